"""Approximate nearest neighbours by multiprobe p-stable hashing.

Unit vectors are projected on Gaussian directions and cut into cells of a fixed width, in several tables. A query visits the
cells around its own in ascending order of the squared distance to them, which is the order of their estimated success.
All cells' vectors are compared exactly in blocks; what the tables found is merged and ranked by cosine in double precision.

The number of directions follows the number of vectors and is at least one. The number of probes is fitted on ``sample`` queries
whose true neighbours are found among all vectors, so that the wanted share of them is found; where the probes do not
suffice, tables are doubled, then a direction is given up.

Equal vectors are one entry with their smallest ids, as many as could be asked for, so a vector that many rows share costs
no more than another. Defined results: null vectors, those with a null or non-finite component, zero vectors and vectors
not of the most frequent dimension take no part. Rows with a null id take no part; repeated ids count as several rows.
"""
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window as W, functions as F

from curbloop.llm.batches import mapped
from curbloop.operators.scratch import stage


@dataclass(frozen=True)
class Settings:
    tables: int = 4             # doubled up to max_tables before a direction is given up
    max_tables: int = 16
    width: float = 1.6          # of a cell, in units of the directions' scale
    per_cell: int = 200         # vectors per cell that the number of directions aims at
    cells_per_direction: float = 3.0
    recall: float = 0.97        # wanted on the sample
    sample: int = 64            # queries the number of probes is fitted on
    max_probes: int = 2048
    hot_cell: int = 100_000     # vectors; larger cells are spread over several tasks
    buffer: int = 200_000       # results a task holds to merge them before it passes them on
    seed: int = 11


class Hashes:
    """Directions, offsets and cells of all tables."""

    def __init__(self, dim: int, directions: int, settings: Settings, tables: int | None = None):
        import numpy as np
        rng = np.random.default_rng(settings.seed)
        self.tables, self.m = tables or settings.tables, directions
        self.a = rng.normal(size=(self.tables, directions, dim))
        self.b = rng.uniform(0, 1, size=(self.tables, directions))
        self.width = settings.width

    def places(self, unit):
        """Positions in cells: (vectors, tables, directions)."""
        import numpy as np
        return np.einsum("nd,tmd->ntm", unit, self.a, optimize=True) / self.width + self.b

    def codes(self, cells, table):
        """64-bit code of a cell (..., directions) of a table."""
        import numpy as np
        h = np.broadcast_to(np.asarray(table, np.uint64) + np.uint64(1), cells.shape[:-1]) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(self.m):
            h = (h ^ cells[..., i].astype(np.int64).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        return h.view(np.int64)

    def probes(self, place, n: int):
        """The first n cells in order of distance from one position (directions,): offsets from its own cell.

        The best sums over the first directions extend to the best sums over one more, so only n are kept at each step."""
        import numpy as np
        inside = place - np.floor(place)
        steps = np.arange(-2, 3)
        cost = np.where(steps[None] < 0, inside[:, None] - steps[None] - 1, np.where(steps[None] > 0, steps[None] - inside[:, None], 0)) ** 2
        total, chosen = np.zeros(1), np.zeros((1, 0), np.int64)
        for i in range(self.m):
            sums = (total[:, None] + cost[i][None]).ravel()
            best = np.argsort(sums, kind="stable")[:n]
            total, chosen = sums[best], np.hstack([chosen[best // 5], steps[best % 5][:, None]])
        return chosen


def entries(rows: DataFrame, k: int, vec_id="vec_id", embedding="embedding") -> DataFrame:
    """Usable rows as (id, vec, k1, k2); equal vectors share k1 and k2."""
    kind = rows.select(embedding).schema[0].dataType
    number = "float" if kind.simpleString() == "array<float>" else "double"  # no digit is lost
    values = rows.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast(f"array<{number}>").alias("vec")).filter(
        "id is not null and vec is not null and size(vec) > 0")
    usable = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return values.filter(F.coalesce(usable, F.lit(False))).withColumns(
        {"k1": F.xxhash64("vec"), "k2": F.xxhash64("vec", F.lit("second"))})


def _kind(rows: DataFrame) -> str:
    return rows.schema["vec"].dataType.simpleString()


def _matrix(column, dim: int):
    import numpy as np
    import pyarrow as pa
    flat = column.flatten() if isinstance(column, (pa.ListArray, pa.LargeListArray)) else pa.concat_arrays([c.flatten() for c in column.chunks])
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    return x


def _unit(x):
    import numpy as np
    return x / np.sqrt((x * x).sum(1))[:, None]


def _top(scores, ids, k: int):
    """Per row the k best columns by score, ties to the smaller id: (row, column)."""
    import numpy as np
    keep = min(k, scores.shape[1])
    part = np.argpartition(-scores, keep - 1, axis=1)[:, :keep] if keep < scores.shape[1] else np.broadcast_to(np.arange(keep), scores.shape)
    least = np.take_along_axis(scores, part, 1).min(1)
    r, c = np.nonzero(scores >= least[:, None])  # all that tie with the last
    order = np.lexsort((ids[c], -scores[r, c], r))
    r, c = r[order], c[order]
    rank = np.arange(len(r)) - np.searchsorted(r, r)
    return r[rank < keep], c[rank < keep]


def _best_rows(parts, k: int):
    """Of rows (k1, k2, id, score) each id once and the k best per (k1, k2)."""
    import numpy as np
    k1, k2, ids, score = (np.concatenate(p) for p in zip(*parts))
    order = np.lexsort((-score, ids, k2, k1))
    k1, k2, ids, score = k1[order], k2[order], ids[order], score[order]
    once = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]) | (ids[1:] != ids[:-1]))
    k1, k2, ids, score = k1[once], k2[once], ids[once], score[once]
    order = np.lexsort((ids, -score, k2, k1))
    k1, k2, ids, score = k1[order], k2[order], ids[order], score[order]
    new = np.append(True, (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
    rank = np.arange(len(k1)) - np.maximum.accumulate(np.where(new, np.arange(len(k1)), 0))
    return k1[rank < k], k2[rank < k], ids[rank < k], score[rank < k]


def _best_of_sample(classes: DataFrame, queries, dim: int, k: int):
    """True neighbours of a few vectors among all classes: every task keeps k per query."""
    def best(batches):
        import numpy as np
        import pyarrow as pa
        unit = _unit(np.array(queries))
        for batch in batches:
            if len(batch):
                v, ids = _matrix(batch.column(1), dim), batch.column(0).to_numpy()
                r, c = _top(unit @ _unit(v).T, ids, k)
                yield pa.RecordBatch.from_arrays([pa.array(r), pa.array((unit @ _unit(v).T)[r, c]), pa.array(ids[c]), batch.column(1).take(pa.array(c))],
                                                 names=["q", "score", "id", "vec"])

    found = mapped(classes.select("id", "vec"), best, f"q long, score double, id long, vec {_kind(classes)}")
    return found.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "id"))).filter(f"r <= {k}").collect()


def fit(classes: DataFrame, n: int, dim: int, k: int, settings: Settings) -> tuple[Hashes, int]:
    """Hash functions and the number of probes per table."""
    import math

    import numpy as np
    directions = max(1, round(math.log(max(n, 1) / settings.per_cell) / math.log(settings.cells_per_direction)))
    drawn = classes.select("id", "vec").orderBy(F.xxhash64("id", F.lit(settings.seed))).limit(settings.sample).collect()
    queries = [r["vec"] for r in drawn]
    found = [r for r in _best_of_sample(classes, queries, dim, k + 1) if r["id"] != drawn[r["q"]]["id"]]
    if not found:  # a single vector
        return Hashes(dim, 1, settings), 1
    near = _unit(np.array([r["vec"] for r in found], float))
    unit = _unit(np.array(queries, float))
    tables = settings.tables
    while True:
        hashes = Hashes(dim, directions, settings, tables)
        own, theirs = hashes.places(unit), np.floor(hashes.places(near)).astype(np.int64)
        first = np.full(len(found), settings.max_probes)
        for q in range(len(queries)):
            of = [i for i, r in enumerate(found) if r["q"] == q]
            for t in range(tables):
                order = hashes.probes(own[q, t], settings.max_probes)
                for i in of:
                    hit = np.flatnonzero((order == theirs[i, t] - np.floor(own[q, t]).astype(np.int64)).all(1))
                    if len(hit):
                        first[i] = min(first[i], hit[0])
        need = int(np.sort(first)[min(len(first) - 1, math.ceil(settings.recall * len(first)) - 1)]) + 1
        if need < settings.max_probes // 2:
            return hashes, need
        if tables < settings.max_tables:
            tables *= 2
        elif directions > 1:
            directions, tables = directions - 1, settings.tables
        else:
            return hashes, 5 ** directions  # all cells within two of one's own


def nearest(rows: DataFrame, is_query, k: int = 5, settings: Settings = Settings(), vec_id="vec_id", embedding="embedding") -> DataFrame:
    """The k nearest rows found for every row that ``is_query`` (a column expression on ``id``): (query_id, rank, vec_id, score)."""
    all_rows = entries(rows, k, vec_id, embedding)
    ranked = all_rows.withColumn("r", F.row_number().over(W.partitionBy("k1", "k2").orderBy("id")))
    # the limit is applied before the shuffle too, so a common vector does not meet in one task
    classes = ranked.filter(f"r <= {k + 1}").groupBy("k1", "k2").agg(
        F.min("id").alias("id"), F.array_sort(F.collect_list("id")).alias("members"), F.first("vec").alias("vec"))
    classes = stage(classes, "vector-classes")
    dims = classes.groupBy(F.size("vec").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "dim").limit(1).collect()
    result = "query_id long, rank int, vec_id long, score double"
    if not dims:
        return rows.sparkSession.createDataFrame([], result)
    dim, n = dims[0]["dim"], dims[0]["n"]
    classes = classes.filter(F.size("vec") == dim)
    asking = all_rows.filter(F.size("vec") == dim).filter(is_query).select("id", "k1", "k2", "vec")
    hashes, probes = fit(classes, n, dim, k, settings)
    found = _search(classes, asking.dropDuplicates(["k1", "k2"]).select("k1", "k2", "vec"), hashes, probes, dim, k, settings)
    merged = found.groupBy("k1", "k2", "id").agg(F.max("score").alias("score"))
    best = merged.withColumn("r", F.row_number().over(W.partitionBy("k1", "k2").orderBy(F.desc("score"), "id"))).filter(f"r <= {k + 1}")
    best = stage(best.drop("r"), "nearest-classes").join(classes.select("id", "members"), "id")
    pairs = (asking.select(F.col("id").alias("query_id"), "k1", "k2").join(best.drop("id"), ["k1", "k2"])
             .select("query_id", "score", F.posexplode("members").alias("copy", "vec_id")))
    # a repeated id stays a neighbour of itself once per further row
    selves = W.partitionBy("query_id", "vec_id").orderBy("copy")
    others = pairs.withColumn("own", (F.col("vec_id") == F.col("query_id")) & (F.row_number().over(selves) == 1)).filter("not own")
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (others.withColumn("rank", F.row_number().over(order)).filter(f"rank <= {k}").select("query_id", "rank", "vec_id", "score"))


def _search(classes, queries, hashes: Hashes, probes: int, dim: int, k: int, settings: Settings) -> DataFrame:
    cell = f"cell long, kind int, id long, k1 long, k2 long, vec {_kind(classes)}"

    def place(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if not len(batch):
                continue
            cells = np.floor(hashes.places(_unit(_matrix(batch.column("vec"), dim)))).astype(np.int64)
            for t in range(hashes.tables):
                none = pa.nulls(len(batch), pa.int64())
                yield pa.RecordBatch.from_arrays([
                    pa.array(hashes.codes(cells[:, t], t)), pa.array(np.ones(len(batch), np.int32)), batch.column("id"), none, none,
                    batch.column("vec")], names=["cell", "kind", "id", "k1", "k2", "vec"])

    def visit(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            if not len(batch):
                continue
            at = hashes.places(_unit(_matrix(batch.column("vec"), dim)))
            for q in range(len(batch)):
                codes = [hashes.codes(np.floor(at[q, t]).astype(np.int64) + hashes.probes(at[q, t], probes), t)
                         for t in range(hashes.tables)]
                codes = np.unique(np.concatenate(codes))
                take = pa.array(np.full(len(codes), q))
                yield pa.RecordBatch.from_arrays([
                    pa.array(codes), pa.array(np.zeros(len(codes), np.int32)), pa.nulls(len(codes), pa.int64()), batch.column("k1").take(take),
                    batch.column("k2").take(take), batch.column("vec").take(take)],
                    names=["cell", "kind", "id", "k1", "k2", "vec"])

    def compare(batches):
        import numpy as np
        import pyarrow as pa
        now, held, unit, kept, n_kept = None, [], None, [], 0

        def rows(parts):
            return pa.RecordBatch.from_arrays([pa.array(x) for x in parts], names=["k1", "k2", "id", "score"])

        for batch in batches:
            cells = batch.column("cell").to_numpy()
            kinds, salts = batch.column("kind").to_numpy(), batch.column("salt").to_numpy()
            cuts = np.flatnonzero((np.diff(cells) != 0) | (np.diff(kinds) != 0) | (np.diff(salts) != 0)) + 1
            for a, b in zip(np.append(0, cuts), np.append(cuts, len(batch))):
                if a == b:
                    continue
                if now != (cells[a], salts[a]):
                    now, held, unit = (cells[a], salts[a]), [], None
                part = batch.slice(a, b - a)
                if kinds[a] == 0:
                    held.append(part.select(["k1", "k2", "vec"]))
                    continue
                if not held:
                    continue
                if unit is None:
                    asked = pa.Table.from_batches(held)
                    unit, k1, k2 = _unit(_matrix(asked.column("vec"), dim)), asked.column("k1").to_numpy(), asked.column("k2").to_numpy()
                v, ids = _unit(_matrix(part.column("vec"), dim)), part.column("id").to_numpy()
                for first in range(0, len(unit), 1024):
                    scores = unit[first:first + 1024] @ v.T
                    r, c = _top(scores, ids, k + 1)
                    kept.append((k1[r + first], k2[r + first], ids[c], scores[r, c]))
                    n_kept += len(r)
                if n_kept > settings.buffer:
                    kept = [_best_rows(kept, k + 1)]
                    n_kept = len(kept[0][0])
                    if n_kept > settings.buffer // 2:
                        yield rows(kept[0])
                        kept, n_kept = [], 0
        if kept:
            yield rows(_best_rows(kept, k + 1))

    index = mapped(classes.select("id", "vec"), place, cell).withColumn("salt", F.lit(0))
    asked = mapped(queries, visit, cell).withColumn("salt", F.lit(0))
    crowded = stage(mapped(classes.select("id", "vec"), place, cell).groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
                    .filter(F.col("n") > settings.hot_cell).select("cell", F.ceil(F.col("n") / settings.hot_cell).cast("int").alias("parts")), "cells")
    if crowded.limit(1).count():
        index = index.drop("salt").join(crowded, "cell", "left").withColumn(
            "salt", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        asked = asked.drop("salt").join(crowded, "cell", "left").withColumn(
            "salt", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    both = index.unionByName(asked)
    n = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = both.repartition(n, "cell", "salt").sortWithinPartitions("cell", "salt", "kind")
    return mapped(dealt, compare, "k1 long, k2 long, id long, score double")

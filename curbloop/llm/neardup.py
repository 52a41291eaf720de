"""Near-duplicate documents by order MinHash.

Every sketch keeps, of one random order of all occurrence-labelled k-mers of words, the smallest few, in the order they have in
the text. Texts that share such a key are candidates. First each is compared with few others of its group, chosen by how many
keys they share. Then all get further keys: sketches of a single k-mer of 3 words, and for texts of few words all that is left
of them without one or two words, so that no similar pair of those is missed. In groups that hold several components, every pair of
different components is a candidate that agrees in enough of its single sketches and is not ruled out by its word counts. A block of such
pairs is settled in one task, which joins components as it goes, so pairs that are joined already cost nothing and only joining pairs
leave the task. A banded alignment of the words decides:
1 - edits / words of the longer text must reach ``similarity``. Classes are connected components of the accepted pairs.

Defined results: equal texts are one class, empty ones too. A null text is a class of its own. Texts of fewer words than a k-mer
have one k-mer, all their words. The class id is the smallest document id of the class (null if all are null). Repeated
ids are several documents. Only the two named columns are read.
"""
import functools
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, functions as F

from curbloop.llm.batches import mapped
from curbloop.operators.layout import skew_join
from curbloop.operators.scratch import stage, tidy


@dataclass(frozen=True)
class Settings:
    words: int = 5            # of a k-mer
    kept: int = 2             # k-mers per sketch
    sketches: int = 32
    similarity: float = 0.8
    block: int = 512          # texts of a group compared with each other
    hot: int = 20_000         # texts; larger groups are spread over several tasks
    small: int = 1_000_000    # candidates whose ids may be broadcast (8 bytes each)
    seed: int = 5
    part: int = 4096          # members of a group that meet the members of another part in one task
    exact: int = 14           # words; pairs of texts up to this long are found for certain if at most two edits are allowed
    single: int = 3           # words of the k-mer of a single sketch
    short: int = 80           # words; longer texts form groups by ``few`` of their single sketches
    few: int = 16
    agree: int = 4            # single sketches that must be equal; 2 if one of the texts is short
    settled: int = 10_000     # pairs that are settled in one go


BUCKETS = 256  # of word counts


def word_hashes(text: str):
    """64-bit hashes of the words between white space, in text order."""
    import numpy as np
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    return hashes_of(raw, np.zeros(1, np.int64), np.array([len(raw)]))[0]


def hashes_of(raw, starts, ends):
    """Word hashes of texts that lie in one byte array, with the number of words of each: (hashes, counts).

    A word's hash is the sum of its bytes times powers of an odd number (mod 2^64), shifted to the word's start and mixed."""
    import numpy as np
    space = (raw == 32) | ((raw >= 9) & (raw <= 13))
    inside = np.zeros(len(raw) + 1, bool)
    inside[:-1] = ~space
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    edge = starts[(starts < ends)]
    first[edge] = inside[edge]  # a text's first word starts there even if the text before ends without a space
    at = np.flatnonzero(first)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(starts), np.int64)
    owner = np.searchsorted(starts, at, "right") - 1
    value = np.where(space, 0, raw.astype(np.uint64) + np.uint64(1))
    place = np.zeros(len(raw), np.int64)  # inside a word
    place[at[0]:] = np.arange(at[0], len(raw)) - np.repeat(at, np.diff(at, append=len(raw)))
    longest = int(place[~space].max())
    # spaces count 0, so what follows a word does not matter
    h = np.add.reduceat(value * _powers(longest + 1)[np.minimum(place, longest)], at)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h, np.bincount(owner, minlength=len(starts))


BASE = 0x5851F42D4C957F2D


def _powers(n: int):
    import numpy as np
    table = np.full(n, BASE, np.uint64)
    table[0] = 1
    return np.multiply.accumulate(table)


def sketch(words, settings: Settings):
    """Keys of one text, one per sketch, as signed 64-bit numbers."""
    import numpy as np
    k, n = min(settings.words, len(words)), max(1, len(words) - settings.words + 1)
    h = np.zeros(n, np.uint64)
    for i in range(k):
        h = (h ^ words[i:i + n]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(31)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if same.any():  # the second, third, ... occurrence of a k-mer counts as another one
        run = np.arange(n) - np.maximum.accumulate(np.where(np.append(True, ~same), np.arange(n), 0))
        label = np.empty(n, np.uint64)
        label[order] = run.astype(np.uint64)
        again = (h ^ label * np.uint64(0x94D049BB133111EB)) * np.uint64(0x9E3779B97F4A7C15)
        h = np.where(label > 0, again ^ again >> np.uint64(30), h)
    a, b = _orders(settings)
    y = h[None, :] * a[:, None] + b[:, None]
    y ^= y >> np.uint64(32)
    rows, chosen = np.arange(len(a)), []
    for i in range(settings.kept):
        least = y.argmin(1)
        chosen.append(least if i < n else chosen[-1])
        y[rows, least] = np.uint64(2**64 - 1)
    key = np.zeros(len(a), np.uint64)
    for p in np.sort(np.stack(chosen), axis=0):  # in text order
        key = (key ^ h[p]) * np.uint64(0xBF58476D1CE4E5B9)
        key ^= key >> np.uint64(31)
    return key.view(np.int64)


def deletions(words, settings: Settings):
    """Keys of a short text: all that is left of it without one or two words. Texts that differ by up to two edits share one."""
    import numpy as np
    n = len(words)
    if not 0 < n <= settings.exact:
        return np.zeros(0, np.int64)
    keys, longest = [], int(n / settings.similarity + 1e-9)  # of a partner
    for drop in range(min(2, int(allowed(longest, settings.similarity)), n - 1) + 1):
        h = np.full(1, 0x9E3779B97F4A7C15 * (n - drop) & (2**64 - 1), np.uint64)
        for column in words[_without(n, drop)].T:
            h = (h ^ column) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
        keys.append(np.unique(h).view(np.int64))
    return np.concatenate(keys)


def single_keys(words, settings: Settings):
    """Sketches of one k-mer each: a pair whose edits are scattered agrees in many of these although it may share no key of ``sketch``.
    Texts that only pair by ``deletions`` have none."""
    import numpy as np
    if len(words) <= settings.exact * settings.similarity:
        return np.zeros(0, np.int64)
    of = np.arange(settings.sketches, dtype=np.uint64) + np.uint64(1000)
    return sketch(words, replace(settings, words=settings.single, kept=1)) ^ (of * np.uint64(0x94D049BB133111EB)).view(np.int64)


@functools.cache
def _without(n: int, drop: int):
    """Places of the words that stay when ``drop`` of n are left out, in every way."""
    import itertools

    import numpy as np
    return np.array(list(itertools.combinations(range(n), n - drop)))


@functools.cache
def _orders(settings: Settings):
    import numpy as np
    rng = np.random.default_rng(settings.seed)
    a = rng.integers(1, 1 << 63, settings.sketches, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    return a, rng.integers(0, 1 << 63, settings.sketches, dtype=np.uint64)


def edits_within(a: list, b: list, most: int) -> bool:
    """Whether at most ``most`` insertions, deletions and replacements turn a into b: the bit-parallel alignment of Hyyrö (2003) in a
    band of 2 * most + 1 diagonals that slides down one row per column."""
    while a and b and a[-1] == b[-1]:
        a, b = a[:-1], b[:-1]
    same = 0
    while same < min(len(a), len(b)) and a[same] == b[same]:
        same += 1
    a, b = a[same:], b[same:]
    if abs(len(a) - len(b)) > most:
        return False
    if len(a) <= most and len(b) <= most:
        return True
    if len(a) < most:
        a, b = b, a
    most = min(most, len(a))
    places: dict = {}
    for r, word in enumerate(a):
        places[word] = places.get(word, 0) | 1 << r
    width = 2 * most + 1
    mask, corner = (1 << width) - 1, 1 << width - 1
    up, down, score, row = mask ^ ((1 << most) - 1), 0, most, width - 2
    limit = most + len(b) - (len(a) - most)
    for j, word in enumerate(b):
        match = places.get(word, 0)
        match = (match >> j - most if j >= most else match << most - j) & mask
        diagonal = (((match & up) + up) ^ up | match | down) & mask
        right, left = down | mask & ~(diagonal | up), diagonal & up
        if j < len(a) - most:
            score += not diagonal & corner
        else:
            score += (right >> row & 1) - (left >> row & 1)
            row -= 1
        if score > limit:
            return False
        moved = diagonal >> 1
        up, down = left | mask & ~(moved | right), moved & right
    return score <= most


def allowed(longest, similarity: float):
    """Edits that two texts may differ by."""
    return ((1 - similarity) * longest + 1e-9) // 1


def similar(a, b, similarity: float) -> bool:
    """Words of two texts, as arrays."""
    most = int(allowed(max(len(a), len(b)), similarity))
    return abs(len(a) - len(b)) <= most and edits_within(a.tolist(), b.tolist(), most)


def counts_of(words):
    """Words by bucket, at most 255 each. An edit changes one word, so texts whose counts are further apart than their edits allow
    cannot be similar."""
    import numpy as np
    return np.minimum(np.bincount((words >> np.uint64(40)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 255).astype(np.uint8)


def marks_of(keys, kind="u1") -> bytes:
    """The low bits of each key."""
    import numpy as np
    return keys.astype(np.dtype(kind)).tobytes()


NODE = "node long, keys array<long>, marks binary, size int, counts binary, single array<long>, single_marks binary, exact array<long>"


def sketches(docs: DataFrame, settings: Settings = Settings(), doc_id="doc_id", text="text") -> DataFrame:
    """(doc_id, node, ...) of every row with a text: ``node`` is a hash of the text, ``keys`` its sketches and ``marks`` one byte of each,
    ``size`` the number of words, ``counts`` those by bucket, ``single`` and ``exact`` its further keys. Texts without words have no keys."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("node"), F.col(text).alias("text")).filter("text is not null")

    def draw(batches):
        import numpy as np
        import pyarrow as pa

        def lists(values):
            flat = np.concatenate(values) if values else np.zeros(0, np.int64)
            return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]), pa.int32()), pa.array(flat))

        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                texts = _words_of(part.column(2))
                none = np.zeros(0, np.int64)
                keys = [sketch(w, settings) if len(w) else none for w in texts]
                single = [single_keys(w, settings) for w in texts]
                grouped = [k if len(w) <= settings.short else k[:settings.few] for k, w in zip(single, texts)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0), part.column(1), lists(keys), pa.array(map(marks_of, keys), pa.binary()), pa.array([len(w) for w in texts], pa.int32()),
                    pa.array([counts_of(w).tobytes() for w in texts], pa.binary()), lists(grouped), pa.array([marks_of(k, "<u4") for k in single], pa.binary()),
                    lists([deletions(w, settings) for w in texts])],
                    names=["doc_id", "node", "keys", "marks", "size", "counts", "single", "single_marks", "exact"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return mapped(rows, draw, f"doc_id {id_type}, {NODE}")


def _words_of(column):
    """Word hashes of each text of an Arrow string column."""
    import numpy as np
    import pyarrow as pa
    raw = column.cast(pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset:raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    h, counts = hashes_of(data, offsets[:-1] - offsets[0], offsets[1:] - offsets[0])
    return np.split(h, np.cumsum(counts)[:-1])


def pairs_of(marks, nodes, settings: Settings):
    """Pairs (later, earlier) of one group, about one per member: with the group's first if they share a quarter of their keys, else with
    the one before in the same block that shares most."""
    import numpy as np
    n = len(nodes)
    lead = (marks[1:] == marks[:1]).sum(1) * 4 >= settings.sketches
    out = [(np.flatnonzero(lead) + 1, np.zeros(int(lead.sum()), np.int64))]
    rest = np.append(0, np.flatnonzero(~lead) + 1)
    for a in range(0, len(rest), settings.block):
        block = rest[a:a + settings.block]
        if len(block) < 2:
            if a:
                out.append((block, np.zeros(1, np.int64)))
            continue
        shared = (marks[block][:, None, :] == marks[block][None, :, :]).sum(2)
        shared[np.triu_indices(len(block))] = -1
        out.append((block[1:], block[shared[1:].argmax(1)]))
        if a:
            out.append((block[:1], np.zeros(1, np.int64)))
    return [(nodes[x], nodes[y]) for x, y in out if len(x)]


def candidates(nodes: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Distinct pairs (a, b) of nodes to compare."""
    groups = nodes.select("node", "marks", F.posexplode("keys").alias("s", "key")).select(
        F.xxhash64("s", "key").alias("group"), "node", "marks")
    hot = stage(groups.groupBy("group").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("node", "marks")).alias("lead")).filter(F.col("n") > settings.hot)
                .select("group", F.ceil(F.col("n") / settings.hot).cast("int").alias("parts"), "lead"), "hot-groups")
    groups = groups.withColumn("part", F.lit(0))
    if hot.limit(1).count():  # every part of a large group also gets the group's first text, so parts stay linked
        spread = groups.drop("part").join(hot.select("group", "parts"), "group", "left")
        own = spread.withColumn("part", F.pmod(F.xxhash64("node"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
        leads = hot.select("group", "lead.node", "lead.marks", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
        groups = own.unionByName(leads)

    def pair(batches):
        import numpy as np
        import pyarrow as pa
        held = None

        def pairs(group, nodes, marks):
            for a, b in pairs_of(marks, nodes, settings):
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            group = batch.column("group").to_numpy()
            part = batch.column("part").to_numpy()
            nodes = batch.column("node").to_numpy()
            marks = np.frombuffer(b"".join(batch.column("marks").to_pylist()), np.uint8).reshape(len(batch), settings.sketches) if len(batch) else None
            if marks is None:
                continue
            cuts = np.append(np.flatnonzero((np.diff(group) != 0) | (np.diff(part) != 0)) + 1, len(batch))
            starts = np.append(0, cuts[:-1])
            inner = np.flatnonzero(cuts - starts > 1)
            for k in sorted({0, *inner.tolist(), len(cuts) - 1}):
                x, y = starts[k], cuts[k]
                name = (group[x], part[x])
                if held is not None and held[0] == name:
                    held = (name, np.append(held[1], nodes[x:y]), np.vstack([held[2], marks[x:y]]))
                else:
                    if held is not None and len(held[1]) > 1:
                        yield from pairs(*held)
                    held = (name, nodes[x:y], marks[x:y])
        if held is not None and len(held[1]) > 1:
            yield from pairs(*held)

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = groups.repartition(n, "group", "part").sortWithinPartitions("group", "part", "node")
    found = mapped(dealt.select("group", "part", "node", "marks"), pair, "a long, b long")
    return found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()


def words_of_nodes(ids: DataFrame, docs: DataFrame, settings: Settings, text="text") -> DataFrame:
    """(node, words: 4 bytes each) of the nodes listed."""
    texts = docs.select(F.xxhash64(text).alias("node"), F.col(text).alias("text")).filter("text is not null")
    wanted = F.broadcast(ids) if ids.limit(settings.small + 1).count() <= settings.small else ids

    def hashed(batches):
        import pyarrow as pa
        for batch in batches:
            for first in range(0, len(batch), 256):
                part = batch.slice(first, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([w.astype("<u4").tobytes() for w in _words_of(part.column(1))], pa.binary())],
                                                 names=["node", "words"])

    words = mapped(texts.join(wanted, "node", "left_semi"), hashed, "node long, words binary")
    return stage(words.groupBy("node").agg(F.first("words").alias("words")), "candidate-words")


def accepted(pairs: DataFrame, docs: DataFrame, settings: Settings = Settings(), text="text") -> DataFrame:
    """The pairs whose texts are similar enough."""
    ids = stage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct(), "candidate-ids")
    words = words_of_nodes(ids, docs, settings, text)
    both = (pairs.join(words.select(F.col("node").alias("a"), F.col("words").alias("wa")), "a")
            .join(words.select(F.col("node").alias("b"), F.col("words").alias("wb")), "b"))

    def align(batches):
        import numpy as np
        import pyarrow as pa
        for batch in batches:
            wa, wb = (batch.column(c).to_pylist() for c in ("wa", "wb"))
            ok = [similar(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4"), settings.similarity) for x, y in zip(wa, wb)]
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return stage(mapped(both.select("a", "b", "wa", "wb"), align, "a long, b long"), "similar-pairs")


def components(edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(node, label) of all nodes of the edges: the smallest node that each is connected with. A round takes the smallest label of the
    neighbours and then follows labels twice; rounds are written, so a lost executor costs one round."""
    both = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
    labels = stage(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy("a").agg(F.min("label").alias("m"))
        new = labels.join(near, labels["node"] == near["a"]).select("node", F.least("label", "m").alias("label"), F.col("label").alias("old"))
        for _ in range(2):
            step = new.select(F.col("node").alias("at"), F.col("label").alias("next"))
            new = new.join(step, new["label"] == step["at"]).select("node", F.col("next").alias("label"), "old")
        new = stage(new, "labels")
        labels = new.select("node", "label")
        if not new.filter("label <> old").limit(1).count():
            return labels
    raise RuntimeError("components did not settle")


def cross_pairs(side, label, size, counts, marks, sketch_no: int, settings: Settings):
    """Index pairs of one block, with the number of sketches in which they agree: those whose labels differ, that agree in enough sketches
    and in none before this block's (there they meet, too), and that their counts do not rule out. Blocks of deletions have the sketch number -1
    and ask nothing of sketches. Sides 0 and 1 meet each other, side 2 meets itself."""
    import numpy as np
    itself = side[0] == 2
    left = np.flatnonzero(side != 1)
    right = left if itself else np.flatnonzero(side == 1)
    rank = np.arange(len(right))
    for first in range(0, len(left), 64):
        some = left[first:first + 64]
        longest = np.maximum(size[some][:, None], size[right])
        open_ = (label[some][:, None] != label[right]) & (np.abs(size[some][:, None] - size[right]) <= allowed(longest, settings.similarity))
        if itself:
            open_ &= rank > np.arange(first, first + len(some))[:, None]
        a, b = np.nonzero(open_)
        for k in range(0, len(a), 20_000):
            x, y = some[a[k:k + 20_000]], right[b[k:k + 20_000]]
            agree = np.zeros(len(x), np.int64)
            if sketch_no >= 0:
                same = marks[x] == marks[y]
                agree = same.sum(1)
                enough = agree >= np.where(np.minimum(size[x], size[y]) <= settings.short, min(2, settings.agree), settings.agree)
                enough &= ~same[:, :sketch_no].any(1)
                x, y, agree = x[enough], y[enough], agree[enough]
            apart = counts[x].astype(np.int16) - counts[y]
            edits = np.maximum(np.maximum(apart, 0).sum(1), np.maximum(-apart, 0).sum(1))
            ok = edits <= allowed(np.maximum(size[x], size[y]), settings.similarity)
            if ok.any():
                yield x[ok], y[ok], agree[ok]


def open_members(keyed: DataFrame, settings: Settings) -> DataFrame:
    """Of rows (group, sketch, node, label), those of groups with several labels, with the most frequent label of the group (``main``) and the
    number of rows that have it and that do not."""
    several = keyed.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("group")
    members = stage(keyed.join(several, "group", "left_semi"), "open-members")
    sizes = members.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"))
    groups = sizes.groupBy("group").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.max("n").alias("n_main"), F.sum("n").alias("n"))
    groups = stage(groups.withColumn("copies", F.ceil(F.col("n") / settings.hot).cast("int")), "open-groups")
    hot = groups.filter("copies > 1").select("group", "copies")
    known = members.withColumn("salt", F.lit(0))
    if hot.limit(1).count():
        known = members.join(hot, "group", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.coalesce("copies", F.lit(1))).cast("int")).drop("copies")
    spread = groups.select("group", "main", "n_main", (F.col("n") - F.col("n_main")).alias("n_rest"), F.explode(F.sequence(F.lit(0), F.col("copies") - 1)).alias("salt"))
    return known.join(spread, ["group", "salt"]).drop("salt")


def blocks(members: DataFrame, settings: Settings) -> DataFrame:
    """Rows of ``open_members`` dealt to blocks of bounded size in which every two of different labels meet: a part of the main label with a
    part of the rest, and two parts of the rest."""
    parts = members.withColumns({"p": F.greatest(F.lit(1), F.ceil(F.col("n_main") / settings.part)).cast("int"),
                                 "q": F.ceil(F.col("n_rest") / settings.part).cast("int")})
    at = F.expr("cast(pmod(xxhash64(node, group), if(label = main, p, q)) as int)")
    return parts.withColumn("at", at).selectExpr("node", "label", "sketch", "group", """explode(if(label = main,
        transform(sequence(0, q - 1), b -> named_struct('kind', 0, 'a', at, 'b', b, 'side', 0)),
        concat(transform(sequence(0, p - 1), a -> named_struct('kind', 0, 'a', a, 'b', at, 'side', 1)),
               transform(sequence(0, q - 1), b -> named_struct('kind', 1, 'a', least(at, b), 'b', greatest(at, b),
                                                               'side', if(at = b, 2, if(at < b, 0, 1))))))) AS d""").selectExpr(
        "xxhash64(group, d.kind, d.a, d.b) AS block", "sketch", "d.side", "node", "label")


def in_runs(batches):
    """Runs of equal values of the first column, by which rows were dealt and sorted: (value, its batches)."""
    import numpy as np
    held, name = [], None
    for batch in batches:
        if not len(batch):
            continue
        keys = batch.column(0).to_numpy()
        cuts = np.append(np.flatnonzero(np.diff(keys)) + 1, len(batch))
        for x, y in zip(np.append(0, cuts[:-1]).tolist(), cuts.tolist()):
            if held and name != keys[x]:
                yield name, held
                held = []
            name = keys[x]
            held.append(batch.slice(x, y - x))
    if held:
        yield name, held


def _column(parts, k: int):
    import numpy as np
    return np.concatenate([p.column(k).to_numpy(zero_copy_only=False) for p in parts])


def _raw(parts, k: int, kind, width: int):
    import numpy as np
    return np.frombuffer(b"".join(v for p in parts for v in p.column(k).to_pylist()), kind).reshape(-1, width)


def further(members: DataFrame, nodes: DataFrame, settings: Settings) -> DataFrame:
    """Pairs to be settled, one row for at most ``settled`` of them: (portion, nodes, labels, pairs), where pairs are places in nodes,
    4 bytes each, those that agree most first."""
    rows = blocks(members, settings).join(nodes.select("node", "size", "counts", "single_marks"), "node")

    def pair(batches):
        import numpy as np
        import pyarrow as pa

        def portion(block, number, found, node, label):
            a, b, agree = (np.concatenate([f[k] for f in found]) for k in range(3))
            order = np.argsort(-agree, kind="stable")
            used, places = np.unique(np.concatenate([a[order], b[order]]), return_inverse=True)
            pairs = places.reshape(2, -1).T.astype("<u4").tobytes()
            return pa.RecordBatch.from_pylist([{"block": int(block), "number": number, "nodes": node[used].tolist(), "labels": label[used].tolist(), "pairs": pairs}], schema=schema)

        schema = pa.schema([("block", pa.int64()), ("number", pa.int64()), ("nodes", pa.list_(pa.int64())), ("labels", pa.list_(pa.int64())), ("pairs", pa.binary())])
        for block, parts in in_runs(batches):
            sketch_no, side, node, label, size = (_column(parts, k) for k in range(1, 6))
            counts = _raw(parts, 6, np.uint8, BUCKETS)
            marks = None if sketch_no[0] < 0 else _raw(parts, 7, "<u4", settings.sketches)
            found, number = [], 0
            for pairs in cross_pairs(side, label, size, counts, marks, int(sketch_no[0]), settings):
                found.append(pairs)
                if sum(len(f[0]) for f in found) >= settings.settled:
                    yield portion(block, number, found, node, label)
                    found, number = [], number + 1
            if found:
                yield portion(block, number, found, node, label)

    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "block").sortWithinPartitions("block", "node")
    found = mapped(dealt.select("block", "sketch", "side", "node", "label", "size", "counts", "single_marks"), pair,
                   "block long, number long, nodes array<long>, labels array<long>, pairs binary")
    return found.select(F.xxhash64("block", "number").alias("portion"), "nodes", "labels", "pairs")


def occurrences(words):
    """The words in ascending order, each second, third, ... occurrence of a word as another one: as a set it stands for the multiset."""
    import numpy as np
    w = np.sort(words.astype(np.uint64))
    start = np.append(True, w[1:] != w[:-1])
    nth = np.arange(len(w)) - np.maximum.accumulate(np.where(start, np.arange(len(w)), 0))
    return np.sort(w << np.uint64(24) | np.minimum(nth, (1 << 24) - 1).astype(np.uint64))


def settle(words: list, labels: list, pairs, similarity: float) -> list:
    """Pairs of labels that similar texts join, at most one less than there are labels. Pairs of labels that are joined already are passed over;
    the others are aligned if the words that only one of the two has are not too many."""
    import numpy as np
    of = {label: label for label in labels}

    def root(label):
        while of[label] != label:
            of[label] = label = of[of[label]]
        return label

    joined, sets = [], {}
    for x, y in pairs:
        a, b = root(labels[x]), root(labels[y])
        if a == b:
            continue
        for k in (x, y):
            if k not in sets:
                sets[k] = occurrences(words[k])
        longest = max(len(words[x]), len(words[y]))
        shared = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        if longest - shared <= allowed(longest, similarity) and similar(words[x], words[y], similarity):
            of[max(a, b)] = min(a, b)
            joined.append((min(a, b), max(a, b)))
    return joined


def settled(portions: DataFrame, words: DataFrame, settings: Settings) -> DataFrame:
    """Distinct pairs (a, b) of labels that are joined. ``words`` has (node, words) of all nodes of the portions."""
    of = portions.select("portion", F.posexplode("nodes").alias("place", "node")).join(words, "node")
    rows = (of.select("portion", "place", "words").withColumns({"labels": F.lit(None).cast("array<long>"), "pairs": F.lit(None).cast("binary")})
            .unionByName(portions.select("portion", F.lit(-1).alias("place"), F.lit(None).cast("binary").alias("words"), "labels", "pairs")))

    def align(batches):
        import numpy as np
        import pyarrow as pa
        for _, parts in in_runs(batches):
            own = [v for p in parts for v in p.column(2).to_pylist()]  # the first row is that of the pairs
            pairs = np.frombuffer(next(iter(parts[0].column(4).to_pylist())), "<u4").reshape(-1, 2).tolist()
            joined = settle([np.frombuffer(w, "<u4") for w in own[1:]], parts[0].column(3)[0].as_py(), pairs, settings.similarity)
            if joined:
                yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in joined], pa.int64()) for k in (0, 1)], names=["a", "b"])

    n = int(words.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartition(n, "portion").sortWithinPartitions("portion", "place")
    return mapped(dealt.select("portion", "place", "words", "labels", "pairs"), align, "a long, b long").distinct()


def connected(nodes: DataFrame, docs: DataFrame, settings: Settings = Settings(), text="text") -> DataFrame:
    """(node, label) of all nodes; similar ones share a label."""
    pairs = stage(candidates(nodes.filter("size(keys) > 0"), settings), "candidate-pairs")
    found = components(accepted(pairs, docs, settings, text))
    labels = stage(nodes.select("node").join(found, "node", "left").select("node", F.coalesce("label", "node").alias("label")), "labels")
    keys = F.concat(F.transform("exact", lambda key: F.struct(F.xxhash64(F.lit(-1), key).alias("group"), F.lit(-1).alias("sketch"))),
                    F.transform("single", lambda key, s: F.struct(F.xxhash64(s, key).alias("group"), s.alias("sketch"))))
    keyed = nodes.select("node", F.explode(keys).alias("k")).join(labels, "node").select("k.group", "k.sketch", "node", "label")
    portions = stage(further(open_members(keyed, settings), nodes, settings), "portions")
    ids = stage(portions.select(F.explode("nodes").alias("node")).distinct(), "portion-nodes")
    joined = stage(settled(portions, words_of_nodes(ids, docs, settings, text), settings), "joined")
    if not joined.limit(1).count():
        return labels
    moved = components(joined).select(F.col("node").alias("label"), F.col("label").alias("to"))
    return stage(labels.join(moved, "label", "left").select("node", F.coalesce("to", "label").alias("label")), "labels")


def classes(docs: DataFrame, settings: Settings = Settings(), doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: (doc_id, class_id, class_size, text_hash)."""
    rows = stage(sketches(docs, settings, doc_id, text), "sketches")
    with tidy(docs.sparkSession) as kept:
        columns = [c.split()[0] for c in NODE.split(", ")[1:]]
        nodes = stage(rows.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"), *[F.first(c).alias(c) for c in columns]), "nodes")
        own = nodes.select("node", "first_id", "n").join(connected(nodes, docs, settings, text), "node")
        found = own.groupBy("label").agg(F.min("first_id").alias("class_id"), F.sum("n").alias("class_size"))
        of = kept(stage(own.select("node", "label").join(found, "label").select("node", "class_id", "class_size"), "classes"))
    # most texts are one row, but one text may be a third of all
    known = skew_join(rows.select("doc_id", "node"), of, ["node"], ["doc_id"]).select("doc_id", "class_id", "class_size", F.col("node").alias("text_hash"))
    null = docs.filter(F.col(text).isNull()).select(
        F.col(doc_id).alias("doc_id"), F.col(doc_id).alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(None).cast("long").alias("text_hash"))
    return known.union(null)


def keep_one(docs: DataFrame, settings: Settings = Settings(), doc_id="doc_id", text="text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class the document with the smallest id stays, once if it is repeated. Rows
    without a text stay."""
    found = stage(classes(docs, settings, doc_id, text), "document-classes").filter("text_hash is not null")
    keys = [F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")]
    drop = stage(found.filter(~F.col("doc_id").eqNullSafe(F.col("class_id"))).select(*keys).distinct(), "dropped")
    again = stage(found.filter(F.col("doc_id").eqNullSafe(F.col("class_id"))).groupBy(*keys).count().filter("count > 1").drop("count"), "repeated")
    rows = docs.withColumn("_text_hash", F.xxhash64(text))

    def held(table):
        sized = F.broadcast(table) if table.limit(settings.small + 1).count() <= settings.small else table
        return sized, rows[doc_id].eqNullSafe(sized["_id"]) & (rows["_text_hash"] == sized["_hash"])

    out = rows.join(*held(drop), "left_anti")
    if again.limit(1).count():
        once = rows.join(*held(again), "left_semi").dropDuplicates([doc_id, "_text_hash"])
        out = out.join(F.broadcast(again) if again.limit(settings.small + 1).count() <= settings.small else again,
                       out[doc_id].eqNullSafe(again["_id"]) & (out["_text_hash"] == again["_hash"]), "left_anti").unionByName(once)
    return out.drop("_text_hash")

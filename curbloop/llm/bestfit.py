"""Few sequences by best-fit decreasing, certified by lower bounds and repacked where they leave a gap.

Documents longer than a sequence are cut into whole sequences and one first piece that may be shorter. Pieces are dealt evenly
over partitions, whatever their ids. A partition is packed by best-fit decreasing and its number of sequences is compared with
lower bounds of dual feasible functions. Partitions whose number equals the bound are certified and give up their emptiest
sequence only. The others, which have a gap, give up all sequences that are not full. These documents are dealt anew over fewer partitions and
packed again, as long as that saves sequences.

Equal lengths are packed at once, so a partition costs by its different lengths and not by its rows.

Defined results: a null text is empty; an empty document is its end id alone. Every row is packed, also repeated ones and those
with a null id. ``cut`` reads the two named columns only. ``pack`` keeps all columns of its pieces and replaces its own:
``sequence_id``, ``offset`` and the certificate: ``part`` (where the piece was packed last), ``part_bins`` and ``part_bound`` (its sequences then, and
their bound). Lengths that are null, below 1 or above the capacity are
refused. An empty table gives no rows.
"""
from pyspark.sql import DataFrame, Window as W, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from curbloop.llm.batches import mapped
from curbloop.llm.tokens import encoder, public_path
from curbloop.operators.scratch import stage

CAPACITY, END_ID = 2048, 0
RESULTS = ["sequence_id", "offset", "part", "part_bins", "part_bound"]
PIECES = "doc_id {id_type}, piece int, start long, length long, ids binary"


def cut(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, doc_id="doc_id",
        text="text") -> DataFrame:
    """Pieces (doc_id, piece, start, length, ids): the first one takes what does not fill a sequence, the others are full. Ids are
    little-endian unsigned 32-bit integers."""
    path = path or public_path("byte_bpe_50k.json")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def pieces(batches):
        import pyarrow as pa
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for first in range(0, len(batch), 128):
                part = batch.slice(first, 128)
                found = []
                for k, ids in enumerate(encoder(path).encode([t or "" for t in part.column(1).to_pylist()])):
                    ids += end
                    n = len(ids) // 4
                    borders = [0, *range(n % capacity or capacity, n + 1, capacity)]
                    found += [(k, i, a, b - a, ids[4 * a:4 * b]) for i, (a, b) in enumerate(zip(borders, borders[1:]))]
                at, number, start, length, ids = zip(*found)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int32())), pa.array(number, pa.int32()), pa.array(start, pa.int64()),
                     pa.array(length, pa.int64()), pa.array(ids, pa.binary())], names=["doc_id", "piece", "start", "length", "ids"])

    return mapped(rows, pieces, PIECES.format(id_type=rows.schema["doc_id"].dataType.simpleString()))


def lower_bound(counts, capacity: int = CAPACITY) -> int:
    """No packing of ``counts[length]`` pieces has fewer sequences: the best of three families of dual feasible functions (Fekete and
    Schepers, 2001), each of which maps lengths to shares that add up to at most 1 in any sequence. Whole numbers only."""
    import numpy as np
    counts = np.asarray(counts, np.int64)
    length = np.flatnonzero(counts)
    if not len(length):
        return 0
    n = counts[length]
    best = -(-int((n * length).sum()) // capacity)
    for k in range(1, 33):  # rounding to multiples of 1 / k
        shares = np.where((k + 1) * length % capacity == 0, k * length, (k + 1) * length // capacity * capacity)
        best = max(best, -(-int((n * shares).sum()) // (k * capacity)))
    edges = np.unique(np.concatenate([length, capacity - length + 1]))  # only here do the functions below change
    for least in edges[2 * edges <= capacity]:
        middle = np.where(length >= least, length, 0)  # nothing of what is below, all of what leaves no room for it
        best = max(best, -(-int((n * np.where(length > capacity - least, capacity, middle)).sum()) // capacity))
        parts = capacity // int(least)
        shares = np.where(length >= least, 1, 0)
        shares = np.where(2 * length > capacity, parts - (capacity - length) // least, shares)
        best = max(best, -(-int((n * shares).sum()) // parts))
    return best


def best_fit(counts, capacity: int = CAPACITY) -> list[tuple[int, tuple]]:
    """Best-fit decreasing on counts by length: (how many sequences, ((length, number), ...)). Pieces of equal length follow each
    other into the same fullest sequence that has room, so they are placed together."""
    open_, done = {}, []  # room -> [how many sequences, contents]

    def put(room, times, contents):
        if times:
            (open_.setdefault(room, []) if room else done).append((times, contents))

    for length in range(capacity, 0, -1):
        left = int(counts[length]) if length < len(counts) else 0
        if not left:
            continue
        for room in sorted(r for r in open_ if r >= length):
            each, groups = room // length, open_.pop(room)
            while groups and left:
                times, contents = groups.pop()
                whole = min(times, left // each)
                put(room - each * length, whole, (*contents, (length, each)))
                left -= whole * each
                times -= whole
                if times and left:  # the last pieces of this length
                    put(room - left * length, 1, (*contents, (length, left)))
                    left, times = 0, times - 1
                if times:
                    groups.append((times, contents))
            if groups:
                open_.setdefault(room, []).extend(groups)
            if not left:
                break
        each = capacity // length
        put(capacity - each * length, left // each, ((length, each),))
        put(capacity - left % each * length, int(left % each > 0), ((length, left % each),))
    return done + [group for groups in open_.values() for group in groups]


def places(lengths, capacity: int = CAPACITY):
    """(sequence, offset, sequences in all, lower bound) of the pieces of one partition; sequences count from 0."""
    import numpy as np
    lengths = np.asarray(lengths, np.int64)
    if len(lengths) and not (lengths.min() > 0 and lengths.max() <= capacity):
        raise ValueError(f"pieces must have 1 to {capacity} ids")
    counts = np.bincount(lengths, minlength=capacity + 1)
    order = np.argsort(lengths, kind="stable")
    next_ = np.cumsum(counts) - counts  # the first piece of each length that is not placed yet
    sequence, offset, first = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), 0
    for times, contents in best_fit(counts, capacity):
        at = 0
        for length, number in contents:
            rows = order[next_[length]:next_[length] + times * number]
            nth = np.arange(len(rows))
            sequence[rows], offset[rows] = first + nth // number, at + nth % number * length
            next_[length] += len(rows)
            at += number * length
        first += times
    return sequence, offset, first, lower_bound(counts, capacity)


def _packed(rows: DataFrame, n_parts: int, round_: int, capacity: int, part_rows: int) -> DataFrame:
    """One round: rows dealt evenly, each partition packed in portions of at most ``part_rows`` rows. Sequences have numbers by round, partition and place."""
    schema = StructType(rows.schema.fields + [StructField(c, LongType()) for c in RESULTS])

    def pack_part(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext
        used, portions, held = 0, 0, []
        base = round_ << 56 | TaskContext.get().partitionId() << 36

        def portion(table):
            nonlocal used, portions
            length = table.column("length")
            if length.null_count:
                raise ValueError("pieces must have a length")
            sequence, offset, bins, bound = places(length.to_numpy(), capacity)
            new = [base + used + sequence, offset, *(np.full(len(table), v, np.int64) for v in (base + portions, bins, bound))]
            used, portions = used + bins, portions + 1
            for name, values in zip(RESULTS, new):
                table = table.append_column(name, pa.array(values))
            yield from table.to_batches(max_chunksize=10_000)

        for batch in batches:
            while len(batch):
                room = part_rows - sum(map(len, held))
                held.append(batch.slice(0, room))
                batch = batch.slice(room)
                if sum(map(len, held)) == part_rows:
                    yield from portion(pa.Table.from_batches(held))
                    held = []
        if held:
            yield from portion(pa.Table.from_batches(held))

    return mapped(rows.repartition(n_parts), pack_part, schema)


def pack(pieces: DataFrame, capacity: int = CAPACITY, part_rows: int = 50_000, max_rounds: int = 16) -> DataFrame:
    """Add ``sequence_id``, ``offset`` and the certificate to pieces (length, and any other columns)."""
    rows = pieces.drop(*RESULTS)
    columns = rows.columns
    n_rows = rows.count()
    out, n_parts = None, max(1, -(-n_rows // part_rows))
    packed = stage(_packed(rows, n_parts, 0, capacity, part_rows), "packed-0")
    for round_ in range(1, max_rounds + 1):
        filled = packed.groupBy("part", "sequence_id").agg(F.sum("length").alias("ids"), F.first(F.col("part_bins") > F.col("part_bound")).alias("gap"))
        emptiest = F.min(F.struct("ids", "sequence_id")).over(W.partitionBy("part"))["sequence_id"]
        given = stage(filled.withColumn("emptiest", emptiest).filter(F.col("ids") < capacity).filter(F.col("gap") | (F.col("sequence_id") == F.col("emptiest")))
                      .select("sequence_id"), "given-up")
        before = given.count()
        if n_parts == 1 or not before:
            break
        again = packed.join(given, "sequence_id", "left_semi").select(columns)
        n_parts = min(n_parts - 1, -(-again.count() // part_rows))
        repacked = stage(_packed(again, n_parts, round_, capacity, part_rows), f"packed-{round_}")
        if repacked.select("sequence_id").distinct().count() >= before:
            break
        kept = packed.join(given, "sequence_id", "left_anti").select(*columns, *RESULTS)
        out, packed = kept if out is None else out.unionByName(kept), repacked
    return packed if out is None else out.unionByName(packed)

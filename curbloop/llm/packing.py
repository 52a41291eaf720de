"""Packing token ids into sequences by minimum bin slack.

Documents are cut into pieces of the full length and one remainder. Only the number of pieces of each length (at most
``capacity`` numbers) is needed to plan; pieces then find their places by their rank among pieces of equal length, so no
length, however frequent, meets in one task.

Defined results: a null text is empty; an empty document is its end id alone. Every row is packed, also repeated ones and
those with a null id. ``cut`` reads the two named columns only; ``pack`` keeps all columns and replaces ``sequence_id`` and
``offset``. Pieces of length 0, below or above the capacity are refused.
"""
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from curbloop.llm.batches import mapped
from curbloop.llm.tokens import encoder, public_path

CAPACITY, END_ID = 1024, 0
PIECES = "doc_id {id_type}, start long, length long, doc_tokens long, ids binary"


def cut(docs: DataFrame, path: str | None = None, end_id: int = END_ID, capacity: int = CAPACITY, doc_id="doc_id",
        text="text") -> DataFrame:
    """Pieces (doc_id, start, length, doc_tokens, ids) of at most ``capacity`` ids; ids as little-endian unsigned 32-bit
    integers."""
    path = path or public_path("byte_bpe_50k.json")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))

    def pieces(batches):
        import pyarrow as pa
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            for first in range(0, len(batch), 128):
                part = batch.slice(first, 128)
                ids = [i + end for i in encoder(path).encode([t or "" for t in part.column(1).to_pylist()])]
                at = [(k, s, len(i) // 4) for k, i in enumerate(ids) for s in range(0, len(i) // 4, capacity)]
                yield pa.RecordBatch.from_arrays([
                    part.column(0).take(pa.array([k for k, _, _ in at], pa.int32())),
                    pa.array([s for _, s, _ in at], pa.int64()), pa.array([min(capacity, n - s) for _, s, n in at], pa.int64()),
                    pa.array([n for _, _, n in at], pa.int64()),
                    pa.array([ids[k][4 * s:4 * (s + capacity)] for k, s, _ in at], pa.binary())],
                    names=["doc_id", "start", "length", "doc_tokens", "ids"])

    return mapped(rows, pieces, PIECES.format(id_type=rows.schema["doc_id"].dataType.simpleString()))


def fullest(counts: dict[int, int], seed: int, capacity: int) -> dict[int, int]:
    """The multiset of lengths that holds ``seed`` and comes closest to the capacity.

    Bit s of ``reached`` says that sum s can be made. Each length enters as 1, 2, 4, ... copies of itself, so any number up to
    its count can be made; the sets before each step lead back to the counts.
    """
    reached, steps = 1 << seed, []
    window = (1 << (capacity + 1)) - 1
    for length in sorted(counts, reverse=True):
        left, copies = min(counts[length] - (length == seed), (capacity - seed) // length), 1
        while left > 0 and not reached >> capacity & 1:
            take = min(copies, left)
            steps.append((length, take, reached))
            reached |= reached << (length * take) & window
            left, copies = left - take, copies * 2
    total, chosen = reached.bit_length() - 1, {seed: 1}
    for length, take, before in reversed(steps):
        if not before >> total & 1:
            chosen[length] = chosen.get(length, 0) + take
            total -= length * take
    return chosen


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Windows as (how many, lengths with their counts). Each holds the largest length left and is repeated while the pieces
    last, so the plan has a few thousand entries at most, whatever the number of pieces."""
    counts, out = {length: n for length, n in counts.items() if n > 0}, []
    if any(not 0 < length <= capacity for length in counts):
        raise ValueError(f"pieces must have 1 to {capacity} ids")
    while counts:
        chosen = fullest(counts, max(counts), capacity)
        times = min(counts[length] // n for length, n in chosen.items())
        out.append((times, chosen))
        for length, n in chosen.items():
            counts[length] -= n * times
            if not counts[length]:
                del counts[length]
    return out


def _places(spark: SparkSession, windows) -> DataFrame:
    """Which ranks of a length go to which sequences: one row per window and length."""
    rows, first, used = [], 0, {}
    for times, chosen in windows:
        offset = 0
        for length in sorted(chosen, reverse=True):
            rank, n = used.get(length, 0), chosen[length]
            rows.append((length, rank, rank + n * times, first, n, offset))
            used[length] = rank + n * times
            offset += length * n
        first += times
    return spark.createDataFrame(rows, "length long, rank_from long, rank_to long, first long, per long, offset_from long")


def pack(pieces: DataFrame, capacity: int = CAPACITY, order=("doc_id", "start"), rows_per_bucket: int = 20_000) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces (length, and ``order`` to tell them apart)."""
    spark = pieces.sparkSession
    rows = pieces.drop("sequence_id", "offset", "_bucket", "_rank", "_before")
    buckets = max(64, min(1 << 16, rows.count() // rows_per_bucket))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counted = rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("n"))
    lengths = {r["length"]: r["n"] for r in counted.groupBy("length").agg(F.sum("n").alias("n")).limit(capacity + 1).collect()}
    places = _places(spark, plan(lengths, capacity))
    before = W.partitionBy("length").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = counted.select("length", "_bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_before"))
    ranked = (rows.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_bucket").orderBy(*order)) - 1)
              .join(starts, ["length", "_bucket"]).withColumn("_rank", F.col("_rank") + F.col("_before")))
    # the plan is bounded by the capacity, not by the input
    placed = ranked.join(F.broadcast(places), (ranked["length"] == places["length"]) & (ranked["_rank"] >= places["rank_from"])
                         & (ranked["_rank"] < places["rank_to"])).drop(places["length"])
    nth = F.col("_rank") - F.col("rank_from")
    return placed.select(*[c for c in rows.columns if c != "_bucket"], F.expr("first + (_rank - rank_from) div per").alias("sequence_id"),
                         (F.col("offset_from") + nth % F.col("per") * F.col("length")).alias("offset"))


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = END_ID) -> DataFrame:
    """The sequences themselves (sequence_id, ids, n_ids), padded to the capacity. Each is one group of bounded size."""
    return (packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("parts"), F.sum("length").alias("n_ids"))
            .select("sequence_id", F.unhex(F.rpad(F.array_join(F.transform("parts", lambda p: F.hex(p["ids"])), ""),
                                                  8 * capacity, pad_id.to_bytes(4, "little").hex().upper())).alias("ids"), "n_ids"))

"""Sharding by sampled splitters, with DataFrame functions only.

Keys are drawn with chances in proportion to size, their quantiles are the splitters, records are range-partitioned by them,
and ranges that turn out overfull are subdivided by splitters drawn inside them. The sizes of all ranges then give each
record its place in the whole order, and shards are equal steps of the running size.

Defined results: a null text is empty (size 16). Null ids come first. Equal rows share a range and are ordered arbitrarily among
themselves; every row has a place. Other columns are kept, those named like a result are replaced. An empty table gives an
empty one.
"""
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from curbloop.llm.ranges import MAX_RANGES, order_key, range_index, weighted_splitters, with_range

ROW_COST = 16


def split_ranges(rows: DataFrame, key: Column, key_type: str, size: Column, rows_per_range: int, bytes_per_range: int,
                 max_ranges: int, rounds: int = 3) -> list:
    """Splitters whose ranges hold about the given rows and bytes.

    A range with over twice its share is subdivided by a sample drawn from overfull ranges only. A single key value is
    never cut. At most ``max_ranges`` ranges (65,536, what the driver can hold) are made by the first draw, and twice as many in all."""
    total = rows.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    n_ranges = int(min(max_ranges, max(1, total["n"] // rows_per_range, total["b"] // bytes_per_range)))
    splitters = weighted_splitters(rows, key, size, n_ranges, total["b"])
    for again in range(rounds):
        ranged = with_range(rows, key, splitters, key_type, "_over")
        held = ranged.groupBy(F.col("_over").alias("range")).agg(
            F.count(F.lit(1)).alias("n"), F.sum(size).alias("b"), (F.min(key) != F.max(key)).alias("divisible"))
        counted = held.collect()  # one row per range
        share = max(1, total["b"] // max(1, n_ranges))
        over = [r["range"] for r in counted if r["divisible"] and r["b"] > 2 * share]
        if not over or len(splitters) >= 2 * max_ranges:
            break
        inside = ranged.filter(F.col("_over").isin(over))
        held_over = sum(r["b"] for r in counted if r["range"] in set(over))
        more = weighted_splitters(inside, key, size, int(min(held_over // share + len(over), 2 * max_ranges - len(splitters))) + 1,
                                  held_over, seed=again + 2)
        merged = sorted({*map(tuple, splitters), *map(tuple, more)}, key=lambda k: [(v is not None, v if v is not None else 0) for v in k])
        if len(merged) == len(splitters):
            break
        splitters = merged
    return splitters


def shard(docs: DataFrame, n_shards: int = 40, text="text", doc_id="doc_id", group: Column | None = None,
          size: Column | None = None, rows_per_range: int = 20_000,
          bytes_per_range: int = 64 << 20, max_ranges: int = MAX_RANGES, keep=None) -> DataFrame:
    """Add ``size``, ``shard`` and ``slot``. Shards are near equal in size: record boundaries are the only difference.

    Records are ordered by ``group`` (a 64-bit hash of the text by default, so equal texts are neighbours) and then by id, so a
    group that exceeds its range or shard is cut between ids. ``keep`` names the columns to keep: all by default. Pass
    ``size`` and ``group`` to shard measured rows without their texts."""
    whole = F.coalesce(F.col(text), F.lit("")) if size is None or group is None else None
    results = {"size", "shard", "slot", "_group", "_range", "_rank", "_sum", "_rows_before", "_size_before"}
    kept = [c for c in (docs.columns if keep is None else keep) if c not in results]
    rows = docs.withColumns({"size": F.octet_length(whole).cast("long") + ROW_COST if size is None else size,
                             "_group": F.xxhash64(whole) if group is None else group})
    rows = rows.select(*kept, "size", "_group", F.col(doc_id).alias("_id"))
    key = order_key("_group", "_id")
    key_type = f"struct<k0:bigint,k1:{rows.schema['_id'].dataType.simpleString()}>"
    splitters = split_ranges(rows, key, key_type, F.col("size"), rows_per_range, bytes_per_range, max_ranges)
    rows = with_range(rows, key, splitters, key_type, "_range")
    sizes = rows.groupBy("_range").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("b"))
    before = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # one row per range, at most 2 * max_ranges
    starts = sizes.select("_range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_rows_before"),
                          F.coalesce(F.sum("b").over(before), F.lit(0)).alias("_size_before"))
    total = sizes.agg(F.coalesce(F.sum("b"), F.lit(1))).first()[0]
    inside = W.partitionBy("_range").orderBy("_group", "_id")
    up_to = inside.rowsBetween(W.unboundedPreceding, -1)
    placed = (rows.withColumns({"_rank": F.row_number().over(inside) - 1, "_sum": F.coalesce(F.sum("size").over(up_to), F.lit(0))})
              .join(F.broadcast(starts), "_range")
              .withColumns({"_rank": F.col("_rank") + F.col("_rows_before"),
                            "shard": F.expr(f"cast((_sum + _size_before) * {n_shards} div {total} AS int)")}))
    first = placed.groupBy("shard").agg(F.min("_rank").alias("_first"))  # one row per shard
    return placed.join(F.broadcast(first), "shard").select(*kept, "size", "shard", (F.col("_rank") - F.col("_first")).alias("slot"))

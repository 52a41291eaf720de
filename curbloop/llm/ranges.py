"""Weighted range splitters, and which range a key falls into, as column expressions."""
from pyspark.sql import Column, DataFrame, functions as F

MAX_RANGES = 1 << 16   # the driver holds DRAWS keys for each
DRAWS = 16             # expected keys in the sample per range
INLINE = 4096          # so many splitters are a constant array of the plan, more are a table
BLOCK = 512            # splitters per row of that table


def order_key(*columns) -> Column:
    """A comparable struct of columns; nulls come first."""
    return F.struct(*[F.col(c).alias(f"k{i}") if isinstance(c, str) else c.alias(f"k{i}") for i, c in enumerate(columns)])


def weighted_splitters(rows: DataFrame, key: Column, size: Column, n_ranges: int, total: int, sample_rows: int = 8192,
                       seed: int = 1) -> list:
    """At most ``n_ranges - 1`` ascending keys that cut the rows, of ``total`` size, into ranges of about equal size.

    Every row is drawn on its own, with a chance of size * m / total, m being the larger of ``sample_rows`` and 16 a range, so about
    m rows are drawn, whatever the number of tasks, and a row above total / m always is. A drawn row counts as
    max(size, total / m); the splitters are quantiles of the drawn sizes, summed by key. The same partitions give the same draws. A
    key that holds several ranges' share ends its range."""
    n_ranges = min(n_ranges, MAX_RANGES)
    if n_ranges <= 1 or total <= 0:
        return []
    step = total / max(sample_rows, DRAWS * n_ranges)
    weight = size.cast("double")
    drawn = (rows.select(key.alias("key"), weight.alias("size")).filter(F.rand(seed) * step < F.col("size"))
             .groupBy("key").agg(F.sum(F.greatest("size", F.lit(step))).alias("weight")).orderBy("key").collect())
    share, before, due, splitters = sum(r["weight"] for r in drawn) / n_ranges, 0.0, 1, []
    for r in drawn:
        if before >= share * due:
            splitters.append(r["key"])
            due = int(before // share) + 1
        before += r["weight"]
    return splitters


def _search(steps: list, held, key: Column) -> Column:
    """How many ascending elements of the array ``held`` are at or below the key; null elements count as above."""
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), lambda low, step: F.when(
        F.get(held, low + step - 1) <= key, low + step).otherwise(low))


def range_index(key: Column, splitters: list, key_type: str) -> Column:
    """How many splitters are at or below the key: a binary search in a constant array, without user code."""
    if not splitters:
        return F.lit(0)
    steps = [1 << s for s in reversed(range(len(splitters).bit_length()))]
    return _search(steps, F.array(*[_literal(k, key_type) for k in splitters]), key)


def with_range(rows: DataFrame, key: Column, splitters: list, key_type: str, name: str, inline: int = INLINE, block: int = BLOCK) -> DataFrame:
    """Add ``range_index``. Above ``inline`` splitters the constant array holds every ``block``-th one, and those between come from
    a table of one row per block, broadcast (at most 2 * MAX_RANGES keys)."""
    if len(splitters) <= inline:
        return rows.withColumn(name, range_index(key, splitters, key_type))
    coarse = splitters[block - 1::block]
    table = rows.sparkSession.createDataFrame([(i, [tuple(k) for k in splitters[i * block:(i + 1) * block - 1]]) for i in range(len(coarse) + 1)],
                                              f"_block int, _held array<{key_type}>")
    steps = [1 << s for s in reversed(range((block - 1).bit_length()))]
    placed = rows.withColumn("_block", range_index(key, coarse, key_type)).join(F.broadcast(table), "_block")
    return placed.withColumn(name, F.col("_block") * block + _search(steps, F.col("_held"), key)).drop("_block", "_held")


def _literal(row, key_type: str) -> Column:
    return F.struct(*[F.lit(v).alias(f"k{i}") for i, v in enumerate(row)]).cast(key_type)

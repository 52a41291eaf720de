"""How points of one device or trip are spread over tasks.

A device or a trip may hold a large share of all rows, so nothing here ever windows over a whole one.
Points are worked on in bounded pieces: time chunks (``t div chunk_secs``, full ones in ``slots``) or parts (``part_rows``
consecutive points). What has to cross a piece boundary crosses in one of three ways:

* a copy of the last few rows in the next piece (``with_lags``), for windows that look back a bounded way;
* one summary row per piece, windowed per key and joined back on (key, piece);
* per-trip values repeated once per part (``attach``), so the join key is (trip, part).
"""
from pyspark.sql import Column, DataFrame, Window as W, functions as F


def shuffled(df: DataFrame) -> DataFrame:
    """A side of a join that grows with the data. Plans see neither how many rows an explode makes nor how far files are packed, so a large
    side can look small enough to be collected by the driver and broadcast. This join shuffles and sorts both sides instead."""
    return df.hint("merge")


def part_of(ptid, part_rows: int) -> Column:
    return F.expr(f"({ptid} - 1) div {part_rows}")


def slots(points: DataFrame, key, t, max_rows: int, name="slot", known_keys: int = 100_000) -> DataFrame:
    """Number the equi-depth time slots of every key: a key of up to ``max_rows`` rows is one slot, a fuller one is cut between values of
    ``t`` so that a slot starts with fewer than ``max_rows`` rows before its last value. Values of ``t`` are never cut.

    Fuller keys are counted per value of ``t`` (combined before the shuffle) and a slot is a step of the running count, so slots are exact
    and follow from the rows alone. Without fuller keys nothing is joined; up to ``known_keys`` of them are broadcast."""
    full = points.groupBy(*key).agg(F.expr("count(1) AS n")).filter(F.col("n") > max_rows).select(*key)
    rows = full.limit(known_keys + 1).collect()
    if not rows:
        return points.withColumn(name, F.lit(0))

    def bounded(df):
        return F.broadcast(df) if len(rows) <= known_keys else df

    if len(rows) <= known_keys:
        full = points.sparkSession.createDataFrame(rows, full.schema)
    counts = points.select(*key, t).join(bounded(full), [*key]).groupBy(*key, t).agg(F.expr("count(1) AS n"))
    before = F.coalesce(F.sum("n").over(W.partitionBy(*key).orderBy(t).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    cuts = (counts.withColumn("step", F.floor(before / max_rows)).groupBy(*key, "step").agg(F.min(t).alias("cut")).filter("step > 0")
            .groupBy(*key).agg(F.array_sort(F.collect_list("cut")).alias("cuts")))
    return (points.join(bounded(cuts), [*key], "left")
            .withColumn(name, F.coalesce(F.expr(f"size(filter(cuts, c -> c <= {t}))"), F.lit(0))).drop("cuts"))


def attach(points: DataFrame, trips: DataFrame, part_rows: int, n_points="n_points", how="inner") -> DataFrame:
    """Join one-row-per-trip values to the points (trip_id, ptid, ...) of the trips."""
    spread = trips.withColumn("part", F.expr(
        f"explode(sequence(0L, greatest(0L, (cast({n_points} AS bigint) - 1) div {part_rows})))"))
    return (points.withColumn("part", part_of("ptid", part_rows))
            .join(shuffled(spread), ["trip_id", "part"], how).drop("part"))


def with_lags(points: DataFrame, fields, steps: int, part_rows: int) -> DataFrame:
    """Add ``prev1`` .. ``prevN``, structs of ``fields`` of the points before. ``ptid`` must count 1, 2, 3, ..."""
    own = f"(ptid - 1) div {part_rows}"
    rows = points.withColumn("part", F.expr(
        f"explode(if((ptid - 1) % {part_rows} >= {part_rows - steps}, array({own}, {own} + 1), array({own})))"))
    w = W.partitionBy("trip_id", "part").orderBy("ptid")
    here = F.struct(*fields)
    lagged = rows.withColumns({f"prev{k}": F.lag(here, k).over(w) for k in range(1, steps + 1)})
    return lagged.filter(f"part = {own}").drop("part")


def renumber(points: DataFrame, part_rows: int) -> DataFrame:
    """Number the points of each trip 1, 2, 3, ... again after some were dropped, keeping their order."""
    parts = points.withColumn("part", part_of("ptid", part_rows)).repartition("trip_id", "part")
    ahead = (parts.groupBy("trip_id", "part").agg(F.count(F.lit(1)).alias("n"))
             .select("trip_id", "part", F.coalesce(F.sum("n").over(
                 W.partitionBy("trip_id").orderBy("part").rowsBetween(W.unboundedPreceding, -1)),
                 F.lit(0)).alias("ahead")))
    w = W.partitionBy("trip_id", "part").orderBy("ptid")
    return (parts.withColumn("rn", F.row_number().over(w)).join(shuffled(ahead), ["trip_id", "part"])
            .withColumn("ptid", F.col("ahead") + F.col("rn")).drop("ahead", "rn", "part"))


def dense_ids(trips: DataFrame, key, order, name="trip_id", buckets: int = 4096, rows_per_bucket: int = 250_000, level: int = 4096) -> DataFrame:
    """Unique numbers 1 .. n without a global sort: rows are numbered inside hash buckets of ``key`` and shifted by the sizes of the
    buckets before. There are ``buckets``, or as many as keep about ``rows_per_bucket`` rows in each. Sizes are summed over groups of
    ``level`` buckets and groups of groups, so no task sums more than ``level`` of them. A key's rows share a bucket."""
    buckets = max(buckets, -(-trips.count() // rows_per_bucket))
    rows = trips.withColumn("bucket", F.pmod(F.xxhash64(*key), F.lit(buckets)))
    shift = _before(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), buckets, level).select("bucket", "shift")
    rn = F.row_number().over(W.partitionBy("bucket").orderBy(*order))
    return (rows.withColumn("rn", rn).join(F.broadcast(shift) if buckets <= 1 << 18 else shift, "bucket")
            .withColumn(name, F.col("shift") + F.col("rn")).drop("bucket", "shift", "rn"))


def _before(sizes: DataFrame, buckets: int, level: int) -> DataFrame:
    """Add ``shift``, the sum of ``n`` over all smaller buckets."""
    inside = F.coalesce(F.sum("n").over(W.partitionBy("above").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    grouped = sizes.withColumn("above", F.expr(f"bucket div {level}")).withColumn("shift", inside)
    if buckets <= level:
        return grouped.drop("above")
    above = sizes.groupBy(F.expr(f"bucket div {level}").alias("bucket")).agg(F.sum("n").alias("n"))
    above = _before(above, -(-buckets // level), level).select(F.col("bucket").alias("above"), F.col("shift").alias("more"))
    return grouped.join(above, "above").withColumn("shift", F.col("shift") + F.col("more")).drop("above", "more")


def skew_join(big: DataFrame, small: DataFrame, on, salt_by, max_rows: int = 500_000, how: str = "inner",
              known_keys: int = 100_000) -> DataFrame:
    """Join on keys of which some may hold a large share of ``big``.

    A key with more than ``max_rows`` rows is hot. Its rows are spread by a hash of ``salt_by`` over as many copies as it exceeds
    the limit; its rows of ``small`` are repeated that often. Without hot keys this is a plain join. Up to ``known_keys`` hot keys
    are broadcast, longer lists are joined; ``small`` grows with the data and is shuffled.
    """
    hot = (big.groupBy(*on).agg(F.expr("count(1) AS n")).filter(F.col("n") > max_rows)
           .select(*on, F.ceil(F.col("n") / max_rows).alias("copies")))
    rows = hot.limit(known_keys + 1).collect()
    if not rows:
        return big.join(shuffled(small), on, how)
    if len(rows) <= known_keys:
        hot = F.broadcast(big.sparkSession.createDataFrame(rows, hot.schema))
    else:
        hot = shuffled(hot)
    salted = (big.join(hot, on, "left")
              .withColumn("salt", F.expr(f"pmod(xxhash64({', '.join(salt_by)}), coalesce(copies, 1))")).drop("copies"))
    spread = (small.join(hot, on, "left")
              .withColumn("salt", F.expr("explode(sequence(0L, coalesce(copies, 1) - 1))")).drop("copies"))
    return salted.join(shuffled(spread), [*on, "salt"], how).drop("salt")

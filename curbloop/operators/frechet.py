"""Discrete Frechet distance of lines of any length, in blocks of bounded size.

The distance is the end of a table over the points of both lines: an entry is the larger of the distance of its two points and the smallest
of the three entries before it. The table of a pair is cut into blocks of ``part_rows`` points of each line. A block needs its points and the
last row and column of its neighbours only, so all blocks of a diagonal, of all pairs, are worked on at once. The entries are minima and maxima of
point distances, so the result does not depend on the cut.
"""
import contextlib

from pyspark.sql import DataFrame, SparkSession, functions as F

from curbloop.operators.layout import part_of, renumber
from curbloop.operators.scratch import new_path, stage

BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
BLOCK = "trip_id {kind}, i bigint, j bigint, top array<double>, right array<double>, value double"


def _parts(lines: DataFrame, part_rows: int, at: str) -> DataFrame:
    """Lines in long form (trip_id, ptid, x, y; ptid counts 1, 2, 3, ...) -> their parts as arrays."""
    known = renumber(lines.filter("x is not null and y is not null").select("trip_id", "ptid", "x", "y"), part_rows)
    return (known.groupBy("trip_id", part_of("ptid", part_rows).alias(at))
            .agg(F.array_sort(F.collect_list(F.struct("ptid", "x", "y"))).alias("pts"))
            .select("trip_id", at, F.col("pts.x").alias(f"{at}x"), F.col("pts.y").alias(f"{at}y")))


def _entries(ax, ay, bx, by, below, left):
    """Last row and last column of a block. ``below``: the row before it with the corner first; ``left``: the column before it."""
    import numpy as np
    n, m = len(ax), len(bx)
    # diagonal k holds the entries (r, k - r), kept at place r + 1; place 0 is the row before the block
    older, last = np.full(n + 1, np.inf), np.full(n + 1, np.inf)
    older[0] = below[0]
    top, right = np.empty(m), np.empty(n)
    for k in range(n + m - 1):
        lo, hi = max(0, k - m + 1), min(n - 1, k)
        if k < n:
            last[k + 1] = left[k]            # before (k, 0)
            if k:
                older[k] = left[k - 1]
        if k < m:
            last[0] = below[k + 1]           # before (0, k)
        r = np.arange(lo, hi + 1)
        d = np.hypot(ax[r] - bx[k - r], ay[r] - by[k - r])
        now = np.full(n + 1, np.inf)
        now[r + 1] = np.maximum(d, np.minimum(np.minimum(last[r], last[r + 1]), older[r]))
        if hi == n - 1:
            top[k - hi] = now[n]
        if k - lo == m - 1:
            right[lo] = now[lo + 1]
        older, last = last, now
        if k + 1 < m:
            older[0] = below[k + 1]
    return top, right


def _settle(batches):
    import numpy as np
    import pandas as pd
    for rows in batches:
        out = []
        for b in rows.itertuples(index=False):
            ax, ay, bx, by = (np.asarray(v, float) for v in (b.ix, b.iy, b.jx, b.jy))
            below, left = np.full(len(bx) + 1, np.inf), np.full(len(ax), np.inf)
            if b.i == 0 and b.j == 0:
                below[0] = 0.0               # nothing comes before the first pair of points
            if b.below is not None:
                below = np.asarray(b.below, float)
            if b.left is not None:
                left = np.asarray(b.left, float)
            top, right = _entries(ax, ay, bx, by, below, left)
            out.append((b.trip_id, b.i, b.j, np.append(left[-1], top), right, float(top[-1])))
        yield pd.DataFrame(out, columns=["trip_id", "i", "j", "top", "right", "value"])


@contextlib.contextmanager
def _small_batches(spark: SparkSession, size: int = 4 << 20):
    """A batch of rows that go to Python is bounded in bytes while the block runs; then the session is as it was."""
    before = spark.conf.get(BATCH_BYTES, None)
    spark.conf.set(BATCH_BYTES, str(size))
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(BATCH_BYTES)
        else:
            spark.conf.set(BATCH_BYTES, before)


def frechet_distance(a: DataFrame, b: DataFrame, part_rows: int = 4096) -> DataFrame:
    """trip_id and ``frechet`` of the trips that have a line in both tables (trip_id, ptid, x, y).

    There are as many rounds as the longest pair has blocks along both sides, one for lines of up to ``part_rows`` points. A round reads what the
    round before wrote. Points without a position are left out.
    """
    spark = a.sparkSession
    rows, columns = (stage(_parts(line, part_rows, at), f"parts-{at}") for line, at in ((a, "i"), (b, "j")))
    sizes = stage(rows.groupBy("trip_id").agg((F.max("i") + 1).alias("n")).join(
        columns.groupBy("trip_id").agg((F.max("j") + 1).alias("m")), "trip_id"), "sizes")
    rounds = sizes.agg(F.coalesce(F.max(F.expr("n + m - 1")), F.lit(1))).first()[0]
    schema = BLOCK.format(kind=dict(sizes.dtypes)["trip_id"])
    path = new_path(spark, "frechet")
    nothing = spark.createDataFrame([], schema)
    for k in range(rounds):
        blocks = (sizes.filter(f"{k} < n + m - 1")
                  .selectExpr("trip_id", f"explode(sequence(greatest(0L, {k} - m + 1), least({k}L, n - 1))) AS i").withColumn("j", F.lit(k) - F.col("i")))
        before = spark.read.schema(schema).parquet(f"{path}/round={k - 1}") if k else nothing
        ready = (blocks.join(rows, ["trip_id", "i"]).join(columns, ["trip_id", "j"])
                 .join(before.select("trip_id", (F.col("i") + 1).alias("i"), "j", F.col("top").alias("below")), ["trip_id", "i", "j"], "left")
                 .join(before.select("trip_id", "i", (F.col("j") + 1).alias("j"), F.col("right").alias("left")), ["trip_id", "i", "j"], "left"))
        with _small_batches(spark):
            ready.mapInPandas(_settle, schema).write.parquet(f"{path}/round={k}")
    done = spark.read.schema(schema).parquet(path).select("trip_id", "i", "j", "value")
    return (done.join(sizes, "trip_id").filter("i = n - 1 AND j = m - 1").select("trip_id", F.col("value").alias("frechet")))

"""Drop errant points of traces; the given points stay untouched as the original line."""
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from curbloop.functions import geo
from curbloop.operators.layout import attach, part_of, renumber, shuffled, with_lags
from curbloop.operators.scratch import stage
from curbloop.params import Params


def drop_good_starts(points: DataFrame, trips: DataFrame, params: Params = Params()) -> DataFrame:
    """Remove the first point where the start is known to be good and more than two points exist."""
    flagged = attach(points, trips.select("trip_id", "n_points", "start_good"), params.part_rows, how="left")
    drop = F.coalesce(F.col("start_good"), F.lit(False)) & (F.col("ptid") == 1) & (F.col("n_points") > 2)
    dropped = F.coalesce(F.col("start_good"), F.lit(False)) & (F.col("n_points") > 2)
    return (flagged.filter(~drop)
            .withColumn("ptid", F.col("ptid") - F.when(dropped, 1).otherwise(0))
            .drop("start_good", "n_points"))


def _judge(batches, speed_max: float):
    """One row per part: the numbers of the points that are too fast from the last kept point, and the last kept point. Rows come in the order of
    trip, part and ptid; ``in_*`` is the point kept before the part. A part may go on in the next batch of rows."""
    part, last, gone, own = None, None, [], None
    for pdf in batches:
        out = []
        columns = (pdf[c].to_list() for c in ("trip_id", "part", "ptid"))
        numbers = (pdf[c].to_numpy(float).tolist() for c in ("t", "x", "y", "in_t", "in_x", "in_y"))
        for trip, number, ptid, t, x, y, in_t, in_x, in_y in zip(*columns, *numbers):
            if (trip, number) != part:
                if part is not None:
                    out.append((*part, gone, own))
                part, last, gone, own = (trip, number), None if in_t != in_t else (in_t, in_x, in_y), [], None
            if last is not None:
                hours, km = (t - last[0]) / 3600, ((x - last[1]) ** 2 + (y - last[2]) ** 2) ** 0.5 / 1000
                if km / hours > speed_max if hours > 0 else km > 0:
                    gone.append(ptid)
                    continue
            last = own = (t, x, y)
        if out:
            yield _parts_judged(out)
    if part is not None:
        yield _parts_judged([(*part, gone, own)])


JUDGED = "trip_id bigint, part bigint, gone array<bigint>, keeps boolean, t double, x double, y double"


def _parts_judged(rows) -> pd.DataFrame:
    own = [r[3] or (None, None, None) for r in rows]
    return pd.DataFrame({"trip_id": [r[0] for r in rows], "part": [r[1] for r in rows], "gone": pd.Series([r[2] for r in rows], dtype=object), "keeps": [r[3] is not None for r in rows],
                         **{c: pd.Series([o[k] for o in own], dtype=float) for k, c in enumerate("txy")}})


def drop_fast_points(points: DataFrame, params: Params = Params()) -> DataFrame:
    """Remove points reached faster than ``clean_speed_max`` from the last kept point.

    Trips without a fast step are left alone. The parts of the others are judged all at once, each as if the last point of the
    part before were kept; parts that were entered from another point are judged again, until none is left. A trip of
    one part takes one pass, however many of its points are fast.
    """
    hours, km = (F.col("t") - F.col("prev1.t")) / 3600, geo.distance("prev1.x", "prev1.y", "x", "y") / 1000
    fast = F.coalesce(F.when(hours > 0, km / hours > params.clean_speed_max).when(km > 0, F.lit(True)), F.lit(False))
    marked = stage(with_lags(points, ["t", "x", "y"], 1, params.part_rows).withColumn("fast", fast).drop("prev1"), "clean")
    trips = marked.groupBy("trip_id").agg(F.max("ptid").alias("n_points"), F.bool_or("fast").alias("dirty")).filter("dirty")
    trips = stage(trips.drop("dirty"), "fast-trips")
    rows = marked.drop("fast")
    if trips.isEmpty():
        return rows
    rows = attach(rows, trips.withColumnRenamed("n_points", "n"), params.part_rows, "n", how="left")
    rows = stage(rows.withColumn("part", F.when(F.col("n").isNotNull(), part_of("ptid", params.part_rows))).drop("n"), "clean")
    part = ["trip_id", "part"]
    open_rows = rows.filter("part is not null").selectExpr(*part, "ptid", "cast(t AS double) AS t", "cast(x AS double) AS x", "cast(y AS double) AS y")
    at = F.struct("t", "x", "y")
    parts = stage(open_rows.groupBy(*part).agg(F.max_by(at, "ptid").alias("p")), "parts")
    entered = stage(parts.select("trip_id", (F.col("part") + 1).alias("part"), "p"), "entries")
    judged, again = None, None
    while True:
        mine = open_rows if again is None else open_rows.join(shuffled(again), part, "left_semi")
        work = (mine.join(shuffled(entered), part, "left")
                .select(*part, "ptid", "t", "x", "y", F.col("p.t").alias("in_t"), F.col("p.x").alias("in_x"), F.col("p.y").alias("in_y")))
        new = work.repartition(*part).sortWithinPartitions(*part, "ptid").mapInPandas(lambda batches: _judge(batches, params.clean_speed_max), JUDGED)
        judged = stage(new if judged is None else judged.join(shuffled(again), part, "left_anti").unionByName(new), "judged")
        # a part that keeps nothing is left from where it was entered
        left = (judged.select(*part, F.when(F.col("keeps"), at).alias("own")).join(shuffled(entered), part, "left")
                .select("trip_id", (F.col("part") + 1).alias("part"), F.coalesce("own", "p").alias("now")))
        left = stage(left.join(shuffled(entered), part, "left").join(shuffled(parts.select(*part)), part, "left_semi"), "exits")
        again = stage(left.filter("not (now <=> p)").select(*part), "again")
        if again.isEmpty():
            break
        entered = left.select(*part, F.col("now").alias("p"))
    dropped = judged.select(*part, F.explode("gone").alias("ptid"))
    changed = rows.filter("part is not null").join(shuffled(dropped), [*part, "ptid"], "left_anti").drop("part")
    return rows.filter("part is null").drop("part").unionByName(renumber(changed, params.part_rows))


def clean_traces(points: DataFrame, trips: DataFrame, params: Params = Params()) -> DataFrame:
    if "start_good" in trips.columns:
        points = drop_good_starts(points, trips, params)
    return drop_fast_points(points, params)

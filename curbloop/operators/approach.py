"""Trip -> final approach: parking-lot zone, rolling speeds, cut points, slices."""
from pyspark.sql import DataFrame, functions as F

from curbloop.functions import geo
from curbloop.operators.layout import attach, shuffled, with_lags
from curbloop.operators.spatial import (box_holds_line, extent, inside_polygons, near_segments, street_segments)
from curbloop.params import Params

POINT = ["trip_id", "ptid"]


def lot_zone(points: DataFrame, streets: DataFrame, lots: DataFrame | None = None,
             params: Params = Params()) -> DataFrame:
    """Add ``in_lot``: close to a service street or an off-street lot and not close to any other street.

    The zone is never built as a shape. Without any lot or service street, or without any other street, there
    is no zone and ``in_lot`` is null.
    """
    box = extent(points)
    clip = streets.filter(box_holds_line(box, "geom_way"))
    segments = (street_segments(clip.select("id", "clazz", "geom_way"))
                .select((F.col("clazz") == params.service_class).alias("service"), "x1", "y1", "x2", "y2"))
    bare = points.select(*POINT, "x", "y")
    near = near_segments(bare, segments, max(params.lot_buffer, params.street_buffer), POINT)
    evidence = [near.select(*POINT, (F.col("service") & (F.col("dist") <= params.lot_buffer)).alias("lot"),
                            (~F.col("service") & (F.col("dist") < params.street_buffer)).alias("street"))]
    zones = clip.agg(F.coalesce(F.bool_or(F.col("clazz") == params.service_class), F.lit(False)).alias("service"),
                     F.coalesce(F.bool_or(F.col("clazz") != params.service_class), F.lit(False)).alias("other"))
    has_zone = zones.select(F.struct("service", "other")).scalar()
    any_lot = F.lit(False)
    if lots is not None:
        any_lot = lots.agg((F.count(F.lit(1)) > 0).alias("n")).scalar()
        edge = near_segments(bare, lots.select("lot_id", "x1", "y1", "x2", "y2"), params.lot_buffer, POINT).select(*POINT)
        evidence += [hit.select(*POINT, F.lit(True).alias("lot"), F.lit(False).alias("street"))
                     for hit in (edge, inside_polygons(bare, lots, "lot_id", POINT))]
    found = evidence[0]
    for more in evidence[1:]:
        found = found.unionByName(more)
    found = found.groupBy(*POINT).agg(F.bool_or("lot").alias("lot"), F.bool_or("street").alias("street"))
    in_lot = F.coalesce("lot", F.lit(False)) & ~F.coalesce("street", F.lit(False))
    return (points.join(shuffled(found), POINT, "left")
            .withColumn("in_lot", F.when((has_zone["service"] | any_lot) & has_zone["other"], in_lot))
            .drop("lot", "street"))


def lagged_points(points: DataFrame, trips: DataFrame, params: Params = Params()) -> DataFrame:
    """Distance to the trip end and steps to the one and two points before, per raw point."""
    if "in_lot" not in points.columns:
        points = points.withColumn("in_lot", F.lit(None).cast("boolean"))
    ends = trips.select("trip_id", "end_x", "end_y", "t0", "n_points").filter("n_points > 1")
    rows = with_lags(attach(points, ends, params.part_rows), ["t", "x", "y"], 2, params.part_rows)
    return rows.select(
        "trip_id", "ptid", "t", "x", "y", "in_lot", "t0", "n_points",
        geo.distance("end_x", "end_y", "x", "y").alias("disttoend"),
        geo.distance("prev1.x", "prev1.y", "x", "y").alias("distdelta"),
        geo.distance("prev2.x", "prev2.y", "x", "y").alias("distdelta2"),
        (F.col("t") - F.col("prev1.t")).alias("timedelta"), (F.col("t") - F.col("prev2.t")).alias("timedelta2"))


def approach_points(points: DataFrame, trips: DataFrame, params: Params = Params()) -> DataFrame:
    """One row per trip and second with ping speed and rolling speed.

    Seconds are merged and rolled inside hours of a trip; the last ``roll_secs - 1`` seconds of an hour are
    repeated in the next one, so every window is complete.
    """
    lagged = lagged_points(points, trips, params)
    if params.smooth_one_hz:
        lagged = lagged.withColumn("distdelta", F.when(
            (F.col("timedelta") == 1) & (F.col("timedelta2") == 2), F.col("distdelta2")).otherwise(F.col("distdelta")))
    look_back = params.roll_secs - 1
    own = f"t div {params.chunk_secs}"
    hours = (lagged.selectExpr(
        "trip_id", "ptid", "t", "t0", "disttoend", "in_lot", "timedelta", "distdelta",
        f"explode(if(t % {params.chunk_secs} >= {params.chunk_secs - look_back}, array({own}, {own} + 1), array({own}))) AS hour")
        .repartition("trip_id", "hour"))
    merged = hours.groupBy("trip_id", "hour", "t").agg(*map(F.expr, (
        "max(ptid) AS ptid", "max(disttoend) AS disttoend", "min(in_lot) AS in_lot",
        "nullif(sum(timedelta), 0) AS timedelta", "sum(distdelta) AS distdelta", "min(t0) AS t0")))
    w = f"(PARTITION BY trip_id, hour ORDER BY t RANGE BETWEEN {look_back} PRECEDING AND CURRENT ROW)"
    # gaps add up to the time since the first point
    return (merged.selectExpr(
        "trip_id", "hour", "t", "ptid", "disttoend", "in_lot", "timedelta", "distdelta",
        f"if(timedelta IS NOT NULL AND t - t0 < {params.roll_secs}, NULL,"
        f" sum(distdelta) OVER {w} / 1000 / nullif(sum(timedelta) OVER {w}, 0) * 3600) AS rollspeed",
        "distdelta / timedelta / 1000 * 3600 AS speed")
        .filter(f"hour = {own}"))


def approach_metrics(steps: DataFrame, params: Params = Params()) -> DataFrame:
    """Cut points and masked statistics per trip from ``approach_points``.

    Hours are summarised first; the summaries of a trip are few, and windows run over those only.
    """
    hour = ["trip_id", "hour"]
    r = params.buffer_radius
    ids = (steps.groupBy(*hour)
           .agg(F.expr(f"min(if(disttoend <= {r}, ptid, NULL)) AS in1"),
                F.expr(f"min(if(disttoend <= 2 * {r}, ptid, NULL)) AS in2"),
                F.expr(f"max(if(rollspeed > {params.walk_speed}, ptid, NULL)) AS walk"))
           .selectExpr(*hour, "greatest(1, min(in1) OVER (PARTITION BY trip_id) - 1) AS id_first",
                       "greatest(1, min(in2) OVER (PARTITION BY trip_id) - 1) AS id_firstx2",
                       "coalesce(max(walk) OVER (PARTITION BY trip_id), 1) AS id_walk"))
    rows = (steps.join(shuffled(ids), hour)
            .withColumns({"buf": F.expr("ptid > id_first AND ptid <= id_walk"),
                          "donut": F.expr("ptid > id_firstx2 AND ptid <= id_first + 1"),
                          "walk": F.expr("ptid > id_walk"),
                          "outside": F.expr("ptid <= id_walk AND NOT coalesce(in_lot, false)")})
            .withColumn("run", F.expr("ptid <= id_walk AND ptid > coalesce("
                                      "max(if(outside, ptid, NULL)) OVER (PARTITION BY trip_id, hour), 0)")))

    def stats(prefix, mask, value):
        v = f"if({mask}, {value}, NULL)"
        return [f"sum({v}) AS {prefix}_sum", f"count({v}) AS {prefix}_n", f"max({v}) AS {prefix}_max"]

    per_hour = rows.groupBy(*hour, "id_first", "id_firstx2", "id_walk").agg(*map(F.expr, [
        "count(1) AS npings", "count_if(buf) AS npingsbuf", "count_if(donut) AS npingsdonut", "count_if(walk) AS npingswalk",
        "bool_or(outside) AS broken", "min(if(run, ptid, NULL)) AS run_start", "count_if(run) AS run_n",
        *stats("speed_buf", "buf", "speed"), *stats("speed_donut", "donut", "speed"), *stats("speed_walk", "walk", "speed"),
        *stats("gap_all", "true", "timedelta"), *stats("gap_buf", "buf", "timedelta"), *stats("gap_walk", "walk", "timedelta")]))
    # the run of in-lot points that ends at id_walk starts after the last hour broken by a point outside
    per_hour = per_hour.withColumn("tail", F.expr(
        "hour >= coalesce(max(if(broken, hour, NULL)) OVER (PARTITION BY trip_id), hour)"))

    def mean(prefix, name):
        return f"sum({prefix}_sum) / nullif(sum({prefix}_n), 0) AS {name}"

    return per_hour.groupBy("trip_id", "id_first", "id_firstx2", "id_walk").agg(*map(F.expr, [
        "sum(npings) AS npings", "coalesce(min(if(tail, run_start, NULL)), id_walk) AS id_park",
        "max(speed_buf_max) AS maxspeed", mean("speed_buf", "speed"), mean("speed_donut", "donutspeed"),
        mean("speed_walk", "walkspeed"), mean("gap_all", "pingtime_meanall"), "max(gap_all_max) AS pingtime_maxall",
        mean("gap_buf", "pingtime_meanbuf"), "max(gap_buf_max) AS pingtime_maxbuf", "sum(npingsbuf) AS npingsbuf",
        "sum(npingsdonut) AS npingsdonut", "sum(npingswalk) AS npingswalk", mean("gap_walk", "pingtime_meanwalk"),
        "max(gap_walk_max) AS pt_maxwalk", "greatest(coalesce(sum(if(tail, run_n, NULL)), 0) - 1, 0) AS npingspark"]))


def truncate_traces(points: DataFrame, trips: DataFrame, params: Params = Params()) -> DataFrame:
    """The 19 approach metrics of every trip with more than one point."""
    return approach_metrics(approach_points(points, trips, params), params)


def slice_points(points: DataFrame, trips: DataFrame, metrics: DataFrame, params: Params = Params()) -> DataFrame:
    """Raw points with the slices they belong to; neighbouring slices share their end point."""
    ends = (trips.select("trip_id", "end_x", "end_y", "n_points").filter("n_points > 1")
            .join(shuffled(metrics.select("trip_id", "id_first", "id_walk", "id_park")), "trip_id"))
    rows = with_lags(attach(points.select("trip_id", "ptid", "t", "x", "y"), ends, params.part_rows),
                     ["t", "x", "y"], 1, params.part_rows)
    rows = rows.withColumns({
        "disttoend": geo.distance("end_x", "end_y", "x", "y"),
        "distdelta": geo.distance("prev1.x", "prev1.y", "x", "y"),
        "timedelta": F.col("t") - F.col("prev1.t")}).drop("prev1", "end_x", "end_y", "n_points")
    return rows.withColumns({
        "in_lbuff": F.expr("ptid BETWEEN id_first AND id_park"), "in_lotslice": F.expr("ptid BETWEEN id_park AND id_walk"),
        "in_walk": F.expr("ptid >= id_walk"), "in_all": F.expr("ptid >= id_first")})


def slice_summary(sliced: DataFrame) -> DataFrame:
    """Ends, sizes, lengths and gaps of the slices, one row per trip; trips with an empty slice are left out."""
    def total(mask, name):
        return f"coalesce(sum(if({mask}, distdelta, NULL)), 0D) AS {name}"

    def here(cut, name):
        return f"max(if(ptid = {cut}, named_struct('x', x, 'y', y, 't', t), NULL)) AS {name}"

    drive_gap = "if(ptid > id_first AND ptid <= id_park, timedelta, NULL)"
    rows = sliced.groupBy("trip_id").agg(*map(F.expr, [
        "count_if(in_lbuff) AS n_lbuff", "count_if(in_lotslice) AS n_lot", "count_if(in_walk) AS n_walk",
        "count_if(in_all) AS n_all", here("id_first", "s"), here("id_park", "e"), here("id_walk", "k"),
        total("ptid > id_first AND ptid <= id_park", "gpsdist"), total("ptid > id_park AND ptid <= id_walk", "parkdist"),
        total("ptid > id_walk", "walkdist"), total("ptid > id_first", "alldist"),
        f"max({drive_gap}) AS pingtime_max", f"avg({drive_gap}) AS pingtime_mean",
        "max(if(in_lbuff, disttoend, NULL)) AS max_dist"]))
    return (rows.filter("n_lbuff > 0 AND n_lot > 0 AND n_walk > 0 AND n_all > 0")
            .selectExpr("trip_id", "n_lbuff", "n_lot", "n_walk", "n_all",
                        "s.x AS startpt_x", "s.y AS startpt_y", "s.t AS startpt_t",
                        "e.x AS enterlot_x", "e.y AS enterlot_y", "e.t AS enterlot_t",
                        "coalesce(k.x, e.x) AS park_x", "coalesce(k.y, e.y) AS park_y",
                        "gpsdist", "parkdist", "walkdist", "alldist", "pingtime_max", "pingtime_mean", "max_dist"))

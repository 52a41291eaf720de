"""Pings -> trip points -> traces."""
from pyspark.sql import DataFrame, Window as W, functions as F

from curbloop.functions import clock, geo
from curbloop.functions.projection import project_columns
from curbloop.operators.layout import dense_ids, part_of, shuffled, slots, with_lags
from curbloop.operators.scratch import stage
from curbloop.params import Params


def locate_pings(pings: DataFrame, zone, params: Params = Params()) -> DataFrame:
    """Accurate pings as points in regional metres with a measure in whole seconds."""
    kept = pings.filter(F.col("h_acc") < params.h_acc_max)
    return project_columns(kept, zone).withColumn("t", clock.epoch_seconds("ts_ms"))


def segment_trips(points: DataFrame, params: Params = Params()) -> DataFrame:
    """Number the trips of every device and drop what is not part of one.

    ``points`` needs gid, device_id, ts_ms, t, x, y. A trip is (device_id, trip_start); ``trip_seq`` counts the
    trips of a device and ``ptid`` the points of a trip.

    Points are shuffled once, by device and hour; an hour of more than ``chunk_rows`` pings is cut into slots between seconds.
    Everything that crosses an hour or slot travels through summary tables with a few rows for each, joined back on the same keys.
    """
    hour, chunk = ["device_id", "chunk"], ["device_id", "chunk", "slot"]
    order = ["t", "ts_ms", "gid"]
    hours = points.select("gid", "device_id", "ts_ms", "t", "x", "y", F.expr(f"t div {params.chunk_secs}").alias("chunk"))
    rows = slots(hours, hour, "t", params.chunk_rows).repartition(*chunk)
    here = F.struct("t", "x", "y")
    in_chunk = W.partitionBy(*chunk).orderBy(*order)
    by_device = W.partitionBy("device_id")

    edges = (rows.groupBy(*chunk)
             .agg(F.count(F.lit(1)).alias("n"), F.max_by(here, F.struct(*order)).alias("last"))
             .select(*chunk, F.sum("n").over(by_device).alias("point_count"),
                     F.lag("last").over(by_device.orderBy("chunk", "slot")).alias("carried")))

    gap = F.abs(F.col("t") - F.col("prev.t"))
    moved = (rows.withColumn("prev", F.lag(here).over(in_chunk))
             .join(edges, chunk)
             .withColumn("prev", F.coalesce("prev", "carried"))
             .withColumns({"dt": gap, "d": geo.distance("prev.x", "prev.y", "x", "y")})
             .withColumns({
                 "start": (F.col("prev").isNull() & (F.col("point_count") > 1))
                 | F.coalesce(F.col("dt") > params.trip_gap, F.lit(False)),
                 "speed": F.when(F.col("dt") > 0, (F.col("d") / 1000) / (F.col("dt") / 3600)).otherwise(F.lit(0.0))})
             .drop("prev", "carried")
             .filter((F.col("point_count") > params.device_pings_min)
                     & (F.col("d").isNull() | (F.col("d") != 0)))
             .filter(F.col("speed") < params.speed_max))
    # RANGE frame: points of the same second share their number
    kept = moved.withColumn("piece", F.sum(F.col("start").cast("int")).over(W.partitionBy(*chunk).orderBy("t")))

    # a piece is the share of a trip inside one chunk; piece 0 goes on with the trip of the chunk before
    by_piece = by_device.orderBy("chunk", "slot", "piece")
    by_trip = W.partitionBy("device_id", "trip_seq")
    before = (W.unboundedPreceding, -1)
    pieces = (kept.groupBy(*chunk, "piece")
              .agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("first_t"),
                   F.max_by(here, F.struct(*order)).alias("last"))
              .withColumn("begins", (F.col("piece") > 0).cast("int"))
              .withColumn("trip_seq", F.sum("begins").over(by_piece))
              .withColumn("trip_n", F.sum("n").over(by_trip))
              .filter(F.col("trip_n") > params.trip_pings_min)
              .withColumn("trip_seq", F.sum("begins").over(by_piece))
              .withColumns({
                  "trip_start": F.min("first_t").over(by_trip),
                  "carried": F.lag("last").over(by_piece),
                  "shift": F.coalesce(F.sum("n").over(by_trip.orderBy("chunk", "slot", "piece").rowsBetween(*before)), F.lit(0))
                  - F.coalesce(F.sum("n").over(W.partitionBy(*chunk).orderBy("piece").rowsBetween(*before)), F.lit(0))}))
    # trips inside a chunk are more than trip_gap apart, so the map has a handful of entries
    info = pieces.groupBy(*chunk).agg(F.map_from_entries(F.collect_list(F.struct(
        "piece", F.struct("trip_seq", "trip_start", "trip_n", "shift", "carried")))).alias("pieces"))

    gap2 = F.abs(F.col("t") - F.col("prev2.t"))
    return (kept.join(info, chunk)
            .withColumn("p", F.try_element_at("pieces", "piece")).drop("pieces")
            .filter("p is not null")
            .withColumns({"prev2": F.lag(here).over(in_chunk), "rn": F.row_number().over(in_chunk)})
            .withColumn("prev2", F.coalesce("prev2", "p.carried"))
            .select("gid", "device_id", "p.trip_start", "p.trip_seq",
                    (F.col("rn") + F.col("p.shift")).alias("ptid"), "ts_ms", "t", "x", "y", "point_count",
                    "dt", "d", "start", "speed", F.col("p.trip_n").alias("point_count2"), gap2.alias("dt2"),
                    geo.distance("prev2.x", "prev2.y", "x", "y").alias("d2")))


TRIP = ["device_id", "trip_start"]


def build_traces(points: DataFrame) -> DataFrame:
    """One row per trip: statistics over the points that do not start it, and its two ends."""
    inner = ~F.col("start")

    def over(expr):
        return F.when(inner, expr)

    order = F.struct("t", "ts_ms", "gid")
    at = F.struct("x", "y", "t")
    stats = points.groupBy(*TRIP, "trip_seq").agg(
        F.sum(over(F.col("dt"))).alias("sum_dt"), F.count(over(F.col("dt"))).alias("count_dt"),
        F.avg(over(F.col("point_count2"))).alias("ping_count"),
        F.sum(over(F.col("d"))).alias("trip_distance"),
        F.sum(over(F.col("dt2"))).alias("sum_dt2"), F.sum(over(F.col("d2"))).alias("sum_d2"),
        F.count(F.lit(1)).alias("n_points"),
        F.min_by(at, order).alias("first"), F.max_by(at, order).alias("last"))
    return (stats
            .withColumn("avg_pingtime", F.col("sum_dt") / F.nullif(F.col("count_dt") - 1, F.lit(0)))
            .select(*TRIP, "trip_seq", "n_points",
                    F.col("first.x").alias("start_x"), F.col("first.y").alias("start_y"),
                    F.col("first.t").alias("start_t"),
                    F.col("last.x").alias("end_x"), F.col("last.y").alias("end_y"), F.col("last.t").alias("end_t"),
                    "avg_pingtime", "ping_count", "trip_distance",
                    (F.col("avg_pingtime") * F.col("ping_count")).alias("trip_duration"),
                    F.when(F.col("sum_dt2") > 0, F.col("sum_d2") / F.col("sum_dt2")).alias("avg_speed"),
                    geo.distance("first.x", "first.y", "last.x", "last.y").alias("trip_od_distance")))


def usable_traces(traces: DataFrame, params: Params = Params()) -> DataFrame:
    return traces.filter((F.col("avg_pingtime") <= params.avg_ping_max)
                         & (F.col("trip_duration") >= params.duration_min)
                         & (F.col("trip_od_distance") > params.od_distance_min)
                         & (F.col("n_points") >= 2))


def number_traces(traces: DataFrame) -> DataFrame:
    """Give traces a unique ``trip_id`` from 1 up; (device_id, trip_start) stays as the stable key."""
    return dense_ids(stage(traces, "traces"), ["device_id", "trip_start"], ["device_id", "trip_start"])


def trace_points(points: DataFrame, traces: DataFrame, params: Params = Params()) -> DataFrame:
    """The lines of ``traces`` in long form: trip_id, ptid, t, x, y."""
    spread = traces.select(*TRIP, "trip_id", F.explode(F.sequence(
        F.lit(0).cast("bigint"), part_of("n_points", params.part_rows))).alias("part"))
    return (points.withColumn("part", part_of("ptid", params.part_rows))
            .join(spread, [*TRIP, "part"]).select("trip_id", "ptid", "t", "x", "y"))


def line_parts(points: DataFrame, params: Params = Params()) -> DataFrame:
    """Lines as arrays, cut into parts of at most ``part_rows`` points so that no row grows without bound."""
    part = part_of("ptid", params.part_rows)
    return (points.groupBy("trip_id", part.alias("part"))
            .agg(F.array_sort(F.collect_list(F.struct("ptid", "x", "y", F.col("t").alias("m")))).alias("pts"))
            .select("trip_id", "part", F.expr("transform(pts, p -> named_struct('x', p.x, 'y', p.y, 'm', p.m))").alias("line")))


def explode_lines(traces: DataFrame, line="lines_geom") -> DataFrame:
    """Array lines -> long form, points numbered from 1. A long line may come in several rows, its parts, counted from 0 by ``line_part``: their
    points are numbered on. Only the sizes of the parts are windowed over a trip."""
    ahead = F.lit(0)
    if "line_part" in traces.columns:
        before = W.partitionBy("trip_id").orderBy("line_part").rowsBetween(W.unboundedPreceding, -1)
        sizes = traces.groupBy("trip_id", "line_part").agg(F.max(F.size(line)).alias("n")).select(
            "trip_id", "line_part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
        traces, ahead = traces.select("trip_id", "line_part", line).join(shuffled(sizes), ["trip_id", "line_part"]), F.col("ahead")
    return (traces.select("trip_id", ahead.alias("ahead"), F.posexplode(line).alias("pos", "p"))
            .select("trip_id", (F.col("ahead") + F.col("pos") + 1).cast("bigint").alias("ptid"),
                    F.col("p.m").cast("bigint").alias("t"), "p.x", "p.y"))


def trip_ends(points: DataFrame) -> DataFrame:
    """Ends, first second and number of points of every line in long form."""
    at = F.struct("x", "y")
    return (points.groupBy("trip_id")
            .agg(F.min_by(at, "ptid").alias("first"), F.max_by(at, "ptid").alias("last"), F.min("t").alias("t0"),
                 F.max("ptid").alias("n_points"))
            .select("trip_id", F.col("first.x").alias("start_x"), F.col("first.y").alias("start_y"),
                    F.col("last.x").alias("end_x"), F.col("last.y").alias("end_y"), "t0", "n_points"))


def line_lengths(points: DataFrame, params: Params = Params()) -> DataFrame:
    """trip_id and ``length`` of every line in long form; a line of one point has length 0."""
    steps = with_lags(points.select("trip_id", "ptid", "x", "y"), ["x", "y"], 1, params.part_rows)
    return steps.groupBy("trip_id").agg(F.coalesce(F.sum(geo.distance("x", "y", "prev1.x", "prev1.y")), F.lit(0.0)).alias("length"))

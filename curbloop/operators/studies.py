"""Study-specific inputs: sensors, meters, blocks, vendor, survey, video and household traces."""
from pyspark.sql import DataFrame, functions as F

from curbloop.functions import clock, geo
from curbloop.functions.projection import project_columns
from curbloop.operators.layout import dense_ids, renumber, shuffled, skew_join
from curbloop.operators.scratch import stage
from curbloop.operators.spatial import (box_holds_point, box_meets_line, cut_segments, inside_polygons, near_segments, segment_cells,
                                        segments_extent, street_segments)
from curbloop.operators.trips import trip_ends
from curbloop.params import Params

# Block ids that one study leaves out because its block map has them wrong.
WRONG_BLOCKS = [56848, 44312, 36506]
SIDE_CELL = 100  # metres; cells in which streets meet the sides of blocks


def sensor_occupancy(sensors: DataFrame, predictions: DataFrame, time_zone: str = "America/Los_Angeles") -> DataFrame:
    """Typed sensor readings with occupancy and the looked-up probability that the block is full.

    The lookup has one row per (capacity, pc_occ); Spark broadcasts it when it is small enough.
    """
    def occupancy(kind):
        taken, free = F.col(f"{kind}_occupied_time"), F.col(f"{kind}_vacant_time")
        return taken.cast("double") / F.nullif((taken + free).cast("double"), F.lit(0.0))

    out = (clock.with_local_12h(sensors, "start_time_dt", "sensor_time", time_zone)
           .withColumn("block_id", F.lpad("block_id", 5, "0"))
           .withColumns({
               "rate": F.nullif("ratetext", F.lit("")).try_cast("double"),
               "caldate": clock.parse_day("left(cal_date, 9)"),
               "tot_occ_pc": occupancy("tot"), "gmp_occ_pc": occupancy("gmp")})
           .drop("ratetext", "cal_date"))
    for kind in ("gmp", "tot"):
        lookup = predictions.filter("pc_occ >= 0").select(F.col("capacity").cast("bigint").alias("n"), F.col("pc_occ").cast("bigint").alias("occ"),
                                    F.col("pr_full").alias(f"{kind}_pr_full"))
        # hours are counted in whole numbers of seconds / 3600, like the integer division of the source columns
        # occupancy is looked up in single precision and rounded half to even
        # readings without an occupancy find nothing; each gets a number of its own below 0, or all of them would meet in one task
        nothing = -1 - F.pmod(F.xxhash64("block_id", "sensor_time", f"{kind}_time"), F.lit(1 << 20))
        keys = out.withColumns({"n": F.expr(f"{kind}_time div 3600"),
                                "occ": F.coalesce(F.rint(F.col(f"{kind}_occ_pc").cast("float").cast("double") * 100).cast("bigint"), nothing)})
        out = keys.join(lookup, ["n", "occ"], "left").drop("n", "occ")
    return out


def meter_points(meters: DataFrame, zone=None) -> DataFrame:
    """blockid from the post id and lon / lat from the "(lat, lon)" text; with a zone also x / y in its metres."""
    at = geo.point_from_lat_lon_text("location")
    points = (meters.withColumn("blockid", F.concat(F.left("post_id", F.lit(3)), F.substring("post_id", 5, 2)))
              .withColumns({"longitude": at["x"], "latitude": at["y"]}))
    return points if zone is None else project_columns(points, zone)


def street_block_ids(streets: DataFrame, blocks: DataFrame, wrong_blocks=()) -> DataFrame:
    """sfpark_id of the block that holds the middle 60 percent of a street; blocks in ``wrong_blocks`` do not count.

    ``blocks`` are boundary rows (block_id, ring, seq, x1 .. y2) of any shape. A line is in a block when its vertices are and, between
    any two places where a side crosses it, its middle is.
    """
    segments = street_segments(streets.select("id", "geom_way"))
    middle = cut_segments(segments, "0.2D", "0.8D")
    ends = middle.select("id", "seq", F.explode(F.array(
        F.struct(F.lit(0).alias("at"), F.col("x1").alias("x"), F.col("y1").alias("y")),
        F.struct(F.lit(1).alias("at"), F.col("x2").alias("x"), F.col("y2").alias("y")))).alias("p"))
    ends = ends.select("id", "seq", "p.at", "p.x", "p.y")
    blocks = blocks.filter(~F.col("block_id").isin(list(wrong_blocks)))
    inside = (inside_polygons(ends, blocks, "block_id", ["id", "seq", "at"], size=100)
              .groupBy("id", "block_id").agg(F.count(F.lit(1)).alias("n_in")))
    whole = ends.groupBy("id").agg(F.count(F.lit(1)).alias("n_ends"))
    holding = stage(inside.join(shuffled(whole), "id").filter("n_in = n_ends").select("id", "block_id"), "holding")
    between = stage(_middles_between_sides(middle, blocks, holding), "between")
    left = (between.join(shuffled(inside_polygons(between, blocks, "block_id", ["id", "seq", "k", "target"], size=100).filter("target = block_id").drop("block_id")),
                         ["id", "seq", "k", "target"], "left_anti").select("id", F.col("target").alias("block_id")).distinct())
    found = (holding.join(shuffled(left), ["id", "block_id"], "left_anti").groupBy("id").agg(F.min("block_id").alias("block_id"))
             .select("id", F.lpad(F.col("block_id").cast("bigint").cast("string"), 5, "0").alias("sfpark_id")))
    return streets.join(shuffled(found), "id", "left")


def _middles_between_sides(segments: DataFrame, blocks: DataFrame, pairs: DataFrame) -> DataFrame:
    """For pairs (id, block_id): the middles (id, seq, k, target, x, y) of the pieces into which the sides of the block cut a segment. A side
    that lies along the segment needs no cut, its neighbours cut there."""
    cell = ["cx", "cy"]
    sides = segment_cells(blocks, 0, SIDE_CELL).selectExpr("block_id", *cell, "x1 AS bx", "y1 AS by", "x2 - x1 AS sx", "y2 - y1 AS sy")
    # a segment meets the sides in its own cells only; one that meets none lies where its ends lie
    parts = segment_cells(segments, 0, SIDE_CELL).selectExpr("id", "seq", *cell, "x1", "y1", "x2 - x1 AS rx", "y2 - y1 AS ry")
    met = (pairs.join(shuffled(parts), "id").join(shuffled(sides), ["block_id", *cell])
           .withColumn("d", F.expr("nullif(rx * sy - ry * sx, 0D)"))
           .withColumns({"t": F.expr("((bx - x1) * sy - (by - y1) * sx) / d"), "u": F.expr("((bx - x1) * ry - (by - y1) * rx) / d")}))
    cuts = met.groupBy("id", "seq", "block_id", "x1", "y1", "rx", "ry").agg(
        F.expr("array_sort(array_union(array(0D, 1D), collect_set(if(t > 0 AND t < 1 AND u BETWEEN -1e-9 AND 1 + 1e-9, t, NULL)))) AS ts"))
    return (cuts.filter("size(ts) > 2").selectExpr("*", "posexplode(transform(sequence(1, size(ts) - 1), k -> (ts[k - 1] + ts[k]) / 2)) AS (k, mid)")
            .selectExpr("id", "seq", "k", "block_id AS target", "x1 + mid * rx AS x", "y1 + mid * ry AS y"))


def streets_near_layer(streets: DataFrame, layer: DataFrame, grow: float) -> DataFrame:
    """Streets whose box overlaps the box of a layer grown by some metres."""
    return streets.filter(box_meets_line(segments_extent(layer, grow), "geom_way"))


def vendor_trip_filter(traces: DataFrame, curbs: DataFrame, year_min: int = 2013, grow: float = 500,
                       time_zone: str = "UTC") -> tuple[DataFrame, DataFrame]:
    """Keep true trip ends of personal vehicles since a year that end near the curb layer.

    ``traces`` has end_good, provider_type, start_t, end_x, end_y. Returns (kept traces, one row of counts after each rule).
    """
    box = segments_extent(curbs, grow)
    rules = [F.coalesce(F.col("end_good"), F.lit(True)),
             F.coalesce(F.col("provider_type") == "PERS", F.lit(True)),
             F.coalesce(F.year(clock.local_wall_clock(F.col("start_t"), time_zone)) >= year_min, F.lit(True)),
             F.coalesce(box_holds_point(box, "end_x", "end_y"), F.lit(True))]
    passed = F.lit(True)
    names, flags = ["end_good", "personal", "recent", "in_area"], {}
    for name, rule in zip(names, rules):
        passed = passed & rule
        flags[name] = passed
    marked = traces.withColumns(flags)
    counts = marked.agg(F.count(F.lit(1)).alias("n_all"), *[F.count_if(n).alias("n_" + n) for n in names])
    return marked.filter("in_area").drop(*[n for n in names if n not in traces.columns]), counts


def survey_points(logs: DataFrame, guide: DataFrame) -> DataFrame:
    """Log rows with their instant, destination and cruise flag.

    ``logs``: traceid, trace, day, start_ms (wall clock as epoch ms), framenum, frametime (ms), lat, lon. ``guide``: trace, day, video,
    elapsed (``h:mm:ss``), at most one row per (trace, day).
    """
    doubles = guide.groupBy("trace", "day").agg(F.count(F.lit(1)).alias("n"))
    video = F.col("video")
    dest = F.when(video.startswith("G") | video.startswith("No Video"), "").otherwise(
        F.coalesce(F.get(F.split(F.get(F.split(video, " "), F.lit(0)), "_"), F.lit(1)), F.lit("")))
    clock_parts = F.split("elapsed", ":")
    start_ms = (F.get(clock_parts, F.lit(0)).try_cast("bigint") * 3600 + F.get(clock_parts, F.lit(1)).try_cast("bigint") * 60
                + F.get(clock_parts, F.lit(2)).try_cast("bigint")) * 1000
    lookup = (guide.join(doubles, ["trace", "day"])
              .select("trace", "day", F.assert_true(F.col("n") == 1, F.lit("more than one guide row for a log")).alias("ok"),
                      dest.alias("dest"), start_ms.alias("cruise_ms"))
              .filter("ok is null").drop("ok"))
    return (logs.join(lookup, ["trace", "day"], "left")
            .withColumns({"dest": F.coalesce("dest", F.lit("")),
                          "ms": F.col("start_ms") + F.col("frametime"),
                          "cruise": F.col("frametime") >= F.col("cruise_ms")}))


def survey_traces(logs: DataFrame, guide: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Survey logs -> (trips, line points). Lines hold one mean position per second; the end is the last raw position."""
    rows = survey_points(logs, guide).filter("lat is not null and lon is not null")
    seconds = (rows.groupBy("traceid", F.expr("ms div 1000").alias("t"))
               .agg(F.avg("lon").alias("lon"), F.avg("lat").alias("lat"),
                    # a second cruises when all its rows do
                    F.coalesce(F.avg(F.col("cruise").cast("int")) == 1, F.lit(False)).alias("cruise")))
    ends = rows.groupBy("traceid").agg(F.max_by(F.struct("lon", "lat"), F.struct("ms", "framenum")).alias("end"),
                                       F.max("dest").alias("dest"))
    sizes = seconds.groupBy("traceid").agg(F.count(F.lit(1)).alias("n_points"), F.count_if("cruise").alias("n_cruise"),
                                           F.min("t").alias("t0"))
    trips = ends.join(shuffled(sizes), "traceid").select("traceid", "dest", F.col("end.lon").alias("end_lon"),
                                               F.col("end.lat").alias("end_lat"), "t0", "n_points", "n_cruise")
    return trips, seconds


def survey_lines(logs: DataFrame, guide: DataFrame, zone, params: Params = Params()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Survey logs -> (traces, points, cruise points) in metres of a zone, as ``classify_traces`` takes them.

    Traces have a ``trip_id`` beside their columns in degrees, the start of the line and the end, which is the last raw position. Points are trip_id,
    ptid, t, x, y; the measure t is the second. The cruise line holds the seconds that cruise, numbered anew, and is empty for a trip without any."""
    trips, seconds = survey_traces(logs, guide)
    trips = stage(dense_ids(stage(trips, "survey-trips"), ["traceid"], ["traceid"]), "survey-ids")
    ids = trips.select("traceid", "trip_id", "t0")
    rows = skew_join(seconds, ids, ["traceid"], ["t"]).withColumn("ptid", F.col("t") - F.col("t0") + 1)
    rows = project_columns(rows, zone, "lon", "lat").select("trip_id", "ptid", "t", "x", "y", "cruise")
    points = stage(renumber(rows, params.part_rows), "survey-points")
    cruising = renumber(points.filter("cruise"), params.part_rows).select("trip_id", "ptid", "t", "x", "y")
    starts = trip_ends(points).select("trip_id", "start_x", "start_y")
    traces = project_columns(trips, zone, "end_lon", "end_lat", "end_x", "end_y").join(shuffled(starts), "trip_id")
    return traces, points.select("trip_id", "ptid", "t", "x", "y"), cruising


def video_traces(pings: DataFrame, tracts: DataFrame | None, locate, pings_min: int = 20) -> tuple[DataFrame, DataFrame]:
    """Video pings (trip_id, device, epoch, longitude, latitude) -> (trips, points) with more than ``pings_min`` pings
    that end inside the tracts. ``locate`` adds x, y."""
    rows = locate(pings)
    at = F.struct("x", "y", "epoch")
    order = F.struct("epoch", "longitude", "latitude")
    trips = (rows.groupBy("trip_id")
             .agg(F.count(F.lit(1)).alias("n_points"), F.min("device").alias("device"), F.max("device").alias("other"),
                  F.min_by(at, order).alias("s"), F.max_by(at, order).alias("e"))
             .filter(F.col("n_points") > pings_min)
             .withColumn("device", F.when(F.assert_true(F.col("device") == F.col("other"), F.lit("trip of two devices")).isNull(),
                                          F.col("device")))
             .select("trip_id", "device", "n_points", F.col("s.epoch").alias("t0"), F.col("s.x").alias("start_x"),
                     F.col("s.y").alias("start_y"), F.col("e.x").alias("end_x"), F.col("e.y").alias("end_y")))
    if tracts is not None:
        ends = trips.select("trip_id", F.col("end_x").alias("x"), F.col("end_y").alias("y"))
        trips = trips.join(shuffled(inside_polygons(ends, tracts, "tract", ["trip_id"]).select("trip_id").distinct()), "trip_id", "left_semi")
    points = skew_join(rows, trips.select("trip_id"), ["trip_id"], ["epoch"])
    return trips, points


HOUSEHOLD = ["gpstripid", "sampno", "vehno"]


def household_traces(points: DataFrame, trip_ends: DataFrame, streets: DataFrame | None = None, within: float = 200) -> DataFrame:
    """Survey points (three keys, localid, t, x, y) of the given trips -> traces; with streets, only those that end near one.

    ``trip_ends``: three keys, end_x, end_y.
    """
    chosen = trip_ends.select(*HOUSEHOLD, F.col("end_x").alias("x"), F.col("end_y").alias("y"))
    if streets is not None:
        segments = street_segments(streets.select("id", "geom_way")).select("x1", "y1", "x2", "y2")
        chosen = near_segments(chosen, segments, within, HOUSEHOLD)
    chosen = chosen.select(*HOUSEHOLD).distinct()
    at = F.struct("x", "y", "t")
    return (skew_join(points, chosen, HOUSEHOLD, ["localid"]).groupBy(*HOUSEHOLD)
            .agg(F.max("t").alias("endtime"), F.count(F.lit(1)).alias("n_points"),
                 F.min_by(at, "localid").alias("s"), F.max_by(at, "localid").alias("e"))
            .select(*HOUSEHOLD, "endtime", "n_points", F.col("s.x").alias("start_x"), F.col("s.y").alias("start_y"),
                    F.col("e.x").alias("end_x"), F.col("e.y").alias("end_y")))


def household_lines(points: DataFrame, traces: DataFrame, zone=None, params: Params = Params()) -> tuple[DataFrame, DataFrame]:
    """Household traces with a ``trip_id`` from 1 up, and their lines (trip_id, ptid, t, x, y), as ``classify_traces`` takes them.

    ``points``: three keys, localid, t and x, y, or longitude, latitude if there is a zone to project to; the traces then get the ends of the projected lines.
    Lines follow localid, a whole number that a trip uses once, from any start and with gaps. Points of other trips are left out."""
    ids = stage(dense_ids(stage(traces, "household-traces"), HOUSEHOLD, HOUSEHOLD), "household-ids")
    rows = skew_join(points, ids.select(*HOUSEHOLD, "trip_id"), HOUSEHOLD, ["localid"])
    if zone is not None:
        rows = project_columns(rows, zone)
    first = rows.groupBy("trip_id").agg(F.min("localid").alias("first"))
    rows = (skew_join(rows.select("trip_id", "localid", "t", "x", "y"), first, ["trip_id"], ["localid"])
            .select("trip_id", F.expr("cast(localid AS bigint) - first + 1 AS ptid"), "t", "x", "y"))
    lines = stage(renumber(rows, params.part_rows), "household-points")
    if zone is not None:
        ends = trip_ends(lines).select("trip_id", "start_x", "start_y", "end_x", "end_y")
        ids = ids.drop("start_x", "start_y", "end_x", "end_y").join(shuffled(ends), "trip_id")
    return ids, lines

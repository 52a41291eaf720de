"""Study inputs."""
from pyspark.sql import functions as F

from cases import inputs
from cases.inputs import lambert_sql, rounded
from curbloop.functions import geo
from curbloop.operators import frechet, spatial, studies, trips
from curbloop.params import Params

def sensor_rows(spark, sf_dir):
    return inputs.table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cast(l_partkey % 20000 AS string) AS block_id",
        "if(l_linenumber = 3, '', cast(l_tax AS string)) AS ratetext",
        "concat(date_format(l_shipdate, 'dd-'), upper(date_format(l_shipdate, 'MMM-yy')), ' 12.00.00.000000 AM') AS cal_date",
        "concat(date_format(l_shipdate, 'dd-'), upper(date_format(l_shipdate, 'MMM-yy')), ' ', lpad(cast(1 + l_orderkey % 12 AS string), 2, '0'),"
        " '.30.00.000000 ', if(l_linenumber % 2 = 0, 'AM', 'PM')) AS start_time_dt",
        "3600L * (l_suppkey % 30) + 1800 AS tot_time", "cast(l_quantity AS bigint) AS tot_occupied_time",
        "cast(if(l_linenumber = 5, -l_quantity, l_partkey % 50) AS bigint) AS tot_vacant_time",
        "3600L * (l_partkey % 30) AS gmp_time", "l_partkey % 37 AS gmp_occupied_time", "l_suppkey % 41 AS gmp_vacant_time")


def predictions(spark, sf_dir):
    """30 x 101 pairs per distinct capacity seen in the readings."""
    caps = inputs.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey % 30 AS capacity").distinct()
    return caps.selectExpr("capacity", "explode(sequence(0, 100)) AS pc_occ").selectExpr(
        "capacity", "pc_occ", "(capacity * 101 + pc_occ) / 4000D AS pr_full")


def sensor_occupancy(spark, sf_dir):
    out = studies.sensor_occupancy(sensor_rows(spark, sf_dir), predictions(spark, sf_dir))
    return rounded(out.selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "block_id", "rate", "date_format(caldate, 'yyyy-MM-dd') AS caldate",
        "unix_seconds(sensor_time) AS sensor_secs", "tot_occ_pc", "gmp_occ_pc", "tot_pr_full", "gmp_pr_full"), 6)


SENSOR_OCCUPANCY = """WITH s AS (SELECT *, lpad((l_partkey % 20000)::VARCHAR, 5, '0') AS block_id,
   CASE WHEN l_linenumber <> 3 THEN l_tax END AS rate, strftime(l_shipdate, '%Y-%m-%d') AS caldate,
   date_trunc('day', l_shipdate) + to_hours(((1 + l_orderkey % 12) % 12 + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE 12 END)::INT)
     + to_minutes(30) AS wall,
   l_quantity / nullif(l_quantity + CASE WHEN l_linenumber = 5 THEN -l_quantity ELSE l_partkey % 50 END, 0) AS tot_occ_pc,
   (l_partkey % 37)::DOUBLE / nullif(l_partkey % 37 + l_suppkey % 41, 0) AS gmp_occ_pc FROM lineitem),
p AS (SELECT DISTINCT l_suppkey % 30 AS capacity FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, block_id, round(rate, 6) AS rate, caldate,
   epoch(wall AT TIME ZONE 'America/Los_Angeles')::BIGINT AS sensor_secs, round(tot_occ_pc, 6) AS tot_occ_pc, round(gmp_occ_pc, 6) AS gmp_occ_pc,
   CASE WHEN round_even(tot_occ_pc::FLOAT::DOUBLE * 100, 0) BETWEEN 0 AND 100
        THEN round((l_suppkey % 30 * 101 + round_even(tot_occ_pc::FLOAT::DOUBLE * 100, 0)) / 4000, 6) END AS tot_pr_full,
   CASE WHEN l_partkey % 30 IN (FROM p) AND round_even(gmp_occ_pc::FLOAT::DOUBLE * 100, 0) BETWEEN 0 AND 100
        THEN round((l_partkey % 30 * 101 + round_even(gmp_occ_pc::FLOAT::DOUBLE * 100, 0)) / 4000, 6) END AS gmp_pr_full
FROM s"""


def meter_points(spark, sf_dir):
    meters = inputs.table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat(lpad(cast(event_id % 1000 AS string), 3, '0'), '-', lpad(cast(event_id % 97 AS string), 5, '0')) AS post_id",
        "concat('(', cast(37 + event_id % 1000 / 1000D AS string), ', ', cast(-122 - event_id % 777 / 1000D AS string), ')') AS location")
    return rounded(studies.meter_points(meters).select("event_id", "blockid", "longitude", "latitude"), 6)


METER_POINTS = """SELECT event_id, lpad((event_id % 1000)::VARCHAR, 3, '0') || lpad((event_id % 97)::VARCHAR, 5, '0')[1:2] AS blockid,
   round(-122 - event_id % 777 / 1000::DOUBLE, 6) AS longitude, round(37 + event_id % 1000 / 1000::DOUBLE, 6) AS latitude FROM events"""


def meter_metres(spark, sf_dir):
    """Meters on the plane of their region."""
    meters = inputs.table(spark, sf_dir, "events").selectExpr(
        "event_id", "concat(lpad(cast(event_id % 1000 AS string), 3, '0'), '-', lpad(cast(event_id % 97 AS string), 5, '0')) AS post_id",
        "concat('(', cast(37 + event_id % 1000 / 1000D AS string), ', ', cast(-122 - event_id % 777 / 1000D AS string), ')') AS location")
    return rounded(studies.meter_points(meters, "sf").select("event_id", "blockid", "x", "y"))


METER_METRES = "WITH m AS ({m}) SELECT event_id, blockid, round({x}, 3) AS x, round({y}, 3) AS y FROM m".format(
    m=METER_POINTS, **dict(zip("xy", lambert_sql("longitude", "latitude", "sf"))))


#: Corners of a block around its centre: a box of 200 x 60 m, and a U of 260 x 260 m whose notch, 40 m wide, comes from the north down to
#: 70 m below the centre, so that streets run from arm to arm through it.
BOX = [(-100, -30), (100, -30), (100, 30), (-100, 30)]
U_SHAPE = [(-130, -130), (130, -130), (130, 130), (20, 130), (20, -70), (-20, -70), (-20, 130), (-130, 130)]


def _sides(corners) -> str:
    return ", ".join(f"({k}, {a[0]}, {a[1]}, {b[0]}, {b[1]})" for k, (a, b) in enumerate(zip(corners, corners[1:] + corners[:1])))


def blocks(spark, sf_dir):
    """Boxes around every other crossing, and U-shaped blocks 30 m east of every 16th crossing of the others; one block id is on the wrong list."""
    return spark.sql(f"""WITH q AS (SELECT c, i, j, 20000D * c - 1140 + 120 * i AS cx, 20000D * c - 1200 + 120 * j AS cy FROM {{n}})
        SELECT if(c = 0 AND i = 1 AND j = 1, 56848, c * 441 + i * 21 + j) AS block_id, 0 AS ring, seq, cx + a1 AS x1, cy + b1 AS y1, cx + a2 AS x2, cy + b2 AS y2
        FROM q CROSS JOIN (VALUES {_sides(BOX)}) s(seq, a1, b1, a2, b2) WHERE (i + j) % 2 = 0
        UNION ALL SELECT c * 441 + i * 21 + j, 0, seq, cx + 30 + a1, cy + b1, cx + 30 + a2, cy + b2
        FROM q CROSS JOIN (VALUES {_sides(U_SHAPE)}) s(seq, a1, b1, a2, b2) WHERE i % 4 = 1 AND j % 4 = 2""", n=inputs.nodes(spark, sf_dir))


def street_block_ids(spark, sf_dir):
    return studies.street_block_ids(inputs.streets(spark, sf_dir), blocks(spark, sf_dir), studies.WRONG_BLOCKS).select("id", "sfpark_id")


STREET_BLOCK_IDS = f"""WITH {inputs.GRID},
q AS (SELECT c, i, j, c * 441 + i * 21 + j AS block_id, 20000::DOUBLE * c - 1140 + 120 * i AS cx, 20000::DOUBLE * c - 1200 + 120 * j AS cy FROM nodes),
m AS (SELECT id, c, x1 + 0.2 * (x2 - x1) AS mx1, x1 + 0.8 * (x2 - x1) AS mx2, y1 + 0.2 * (y2 - y1) AS my1, y1 + 0.8 * (y2 - y1) AS my2 FROM grid),
hits AS (SELECT id, block_id FROM m JOIN q USING (c)
         WHERE (i + j) % 2 = 0 AND NOT (c = 0 AND i = 1 AND j = 1) AND block_id NOT IN (56848, 44312, 36506)
           AND greatest(abs(mx1 - cx), abs(mx2 - cx)) <= 100 AND greatest(abs(my1 - cy), abs(my2 - cy)) <= 30
         UNION ALL SELECT id, block_id FROM m JOIN q USING (c)  -- in the box of the U, and not through its notch
         WHERE i % 4 = 1 AND j % 4 = 2 AND block_id NOT IN (56848, 44312, 36506)
           AND greatest(abs(mx1 - cx - 30), abs(mx2 - cx - 30)) <= 130 AND greatest(abs(my1 - cy), abs(my2 - cy)) <= 130
           AND NOT (greatest(mx1, mx2) > cx + 10 AND least(mx1, mx2) < cx + 50 AND greatest(my1, my2) > cy - 70)),
b AS (SELECT id, min(block_id) AS b FROM hits GROUP BY id)
SELECT id, lpad(b::VARCHAR, 5, '0') AS sfpark_id FROM grid LEFT JOIN b USING (id)"""


def large_lots(spark, sf_dir):
    """Parcel sizes: squares of 40 m, made 30 times as wide at every fifth lot; the large ones go."""
    parcels = inputs.lots(spark, sf_dir).withColumns({
        "x1": F.expr("if(lot_id % 5 = 0, x1 * 30, x1)"), "x2": F.expr("if(lot_id % 5 = 0, x2 * 30, x2)"),
        "y1": F.expr("if(lot_id % 5 = 0, y1 * 30, y1)"), "y2": F.expr("if(lot_id % 5 = 0, y2 * 30, y2)")})
    kept = spatial.drop_large_polygons(parcels, "lot_id")
    return rounded(spatial.polygon_area(kept, "lot_id"), 2)


LARGE_LOTS = f"WITH {inputs.GRID}, {inputs.LOTS} SELECT lot_id, 1600::DOUBLE AS area FROM lots WHERE lot_id % 5 <> 0"


def streets_near_layer(spark, sf_dir):
    """Streets within 30 m of the box of all lots: those at the edges of the first and the last district lie outside."""
    return studies.streets_near_layer(inputs.streets(spark, sf_dir), inputs.lots(spark, sf_dir), 30).select("id")


STREETS_NEAR_LAYER = f"""WITH {inputs.GRID}, {inputs.LOTS},
box AS (SELECT min(cx) - 50 AS lx, min(cy) - 50 AS ly, max(cx) + 50 AS hx, max(cy) + 50 AS hy FROM lots)
SELECT id FROM grid, box WHERE greatest(x1, x2) >= lx AND least(x1, x2) <= hx AND greatest(y1, y2) >= ly AND least(y1, y2) <= hy"""


def _vendor(spark, sf_dir):
    ends = trips.trip_ends(inputs.drives(spark, sf_dir))
    traces = ends.withColumns({
        "end_good": F.expr("CASE trip_id % 4 WHEN 0 THEN false WHEN 1 THEN NULL ELSE true END"),
        "provider_type": F.expr("CASE WHEN trip_id % 5 = 0 THEN 'COMM' WHEN trip_id % 7 = 0 THEN NULL ELSE 'PERS' END"),
        "start_t": F.expr("if(trip_id % 6 = 0, 1320000000, 1704103200)"),
        "end_x": F.expr("end_x + if(trip_id % 9 = 0, -90000, 0)")})
    return studies.vendor_trip_filter(traces, inputs.curbs(spark, sf_dir))


def vendor_trip_filter(spark, sf_dir):
    return rounded(_vendor(spark, sf_dir)[0].select("trip_id", "end_x", "end_y", "n_points"))


_VENDOR = f"""{inputs.DRIVES}, {inputs.GRID}, {inputs.CURBS},
box AS (SELECT min(least(x1, x2)) - 500 AS lx, min(least(y1, y2)) - 500 AS ly, max(greatest(x1, x2)) + 500 AS hx,
               max(greatest(y1, y2)) + 500 AS hy FROM curbs),
t AS (SELECT trip_id, arg_max(x, ptid) + CASE WHEN trip_id % 9 = 0 THEN -90000 ELSE 0 END AS end_x, arg_max(y, ptid) AS end_y,
             count(*) AS n_points FROM drives GROUP BY trip_id),
r AS (SELECT t.*, trip_id % 4 <> 0 AS r1, trip_id % 5 <> 0 AS r2, trip_id % 6 <> 0 AS r3,
             end_x BETWEEN lx AND hx AND end_y BETWEEN ly AND hy AS r4 FROM t, box)"""
VENDOR_TRIP_FILTER = f"""WITH {_VENDOR}
SELECT trip_id, round(end_x, 3) AS end_x, round(end_y, 3) AS end_y, n_points FROM r WHERE r1 AND r2 AND r3 AND r4"""


def vendor_drop_counts(spark, sf_dir):
    return _vendor(spark, sf_dir)[1]


VENDOR_DROP_COUNTS = f"""WITH {_VENDOR}
SELECT count(*) AS n_all, count(*) FILTER (r1) AS n_end_good, count(*) FILTER (r1 AND r2) AS n_personal,
       count(*) FILTER (r1 AND r2 AND r3) AS n_recent, count(*) FILTER (r1 AND r2 AND r3 AND r4) AS n_in_area FROM r"""

_LOGS = """SELECT concat('May ', 1 + user_id % 28, ' trace ', user_id) AS traceid, concat(lpad({user}, 5, '0'), '_00') AS trace,
   1 + user_id % 28 AS day, 1432600000000 + user_id * 86400000 AS start_ms, event_id AS framenum,
   400 * row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS frametime,
   CASE WHEN event_id % 13 <> 0 THEN 37.7{f} + event_id % 1000 / 100000{f} END AS lat, -122.4{f} + event_id % 777 / 100000{f} AS lon, user_id
   FROM {events}"""


def survey_inputs(spark, sf_dir):
    logs = spark.sql(_LOGS.format(f="D", user="cast(user_id AS string)", events="{e}"), e=inputs.table(spark, sf_dir, "events"))
    guide = logs.select("trace", "day", "user_id").distinct().filter("user_id % 3 <> 0").selectExpr(
        "trace", "day", "CASE user_id % 5 WHEN 0 THEN 'GOPR 1' WHEN 1 THEN 'No Video' ELSE concat('V_', user_id, ' x') END AS video",
        "if(user_id % 4 = 0, NULL, '0:00:09') AS elapsed")
    return logs, guide


def survey_traces(spark, sf_dir):
    table, points = studies.survey_traces(*survey_inputs(spark, sf_dir))
    first = points.groupBy("traceid").agg(F.sum("lon").alias("sum_lon"), F.sum("lat").alias("sum_lat"))
    return rounded(table.join(first, "traceid"), 7)


SURVEY_TRACES = f"""WITH logs AS ({_LOGS.format(f='::DOUBLE', user='user_id::VARCHAR', events='events')}),
rows AS (SELECT *, start_ms + frametime AS ms, CASE WHEN user_id % 3 <> 0 AND user_id % 4 <> 0 THEN frametime >= 9000 END AS cruise
         FROM logs WHERE lat IS NOT NULL),
secs AS (SELECT traceid, ms // 1000 AS t, avg(lon) AS lon, avg(lat) AS lat, coalesce(bool_and(cruise), false) AS cruise FROM rows GROUP BY ALL)
SELECT traceid, dest, end_lon, end_lat, t0, n_points, n_cruise, round(sum_lon, 7) AS sum_lon, round(sum_lat, 7) AS sum_lat FROM (
  SELECT traceid, round(arg_max(lon, ms), 7) AS end_lon, round(arg_max(lat, ms), 7) AS end_lat,
         max(CASE WHEN user_id % 3 = 0 OR user_id % 5 < 2 THEN '' ELSE user_id::VARCHAR END) AS dest FROM rows GROUP BY traceid)
JOIN (SELECT traceid, min(t) AS t0, count(*) AS n_points, count(*) FILTER (cruise) AS n_cruise, sum(lon) AS sum_lon, sum(lat) AS sum_lat
      FROM secs GROUP BY traceid) USING (traceid)"""


def survey_lines(spark, sf_dir):
    """Lines, cruise lines and ends in metres, and the numbers of the points."""
    traces, points, cruising = studies.survey_lines(*survey_inputs(spark, sf_dir), "sf", Params(part_rows=50))
    few = Params(part_rows=20)

    def line(rows, name):
        sizes = rows.groupBy("trip_id").agg(F.count(F.lit(1)).alias(f"{name}_points"), F.max("ptid").alias(f"{name}_last"), F.min("t").alias(f"{name}_from"),
                                            F.max("t").alias(f"{name}_to"))
        return sizes.join(trips.line_lengths(rows, few).withColumnRenamed("length", f"{name}_length"), "trip_id")

    out = traces.join(line(points, "line"), "trip_id").join(line(cruising, "cruise"), "trip_id", "left")
    return rounded(out.drop("trip_id", "end_lon", "end_lat", "t0", "n_points", "n_cruise"), 2)


_SX, _SY = lambert_sql("lon", "lat", "sf")
_EX, _EY = lambert_sql("end_lon", "end_lat", "sf")
SURVEY_LINES = f"""WITH logs AS ({_LOGS.format(f='::DOUBLE', user='user_id::VARCHAR', events='events')}),
rows AS (SELECT *, start_ms + frametime AS ms, CASE WHEN user_id % 3 <> 0 AND user_id % 4 <> 0 THEN frametime >= 9000 END AS cruise
         FROM logs WHERE lat IS NOT NULL),
secs AS (SELECT traceid, ms // 1000 AS t, avg(lon) AS lon, avg(lat) AS lat, coalesce(bool_and(cruise), false) AS cruise FROM rows GROUP BY ALL),
plane AS (SELECT *, {_SX} AS x, {_SY} AS y FROM secs),
steps AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM plane WINDOW w AS (PARTITION BY traceid ORDER BY t)),
cruising AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d FROM plane WHERE cruise WINDOW w AS (PARTITION BY traceid ORDER BY t)),
ends AS (SELECT traceid, arg_max(lon, ms) AS end_lon, arg_max(lat, ms) AS end_lat,
                max(CASE WHEN user_id % 3 = 0 OR user_id % 5 < 2 THEN '' ELSE user_id::VARCHAR END) AS dest FROM rows GROUP BY traceid),
l AS (SELECT traceid, arg_min(x, t) AS sx, arg_min(y, t) AS sy, count(*) AS n, min(t) AS t0, max(t) AS t1, coalesce(sum(d), 0) AS d FROM steps GROUP BY 1),
c AS (SELECT traceid, count(*) AS n, min(t) AS t0, max(t) AS t1, coalesce(sum(d), 0) AS d FROM cruising GROUP BY 1)
SELECT traceid, dest, round({_EX}, 2) AS end_x, round({_EY}, 2) AS end_y, round(sx, 2) AS start_x, round(sy, 2) AS start_y, l.n AS line_points, l.n AS line_last,
       l.t0 AS line_from, l.t1 AS line_to, round(l.d, 2) AS line_length, c.n AS cruise_points, c.n AS cruise_last, c.t0 AS cruise_from, c.t1 AS cruise_to,
       round(c.d, 2) AS cruise_length FROM ends JOIN l USING (traceid) LEFT JOIN c USING (traceid)"""


def video_traces(spark, sf_dir):
    """Device and trip numbers from users; positions in metres; tracts are the block groups without one row."""
    pings = inputs.drives(spark, sf_dir).selectExpr(
        "trip_id % 7 AS device", "trip_id AS trip", "t AS epoch", "x", "y",
        "if(ptid % 11 = 0, 0D, y + 1D) AS latitude", "x + 1D AS longitude").filter("latitude <> 0 and longitude <> 0")
    pings = pings.withColumn("trip_id", F.expr("device * 20000 + trip"))
    tracts = inputs.block_groups(spark, sf_dir).withColumnRenamed("bg", "tract").filter("right(tract, 2) <> '11'")
    table, points = studies.video_traces(pings, tracts, lambda df: df)
    ends = trips.trip_ends(points.selectExpr("trip_id", "epoch - 1704103200 AS ptid", "epoch AS t", "x", "y"))
    return rounded(table.join(ends.selectExpr("trip_id", "t0 AS first_t"), "trip_id"))


VIDEO_TRACES = f"""WITH {inputs.DRIVES}, {inputs.GRID}, {inputs.BLOCK_GROUPS},
p AS (SELECT trip_id % 7 * 20000 + trip_id AS id, trip_id % 7 AS device, trip_id // 10 AS c, t, x, y FROM drives
      WHERE ptid % 11 <> 0 AND y + 1 <> 0 AND x + 1 <> 0),
v AS (SELECT id AS trip_id, any_value(device) AS device, any_value(c) AS c, count(*) AS n_points, min(t) AS t0, min(t) AS first_t,
             arg_min(x, t) AS start_x, arg_min(y, t) AS start_y, arg_max(x, t) AS end_x, arg_max(y, t) AS end_y FROM p GROUP BY id HAVING count(*) > 20)
SELECT trip_id, device, n_points, t0, first_t, round(start_x, 3) AS start_x, round(start_y, 3) AS start_y, round(end_x, 3) AS end_x,
       round(end_y, 3) AS end_y FROM v
SEMI JOIN (SELECT * FROM bgs WHERE bg[-2:] <> '11') b ON b.c = v.c AND abs(end_x - cx) <= h AND abs(end_y - cy) <= h"""


def household_traces(spark, sf_dir):
    points = inputs.drives(spark, sf_dir).selectExpr(
        "trip_id AS gpstripid", "trip_id % 13 AS sampno", "trip_id % 3 AS vehno", "ptid AS localid", "t", "x", "y")
    ends = trips.trip_ends(inputs.drives(spark, sf_dir)).selectExpr(
        "trip_id AS gpstripid", "trip_id % 13 AS sampno", "trip_id % 3 AS vehno", "end_x + if(trip_id % 4 = 0, 3000, 40) AS end_x", "end_y")
    return rounded(studies.household_traces(points, ends, inputs.streets(spark, sf_dir)))


HOUSEHOLD_TRACES = f"""WITH {inputs.DRIVES}
SELECT trip_id AS gpstripid, trip_id % 13 AS sampno, trip_id % 3 AS vehno, max(t) AS endtime, count(*) AS n_points,
       round(arg_min(x, ptid), 3) AS start_x, round(arg_min(y, ptid), 3) AS start_y, round(arg_max(x, ptid), 3) AS end_x,
       round(arg_max(y, ptid), 3) AS end_y FROM drives WHERE trip_id % 4 <> 0 GROUP BY trip_id"""


def household_lines(spark, sf_dir):
    """Survey points in degrees, numbered from 1000 in steps of 3, as lines in metres; trips that end away from streets go."""
    drives = inputs.drives(spark, sf_dir)
    keys = "trip_id AS gpstripid, trip_id % 13 AS sampno, trip_id % 3 AS vehno"
    points = drives.selectExpr(*keys.split(", "), "1000 + 3 * ptid AS localid", "t", "x", "y")
    ends = trips.trip_ends(drives).selectExpr(*keys.split(", "), "end_x + if(trip_id % 4 = 0, 3000, 40) AS end_x", "end_y")
    traces = studies.household_traces(points, ends, inputs.streets(spark, sf_dir))
    degrees = points.withColumns({"longitude": F.expr("-122.4D + (x - 20000 * (gpstripid div 10)) / 1e5D"),
                                  "latitude": F.expr("37.7D + (y - 20000 * (gpstripid div 10)) / 1e5D")}).drop("x", "y")
    traces, lines = studies.household_lines(degrees, traces, "sf", Params(part_rows=50))
    sizes = lines.groupBy("trip_id").agg(F.max("ptid").alias("last"), F.min("t").alias("t0"), F.max("t").alias("t1"), F.sum(F.col("ptid") * F.col("t")).alias("in_order"))
    out = traces.join(sizes, "trip_id").join(trips.line_lengths(lines, Params(part_rows=20)), "trip_id")
    return rounded(out.drop("trip_id"), 2)


_HX, _HY = lambert_sql("lon", "lat", "sf")
HOUSEHOLD_LINES = f"""WITH {inputs.DRIVES},
d AS (SELECT *, -122.4::DOUBLE + (x - 20000 * (trip_id // 10)) / 1e5::DOUBLE AS lon, 37.7::DOUBLE + (y - 20000 * (trip_id // 10)) / 1e5::DOUBLE AS lat
      FROM drives WHERE trip_id % 4 <> 0),
m AS (SELECT trip_id, ptid, t, {_HX} AS x, {_HY} AS y FROM d),
s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM m WINDOW w AS (PARTITION BY trip_id ORDER BY ptid))
SELECT trip_id AS gpstripid, trip_id % 13 AS sampno, trip_id % 3 AS vehno, max(t) AS endtime, count(*) AS n_points, round(arg_min(x, ptid), 2) AS start_x,
       round(arg_min(y, ptid), 2) AS start_y, round(arg_max(x, ptid), 2) AS end_x, round(arg_max(y, ptid), 2) AS end_y, max(ptid) AS last, min(t) AS t0,
       max(t) AS t1, sum(ptid * t)::BIGINT AS in_order, round(coalesce(sum(step), 0), 2) AS length FROM s GROUP BY trip_id"""


#: Every third point of a drive, aside of it; each tenth of these lies far back.
_ROUGH = "(ptid + 2) {div} 3 AS ptid, x + 7 * cos(ptid) - CASE WHEN (ptid + 2) {div} 3 % 10 = 0 THEN 150 ELSE 0 END AS x, y + 25 AS y"


def frechet_distance(spark, sf_dir):
    """Drives against rough copies of them, in blocks of 16 points."""
    drives = inputs.drives(spark, sf_dir).select("trip_id", "ptid", "x", "y")
    rough = drives.filter("ptid % 3 = 1").selectExpr("trip_id", *_ROUGH.format(div="div").split(", "))
    return rounded(frechet.frechet_distance(drives, rough, part_rows=16))


FRECHET_DISTANCE = f"""WITH RECURSIVE {inputs.DRIVES},
a AS (SELECT trip_id, list(x ORDER BY ptid) AS ax, list(y ORDER BY ptid) AS ay FROM drives GROUP BY 1),
r AS (SELECT trip_id, {_ROUGH.format(div='//')} FROM drives WHERE ptid % 3 = 1),
b AS (SELECT trip_id, list(x ORDER BY ptid) AS bx, list(y ORDER BY ptid) AS b_y FROM r GROUP BY 1),
p AS (SELECT *, len(ax) AS n, len(bx) AS m FROM a JOIN b USING (trip_id)),
-- diagonal s holds the entries (i, s - i) for every i, and those of the diagonal before
f AS (SELECT trip_id, 1 AS s, list_transform(range(n), lambda i: NULL::DOUBLE) AS now, list_transform(range(n), lambda i: NULL::DOUBLE) AS last FROM p
      UNION ALL
      SELECT p.trip_id, s + 1, list_transform(range(1, n + 1), lambda i: CASE WHEN s + 1 - i BETWEEN 1 AND m THEN
               greatest(sqrt(pow(ax[i] - bx[s + 1 - i], 2) + pow(ay[i] - b_y[s + 1 - i], 2)),
                        least(now[i], CASE WHEN i > 1 THEN now[i - 1] END, CASE WHEN i > 1 THEN last[i - 1] END)) END), now
      FROM f JOIN p USING (trip_id) WHERE s < n + m)
SELECT trip_id, round(now[n], 3) AS frechet FROM f JOIN p USING (trip_id) WHERE s = n + m"""


def wkt_lines(spark, sf_dir):
    """Lines to text and back, in parts of at most 20 points."""
    parts = trips.line_parts(inputs.drives(spark, sf_dir), Params(part_rows=20))
    text = parts.select("trip_id", "part", geo.line_to_wkt("line").alias("wkt"))
    back = text.select("trip_id", "part", geo.line_from_wkt("wkt").alias("line"))
    return rounded(back.select("trip_id", "part", geo.n_points("line").alias("n"), geo.line_length("line").alias("length"),
                               geo.end_point("line")["m"].alias("last_m")))


WKT_LINES = f"""WITH {inputs.DRIVES},
l AS (SELECT *, (ptid - 1) // 20 AS part, lag(x) OVER w AS px, lag(y) OVER w AS py FROM drives
      WINDOW w AS (PARTITION BY trip_id, (ptid - 1) // 20 ORDER BY ptid))
SELECT trip_id, part, count(*) AS n, round(coalesce(sum(sqrt(pow(x - px, 2) + pow(y - py, 2))), 0), 3) AS length, max(t) AS last_m
FROM l GROUP BY ALL"""

CASES = {
    "sensor_occupancy": (sensor_occupancy, SENSOR_OCCUPANCY),
    "meter_points": (meter_points, METER_POINTS),
    "street_block_ids": (street_block_ids, STREET_BLOCK_IDS),
    "large_lots": (large_lots, LARGE_LOTS),
    "streets_near_layer": (streets_near_layer, STREETS_NEAR_LAYER),
    "vendor_trip_filter": (vendor_trip_filter, VENDOR_TRIP_FILTER),
    "vendor_drop_counts": (vendor_drop_counts, VENDOR_DROP_COUNTS),
    "survey_traces": (survey_traces, SURVEY_TRACES),
    "video_traces": (video_traces, VIDEO_TRACES),
    "household_traces": (household_traces, HOUSEHOLD_TRACES),
    "wkt_lines": (wkt_lines, WKT_LINES),
    "meter_metres": (meter_metres, METER_METRES),
    "survey_lines": (survey_lines, SURVEY_LINES),
    "household_lines": (household_lines, HOUSEHOLD_LINES),
    "frechet_distance": (frechet_distance, FRECHET_DISTANCE),
}

"""Files in, and the whole chain."""
from pyspark.sql import functions as F

from cases import inputs, studies
from cases.inputs import rounded
from curbloop.operators import network, studies as study, trips
from curbloop.operators.layout import shuffled
from curbloop.operators.scratch import new_path
from curbloop.params import Params
from curbloop.plans import run
from curbloop.sources import readers


def ping_files(spark, sf_dir):
    """Pings written as vendor files (gz, 16 quoted columns, no header) and read back."""
    path = new_path(spark, "ping-files")
    blank = [F.lit("x, y").alias(c.split()[0]) for c in readers.PING_FILE.split(", ")[6:]]
    pings = inputs.pings(spark, sf_dir)
    (pings.select("device_id", F.lit("aaid").alias("id_type"), "latitude", "longitude", "h_acc", F.col("ts_ms").alias("timestamp"), *blank)
     .write.option("compression", "gzip").option("quoteAll", True).csv(path))
    back = readers.read_pings(spark, path)
    return rounded(back.groupBy("device_id", "id_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("gid").alias("n_gid"), F.sum("latitude").alias("lat"),
        F.sum("longitude").alias("lon"), F.sum("h_acc").alias("acc"), F.max("ts_ms").alias("last")))


PING_FILES = f"""WITH {inputs.PINGS}
SELECT device_id, 'aaid' AS id_type, count(*) AS n, count(*) AS n_gid, round(sum(latitude), 3) AS lat, round(sum(longitude), 3) AS lon,
       round(sum(h_acc), 3) AS acc, max(ts_ms) AS last FROM pings GROUP BY device_id"""


def run_all(spark, sf_dir):
    """Drives through every stage to the flags of each trip."""
    points = inputs.drives(spark, sf_dir)
    streets = inputs.streets(spark, sf_dir)
    layers = run.Layers(streets, network.turn_restrictions(inputs.vertices(spark, sf_dir), streets), inputs.lots(spark, sf_dir),
                        inputs.curbs(spark, sf_dir), inputs.block_groups(spark, sf_dir))
    out = run.classify_traces(trips.trip_ends(points), points, layers)
    return rounded(out.select("trip_id", "npings", "id_first", "id_walk", "id_park", "gpsdist", "matchdist", "netwkdist", "match_score",
                              "ids_repeat", "edge_id_end", "end_clazz", "bg", "near_lot_dist", "curb_dist", "dist_ratio", "frc_inbuffer",
                              "cruise", "high_cruise", "cruise_time", "use_trip"))


# Known tours, one per user, on two kinds of way: up a column of streets without a turn, or clockwise round a block of 120 m. A ping lies on the street
# every 60 m and 5 s, 30 or 90 m from a crossing, so every result has a closed form. No ban touches these ways.
_TOURS = """SELECT user_id AS trip_id, user_id {div} 10 AS c, user_id % 2 = 1 AS laps, CASE WHEN user_id % 2 = 1 THEN 12 + user_id % 4 ELSE 10 + user_id % 13 END AS k_last,
   CASE WHEN user_id % 2 = 1 THEN CASE user_id % 3 WHEN 0 THEN 2 WHEN 1 THEN 6 ELSE 11 END
        ELSE CASE user_id % 8 WHEN 0 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 4 ELSE 7 END END AS i,
   CASE WHEN user_id % 2 = 1 THEN 6 ELSE 3 END AS j FROM (SELECT DISTINCT user_id FROM {events}) u"""


def tour_points(spark, sf_dir):
    tours = spark.sql(_TOURS.format(div="div", events="{e}"), e=inputs.table(spark, sf_dir, "events"))
    at = tours.selectExpr("*", "explode(sequence(0L, k_last)) AS k").selectExpr("*", "30 + 60 * k AS p").selectExpr(
        "*", "if(laps, (p div 120) % 4, 0) AS side", "if(laps, p % 120, p) AS off")
    return at.selectExpr(
        "trip_id", "k + 1 AS ptid", "1704103200 + trip_id * 60 + 5 * k AS t",
        f"{inputs.APART}D * c - 1200 + 120 * i + CASE side WHEN 0 THEN 0 WHEN 1 THEN off WHEN 2 THEN 120 ELSE 120 - off END AS x",
        f"{inputs.APART}D * c - 1200 + 120 * j + CASE side WHEN 0 THEN off WHEN 1 THEN 120 WHEN 2 THEN 120 - off ELSE 0 END AS y")


def run_known(spark, sf_dir):
    """Known tours through every stage: matched to streets, routed, classified and placed."""
    points, streets = tour_points(spark, sf_dir), inputs.streets(spark, sf_dir)
    layers = run.Layers(streets, network.turn_restrictions(inputs.vertices(spark, sf_dir), streets), None,
                        inputs.curbs(spark, sf_dir), inputs.block_groups(spark, sf_dir))
    out = run.classify_traces(trips.trip_ends(points), points, layers)
    return rounded(out.select("trip_id", "npings", "id_first", "id_walk", "id_park", "gpsdist", "matchdist", "netwkdist", "n_gaps", "ids_repeat", "edge_id_start",
                              "edge_id_end", "end_clazz", "bg", "curb_dist", "pingtime_max", "max_dist", "dist_ratio", "frc_inbuffer", "cruise", "high_cruise",
                              "cruise_time", "use_trip"))


RUN_KNOWN = f"""WITH tours AS ({_TOURS.format(div='//', events='events')}),
-- the driven part: all of a lap tour, the last 8 pings of a straight one
d AS (SELECT *, CASE WHEN laps THEN 0 ELSE k_last - 7 END AS k0, 30 + 60 * k_last AS p1 FROM tours),
e AS (SELECT *, 30 + 60 * k0 AS p0, 60 * (k_last - k0) AS metres, p1 // 120 AS s1, 60 * (k_last - k0) % 480 AS lap_rest FROM d),
m AS (SELECT *, CASE WHEN laps THEN least(lap_rest, 480 - lap_rest) ELSE metres END AS shortest,
             CASE WHEN laps THEN 120 * i + CASE s1 % 4 WHEN 0 THEN 0 WHEN 1 THEN p1 % 120 WHEN 2 THEN 120 ELSE 120 - p1 % 120 END ELSE 120 * i END AS ex,
             120 * j + CASE WHEN laps THEN CASE s1 % 4 WHEN 0 THEN p1 % 120 WHEN 1 THEN 120 WHEN 2 THEN 120 - p1 % 120 ELSE 0 END ELSE p1 END AS ey FROM e),
far AS (SELECT trip_id, max(sqrt(pow(px - ex, 2) + pow(py - ey, 2))) AS far FROM (
          SELECT trip_id, ex, ey, 120 * i + CASE p // 120 % 4 WHEN 0 THEN 0 WHEN 1 THEN p % 120 WHEN 2 THEN 120 ELSE 120 - p % 120 END AS px,
                 120 * j + CASE p // 120 % 4 WHEN 0 THEN p % 120 WHEN 1 THEN 120 WHEN 2 THEN 120 - p % 120 ELSE 0 END AS py
          FROM (SELECT *, 30 + 60 * unnest(range(0, k_last + 1)) AS p FROM m WHERE laps)) GROUP BY 1),
-- streets of laps 0, 1, .. s1; side s is driven as often as it comes up among them
visits AS (SELECT trip_id, sum(n) FILTER (n > 1) AS again FROM (
             SELECT trip_id, s % 4 AS side, count(*) AS n FROM (SELECT trip_id, unnest(range(0, s1 + 1)) AS s FROM m WHERE laps) GROUP BY 1, 2) GROUP BY 1)
SELECT trip_id, k_last + 1 AS npings, CASE WHEN laps THEN 1 ELSE k_last - 6 END AS id_first, k_last + 1 AS id_walk, k_last + 1 AS id_park,
       round(CASE WHEN laps THEN 60 * ((k_last + 1) // 2) + sqrt(1800) * (k_last // 2) ELSE metres END, 3) AS gpsdist, metres::DOUBLE AS matchdist,
       shortest::DOUBLE AS netwkdist, 0 AS n_gaps, coalesce(again, 0)::BIGINT AS ids_repeat,
       c * 840 + 420 + i * 20 + j + p0 // 120 + 1 AS edge_id_start,
       c * 840 + CASE WHEN NOT laps THEN 420 + i * 20 + j + s1 + 1 WHEN s1 % 4 = 0 THEN 420 + i * 20 + j + 1 WHEN s1 % 4 = 1 THEN i * 21 + j + 2
                      WHEN s1 % 4 = 2 THEN 420 + (i + 1) * 20 + j + 1 ELSE i * 21 + j + 1 END AS edge_id_end,
       41 AS end_clazz, 'bg' || lpad(c::VARCHAR, 6, '0') || '_' || (ex // 600) || (ey // 600) AS bg, 4::DOUBLE AS curb_dist, 5 AS pingtime_max,
       round(CASE WHEN laps THEN far ELSE 420 END, 3) AS max_dist, round(metres / shortest, 3) AS dist_ratio,
       CASE WHEN laps THEN 1 ELSE round(400 / 420, 3) END AS frc_inbuffer, laps AS cruise, laps AS high_cruise,
       round((metres - shortest) / 12, 3) AS cruise_time, true AS use_trip
FROM m LEFT JOIN far USING (trip_id) LEFT JOIN visits USING (trip_id)"""


def _file_of(rows, schema: str, path: str):
    """Rows as a CSV with the columns of a file schema; columns that the rows lack are 7 or 'x'."""
    columns = [c.split() for c in schema.split(", ")]
    own = set(rows.columns)
    out = rows.select(*[F.col(name).alias(name) if name in own else F.lit("x" if kind == "STRING" else 7).alias(name) for name, kind in columns])
    out.write.option("header", True).csv(path)


def sensor_files(spark, sf_dir):
    """Sensor readings written as CSV and read back."""
    path = new_path(spark, "sensor-files")
    _file_of(studies.sensor_rows(spark, sf_dir), readers.SENSOR_FILE, path)
    return readers.read_sensors(spark, path).groupBy("block_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("tot_time").alias("secs"), F.sum("tot_occupied_time").alias("taken"), F.count("ratetext").alias("rated"),
        F.max("start_time_dt").alias("last"), F.sum("time_of_day").alias("sevens"))


SENSOR_FILES = """SELECT (l_partkey % 20000)::VARCHAR AS block_id, count(*) AS n, sum(3600 * (l_suppkey % 30) + 1800)::BIGINT AS secs,
   sum(l_quantity)::BIGINT AS taken, count(*) FILTER (l_linenumber <> 3) AS rated,
   max(strftime(l_shipdate, '%d-') || upper(strftime(l_shipdate, '%b-%y')) || ' ' || lpad((1 + l_orderkey % 12)::VARCHAR, 2, '0') || '.30.00.000000 '
       || CASE WHEN l_linenumber % 2 = 0 THEN 'AM' ELSE 'PM' END) AS last, 7 * count(*) AS sevens
FROM lineitem GROUP BY 1"""


def meter_files(spark, sf_dir):
    """Meters written as CSV and read back, with their points."""
    path = new_path(spark, "meter-files")
    rows = inputs.table(spark, sf_dir, "events").selectExpr(
        "concat(lpad(cast(event_id % 1000 AS string), 3, '0'), '-', lpad(cast(event_id % 97 AS string), 5, '0')) AS post_id", "cast(event_id AS int) AS ms_spaceid",
        "concat('(', cast(37 + event_id % 1000 / 1000D AS string), ', ', cast(-122 - event_id % 777 / 1000D AS string), ')') AS location")
    _file_of(rows, readers.METER_FILE, path)
    points = study.meter_points(readers.read_meters(spark, path))
    return rounded(points.select(F.col("ms_spaceid").alias("id"), "blockid", "street_num", "longitude", "latitude"), 6)


METER_FILES = """SELECT event_id::INT AS id, lpad((event_id % 1000)::VARCHAR, 3, '0') || lpad((event_id % 97)::VARCHAR, 5, '0')[1:2] AS blockid, 7 AS street_num,
   round(-122 - event_id % 777 / 1000::DOUBLE, 6) AS longitude, round(37 + event_id % 1000 / 1000::DOUBLE, 6) AS latitude FROM events"""


def appended_traces(spark, sf_dir):
    """Three batches of traces in one table; ids go on and every batch is in order. One batch comes twice and one failed before its commit:
    neither leaves rows or ids."""
    path = new_path(spark, "appended")
    users = inputs.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("device_id")).agg(F.min("ts").alias("trip_start"))
    for batch in (0, 1, 1, 2):
        rows = users.filter(F.col("device_id") % 3 == batch)
        if batch == 2:
            trips.number_traces(rows).write.parquet(f"{path}/data/failed")
        table = readers.append_traces(rows, path, trips.number_traces, str(batch))
    return table.groupBy((F.col("device_id") % 3).alias("batch")).agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("trip_id").alias("n_ids"), F.min("trip_id").alias("lowest"), F.max("trip_id").alias("highest"))


APPENDED_TRACES = """WITH b AS (SELECT user_id % 3 AS batch, count(DISTINCT user_id) AS n FROM events GROUP BY 1)
SELECT batch, n, n AS n_ids, (1 + sum(n) OVER w - n)::BIGINT AS lowest, (sum(n) OVER w)::BIGINT AS highest FROM b WINDOW w AS (ORDER BY batch)"""

def layer_files(spark, sf_dir):
    """Streets written as CSV with binary lines and read back with their types."""
    path = new_path(spark, "layer-files")
    readers.export_csv(inputs.streets(spark, sf_dir), path)
    back = readers.read_layer(spark, path, "streets")
    return rounded(back.selectExpr("id", "osm_id", "source", "target", "cost", "reverse_cost", "km", "kmh", "clazz", "size(geom_way) AS n", "geom_way[0].x AS x1",
                                   "geom_way[0].y AS y1", "geom_way[1].x AS x2", "geom_way[1].y AS y2"), 6)


LAYER_FILES = f"""WITH {inputs.GRID}
SELECT id, id + 7000000 AS osm_id, source, target, round(cost, 6) AS cost, round(reverse_cost, 6) AS reverse_cost, km, kmh::DOUBLE AS kmh, clazz, 2 AS n,
       x1::DOUBLE AS x1, y1::DOUBLE AS y1, x2::DOUBLE AS x2, y2::DOUBLE AS y2 FROM grid"""


def trace_files(spark, sf_dir):
    """Vendor traces as CSV, lines with measures and ends as text, read back into traces and points. A line of more than ``part_rows`` points is
    written in several rows."""
    path = new_path(spark, "trace-files")
    parts = trips.line_parts(inputs.drives(spark, sf_dir), Params())
    ends = trips.trip_ends(inputs.drives(spark, sf_dir)).selectExpr("trip_id", "named_struct('x', end_x, 'y', end_y) AS end_geom", "trip_id % 3 = 0 AS start_good")
    readers.export_csv(parts.selectExpr("trip_id", "part AS line_part", "line AS lines_geom").join(shuffled(ends), "trip_id"), path)
    traces, points = run.vendor_traces(readers.read_layer(spark, path, "traces"))
    sizes = points.groupBy("trip_id").agg(F.count(F.lit(1)).alias("n"), F.min("t").alias("t0"), F.max("t").alias("t1"))
    return rounded(traces.join(sizes, "trip_id").join(trips.line_lengths(points), "trip_id"))


TRACE_FILES = f"""WITH {inputs.DRIVES},
s AS (SELECT *, sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS step FROM drives WINDOW w AS (PARTITION BY trip_id ORDER BY ptid))
SELECT trip_id, trip_id % 3 = 0 AS start_good, round(arg_min(x, ptid), 3) AS start_x, round(arg_min(y, ptid), 3) AS start_y, round(arg_max(x, ptid), 3) AS end_x,
       round(arg_max(y, ptid), 3) AS end_y, count(*) AS n, min(t) AS t0, max(t) AS t1, round(coalesce(sum(step), 0), 3) AS length FROM s GROUP BY trip_id"""

CASES = {"layer_files": (layer_files, LAYER_FILES), "trace_files": (trace_files, TRACE_FILES), "ping_files": (ping_files, PING_FILES), "sensor_files": (sensor_files, SENSOR_FILES), "meter_files": (meter_files, METER_FILES),
         "appended_traces": (appended_traces, APPENDED_TRACES), "run_all": (run_all, None), "run_known": (run_known, RUN_KNOWN)}

"""Pings -> trips."""
from pyspark.sql import functions as F

from cases import inputs
from cases.inputs import rounded
from curbloop.operators import trips
from curbloop.params import Params

# the fixture pings every few minutes
PARAMS = Params(avg_ping_max=240)


def located(spark, sf_dir):
    return trips.locate_pings(inputs.pings(spark, sf_dir), "wa")


def project_pings(spark, sf_dir):
    return rounded(located(spark, sf_dir).select("gid", "device_id", "ts_ms", "t", "x", "y"))


PROJECT_PINGS = f"""WITH {inputs.POINTS}
SELECT gid, device_id, ts_ms, t, round(x, 3) AS x, round(y, 3) AS y FROM points"""


def trip_points(spark, sf_dir):
    df = trips.segment_trips(located(spark, sf_dir), PARAMS)
    return rounded(df.select("gid", "device_id", "trip_start", "trip_seq", "ptid", "t", "point_count", "dt", "d", "start",
                             "speed", "point_count2", "dt2", "d2"))


_DIST = "sqrt(pow(x - {p}x, 2) + pow(y - {p}y, 2))"
TRIP_POINTS_CTE = inputs.POINTS + f""",
w1 AS (SELECT *, count(*) OVER (PARTITION BY device_id) AS point_count,
              lag(t) OVER d AS lt, lag(x) OVER d AS lx, lag(y) OVER d AS ly
       FROM points WINDOW d AS (PARTITION BY device_id ORDER BY t, ts_ms, gid)),
w2 AS (SELECT *, abs(t - lt) AS dt, {_DIST.format(p='l')} AS d FROM w1),
w3 AS (SELECT *, (lt IS NULL AND point_count > 1) OR coalesce(dt > 600, false) AS start,
              CASE WHEN dt > 0 THEN (d / 1000) / (dt / 3600.0::DOUBLE) ELSE 0 END AS speed FROM w2),
w4 AS (SELECT * FROM w3 WHERE point_count > 2 AND (d IS NULL OR d <> 0) AND speed < 130),
w5 AS (SELECT *, sum(start::INT) OVER (ORDER BY device_id, t) AS tmp_trip FROM w4),
w6 AS (SELECT *, count(*) OVER (PARTITION BY tmp_trip) AS point_count2 FROM w5),
w7 AS (SELECT *, sum(start::INT) OVER (ORDER BY device_id, t) AS trip FROM w6 WHERE point_count2 > 10),
w8 AS (SELECT *, min(t) OVER (PARTITION BY trip) AS trip_start,
              row_number() OVER (PARTITION BY trip ORDER BY ts_ms, gid) AS ptid,
              lag(t) OVER d AS l2t, lag(x) OVER d AS l2x, lag(y) OVER d AS l2y
       FROM w7 WINDOW d AS (PARTITION BY device_id ORDER BY t, ts_ms, gid)),
trip_points AS (SELECT *, abs(t - l2t) AS dt2, {_DIST.format(p='l2')} AS d2,
                       dense_rank() OVER (PARTITION BY device_id ORDER BY trip) AS trip_seq FROM w8)"""

TRIP_POINTS = f"""WITH {TRIP_POINTS_CTE}
SELECT gid, device_id, trip_start, trip_seq, ptid, t, point_count, dt, round(d, 3) AS d, start,
       round(speed, 3) AS speed, point_count2, dt2, round(d2, 3) AS d2 FROM trip_points"""


def traces(spark, sf_dir):
    return trips.usable_traces(trips.build_traces(trips.segment_trips(located(spark, sf_dir), PARAMS)), PARAMS)


def trip_traces(spark, sf_dir):
    return rounded(traces(spark, sf_dir))


TRACES_CTE = TRIP_POINTS_CTE + """,
stats AS (SELECT trip, sum(dt) / nullif(count(dt) - 1, 0) AS avg_pingtime, avg(point_count2) AS ping_count,
                 sum(d) AS trip_distance, CASE WHEN sum(dt2) > 0 THEN sum(d2) / sum(dt2) END AS avg_speed
          FROM trip_points WHERE NOT start GROUP BY trip),
ends AS (SELECT trip, any_value(device_id) AS device_id, any_value(trip_start) AS trip_start,
                any_value(trip_seq) AS trip_seq, count(*) AS n_points,
                arg_min(x, ptid) AS start_x, arg_min(y, ptid) AS start_y, arg_min(t, ptid) AS start_t,
                arg_max(x, ptid) AS end_x, arg_max(y, ptid) AS end_y, arg_max(t, ptid) AS end_t
         FROM trip_points GROUP BY trip),
traces AS (SELECT *, avg_pingtime * ping_count AS trip_duration,
                  sqrt(pow(end_x - start_x, 2) + pow(end_y - start_y, 2)) AS trip_od_distance
           FROM ends JOIN stats USING (trip)),
usable AS (SELECT * FROM traces
           WHERE avg_pingtime <= 240 AND trip_duration >= 300 AND trip_od_distance > 400 AND n_points >= 2)"""

TRIP_TRACES = f"""WITH {TRACES_CTE}
SELECT device_id, trip_start, trip_seq, n_points, round(start_x, 3) AS start_x, round(start_y, 3) AS start_y, start_t,
       round(end_x, 3) AS end_x, round(end_y, 3) AS end_y, end_t, round(avg_pingtime, 3) AS avg_pingtime,
       round(ping_count, 3) AS ping_count, round(trip_distance, 3) AS trip_distance,
       round(trip_duration, 3) AS trip_duration, round(avg_speed, 3) AS avg_speed,
       round(trip_od_distance, 3) AS trip_od_distance
FROM usable"""


def unique_trip_ids(spark, sf_dir):
    """Every number from 1 up once."""
    numbered = trips.number_traces(traces(spark, sf_dir))
    return numbered.agg(F.count("trip_id").alias("n"), F.count_distinct("trip_id").alias("n_distinct"),
                        F.min("trip_id").alias("lowest"), F.max("trip_id").alias("highest"))


UNIQUE_TRIP_IDS = f"""WITH {TRACES_CTE}
SELECT count(*) AS n, count(*) AS n_distinct, 1::BIGINT AS lowest, count(*) AS highest FROM usable"""


def trace_lines(spark, sf_dir):
    """Lines in parts of at most 8 points, measured as arrays."""
    params = Params(avg_ping_max=240, part_rows=8)
    points = trips.segment_trips(located(spark, sf_dir), params)
    numbered = trips.number_traces(trips.usable_traces(trips.build_traces(points), params))
    parts = trips.line_parts(trips.trace_points(points, numbered, params), params)
    from curbloop.functions import geo
    return rounded(parts.join(numbered.select("trip_id", "device_id", "trip_start"), "trip_id").select(
        "device_id", "trip_start", "part", geo.n_points("line").alias("n_points"),
        geo.line_length("line").alias("length"), geo.start_point("line")["m"].alias("first_m"),
        geo.end_point("line")["m"].alias("last_m")))


TRACE_LINES = f"""WITH {TRACES_CTE},
line AS (SELECT p.device_id, p.trip_start, (p.ptid - 1) // 8 AS part, p.ptid, p.t, p.x, p.y,
                lag(x) OVER w AS px, lag(y) OVER w AS py
         FROM trip_points p SEMI JOIN usable u ON p.trip = u.trip
         WINDOW w AS (PARTITION BY p.trip, (p.ptid - 1) // 8 ORDER BY p.ptid))
SELECT device_id, trip_start, part, count(*) AS n_points,
       round(coalesce(sum({_DIST.format(p='p')}), 0), 3) AS length, min(t) AS first_m, max(t) AS last_m
FROM line GROUP BY ALL"""

CASES = {
    "project_pings": (project_pings, PROJECT_PINGS),
    "trip_points": (trip_points, TRIP_POINTS),
    "trip_traces": (trip_traces, TRIP_TRACES),
    "unique_trip_ids": (unique_trip_ids, UNIQUE_TRIP_IDS),
    "trace_lines": (trace_lines, TRACE_LINES),
}

"""Trips -> final approach."""
from pyspark.sql import functions as F

from cases import inputs
from cases.inputs import rounded, seg_dist_sql
from curbloop.functions import geo
from curbloop.operators import approach, classify, cleaning, context, trips
from curbloop.operators.layout import with_lags
from curbloop.params import Params

PARAMS = Params()


def lines(spark, sf_dir):
    points = inputs.drives(spark, sf_dir)
    return points, trips.trip_ends(points)


def approach_points(spark, sf_dir):
    points, ends = lines(spark, sf_dir)
    return rounded(approach.approach_points(points, ends).drop("in_lot", "hour"), 6)


POINTS_CTE = inputs.DRIVES + """,
ends AS (SELECT trip_id, arg_max(x, ptid) AS end_x, arg_max(y, ptid) AS end_y, arg_min(x, ptid) AS start_x,
                arg_min(y, ptid) AS start_y, min(t) AS t0, max(ptid) AS n_points FROM drives GROUP BY trip_id),
lagged AS (SELECT trip_id, ptid, t, x, y, t0, n_points, sqrt(pow(x - end_x, 2) + pow(y - end_y, 2)) AS disttoend,
                  sqrt(pow(x - lag(x) OVER w, 2) + pow(y - lag(y) OVER w, 2)) AS d1,
                  sqrt(pow(x - lag(x, 2) OVER w, 2) + pow(y - lag(y, 2) OVER w, 2)) AS d2,
                  t - lag(t) OVER w AS timedelta, t - lag(t, 2) OVER w AS timedelta2
           FROM drives JOIN ends USING (trip_id) WINDOW w AS (PARTITION BY trip_id ORDER BY ptid)),
smooth AS (SELECT *, CASE WHEN timedelta = 1 AND timedelta2 = 2 THEN d2 ELSE d1 END AS distdelta FROM lagged WHERE n_points > 1),
steps AS (SELECT trip_id, ptid, t, x, y, disttoend, timedelta, distdelta,
                 CASE WHEN NOT (timedelta IS NOT NULL AND sum(timedelta) OVER c < 30)
                      THEN sum(distdelta) OVER r / 1000 / sum(timedelta) OVER r * 3600 END AS rollspeed,
                 distdelta / timedelta / 1000 * 3600 AS speed
          FROM smooth WINDOW c AS (PARTITION BY trip_id ORDER BY ptid),
                             r AS (PARTITION BY trip_id ORDER BY t RANGE BETWEEN 29 PRECEDING AND CURRENT ROW))"""

APPROACH_POINTS = f"""WITH {POINTS_CTE}
SELECT trip_id, ptid, t, round(disttoend, 6) AS disttoend, timedelta::BIGINT AS timedelta, round(distdelta, 6) AS distdelta,
       round(rollspeed, 6) AS rollspeed, round(speed, 6) AS speed FROM steps"""


def lot_zone(spark, sf_dir):
    points, _ = lines(spark, sf_dir)
    return approach.lot_zone(points, inputs.streets(spark, sf_dir), inputs.lots(spark, sf_dir)).select("trip_id", "ptid", "in_lot")


LOT_ZONE_CTE = f"""{inputs.GRID}, {inputs.LOTS},
box AS (SELECT min(x) AS lx, min(y) AS ly, max(x) AS hx, max(y) AS hy FROM drives),
clip AS (SELECT g.* FROM grid g, box WHERE least(x1, x2) >= lx AND greatest(x1, x2) <= hx
                                       AND least(y1, y2) >= ly AND greatest(y1, y2) <= hy),
near_streets AS (SELECT trip_id, ptid, bool_or(clazz = 51 AND gap <= 10) AS lot, bool_or(clazz <> 51 AND gap < 5) AS street
                 FROM (SELECT trip_id, ptid, clazz, {seg_dist_sql('x', 'y')} AS gap
                       FROM drives JOIN clip ON c = trip_id // 10) GROUP BY ALL),
near_lots AS (SELECT DISTINCT trip_id, ptid FROM drives JOIN lots ON c = trip_id // 10
              WHERE pow(greatest(abs(x - cx) - h, 0), 2) + pow(greatest(abs(y - cy) - h, 0), 2) <= 100),
zone AS (SELECT trip_id, ptid, CASE WHEN (EXISTS (FROM clip WHERE clazz = 51) OR EXISTS (FROM lots))
                                         AND EXISTS (FROM clip WHERE clazz <> 51)
                                    THEN (coalesce(s.lot, false) OR l.ptid IS NOT NULL) AND NOT coalesce(s.street, false) END AS in_lot
         FROM drives LEFT JOIN near_streets s USING (trip_id, ptid) LEFT JOIN near_lots l USING (trip_id, ptid))"""

LOT_ZONE = f"WITH {inputs.DRIVES}, {LOT_ZONE_CTE} SELECT trip_id, ptid, in_lot FROM zone"


def _metrics(spark, sf_dir):
    points, ends = lines(spark, sf_dir)
    zoned = approach.lot_zone(points, inputs.streets(spark, sf_dir), inputs.lots(spark, sf_dir))
    return points, ends, approach.truncate_traces(zoned, ends)


def approach_metrics(spark, sf_dir):
    return rounded(_metrics(spark, sf_dir)[2], 4)


METRICS_CTE = POINTS_CTE + ", " + LOT_ZONE_CTE + """,
walks AS (SELECT trip_id, greatest(1, coalesce(min(ptid) FILTER (disttoend <= 400) - 1, 1)) AS id_first,
                 greatest(1, coalesce(min(ptid) FILTER (disttoend <= 800) - 1, 1)) AS id_firstx2,
                 coalesce(max(ptid) FILTER (rollspeed > 6), 1) AS id_walk FROM steps GROUP BY trip_id),
runs AS (SELECT trip_id, ptid, bool_and(coalesce(in_lot, false)) OVER (PARTITION BY trip_id ORDER BY ptid DESC) AS run
         FROM steps JOIN zone USING (trip_id, ptid) JOIN walks USING (trip_id) WHERE ptid <= id_walk),
cuts AS (SELECT w.*, coalesce(p, id_walk) AS id_park FROM walks w
         LEFT JOIN (SELECT trip_id, min(ptid) AS p FROM runs WHERE run GROUP BY trip_id) USING (trip_id)),
masks AS (SELECT s.*, id_first, id_firstx2, id_walk, id_park, ptid > id_first AND ptid <= id_walk AS buf,
                 ptid > id_firstx2 AND ptid <= id_first + 1 AS donut, ptid > id_walk AS walk,
                 ptid > id_park AND ptid <= id_walk AS park FROM steps s JOIN cuts USING (trip_id)),
metrics AS (SELECT trip_id, id_first, id_firstx2, id_walk, id_park, count(*) AS npings,
   max(speed) FILTER (buf) AS maxspeed, avg(speed) FILTER (buf) AS speed, avg(speed) FILTER (donut) AS donutspeed,
   avg(speed) FILTER (walk) AS walkspeed, avg(timedelta) AS pingtime_meanall, max(timedelta) AS pingtime_maxall,
   avg(timedelta) FILTER (buf) AS pingtime_meanbuf, max(timedelta) FILTER (buf) AS pingtime_maxbuf,
   count(*) FILTER (buf) AS npingsbuf, count(*) FILTER (donut) AS npingsdonut, count(*) FILTER (walk) AS npingswalk,
   avg(timedelta) FILTER (walk) AS pingtime_meanwalk, max(timedelta) FILTER (walk) AS pt_maxwalk,
   count(*) FILTER (park) AS npingspark FROM masks GROUP BY ALL)"""

APPROACH_METRICS = f"""WITH {METRICS_CTE}
SELECT trip_id, id_first, id_firstx2, id_walk, npings, id_park, round(maxspeed, 4) AS maxspeed, round(speed, 4) AS speed,
       round(donutspeed, 4) AS donutspeed, round(walkspeed, 4) AS walkspeed, round(pingtime_meanall, 4) AS pingtime_meanall,
       pingtime_maxall::BIGINT AS pingtime_maxall, round(pingtime_meanbuf, 4) AS pingtime_meanbuf,
       pingtime_maxbuf::BIGINT AS pingtime_maxbuf, npingsbuf, npingsdonut, npingswalk,
       round(pingtime_meanwalk, 4) AS pingtime_meanwalk, pt_maxwalk::BIGINT AS pt_maxwalk, npingspark FROM metrics"""


def approach_slices(spark, sf_dir):
    points, ends, metrics = _metrics(spark, sf_dir)
    return rounded(approach.slice_summary(approach.slice_points(points, ends, metrics)))


SLICES_CTE = METRICS_CTE + """,
raw AS (SELECT l.*, id_first, id_walk, id_park, ptid BETWEEN id_first AND id_park AS b, ptid BETWEEN id_park AND id_walk AS o,
               ptid >= id_walk AS w, ptid >= id_first AS a FROM lagged l JOIN cuts USING (trip_id)),
slices AS (SELECT trip_id, count(*) FILTER (b) AS n_lbuff, count(*) FILTER (o) AS n_lot, count(*) FILTER (w) AS n_walk,
   count(*) FILTER (a) AS n_all,
   max(x) FILTER (ptid = id_first) AS startpt_x, max(y) FILTER (ptid = id_first) AS startpt_y, max(t) FILTER (ptid = id_first) AS startpt_t,
   max(x) FILTER (ptid = id_park) AS enterlot_x, max(y) FILTER (ptid = id_park) AS enterlot_y, max(t) FILTER (ptid = id_park) AS enterlot_t,
   max(x) FILTER (ptid = id_walk) AS park_x, max(y) FILTER (ptid = id_walk) AS park_y,
   coalesce(sum(d1) FILTER (b AND ptid > id_first), 0) AS gpsdist, coalesce(sum(d1) FILTER (o AND ptid > id_park), 0) AS parkdist,
   coalesce(sum(d1) FILTER (w AND ptid > id_walk), 0) AS walkdist, coalesce(sum(d1) FILTER (a AND ptid > id_first), 0) AS alldist,
   max(timedelta) FILTER (b AND ptid > id_first) AS pingtime_max, avg(timedelta) FILTER (b AND ptid > id_first) AS pingtime_mean,
   max(disttoend) FILTER (b) AS max_dist
   FROM raw GROUP BY trip_id HAVING n_lbuff > 0 AND n_lot > 0 AND n_walk > 0 AND n_all > 0)"""
_R = ["startpt_x", "startpt_y", "enterlot_x", "enterlot_y", "park_x", "park_y", "gpsdist", "parkdist", "walkdist", "alldist",
      "pingtime_mean", "max_dist"]
APPROACH_SLICES = f"""WITH {SLICES_CTE}
SELECT trip_id, n_lbuff, n_lot, n_walk, n_all, startpt_t, enterlot_t, pingtime_max::BIGINT AS pingtime_max,
       {', '.join(f'round({c}, 3) AS {c}' for c in _R)} FROM slices"""


_SPIKE = "(ptid % 41 IN (9, 20, 21, 30, 31, 32) OR (trip_id % 3 = 0 AND ptid % 97 BETWEEN 60 AND 75))"


def clean_traces(spark, sf_dir):
    """Drives with spikes of one, two and three points and, on every third trip, a run of sixteen; these and the good first points go."""
    far = F.when(F.expr(_SPIKE), F.expr("50000D + 20000D * (ptid % 2)")).otherwise(0.0)
    points = inputs.drives(spark, sf_dir).withColumn("x", F.col("x") + far)
    ends = trips.trip_ends(points).withColumn("start_good", F.col("trip_id") % 2 == 0)
    return rounded(cleaning.clean_traces(points, ends, Params(part_rows=25)))


CLEAN_TRACES = f"""WITH {inputs.DRIVES},
kept AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY trip_id) AS n FROM drives)
         WHERE NOT {_SPIKE} AND NOT (ptid = 1 AND trip_id % 2 = 0 AND n > 2))
SELECT trip_id, row_number() OVER (PARTITION BY trip_id ORDER BY ptid) AS ptid, t, round(x, 3) AS x, round(y, 3) AS y FROM kept"""


def length_in_buffer(spark, sf_dir):
    """Metres of every whole line inside the disc around its end."""
    points, ends = lines(spark, sf_dir)
    segments = with_lags(points, ["x", "y"], 1, PARAMS.part_rows).filter("prev1 is not null").select(
        "trip_id", F.col("prev1.x").alias("x1"), F.col("prev1.y").alias("y1"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return rounded(classify.length_in_buffer(segments, ends))


LENGTH_IN_BUFFER = f"""WITH {POINTS_CTE},
seg AS (SELECT trip_id, lag(x) OVER w AS x1, lag(y) OVER w AS y1, x AS x2, y AS y2 FROM drives
        WINDOW w AS (PARTITION BY trip_id ORDER BY ptid)),
q AS (SELECT trip_id, pow(x2 - x1, 2) + pow(y2 - y1, 2) AS a, (x1 - end_x) * (x2 - x1) + (y1 - end_y) * (y2 - y1) AS b,
             pow(x1 - end_x, 2) + pow(y1 - end_y, 2) - 160000 AS c FROM seg JOIN ends USING (trip_id) WHERE x1 IS NOT NULL)
SELECT trip_id, round(sum(CASE WHEN b * b > a * c THEN sqrt(a) * greatest(0, least(1, (-b + sqrt(b * b - a * c)) / a)
                                    - greatest(0, (-b - sqrt(b * b - a * c)) / a)) ELSE 0 END), 3) AS inbuffer_length
FROM q GROUP BY trip_id"""


def _parked(spark, sf_dir):
    """Trips with a parking point every few metres around the district and a last street."""
    _, ends = lines(spark, sf_dir)
    k = F.col("trip_id") % 10
    return ends.select(
        "trip_id", "end_x", "end_y", (F.col("end_x") + k * 37 - 150).alias("park_x"), (F.col("end_y") + k * 23 - 90).alias("park_y"),
        (F.expr("trip_id div 10") * 840 + 1 + (F.col("trip_id") * 53) % 840).alias("edge_id_end"))


_PARKED = """parked AS (SELECT trip_id, trip_id // 10 AS c, end_x, end_y, end_x + trip_id % 10 * 37 - 150 AS park_x,
   end_y + trip_id % 10 * 23 - 90 AS park_y, trip_id // 10 * 840 + 1 + (trip_id * 53) % 840 AS edge_id_end FROM ends)"""


def nearest_lot(spark, sf_dir):
    return rounded(context.nearest_lot(_parked(spark, sf_dir), inputs.lots(spark, sf_dir)))


NEAREST_LOT = f"""WITH {POINTS_CTE}, {inputs.GRID}, {inputs.LOTS}, {_PARKED}
SELECT trip_id, round(min(d), 3) AS near_lot_dist FROM (
  SELECT trip_id, sqrt(pow(greatest(abs(park_x - cx) - h, 0), 2) + pow(greatest(abs(park_y - cy) - h, 0), 2)) AS d
  FROM parked JOIN lots USING (c)) WHERE d <= 100 GROUP BY trip_id"""


def curb_distance(spark, sf_dir):
    return rounded(context.curb_distance(_parked(spark, sf_dir), inputs.curbs(spark, sf_dir), inputs.streets(spark, sf_dir)))


CURB_DISTANCE = f"""WITH {POINTS_CTE}, {inputs.GRID}, {inputs.CURBS}, {_PARKED},
near AS (SELECT p.*, u.x1 AS ux1, u.y1 AS uy1, u.x2 AS ux2, u.y2 AS uy2, curb_id, {seg_dist_sql('park_x', 'park_y', 'u.x1', 'u.y1', 'u.x2', 'u.y2')} AS d,
                {inputs.share_sql('park_x', 'park_y', 'u.x1', 'u.y1', 'u.x2', 'u.y2')} AS s FROM parked p JOIN curbs u USING (c)),
best AS (SELECT * FROM near WHERE d <= 200 QUALIFY row_number() OVER (PARTITION BY trip_id ORDER BY d, curb_id) = 1),
spot AS (SELECT b.*, ux1 + s * (ux2 - ux1) AS qx, uy1 + s * (uy2 - uy1) AS qy, g.x1, g.y1, g.x2, g.y2
         FROM best b JOIN grid g ON g.id = edge_id_end)
SELECT trip_id, round(CASE WHEN {seg_dist_sql('park_x', 'park_y')} < {seg_dist_sql('qx', 'qy')} THEN d ELSE -d END, 3) AS curb_dist
FROM spot"""


def end_block_group(spark, sf_dir):
    return context.end_block_group(_parked(spark, sf_dir).withColumns(
        {"end_x": F.col("park_x"), "end_y": F.col("park_y")}), inputs.block_groups(spark, sf_dir))


END_BLOCK_GROUP = f"""WITH {POINTS_CTE}, {inputs.GRID}, {inputs.BLOCK_GROUPS}, {_PARKED}
SELECT trip_id, min(bg) AS bg FROM parked JOIN bgs USING (c)
WHERE abs(park_x - cx) <= h AND abs(park_y - cy) <= h GROUP BY trip_id"""


def parking_context(spark, sf_dir):
    """All layers at once."""
    out = context.add_parking_context(_parked(spark, sf_dir), inputs.streets(spark, sf_dir), inputs.lots(spark, sf_dir),
                                      inputs.curbs(spark, sf_dir), inputs.block_groups(spark, sf_dir))
    return rounded(out.select("trip_id", "end_clazz", "bg", "near_lot_dist", "curb_dist"))


PARKING_CONTEXT = f"""WITH {POINTS_CTE}, {inputs.GRID}, {inputs.LOTS}, {inputs.CURBS}, {inputs.BLOCK_GROUPS}, {_PARKED},
lot AS ({NEAREST_LOT[NEAREST_LOT.index('SELECT trip_id, round(min(d)'):]}),
{CURB_DISTANCE[CURB_DISTANCE.index('near AS'):CURB_DISTANCE.index('SELECT trip_id, round(CASE')].rstrip()},
curb AS ({CURB_DISTANCE[CURB_DISTANCE.index('SELECT trip_id, round(CASE'):]}),
area AS (SELECT trip_id, min(bg) AS bg FROM parked JOIN bgs USING (c) WHERE abs(end_x - cx) <= h AND abs(end_y - cy) <= h GROUP BY trip_id)
SELECT trip_id, clazz AS end_clazz, bg, near_lot_dist, curb_dist FROM parked LEFT JOIN grid g ON g.id = edge_id_end
LEFT JOIN area USING (trip_id) LEFT JOIN lot USING (trip_id) LEFT JOIN curb USING (trip_id)"""

CASES = {
    "clean_traces": (clean_traces, CLEAN_TRACES),
    "approach_points": (approach_points, APPROACH_POINTS),
    "lot_zone": (lot_zone, LOT_ZONE),
    "approach_metrics": (approach_metrics, APPROACH_METRICS),
    "approach_slices": (approach_slices, APPROACH_SLICES),
    "length_in_buffer": (length_in_buffer, LENGTH_IN_BUFFER),
    "nearest_lot": (nearest_lot, NEAREST_LOT),
    "curb_distance": (curb_distance, CURB_DISTANCE),
    "end_block_group": (end_block_group, END_BLOCK_GROUP),
    "parking_context": (parking_context, PARKING_CONTEXT),
}

"""Flags, usability, shares, quality model."""
from pyspark.sql import functions as F

from cases import inputs
from cases.inputs import rounded
from curbloop.operators import classify, matching
from curbloop.params import Params

# one trip per order; nulls in every column, values on both sides of every threshold
_MATCHED = """
  SELECT o_orderkey AS trip_id, o_custkey % 25 AS area,
    CASE WHEN k % 11 <> 0 THEN 120{f} + k % 1013 + 0.25{f} END AS matchdist,
    CASE WHEN k % 13 = 0 THEN NULL WHEN k % 17 = 0 THEN 0{f} ELSE 110{f} + (k * 7) % 811 + 0.5{f} END AS netwkdist,
    CASE WHEN k % 19 <> 0 THEN CASE WHEN k % 5 = 0 THEN 2 + k % 3 ELSE 0 END END AS ids_repeat,
    CASE WHEN k % 23 <> 0 THEN 300{f} + (k * 3) % 1301 + 0.125{f} END AS max_dist,
    CASE WHEN k % 29 <> 0 THEN (120{f} + k % 1013) * ((k % 10 + 0.5{f}) / 10) END AS inbuffer_length,
    CASE WHEN k % 31 <> 0 THEN 0.8{f} + (k % 21) / 100{f} + 0.001{f} END AS match_score,
    CASE WHEN k % 37 <> 0 THEN 11 + 10 * (k % 5) END AS end_clazz,
    CASE WHEN k % 41 <> 0 THEN 5{f} + k % 31 + 0.5{f} END AS pingtime_mean,
    CASE WHEN k % 43 <> 0 THEN 10 + k % 71 END AS pingtime_max,
    CASE WHEN k % 47 <> 0 THEN 20 + k % 301 END AS drive_secs,
    CASE WHEN k % 53 <> 0 THEN day_secs + k * 61 % 86400 END AS enterlot_t,
    k % 2 = 0 AS start_good, 1{f} * (k % 100) AS start_x, 2{f} * (k % 50) AS start_y, 10{f} AS end_x, 20{f} AS end_y,
    CASE WHEN k % 59 <> 0 THEN 12{f} + k % 7 END AS park_x, 21{f} + k % 3 AS park_y
  FROM (SELECT o_orderkey, o_custkey, o_orderkey AS k, {secs} AS day_secs FROM {orders}) o"""


def matched(spark, sf_dir):
    sql = _MATCHED.format(f="D", secs="timestampdiff(SECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', o_orderdate)", orders="{o}")
    return spark.sql(sql, o=inputs.table(spark, sf_dir, "orders"))


MATCHED = "matched AS (" + _MATCHED.format(f="::DOUBLE", secs="epoch(o_orderdate)::BIGINT", orders="orders") + ")"


def end_time_fields(spark, sf_dir):
    out = classify.add_time_fields(matched(spark, sf_dir).select("trip_id", "enterlot_t"))
    return out.selectExpr("trip_id", "date_format(endtime, 'yyyy-MM-dd HH:mm:ss') AS endtime", "endhour", "endminute", "weekday")


TIMES = """times AS (SELECT trip_id, make_timestamp(enterlot_t * 1000000) AS e FROM matched),
timed AS (SELECT trip_id, strftime(e, '%Y-%m-%d %H:%M:%S') AS endtime, hour(e) AS endhour, minute(e) AS endminute,
                 coalesce(isodow(e) < 6 AND strftime(e, '%m-%d') NOT IN ('01-01', '12-25'), false) AS weekday FROM times)"""
END_TIME_FIELDS = f"WITH {MATCHED}, {TIMES} SELECT * FROM timed"


def classified(spark, sf_dir):
    return classify.flag_usable(classify.classify_cruise(classify.add_distances(matched(spark, sf_dir))))


def cruise_flags(spark, sf_dir):
    return rounded(classified(spark, sf_dir).select("trip_id", "walklength", "dist_ratio", "frc_inbuffer", "start_end_dist",
                                                   "cruise", "high_cruise", "cruise_time"), 4)


FLAGS = MATCHED + """,
dist AS (SELECT *, sqrt(pow(end_x - park_x, 2) + pow(end_y - park_y, 2)) AS walklength,
                CASE WHEN netwkdist > 0 THEN greatest(matchdist / netwkdist, 1) END AS dist_ratio,
                CASE WHEN matchdist > 0 THEN inbuffer_length / matchdist END AS frc_inbuffer,
                CASE WHEN start_good THEN sqrt(pow(end_x - start_x, 2) + pow(end_y - start_y, 2)) END AS start_end_dist FROM matched),
f1 AS (SELECT *, CASE WHEN (matchdist - netwkdist > 5 OR ids_repeat > 0) AND max_dist <= 1400 AND frc_inbuffer > 0.5 THEN true
                      WHEN dist_ratio IS NOT NULL THEN false END AS cruise FROM dist),
f2 AS (SELECT *, CASE WHEN matchdist - netwkdist > 200 AND cruise THEN true
                      WHEN dist_ratio IS NOT NULL THEN false END AS high_cruise FROM f1),
flags AS (SELECT *, CASE WHEN high_cruise THEN greatest((matchdist - netwkdist) / (matchdist / drive_secs), 0)
                         WHEN NOT high_cruise THEN 0 END AS cruise_time,
                 coalesce(match_score > 0.9 AND end_clazz <> 11 AND pingtime_mean <= 30 AND pingtime_max <= 60, false) AS use_trip FROM f2)"""
CRUISE_FLAGS = f"""WITH {FLAGS} SELECT trip_id, round(walklength, 4) AS walklength, round(dist_ratio, 4) AS dist_ratio,
  round(frc_inbuffer, 4) AS frc_inbuffer, round(start_end_dist, 4) AS start_end_dist, cruise, high_cruise,
  round(cruise_time, 4) AS cruise_time FROM flags"""


def usable_trips(spark, sf_dir):
    return classified(spark, sf_dir).select("trip_id", "use_trip")


USABLE_TRIPS = f"WITH {FLAGS} SELECT trip_id, use_trip FROM flags"


def cruise_share(spark, sf_dir):
    """By hour, weekday and area of the trip end."""
    timed = classify.add_time_fields(classified(spark, sf_dir))
    return rounded(classify.cruise_share(timed, "endhour", "weekday", "area"), 3)


CRUISE_SHARE = f"""WITH {FLAGS}, {TIMES}
SELECT endhour, weekday, area, count(*) AS trips, round(avg(cruise::INT), 3) AS cruise_share,
       round(avg(high_cruise::INT), 3) AS high_cruise_share, round(sum(cruise_time), 3) AS cruise_time
FROM flags JOIN timed USING (trip_id) WHERE use_trip GROUP BY ALL"""


def match_scores(spark, sf_dir):
    score = matching.match_score(F.col("max_dist") / 10, -F.col("netwkdist") / 50)
    return rounded(matched(spark, sf_dir).select("trip_id", score.alias("match_score")), 6)


MATCH_SCORES = f"""WITH {MATCHED} SELECT trip_id, round(1 / (1 + exp(-(4.5289042565::DOUBLE - 0.0446756552965::DOUBLE * (max_dist / 10)
  + 0.00200883204845::DOUBLE * (-netwkdist / 50)))), 6) AS match_score FROM matched"""


def fit_match_quality(spark, sf_dir):
    """A model fitted to labels over all orders. At its coefficients the mean residual, times 1 and times each feature, is zero."""
    rows = matched(spark, sf_dir).selectExpr("max_dist / 10 AS frechet_dist", "-netwkdist / 50 AS ll_topol_min", "trip_id")
    p = "1 / (1 + exp(-(4.5 - 0.045 * frechet_dist + 0.02 * ll_topol_min)))"
    labelled = rows.filter("frechet_dist is not null and ll_topol_min is not null").selectExpr(
        "frechet_dist", "ll_topol_min", f"pmod(trip_id * 7919, 1000) / 1000D < {p} AS good")
    fitted = {r["name"]: r["value"] for r in matching.fit_match_quality(labelled).collect()}  # three rows
    residual = matching.match_score(F.col("frechet_dist"), F.col("ll_topol_min"), fitted) - F.col("good").cast("double")
    names = {"(Intercept)": F.lit(1.0), "frechet_dist": F.col("frechet_dist"), "ll_topol_min": F.col("ll_topol_min")}
    sums = labelled.agg(F.count(F.lit(1)).alias("n"), *[F.avg(residual * x).alias(name) for name, x in names.items()])
    return rounded(sums.selectExpr("n", "stack(3, " + ", ".join(f"'{name}', `{name}`" for name in names) + ") AS (name, mean_residual)"), 3)


FIT_MATCH_QUALITY = f"""WITH {MATCHED}
SELECT count(*) AS n, unnest(['(Intercept)', 'frechet_dist', 'll_topol_min']) AS name, 0::DOUBLE AS mean_residual
FROM matched WHERE max_dist IS NOT NULL AND netwkdist IS NOT NULL"""

CASES = {
    "end_time_fields": (end_time_fields, END_TIME_FIELDS),
    "cruise_flags": (cruise_flags, CRUISE_FLAGS),
    "usable_trips": (usable_trips, USABLE_TRIPS),
    "cruise_share": (cruise_share, CRUISE_SHARE),
    "match_scores": (match_scores, MATCH_SCORES),
    "fit_match_quality": (fit_match_quality, FIT_MATCH_QUALITY),
}

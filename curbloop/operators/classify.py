"""Distances, cruising flags, usability and the share of cruising trips. One row per trip in, one row per trip out."""
from pyspark.sql import DataFrame, functions as F

from curbloop.functions import clock, geo
from curbloop.operators.layout import skew_join
from curbloop.params import Params


def length_in_buffer(segments: DataFrame, ends: DataFrame, params: Params = Params()) -> DataFrame:
    """Metres of a line (trip_id, x1 .. y2) inside the disc around the trip end."""
    inside = geo.chord_length("x1", "y1", "x2", "y2", "end_x", "end_y", params.buffer_radius)
    return (skew_join(segments, ends.select("trip_id", "end_x", "end_y"), ["trip_id"], ["x1", "y1", "x2", "y2"])
            .groupBy("trip_id").agg(F.sum(inside).alias("inbuffer_length")))


def add_time_fields(trips: DataFrame, params: Params = Params(), seconds="enterlot_t") -> DataFrame:
    """endtime, endhour, endminute, weekday of the last driven point, on the wall clock of a named zone."""
    wall = clock.local_wall_clock(F.col(seconds), params.time_zone)
    return (trips.withColumn("endtime", clock.utc_timestamp(F.col(seconds)))
            .withColumns({"endhour": F.hour(wall), "endminute": F.minute(wall),
                          "weekday": clock.is_workday(F.to_date(wall), params.fix_holidays)}))


def add_distances(trips: DataFrame) -> DataFrame:
    """walklength, dist_ratio, frc_inbuffer, start_end_dist from the ends, lengths and routed distance of trips."""
    matched, routed = F.col("matchdist"), F.col("netwkdist")
    ends_apart = geo.distance("start_x", "start_y", "end_x", "end_y")
    if "start_good" in trips.columns:
        ends_apart = F.when(F.col("start_good"), ends_apart)
    return trips.withColumns({
        "walklength": geo.distance("end_x", "end_y", "park_x", "park_y"),
        # greatest() skips nulls, so a missing matchdist gives 1
        "dist_ratio": F.when(routed > 0, F.greatest(matched / F.nullif(routed, F.lit(0.0)), F.lit(1.0))),
        "frc_inbuffer": F.when(matched > 0, F.col("inbuffer_length") / F.nullif(matched, F.lit(0.0))),
        "start_end_dist": ends_apart})


def classify_cruise(trips: DataFrame, params: Params = Params()) -> DataFrame:
    """cruise and high_cruise (true, false or unknown) and cruise_time in seconds."""
    excess = F.col("matchdist") - F.col("netwkdist")
    circled = (((excess > params.excess_min) | (F.col("ids_repeat") > 0))
               & (F.col("max_dist") <= params.max_dist) & (F.col("frc_inbuffer") > params.buffer_share))
    known = F.col("dist_ratio").isNotNull()
    took = F.nullif(F.col("matchdist") / F.nullif(F.col("drive_secs").cast("double"), F.lit(0.0)), F.lit(0.0))
    return (trips
            .withColumn("cruise", F.when(circled, True).when(known, False))
            .withColumn("high_cruise", F.when((excess > params.high_excess_min) & F.col("cruise"), True).when(known, False))
            .withColumn("cruise_time", F.when(F.col("high_cruise"), F.greatest(excess / took, F.lit(0.0)))
                        .when(~F.col("high_cruise"), F.lit(0.0))))


def flag_usable(trips: DataFrame, params: Params = Params()) -> DataFrame:
    good = ((F.col("match_score") > params.quality_cutoff) & (F.col("end_clazz") != params.freeway_class)
            & (F.col("pingtime_mean") <= params.ping_mean_max) & (F.col("pingtime_max") <= params.ping_max_max))
    return trips.withColumn("use_trip", F.coalesce(good, F.lit(False)))


def cruise_share(trips: DataFrame, *by) -> DataFrame:
    """Share of usable trips that cruise; trips of unknown status count in ``trips`` but not in the shares."""
    return (trips.filter("use_trip").groupBy(*by)
            .agg(F.count(F.lit(1)).alias("trips"), F.avg(F.col("cruise").cast("int")).alias("cruise_share"),
                 F.avg(F.col("high_cruise").cast("int")).alias("high_cruise_share"),
                 F.sum("cruise_time").alias("cruise_time")))

"""Parking context of trip ends: area, street class, nearest lot, distance from the curb. Every layer may be absent."""
from pyspark.sql import DataFrame, functions as F

from curbloop.functions import geo
from curbloop.operators.layout import shuffled, skew_join
from curbloop.operators.spatial import inside_polygons, near_segments, polygon_distances, street_segments
from curbloop.params import Params

TRIP = ["trip_id"]


def _at(trips, x, y):
    return trips.filter(F.col(x).isNotNull()).select("trip_id", F.col(x).alias("x"), F.col(y).alias("y"))


def end_block_group(trips: DataFrame, block_groups: DataFrame) -> DataFrame:
    """Area of the trip end; the lowest code where several meet."""
    return (inside_polygons(_at(trips, "end_x", "end_y"), block_groups, "bg", TRIP)
            .groupBy("trip_id").agg(F.min("bg").alias("bg")))


def nearest_lot(trips: DataFrame, lots: DataFrame, params: Params = Params()) -> DataFrame:
    """Distance from the parking point to the nearest lot within the search radius, 0 inside one."""
    found = polygon_distances(_at(trips, "park_x", "park_y"), lots, "lot_id", TRIP, params.lot_search)
    return found.groupBy("trip_id").agg(F.min("dist").alias("near_lot_dist"))


def curb_distance(trips: DataFrame, curbs: DataFrame, streets: DataFrame, params: Params = Params()) -> DataFrame:
    """Distance from the parking point to the nearest curb, positive where the point is nearer to the middle of
    the last driven street than the curb is."""
    segments = curbs.select("curb_id", "x1", "y1", "x2", "y2")
    closest = F.struct("dist", "curb_id", geo.between("x1", "x2", "share").alias("cx"), geo.between("y1", "y2", "share").alias("cy"))
    spots = _at(trips.filter("edge_id_end is not null"), "park_x", "park_y")
    curb = (near_segments(spots, segments, params.curb_search, TRIP)
            .groupBy("trip_id", "x", "y").agg(F.min(closest).alias("c"))
            .select("trip_id", "x", "y", "c.dist", "c.cx", "c.cy")
            .join(shuffled(trips.select("trip_id", "edge_id_end")), "trip_id"))
    middle = street_segments(streets.select(F.col("id").alias("edge_id_end"), "geom_way")).drop("total", "seq", "off")
    return (skew_join(curb, middle, ["edge_id_end"], TRIP)
            .groupBy("trip_id", "dist").agg(
                F.min(geo.segment_distance("x", "y", "x1", "y1", "x2", "y2")).alias("spot"),
                F.min(geo.segment_distance("cx", "cy", "x1", "y1", "x2", "y2")).alias("curb"))
            .select("trip_id", F.when(F.col("spot") < F.col("curb"), F.col("dist")).otherwise(-F.col("dist")).alias("curb_dist")))


def end_class(trips: DataFrame, streets: DataFrame) -> DataFrame:
    """Class of the last driven street."""
    classes = streets.select(F.col("id").alias("edge_id_end"), F.col("clazz").alias("end_clazz"))
    return skew_join(trips.select("trip_id", "edge_id_end").filter("edge_id_end is not null"), classes,
                     ["edge_id_end"], TRIP).select("trip_id", "end_clazz")


def add_parking_context(trips: DataFrame, streets: DataFrame, lots: DataFrame | None = None, curbs: DataFrame | None = None,
                        block_groups: DataFrame | None = None, params: Params = Params()) -> DataFrame:
    out = trips.join(shuffled(end_class(trips, streets)), "trip_id", "left")
    if block_groups is None:
        out = out.withColumn("bg", F.lit(None).cast("string"))
    else:
        out = out.join(shuffled(end_block_group(trips, block_groups)), "trip_id", "left")
    if lots is None:
        out = out.withColumn("near_lot_dist", F.lit(None).cast("double"))
    else:
        out = out.join(shuffled(nearest_lot(trips, lots, params)), "trip_id", "left")
    if curbs is None:
        return out.withColumn("curb_dist", F.lit(None).cast("double"))
    return out.join(shuffled(curb_distance(trips, curbs, streets, params)), "trip_id", "left")

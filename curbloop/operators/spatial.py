"""Distance, nearest-feature and containment joins on grid cells.

Features are segments or polygons held as rows of segments (feature, x1, y1, x2, y2). A feature row is
repeated for every cell it can matter to, a point falls into exactly one cell, and the equi-join on the cell
is followed by the exact test. Cells crowded with points are salted by ``skew_join``.
"""
from pyspark.sql import Column, DataFrame, functions as F

from curbloop.functions import geo
from curbloop.operators.layout import shuffled, skew_join

CELL = ["cx", "cy"]


def cell_of(v: str, size: float) -> Column:
    return F.expr(f"floor(({v}) / {size}D)")


def _cells(lo: str, hi: str, size) -> Column:
    return F.expr(f"explode(sequence(floor(({lo}) / {size}D), floor(({hi}) / {size}D)))")


def segment_cells(segments: DataFrame, radius: float, size: float) -> DataFrame:
    """Repeat segments for the cells that hold some point within ``radius`` of them."""
    half = size / 2
    return (segments
            .withColumn("cx", _cells(f"least(x1, x2) - {radius}D", f"greatest(x1, x2) + {radius}D", size))
            .withColumn("cy", _cells(f"least(y1, y2) - {radius}D", f"greatest(y1, y2) + {radius}D", size))
            .filter(geo.segment_distance(f"cx * {size}D + {half}D", f"cy * {size}D + {half}D", "x1", "y1", "x2", "y2")
                    <= radius + half * 1.4143))


def near_segments(points: DataFrame, segments: DataFrame, radius: float, salt_by, size: float | None = None) -> DataFrame:
    """All (point, segment) pairs at most ``radius`` apart, with ``dist`` and the position ``share`` on the segment."""
    size = size or max(radius, 25.0)
    located = points.withColumns({"cx": cell_of("x", size), "cy": cell_of("y", size)})
    share = geo.share_along("x", "y", "x1", "y1", "x2", "y2")
    return (skew_join(located, segment_cells(segments, radius, size), CELL, salt_by).drop(*CELL)
            .withColumn("share", share)
            .withColumn("dist", geo.distance("x", "y", geo.between_sql("x1", "x2", "share"), geo.between_sql("y1", "y2", "share")))
            .filter(F.col("dist") <= radius))


def inside_polygons(points: DataFrame, segments: DataFrame, polygon, key, size: float = 500.0) -> DataFrame:
    """Distinct (``key``, ``polygon``) with the point in or on the polygon.

    A point needs the boundary rows its ray can meet, so a boundary row is repeated over the cells of its own
    rows and from the left edge of its polygon to its own right end.
    """
    left = segments.groupBy(polygon).agg(F.min(F.least("x1", "x2")).alias("left"))
    spread = (segments.join(shuffled(left), polygon)
              .withColumn("cx", _cells("left", "greatest(x1, x2)", size))
              .withColumn("cy", _cells("least(y1, y2)", "greatest(y1, y2)", size))
              .select(polygon, "x1", "y1", "x2", "y2", *CELL))
    located = points.select(*key, "x", "y").withColumns({"cx": cell_of("x", size), "cy": cell_of("y", size)})
    met = skew_join(located, spread, CELL, key)
    hits = met.groupBy(*key, polygon).agg(
        F.count_if(geo.crosses_ray("x", "y", "x1", "y1", "x2", "y2")).alias("crossings"),
        F.bool_or(geo.segment_distance("x", "y", "x1", "y1", "x2", "y2") <= 1e-9).alias("on_edge"))
    return hits.filter((F.col("crossings") % 2 == 1) | F.col("on_edge")).select(*key, polygon)


def polygon_distances(points: DataFrame, segments: DataFrame, polygon, key, radius: float) -> DataFrame:
    """(``key``, ``polygon``, ``dist``) within ``radius``; 0 inside a polygon."""
    near = (near_segments(points.select(*key, "x", "y"), segments, radius, key)
            .groupBy(*key, polygon).agg(F.min("dist").alias("dist")))
    inside = inside_polygons(points, segments, polygon, key, size=max(radius, 100)).withColumn("dist", F.lit(0.0))
    return near.unionByName(inside).groupBy(*key, polygon).agg(F.min("dist").alias("dist"))


# --- shapes of layers -----------------------------------------------------------------------------

def ring_segments(vertices: DataFrame, polygon, ring="ring") -> DataFrame:
    """Closed rings as vertex rows (polygon, ring, seq, x, y) -> boundary rows. An equi-join on the next seq."""
    a = vertices.select(polygon, ring, "seq", F.col("x").alias("x1"), F.col("y").alias("y1"))
    b = vertices.select(polygon, ring, (F.col("seq") - 1).alias("seq"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    return a.join(shuffled(b), [polygon, ring, "seq"])


def polygon_area(segments: DataFrame, polygon, ring="ring") -> DataFrame:
    """Shoelace area; ring 0 is the outline, the others are holes."""
    part = F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")
    rings = segments.groupBy(polygon, ring).agg(F.abs(F.sum(part) / 2).alias("a"))
    return rings.groupBy(polygon).agg(F.sum(F.when(F.col(ring) == 0, F.col("a")).otherwise(-F.col("a"))).alias("area"))


def drop_large_polygons(segments: DataFrame, polygon, area_max: float = 250_000) -> DataFrame:
    return segments.join(shuffled(polygon_area(segments, polygon).filter(F.col("area") > area_max)), polygon, "left_anti")


def street_segments(streets: DataFrame) -> DataFrame:
    """Street lines (array ``geom_way``) -> segment rows with their offset on the edge and its length."""
    keep = [c for c in streets.columns if c != "geom_way"]
    return (streets.selectExpr(*keep, f"{geo.step_lengths_sql('geom_way')} AS lens",
                               "slice(geom_way, 1, size(geom_way) - 1) AS a", "slice(geom_way, 2, size(geom_way) - 1) AS b")
            .selectExpr(*keep, "lens", "posexplode(arrays_zip(a, b)) AS (seq, s)")
            .selectExpr(*keep, "aggregate(lens, 0D, (acc, d) -> acc + d) AS total", "seq",
                        "aggregate(slice(lens, 1, seq), 0D, (acc, d) -> acc + d) AS off",
                        "s.a.x AS x1", "s.a.y AS y1", "s.b.x AS x2", "s.b.y AS y2"))


def cut_segments(segments: DataFrame, lo, hi) -> DataFrame:
    """The part of every line between two shares of its length; needs off and total."""
    length = geo.distance_sql("x1", "y1", "x2", "y2")
    return (segments
            .withColumns({"a": F.expr(f"greatest(0D, ({lo} * total - off) / nullif({length}, 0D))"),
                          "b": F.expr(f"least(1D, ({hi} * total - off) / nullif({length}, 0D))")})
            .filter("a < b")
            .withColumns({"x1": geo.between("x1", "x2", "a"), "y1": geo.between("y1", "y2", "a"),
                          "x2": geo.between("x1", "x2", "b"), "y2": geo.between("y1", "y2", "b")})
            .drop("a", "b"))


def extent(points: DataFrame, x="x", y="y", grow: float = 0.0) -> Column:
    """Bounding box of a point set as a scalar column with fields x_min, y_min, x_max, y_max."""
    return points.agg(F.expr(
        f"named_struct('x_min', min({x}) - {grow}D, 'y_min', min({y}) - {grow}D, 'x_max', max({x}) + {grow}D,"
        f" 'y_max', max({y}) + {grow}D) AS box")).scalar()


def segments_extent(segments: DataFrame, grow: float = 0.0) -> Column:
    ends = segments.selectExpr("explode(array(named_struct('x', x1, 'y', y1), named_struct('x', x2, 'y', y2))) AS p")
    return extent(ends, "p.x", "p.y", grow)


def _line_box(line):
    return [F.expr(f"array_{end}(transform({line}, p -> p.{axis}))") for end, axis in
            (("min", "x"), ("min", "y"), ("max", "x"), ("max", "y"))]


def box_holds_line(box: Column, line) -> Column:
    """Whether an array line lies wholly in a box."""
    x1, y1, x2, y2 = _line_box(line)
    return (x1 >= box["x_min"]) & (y1 >= box["y_min"]) & (x2 <= box["x_max"]) & (y2 <= box["y_max"])


def box_meets_line(box: Column, line) -> Column:
    """Whether the bounding box of an array line overlaps a box."""
    x1, y1, x2, y2 = _line_box(line)
    return (x2 >= box["x_min"]) & (x1 <= box["x_max"]) & (y2 >= box["y_min"]) & (y1 <= box["y_max"])


def box_holds_point(box: Column, x, y) -> Column:
    return F.col(x).between(box["x_min"], box["x_max"]) & F.col(y).between(box["y_min"], box["y_max"])

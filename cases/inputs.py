"""Inputs derived from the given tables, in Spark and as DuckDB CTEs with the same arithmetic.

Trips are grouped ten to a district. Districts lie 20 km apart on a diagonal, each with its own street grid,
lots, curbs and areas, so networks and layers grow with the tables just as the trips do.
"""
from pyspark.sql import DataFrame, SparkSession

from curbloop.functions.projection import zone_constants
from curbloop.params import REGIONS

PER_DISTRICT = 10
APART = 20_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- sparse, noisy pings ----------------------------------------------------------------------------

def pings(spark, sf_dir) -> DataFrame:
    return spark.sql("""
        SELECT event_id AS gid, concat('d', user_id) AS device_id,
               -122.33D + 0.015D * cos(event_id * 0.53D) AS longitude,
               47.60D + 0.010D * sin(event_id * 0.37D) AS latitude, value AS h_acc,
               1704067200000 + timestampdiff(MICROSECOND, TIMESTAMP_NTZ '2024-01-01 00:00:00', ts) div 1000 div 300 AS ts_ms
        FROM {e}""", e=table(spark, sf_dir, "events"))


PINGS = """pings AS (
  SELECT event_id AS gid, 'd' || user_id AS device_id,
         -122.33::DOUBLE + 0.015::DOUBLE * cos(event_id * 0.53::DOUBLE) AS longitude,
         47.60::DOUBLE + 0.010::DOUBLE * sin(event_id * 0.37::DOUBLE) AS latitude, value AS h_acc,
         1704067200000 + (epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01')) // 1000 // 300 AS ts_ms
  FROM events)"""


def lambert_sql(lon: str, lat: str, zone: str) -> tuple[str, str]:
    k = {n: f"{v!r}::DOUBLE" for n, v in zone_constants(REGIONS[zone]).items()}
    s = f"({k['e']} * sin(radians({lat})))"
    t = f"(tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {s}) / (1 + {s}), {k['e']} / 2))"
    rho = f"({k['af']} * pow({t}, {k['n']}))"
    theta = f"({k['n']} * radians({lon} - ({k['lon0']})))"
    return (f"({k['x0']} + {rho} * sin({theta}))", f"({k['y0']} + {k['rho0']} - {rho} * cos({theta}))")


_X, _Y = lambert_sql("longitude", "latitude", "wa")
POINTS = PINGS + f""",
points AS (
  SELECT gid, device_id, ts_ms, ts_ms // 1000 AS t, {_X} AS x, {_Y} AS y, h_acc FROM pings WHERE h_acc < 65)"""

# --- smooth drives that end in a walk -----------------------------------------------------------------

_DRIVES = """
  SELECT trip_id, ptid, {t} AS t, {apart} * (trip_id {div} 10) + d AS x,
         {apart} * (trip_id {div} 10) + 60{f} * sin(d / 80) AS y FROM (
    SELECT *, sum(g) OVER (PARTITION BY trip_id ORDER BY ptid) AS t0,
           coalesce(sum(g * s) OVER (PARTITION BY trip_id ORDER BY ptid
             ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), 0{f}) AS d FROM (
      SELECT *, CASE WHEN ptid <= n - 12 THEN 9{f} + event_id % 5 ELSE 1.1{f} END AS s FROM (
        SELECT user_id AS trip_id, event_id, 1 + event_id % 9 AS g,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS ptid,
               count(*) OVER (PARTITION BY user_id) AS n FROM {events}) a) b) c"""


def drives(spark, sf_dir) -> DataFrame:
    """Lines in long form: trip_id, ptid, t, x, y."""
    sql = _DRIVES.format(t="1704103200 + trip_id * 977 + t0", apart=APART, div="div", f="D", events="{e}")
    df = spark.sql(sql, e=table(spark, sf_dir, "events"))
    return df.selectExpr("trip_id", "cast(ptid as bigint) ptid", "t", "x", "y")


DRIVES = "drives AS (" + _DRIVES.format(
    t="(1704103200 + trip_id * 977 + t0)::BIGINT", apart=APART, div="//", f="::DOUBLE", events="events") + ")"

# --- street grids -----------------------------------------------------------------------------------

NODES_PER_DISTRICT, EDGES_PER_DISTRICT = 441, 840

_GRID = """
  SELECT c * 840 + row_number() OVER (PARTITION BY c ORDER BY dir, s) AS id, c, i, j, dir,
         c * 441 + s AS source, c * 441 + e AS target,
         {apart} * c - 1200{f} + 120 * (s {div} 21) AS x1, {apart} * c - 1200{f} + 120 * (s % 21) AS y1,
         {apart} * c - 1200{f} + 120 * (e {div} 21) AS x2, {apart} * c - 1200{f} + 120 * (e % 21) AS y2,
         CASE WHEN dir = 0 AND j % 7 = 3 THEN 51
              WHEN (dir = 0 AND j IN (0, 20)) OR (dir = 1 AND i IN (0, 20)) THEN 11 ELSE 41 END AS clazz,
         0.12{f} AS km, CASE WHEN dir = 0 AND j % 7 = 3 THEN 10 ELSE 40 END AS kmh,
         0.12{f} / CASE WHEN dir = 0 AND j % 7 = 3 THEN 10 ELSE 40 END AS cost,
         CASE WHEN dir = 1 AND i % 4 = 1 THEN 1000000{f}
              ELSE 0.12{f} / CASE WHEN dir = 0 AND j % 7 = 3 THEN 10 ELSE 40 END END AS reverse_cost
  FROM (SELECT c, i * 21 + j AS s, (i + 1) * 21 + j AS e, i, j, 0 AS dir FROM nodes WHERE i < 20
        UNION ALL SELECT c, i * 21 + j, i * 21 + j + 1, i, j, 1 FROM nodes WHERE j < 20) h"""


def nodes(spark, sf_dir) -> DataFrame:
    return spark.sql("""
        SELECT c, i, j FROM (SELECT DISTINCT user_id div 10 AS c FROM {e})
        LATERAL VIEW explode(sequence(0L, 20L)) a AS i LATERAL VIEW explode(sequence(0L, 20L)) b AS j""",
                     e=table(spark, sf_dir, "events"))


def grid(spark, sf_dir) -> DataFrame:
    sql = "WITH nodes AS (SELECT * FROM {n})" + _GRID.format(apart=APART, div="div", f="D")
    return spark.sql(sql, n=nodes(spark, sf_dir))


def streets(spark, sf_dir) -> DataFrame:
    return grid(spark, sf_dir).selectExpr(
        "cast(id as bigint) id", "cast(id + 7000000 as bigint) osm_id", "source", "target", "cost", "reverse_cost", "km", "kmh", "clazz",
        "array(named_struct('x', x1, 'y', y1), named_struct('x', x2, 'y', y2)) geom_way")


GRID = """nodes AS (
  SELECT c, i, j FROM (SELECT DISTINCT user_id // 10 AS c FROM events), range(21) a(i), range(21) b(j)),
grid AS (""" + _GRID.format(apart=APART, div="//", f="::DOUBLE") + ")"


def vertices(spark, sf_dir) -> DataFrame:
    return spark.sql("""
        SELECT /*+ MERGE(r) */ n.c * 441 + i * 21 + j AS id, n.c * 441 + i * 21 + j + 5000000 AS osm_id,
               CASE WHEN (i + j) % 5 = 0 THEN concat('-', e1, '_', e2)
                    WHEN (i * j) % 11 = 1 THEN concat('+', e1, '_', e2) END AS restrictions,
               20000D * n.c - 1200 + 120 * i AS x, 20000D * n.c - 1200 + 120 * j AS y
        FROM {n} n JOIN (
          SELECT node, min(id) AS e1, min_by(id2, id) AS e2 FROM (
            SELECT node, id, lead(id) OVER (PARTITION BY node ORDER BY id) AS id2
            FROM (SELECT source AS node, id FROM {g} UNION ALL SELECT target, id FROM {g}))
          GROUP BY node) r ON r.node = n.c * 441 + i * 21 + j""",
                     n=nodes(spark, sf_dir), g=grid(spark, sf_dir))


VERTICES = """touch AS (SELECT source AS node, id FROM grid UNION ALL SELECT target, id FROM grid),
vertices AS (
  SELECT node AS id, CASE WHEN (i + j) % 5 = 0 THEN '-' || e1 || '_' || e2
                          WHEN (i * j) % 11 = 1 THEN '+' || e1 || '_' || e2 END AS restrictions,
         20000::DOUBLE * c - 1200 + 120 * i AS x, 20000::DOUBLE * c - 1200 + 120 * j AS y
  FROM (SELECT node, min(id) AS e1, min(id2) AS e2 FROM (
          SELECT node, id, CASE WHEN rn = 2 THEN id END AS id2 FROM (
            SELECT *, row_number() OVER (PARTITION BY node ORDER BY id) AS rn FROM touch)) GROUP BY node) r
  JOIN nodes ON node = c * 441 + i * 21 + j),
tokens AS (SELECT id AS node, restrictions[1] AS sign, split_part(restrictions[2:], '_', 1)::BIGINT AS a,
                  split_part(restrictions[2:], '_', 2)::BIGINT AS b FROM vertices WHERE restrictions IS NOT NULL),
bans AS (SELECT DISTINCT * FROM (
  SELECT a AS source_id, b AS target_id FROM tokens WHERE sign = '-'
  UNION ALL SELECT a, id FROM tokens JOIN touch USING (node) WHERE sign = '+' AND id <> a AND id <> b))"""

# --- layers -------------------------------------------------------------------------------------------

_SIDES = ("(0, -1, -1, 1, -1), (1, 1, -1, 1, 1), (2, 1, 1, -1, 1), (3, -1, 1, -1, -1)")


def _boxes(key, select, where):
    return f"""SELECT {key}, 0 AS ring, seq, cx + h * a1 AS x1, cy + h * b1 AS y1, cx + h * a2 AS x2, cy + h * b2 AS y2
        FROM ({select}) q CROSS JOIN (VALUES {_SIDES}) s(seq, a1, b1, a2, b2) {where}"""


_LOT = """SELECT c, c * 441 + i * 21 + j AS lot_id, 20000{f} * c - 1200 + 120 * i AS cx,
                 20000{f} * c - 1200 + 120 * j AS cy, 20{f} AS h FROM nodes WHERE (i * 21 + j) % 3 = 0"""
_BG = """SELECT c, {bg} AS bg, 20000{f} * c - 900 + 600 * i AS cx, 20000{f} * c - 900 + 600 * j AS cy, 300{f} AS h
         FROM nodes WHERE i < 4 AND j < 4"""


def lots(spark, sf_dir) -> DataFrame:
    """Squares of 40 m as boundary rows."""
    return spark.sql("WITH nodes AS (SELECT * FROM {n}) " + _boxes("lot_id", _LOT.format(f="D"), ""), n=nodes(spark, sf_dir))


def block_groups(spark, sf_dir) -> DataFrame:
    """A 4 x 4 tiling of every district."""
    bg = "concat('bg', lpad(cast(c as string), 6, '0'), '_', i, j)"
    return spark.sql("WITH nodes AS (SELECT * FROM {n}) " + _boxes("bg", _BG.format(f="D", bg=bg), ""), n=nodes(spark, sf_dir))


def curbs(spark, sf_dir) -> DataFrame:
    """The streets shifted by 4 m."""
    return grid(spark, sf_dir).selectExpr("cast(id as bigint) curb_id", "x1 + 4 x1", "y1 + 4 y1", "x2 + 4 x2", "y2 + 4 y2")


LOTS = f"lots AS ({_LOT.format(f='::DOUBLE')})"
BLOCK_GROUPS = "bgs AS (" + _BG.format(f="::DOUBLE", bg="'bg' || lpad(c::VARCHAR, 6, '0') || '_' || i || j") + ")"
CURBS = "curbs AS (SELECT c, id AS curb_id, x1 + 4 AS x1, y1 + 4 AS y1, x2 + 4 AS x2, y2 + 4 AS y2 FROM grid)"


def rounded(df: DataFrame, digits: int = 3) -> DataFrame:
    """Doubles rounded for comparison across engines; -0.0 becomes 0.0."""
    return df.selectExpr(*[f"round(`{n}`, {digits}) + 0D AS `{n}`" if t == "double" else f"`{n}`" for n, t in df.dtypes])


def seg_dist_sql(px, py, x1="x1", y1="y1", x2="x2", y2="y2") -> str:
    s = share_sql(px, py, x1, y1, x2, y2)
    return f"sqrt(pow({px} - ({x1} + {s} * ({x2} - {x1})), 2) + pow({py} - ({y1} + {s} * ({y2} - {y1})), 2))"


def share_sql(px, py, x1="x1", y1="y1", x2="x2", y2="y2") -> str:
    return (f"greatest(0, least(1, (({px} - {x1}) * ({x2} - {x1}) + ({py} - {y1}) * ({y2} - {y1}))"
            f" / (pow({x2} - {x1}, 2) + pow({y2} - {y1}, 2))))")

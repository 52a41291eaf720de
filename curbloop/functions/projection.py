"""Degrees to regional metres: the closed Lambert conformal conic form (Snyder, USGS PP 1395, 1987)."""
import math

from pyspark.sql import Column, DataFrame, functions as F

from curbloop.params import REGIONS, LambertZone


def zone_constants(z: LambertZone) -> dict:
    f = 1 / z.inv_f if z.inv_f else 0.0
    e = math.sqrt(2 * f - f * f)

    def m(lat):
        return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)

    def t(lat):
        s = e * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    p1, p2, p0 = map(math.radians, (z.lat1, z.lat2, z.lat0))
    n = math.log(m(p1) / m(p2)) / math.log(t(p1) / t(p2))
    af = z.a * m(p1) / (n * t(p1) ** n)
    return {"e": e, "n": n, "af": af, "rho0": af * t(p0) ** n, "lon0": z.lon0, "x0": z.x0, "y0": z.y0}


def project_sql(lon: str, lat: str, zone: LambertZone | str) -> tuple[str, str]:
    """SQL for x, y in metres from fragments in degrees."""
    k = {n: f"{v!r}D" for n, v in zone_constants(REGIONS[zone] if isinstance(zone, str) else zone).items()}
    s = f"({k['e']} * sin(radians({lat})))"
    t = f"(tan(pi() / 4 - radians({lat}) / 2) / pow((1 - {s}) / (1 + {s}), {k['e']} / 2))"
    rho = f"({k['af']} * pow({t}, {k['n']}))"
    theta = f"({k['n']} * radians({lon} - ({k['lon0']})))"
    return f"({k['x0']} + {rho} * sin({theta}))", f"({k['y0']} + {k['rho0']} - {rho} * cos({theta}))"


def project_columns(df: DataFrame, zone, lon="longitude", lat="latitude", x="x", y="y") -> DataFrame:
    px, py = project_sql(lon, lat, zone)
    return df.withColumns({x: F.expr(px), y: F.expr(py)})


def project_line(line: str, zone) -> Column:
    """Re-project an array line whose x, y are lon, lat."""
    x, y = project_sql("p.x", "p.y", zone)
    return F.expr(f"transform({line}, p -> named_struct('x', {x}, 'y', {y}, 'm', p.m))")

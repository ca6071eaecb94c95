"""Coordinate systems as column expressions: map projections both ways, a datum shift, and moving tables and rasters between them.

Longitudes and latitudes are degrees, plane coordinates metres. Projections are ellipsoidal and closed or iterate a fixed
number of times; forth and back is good to well under a millimetre. Coordinates pass through helper columns
stage by stage, so no expression is computed twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Published ellipsoids (semi-major axis, inverse flattening) and the mean shift of the old North American datum to the world one (metres).
ELLIPSOIDS = {"WGS84": (6378137.0, 298.257223563), "GRS80": (6378137.0, 298.257222101), "CLARKE66": (6378206.4, 294.978698214)}
NAD27_SHIFTS = {"conus": (-8.0, 160.0, 176.0), "alaska": (-5.0, 135.0, 172.0), "canada": (-10.0, 158.0, 187.0)}


@dataclass(frozen=True)
class Crs:
    """A coordinate system. ``kind``: ``geographic``, ``mercator`` (spherical), ``albers`` or ``transverse``; ``shift``: to the world datum, where it isn't on it."""

    kind: str
    ellipsoid: str = "GRS80"
    lon0: float = 0.0
    lat0: float = 0.0
    lat1: float = 0.0
    lat2: float = 0.0
    scale: float = 1.0
    east: float = 0.0
    north: float = 0.0
    shift: tuple[float, float, float] | None = None


# Parameters of published coordinate systems by their numbers.
KNOWN = {
    4326: Crs("geographic", "WGS84"),
    4269: Crs("geographic", "GRS80"),
    4267: Crs("geographic", "CLARKE66", shift=NAD27_SHIFTS["conus"]),
    3857: Crs("mercator", "WGS84"),
    3310: Crs("albers", "GRS80", -120.0, 0.0, 34.0, 40.5, north=-4_000_000.0),
    3005: Crs("albers", "GRS80", -126.0, 45.0, 50.0, 58.5, east=1_000_000.0),
    3338: Crs("albers", "GRS80", -154.0, 50.0, 55.0, 65.0),
    5070: Crs("albers", "GRS80", -96.0, 23.0, 29.5, 45.5),
}


def crs(number: int) -> Crs:
    """The system of a number; zones of the universal transverse Mercator system by rule (326xx and 327xx world datum, 269xx and 267xx the newer and older North American one)."""
    if number in KNOWN:
        return KNOWN[number]
    group, zone = divmod(number, 100)
    if group in (326, 327, 269, 267) and 1 <= zone <= 60:
        old = group == 267
        return Crs("transverse", "CLARKE66" if old else "GRS80" if group == 269 else "WGS84", 6.0 * zone - 183, scale=0.9996, east=500_000.0, north=10_000_000.0 if group == 327 else 0.0, shift=NAD27_SHIFTS["conus"] if old else None)
    raise KeyError(f"unknown coordinate system {number}")


def _shape(name: str) -> tuple[float, float, float]:
    """Semi-major axis, flattening, squared eccentricity."""
    a, inverse = ELLIPSOIDS[name]
    f = 1 / inverse
    return a, f, f * (2 - f)


def _q(sine, e2: float, ln):
    e = math.sqrt(e2)
    return (1 - e2) * (sine / (1 - e2 * sine * sine) - ln((1 - e * sine) / (1 + e * sine)) / (2 * e))


def _cone(c: Crs) -> tuple[float, float, float]:
    """The constants of an equal-area cone: n, C and the radius of the origin."""
    a, _, e2 = _shape(c.ellipsoid)
    q = lambda lat: _q(math.sin(math.radians(lat)), e2, math.log)
    m2 = lambda lat: math.cos(math.radians(lat)) ** 2 / (1 - e2 * math.sin(math.radians(lat)) ** 2)
    n = (m2(c.lat1) - m2(c.lat2)) / (q(c.lat2) - q(c.lat1)) if c.lat1 != c.lat2 else math.sin(math.radians(c.lat1))
    k = m2(c.lat1) + n * q(c.lat1)
    return n, k, a * math.sqrt(k - n * q(c.lat0)) / n


def _series(c: Crs) -> tuple[float, float, list[float], list[float], list[float]]:
    """Third flattening, radius of the rectifying sphere, and the series forth, back and to latitudes, to the third order."""
    a, f, _ = _shape(c.ellipsoid)
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    forth = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    lat = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    return n, radius, forth, back, lat


def _stages(df: DataFrame, *stages: dict[str, Column]) -> DataFrame:
    for stage in stages:
        df = df.withColumns(stage)
    return df


def _project(df: DataFrame, c: Crs) -> DataFrame:
    """``_lon``, ``_lat`` to ``_x``, ``_y``."""
    a, _, e2 = _shape(c.ellipsoid)
    lon, lat = F.col("_lon"), F.col("_lat")
    if c.kind == "geographic":
        return df.withColumns({"_x": lon, "_y": lat})
    if c.kind == "mercator":
        return df.withColumns({"_x": F.radians(lon) * a, "_y": F.ln(F.tan(math.pi / 4 + F.radians(lat) / 2)) * a})
    turn = F.radians(F.pmod(lon - c.lon0 + 180, F.lit(360.0)) - 180)
    if c.kind == "albers":
        n, k, top = _cone(c)
        away = a * F.sqrt(k - n * _q(F.sin(F.radians(lat)), e2, F.ln)) / n
        return _stages(df, {"_t": n * turn, "_r": away}, {"_x": c.east + F.col("_r") * F.sin("_t"), "_y": c.north + top - F.col("_r") * F.cos("_t")}).drop("_t", "_r")
    n, radius, forth, _, _ = _series(c)
    k = 2 * math.sqrt(n) / (1 + n)
    t = F.sinh(F.atanh(F.sin(F.radians(lat))) - k * F.atanh(k * F.sin(F.radians(lat))))
    u, v = F.col("_u"), F.col("_v")
    y = u + sum((x * F.sin(2 * j * u) * F.cosh(2 * j * v) for j, x in enumerate(forth, 1)), F.lit(0.0))
    x = v + sum((x * F.cos(2 * j * u) * F.sinh(2 * j * v) for j, x in enumerate(forth, 1)), F.lit(0.0))
    return _stages(
        df, {"_t": t, "_d": turn}, {"_u": F.atan2(F.col("_t"), F.cos("_d")), "_v": F.atanh(F.sin("_d") / F.sqrt(1 + F.col("_t") * F.col("_t")))},
        {"_x": c.east + c.scale * radius * x, "_y": c.north + c.scale * radius * y},
    ).drop("_t", "_d", "_u", "_v")


def _unproject(df: DataFrame, c: Crs) -> DataFrame:
    """``_x``, ``_y`` to ``_lon``, ``_lat``."""
    a, _, e2 = _shape(c.ellipsoid)
    x, y = F.col("_x"), F.col("_y")
    if c.kind == "geographic":
        return df.withColumns({"_lon": x, "_lat": y})
    if c.kind == "mercator":
        return df.withColumns({"_lon": F.degrees(x / a), "_lat": F.degrees(2 * F.atan(F.exp(y / a)) - math.pi / 2)})
    if c.kind == "albers":
        n, k, top = _cone(c)
        dx, dy = x - c.east, top - (y - c.north)
        e = math.sqrt(e2)

        def step(lat: Column, _: Column) -> Column:
            s = F.sin(lat)
            w = 1 - e2 * s * s
            return lat + w * w / (2 * F.cos(lat)) * (F.col("_q") / (1 - e2) - s / w + F.ln((1 - e * s) / (1 + e * s)) / (2 * e))

        lat = F.aggregate(F.sequence(F.lit(1), F.lit(6)), F.asin(F.least(F.greatest(F.col("_q") / 2, F.lit(-1.0)), F.lit(1.0))), step)
        q = (k - (dx * dx + dy * dy) * (n * n) / (a * a)) / n
        return _stages(df, {"_q": q, "_lon": c.lon0 + F.degrees(F.atan2(dx, dy) / n)}, {"_lat": F.degrees(lat)}).drop("_q")
    _, radius, _, back, lats = _series(c)
    u, v = F.col("_u"), F.col("_v")
    up = u - sum((b * F.sin(2 * j * u) * F.cosh(2 * j * v) for j, b in enumerate(back, 1)), F.lit(0.0))
    vp = v - sum((b * F.cos(2 * j * u) * F.sinh(2 * j * v) for j, b in enumerate(back, 1)), F.lit(0.0))
    chi = F.col("_chi")
    return _stages(
        df, {"_u": (y - c.north) / (c.scale * radius), "_v": (x - c.east) / (c.scale * radius)}, {"_up": up, "_vp": vp}, {"_chi": F.asin(F.sin("_up") / F.cosh("_vp"))},
        {"_lat": F.degrees(chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(lats, 1)), F.lit(0.0))), "_lon": c.lon0 + F.degrees(F.atan2(F.sinh("_vp"), F.cos("_up")))},
    ).drop("_u", "_v", "_up", "_vp", "_chi")


def _moved(df: DataFrame, source: str, target: str, by: tuple[float, float, float]) -> DataFrame:
    """``_lon``, ``_lat`` to those of the same point, at the ellipsoid's surface, seen from a centre moved by ``by`` on another ellipsoid."""
    a, _, e2 = _shape(source)
    b, f, t2 = _shape(target)
    minor = b * (1 - f)
    lon, lat = F.radians("_lon"), F.radians("_lat")
    n = a / F.sqrt(1 - e2 * F.sin(lat) * F.sin(lat))
    p = F.sqrt(F.col("_X") * F.col("_X") + F.col("_Y") * F.col("_Y"))
    s, c = F.sin("_th"), F.cos("_th")
    return _stages(
        df, {"_n": n}, {"_X": F.col("_n") * F.cos(lat) * F.cos(lon) + by[0], "_Y": F.col("_n") * F.cos(lat) * F.sin(lon) + by[1], "_Z": F.col("_n") * (1 - e2) * F.sin(lat) + by[2]},
        {"_p": p, "_th": F.atan2(F.col("_Z") * b, p * minor)},
        {"_lon": F.degrees(F.atan2("_Y", "_X")), "_lat": F.degrees(F.atan2(F.col("_Z") + t2 / (1 - t2) * minor * s * s * s, F.col("_p") - t2 * b * c * c * c))},
    ).drop("_n", "_X", "_Y", "_Z", "_p", "_th")


def _to_world(df: DataFrame, c: Crs) -> DataFrame:
    return _moved(df, c.ellipsoid, "WGS84", c.shift) if c.shift else df


def _from_world(df: DataFrame, c: Crs) -> DataFrame:
    """The other way; heights are lost, so the way there and back is made once and its error taken off."""
    if not c.shift:
        return df
    back = tuple(-x for x in c.shift)
    first = _moved(df.withColumns({"_lon0": F.col("_lon"), "_lat0": F.col("_lat")}), "WGS84", c.ellipsoid, back)
    again = _to_world(first.withColumns({"_lon1": F.col("_lon"), "_lat1": F.col("_lat")}), c)
    fixed = {k: F.col(f"{k}1") + F.col(f"{k}0") - F.col(k) for k in ("_lon", "_lat")}
    return again.withColumns(fixed).drop("_lon0", "_lat0", "_lon1", "_lat1")


def reproject(df: DataFrame, source: Crs, target: Crs, x: str = "x", y: str = "y") -> DataFrame:
    """``x`` and ``y`` moved from one system to another; null where one of them is null. All other columns stay."""
    there = F.col(x).isNotNull() & F.col(y).isNotNull()
    rows = df.withColumns({"_x": F.when(there, F.col(x).cast("double")), "_y": F.when(there, F.col(y).cast("double"))})
    rows = _project(_from_world(_to_world(_unproject(rows, source), source), target), target)
    return rows.withColumns({x: F.col("_x"), y: F.col("_y")}).drop("_x", "_y", "_lon", "_lat")


def reproject_mixed(df: DataFrame, target: Crs, srid: str = "srid", x: str = "x", y: str = "y", systems: dict[int, Crs] | None = None) -> DataFrame:
    """Rows of several systems (numbers in ``srid``) moved to one, group by group, and united; a null or unknown number makes the coordinates null.

    ``systems``: those to look for; else the numbers that are there are read first (a short list).
    """
    if systems is None:
        systems = {}
        for (number,) in df.where(F.col(srid).isNotNull()).select(srid).distinct().collect():  # as many as there are coordinate systems
            try:
                systems[number] = crs(number)
            except KeyError:
                continue
    own = F.col(srid)
    other = df.where(own.isNull() | ~own.isin(list(systems)) if systems else F.lit(True))
    out = other.withColumns({c: F.lit(None).cast("double") for c in (x, y)})
    for number, system in sorted(systems.items()):
        out = out.unionByName(reproject(df.where(own == number), system, target, x, y))
    return out

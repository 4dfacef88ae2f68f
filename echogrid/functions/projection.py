"""Closed-form map projections as column expressions, no UDF.

Formulas follow Snyder, *Map Projections: A Working Manual* (1987), and the
Krueger series as given by Karney (2011).  Angles are degrees at the interface.
Out-of-domain input gives NULL.  Values used more than once are kept as columns
on the way, so the optimizer does not multiply the expression trees.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EARTH_RADIUS = 6378137.0
WGS84_FLATTENING = 1.0 / 298.257223563


@dataclass(frozen=True)
class Crs:
    """Parameters of one coordinate system; ``f`` is the flattening (0 = sphere)."""

    kind: str  # longlat | merc | laea | tmerc
    a: float = EARTH_RADIUS
    f: float = 0.0
    lat0: float = 0.0
    lon0: float = 0.0
    k: float = 1.0
    x0: float = 0.0
    y0: float = 0.0


LONLAT = Crs("longlat")
WEB_MERCATOR = Crs("merc")


def local_laea(lat0: float, lon0: float) -> Crs:
    return Crs("laea", f=WGS84_FLATTENING, lat0=lat0, lon0=lon0)


def parse_proj4(text: str) -> Crs:
    """The parameters of a proj4 definition of one of the supported kinds."""
    params: dict[str, str] = {}
    for token in text.split():
        key, _, value = token.lstrip("+").partition("=")
        params[key] = value
    kind = params.get("proj", "")
    if kind in ("latlong", "lonlat"):
        kind = "longlat"
    if kind not in _FORWARD:
        raise ValueError(f"unsupported projection {kind!r} in {text!r}")
    sphere = params.get("datum") != "WGS84" and params.get("ellps") != "WGS84"
    a = float(params.get("a", params.get("R", EARTH_RADIUS)))
    if "rf" in params:
        f = 1.0 / float(params["rf"])
    elif "b" in params:
        f = (a - float(params["b"])) / a
    else:
        f = 0.0 if sphere and ("a" in params or "R" in params or kind == "merc") else WGS84_FLATTENING
    if kind == "merc" and f:
        raise ValueError("only the spherical Mercator is supported")
    number = lambda *names: next((float(params[n]) for n in names if n in params), None)
    return Crs(
        kind,
        a=a,
        f=f,
        lat0=number("lat_0") or 0.0,
        lon0=number("lon_0") or 0.0,
        k=number("k_0", "k") or 1.0,
        x0=number("x_0") or 0.0,
        y0=number("y_0") or 0.0,
    )


class _Steps:
    """A DataFrame under construction, with named intermediate columns."""

    def __init__(self, df: DataFrame) -> None:
        self.df = df
        self.kept: list[str] = []

    def keep(self, *values: Column) -> tuple[Column, ...]:
        names = [f"_step{len(self.kept) + i}" for i in range(len(values))]
        self.df = self.df.withColumns(dict(zip(names, values)))
        self.kept.extend(names)
        return tuple(F.col(name) for name in names)

    def finish(self, out: tuple[str, str], values: tuple[Column, Column]) -> DataFrame:
        """Add the results and drop the intermediates.

        Where there are many, the result passes through a one-element explode:
        filters on it then stay above, instead of being pushed down with every
        intermediate written out in full.
        """
        if len(self.kept) <= 4:
            return self.df.withColumns(dict(zip(out, values))).drop(*self.kept)
        pair = F.struct(*[value.alias(name) for name, value in zip(out, values)])
        packed = self.df.withColumn("_pair", F.explode(F.array(pair))).drop(*self.kept)
        return packed.withColumns({name: F.col(f"_pair.{name}") for name in out}).drop("_pair")


def forward(df: DataFrame, lon: Column, lat: Column, crs: Crs, out: tuple[str, str] = ("x", "y")) -> DataFrame:
    """Add projected coordinates of ``crs`` for degrees."""
    return project(df, lon, lat, LONLAT, crs, out)


def inverse(df: DataFrame, x: Column, y: Column, crs: Crs, out: tuple[str, str] = ("lon", "lat")) -> DataFrame:
    """Add degrees for projected coordinates of ``crs``."""
    return project(df, x, y, crs, LONLAT, out)


def project(
    df: DataFrame, x: Column, y: Column, source: Crs, target: Crs, out: tuple[str, str] = ("x", "y")
) -> DataFrame:
    """Add ``out`` columns: (x, y) of ``source`` expressed in ``target``."""
    steps = _Steps(df)
    lon, lat = _INVERSE[source.kind](steps, x, y, source)
    return steps.finish(out, _FORWARD[target.kind](steps, lon, lat, target))


def laea_forward_at(
    df: DataFrame, lon: Column, lat: Column, lon0: Column, lat0: Column, out: tuple[str, str] = ("x", "y")
) -> DataFrame:
    """Equal-area coordinates about an origin that may differ by row."""
    steps = _Steps(df)
    return steps.finish(out, _laea_to_plane(steps, lon, lat, lon0, lat0, EARTH_RADIUS, WGS84_FLATTENING))


def laea_inverse_at(
    df: DataFrame, x: Column, y: Column, lon0: Column, lat0: Column, out: tuple[str, str] = ("lon", "lat")
) -> DataFrame:
    steps = _Steps(df)
    return steps.finish(out, _laea_to_degrees(steps, x, y, lon0, lat0, EARTH_RADIUS, WGS84_FLATTENING))


def _longlat_forward(steps: _Steps, lon: Column, lat: Column, crs: Crs) -> tuple[Column, Column]:
    return lon, lat


def _longlat_inverse(steps: _Steps, x: Column, y: Column, crs: Crs) -> tuple[Column, Column]:
    return x, F.when(F.abs(y) <= 90, y)


def _merc_forward(steps: _Steps, lon: Column, lat: Column, crs: Crs) -> tuple[Column, Column]:
    scale = crs.a * crs.k
    inside = F.abs(lat) < 90
    x = F.lit(crs.x0) + F.lit(scale) * F.radians(lon - crs.lon0)
    y = F.lit(crs.y0) + F.lit(scale) * F.log(F.tan(F.lit(math.pi / 4) + F.radians(lat) / 2))
    return F.when(inside, x), F.when(inside, y)


def _merc_inverse(steps: _Steps, x: Column, y: Column, crs: Crs) -> tuple[Column, Column]:
    scale = crs.a * crs.k
    lon = F.degrees((x - crs.x0) / scale) + crs.lon0
    lat = F.degrees(F.lit(math.pi / 2) - 2 * F.atan(F.exp(-(y - crs.y0) / scale)))
    return steps.keep(lon, lat)


def _authalic_q(sin_lat: Column, e: float) -> Column:
    if e == 0.0:
        return 2 * sin_lat
    es = e * sin_lat
    return (1 - e * e) * (sin_lat / (1 - es * es) - F.log((1 - es) / (1 + es)) / (2 * e))


def _clamp_unit(value: Column) -> Column:
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), value))


def _laea_origin(steps: _Steps, lat0: Column, a: float, e: float) -> tuple[Column, ...]:
    """q at the pole, authalic radius, sine and cosine of the authalic latitude of origin, shape factor."""
    q_pole, sin0 = steps.keep(_authalic_q(F.lit(1.0), e), F.sin(F.radians(lat0)))
    (sin_b0,) = steps.keep(_clamp_unit(_authalic_q(sin0, e) / q_pole))
    cos_b0, radius = steps.keep(F.sqrt(1 - sin_b0 * sin_b0), a * F.sqrt(q_pole / 2))
    (d,) = steps.keep(a * F.cos(F.radians(lat0)) / (F.sqrt(1 - e * e * sin0 * sin0) * radius * cos_b0))
    return q_pole, radius, sin_b0, cos_b0, d


def _laea_to_plane(steps, lon, lat, lon0, lat0, a, f) -> tuple[Column, Column]:
    e = math.sqrt(f * (2 - f))
    q_pole, radius, sin_b0, cos_b0, d = _laea_origin(steps, lat0, a, e)
    sin_lat, turn = steps.keep(F.sin(F.radians(lat)), F.radians(lon - lon0))
    (sin_b,) = steps.keep(_clamp_unit(_authalic_q(sin_lat, e) / q_pole))
    cos_b, cos_turn = steps.keep(F.sqrt(1 - sin_b * sin_b), F.cos(turn))
    (facing,) = steps.keep(1 + sin_b0 * sin_b + cos_b0 * cos_b * cos_turn)
    (spread,) = steps.keep(radius * F.sqrt(F.lit(2.0) / F.when(facing > 1e-12, facing)))
    return spread * d * cos_b * F.sin(turn), spread / d * (cos_b0 * sin_b - sin_b0 * cos_b * cos_turn)


def _laea_to_degrees(steps, x, y, lon0, lat0, a, f) -> tuple[Column, Column]:
    e = math.sqrt(f * (2 - f))
    q_pole, radius, sin_b0, cos_b0, d = _laea_origin(steps, lat0, a, e)
    dx, dy = steps.keep(x / d, y * d)
    (rho,) = steps.keep(F.sqrt(dx * dx + dy * dy))
    (arc,) = steps.keep(2 * F.asin(F.when(rho <= 2 * radius, rho / (2 * radius))))
    sin_arc, cos_arc = steps.keep(F.sin(arc), F.cos(arc))
    tilted = cos_arc * sin_b0 + dy * sin_arc * cos_b0 / F.when(rho > 0, rho)
    turn = F.atan2(dx * sin_arc, rho * cos_b0 * cos_arc - dy * sin_b0 * sin_arc)
    sin_b, lon = steps.keep(F.coalesce(tilted, F.when(rho == 0, sin_b0)), lon0 + F.degrees(turn))
    (b,) = steps.keep(F.asin(_clamp_unit(sin_b)))
    if e == 0.0:
        return steps.keep(F.when(sin_b.isNotNull(), lon), F.degrees(b))
    e2 = e**2
    e4, e6 = e2**2, e2**3
    (series,) = steps.keep(
        b
        + (e2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * b)
        + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * b)
        + (761 * e6 / 45360) * F.sin(6 * b)
    )
    # One Newton step on q brings the series to machine precision; the poles,
    # where the step degenerates, keep the series value.
    sin_p, cos_p = steps.keep(F.sin(series), F.cos(series))
    slack = 1 - e2 * sin_p * sin_p
    step = slack * slack / (2 * (1 - e2)) * (q_pole * sin_b - _authalic_q(sin_p, e)) / F.when(cos_p > 1e-9, cos_p)
    lat = F.degrees(series + F.coalesce(step, F.when(sin_b.isNotNull(), F.lit(0.0))))
    return steps.keep(F.when(sin_b.isNotNull(), lon), lat)


def _laea_forward(steps: _Steps, lon: Column, lat: Column, crs: Crs) -> tuple[Column, Column]:
    x, y = _laea_to_plane(steps, lon, lat, F.lit(crs.lon0), F.lit(crs.lat0), crs.a, crs.f)
    return crs.x0 + x, crs.y0 + y


def _laea_inverse(steps: _Steps, x: Column, y: Column, crs: Crs) -> tuple[Column, Column]:
    return _laea_to_degrees(steps, x - crs.x0, y - crs.y0, F.lit(crs.lon0), F.lit(crs.lat0), crs.a, crs.f)


# Krueger series coefficients by powers n, n^2, ... n^6, one row
# per multiple of the angle.
_ALPHA = (
    (1 / 2, -2 / 3, 5 / 16, 41 / 180, -127 / 288, 7891 / 37800),
    (0, 13 / 48, -3 / 5, 557 / 1440, 281 / 630, -1983433 / 1935360),
    (0, 0, 61 / 240, -103 / 140, 15061 / 26880, 167603 / 181440),
    (0, 0, 0, 49561 / 161280, -179 / 168, 6601661 / 7257600),
    (0, 0, 0, 0, 34729 / 80640, -3418889 / 1995840),
    (0, 0, 0, 0, 0, 212378941 / 319334400),
)
_BETA = (
    (1 / 2, -2 / 3, 37 / 96, -1 / 360, -81 / 512, 96199 / 604800),
    (0, 1 / 48, 1 / 15, -437 / 1440, 46 / 105, -1118711 / 3870720),
    (0, 0, 17 / 480, -37 / 840, -209 / 4480, 5569 / 90720),
    (0, 0, 0, 4397 / 161280, -11 / 504, -830251 / 7257600),
    (0, 0, 0, 0, 4583 / 161280, -108847 / 3991680),
    (0, 0, 0, 0, 0, 20648693 / 638668800),
)
_DELTA = (
    (2, -2 / 3, -2, 116 / 45, 26 / 45, -2854 / 675),
    (0, 7 / 3, -8 / 5, -227 / 45, 2704 / 315, 2323 / 945),
    (0, 0, 56 / 15, -136 / 35, -1262 / 105, 73814 / 2835),
    (0, 0, 0, 4279 / 630, -332 / 35, -399572 / 14175),
    (0, 0, 0, 0, 4174 / 315, -144838 / 6237),
    (0, 0, 0, 0, 0, 601676 / 22275),
)


def _series(table: tuple, n: float) -> list[float]:
    return [sum(factor * n ** (power + 1) for power, factor in enumerate(row)) for row in table]


def _tmerc_origin(crs: Crs) -> float:
    """Northing of the latitude of origin on the central meridian, unscaled by k."""
    n = crs.f / (2 - crs.f)
    big = 2 * math.sqrt(n) / (1 + n)
    s = math.sin(math.radians(crs.lat0))
    xi = math.atan(math.sinh(math.atanh(s) - big * math.atanh(big * s)))
    return xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(_series(_ALPHA, n)))


def _tmerc_radius(crs: Crs) -> float:
    n = crs.f / (2 - crs.f)
    return crs.k * crs.a / (1 + n) * (1 + n**2 / 4 + n**4 / 64 + n**6 / 256)


def _tmerc_forward(steps: _Steps, lon: Column, lat: Column, crs: Crs) -> tuple[Column, Column]:
    n = crs.f / (2 - crs.f)
    big = 2 * math.sqrt(n) / (1 + n)
    radius = _tmerc_radius(crs)
    (turn,) = steps.keep(F.radians(lon - crs.lon0))
    (s,) = steps.keep(F.when((F.abs(lat) < 90) & (F.cos(turn) > 0), F.sin(F.radians(lat))))
    (t,) = steps.keep(F.sinh(F.atanh(s) - big * F.atanh(big * s)))
    xi, eta = steps.keep(F.atan2(t, F.cos(turn)), F.asinh(F.sin(turn) / F.sqrt(t * t + F.pow(F.cos(turn), 2))))
    north, east = xi, eta
    for j, alpha in enumerate(_series(_ALPHA, n)):
        m = 2.0 * (j + 1)
        north = north + alpha * F.sin(m * xi) * F.cosh(m * eta)
        east = east + alpha * F.cos(m * xi) * F.sinh(m * eta)
    return crs.x0 + radius * east, crs.y0 + radius * (north - _tmerc_origin(crs))


def _tmerc_inverse(steps: _Steps, x: Column, y: Column, crs: Crs) -> tuple[Column, Column]:
    n = crs.f / (2 - crs.f)
    radius = _tmerc_radius(crs)
    xi, eta = steps.keep((y - crs.y0) / radius + _tmerc_origin(crs), (x - crs.x0) / radius)
    xi_p, eta_p = xi, eta
    for j, beta in enumerate(_series(_BETA, n)):
        m = 2.0 * (j + 1)
        xi_p = xi_p - beta * F.sin(m * xi) * F.cosh(m * eta)
        eta_p = eta_p - beta * F.cos(m * xi) * F.sinh(m * eta)
    xi_p, eta_p = steps.keep(xi_p, eta_p)
    inside = (F.abs(xi) < math.pi / 2) & (F.abs(eta) < 2.0)
    (chi,) = steps.keep(F.asin(F.when(inside, _clamp_unit(F.sin(xi_p) / F.cosh(eta_p)))))
    lat = chi
    for j, delta in enumerate(_series(_DELTA, n)):
        lat = lat + delta * F.sin(2.0 * (j + 1) * chi)
    lon = crs.lon0 + F.degrees(F.atan2(F.sinh(eta_p), F.cos(xi_p)))
    return steps.keep(F.when(inside, lon), F.degrees(lat))


_FORWARD = {"longlat": _longlat_forward, "merc": _merc_forward, "laea": _laea_forward, "tmerc": _tmerc_forward}
_INVERSE = {"longlat": _longlat_inverse, "merc": _merc_inverse, "laea": _laea_inverse, "tmerc": _tmerc_inverse}

"""Column expressions of map algebra.  Missing values are NULL, never NaN; a zero denominator gives NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def no_nan(x) -> Column:
    """NaN to NULL: Spark sorts NaN above every number, so it must not enter a comparison."""
    return F.nanvl(_col(x), F.lit(None).cast("double"))


def no_data(x, value: float | None) -> Column:
    """NULL where ``x`` is the no-data value."""
    x = no_nan(_col(x).cast("double"))
    return x if value is None else F.nullif(x, F.lit(float(value)))


def ratio(a, b) -> Column:
    """(a - b) / (a + b)."""
    a, b = _col(a), _col(b)
    return F.try_divide(a - b, a + b)


def ndvi(nir="b08", red="b04") -> Column:
    return ratio(nir, red)


def ndwi(green="b03", nir="b08") -> Column:
    return ratio(green, nir)


def ndre(nir="b08", red_edge="b05") -> Column:
    return ratio(nir, red_edge)


def exg(red="red", green="green", blue="blue") -> Column:
    """Chromatic excess green, 2g - r - b on shares of R + G + B (a sum of 0 counts as 1)."""
    r, g, b = (_col(x).cast("double") for x in (red, green, blue))
    total = r + g + b
    total = F.when(total == 0, F.lit(1.0)).otherwise(total)
    return 2 * (g / total) - r / total - b / total


def canopy_height(dsm="dsm", dem="dem", dsm_nodata: float | None = None, dem_nodata: float | None = None) -> Column:
    """Surface minus terrain, NULL where either is no data."""
    return no_data(dsm, dsm_nodata) - no_data(dem, dem_nodata)


def canopy_height_floor(dsm="dsm", dem="dem", floor: float = -1000.0) -> Column:
    """The variant that takes everything below ``floor`` for no data."""
    held = lambda x: F.when(_col(x) >= floor, _col(x))
    return held(dsm) - held(dem)


def height_in_range(h="h", most: float = 120.0) -> Column:
    return F.when((_col(h) >= 0) & (_col(h) <= most), _col(h))


def harmonise(value, ts, cutoff: str = "2022-01-25", offset: float = 1000.0) -> Column:
    """From ``cutoff`` on, an offset is taken off and the result stops at 0."""
    v = _col(value).cast("double")
    return F.when(_col(ts) >= F.lit(cutoff).cast("timestamp"), F.greatest(v - offset, F.lit(0.0))).otherwise(v)


def reflectance(value, scale: float = 10000.0) -> Column:
    """Digital number to 0 .. 1; NULL stays NULL (greatest and least skip it)."""
    v = _col(value)
    return F.when(v.isNotNull(), F.least(F.greatest(v / scale, F.lit(0.0)), F.lit(1.0)))


def stretch(value, low, high) -> Column:
    """Percentile stretch to 0 .. 255, truncated; NULL gives 0."""
    x = F.try_divide(_col(value) - _col(low), _col(high) - _col(low) + F.lit(1e-9))
    return F.floor(F.coalesce(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)), F.lit(0.0)) * 255).cast("int")


def recovery_fraction(value, bare, reference, clip: bool = True) -> Column:
    """(v - bare) / (ref - bare), in 0 .. 1 with ``clip``; equal anchors are an error."""
    v, lo, hi = _col(value), _col(bare), _col(reference)
    out = F.when(lo == hi, F.raise_error(F.lit("recovery anchors are equal"))).otherwise((v - lo) / (hi - lo))
    return F.when(v.isNotNull(), F.least(F.greatest(out, F.lit(0.0)), F.lit(1.0))) if clip else out


def quadkey(lon, lat, zoom: int = 9) -> Column:
    """The tile key of a longitude and latitude: one base-4 digit for each zoom level."""
    lon, lat = _col(lon), _col(lat)
    n = float(1 << zoom)
    s = F.sin(F.radians(lat))
    x = F.floor((lon + 180) / 360 * n)
    y = F.floor((0.5 - F.log((1 + s) / (1 - s)) / (4 * F.pi())) * n)
    inside = lambda v: F.least(F.greatest(v, F.lit(0)), F.lit((1 << zoom) - 1)).cast("long")
    x, y = inside(x), inside(y)
    digits = [(F.shiftright(x, z).bitwiseAND(F.lit(1).cast("long")) + 2 * F.shiftright(y, z).bitwiseAND(F.lit(1).cast("long"))).cast("string") for z in range(zoom - 1, -1, -1)]
    return F.concat(*digits)


def mercator(lon, lat) -> tuple[Column, Column]:
    """Longitude and latitude to spherical Mercator metres."""
    r = 6378137.0
    lon, lat = _col(lon), _col(lat)
    return r * F.radians(lon), r * F.log(F.tan(F.pi() / 4 + F.radians(lat) / 2))


def mercator_inverse(x, y) -> tuple[Column, Column]:
    r = 6378137.0
    return F.degrees(_col(x) / r), F.degrees(2 * F.atan(F.exp(_col(y) / r)) - F.pi() / 2)


# Semi-major axis and inverse flattening of GRS 80 and WGS 84.
GRS80, WGS84 = (6378137.0, 298.257222101), (6378137.0, 298.257223563)


def transverse_zone(epsg: int) -> dict:
    """Ellipsoid, central meridian, scale and false origin of EPSG:2193 or a UTM zone (326nn, 327nn)."""
    if epsg == 2193:
        return {"ellipsoid": GRS80, "lon0": 173.0, "k0": 0.9996, "east0": 1_600_000.0, "north0": 10_000_000.0}
    side, zone = divmod(epsg, 100)
    if side not in (326, 327) or not 1 <= zone <= 60:
        raise ValueError(f"no transverse Mercator zone for EPSG:{epsg}")
    return {"ellipsoid": WGS84, "lon0": 6.0 * zone - 183, "k0": 0.9996, "east0": 500_000.0, "north0": 10_000_000.0 if side == 327 else 0.0}


def _series(ellipsoid: tuple[float, float]) -> tuple[float, float, list[float], list[float]]:
    """Eccentricity, rectifying radius and the coefficients, to the fourth power of the third flattening, of
    the sine series between conformal and rectifying coordinates (there, back)."""
    a, inverse = ellipsoid
    f = 1 / inverse
    n = f / (2 - f)
    radius = a / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    there = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    return (f * (2 - f)) ** 0.5, radius, there, back


def transverse_mercator(lon, lat, epsg: int) -> tuple[Column, Column]:
    """Longitude and latitude to easting and northing in metres; a millimetre within a zone."""
    z = transverse_zone(epsg)
    e, radius, there, _ = _series(z["ellipsoid"])
    away, sine = F.radians(_col(lon) - z["lon0"]), F.sin(F.radians(_col(lat)))
    t = F.sinh(F.atanh(sine) - e * F.atanh(e * sine))
    xi, eta = F.atan2(t, F.cos(away)), F.atanh(F.sin(away) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, c in enumerate(there, 1):
        north, east = north + c * F.sin(2 * j * xi) * F.cosh(2 * j * eta), east + c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return z["east0"] + z["k0"] * radius * east, z["north0"] + z["k0"] * radius * north


def transverse_mercator_inverse(east, north, epsg: int) -> tuple[Column, Column]:
    z = transverse_zone(epsg)
    e, radius, _, back = _series(z["ellipsoid"])
    xi, eta = (_col(north) - z["north0"]) / (z["k0"] * radius), (_col(east) - z["east0"]) / (z["k0"] * radius)
    x, y = xi, eta
    for j, c in enumerate(back, 1):
        x, y = x - c * F.sin(2 * j * xi) * F.cosh(2 * j * eta), y - c * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    conformal = F.sin(x) / F.sqrt(F.sinh(y) * F.sinh(y) + F.cos(x) * F.cos(x))  # its tangent
    sine = conformal / F.sqrt(1 + conformal * conformal)
    for _ in range(4):  # the latitude whose conformal one this is; each step wins three digits
        sine = F.tanh(F.asinh(conformal) + e * F.atanh(e * sine))
    return z["lon0"] + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(F.asin(sine))


def sphere_point(lon, lat, radius: float = 1.0) -> Column:
    """The point on a sphere with y up."""
    phi, theta = F.radians(90 - _col(lat)), F.radians(_col(lon) + 180)
    return F.struct((-radius * F.sin(phi) * F.cos(theta)).alias("x"), (radius * F.cos(phi)).alias("y"), (radius * F.sin(phi) * F.sin(theta)).alias("z"))


def map_point(lon, lat, width: float, height: float, bounds: tuple[float, float, float, float]) -> Column:
    """Plate carree position in a ``width`` x ``height`` picture of (west, south, east, north)."""
    w, s, e, n = bounds
    return F.struct(((_col(lon) - w) / (e - w) * width).alias("x"), ((n - _col(lat)) / (n - s) * height).alias("y"))


def pretty_name(name) -> Column:
    bare = F.regexp_replace(_col(name), "(_rehab)?_trajectory$", "")
    return F.initcap(F.replace(bare, F.lit("_"), F.lit(" ")))

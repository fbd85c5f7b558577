"""Numbers and places: rounding, distances, local projection, bounding boxes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_RADIUS_M = 6_371_000.0
#: Origin and metres per degree of the local projection.
ORIGIN_LON, ORIGIN_LAT, METRES_PER_LON, METRES_PER_LAT = 12.5, 41.9, 82_800.0, 111_320.0


def rounded(x: Column, places: int) -> Column:
    """Half away from zero on the scaled double (I35); round(x, places) would round decimal digits."""
    scale = F.lit(float(10**places))
    return F.round(x * scale) / scale


def rounded_distance(x: Column, places: int) -> Column:
    """rounded() of numbers that are not negative, for pairs that are many: F.round goes by way of a decimal's text, which costs more than a distance."""
    y, scale = x * F.lit(float(10**places)), F.lit(float(10**places))
    even = F.rint(y)  # halves go to the even neighbour, which may be the lower one
    return F.when(y - even == F.lit(0.5), even + F.lit(1.0)).otherwise(even) / scale


def exact_sum(x: Column, places: int = 7) -> Column:
    """Sum of doubles as decimals of so many places: the same in whatever order rows come."""
    return F.sum(x.cast(f"decimal({19 + places},{places})")).cast("double")


def quantize(degrees: Column) -> Column:
    """Hundredths of a degree."""
    return F.round(degrees * F.lit(100.0)).cast("long")


def cos_degrees(x: Column) -> Column:
    return F.cos(F.radians(x))


def haversine_m(lon1: Column, lat1: Column, lon2: Column, lat2: Column, cos1: Column | None = None, cos2: Column | None = None) -> Column:
    """Metres between two places. cos1, cos2: cos_degrees() of the latitudes, where rows that meet many others have them already."""
    u, v = F.sin(F.radians(lat2 - lat1) / 2), F.sin(F.radians(lon2 - lon1) / 2)
    cos1, cos2 = (cos_degrees(lat) if c is None else c for lat, c in ((lat1, cos1), (lat2, cos2)))
    a = u * u + cos1 * cos2 * (v * v)
    return F.lit(2 * EARTH_RADIUS_M) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def to_metres(lon: Column, lat: Column) -> tuple[Column, Column]:
    return (lon - F.lit(ORIGIN_LON)) * F.lit(METRES_PER_LON), (lat - F.lit(ORIGIN_LAT)) * F.lit(METRES_PER_LAT)


def from_metres(x: Column, y: Column) -> tuple[Column, Column]:
    return rounded(F.lit(ORIGIN_LON) + x / F.lit(METRES_PER_LON), 7), rounded(F.lit(ORIGIN_LAT) + y / F.lit(METRES_PER_LAT), 7)


def dist2(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    return (x1 - x2) * (x1 - x2) + (y1 - y2) * (y1 - y2)


def parse_bbox(text: Column) -> Column:
    """min_lon, min_lat, max_lon, max_lat and area of four numbers; null if they are no box."""
    p = F.transform(F.split(text, ","), lambda x: F.trim(x).try_cast("double"))
    a, b, c, e = (F.get(p, k) for k in range(4))
    sound = (F.size(p) == 4) & a.between(-180, 180) & c.between(-180, 180) & b.between(-90, 90) & e.between(-90, 90) & (a < c) & (b < e)
    return F.when(sound, F.struct(a.alias("min_lon"), b.alias("min_lat"), c.alias("max_lon"), e.alias("max_lat"), ((c - a) * (e - b)).alias("area_deg2")))


def in_bbox(x: Column, y: Column, box: tuple[float, float, float, float]) -> Column:
    """Range predicates on plain columns, which the Parquet reader takes over."""
    return x.between(box[0], box[2]) & y.between(box[1], box[3])


def ring_area(xs: Column, ys: Column) -> Column:
    """Shoelace area of a ring given as two arrays."""
    n = F.size(xs)
    terms = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get(xs, i) * F.get(ys, (i + 1) % n) - F.get(xs, (i + 1) % n) * F.get(ys, i))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda a, b: a + b)) / 2

"""The national grid of the Netherlands to and from longitude and latitude, as polynomials of columns.

The published approximation of the transformation (Schreutelkamp and Strang van Hees, 2001) is a polynomial of the distance
to the grid's centre, good to some decimetres; the way there and back closes within a centimetre after one correction.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import let

# The centre in the grid (metres) and in longitude and latitude (degrees).
CENTRE_X, CENTRE_Y, CENTRE_LON, CENTRE_LAT = 155000.0, 463000.0, 5.38720621, 52.15517440
# Coefficients by powers of (dx, dy), each 100 km, in arc seconds of latitude and longitude.
TO_LAT = {
    (0, 1): 3235.65389, (2, 0): -32.58297, (0, 2): -0.24750, (2, 1): -0.84978, (0, 3): -0.06550, (2, 2): -0.01709,
    (1, 0): -0.00738, (4, 0): 0.00530, (2, 3): -0.00039, (4, 1): 0.00033, (1, 1): -0.00012,
}
TO_LON = {
    (1, 0): 5260.52916, (1, 1): 105.94684, (1, 2): 2.45656, (3, 0): -0.81885, (1, 3): 0.05594, (3, 1): -0.05607,
    (0, 1): 0.01199, (3, 2): -0.00256, (1, 4): 0.00128, (0, 2): 0.00022, (2, 0): -0.00022, (5, 0): 0.00026,
}
# Coefficients by powers of (dlat, dlon), each 10,000 arc seconds, in metres.
TO_X = {
    (0, 1): 190094.945, (1, 1): -11832.228, (2, 1): -114.221, (0, 3): -32.391, (1, 0): -0.705, (3, 1): -2.340,
    (1, 3): -0.608, (0, 2): -0.008, (2, 3): 0.148,
}
TO_Y = {
    (1, 0): 309056.544, (0, 2): 3638.893, (2, 0): 73.077, (1, 2): -157.984, (3, 0): 59.788, (0, 1): 0.433,
    (2, 2): -6.439, (1, 1): -0.032, (0, 4): 0.092, (1, 4): -0.054,
}


def _power(v: Column, n: int) -> Column:
    return reduce(Column.__mul__, [v] * n, F.lit(1.0))


def _polynomial(coefficients: dict[tuple[int, int], float], a: Column, b: Column) -> Column:
    return reduce(Column.__add__, (F.lit(c) * _power(a, p) * _power(b, q) for (p, q), c in coefficients.items()))


def from_national(x: Column, y: Column) -> Column:
    """(lon, lat) in degrees of a place on the national grid; null for null."""
    shift = F.struct(((x - CENTRE_X) / 1e5).alias("x"), ((y - CENTRE_Y) / 1e5).alias("y"))
    at = lambda d, of, centre: F.lit(centre) + _polynomial(of, d["x"], d["y"]) / 3600
    return let(shift, lambda d: F.struct(at(d, TO_LON, CENTRE_LON).alias("lon"), at(d, TO_LAT, CENTRE_LAT).alias("lat")))


def _approximate(lon: Column, lat: Column) -> Column:
    shift = F.struct(((lat - CENTRE_LAT) * 0.36).alias("lat"), ((lon - CENTRE_LON) * 0.36).alias("lon"))
    at = lambda d, of, centre: F.lit(centre) + _polynomial(of, d["lat"], d["lon"])
    return let(shift, lambda d: F.struct(at(d, TO_X, CENTRE_X).alias("x"), at(d, TO_Y, CENTRE_Y).alias("y")))


def to_national(lon: Column, lat: Column) -> Column:
    """(x, y) on the national grid in metres; null for null. The published polynomial, then one correction by what the way
    back misses, so it is the inverse of `from_national` within a centimetre."""

    def corrected(p: Column) -> Column:
        again = let(from_national(p["x"], p["y"]), lambda w: _approximate(w["lon"], w["lat"]))
        return let(again, lambda q: F.struct((p["x"] * 2 - q["x"]).alias("x"), (p["y"] * 2 - q["y"]).alias("y")))

    return let(_approximate(lon, lat), corrected)


def line_to_national(points: Column) -> Column:
    """A line of (x, y) in degrees on the national grid."""
    return F.transform(points, lambda p: to_national(p["x"], p["y"]))

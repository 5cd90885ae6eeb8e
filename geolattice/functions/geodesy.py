"""Geodesics on the WGS84 ellipsoid and transverse Mercator, as Column expressions.

Vincenty's formulae with a fixed number of iterations inside one aggregate, so a plan holds
each step once. Far from antipodes they settle in a few; where they do not, the result is NULL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 semi-major axis and flattening.
A = 6378137.0
FLAT = 1 / 298.257223563
B = A * (1 - FLAT)
STEPS = 20


def _let(value: Column, body) -> Column:
    """``body`` of ``value``, worked out once however often the body uses it."""
    return F.get(F.transform(F.array(value), body), 0)


def _series(u2: Column) -> tuple[Column, Column]:
    big = 1 + u2 / 16384 * (4096 + u2 * (-768 + u2 * (320 - 175 * u2)))
    small = u2 / 1024 * (256 + u2 * (-128 + u2 * (74 - 47 * u2)))
    return big, small


def _delta(small: Column, sin_s: Column, cos_s: Column, cos_2m: Column) -> Column:
    c2 = cos_2m * cos_2m
    return small * sin_s * (cos_2m + small / 4 * (cos_s * (-1 + 2 * c2) - small / 6 * cos_2m * (-3 + 4 * sin_s * sin_s) * (-3 + 4 * c2)))


def inverse(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    """struct(azimuth in degrees from the first point, distance in metres); equal points have azimuth and distance zero."""
    u1, u2 = F.atan((1 - FLAT) * F.tan(F.radians(lat1))), F.atan((1 - FLAT) * F.tan(F.radians(lat2)))
    around = F.radians(lng2 - lng1)
    s1, c1, s2, c2 = F.sin(u1), F.cos(u1), F.sin(u2), F.cos(u2)

    def parts(lam: Column) -> Column:
        """struct of what every step needs, each worked out once."""
        p, q = c2 * F.sin(lam), c1 * s2 - s1 * c2 * F.cos(lam)
        first = F.struct(p.alias("p"), q.alias("q"), F.sqrt(p * p + q * q).alias("sin_s"), (s1 * s2 + c1 * c2 * F.cos(lam)).alias("cos_s"), F.sin(lam).alias("sin_l"))
        second = _let(first, lambda x: F.struct(x["p"].alias("p"), x["q"].alias("q"), x["sin_s"].alias("sin_s"), x["cos_s"].alias("cos_s"), F.when(x["sin_s"] == 0, 0.0).otherwise(c1 * c2 * x["sin_l"] / x["sin_s"]).alias("sin_a")))

        def third(x: Column) -> Column:
            cos2_a = 1 - x["sin_a"] * x["sin_a"]
            return F.struct(x["p"].alias("p"), x["q"].alias("q"), x["sin_s"].alias("sin_s"), x["cos_s"].alias("cos_s"), x["sin_a"].alias("sin_a"), cos2_a.alias("cos2_a"), F.when(cos2_a == 0, 0.0).otherwise(x["cos_s"] - 2 * s1 * s2 / cos2_a).alias("cos_2m"), F.atan2(x["sin_s"], x["cos_s"]).alias("sigma"))

        return _let(second, third)

    def step(acc: Column, _: Column) -> Column:
        def moved(x: Column) -> Column:
            c = FLAT / 16 * x["cos2_a"] * (4 + FLAT * (4 - 3 * x["cos2_a"]))
            return around + (1 - c) * FLAT * x["sin_a"] * (x["sigma"] + c * x["sin_s"] * (x["cos_2m"] + c * x["cos_s"] * (-1 + 2 * x["cos_2m"] * x["cos_2m"])))

        return _let(_let(parts(acc["lam"]), moved), lambda lam: F.struct(lam.alias("lam"), F.abs(lam - acc["lam"]).alias("moved")))

    def finish(acc: Column) -> Column:
        def ends(x: Column) -> Column:
            big, small = _series(x["cos2_a"] * (A * A - B * B) / (B * B))
            distance = B * big * (x["sigma"] - _delta(small, x["sin_s"], x["cos_s"], x["cos_2m"]))
            azimuth = F.when(x["sin_s"] == 0, 0.0).otherwise(F.degrees(F.atan2(x["p"], x["q"])))
            return F.struct(azimuth.alias("azimuth"), distance.alias("distance"))

        return F.when(acc["moved"] < 1e-9, _let(parts(acc["lam"]), ends))

    start = F.struct(around.alias("lam"), F.lit(1.0).cast("double").alias("moved"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step, finish)


def direct(lat: Column, lng: Column, azimuth: Column, distance: Column) -> Column:
    """struct(lat, lng) reached from a point by azimuth in degrees and distance in metres."""
    a1 = F.radians(azimuth)
    tan_u = (1 - FLAT) * F.tan(F.radians(lat))
    cos_u = 1 / F.sqrt(1 + tan_u * tan_u)
    sin_u = tan_u * cos_u
    s1 = F.atan2(tan_u, F.cos(a1))
    sin_a = cos_u * F.sin(a1)
    cos2_a = 1 - sin_a * sin_a
    big, small = _series(cos2_a * (A * A - B * B) / (B * B))
    first = distance / (B * big)

    def step(s: Column, _: Column) -> Column:
        return first + _delta(small, F.sin(s), F.cos(s), F.cos(2 * s1 + s))

    def finish(s: Column) -> Column:
        sin_s, cos_s, cos_2m = F.sin(s), F.cos(s), F.cos(2 * s1 + s)
        t = sin_u * sin_s - cos_u * cos_s * F.cos(a1)
        lat2 = F.atan2(sin_u * cos_s + cos_u * sin_s * F.cos(a1), (1 - FLAT) * F.sqrt(sin_a * sin_a + t * t))
        lam = F.atan2(sin_s * F.sin(a1), cos_u * cos_s - sin_u * sin_s * F.cos(a1))
        c = FLAT / 16 * cos2_a * (4 + FLAT * (4 - 3 * cos2_a))
        around = lam - (1 - c) * FLAT * sin_a * (s + c * sin_s * (cos_2m + c * cos_s * (-1 + 2 * cos_2m * cos_2m)))
        return F.struct(F.degrees(lat2).alias("lat"), (lng + F.degrees(around)).alias("lng"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), first, step, finish)


def relative_position(lat1, lng1, alt1, azn1, lat2, lng2, alt2) -> Column:
    """Position of camera 2 in the frame of camera 1: x right, y down, z ahead."""
    g = inverse(lat1, lng1, lat2, lng2)
    theta = F.radians(90 - (g["azimuth"] - azn1))
    return F.array(F.cos(theta) * g["distance"], -(alt2 - alt1), F.sin(theta) * g["distance"])


#: Third flattening and the Krueger coefficients built from it.
_N = FLAT / (2 - FLAT)
_RADIUS = A / (1 + _N) * (1 + _N**2 / 4 + _N**4 / 64)
_ALPHA = (
    _N / 2 - 2 * _N**2 / 3 + 5 * _N**3 / 16,
    13 * _N**2 / 48 - 3 * _N**3 / 5,
    61 * _N**3 / 240,
)
_BETA = (
    _N / 2 - 2 * _N**2 / 3 + 37 * _N**3 / 96,
    _N**2 / 48 + _N**3 / 15,
    17 * _N**3 / 480,
)
_DELTA = (
    2 * _N - 2 * _N**2 / 3 - 2 * _N**3,
    7 * _N**2 / 3 - 8 * _N**3 / 5,
    56 * _N**3 / 15,
)
K0, EAST = 0.9996, 500000.0


def utm_forward(lat: Column, lng: Column, zone: int) -> Column:
    """struct(east, north) in a northern UTM zone."""
    e = 2 * _N**0.5 / (1 + _N)
    phi, lam = F.radians(lat), F.radians(lng - (zone * 6 - 183))
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, 1):
        x = x + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    return F.struct((EAST + K0 * _RADIUS * x).alias("east"), (K0 * _RADIUS * y).alias("north"))


def utm_inverse(east: Column, north: Column, zone: int) -> Column:
    """struct(lat, lng) of a point in a northern UTM zone."""
    xi0, eta0 = north / (K0 * _RADIUS), (east - EAST) / (K0 * _RADIUS)
    xi, eta = xi0, eta0
    for j, b in enumerate(_BETA, 1):
        xi = xi - b * F.sin(2 * j * xi0) * F.cosh(2 * j * eta0)
        eta = eta - b * F.cos(2 * j * xi0) * F.sinh(2 * j * eta0)
    chi = F.asin(F.sin(xi) / F.cosh(eta))
    phi = chi
    for j, d in enumerate(_DELTA, 1):
        phi = phi + d * F.sin(2 * j * chi)
    return F.struct(F.degrees(phi).alias("lat"), (F.degrees(F.atan2(F.sinh(eta), F.cos(xi))) + (zone * 6 - 183)).alias("lng"))

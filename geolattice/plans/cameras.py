"""Registered queries of camera algebra and geodesy over derived camera tables.

Relative poses are those of every camera to the one with id 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolattice.functions import camera, geodesy
from geolattice.plans.fixtures import CAMERAS, cameras


def _rounded(df: DataFrame, key: str, values: Column) -> DataFrame:
    """(key, pos, x): an array column, one row per entry, rounded."""
    return df.select(key, F.posexplode(camera.column(values)).alias("pos", "x")).select(key, "pos", (F.round("x", 6) + 0.0).alias("x"))


def _poses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(v, r, t, k): rotation about y by the azimuth, then a small tilt about x; a position on a grid."""
    c = cameras(spark, sf_dir)
    tilt = F.radians(F.col("entry_id") % 11)
    one, z = F.lit(1.0), F.lit(0.0)
    rx = F.array(one, z, z, z, F.cos(tilt), -F.sin(tilt), z, F.sin(tilt), F.cos(tilt))
    r = camera.matmul(rx, camera.rotation_y(F.col("azn")), 3, 3, 3)
    center = F.array((F.col("entry_id") % 25) * 2.0, F.col("alt") - 290, F.floor(F.col("entry_id") / 25) * 2.0)
    k = camera.intrinsics(F.col("w"), F.col("h"), F.col("fov"))
    made = c.select(F.col("entry_id").alias("v"), "w", "h", r.alias("r"), center.alias("c"), k.alias("k"))
    return made.select("v", "w", "h", "r", camera.translation_from_center(F.col("r"), F.col("c")).alias("t"), "k", "c")


def intrinsics_from_fov(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cameras(spark, sf_dir)
    return _rounded(c, "entry_id", camera.intrinsics(F.col("w"), F.col("h"), F.col("fov") - F.col("entry_id") % 30))


def camera_center(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_poses(spark, sf_dir), "v", camera.camera_center(F.col("r"), F.col("t")))


def projection_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_poses(spark, sf_dir), "v", camera.projection_matrix(F.col("k"), F.col("r"), F.col("t")))


def pose_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _poses(spark, sf_dir).withColumn("e", camera.column(camera.pose_matrix(F.col("r"), F.col("t"))))
    return _rounded(p, "v", F.concat(camera.rotation_of(F.col("e")), camera.translation_of(F.col("e"))))


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pose with the next one."""
    p = _poses(spark, sf_dir)
    nxt = p.select((F.col("v") - 1).alias("v"), F.col("r").alias("r2"), F.col("t").alias("t2"))
    return p.join(nxt, "v")


def relative_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pairs(spark, sf_dir)
    a, b, c, e = F.col("r"), F.col("t"), F.col("r2"), F.col("t2")
    return _rounded(d, "v", [*camera.relative_rotation(a, c), *camera.relative_translation(a, b, c, e)])


def rotation_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("v", F.round(camera.rotation_error(F.col("r"), F.col("r2")), 5).alias("deg"))


def pose_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    angle = camera.vector_angle(F.col("t"), F.col("t2"))
    return _pairs(spark, sf_dir).select("v", F.round(angle, 5).alias("t_deg"), F.round(camera.folded(angle), 5).alias("t_folded"))


def quat_to_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = cameras(spark, sf_dir).select(F.col("entry_id").alias("v"))
    q = [F.col("v") % 7 + 1.0, F.col("v") % 5 - 2.0, F.col("v") % 3 - 1.0, F.col("v") % 11 - 5.0]
    return _rounded(v, "v", camera.quaternion_to_matrix(*q))


def matrix_to_quat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_poses(spark, sf_dir), "v", camera.matrix_to_quaternion(F.col("r")))


def rotated_intrinsics(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _poses(spark, sf_dir)
    k = camera.scaled_intrinsics(F.col("k"), F.lit(2.0), F.lit(1.6))
    return _rounded(p, "v", camera.rotated_intrinsics(k, F.lit(320.0), F.lit(400.0), F.col("v").cast("int")))


def epipolar_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _pairs(spark, sf_dir)
    x = [(F.col("v") % 13 - 6) / 10.0, (F.col("v") % 7 - 3) / 10.0, (F.col("v") % 9 - 4) / 10.0, (F.col("v") % 5 - 2) / 10.0]
    t = F.array(F.lit(1.0), F.lit(0.5), (F.col("v") % 4) / 4.0)
    return d.select("v", F.round(camera.epipolar_error(*x, F.col("r"), t), 6).alias("err"))


def intrinsics_rescale(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    w, h = F.col("p_partkey") % 2000 + 1, F.col("p_size") * 37 + 5
    return p.select("p_partkey", camera.downscaled(w, h, 640).alias("s")).select("p_partkey", F.round("s.scale", 6).alias("scale"), "s.w", "s.h")


def _anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cameras(spark, sf_dir)
    first = c.filter("entry_id = 0").select(*[F.col(x).alias(f"{x}0") for x in ("lat", "lng", "alt", "azn")])
    return c.join(F.broadcast(first))  # one row


def geodesic_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _anchor(spark, sf_dir).withColumn("g", geodesy.inverse(F.col("lat0"), F.col("lng0"), F.col("lat"), F.col("lng")))
    return d.select("entry_id", F.round("g.azimuth", 5).alias("azimuth"), F.round("g.distance", 4).alias("distance"))


def relative_extrinsic(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = geodesy.relative_position(F.col("lat0"), F.col("lng0"), F.col("alt0"), F.col("azn0"), F.col("lat"), F.col("lng"), F.col("alt"))
    d = _anchor(spark, sf_dir).select("entry_id", c.alias("c"), camera.rotation_y(F.col("azn0") - F.col("azn")).alias("r"))
    out = d.select("entry_id", F.posexplode(F.concat("r", camera.column(camera.translation_from_center(F.col("r"), F.col("c"))))).alias("pos", "x"))
    return out.select("entry_id", "pos", (F.round("x", 4) + 0.0).alias("x"))


def turned_pose(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Poses turned about the optical axis by quarter turns."""
    v = F.col("entry_id")
    e = camera.Matrix([*[(v % 7 + i).cast("double") for i in range(8)], *[F.lit(0.0)] * 3, v.cast("double"), *[F.lit(x) for x in (0.0, 0.0, 0.0, 1.0)]])
    return cameras(spark, sf_dir).select("entry_id", F.posexplode(camera.column(camera.turned_pose(e, v))).alias("pos", "x")).select("entry_id", "pos", (F.col("x") + 0.0).alias("x"))


def pose_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of rotations about one axis and of translations in a plane."""
    v = F.col("entry_id")
    a, b = F.radians((v % 23 * 15 + 7).cast("double")), F.lit(0.0)
    err = camera.pose_errors(camera.rotation_y(b), [F.lit(1.0), F.lit(0.0), F.lit(0.0)], camera.rotation_y((v % 17 * 10 + 5).cast("double")), [2 * F.cos(a), F.lit(0.0), 2 * F.sin(a)])
    return cameras(spark, sf_dir).select("entry_id", err.alias("e")).select("entry_id", F.round("e.t_err", 5).alias("t_err"), F.round("e.r_err", 5).alias("r_err"))


def resized_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = spark.read.parquet(f"{sf_dir}/part.parquet")
    w, h = F.col("p_partkey") % 2000 + 1, F.col("p_size") * 37 + 5
    return p.select("p_partkey", camera.resized(w, h, (500,)).alias("s"), camera.resized(w, h, (-1,)).alias("k"), camera.resized(w, h, (64, 48)).alias("x")).select("p_partkey", "s.w", "s.h", F.col("k.w").alias("kept"), F.col("x.h").alias("exact"))


def geodesic_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Jitters every camera by a distance and azimuth derived from its id."""
    g = geodesy.direct(F.col("lat"), F.col("lng"), (F.col("entry_id") * 37 % 360).cast("double"), 1.0 + F.col("entry_id") % 50)
    return cameras(spark, sf_dir).select("entry_id", g.alias("g")).select("entry_id", F.round("g.lat", 9).alias("lat"), F.round("g.lng", 9).alias("lng"))


def utm_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = geodesy.utm_forward(F.col("lat"), F.col("lng"), 35)
    return cameras(spark, sf_dir).select("entry_id", u.alias("u")).select("entry_id", F.round("u.east", 4).alias("east"), F.round("u.north", 4).alias("north"))


QUERIES = {
    f.__name__: f
    for f in (
        intrinsics_from_fov, camera_center, projection_matrix, pose_round_trip, relative_pose, rotation_error, pose_error, quat_to_matrix,
        matrix_to_quat, rotated_intrinsics, epipolar_error, intrinsics_rescale, geodesic_inverse, relative_extrinsic, geodesic_direct, utm_forward,
        turned_pose, pose_errors, resized_images,
    )
}


def _mul(a: str, b: str, n: int, k: int, m: int) -> str:
    return "[" + ", ".join(" + ".join(f"{a}[{r * k + i + 1}] * {b}[{i * m + c + 1}]" for i in range(k)) for r in range(n) for c in range(m)) + "]"


_R = "[{r}[1], {r}[4], {r}[7], {r}[2], {r}[5], {r}[8], {r}[3], {r}[6], {r}[9]]"
_POSES = f"""
cams AS ({CAMERAS}),
p0 AS (SELECT entry_id AS v, w, h, radians(entry_id % 11) AS ta, radians(azn) AS ya, [(entry_id % 25) * 2e0, alt - 290, floor(entry_id / 25e0) * 2] AS c, 320 / tan(radians(45e0)) AS f FROM cams),
p1 AS (SELECT *, [1e0, 0, 0, 0, cos(ta), -sin(ta), 0, sin(ta), cos(ta)] AS rx, [cos(ya), 0, sin(ya), 0, 1, 0, -sin(ya), 0, cos(ya)] AS ry, [f, 0, 320, 0, f, 320, 0, 0, 1] AS k FROM p0),
p2 AS (SELECT *, {_mul('rx', 'ry', 3, 3, 3)} AS r FROM p1),
p3 AS (SELECT *, {_mul('r', 'c', 3, 3, 1)} AS rc, {_R.format(r='r')} AS rt FROM p2),
poses AS (SELECT *, [-rc[1], -rc[2], -rc[3]] AS t FROM p3),
pairs AS (SELECT a.*, b.r AS r2, b.t AS t2 FROM poses a JOIN poses b ON b.v = a.v + 1)
"""


def _long(source: str, key: str, values: str, n: int, digits: int = 6) -> str:
    return f"SELECT {key}, CAST(i - 1 AS INTEGER) AS pos, round(({values})[i], {digits}) + 0e0 AS x FROM {source}, range(1, {n + 1}) g(i)"


def _clip(x: str) -> str:
    return f"degrees(acos(greatest(-1e0, least(1e0, {x}))))"


_TRACE = " + ".join(f"r[{i}] * r2[{i}]" for i in range(1, 10))
_TANGLE = _clip("list_inner_product(t, t2) / (sqrt(list_inner_product(t, t)) * sqrt(list_inner_product(t2, t2)))")
_SAFE = f"CASE WHEN list_inner_product(t, t) > 0 AND list_inner_product(t2, t2) > 0 THEN {_TANGLE} END"


def _vincenty() -> str:
    f, a, b = repr(geodesy.FLAT), repr(geodesy.A), repr(geodesy.B)
    out = [
        f"c0 AS ({CAMERAS})",
        "c1 AS (SELECT c.*, o.lat AS lat0, o.lng AS lng0, o.alt AS alt0, o.azn AS azn0 FROM c0 c, c0 o WHERE o.entry_id = 0)",
        f"v0 AS (SELECT *, atan((1 - {f}) * tan(radians(lat0))) AS u1, atan((1 - {f}) * tan(radians(lat))) AS u2, radians(lng - lng0) AS l, radians(lng - lng0) AS lam FROM c1)",
    ]
    for i in range(8):
        out += [
            f"x{i} AS (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM v{i})",
            f"y{i} AS (SELECT *, CASE WHEN ss = 0 THEN 0e0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM x{i})",
            f"z{i} AS (SELECT *, 1 - sa * sa AS ca, cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) AS cm FROM y{i})",
            f"w{i} AS (SELECT *, {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) AS cc FROM z{i})",
            f"v{i + 1} AS (SELECT entry_id, lat, lng, alt, azn, lat0, lng0, alt0, azn0, u1, u2, l, l + (1 - cc) * {f} * sa * (atan2(ss, cs) + cc * ss * (cm + cc * cs * (-1 + 2 * cm * cm))) AS lam FROM w{i})",
        ]
    n = 8
    out += [
        f"x{n} AS (SELECT *, sqrt(pow(cos(u2) * sin(lam), 2) + pow(cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam), 2)) AS ss, sin(u1) * sin(u2) + cos(u1) * cos(u2) * cos(lam) AS cs FROM v{n})",
        f"y{n} AS (SELECT *, CASE WHEN ss = 0 THEN 0e0 ELSE cos(u1) * cos(u2) * sin(lam) / ss END AS sa FROM x{n})",
        f"z{n} AS (SELECT *, cs - 2 * sin(u1) * sin(u2) / (1 - sa * sa) AS cm, (1 - sa * sa) * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS uu FROM y{n})",
        f"k AS (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS ka, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS kb FROM z{n})",
        f"""geo AS (SELECT *, CASE WHEN ss = 0 THEN 0e0 ELSE degrees(atan2(cos(u2) * sin(lam), cos(u1) * sin(u2) - sin(u1) * cos(u2) * cos(lam))) END AS azimuth,
 {b} * ka * (atan2(ss, cs) - kb * ss * (cm + kb / 4 * (cs * (-1 + 2 * cm * cm) - kb / 6 * cm * (-3 + 4 * ss * ss) * (-3 + 4 * cm * cm)))) AS distance FROM k)""",
    ]
    return ",\n".join(out)


def _utm() -> str:
    n, radius = geodesy._N, geodesy._RADIUS
    e = 2 * n**0.5 / (1 + n)
    x = " + ".join(["eta", *[f"{a!r} * cos({2 * j} * xi) * sinh({2 * j} * eta)" for j, a in enumerate(geodesy._ALPHA, 1)]])
    y = " + ".join(["xi", *[f"{a!r} * sin({2 * j} * xi) * cosh({2 * j} * eta)" for j, a in enumerate(geodesy._ALPHA, 1)]])
    return f"""WITH c AS ({CAMERAS}), a AS (SELECT entry_id, radians(lng - 27) AS lam, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) AS t FROM c),
b AS (SELECT entry_id, atan2(t, cos(lam)) AS xi, atanh(sin(lam) / sqrt(1 + t * t)) AS eta FROM a)
SELECT entry_id, round(500000 + {0.9996 * radius!r} * ({x}), 4) AS east, round({0.9996 * radius!r} * ({y}), 4) AS north FROM b"""


def _direct() -> str:
    f, a, b = repr(geodesy.FLAT), repr(geodesy.A), repr(geodesy.B)
    delta = "kb * sin(s) * (cos(2 * s1 + s) + kb / 4 * (cos(s) * (-1 + 2 * pow(cos(2 * s1 + s), 2)) - kb / 6 * cos(2 * s1 + s) * (-3 + 4 * pow(sin(s), 2)) * (-3 + 4 * pow(cos(2 * s1 + s), 2))))"
    steps = [f"s{i + 1} AS (SELECT * REPLACE (s0v + {delta} AS s) FROM s{i})" for i in range(8)]
    return f"""WITH c AS (SELECT *, radians(entry_id * 37 % 360) AS a1, 1e0 + entry_id % 50 AS dist, (1 - {f}) * tan(radians(lat)) AS tu FROM ({CAMERAS})),
d AS (SELECT *, 1 / sqrt(1 + tu * tu) AS cu, tu / sqrt(1 + tu * tu) AS su, atan2(tu, cos(a1)) AS s1 FROM c),
e AS (SELECT *, cu * sin(a1) AS sa, (1 - pow(cu * sin(a1), 2)) AS ca FROM d),
g AS (SELECT *, ca * ({a} * {a} - {b} * {b}) / ({b} * {b}) AS uu FROM e),
h AS (SELECT *, 1 + uu / 16384 * (4096 + uu * (-768 + uu * (320 - 175 * uu))) AS ka, uu / 1024 * (256 + uu * (-128 + uu * (74 - 47 * uu))) AS kb FROM g),
s0 AS (SELECT *, dist / ({b} * ka) AS s0v, dist / ({b} * ka) AS s, {f} / 16 * ca * (4 + {f} * (4 - 3 * ca)) AS cc FROM h), {", ".join(steps)}
SELECT entry_id, round(degrees(atan2(su * cos(s) + cu * sin(s) * cos(a1), (1 - {f}) * sqrt(sa * sa + pow(su * sin(s) - cu * cos(s) * cos(a1), 2)))), 9) AS lat,
round(lng + degrees(atan2(sin(s) * sin(a1), cu * cos(s) - su * sin(s) * cos(a1)) - (1 - cc) * {f} * sa * (s + cc * sin(s) * (cos(2 * s1 + s) + cc * cos(s) * (-1 + 2 * pow(cos(2 * s1 + s), 2))))), 9) AS lng FROM s8"""


_QUAT = "q AS (SELECT vec_id AS v, vec_id % 7 + 1e0 AS w, vec_id % 5 - 2e0 AS x, vec_id % 3 - 1e0 AS y, vec_id % 11 - 5e0 AS z FROM embeddings), s AS (SELECT *, 2 / (w * w + x * x + y * y + z * z) AS n FROM q)"
_QM = "[1 - n * (y * y + z * z), n * (x * y - z * w), n * (x * z + y * w), n * (x * y + z * w), 1 - n * (x * x + z * z), n * (y * z - x * w), n * (x * z - y * w), n * (y * z + x * w), 1 - n * (x * x + y * y)]"
_MQ = """m AS (SELECT v, r, sqrt(greatest(0, 1 + r[1] + r[5] + r[9])) / 2 AS w, sqrt(greatest(0, 1 + r[1] - r[5] - r[9])) / 2 AS x, sqrt(greatest(0, 1 - r[1] + r[5] - r[9])) / 2 AS y, sqrt(greatest(0, 1 - r[1] - r[5] + r[9])) / 2 AS z FROM poses),
q AS (SELECT v, CASE WHEN w >= x AND w >= y AND w >= z THEN [w, (r[8] - r[6]) / (4 * w), (r[3] - r[7]) / (4 * w), (r[4] - r[2]) / (4 * w)]
 WHEN x >= y AND x >= z THEN [(r[8] - r[6]) / (4 * x), x, (r[2] + r[4]) / (4 * x), (r[3] + r[7]) / (4 * x)]
 WHEN y >= z THEN [(r[3] - r[7]) / (4 * y), (r[2] + r[4]) / (4 * y), y, (r[6] + r[8]) / (4 * y)]
 ELSE [(r[4] - r[2]) / (4 * z), (r[3] + r[7]) / (4 * z), (r[6] + r[8]) / (4 * z), z] END AS q0 FROM m),
qq AS (SELECT v, CASE WHEN q0[1] < 0 THEN [-q0[1], -q0[2], -q0[3], -q0[4]] ELSE q0 END AS q FROM q)"""
_ROTK = """kk AS (SELECT v, f / 2 AS fx, f / 1.6e0 AS fy, 160e0 AS cx, 200e0 AS cy FROM poses),
rk AS (SELECT v, CASE v % 4 WHEN 0 THEN [fx, 0, cx, 0, fy, cy, 0, 0, 1] WHEN 1 THEN [fy, 0, cy, 0, fx, 319 - cx, 0, 0, 1] WHEN 2 THEN [fx, 0, 319 - cx, 0, fy, 399 - cy, 0, 0, 1] ELSE [fy, 0, 399 - cy, 0, fx, cx, 0, 0, 1] END AS k FROM kk)"""
_EPI = f"""ep AS (SELECT *, (v % 13 - 6) / 10e0 AS x0, (v % 7 - 3) / 10e0 AS y0, (v % 9 - 4) / 10e0 AS x1, (v % 5 - 2) / 10e0 AS y1, [0, -((v % 4) / 4e0), 0.5e0, (v % 4) / 4e0, 0, -1, -0.5e0, 1, 0] AS tx FROM pairs),
e1 AS (SELECT *, {_mul('tx', 'r', 3, 3, 3)} AS e FROM ep),
e2 AS (SELECT v, x1, y1, e[1] * x0 + e[2] * y0 + e[3] AS a, e[4] * x0 + e[5] * y0 + e[6] AS b, e[7] * x0 + e[8] * y0 + e[9] AS c, e[1] * x1 + e[4] * y1 + e[7] AS g, e[2] * x1 + e[5] * y1 + e[8] AS h FROM e1)"""

ORACLES = {
    "intrinsics_from_fov": f"WITH c AS ({CAMERAS}), k AS (SELECT entry_id, 640 / tan(radians((fov - entry_id % 30) / 2)) / 2 AS f FROM c) " + _long("k", "entry_id", "[f, 0, 320, 0, f, 320, 0, 0, 1]", 9),
    "camera_center": f"WITH {_POSES}, cc AS (SELECT v, {_mul('rt', 't', 3, 3, 1)} AS m FROM poses) " + _long("cc", "v", "[-m[1], -m[2], -m[3]]", 3),
    "projection_matrix": f"WITH {_POSES}, kk AS (SELECT v, {_mul('k', 'r', 3, 3, 3)} AS a, {_mul('k', 't', 3, 3, 1)} AS b FROM poses) " + _long("kk", "v", "[a[1], a[2], a[3], b[1], a[4], a[5], a[6], b[2], a[7], a[8], a[9], b[3]]", 12),
    "pose_round_trip": f"WITH {_POSES} " + _long("poses", "v", "list_concat(r, t)", 12),
    "relative_pose": f"WITH {_POSES}, a AS (SELECT v, t, t2, {_mul('r2', 'rt', 3, 3, 3)} AS m FROM pairs), b AS (SELECT v, m, t2, {_mul('m', 't', 3, 3, 1)} AS s FROM a) " + _long("b", "v", "list_concat(m, [t2[1] - s[1], t2[2] - s[2], t2[3] - s[3]])", 12),
    "rotation_error": f"WITH {_POSES} SELECT v, round({_clip(f'({_TRACE} - 1) / 2')}, 5) AS deg FROM pairs",
    "pose_error": f"WITH {_POSES}, a AS (SELECT v, {_SAFE} AS d FROM pairs) SELECT v, round(d, 5) AS t_deg, round(least(d, 180 - d), 5) AS t_folded FROM a",
    "quat_to_matrix": f"WITH {_QUAT} " + _long("s", "v", _QM, 9),
    "matrix_to_quat": f"WITH {_POSES}, {_MQ} " + _long("qq", "v", "q", 4),
    "rotated_intrinsics": f"WITH {_POSES}, {_ROTK} " + _long("rk", "v", "k", 9),
    "epipolar_error": f"WITH {_POSES}, {_EPI} SELECT v, round(pow(x1 * a + y1 * b + c, 2) * (1 / (a * a + b * b) + 1 / (g * g + h * h)), 6) AS err FROM e2",
    "intrinsics_rescale": """WITH p AS (SELECT p_partkey, p_partkey % 2000 + 1 AS w, p_size * 37 + 5 AS h FROM part), s AS (SELECT *, least(1e0, 640e0 / greatest(w, h)) AS scale FROM p)
SELECT p_partkey, round(scale, 6) AS scale, CAST(round_even(w * scale, 0) AS INTEGER) AS w, CAST(round_even(h * scale, 0) AS INTEGER) AS h FROM s""",
    "turned_pose": """WITH c AS (SELECT vec_id AS v, CASE vec_id % 4 WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS c, CASE vec_id % 4 WHEN 1 THEN -1 WHEN 3 THEN 1 ELSE 0 END AS s FROM embeddings)
SELECT v AS entry_id, CAST(i AS INTEGER) AS pos, (CASE WHEN i < 4 THEN c * (v % 7 + i) - s * (v % 7 + 4 + i) WHEN i < 8 THEN s * (v % 7 + i - 4) + c * (v % 7 + i) WHEN i = 11 THEN v WHEN i = 15 THEN 1 ELSE 0 END)::DOUBLE AS x FROM c, range(0, 16) g(i)""",
    "pose_errors": """WITH a AS (SELECT vec_id AS entry_id, vec_id % 23 * 15 + 7 AS t, vec_id % 17 * 10 + 5 AS r FROM embeddings), b AS (SELECT entry_id, CASE WHEN t > 180 THEN 360 - t ELSE t END AS t, r FROM a)
SELECT entry_id, round(least(t, 180 - t)::DOUBLE, 5) AS t_err, round(r::DOUBLE, 5) AS r_err FROM b""",
    "resized_images": """WITH p AS (SELECT p_partkey, p_partkey % 2000 + 1 AS w, p_size * 37 + 5 AS h FROM part)
SELECT p_partkey, CAST(round_even(w * (500e0 / greatest(w, h)), 0) AS INTEGER) AS w, CAST(round_even(h * (500e0 / greatest(w, h)), 0) AS INTEGER) AS h, CAST(w AS INTEGER) AS kept, CAST(48 AS INTEGER) AS exact FROM p""",
    "geodesic_inverse": f"WITH {_vincenty()} SELECT entry_id, round(azimuth, 5) AS azimuth, round(distance, 4) AS distance FROM geo",
    "relative_extrinsic": f"""WITH {_vincenty()}, ra AS (SELECT entry_id, radians(90 - (azimuth - azn0)) AS th, distance AS d, alt - alt0 AS up, radians(azn0 - azn) AS ya FROM geo),
rb AS (SELECT entry_id, [cos(th) * d, -up, sin(th) * d] AS c, [cos(ya), 0, sin(ya), 0, 1, 0, -sin(ya), 0, cos(ya)] AS r FROM ra), rd AS (SELECT entry_id, r, {_mul('r', 'c', 3, 3, 1)} AS m FROM rb) """
    + _long("rd", "entry_id", "list_concat(r, [-m[1], -m[2], -m[3]])", 12, 4),
    "geodesic_direct": _direct(),
    "utm_forward": _utm(),
}

"""Triangulation and pose fits: row-local or grouped NumPy over Arrow batches.

Triangulation is a batch of small null-space problems, solved row by row without a shuffle.
A pose fit sees one query's correspondences at a time; samples are drawn from a generator
seeded by the query's id, so results do not depend on partitions or retries.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# --- two views ------------------------------------------------------------------------------


def triangulate_points(p1: np.ndarray, p2: np.ndarray, x1: np.ndarray, x2: np.ndarray) -> np.ndarray:
    """Points (n, 3) from projections (n, 3, 4) and pixels (n, 2), by the direct linear method; points at infinity are not finite."""
    rows = np.stack([x1[:, :1] * p1[:, 2] - p1[:, 0], x1[:, 1:] * p1[:, 2] - p1[:, 1], x2[:, :1] * p2[:, 2] - p2[:, 0], x2[:, 1:] * p2[:, 2] - p2[:, 1]], axis=1)
    finite = np.isfinite(rows).all(axis=(1, 2))
    rows[~finite] = 0.0
    _, _, v = np.linalg.svd(rows)
    with np.errstate(divide="ignore", invalid="ignore"):
        points = v[:, 3, :3] / v[:, 3, 3:]
    points[~finite] = np.nan
    return points


def _triangulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        get = lambda name, *shape: np.array(batch.column(name).to_pylist(), dtype=float).reshape(-1, *shape)  # noqa: B023, E731
        points = triangulate_points(get("p1", 3, 4), get("p2", 3, 4), get("x1", 2), get("x2", 2))
        kept = [n for n in batch.schema.names if n not in ("p1", "p2", "x1", "x2")]
        yield pa.RecordBatch.from_arrays([*[batch.column(n) for n in kept], *[pa.array(points[:, i]) for i in range(3)]], names=[*kept, "x", "y", "z"])


def triangulate(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, z) from rows with projections p1, p2 (12 doubles) and pixels x1, x2 (2 doubles)."""
    schema = pairs.select(*keys).schema.add("x", "double").add("y", "double").add("z", "double")
    return pairs.select(*keys, "p1", "p2", "x1", "x2").mapInArrow(_triangulate, schema)


# --- perspective n points -------------------------------------------------------------------


def three_point_poses(world: np.ndarray, rays: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(R, T) stacks of all poses that put three world points (m, 3, 3) on three normalised image points (m, 3, 2).

    Grunert's method: with the distances of the points known, the distances from the camera are
    roots of a polynomial of degree four; each root gives the points in the camera's frame, and
    a rotation aligns the two triangles.
    """
    f = np.concatenate([rays, np.ones((*rays.shape[:2], 1))], axis=2)
    f /= np.linalg.norm(f, axis=2, keepdims=True)
    side = lambda i, j: ((world[:, i] - world[:, j]) ** 2).sum(axis=1)
    cosine = lambda i, j: (f[:, i] * f[:, j]).sum(axis=1)
    a2, b2, c2 = side(1, 2), side(0, 2), side(0, 1)
    ca, cb, cg = cosine(1, 2), cosine(0, 2), cosine(0, 1)
    with np.errstate(all="ignore"):
        p, q, c = (a2 - c2) / b2, (a2 + c2) / b2, c2 / b2
        a = a2 / b2
        quartic = np.stack(
            [
                (p - 1) ** 2 - 4 * c * ca**2,
                4 * (p * (1 - p) * cb - (1 - q) * ca * cg + 2 * c * ca**2 * cb),
                2 * (p**2 - 1 + 2 * p**2 * cb**2 + 2 * (1 - c) * ca**2 - 4 * q * ca * cb * cg + 2 * (1 - a) * cg**2),
                4 * (-p * (1 + p) * cb + 2 * a * cg**2 * cb - (1 - q) * ca * cg),
                (1 + p) ** 2 - 4 * a * cg**2,
            ],
            axis=1,
        )
        usable = np.isfinite(quartic).all(axis=1) & (np.abs(quartic[:, 0]) > 1e-12) & (b2 > 1e-18)
        quartic, p, ca, cb, cg, b2, f, world = quartic[usable], p[usable], ca[usable], cb[usable], cg[usable], b2[usable], f[usable], world[usable]
        companion = np.zeros((len(quartic), 4, 4))
        companion[:, 0] = -quartic[:, 1:] / quartic[:, :1]
        companion[:, 1, 0] = companion[:, 2, 1] = companion[:, 3, 2] = 1.0
        roots = np.linalg.eigvals(companion) if len(companion) else np.zeros((0, 4), complex)
        v = roots.real
        for _ in range(2):  # polished, as eigenvalues of near double roots are rough
            value = np.zeros_like(v)
            slope = np.zeros_like(v)
            for i in range(5):
                slope, value = slope * v + value, value * v + quartic[:, i : i + 1]
            v = np.where(np.abs(slope) > 1e-12, v - value / slope, v)
        p, ca, cb, cg, b2 = (x[:, None] for x in (p, ca, cb, cg, b2))
        u = ((p - 1) * v**2 - 2 * p * cb * v + 1 + p) / (2 * (cg - v * ca))
        s1 = np.sqrt(b2 / (1 + v**2 - 2 * v * cb))
        good = (np.abs(roots.imag) < 1e-4 * (1 + np.abs(roots.real))) & (v > 0) & (u > 0) & np.isfinite(s1) & np.isfinite(u)
        which, _ = np.nonzero(good)
        depth = np.stack([s1, u * s1, v * s1], axis=2)[good]
    seen, real = depth[:, :, None] * f[which], world[which]
    mid_seen, mid_real = seen.mean(axis=1), real.mean(axis=1)
    h = np.einsum("mni,mnj->mij", seen - mid_seen[:, None], real - mid_real[:, None])
    left, _, right = np.linalg.svd(h)
    flip = np.ones((len(h), 3))
    flip[:, 2] = np.sign(np.linalg.det(left) * np.linalg.det(right))
    r = np.einsum("mij,mj,mjk->mik", left, flip, right)
    return r, mid_seen - np.einsum("mij,mj->mi", r, mid_real)


def _rotation(w: np.ndarray) -> np.ndarray:
    angle = np.linalg.norm(w)
    k = np.array([[0, -w[2], w[1]], [w[2], 0, -w[0]], [-w[1], w[0], 0]])
    if angle < 1e-12:
        return np.eye(3) + k
    return np.eye(3) + np.sin(angle) / angle * k + (1 - np.cos(angle)) / angle**2 * k @ k


def refine_pose(r: np.ndarray, t: np.ndarray, world: np.ndarray, rays: np.ndarray, steps: int = 15) -> tuple[np.ndarray, np.ndarray]:
    """Gauss-Newton with damping on reprojection errors in normalised coordinates."""
    damp = 1e-6
    cost = lambda r, t: float((((world @ r.T + t)[:, :2] / (world @ r.T + t)[:, 2:] - rays) ** 2).sum())
    now = cost(r, t)
    for _ in range(steps):
        c = world @ r.T + t
        x, y, z = c.T
        e = (c[:, :2] / c[:, 2:] - rays).reshape(-1)
        j = np.zeros((2 * len(world), 6))
        d = np.stack([np.stack([1 / z, 0 * z, -x / z**2], 1), np.stack([0 * z, 1 / z, -y / z**2], 1)], 1)
        turned = world @ r.T
        cross = np.zeros((len(world), 3, 3))
        cross[:, 0, 1], cross[:, 0, 2], cross[:, 1, 2] = turned[:, 2], -turned[:, 1], turned[:, 0]
        cross -= cross.transpose(0, 2, 1)
        j[:, :3], j[:, 3:] = np.einsum("nij,njk->nik", d, cross).reshape(-1, 3), d.reshape(-1, 3)
        h = j.T @ j
        step = np.linalg.solve(h + damp * np.diag(np.diag(h) + 1e-12), -j.T @ e)
        r2, t2 = _rotation(step[:3]) @ r, t + step[3:]
        new = cost(r2, t2)
        if new < now:
            done = now - new < 1e-14 * max(now, 1e-12)
            r, t, now, damp = r2, t2, new, damp / 10
            if done:
                break
        else:
            damp *= 10
    return r, t


def robust_pose(world: np.ndarray, pixels: np.ndarray, k: np.ndarray, seed: int, threshold: float = 1.0, confidence: float = 0.999999, most: int = 10_000, batch: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(R, T, inliers) from four points or more by RANSAC over three-point samples, a batch at a time, refined on the inliers, or None."""
    n = len(world)
    if n < 4 or not np.isfinite(world).all():
        return None
    rays = (np.concatenate([pixels, np.ones((n, 1))], axis=1) @ np.linalg.inv(k).T)[:, :2]
    rng = np.random.default_rng(seed)

    def inliers(r: np.ndarray, t: np.ndarray) -> np.ndarray:
        c = np.einsum("mij,nj->mni", r, world) + t[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.einsum("ij,mnj->mni", k[:2], c / c[:, :, 2:])
        return (c[:, :, 2] > 0) & (np.hypot(p[:, :, 0] - pixels[:, 0], p[:, :, 1] - pixels[:, 1]) <= threshold)

    best, rounds, done = None, most, 0
    while done < rounds:
        pick = rng.random((batch, n)).argpartition(2, axis=1)[:, :3]
        done += batch
        r, t = three_point_poses(world[pick], rays[pick])
        if not len(r):
            continue
        good = inliers(r, t)
        top = int(good.sum(axis=1).argmax())
        if best is None or good[top].sum() > best[2].sum():
            best = r[top], t[top], good[top]
            if good[top].sum() >= 4:  # a better pose of the same support shortens the search
                finer = refine_pose(r[top], t[top], world[good[top]], rays[good[top]], 5)
                found = inliers(finer[0][None], finer[1][None])[0]
                if found.sum() >= good[top].sum():
                    best = (*finer, found)
            share = best[2].mean()
            rounds = min(most, int(np.ceil(np.log(1 - confidence) / np.log(1 - share**3 + 1e-15)))) if 0 < share < 1 else 0 if share == 1 else most
    if best is None or best[2].sum() < 4:
        return None
    for _ in range(3):
        good = best[2]
        model = refine_pose(best[0], best[1], world[good], rays[good])
        found = inliers(model[0][None], model[1][None])[0]
        if found.sum() < good.sum():
            break
        best = (*model, found)
    return best


_POSE_SCHEMA = "query_id long, status string, r array<double>, t array<double>, n_points int, n_inliers int"


def solve_poses(points: DataFrame, threshold: float = 1.0) -> DataFrame:
    """One row per query with its pose: (query_id, status, r, t, n_points, n_inliers).

    Points are (query_id, x, y, z, px, py, k array of 9). A query's points are bounded by its
    keypoints and reference pairs. status is "ok", "too few points" (under four) or "no model";
    r and t are NULL unless ok.
    """

    def fit(group: pa.Table) -> pa.Table:
        query = group.column("query_id")[0].as_py()
        order = np.lexsort([group.column(c).to_numpy() for c in ("z", "y", "x", "py", "px")])
        world = np.stack([group.column(c).to_numpy() for c in ("x", "y", "z")], axis=1)[order]
        pixels = np.stack([group.column(c).to_numpy() for c in ("px", "py")], axis=1)[order]
        keep = np.isfinite(world).all(axis=1) & np.isfinite(pixels).all(axis=1)
        world, pixels = world[keep], pixels[keep]
        status, found = "too few points", None
        if len(world) >= 4:
            found = robust_pose(world, pixels, np.array(group.column("k")[0].as_py()).reshape(3, 3), zlib.crc32(str(query).encode()), threshold)
            status = "ok" if found else "no model"
        r, t, n = (found[0].reshape(-1).tolist(), found[1].tolist(), int(found[2].sum())) if found else (None, None, 0)
        return pa.table({"query_id": pa.array([query], pa.int64()), "status": [status], "r": pa.array([r], pa.list_(pa.float64())), "t": pa.array([t], pa.list_(pa.float64())), "n_points": pa.array([len(world)], pa.int32()), "n_inliers": pa.array([n], pa.int32())})

    return points.select("query_id", "x", "y", "z", "px", "py", "k").groupBy("query_id").applyInArrow(fit, _POSE_SCHEMA)


# --- essential matrix -----------------------------------------------------------------------


def essential_from_points(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """Essential matrix from at least eight pairs of normalised points, singular values made (1, 1, 0)."""

    def conditioned(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, s = x.mean(axis=0), max(np.sqrt(((x - x.mean(axis=0)) ** 2).sum(axis=1)).mean(), 1e-12)
        m = np.array([[1 / s, 0, -c[0] / s], [0, 1 / s, -c[1] / s], [0, 0, 1]])
        return np.concatenate([x, np.ones((len(x), 1))], axis=1) @ m.T, m

    (ha, ma), (hb, mb) = conditioned(a), conditioned(b)
    _, s, v = np.linalg.svd(np.einsum("ni,nj->nij", hb, ha).reshape(len(a), 9))
    if len(s) > 7 and s[7] < 1e-10 * s[0]:
        return None
    e = mb.T @ v[-1].reshape(3, 3) @ ma
    u, _, w = np.linalg.svd(e)
    return u @ np.diag([1.0, 1.0, 0.0]) @ w


def recover_pose(e: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(R, unit T, in front): of the four decompositions that with most points before both cameras."""
    u, _, v = np.linalg.svd(e)
    u, v = u * np.sign(np.linalg.det(u)), v * np.sign(np.linalg.det(v))
    turn = np.array([[0.0, -1, 0], [1, 0, 0], [0, 0, 1]])
    best = None
    for r in (u @ turn @ v, u @ turn.T @ v):
        for t in (u[:, 2], -u[:, 2]):
            n = len(a)
            p = triangulate_points(np.broadcast_to(np.eye(3, 4), (n, 3, 4)), np.broadcast_to(np.column_stack([r, t]), (n, 3, 4)), a, b)
            front = (p[:, 2] > 0) & ((p @ r.T + t)[:, 2] > 0)
            if best is None or front.sum() > best[2].sum():
                best = (r, t, front)
    return best


def robust_relative_pose(a: np.ndarray, b: np.ndarray, seed: int, threshold: float = 1e-3, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(R, unit T, inliers) of the second view, by RANSAC over eight-point samples with Sampson distances, or None."""
    n = len(a)
    if n < 8:
        return None
    rng = np.random.default_rng(seed)
    ha, hb = (np.concatenate([x, np.ones((n, 1))], axis=1) for x in (a, b))

    def inliers(e: np.ndarray) -> np.ndarray:
        left, right = ha @ e.T, hb @ e
        return (hb * left).sum(axis=1) ** 2 / np.maximum(left[:, 0] ** 2 + left[:, 1] ** 2 + right[:, 0] ** 2 + right[:, 1] ** 2, 1e-18) < threshold**2

    best, most, i = None, 0, 0
    while i < rounds:
        i += 1
        pick = rng.choice(n, 8, replace=False)
        e = essential_from_points(a[pick], b[pick])
        if e is None:
            continue
        found = int(inliers(e).sum())
        if found > most:
            best, most = e, found
            share = found / n
            rounds = min(rounds, i) if share == 1 else min(rounds, int(np.ceil(np.log(1e-3) / np.log(1 - share**8 + 1e-15))) + 1)
    if best is None or inliers(best).sum() < 8:
        return None
    good = inliers(best)
    e = essential_from_points(a[good], b[good])
    if e is None or inliers(e).sum() < good.sum():
        e = best
    good = inliers(e)
    r, t, front = recover_pose(e, a[good], b[good])
    mask = np.zeros(n, dtype=bool)
    mask[np.flatnonzero(good)[front]] = True
    return r, t, mask


def two_view_poses(pairs: DataFrame) -> DataFrame:
    """One row per (query_id, ref_rank): (query_id, ref_rank, status, r, t, n_inliers) from normalised points (ax, ay, bx, by).

    The translation has unit length: its scale is open.
    """

    def fit(group: pa.Table) -> pa.Table:
        q, ref = group.column("query_id")[0].as_py(), group.column("ref_rank")[0].as_py()
        m = np.stack([group.column(c).to_numpy() for c in ("ax", "ay", "bx", "by")], axis=1)
        m = m[np.lexsort(m.T)]
        found = robust_relative_pose(m[:, :2], m[:, 2:], zlib.crc32(f"{q}:{ref}".encode()))
        r, t, n = (found[0].reshape(-1).tolist(), found[1].tolist(), int(found[2].sum())) if found else (None, None, 0)
        return pa.table({"query_id": pa.array([q], pa.int64()), "ref_rank": pa.array([ref], pa.int64()), "status": ["ok" if found else "no model"], "r": pa.array([r], pa.list_(pa.float64())), "t": pa.array([t], pa.list_(pa.float64())), "n_inliers": pa.array([n], pa.int32())})

    return pairs.select("query_id", "ref_rank", "ax", "ay", "bx", "by").groupBy("query_id", "ref_rank").applyInArrow(fit, "query_id long, ref_rank long, status string, r array<double>, t array<double>, n_inliers int")


def query_point_clouds(pairs: DataFrame, distance: float, threshold: float = 1e-3) -> DataFrame:
    """(query_id, ref_rank, kp_idx, x, y, z): points seen by a query and one reference, by their relative pose.

    Pairs are (query_id, ref_rank, kp_idx, ax, ay, bx, by, r array of 9, t array of 3) with
    normalised points of the query (a) and the reference (b) and the reference's pose. The
    relative translation has unit length, so the points are not to scale. Those farther than
    ``distance`` from the reference, and references without a relative pose, give no row.
    """
    names = ["query_id", "ref_rank", "kp_idx"]

    def fit(group: pa.Table) -> pa.Table:
        group = group.sort_by("kp_idx")
        a, b = (np.stack([group.column(c).to_numpy() for c in side], axis=1) for side in (("ax", "ay"), ("bx", "by")))
        q, ref = group.column("query_id")[0].as_py(), group.column("ref_rank")[0].as_py()
        found = robust_relative_pose(a, b, zlib.crc32(f"{q}:{ref}".encode()), threshold)
        if found is None:
            return pa.table({**{n: pa.array([], pa.int64()) for n in names}, **{n: pa.array([], pa.float64()) for n in "xyz"}})
        turn, shift, _ = found
        r, t = np.array(group.column("r")[0].as_py()).reshape(3, 3), np.array(group.column("t")[0].as_py())
        one, two = np.column_stack([turn.T @ r, turn.T @ (t - shift)]), np.column_stack([r, t])
        points = triangulate_points(np.broadcast_to(one, (len(a), 3, 4)), np.broadcast_to(two, (len(a), 3, 4)), a, b)
        near = np.linalg.norm(points + r.T @ t, axis=1) <= distance
        return pa.table({**{n: group.column(n).filter(pa.array(near)).cast(pa.int64()) for n in names}, **{n: pa.array(points[near, i]) for i, n in enumerate("xyz")}})

    schema = "query_id long, ref_rank long, kp_idx long, x double, y double, z double"
    return pairs.select(*names, "ax", "ay", "bx", "by", "r", "t").groupBy("query_id", "ref_rank").applyInArrow(fit, schema)


# --- lens distortion ------------------------------------------------------------------------


def undistort(x, y, dist, steps: int = 20):
    """struct(x, y): normalised coordinates freed of the five-parameter radial and tangential model by fixed-point steps."""
    k1, k2, p1, p2, k3 = (F.get(dist, i) for i in range(5))

    def step(acc, _):
        u, v = acc["x"], acc["y"]
        r2 = u * u + v * v
        radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
        dx, dy = 2 * p1 * u * v + p2 * (r2 + 2 * u * u), p1 * (r2 + 2 * v * v) + 2 * p2 * u * v
        return F.struct(((x - dx) / radial).alias("x"), ((y - dy) / radial).alias("y"))

    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), F.struct(x.alias("x"), y.alias("y")), step)


def straight_pixels(x, y, k, dist):
    """struct(x, y): pixels of a camera (k array of 9) freed of its lens distortion; NULL distortion leaves them as they are."""
    fx, cx, fy, cy = (F.get(k, i) for i in (0, 2, 4, 5))
    free = F.get(F.transform(F.array(undistort((x - cx) / fx, (y - cy) / fy, dist)), lambda u: F.struct((u["x"] * fx + cx).alias("x"), (u["y"] * fy + cy).alias("y"))), 0)
    return F.when(dist.isNotNull(), free).otherwise(F.struct(x.alias("x"), y.alias("y")))

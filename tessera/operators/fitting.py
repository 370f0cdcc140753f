"""Planes, spheres, cylinders and cones fitted to points and face normals, and their residuals."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np

KINDS = ("plane", "cylinder", "cone", "sphere")


@dataclass(frozen=True)
class Fit:
    """params: plane n, d; sphere centre, r; cylinder point, axis, r; cone apex, axis, half angle."""

    kind: str
    params: tuple[float, ...]
    rms: float
    most: float
    inliers: float


def distance(kind: str, q: tuple[float, ...], p: np.ndarray) -> np.ndarray:
    q = np.array(q)
    if kind == "plane":
        return np.abs(p @ q[:3] - q[3])
    if kind == "sphere":
        return np.abs(np.linalg.norm(p - q[:3], axis=1) - q[3])
    d = p - q[:3]
    along = d @ q[3:6]
    radial = np.linalg.norm(d - along[:, None] * q[3:6], axis=1)
    return np.abs(radial - q[6]) if kind == "cylinder" else np.abs(along * math.sin(q[6]) - radial * math.cos(q[6]))


def normals_of(kind: str, q: tuple[float, ...], p: np.ndarray) -> np.ndarray:
    """Outward normals of the primitive at the points."""
    q = np.array(q)
    if kind == "plane":
        return np.tile(q[:3], (len(p), 1))
    d = p - q[:3]
    if kind == "sphere":
        out = d
    else:
        out = d - (d @ q[3:6])[:, None] * q[3:6]
    n = np.linalg.norm(out, axis=1, keepdims=True)
    out = np.where(n > 1e-12, out / np.where(n > 1e-12, n, 1), [0.0, 0.0, 1.0])
    return out * math.cos(q[6]) - math.sin(q[6]) * q[3:6] if kind == "cone" else out


def _made(kind: str, q, p: np.ndarray) -> Fit:
    r = distance(kind, tuple(q), p)
    rms = float(np.sqrt((r * r).mean()))
    return Fit(kind, tuple(float(x) for x in q), rms, float(r.max()), float((r <= max(2 * rms, 1e-4)).mean()))


def _solve(a: np.ndarray, b: np.ndarray):
    """Gaussian elimination with pivoting; None where a pivot is below 1e-15."""
    m = np.concatenate((a.astype(float), b.reshape(-1, 1).astype(float)), 1)
    n = len(m)
    for k in range(n):
        best = k + int(np.argmax(np.abs(m[k:, k])))
        if abs(m[best, k]) < 1e-15:
            return None
        m[[k, best]] = m[[best, k]]
        m[k] /= m[k, k]
        for i in range(n):
            if i != k:
                m[i] -= m[i, k] * m[k]
    return m[:, n]


def fit_plane(p: np.ndarray):
    if len(p) < 3:
        return None
    c = p.mean(0)
    n = np.linalg.eigh((p - c).T @ (p - c))[1][:, 0]
    return _made("plane", (*n, n @ c), p)


def fit_sphere(p: np.ndarray):
    if len(p) < 4:
        return None
    a = np.concatenate((2 * p, np.ones((len(p), 1))), 1)
    x = _solve(a.T @ a, a.T @ (p * p).sum(1))
    if x is None or x[3] + x[:3] @ x[:3] <= 0:
        return None
    return _made("sphere", (*x[:3], math.sqrt(x[3] + x[:3] @ x[:3])), p)


def fit_cylinder(p: np.ndarray, n: np.ndarray):
    if len(p) < 6 or not len(n):
        return None
    axis = np.linalg.eigh(n.T @ n)[1][:, 0]
    u = np.cross(axis, np.eye(3)[0 if abs(axis[0]) < 0.9 else 1])
    u /= np.linalg.norm(u)
    v = np.cross(axis, u)
    c = p.mean(0)
    uv = np.stack(((p - c) @ u, (p - c) @ v), 1)
    a = np.concatenate((2 * uv, np.ones((len(p), 1))), 1)
    x = _solve(a.T @ a, a.T @ (uv * uv).sum(1))
    if x is None or x[2] + x[:2] @ x[:2] <= 0:
        return None
    return _made("cylinder", (*(c + x[0] * u + x[1] * v), *axis, math.sqrt(x[2] + x[:2] @ x[:2])), p)


def fit_cone(p: np.ndarray, n: np.ndarray):
    if len(p) < 6 or len(n) < 3:
        return None
    mean = n.mean(0)
    axis = np.linalg.eigh((n - mean).T @ (n - mean))[1][:, 0]
    s = abs(mean @ axis)
    if not 0.0871 < s < 0.9962:
        return None
    c = p.mean(0)
    along = (p - c) @ axis
    radial = np.linalg.norm((p - c) - along[:, None] * axis, axis=1)
    if ((along - along.mean()) * (radial - radial.mean())).sum() < 0:
        axis, along = -axis, -along
    half = math.asin(s)
    # every tangent plane holds the apex: n . x = n . apex; faces stand for it through the cone's own slope
    t = math.tan(half)
    a = np.concatenate((2 * (p - c), np.ones((len(p), 1))), 1)
    flat = (p - c) - along[:, None] * axis
    basis = np.linalg.svd(flat, full_matrices=False)[2][:2]
    uv = flat @ basis.T
    rows = np.concatenate((2 * uv, -2 * t * t * along[:, None], np.ones((len(p), 1))), 1)
    x = _solve(rows.T @ rows, rows.T @ ((uv * uv).sum(1) - t * t * along * along))
    del a
    if x is None:
        return None
    apex = c + x[0] * basis[0] + x[1] * basis[1] + x[2] * axis
    return _made("cone", (*apex, *axis, half), p)


def all_fits(p: np.ndarray, n: np.ndarray) -> list[Fit]:
    return [f for f in (fit_plane(p), fit_sphere(p), fit_cylinder(p, n), fit_cone(p, n)) if f is not None]


def best_fit(p: np.ndarray, n: np.ndarray) -> Fit:
    """The simplest kind whose residual is within a quarter of the best one and a thousandth of the region's diagonal."""
    fits = all_fits(p, n)
    if any(f.kind == "cylinder" for f in fits):
        fits = [f for f in fits if f.kind != "cone" or math.degrees(f.params[6]) >= 2.5]
    if not fits:
        return Fit("plane", (0.0, 0.0, 1.0, 0.0), math.inf, math.inf, 0.0)
    limit = 1.25 * min(f.rms for f in fits) + 1e-3 * float(np.linalg.norm(p.max(0) - p.min(0)))
    return min((f for f in fits if f.rms <= limit), key=lambda f: KINDS.index(f.kind))


def _solve_each(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """_solve() of many systems [K, n, n], [K, n]: (which have pivots, solutions)."""
    m = np.concatenate((a, b[:, :, None]), 2)
    each, ok = np.arange(len(m)), np.ones(len(m), bool)
    for k in range(m.shape[1]):
        best = k + np.abs(m[:, k:, k]).argmax(1)
        row = m[each, best]
        m[each, best] = m[:, k]
        ok &= np.abs(row[:, k]) >= 1e-15
        row = row / np.where(ok, row[:, k], 1)[:, None]
        m -= m[:, :, k, None] * row[:, None]
        m[:, k] = row
    return ok, m[:, :, -1]


def sampled_fits(p: np.ndarray, t: np.ndarray, n: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """(kind, which samples it fits, params [K, .]) in the order of all_fits(), for samples t [K, m, 3] of triangles with normals n [K, m, 3]."""
    at = np.sort(t.reshape(len(t), -1), 1)
    w = np.ones(at.shape)
    w[:, 1:] = at[:, 1:] != at[:, :-1]  # a shared corner counts once
    size, full = w.sum(1), n.shape[1]
    x = p[at]
    c = (x * w[:, :, None]).sum(1) / size[:, None]
    d = (x - c[:, None]) * w[:, :, None]
    one = w[:, :, None]
    dot = lambda u, v: np.einsum("kij,kj->ki", u, v)
    least = lambda u: np.linalg.eigh(u.transpose(0, 2, 1) @ u)[1][:, :, 0]

    def solved(a: np.ndarray, b: np.ndarray):
        return _solve_each(a.transpose(0, 2, 1) @ a, np.einsum("kij,ki->kj", a, b))

    normal = least(d)
    out = [("plane", size >= 3, np.concatenate((normal, (normal * c).sum(1)[:, None]), 1))]
    y = x * one
    ok, s = solved(np.concatenate((2 * y, one), 2), (y * y).sum(2))
    r2 = s[:, 3] + (s[:, :3] ** 2).sum(1)
    out.append(("sphere", ok & (size >= 4) & (r2 > 0), np.concatenate((s[:, :3], np.sqrt(np.maximum(r2, 0))[:, None]), 1)))
    axis = least(n)
    u = np.cross(axis, np.where(np.abs(axis[:, :1]) < 0.9, [[1.0, 0.0, 0.0]], [[0.0, 1.0, 0.0]]))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    v = np.cross(axis, u)
    uv = np.stack((dot(d, u), dot(d, v)), 2)
    ok, s = solved(np.concatenate((2 * uv, one), 2), (uv * uv).sum(2))
    r2 = s[:, 2] + (s[:, :2] ** 2).sum(1)
    out.append(("cylinder", ok & (size >= 6) & (r2 > 0), np.concatenate((c + s[:, :1] * u + s[:, 1:2] * v, axis, np.sqrt(np.maximum(r2, 0))[:, None]), 1)))
    mean = n.mean(1)
    axis = least(n - mean[:, None])
    slope = np.abs((mean * axis).sum(1))
    able = (size >= 6) & (full >= 3) & (0.0871 < slope) & (slope < 0.9962)
    along = dot(d, axis)
    radial = np.linalg.norm(d - along[:, :, None] * axis[:, None], axis=2)
    middle = lambda z: (z * w).sum(1, keepdims=True) / size[:, None]
    turn = np.where((w * (along - middle(along)) * (radial - middle(radial))).sum(1) < 0, -1.0, 1.0)[:, None]
    axis, along = axis * turn, along * turn
    half = np.arcsin(np.where(able, slope, 0.5))
    flat = d - along[:, :, None] * axis[:, None]
    basis = np.linalg.svd(flat, full_matrices=False)[2][:, :2]
    uv = flat @ basis.transpose(0, 2, 1)
    t2 = np.tan(half)[:, None] ** 2
    ok, s = solved(np.concatenate((2 * uv, (-2 * t2 * along)[:, :, None], one), 2), (uv * uv).sum(2) - t2 * along * along)
    apex = c + s[:, :1] * basis[:, 0] + s[:, 1:2] * basis[:, 1] + s[:, 2:3] * axis
    out.append(("cone", ok & able, np.concatenate((apex, axis, half[:, None]), 1)))
    return out


def holds(kind: str, q: np.ndarray, p: np.ndarray, n: np.ndarray, eps: float, least: float) -> np.ndarray:
    """[K, P]: whether points p with normals n lie within ``eps`` of each primitive of params q [K, .], their normals within the cosine ``least`` of its own."""
    if kind == "plane":
        return (np.abs(p @ q[:, :3].T - q[:, 3]).T <= eps) & (np.abs(q[:, :3] @ n.T) >= least)
    d = p[None] - q[:, None, :3]
    if kind == "sphere":
        out, far = d, np.sqrt((d * d).sum(2))
        gap = np.abs(far - q[:, 3:4])
    else:
        along = np.einsum("kpj,kj->kp", d, q[:, 3:6])
        out = d - along[:, :, None] * q[:, None, 3:6]
        far = np.sqrt((out * out).sum(2))
        half = q[:, 6:7]
        gap = np.abs(far - half) if kind == "cylinder" else np.abs(along * np.sin(half) - far * np.cos(half))
    turned = np.where(far > 1e-12, np.einsum("kpj,pj->kp", out, n) / np.where(far > 1e-12, far, 1), n[:, 2])
    if kind == "cone":
        turned = turned * np.cos(half) - np.sin(half) * (q[:, 3:6] @ n.T)
    return (gap <= eps) & (np.abs(turned) >= least)

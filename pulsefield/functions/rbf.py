"""Radial basis functions: numpy systems for one set of centres, and the kernel as a column expression."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from pulsefield.config import RBFKernel, RBFScheme

#: Systems with a larger condition number get a basic solution by pivoted QR.
SINGULAR = 1e13


def phi(kernel: RBFKernel, u: np.ndarray) -> np.ndarray:
    if kernel is RBFKernel.GAUSSIAN:
        return np.exp(-0.5 * u * u)
    if kernel is RBFKernel.MULTIQUADRIC:
        return -np.sqrt(1 + u * u)
    if kernel is RBFKernel.INVERSE_MULTIQUADRIC:
        return 1 / np.sqrt(1 + u * u)
    if kernel is RBFKernel.LINEAR:
        return -u
    if kernel is RBFKernel.CUBIC:
        return u**3
    return u * u * np.log(np.where(u > 0, u, 1.0))


def phi_column(kernel: RBFKernel | str, u: Column) -> Column:
    return {
        RBFKernel.GAUSSIAN: lambda: F.exp(-0.5 * u * u),
        RBFKernel.MULTIQUADRIC: lambda: -F.sqrt(1 + u * u),
        RBFKernel.INVERSE_MULTIQUADRIC: lambda: 1 / F.sqrt(1 + u * u),
        RBFKernel.LINEAR: lambda: -u,
        RBFKernel.CUBIC: lambda: u * u * u,
        RBFKernel.THIN_PLATE_SPLINE: lambda: F.when(u == 0, 0.0).otherwise(u * u * F.log(u)),
    }[RBFKernel(kernel)]()


def pivoted_solve(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A basic least-squares solution by column-pivoted Householder QR."""
    r, y, n = a.copy(), b.copy(), a.shape[1]
    perm, rank = np.arange(n), 0
    top = np.linalg.norm(r, axis=0).max(initial=0.0)
    for k in range(min(r.shape)):
        norms = np.linalg.norm(r[k:, k:], axis=0)
        j = k + int(norms.argmax())
        if norms[j - k] <= np.finfo(float).eps * n * top:
            break
        r[:, [k, j]], perm[[k, j]] = r[:, [j, k]], perm[[j, k]]
        v = r[k:, k].copy()
        v[0] += np.copysign(np.linalg.norm(v), v[0])
        v /= np.linalg.norm(v)
        r[k:, k:] -= 2 * np.outer(v, v @ r[k:, k:])
        y[k:] -= 2 * v * (v @ y[k:])
        rank += 1
    x = np.zeros(n)
    x[perm[:rank]] = np.linalg.solve(r[:rank, :rank], y[:rank]) if rank else 0
    return x


class System:
    """The bordered system of some centres (k, d); `constant` if they are one point."""

    def __init__(self, centers: np.ndarray, scheme: RBFScheme):
        if not len(centers):
            raise ValueError("rbf: need at least one center")
        self.centers, self.scheme = centers, scheme
        k, d = centers.shape
        span = float(np.linalg.norm(np.ptp(centers, axis=0)))
        self.constant = k == 1 or span == 0
        if self.constant:
            return
        self.per = scheme.shape / span
        degree = 0 if scheme.degree == 1 and k < d + 1 else scheme.degree
        self.tail_size = 0 if degree < 0 else 1 if degree == 0 else d + 1
        self.mean = centers.mean(0)
        p = self.tail(centers)
        self.a = np.block([[self.kernel(centers) + scheme.smoothing * np.eye(k), p], [p.T, np.zeros((self.tail_size,) * 2)]])

    def kernel(self, points: np.ndarray) -> np.ndarray:
        return phi(self.scheme.kernel, np.linalg.norm(points[:, None] - self.centers[None], axis=2) * self.per)

    def tail(self, points: np.ndarray) -> np.ndarray:
        return np.hstack([np.ones((len(points), 1)), (points - self.mean) * self.per])[:, : self.tail_size]

    def basis(self, points: np.ndarray) -> np.ndarray:
        return np.hstack([self.kernel(points), self.tail(points)])

    def solve(self, b: np.ndarray) -> np.ndarray:
        return np.linalg.solve(self.a, b) if np.linalg.cond(self.a) < SINGULAR else pivoted_solve(self.a, b)


def rbf_interpolate(values: np.ndarray, centers: np.ndarray, eval_points: np.ndarray, scheme: RBFScheme | None = None) -> np.ndarray:
    """The interpolant of (centers, values) at the points; one centre, or several at one place, give their mean."""
    values, centers, eval_points = (np.asarray(x, float) for x in (values, centers, eval_points))
    s = System(centers, scheme or RBFScheme())
    if values.shape != (len(centers),) or eval_points.ndim != 2 or eval_points.shape[1] != centers.shape[1]:
        raise ValueError("rbf_interpolate: values must be (k,), centers (k, d) and eval_points (m, d)")
    if s.constant:
        return np.full(len(eval_points), values.mean())
    return s.basis(eval_points) @ s.solve(np.append(values, np.zeros(s.tail_size)))


def rbf_functional(centers: np.ndarray, eval_point: np.ndarray, scheme: RBFScheme | None = None) -> np.ndarray:
    """Weights w with interpolant(eval_point) = w . values for any values."""
    centers, eval_point = np.asarray(centers, float), np.asarray(eval_point, float)
    s = System(centers, scheme or RBFScheme())
    if eval_point.shape != (centers.shape[1],):
        raise ValueError("rbf_functional: eval_point must be (d,)")
    return np.full(len(centers), 1 / len(centers)) if s.constant else s.solve(s.basis(eval_point[None])[0])[: len(centers)]


def rbf_functionals(centers: np.ndarray, scheme: RBFScheme) -> np.ndarray:
    """Weights (n, k) at the origin for n sets of centres (n, k, d), solved together; doubtful systems are solved one by one."""
    n, k, d = centers.shape
    out = np.full((n, k), 1 / k)
    span = np.linalg.norm(np.ptp(centers, axis=1), axis=1)
    rows = np.flatnonzero(span > 0) if k > 1 else np.zeros(0, int)
    if not len(rows):
        return out
    c, per = centers[rows], scheme.shape / span[rows]
    degree = 0 if scheme.degree == 1 and k < d + 1 else scheme.degree
    size = 0 if degree < 0 else 1 if degree == 0 else d + 1
    mean = c.mean(1, keepdims=True)
    tail = lambda p: np.concatenate([np.ones((*p.shape[:2], 1)), (p - mean) * per[:, None, None]], 2)[:, :, :size]
    a = np.zeros((len(c), k + size, k + size))
    a[:, :k, :k] = phi(scheme.kernel, np.linalg.norm(c[:, :, None] - c[:, None], axis=3) * per[:, None, None]) + scheme.smoothing * np.eye(k)
    a[:, :k, k:] = tail(c)
    a[:, k:, :k] = a[:, :k, k:].transpose(0, 2, 1)
    b = np.concatenate([phi(scheme.kernel, np.linalg.norm(c, axis=2) * per[:, None]), tail(np.zeros((len(c), 1, d)))[:, 0]], 1)
    try:
        inverse = np.linalg.inv(a)
        sure = np.linalg.norm(a, 1, (1, 2)) * np.linalg.norm(inverse, 1, (1, 2)) * a.shape[1] < SINGULAR
    except np.linalg.LinAlgError:
        sure = np.zeros(len(a), bool)
    if sure.any():
        out[rows[sure]] = np.linalg.solve(a[sure], b[sure][:, :, None])[:, :k, 0]
    for i in np.flatnonzero(~sure):
        out[rows[i]] = rbf_functional(c[i], np.zeros(d), scheme)
    return out

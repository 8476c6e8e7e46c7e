"""Kernel entries from field arrays: what runs inside one task, vectorised over targets and neighbours.

Fields (meshes, batches, samples, moments) are small beside the points, so a task holds them as arrays. The relational
pipeline of pulsefield.operators.predictions gives the same predictions as tables.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np

from pulsefield.config import EvalConfig, Frame, RBFScheme, Scaling, SymmetricCombine
from pulsefield.functions.rbf import rbf_functionals, rbf_interpolate
from pulsefield.functions.spd import spd_parts

#: How far outside a simplex a point may lie and still count as inside it.
INSIDE = 1e-12
#: Predictions that are held at a time.
SWEPT = 1 << 21


class MeshArrays:
    """A simplicial mesh (vertices (nv, d), cells (nc, d + 1)) with buckets of cells for point location.

    grid: squares a side of a structured unit square, where location is arithmetic and needs no buckets.
    """

    def __init__(self, vertices: np.ndarray, cells: np.ndarray, grid: int | None = None):
        self.vertices, self.cells, self.grid = np.asarray(vertices, float), np.asarray(cells, int), grid
        n, self.dim = self.vertices.shape
        if grid:
            return
        p = self.vertices[self.cells]
        self.affine = np.linalg.inv(np.concatenate([p, np.ones((*p.shape[:2], 1))], 2).transpose(0, 2, 1)) if len(p) else np.zeros((0, self.dim + 1, self.dim + 1))
        self.low = self.vertices.min(0) if n else np.zeros(self.dim)
        high = self.vertices.max(0) if n else np.ones(self.dim)
        self.side = np.full(self.dim, max(1, round(len(p) ** (1 / self.dim))))
        self.step = np.maximum((high - self.low) / self.side, 1e-300)
        pad = 1e-9 * (high - self.low)
        lo, hi = self.bucket(p.min(1) - pad), self.bucket(p.max(1) + pad)
        pairs = [(int(np.ravel_multi_index(at, self.side)), c) for c in range(len(p)) for at in np.ndindex(*(hi[c] - lo[c] + 1)) for at in [tuple(lo[c] + at)]]
        pairs.sort()
        keys = np.array([k for k, _ in pairs], int)
        self.members = np.array([c for _, c in pairs], int)
        self.start = np.searchsorted(keys, np.arange(self.side.prod() + 1))

    def bucket(self, points: np.ndarray) -> np.ndarray:
        return np.clip(np.floor((points - self.low) / self.step), 0, self.side - 1).astype(int)

    def locate(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Lowest containing cell of each point (-1: none) and barycentric coordinates there."""
        if self.grid:
            return self.locate_on_grid(points)
        cell, alpha = np.full(len(points), -1), np.zeros((len(points), self.dim + 1))
        key = np.ravel_multi_index(self.bucket(points).T, self.side) if len(points) else np.zeros(0, int)
        at, end = self.start[key], self.start[key + 1]
        todo = np.flatnonzero(at < end)
        one = np.concatenate([points, np.ones((len(points), 1))], 1)
        while len(todo):
            c = self.members[at[todo]]
            a = np.einsum("nij,nj->ni", self.affine[c], one[todo])
            ok = (a >= -INSIDE).all(1)
            cell[todo[ok]], alpha[todo[ok]] = c[ok], a[ok]
            at[todo] += 1
            todo = todo[~ok & (at[todo] < end[todo])]
        return cell, alpha


    def locate_on_grid(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n, (x, y) = self.grid, points.T
        off = (x < -INSIDE) | (x > 1 + INSIDE) | (y < -INSIDE) | (y > 1 + INSIDE)
        i, j = (np.clip(np.floor(z * n), 0, n - 1) for z in (x, y))
        u, v = x * n - i, y * n - j
        upper = v > u
        least, most = np.minimum(u, v), np.maximum(u, v)
        alpha = np.stack([1 - most, np.where(upper, u, most - least), np.where(upper, most - least, v)], 1)
        alpha[off] = 0
        cell = 2 * (j * n + i) + upper
        return np.where(off, -1, cell).astype(int), alpha

    def interpolate(self, z: np.ndarray, values: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows `of` of vertex values (r, nv) at the points z (d, n), 0 off the mesh, and which points are off it."""
        first, values = of * values.shape[1], values.ravel()
        if not self.grid:
            cell, alpha = self.locate(z.T)
            corners = self.cells[np.maximum(cell, 0)]
            return np.where(cell >= 0, sum(alpha[:, a] * values[first + corners[:, a]] for a in range(corners.shape[1])), 0.0), cell < 0
        n, (x, y) = self.grid, z
        off = (np.minimum(x, y) < -INSIDE) | (np.maximum(x, y) > 1 + INSIDE)
        a, b = x * n, y * n
        i, j = (np.minimum(np.maximum(np.floor(q), 0), n - 1) for q in (a, b))
        a -= i
        b -= j
        least, most = np.minimum(a, b), np.maximum(a, b)
        at = (j * (n + 1) + i).astype(np.intp) + first
        # Both triangles of a square have its low and its high corner; the third is at the right or above.
        got = (1 - most) * values.take(at) + (most - least) * values.take(at + np.where(b > a, n + 1, 1)) + least * values.take(at + (n + 2))
        got[off] = 0
        return got, off


def patterns(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct columns of a mask (k, n) as rows, and which of them each column is."""
    k = len(mask)
    if k > 16:
        got, which = np.unique(mask, axis=1, return_inverse=True)
        return got.T, which.ravel()
    code = sum((mask[a].astype(np.int64) << a for a in range(k)), np.zeros(mask.shape[1], np.int64))
    seen = np.flatnonzero(np.bincount(code))
    return (seen[:, None] >> np.arange(k) & 1).astype(bool), np.searchsorted(seen, code)


def quadratic(a: np.ndarray, z: np.ndarray) -> np.ndarray:
    """z' a z for a symmetric matrix and points (d, n), or matrices (d, d, n) one for each."""
    out = sum(a[e, e] * z[e] * z[e] for e in range(len(z)))
    return out + sum((2 * a[e, f] * z[e] * z[f] for e in range(len(z)) for f in range(e)), 0.0)


@dataclass
class FieldArrays:
    """Samples, their batches and the moment fields. Absent moments are None."""

    target: MeshArrays
    source: MeshArrays
    batches: np.ndarray
    batch_of: np.ndarray
    points: np.ndarray
    normalized: bool = True
    v: np.ndarray | None = None
    mu: np.ndarray | None = None
    sigma: np.ndarray | None = None
    field_v: np.ndarray | None = None
    field_mu: np.ndarray | None = None
    field_sigma: np.ndarray | None = None

    @cached_property
    def parts(self) -> dict[str, np.ndarray]:
        return spd_parts(self.sigma)

    @cached_property
    def field_w(self) -> np.ndarray:
        return spd_parts(self.field_sigma)["inv_sqrt"]

    def nearest_sample_distance(self, x: np.ndarray) -> np.ndarray:
        if not len(self.points):
            return np.full(len(x), np.inf)
        return np.sqrt(((x[:, None] - self.points[None]) ** 2).sum(2).min(1))

    def neighbours(self, x: np.ndarray, k: int) -> np.ndarray:
        """The k nearest samples of each point, nearest first, ties by sample."""
        d2 = ((x[:, None] - self.points[None]) ** 2).sum(2)
        return np.argsort(d2, axis=1, kind="stable")[:, :k]

    def at_sources(self, x: np.ndarray, c: EvalConfig) -> dict:
        """What predictions need of each source: informed, near, scale and the fields there."""
        near = self.neighbours(x, min(c.num_neighbors, len(self.points)))
        out = {"x": x, "near": near, "informed": np.ones(len(x), bool)}
        v = None
        if c.needs_fields:
            cell, alpha = self.source.locate(x)
            out["informed"] = cell >= 0
            at = self.source.cells[np.maximum(cell, 0)]
            if c.needs_v:
                v = (alpha * self.field_v[at]).sum(1)
            if c.needs_mu:
                out["mu"] = np.einsum("nk,nki->ni", alpha, self.field_mu[at])
            if c.needs_w:
                out["w"] = np.einsum("nk,nkij->nij", alpha, self.field_w[at])
        if c.scaling is Scaling.NONE:
            scale = self.v[near] if self.normalized else np.ones(near.shape)
        else:
            scale = np.broadcast_to(v[:, None], near.shape) if self.normalized else v[:, None] / self.v[near]
            if c.scaling is Scaling.VOLUME_DET:
                scale = scale * np.sqrt(self.parts["det"][near]) * np.abs(np.linalg.det(out["w"]))[:, None]
        return out | {"scale": scale}

    def sweep(self, y: np.ndarray, at: dict, i: int, c: EvalConfig) -> tuple[np.ndarray, np.ndarray]:
        """values and excluded (k, m) of source i over the targets, all neighbours at once on contiguous coordinates."""
        near, q, m = at["near"][i], np.ascontiguousarray(y.T), len(y)
        values, excluded = np.zeros((len(near), m)), np.zeros((len(near), m), bool)
        each = lambda p: p[near].T[:, :, None]
        if c.frame is Frame.IDENTITY:
            z = np.broadcast_to(q[:, None], (len(q), len(near), m))
        elif c.frame is Frame.TRANSLATION:
            z = (q - at["x"][i][:, None])[:, None] + each(self.points)
        elif c.frame is Frame.MEAN_TRANSLATION:
            z = (q - at["mu"][i][:, None])[:, None] + each(self.mu)
        else:
            white = at["w"][i] @ (q - at["mu"][i][:, None])
            z = each(self.mu) + np.einsum("kij,jm->ikm", self.parts["sqrt"][near], white)
        rows = np.arange(len(near) * m)
        if c.gated:
            if c.frame is Frame.WHITENED_AFFINE:
                inside = np.broadcast_to((white**2).sum(0) <= c.tau**2, values.shape)
            else:
                inside = quadratic(self.parts["inv"][near].transpose(1, 2, 0)[..., None], z - each(self.mu)) <= c.tau**2
            rows = np.flatnonzero(inside)
        if len(rows):
            who = rows // m
            got, excluded.ravel()[rows] = self.target.interpolate(z.reshape(len(z), -1).take(rows, axis=1), self.batches, self.batch_of[near][who])
            values.ravel()[rows] = at["scale"][i][who] * got
        return values, excluded

    def at_pairs(self, y: np.ndarray, at: dict, who: np.ndarray, c: EvalConfig) -> tuple[np.ndarray, np.ndarray]:
        """values and excluded (n, k) of pairs of a target and source who[n], all pairs at once."""
        near = at["near"][who]
        inside = np.ones(near.shape, bool)
        if c.frame is Frame.IDENTITY:
            z = np.broadcast_to(y[:, None], (*near.shape, y.shape[1]))
        elif c.frame is Frame.TRANSLATION:
            z = (y - at["x"][who])[:, None] + self.points[near]
        elif c.frame is Frame.MEAN_TRANSLATION:
            z = (y - at["mu"][who])[:, None] + self.mu[near]
        else:
            white = np.einsum("nij,nj->ni", at["w"][who], y - at["mu"][who])
            z = self.mu[near] + np.einsum("nkij,nj->nki", self.parts["sqrt"][near], white)
        if c.gated:
            if c.frame is Frame.WHITENED_AFFINE:
                inside[:] = ((white**2).sum(1) <= c.tau**2)[:, None]
            else:
                dz = z - self.mu[near]
                inside = np.einsum("nki,nkij,nkj->nk", dz, self.parts["inv"][near], dz) <= c.tau**2
        values, excluded = np.zeros(near.shape), np.zeros(near.shape, bool)
        n, k = np.nonzero(inside)
        cell, alpha = self.target.locate(z[n, k])
        excluded[n, k] = cell < 0
        corners = self.target.cells[np.maximum(cell, 0)]
        of = self.batch_of[near[n, k]]
        raw = sum(alpha[:, a] * self.batches[of, corners[:, a]] for a in range(corners.shape[1]))
        values[n, k] = np.where(cell >= 0, at["scale"][who[n], k] * raw, 0.0)
        return values, excluded

    def ellipsoids(self, x: np.ndarray, c: EvalConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Informed points, and centres (n, k, d) and shapes (n, k, d, d) of all points' unit-scale ellipsoids."""
        at = self.at_sources(x, c)
        near, d = at["near"], self.target.dim
        if c.frame is Frame.WHITENED_AFFINE:
            shape = np.tile(np.eye(d), (len(x), 1, 1, 1))
            live = at["informed"]
            shape[live, 0] = c.tau**2 * np.linalg.inv(at["w"][live] @ at["w"][live])
            return live, at["mu"][:, None], shape
        if c.frame is Frame.MEAN_TRANSLATION:
            center = np.broadcast_to(at["mu"][:, None], (*near.shape, d))
        else:
            center = self.mu[near] if c.frame is Frame.IDENTITY else x[:, None] + self.mu[near] - self.points[near]
        return at["informed"], center, c.tau**2 * self.sigma[near]

    def boxes(self, x: np.ndarray, c: EvalConfig) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which points have ellipsoids, and the lower and upper corners (n, d) of the boxes around them."""
        if not len(self.points) or not len(x):
            return np.zeros(len(x), bool), *np.zeros((2, len(x), self.target.dim))
        live, center, shape = self.ellipsoids(x, c)
        half = np.sqrt(np.diagonal(shape, axis1=2, axis2=3))
        return live, (center - half).min(1), (center + half).max(1)

    def reached(self, y: np.ndarray, x: np.ndarray, c: EvalConfig) -> np.ndarray:
        """Which points y lie in an ellipsoid of any of the points x."""
        hit = np.zeros(len(y), bool)
        if not len(self.points) or not len(x) or not len(y):
            return hit
        live, center, shape = self.ellipsoids(x, c)
        _, lo, hi = self.boxes(x[live], c)
        if not len(lo):
            return hit
        todo = np.flatnonzero(((y >= lo.min(0) - 1e-9) & (y <= hi.max(0) + 1e-9)).all(1))
        left, inverse = np.ascontiguousarray(y[todo].T), np.linalg.inv(shape)
        for i in np.flatnonzero(live):
            for a in range(center.shape[1]):
                inside = quadratic(inverse[i, a], left - center[i, a][:, None]) <= 1
                if inside.any():
                    hit[todo[inside]] = True
                    todo, left = todo[~inside], left[:, ~inside]
        return hit

    def reaching(self, x: np.ndarray, y: np.ndarray, c: EvalConfig) -> np.ndarray:
        """Which points x have an ellipsoid that any of the points y lies in."""
        hit = np.zeros(len(x), bool)
        if not len(self.points) or not len(x) or not len(y):
            return hit
        live, center, shape = self.ellipsoids(x, c)
        todo = np.flatnonzero(live)
        center, inverse = np.ascontiguousarray(center[todo].transpose(2, 1, 0)), np.ascontiguousarray(np.linalg.inv(shape[todo]).transpose(2, 3, 1, 0))
        for p in y:
            inside = (quadratic(inverse, p[:, None, None] - center) <= 1).any(0)
            if inside.any():
                hit[todo[inside]] = True
                todo, center, inverse = todo[~inside], center[:, :, ~inside], inverse[:, :, :, ~inside]
        return hit

    def support_ellipsoids(self, x: np.ndarray, c: EvalConfig) -> list[list[tuple[np.ndarray, np.ndarray]]]:
        """Unit-scale ellipsoids (centre, shape) outside of which each source's predictions are zero."""
        if not len(self.points):
            return [[] for _ in x]
        at = self.at_sources(x, c)
        out = []
        for i in range(len(x)):
            near = at["near"][i]
            if not at["informed"][i]:
                out.append([])
            elif c.frame is Frame.WHITENED_AFFINE:
                out.append([(at["mu"][i], c.tau**2 * np.linalg.inv(at["w"][i] @ at["w"][i]))])
            else:
                center = {Frame.IDENTITY: lambda s: self.mu[s], Frame.TRANSLATION: lambda s: x[i] + self.mu[s] - self.points[s], Frame.MEAN_TRANSLATION: lambda s: at["mu"][i]}[c.frame]
                out.append([(center(s), c.tau**2 * self.sigma[s]) for s in near])
        return out


@dataclass
class KernelArrays:
    """Kernel entries from a column field and, in symmetric mode, a row field."""

    col: FieldArrays
    row: FieldArrays | None
    config: EvalConfig
    rbf: RBFScheme
    duplicate_tol: float = 1e-7

    def one_sided(self, f: FieldArrays, y: np.ndarray, x: np.ndarray, wanted: np.ndarray | None = None) -> np.ndarray:
        """(targets, sources): one functional for each source and pattern of excluded neighbours, then dot products. Functionals
        of as many neighbours are solved together.

        wanted: which entries are asked for, by default all; the others stay 0.
        """
        out = np.zeros((len(y), len(x)))
        if not len(f.points) or not len(x) or not len(y):
            return out
        at, k = f.at_sources(x, self.config), min(self.config.num_neighbors, len(f.points))
        y, rows = np.asfortranarray(y), np.flatnonzero(at["informed"])
        step = max(1, SWEPT // (k * len(y)))
        for some in (rows[n : n + step] for n in range(0, len(rows), step)):
            swept, users = [], {}
            for i in some:
                mine = slice(None) if wanted is None else np.flatnonzero(wanted[:, i])
                if wanted is not None and not len(mine):
                    continue
                values, excluded = f.sweep(y[mine], at, i, self.config)
                # Entries by which of their neighbours are left.
                groups = [(np.ones(k, bool), None)]
                if excluded.any():
                    live = np.flatnonzero((values != 0).any(0))
                    masks, which = patterns(excluded[:, live])
                    groups = [(~mask, live[which == m]) for m, mask in enumerate(masks)]
                for kept, cols in groups:
                    users.setdefault(int(kept.sum()), []).append((i, kept))
                    swept.append((i, mine, kept, cols, values))
            weights = {}
            for of in users.values():
                who = np.array([i for i, _ in of])[:, None]
                left = np.array([np.flatnonzero(kept) for _, kept in of])
                got = rbf_functionals(f.points[at["near"][who, left]] - x[who], self.rbf)
                weights |= {(i, kept.tobytes()): w for (i, kept), w in zip(of, got, strict=True)}
            for i, mine, kept, cols, values in swept:
                w = weights[i, kept.tobytes()]
                if cols is None:
                    out[mine, i] = w @ values
                else:
                    out[cols if wanted is None else mine[cols], i] = w @ values[np.ix_(kept, cols)]
        return out

    def one_sided_pairs(self, f: FieldArrays, y: np.ndarray, x: np.ndarray, who: np.ndarray) -> np.ndarray:
        """Entries of pairs (y[n], x[who[n]]): functionals are solved together, one for each source and excluded pattern."""
        out = np.zeros(len(y))
        if not len(f.points) or not len(x) or not len(y):
            return out
        at = f.at_sources(x, self.config)
        rows = np.flatnonzero(at["informed"][who])
        values, excluded = f.at_pairs(y[rows], at, who[rows], self.config)
        live = np.flatnonzero((values != 0).any(1))
        if not len(live):
            return out
        k = values.shape[1]
        kept = ~excluded[live]
        weigh = np.zeros(kept.shape)
        patterns, pattern = np.unique(kept, axis=0, return_inverse=True)
        for p, keep in enumerate(patterns):
            mine = np.flatnonzero(pattern.ravel() == p)
            sources, which = np.unique(who[rows[live[mine]]], return_inverse=True)
            cols = np.flatnonzero(keep)
            w = np.zeros((len(sources), k))
            w[:, cols] = rbf_functionals(f.points[at["near"][sources][:, cols]] - x[sources][:, None], self.rbf)
            weigh[mine] = w[which]
        out[rows[live]] = (weigh * values[live]).sum(1)
        return out

    def pairs(self, y: np.ndarray, x: np.ndarray, targets: np.ndarray, sources: np.ndarray, side: str = "both") -> np.ndarray:
        """Entries of pairs (y[targets[n]], x[sources[n]]); side: from the column field, the row field, or as block() has them."""
        if side == "row":
            return self.one_sided_pairs(self.row, x[sources], y, targets)
        if side == "col" or self.row is None:
            return self.one_sided_pairs(self.col, y[targets], x, sources)
        if self.config.symmetric_combine is SymmetricCombine.CRISSCROSS:
            a, b = self.pairs(y, x, targets, sources, "col"), self.pairs(y, x, targets, sources, "row")
            dx, dy = self.col.nearest_sample_distance(x)[sources], self.row.nearest_sample_distance(y)[targets]
            return np.where(dx < dy, a, np.where(dy < dx, b, 0.5 * (a + b)))
        out = np.zeros(len(targets))
        order = np.argsort(sources, kind="stable")
        for rows in np.split(order, np.flatnonzero(np.diff(sources[order])) + 1) if len(order) else []:
            out[rows] = self.pooled(y[targets[rows]], x[sources[rows[:1]]])[:, 0]
        return out

    def block(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """(targets, sources) kernel entries."""
        if self.row is None:
            return self.one_sided(self.col, y, x)
        if self.config.symmetric_combine is SymmetricCombine.CRISSCROSS:
            dx, dy = self.col.nearest_sample_distance(x)[None], self.row.nearest_sample_distance(y)[:, None]
            a, b = self.one_sided(self.col, y, x, dx <= dy), self.one_sided(self.row, x, y, (dy <= dx).T).T
            return np.where(dx < dy, a, np.where(dy < dx, b, 0.5 * (a + b)))
        return self.pooled(y, x)

    def pooled(self, y: np.ndarray, x: np.ndarray) -> np.ndarray:
        """One fit an entry over both sides' predictions; an adjoint centre joins the first forward one it meets."""
        out = np.zeros((len(y), len(x)))
        sides = []
        for f, to, of in ((self.col, y, x), (self.row, x, y)):
            at = f.at_sources(of, self.config) if len(f.points) and len(of) else None
            sides.append([(f.points[at["near"][i]] - of[i], *f.sweep(to, at, i, self.config)) if at and at["informed"][i] else None for i in range(len(of))])
        for i in range(len(x)):
            for j in range(len(y)):
                centers, values = [], []
                for side, a, b in ((sides[0], i, j), (sides[1], j, i)):
                    first = len(centers)
                    if side[a] is None:
                        continue
                    c, v, gone = side[a]
                    for n in np.flatnonzero(~gone[:, b]):
                        near = next((k for k in range(first) if np.linalg.norm(centers[k] - c[n]) <= self.duplicate_tol), None) if side is sides[1] else None
                        if near is None:
                            centers.append(c[n])
                            values.append(v[n, b])
                        else:
                            centers[near] = 0.5 * (centers[near] + c[n])
                            values[near] = 0.5 * (values[near] + v[n, b])
                if any(values):
                    out[j, i] = rbf_interpolate(np.array(values), np.array(centers), np.zeros((1, x.shape[1])), self.rbf)[0]
        return out

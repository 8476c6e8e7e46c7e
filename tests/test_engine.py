"""The engine against closed forms, against its own numpy evaluator, and against dense linear algebra."""

import itertools
from dataclasses import replace

import numpy as np
import pytest
from pulsefield.config import MIN_DEGREE, ACAOptions, CompressionMethod, EvalConfig, Frame, KernelLowRankOptions, RBFKernel, RBFScheme, RSVDOptions, Scaling, Support, SymmetricCombine, rbf_min_degree
from pulsefield.functions import lowrank as L
from pulsefield.functions.evaluator import KernelArrays
from pulsefield.functions.rbf import phi, pivoted_solve, rbf_functional, rbf_interpolate
from pulsefield.functions.spd import clamp_column, clamp_spd, spd_parts, with_parts
from pulsefield.operators import blocks as B
from pulsefield.operators import classes
from pulsefield.operators.field import ImpulseResponseField
from pulsefield.operators.kernel import KernelEvaluator
from pulsefield.operators.mesh import locate, mesh_of, unit_cube, unit_grid, unit_interval
from pulsefield.operators.neighbors import nearest_sample_distance, nearest_samples
from pulsefield.operators.partition import block_sizes, block_target_sets, recursive_bisection_partition
from pulsefield.operators.predictions import predictions, predictions_over_targets, sums_over_targets, support_ellipsoids
from pulsefield.sources import frog
from pyspark.sql import functions as F


def points(spark, xs, i, p):
    return spark.createDataFrame([(k, np.atleast_1d(x).tolist()) for k, x in enumerate(np.asarray(xs, float))], f"{i} int, {p} array<double>")


def spd(rng, n, d, scale=0.05):
    w = rng.normal(0, scale, (n, d, d))
    return w @ w.transpose(0, 2, 1) + 0.01 * np.eye(d)


def vertices(mesh):
    return np.array([r.p for r in mesh.vertices.orderBy("vertex_id").collect()])


def random_field(mesh, source=None, seed=0, batches=3, normalized=True):
    rng = np.random.default_rng(seed)
    dt, source = mesh.dim, source or mesh
    f = ImpulseResponseField.on(mesh, source, normalized)
    nv, ns = mesh.vertices.count(), source.vertices.count()
    f = f.set_moment_fields(V=1 + rng.uniform(0.5, 1.5, ns), mu=rng.uniform(0.2, 0.8, (ns, dt)), sigma=spd(rng, ns, dt))
    for _ in range(batches):
        k = int(rng.integers(2, 5))
        f = f.add_batch(rng.uniform(0.1, 0.9, (k, source.dim)), rng.normal(size=nv), rng.uniform(0.5, 2, k), rng.uniform(0.3, 0.7, (k, dt)), spd(rng, k, dt))
    return f


@pytest.fixture(scope="module")
def grid(spark):
    return unit_grid(spark, 6)


@pytest.fixture(scope="module")
def field(grid):
    return random_field(grid)


@pytest.fixture(scope="module")
def yx(spark):
    rng = np.random.default_rng(9)
    return points(spark, rng.uniform(-0.1, 1.1, (7, 2)), "target_id", "y"), points(spark, rng.uniform(-0.05, 1.05, (5, 2)), "source_id", "x")


def arrays_of(df, name):
    return np.array([r[1] for r in df.orderBy(df.columns[0]).collect()], float)


# Meshes


@pytest.mark.parametrize("make, n, cells", [(unit_interval, 5, 5), (unit_grid, 4, 32), (unit_cube, 2, 48)])
def test_locate_reproduces_points(spark, make, n, cells):
    mesh = make(spark, n)
    assert mesh.cells.count() == cells and mesh.vertices.count() == (n + 1) ** mesh.dim
    v, c = vertices(mesh), [r.vertex_ids for r in mesh.cells.orderBy("cell_id").collect()]
    x = np.vstack([np.random.default_rng(1).uniform(0, 1, (30, mesh.dim)), v[:3], np.full((1, mesh.dim), 1.2)])
    general = mesh_of(spark, v, np.array(c))
    got = {r.target_id: r for r in locate(points(spark, x, "target_id", "y"), general, "y", ["target_id"]).collect()}
    cell, alpha = general.arrays().locate(x)
    assert got[len(x) - 1].cell_id is None and cell[-1] == -1
    for k in range(len(x) - 1):
        assert got[k].cell_id == cell[k]
        assert np.allclose(got[k].alpha @ v[c[got[k].cell_id]], x[k], atol=1e-12) and np.allclose(got[k].alpha, alpha[k], atol=1e-12)


def test_neighbours_by_buckets(spark):
    rng = np.random.default_rng(2)
    s = points(spark, np.vstack([rng.uniform(0, 1, (60, 2)), [[5.0, 5.0], [0.5, 0.5], [0.5, 0.5]]]), "sample_id", "xs")
    q = points(spark, np.vstack([rng.uniform(-1, 2, (20, 2)), [[0.5, 0.5], [9.0, -9.0]]]), "source_id", "x")
    rows = lambda n: sorted((r.source_id, r.rnk, r.sample_id) for r in nearest_samples(q, s, 4, 2, broadcast_rows=n).collect())
    assert rows(1000) == rows(0) and len(rows(0)) == 88
    assert nearest_sample_distance(q, s.limit(0), 2).first().dist == np.inf


# Predictions


def test_affine_closed_form(spark):
    mesh = unit_grid(spark, 8)
    v = vertices(mesh)
    f = ImpulseResponseField.on(mesh)
    f = f.set_moment_fields(V=1 + v[:, 0], mu=v + [0.05, -0.05], sigma=np.tile(np.diag([0.04, 0.09]), (len(v), 1, 1)))
    f = f.add_batch([[0.3, 0.4]], 2 + 3 * v[:, 0] - v[:, 1], [2.0], [[0.35, 0.45]], [np.diag([0.01, 0.0225])])
    f = f.add_batch([[0.7, 0.6]], 1 - v[:, 0] + 2 * v[:, 1], [1.5], [[0.65, 0.55]], [np.diag([0.01, 0.01])])
    y, x = np.array([0.45, 0.42]), np.array([0.40, 0.40])
    psi = [lambda p: 2 + 3 * p[0] - p[1], lambda p: 1 - p[0] + 2 * p[1]]
    xs, mu, v_i = np.array([[0.3, 0.4], [0.7, 0.6]]), np.array([[0.35, 0.45], [0.65, 0.55]]), [2.0, 1.5]
    sig, mux = [np.array([0.01, 0.0225]), np.array([0.01, 0.01])], x + [0.05, -0.05]
    want = {
        (Frame.TRANSLATION, Scaling.NONE): [v_i[i] * psi[i](y - x + xs[i]) for i in range(2)],
        (Frame.MEAN_TRANSLATION, Scaling.VOLUME): [1.4 * psi[i](y - mux + mu[i]) for i in range(2)],
        (Frame.WHITENED_AFFINE, Scaling.VOLUME_DET): [1.4 * np.sqrt(sig[i].prod() / 0.0036) * psi[i](mu[i] + np.sqrt(sig[i] / [0.04, 0.09]) * (y - mux)) for i in range(2)],
    }
    t, s = points(spark, [y], "target_id", "y"), points(spark, [x], "source_id", "x")
    for (frame, scaling), expect in want.items():
        rows = predictions_over_targets(f, t, s, EvalConfig(frame, scaling, Support.NONE, 3.0, 2)).orderBy("sample_id").collect()
        assert np.allclose([r.value for r in rows], expect, rtol=1e-12)


def test_gate_against_exclusion(spark):
    mesh = unit_grid(spark, 8)
    v = vertices(mesh)
    f = ImpulseResponseField.on(mesh).add_batch([[0.35, 0.45]], 2 + 3 * v[:, 0] - v[:, 1], [2.0], [[0.35, 0.45]], [np.diag([0.01, 0.0225])])
    s = points(spark, [[0.40, 0.40]], "source_id", "x")
    t = points(spark, [[0.42, 0.44], [0.90, 0.40], [1.10, 0.40], [1.50, 0.40]], "target_id", "y")
    pairs = t.crossJoin(s.select("source_id"))
    run = lambda support: {r.target_id: r.value for r in predictions(f, pairs, s, EvalConfig(Frame.TRANSLATION, Scaling.NONE, support, 3.0, 1)).collect()}
    gated, free = run(Support.ELLIPSOID), run(Support.NONE)
    assert set(gated) == {0, 1, 2, 3} and gated[1] == gated[2] == gated[3] == 0.0 and abs(gated[0] - 2 * (2 + 3 * 0.37 - 0.49)) < 1e-12
    assert set(free) == {0, 1} and free[1] != 0


@pytest.mark.parametrize("normalized", [True, False])
def test_relational_equals_arrays(spark, grid, yx, normalized):
    """All frames, scalings and gates: the tables and the in-task evaluator agree."""
    f = random_field(grid, seed=3, normalized=normalized)
    f = replace(f, samples=f.samples.coalesce(1).persist(), batches=f.batches.coalesce(1).persist(), moments=f.moments.coalesce(1).persist())
    t, s = yx
    y, x = arrays_of(t, "y"), arrays_of(s, "x")
    a = f.arrays()
    for frame, scaling, support in itertools.product(Frame, Scaling, Support):
        c = EvalConfig(frame, scaling, support, 2.5, 5)
        got = {(r.source_id, r.target_id, r.sample_id): (r.value, r.excluded) for r in predictions_over_targets(f, t, s, c).collect()}
        at, n = a.at_sources(x, c), 0
        for i in np.flatnonzero(at["informed"]):
            values, excluded = a.sweep(y, at, i, c)
            for k, j in np.ndindex(values.shape):
                value, gone = got[i, j, at["near"][i][k]]
                assert abs(value - values[k, j]) <= 1e-9 * max(1, abs(values[k, j])) and gone == excluded[k, j]
                n += 1
        assert n == len(got)


@pytest.mark.parametrize("target, source", [(unit_interval, unit_interval), (unit_cube, unit_cube), (unit_grid, unit_interval)])
def test_other_dimensions(spark, target, source):
    t, s = target(spark, 2 if target is unit_cube else 5), source(spark, 2 if source is unit_cube else 5)
    f = random_field(t, s, seed=4)
    rng = np.random.default_rng(5)
    y, x = rng.uniform(0.2, 0.8, (4, t.dim)), rng.uniform(0.2, 0.8, (3, s.dim))
    for frame in (Frame.MEAN_TRANSLATION, Frame.WHITENED_AFFINE):
        c = EvalConfig(frame, Scaling.VOLUME_DET, Support.ELLIPSOID, 2.5, 4)
        got = {(r.source_id, r.target_id, r.sample_id): r.value for r in predictions_over_targets(f, points(spark, y, "target_id", "y"), points(spark, x, "source_id", "x"), c).collect()}
        a = f.arrays()
        at = a.at_sources(x, c)
        for i in range(3):
            values, _ = a.sweep(y, at, i, c)
            for k, j in np.ndindex(values.shape):
                assert abs(got[i, j, at["near"][i][k]] - values[k, j]) < 1e-9
    assert t.dim == s.dim or pytest.raises(ValueError, f.validate, EvalConfig(Frame.TRANSLATION, Scaling.NONE, Support.NONE))


def test_validation(spark, grid, field):
    bare = ImpulseResponseField.on(grid)
    with pytest.raises(ValueError, match="per-sample mu(.|\n)*vertex field v"):
        bare.validate(EvalConfig())
    nv = grid.vertices.count()
    one = bare.add_batch([[0.5, 0.5]], np.ones(nv), V=[1.0])
    with pytest.raises(ValueError, match="first batch"):
        one.add_batch([[0.4, 0.5]], np.ones(nv))
    with pytest.raises(ValueError, match="positive definite"):
        bare.add_batch([[0.5, 0.5]], np.ones(nv), sigma=[np.diag([1.0, -1.0])])
    bad = np.tile(np.eye(2), (nv, 1, 1))
    bad[7] = np.diag([1.0, -0.1])
    with pytest.raises(ValueError, match=r"\[7\]"):
        bare.set_moment_fields(sigma=bad)
    for points_, psi in (([[0.5]], np.ones(nv)), ([[0.5, 0.5]], np.ones(3)), (np.zeros((0, 2)), np.ones(nv))):
        with pytest.raises(ValueError):
            bare.add_batch(points_, psi)
    stale = bare.add_batch([[0.5, 0.5]], np.ones(nv), V=[1.0], rebuild=False)
    c = EvalConfig(Frame.IDENTITY, Scaling.NONE, Support.NONE)
    with pytest.raises(RuntimeError):
        stale.ready(c)
    stale.rebuild_kdtree().ready(c)
    assert field.set_moment_fields().field_has == frozenset()
    with pytest.raises(ValueError):
        EvalConfig(frame="sideways")
    with pytest.raises(RuntimeError):
        KernelEvaluator(field).source_support(points(spark, [[0.5, 0.5]], "target_id", "y"))


def test_empty_field(spark, grid, yx):
    t, s = yx
    c = EvalConfig(Frame.IDENTITY, Scaling.NONE, Support.NONE)
    assert predictions(ImpulseResponseField.on(grid), t.crossJoin(s.select("source_id")), s, c).count() == 0


# Moments


def test_clamp(spark):
    rng = np.random.default_rng(0)
    for d in (1, 2, 3):
        s = rng.normal(size=(20, d, d))
        s = s + s.transpose(0, 2, 1)
        s[3] = np.eye(d)
        out, ids = clamp_spd(s, 0.2)
        assert (np.linalg.eigvalsh(out) >= 0.2 - 1e-12).all() and 3 not in ids and (out[3] == s[3]).all()
        df = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(s)], "id int, s array<double>")
        got = clamp_column(df, "s", 0.2, d).orderBy("id").collect()
        assert np.allclose([r.s for r in got], out.reshape(20, -1), atol=1e-12) and [r.id for r in got if r.modified] == ids.tolist()
        floors = np.linspace(0.1, 1, 20)
        assert (np.linalg.eigvalsh(clamp_spd(s, floors)[0]).min(1) >= floors - 1e-12).all()
    with pytest.raises(ValueError):
        clamp_spd(np.eye(2), 0)


@pytest.mark.parametrize("d", [1, 2, 3])
def test_parts(spark, d):
    s = spd(np.random.default_rng(1), 12, d)
    df = spark.createDataFrame([(i, x.ravel().tolist()) for i, x in enumerate(s)], "id int, sigma array<double>")
    want = spd_parts(s)
    for r in with_parts(df, "sigma", d).collect():
        for k in ("inv", "sqrt", "inv_sqrt"):
            assert np.allclose(r["sigma_" + k], want[k][r.id].ravel(), rtol=1e-9)
        assert np.isclose(r.sigma_det, want["det"][r.id])


# Radial basis functions


@pytest.mark.parametrize("kernel, smoothing", list(itertools.product(RBFKernel, (0.0, 0.3))))
def test_rbf_against_bordered_solve(kernel, smoothing):
    rng = np.random.default_rng(3)
    c, f, e = rng.uniform(0, 1, (9, 2)), rng.normal(size=9), rng.uniform(0, 1, (5, 2))
    scheme = RBFScheme(kernel, 2.0, 1, smoothing)
    per = 2.0 / np.linalg.norm(np.ptp(c, axis=0))
    dist = lambda a: phi(kernel, np.linalg.norm(a[:, None] - c[None], axis=2) * per)
    p = np.hstack([np.ones((9, 1)), c])
    a = np.block([[dist(c) + smoothing * np.eye(9), p], [p.T, np.zeros((3, 3))]])
    w = np.linalg.solve(a, np.append(f, np.zeros(3)))
    want = dist(e) @ w[:9] + np.hstack([np.ones((5, 1)), e]) @ w[9:]
    assert np.allclose(rbf_interpolate(f, c, e, scheme), want, rtol=1e-8)
    assert np.isclose(rbf_functional(c, e[0], scheme) @ f, want[0], rtol=1e-8)


def test_rbf_degenerate():
    at = np.array([[0.3, 0.4]])
    assert rbf_interpolate(np.array([5.0]), at, at + 1)[0] == 5
    assert rbf_interpolate(np.array([1.0, 2.0, 6.0]), np.repeat(at, 3, 0), at)[0] == 3
    two = np.array([[0.0, 0.0], [1.0, 0.0]])
    assert np.allclose(rbf_interpolate(np.array([1.0, 4.0]), two, two), [1, 4])
    line = np.array([[0.0, 0.0], [0.5, 0.5], [1.0, 1.0], [0.2, 0.2]])
    assert np.isfinite(rbf_functional(line, np.zeros(2))).all()
    a = np.array([[1.0, 2.0], [2.0, 4.0]])
    assert np.allclose(a @ pivoted_solve(a, np.array([1.0, 2.0])), [1, 2])
    for bad in ({"shape": 0}, {"smoothing": -1}, {"degree": 2}, {"kernel": "cubic", "degree": 0}):
        with pytest.raises(ValueError):
            RBFScheme(**bad)
    assert {k: rbf_min_degree(k) for k in RBFKernel} == MIN_DEGREE
    with pytest.raises(ValueError):
        rbf_functional(np.zeros((0, 2)), np.zeros(2))


# Low rank


def raw(m, n, seed):
    x = np.frombuffer(np.random.RandomState(seed).bytes(4 * m * n), "<u4")
    return (2 * x / 2.0**32 - 1).reshape(n, m).T


def test_truncation():
    a = raw(12, 3, 1) @ raw(9, 3, 2).T
    assert L.truncated_svd(a, 1e-12).rank == 3 and L.truncated_svd(np.zeros((7, 5)), 0.1).rank == 0 and L.truncated_svd(np.zeros((0, 5)), 0).rank == 0
    q1, q2 = np.linalg.qr(raw(11, 5, 3))[0], np.linalg.qr(raw(8, 5, 4))[0]
    b = q1 @ np.diag([1, 0.5, 0.1, 0.05, 0.01]) @ q2.T
    assert (L.truncated_svd(b, 0.12).rank, L.truncated_svd(b, 0.09).rank, L.truncated_svd(b, 0, 2).rank) == (2, 3, 2)
    f = L.recompress(L.LowRank(np.hstack([q1, q1]), np.hstack([q2, q2])), 1e-10)
    assert f.rank == 5 and np.allclose(f.to_dense(), 2 * q1 @ q2.T)
    with pytest.raises(ValueError):
        L.truncated_svd(a, -1)


def test_cross_approximation():
    run = lambda a, rtol, **o: L.aca(lambda i: a[i], lambda j: a[:, j], *a.shape, rtol, ACAOptions(**o))
    a = np.zeros((40, 40))
    a[:20, :20], a[20:, 20:] = raw(20, 2, 5) @ raw(20, 2, 6).T, raw(20, 2, 7) @ raw(20, 2, 8).T
    got = run(a, 1e-8)
    assert got.factors.rank == 4 and got.converged and min(got.sampled_rows) < 20 <= max(got.sampled_rows)
    b = raw(20, 5, 9) @ raw(15, 5, 10).T
    capped = run(b, 1e-8, max_rank=3)
    assert capped.hit_max_rank and not capped.converged and capped.sampled_rank == 3
    none = run(b, 1e-8, max_rank=0)
    assert not none.hit_max_rank and not none.converged
    exact = run(b, 0.0)
    assert exact.converged and np.allclose(exact.factors.to_dense(), b)
    assert run(np.zeros((7, 5)), 0.1).converged and run(np.zeros((0, 5)), 0.1).converged
    assert [run(b, 1e-8).sampled_rows, run(b, 1e-8).sampled_cols] == [run(b, 1e-8).sampled_rows, run(b, 1e-8).sampled_cols]
    for bad in ({"aca_safety_factor": 0}, {"required_consecutive_successes": 0}):
        with pytest.raises(ValueError):
            run(b, 1e-8, **bad)
    with pytest.raises(ValueError, match="get_row"):
        L.aca(lambda i: b[i, :2], lambda j: b[:, j], *b.shape, 1e-8)


def test_randomized_svd():
    q1, q2 = np.linalg.qr(raw(30, 20, 1))[0], np.linalg.qr(raw(22, 20, 2))[0]
    a = q1 @ np.diag(2.0 ** -np.arange(20)) @ q2.T
    f = L.randomized_svd(lambda x: a @ x, lambda y: a.T @ y, 30, 22, 8, RSVDOptions(power_iterations=2))
    best = np.linalg.norm(2.0 ** -np.arange(8.0, 20))
    assert f.rank == 8 and np.linalg.norm(a - f.to_dense()) <= 10 * best
    with pytest.raises(ValueError):
        L.randomized_svd(lambda x: x, lambda y: y, 3, 3, 0)
    with pytest.raises(ValueError, match="shape"):
        L.randomized_svd(lambda x: x[:2], lambda y: y, 5, 5, 2)


# Kernels


def dense(df, ny, nx):
    a = np.zeros((ny, nx))
    for r in df.collect():
        a[r.target_id, r.source_id] = r.value
    return a


@pytest.mark.parametrize("support", list(Support))
@pytest.mark.parametrize("mode", [None, "pooled", "crisscross"])
def test_blocks_against_entries(spark, field, yx, support, mode):
    t, s = yx
    c = EvalConfig(Frame.MEAN_TRANSLATION, Scaling.VOLUME, support, 2.5, 4, mode or "pooled")
    k = KernelEvaluator(field, field if mode else None, c)
    y, x = arrays_of(t, "y"), arrays_of(s, "x")
    got = dense(k.block(t, s), len(y), len(x))
    for i, j in np.ndindex(got.shape):
        want = k(y[i], x[j])
        assert abs(got[i, j] - want) <= 1e-9 * max(1, abs(want)) and (got[i, j] == 0) == (want == 0)


def test_entry_is_interpolation_of_predictions(spark, field, yx):
    t, s = yx
    c = EvalConfig(Frame.TRANSLATION, Scaling.NONE, Support.NONE, 2.5, 5)
    k = KernelEvaluator(field, config=c)
    rows = predictions(field, t.crossJoin(s.select("source_id")), s, c).collect()
    y, x = arrays_of(t, "y"), arrays_of(s, "x")
    for i, j in np.ndindex(len(y), len(x)):
        mine = [r for r in rows if (r.target_id, r.source_id) == (i, j)]
        want = rbf_interpolate(np.array([r.value for r in mine]), np.array([r.point for r in mine]) - x[j], np.zeros((1, 2)))[0] if mine else 0.0
        assert np.isclose(k(y[i], x[j]), want, rtol=1e-7, atol=1e-9)


def test_crisscross_is_symmetric(field):
    c = EvalConfig(Frame.MEAN_TRANSLATION, Scaling.VOLUME, Support.NONE, 3.0, 4, SymmetricCombine.CRISSCROSS)
    a = KernelArrays(field.arrays(), field.arrays(), c, RBFScheme())
    p = np.random.default_rng(8).uniform(0.1, 0.9, (6, 2))
    k = a.block(p, p)
    assert (k == k.T).all()


def test_exact_at_samples(spark):
    """With nothing smoothed, the kernel at a sample is its own response."""
    mesh = unit_grid(spark, 8)
    v = vertices(mesh)
    f = ImpulseResponseField.on(mesh, batches_normalized=False)
    for x, (a, b, c) in (((0.3, 0.4), (2, 3, -1)), ((0.55, 0.5), (1, -1, 2)), ((0.45, 0.65), (0.5, 2, 1)), ((0.62, 0.35), (-1, 1, 1)), ((0.38, 0.58), (3, -2, 0.5))):
        f = f.add_batch([x], a + b * v[:, 0] + c * v[:, 1])
    k = KernelEvaluator(f, config=EvalConfig(Frame.TRANSLATION, Scaling.NONE, Support.NONE, 3.0, 5))
    assert np.isclose(k([0.5, 0.5], [0.3, 0.4]), 2 + 1.5 - 0.5)


# Partitions and blocks


def test_bisection(spark):
    line = points(spark, np.linspace(0, 1, 100)[:, None], "source_id", "x")
    parts = {}
    for r in recursive_bisection_partition(line, 50, 1).collect():
        parts.setdefault(r.part_id, []).append(r.source_id)
    assert {k: sorted(v) for k, v in parts.items()} == {0: list(range(50)), 1: list(range(50, 100))}
    square = points(spark, [(i % 10, i // 10) for i in range(100)], "source_id", "x")
    sizes = recursive_bisection_partition(square, 30, 2).groupBy("part_id").count().collect()
    assert sorted((r.part_id, r["count"]) for r in sizes) == [(k, 25) for k in range(4)]
    assert recursive_bisection_partition(square.limit(0), 5, 2).count() == 0
    with pytest.raises(ValueError):
        recursive_bisection_partition(square, 0, 2)


def test_bisection_by_histograms(spark, monkeypatch):
    from pulsefield.operators import partition as P

    x = np.round(np.random.default_rng(0).uniform(0, 1, (300, 2)), 2)
    df = points(spark, x, "source_id", "x")
    rows = lambda: sorted(tuple(r) for r in recursive_bisection_partition(df, 40, 2).collect())
    want = rows()
    monkeypatch.setattr(P, "RANKED", 5)
    monkeypatch.setattr(P, "BINS", 4)
    assert rows() == want


@pytest.fixture(scope="module")
def gated(spark, field):
    c = EvalConfig(Frame.TRANSLATION, Scaling.NONE, Support.ELLIPSOID, 2.0, 3)
    g = np.linspace(0.1, 0.9, 6)
    p = np.array([(a, b) for a in g for b in g])
    s, t = points(spark, p, "source_id", "x"), points(spark, p + 0.01, "target_id", "y")
    k = KernelEvaluator(field, config=c)
    part = recursive_bisection_partition(s, 10, 2).persist()
    return k, t, s, part, k.arrays().block(p + 0.01, p)


def test_target_sets_lose_nothing(spark, field, gated):
    k, t, s, part, a = gated
    sets = {(r.part_id, r.target_id) for r in block_target_sets(k, t, s, part).collect()}
    of = {r.source_id: r.part_id for r in part.collect()}
    for i, j in zip(*np.nonzero(a)):
        assert (of[j], i) in sets
    both = KernelEvaluator(field, field, k.config)
    more = {(r.part_id, r.target_id) for r in block_target_sets(both, t, s, part).collect()}
    assert sets <= more
    with pytest.raises(ValueError):
        block_target_sets(k, t, s, spark.createDataFrame([(0, 999)], "part_id int, source_id int"))


def test_support_ellipsoids_match_arrays(spark, field, yx):
    _, s = yx
    x = arrays_of(s, "x")
    for frame in Frame:
        c = EvalConfig(frame, Scaling.VOLUME, Support.ELLIPSOID, 2.0, 3)
        got = {(r.source_id, r.ord): r for r in support_ellipsoids(field, s, c).collect()}
        want = field.arrays().support_ellipsoids(x, c)
        assert sum(map(len, want)) == len(got)
        for i, ells in enumerate(want):
            for n, (center, shape) in enumerate(ells, 1):
                assert np.allclose(got[i, n].c, center) and np.allclose(got[i, n].s, shape.ravel())
    with pytest.raises(ValueError):
        support_ellipsoids(field, s, EvalConfig(support="none"))


@pytest.mark.parametrize("method, rtol", [(CompressionMethod.DENSE_SVD, 0.0), (CompressionMethod.DENSE_SVD, 1e-2), (CompressionMethod.ACA, 1e-6)])
def test_block_low_rank(spark, gated, tmp_path, method, rtol):
    k, t, s, part, a = gated
    b = B.block_low_rank(k, t, s, part, rtol, KernelLowRankOptions(method=method))
    b = B.BlockLowRank.of(b.num_sources, b.num_targets, b.blocks.persist())
    got = dense(b.to_dense(), *a.shape)
    assert np.linalg.norm(got - a) <= max(rtol, 1e-9) * np.linalg.norm(a) * 2
    assert (got[a == 0] == 0).all() or rtol > 0
    u, v = np.random.default_rng(1).normal(size=(36, 2)), np.random.default_rng(2).normal(size=(36, 2))
    vec = lambda df, name: np.array([r.u for r in df.orderBy(name).collect()])
    table = lambda x, name: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], f"{name} int, u array<double>")
    bu, bv = vec(b.apply(table(u, "source_id"), 2), "target_id"), vec(b.applyT(table(v, "target_id"), 2), "source_id")
    assert np.allclose(bu, got @ u) and np.allclose(bv, got.T @ v) and np.isclose((bu * v).sum(), (bv * u).sum(), rtol=1e-12)
    assert b.storage_entries() <= sum(len(r.source_ids) * len(r.target_ids) for r in b.blocks.collect())
    assert b.diagnostics().first().all_converged
    b.write(str(tmp_path / "blocks"))
    again = B.BlockLowRank.read(spark, str(tmp_path / "blocks"))
    assert (dense(again.to_dense(), *a.shape) == got).all()


def test_global_low_rank(spark, gated):
    k, t, s, part, a = gated
    r = B.kernel_low_rank(k, t, s, 1e-3).first()
    assert r.converged and np.linalg.norm(B.low_rank_arrays(r).to_dense() - a) <= 1e-3 * np.linalg.norm(a)
    b = B.block_low_rank(k, t, s, part, 0.0)
    u, v, rank = B.randomized_svd_blocks(b, 12, RSVDOptions(power_iterations=2))
    f = L.LowRank(np.array([x.u for x in u.orderBy("target_id").collect()]), np.array([x.u for x in v.orderBy("source_id").collect()]))
    sv = np.linalg.svd(a, compute_uv=False)
    assert rank == 12 and np.linalg.norm(f.to_dense() - a) <= 1.5 * np.linalg.norm(sv[12:]) + 1e-8


def test_container_checks(spark):
    row = lambda s, t, f, r, tf, sf: spark.createDataFrame([(0, s, t, f, r, tf, sf, False, True, False, 0.0)], B.BLOCKS)
    ok = row([0, 1], [0, 2], True, 1, [1.0, 2.0], [3.0, 4.0])
    b = B.BlockLowRank.of(3, 3, ok)
    assert dense(b.to_dense(), 3, 3).tolist() == [[3, 4, 0], [0, 0, 0], [6, 8, 0]] and b.ranks().first().rank == 1
    for bad in (row([0, 3], [0], True, 0, [], []), row([0], [2, 1], True, 0, [], []), row([0, 1], [0], True, 1, [1.0], [1.0]), ok.union(ok)):
        with pytest.raises(ValueError):
            B.BlockLowRank.of(3, 3, bad)


def test_frog(spark):
    """More batches approximate the kernel better."""
    errors = []
    for batches in (1, 4):
        f = frog.frog_field(spark, 16, batches)
        x = np.random.default_rng(0).uniform(0.2, 0.8, (12, 2))
        y = vertices(f.target)
        t, s = points(spark, y, "target_id", "y"), points(spark, x, "source_id", "x")
        exact = t.crossJoin(s).select("target_id", "source_id", frog.value_column(*map(__import__("pyspark").sql.functions.col, ("y", "x"))).alias("value"))
        near = KernelEvaluator(f, config=EvalConfig(Frame.WHITENED_AFFINE, Scaling.VOLUME_DET, Support.ELLIPSOID, 3.0, 10)).block(t, s)
        e = frog.relative_column_errors(exact, near).persist()
        errors.append(frog.percentile(e, "error", 0.5))
    assert np.allclose(frog.values(y[:3], x[:2]), np.array([r.value for r in exact.where("target_id < 3 and source_id < 2").orderBy("target_id", "source_id").collect()]).reshape(3, 2))
    assert errors[1] < errors[0] < 0.6
    assert frog.storage_matched_rank(10, 100) == 1 and frog.median_int([3, 1, 2, 9]) == 3


def test_pairs_are_entries_of_blocks():
    """Pairs evaluated together give the block's entries, on buckets of cells and on a structured square alike."""
    from itertools import product

    from pulsefield.config import EvalConfig, Frame, RBFScheme, Scaling, Support
    from pulsefield.functions.evaluator import FieldArrays, KernelArrays, MeshArrays

    rng, n = np.random.default_rng(1), 6
    v = np.array([[i / n, j / n] for j in range(n + 1) for i in range(n + 1)])
    corner = [j * (n + 1) + i for j in range(n) for i in range(n)]
    cells = np.array([c for a in corner for c in ([a, a + 1, a + n + 2], [a, a + n + 2, a + n + 1])])
    points = rng.random((9, 2)) * 0.8 + 0.1
    y, x = rng.random((11, 2)), rng.random((7, 2))
    x[3] = points[2]
    t, s = (z.ravel() for z in np.meshgrid(np.arange(11), np.arange(7), indexing="ij"))
    psi, v1, v2 = rng.normal(size=(3, len(v))), 1 + rng.random(9), 1 + rng.random(len(v))
    fields = [FieldArrays(m, m, psi, np.arange(9) % 3, points, True, v1, points + 0.01, np.tile(np.diag([0.02, 0.03]), (9, 1, 1)), v2, v + 0.01, np.tile(np.diag([0.02, 0.025]), (len(v), 1, 1))) for m in (MeshArrays(v, cells), MeshArrays(v, cells, n))]
    for frame, scaling, support, k, (two, combine) in product(Frame, Scaling, Support, (1, 2, 4), ((False, "pooled"), (True, "crisscross"))):
        c = EvalConfig(frame, scaling, support, 2.0, k, combine)
        want = KernelArrays(fields[0], fields[0] if two else None, c, RBFScheme()).block(y, x)
        for f in fields:
            got = KernelArrays(f, f if two else None, c, RBFScheme()).pairs(y, x, t, s).reshape(want.shape)
            assert np.allclose(got, want, rtol=1e-9, atol=1e-9)


def test_field_and_results_on_the_driver(spark, small):
    """The field's samples and batches as arrays, its operators as methods, and results with what they report."""
    from pulsefield import block_low_rank_result, kernel_low_rank_result
    from pulsefield.plans.catalogue import BASE, OPEN, kernel_of, partition
    from pulsefield.sources import tables as S

    f, sources, targets = S.field(spark, small), S.sources(spark, small), S.targets(spark, small).where("target_id < 30")
    samples = S.samples(spark, small).orderBy("sample_id").collect()
    assert f.sample_points.tolist() == [r.xs for r in samples] and f.sample_V.tolist() == [r.v for r in samples]
    assert f.point2batch.tolist() == [r.batch_id for r in samples] and f.sample_Sigma.shape == (25, 2, 2) and f.sample_mu.shape == (25, 2)
    ids = [r.sample_id for r in samples if r.batch_id == 1]
    assert f.batch_range(1) == (min(ids), max(ids) + 1) and len(f.batch_values(1)) == 289
    with pytest.raises(ValueError):
        f.batch_range(99)
    assert f.nearest_sample_distance(sources).count() == sources.count() and f.support_ellipsoids(sources, BASE).count() == 3 * sources.count()
    k = kernel_of(spark, small, OPEN)
    got = block_low_rank_result(k, targets, sources, partition(spark, small), 1e-2)
    assert got.all_converged and not got.any_hit_max_rank and [i.part_id for i in got.infos] == [0]
    exact = k.arrays().block(np.array([r.y for r in targets.orderBy("target_id").collect()]), np.array([r.x for r in sources.orderBy("source_id").collect()]))
    for dense in (got.operator.block(0).to_dense(), kernel_low_rank_result(k, targets, sources, 1e-2).factors.to_dense()):
        assert np.linalg.norm(dense - exact) <= 1.01e-2 * np.linalg.norm(exact)


# Points that occur more than once


@pytest.fixture(scope="module")
def copied(spark, field):
    """Points of which many occur several times, in one part and over several, and the dense kernel."""
    rng = np.random.default_rng(4)
    y, x = rng.uniform(0, 1, (12, 2))[rng.integers(0, 12, 40)], rng.uniform(0, 1, (9, 2))[rng.integers(0, 9, 30)]
    k = KernelEvaluator(field, config=EvalConfig(Frame.MEAN_TRANSLATION, Scaling.VOLUME, Support.ELLIPSOID, 2.0, 3))
    return k, points(spark, y, "target_id", "y"), points(spark, x, "source_id", "x"), k.arrays().block(y, x), y, x


def test_copies_are_evaluated_once(copied):
    k, t, s, a, y, x = copied
    got = k.shared(t, s)
    assert got.values.count() <= len(np.unique(y, axis=0)) * len(np.unique(x, axis=0)) < (a != 0).sum()
    assert np.allclose(dense(got.rows(), *a.shape), a)
    w = got.weighed().collect()
    assert np.isclose(sum(r.value**2 * r.copies for r in w), (a * a).sum())
    v = got.product(s.select("source_id", (F.col("source_id") + 1.0).alias("u")), "source_id", "target_id").collect()
    assert np.allclose([r.value for r in sorted(v)], [r for r, on in zip(a @ np.arange(1.0, 31.0), (a != 0).any(1), strict=True) if on])


@pytest.mark.parametrize("listed, broadcast", [(1024, 1 << 20), (2, 1 << 20), (2, 0)])
def test_entries_meet_lists_of_copies(copied, monkeypatch, listed, broadcast):
    k, t, s, a, y, x = copied
    monkeypatch.setattr(classes, "LISTED", listed)
    monkeypatch.setattr(classes, "BROADCAST_ROWS", broadcast)
    got = k.shared(t, s)
    rows = classes.lists(got.targets, got.target_points, "target_id").collect()
    assert sorted(i for r in rows for i in r.ids) == list(range(40))
    assert (len(rows) == len(np.unique(y, axis=0))) == (listed > 2)
    entries = got.rows()
    assert np.allclose(dense(entries, *a.shape), a) and entries.count() == (a != 0).sum()
    assert entries._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 2
    alone = k.shared(t.join(got.target_points, "target_id", "left_semi"), s)  # targets without copies
    assert classes.lists(alone.targets, alone.target_points, "target_id") is None
    assert {(r.target_id, r.source_id) for r in alone.rows().collect()} == {(i, j) for i, j in zip(*np.nonzero(a)) if i in {r.target_id for r in got.target_points.collect()}}


@pytest.mark.parametrize("rtol", [0.0, 1e-3])
def test_blocks_of_copies(spark, copied, tmp_path, rtol):
    k, t, s, a, y, x = copied
    part = recursive_bisection_partition(s, 8, 2).persist()
    b = B.block_low_rank(k, t, s, part, rtol)
    b = replace(b, blocks=b.blocks.persist())
    rows = b.blocks.collect()
    assert all(len(r.target_ids) <= len(np.unique(y, axis=0)) for r in rows) and sum(len(r.source_ids) for r in rows) < len(x)
    b.write(str(tmp_path / "b"))
    for c in (b, B.BlockLowRank.read(spark, str(tmp_path / "b"))):
        got = dense(c.to_dense(), *a.shape)
        assert np.linalg.norm(got - a) <= max(rtol, 1e-12) * np.linalg.norm(a)
        u = spark.createDataFrame([(i, [float(i)]) for i in range(30)], "source_id int, u array<double>")
        v = spark.createDataFrame([(i, [float(i)]) for i in range(40)], "target_id int, u array<double>")
        assert np.allclose([r.u[0] for r in c.apply(u).orderBy("target_id").collect()], got @ np.arange(30.0))
        assert np.allclose([r.u[0] for r in c.applyT(v).orderBy("source_id").collect()], got.T @ np.arange(40.0))
    sizes = {r.part_id: (r.n_sources, r.n_targets) for r in block_sizes(k, t, s, part).collect()}
    sets = [tuple(r) for r in block_target_sets(k, t, s, part).collect()]
    of = {r.source_id: r.part_id for r in part.collect()}
    assert len(sets) == len(set(sets)) and all((of[j], i) in set(sets) for i, j in zip(*np.nonzero(a)))
    assert sizes == {p: (sum(q == p for q in of.values()), sum(r[0] == p for r in sets)) for p in sizes}
    norms = {r.part_id: r.norm for r in b.norms().collect()}
    assert all(np.isclose(n, np.linalg.norm(a[:, [j for j in of if of[j] == p]]), rtol=2e-3) for p, n in norms.items())
    if rtol == 0:
        assert {r.part_id: r.storage_entries for r in b.ranks().collect()} == {p: m * n for p, (m, n) in sizes.items()}
    one = b.block(rows[0].part_id)
    assert np.allclose(one.to_dense(), dense(b.to_dense(), *a.shape)[np.ix_(one.target_ids, one.source_ids)])
    with pytest.raises(ValueError):
        B.BlockLowRank.of(b.num_sources, b.num_targets, b.blocks)


def test_sums_over_targets(copied, field):
    _, t, s, *_ = copied
    for c in (EvalConfig(Frame.TRANSLATION, Scaling.NONE, Support.NONE, 2.0, 3), EvalConfig(Frame.WHITENED_AFFINE, Scaling.VOLUME, Support.ELLIPSOID, 2.0, 2)):
        got = {(r.source_id, r.rnk): (r.n, r.n_excluded, round(r.total, 9)) for r in sums_over_targets(field, t, s, c).collect()}
        want = {}
        for r in predictions_over_targets(field, t, s, c).collect():
            n, gone, total = want.get((r.source_id, r.rnk), (0, 0, 0.0))
            want[r.source_id, r.rnk] = (n + 1, gone + r.excluded, total + r.value)
        assert got == {k: (n, g, round(v, 9)) for k, (n, g, v) in want.items()}


@pytest.mark.parametrize("method, rtol", [(CompressionMethod.DENSE_SVD, 1e-2), (CompressionMethod.DENSE_SVD, 0.0), (CompressionMethod.ACA, 1e-4)])
def test_whole_kernel_by_parts(copied, monkeypatch, method, rtol):
    k, t, s, a, y, x = copied
    k = KernelEvaluator(k.col_field, config=replace(k.config, support=Support.NONE))
    a = k.arrays().block(y, x)
    monkeypatch.setattr(B, "WHOLE_PART", 3)
    o = KernelLowRankOptions(method=method)
    few = B.kernel_low_rank_points(k, t, s, rtol, o).first()
    assert len(few.target_ids) == len(np.unique(y, axis=0)) and sum(few.source_counts) == len(x)
    r = B.kernel_low_rank(k, t, s, rtol, o).first()
    assert r.converged and list(r.target_ids) == list(range(40)) and list(r.source_ids) == list(range(30))
    assert np.linalg.norm(B.low_rank_arrays(r).to_dense() - a) <= max(rtol, 1e-12) * np.linalg.norm(a)


@pytest.mark.parametrize("method, rtol", [(CompressionMethod.DENSE_SVD, 3e-2), (CompressionMethod.DENSE_SVD, 0.0), (CompressionMethod.ACA, 1e-3)])
def test_whole_kernel_in_rounds(spark, copied, monkeypatch, method, rtol):
    """Parts are put together two at a time; the rank is that of one truncated SVD, and a part of small entries has few ranks."""
    k, t, s, _, y, x = copied
    k = KernelEvaluator(k.col_field, config=replace(k.config, support=Support.NONE))
    a = k.arrays().block(y, x)
    monkeypatch.setattr(B, "WHOLE_PART", 1)
    monkeypatch.setattr(B, "MERGED", 2)
    r = B.kernel_low_rank(k, t, s, rtol, KernelLowRankOptions(method=method)).first()
    assert r.part_id == 0 and r.converged and not r.hit_max_rank and list(r.target_ids) == list(range(40)) and list(r.source_ids) == list(range(30))
    error = np.linalg.norm(B.low_rank_arrays(r).to_dense() - a) / np.linalg.norm(a)
    assert error <= max(rtol, 1e-12) and (method is CompressionMethod.ACA or abs(r.relerr_estimate - error) <= 1e-7)
    least = L.truncated_svd(a, max(rtol, 1e-12)).rank
    assert least <= r.rank <= least + (rtol > 0)
    capped = B.kernel_low_rank_points(k, t, s, 1e-6, KernelLowRankOptions(method=method, max_rank=2)).first()
    assert capped.rank == 2 and capped.hit_max_rank and not capped.converged
    none = B.kernel_low_rank_points(k, t.limit(0), s, rtol, KernelLowRankOptions(method=method)).first()
    assert none.rank == 0 and sum(none.source_counts) == 30 and not none.target_ids


def test_norms_of_parts(copied):
    k, t, s, a, y, x = copied
    places = B.distinct_points(t, "target_id", "y").selectExpr("array(cast(target_id as int)) ti", "y tp", "array(cast(copies as int)) tn")
    own = B.distinct_points(s, "source_id", "x").withColumn("part_id", F.col("source_id") % 2)
    got = B.norms_of_parts(k, own.select("part_id").distinct().crossJoin(places), own)
    of = {tuple(r.x): r.part_id for r in own.collect()}
    part = np.array([of[tuple(p)] for p in x])
    assert {p: n for p, (n, _) in got.items()} == {p: list(of.values()).count(p) for p in set(of.values())}
    assert all(np.isclose(norm2, (a[:, part == p] ** 2).sum()) for p, (_, norm2) in got.items())


def test_projection_by_gram_matrix():
    rng = np.random.default_rng(3)
    a = np.linalg.qr(rng.normal(size=(60, 20)))[0] * 0.5 ** np.arange(20) @ np.linalg.qr(rng.normal(size=(20, 20)))[0]
    size2 = (a * a).sum()
    for rtol, most in ((0.9, -1), (1e-2, -1), (1e-4, -1), (0.0, -1), (1e-2, 3), (2.0, -1)):
        f, want = B.projected(a, rtol**2 * size2, most), L.truncated_svd(a, rtol, most)
        assert f.rank == want.rank and np.allclose(f.to_dense(), want.to_dense(), atol=1e-9)
        assert np.allclose(f.V.T @ f.V, np.eye(f.rank))


def test_reach_is_swept_in_tiles(spark, copied, monkeypatch):
    """Targets of a part are tested as arrays, tile by tile; no ellipsoid is joined to points row by row."""
    from pulsefield.operators import partition as P
    from pulsefield.operators import predictions as R

    k, t, s, a, y, x = copied
    part = recursive_bisection_partition(s, 8, 2).persist()
    monkeypatch.setattr(P, "TARGETS", 3)
    monkeypatch.setattr(R, "points_in_ellipsoids", None)
    for kernel in (k, KernelEvaluator(k.col_field, k.col_field, replace(k.config, symmetric_combine=SymmetricCombine.CRISSCROSS))):
        got = P.block_target_sets(kernel, t, s, part).collect()
        f, of = kernel.arrays().col, {r.source_id: r.part_id for r in part.collect()}
        inside = lambda c, e, p: (p - c) @ np.linalg.inv(e) @ (p - c) <= 1
        pairs = {(of[i], j) for i, own in enumerate(f.support_ellipsoids(x, k.config)) for j in range(len(y)) if any(inside(c, e, y[j]) for c, e in own)}
        if kernel.symmetric:
            pairs |= {(of[i], j) for j, own in enumerate(f.support_ellipsoids(y, k.config)) for i in range(len(x)) if any(inside(c, e, x[i]) for c, e in own)}
        assert len(got) == len(set(got)) and {(r.part_id, r.target_id) for r in got} == pairs


def test_products_are_summed_in_tiles(copied):
    k, t, s, a, y, x = copied
    got = k.shared(t, s)
    v = got.product(t.select("target_id", (F.col("target_id") + 1.0).alias("u")).where("target_id < 20"), "target_id", "source_id").collect()
    assert "values" not in got.__dict__  # no entry left a tile
    assert np.allclose([r.value for r in sorted(v)], [q for q, on in zip(np.arange(1.0, 21.0) @ a[:20], (a != 0).any(0), strict=True) if on])


def test_dense_blocks_need_no_svd(copied, monkeypatch):
    k, t, s, a, y, x = copied
    monkeypatch.setattr(B, "truncated_svd", None)
    block = np.random.default_rng(0).normal(size=(30, 6))
    got = B.compress(lambda p, q: block[p[:, 0]][:, q[:, 0]], np.arange(30)[:, None], np.arange(6)[:, None], 0.0, KernelLowRankOptions())
    assert not got["factored"] and got["rank"] == 6 and np.allclose(np.reshape(got["target_factor"], (30, 6)), block)
    assert B.least_rank(np.outer(np.arange(9.0), np.arange(4.0)), 0.0) == 1

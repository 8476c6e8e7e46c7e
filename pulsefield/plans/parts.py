"""Registered queries over the engine's smaller parts: other meshes, floors, functionals, factorisations, diagnostics."""

from __future__ import annotations

from dataclasses import replace
from itertools import permutations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefield.config import CompressionMethod, EvalConfig, Frame, KernelLowRankOptions, RBFKernel, RBFScheme, RSVDOptions, Scaling, Support, SymmetricCombine, rbf_min_degree
from pulsefield.functions import lowrank
from pulsefield.functions.rbf import rbf_interpolate
from pulsefield.functions.spd import clamp_column
from pulsefield.operators import blocks as B
from pulsefield.operators.field import ImpulseResponseField
from pulsefield.operators.kernel import KernelEvaluator
from pulsefield.operators.mesh import unit_cube, unit_grid, unit_interval
from pulsefield.operators.neighbors import nearest_samples
from pulsefield.operators.predictions import predictions
from pulsefield.plans import sql
from pulsefield.plans.catalogue import BASE, BISECT, CLAMP, KER, OPEN, RBF, compressed, kernel_of, product_sql, query, r, rounded, weights, whole
from pulsefield.plans.lineage import cut, folder
from pulsefield.sources import frog
from pulsefield.sources import tables as S

FREE = EvalConfig(Frame.IDENTITY, Scaling.NONE, Support.NONE, 2.0, 3)

# Meshes


@query("interval_mesh", "SELECT CAST(range AS INTEGER) AS cell_id, CAST(range AS INTEGER) AS v0, CAST(range + 1 AS INTEGER) AS v1, range / 16.0::DOUBLE AS low, (range + 1) / 16.0::DOUBLE AS high FROM range(16)")
def interval_mesh(spark, sf_dir):
    g = unit_interval(spark, 16).geometry()
    return g.select("cell_id", F.col("vertex_ids")[0].alias("v0"), F.col("vertex_ids")[1].alias("v1"), F.col("low")[0].alias("low"), F.col("high")[0].alias("high"))


@query("cube_vertices", "SELECT CAST(range AS INTEGER) AS vertex_id, (range % 5) / 4.0::DOUBLE AS px, (range // 5 % 5) / 4.0::DOUBLE AS py, (range // 25) / 4.0::DOUBLE AS pz FROM range(125)")
def cube_vertices(spark, sf_dir):
    return unit_cube(spark, 4).vertices.select("vertex_id", *[F.col("p")[k].alias(f"p{'xyz'[k]}") for k in range(3)])


STEPS = ", ".join(f"({k}, {a}, {a + b})" for k, (a, b, _) in enumerate(permutations((1, 5, 25))))


@query("cube_cells", f"SELECT CAST(range AS INTEGER) AS cell_id, CAST(o AS INTEGER) AS v0, CAST(o + a AS INTEGER) AS v1, CAST(o + b AS INTEGER) AS v2, CAST(o + 31 AS INTEGER) AS v3 FROM (SELECT range, (range // 6 % 4) + (range // 24 % 4) * 5 + (range // 96) * 25 AS o FROM range(384)) JOIN (VALUES {STEPS}) s(k, a, b) ON range % 6 = k")
def cube_cells(spark, sf_dir):
    return unit_cube(spark, 4).cells.select("cell_id", *[F.col("vertex_ids")[k].alias(f"v{k}") for k in range(4)])


# Fields


@query("pred_rectangular", f"""WITH {sql.FIELD}, src AS ({sql.SUPPLIERS}), tgt AS ({sql.CUSTOMERS}), prs AS ({sql.ORDERED}),
near AS (SELECT src.id AS source_id, smp.*, row_number() OVER (PARTITION BY src.id ORDER BY (src.x0 - smp.x0) * (src.x0 - smp.x0), sample_id) AS rnk FROM src, smp QUALIFY rnk <= 3)
SELECT t.id AS target_id, n.source_id, CAST(n.rnk AS INTEGER) AS rnk, n.sample_id, {r('n.v * (l0 * a.psi + l1 * b.psi + l2 * c.psi)')} AS value FROM prs JOIN near n ON prs.source_id = n.source_id JOIN {sql.located('tgt', 'x0', 'x1')} t ON t.id = prs.target_id
JOIN psi a ON va = a.vertex_id AND n.batch_id = a.batch_id JOIN psi b ON vb = b.vertex_id AND n.batch_id = b.batch_id JOIN psi c ON vc = c.vertex_id AND n.batch_id = c.batch_id""")
def pred_rectangular(spark, sf_dir):
    """Sources on an interval, targets on the square."""
    square = S.field(spark, sf_dir)
    flat = F.slice("xs", 1, 1)
    f = ImpulseResponseField.on(unit_grid(spark, S.GRID), unit_interval(spark, S.GRID)).with_tables(S.samples(spark, sf_dir).withColumn("xs", flat), square.batches, {"v", "mu", "sigma"})
    out = predictions(f, S.pairs(spark, sf_dir), S.sources(spark, sf_dir).withColumn("x", F.slice("x", 1, 1)), FREE)
    return rounded(out.drop("point"), "value")


SHIFTED = "SELECT id, 1.4::DOUBLE * x0 - 0.2::DOUBLE AS x0, 1.4::DOUBLE * x1 - 0.2::DOUBLE AS x1 FROM ({})"


@query("pred_source_domain", f"WITH {sql.predictions(OPEN, SHIFTED.format(sql.SUPPLIERS))} SELECT target_id, source_id, rnk, sample_id, {r('value')} AS value FROM pred WHERE NOT excluded")
def pred_source_domain(spark, sf_dir):
    """Sources off the source mesh, where the moment fields say nothing, have no predictions."""
    s = S.sources(spark, sf_dir).withColumn("x", F.transform("x", lambda v: 1.4 * v - 0.2))
    return rounded(predictions(S.field(spark, sf_dir), S.pairs(spark, sf_dir), s, OPEN).drop("point"), "value")


@query("field_by_batches", f"WITH {sql.kernel(BASE, RBF, pairs=sql.ORDERED)} {KER}")
def field_by_batches(spark, sf_dir):
    """The field made batch by batch, its sample search rebuilt once at the end."""
    whole_field = S.field(spark, sf_dir)
    f = replace(whole_field, samples=None, batches=None, sample_has=frozenset(), num_batches=0, num_sample_points=0)
    psi = {}
    for row in whole_field.batches.orderBy("batch_id", "vertex_id").collect():
        psi.setdefault(row.batch_id, []).append(row.psi)
    samples = S.samples(spark, sf_dir).orderBy("sample_id").collect()
    for b, values in psi.items():
        own = [s for s in samples if s.batch_id == b]
        f = f.add_batch([s.xs for s in own], values, [s.v for s in own], [s.mu for s in own], [s.sigma for s in own], rebuild=False)
    k = KernelEvaluator(f.rebuild_kdtree(), config=BASE, rbf=RBF)
    return rounded(k.entries(S.pairs(spark, sf_dir).join(S.sources(spark, sf_dir), "source_id")), "value").where("value <> 0")


NEEDS = [("mean_translation", "frame", "smp mu"), ("mean_translation", "frame", "fld mu"), ("whitened_affine", "frame", "smp mu"), ("whitened_affine", "frame", "fld mu"), ("whitened_affine", "frame", "smp sigma"), ("whitened_affine", "frame", "fld sigma"), ("none", "scaling", "smp v"), ("volume", "scaling", "fld v"), ("volume_det", "scaling", "fld v"), ("volume_det", "scaling", "smp sigma"), ("volume_det", "scaling", "fld sigma"), ("ellipsoid", "support", "smp mu"), ("ellipsoid", "support", "smp sigma")]
KINDS = {"frame": Frame, "scaling": Scaling, "support": Support}


@query("missing_moments", "WITH " + ", ".join(f"{k} AS (SELECT unnest({[e.value for e in v]}) AS {k})" for k, v in KINDS.items()) + f", needs AS (SELECT * FROM (VALUES {', '.join(map(str, NEEDS))}) n(choice, kind, what)) SELECT frame, scaling, support, count(DISTINCT what) AS missing FROM frame, scaling, support LEFT JOIN needs ON (kind = 'frame' AND choice = frame) OR (kind = 'scaling' AND choice = scaling) OR (kind = 'support' AND choice = support) GROUP BY ALL")
def missing_moments(spark, sf_dir):
    """How many requirements of each configuration a field without moments lacks, from the one error that lists them."""
    f = ImpulseResponseField.on(unit_grid(spark, 2))
    rows = []
    for frame, scaling, support in product(Frame, Scaling, Support):
        try:
            f.validate(EvalConfig(frame, scaling, support, 2.0, 3))
            n = 0
        except ValueError as e:
            n = str(e).count("\n")
        rows.append((frame.value, scaling.value, support.value, n))
    return spark.createDataFrame(rows, "frame string, scaling string, support string, missing long")


FLOOR = "(0.01::DOUBLE + 0.003::DOUBLE * (id % 6))"
FLOORS = CLAMP.replace("0.015::DOUBLE", FLOOR)


@query("spd_clamp_vector_floors", f"{FLOORS} SELECT id, lo < {FLOOR} AS modified, {', '.join(f'{r(f'CASE WHEN lo < {FLOOR} THEN {e} ELSE {x} END')} AS {x}' for x, e in (('a', f'p * a + greatest(lo, {FLOOR}) - p * lo'), ('b', 'p * b'), ('c', f'p * c + greatest(lo, {FLOOR}) - p * lo')))} FROM g")
def spd_clamp_vector_floors(spark, sf_dir):
    """Each matrix has a floor of its own."""
    k = F.col("s_suppkey")
    b = 0.002 * (k % 5)
    s = S.read(spark, sf_dir, "supplier").select(k.alias("id"), F.array(0.01 * (k % 9) - 0.01, b, b, 0.01 * (k % 4)).alias("sigma"))
    out = clamp_column(s, "sigma", 0.01 + 0.003 * (F.col("id") % 6), 2)
    return rounded(out.select("id", "modified", F.col("sigma")[0].alias("a"), F.col("sigma")[1].alias("b"), F.col("sigma")[3].alias("c")), "a", "b", "c")


# Radial basis functions and kernels


@query("rbf_min_degree", "SELECT * FROM (VALUES ('gaussian', -1), ('inverse_multiquadric', -1), ('multiquadric', 0), ('linear', 0), ('thin_plate_spline', 1), ('cubic', 1)) t(kernel, degree)")
def rbf_min_degrees(spark, sf_dir):
    return spark.createDataFrame([(k.value, rbf_min_degree(k)) for k in RBFKernel], "kernel string, degree int")


THREE = f"""WITH {sql.FIELD}, src AS ({sql.SUPPLIERS}), near AS (SELECT src.id, src.x0 AS sx0, src.x1 AS sx1, smp.*, row_number() OVER (PARTITION BY src.id ORDER BY (src.x0 - smp.x0) * (src.x0 - smp.x0) + (src.x1 - smp.x1) * (src.x1 - smp.x1), sample_id) AS ord FROM src, smp QUALIFY ord <= 3),
w AS (SELECT id, {', '.join(f'max(CASE WHEN ord = {i} THEN x0 - sx0 END) AS {n}0, max(CASE WHEN ord = {i} THEN x1 - sx1 END) AS {n}1, max(CASE WHEN ord = {i} THEN v END) AS f{n}' for i, n in enumerate('abc', 1))} FROM near GROUP BY id)
SELECT id AS source_id, {r('(fa * (b0 * c1 - c0 * b1) + fb * (c0 * a1 - a0 * c1) + fc * (a0 * b1 - b0 * a1)) / ((b0 - a0) * (c1 - a1) - (c0 - a0) * (b1 - a1))')} AS value FROM w"""


@query("rbf_interpolate", THREE)
def rbf_interpolation(spark, sf_dir):
    """Masses of the three nearest samples interpolated at each source: through three points with a linear tail, that is affine."""
    near = nearest_samples(S.sources(spark, sf_dir), S.samples(spark, sf_dir), 3, 2)
    rows = near.join(S.samples(spark, sf_dir), "sample_id").groupBy("source_id").agg(F.array_sort(F.collect_list(F.struct("rnk", "xs", "v"))).alias("n")).join(S.sources(spark, sf_dir), "source_id")

    def run(batches):
        for b in batches:
            got = [rbf_interpolate([c["v"] for c in n], [c["xs"] for c in n], [x])[0] for n, x in zip(b.column("n").to_pylist(), b.column("x").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("source_id"), pa.array(got, pa.float64())], names=["source_id", "value"])

    return rounded(rows.select("source_id", "x", "n").mapInArrow(run, "source_id long, value double"), "value")


ONE_EACH = replace(BASE, num_neighbors=1, symmetric_combine=SymmetricCombine.POOLED)
BACK = f"SELECT source_id AS target_id, target_id AS source_id FROM ({sql.ORDERED})"


@query("pooled_two", f"""WITH fwd AS (WITH {sql.predictions(ONE_EACH)} SELECT target_id, source_id, 1 AS ord, x0 - sx0 AS d0, x1 - sx1 AS d1, value FROM pred WHERE NOT excluded),
bwd AS (WITH {sql.predictions(ONE_EACH, sql.CUSTOMERS, sql.SUPPLIERS, BACK)} SELECT source_id AS target_id, target_id AS source_id, 2 AS ord, x0 - sx0 AS d0, x1 - sx1 AS d1, value FROM pred WHERE NOT excluded),
kept AS (SELECT * FROM fwd UNION ALL SELECT * FROM bwd), {sql.fitted(RBF)} {KER}""")
def pooled_two(spark, sf_dir):
    """One neighbour from each side, pooled, for customers and suppliers that an order joins."""
    f = S.field(spark, sf_dir)
    k = KernelEvaluator(f, f, ONE_EACH, RBF)
    return rounded(k.entries(S.pairs(spark, sf_dir).join(S.sources(spark, sf_dir), "source_id")), "value").where("value <> 0")


@query("single_entries", f"WITH {sql.kernel(OPEN, RBF)}, few AS (SELECT t.range AS target_id, s.range AS source_id FROM range(1, 5) t, range(1, 5) s) SELECT target_id, source_id, {r('coalesce(value, 0)')} AS value FROM few LEFT JOIN ker USING (target_id, source_id)")
def single_entries(spark, sf_dir):
    """Entries asked for one by one."""
    k = kernel_of(spark, sf_dir, OPEN)
    y = {row.target_id: row.y for row in S.targets(spark, sf_dir).where("target_id between 1 and 4").collect()}
    x = {row.source_id: row.x for row in S.sources(spark, sf_dir).where("source_id between 1 and 4").collect()}
    return rounded(spark.createDataFrame([(t, s, k(y[t], x[s])) for t in y for s in x], "target_id long, source_id long, value double"), "value")


# Blocks


def digits(df: DataFrame, name: str, n: int = 4) -> DataFrame:
    """The first n digits of a positive column and its power of ten, in place of the column."""
    power = F.floor(F.log10(name))
    return df.withColumns({"digits": F.round(F.col(name) / F.pow(F.lit(10.0), power - (n - 1))).cast("long"), "power": power.cast("long")}).drop(name)


def digits_sql(x: str, n: int = 4) -> str:
    return f"CAST(round({x} / pow(10.0::DOUBLE, floor(log10({x})) - {n - 1})) AS BIGINT) AS digits, CAST(floor(log10({x})) AS BIGINT) AS power"


def norms(b: B.BlockLowRank) -> DataFrame:
    return b.norms()


PART_NORMS = f"WITH {BISECT}, kern AS (WITH {sql.kernel(BASE, RBF)} SELECT * FROM ker), n AS (SELECT part_id, sqrt(sum(value * value)) AS norm FROM kern JOIN part USING (source_id) GROUP BY part_id) SELECT part_id, {digits_sql('norm')} FROM n"


@query("block_norms", PART_NORMS)
def block_norms(spark, sf_dir):
    """Norms of the blocks that rtol 1e-3 leaves: what an orthogonal truncation drops is 5e-7 of the norm at most."""
    return digits(norms(compressed(spark, sf_dir, 1e-3)), "norm")


@query("svd_blocks", PART_NORMS)
def svd_blocks(spark, sf_dir):
    """The same by truncated SVD at rtol 1e-4."""
    return digits(norms(compressed(spark, sf_dir, 1e-4, KernelLowRankOptions(method=CompressionMethod.DENSE_SVD))), "norm")


@query("aca_blocks", PART_NORMS)
def aca_blocks(spark, sf_dir):
    """The same by cross approximation at rtol 1e-7."""
    return digits(norms(compressed(spark, sf_dir, 1e-7, KernelLowRankOptions(method=CompressionMethod.ACA))), "norm")


@query("kernel_low_rank", f"WITH {sql.kernel(OPEN, RBF)}, n AS (SELECT sqrt(sum(value * value)) AS norm FROM ker) SELECT CAST(0 AS INTEGER) AS part_id, TRUE AS below_full_rank, {digits_sql('norm', 2)} FROM n")
def kernel_low_rank(spark, sf_dir):
    """One factored block for the whole kernel: its norm, and that it has fewer than all ranks."""
    k = kernel_of(spark, sf_dir, OPEN)
    rows = cut(B.kernel_low_rank_points(k, S.targets(spark, sf_dir), S.sources(spark, sf_dir), 1e-2, KernelLowRankOptions(method=CompressionMethod.DENSE_SVD)))
    b = B.BlockLowRank(0, 0, rows)
    return digits(norms(b).join(rows.select("part_id", (F.col("rank") < F.least(B.total("source_counts"), B.total("target_counts"))).alias("below_full_rank")), "part_id"), "norm", 2)


@query("brlr_round_trip", product_sql(False))
def brlr_round_trip(spark, sf_dir):
    """The operator written, read again and multiplied."""
    path = folder(spark, "blocks")
    compressed(spark, sf_dir, 0.0).write(path)
    u = weights(spark, sf_dir).select("source_id", F.array("u").alias("u"))
    return whole(B.BlockLowRank.read(spark, path).apply(u).select("target_id", F.col("u")[0].alias("value")))


A, Bs = (lambda k, p: f"(({k} * ({k} * {p} + 5)) % 101) / 101.0::DOUBLE"), (3, 7, 12)
LOW = " + ".join(f"{A('c_custkey', p)} * {A('s_suppkey', p + 1)}" for p in Bs)


@query("rsvd_of_low_rank", f"WITH n AS (SELECT sqrt(sum(v * v)) AS norm FROM (SELECT {LOW} AS v FROM customer, supplier)) SELECT CAST(3 AS INTEGER) AS rank, {digits_sql('norm', 8)} FROM n")
def rsvd_of_low_rank(spark, sf_dir):
    """A rank-3 operator in four factored blocks, whose randomised SVD finds rank and norm from products alone."""
    axis = lambda table, key, name, shift: S.read(spark, sf_dir, table).select(F.col(key).cast("int").alias(name), F.array(*[((F.col(key) * (F.col(key) * (p + shift) + 5)) % 101) / F.lit(101.0) for p in Bs]).alias("f"))
    t, s = axis("customer", "c_custkey", "target_id", 0), axis("supplier", "s_suppkey", "source_id", 1)
    gather = lambda d, i: (F.transform(F.array_sort(F.collect_list(F.struct(i, "f"))), lambda x: x[i]).alias(f"{i}s"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(i, "f"))), lambda x: x["f"])).alias(f"{d}_factor"))
    own = s.withColumn("part_id", F.col("source_id") % 4).groupBy("part_id").agg(*gather("source", "source_id"))
    made = own.crossJoin(F.broadcast(t.agg(*gather("target", "target_id"))))
    blocks = made.select("part_id", "source_ids", "target_ids", F.lit(True).alias("factored"), F.lit(3).alias("rank"), "target_factor", "source_factor", F.lit(False).alias("used_aca"), F.lit(True).alias("converged"), F.lit(False).alias("hit_max_rank"), F.lit(0.0).alias("relerr_estimate"))
    b = B.BlockLowRank.of(s.count(), t.count(), blocks)
    u, v, rank = B.randomized_svd_blocks(b, 8, RSVDOptions(power_iterations=2, rtol=1e-8))
    gram = lambda d: np.array(d.agg(*[F.sum(F.col("u")[i] * F.col("u")[j]) for i in range(rank) for j in range(rank)]).first()).reshape(rank, rank)
    norm = float(np.sqrt((gram(u) * gram(v)).sum()))
    return digits(spark.createDataFrame([(rank, norm)], "rank int, norm double"), "norm", 8)


# Factorisations


def triangles(spark, sf_dir) -> DataFrame:
    """label and the R factor of the label's embeddings in each task, so that no task needs all rows of a label."""
    e = S.read(spark, sf_dir, "embeddings").select(F.col("label").cast("int").alias("label"), "embedding")

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            label, x = b.column(0).to_numpy(zero_copy_only=False), np.array(b.column(1).to_pylist(), float)
            for k in np.unique(label):
                held[k] = lowrank.thin_qr(np.vstack([*([held[k]] if k in held else []), x[label == k]]))[1]
        for k, t in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([t.ravel()], pa.list_(pa.float64()))], names=["label", "r"])

    return e.mapInArrow(run, "label int, r array<double>")


GRAM = "WITH x AS (SELECT label, row_number() OVER () AS i, embedding FROM embeddings), e AS (SELECT label, i, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS k FROM x), g AS (SELECT a.label, a.k, b.k AS l, sum(a.v * b.v) AS s FROM e a JOIN e b USING (i) GROUP BY ALL), t AS (SELECT label, sum(CASE WHEN k = l THEN s END) AS energy, sqrt(sum(s * s)) AS norm FROM g GROUP BY label)"


@query("factorizations", f"{GRAM} SELECT CAST(label AS INTEGER) AS label, round(energy, 3) + 0.0 AS qr_energy, round(energy, 3) + 0.0 AS svd_energy, round(0.5 * norm, 3) + 0.0 AS product_norm FROM t")
def factorizations(spark, sf_dir):
    """Thin QR and SVD keep each label's energy; doubled factors of half its Gram matrix keep their norm when recompressed."""

    def run(table: pa.Table) -> pa.Table:
        x = np.vstack([np.array(t, float).reshape(-1, 64) for t in table.column("r").to_pylist()])
        q, tri = lowrank.thin_qr(x)
        svd = lowrank.truncated_svd(x, 0.0)
        g = lowrank.recompress(lowrank.LowRank(np.hstack([x.T, x.T]), np.hstack([x.T, -0.5 * x.T])), 1e-10)
        assert np.allclose(q.T @ q, np.eye(q.shape[1])) and g.rank <= 64
        return pa.table({"label": table.column("label")[:1], "qr_energy": [float((tri * tri).sum())], "svd_energy": [float((svd.U * svd.U).sum())], "product_norm": [float(np.linalg.norm(g.to_dense()))]})

    out = triangles(spark, sf_dir).groupBy("label").applyInArrow(run, "label int, qr_energy double, svd_energy double, product_norm double")
    return out.select("label", *[(F.round(c, 3) + 0.0).alias(c) for c in ("qr_energy", "svd_energy", "product_norm")])


CAUCHY = "SELECT round(sum(1 / (1 + (s.x0 - n.x0) * (s.x0 - n.x0))), 5) + 0.0 AS total FROM src s, smp n"


@query("functor_sums", f"WITH {sql.FIELD}, src AS ({sql.SUPPLIERS}), t AS ({CAUCHY}) SELECT total AS aca_total, total AS rsvd_total FROM t")
def functor_sums(spark, sf_dir):
    """A smooth matrix known by its rows and columns (ACA) or by its action (randomised SVD); sums of what they make of it."""
    x = np.array([row.x[0] for row in S.sources(spark, sf_dir).collect()])
    z = np.array([row.xs[0] for row in S.samples(spark, sf_dir).collect()])
    a = 1 / (1 + (x[:, None] - z[None]) ** 2)
    cross = lowrank.aca(lambda i: a[i], lambda j: a[:, j], *a.shape, 1e-10).factors
    action = lowrank.randomized_svd(lambda v: a @ v, lambda v: a.T @ v, *a.shape, len(z))
    total = lambda f: float(f.U.sum(0) @ f.V.sum(0))
    return spark.createDataFrame([(round(total(cross), 5) + 0.0, round(total(action), 5) + 0.0)], "aca_total double, rsvd_total double")


# The rotating test kernel and its statistics

FROG = "mass * (1 + cos(p0 / 0.05) * sin(p1 / 0.025)) * exp(-0.5 * (p0 * p0 / 0.01 + p1 * p1 / 0.0025)) / (2 * pi() * 0.1 * 0.05)"
FROG_PAIRS = f"WITH src AS ({sql.SUPPLIERS}), tgt AS ({sql.CUSTOMERS}), prs AS ({sql.ORDERED}), d AS (SELECT target_id, source_id, s.x0 * (1 - s.x0) * s.x1 * (1 - s.x1) AS mass, (s.x0 + s.x1) * pi() / 2 AS t, y.x0 - s.x0 AS d0, y.x1 - s.x1 AS d1 FROM prs JOIN src s ON s.id = source_id JOIN tgt y ON y.id = target_id), p AS (SELECT *, cos(t) * d0 - sin(t) * d1 AS p0, sin(t) * d0 + cos(t) * d1 AS p1 FROM d), k AS (SELECT target_id, source_id, {FROG} AS value FROM p)"


def frog_values(spark, sf_dir) -> DataFrame:
    pairs = S.pairs(spark, sf_dir).join(S.sources(spark, sf_dir), "source_id")
    return pairs.select("target_id", "source_id", frog.value_column(F.col("y"), F.col("x")).alias("value"))


@query("frog_kernel", f"{FROG_PAIRS} SELECT target_id, source_id, {r('value')} AS value FROM k")
def frog_kernel(spark, sf_dir):
    return rounded(frog_values(spark, sf_dir), "value")


@query("relative_column_error", f"{FROG_PAIRS}, c AS (SELECT source_id, sqrt(sum(value * value)) AS n FROM k GROUP BY source_id) SELECT source_id, {r('0.25 * n / greatest(n, 0.01 * (SELECT max(n) FROM c))')} AS error FROM c")
def relative_column_error(spark, sf_dir):
    """Errors of a matrix a quarter too large."""
    k = frog_values(spark, sf_dir)
    return rounded(frog.relative_column_errors(k, k.withColumn("value", F.col("value") * 1.25)), "error")


@query("frog_candidates", "SELECT count(*) AS candidates FROM (SELECT (range % 41) / 40.0::DOUBLE AS x, (range // 41) / 40.0::DOUBLE AS y FROM range(1681)) WHERE x * (1 - x) * y * (1 - y) > 1e-5 / 16")
def frog_candidates(spark, sf_dir):
    """Vertices with mass enough to be picked."""
    p = np.array([row.p for row in unit_grid(spark, 40).vertices.collect()])
    m = frog.mass(p)
    return spark.createDataFrame([(int((m > frog.LEAST_MASS * m.max()).sum()),)], "candidates long")


@query("place_statistics", "WITH o AS (SELECT l_extendedprice AS v, row_number() OVER (ORDER BY l_extendedprice) - 1 AS k, count(*) OVER () AS n FROM lineitem), p AS (SELECT p_size AS v, row_number() OVER (ORDER BY p_size) - 1 AS k, count(*) OVER () AS n FROM part) SELECT q, (SELECT max(v) FROM o WHERE k = floor(q * (n - 1))) AS price, (SELECT max(v) FROM p WHERE k = n // 2) AS middle_size, greatest(1, CAST(q * 1000 AS BIGINT) // 34) AS matched_rank FROM (VALUES (0.0::DOUBLE), (0.25::DOUBLE), (0.5::DOUBLE), (1.0::DOUBLE)) t(q)")
def place_statistics(spark, sf_dir):
    """Order statistics without interpolation, and the rank whose storage matches a number of entries."""
    items = S.read(spark, sf_dir, "lineitem")
    sizes = [row.p_size for row in S.read(spark, sf_dir, "part").select("p_size").collect()]
    rows = [(q, frog.percentile(items, "l_extendedprice", q), frog.median_int(sizes), frog.storage_matched_rank(int(q * 1000), 17)) for q in (0.0, 0.25, 0.5, 1.0)]
    price, size = items.schema["l_extendedprice"].dataType.simpleString(), S.read(spark, sf_dir, "part").schema["p_size"].dataType.simpleString()
    return spark.createDataFrame(rows, f"q double, price {price}, middle_size {size}, matched_rank long")

"""Per-neighbour kernel predictions and support ellipsoids as relational pipelines.

Source-side work (location, field values, neighbours, scalings) is done once a source; targets join it, the gate comes
before point location, and only rows inside the gate look a response up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefield.config import EvalConfig, Frame, Scaling
from pulsefield.functions import vectors as V
from pulsefield.operators.classes import distinct_points, members, spread
from pulsefield.operators.field import ImpulseResponseField
from pulsefield.operators.mesh import locate
from pulsefield.operators.neighbors import nearest_samples
from pulsefield.plans.lineage import cut

#: Sources and targets that a task sweeps at a time.
SWEEP = (128, 2048)
#: Points of at most so many rows are broadcast to the ellipsoids that may hold them.
BROADCAST_POINTS = 200_000


def at_sources(field: ImpulseResponseField, sources: DataFrame, c: EvalConfig) -> DataFrame:
    """source_id, x and the fields there that the configuration needs (v_x, mu_x, w_x); uninformed sources have no row."""
    ds, dt = field.dim_source, field.dim_target
    rows = sources.select("source_id", "x")
    if not c.needs_fields:
        return rows
    names = ["v"] * c.needs_v + ["mu"] * c.needs_mu + ["w"] * c.needs_w
    at = locate(rows, field.source, "x", ["source_id"]).where(F.col("cell_id").isNotNull())
    at = at.join(field.source.per_cell(field.moments, names), "cell_id")
    alpha, k = F.col("alpha"), ds + 1
    wide = {"v": 1, "mu": dt, "w": dt * dt}
    got = {n: V.weighted(alpha, F.col(n), k, wide[n]) for n in names}
    return at.select("source_id", "x", *[(g[0] if n == "v" else F.array(*g)).alias(f"{n}_x") for n, g in got.items()])


def with_neighbours(field: ImpulseResponseField, at: DataFrame, c: EvalConfig) -> DataFrame:
    """A row for each source and neighbour with the sample's columns and the scale of its response."""
    near = nearest_samples(at, field.samples, c.num_neighbors, field.dim_source)
    s = at.join(near, "source_id").join(field.samples, "sample_id")
    if c.scaling is Scaling.NONE:
        scale = F.col("v") if field.normalized else F.lit(1.0)
    else:
        scale = F.col("v_x") if field.normalized else F.col("v_x") / F.col("v")
        if c.scaling is Scaling.VOLUME_DET:
            det_w = V.det(V.vec("w_x", field.dim_target**2), field.dim_target)
            scale = scale * F.sqrt(F.col("sigma_det") / (1.0 / (det_w * det_w)))
    return s.withColumn("scale", scale)


def predictions(field: ImpulseResponseField, pairs: DataFrame, sources: DataFrame, c: EvalConfig, keep_excluded: bool = False) -> DataFrame:
    """target_id, source_id, rnk, sample_id, point, value (and excluded) of each pair's neighbours.

    pairs: target_id, y, source_id; sources: source_id, x. A neighbour beyond the gate stays with value 0; an ungated one
    whose carried point is off the target mesh is left out (or kept as excluded).
    """
    if not field.num_sample_points:
        empty = pairs.limit(0).select("target_id", "source_id", F.lit(0).alias("rnk"), F.lit(0).alias("sample_id"), F.col("y").alias("point"), F.lit(0.0).alias("value"))
        return empty.withColumn("excluded", F.lit(False)) if keep_excluded else empty
    field.ready(c)
    near = with_neighbours(field, at_sources(field, sources, c), c)
    rows = pairs.select("target_id", "y", "source_id").join(near, "source_id")
    ds, dt = field.dim_source, field.dim_target
    y, mu_i = V.vec("y", dt), V.vec("mu", dt)
    if c.frame is Frame.IDENTITY:
        z = y
    elif c.frame is Frame.TRANSLATION:
        z = V.plus(V.minus(y, V.vec("x", ds)), V.vec("xs", ds))
    elif c.frame is Frame.MEAN_TRANSLATION:
        z = V.plus(V.minus(y, V.vec("mu_x", dt)), mu_i)
    else:
        rows = rows.withColumn("white", F.array(*V.times(V.vec("w_x", dt * dt), V.minus(y, V.vec("mu_x", dt)))))
        z = V.plus(mu_i, V.times(V.vec("sigma_sqrt", dt * dt), V.vec("white", dt)))
    rows = rows.withColumn("z", F.array(*z))
    inside = F.lit(True)
    if c.gated:
        if c.frame is Frame.WHITENED_AFFINE:
            w = V.vec("white", dt)
            inside = V.dot(w, w) <= c.tau**2
        else:
            inside = V.quadratic(V.vec("sigma_inv", dt * dt), V.minus(V.vec("z", dt), mu_i)) <= c.tau**2
    rows = rows.withColumn("inside", inside)
    rows = locate(rows.withColumn("z", F.when(F.col("inside"), F.col("z"))), field.target, "z", ["target_id", "source_id", "rnk"])
    # Rows without a cell get keys of their own kind, so that they don't meet in one task.
    rows = rows.withColumn("cell", F.coalesce("cell_id", (-1 - F.pmod(F.xxhash64("target_id", "source_id"), F.lit(1 << 20))).cast("int")))
    psi = field.target.per_cell(field.batches, ["psi"], ["batch_id"]).withColumnRenamed("cell_id", "cell")
    rows = rows.join(psi, ["cell", "batch_id"], "left")
    raw = V.weighted(F.col("alpha"), F.col("psi"), dt + 1, 1)[0]
    out = rows.select("target_id", "source_id", "rnk", "sample_id", F.col("xs").alias("point"), F.when(F.col("inside") & F.col("cell_id").isNotNull(), F.col("scale") * raw).otherwise(0.0).alias("value"), (F.col("inside") & F.col("cell_id").isNull()).alias("excluded"))
    return out if keep_excluded else out.where(~F.col("excluded")).drop("excluded")


def predictions_over_targets(field: ImpulseResponseField, targets: DataFrame, sources: DataFrame, c: EvalConfig) -> DataFrame:
    """Predictions of every (target, source) pair with the mask of excluded neighbours."""
    return predictions(field, targets.select("target_id", "y").crossJoin(sources.select("source_id")), sources, c, keep_excluded=True)


def sums_over_targets(field: ImpulseResponseField, targets: DataFrame, sources: DataFrame, c: EvalConfig) -> DataFrame:
    """source_id, rnk, n, n_excluded, total: what predictions_over_targets has for each source and neighbour, counted and summed.

    Swept in numpy by tiles of distinct points, so that no row a pair is made.
    """
    if not field.num_sample_points:
        return sources.limit(0).select("source_id", F.lit(0).alias("rnk"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("n_excluded"), F.lit(0.0).alias("total"))
    field.ready(c)
    t, s = cut(distinct_points(targets, "target_id", "y")), cut(distinct_points(sources, "source_id", "x"))
    context, ds, dt = targets.sparkSession.sparkContext, field.dim_source, field.dim_target
    sent = context.broadcast(field.arrays())

    def dealt(df: DataFrame, i: str, p: str, size: int, *more: str) -> DataFrame:
        n = max(1, -(-df.count() // size))
        return df.groupBy(F.pmod(F.xxhash64(i), F.lit(n)).alias(f"{i}_tile")).agg(F.flatten(F.collect_list(p)).alias(f"{p}s"), *[F.collect_list(m).alias(f"{m}s") for m in more])

    def run(batches):
        f = sent.value
        for b in batches:
            for r in b.to_pylist():
                y, copies = np.asfortranarray(np.array(r["ys"]).reshape(-1, dt)), np.array(r["copiess"], float)
                at, ids = f.at_sources(np.array(r["xs"]).reshape(-1, ds), c), np.array(r["source_ids"])
                k, rows = at["near"].shape[1], np.flatnonzero(at["informed"])
                swept = (f.sweep(y, at, i, c) for i in rows)
                sums = [(v @ copies, e.astype(float) @ copies) for v, e in swept]
                total, gone = np.array(sums, float).reshape(-1, 2, k).transpose(1, 0, 2).reshape(2, -1)
                rnk = np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(ids[rows], k).astype(np.int64)), pa.array(rnk), pa.array(np.full(len(gone), int(copies.sum()))), pa.array(gone.astype(np.int64)), pa.array(total)], names=["source_id", "rnk", "n", "n_excluded", "total"])

    tiles = dealt(t, "target_id", "y", SWEEP[1], "copies").crossJoin(dealt(s, "source_id", "x", SWEEP[0], "source_id"))
    got = tiles.repartition(4 * context.defaultParallelism, F.xxhash64("target_id_tile", "source_id_tile")).select("ys", "copiess", "xs", "source_ids").mapInArrow(run, "source_id long, rnk int, n long, n_excluded long, total double")
    sums = got.groupBy("source_id", "rnk").agg(*[F.sum(x).alias(x) for x in ("n", "n_excluded", "total")])
    return spread(sums, members(sources, s, "source_id", "x"), "source_id")


def support_ellipsoids(field: ImpulseResponseField, sources: DataFrame, c: EvalConfig) -> DataFrame:
    """source_id, ord, c, s: unit-scale ellipsoids outside of whose union the source's predictions are zero."""
    if not c.gated:
        raise ValueError("support_ellipsoids: predictions have compact support only under the ellipsoid gate")
    field.validate(c)
    if not field.num_sample_points:
        return sources.limit(0).select("source_id", F.lit(0).alias("ord"), F.col("x").alias("c"), F.col("x").alias("s"))
    field.ready(c)
    ds, dt = field.dim_source, field.dim_target
    at = at_sources(field, sources, c)
    t2 = c.tau**2
    if c.frame is Frame.WHITENED_AFFINE:
        w = V.vec("w_x", dt * dt)
        return at.select("source_id", F.lit(1).alias("ord"), F.col("mu_x").alias("c"), F.array(*[t2 * x for x in V.inverse(V.product(w, w, dt), dt)]).alias("s"))
    near = nearest_samples(at, field.samples, c.num_neighbors, ds)
    rows = at.join(near, "source_id").join(field.samples, "sample_id")
    center = {Frame.IDENTITY: lambda: F.col("mu"), Frame.MEAN_TRANSLATION: lambda: F.col("mu_x"), Frame.TRANSLATION: lambda: F.array(*V.minus(V.plus(V.vec("x", ds), V.vec("mu", dt)), V.vec("xs", ds)))}[c.frame]()
    return rows.select("source_id", F.col("rnk").alias("ord"), center.alias("c"), F.array(*[t2 * x for x in V.vec("sigma", dt * dt)]).alias("s"))


def points_in_ellipsoids(ellipsoids: DataFrame, points: DataFrame, d: int, keep: list[str], point: str) -> DataFrame:
    """keep columns of ellipsoids (c, s) beside those of points inside them, by buckets about as wide as an ellipsoid.

    The bounding box of {p : (p - c)' s^-1 (p - c) <= 1} has half-widths sqrt(s_ii).
    """
    half = [F.sqrt(F.col("s")[i * d + i]) for i in range(d)]
    wide = ellipsoids.agg(*[F.avg(2 * h).alias(f"w{i}") for i, h in enumerate(half)]).first()
    step = [max(w or 1.0, 1e-12) for w in wide]
    e = ellipsoids.withColumn("__inv", F.array(*V.inverse(V.vec("s", d * d), d)))
    p = points
    for i in range(d):
        lo, hi = F.floor((F.col("c")[i] - half[i]) / step[i] - 1e-9), F.floor((F.col("c")[i] + half[i]) / step[i] + 1e-9)
        e = e.withColumn(f"__b{i}", F.explode(F.sequence(lo, hi)))
        p = p.withColumn(f"__b{i}", F.floor(F.col(point)[i] / step[i]))
    # Buckets are few where ellipsoids are wide: ellipsoids are dealt over tasks, not by bucket, if the points can go to each.
    if points.limit(BROADCAST_POINTS + 1).count() <= BROADCAST_POINTS:
        e, p = e.repartition(4 * points.sparkSession.sparkContext.defaultParallelism, keep[0]), F.broadcast(p)
    met = e.join(p, [f"__b{i}" for i in range(d)])
    inside = V.quadratic(V.vec("__inv", d * d), V.minus(V.vec(point, d), V.vec("c", d))) <= 1
    return met.where(inside).select(*keep, *points.columns)

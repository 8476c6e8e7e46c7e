"""Impulse-response fields: meshes, batches of responses, their samples and moments, as an immutable handle on tables."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsefield.config import EvalConfig, Frame, Scaling
from pulsefield.functions.evaluator import FieldArrays
from pulsefield.functions.spd import min_eigenvalue, with_parts
from pulsefield.operators.mesh import Mesh

ARRAY = T.ArrayType(T.DoubleType(), False)
MOMENTS = ("v", "mu", "sigma")
SAMPLES = "sample_id int, batch_id int, xs array<double>, v double, mu array<double>, sigma array<double>"


def rows_of(x, n: int, width: int | None, what: str) -> list:
    """n rows of an optional array; width None: scalars."""
    if x is None:
        return [None] * n
    x = np.asarray(x, float)
    x = x.reshape(n, -1) if width and x.size == n * width else x
    if x.shape != ((n, width) if width else (n,)):
        raise ValueError(f"{what} must have shape {(n, width) if width else (n,)}, not {x.shape}")
    return x.tolist()


@dataclass(frozen=True)
class ImpulseResponseField:
    """Tables: samples (sample_id, batch_id, xs, v, mu, sigma and parts of sigma), batches (batch_id, vertex_id, psi) and
    moments (vertex_id, v, mu, sigma, w). Which moments there are is the same for all rows of a table.

    Every change gives a new field; a refused change leaves the old one as it was.
    """

    target: Mesh
    source: Mesh
    normalized: bool = True
    samples: DataFrame | None = None
    batches: DataFrame | None = None
    moments: DataFrame | None = None
    sample_has: frozenset[str] = frozenset()
    field_has: frozenset[str] = frozenset()
    num_batches: int = 0
    num_sample_points: int = 0
    stale: bool = False

    @staticmethod
    def on(target: Mesh, source: Mesh | None = None, batches_normalized: bool = True) -> ImpulseResponseField:
        return ImpulseResponseField(target, source or target, batches_normalized)

    @property
    def dim_target(self) -> int:
        return self.target.dim

    @property
    def dim_source(self) -> int:
        return self.source.dim

    def with_tables(self, samples: DataFrame, batches: DataFrame, has: set[str]) -> ImpulseResponseField:
        """The field with these sample and batch tables; `has` names the moments that samples carry."""
        dt = self.dim_target
        cols = [F.col(c) if c in samples.columns else F.lit(None).cast(t).alias(c) for c, t in (("v", "double"), ("mu", "array<double>"), ("sigma", "array<double>"))]
        samples = samples.select("sample_id", "batch_id", "xs", *cols)
        if "sigma" in has:
            samples = with_parts(samples, "sigma", dt)
            self.refuse_indefinite(samples.select(F.col("sample_id").alias("id"), "sigma"), "sample")
        n, b = samples.agg(F.count(F.lit(1)), F.countDistinct("batch_id")).first()
        return replace(self, samples=samples, batches=batches.select("batch_id", "vertex_id", "psi"), sample_has=frozenset(has), num_sample_points=n, num_batches=b)

    def refuse_indefinite(self, sigmas: DataFrame, what: str) -> None:
        bad = sigmas.where(~(min_eigenvalue(F.col("sigma"), self.dim_target) > 0))
        if bad.limit(1).collect():
            n = bad.count()
            ids = [r.id for r in bad.orderBy("id").limit(10).collect()]
            raise ValueError(f"{n} {what} covariances are not positive definite, at {what} ids {ids}; clamp_spd can raise their eigenvalues")

    def add_batch(self, points, psi, V=None, mu=None, sigma=None, rebuild: bool = True) -> ImpulseResponseField:
        """The field with one more response psi (a value at each target vertex) to impulses at points (k, dim_source)."""
        points, psi = np.asarray(points, float), np.asarray(psi, float)
        points = points.reshape(-1, 1) if points.ndim == 1 and self.dim_source == 1 else points
        if points.ndim != 2 or not len(points) or points.shape[1] != self.dim_source:
            raise ValueError("add_batch: points must be (k, dim_source) with k >= 1")
        if psi.ndim != 1 or len(psi) != self.target.vertices.count():
            raise ValueError("add_batch: psi must have a value for each target vertex")
        k, dt = len(points), self.dim_target
        has = {n for n, x in (("v", V), ("mu", mu), ("sigma", sigma)) if x is not None}
        if self.num_batches and has != self.sample_has:
            raise ValueError("add_batch: moments must be those of the first batch")
        spark = self.target.vertices.sparkSession
        first, b = self.num_sample_points, self.num_batches
        cols = zip(points.tolist(), rows_of(V, k, None, "V"), rows_of(mu, k, dt, "mu"), rows_of(sigma, k, dt * dt, "sigma"), strict=True)
        new = spark.createDataFrame([(first + i, b, *c) for i, c in enumerate(cols)], SAMPLES)
        if "sigma" in has:
            new = with_parts(new, "sigma", dt)
            self.refuse_indefinite(new.select(F.col("sample_id").alias("id"), "sigma"), "sample")
        ids = [r.vertex_id for r in self.target.vertices.select("vertex_id").orderBy("vertex_id").collect()]
        values = spark.createDataFrame([(b, i, float(x)) for i, x in zip(ids, psi, strict=True)], "batch_id int, vertex_id int, psi double")
        return replace(
            self,
            samples=self.samples.unionByName(new) if self.samples is not None else new,
            batches=self.batches.unionByName(values) if self.batches is not None else values,
            sample_has=frozenset(has),
            num_batches=b + 1,
            num_sample_points=first + k,
            stale=not rebuild,
        )

    def rebuild_kdtree(self) -> ImpulseResponseField:
        """The field with its sample search brought up to date."""
        return replace(self, stale=False)

    def set_moment_fields(self, moments: DataFrame | None = None, V=None, mu=None, sigma=None) -> ImpulseResponseField:
        """The field with all three vertex fields replaced; what is not given is unset.

        moments: vertex_id with any of v, mu, sigma; or arrays by source vertex.
        """
        dt = self.dim_target
        if moments is None:
            n = self.source.vertices.count()
            has = {k for k, x in (("v", V), ("mu", mu), ("sigma", sigma)) if x is not None}
            rows = [(i, *c) for i, c in enumerate(zip(rows_of(V, n, None, "V"), rows_of(mu, n, dt, "mu"), rows_of(sigma, n, dt * dt, "sigma"), strict=True))]
            moments = self.source.vertices.sparkSession.createDataFrame(rows, "vertex_id int, v double, mu array<double>, sigma array<double>")
        else:
            has = {c for c in MOMENTS if c in moments.columns}
        if not has:
            return replace(self, moments=None, field_has=frozenset())
        moments = moments.select("vertex_id", *[c for c in MOMENTS if c in has])
        if "sigma" in has:
            self.refuse_indefinite(moments.select(F.col("vertex_id").alias("id"), "sigma"), "vertex")
            moments = with_parts(moments, "sigma", dt).withColumnRenamed("sigma_inv_sqrt", "w").drop("sigma_inv", "sigma_sqrt", "sigma_det")
        return replace(self, moments=moments, field_has=frozenset(has))

    def validate(self, c: EvalConfig) -> None:
        """Raise one ValueError that lists all that the configuration needs and the field lacks."""
        need: list[str] = []
        sample = lambda name: [] if name in self.sample_has else [f"per-sample {name} (add_batch)"]
        fields = lambda name: [] if name in self.field_has else [f"vertex field {name} (set_moment_fields)"]
        if c.num_neighbors < 1:
            need.append("num_neighbors >= 1")
        if c.frame is Frame.TRANSLATION and self.dim_source != self.dim_target:
            need.append("equal source and target dimensions (frame translation)")
        if c.needs_mu:
            need += sample("mu") + fields("mu")
        if c.frame is Frame.WHITENED_AFFINE:
            need += sample("sigma") + fields("sigma")
        if c.scaling is Scaling.NONE:
            need += sample("v") if self.normalized else []
        else:
            need += fields("v") + ([] if self.normalized else sample("v"))
        if c.scaling is Scaling.VOLUME_DET:
            need += sample("sigma") + fields("sigma")
        if c.gated:
            need += sample("mu") + sample("sigma") + ([] if c.tau > 0 else ["tau > 0"])
        if need:
            raise ValueError("this configuration requires:\n  - " + "\n  - ".join(dict.fromkeys(need)))

    def ready(self, c: EvalConfig) -> None:
        self.validate(c)
        if self.stale:
            raise RuntimeError("the sample search is stale; call rebuild_kdtree() after add_batch(..., rebuild=False)")

    # What the field holds, as small arrays on the driver, and its operators as methods

    def _samples(self, name: str, width: int | None, present: bool = True) -> np.ndarray | None:
        if not present:
            return None
        rows = [r[0] for r in self.samples.orderBy("sample_id").select(name).collect()] if self.samples is not None else []
        return np.array(rows, float).reshape(len(rows), *([width] if width else []))

    @property
    def sample_points(self) -> np.ndarray:
        return self._samples("xs", self.dim_source)

    @property
    def sample_V(self) -> np.ndarray | None:
        return self._samples("v", None, "v" in self.sample_has)

    @property
    def sample_mu(self) -> np.ndarray | None:
        return self._samples("mu", self.dim_target, "mu" in self.sample_has)

    @property
    def sample_Sigma(self) -> np.ndarray | None:
        d = self.dim_target
        flat = self._samples("sigma", d * d, "sigma" in self.sample_has)
        return None if flat is None else flat.reshape(-1, d, d)

    @property
    def point2batch(self) -> np.ndarray:
        return self._samples("batch_id", None).astype(int)

    def batch_range(self, batch: int) -> tuple[int, int]:
        """The half-open range of the batch's sample ids."""
        low, high = self.samples.where(F.col("batch_id") == batch).agg(F.min("sample_id"), F.max("sample_id")).first() if self.samples is not None else (None, None)
        if low is None:
            raise ValueError(f"batch_range: there is no batch {batch}")
        return low, high + 1

    def batch_values(self, batch: int) -> np.ndarray:
        """The batch's response at each target vertex."""
        rows = self.batches.where(F.col("batch_id") == batch).orderBy("vertex_id").select("psi").collect() if self.batches is not None else []
        if not rows:
            raise ValueError(f"batch_values: there is no batch {batch}")
        return np.array([r.psi for r in rows], float)

    def predictions(self, pairs: DataFrame, sources: DataFrame, config: EvalConfig) -> DataFrame:
        from pulsefield.operators.predictions import predictions

        return predictions(self, pairs, sources, config)

    def predictions_over_targets(self, targets: DataFrame, sources: DataFrame, config: EvalConfig) -> DataFrame:
        from pulsefield.operators.predictions import predictions_over_targets

        return predictions_over_targets(self, targets, sources, config)

    def support_ellipsoids(self, sources: DataFrame, config: EvalConfig) -> DataFrame:
        from pulsefield.operators.predictions import support_ellipsoids

        return support_ellipsoids(self, sources, config)

    def nearest_sample_distance(self, sources: DataFrame) -> DataFrame:
        """source_id, dist; infinite without samples."""
        from pulsefield.operators.neighbors import nearest_sample_distance

        if self.samples is None:
            return sources.select("source_id", F.lit(float("inf")).alias("dist"))
        return nearest_sample_distance(sources, self.samples.select("sample_id", "xs"), self.dim_source)

    def arrays(self, most_values: int = 1 << 25) -> FieldArrays:
        """The field as arrays for use inside a task; refuses more than most_values batch values."""
        target = self.target.arrays()
        source = target if self.source is self.target else self.source.arrays()
        if self.num_batches * len(target.vertices) > most_values:
            raise ValueError("this field is too large to be held by one task; use the relational predictions")
        # Sorted here, as a sorted plan of a small table takes three jobs.
        s = sorted(self.samples.collect(), key=lambda r: r.sample_id) if self.samples is not None else []
        b = self.batches.select("batch_id", "vertex_id", "psi").toPandas().sort_values(["batch_id", "vertex_id"])["psi"].to_numpy(float) if s else np.zeros(0)
        m = sorted(self.moments.collect(), key=lambda r: r.vertex_id) if self.moments is not None else []
        dt = self.dim_target
        col = lambda rows, name, has, shape: np.array([r[name] for r in rows], float).reshape(len(rows), *shape) if name in has else None
        batch = {k: i for i, k in enumerate(sorted({r.batch_id for r in s}))}
        return FieldArrays(
            target,
            source,
            b.reshape(len(batch), -1) if s else np.zeros((0, len(target.vertices))),
            np.array([batch[r.batch_id] for r in s], int),
            np.array([r.xs for r in s], float).reshape(len(s), self.dim_source),
            self.normalized,
            *(col(s, n, self.sample_has, shape) for n, shape in (("v", ()), ("mu", (dt,)), ("sigma", (dt, dt)))),
            *(col(m, n, self.field_has, shape) for n, shape in (("v", ()), ("mu", (dt,)), ("sigma", (dt, dt)))),
        )

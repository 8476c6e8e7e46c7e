"""Kernel entries over tables of targets and sources."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsefield.config import EvalConfig, RBFScheme, SymmetricCombine
from pulsefield.functions.evaluator import KernelArrays
from pulsefield.operators.classes import SharedEntries, distinct_points, members
from pulsefield.operators.field import ImpulseResponseField
from pulsefield.operators.neighbors import nearest_sample_distance
from pulsefield.operators.predictions import points_in_ellipsoids, support_ellipsoids
from pulsefield.plans.lineage import cut

#: Sources and targets in a dense tile, which is one unit of work; a symmetric kernel sweeps along both axes.
TILE, SQUARE = (128, 2048), (1024, 1024)
ENTRY = "target_id long, source_id long, value double"


def as_array(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


class KernelEvaluator:
    """Entries from the column field alone or, with a row field, symmetrically from both."""

    def __init__(self, col_field: ImpulseResponseField, row_field: ImpulseResponseField | None = None, config: EvalConfig | None = None, rbf: RBFScheme | None = None, duplicate_tol: float = 1e-7):
        self.col_field, self.row_field = col_field, row_field
        self.config, self.rbf, self.duplicate_tol = config or EvalConfig(), rbf or RBFScheme(), duplicate_tol
        if not duplicate_tol >= 0:
            raise ValueError("KernelEvaluator: duplicate_tol must be >= 0")
        col_field.validate(self.config)
        if row_field:
            if len({col_field.dim_source, col_field.dim_target, row_field.dim_source, row_field.dim_target}) != 1:
                raise ValueError("KernelEvaluator: symmetric mode needs equal dimensions throughout")
            row_field.validate(self.config)
        elif self.config.symmetric_combine is SymmetricCombine.CRISSCROSS:
            raise ValueError("KernelEvaluator: crisscross needs a row field; give the same field twice for a symmetric operator")
        self._arrays: KernelArrays | None = None

    @property
    def symmetric(self) -> bool:
        return self.row_field is not None

    @property
    def dim_source(self) -> int:
        return self.col_field.dim_source

    @property
    def dim_target(self) -> int:
        return self.col_field.dim_target

    def arrays(self) -> KernelArrays:
        if self._arrays is None:
            for f in (self.col_field, self.row_field):
                if f and f.num_sample_points:
                    f.ready(self.config)
            col = self.col_field.arrays()
            row = col if self.row_field is self.col_field else self.row_field.arrays() if self.row_field else None
            self._arrays = KernelArrays(col, row, self.config, self.rbf, self.duplicate_tol)
        return self._arrays

    def __call__(self, y, x) -> float:
        """One entry, on the driver."""
        one = lambda p: np.asarray(p, float).reshape(1, -1)
        return float(self.arrays().block(one(y), one(x))[0, 0])

    def target_support(self, sources: DataFrame) -> DataFrame:
        return support_ellipsoids(self.col_field, sources, self.config)

    def source_support(self, targets: DataFrame) -> DataFrame:
        """target_id, ord, c, s in the source domain; symmetric mode only."""
        if not self.row_field:
            raise RuntimeError("source_support needs symmetric mode: a row field")
        flipped = targets.select(F.col("target_id").alias("source_id"), F.col("y").alias("x"))
        return support_ellipsoids(self.row_field, flipped, self.config).withColumnRenamed("source_id", "target_id")

    def support_pairs(self, targets: DataFrame, sources: DataFrame) -> DataFrame:
        """target_id, source_id, y, x of the pairs that can be other than zero under the gate."""
        ell = self.target_support(sources)
        pairs = points_in_ellipsoids(ell, targets.select("target_id", "y"), self.dim_target, ["source_id"], "y").select("target_id", "source_id")
        if self.row_field:
            back = points_in_ellipsoids(self.source_support(targets), sources.select("source_id", "x"), self.dim_source, ["target_id"], "x")
            pairs = pairs.union(back.select("target_id", "source_id"))
        return pairs.distinct().join(sources.select("source_id", "x"), "source_id").join(targets.select("target_id", "y"), "target_id")

    def block(self, targets: DataFrame, sources: DataFrame) -> DataFrame:
        """target_id, source_id, value of all entries; a pair without a row is exactly 0."""
        return self.shared(targets, sources).rows()

    def shared(self, targets: DataFrame, sources: DataFrame) -> SharedEntries:
        """The entries of the distinct points, with the ids that each point stands for.

        The block is cut into tiles; under the gate, of those only that an ellipsoid reaches.
        """
        t, s = cut(distinct_points(targets, "target_id", "y")), cut(distinct_points(sources, "source_id", "x"))
        pooled = self.config.gated and self.row_field and self.config.symmetric_combine is SymmetricCombine.POOLED
        tiles = lambda *u: self.tiles(t, s, *u)
        # Pooled, an entry is a fit: only pairs in reach are made.
        values = (lambda: self.entries(self.support_pairs(t, s))) if pooled else tiles
        return SharedEntries(values, members(targets, t, "target_id", "y"), members(sources, s, "source_id", "x"), t, s, None if pooled else tiles)

    def entries(self, pairs: DataFrame) -> DataFrame:
        """Entries of given pairs (target_id, source_id, y, x).

        Crisscross pairs go to the side whose sample is nearer, so each is one field's sweep; only ties take both.
        """
        if not self.row_field or self.config.symmetric_combine is not SymmetricCombine.CRISSCROSS:
            return self._sweeps(pairs, "both")
        pairs = cut(pairs)  # it is read five times
        flipped = pairs.select(F.col("target_id").alias("id"), "y").distinct()
        dx = nearest_sample_distance(pairs.select("source_id", "x").distinct(), self._samples(self.col_field), self.dim_source).withColumnRenamed("dist", "dx")
        dy = nearest_sample_distance(flipped, self._samples(self.row_field), self.dim_target, "id", "y").withColumnsRenamed({"dist": "dy", "id": "target_id"})
        at = pairs.join(dx, "source_id").join(dy, "target_id")
        return self._sweeps(at.where("dx < dy"), "col").union(self._sweeps(at.where("dy < dx"), "row")).union(self._sweeps(at.where("dx = dy"), "both"))

    def _samples(self, field: ImpulseResponseField) -> DataFrame:
        if field.samples is not None:
            return field.samples.select("sample_id", "xs")
        return field.target.vertices.limit(0).select(F.col("vertex_id").alias("sample_id"), F.col("p").alias("xs"))

    def _sweeps(self, pairs: DataFrame, side: str) -> DataFrame:
        """Entries from the column field, the row field, or as block() has them, a whole Arrow batch of pairs at a time."""
        sent = pairs.sparkSession.sparkContext.broadcast(self.arrays())
        ds, dt = self.dim_source, self.dim_target
        hub, spoke = ("target_id", "source_id") if side == "row" else ("source_id", "target_id")

        def run(batches):
            k = sent.value
            for b in batches:
                t, s = (b.column(n).to_numpy(zero_copy_only=False).astype(np.int64) for n in ("target_id", "source_id"))
                y, x = as_array(b.column("y"), dt), as_array(b.column("x"), ds)
                _, first_t, of_t = np.unique(t, return_index=True, return_inverse=True)
                _, first_s, of_s = np.unique(s, return_index=True, return_inverse=True)
                value = k.pairs(y[first_t], x[first_s], of_t, of_s, side)
                live = value != 0
                yield pa.RecordBatch.from_arrays([pa.array(t[live]), pa.array(s[live]), pa.array(value[live])], names=["target_id", "source_id", "value"])

        rows = pairs.select("target_id", "source_id", "y", "x")
        # A source's targets stand together, but a source of very many is dealt over several tasks.
        spread = F.pmod(F.xxhash64(spoke), F.lit(8))
        return rows.repartition(hub, spread).sortWithinPartitions(hub).mapInArrow(run, ENTRY)

    def boxed(self, points: DataFrame, p: str, back: bool = False) -> DataFrame:
        """points with lo, hi: the box around each one's ellipsoids, null without one. back: of targets, in the source domain."""
        sent, d = points.sparkSession.sparkContext.broadcast(self.arrays()), self.dim_target if back else self.dim_source
        schema = T.StructType([*points.schema, *(T.StructField(n, T.ArrayType(T.DoubleType())) for n in ("lo", "hi"))])

        def run(batches):
            f = sent.value.row if back else sent.value.col
            for b in batches:
                live, *corners = f.boxes(as_array(b.column(p), d), sent.value.config)
                ends = [pa.array([c.tolist() if ok else None for ok, c in zip(live, x, strict=True)], pa.list_(pa.float64())) for x in corners]
                yield pa.RecordBatch.from_arrays([*b.columns, *ends], names=schema.names)

        return points.mapInArrow(run, schema)

    def dealt(self, df: DataFrame, i: str, p: str, size: int, d: int, across: int, *more: str) -> DataFrame:
        """Tiles of at most about size points: by hash or, under the gate, by squares of the plane. Where df has lo and hi
        (boxes in `across` dimensions), a tile has the box around them; a point without one reaches nothing."""
        box = df.agg(F.count(F.lit(1)).alias("n"), *[f(F.col(p)[k]).alias(f"{f.__name__}{k}") for k in range(d) for f in (F.min, F.max)]).first()
        n = max(1, -(-box.n // size))
        tile = [F.pmod(F.xxhash64(i), F.lit(n))]
        if self.config.gated and n > 1:
            g = max(1, round(n ** (1 / d)))
            cell = [F.least(F.lit(g - 1), F.floor((F.col(p)[k] - box[f"min{k}"]) / F.lit(max(box[f"max{k}"] - box[f"min{k}"], 1e-300)) * g)).alias(f"c{k}") for k in range(d)]
            df = df.select("*", *cell)
            names = [f"c{k}" for k in range(d)]
            shares = df.groupBy(*names).agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).alias("shares"))  # about n rows
            df = df.join(F.broadcast(shares), names)
            tile = [*map(F.col, names), F.pmod(F.xxhash64(i), F.col("shares"))]
        sums = [F.collect_list(i).alias(f"{i}s"), F.flatten(F.collect_list(p)).alias(f"{p}s"), *[F.collect_list(m).alias(f"{m}s") for m in more], *self.edges(i, p, d)]
        if "lo" in df.columns:
            sums += self.reach(i, across)
        return df.groupBy(F.struct(*[x.alias(f"k{j}") for j, x in enumerate(tile)]).alias(f"{i}_tile")).agg(*sums)

    @staticmethod
    def edges(i: str, p: str, d: int) -> list[Column]:
        return [f(F.col(p)[k]).alias(f"{i}_{f.__name__}{k}") for k in range(d) for f in (F.min, F.max)]

    @staticmethod
    def reach(i: str, d: int) -> list[Column]:
        return [f(F.col(n)[k]).alias(f"{i}_{n}{k}") for k in range(d) for n, f in (("lo", F.min), ("hi", F.max))]

    def meets(self) -> Column:
        """Whether a source tile's ellipsoids can hold a target of a target tile or, symmetrically, the other way round."""
        over = lambda a, b, d: reduce(Column.__and__, [(F.col(f"{a}_lo{k}") <= F.col(f"{b}_max{k}") + 1e-9) & (F.col(f"{a}_hi{k}") >= F.col(f"{b}_min{k}") - 1e-9) for k in range(d)])
        if not self.config.gated:
            return F.lit(True)
        meets = over("source_id", "target_id", self.dim_target)
        return F.coalesce(meets, F.lit(False)) | F.coalesce(over("target_id", "source_id", self.dim_source), F.lit(False)) if self.symmetric else meets

    def tiles(self, targets: DataFrame, sources: DataFrame, u: DataFrame | None = None, mine: str = "source_id") -> DataFrame:
        """Entries or, with u (mine, u), the other axis' ids with sums (value) over a tile of entries times u."""
        sent = targets.sparkSession.sparkContext.broadcast(self.arrays())
        ds, dt, gated = self.dim_source, self.dim_target, self.config.gated
        size = SQUARE if self.row_field else TILE
        weighed = u is not None
        if weighed:
            u = u.select(mine, F.col("u").cast("double").alias("u"))
            targets, sources = (x.join(u, mine, "left") if mine in x.columns else x for x in (targets, sources))

        def run(batches):
            k = sent.value
            for b in batches:
                for r in b.to_pylist():
                    t, s = np.array(r["target_ids"]), np.array(r["source_ids"])
                    a = k.block(np.array(r["ys"]).reshape(-1, dt), np.array(r["xs"]).reshape(-1, ds))
                    if weighed:
                        if mine == "target_id":
                            a, t, s = a.T, s, t
                        # A point without u has no part in any sum.
                        w = np.array([np.nan if x is None else x for x in r["us"]], float)
                        has = np.array([x is not None for x in r["us"]], bool)
                        live = (a[:, has] != 0).any(1)
                        yield pa.RecordBatch.from_arrays([pa.array(t[live].astype(np.int64)), pa.array(a[live][:, has] @ w[has])], names=["id", "value"])
                        continue
                    i, j = np.nonzero(a)
                    yield pa.RecordBatch.from_arrays([pa.array(t[i].astype(np.int64)), pa.array(s[j].astype(np.int64)), pa.array(a[i, j])], names=["target_id", "source_id", "value"])

        if gated:
            sources = self.boxed(sources, "x")
            targets = self.boxed(targets, "y", True) if self.symmetric else targets
        # A list leaves nulls out, so u goes in an array of its own.
        if weighed:
            targets, sources = (x.withColumn("u", F.array("u")) if "u" in x.columns else x for x in (targets, sources))
        more = lambda x: ["u"] if weighed and "u" in x.columns else []
        s = self.dealt(sources, "source_id", "x", size[0], ds, dt, *more(sources))
        t = self.dealt(targets, "target_id", "y", size[1], dt, ds, *more(targets))
        tiles = t.crossJoin(s).where(self.meets())
        n = max(1, tiles.sparkSession.sparkContext.defaultParallelism * 16)  # tiles differ much in their entries
        columns = ["target_ids", "ys", "source_ids", "xs", *[F.flatten("us").alias("us")] * weighed]
        return tiles.repartition(n, F.xxhash64("target_id_tile", "source_id_tile")).select(*columns).mapInArrow(run, "id long, value double" if weighed else ENTRY)

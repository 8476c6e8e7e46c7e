"""Simplicial meshes as tables, point location and piecewise-linear interpolation."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pulsefield.functions import vectors as V
from pulsefield.functions.evaluator import INSIDE, MeshArrays

ARRAY = T.ArrayType(T.DoubleType(), False)


@dataclass(frozen=True)
class Mesh:
    """vertices (vertex_id, p) and cells (cell_id, vertex_ids); grid: squares a side of a structured unit square."""

    vertices: DataFrame
    cells: DataFrame
    dim: int
    grid: int | None = None

    def corners(self) -> DataFrame:
        """cell_id, vertex_ids, pts: all corner coordinates in one flat array, in corner order."""
        each = self.cells.select("cell_id", "vertex_ids", F.posexplode("vertex_ids").alias("k", "vertex_id"))
        each = each.join(self.vertices, "vertex_id").groupBy("cell_id", "vertex_ids").agg(F.array_sort(F.collect_list(F.struct("k", "p"))).alias("c"))
        return each.select("cell_id", "vertex_ids", F.flatten(F.transform("c", lambda x: x["p"])).alias("pts"))

    def geometry(self) -> DataFrame:
        """cell_id, vertex_ids, low, high and affine: the flat map from [p, 1] to barycentric coordinates."""
        d = self.dim

        @F.pandas_udf(ARRAY)
        def affine(pts):
            import pandas as pd

            p = np.stack(pts.to_numpy()).reshape(-1, d + 1, d)
            one = np.concatenate([p, np.ones((len(p), d + 1, 1))], 2).transpose(0, 2, 1)
            return pd.Series(list(np.linalg.inv(one).reshape(len(p), -1)))

        c = self.corners()
        of = lambda f: F.array(*[f(*[F.col("pts")[k * d + i] for k in range(d + 1)]) for i in range(d)])
        return c.select("cell_id", "vertex_ids", of(F.least).alias("low"), of(F.greatest).alias("high"), affine("pts").alias("affine"))

    def per_cell(self, values: DataFrame, names: list[str], by: list[str] | None = None) -> DataFrame:
        """Vertex columns gathered by cell (and `by`): one flat array a column, corners in order."""
        by = by or []
        each = self.cells.select("cell_id", F.posexplode("vertex_ids").alias("k", "vertex_id")).join(values, "vertex_id")
        got = each.groupBy("cell_id", *by).agg(F.array_sort(F.collect_list(F.struct("k", *names))).alias("c"))
        flat = lambda n: F.flatten(F.transform("c", lambda x: x[n])) if isinstance(values.schema[n].dataType, T.ArrayType) else F.transform("c", lambda x: x[n])
        return got.select("cell_id", *by, *[flat(n).alias(n) for n in names])

    def arrays(self) -> MeshArrays:
        v = sorted(self.vertices.collect(), key=lambda r: r.vertex_id)
        c = sorted(self.cells.collect(), key=lambda r: r.cell_id)
        return MeshArrays(np.array([r.p for r in v], float).reshape(len(v), self.dim), np.array([r.vertex_ids for r in c], int).reshape(len(c), self.dim + 1), self.grid)


def unit_grid(spark: SparkSession, n: int) -> Mesh:
    """(n + 1)² vertices of the unit square and two triangles a square."""
    v = spark.range((n + 1) ** 2).select(F.col("id").cast("int").alias("vertex_id"), F.array((F.col("id") % (n + 1)) / F.lit(float(n)), F.floor(F.col("id") / (n + 1)) / F.lit(float(n))).alias("p"))
    q = spark.range(2 * n * n).select(F.col("id").cast("int").alias("cell_id"), (F.col("id") % 2).cast("int").alias("half"), F.floor(F.col("id") / 2).cast("int").alias("s"))
    a = (F.floor(F.col("s") / n) * (n + 1) + F.col("s") % n).cast("int")
    c = q.select("cell_id", F.when(F.col("half") == 0, F.array(a, a + 1, a + n + 2)).otherwise(F.array(a, a + n + 2, a + n + 1)).alias("vertex_ids"))
    return Mesh(v, c, 2, n)


def unit_interval(spark: SparkSession, n: int) -> Mesh:
    v = spark.range(n + 1).select(F.col("id").cast("int").alias("vertex_id"), F.array(F.col("id") / F.lit(float(n))).alias("p"))
    c = spark.range(n).select(F.col("id").cast("int").alias("cell_id"), F.array(F.col("id").cast("int"), F.col("id").cast("int") + 1).alias("vertex_ids"))
    return Mesh(v, c, 1)


def unit_cube(spark: SparkSession, n: int) -> Mesh:
    """(n + 1)³ vertices of the unit cube and six tetrahedra a cube, one for each order of the axes."""
    m = n + 1
    i = F.col("id")
    v = spark.range(m**3).select(i.cast("int").alias("vertex_id"), F.array((i % m) / F.lit(float(n)), (F.floor(i / m) % m) / F.lit(float(n)), F.floor(i / (m * m)) / F.lit(float(n))).alias("p"))
    paths = []
    for order in permutations((1, m, m * m)):
        paths.append([0, order[0], order[0] + order[1], 1 + m + m * m])
    s = F.floor(i / 6)
    base = (s % n) + (F.floor(s / n) % n) * m + F.floor(s / (n * n)) * m * m
    steps = F.element_at(F.array(*[F.array(*map(F.lit, p)) for p in paths]), (i % 6).cast("int") + 1)
    c = spark.range(6 * n**3).select(i.cast("int").alias("cell_id"), base.cast("int").alias("b"), steps.alias("steps"))
    return Mesh(v, c.select("cell_id", F.transform("steps", lambda x: x + F.col("b")).alias("vertex_ids")), 3)


def mesh_of(spark: SparkSession, vertices: np.ndarray, cells: np.ndarray) -> Mesh:
    """A mesh from arrays, one point and one cell a row."""
    v, c = np.asarray(vertices, float), np.asarray(cells, int)
    if v.ndim != 2 or c.ndim != 2 or c.shape[1] != v.shape[1] + 1:
        raise ValueError("mesh: vertices must be (nv, d) and cells (nc, d + 1)")
    vs = spark.createDataFrame([(i, p.tolist()) for i, p in enumerate(v)], "vertex_id int, p array<double>")
    cs = spark.createDataFrame([(i, ids.tolist()) for i, ids in enumerate(c)], "cell_id int, vertex_ids array<int>")
    return Mesh(vs, cs, v.shape[1])


def grid_cell(p: V.Vec, n: int) -> tuple[Column, Column, Column, Column]:
    """inside, cell id, vertex ids and barycentric coordinates on a structured unit square, by arithmetic alone."""
    inside = (p[0] >= -INSIDE) & (p[0] <= 1 + INSIDE) & (p[1] >= -INSIDE) & (p[1] <= 1 + INSIDE)
    at = [F.least(F.greatest(F.floor(x * n), F.lit(0)), F.lit(n - 1)).cast("int") for x in p]
    u, v = (x * n - i for x, i in zip(p, at, strict=True))
    low = v <= u
    a = at[1] * (n + 1) + at[0]
    cell = 2 * (at[1] * n + at[0]) + F.when(low, 0).otherwise(1)
    ids = F.array(a, F.when(low, a + 1).otherwise(a + n + 2), F.when(low, a + n + 2).otherwise(a + n + 1))
    alpha = F.array(F.when(low, 1 - u).otherwise(1 - v), F.when(low, u - v).otherwise(u), F.when(low, v).otherwise(v - u))
    return inside, cell, ids, alpha


def locate(points: DataFrame, mesh: Mesh, point: str, key: list[str], prefix: str = "") -> DataFrame:
    """points with cell_id and alpha of the lowest containing cell; null off the mesh. key: columns that identify a row.

    Structured squares need no join. Other meshes are found over buckets about the size of a cell: an equi-join of the
    point's bucket with the buckets that each cell's bounding box covers, then the barycentric test.
    """
    d = mesh.dim
    if mesh.grid:
        inside, cell, _, alpha = grid_cell(V.vec(point, 2), mesh.grid)
        return points.withColumns({prefix + "cell_id": F.when(inside, cell), prefix + "alpha": F.when(inside, alpha)})
    geo = mesh.geometry()
    size = geo.agg(*[F.avg(F.col("high")[i] - F.col("low")[i]).alias(f"s{i}") for i in range(d)]).first()
    step = [max(s or 1.0, 1e-12) for s in size]
    bucket = lambda x, i, shift=0.0: F.floor((x + shift) / step[i]).cast("long")
    cover = geo
    for i in range(d):
        cover = cover.withColumn(f"__b{i}", F.explode(F.sequence(bucket(F.col("low")[i], i, -1e-9), bucket(F.col("high")[i], i, 1e-9))))
    p = V.vec(point, d)
    mine = points.select(*key, *[p[i].alias(f"__p{i}") for i in range(d)], *[bucket(p[i], i).alias(f"__b{i}") for i in range(d)])
    met = mine.join(cover.select("cell_id", "affine", *[f"__b{i}" for i in range(d)]), [f"__b{i}" for i in range(d)])
    one = [*(F.col(f"__p{i}") for i in range(d)), F.lit(1.0)]
    alpha = V.times([F.col("affine")[i] for i in range((d + 1) ** 2)], one)
    met = met.withColumn("alpha", F.array(*alpha)).where(F.array_min("alpha") >= -INSIDE)
    best = met.groupBy(*key).agg(F.min_by(F.struct("cell_id", "alpha"), "cell_id").alias("__hit"))
    return points.join(best, key, "left").withColumns({prefix + "cell_id": F.col("__hit.cell_id"), prefix + "alpha": F.col("__hit.alpha")}).drop("__hit")


def interpolate(points: DataFrame, mesh: Mesh, values: DataFrame, point: str, key: list[str], names: list[str]) -> DataFrame:
    """points with piecewise-linear values of vertex columns; null off the mesh."""
    at = locate(points, mesh, point, key)
    got = at.join(mesh.per_cell(values, names).withColumnsRenamed({n: f"__{n}" for n in names}), "cell_id", "left")
    out = {}
    for n in names:
        if isinstance(values.schema[n].dataType, T.ArrayType):
            raise ValueError("interpolate takes scalar columns; see predictions for vectors")
        out[n] = V.weighted(F.col("alpha"), F.col(f"__{n}"), mesh.dim + 1, 1)[0]
    return got.withColumns(out).drop(*[f"__{n}" for n in names])

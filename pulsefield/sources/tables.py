"""The engine's domain derived from the star-schema tables by integer arithmetic on their keys.

nation gives samples, region their batches, supplier sources, customer targets; the mesh is the structured unit square.
Every number is rational (square roots aside), so other engines get the same ones.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pulsefield.operators.field import ImpulseResponseField
from pulsefield.operators.mesh import unit_grid
from pulsefield.plans.lineage import local

#: Squares a side of the mesh; width² of a response's bump.
GRID, WIDTH2 = 16, 0.0225


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scatter(key: Column, prime: int) -> Column:
    """A coordinate in [0, 1) that jumps about as the key counts up."""
    return ((key + 1) * prime) % 10007 / F.lit(10007.0)


def sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return read(spark, sf_dir, "supplier").select(k.alias("source_id"), F.array(scatter(k, 4799), scatter(k, 8641)).alias("x"))


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return read(spark, sf_dir, "customer").select(k.alias("target_id"), F.array(scatter(k, 3571), scatter(k, 9227)).alias("y"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """target_id, y, source_id of every customer and supplier that an order joins."""
    o, li = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem")
    met = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("target_id"), F.col("l_suppkey").alias("source_id")).distinct()
    return met.join(targets(spark, sf_dir), "target_id")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("n_nationkey")
    # The second coordinate goes by the key's square, so that no three samples are in line.
    x = [0.1 + 0.8 * scatter(k, 7919), 0.1 + 0.8 * scatter(k * (k + 2), 6271)]
    return read(spark, sf_dir, "nation").select(
        k.cast("int").alias("sample_id"),
        F.col("n_regionkey").cast("int").alias("batch_id"),
        F.array(*x).alias("xs"),
        (1 + (k % 5) / F.lit(4.0)).alias("v"),
        F.array(x[0] + 0.02, x[1] - 0.01).alias("mu"),
        F.array(0.02 + 0.001 * (k % 7), F.lit(0.004), F.lit(0.004), 0.03 + 0.001 * (k % 5)).alias("sigma"),
    )


def field(spark: SparkSession, sf_dir: str, normalized: bool = True) -> ImpulseResponseField:
    mesh = unit_grid(spark, GRID)
    mesh = replace(mesh, vertices=local(mesh.vertices), cells=local(mesh.cells))
    s = local(samples(spark, sf_dir))  # as many as nations
    p = mesh.vertices
    bump = 1 / (1 + ((F.col("p")[0] - F.col("mu")[0]) * (F.col("p")[0] - F.col("mu")[0]) + (F.col("p")[1] - F.col("mu")[1]) * (F.col("p")[1] - F.col("mu")[1])) / WIDTH2)
    psi = s.select("batch_id", "mu").crossJoin(F.broadcast(p)).groupBy("batch_id", "vertex_id").agg(F.sum(bump).alias("psi"))
    x, y = F.col("p")[0], F.col("p")[1]
    moments = p.select("vertex_id", (1 + 0.5 * x).alias("v"), F.array(x + 0.02, y - 0.01).alias("mu"), F.array(0.02 + 0.01 * x, F.lit(0.004), F.lit(0.004), 0.03 + 0.01 * y).alias("sigma"))
    return ImpulseResponseField.on(mesh, batches_normalized=normalized).with_tables(s, local(psi), {"v", "mu", "sigma"}).set_moment_fields(moments)

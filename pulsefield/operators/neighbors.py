"""Nearest-sample joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pulsefield.functions import vectors as V
from pulsefield.plans.lineage import cut

#: Samples up to this many rows go to every task; more are searched over a grid of buckets.
BROADCAST_ROWS = 20_000


def distance2(a: str, b: str, d: int):
    diff = V.minus(V.vec(a, d), V.vec(b, d))
    return V.dot(diff, diff)


def nearest_samples(queries: DataFrame, samples: DataFrame, k: int, d: int, query_id: str = "source_id", point: str = "x", broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """query_id, rnk (from 1), sample_id, d2: the k nearest samples of each query, ties by sample_id.

    samples: sample_id, xs. Few samples are one broadcast array in each row's scope, so nothing is shuffled.
    """
    rows = samples.select("sample_id", "xs")
    if rows.limit(broadcast_rows + 1).count() <= broadcast_rows:
        every = rows.agg(F.collect_list(F.struct("sample_id", "xs")).alias("__s"))
        met = queries.select(query_id, point).join(F.broadcast(every))
        ds = F.transform("__s", lambda s: F.struct(V.dot(*[V.minus(V.vec(point, d), [s["xs"][i] for i in range(d)])] * 2).alias("d2"), s["sample_id"].alias("sample_id")))
        top = met.select(query_id, F.posexplode(F.slice(F.array_sort(ds), 1, k)).alias("rnk", "n"))
        return top.select(query_id, (F.col("rnk") + 1).alias("rnk"), "n.sample_id", "n.d2")
    return bucket_nearest(queries, rows, k, d, query_id, point)


def bucket_nearest(queries: DataFrame, samples: DataFrame, k: int, d: int, query_id: str, point: str) -> DataFrame:
    """The same rows by equi-joins over ever larger buckets, for samples that no task should hold.

    A query is settled once its k-th neighbour is nearer than the edge of the 3^d buckets it has seen; the side doubles
    for the rest, and a side as large as the data settles all.
    """
    box = samples.agg(F.count(F.lit(1)).alias("n"), *[f(F.col("xs")[i]).alias(f"{f.__name__}{i}") for i in range(d) for f in (F.min, F.max)]).first()
    spans = [box[f"max{i}"] - box[f"min{i}"] for i in range(d)]
    side = max(1e-12, max(spans) / max(1.0, (box.n / max(1, k)) ** (1 / d)))
    todo, done = queries.select(query_id, point), None
    while True:
        cell = lambda c, i: F.floor(F.col(c)[i] / side).cast("long")  # noqa: B023, E731
        mine = todo.select("*", *[cell(point, i).alias(f"__q{i}") for i in range(d)])
        for i in range(d):
            mine = mine.withColumn(f"__b{i}", F.explode(F.array(*[F.col(f"__q{i}") + s for s in (-1, 0, 1)])))
        theirs = samples.select("sample_id", "xs", *[cell("xs", i).alias(f"__b{i}") for i in range(d)])
        met = mine.join(theirs, [f"__b{i}" for i in range(d)]).withColumn("d2", distance2(point, "xs", d))
        w = Window.partitionBy(query_id).orderBy("d2", "sample_id")
        top = cut(met.withColumn("rnk", F.row_number().over(w)).where(F.col("rnk") <= k))
        edge = F.least(*[F.least(F.col(point)[i] - (F.col(f"__q{i}") - 1) * side, (F.col(f"__q{i}") + 2) * side - F.col(point)[i]) for i in range(d)]) if d > 1 else F.least(F.col(point)[0] - (F.col("__q0") - 1) * side, (F.col("__q0") + 2) * side - F.col(point)[0])
        whole = side > 2 * max(max(abs(box[f"max{i}"]), abs(box[f"min{i}"])) for i in range(d)) + 2
        seen = top.groupBy(query_id).agg(F.count(F.lit(1)).alias("n"), F.max("d2").alias("far"), F.first(edge).alias("edge"))
        ok = seen.where((F.col("n") >= k) & (F.col("far") < F.col("edge") * F.col("edge"))).select(query_id) if not whole else todo.select(query_id)
        part = top.join(ok, query_id).select(query_id, "rnk", "sample_id", "d2")
        done = part if done is None else done.unionByName(part)
        if whole:
            return done
        todo = cut(todo.join(ok, query_id, "left_anti"))
        side *= 2
        if not todo.limit(1).count():
            return done


def nearest_sample_distance(queries: DataFrame, samples: DataFrame, d: int, query_id: str = "source_id", point: str = "x") -> DataFrame:
    """query_id, dist to the nearest sample; infinite where there are no samples."""
    near = nearest_samples(queries, samples, 1, d, query_id, point)
    return queries.select(query_id).join(near.select(query_id, F.sqrt("d2").alias("dist")), query_id, "left").withColumn("dist", F.coalesce("dist", F.lit(float("inf"))))

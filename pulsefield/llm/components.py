"""Connected components of an edge table: in one task while the edges are few, else by alternating star contractions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsefield.llm.common import checkpoint, map_arrow


#: Up to this many edges are united in one executor task (some 200 MB of Python there).
ONE_TASK = 1 << 20


def united(edges: DataFrame) -> DataFrame:
    """The components of u, v edges by union-find in one task; the smaller root wins."""

    def run(batches):
        home: dict = {}

        def find(x):
            while home[x] != x:
                home[x] = home[home[x]]
                x = home[x]
            return x

        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x, y = find(home.setdefault(x, x)), find(home.setdefault(y, y))
                if x != y:
                    home[max(x, y)] = min(x, y)
        nodes = list(home)
        yield pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array([find(x) for x in nodes], kind)], names=["node", "root"])

    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(edges.schema["u"].dataType)
    name = edges.schema["u"].dataType.simpleString()
    return map_arrow(edges.select("u", "v").coalesce(1), run, f"node {name}, root {name}")


def connected_components(edges: DataFrame, most_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """node, root of every node with an edge; root is the smallest node of its component. edges: a, b of one ordered type.

    Minima are partial sums by node and go back over a join, which adaptive execution may split, so a hub's edges need
    not meet in one task. Loops are ignored; no edges give no rows.
    """
    e = checkpoint(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    if e.count() <= one_task:
        return united(e)
    before = None
    for _ in range(most_rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(low.select("u", F.col("m").alias("v"))).distinct()
        e = checkpoint(small)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(e.select(F.col("v"), F.col("v")).distinct())

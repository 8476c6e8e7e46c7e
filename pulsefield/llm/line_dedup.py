"""Site-relative line deduplication with DataFrame functions only.

A line is boilerplate of its site if it stands on at least `min_pages` of the site's pages and on more than `ratio` of
them. Lines are counted by two 64-bit hashes, each page's distinct lines once, with partial sums before the shuffle. A
site can have at most (its mean distinct lines a page) / ratio boilerplate lines, so its list fits in a row; it is dealt
into SLOTS by hash, one of which a line is looked up in. Beyond a broadcast the lists are joined by site, where adaptive
execution splits the pages of a large site over tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pulsefield.llm.common import BROADCAST_BYTES, checkpoint

SLOTS = 64


def line_key(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit(11), line).alias("b"))


def boilerplate(df: DataFrame, text: str = "text", site: str = "source", ratio: float = 0.03, min_pages: int = 3, once: bool = False) -> DataFrame:
    """site, n, lines: each site's boilerplate line keys in SLOTS lists; sites without any have no row. once: equal texts of a site are one page."""
    pages = df.select(F.col(site).alias("site"), F.col(text).cast("string").alias("t")).withColumn("page", F.xxhash64("t"))
    n_pages = F.count_distinct("page") if once else F.count(F.lit(1))
    lines = F.array_distinct(F.filter(F.split("t", "\n"), lambda x: F.trim(x) != ""))
    keys = pages.select("site", "page", F.explode(lines).alias("line")).select("site", "page", line_key(F.col("line")).alias("k"))
    per_line = keys.groupBy("site", "k.a", "k.b").agg(n_pages.alias("n")).where(F.col("n") >= min_pages)
    per_site = pages.groupBy(F.col("site").alias("own")).agg(n_pages.alias("pages"))
    often = per_line.join(per_site, F.col("site").eqNullSafe(F.col("own"))).where(F.col("n") * 1_000_000 > F.col("pages") * round(ratio * 1_000_000))
    lists = often.groupBy("site").agg(F.collect_list(F.struct("a", "b")).alias("all"))
    dealt = F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), lambda k: F.filter("all", lambda x: F.pmod(x["a"], F.lit(SLOTS)) == k))
    return lists.select("site", F.size("all").alias("n"), dealt.alias("lines"))


def drop_boilerplate(df: DataFrame, text: str = "text", site: str = "source", ratio: float = 0.03, min_pages: int = 3, keep: tuple[str, ...] = ("doc_id",), broadcast_bytes: int = BROADCAST_BYTES, once: bool = False) -> DataFrame:
    """keep columns, n_lines, n_dropped and the text without its site's boilerplate lines, one row for each input row.

    Null texts have 0 lines and stay null; a null site is a site of its own; lines of blanks only are neither counted
    nor dropped; repeated rows count as so many pages, or with `once` equal texts of a site as one; an empty table gives
    no rows; columns other than `keep`, text and site are not read.
    """
    found = checkpoint(boilerplate(df, text, site, ratio, min_pages, once))
    size = found.agg(F.coalesce(F.sum(16 * F.col("n") + 32 * SLOTS), F.lit(0))).first()[0]
    rows = df.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keep)], F.col(site).alias("__site"), F.col(text).cast("string").alias("__text"))
    hint = F.broadcast if size <= broadcast_bytes else (lambda x: x)
    rows = rows.join(hint(found), F.col("__site").eqNullSafe(F.col("site")), "left")
    lines = F.split("__text", "\n")
    slot = lambda x: F.element_at("lines", F.pmod(F.xxhash64(x), F.lit(SLOTS)).cast("int") + 1)
    rows = rows.withColumn("__kept", F.when(F.col("lines").isNotNull(), F.filter(lines, lambda x: ~F.array_contains(slot(x), line_key(x)))))
    n = F.when(F.col("__text").isNull(), 0).otherwise(F.size(lines)).cast("long")
    dropped = F.when(F.col("__kept").isNull(), 0).otherwise(F.size(lines) - F.size("__kept")).cast("long")
    clean = F.when(F.col("__kept").isNull(), F.col("__text")).otherwise(F.array_join("__kept", "\n"))
    return rows.select(*[F.col(f"__k{i}").alias(k) for i, k in enumerate(keep)], n.alias("n_lines"), dropped.alias("n_dropped"), clean.alias("text"))


SQL = """
WITH d AS (SELECT doc_id, source, text, string_split(text, chr(10)) AS lines FROM documents),
u AS (SELECT source, unnest(list_distinct(list_filter(lines, lambda x: trim(x) <> ''))) AS line FROM d),
c AS (SELECT source, line, count(*) AS n FROM u GROUP BY source, line),
p AS (SELECT source, count(*) AS pages FROM documents GROUP BY source),
b AS (SELECT c.source, list(c.line) AS gone FROM c JOIN p ON c.source IS NOT DISTINCT FROM p.source
      WHERE n >= 3 AND n * 1000000 > pages * 30000 GROUP BY c.source),
k AS (SELECT d.*, CASE WHEN gone IS NULL THEN lines ELSE list_filter(lines, lambda x: NOT list_contains(gone, x)) END AS kept
      FROM d LEFT JOIN b ON d.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, coalesce(len(lines), 0) AS n_lines, coalesce(len(lines) - len(kept), 0) AS n_dropped,
       CASE WHEN len(kept) = 0 AND text IS NOT NULL THEN '' ELSE array_to_string(kept, chr(10)) END AS text
FROM k
"""

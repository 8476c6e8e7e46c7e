"""Five stages that turn the documents table into a clean, tokenised corpus.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept; all but the last return the
columns of documents. Stages 1, 3 and 4 drop whole documents, stage 2 lines, and stage 5 adds tokens.

In every stage an empty table gives an empty table, repeated rows are judged alike, columns beside those of documents are
not read, and a row with nulls stays unless the stage's own rule drops it: a null text has no language and goes in stage 1;
in the later stages it has no lines, words or tokens, so nothing is dropped for it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pulsefield.llm.bpe_codec import round_trip
from pulsefield.llm.common import BROADCAST_BYTES, checkpoint, read_table, remove, shared_dir
from pulsefield.llm.decontamination import decontaminate
from pulsefield.llm.language_id import UNKNOWN, fit, identify
from pulsefield.llm.line_dedup import drop_boilerplate
from pulsefield.llm.ngram_join import link_components

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Documents whose language score is below this are rejected. The winner's score is never below 0.5, the boundary itself;
#: the README has the held-out scores of clean texts and of random letters from which this was chosen.
LEAST_SCORE = 0.75


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents without a letter and those whose language no machine is sure of."""
    docs = docs.select(*COLUMNS)
    out = identify(docs, fit(docs), keep=COLUMNS)
    return out.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= LEAST_SCORE)).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops each site's boilerplate lines; the documents stay, with n_chars of what is left.

    Equal texts of a site vote once, so that a group of copies keeps its lines for the next stage.
    """
    out = drop_boilerplate(docs, keep=("doc_id", "lang", "source"), once=True)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """docs less those whose doc_id and text hash stand in gone, th."""
    hint = F.broadcast if gone.count() * 48 <= BROADCAST_BYTES else (lambda x: x)
    return docs.join(hint(gone), F.col("doc_id").eqNullSafe(F.col("gone")) & (F.xxhash64("text") == F.col("th")), "left_anti")


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles at a Jaccard similarity of 0.8, the smallest doc_id stays.

    Documents without words are linked with nothing and stay; rows of one doc_id and text are one document, rows of one
    doc_id (or of none) with other texts are others, and of linked ones under the smallest doc_id one stays.
    """
    docs = docs.select(*COLUMNS)
    linked = link_components(docs, n=5, num=80, den=100, hashed=True).where("root is not null")
    gone = linked.where("not doc_id <=> component_id").select(F.col("doc_id").alias("gone"), "th")
    first = linked.where("doc_id <=> component_id").groupBy("root", F.col("doc_id").alias("gone")).agg(F.array_sort(F.collect_set("th")).alias("ths"))
    gone = checkpoint(gone.union(first.where(F.size("ths") > 1).select("gone", F.explode(F.expr("slice(ths, 2, size(ths))")).alias("th"))).distinct())
    out = without(docs, gone)
    if docs.groupBy("doc_id").count().where("count > 1").limit(1).count():
        same = Window.partitionBy("doc_id", F.xxhash64("text")).orderBy("lang", "source")
        out = out.withColumn("nth", F.row_number().over(same)).where("nth = 1").drop("nth")
    return out


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a ten-word window of a benchmark item."""
    docs = docs.select(*COLUMNS)
    found = decontaminate(docs.withColumn("th", F.xxhash64("text")), read_table(spark, sf_dir, "benchmark"), keep=("doc_id", "th"), slop=-1)
    gone = checkpoint(found.where("contaminated").select(F.col("doc_id").alias("gone"), "th").distinct())
    return without(docs, gone)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, their number, and digests of the ids and of the text they decode to."""
    out = round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), keep=("doc_id", "lang", "source"), ids=True)
    return out.drop("decoded")


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark_free", benchmark_free), ("tokens", tokens)]

#: Language identification and tokenisation have no SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written as Parquet in the shared folder, read again, and goes after the next."""
    docs = read_table(spark, sf_dir, "documents")
    folder, before = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            remove(spark, before)
        before = f"{folder}/{name}"
    return docs

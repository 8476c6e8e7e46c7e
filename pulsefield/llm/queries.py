"""Registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame, and their DuckDB SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from pulsefield.llm import line_dedup, secret_scan
from pulsefield.llm.common import read_table


def op1_line_dedup(spark, sf_dir):
    from pulsefield.llm.line_dedup import drop_boilerplate

    return drop_boilerplate(read_table(spark, sf_dir, "documents"))


def op2_ngram_join(spark, sf_dir):
    from pulsefield.llm.ngram_join import link_components

    return link_components(read_table(spark, sf_dir, "documents"))


def op3_secret_scan(spark, sf_dir):
    from pulsefield.llm.secret_scan import scan

    return scan(read_table(spark, sf_dir, "documents"))


def op4_decontamination(spark, sf_dir):
    from pulsefield.llm.decontamination import decontaminate

    out = decontaminate(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.drop("spans", "items", "near")


def op5_suffix_dedup(spark, sf_dir):
    from pulsefield.llm.suffix_dedup import drop_repeats

    return drop_repeats(read_table(spark, sf_dir, "documents"))


def op6_language_id(spark, sf_dir):
    from pulsefield.llm.language_id import crc_part, fit, identify

    docs = read_table(spark, sf_dir, "documents")
    held = docs.withColumn("held_out", F.coalesce(crc_part("doc_id", 4) == 2, F.lit(False)))
    return identify(held, fit(docs), keep=("doc_id", "held_out"))


def op7_bpe_codec(spark, sf_dir):
    from pulsefield.llm.bpe_codec import round_trip

    return round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"))


def op8_mpeg_audio(spark, sf_dir):
    from pulsefield.llm.mpeg_audio import audio_columns

    return audio_columns(read_table(spark, sf_dir, "documents"))


def op9_lm_scoring(spark, sf_dir):
    from pulsefield.llm.language_id import crc_part
    from pulsefield.llm.lm_scoring import score

    return score(read_table(spark, sf_dir, "documents"), crc_part("doc_id", 10) == 0)


def op10_token_counts(spark, sf_dir):
    from pulsefield.llm.token_counts import count_tokens

    return count_tokens(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {f.__name__: f for f in (op1_line_dedup, op2_ngram_join, op3_secret_scan, op4_decontamination, op5_suffix_dedup, op6_language_id, op7_bpe_codec, op8_mpeg_audio, op9_lm_scoring, op10_token_counts)}
ORACLE_SQL: dict[str, str] = {"op1_line_dedup": line_dedup.SQL, "op3_secret_scan": secret_scan.sql()}

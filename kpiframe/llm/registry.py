"""Registered queries of the corpus operators and their DuckDB SQL."""

from __future__ import annotations

import functools
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiframe.llm import conversation_repair, decontamination, hard_negatives, license_scan, source_mix, url_rules, vector_topk
from kpiframe.llm.bpe_codec import bpe_codec
from kpiframe.llm.common import prepare
from kpiframe.llm.exact_dedup import exact_dedup
from kpiframe.llm.language_crf import identify
from kpiframe.llm.near_dedup import near_dedup
from kpiframe.llm.quality_gam import quality_scores
from kpiframe.llm.token_counts import count_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
BYTE_BPE = "byte_bpe_50k.json"


def _query(f):
    @functools.wraps(f)
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        prepare(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = query
    return query


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_language_crf(spark, sf_dir):
    return identify(table(spark, sf_dir, "documents"))


@_query
def op2_vector_topk(spark, sf_dir):
    vectors = (
        table(spark, sf_dir, "embeddings")
        .filter(vector_topk.usable(F.col("embedding")))
        .select(F.col("vec_id").alias("id"), vector_topk.quantised(F.col("embedding")).alias("v"))
    )
    return vector_topk.top_k(vectors, vectors.filter(F.col("id") % 100 == 0))


ORACLE["op2_vector_topk"] = vector_topk.ORACLE


@_query
def op3_source_mix(spark, sf_dir):
    lines, targets, plan = source_mix.mix_sources(table(spark, sf_dir, "documents"))
    return source_mix.taken_words(lines, targets, plan).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


ORACLE["op3_source_mix"] = source_mix.ORACLE


@_query
def op4_quality_gam(spark, sf_dir):
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@_query
def op5_url_rules(spark, sf_dir):
    return url_rules.url_verdicts(table(spark, sf_dir, "pages"))


ORACLE["op5_url_rules"] = url_rules.oracle()


@_query
def op6_exact_dedup(spark, sf_dir):
    return exact_dedup(table(spark, sf_dir, "documents")).drop("place")


ORACLE["op6_exact_dedup"] = r"""
WITH d AS (
  SELECT doc_id, length(COALESCE(text, '')) AS chars, row_number() OVER () AS rid,
    sha256(regexp_replace(COALESCE(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256)::BIGINT AS group_size,
  rid = first_value(rid) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY chars DESC, doc_id NULLS LAST, rid)
"""


@_query
def op7_license_scan(spark, sf_dir):
    return license_scan.license_scan(table(spark, sf_dir, "documents"))


ORACLE["op7_license_scan"] = license_scan.oracle()


@_query
def op8_near_dedup(spark, sf_dir):
    return near_dedup(table(spark, sf_dir, "documents")).drop("place")


@_query
def op9_token_counts(spark, sf_dir):
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))


@_query
def op10_bpe_codec(spark, sf_dir):
    coded = bpe_codec(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_BPE))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op11_hard_negatives(spark, sf_dir):
    vectors = hard_negatives.mined_vectors(table(spark, sf_dir, "embeddings"))
    return hard_negatives.hard_negatives(vectors, F.col("id") % 100 == 0)


ORACLE["op11_hard_negatives"] = hard_negatives.ORACLE


@_query
def op12_benchmark_scan(spark, sf_dir):
    return decontamination.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op12_benchmark_scan"] = decontamination.oracle()


@_query
def op13_conversation_repair(spark, sf_dir):
    summary, _ = conversation_repair.repair(table(spark, sf_dir, "conversations"))
    return summary


ORACLE["op13_conversation_repair"] = conversation_repair.ORACLE

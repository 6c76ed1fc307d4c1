"""Corpus pipeline: quality filter, exact deduplication, near deduplication, source mix, BPE encoding.

Every stage takes (spark, docs, sf_dir) and works on all that the one before kept. ``run`` writes each stage's result
to the shared folder and reads it again for the next, so a lost executor costs no earlier stage.

Defined results of every stage: null and empty texts are texts without words (what becomes of them is said below); very long
texts are kept whole; repeated rows and null ids are documents of their own; ties go by id, then by where rows are stored;
an empty table gives an empty result; all columns are kept but by the last stage, whatever their names.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kpiframe.llm.bpe_codec import bpe_codec
from kpiframe.llm.common import collect_garbage, prepare, stored, without, written
from kpiframe.llm.exact_dedup import exact_dedup
from kpiframe.llm.near_dedup import near_dedup
from kpiframe.llm.quality_gam import accepted
from kpiframe.llm.source_mix import mixed_documents

TOKENIZER = "byte_bpe_50k.json"
#: Smaller blocks than the operator's own: more to shuffle, less to hold beside what earlier stages left.
BLOCK_BYTES = 6 << 20


def begin(spark: SparkSession) -> None:
    """A stage starts with the session's settings and with executors that hold nothing of the stage before."""
    prepare(spark)
    collect_garbage(spark)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality model doesn't reject; it learns from those of ``docs`` that have labels. Null and empty texts
    are scored like any other."""
    begin(spark)
    return accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group with equal texts; null, empty and blank texts are one group."""
    begin(spark)
    docs = stored(docs)
    return without(docs, exact_dedup(docs).filter("not kept").select("place"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class; a text without words is a class of its own."""
    begin(spark)
    docs = stored(docs)
    return without(docs, near_dedup(docs).filter("not kept").select("place"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents, whole, as often as the mix of sources takes them; texts without words aren't taken."""
    begin(spark)
    return mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids and text (decoded from the ids; empty for a null text)."""
    begin(spark)
    coded = bpe_codec(docs, public_tokenizers.path(TOKENIZER), keep=("doc_id", "lang", "source"), block_bytes=BLOCK_BYTES)
    return coded.select(
        "doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text")
    )


STAGES = [
    ("quality", quality),
    ("exact_copies", exact_copies),
    ("near_copies", near_copies),
    ("mix", mix),
    ("encode", encode),
]

#: Models and signatures can't be said in SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pipeline over ``documents``."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs

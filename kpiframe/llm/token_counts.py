"""Token counts by a two-tier look-up of pre-token lengths, map-side only.

*First tier.* One pass counts the pieces (blanks and the word behind them, one or more whole pre-tokens) of all
texts in mergeable Misra-Gries summaries: one compressed row per task with ``SUMMARY`` entries at most. ``FOLD`` rows at a time
are merged into one, level by level, until one is left; so what moves is bounded by tasks and summary size, and no piece
is ever a row or a shuffle key. Pieces that make up at least one in ``FREQUENT`` of all counted (so FREQUENT at most) and
their token lengths become a compact hash table, broadcast (at most FREQUENT entries of at most ``LONGEST`` characters: a
few MB at any input size). The summaries only decide what is fast, never a result.

*Second tier.* Pieces that miss are encoded by the library, once per worker while its cache holds them
(``CACHE`` entries, then the cache starts again from the frequent table). Texts and pieces are never shuffled.

Defined results: null and empty texts have 0 bytes and 0 tokens; strings of special tokens count as the library
counts them by default; very long texts are cut into pieces as wholes; repeated rows and null ids are kept; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiframe.llm.common import tidied, written
from kpiframe.llm.pieces import encode_keys, ship, tools

FREQUENT = 131_072
LONGEST = 32
SUMMARY = 16_384
CACHE = 400_000
#: Summaries that are merged at once.
FOLD = 32


def _trim(counts: Counter, size: int) -> Counter:
    """Misra-Gries: take the count of the first entry beyond ``size`` from all, keep what stays positive."""
    if len(counts) <= size:
        return counts
    cut = sorted(counts.values(), reverse=True)[size]
    return Counter({k: n - cut for k, n in counts.items() if n > cut})


def _pack(counts: Counter) -> bytes:
    keys = list(counts)
    rows = pa.table({"key": pa.array(keys, pa.string()), "n": pa.array([counts[k] for k in keys], pa.int64())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def _unpack(blob: bytes) -> Counter:
    rows = pa.ipc.open_stream(blob).read_all()
    return Counter(dict(zip(rows["key"].to_pylist(), rows["n"].to_pylist())))


_SUMMARY = "task long, total long, pieces binary"


def _summary_row(task: int, total: int, counts: Counter) -> pa.RecordBatch:
    columns = [pa.array([task], pa.int64()), pa.array([total], pa.int64()), pa.array([_pack(counts)], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, ["task", "total", "pieces"])


def summaries(docs: DataFrame, tokenizer, summary: int = SUMMARY) -> DataFrame:
    """task, total (pieces counted) and pieces (a summary of them): one row per task."""

    @tidied
    def count(batches):
        cutter, _ = tools(tokenizer.value)
        counts: Counter = Counter()
        total = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                keys = cutter.keys(text)
                total += len(keys)
                counts.update(keys)
                if len(counts) > 16 * summary:
                    counts = _trim(counts, summary)
        short = Counter({k: n for k, n in _trim(counts, summary).items() if len(k) <= LONGEST})
        yield _summary_row(TaskContext.get().partitionId(), total, short)

    return docs.select("text").mapInArrow(count, _SUMMARY)


def _folded(rows: DataFrame, summary: int) -> DataFrame:
    """``FOLD`` neighbouring summaries as one."""

    def merge(key, table):
        counts: Counter = Counter()
        for blob in table["pieces"].to_pylist():
            counts.update(_unpack(blob))
        total = sum(table["total"].to_pylist())
        return pa.Table.from_batches([_summary_row(key[0].as_py(), total, _trim(counts, summary))])

    return rows.groupBy(F.floor(F.col("task") / FOLD).alias("fold")).applyInArrow(merge, _SUMMARY)


def frequent_lengths(docs: DataFrame, tokenizer, frequent: int = FREQUENT, summary: int = SUMMARY) -> dict[str, int]:
    """Token lengths of the pieces that are one in ``frequent`` or more of all (so ``frequent`` entries at most)."""
    rows = written(summaries(docs, tokenizer, summary), "piece-summaries")
    while rows.count() > 1:
        rows = written(_folded(rows, max(summary, frequent)), "piece-summaries")
    found = rows.first()
    if found is None:
        return {}
    counts = _unpack(bytes(found["pieces"]))
    top = [k for k, n in counts.items() if n * frequent >= found["total"]]
    _, encoder = tools(tokenizer.value)
    return {k: len(ids) for i in range(0, len(top), 1000) for k, ids in zip(top[i : i + 1000], encode_keys(encoder, top[i : i + 1000]))}


def count_tokens(docs: DataFrame, tokenizer_path: str, *, limit: int = 1024, frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit (more than ``limit`` tokens)."""
    spark = docs.sparkSession
    tokenizer = ship(spark, tokenizer_path)
    table = spark.sparkContext.broadcast(frequent_lengths(docs, tokenizer, frequent))

    @tidied
    def count(batches):
        cutter, encoder = tools(tokenizer.value)
        lengths = dict(table.value)
        for batch in batches:
            totals = []
            for text in batch.column("text").to_pylist():
                keys = cutter.keys(text)
                try:
                    totals.append(sum(map(lengths.__getitem__, keys)))
                except KeyError:
                    missing = list(set(keys).difference(lengths))
                    if len(lengths) + len(missing) > CACHE:
                        lengths = dict(table.value)
                        missing = list(set(keys).difference(lengths))
                    lengths.update(zip(missing, map(len, encode_keys(encoder, missing))))
                    totals.append(sum(map(lengths.__getitem__, keys)))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(totals, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(count, f"doc_id {kind}, n_bytes long, n_tokens long").withColumn(
        "over_limit", F.col("n_tokens") > limit
    )

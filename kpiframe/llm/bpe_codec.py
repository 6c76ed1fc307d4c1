"""BPE encoding and decoding through a distinct-word table.

1. *Words.* Tasks split whole texts into words (a piece: blanks and the word behind them) and pack the documents
   of about ``BLOCK_BYTES`` into a block: its distinct words, and each document as numbers of those words. The
   distinct words leave the block in ``buckets`` parts by a hash of the word. Blocks are written to the shared folder
   as a table bucketed by block, without an entry in the catalog.
2. *Distinct-word table.* The parts are shuffled by bucket, so all occurrences of a word meet in one task, which
   encodes each distinct word once: its table holds one of ``buckets`` parts of all distinct words. A word comes once
   per block, so a word that holds a third of all positions brings one row per block.
3. *Join by position.* The ids of a block's words go back to the block, where each document's numbers are
   replaced by ids in order. Tasks hold one block at a time.
4. *Decoding.* Ids meet the id-to-piece table, a broadcast of the vocabulary (fixed by the file, about a MB),
   and the pieces' bytes are read as UTF-8, with the replacement character for bytes that are not.

Defined results: null and empty texts have no ids and decode to the empty text; special strings in texts become
their own id, as the library's default does; very long texts are a block of their own, encoded whole; repeated rows and null
keys are kept; an empty table gives an empty result; columns that aren't in ``keep`` are ignored.
"""

from __future__ import annotations

import io
import json
import uuid
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kpiframe.llm.common import fresh, shared_path, shuffle_partitions, tidied
from kpiframe.llm.pieces import encode_keys, ship, tools

BLOCK_BYTES = 16 << 20
#: Rows unpacked, and words put together, at once.
ROWS_AT_ONCE = 256
WORDS_AT_ONCE = 1 << 18


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def piece_table(tokenizer_json: str) -> list[bytes]:
    """Bytes of every id; an added token stands for its own text."""
    spec = json.loads(tokenizer_json)
    letters = byte_alphabet()
    pieces = dict((i, bytes(letters[c] for c in token)) for token, i in spec["model"]["vocab"].items())
    pieces |= {t["id"]: t["content"].encode() for t in spec.get("added_tokens") or []}
    return [pieces.get(i, b"") for i in range(max(pieces, default=-1) + 1)]


def _squeeze(numbers: np.ndarray) -> bytes:
    """Numbers below 2**32 as zstd of their byte planes."""
    planes = numbers.astype("<u4").view(np.uint8).reshape(-1, 4)
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(planes.T).tobytes())


def _expand(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _squeeze_words(words: list[str]) -> bytes:
    """Words as zstd of their lengths and their text."""
    text = zstandard.ZstdCompressor(level=3).compress("".join(words).encode())
    lengths = _squeeze(np.fromiter(map(len, words), np.uint32, len(words)))
    return len(lengths).to_bytes(4, "little") + lengths + text


def _expand_words(blob: bytes) -> list[str]:
    cut = 4 + int.from_bytes(blob[:4], "little")
    text = zstandard.ZstdDecompressor().decompress(blob[cut:]).decode()
    ends = np.cumsum(_expand(blob[4:cut]), dtype=np.int64).tolist()
    return [text[a:b] for a, b in zip([0, *ends], ends)]


_BLOCK_SCHEMA = "block long, bucket int, words binary, docs binary, lengths binary, numbers binary, buckets binary"


def pack_blocks(docs: DataFrame, tokenizer, buckets: int, keep: list[str], block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Blocks: one row with the documents (bucket -1) and one row of words for each bucket that has any."""
    schema = T._parse_datatype_string(_BLOCK_SCHEMA)
    text_column = fresh(keep, "__text")
    arrow = pa.schema(
        [("block", pa.int64()), ("bucket", pa.int32()), ("words", pa.binary())]
        + [(name, pa.binary()) for name in ("docs", "lengths", "numbers", "buckets")]
    )

    def block_rows(number, keys_table, lengths, numbers, table):
        words = list(table)
        where = np.fromiter((zlib.crc32(w.encode()) % buckets for w in words), np.uint32, len(words))
        sink = io.BytesIO()
        with pa.ipc.new_stream(sink, keys_table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
            out.write_table(keys_table)
        squeezed = [_squeeze(np.array(lengths, np.uint32)), _squeeze(np.concatenate(numbers)), _squeeze(where)]
        rows = [{"block": number, "bucket": -1, "words": None, "docs": sink.getvalue()} | dict(zip(("lengths", "numbers", "buckets"), squeezed))]
        order = np.argsort(where, kind="stable")
        ends = np.searchsorted(where[order], np.arange(buckets + 1))
        for b in range(buckets):
            if ends[b] < ends[b + 1]:
                part = [words[i] for i in order[ends[b] : ends[b + 1]]]
                rows.append({"block": number, "bucket": b, "words": _squeeze_words(part)})
        return pa.RecordBatch.from_pylist(rows, schema=arrow)

    @tidied
    def pack(batches):
        cutter, _ = tools(tokenizer.value)
        first, made = TaskContext.get().partitionId() << 32, 0
        kept, lengths, numbers, size, table = [], [], [], 0, _Numbers()
        pieces_of = (b.slice(at, ROWS_AT_ONCE) for b in batches for at in range(0, b.num_rows, ROWS_AT_ONCE))
        for batch in pieces_of:
            texts, done = batch.column(text_column).to_pylist(), 0
            columns = pa.Table.from_batches([batch]).select(keep)
            for i, text in enumerate(texts):
                keys = cutter.keys(text)
                lengths.append(len(keys))
                numbers.append(np.fromiter(map(table.__getitem__, keys), np.uint32, len(keys)))
                size += len((text or "").encode())
                if size >= block_bytes:
                    kept.append(columns.slice(done, i + 1 - done))
                    yield block_rows(first + made, pa.concat_tables(kept), lengths, numbers, table)
                    kept, lengths, numbers, size, table = [], [], [], 0, _Numbers()
                    made, done = made + 1, i + 1
            if done < len(texts):
                kept.append(columns.slice(done))
        if lengths:
            yield block_rows(first + made, pa.concat_tables(kept), lengths, numbers, table)

    rows = docs.select(*keep, F.col("text").alias(text_column))
    # Bucketed by block, so that the documents needn't be shuffled to meet their ids.
    name = f"bpe_blocks_{uuid.uuid4().hex}"
    (
        rows.mapInArrow(pack, schema)
        .write.bucketBy(buckets, "block")
        .option("path", shared_path(docs.sparkSession, "bpe-blocks"))
        .option("compression", "zstd")
        .saveAsTable(name)
    )
    blocks = docs.sparkSession.table(name)
    # The table lies outside the warehouse: its entry goes, its files stay for the plan that names them.
    docs.sparkSession.sql(f"DROP TABLE {name}")
    return blocks


class _Numbers(dict):
    """Numbers keys in order of first use."""

    def __missing__(self, key):
        self[key] = number = len(self)
        return number


def encode_words(blocks: DataFrame, tokenizer, buckets: int) -> DataFrame:
    """block, bucket, ids (of all words of the row, one after another) and counts (ids of each word), squeezed."""

    @tidied
    def encode(batches):
        _, encoder = tools(tokenizer.value)
        table: dict[str, bytes] = {}  # ids of a word, four bytes each
        for batch in batches:
            for block, bucket, packed in zip(*(batch.column(i).to_pylist() for i in range(3))):
                words = _expand_words(packed)
                new = [w for w in words if w not in table]
                for i in range(0, len(new), 2000):
                    ids = encode_keys(encoder, new[i : i + 2000])
                    table.update(zip(new[i : i + 2000], (np.array(x, np.uint32).tobytes() for x in ids)))
                found = [table[w] for w in words]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([block], pa.int64()),
                        pa.array([bucket], pa.int32()),
                        pa.array([_squeeze(np.frombuffer(b"".join(found), np.uint32))], pa.binary()),
                        pa.array([_squeeze(np.fromiter(map(len, found), np.uint32, len(found)) // 4)], pa.binary()),
                    ],
                    ["block", "bucket", "ids", "counts"],
                )

    words = blocks.filter("bucket >= 0").select("block", "bucket", "words").repartition(buckets, "bucket")
    return words.mapInArrow(encode, "block long, bucket int, ids binary, counts binary")


def bpe_codec(
    docs: DataFrame, tokenizer_path: str, *, keep: tuple[str, ...] = ("doc_id",), block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """One row per document: the ``keep`` columns, ids (array of int) and decoded (text of the ids)."""
    spark = docs.sparkSession
    tokenizer = ship(spark, tokenizer_path)
    pieces = spark.sparkContext.broadcast(piece_table(tokenizer.value))
    buckets = shuffle_partitions(spark)
    keep = list(keep)
    blocks = pack_blocks(docs, tokenizer, buckets, keep, block_bytes)
    ids = encode_words(blocks, tokenizer, buckets)
    held = blocks.filter("bucket < 0").select("block", "docs", "lengths", "numbers", "buckets")
    schema = T.StructType(
        [docs.schema[k] for k in keep]
        + [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    )

    def join_back(_, block: pa.Table, parts: pa.Table):
        row = block.to_pylist()[0]
        rows = pa.ipc.open_stream(row["docs"]).read_all()
        lengths, numbers, where = (_expand(row[k]) for k in ("lengths", "numbers", "buckets"))
        if parts.num_rows:
            parts = parts.sort_by("bucket")
            flat = np.concatenate([_expand(x) for x in parts.column("ids").to_pylist()])
            counts = np.concatenate([_expand(x) for x in parts.column("counts").to_pylist()]).astype(np.int64)
        else:
            flat, counts = np.zeros(0, np.uint32), np.zeros(0, np.int64)
        # Words stand by bucket, then by number: place[n] is where word n stands.
        place = np.empty(len(where), np.int64)
        place[np.argsort(where, kind="stable")] = np.arange(len(where))
        starts = np.concatenate([[0], np.cumsum(counts)])
        table = pieces.value
        ends = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        for lo, hi in _slices(lengths):
            at = place[numbers[ends[lo] : ends[hi]]]
            each = counts[at]
            before = np.cumsum(each) - each
            tokens = flat[np.repeat(starts[at] - before, each) + np.arange(each.sum())]
            marks = np.concatenate([[0], np.cumsum(each)])[ends[lo : hi + 1] - ends[lo]]
            listed = tokens.tolist()
            decoded = [
                b"".join(map(table.__getitem__, listed[a:b])).decode("utf-8", "replace")
                for a, b in zip(marks[:-1].tolist(), marks[1:].tolist())
            ]
            columns = rows.slice(lo, hi - lo).combine_chunks()
            yield pa.table(
                [*columns.columns, pa.ListArray.from_arrays(pa.array(marks, pa.int32()), pa.array(tokens.astype(np.int32))), pa.array(decoded, pa.string())],
                [*keep, "ids", "decoded"],
            )

    def cogrouped(key, block, parts):
        out = pa.concat_tables(list(join_back(key, block, parts)))
        pa.default_memory_pool().release_unused()
        return out

    return held.groupBy("block").cogroup(ids.groupBy("block")).applyInArrow(cogrouped, schema)


def _slices(lengths: np.ndarray, words: int = WORDS_AT_ONCE):
    """(from, to) of runs of documents with about ``words`` words."""
    ends, lo = np.cumsum(lengths, dtype=np.int64), 0
    while lo < len(lengths):
        base = ends[lo - 1] if lo else 0
        hi = max(lo + 1, int(np.searchsorted(ends, base + words, "right")))
        yield lo, hi
        lo = hi

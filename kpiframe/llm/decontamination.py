"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark windows.

1. *Windows.* Benchmark texts are lower-cased (A-Z) and cut into words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in Spark;
   ``WINDOW`` consecutive words of an item are a window, and an item of fewer words is one window. Equal windows of an
   item count once.
2. *Automaton.* Every benchmark word gets a two-letter code, so a window is a string of twice as many letters and a match
   stands on word limits. The automaton is broadcast; it holds ``POSTINGS`` (window, item) pairs or ``PART_BYTES`` at most.
   A larger benchmark is dealt by hash to parts, each with an automaton and a scan of its own, and what the parts found
   is put together per document. The usual benchmark is one part: one scan, no shuffle.
3. *Scan.* Documents are normalised byte by byte (the bytes stay where they are, so the offsets of words are those of
   the original), words are coded, and the automaton runs over the codes once. Every match marks its words.

Defined results: null and empty texts have no words; a null or empty item has no windows; items are told apart by their
id's text, and rows with one id are one item; an item without an id marks words but isn't counted or listed; very long texts
are scanned whole, in one go; very long words are compared by digest; repeated documents are documents of their own; a null
``doc_id`` is kept; an empty benchmark marks nothing; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiframe.llm.common import place_of, stored, tidied, written

WINDOW = 10
#: What one automaton holds at most.
POSTINGS = 50_000
PART_BYTES = 16 << 20
#: Longer words stand in windows and codes as their digest.
LONG_WORD = 256

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[^0-9a-z\x{80}-\x{10FFFF}]+"
#: Byte to byte: A-Z lower-cased, every other ASCII byte that is no digit or letter a blank.
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words_of(text: Column) -> Column:
    """The words of a text, as the scan takes them, very long ones as their digest."""
    folded = F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER)
    words = F.filter(F.split(folded, _GAP, -1), lambda w: w != "")
    digest = lambda w: F.concat(F.lit("+"), F.sha2(w, 256))  # noqa: E731  no word has a plus sign
    return F.transform(words, lambda w: F.when(F.octet_length(w) > LONG_WORD, digest(w)).otherwise(w))


def postings(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """item (text of the id), window (words joined by blanks): the different windows of every item."""
    words = benchmark.select(F.col("item_id").cast("string").alias("item"), words_of(F.col("text")).alias("words"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("words") - (window - 1), F.lit(1)))
    cut = F.transform(starts, lambda at: F.array_join(F.slice("words", at, F.lit(window)), " "))
    return words.filter(F.size("words") > 0).select("item", F.explode(cut).alias("window")).distinct()


class Automaton:
    """Windows as an Aho-Corasick automaton over two-letter word codes."""

    def __init__(self, rows: list[tuple[str | None, str]]):
        import ahocorasick

        windows: dict[str, set] = {}
        for item, window in rows:
            windows.setdefault(window, set()).add(item)
        words = sorted({w for window in windows for w in window.split(" ")})
        side = int(len(words) ** 0.5) + 1
        # First and second letters have ranges of their own, so a match never begins inside a word.
        code = {w.encode(): chr(0x100 + i // side) + chr(0x3000 + i % side) for i, w in enumerate(words)}
        self.code, self.unknown = code, "\x01\x02"
        self.long = any(w[:1] == b"+" for w in code)
        self.found = [(window.count(" ") + 1, sorted(x for x in items if x is not None)) for window, items in windows.items()]
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, window in enumerate(windows):
            self.automaton.add_word("".join(code[w.encode()] for w in window.split(" ")), i)
        self.automaton.make_automaton()
        self.any = bool(windows)

    def scan(self, text: bytes) -> tuple[int, list[dict], list[str]]:
        """Number of words, the marked runs of words with their offsets in ``text``, and the items found."""
        folded = text.translate(_FOLD)
        words = folded.split()
        if not self.any:
            return len(words), [], []
        if self.long:
            words = [w if len(w) <= LONG_WORD else b"+" + hashlib.sha256(w).hexdigest().encode() for w in words]
        get, unknown = self.code.get, self.unknown
        runs: list[list[int]] = []
        seen: set[int] = set()
        for end, number in self.automaton.iter("".join([get(w, unknown) for w in words])):
            seen.add(number)
            to = (end + 1) // 2
            at = to - self.found[number][0]
            while runs and at <= runs[-1][1]:
                at = min(at, runs.pop()[0])
            runs.append([at, to])
        if not runs:
            return len(words), [], []
        items = sorted({x for number in seen for x in self.found[number][1]})
        return len(words), _with_offsets(text, folded, runs), items


def _with_offsets(text: bytes, folded: bytes, runs: list[list[int]]) -> list[dict]:
    """Runs of words with the characters of the original at which they begin and end."""
    out, number, at, chars, upto = [], 0, 0, 0, 0
    ends = iter(runs)
    run = next(ends)
    for word in folded.split():
        at = folded.index(word, at)
        if number == run[0]:
            chars += len(text[upto:at].decode("utf-8", "replace"))
            upto, start = at, chars
        at += len(word)
        number += 1
        if number == run[1]:
            chars += len(text[upto:at].decode("utf-8", "replace"))
            upto = at
            out.append({"from_word": run[0], "to_word": run[1], "start": start, "end": chars})
            run = next(ends, None)
            if run is None:
                return out
    return out


_RUNS = "array<struct<from_word:long,to_word:long,start:long,end:long>>"
_ARROW_RUNS = pa.list_(pa.struct([(name, pa.int64()) for name in ("from_word", "to_word", "start", "end")]))


def _scanned(docs: DataFrame, rows: list[tuple[str | None, str]]) -> DataFrame:
    """``docs`` (bytes: __text) with n_words, runs and items in place of the text."""
    kept = [c for c in docs.columns if c != "__text"]
    shipped = docs.sparkSession.sparkContext.broadcast(rows)
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in docs.schema if f.name in kept])

    @tidied
    def run(batches):
        automaton = Automaton(shipped.value)
        for batch in batches:
            found = [automaton.scan(text or b"") for text in batch.column("__text").to_pylist()]
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(columns[0], pa.int64()), pa.array(columns[1], _ARROW_RUNS),
                 pa.array(columns[2], pa.list_(pa.string()))],
                [*kept, "n_words", "runs", "items"],
            )

    return docs.mapInArrow(run, f"{schema}, n_words long, runs {_RUNS}, items array<string>")


def _merged(runs: Column) -> Column:
    """Sorted runs of several parts, those that meet joined."""
    joined = lambda last, x: F.struct(
        last["from_word"].alias("from_word"), F.greatest(last["to_word"], x["to_word"]).alias("to_word"),
        last["start"].alias("start"), F.greatest(last["end"], x["end"]).alias("end"),
    )

    def step(done: Column, x: Column) -> Column:
        last = F.element_at(done, -1)
        meets = (F.size(done) > 0) & (x["from_word"] <= F.get(done, F.size(done) - 1)["to_word"])
        return F.when(meets, F.concat(F.slice(done, F.lit(1), F.size(done) - 1), F.array(joined(last, x)))).otherwise(
            F.concat(done, F.array(x))
        )

    return F.aggregate(F.sort_array(runs), F.array().cast(_RUNS), step)


def contaminated_words(
    docs: DataFrame, benchmark: DataFrame, *, window: int = WINDOW, part_postings: int = POSTINGS
) -> DataFrame:
    """doc_id, n_words, runs (the hit words: places and characters of the original) and items (ids, sorted) of every document."""
    listed = written(postings(benchmark, window), "benchmark-windows")
    size = listed.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("window")), F.lit(0)).alias("bytes")
    ).first()
    parts = max(1, -(-size["n"] // part_postings), -(-size["bytes"] // PART_BYTES))
    of = F.pmod(F.xxhash64("window", "item"), F.lit(parts))
    text = F.col("text").cast("binary").alias("__text")
    if parts == 1:
        rows = [tuple(r) for r in listed.select("item", "window").collect()]
        return _scanned(docs.select("doc_id", text), rows)
    docs = stored(docs)
    placed = docs.select("doc_id", place_of(docs).alias("place"), text)
    found = []
    for part in range(parts):
        # About part_postings rows: what one automaton holds.
        rows = [tuple(r) for r in listed.filter(of == part).select("item", "window").collect()]
        scanned = _scanned(placed, rows)
        # Every document has a row from the first part; the others add what they found.
        found.append(written(scanned if part == 0 else scanned.filter(F.size("runs") > 0), "benchmark-hits"))
    together = found[0]
    for more in found[1:]:
        together = together.unionByName(more)
    return together.groupBy("place").agg(
        F.max("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        _merged(F.flatten(F.collect_list("runs"))).alias("runs"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    ).drop("place")


def contamination(docs: DataFrame, benchmark: DataFrame, **settings) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    found = contaminated_words(docs, benchmark, **settings)
    hit = F.aggregate("runs", F.lit(0).cast("long"), lambda n, x: n + x["to_word"] - x["from_word"])
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("runs") > 0).alias("contaminated"),
    )


def oracle() -> str:
    """DuckDB SQL for the scan: every run of up to WINDOW words of a document, compared with the windows of its length."""
    words = f"regexp_extract_all(translate(COALESCE(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"
    leads = ", ".join(f"lead(word, {i}) OVER p" for i in range(1, WINDOW))
    return rf"""
WITH files AS (SELECT row_number() OVER () AS file, doc_id, {words} AS w FROM documents),
items AS (SELECT item_id::VARCHAR AS item, {words} AS w FROM benchmark),
starts AS (SELECT item, w, unnest(range(greatest(len(w) - {WINDOW - 1}, 1))) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, array_to_string(w[i + 1:i + {WINDOW}], ' ') AS win, least(len(w), {WINDOW}) AS k FROM starts),
placed AS (SELECT file, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM files),
nexts AS (SELECT file, pos, [word, {leads}] AS ws FROM placed WINDOW p AS (PARTITION BY file ORDER BY pos)),
runs AS (
  SELECT file, pos, k, array_to_string(ws[1:k], ' ') AS win FROM nexts, (SELECT DISTINCT k FROM windows) WHERE ws[k] IS NOT NULL
), found AS (SELECT file, pos, k, item FROM runs JOIN windows USING (k, win)),
hits AS (SELECT file, count(DISTINCT i) AS n_hit FROM (SELECT file, unnest(range(pos, pos + k)) AS i FROM found) GROUP BY file),
listed AS (
  SELECT file, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM found GROUP BY file
)
SELECT doc_id, len(w)::BIGINT AS n_words, COALESCE(n_hit, 0)::BIGINT AS n_hit, COALESCE(n_items, 0)::BIGINT AS n_items,
  sha256(COALESCE(items, '')) AS items_sha256, COALESCE(n_hit, 0) > 0 AS contaminated
FROM files LEFT JOIN hits USING (file) LEFT JOIN listed USING (file)
"""

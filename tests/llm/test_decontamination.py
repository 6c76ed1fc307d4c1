"""Benchmark decontamination against a plain search for every window."""

import hashlib
import re

import pytest
from corpus_cases import DOC, doc

from kpiframe.llm.decontamination import Automaton, contaminated_words, contamination

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def fold(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(docs, items, window):
    """doc_id, n_words, hit words, items of each document, window by window."""
    windows = set()
    for item, text in items:
        w = WORD.findall(fold(text))
        windows |= {(item, tuple(w[i : i + window])) for i in range(max(1, len(w) - window + 1)) if w}
    out = []
    for row in docs:
        w, hit, found = WORD.findall(fold(row[1])), set(), set()
        for item, win in windows:
            for i in range(len(w) - len(win) + 1):
                if tuple(w[i : i + len(win)]) == win:
                    hit |= set(range(i, i + len(win)))
                    found |= {str(item)} if item is not None else set()
        out.append((row[0], len(w), hit, ",".join(sorted(found))))
    return out


ITEMS = [
    (1, "One two three four five, six?"), (2, "two three FOUR five six seven"), (10, "Short one"), (3, None), (4, "  ?! "),
    (None, "three four five six nine"), (5, "été déjà vu İ x"), (2, "two three FOUR five six seven"), (6, "w" * 400 + " tail"),
    (7, "aa aa aa aa aa"),
]
TEXTS = [
    doc(1, "zero. One  two\nthree-four FIVE six seven; eight"), doc(2, None), doc(3, ""), doc(4, "short ONE and short one"),
    doc(None, "x three four five six nine y"), doc(5, "Été déjà vu İ x"), doc(5, "été déjà vu İ x"), doc(6, "a" + "w" * 399 + " tail"),
    doc(7, "W" * 400 + " tail " + "w" * 400 + " tail"), doc(8, "aa " * 50), doc(9, "one two three four"), doc(10, "shortone short"),
    doc(11, ("filler words go on " * 30_000) + "two three four five six seven " + "and on " * 1000),
]


@pytest.mark.parametrize("part_postings", [50_000, 4])
def test_every_window_is_found(spark, table, part_postings):
    docs = table(TEXTS, DOC)
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    settings = {"window": 5, "part_postings": part_postings}
    want = sorted(
        (str(i), n, len(hit), 0 if not names else names.count(",") + 1, hashlib.sha256(names.encode()).hexdigest(), bool(hit))
        for i, n, hit, names in plain(TEXTS, ITEMS, 5)
    )
    got = sorted((str(r[0]), *r[1:]) for r in contamination(docs, items, **settings).collect())
    assert got == want
    # Runs are the hit words, and their characters in the original spell them.
    texts = {row[0]: row[1] for row in TEXTS if row[0] != 5}
    for row in contaminated_words(docs, items, **settings).collect():
        if row["doc_id"] in texts and row["runs"]:
            hit = next(hit for i, _, hit, _ in plain(TEXTS, ITEMS, 5) if i == row["doc_id"])
            assert {w for r in row["runs"] for w in range(r["from_word"], r["to_word"])} == hit
            text = texts[row["doc_id"]]
            words = WORD.findall(fold(text))
            for r in row["runs"]:
                assert WORD.findall(fold(text[r["start"] : r["end"]])) == words[r["from_word"] : r["to_word"]]


def test_empty_tables(spark, table):
    docs = table(TEXTS[:3], DOC)
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["contaminated"] for r in contamination(docs, none).collect()] == [False] * 3
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert contamination(table([], DOC), items).count() == 0


def test_runs_that_meet_are_one():
    rows = [("a", "x y z"), ("b", "z q r")]
    _, runs, items = Automaton(rows).scan("x y z Q r, x y z".encode())
    assert [(r["from_word"], r["to_word"]) for r in runs] == [(0, 8)] and items == ["a", "b"]

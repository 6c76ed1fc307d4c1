"""Text quality by a generalised additive model with pairwise interactions.

*Features.* One pass over whole texts gives a few shares and sizes per document (repeats, symbols, separators, ...).
*Learning.* Cyclic boosting on a bounded sample of labelled rows: in every round each feature in turn gets a shallow
regression tree on the log-loss gradients of its bins, whose leaves, times a small rate, are added to the
feature's look-up table. Then the ``PAIRS`` pairs of features with the largest gain on the residuals get tables
of their own on a coarser grid, boosted the same way with trees that split both axes.
*Scoring.* Bins by ``searchsorted``, then one addition per table; the score is the logistic of the sum.

The sample: the ``SAMPLE`` labelled rows with the smallest hash of their id, among rows that aren't held out. Labels
that are null or neither 0 nor 1 are left out, labels of one id are averaged and cut at a half; a document that
comes more than once counts each time. Without labels of both kinds the score is the smoothed share of 1 for all.

Defined results: null text counts as empty and is scored like any other; very long texts are scored whole; repeated rows and
null ids are kept (null ids aren't held out), ties at the sample's end go by hash and id; an empty table gives an empty result;
other columns are ignored by :func:`quality_scores` and kept by :func:`accepted`, whatever their names.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kpiframe.llm.common import fresh, hash_below, held_out, tidied

#: Bound of the labelled sample that the model is fitted on.
SAMPLE = 20_000
BINS = 64
PAIR_BINS = 12
PAIRS = 6
ROUNDS = 200
PAIR_ROUNDS = 60
RATE = 0.1
LEAVES = 3
THRESHOLD = 0.7

FEATURES = [
    "log_words", "word_length", "long_words", "distinct_words", "repeated_next", "top_word", "single_marks",
    "symbol_ends", "symbols", "digits", "upper", "stops", "lines_per_word", "repeated_lines", "blanks", "beyond_ascii",
]

_SYMBOL_END = re.compile(r"[^\w\s.,;:!?'\")\]}»”’…-]{2,}(?=\s|$)")
_CLASSES = np.zeros(256, np.int64)
for _bytes, _class in (
    (b" \t\n\r\v\f", 1), (b"0123456789", 2), (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", 3), (b".!?", 4),
    (b"#$%&*+/<=>@[\\]^_`{|}~", 5),
):
    _CLASSES[list(_bytes)] = _class
_CLASSES[128:] = 6


def features_of(text: str | None) -> list[float]:
    """The ``FEATURES`` of one whole text."""
    text = text or ""
    words = text.split()
    n = len(words)
    kinds = np.bincount(_CLASSES, weights=np.bincount(np.frombuffer(text.encode(), np.uint8), minlength=256), minlength=7)
    size = max(1.0, float(kinds.sum()))
    lines = [x for x in text.split("\n") if x]
    if not n:
        return [0.0] * 14 + [kinds[1] / size, kinds[6] / size]
    counts: dict[str, int] = {}
    for w in words:
        counts[w] = counts.get(w, 0) + 1
    lengths = np.fromiter(map(len, words), np.int64, n)
    return [
        float(np.log1p(n)),
        float(lengths.mean()),
        float((lengths > 12).mean()),
        len(counts) / n ** 0.8,
        sum(map(str.__eq__, words, words[1:])) / n,
        max(counts.values()) / n,
        sum(c for w, c in counts.items() if len(w) == 1 and not w.isalnum()) / n,
        len(_SYMBOL_END.findall(text)) / n,
        kinds[5] / size,
        kinds[2] / size,
        kinds[3] / size,
        kinds[4] / n,
        len(lines) / n,
        1 - len(set(lines)) / max(1, len(lines)),
        kinds[1] / size,
        kinds[6] / size,
    ]


@dataclass
class Gam:
    """Bin edges and look-up tables; ``pairs`` holds (feature, feature, table)."""

    base: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables)):
            total += table[np.searchsorted(edges, x[:, j], "right")]
        for a, b, table in self.pairs:
            total += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-total))


#: Steps as small as this are rounding.
ROUNDING = 1e-12


def _edges(column: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(column, np.arange(1, bins) / bins, method="higher"))


def _gain(g, h):
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """Values per bin of a tree with ``leaves`` leaves on gradient and hessian sums of ordered bins."""
    cuts = [(0, len(g))]
    while len(cuts) < leaves:
        best = (1e-6, None, None)
        for i, (a, b) in enumerate(cuts):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h) - _gain(all_g, all_h)
            at = int(np.argmax(gains))
            if gains[at] > best[0]:
                best = (gains[at], i, a + at + 1)
        if best[1] is None:
            break
        a, b = cuts[best[1]]
        cuts[best[1] : best[1] + 1] = [(a, best[2]), (best[2], b)]
    out = np.zeros(len(g))
    for a, b in cuts:
        value = g[a:b].sum() / (h[a:b].sum() + 1.0)
        # Residuals that cancel out leave what the machine's rounding makes of them.
        out[a:b] = value if abs(value) > ROUNDING else 0.0
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Values per cell of a tree that splits one axis, then each side on the other; and its gain."""
    best: tuple[float, np.ndarray | None] = (0.0, None)
    for flip in (False, True):
        gg, hh = (g.T, h.T) if flip else (g, h)
        for cut in range(1, gg.shape[0]):
            out, gain = np.zeros_like(gg), 0.0
            for part in (slice(0, cut), slice(cut, None)):
                sg, sh = gg[part].sum(axis=0), hh[part].sum(axis=0)
                left_g, left_h = np.cumsum(sg)[:-1], np.cumsum(sh)[:-1]
                all_g, all_h = sg.sum(), sh.sum()
                gains = _gain(left_g, left_h) + _gain(all_g - left_g, all_h - left_h)
                at = int(np.argmax(gains)) + 1 if len(gains) else len(sg)
                gain += gains[at - 1] if len(gains) else _gain(all_g, all_h)
                for side in (slice(0, at), slice(at, None)):
                    out[part, side] = sg[side].sum() / (sh[side].sum() + 1.0)
            if gain > best[0]:
                best = (gain, out.T if flip else out)
    return (np.zeros_like(g) if best[1] is None else best[1]), best[0]


def fit(x: np.ndarray, y: np.ndarray) -> Gam:
    """Cyclic boosting of one table per feature, then of the strongest pairs."""
    share = (y.sum() + 1) / (len(y) + 2)
    model = Gam(float(np.log(share / (1 - share))))
    if len(y) == 0 or y.min() == y.max():
        return model
    n_features = x.shape[1]
    model.edges = [_edges(x[:, j], BINS) for j in range(n_features)]
    bins = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.edges)]
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    total = np.full(len(y), model.base)
    for _ in range(ROUNDS):
        for j in range(n_features):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[j])
            step = RATE * _tree(np.bincount(bins[j], y - p, size), np.bincount(bins[j], p * (1 - p), size), LEAVES)
            model.tables[j] += step
            total += step[bins[j]]
    model.coarse = [_edges(x[:, j], PAIR_BINS) for j in range(n_features)]
    cells = [np.searchsorted(e, x[:, j], "right") for j, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.coarse]

    def sums(a, b):
        p = 1 / (1 + np.exp(-total))
        cell, shape = cells[a] * sizes[b] + cells[b], (sizes[a], sizes[b])
        return (np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (y - p, p * (1 - p)))

    ranked = sorted(((_pair_tree(*sums(a, b))[1], a, b) for a in range(n_features) for b in range(a)), reverse=True)
    model.pairs = [(a, b, np.zeros((sizes[a], sizes[b]))) for gain, a, b in ranked[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in model.pairs:
            step = RATE * _pair_tree(*sums(a, b))[0]
            table += step
            total += step[cells[a], cells[b]]
    return model


def learn(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE) -> Gam:
    """Fit on the documents of ``sample`` labelled ids (see above); the rows collected are bounded by ``sample``."""
    usable = labels.select("doc_id", F.col(label).alias("y")).filter(
        F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & ~held_out()
    )
    # The hash spreads evenly over the longs, so a share of its range holds about that share of the rows: what is
    # sorted below is about twice the sample, whatever the table's size.
    order = F.xxhash64("doc_id")
    below = hash_below(2.0 * sample / max(1, usable.count()))
    known = (
        usable.filter(order <= below)
        .groupBy("doc_id")
        .agg((F.avg("y") >= 0.5).cast("double").alias("y"))
        .orderBy(order, "doc_id")
        .limit(sample)
    )

    @tidied
    def compute(batches):
        for batch in batches:
            x = [features_of(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("y"), pa.array(x, pa.list_(pa.float64()))], ["doc_id", "y", "x"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = (
        docs.select("doc_id", "text")
        .join(F.broadcast(known), "doc_id")
        .mapInArrow(compute, f"doc_id {kind}, y double, x array<double>")
        .orderBy(order, "doc_id", "x")
        .limit(sample)
        .select("x", "y")
        .toArrow()
    )
    x = np.array(rows["x"].to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, np.array(rows["y"].to_pylist(), float))


def _scored(docs: DataFrame, model: Gam, columns: list[str]) -> tuple[DataFrame, str]:
    """``columns`` of every row and the score of its whole text; and the score's name, which no column has."""
    shipped = docs.sparkSession.sparkContext.broadcast(model)
    name, text = fresh(columns, "__score"), fresh(columns, "__text")
    rows = docs.select(*columns, F.col("text").alias(text))

    @tidied
    def score(batches):
        for batch in batches:
            x = np.array([features_of(t.as_py()) for t in batch.column(text)], float).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.select(columns).columns, pa.array(shipped.value.score(x))], [*columns, name]
            )

    return rows.mapInArrow(score, docs.select(*columns).schema.add(name, "double")), name


def quality_scores(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """One row per document: doc_id, held_out, score (0 to 1), predicted (1 if score >= ``threshold``)."""
    scored, score = _scored(docs, learn(docs, labels, sample=sample), ["doc_id"])
    return scored.select(
        "doc_id",
        held_out().alias("held_out"),
        F.col(score).alias("score"),
        (F.col(score) >= threshold).cast("int").alias("predicted"),
    )


def accepted(docs: DataFrame, labels: DataFrame, *, threshold: float = THRESHOLD, sample: int = SAMPLE) -> DataFrame:
    """The rows of ``docs``, all columns, that score ``threshold`` or more."""
    scored, score = _scored(docs, learn(docs, labels, sample=sample), docs.columns)
    return scored.filter(F.col(score) >= threshold).drop(score)

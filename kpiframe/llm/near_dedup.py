"""Near-duplicate classes by ProbMinHash signatures, banding and verification.

Words are the lower-cased runs of letters and digits, shingles five neighbouring words (a shorter text is one
shingle), weighted by how often the text has them. Two texts are linked if their probability Jaccard similarity
(the Jaccard similarity, when no shingle repeats) is ``THRESHOLD`` or more; classes are the linked components.

1. *Signatures.* Every shingle is a Poisson process with its weight as rate; each arrival falls on one of
   ``REGISTERS`` registers, and a register keeps the shingle that arrives first. Arrivals are generated for all texts of
   a batch at once, round by round; a shingle stops at the first arrival later than its text's latest register.
   Equal registers estimate the similarity.
2. *Copies.* Texts with the same words are collapsed to one representative first, counted map-side.
3. *Banding.* Representatives that agree on all registers of a band meet in a bucket. A bucket of more than ``CELL``
   members is dealt out in pairs of parts, so that each task holds two parts.
4. *Pairs.* In a bucket, pairs whose estimate is within 3.5 standard deviations of the threshold are possible; a pair
   counts only in the first band on which its texts agree. The first round emits only a spanning forest of them, best estimates first (less than one pair per member). Pairs are verified
   on their whole shingle sets, and classes formed. In the second round the members that have a possible pair in another
   class bring their shingle sets to the bucket, and every such pair is verified there, on whole sets; only links that join
   classes are emitted (less than one per member). So no possible link is lost, and no rows are made pair by pair.
5. *Classes.* Minimum labels with pointer jumping over the links.

With 32 bands of 6 registers, a pair at the threshold meets in a bucket with probability 0.9999.

Defined results: null texts and texts without words are classes of their own; of a class the row with the
smallest id stays (null last, then by place); repeated rows are copies; very long texts are signed and compared whole; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kpiframe.llm.common import located, shuffle_partitions, tidied, written

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 6
#: The bands use the first 192 registers, estimates all of them.
REGISTERS = 256
CELL = 2048
#: Where members bring their shingle sets, a part has about so many bytes of them.
CELL_BYTES = 8 << 20
#: Sets compared with one at once.
AT_ONCE = 256
#: Estimates this far below the threshold are still verified (3.5 standard deviations at the threshold).
LEAST = THRESHOLD - 3.5 * (THRESHOLD * (1 - THRESHOLD) / REGISTERS) ** 0.5
#: Up to so many candidates (8 bytes each) are broadcast to keep other texts out of a shuffle.
BROADCAST = 1_000_000
SHINGLES_AT_ONCE = 200_000
ROWS_AT_ONCE = 256
CACHE = 200_000

_WORD = re.compile(r"\w+")
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finalizer."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hashes(dict):
    """Hash of each word, kept by the worker."""

    def __missing__(self, word):
        if len(self) >= CACHE:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


def shingles(texts: list[list[int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, shingle hash, weight) of the distinct shingles of texts given as word hashes, by text and hash."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    words = np.fromiter((w for t in texts for w in t), np.uint64, int(lengths.sum()))
    counts = np.where(lengths > 0, np.maximum(1, lengths - SHINGLE + 1), 0)
    owner = np.repeat(np.arange(len(texts)), counts)
    first = np.repeat(np.cumsum(lengths) - lengths, counts) + np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    end = np.repeat(np.cumsum(lengths), counts)
    total = np.zeros(len(owner), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(SHINGLE):
            inside = first + j < end
            total = total * _ODD + np.where(inside, words[np.minimum(first + j, max(0, len(words) - 1))] if len(words) else 0, np.uint64(0))
        total = _mixed(total)
        key = total ^ _mixed(owner.astype(np.uint64) * _ODD)
    order = np.argsort(key, kind="stable")
    fresh = np.flatnonzero(np.append(True, np.diff(key[order]) != 0)) if len(order) else order
    weight = np.diff(np.append(fresh, len(order)))
    owner, total = owner[order[fresh]], total[order[fresh]]
    by_text = np.lexsort((total, owner))
    return owner[by_text], total[by_text], weight[by_text]


def signatures(count: int, owner: np.ndarray, element: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """``count`` x REGISTERS: 16 bits of the shingle that arrives first at each register."""
    times = np.full(count * REGISTERS, np.inf)
    holders = np.zeros(count * REGISTERS, np.uint16)
    latest = np.full(count, np.inf)
    clock, turn = np.zeros(len(owner)), 0
    with np.errstate(over="ignore"):
        while len(owner):
            turn += 1
            draw = _mixed(element + np.uint64(turn) * _ODD)
            clock = clock - np.log(((draw >> np.uint64(11)).astype(np.float64) + 0.5) / 2**53) / weight
            live = clock < latest[owner]
            owner, element, weight, clock, draw = owner[live], element[live], weight[live], clock[live], draw[live]
            at = owner * REGISTERS + (_mixed(draw ^ _ODD) % np.uint64(REGISTERS)).astype(np.int64)
            np.minimum.at(times, at, clock)
            won = times[at] == clock
            holders[at[won]] = (_mixed(element[won]) >> np.uint64(48)).astype(np.uint16)
            touched = np.unique(owner)
            latest[touched] = times.reshape(count, REGISTERS)[touched].max(axis=1)
    return holders.reshape(count, REGISTERS)


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Probability Jaccard of two sets of (sorted shingle hashes, weights)."""
    common, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    if not len(common):
        return 0.0
    if a[1].max() == 1 and b[1].max() == 1:
        return len(common) / (len(a[0]) + len(b[0]) - len(common))
    w, v = a[1][i].astype(float), b[1][j].astype(float)
    order = np.argsort(w / v, kind="stable")
    w, v = w[order], v[order]
    only_w, only_v = a[1].sum() - w.sum(), b[1].sum() - v.sum()
    # For the shingle at place k: shingles from k on count by w (their ratio is as large), those before by v.
    from_here = np.cumsum(w[::-1])[::-1] + only_w
    before = np.cumsum(v) - v + only_v
    return float((1 / (from_here / w + before / v)).sum())


def _word_hashes(texts, cache):
    return [list(map(cache.__getitem__, _WORD.findall(t.lower()))) if t else [] for t in texts]


def _slices(batches):
    """The batches in pieces of a few rows, so that a task never unpacks many texts at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def _groups(lists):
    """(from, to) of runs of texts with about SHINGLES_AT_ONCE words."""
    lo, size = 0, 0
    for i, words in enumerate(lists):
        size += len(words)
        if size >= SHINGLES_AT_ONCE or i + 1 == len(lists):
            yield lo, i + 1
            lo, size = i + 1, 0


def sign(content: DataFrame) -> DataFrame:
    """doc_id, place, copy (digest of the words; null without words) and sig of every text."""
    schema = content.select("doc_id", "place").schema.add("copy", "binary").add("sig", "binary")

    @tidied
    def run(batches):
        cache = _Hashes()
        for batch in _slices(batches):
            lists = _word_hashes(batch.column("text").to_pylist(), cache)
            copies, sigs = [], []
            for lo, hi in _groups(lists):
                owner, element, weight = shingles(lists[lo:hi])
                sig = signatures(hi - lo, owner, element, weight)
                for words, row in zip(lists[lo:hi], sig):
                    copies.append(xxhash.xxh3_128_digest(np.array(words, np.uint64).tobytes()) if words else None)
                    sigs.append(row.tobytes() if words else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("place"), pa.array(copies, pa.binary()), pa.array(sigs, pa.binary())],
                ["doc_id", "place", "copy", "sig"],
            )

    return content.select("doc_id", "place", "text").mapInArrow(run, schema)


def shingle_sets(texts: DataFrame) -> DataFrame:
    """id, hashes and weights (as bytes; no weights: all 1) of (id, text)."""

    @tidied
    def run(batches):
        cache = _Hashes()
        for batch in _slices(batches):
            lists = _word_hashes(batch.column("text").to_pylist(), cache)
            hashes, weights = [], []
            for lo, hi in _groups(lists):
                owner, element, weight = shingles(lists[lo:hi])
                cuts = np.searchsorted(owner, np.arange(hi - lo + 1))
                for a, b in zip(cuts[:-1], cuts[1:]):
                    hashes.append(element[a:b].tobytes())
                    weights.append(weight[a:b].astype(np.uint32).tobytes() if b > a and weight[a:b].max() > 1 else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(hashes, pa.binary()), pa.array(weights, pa.binary())], ["id", "hashes", "weights"]
            )

    return texts.select("id", "text").mapInArrow(run, "id long, hashes binary, weights binary")


def deal(rows: DataFrame, sizes: DataFrame, parts: Column) -> DataFrame:
    """``rows`` (bucket, id, others) of the buckets in ``sizes``, in cells of two parts (cell, part, inside); ``parts``: into
    how many parts a bucket is dealt, from the columns of ``sizes``."""
    kept = [c for c in rows.columns if c not in ("bucket", "id")]
    part = F.pmod(F.xxhash64("id", "bucket"), parts).cast("int")
    return (
        rows.join(sizes, "bucket")
        .withColumn("part", part)
        .withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
        .select(
            "bucket",
            (F.least("part", "other") * parts + F.greatest("part", "other")).alias("cell"),
            (F.col("part") != F.least("part", "other")).cast("int").alias("part"),
            # A cell of one part compares inside, a cell of two only across.
            (F.col("part") == F.col("other")).alias("inside"),
            "id",
            *kept,
        )
    )


def bucket_rows(reps: DataFrame) -> DataFrame:
    """bucket, cell, band, part, inside, id, sig: members of buckets with at least two; large buckets in cells of two parts."""
    width = 2 * ROWS
    band = F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1)))
    rows = reps.select("id", "sig", band.alias("band")).select(
        "id", "band", F.xxhash64("band", F.expr(f"substring(sig, band * {width} + 1, {width})")).alias("bucket")
    )
    sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # In the cell of a part with itself every member comes once; in a cell of two parts, too.
    return deal(rows, sizes, F.ceil(F.col("n") / CELL).cast("int")).join(reps.select("id", "sig"), "id")


def _possible_of(i, sigs, bands, parts, inside, band, classes):
    """(estimates, places behind ``i``) of the possible pairs of member ``i`` of a cell: different classes, first common band
    here, estimate high enough.

    ``bands`` has one number per member and band, equal where the band's registers are.
    """
    keep = classes[i + 1 :] != classes[i]
    if not inside:
        keep &= parts[i + 1 :] != parts[i]
    other = np.flatnonzero(keep) + i + 1
    if band and len(other):
        other = other[~(bands[other, :band] == bands[i, :band]).any(axis=1)]
    share = (sigs[other] == sigs[i]).mean(axis=1) if len(other) else np.zeros(0)
    good = share >= LEAST
    return share[good], other[good]


def _possible(*cell):
    """(estimate, i, j) of the possible pairs in one cell."""
    found = []
    for i in range(len(cell[0]) - 1):
        share, other = _possible_of(i, *cell)
        if len(other):
            found.append((share, np.full(len(other), i), other))
    if not found:
        return None
    return tuple(np.concatenate(x) for x in zip(*found))


def _forest(pairs, n):
    """Of the pairs, a spanning forest that prefers high estimates: places of the kept pairs."""
    share, left, right = pairs
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    kept = []
    for k in np.argsort(-share, kind="stable").tolist():
        a, b = find(int(left[k])), find(int(right[k]))
        if a != b:
            root[a] = b
            kept.append(k)
    return np.array(kept, np.int64)


def _by_cell(rows: DataFrame, columns: tuple[str, ...], judge, schema: str) -> DataFrame:
    """What ``judge`` makes of each cell of ``rows`` (bucket, cell, band, part, inside, id, class, sig, and ``columns``): it gets the
    cell's table, and signatures, bands, parts, inside, band and classes as ``_possible`` takes them, and returns a record batch."""
    tasks = shuffle_partitions(rows.sparkSession)

    @tidied
    def run(batches):
        held = []

        def edges(table):
            bucket, cell = table["bucket"].to_numpy(), table["cell"].to_numpy()
            return np.flatnonzero(np.append(True, (np.diff(bucket) != 0) | (np.diff(cell) != 0))).tolist()

        def emit(pieces):
            table = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
            sigs = np.frombuffer(b"".join(table["sig"].to_pylist()), np.uint16).reshape(-1, REGISTERS)
            with np.errstate(over="ignore"):
                weight = _ODD ** np.arange(1, ROWS + 1, dtype=np.uint64)
                bands = _mixed((sigs[:, : BANDS * ROWS].reshape(-1, BANDS, ROWS).astype(np.uint64) * weight).sum(axis=2))
            band, part, classes = (table[c].to_numpy() for c in ("band", "part", "class"))
            inside = table["inside"].to_numpy(zero_copy_only=False)
            starts, found = edges(table), []
            for lo, hi in zip(starts, [*starts[1:], table.num_rows]):
                if hi - lo > 1:
                    cell = sigs[lo:hi], bands[lo:hi], part[lo:hi], bool(inside[lo]), int(band[lo]), classes[lo:hi]
                    found.append(judge(table.slice(lo, hi - lo), *cell))
            found = [x for x in found if x is not None]
            if found:
                yield from pa.Table.from_batches(found).combine_chunks().to_batches()

        for batch in batches:
            if not batch.num_rows:
                continue
            # Only the last cell of what has come may go on in the next batch.
            starts = edges(batch)
            same = held and all(held[-1][c][-1] == batch[c][0] for c in ("bucket", "cell"))
            if held and (len(starts) > 1 or not same):
                ended = (starts[1] if len(starts) > 1 else 0) if same else 0
                yield from emit([*held, batch.slice(0, ended)])
                held, batch = [], batch.slice(ended)
                starts = edges(batch)
            if starts[-1]:
                yield from emit([batch.slice(0, starts[-1])])
                batch = batch.slice(starts[-1])
            held.append(batch)
        if held:
            yield from emit(held)

    return (
        rows.select("bucket", "cell", "band", "part", "inside", "id", "class", "sig", *columns)
        .repartition(tasks, "bucket", "cell")
        .sortWithinPartitions("bucket", "cell")
        .mapInArrow(run, schema)
    )


def _pairs(a, b):
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def candidate_pairs(buckets: DataFrame) -> DataFrame:
    """a, b (a < b) of a spanning forest of the possible pairs of each cell, each pair once."""

    def judge(table, *cell):
        pairs = _possible(*cell)
        if pairs is None:
            return None
        keep, ids = _forest(pairs, table.num_rows), table["id"].to_numpy()
        return _pairs(ids[pairs[1][keep]], ids[pairs[2][keep]])

    return _by_cell(buckets.withColumn("class", F.col("id")), (), judge, "a long, b long")


def open_members(buckets: DataFrame) -> DataFrame:
    """bucket, band, id, class of the members that have a possible pair in another class; ``buckets`` has the members' class."""

    def judge(table, *cell):
        open_ = np.zeros(table.num_rows, bool)
        for i in range(table.num_rows - 1):
            _, other = _possible_of(i, *cell)
            open_[other] = True
            open_[i] |= len(other) > 0
        if not open_.any():
            return None
        return table.select(["bucket", "band", "id", "class"]).filter(pa.array(open_))

    return _by_cell(buckets, (), judge, "bucket long, band int, id long, class long").distinct()


class _Sets:
    """The shingle sets of a cell's members, to compare one with many."""

    def __init__(self, hashes, weights):
        self.found = [np.frombuffer(h.as_buffer(), np.uint64) for h in hashes]
        self.weights = [np.frombuffer(w.as_buffer(), np.uint32) if w.is_valid else None for w in weights]
        self.sizes = np.fromiter(map(len, self.found), np.int64, len(self.found))
        every, code = np.unique(np.concatenate(self.found), return_inverse=True)
        self.code, self.ends = code.astype(np.int32), np.cumsum(self.sizes)
        self.mark = np.zeros(len(every), bool)

    def _codes(self, i):
        return self.code[self.ends[i] - self.sizes[i] : self.ends[i]]

    def _weighted(self, i):
        return self.found[i], np.ones(len(self.found[i]), np.uint32) if self.weights[i] is None else self.weights[i]

    def similarities(self, i: int, others: np.ndarray) -> np.ndarray:
        """``similarity`` of member ``i`` with each of the others."""
        self.mark[self._codes(i)] = True
        common = np.fromiter((np.count_nonzero(self.mark[self._codes(j)]) for j in others), np.int64, len(others))
        self.mark[self._codes(i)] = False
        out = common / (self.sizes[i] + self.sizes[others] - common)
        for k, j in enumerate(others.tolist()):
            if common[k] and not (self.weights[i] is None and self.weights[j] is None):
                out[k] = similarity(self._weighted(i), self._weighted(j))
        return out


def links_between(buckets: DataFrame, sets: DataFrame, reps: DataFrame, threshold: float) -> DataFrame:
    """a, b (a < b): links that join the classes of ``buckets`` (bucket, band, id, class, sig, others) as all their links do.

    The members that have possible pairs in other classes bring their shingle sets to their bucket's cells, once a cell; every
    possible pair is verified there, until its classes are joined. So a cell gives fewer links than it has members, and
    no row is made for a pair.
    """
    members = written(open_members(buckets), "near-open", fewer=4)
    whole = reps.join(sets, "id").select("id", "sig", "hashes", "weights")
    bytes_ = sets.select("id", (F.octet_length("hashes") + F.coalesce(F.octet_length("weights"), F.lit(0))).cast("long").alias("bytes"))
    sizes = members.join(bytes_, "id").groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes"))
    parts = F.ceil(F.greatest(F.col("n") / CELL, F.col("bytes") / CELL_BYTES)).cast("int")

    def judge(table, *cell):
        *cell, classes = cell
        ids, classes = table["id"].to_numpy(), classes.copy()
        held = _Sets(table["hashes"], table["weights"])
        a, b = [], []
        for i in range(len(ids) - 1):
            share, other = _possible_of(i, *cell, classes)
            other = other[np.argsort(-share, kind="stable")]
            while len(other):
                near, other = other[:AT_ONCE], other[AT_ONCE:]
                for j in near[held.similarities(i, near) >= threshold].tolist():
                    if classes[i] != classes[j]:
                        a.append(ids[i])
                        b.append(ids[j])
                        classes[classes == classes[j]] = classes[i]
                other = other[classes[other] != classes[i]]
        return _pairs(np.array(a, np.int64), np.array(b, np.int64)) if a else None

    return _by_cell(deal(members, sizes, parts).join(whole, "id"), ("hashes", "weights"), judge, "a long, b long").distinct()


def verified(pairs: DataFrame, sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b of the pairs whose whole shingle sets are as similar as ``threshold``."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha"), F.col("weights").alias("wa"))
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb"), F.col("weights").alias("wb"))

    @tidied
    def run(batches):
        def read(hashes, weights, i):
            found = np.frombuffer(hashes[i].as_buffer(), np.uint64)
            weight = weights[i]
            return found, np.frombuffer(weight.as_buffer(), np.uint32) if weight.is_valid else np.ones(len(found), np.uint32)

        for batch in batches:
            ha, wa, hb, wb = (batch.column(c) for c in ("ha", "wa", "hb", "wb"))
            kept = [i for i in range(batch.num_rows) if similarity(read(ha, wa, i), read(hb, wb, i)) >= threshold]
            yield batch.select(["a", "b"]).take(pa.array(kept, pa.int64()))

    return pairs.join(left, "a").join(right, "b").select("a", "b", "ha", "wa", "hb", "wb").mapInArrow(run, "a long, b long")


def components(links: DataFrame) -> DataFrame:
    """id and class (the smallest id) of every id in ``links`` (a, b).

    Each turn every node takes its smallest neighbour for its parent, then the parent's parent; links between nodes of
    one class are dropped and the others go on between the parents, so the links left shrink from turn to turn.
    """
    edges = links
    labels = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy("a").agg(F.least("a", F.min("b")).alias("parent"))
        up = parents.select(F.col("a").alias("parent"), F.col("parent").alias("top"))
        parents = written(
            parents.join(up, "parent", "left").select(F.col("a").alias("node"), F.coalesce("top", "parent").alias("parent")),
            "near-parents",
            fewer=8,
        )
        if labels is None:
            labels = parents.select(F.col("node").alias("id"), F.col("parent").alias("class"))
        else:
            moved = parents.select(F.col("node").alias("class"), "parent")
            labels = labels.join(moved, "class", "left").select("id", F.coalesce("parent", "class").alias("class"))
        tail = parents.select(F.col("node").alias("a"), F.col("parent").alias("pa"))
        head = parents.select(F.col("node").alias("b"), F.col("parent").alias("pb"))
        edges = written(
            edges.join(tail, "a").join(head, "b").filter("pa <> pb").select(F.col("pa").alias("a"), F.col("pb").alias("b")).distinct(),
            "near-edges",
            fewer=8,
        )
        if edges.isEmpty():
            return written(labels, "near-labels", fewer=8)


def near_dedup(docs: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, class_id (id of the row that stays), class_size, kept, place.

    Banding and estimates are made for ``THRESHOLD``: a higher ``threshold`` is a stricter verification, a lower one is an
    error, because it would lose links without a word.
    """
    if not THRESHOLD <= threshold <= 1:
        raise ValueError(f"threshold must be between {THRESHOLD} and 1: the bands are made for {THRESHOLD}")
    content = located(docs, "doc_id", "text")
    signed = written(sign(content).withColumn("id", F.monotonically_increasing_id()), "near-signed")
    # Texts without words are copies of nothing.
    copy = F.coalesce("copy", F.concat(F.lit(b"\x00"), F.col("id").cast("string").cast("binary")))
    copies = signed.groupBy(copy.alias("text_key")).agg(F.min("id").alias("id"))
    reps = signed.filter("copy is not null").join(copies.select("id"), "id", "left_semi").select("id", "sig")
    buckets = written(bucket_rows(reps), "near-buckets")
    first = written(candidate_pairs(buckets), "near-pairs")
    ends = first.select(F.col("a").alias("id")).union(first.select(F.col("b").alias("id"))).distinct()
    ids = written(
        ends.join(signed.select("id", "place"), "id").withColumn("spot", F.xxhash64("place")), "near-candidates", fewer=8
    )
    texts = content.select("place", "text")
    if ids.count() <= BROADCAST:
        texts = texts.join(F.broadcast(ids.select("spot")), F.xxhash64("place") == F.col("spot"), "left_semi")
    sets = written(shingle_sets(texts.join(ids.select("id", "place"), "place")), "near-sets")
    links = written(verified(first, sets, threshold), "near-verified", fewer=4)
    classes = components(links)
    held = buckets.join(classes, "id", "left").withColumn("class", F.coalesce("class", "id"))
    more = written(links_between(held, sets, reps, threshold), "near-verified", fewer=4)
    if not more.isEmpty():
        # Links between classes: classes of classes.
        ends = held.select("id", "class").distinct()
        tail, head = (ends.select(F.col("id").alias(c), F.col("class").alias(f"c{c}")) for c in "ab")
        joined = components(
            more.join(tail, "a").join(head, "b").select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"))
        )
        classes = (
            ends.join(joined.select(F.col("id").alias("class"), F.col("class").alias("whole")), "class", "left")
            .select("id", F.coalesce("whole", "class").alias("class"))
        )
    # Copies get their representative's class.
    rows = (
        signed.select("doc_id", "place", copy.alias("text_key"))
        .join(copies, "text_key")
        .join(classes, "id", "left")
        .select("doc_id", "place", F.coalesce("class", "id").alias("class"))
    )
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("place"))
    stay = rows.groupBy("class").agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("class_size"))
    return rows.join(stay, "class").select(
        "doc_id",
        F.col("first.doc_id").alias("class_id"),
        "class_size",
        (F.col("first.place") == F.col("place")).alias("kept"),
        "place",
    )

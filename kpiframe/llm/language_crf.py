"""Language identification by a linear-chain conditional random field over the words of a text.

*Words* are runs of letters. A word's features are its character n-grams of 1 to 5 letters with marks for its
beginning and end (so prefixes and suffixes are among them), hashed to ``DIMENSIONS`` weights per language, and its
entry in a lexicon of frequent words, if it has one. Transitions between the languages of neighbouring words are learned.
*Learning.* A bounded sample: of each language the ``SAMPLE`` documents with the smallest hash of their id, among
labelled rows that aren't held out, and of each a run of ``SPAN`` words at a place given by that hash. Runs of different
languages are joined into code-switched sequences; full-batch Adam on the exact log-likelihood (forward-backward).
*Labelling.* Forward-backward over whole texts: texts are cut into chunks, the chunks' transition products give each
chunk its incoming and outgoing messages, and all chunks of a batch then go forward and backward side by side.
The result is exact. A text's language is the one with the largest mean posterior over its words; that mean is
the score.

Defined results: null texts and texts without a letter are ``und`` with score 0; so is every text if nothing can be
learned from; very long texts are labelled whole; repeated rows and null ids are kept (null ids aren't held out); ties go to the smaller language
name; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kpiframe.llm.common import hash_below, held_out, tidied

#: Bound of the sample: documents of each language, and words of each.
SAMPLE = 1500
SPAN = 60
DIMENSIONS = 1 << 16
LEXICON = 4000
NGRAMS = 5
EPOCHS = 40
STEP = 0.08
RIDGE = 1e-4
CHUNK = 64
#: Words of texts that go side by side, and cached word types of a worker.
SIDE_BY_SIDE = 400_000
CACHE = 300_000
UNKNOWN = "und"

_WORD = re.compile(r"[^\W\d_]+")
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """Runs of letters, lower-cased. The pattern also takes numbers that are no digits (fractions, Roman numerals)."""
    found = _WORD.findall(text.lower()) if text else []
    if all(map(str.isalpha, found)):
        return found
    return [w for run in found for w in "".join(c if c.isalpha() else " " for c in run).split()]


def word_features(words: list[str], lexicon: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature numbers, start of each word's features): hashed n-grams and, if known, the lexicon entry."""
    if not words:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    starts = np.cumsum(lengths) - lengths
    left = np.repeat(starts + lengths, lengths) - np.arange(len(codes))  # codes from here to the word's end
    owner = np.repeat(np.arange(len(words)), lengths)
    found, whose = [], []
    rolled = np.zeros(len(codes), np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, NGRAMS + 1):
            shifted = np.concatenate([codes[n - 1 :], np.zeros(min(n - 1, len(codes)), np.uint64)])
            rolled = (rolled ^ (shifted + np.uint64(n))) * _MIX
            fits = left >= n
            found.append(((rolled[fits] >> np.uint64(40)) % np.uint64(DIMENSIONS)).astype(np.int64))
            whose.append(owner[fits])
        places = np.arange(len(codes)) - np.repeat(starts, lengths)
        weights = _MIX ** (places.astype(np.uint64) + np.uint64(1))
        names = np.add.reduceat(codes * weights, starts)
    if len(lexicon):
        at = np.minimum(np.searchsorted(lexicon, names), len(lexicon) - 1)
        known = lexicon[at] == names
        found.append(DIMENSIONS + at[known])
        whose.append(np.flatnonzero(known))
    numbers, owners = np.concatenate(found), np.concatenate(whose)
    order = np.argsort(owners, kind="stable")
    return numbers[order], np.searchsorted(owners[order], np.arange(len(words)))


def word_names(words: list[str]) -> np.ndarray:
    """The hash by which the lexicon knows a word."""
    lengths = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    codes = np.frombuffer("".join(f"\x02{w}\x03" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    starts = np.cumsum(lengths) - lengths
    places = np.arange(len(codes)) - np.repeat(starts, lengths)
    with np.errstate(over="ignore"):
        return np.add.reduceat(codes * _MIX ** (places.astype(np.uint64) + np.uint64(1)), starts)


@dataclass
class Crf:
    languages: list[str]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray  # log potentials, from x to
    lexicon: np.ndarray  # sorted hashes of the lexicon's words

    def emissions(self, words: list[str]) -> np.ndarray:
        numbers, starts = word_features(words, self.lexicon)
        if not words:
            return np.zeros((0, len(self.languages)), np.float32)
        return np.add.reduceat(self.weights[numbers], starts, axis=0).astype(np.float32)

    def posteriors(self, emissions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Posterior of each language for every word; ``lengths``: words of each text (all positive)."""
        size = emissions.shape[1]
        move = np.exp(self.transitions)
        per_text = -(-lengths // CHUNK)
        chunks = int(per_text.sum())
        first = np.cumsum(per_text) - per_text
        text = np.repeat(np.arange(len(lengths)), per_text)
        begin = np.repeat(np.cumsum(lengths) - lengths, per_text) + (np.arange(chunks) - first[text]) * CHUNK
        count = np.minimum(CHUNK, np.repeat(np.cumsum(lengths), per_text) - begin)
        # Potentials by (step, chunk, language); steps beyond a chunk's words are never used.
        at = np.minimum(begin[None, :] + np.arange(CHUNK)[:, None], len(emissions) - 1)
        scaled = np.exp(emissions - emissions.max(axis=1, keepdims=True))[at]
        live = np.arange(CHUNK)[:, None] < count[None, :]
        inward = np.full((chunks, size), 1.0 / size)
        outward = np.ones((chunks, size))
        many = np.flatnonzero(per_text[text] > 1)
        if len(many):
            product = np.broadcast_to(np.eye(size), (len(many), size, size)).copy()
            for t in range(CHUNK):
                on = live[t, many]
                after = (product[on] @ move) * scaled[t, many[on]][:, None, :]
                product[on] = after / after.max(axis=(1, 2), keepdims=True)
            place = np.full(chunks, -1)
            place[many] = np.arange(len(many))
            rank = np.arange(chunks) - first[text]
            for k in range(1, int(per_text.max())):
                mine = np.flatnonzero(rank == k) if k < 64 else first[per_text > k] + k
                vector = (inward[mine - 1][:, None, :] @ product[place[mine - 1]])[:, 0]
                inward[mine] = vector / vector.sum(axis=1, keepdims=True)
            for k in range(int(per_text.max()) - 2, -1, -1):
                mine = first[per_text > k + 1] + k
                vector = (product[place[mine + 1]] @ outward[mine + 1][:, :, None])[:, :, 0]
                outward[mine] = vector / vector.max(axis=1, keepdims=True)
        forward = np.empty((CHUNK, chunks, size))
        message = inward
        for t in range(CHUNK):
            after = (message @ move) * scaled[t]
            forward[t] = after / after.sum(axis=1, keepdims=True)
            message = np.where(live[t][:, None], forward[t], message)
        out = np.empty_like(emissions)
        message = outward
        for t in range(CHUNK - 1, -1, -1):
            on = live[t]
            both = forward[t, on] * message[on]
            out[begin[on] + t] = both / both.sum(axis=1, keepdims=True)
            before = (scaled[t, on] * message[on]) @ move.T
            message = message.copy()
            message[on] = before / before.max(axis=1, keepdims=True)
        return out


def _sequences(rows: list[tuple[str, list[str]]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Words and labels (language numbers) of code-switched sequences of equal length, made of runs of the rows."""
    languages = sorted({lang for lang, _ in rows})
    number = {lang: i for i, lang in enumerate(languages)}
    rng = np.random.default_rng(7)
    words, labels = [], []
    runs = []
    for lang, span in rows:
        at = 0
        while at < len(span):
            n = int(rng.integers(8, 41))
            runs.append((number[lang], span[at : at + n]))
            at += n
    for i in rng.permutation(len(runs)):
        words += runs[i][1]
        labels += [runs[i][0]] * len(runs[i][1])
    length = 128
    keep = max(length, len(words) // length * length) if words else 0
    while words and len(words) < keep:
        words, labels = words + words, labels + labels
    return languages, np.array(words[:keep], dtype=object).reshape(-1, length), np.array(labels[:keep]).reshape(-1, length)


def gradients(emissions: np.ndarray, transitions: np.ndarray, gold: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Slopes of the sequences' log-likelihood (sequence, word, language) by emissions and transitions.

    ``gold`` has 1 at each word's language. What stands before a sequence is any language, one as likely as another.
    """
    batch, length, size = emissions.shape
    scaled = np.exp(emissions - emissions.max(axis=2, keepdims=True))
    move = np.exp(transitions - transitions.max())
    forward, message = np.empty_like(scaled), np.full((batch, size), 1.0 / size)
    for t in range(length):
        message = (message @ move) * scaled[:, t]
        message /= message.sum(axis=1, keepdims=True)
        forward[:, t] = message
    backward, message = np.empty_like(scaled), np.ones((batch, size))
    moves = np.zeros_like(transitions)
    for t in range(length - 1, -1, -1):
        backward[:, t] = message
        inward = forward[:, t - 1] if t else np.full((batch, size), 1.0 / size)
        outward = scaled[:, t] * message
        pair = inward[:, :, None] * move[None] * outward[:, None, :]
        moves += (pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        message = outward @ move.T
        message /= message.max(axis=1, keepdims=True)
    posterior = forward * backward
    posterior /= posterior.sum(axis=2, keepdims=True)
    gold_moves = np.einsum("bti,btj->ij", gold[:, :-1], gold[:, 1:]) + gold[:, 0].sum(axis=0)[None, :] / size
    return gold - posterior, gold_moves - moves


def fit(rows: list[tuple[str, list[str]]]) -> Crf | None:
    """Weights and transitions from (language, words) runs; None without any word."""
    rows = [(lang, words) for lang, words in rows if words]
    if not rows:
        return None
    languages, words, labels = _sequences(rows)
    size = len(languages)
    types, where = np.unique(words.ravel().astype(str), return_inverse=True)
    counts = np.bincount(where)
    common = [str(types[i]) for i in np.argsort(-counts, kind="stable")[:LEXICON] if counts[i] > 1]
    lexicon = np.unique(word_names(common)) if common else np.zeros(0, np.uint64)
    numbers, starts = word_features([str(w) for w in types], lexicon)
    ends = np.append(starts[1:], len(numbers))
    owner = np.repeat(np.arange(len(types)), ends - starts)
    weights = np.zeros((DIMENSIONS + max(1, len(lexicon)), size))
    transitions = np.zeros((size, size))
    batch, length = labels.shape
    where = where.reshape(labels.shape)
    moments = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(transitions), np.zeros_like(transitions)]
    gold = np.eye(size)[labels]
    for epoch in range(1, EPOCHS + 1):
        miss, moves_missed = gradients(np.add.reduceat(weights[numbers], starts, axis=0)[where], transitions, gold)
        miss = miss.reshape(-1, size)
        per_type = np.stack([np.bincount(where.ravel(), miss[:, k], len(types)) for k in range(size)], axis=1)
        slope = np.stack([np.bincount(numbers, per_type[owner, k], len(weights)) for k in range(size)], axis=1)
        slopes = (slope / miss.shape[0] - RIDGE * weights / 100, moves_missed / miss.shape[0])
        for target, grad, first, second in zip((weights, transitions), slopes, moments[::2], moments[1::2]):
            first += 0.1 * (grad - first)
            second += 0.02 * (grad * grad - second)
            target += STEP * (first / (1 - 0.9**epoch)) / (np.sqrt(second / (1 - 0.98**epoch)) + 1e-8)
    return Crf(languages, weights.astype(np.float32), transitions - transitions.max(), lexicon)


def training_runs(docs: DataFrame, sample: int = SAMPLE, span: int = SPAN) -> list[tuple[str, list[str]]]:
    """(language, words) of the bounded sample: at most ``sample`` runs of ``span`` words for each language."""
    order = F.xxhash64("doc_id")
    usable = docs.filter(
        F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()
    )
    # The hash spreads evenly over the longs: a share of its range holds about that share of a language's rows. Twice the
    # sample is read, whatever the table's size, and cut to the sample below.
    counts = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # one row per language
    cuts = [(r["lang"], hash_below(2.0 * sample / r["n"])) for r in counts]
    if not cuts:
        return []
    below = F.create_map(*[F.lit(x) for pair in cuts for x in pair])

    @tidied
    def runs(batches):
        for batch in batches:
            out = []
            for text, at in zip(batch.column("text").to_pylist(), batch.column("place").to_pylist()):
                words = words_of(text)
                begin = int(max(0, len(words) - span) * at)
                out.append(words[begin : begin + span])
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("order"), pa.array(out, pa.list_(pa.string()))],
                ["lang", "order", "words"],
            )

    found = (
        usable.filter(order <= F.element_at(below, F.col("lang")))
        .select("lang", "text", order.alias("order"), (F.pmod(order, F.lit(10007)) / 10007).alias("place"))
        .mapInArrow(runs, "lang string, order long, words array<string>")
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("order", "words")))
        .filter(F.col("rank") <= sample)
        .orderBy("lang", "rank")
        .select("lang", "words")
        .toArrow()
    )
    return list(zip(found["lang"].to_pylist(), found["words"].to_pylist()))


def identify(docs: DataFrame, *, sample: int = SAMPLE, spans: bool = False, crf: Crf | None = None) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, n_words, switches (language changes in the text).

    ``spans`` adds the labelled runs of words: array of (start, end, lang), words counted from 0. ``crf`` skips learning.
    """
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(crf or fit(training_runs(docs, sample)))
    kind = docs.schema["doc_id"].dataType.simpleString()
    span_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
    names = ["doc_id", "lang_pred", "score", "n_words", "switches"] + ["spans"] * spans
    schema = f"doc_id {kind}, lang_pred string, score double, n_words int, switches int"
    if spans:
        schema += ", spans array<struct<start:int,end:int,lang:string>>"

    @tidied
    def label(batches):
        net = model.value
        if net is None:
            for batch in batches:
                n = batch.num_rows
                columns = [batch.column("doc_id"), pa.array([UNKNOWN] * n), pa.array([0.0] * n)]
                columns += [pa.array([0] * n, pa.int32())] * 2 + [pa.array([[]] * n, span_type)] * spans
                yield pa.RecordBatch.from_arrays(columns, names)
            return
        size = len(net.languages)
        table: dict[str, int] = {}
        known = np.zeros((1024, size), np.float32)

        def numbered(words):
            nonlocal known, table
            new = list(set(words).difference(table))
            if len(table) + len(new) > CACHE:
                table, new = {}, list(set(words))
            if new:
                need = len(table) + len(new)
                if need > len(known):
                    known = np.concatenate([known[: len(table)], np.zeros((2 * need - len(table), size), np.float32)])
                known[len(table) : need] = net.emissions(new)
                table.update(zip(new, range(len(table), need)))
            return known[np.fromiter(map(table.__getitem__, words), np.int64, len(words))]

        def answer(some: list[list[str]]):
            flat = [w for words in some for w in words]
            lengths = np.fromiter(map(len, some), np.int64, len(some))
            posterior = net.posteriors(numbered(flat), lengths)
            starts = np.cumsum(lengths) - lengths
            means = np.add.reduceat(posterior.astype(np.float64), starts, axis=0) / lengths[:, None]
            best = means.argmax(axis=1)
            labels = posterior.argmax(axis=1)
            change = np.flatnonzero(np.diff(labels)) + 1
            change = change[~np.isin(change, starts)]
            switches = np.bincount(np.searchsorted(starts, change, "right") - 1, minlength=len(some))
            pieces = [None] * len(some)
            if spans:
                marks = np.union1d(change, starts)
                ends = np.append(marks[1:], len(labels))
                pieces = [[] for _ in some]
                for a, b, t in zip(marks, ends, np.searchsorted(starts, marks, "right") - 1):
                    pieces[t].append((int(a - starts[t]), int(b - starts[t]), net.languages[labels[a]]))
            return [
                (net.languages[k], min(1.0, float(m[k])), int(n), int(s), p)
                for k, m, n, s, p in zip(best, means, lengths, switches, pieces)
            ]

        for batch in batches:
            texts = batch.column("text").to_pylist()
            rows: list = [(UNKNOWN, 0.0, 0, 0, [])] * len(texts)
            held, held_words, total = [], [], 0
            for i, text in enumerate(texts):
                words = words_of(text)
                if words:
                    held.append(i)
                    held_words.append(words)
                    total += len(words)
                if held and (total > SIDE_BY_SIDE or i + 1 == len(texts)):
                    for j, row in zip(held, answer(held_words)):
                        rows[j] = row
                    held, held_words, total = [], [], 0
            columns = [batch.column("doc_id")] + [
                pa.array([r[c] for r in rows], t)
                for c, t in enumerate((pa.string(), pa.float64(), pa.int32(), pa.int32(), span_type)[: 4 + spans])
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return docs.select("doc_id", "text").mapInArrow(label, schema).withColumn("held_out", held_out())

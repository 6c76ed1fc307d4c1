"""Operators on texts against brute force: exact and near duplicates, licences, tokens, BPE, languages, quality."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from corpus_cases import DOC, doc
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from kpiframe.llm import language_crf, license_scan, near_dedup, quality_gam
from kpiframe.llm.bpe_codec import bpe_codec
from kpiframe.llm.exact_dedup import exact_dedup
from kpiframe.llm.token_counts import count_tokens

BPE = public_tokenizers.path("byte_bpe_50k.json")


# --- exact duplicates ------------------------------------------------------------------------


def brute_exact(rows):
    groups = {}
    for i, (doc_id, text) in enumerate(rows):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", text or ""), []).append((-len(text or ""), doc_id is None, doc_id or 0, i, doc_id))
    out = Counter()
    for norm, members in groups.items():
        keeper = min(members)[4]
        for _, _, _, _, doc_id in members:
            out[(doc_id, keeper, len(members), hashlib.sha256(norm.encode()).hexdigest())] += 1
    return out, len(groups)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup(spark, odd_documents, weak):
    # With four bits of digest nearly every digest joins different texts: the bytes must decide.
    digest = {"digest": lambda n: F.substring(F.sha2(n, 256), 1, 1)} if weak else {}
    rows = [tuple(r) for r in odd_documents.select("doc_id", "text").collect()]
    got = exact_dedup(odd_documents, **digest).collect()
    want, groups = brute_exact(rows)
    assert Counter((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got) == want
    assert sum(r["kept"] for r in got) == groups
    assert exact_dedup(odd_documents.limit(0), **digest).count() == 0


def test_exact_dedup_goes_on_from_its_state(table, tmp_path):
    state = str(tmp_path / "state")
    first = exact_dedup(table([doc(1, "a b"), doc(2, "c")], DOC), state_dir=state)
    assert first.where("kept").count() == 2
    # A later run over more documents, one of them a longer copy of an earlier one.
    later = exact_dedup(table([doc(7, "a  b"), doc(8, "d"), doc(9, "c")], DOC), state_dir=state)
    rows = {r["doc_id"]: r for r in later.collect()}
    assert (rows[7]["keep_id"], rows[7]["group_size"], rows[7]["kept"]) == (7, 2, True)
    assert (rows[9]["keep_id"], rows[9]["group_size"], rows[9]["kept"]) == (2, 2, False)
    assert rows[8]["group_size"] == 1


# --- near duplicates ---------------------------------------------------------------------------


def shingled(text):
    words = re.findall(r"\w+", (text or "").lower())
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def probability_jaccard(a, b):
    total = 0.0
    for x in a.keys() & b.keys():
        total += 1 / sum(max(a[y] / a[x], b[y] / b[x]) for y in a.keys() | b.keys())
    return total


def test_similarity_is_probability_jaccard():
    rng = np.random.default_rng(3)
    for _ in range(40):
        a, b = (Counter(rng.integers(0, 30, rng.integers(1, 60)).tolist()) for _ in range(2))
        pack = lambda c: (np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], np.uint32))
        assert near_dedup.similarity(pack(a), pack(b)) == pytest.approx(probability_jaccard(a, b))


def test_signatures_estimate_it():
    rng = random.Random(5)
    near = []
    for _ in range(30):
        a = [rng.randrange(1 << 40) for _ in range(120)]
        b = list(a)
        for _ in range(rng.randrange(0, 30)):
            b[rng.randrange(len(b))] = rng.randrange(1 << 40)
        owner, element, weight = near_dedup.shingles([a, b])
        sig = near_dedup.signatures(2, owner, element, weight)
        sets = [(element[owner == k], weight[owner == k]) for k in (0, 1)]
        near.append((sig[0] == sig[1]).mean() - near_dedup.similarity(*sets))
    assert abs(np.mean(near)) < 0.02 and np.max(np.abs(near)) < 0.15


def test_near_dedup_classes(spark, table):
    rng = random.Random(11)
    vocabulary = [f"word{i}" for i in range(4000)]
    rows, number = [], 0
    for _ in range(12):  # families: an original, and copies with a few words changed
        base = [rng.choice(vocabulary) for _ in range(rng.randrange(30, 200))]
        for copy in range(rng.randrange(1, 9)):
            words = list(base)
            for _ in range(copy and rng.randrange(0, 8)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rows.append(doc(number, " ".join(words)))
            number += 1
    rows += [doc(None, rows[0][1]), doc(900, rows[0][1].upper() + "!"), doc(901, None), doc(902, ""), doc(903, "!!"), doc(904, "one two"),
             doc(905, "one, two"), doc(906, "one two three"), doc(904, "one two")]
    docs = table(rows, DOC)
    got = near_dedup.near_dedup(docs).collect()
    sets = [shingled(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and probability_jaccard(sets[i], sets[j]) >= 0.8:
                root[find(i)] = find(j)
    want = {}
    for i, r in enumerate(rows):
        want.setdefault(find(i), []).append(r[0])
    classes = {}
    for r in got:
        classes.setdefault((r["class_id"], r["class_size"]), []).append(r["doc_id"])
    key = lambda members: sorted(members, key=lambda x: (x is None, x or 0))
    assert sorted(map(key, classes.values()), key=str) == sorted(map(key, want.values()), key=str)
    assert all(c[0] == key(m)[0] and c[1] == len(m) for c, m in classes.items())
    assert sum(r["kept"] for r in got) == len(want)
    assert near_dedup.near_dedup(docs.limit(0)).count() == 0


def test_thresholds_that_the_bands_arent_made_for(table):
    docs = table([doc(1, "a b c d e f"), doc(2, "a b c d e g")], DOC)
    for threshold in (0.6, 0.79, 1.1):
        with pytest.raises(ValueError, match="bands"):
            near_dedup.near_dedup(docs, threshold=threshold)


def test_links_of_the_given_table_are_found(spark):
    """Recall on sf0.01: every pair with similarity 0.8 or more, found by comparing all pairs that share a shingle."""
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r["class_id"] for r in near_dedup.near_dedup(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    sets = {r["doc_id"]: shingled(r["text"]) for r in rows}
    holders = {}
    for i, found in sets.items():
        for x in found:
            holders.setdefault(x, []).append(i)
    common = Counter((a, b) for ids in holders.values() for a in ids for b in ids if a < b)
    links = [(a, b) for (a, b), n in common.items() if 3 * n >= min(len(sets[a]), len(sets[b])) and probability_jaccard(sets[a], sets[b]) >= 0.8]
    assert len(links) > 50 and all(got[a] == got[b] for a, b in links)


def test_large_buckets_lose_no_link(spark, table, monkeypatch):
    # Buckets of more than CELL members are compared in pairs of parts.
    monkeypatch.setattr(near_dedup, "CELL", 4)
    base = [f"t{i}" for i in range(90)]
    rows = [doc(i, " ".join(base[:40] + [f"x{i}"] + base[40:])) for i in range(23)]
    got = near_dedup.near_dedup(table(rows, DOC))
    assert got.select("class_id").distinct().count() == 1 and got.where("kept").count() == 1


def family(rng, count, most):
    """Texts that are one text with up to ``most`` words of their own between its words: many pairs are just not similar enough."""
    base = [f"t{i}" for i in range(150)]
    texts = []
    for i in range(count):
        words = list(base)
        for k in range(rng.randrange(1, most + 1)):
            words.insert(rng.randrange(len(words)), f"own{i}x{k}")
        texts.append(" ".join(words))
    return texts


def classes_by_jaccard(texts):
    sets = [set(shingled(t)) for t in texts]
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                gone, root_ = max(root[i], root[j]), min(root[i], root[j])
                root = [root_ if r == gone else r for r in root]
    return root


@pytest.mark.parametrize("cell, size", [(near_dedup.CELL, 8 << 20), (16, 8 << 20), (near_dedup.CELL, 30_000)])
def test_dense_families_are_verified_without_a_row_for_each_pair(spark, table, monkeypatch, cell, size):
    monkeypatch.setattr(near_dedup, "CELL", cell)
    monkeypatch.setattr(near_dedup, "CELL_BYTES", size, raising=False)
    pairs, plain = [], near_dedup.verified

    def verified(found, *args):
        pairs.append(found.count())
        return plain(found, *args)

    monkeypatch.setattr(near_dedup, "verified", verified)
    texts = family(random.Random(3), 160, 5)
    got = near_dedup.near_dedup(table([doc(i, t) for i, t in enumerate(texts)], DOC)).collect()
    want = classes_by_jaccard(texts)
    assert {r["doc_id"]: r["class_id"] for r in got} == dict(enumerate(want)) and 5 < len(set(want)) < 100
    if cell > len(texts):
        # A spanning forest for each bucket, and no pairs after that (there are 12,720 pairs).
        assert sum(pairs) < 12 * len(texts)


def test_sets_of_a_cell_compare_as_pairs_do():
    rng = np.random.default_rng(4)
    counts = [Counter(rng.integers(0, 60, rng.integers(1, 80)).tolist()) for _ in range(12)] + [Counter(range(n)) for n in (1, 20, 40, 60)]
    sets = [(np.array(sorted(c), np.uint64), np.array([c[k] for k in sorted(c)], np.uint32)) for c in counts]
    packed = pa.array([h.tobytes() for h, _ in sets], pa.binary()), pa.array([w.tobytes() if w.max() > 1 else None for _, w in sets], pa.binary())
    held = near_dedup._Sets(*packed)
    for i in range(len(sets)):
        others = np.array([j for j in range(len(sets)) if j != i])
        assert held.similarities(i, others).tolist() == [near_dedup.similarity(sets[i], sets[j]) for j in others]


def test_odd_documents_have_near_classes(odd_documents):
    got = near_dedup.near_dedup(odd_documents)
    assert got.count() == 12 and got.where("doc_id = 1").select("class_size").distinct().collect()[0][0] == 2


# --- licences --------------------------------------------------------------------------------------


def brute_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = [(i, label) for phrase, label in license_scan.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    places = [i for i, _ in found]
    return len(words), len(found), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in found}))


def test_licence_passes_begin_with_collected_garbage(table, monkeypatch):
    done, written, collect = [], license_scan.written, license_scan.collect_garbage
    monkeypatch.setattr(license_scan, "written", lambda df, label: done.append(label) or written(df, label))
    monkeypatch.setattr(license_scan, "collect_garbage", lambda spark: done.append("collected") or collect(spark))
    # Words that aren't licence words leave no place, those that only lower() makes licence words neither.
    rows = license_scan.license_scan(table([doc(1, "x MIT License \u212aey c\u0130 mit\u212a"), doc(2, "x y"), doc(3, None)], DOC)).collect()
    assert {r["doc_id"]: (r["n_words"], r["n_base"], r["first_word"], r["labels"]) for r in rows} == {
        1: (6, 1, 1, "mit"), 2: (2, 0, None, ""), 3: (0, 0, None, "")
    }
    assert done == ["collected", "licence-index", "collected"]


def test_licence_places(spark, table):
    rng = random.Random(2)
    words = "gnu general public license apache cc by mit version 2 the of İt \u212aey nc".split()
    texts = [" ".join(rng.choice(words).upper() if rng.random() < 0.3 else rng.choice(words) for _ in range(rng.randrange(0, 60))) for _ in range(200)]
    texts += ["...GNU  General\nPublic-License", "mit license mit license", None, "", "-- ", "cc by" * 500, "permission is hereby granted, free of charge, to any person obtaining a copy of that software"]
    docs = table([doc(i, t) for i, t in enumerate(texts)], DOC)
    got = {r["doc_id"]: r for r in license_scan.license_scan(docs).collect()}
    for i, t in enumerate(texts):
        assert tuple(got[i][c] for c in ("n_words", "n_base", "first_word", "last_word", "base_labels")) == brute_licences(t), t
        assert set(got[i]["base_labels"].split(",")) <= set(got[i]["labels"].split(",")) | {""} and 0 <= got[i]["score"] <= 1
    assert got[len(texts) - 1]["labels"] == "mit"  # one word of the template differs
    assert license_scan.license_scan(docs.limit(0)).count() == 0


def brute_scores(texts):
    """Largest share of a template's words at an offset that holds one of its three rarest words."""
    files = [re.findall(r"[0-9a-z]+", (t or "").lower()) for t in texts]
    counts = Counter(w for f in files for w in set(f))
    templates = [p.split() for p in license_scan.BASE] + [words.split() for _, words, _ in license_scan.TEMPLATES]
    out = []
    for f in files:
        best = 0.0
        for words in templates:
            rare = sorted({(counts[w], w) for w in words if 0 < counts[w] <= max(20, len(files) / 10)})[:3]
            for start in range(-len(words), len(f)):
                here = [w for i, w in enumerate(words) if 0 <= start + i < len(f) and f[start + i] == w]
                if {w for _, w in rare} & set(here):
                    best = max(best, len(here) / len(words))
        out.append(round(best, 6))
    return out


def test_licence_scores_of_partial_matches(table):
    grant = "permission is hereby granted free of charge to any person obtaining a copy of this software"
    texts = ["free of charge to any person obtaining a copy of this software", grant, grant.replace("hereby", "now"), "hereby hereby", "the software of any person"]
    texts += ["permission granted to use it", "person obtaining a copy", "in source and binary forms", "the gnu public", "cc", "by", "", None]
    got = {r["doc_id"]: r for r in license_scan.license_scan(table([doc(i, t) for i, t in enumerate(texts)], DOC)).collect()}
    assert [got[i]["score"] for i in range(len(texts))] == brute_scores(texts)
    assert got[0]["score"] == 0.75 and got[0]["labels"] == ""  # 12 of 16 words, not the rarest one of the key phrase


@pytest.mark.parametrize("batch", [0, 1])
def test_licence_mentions_without_their_lead_in(table, batch):
    want = [
        {
            "under the terms of the GNU General Public License version 3": "gpl,gpl-3.0",
            "GNU General Public License version 3": "gpl,gpl-3.0",
            "GNU General Public License, version 2": "gpl,gpl-2.0",
            "licensed under the new GNU General Public License version 3": "gpl,gpl-3.0",
            "Apache License, Version 2.0": "apache,apache-2.0",
            "CC BY-NC 4.0": "cc-by,cc-by-nc",
            "licensed under CC BY-NC-SA 4.0": "cc-by,cc-by-nc",
            "CC BY-SA 3.0": "cc-by,cc-by-sa",
            "Permission is hereby granted, free of charge, to everybody": "mit",
            "Redistribution and use in source and binary forms is allowed": "bsd",
            "it is free and unencumbered software": "unlicense",
        },
        {  # names that hold others' key phrases
            "GNU Lesser General Public License version 3": "lgpl",
            "GNU Affero General Public License version 3": "agpl",
            "Mozilla Public License Version 2.0": "mpl",
            "Mozilla Public License 1.1": "mpl",
            "licensed under the terms of a public license version 3": "",
            "licensed under the gnu broad public license version 3": "gpl-3.0",  # 8 of 9 words
            "licensed under the Apache License": "apache",
            "hereby granted, free of charge": "",
            "CC BY 4.0": "cc-by",
        },
    ][batch]
    docs = table([doc(i, t) for i, t in enumerate(want)], DOC)
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(docs).collect()}
    assert {t: got[i] for i, t in enumerate(want)} == want


# --- tokens -----------------------------------------------------------------------------------------


def test_tokens_as_the_library_gives_them(spark, table, odd_documents):
    rng = random.Random(4)
    bits = [" ", "  ", "\n", "\t", "a", "be", "é", "12", "'s", "'", ".", "<|endoftext|>", "\x1c", "日本", "🙂", "\r\n", "\u3000", "\xa0", "word"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(600)]
    library = Tokenizer.from_file(BPE)
    for docs in (table([doc(i, t) for i, t in enumerate(texts)], DOC), odd_documents):
        want = Counter()
        for r in docs.select("doc_id", "text").collect():
            ids = library.encode(r["text"] or "", add_special_tokens=False).ids
            want[(r["doc_id"], len((r["text"] or "").encode()), tuple(ids), library.decode(ids, skip_special_tokens=False))] += 1
        counted = count_tokens(docs, BPE, limit=5).collect()
        assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in counted) == sum(
            (Counter({(i, b, len(ids), len(ids) > 5): n}) for (i, b, ids, _), n in want.items()), Counter())
        coded = bpe_codec(docs, BPE, block_bytes=4000).collect()
        assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"]) for r in coded) == sum(
            (Counter({(i, ids, text): n}) for (i, _, ids, text), n in want.items()), Counter())
        assert count_tokens(docs.limit(0), BPE).count() == 0 and bpe_codec(docs.limit(0), BPE).count() == 0


def test_small_caches_change_nothing(documents):
    from kpiframe.llm import bpe_codec as codec
    from kpiframe.llm import token_counts

    want = {r["doc_id"]: r["n_tokens"] for r in count_tokens(documents, BPE).collect()}
    few = token_counts.count_tokens(documents, BPE, frequent=3)
    assert {r["doc_id"]: r["n_tokens"] for r in few.collect()} == want
    assert {r["doc_id"]: len(r["ids"]) for r in codec.bpe_codec(documents, BPE, block_bytes=1 << 15).collect()} == want


def test_no_piece_is_shuffled(documents, spark):
    """Summaries, one row a task, are all that is exchanged; merged, they know the frequent pieces."""
    from kpiframe.llm import token_counts
    from kpiframe.llm.pieces import Cutter, ship

    tokenizer = ship(spark, BPE)
    rows = token_counts.summaries(documents.repartition(40), tokenizer)
    assert "Exchange" not in token_counts.summaries(documents, tokenizer)._jdf.queryExecution().executedPlan().toString()
    assert rows.count() == 40
    cutter = Cutter(tokenizer.value)
    counts = Counter(k for r in documents.select("text").collect() for k in cutter.keys(r["text"]))
    got = token_counts.frequent_lengths(documents.repartition(40), tokenizer, frequent=200)
    # Summaries count a little less than there is, never more.
    often = lambda share: {k for k, n in counts.items() if n * share >= counts.total() and len(k) <= token_counts.LONGEST}
    assert len(often(150)) > 5 and often(150) <= set(got) <= often(200)
    assert token_counts.frequent_lengths(documents.limit(0), tokenizer) == {}


def test_other_tokenizer_files_are_refused(documents):
    with pytest.raises(ValueError, match="byte-level"):
        count_tokens(documents, public_tokenizers.path("word_bpe_49k.json"))


# --- languages ---------------------------------------------------------------------------------------


def test_posteriors_are_forward_backward():
    rng = np.random.default_rng(1)
    size, lengths = 3, np.array([1, 2, 64, 65, 200, 1000])
    net = language_crf.Crf(list("abc"), np.zeros((1, size), np.float32), rng.normal(size=(size, size)), np.zeros(0, np.uint64))
    emissions = rng.normal(size=(int(lengths.sum()), size)) * 3
    got = net.posteriors(emissions, lengths)
    move, at = np.exp(net.transitions), 0
    for n in lengths:
        e = np.exp(emissions[at : at + n])
        forward, backward = [], [np.ones(size)]
        a = np.full(size, 1 / size)
        for row in e:
            a = (a @ move) * row
            a /= a.sum()
            forward.append(a)
        for row in e[:0:-1]:
            b = move @ (row * backward[-1])
            backward.append(b / b.max())
        want = np.array(forward) * np.array(backward[::-1])
        np.testing.assert_allclose(got[at : at + n], want / want.sum(axis=1, keepdims=True), atol=1e-9)
        at += n


def test_learning_follows_the_likelihood():
    """Slopes against numeric differences of the log-likelihood, summed over every labelling."""
    import itertools

    rng = np.random.default_rng(8)
    size, length, batch = 3, 4, 2
    emissions, transitions = rng.normal(size=(batch, length, size)), rng.normal(size=(size, size))
    labels = rng.integers(0, size, (batch, length))

    def likelihood(e, t):
        total = 0.0
        for b in range(batch):
            score = lambda y, start: t[start, y[0]] + sum(e[b, i, y[i]] for i in range(length)) + sum(t[y[i], y[i + 1]] for i in range(length - 1))
            every = [score(y, s) for y in itertools.product(range(size), repeat=length) for s in range(size)]
            total += np.mean([score(labels[b], s) for s in range(size)]) - np.log(np.exp(every).sum())
        return total

    by_word, by_move = language_crf.gradients(emissions, transitions, np.eye(size)[labels])
    step = 1e-5
    for array, slopes in ((emissions, by_word), (transitions, by_move)):
        for at in np.ndindex(array.shape):
            up, down = array.copy(), array.copy()
            up[at] += step
            down[at] -= step
            pick = (lambda x: (x, transitions)) if array is emissions else (lambda x: (emissions, x))
            numeric = (likelihood(*pick(up)) - likelihood(*pick(down))) / (2 * step)
            assert slopes[at] == pytest.approx(numeric, abs=1e-6)


def test_languages_held_out(documents):
    rows = language_crf.identify(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["held_out"] for r in rows)


def test_code_switched_spans(documents, table):
    en, de = (documents.where(f"lang = '{x}' AND n_chars > 400").orderBy("doc_id").first()["text"] for x in ("en", "de"))
    words = [" ".join(language_crf.words_of(t)[:40]) for t in (en, de)]
    net = language_crf.fit(language_crf.training_runs(documents))
    row = language_crf.identify(table([doc(1, words[0] + " " + words[1])], DOC), spans=True, crf=net).first()
    longest = {max((s["end"] - s["start"], s["lang"]) for s in row["spans"] if s["lang"] == x) for x in ("en", "de")}
    assert all(n >= 25 for n, _ in longest) and row["switches"] >= 1
    assert [s["end"] for s in row["spans"]][:-1] == [s["start"] for s in row["spans"]][1:]


def test_odd_texts_have_languages(odd_documents):
    rows = language_crf.identify(odd_documents).collect()
    assert len(rows) == 12
    by_id = {r["doc_id"]: r for r in rows}
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (2, 3, 4, 7, 10))
    assert by_id[8]["lang_pred"] in {"en", "fr", "de"}
    assert language_crf.identify(odd_documents.limit(0)).count() == 0
    nothing = language_crf.identify(odd_documents.withColumn("lang", F.lit(None).cast("string")))
    assert {r["lang_pred"] for r in nothing.collect()} == {"und"}


# --- quality -------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    rows = quality_gam.quality_scores(docs, labels).join(labels, "doc_id").where("held_out").collect()
    assert len(rows) > 60 and np.mean([r["predicted"] == r["quality"] for r in rows]) > 0.95


def test_features_by_hand():
    text = "The cat, the CAT the cat!! 12 ## x\nThe same line\nThe same line\nété"
    got = dict(zip(quality_gam.FEATURES, quality_gam.features_of(text)))
    words = text.split()
    n, size = len(words), len(text.encode())
    want = {
        "log_words": np.log(1 + n), "word_length": sum(map(len, words)) / n, "long_words": 0, "distinct_words": len(set(words)) / n**0.8,
        "repeated_next": 0, "top_word": 3 / n, "single_marks": 0, "symbol_ends": 1 / n, "symbols": 2 / size, "digits": 2 / size,
        "upper": 6 / size, "stops": 2 / n, "lines_per_word": 4 / n, "repeated_lines": 1 - 3 / 4,
        "blanks": sum(c in " \n" for c in text) / size, "beyond_ascii": 4 / size,
    }
    assert {k: pytest.approx(v) for k, v in want.items()} == got
    assert quality_gam.features_of(None) == quality_gam.features_of("") and len(quality_gam.features_of("")) == len(want)
    # The model's step on one feature: the mean of its bin's residuals over p (1 - p) + 1, times the rate.
    x, y = np.zeros((40, 16)), np.array([0.0, 1.0] * 20)
    x[:, 3] = y
    model = quality_gam.fit(x, y)
    low, high = model.score(x[:2])
    assert low < 0.02 and high > 0.98 and all(not t.any() for j, t in enumerate(model.tables) if j != 3)


def test_gam_learns_pairs_and_scores_by_tables():
    rng = np.random.default_rng(0)
    x = rng.random((3000, len(quality_gam.FEATURES)))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no single feature tells
    model = quality_gam.fit(x, y)
    assert ((model.score(x) > 0.5) == y).mean() > 0.9
    total = np.full(5, model.base)
    for i in range(5):
        total[i] += sum(t[np.searchsorted(e, x[i, j], "right")] for j, (e, t) in enumerate(zip(model.edges, model.tables)))
        total[i] += sum(t[np.searchsorted(model.coarse[a], x[i, a], "right"), np.searchsorted(model.coarse[b], x[i, b], "right")] for a, b, t in model.pairs)
    np.testing.assert_allclose(model.score(x[:5]), 1 / (1 + np.exp(-total)))


def test_odd_documents_have_scores(spark, odd_documents):
    labels = spark.createDataFrame([(1, 1), (1, 1), (5, 0), (6, None), (8, 7), (None, 1)], "doc_id long, quality int")
    rows = quality_gam.quality_scores(odd_documents, labels).collect()
    assert len(rows) == 12 and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    assert {r["score"] for r in quality_gam.quality_scores(odd_documents, labels.limit(0)).collect()} == {0.5}
    assert quality_gam.quality_scores(odd_documents.limit(0), labels).count() == 0

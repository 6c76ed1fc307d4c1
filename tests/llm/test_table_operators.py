"""Source mix, URL rules and vector search against brute force; registered queries against their SQL; the pipeline."""

import math
import os
import random
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from corpus_cases import DOC, SF, doc
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kpiframe.llm import registry, source_mix, url_rules, vector_topk

TABLES = ("documents", "embeddings", "pages", "labels", "benchmark", "conversations")


# --- source mix -------------------------------------------------------------------------------------


def brute_targets(sizes, share=1.5, most=2):
    """Shares handed out again and again until nobody is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, full, left = {s: 0.0 for s in order}, set(), share * sum(sizes.values())
    while left > 1e-9 and len(full) < len(order):
        whole = sum(weight[s] for s in order if s not in full)
        for s in order:
            if s not in full:
                target[s] += left * weight[s] / whole
        left = 0.0
        for s in order:
            if s not in full and target[s] >= most * sizes[s]:
                left += target[s] - most * sizes[s]
                target[s] = most * sizes[s]
                full.add(s)
    return target


@pytest.mark.parametrize("seed", range(4))
def test_targets_and_taken_words(table, seed):
    rng = random.Random(seed)
    names = ["b", "a", None, "Ä", "z", "hot"]
    rows = [doc(i, " ".join("w" for _ in range(int(rng.expovariate(0.01)))), source=rng.choice(names + ["hot"] * 4)) for i in range(150)]
    rows += [rows[0], doc(None, "one two", source="a"), doc(900, None, source="z"), doc(901, "\t", source="empty")]
    docs = table(rows, DOC)
    lines, targets, plan = source_mix.mix_sources(docs, block=16)
    got = source_mix.taken_words(lines, targets, plan).collect()
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = brute_targets(sizes)
    taken = defaultdict(int)
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len((r[1] or "").split())) for r in rows)
    for r in got:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(taken[s] == math.floor(want[s] + 1e-6) for s in sizes)
    # Every slot holds one block of one source, full but for a source's last.
    pieces = plan.collect()
    words = defaultdict(int)
    for p in pieces:
        words[(p["source"], p["slot"])] += p["to_word"] - p["from_word"]
    short = Counter(s for (s, _), n in words.items() if n < 16)
    assert max(words.values()) == 16 and max(short.values(), default=0) <= 1


def test_schedule_is_even(table):
    docs = table([doc(i, "w " * 200, source=s) for i, s in enumerate("aaaaaabbbbbbcccccc")], DOC)
    _, targets, _ = source_mix.mix_sources(docs, block=8)
    slots = source_mix.schedule(targets, 8).orderBy("slot").collect()
    goal = {r["source"]: r["goal"] for r in targets.collect()}
    seen = Counter()
    for i, s in enumerate(slots, start=1):
        assert s["block"] == seen[s["source"]]
        seen[s["source"]] += 1
        for source, words in goal.items():  # any start of the schedule has nearly the target shares
            assert abs(seen[source] - i * words / sum(goal.values())) < 6


def test_empty_mix_and_reruns(odd_documents):
    assert source_mix.taken_words(*source_mix.mix_sources(odd_documents.limit(0))).count() == 0
    runs = [sorted(map(str, source_mix.taken_words(*source_mix.mix_sources(odd_documents)).drop("place").collect())) for _ in range(2)]
    assert runs[0] == runs[1] and len(runs[0]) == 12
    mixed = source_mix.mixed_documents(odd_documents)
    assert mixed.columns == odd_documents.columns
    check_mix(odd_documents, mixed)


def check_mix(docs, mixed, **settings):
    """Whole texts, as often as they are taken; the last of a source is taken or left, whichever ends nearer to its target."""
    taken = source_mix.taken_words(*source_mix.mix_sources(docs, **settings)).collect()
    uses = Counter()
    for r in taken:
        whole, rest = divmod(r["taken"], r["size"]) if r["size"] else (0, 0)
        uses[(r["doc_id"], r["source"], r["size"])] += whole + (2 * rest >= r["size"] if rest else 0)
    got = mixed.select("doc_id", "source", source_mix.size_of(F.col("text")).alias("size")).collect()
    assert Counter(map(tuple, got)) == Counter({k: n for k, n in uses.items() if n})
    words = defaultdict(int)
    for r in got:
        words[r["source"]] += r["size"]
    for source in {r["source"] for r in taken}:
        mine = [r for r in taken if r["source"] == source]
        assert abs(words[source] - mine[0]["target"]) <= 1 + max(r["size"] for r in mine) / 2


def test_mixed_documents_stand_in_schedule_order(table):
    docs = table([doc(i, "w " * (5 + i % 37), source="abc"[i % 3]) for i in range(300)], DOC)
    _, _, plan = source_mix.mix_sources(docs, block=16)
    first, words = {}, Counter()
    for p in plan.collect():
        use = (p["doc_id"], p["round"])
        first[use] = min(first.get(use, (math.inf,)), (p["slot"], p["round"], p["start"]))
        words[use] += p["to_word"] - p["from_word"]
    mixed = source_mix.mixed_documents(docs, block=16).collect()
    kept = [use for use in sorted(first, key=first.get) if 2 * words[use] >= 5 + use[0] % 37]
    assert [r["doc_id"] for r in mixed] == [i for i, _ in kept]
    goal = Counter(r["source"] for r in mixed)
    seen = Counter()
    for n, r in enumerate(mixed, start=1):  # any start of the mix has nearly the target shares
        seen[r["source"]] += 1
        assert all(abs(seen[s] - n * goal[s] / len(mixed)) < 12 for s in goal)


def test_hot_ids_are_split(table, monkeypatch):
    """Rows of one source with null or one repeated id: one digest, and still no window takes them all."""
    monkeypatch.setattr(source_mix, "RANGE_ROWS", 20)
    monkeypatch.setattr(source_mix, "HOT_RANGE", 40)
    rows = [doc(None, "w " * (1 + i % 9), source="a") for i in range(150)] + [doc(7, "v " * (1 + i % 5), source="a") for i in range(150)]
    rows += [doc(i, "u " * (i % 11), source="b") for i in range(100, 200)]
    docs = table(rows, DOC)
    lines, targets, plan = source_mix.mix_sources(docs, block=16)
    placed = sorted((r["start"], r["size"]) for r in lines.where("source = 'a' AND size > 0").collect())
    assert [s for s, _ in placed] == [sum(n for _, n in placed[:i]) for i in range(len(placed))]  # one line without gaps
    taken = source_mix.taken_words(lines, targets, plan)
    for r in taken.groupBy("source").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).collect():
        assert r["n"] == math.floor(r["t"] + 1e-6)
    again = source_mix.taken_words(*source_mix.mix_sources(docs, block=16))
    assert sorted(map(str, taken.drop("place").collect())) == sorted(map(str, again.drop("place").collect()))


# --- URL rules ------------------------------------------------------------------------------------------


def brute_verdict(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([i for i in map(rest.find, "/?#") if i >= 0], default=len(rest))
        host = rest[:cut].translate({c: c + 32 for c in range(65, 91)})
        path = rest[cut:]
        path = path[: min([i for i in map(path.find, "?#") if i >= 0], default=len(path))]
    best = None
    for h, p, v in rules:
        if h and (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h) + len(p), len(h), v == "block")
            if best is None or rank > best[0]:
                best = (rank, h + p, v)
    return (host, path, None, "allow") if best is None else (host, path, *best[1:])


def test_urls_against_every_rule(spark, table):
    rng = random.Random(9)
    labels = ["org", "com", "a", "b", "ex", "ex-x", "EX", "été", "0"]
    some = lambda: ".".join(rng.choice(labels) for _ in range(rng.randrange(1, 5)))
    path = lambda: "".join("/" + rng.choice(["en", "de", "x1", ""]) for _ in range(rng.randrange(0, 4)))
    rules = list({(some().lower(), path(), rng.choice(["allow", "block"])) for _ in range(80)})
    urls = [f"http{'s' * rng.randrange(2)}://{some()}{path()}{rng.choice(['', '?q=/de/', '#top', ':80'])}" for _ in range(900)]
    urls += [None, "", "none", "://", "x://org", "http://a.org/http://b.com/de/", "mailto:x@org"] + ["http://a.b.ex.org/en/x1"] * 400
    docs = table([(i, u, "x") for i, u in enumerate(urls)] + [(None, "http://org/", "x")], "page_id long, url string, html string")
    got = url_rules.url_verdicts(docs, spark.createDataFrame(rules, url_rules.RULE_SCHEMA), ranges=7).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        url = "http://org/" if r["page_id"] is None else urls[r["page_id"]]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute_verdict(url, rules), url
    assert url_rules.url_verdicts(docs.limit(0)).count() == 0
    none = spark.createDataFrame([], url_rules.RULE_SCHEMA)
    assert {(r["rule"], r["verdict"]) for r in url_rules.url_verdicts(docs, none, default="block").collect()} == {(None, "block")}


# --- vector search ----------------------------------------------------------------------------------------


def test_top_k_against_all_pairs(spark, table):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=6) * rng.choice([0.1, 1, 4])).tolist(), 0) for i in range(900)]
    rows += [(1000 + i, [1.0] * 6, 0) for i in range(300)]  # one hot vector: ties go to smaller ids
    rows += [(2000, None, 0), (2100, [1.0, None, 2.0], 0), (2200, [float("nan")] * 6, 0), (2300, [float("inf")] * 6, 0), (2400, [], 0),
             (2500, [], 0), (2600, [0.5], 0), (None, [9.0] * 6, 0), (100, [2.0] * 6, 0)]
    df = table(rows, "vec_id long, embedding array<double>, label int")
    vectors = df.filter(vector_topk.usable(F.col("embedding"))).select(F.col("vec_id").alias("id"), vector_topk.quantised(F.col("embedding")).alias("v"))
    got = defaultdict(list)
    for r in vector_topk.top_k(vectors, vectors.filter("id % 100 = 0"), k=7, shard_rows=150).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    kept = [(i, np.floor(1024 * np.array(v)).astype(int)) for i, v, _ in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = defaultdict(list)
    for i, q in kept:
        if i % 100 == 0:
            found = sorted((-int(q @ v), j) for j, v in kept if j != i and len(v) == len(q))[:7]
            want[i] += [(rank, j, -minus) for rank, (minus, j) in enumerate(found, start=1)]
    assert {q: sorted(v) for q, v in got.items()} == {q: sorted(v) for q, v in want.items() if v}
    assert vector_topk.top_k(vectors.limit(0), vectors.limit(0)).count() == 0


def test_too_large_components_are_refused(table):
    df = table([(100, [1e300, 1.0], 0), (1, [1.0, 1.0], 0)], "vec_id long, embedding array<double>, label int")
    vectors = df.select(F.col("vec_id").alias("id"), vector_topk.quantised(F.col("embedding")).alias("v"))
    with pytest.raises(PySparkException, match="too large for exact"):
        vector_topk.top_k(vectors, vectors.filter("id % 100 = 0")).collect()


def test_queries_go_to_the_trees_in_blocks(spark, monkeypatch):
    """Whatever the number of query blocks, the trees aren't shuffled."""
    monkeypatch.setattr(vector_topk, "BLOCK", 7)
    rng = np.random.default_rng(1)
    rows = [(i, rng.integers(-99, 99, 4).tolist()) for i in range(300)]
    vectors = spark.createDataFrame(rows, "id long, v array<long>")
    found = vector_topk.top_k(vectors, vectors.filter("id % 10 = 0"), k=3, shard_rows=50)
    want = {(i, rank, j, s) for i, v in rows if i % 10 == 0 for rank, (s, j) in enumerate(
        sorted(((int(np.dot(v, w)), j) for j, w in rows if j != i), key=lambda x: (-x[0], x[1]))[:3], start=1)}
    assert set(map(tuple, found.collect())) == want
    plan = vector_topk._search(vector_topk.build_shards(vectors.withColumn("dim", F.size("v")), 3), [(0, 0, [1, 2, 3, 4])], 3)
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


def test_trees_prune():
    rng = np.random.default_rng(2)
    centres = rng.integers(-4000, 4000, (40, 8))
    rows = centres[rng.integers(0, 40, 6000)] + rng.integers(-50, 50, (6000, 8))
    tree = vector_topk.Tree(np.arange(6000), rows)
    query = centres[3]
    scores = rows @ query
    best = sorted(zip(-scores, range(6000)))[:10]
    assert tree.search(query, -1, 10, None) == [(-minus, i) for minus, i in best]
    # A known kth score may only drop what is below it.
    assert tree.search(query, -1, 10, int(-best[4][0])) == [(-minus, i) for minus, i in best if minus <= best[4][0]]
    tight = vector_topk.Tree.unpack(tree.pack())
    assert tight.search(query, -1, 10, None) == tree.search(query, -1, 10, None)
    for node in range(len(tree.lo)):
        mine = tree.rows[tree.lo[node] : tree.hi[node]]
        assert (mine.min(axis=0) == tree.low[node]).all() and (mine.max(axis=0) == tree.high[node]).all()


# --- registered queries and the pipeline -------------------------------------------------------------------


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_queries_match_their_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("test data not present")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    rel = con.execute(registry.ORACLE[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == sorted(df.columns)
    tidy = lambda row: tuple(round(v, 6) if isinstance(v, float) else v for v in row)
    got = Counter(tidy(r[c] for c in names) for r in df.collect())
    assert got == Counter(tidy(r) for r in rel.fetchall())


def test_pipeline_stages(spark):
    import re

    import corpus_pipeline
    from tokenizers import Tokenizer

    from kpiframe.llm.common import written
    from kpiframe.llm.quality_gam import quality_scores

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "exact_copies", "near_copies", "mix", "encode"]
    kept = [docs]
    for name, stage in corpus_pipeline.STAGES:
        kept.append(written(stage(spark, kept[-1], SF), f"test-{name}"))
    assert all(d.columns == docs.columns for d in kept[:-1])
    ids = [sorted(r["doc_id"] for r in d.collect()) for d in kept]
    assert ids[1] == sorted(r["doc_id"] for r in quality_scores(docs, labels).where("predicted = 1").collect())
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    bare = lambda i: re.sub(r"[\x20\x09-\x0D]", "", texts[i])
    assert len(ids[2]) == len({bare(i) for i in ids[1]}) == len({bare(i) for i in ids[2]})
    from test_text_operators import probability_jaccard, shingled

    shingle_sets = {i: shingled(texts[i]) for i in ids[2]}
    dropped = set(ids[2]) - set(ids[3])
    near = lambda i, j: len(shingle_sets[i].keys() & shingle_sets[j].keys()) and probability_jaccard(shingle_sets[i], shingle_sets[j]) >= 0.8
    assert all(any(near(i, j) for j in ids[2] if j != i) for i in dropped)
    check_mix(kept[3], kept[4])
    whole = kept[4].join(docs.select("doc_id", F.col("text").alias("whole"), F.col("n_chars").alias("chars")), "doc_id")
    assert whole.where("NOT (text <=> whole AND n_chars <=> chars)").isEmpty()
    library = Tokenizer.from_file(__import__("public_tokenizers").path(corpus_pipeline.TOKENIZER))
    want = Counter()
    for r in kept[4].collect():
        want[(r["doc_id"], tuple(library.encode(r["text"], add_special_tokens=False).ids), r["text"])] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["text"]) for r in kept[5].collect()) == want


def test_stages_take_odd_documents(spark, odd_documents):
    import corpus_pipeline
    from kpiframe.llm.common import written

    for start in (odd_documents, odd_documents.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            if name != "quality":  # one document has a label here: nothing to learn, and nothing would be left
                assert stage(spark, start, SF).count() >= 0
        left = corpus_pipeline.quality(spark, start, SF)
        assert left.columns == start.columns and written(left, "test-left").count() <= 12

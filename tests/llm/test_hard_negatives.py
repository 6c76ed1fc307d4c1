"""Hard-negative mining against all pairs."""

import random

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from kpiframe.llm.hard_negatives import CoverTree, hard_negatives, mined_vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def plain(rows):
    """Every row of the result, from all pairs."""
    import math

    taken = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        moved = int(math.fmod(label + 1, 10)) if vec_id % 7 == 0 else label
        taken.append((vec_id, moved, [math.floor(x * 256) for x in vector]))
    out = []
    for i, (anchor, label, q) in enumerate(taken):
        if anchor % 100:
            continue
        others = [
            (-sum(a * b for a, b in zip(q, v)), vec_id, same == label)
            for j, (vec_id, same, v) in enumerate(taken) if j != i and len(v) == len(q)
        ]
        others.sort()
        for ps, positive in [(-s, p) for s, p, same in others if same][:5]:
            found = [(-s, n) for s, n, same in others if not same and 30 * ps <= -100 * s <= 90 * ps][:10]
            out += [(anchor, positive, rank, n, ps, s) for rank, (s, n) in enumerate(found, 1)]
    return sorted(out)


def made(seed, n, dim=6, spread=1.0):
    rng = random.Random(seed)
    middles = [[rng.gauss(0, spread) for _ in range(dim)] for _ in range(8)]
    out = []
    for i in range(n):
        middle = rng.choice(middles)
        out.append((i * 25 % (n * 5), [m + rng.gauss(0, 0.4) for m in middle], rng.choice([0, 1, 2, 9, -3])))
    return out


ODD = [
    (0, [0.5, 0.25], 1), (0, [0.5, 0.25], 1), (100, [], 4), (101, [], 4), (102, [], 5), (200, None, 1), (300, [1.0, None], 1),
    (400, [float("nan"), 1.0], 1), (500, [float("inf"), 1.0], 1), (600, [0.0, 0.0], 2), (601, [0.0, 0.0], 2), (602, [0.0, 1.0], 3),
    (None, [1.0, 1.0], 1), (700, [1.0, 1.0], None), (5, [0.5, 0.25], 2), (6, [0.25, 0.5], 3), (7, [0.5, 0.25], 0), (8, [0.5, 0.2], 1),
    (9, [-0.5, -0.25], 1), (800, [-1.0, 0.5], 8), (801, [1.0, -0.5], 8), (802, [0.3, 0.3], 9), (900, [2.0], 1), (901, [1.0], 7),
]


@pytest.mark.parametrize("rows,shard_rows", [(made(1, 600), 100), (made(2, 500, 3, 0.2), 5000), (ODD, 4), (ODD * 3, 8192), ([(100 * i, [1.0, 0.5], i % 2) for i in range(300)], 64)])
def test_same_as_all_pairs(spark, table, rows, shard_rows):
    vectors = mined_vectors(table(rows, SCHEMA))
    got = sorted(map(tuple, hard_negatives(vectors, F.col("id") % 100 == 0, shard_rows=shard_rows).collect()))
    assert got == plain(rows)


def test_empty_table_and_too_large_components(spark, table):
    assert hard_negatives(mined_vectors(table([], SCHEMA)), F.col("id") % 100 == 0).count() == 0
    with pytest.raises(PySparkException, match="too large for exact"):
        hard_negatives(mined_vectors(table([(100, [1e300], 1), (1, [1.0], 1)], SCHEMA)), F.col("id") % 100 == 0).collect()


def test_covering_radii_and_bounds():
    rng = np.random.default_rng(3)
    rows = (rng.normal(size=(3000, 8)) * 200 + rng.integers(0, 5, (3000, 1)) * 300).astype(np.int64)
    tree = CoverTree.unpack(CoverTree(np.arange(3000), np.arange(3000), rng.integers(0, 3, 3000), rows).pack())
    assert sorted(tree.uids.tolist()) == list(range(3000)) and (tree.kids > 0).any()
    queries = (rng.normal(size=(20, 8)) * 200).astype(np.int64)
    low, high = tree.bounds(queries)
    for node in range(len(tree.lo)):
        products = queries @ tree.rows[tree.lo[node] : tree.hi[node]].T
        assert (products >= low[:, node, None]).all() and (products <= high[:, node, None]).all()
        # Children part the rows of their parent.
        kids = range(tree.kid[node], tree.kid[node] + tree.kids[node])
        if kids:
            assert [tree.lo[node], *(tree.hi[c] for c in kids)] == [*(tree.lo[c] for c in kids), tree.hi[node]]


def test_nodes_are_skipped():
    """Well apart clusters: a descent looks at a small part of the leaves."""
    rng = np.random.default_rng(4)
    rows = (rng.normal(size=(4000, 6)) * 10 + rng.normal(size=(40, 6)).repeat(100, axis=0) * 2000).astype(np.int64)
    tree = CoverTree.unpack(CoverTree(np.arange(4000), np.arange(4000), np.zeros(4000, np.int64), rows).pack())
    seen, scores = [], tree.scores
    tree.scores = lambda q, a, b: seen.append(b - a) or scores(q, a, b)
    query, heap = rows[17], []
    low, high = tree.bounds(query[None, :])
    tree.search(query, 17, 0, True, [(-(2**63), 2**63 - 1, 5, heap)], low[0], high[0])
    assert sum(seen) < 1000
    best = sorted(((int(rows[i] @ query), -i) for i in range(4000) if i != 17), reverse=True)[:5]
    assert sorted(heap, reverse=True) == [(s, i, -i) for s, i in best]

"""Sigma of merged groups against a plain-Python model of the fold semantics."""

import math
import random
import statistics

import pytest

from kpiframe.plans.chart import chart


def model(rows, threshold):
    """rows: (x, fold, actual, expected, weight). Returns {display label: (valid_folds, se)}."""
    groups = {}
    for x, fold, a, e, w in rows:
        g = groups.setdefault(x, {"volume": 0.0, "folds": {}})
        if a is None or e is None or w is None:
            continue
        g["volume"] += w
        f = g["folds"].setdefault(fold, [0.0, 0.0, 0.0])
        f[0] += a
        f[1] += e
        f[2] += w
    order = sorted(groups)
    # stop-at-first-overflow tails
    low, cum = [], 0.0
    for x in order:
        if cum + groups[x]["volume"] <= threshold:
            low.append(x)
            cum += groups[x]["volume"]
        else:
            break
    high, cum = [], 0.0
    for x in reversed(order[len(low):]):
        if cum + groups[x]["volume"] <= threshold:
            high.append(x)
            cum += groups[x]["volume"]
        else:
            break
    members = {}
    for x in order:
        label = "Low tail" if x in low and len(low) > 1 else "High tail" if x in high and len(high) > 1 else str(x)
        members.setdefault(label, []).append(x)
    out = {}
    for label, xs in members.items():
        totals = {}
        for x in xs:
            for fold, (n0, n1, d) in groups[x]["folds"].items():
                if d != 0:  # valid in the member: both KPIs defined
                    t = totals.setdefault(fold, [0.0, 0.0, 0.0])
                    t[0] += n0
                    t[1] += n1
                    t[2] += d
        diffs = [t[0] / t[2] - t[1] / t[2] for t in totals.values() if t[2] != 0]
        se = statistics.stdev(diffs) / math.sqrt(len(diffs)) if len(diffs) >= 2 else None
        out[label] = (len(diffs) or None, se)
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_merged_sigma_matches_model(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for i in range(600):
        x = float(rnd.randint(0, 12))
        a = None if rnd.random() < 0.05 else rnd.uniform(0, 10)
        e = rnd.uniform(0, 10)
        w = rnd.choice([1.0, 2.0, 0.5, -0.5])
        rows.append((i, x, a, e, w))
    df = spark.createDataFrame(rows, "id long, x double, a double, e double, w double")
    threshold = 60.0
    res = chart(df, "x", "a", "e", weight="w", band=1, low_weight=str(threshold), sigma=1, fold_by=["id"])
    got = {r["x"]: (r["valid_folds"], r["sigma_se"]) for r in res.rows.collect()}
    # folds as the operator computes them (md5 of the key text)
    import hashlib

    fold = {i: int(hashlib.md5(str(i).encode()).hexdigest()[:8], 16) % 20 for i, *_ in rows}
    want = model([(x, fold[i], a, e, w) for i, x, a, e, w in rows], threshold)
    assert set(got) == set(want)
    for label, (n, se) in want.items():
        assert got[label][0] == n
        if se is None:
            assert got[label][1] is None
        else:
            assert got[label][1] == pytest.approx(se, rel=1e-9, abs=1e-12)

"""Hard-negative mining with cover trees over norm-augmented candidates.

*Candidates.* Integer vectors are dealt to shards by hash; one task per shard builds a cover tree and writes it to the shared
folder. Every candidate gets one more component, ``sqrt(M - |x|^2)`` with M the shard's largest squared norm, so all have
one length and the inner product with a query (whose own extra component is 0) falls with the distance. A node of level i has a
centre, and every vector below it lies within the covering radius ``top / BASE**i`` of it (the tight radius of the node is
kept); centres of one parent are further apart than that, and what is too sparse for a node of its own stays in a leaf of
its parent. With ``|<q, x> - <q, c>| <= |q| * |x - c|`` the radius bounds all
inner products below a node from both sides.

*Descent.* Anchors are broadcast in blocks of ``BLOCK``; the trees stay where they are, and each task passes what an anchor
has found in one tree on to its next. Nodes are opened best first, by the largest product they allow. A node is skipped if it
holds only labels that don't count, or if for every window of the anchor it lies outside: its largest product is below the
window (or the window's kth score), or its smallest is above. Leaves are verified with exact integer products.

*Rounds.* First each anchor's positives: its best rows of the same label. Then the windows that they set: the best rows of
other labels from 30 % to 90 % of a positive's score. What tasks find is merged per anchor and window by (score, smaller id).

Defined results: rows with a null id, label or vector, or a null or non-finite component take no part; vectors meet only vectors
of their own length; an empty vector scores 0; repeated ids are rows of their own and only the row itself is left out; fewer
rows than asked for give all; a positive's score below 0 has no window; an anchor without positives gives none; an empty
table gives an empty result; other columns are ignored. Components too large for exact 64-bit products are an error that says so.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiframe.llm.common import tidied, usable, whole_numbers, written

POSITIVES = 5
NEGATIVES = 10
#: A negative scores from LOW to HIGH percent of the positive.
LOW, HIGH = 30, 90
SCALE = 256
SHARD_ROWS = 8192
#: Covering radii shrink by this factor from level to level.
BASE = 1.3
LEAF = 64
#: The least rows of a node of its own, and after how many smaller ones the rest of a level is left to one leaf.
DENSE = 32
SPARSE = 24
#: Anchors that are broadcast at once.
BLOCK = 4096


class CoverTree:
    """A cover tree in arrays. Node n covers rows lo[n]:hi[n]; its children are kid[n] to kid[n] + kids[n] - 1 (none: a leaf)."""

    def __init__(self, uids: np.ndarray, ids: np.ndarray, labels: np.ndarray, rows: np.ndarray):
        points = rows.astype(np.float64)
        norms = (points * points).sum(axis=1)
        lifted = np.column_stack([points, np.sqrt(np.maximum(norms.max(initial=0) - norms, 0))])
        order = np.arange(len(ids))
        lo, hi, kid, kids, centre, radius, level = [0], [len(ids)], [0], [0], [0], [0.0], [0]
        if len(ids):
            radius[0] = self._reach(lifted, order, 0)
        top, node = radius[0], 0
        while node < len(lo):
            a, b = lo[node], hi[node]
            if level[node] >= 0 and b - a > LEAF and radius[node] > 0:
                # The next level whose covering radius is below this node's own.
                step = level[node] + 1
                while top / BASE**step >= radius[node]:
                    step += 1
                groups, rest = self._cover(lifted, order[a:b], centre[node], top / BASE**step)
                below = [(point, members, self._reach(lifted, members, point), step) for point, members in groups]
                if groups and len(rest):
                    below.append((centre[node], rest, self._reach(lifted, rest, centre[node]), -1))
                kid[node], kids[node] = len(lo), len(below)
                at = a
                for point, members, reach, of_level in below:
                    order[at : at + len(members)] = members
                    lo.append(at)
                    at += len(members)
                    hi.append(at)
                    kid.append(0)
                    kids.append(0)
                    centre.append(point)
                    radius.append(reach)
                    level.append(of_level)
            node += 1
        self.uids, self.ids, self.labels, self.rows = uids[order], ids[order], labels[order], rows[order]
        self.lo, self.hi, self.kid, self.kids = (np.array(x, np.int64) for x in (lo, hi, kid, kids))
        self.centres = rows[np.array(centre)] if len(ids) else np.zeros((1, rows.shape[1]), np.int64)
        self.radius = np.array(radius)
        # A node of one label only names it.
        low = np.array([self.labels[a:b].min() if b > a else 0 for a, b in zip(lo, hi)], np.int64)
        high = np.array([self.labels[a:b].max() if b > a else 0 for a, b in zip(lo, hi)], np.int64)
        self.low_label, self.high_label = low, high

    @staticmethod
    def _reach(lifted: np.ndarray, members: np.ndarray, centre: int) -> float:
        """The tight covering radius."""
        return float(np.sqrt(((lifted[members] - lifted[centre]) ** 2).sum(axis=1).max()))

    @staticmethod
    def _cover(lifted: np.ndarray, members: np.ndarray, first: int, reach: float):
        """Groups (centre, members within ``reach`` of it; centres lie further apart), and what is too sparse for a group.

        Sparse members stay in one leaf of their parent: a node of a few rows costs more than it can save. After
        ``SPARSE`` sparse centres in a row all that is left counts as sparse.
        """
        groups, sparse, left, point, vain = [], [], members, first, 0
        points, squares = lifted[members], (lifted[members] ** 2).sum(axis=1)
        while len(left) and vain < SPARSE:
            away = squares - 2 * (points @ lifted[point]) + (lifted[point] ** 2).sum()
            near = (away <= reach * reach) | (left == point)
            if near.sum() >= DENSE:
                groups.append((point, left[near]))
                vain = 0
            else:
                sparse.append(left[near])
                vain += 1
            left, points, squares = left[~near], points[~near], squares[~near]
            point = int(left[0]) if len(left) else -1
        return groups, np.concatenate([*sparse, left])

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **vars(self))
        return out.getvalue()

    @classmethod
    def unpack(cls, blob: bytes) -> CoverTree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(blob)) as parts:
            for name in parts.files:
                setattr(tree, name, parts[name])
        # Sums of products below 2**24 are exact as floats, below 2**53 as doubles, and faster than as integers.
        tree.size = float(np.abs(tree.rows).max(initial=0))
        tree.as_kind = {}
        return tree

    def bounds(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Smallest and largest product that each node allows with each query, widened beyond what rounding can take."""
        found = queries.astype(np.float64)
        middle = found @ self.centres.astype(np.float64).T
        size = np.sqrt((found * found).sum(axis=1))[:, None]
        slack = size * self.radius[None, :] * (1 + 1e-9)
        slack += 1e-9 * (1 + np.abs(middle) + size * np.sqrt((self.centres.astype(np.float64) ** 2).sum(axis=1))[None, :])
        return middle - slack, middle + slack

    def scores(self, query: np.ndarray, a: int, b: int) -> np.ndarray:
        most = self.size * float(np.abs(query).max(initial=0)) * max(1, len(query))
        kind = np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64
        if kind not in self.as_kind:
            self.as_kind[kind] = self.rows.astype(kind)
        return (self.as_kind[kind][a:b] @ query.astype(kind)).astype(np.int64)

    def search(self, query: np.ndarray, uid: int, label: int, same: bool, windows: list, low: np.ndarray, high: np.ndarray) -> None:
        """Add to each window's heap. A window is (least, most, k, heap of (score, -id, uid)); ``low`` and ``high``: bounds()."""

        def open_to(node: int) -> bool:
            if same and not self.low_label[node] <= label <= self.high_label[node]:
                return False
            if not same and self.low_label[node] == label == self.high_label[node]:
                return False
            top, bottom = high[node], low[node]
            return any(
                top >= (least if len(heap) < k else max(least, heap[0][0])) and bottom <= most for least, most, k, heap in windows
            )

        if not len(self.ids):
            return
        waiting = [(-high[0], 0)]
        while waiting:
            _, node = heapq.heappop(waiting)
            if not open_to(node):
                continue
            if self.kids[node]:
                for child in range(self.kid[node], self.kid[node] + self.kids[node]):
                    if open_to(child):
                        heapq.heappush(waiting, (-high[child], child))
                continue
            a, b = int(self.lo[node]), int(self.hi[node])
            scores = self.scores(query, a, b)
            counts = (self.labels[a:b] == label) == same
            if same:
                counts &= self.uids[a:b] != uid
            for least, most, k, heap in windows:
                floor = least if len(heap) < k else max(least, heap[0][0])
                found = np.flatnonzero(counts & (scores >= floor) & (scores <= most))
                if len(found) > k:
                    # The k best of the leaf, by score and then id.
                    found = found[scores[found] >= np.partition(scores[found], len(found) - k)[len(found) - k]]
                    found = found[np.lexsort((self.ids[a + found], -scores[found]))[:k]]
                for place in found.tolist():
                    item = (int(scores[place]), -int(self.ids[a + place]), int(self.uids[a + place]))
                    if len(heap) < k:
                        heapq.heappush(heap, item)
                    elif item > heap[0]:
                        heapq.heapreplace(heap, item)


def _matrix(column) -> np.ndarray:
    """A column of equally long lists as a matrix of integers."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(lists):
        return np.zeros((0, 0), np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1)


def build_trees(rows: DataFrame, shards: int) -> DataFrame:
    """dim, tree: one cover tree per shard and vector length."""

    def build(key, table):
        columns = [table[c].to_numpy() for c in ("uid", "id", "label")]
        tree = CoverTree(*columns, _matrix(table["v"]))
        return pa.table({"dim": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([tree.pack()], pa.binary())})

    shard = F.pmod(F.xxhash64("uid"), F.lit(shards)).cast("int").alias("shard")
    dealt = rows.select("uid", "id", "label", "v", "dim").groupBy(shard, "dim")
    return written(dealt.applyInArrow(build, "dim int, tree binary"), "cover-trees")


_FOUND = "anchor long, positive long, uid long, id long, score long"
_FOUND_NAMES = ("anchor", "positive", "uid", "id", "score")


def _descend(trees: DataFrame, anchors: list, same: bool) -> DataFrame:
    """What the tasks find for (uid, label, vector, [(positive, least, most, k)]); at most k rows a task and window."""
    shipped = trees.sparkSession.sparkContext.broadcast(anchors)

    @tidied
    def run(batches):
        wanted = shipped.value
        heaps = [[[] for _ in windows] for *_, windows in wanted]
        by_dim: dict[int, list[int]] = {}
        for i, (_, _, vector, _) in enumerate(wanted):
            by_dim.setdefault(len(vector), []).append(i)
        vectors = {dim: np.array([wanted[i][2] for i in of], np.int64).reshape(len(of), dim) for dim, of in by_dim.items()}
        for batch in batches:
            for dim, blob in zip(batch.column("dim").to_pylist(), batch.column("tree")):
                of = by_dim.get(dim)
                if not of:
                    continue
                tree = CoverTree.unpack(blob.as_py())
                for at in range(0, len(of), 256):
                    queries = vectors[dim][at : at + 256]
                    low, high = tree.bounds(queries)
                    for j, i in enumerate(of[at : at + 256]):
                        uid, label, _, windows = wanted[i]
                        held = [(least, most, k, heap) for (_, least, most, k), heap in zip(windows, heaps[i])]
                        tree.search(queries[j], uid, label, same, held, low[j], high[j])
        for start in range(0, len(wanted), 512):
            out = [
                (wanted[i][0], window[0], uid, -minus, score)
                for i in range(start, min(start + 512, len(wanted)))
                for window, heap in zip(wanted[i][3], heaps[i])
                for score, minus, uid in heap
            ]
            columns = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], list(_FOUND_NAMES))

    return trees.select("dim", "tree").mapInArrow(run, _FOUND)


def _best(found: DataFrame, k: int, *key: str) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), "id", "uid")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _all_blocks(anchors: DataFrame, count: int, columns: list[str]):
    """The anchors in blocks of about ``BLOCK`` rows, each of a size that may be broadcast."""
    blocks = max(1, -(-count // BLOCK))
    for block in range(blocks):
        yield anchors.filter(F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block).select(*columns).collect()


def hard_negatives(
    vectors: DataFrame, anchors: Column, *, positives: int = POSITIVES, negatives: int = NEGATIVES, shard_rows: int = SHARD_ROWS
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for ``vectors`` (id, label, v: integers).

    ``anchors`` says of which rows negatives are mined.
    """
    spark = vectors.sparkSession
    rows = vectors.filter("id IS NOT NULL AND label IS NOT NULL AND v IS NOT NULL").select(
        F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), "v", F.size("v").alias("dim"),
        F.coalesce(anchors, F.lit(False)).alias("anchor"), F.monotonically_increasing_id().alias("uid"),
    )
    rows = written(rows, "mining-vectors")
    trees = build_trees(rows, max(1, -(-rows.count() // shard_rows)))
    chosen = rows.filter("anchor").drop("anchor")
    count = chosen.count()
    least = -(2**63)

    found = []
    for block in _all_blocks(chosen, count, ["uid", "label", "v"]):
        wanted = [(r["uid"], r["label"], r["v"], [(0, least, 2**63 - 1, positives)]) for r in block]
        found.append(written(_descend(trees, wanted, True), "mining-positives"))
    best = written(
        _best(_union(found), positives, "anchor").select(
            F.col("anchor").alias("uid"), F.col("uid").alias("positive"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")
        ),
        "mining-positives",
    )
    # Windows reach from LOW to HIGH percent, in whole numbers; a score below 0 has none.
    windows = best.filter("positive_score >= 0").select("uid", "positive", F.col("positive_score").alias("s"))
    listed = windows.groupBy("uid").agg(F.collect_list(F.struct("positive", "s")).alias("windows"))  # a few each
    found = []
    for block in _all_blocks(chosen.join(listed, "uid"), count, ["uid", "label", "v", "windows"]):
        wanted = [
            (r["uid"], r["label"], r["v"], [(w["positive"], -(-w["s"] * LOW // 100), w["s"] * HIGH // 100, negatives) for w in r["windows"]])
            for r in block
        ]
        found.append(written(_descend(trees, wanted, False), "mining-negatives"))
    mined = _best(_union(found), negatives, "anchor", "positive").select(
        F.col("anchor").alias("uid"), "positive", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")
    )
    named = chosen.select("uid", F.col("id").alias("anchor_id"))
    return mined.join(best, ["uid", "positive"]).join(named, "uid").select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def mined_vectors(embeddings: DataFrame) -> DataFrame:
    """id, label and v of the rows of ``embeddings`` that take part, labels of ids divisible by 7 first moved on by one."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & usable(F.col("embedding"))
    return embeddings.filter(fine).select(
        F.col("vec_id").alias("id"), moved.alias("label"), whole_numbers(F.col("embedding"), SCALE).alias("v")
    )


ORACLE = r"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE))::DOUBLE[] AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND label IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
), pairs AS (
  SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid AS b, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.rid <> b.rid AND len(a.q) = len(b.q) WHERE a.vec_id % 100 = 0
), positives AS (
  SELECT * FROM pairs WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, id, b) <= 5
)
SELECT p.anchor_id AS anchor_id, p.id AS positive_id,
  row_number() OVER (PARTITION BY p.a, p.b ORDER BY n.score DESC, n.id, n.b)::INT AS rank,
  n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN pairs n ON p.a = n.a AND NOT n.same AND 30 * p.score <= 100 * n.score AND 100 * n.score <= 90 * p.score
QUALIFY rank <= 10
"""

"""Exact top-k inner-product search with KD-trees per shard.

*Shards.* Vectors are dealt to shards by a hash of their id; a shard holds about ``SHARD_ROWS`` vectors. One task per
shard builds a KD-tree over its integer vectors: each node is split at the median of its widest dimension and keeps
the tight bounding box of its vectors and their smallest id. Trees are written to the shared folder.
*Queries* are sent to the trees in blocks of ``BLOCK``, as broadcasts of a bounded size; the trees stay where they are, and
are read once for each block. A task searches its trees one after another and passes every query's kth score on from tree
to tree: the propagated bound with which the next best-first traversal starts. A node is opened in order of the largest
inner product that its box allows with the query, and the traversal ends when that is below the kth score (equal and a
smaller id possible: it goes on).
*Merge.* The k best of each task are merged per query by (score, smaller id).

Defined results: vectors that are null, or hold null, NaN or infinite components, take no part; vectors meet
only vectors of their own length; an empty vector scores 0 with empty vectors; rows with a null id take no part; repeated
ids are candidates of their own, but a row is never its own query's candidate (a row with the query's id isn't
one); fewer candidates than k give all; an empty table gives an empty result; other columns are ignored.
Scores are exact; components too large for 64-bit products are an error that says so.
"""

from __future__ import annotations

import heapq
import io

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kpiframe.llm.common import tidied, usable, whole_numbers, written

K = 10
SCALE = 1024
SHARD_ROWS = 8192
LEAF = 64
#: Queries that are broadcast at once.
BLOCK = 4096


def quantised(vector: Column, scale: int = SCALE) -> Column:
    return whole_numbers(vector, scale)


class Tree:
    """A KD-tree in arrays: node n covers rows lo[n]:hi[n]; kids are kid[n] and kid[n] + 1 (0: a leaf)."""

    def __init__(self, ids: np.ndarray, rows: np.ndarray):
        order = np.arange(len(ids))
        lo, hi, kid, low, high, least = [0], [len(ids)], [0], [], [], []
        node = 0
        while node < len(lo):
            a, b = lo[node], hi[node]
            mine = rows[order[a:b]]
            low.append(mine.min(axis=0))
            high.append(mine.max(axis=0))
            least.append(ids[order[a:b]].min())
            if b - a > LEAF and mine.shape[1] and (high[-1] > low[-1]).any():
                wide = int(np.argmax(high[-1] - low[-1]))
                mid = (b - a) // 2
                order[a:b] = order[a:b][np.argpartition(mine[:, wide], mid)]
                kid[node] = len(lo)
                lo += [a, a + mid]
                hi += [a + mid, b]
                kid += [0, 0]
            node += 1
        self.ids, self.rows = ids[order], rows[order]
        self.lo, self.hi, self.kid = (np.array(x, np.int64) for x in (lo, hi, kid))
        self.low, self.high, self.least = np.array(low), np.array(high), np.array(least)

    def pack(self) -> bytes:
        out = io.BytesIO()
        np.savez_compressed(out, **vars(self))
        return out.getvalue()

    @classmethod
    def unpack(cls, blob: bytes) -> Tree:
        tree = cls.__new__(cls)
        with np.load(io.BytesIO(blob)) as parts:
            for name in parts.files:
                setattr(tree, name, parts[name])
        return tree

    def search(self, query: np.ndarray, own: int, k: int, kth: int | None, found: list | None = None) -> list[tuple[int, int]]:
        """The k best (score, id), best first, among those that score at least ``kth`` and the heap ``found`` (added to)."""
        best = [] if found is None else found  # a heap: the worst of the k best on top, as (score, -id)
        if not len(self.ids):
            return []
        positive = query > 0

        def bounds(nodes):
            return np.where(positive, self.high[nodes], self.low[nodes]) @ query

        heap = [(-int(bounds([0])[0]), int(self.least[0]), 0)]
        while heap:
            bound, least, node = heapq.heappop(heap)
            bound = -bound
            if kth is not None and bound < kth:
                break
            if len(best) == k and (bound, -least) <= best[0]:
                if bound < best[0][0]:
                    break
                continue
            first = int(self.kid[node])
            if first:
                for child, top in zip((first, first + 1), bounds([first, first + 1])):
                    heapq.heappush(heap, (-int(top), int(self.least[child]), child))
                continue
            a, b = int(self.lo[node]), int(self.hi[node])
            scores = self.rows[a:b] @ query
            floor = max([x for x in (kth, best[0][0] if len(best) == k else None) if x is not None], default=None)
            places = np.arange(a, b) if floor is None else a + np.flatnonzero(scores >= floor)
            for place in places.tolist():
                item = (int(scores[place - a]), -int(self.ids[place]))
                if item[1] == -own:
                    continue  # a query's own id
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)
        return [(score, -minus) for score, minus in sorted(best, reverse=True)]


def _numbers(column) -> np.ndarray:
    """A column of equally long lists as a matrix of integers."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(lists), -1) if len(lists) else np.zeros((0, 0), np.int64)


def build_shards(vectors: DataFrame, shards: int) -> DataFrame:
    """shard, dim, tree: the KD-trees of (id, dim, v), one for each shard and vector length."""

    def build(key, table):
        tree = Tree(table["id"].to_numpy(), _numbers(table["v"]))
        return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "dim": pa.array([key[1].as_py()], pa.int32()), "tree": pa.array([tree.pack()], pa.binary())})

    dealt = vectors.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards)).cast("int"))
    return written(
        dealt.groupBy("shard", "dim").applyInArrow(build, "shard int, dim int, tree binary"), "topk-trees"
    )


_FOUND = "q long, query_id long, vec_id long, score long"


def _search(trees: DataFrame, queries: list, k: int) -> DataFrame:
    """What the tasks find for a block of queries (q, id, v); at most k rows per query and task."""
    shipped = trees.sparkSession.sparkContext.broadcast(queries)

    @tidied
    def run(batches):
        wanted = [(q, own, np.array(v, np.int64)) for q, own, v in shipped.value]
        heaps: list[list] = [[] for _ in wanted]
        for batch in batches:
            for dim, blob in zip(batch.column("dim").to_pylist(), batch.column("tree")):
                tree = Tree.unpack(blob.as_py())
                for (_, own, vector), heap in zip(wanted, heaps):
                    if len(vector) == dim:
                        tree.search(vector, own, k, None, heap)
        for at in range(0, len(wanted), 512):
            out = [
                (q, own, -minus, score)
                for (q, own, _), heap in zip(wanted[at : at + 512], heaps[at : at + 512])
                for score, minus in heap
            ]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["q", "query_id", "vec_id", "score"])

    return trees.select("dim", "tree").mapInArrow(run, _FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, *, k: int = K, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query's ``k`` largest inner products among ``vectors``.

    Both have id (long) and v (array of long). A query row meets every vector whose id isn't its own.
    """
    sized = lambda df: df.filter("id is not null").select("id", "v", F.size("v").alias("dim"))
    vectors = written(sized(vectors), "topk-vectors")
    queries = written(sized(queries).withColumn("q", F.monotonically_increasing_id()), "topk-queries")
    trees = build_shards(vectors, max(1, -(-vectors.count() // shard_rows)))
    blocks = max(1, -(-queries.count() // BLOCK))
    found = None
    for block in range(blocks):
        # About BLOCK rows.
        some = queries.filter(F.pmod(F.xxhash64("q"), F.lit(blocks)) == block).select("q", "id", "v").collect()
        part = written(_search(trees, [tuple(r) for r in some], k), "topk-found")
        found = part if found is None else found.unionByName(part)
    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ORACLE = r"""
WITH v AS (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)
)
SELECT a.vec_id AS query_id,
  row_number() OVER (PARTITION BY a.rid ORDER BY list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[]) DESC, b.vec_id)::INT AS rank,
  b.vec_id AS vec_id, list_inner_product(a.q::DOUBLE[], b.q::DOUBLE[])::BIGINT AS score
FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
WHERE a.vec_id % 100 = 0
QUALIFY rank <= 10
"""

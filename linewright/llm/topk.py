"""Exact top-k by inner product: the threshold algorithm over sorted lists.

Candidates lie in blocks; a block has one list for each dimension, sorted by
component, read from the top for positive query components and from the bottom
for negative ones. A query reads all lists to the same depth, scores what it
meets for the first time, and stops once the sum of the products at that depth
(the most that anything unseen can reach) is below its kth best score. Queries,
a twentieth of the rows, are packed and sent to every block; the best of the
blocks are merged by rank.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

QUERY_BLOCK = 256
CANDIDATE_BLOCK = 8192
#: Depth of the first round; each later round doubles it.
FIRST_DEPTH = 128


def usable(vector: str) -> Column:
    """Not null, not empty, and all components finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & (F.size(vector) > 0) & ~bad


class Lists:
    """A block of candidates with its sorted lists; ties are in order of id."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        by = np.argsort(ids, kind="stable")
        self.ids, exact = ids[by], vectors[by]
        self.exact = exact
        self.largest = float(np.abs(exact).max(initial=0))
        self.cast: dict[type, np.ndarray] = {}
        # [direction, dimension, depth]: 0 falls from the largest component, 1 rises from the smallest.
        self.order = np.stack([np.argsort(-exact, axis=0, kind="stable").T, np.argsort(exact, axis=0, kind="stable").T]).astype(np.int32)
        self.values = np.take_along_axis(np.stack([exact.T, exact.T]), self.order.astype(np.int64), axis=2)

    def typed(self, query: np.ndarray) -> np.ndarray:
        """The rows in the narrowest type in which every product with ``query``, and the query itself, is exact."""
        most = float(np.abs(query).max(initial=0))
        largest = max(self.largest * most * len(query), self.largest, most)
        kind = np.float32 if largest < 1 << 24 else np.float64 if largest < 1 << 53 else np.int64
        if kind not in self.cast:
            self.cast[kind] = self.exact.astype(kind)
        return self.cast[kind]

    def search(self, query: np.ndarray, own: int, k: int, best: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """The k best (scores, ids) of ``best`` and this block."""
        scores, ids = best
        dims = np.flatnonzero(query)
        size = len(self.ids)
        if not len(dims):
            new = self.ids[self.ids != own][:k]
            return _top(np.concatenate([scores, np.zeros(len(new), np.int64)]), np.concatenate([ids, new]), k)
        side = (query[dims] < 0).astype(np.int64)
        vectors = self.typed(query)
        typed = query.astype(vectors.dtype)
        seen = np.zeros(size, bool)
        low, depth = 0, FIRST_DEPTH
        while low < size:
            high = min(depth, size)
            fresh = np.zeros(size, bool)
            fresh[self.order[side, dims, low:high].ravel()] = True
            fresh &= ~seen
            seen |= fresh
            met = np.flatnonzero(fresh)
            got = (vectors[met] @ typed if len(met) * 3 < size else (vectors @ typed)[met]).astype(np.int64)
            worth = self.ids[met] != own
            if len(scores) == k:
                worth &= got >= scores[-1]
            scores, ids = _top(np.concatenate([scores, got[worth]]), np.concatenate([ids, self.ids[met[worth]]]), k)
            bound = int(self.values[side, dims, high - 1] @ query[dims])
            if seen.all() or len(scores) == k and bound < scores[-1]:
                break
            low, depth = high, depth * 2
        return scores, ids


def _top(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    if len(scores) > 4 * k:
        edge = -np.partition(-scores, k - 1)[k - 1]
        scores, ids = scores[scores >= edge], ids[scores >= edge]
    by = np.lexsort((ids, -scores))[:k]
    return scores[by], ids[by]


def top_products(vectors: DataFrame, *, id_column: str = "vec_id", vector: str = "embedding", scale: float = 64.0, every: int = 20, k: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` best of all other rows for each row whose id is divisible by ``every``.

    Components count as floor(scale * x). Ties go to the smaller id. Rows without
    an id, and vectors that are null, empty or hold a component that is null or
    not finite, take no part. Only vectors of equal length are compared. Rows with
    the query's id are its own; of rows that repeat an id each counts. An empty
    table gives no rows.
    """
    whole = vectors.where(F.col(id_column).isNotNull() & usable(vector)).select(
        F.col(id_column).cast("long").alias("id"), F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double"))).alias("v")
    )
    whole = whole.withColumn("size", F.size("v"))
    count = whole.count()
    blocks = max(1, math.ceil(count / CANDIDATE_BLOCK))
    parts = max(1, math.ceil(count / every / QUERY_BLOCK))
    packed = [F.transform("rows", lambda r: r["id"]), F.flatten(F.transform("rows", lambda r: r["v"]))]

    def pack(rows: DataFrame, by: str, ids: str, values: str) -> DataFrame:
        groups = rows.groupBy("size", by).agg(F.collect_list(F.struct("id", "v")).alias("rows"))
        return groups.select("size", by, packed[0].alias(ids), packed[1].alias(values))

    asked = pack(whole.where(F.col("id") % every == 0).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int")), "part", "q_ids", "q_values")
    asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    given = pack(whole.withColumn("block", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(blocks)).cast("int")), "block", "ids", "values")
    schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple = (None, None)
        for batch in batches:
            for i in range(batch.num_rows):
                size, block = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                q_ids, q_values, ids, values = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in range(2, 6))
                if held[0] != (size, block):
                    held = (size, block), Lists(ids, values.reshape(-1, size))
                nothing = np.zeros(0, np.int64), np.zeros(0, np.int64)
                found = [held[1].search(q, int(own), k, nothing) for own, q in zip(q_ids, q_values.reshape(-1, size))]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(q_ids, [len(f[0]) for f in found])), pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[0] for f in found]))], schema=schema
                )

    found = given.join(asked, ["size", "block"]).select("size", "block", "q_ids", "q_values", "ids", "values").mapInArrow(walk, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

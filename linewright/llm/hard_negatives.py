"""Hard negatives by exact inner products in a residue number system.

Components become whole numbers. Anchors and candidates lie in blocks of equal
vector length; for a pair of blocks the component matrices are multiplied once
for every prime, as float32 matrices of residues between -p/2 and p/2, so small
that no sum leaves the 24 bits in which float32 counts exactly. The residues of a
score modulo the primes give the signed score itself by mixed-radix Chinese
remaindering; the primes are as many as the largest possible score of the two
blocks needs. The best rows of every pair of blocks are merged by windows: first
an anchor's positives among the rows of its label, then, for every positive, the
best rows of other labels inside its score range.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.common import stored

ANCHOR_BLOCK = 256
#: Components of a block of candidates: 8,192 rows of 64.
BLOCK_COMPONENTS = 1 << 19
#: Primes from here downwards; residues reach 510, so 64 products stay below 2**24.
LARGEST_PRIME = 1021
#: Scores outside a signed 64-bit integer end the job.
WIDEST = float(1 << 63)


def primes_down(largest: int) -> Iterator[int]:
    for n in range(largest, 2, -1):
        if all(n % d for d in range(2, math.isqrt(n) + 1)):
            yield n


def base_for(bound: float) -> list[int]:
    """The fewest primes whose product exceeds twice ``bound``."""
    need, product, base = 2 * math.ceil(bound) + 1, 1, []
    for p in primes_down(LARGEST_PRIME):
        if product > need:
            break
        base.append(p)
        product *= p
    return base


def residues(values: np.ndarray, prime: int) -> np.ndarray:
    """Whole numbers held as doubles, as residues between -p/2 and p/2, in float32."""
    rest = np.fmod(values, prime)
    half = prime // 2
    return (rest - prime * (rest > half) + prime * (rest < -half)).astype(np.float32)


def centred(values: np.ndarray, prime: int) -> np.ndarray:
    rest = values % prime
    return np.where(rest > prime // 2, rest - prime, rest)


def residue_product(left: np.ndarray, right: np.ndarray, prime: int) -> np.ndarray:
    """left @ right.T modulo ``prime``: float32 products over as many components as stay exact at once."""
    width = max(1, ((1 << 24) - 1) // (prime // 2) ** 2)
    total = np.zeros((len(left), len(right)), np.int32)
    for low in range(0, left.shape[1], width):
        part = left[:, low : low + width] @ right[:, low : low + width].T
        total = (total + part.astype(np.int32)) % prime
    return total


def reconstructed(rests: list[np.ndarray], base: list[int]) -> np.ndarray:
    """The signed numbers with these residues: centred mixed-radix digits, smallest prime power first."""
    digits: list[np.ndarray] = []
    for i, prime in enumerate(base):
        digit, place = rests[i], 1
        for j in range(i):
            digit = digit - digits[j] * (place % prime)
            place *= base[j]
        digits.append(centred(centred(digit, prime) * pow(place, -1, prime), prime))
    total, place = np.zeros(digits[0].shape, np.int64), 1
    for digit, prime in zip(digits, base):
        # Wraps modulo 2**64, which leaves every score of 64 bits as it is.
        total = total + digit * np.uint64(place % (1 << 64)).astype(np.int64)
        place *= prime
    return total


class Block:
    """Rows of one vector length; residues are made once for every prime."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray) -> None:
        self.ids, self.labels, self.vectors = ids, labels, vectors
        self.largest = float(np.abs(vectors).max(initial=0))
        self.norm = float(np.sqrt((vectors**2).sum(axis=1)).max(initial=0))
        self.kept: dict[int, np.ndarray] = {}

    def rest(self, prime: int) -> np.ndarray:
        if prime not in self.kept:
            self.kept[prime] = residues(self.vectors, prime)
        return self.kept[prime]


def exact_scores(a: Block, b: Block, rows: np.ndarray | slice = slice(None), others: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Inner products of rows of ``a`` with rows of ``b``, exact as 64-bit integers."""
    size = a.vectors.shape[1]
    bound = min(a.largest * b.largest * size, a.norm * b.norm * (1 + 1e-9) + 1) if size else 0.0
    if bound >= WIDEST:
        rough = float(np.abs(a.vectors[rows] @ b.vectors[others].T).max(initial=0))
        if not rough < WIDEST * (1 - 1e-6):
            raise OverflowError("an inner product does not fit in a signed 64-bit integer")
        bound = WIDEST
    base = base_for(bound)
    return reconstructed([residue_product(a.rest(p)[rows], b.rest(p)[others], p) for p in base], base)


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` first by falling score, then rising id."""
    at = np.arange(len(scores))
    if len(scores) > 4 * k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
    return at[np.lexsort((ids[at], -scores[at]))[:k]]


def usable(label: str, vector: str) -> Column:
    """A label, and a vector without null or non-finite components."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(label).isNotNull() & F.col(vector).isNotNull() & ~bad


def _matrix(values: pa.ListScalar, size: int, rows: int) -> np.ndarray:
    return values.values.to_numpy(zero_copy_only=False).astype(np.float64).reshape(rows, size)


def _blocks(rows: DataFrame, by: str, parts: Column, names: list[str]) -> DataFrame:
    """One row per (size, ``by``) with the columns ``names`` and the vectors in equal order."""
    dealt = rows.withColumn(by, F.pmod(F.xxhash64("id", F.lit(by)), parts).cast("int"))
    packed = dealt.groupBy("size", by).agg(F.collect_list(F.struct(*names, "v")).alias("rows"))

    def column(name: str) -> Column:
        return F.transform("rows", lambda r: r[name])

    return packed.select("size", by, *[column(n).alias(f"{by}_{n}") for n in names], F.flatten(column("v")).alias(f"{by}_v"))


def hard_negatives(
    vectors: DataFrame,
    *,
    id_column: str = "vec_id",
    vector: str = "embedding",
    label: str = "label",
    scale: float = 256.0,
    every: int = 100,
    positives: int = 5,
    negatives: int = 10,
    least: int = 30,
    most: int = 90,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components count as floor(scale * x). Anchors are the rows whose id is divisible
    by ``every``; an anchor's positives are the first ``positives`` other rows of its
    label by falling score, ties to the smaller id; a positive's negatives are the
    first ``negatives`` rows of another label with least% to most% of its score
    (both ends included).

    Rows without an id or label, and vectors that are null or hold a component that
    is null or not finite, take no part. Only vectors of equal length meet; empty
    ones meet with score 0. Rows equal in id, label and vector count once; rows that
    share an id only are rows of their own, none of them another's positive or
    negative. An empty table gives no rows. A score beyond a signed 64-bit integer,
    or within a millionth of its ends, ends the job.
    """
    whole = vectors.where(F.col(id_column).isNotNull() & usable(label, vector)).select(
        F.col(id_column).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.transform(vector, lambda x: F.lit(scale) * x.cast("double")).alias("v")
    )
    whole = whole.withColumn("size", F.size("v")).withColumn("key", F.xxhash64("label", "v"))
    sizes = whole.agg(F.count("*").alias("n"), F.sum(F.greatest("size", F.lit(1))).alias("components")).first()
    blocks = max(1, math.ceil((sizes["components"] or 0) / BLOCK_COMPONENTS))
    packs = max(1, math.ceil(sizes["n"] / every / ANCHOR_BLOCK))
    candidates = _blocks(whole, "block", F.lit(blocks), ["id", "key", "label"])
    asked = _blocks(whole.where(F.col("id") % every == 0), "pack", F.lit(packs), ["id", "key", "label"])
    spread = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    def held(batch: pa.RecordBatch, i: int, at: int, cache: dict) -> Block:
        """The block in columns ``at`` and on (size, number, ids, keys, labels, vectors), the last one kept; equal rows once."""
        size, number = batch.column(0)[i].as_py(), batch.column(at)[i].as_py()
        if cache.get("of") != (size, number):
            ids, keys, labels = (batch.column(at + c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2, 3))
            once = np.unique(np.stack([ids, keys]), axis=1, return_index=True)[1]
            cache["of"] = size, number
            cache["block"] = Block(ids[once], labels[once], np.floor(_matrix(batch.column(at + 4)[i], size, len(ids))[once]))
            cache["keys"], cache["once"] = keys[once], once
        return cache["block"]

    def nearest_of_label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right: dict = {}
        left: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                b, a = held(batch, i, 1, right), held(batch, i, 6, left)
                out: list[tuple] = []
                for value in np.unique(a.labels):
                    rows, others = np.flatnonzero(a.labels == value), np.flatnonzero(b.labels == value)
                    if not len(others):
                        continue
                    for r, scores in zip(rows, exact_scores(a, b, rows, others)):
                        own = b.ids[others] != a.ids[r]
                        at, got = others[own], scores[own]
                        top = best(got, b.ids[at], positives)
                        out.append((np.repeat(a.ids[r], len(top)), np.repeat(left["keys"][r], len(top)), b.ids[at[top]], right["keys"][at[top]], got[top]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["anchor_id", "anchor_key", "positive_id", "positive_key", "score"])

    # Packs are copied to every block: never by a broadcast, whose size Spark would judge before the copies are made.
    both = candidates.join(asked.withColumn("block", spread).hint("merge"), ["size", "block"])
    columns = ["size", *[f"{s}{c}" for s in ("block", "pack") for c in ("", "_id", "_key", "_label", "_v")]]
    found = both.select(*columns).mapInArrow(nearest_of_label, "anchor_id long, anchor_key long, positive_id long, positive_key long, score long")
    order = Window.partitionBy("anchor_id", "anchor_key").orderBy(F.col("score").desc(), "positive_id", "positive_key")
    chosen = stored(found.withColumn("nth", F.row_number().over(order)).where(F.col("nth") <= positives), "positives")

    # An anchor's positives travel with it: place by place, null where it has fewer.
    by_anchor = chosen.groupBy("anchor_id", "anchor_key").agg(F.array_sort(F.collect_list(F.struct("nth", "positive_id", "score"))).alias("of"))
    kept = whole.where(F.col("id") % every == 0).join(by_anchor, (F.col("id") == F.col("anchor_id")) & (F.col("key") == F.col("anchor_key")))
    kept = kept.withColumn("ids", F.transform("of", lambda p: p["positive_id"])).withColumn("scores", F.transform("of", lambda p: p["score"]))
    sought = _blocks(kept.select("id", "key", "label", "v", "size", "ids", "scores"), "pack", F.lit(packs), ["id", "key", "label", "ids", "scores"])

    def in_range(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right: dict = {}
        left: dict = {}
        for batch in batches:
            for i in range(batch.num_rows):
                b, a = held(batch, i, 1, right), held(batch, i, 6, left)
                owned = [(batch.column(11)[i].values[int(o)].values.to_numpy(), batch.column(12)[i].values[int(o)].values.to_numpy()) for o in left["once"]]
                out: list[tuple] = []
                scores = exact_scores(a, b)
                for r, (ids, worth) in enumerate(owned):
                    other = np.flatnonzero((b.labels != a.labels[r]) & (b.ids != a.ids[r]))
                    got = scores[r, other]
                    for n, (positive, score) in enumerate(zip(ids.tolist(), worth.tolist())):
                        # Whole numbers s with least * score <= 100 * s <= most * score.
                        fits = np.flatnonzero((got >= -(-least * score // 100)) & (got <= most * score // 100))
                        top = other[fits[best(got[fits], b.ids[other[fits]], negatives)]]
                        size = len(top)
                        out.append((np.repeat(a.ids[r], size), np.repeat(left["keys"][r], size), np.full(size, n + 1), np.repeat(positive, size), np.repeat(score, size), b.ids[top], right["keys"][top], scores[r, top]))
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in zip(*out)], names=NEGATIVES)

    both = candidates.join(sought.withColumn("block", spread).hint("merge"), ["size", "block"])
    found = both.select(*columns, "pack_ids", "pack_scores").mapInArrow(in_range, ", ".join(f"{c} long" for c in NEGATIVES))
    order = Window.partitionBy("anchor_id", "anchor_key", "nth").orderBy(F.col("negative_score").desc(), "negative_id", "negative_key")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


NEGATIVES = ["anchor_id", "anchor_key", "nth", "positive_id", "positive_score", "negative_id", "negative_key", "negative_score"]

"""SimHash near-duplicates: a self-join of the binary trie of the fingerprints.

Fingerprints of equal value are one node of the work, whatever the number of
their documents. The join walks pairs of trie nodes together, one bit a level,
adds up the bits in which they differ and drops a pair of nodes once it is over
the budget. Two tries are walked: of at most four differing bits either at most
two lie in the upper half, or at most one lies in the lower half, so one trie
starts with the upper half and a budget of two for it, the other with the lower
half and a budget of one. Spark deals the pairs of subtries with admissible
prefixes to tasks; every task returns a spanning forest of the links it found
(never all pairs of a dense group), and the forests are joined to components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.common import byte_views, free_name, stored, text_key, text_of
from linewright.llm.components import components

SEED = 42
BITS = 64
HALF = 32
#: Fingerprints in a subtrie that one task may hold; longer prefixes are dealt beyond it.
NODES_PER_SUBTRIE = 50_000
LEAST_PREFIX = 6
#: Pairs of nodes walked at once.
FRONT = 400_000


def fingerprint(text: bytes, shingle: int = 4) -> int:
    """64 bits; a bit is set if it is in more than half of the shingles' hashes. No words: 0."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends, at = [], -1
    for w in words:
        at += len(w) + 1
        ends.append(at)
    starts = [0, *(e + 1 for e in ends[: n - shingle])]
    digest = xxhash.xxh64_intdigest
    votes = np.zeros(BITS, np.int64)
    for low in range(0, len(starts), 65_536):
        hashes = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[low : low + 65_536], ends[low + shingle - 1 :])], "<u8")
        votes += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(votes * 2 > len(starts), bitorder="little")
    return int(bits.view("<u8")[0])


def with_fingerprint(docs: DataFrame, text: str, keep: list[str], shingle: int = 4) -> DataFrame:
    """``keep`` columns and ``fp``, the fingerprint as a signed long."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            values = [fingerprint(bytes(view), shingle) for view in byte_views(part.column(part.num_columns - 1))]
            fps = pa.array(np.array(values, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], fps], names=[*part.schema.names[:-1], "fp"])

    slim = docs.select(*keep, text_of(text).alias("_simhash_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]), "fp long"])
    return slim.mapInArrow(batches, schema)


def trie_pairs(values: np.ndarray, left: np.ndarray, right: np.ndarray | None, depth: int, differing: int, half: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions in ``values`` (sorted, distinct, unsigned) that differ in ``budget`` bits at most.

    ``left`` and ``right`` are position ranges [from, to) of two subtries whose
    roots lie at ``depth`` and differ in ``differing`` bits so far; ``right``
    None joins the left one with itself. At most ``half`` bits may differ among
    the first 32.
    """
    other = left if right is None else right
    stack = [(depth, *(np.array([x], np.int64) for x in (left[0], left[1], other[0], other[1], differing)))]
    while stack:
        d, a0, a1, b0, b1, diff = stack.pop()
        if len(a0) > FRONT:
            mid = len(a0) // 2
            stack.append((d, *(x[mid:] for x in (a0, a1, b0, b1, diff))))
            a0, a1, b0, b1, diff = (x[:mid] for x in (a0, a1, b0, b1, diff))
        small = ((a1 - a0) * (b1 - b0) <= 16) | (d == BITS)
        if small.any():
            s0, s1, t0, t1 = a0[small], a1[small], b0[small], b1[small]
            wide = t1 - t0
            counts = (s1 - s0) * wide
            own = np.repeat(np.arange(len(s0)), counts)
            k = np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
            i, j = s0[own] + k // wide[own], t0[own] + k % wide[own]
            x = values[i] ^ values[j]
            fits = (i < j) | (s0[own] != t0[own])
            fits &= (np.bitwise_count(x) <= budget) & (np.bitwise_count(x >> np.uint64(HALF)) <= half)
            if fits.any():
                yield i[fits], j[fits]
            rest = ~small
            a0, a1, b0, b1, diff = a0[rest], a1[rest], b0[rest], b1[rest], diff[rest]
        if not len(a0):
            continue
        shift = np.uint64(BITS - 1 - d)
        one = np.uint64(1)
        am = np.clip(np.searchsorted(values, ((values[a0] >> shift) | one) << shift), a0, a1)
        bm = np.clip(np.searchsorted(values, ((values[b0] >> shift) | one) << shift), b0, b1)
        same = (a0 == b0) & (a1 == b1)
        allowed = half if d < HALF else budget
        nxt = [
            (a0, am, b0, bm, diff),
            (am, a1, bm, b1, diff),
            (a0, am, bm, b1, diff + 1),
            tuple(x[~same] for x in (am, a1, b0, bm, diff + 1)),
        ]
        p0, p1, q0, q1, pd_ = (np.concatenate(x) for x in zip(*nxt))
        keep = (p1 > p0) & (q1 > q0) & (pd_ <= allowed)
        if keep.any():
            stack.append((d + 1, p0[keep], p1[keep], q0[keep], q1[keep], pd_[keep]))


def merge_labels(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Union the pairs (i, j): labels become the smallest position of each set."""
    while True:
        x, y = labels[i], labels[j]
        if (x == y).all():
            return labels
        low = np.minimum(x, y)
        np.minimum.at(labels, x, low)
        np.minimum.at(labels, y, low)
        while (labels[labels] != labels).any():
            labels = labels[labels]


def trie_links(nodes: DataFrame, budget: int = 4) -> DataFrame:
    """``nodes`` (fp long, distinct) -> links (a, b): a spanning forest per task of all pairs within ``budget`` bits."""
    half_a, half_b = budget // 2, (budget - 1) // 2
    count = nodes.count()
    bits = max(LEAST_PREFIX, math.ceil(math.log2(max(1, count / NODES_PER_SUBTRIE))))

    def masks(most: int) -> list[int]:
        out = [0]
        for _ in range(most):
            out = sorted({m ^ (1 << b) for m in out for b in range(bits)} | set(out))
        return out

    def side(trie: int, value, most: int) -> DataFrame:
        own = F.shiftrightunsigned(value, BITS - bits)
        return (
            nodes.select(value.alias("v"), own.alias("own"), F.explode(F.array(*[F.lit(m).cast("long") for m in masks(most)])).alias("mask"))
            .select(F.lit(trie).alias("trie"), F.least("own", F.col("own").bitwiseXOR(F.col("mask"))).alias("lo"), F.col("mask"), "v")
        )

    fp = F.col("fp")
    turned = F.shiftleft(fp, HALF).bitwiseOR(F.shiftrightunsigned(fp, HALF))
    dealt = side(0, fp, half_a).union(side(1, turned, half_b))

    def walk(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        trie, lo, mask = (int(k) for k in key)
        values = np.sort(group["v"].to_numpy().view(np.uint64))
        split = int(np.searchsorted(values >> np.uint64(BITS - bits), np.uint64(lo), side="right"))
        half = (half_a, half_b)[trie]
        if mask == 0:
            pairs = trie_pairs(values, (0, len(values)), None, bits, 0, half, budget)
        elif 0 < split < len(values):
            pairs = trie_pairs(values, (0, split), (split, len(values)), bits, mask.bit_count(), half, budget)
        else:
            return pd.DataFrame({"a": [], "b": []}, dtype=np.int64)
        labels = np.arange(len(values))
        for i, j in pairs:
            labels = merge_labels(labels, i, j)
        if trie:
            values = (values << np.uint64(HALF)) | (values >> np.uint64(HALF))
        linked = np.flatnonzero(labels != np.arange(len(values)))
        return pd.DataFrame({"a": values[linked].view(np.int64), "b": values[labels[linked]].view(np.int64)})

    return dealt.groupBy("trie", "lo", "mask").applyInPandas(walk, "a long, b long")


def _classed(docs: DataFrame, id_column: str, text: str, shingle: int, budget: int) -> DataFrame:
    """id, key (of the text), fp, root (the class) and component_id of every row."""
    slim = docs.select(id_column, text_key(text).alias("_simhash_key"), F.col(text).alias("_simhash_of"))
    prints = stored(with_fingerprint(slim, "_simhash_of", [id_column, "_simhash_key"], shingle), "prints")
    nodes = stored(prints.groupBy("fp").agg(F.min(id_column).alias("least")), "nodes")
    roots = components(trie_links(nodes.select("fp"), budget))
    placed = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    smallest = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    classes = stored(placed.join(smallest, "root").select("fp", "root", "component_id"), "classes")
    return prints.join(classes, "fp")


def near_duplicates(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """One row per document: its id, ``fp`` (signed), ``fingerprint`` (hex) and ``component_id``.

    ``component_id`` is the smallest id of the documents reachable over links of
    at most ``budget`` differing bits. Null and blank texts have fingerprint
    zero and link like any other. Repeated rows stay; a null id never is the
    smallest unless all ids of the component are null (then null). An empty
    table gives no rows. Other columns are left out, so none can clash.
    """
    return _classed(docs, id_column, text, shingle, budget).select(
        id_column, "fp", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_one(docs: DataFrame, *, id_column: str = "doc_id", text: str = "text", shingle: int = 4, budget: int = 4) -> DataFrame:
    """``docs`` with one document of each near-duplicate group: the one with the smallest id.

    A null id comes after all others; ties go to the smallest text key, and of
    rows that repeat both id and text one stays.
    """
    return one_of_each(docs, _classed(docs, id_column, text, shingle, budget), id_column=id_column, text=text)


def one_of_each(docs: DataFrame, classed: DataFrame, *, id_column: str, text: str) -> DataFrame:
    """``docs`` with one document of each ``root`` of ``classed`` (id, _simhash_key, root), chosen as ``keep_one`` says."""
    names = docs.columns
    place = F.struct(F.col(id_column).isNull().alias("last"), F.col(id_column).alias("id"), F.col("_simhash_key").alias("key"))
    best = stored(classed.groupBy("root").agg(F.min(place).alias("best")).select(F.col("best.id").alias("_best_id"), F.col("best.key").alias("_best_key")).distinct(), "best")
    repeats = classed.groupBy(id_column, "_simhash_key").count().where("count > 1").isEmpty()
    key = free_name("_text_key", names)
    kept = docs.withColumn(key, text_key(text))
    kept = kept.join(best, (kept[key] == best["_best_key"]) & kept[id_column].eqNullSafe(best["_best_id"]), "left_semi")
    if not repeats:
        at = free_name("_copy", names)
        kept = kept.withColumn(at, F.row_number().over(Window.partitionBy(id_column, key).orderBy(key))).where(F.col(at) == 1)
    return kept.select(*names)

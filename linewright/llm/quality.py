"""Quality classifier: a generalised additive model with pairwise interactions.

Shallow trees are boosted feature by feature, round after round (cyclic), on
binned features; each adds to that feature's lookup table. The strongest pairs
of features then get small two-way tables on what is left. A score is a sum of
looked-up bins, vectorised over all documents of a batch. Learning takes a
bounded sample of labelled rows; scoring takes all rows and whole texts.
"""

from __future__ import annotations

import operator
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import byte_views, text_of

FEATURES = (
    "log_bytes", "word_length", "distinct_words", "same_as_previous", "upper", "digits", "marks", "bang", "bars", "odd_marks",
    "non_ascii", "blank", "line_words", "repeated_lines", "marked_words", "squeezed", "stops",
)
#: Most labelled rows to learn from.
MAX_LABELLED = 20_000
BINS, PAIR_BINS, PAIRS, ROUNDS, PAIR_ROUNDS, RATE = 32, 8, 8, 80, 30, 0.15
THRESHOLD = 0.3
#: Bytes squeezed at once; each stretch of a long text is squeezed by itself.
STRETCH = 1 << 16

_MARKS = np.array([not chr(i).isalnum() and 32 < i < 127 for i in range(256)])
_ODD = np.isin(np.arange(256), np.frombuffer(b"#$%&*@^~_=+<>{}[]\\", np.uint8))
_END = frozenset(range(33, 127)) - {ord(c) for c in "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"}


def features(text: bytes) -> list[float]:
    """FEATURES of a whole text; all 0 for an empty one."""
    n = len(text)
    words = text.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    lines = text.split(b"\n")
    count = len(words)
    marked = sum(w[-1] in _END for w in words)
    # A mark after another one, or a word that is nothing but one, is no usual end of a word.
    double = sum(len(w) > 1 and w[-1] in _END and w[-2] in _END or len(w) == 1 and w[0] in _END for w in words)
    squeezed = sum(len(zlib.compress(text[i : i + STRETCH], 1)) for i in range(0, n, STRETCH))
    return [
        float(np.log1p(n)),
        (n - counts[32]) / count,
        len(set(words)) / count,
        sum(map(operator.eq, words, words[1:])) / count,
        counts[65:91].sum() / n,
        counts[48:58].sum() / n,
        counts[_MARKS].sum() / n,
        counts[33] / n,
        counts[124] / n,
        counts[_ODD].sum() / n,
        counts[128:].sum() / n,
        (counts[9:14].sum() + counts[32]) / n,
        count / len(lines),
        1 - len(set(lines)) / len(lines),
        double / count,
        squeezed / n,
        (counts[46] + counts[44]) / (marked + 1),
    ]


def feature_rows(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """``keep`` columns and ``x``, the features."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = pa.array([features(bytes(v)) for v in byte_views(part.column(part.num_columns - 1))], pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], x], names=[*part.schema.names[:-1], "x"])

    slim = docs.select(*keep, text_of(text).alias("_quality_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]), "x array<double>"])
    return slim.mapInArrow(batches, schema)


@dataclass
class AdditiveModel:
    """Bin edges and lookup tables; small, and sent to the tasks as it is."""

    base: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pair_edges: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables)):
            out += table[np.searchsorted(edge, x[:, f], side="right")]
        coarse = {f: np.searchsorted(self.pair_edges[f], x[:, f], side="right") for f in {g for i, j, _ in self.pairs for g in (i, j)}}
        for i, j, table in self.pairs:
            out += table[coarse[i], coarse[j]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def _cuts(values: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1]))


def _best_cut(g: np.ndarray, h: np.ndarray, ridge: float = 5.0) -> tuple[float, int]:
    """Gain and place of the best cut of a histogram of gradients and weights."""
    if len(g) < 2:
        return 0.0, 0
    gl, hl = np.cumsum(g)[:-1], np.cumsum(h)[:-1]
    gain = gl**2 / (hl + ridge) + (g.sum() - gl) ** 2 / (h.sum() - hl + ridge) - g.sum() ** 2 / (h.sum() + ridge)
    at = int(gain.argmax())
    return float(gain[at]), at + 1


def shallow_tree(g: np.ndarray, h: np.ndarray, depth: int = 2, ridge: float = 5.0) -> np.ndarray:
    """The step of a tree of ``depth`` cuts over the bins of one feature."""
    gain, at = _best_cut(g, h, ridge) if depth else (0.0, 0)
    if gain <= 1e-9:
        return np.full(len(g), g.sum() / (h.sum() + ridge))
    return np.concatenate([shallow_tree(g[:at], h[:at], depth - 1, ridge), shallow_tree(g[at:], h[at:], depth - 1, ridge)])


def pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 5.0) -> tuple[float, np.ndarray]:
    """Gain and step of the best tree that cuts one feature once and each side once along the other."""
    best: tuple[float, np.ndarray] | None = None
    for turn in (False, True):
        a, b = (g.T, h.T) if turn else (g, h)
        for at in range(1, len(a)):
            gains, steps = 0.0, np.empty_like(a)
            for rows in (slice(0, at), slice(at, None)):
                gs, hs = a[rows].sum(axis=0), b[rows].sum(axis=0)
                gain, cut = _best_cut(gs, hs, ridge)
                cut = cut or len(gs)
                for cols in (slice(0, cut), slice(cut, None)):
                    if gs[cols].size:
                        steps[rows, cols] = gs[cols].sum() / (hs[cols].sum() + ridge)
                gains += gain + gs.sum() ** 2 / (hs.sum() + ridge)
            if best is None or gains > best[0]:
                best = gains, steps.T if turn else steps
    return best or (0.0, np.zeros_like(g))


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Cyclic boosting on the logistic loss. One class only, or no rows: a constant score."""
    n, width = x.shape
    ones = float(y.sum())
    base = float(np.log((ones + 0.5) / (n - ones + 0.5)))
    empty = [np.zeros(0)] * width
    if n == 0 or ones in (0.0, float(n)):
        return AdditiveModel(base, empty, [np.zeros(1)] * width, empty, [])
    edges = [_cuts(x[:, f], BINS) for f in range(width)]
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    logit = np.full(n, base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-logit))
        return y - p, p * (1 - p)

    for _ in range(ROUNDS):
        for f in range(width):
            g, h = slopes()
            size = len(tables[f])
            step = RATE * shallow_tree(np.bincount(bins[f], g, size), np.bincount(bins[f], h, size))
            tables[f] += step
            logit += step[bins[f]]
    coarse_edges = [_cuts(x[:, f], PAIR_BINS) for f in range(width)]
    coarse = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse_edges)]

    def grid(i: int, j: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shape = len(coarse_edges[i]) + 1, len(coarse_edges[j]) + 1
        cell = coarse[i] * shape[1] + coarse[j]
        g, h = slopes()
        return cell, np.bincount(cell, g, shape[0] * shape[1]).reshape(shape), np.bincount(cell, h, shape[0] * shape[1]).reshape(shape)

    ranked = sorted(((pair_tree(*grid(i, j)[1:])[0], i, j) for i in range(width) for j in range(i + 1, width)), reverse=True)[:PAIRS]
    pairs = [(i, j, np.zeros((len(coarse_edges[i]) + 1, len(coarse_edges[j]) + 1))) for _, i, j in ranked]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in pairs:
            cell, g, h = grid(i, j)
            step = RATE * pair_tree(g, h)[1]
            table += step
            logit += step.ravel()[cell]
    return AdditiveModel(base, edges, tables, coarse_edges, pairs)


def held_out(id_column: str, folds: int = 5, fold: int = 0) -> Column:
    """Whether the id's CRC-32 puts the row aside; rows without an id are always aside."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, *, id_column: str = "doc_id", text: str = "text", label: str = "quality", max_rows: int = MAX_LABELLED) -> AdditiveModel:
    """A model from at most about ``max_rows`` labelled rows outside the held-out fold, picked by hash of the id.

    Null labels and ids teach nothing. The features of the sample are all that
    reaches the driver.
    """
    known = labels.where(F.col(label).isin(0, 1) & ~held_out(id_column)).select(F.col(id_column).alias("_id"), F.col(label).alias("_label"))
    count = known.count()
    if count > max_rows:
        known = known.where(F.pmod(F.xxhash64("_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / count))
    rows = docs.join(known, docs[id_column] == known["_id"]).select(id_column, text, "_label")
    table = feature_rows(rows, ["_label"], text).select("_label", "x").toPandas()
    x = np.array(table["x"].tolist(), float).reshape(len(table), len(FEATURES))
    # In a fixed order, so that sums agree from run to run.
    order = np.lexsort((*x.T, table["_label"].to_numpy(float)))
    return fit(x[order], table["_label"].to_numpy(float)[order])


def scored(docs: DataFrame, model: AdditiveModel, *, keep: list[str], text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``keep`` columns, score and predicted for every row of ``docs``.

    Null and blank texts count as empty and get the score of empty texts;
    repeated rows get equal scores; an empty table stays empty.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = np.array([features(bytes(v)) for v in byte_views(part.column(part.num_columns - 1))], float).reshape(part.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(model.score(x))], names=[*part.schema.names[:-1], "score"])

    slim = docs.select(*keep, text_of(text).alias("_quality_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]), "score double"])
    return slim.mapInArrow(batches, schema).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, model: AdditiveModel, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the documents that the model rejects; all columns stay as they are."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            x = np.array([features(bytes(v)) for v in byte_views(part.column(part.num_columns - 1))], float).reshape(part.num_rows, len(FEATURES))
            yield part.filter(pa.array(model.score(x) >= threshold)).select(list(range(part.num_columns - 1)))

    positions = [f"c{i}" for i in range(len(docs.columns))]
    slim = docs.toDF(*positions).withColumn("c_text", text_of(positions[docs.columns.index(text)]))
    schema = ", ".join(f"{p} {f.dataType.simpleString()}" for p, f in zip(positions, docs.schema.fields))
    return slim.mapInArrow(batches, schema).toDF(*docs.columns)

"""Finding the runs of windows that may repeat, for the two operators on repeated spans.

A text is cut into runs: stretches of windows that share an anchor, the place
with the smallest hash inside each of them. Equal windows have equal anchors at
the same offset, so they meet wherever the runs of one anchor meet, and a text
has few runs for its windows. A run's content is its anchor's place in it and
the hash of everything its windows cover.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import stored

BASE = 0x9E3779B97F4A7C15
PLACE_BITS = 24
#: Longest stretch hashed at once; longer texts are worked through in overlapping stretches.
STRETCH = 1 << 20

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 4096)
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(size, base, np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"][:n], _powers["down"][:n]


def mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def rolling(values: np.ndarray, k: int) -> np.ndarray:
    """A hash of each k consecutive values (uint64)."""
    up, down = powers(len(values))
    total = np.empty(len(values) + 1, np.uint64)
    total[0] = 0
    np.cumsum(values * up, out=total[1:])
    return mixed((total[k:] - total[:-k]) * down[: len(values) - k + 1])


def run_table(values: np.ndarray, window: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """anchor hash, anchor place, first and last window of every run of ``values`` (uint64)."""
    parts = []
    span = window - k + 1
    windows = len(values) - window + 1
    for low in range(0, windows, STRETCH):
        high = min(low + STRETCH, windows)
        h = rolling(values[low : high + window - 1], k)
        n = len(h)
        ranked = (h & ~np.uint64((1 << PLACE_BITS) - 1)) | np.arange(n, dtype=np.uint64)
        rows = np.concatenate([ranked, np.full(-n % span, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, span)
        before = np.minimum.accumulate(rows, axis=1).ravel()
        after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
        least = np.minimum(after[: n - span + 1], before[span - 1 : n])
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        place = (least[first] & np.uint64((1 << PLACE_BITS) - 1)).astype(np.int64)
        parts.append((h[place], place + low, first + low, np.append(first[1:], high - low) - 1 + low))
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.uint64), *(np.zeros(0, np.int64),) * 3)


def joined_ranges(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, disjoint [from, to) of possibly overlapping ones; touching ones join."""
    out: list[list[int]] = []
    for start, end in sorted(ranges):
        if out and start <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end])
    return [(a, b) for a, b in out]


RUN_SCHEMA = "key binary, anchor long, content binary, place int, first int, last int, again array<int>"


def repeated_runs(runs: DataFrame) -> DataFrame:
    """``runs`` (RUN_SCHEMA) without those whose windows surely occur once.

    Adds ``repeats`` (the whole content occurs at several places), ``contents``
    (number of contents under the anchor) and ``shown`` (this row stands for its
    content). A place is a text and a position, so copies of one text are one
    place. ``again`` is not null where the content repeats inside its own text.
    """
    at = F.xxhash64("key", "first")
    several = F.min("at").alias("lo"), F.max("at").alias("hi"), F.max(F.col("again").isNotNull()).alias("own")
    keyed = runs.withColumn("at", at)
    hot = keyed.groupBy("anchor").agg(*several).where("own or lo <> hi").select("anchor")
    near = stored(keyed.join(hot, "anchor"), "runs")
    contents = near.groupBy("anchor", "content").agg(*several).select("anchor", "content", "lo", (F.col("own") | (F.col("lo") != F.col("hi"))).alias("repeats"))
    contents = stored(contents, "contents")
    counts = contents.groupBy("anchor").agg(F.count("*").alias("contents"))
    return stored(
        near.join(contents.join(counts, "anchor"), ["anchor", "content"]).withColumn("shown", F.col("at") == F.col("lo")).drop("at", "lo"), "tagged"
    )

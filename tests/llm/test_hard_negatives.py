"""Hard negatives against plain Python integers, and the exactness of the residue arithmetic."""

import math
import random

import numpy as np
import pytest

from linewright.llm import hard_negatives as hn


def plain(rows, *, every=100, scale=256.0, positives=5, negatives=10, least=30, most=90):
    kept = {}
    for i, v, lab in rows:
        if i is None or lab is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        kept[(i, lab, tuple(math.floor(scale * x) for x in v))] = None
    out = []
    for a in kept:
        if a[0] % every:
            continue
        scored = [(-sum(x * y for x, y in zip(a[2], b[2])), b[0], b[1]) for b in kept if b[0] != a[0] and len(b[2]) == len(a[2])]
        near = sorted(s for s in scored if s[2] == a[1])[:positives]
        for ps, p, _ in near:
            fits = sorted(s for s in scored if s[2] != a[1] and least * -ps <= 100 * -s[0] <= most * -ps)[:negatives]
            out += [(a[0], p, r + 1, n, -ps, -ns) for r, (ns, n, _) in enumerate(fits)]
    return sorted(out)


SCHEMA = "vec_id long, embedding array<float>, label int, anchor_id string, `rank` string, size string, id string, v string"


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, lab, "a", "r", "s", "i", "v") for i, v, lab in rows], SCHEMA)
    return sorted(tuple(r) for r in hn.hard_negatives(df, **more).collect())


def vectors(rng, count, size, spread=1.0):
    return [[float(np.float32(rng.gauss(0.1, spread))) for _ in range(size)] for _ in range(count)]


def test_small_tables(spark, monkeypatch):
    """Nulls, NaN, infinities, ties, repeated rows, shared ids, several lengths, one label on most rows, many blocks."""
    rng = random.Random(4)
    rows = [(i, v, rng.choice([0, 0, 0, 1, 2])) for i, v in enumerate(vectors(rng, 260, 9))]
    rows += [(1000 + i, v, i % 2) for i, v in enumerate(vectors(rng, 30, 4))]
    rows += [(2000 + i, [], i % 2) for i in range(12)]
    rows += [(None, [1.0] * 9, 0), (300, None, 1), (301, [1.0] * 9, None), (302, [float("nan")] + [1.0] * 8, 0), (303, [float("inf")] + [1.0] * 8, 0), (304, [None] + [1.0] * 8, 0)]
    rows += [(400 + i, rows[7][1], 0) for i in range(5)] + [(500 + i, rows[9][1], 1) for i in range(9)]
    rows += rows[:40] + [(100, rows[100][1], 2), (-100, rows[3][1], 1)]
    want = plain(rows, every=20)
    assert len(want) > 300
    assert run(spark, rows, every=20) == want
    monkeypatch.setattr(hn, "BLOCK_COMPONENTS", 300)
    monkeypatch.setattr(hn, "ANCHOR_BLOCK", 3)
    assert run(spark, rows, every=20) == want


def test_empty(spark):
    assert run(spark, []) == []
    assert run(spark, [(0, [1.0], 0)]) == []


@pytest.mark.parametrize("largest", [0, 1, 300, 1 << 20, 1 << 26, 1 << 28])
def test_scores_are_exact(largest):
    rng = np.random.default_rng(largest)
    a, b = (rng.integers(-largest, largest + 1, (n, 70)).astype(np.float64) for n in (5, 40))
    blocks = [hn.Block(np.arange(len(v)), np.zeros(len(v), np.int64), v) for v in (a, b)]
    want = a.astype(np.int64).astype(object) @ b.astype(np.int64).T.astype(object)
    assert hn.exact_scores(*blocks).tolist() == want.tolist()


def test_long_vectors_and_widest_scores():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(-256, 257, (n, 5000)).astype(np.float64) for n in (3, 4))
    blocks = [hn.Block(np.arange(len(v)), np.zeros(len(v), np.int64), v) for v in (a, b)]
    assert hn.exact_scores(*blocks).tolist() == (a.astype(np.int64) @ b.astype(np.int64).T).tolist()
    wide = hn.Block(np.arange(1), np.zeros(1, np.int64), np.array([[2.0**31, 2.0**30 + 1]]))
    assert hn.exact_scores(wide, wide).tolist() == [[2**62 + (2**30 + 1) ** 2]]
    far = hn.Block(np.arange(1), np.zeros(1, np.int64), np.array([[2.0**32, 1.0]]))
    with pytest.raises(OverflowError):
        hn.exact_scores(far, far)


def test_fewest_primes():
    assert len(hn.base_for(4_194_304)) == 3 and len(hn.base_for(500)) == 1 and len(hn.base_for(511)) == 2


def test_copied_packs_are_not_broadcast(spark, monkeypatch):
    """The packs that meet every block go through a shuffle, however few they are before they are copied."""
    monkeypatch.setattr(hn, "stored", lambda df, name: df)
    rows = [(i, v, i % 3) for i, v in enumerate(vectors(random.Random(8), 400, 4))]
    monkeypatch.setattr(hn, "BLOCK_COMPONENTS", 200)
    found = hn.hard_negatives(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int"))
    assert sorted(map(tuple, found.collect())) == plain(rows)
    plan = found._jdf.queryExecution().executedPlan().toString()
    final = plan.split("== Initial Plan ==")[0]
    assert final.count("SortMergeJoin [size") == 2 and "BroadcastHashJoin [size" not in final, final

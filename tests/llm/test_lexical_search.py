"""Ranked search against plain sums over all documents, and the bounds against exact scores."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from linewright.llm import lexical_search as ls

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return ["".join(c.lower() if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain(docs, items, k=10):
    split = [(i, Counter(terms(t))) for i, t in docs]
    split = [(i, c, c.total()) for i, c in split if c]
    n, length = len(split), sum(s for _, _, s in split)
    df = Counter(t for _, c, _ in split for t in c)
    out = []
    for item, text in sorted(set(items), key=str):
        asked = Counter(terms(text))
        found = []
        for doc, counts, size in split:
            m = 100 - 75 + (75 * size * n) // length
            score = sum(q * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * counts[t]) // (1000 * counts[t] + 8 * m)) for t, q in asked.items() if t in counts)
            if score > 0:
                found.append((-score, doc is None, doc or 0))
        out += [(item, r + 1, None if nothing else doc, -score) for r, (score, nothing, doc) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def sample(seed, count):
    rng = random.Random(seed)
    words = ["the", "of", "and", "Über", "ñandú", "x1", "cat", "dog"] + [f"w{i}" for i in range(300)]
    return [" ".join(rng.choice(words[:8] if rng.random() < 0.5 else words) for _ in range(rng.choice([1, 3, 20, 20, 60, 400]))) for _ in range(count)]


DOCS = "doc_id long, text string, key string, item string, term string, score string, `rank` string"
ITEMS = "item_id long, text string, item string, words string, floor string"


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(*r, "k", "i", "t", "s", "r") for r in docs], DOCS)
    b = spark.createDataFrame([(*r, "i", "w", "f") for r in items], ITEMS)
    return sorted((tuple(r) for r in ls.ranked_search(d, b, **more).collect()), key=str)


@pytest.mark.parametrize("small", [False, True])
def test_small_tables(spark, monkeypatch, small):
    """Nulls, empty and very long texts, ties, copies, shared ids, repeated items, odd characters; also in tiny blocks and packs."""
    texts = sample(1, 150)
    docs = list(enumerate(texts)) + [(500, None), (501, ""), (502, "?!"), (None, texts[3]), (3, texts[9]), (600, "cat\u0085dog cat CAT"), (601, "the " * 30_000 + texts[5])]
    docs += [(700 + i, texts[8]) for i in range(25)] + docs[:10]
    items = [(i, t) for i, t in enumerate(sample(2, 20))] + [(30, None), (31, ""), (32, "zzz-unseen"), (33, texts[8]), (33, texts[9]), (34, "the the the"), (33, texts[8]), (35, "CAT\u0085dog")]
    if small:
        for name, value in [("BLOCK_ROWS", 8), ("ITEMS_PER_PACK", 2), ("VOCABULARY", 5), ("BROADCAST_KEYS", 2), ("COUNTED_TERMS", 10), ("DENSE_FLAGS", 0)]:
            monkeypatch.setattr(ls, name, value)
    want = plain(docs, items)
    assert len(want) > 200
    assert run(spark, docs, items) == want


def test_pairs_carry_no_terms(spark, monkeypatch):
    """A pair of an item and a document is two numbers, not the item's terms; more pairs than are broadcast give the same rows."""
    docs, items = list(enumerate(sample(5, 60))) + [(100 + i, "cat dog w7") for i in range(40)], list(enumerate(["cat dog w7 " + t for t in sample(6, 10)]))
    made, plain_stored = {}, ls.stored
    monkeypatch.setattr(ls, "stored", lambda df, name: made.setdefault(name, plain_stored(df, name)))
    want = run(spark, docs, items)
    assert dict(made["asked"].dtypes) == {"key": "bigint", "asked": "array<bigint>"}
    monkeypatch.setattr(ls, "stored", plain_stored)
    monkeypatch.setattr(ls, "BROADCAST_KEYS", 3)
    assert run(spark, docs, items) == want == plain(docs, items)


def test_empty_tables(spark):
    assert run(spark, [], []) == []
    assert run(spark, [], [(1, "cat")]) == []
    assert run(spark, [(1, "cat"), (2, "dog")], []) == []
    assert run(spark, [(1, "cat"), (2, "dog")], [(1, "cat")]) == plain([(1, "cat"), (2, "dog")], [(1, "cat")])


def test_bounds_are_never_below_scores_and_near_them():
    docs = [Counter(ls.terms_of(t.encode())) for t in sample(3, 300)]
    n, length = len(docs), sum(c.total() for c in docs)
    shelf = ls.Shelf(ls.BITS << 9)
    for i, c in enumerate(docs):
        shelf.add(i, c.total(), ls.term_hashes(list(c)), np.array(list(c.values())))
    slices, keys, sizes, bits, _, _ = shelf.block()
    asked = [Counter(ls.terms_of(t.encode())) for t in sample(4, 12)]
    offsets = np.cumsum([0] + [len(a) for a in asked])
    weights = np.concatenate([np.array([q * (hash(t) % 7000 + 1) for t, q in a.items()]) for a in asked])
    pack = ls.Pack(np.arange(len(asked)), offsets, [t for a in asked for t in a], weights)
    bounds = pack.bounds(slices, sizes, bits, n, length)
    exact = np.array([[sum(int(w) * ls.share(c[t], ls.normaliser(c.total(), n, length)) for t, w in zip(a, weights[o:]) if t in c) for c in docs] for a, o in zip(asked, offsets)])
    assert (bounds >= exact).all()
    assert np.median((bounds / np.maximum(exact, 1))[exact > 0]) < 1.2

"""The two operators on repeated spans and SimHash, against plain versions."""

import random

import brute
import numpy as np
import pytest

from linewright.llm import debruijn, queries, simhash, suffixes
from linewright.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, n_removed string, key string, `KEPT` string"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, None, "x", None, "y") for i, t in zip(ids, texts)], SCHEMA)


def odd_texts(seed):
    """Copies, shared passages, periods, edits, short, empty, null and non-ASCII texts."""
    rng = random.Random(seed)
    words = ["ab", "ba", "a", "bb", "é", "the", "of", "ñandú", "x" * 9]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, long = make(30), make(60)
    texts = [None, "", " \t\n", "a", make(3), passage, "ab " * 40, "ab " * 33, "a" * 90, "b" + "a" * 60]
    for _ in range(25):
        at = rng.randrange(10)
        texts.append(make(at) + " " + passage + " " + make(rng.randrange(12)))
        cut = list(long)
        cut[rng.randrange(len(cut))] = rng.choice("xyz é")
        texts.append("".join(cut))
    texts += [texts[12]] * 3 + [make(rng.randrange(80)) for _ in range(30)]
    return texts


@pytest.mark.parametrize("many", [2000, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_suffixes(spark, seed, many):
    texts = odd_texts(seed)
    got = {r["doc_id"]: r for r in suffixes.without_repeats(frame(spark, texts), window=20, anchor=5, many=many, with_text=True).collect()}
    want = brute.repeated_bytes([(t or "").encode() for t in texts], 20)
    for i, w in enumerate(want):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == w, (i, texts[i])


@pytest.mark.parametrize("many", [2000, 1])
@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed, many):
    """Shorter strings are counted where asked for; what is removed stays that of the window."""
    texts = odd_texts(seed)
    data = [(t or "").encode() for t in texts]
    got = {r["doc_id"]: r for r in suffixes.without_repeats(frame(spark, texts), window=20, anchor=5, many=many, passages=(4, 12)).collect()}
    left = brute.without_repeated_runs(data, 12, 4)
    for i, w in enumerate(brute.repeated_bytes(data, 20)):
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["n_spans"], got[i]["kept_sha256"]) == w, (i, texts[i])
        assert got[i]["passage_bytes"] == len(data[i]) - len(left[i]), (i, texts[i])
        assert (got[i]["n_passages"] > 0) == (got[i]["passage_bytes"] > 0)


def test_passages_below_the_window(spark, tmp_path):
    """op3 counts passages of over 50 words that are shorter than its 400 bytes, and removes none of their bytes."""
    rng = random.Random(7)
    words = lambda n: " ".join(f"{rng.randrange(10**4, 10**5)}" for _ in range(n))
    shared = [words(n) for n in range(51, 61)]
    texts = [f"{words(80)} {p} {words(80)}" for p in shared for _ in range(2)] + [words(200) for _ in range(10)]
    texts += [f"{words(9)} {words(1)} {shared[0]} {words(30)} {shared[1]}", shared[2], shared[2], None]
    frame(spark, texts).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r for r in queries.QUERIES["op3_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    data = [(t or "").encode() for t in texts]
    for i, left in enumerate(brute.without_repeated_runs(data, 200, 50)):
        passages = 1 if i < 20 else {30: 2, 31: 1, 32: 1}.get(i, 0)
        assert (got[i]["n_passages"], got[i]["passage_bytes"], got[i]["n_removed"]) == (passages, len(data[i]) - len(left), 0), (i, texts[i])


@pytest.mark.parametrize("seed", [1, 2])
def test_words(spark, seed):
    texts = odd_texts(seed)
    got = {r["doc_id"]: r for r in debruijn.without_repeated_words(frame(spark, texts), window=7, anchor=2, with_text=True).collect()}
    want = brute.repeated_words([(t or "").encode() for t in texts], 7)
    for i, w in enumerate(want):
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == w, (i, texts[i])


def test_deep_shallow_order():
    rng = random.Random(3)
    strings = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(30))) for _ in range(300)] + [b"ab" * 50, b"ab" * 50 + b"\0", b"ab" * 50]
    groups = np.array([rng.randrange(3) for _ in strings])
    order, shared = suffixes.deep_shallow(groups, strings, 110, shallow=8)
    assert [(groups[i], strings[i]) for i in order] == sorted((g, s) for g, s in zip(groups, strings))
    for a, b, n in zip(order, order[1:], shared[1:]):
        want = -1 if groups[a] != groups[b] else next((k for k, (x, y) in enumerate(zip(strings[a], strings[b])) if x != y), min(len(strings[a]), len(strings[b])))
        assert n == want


def test_whole_tables(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    texts = [(r["text"] or "").encode() for r in rows]
    got = {r["doc_id"]: r for r in suffixes.without_repeats(docs).collect()}
    assert [tuple(got[r["doc_id"]][c] for c in ("n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in rows] == brute.repeated_bytes(texts, 400)
    got = {r["doc_id"]: r for r in debruijn.without_repeated_words(docs, keep=["doc_id"]).collect()}
    assert [tuple(got[r["doc_id"]][c] for c in ("n_words", "n_removed", "kept_sha256")) for r in rows] == brute.repeated_words(texts, 35)
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    prints = [brute.fingerprint(t) for t in texts]
    assert [int(got[r["doc_id"]]["fingerprint"], 16) for r in rows] == prints
    assert [got[r["doc_id"]]["component_id"] for r in rows] == brute.linked_components([r["doc_id"] for r in rows], prints)


def test_empty_tables(spark):
    empty = frame(spark, [])
    assert suffixes.without_repeats(empty).count() == 0
    assert debruijn.without_repeated_words(empty).count() == 0
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.keep_one(empty).count() == 0


def test_paths_compact(spark):
    """One shared passage is one unbranched path, whatever runs it falls into."""
    rng = random.Random(5)
    words = lambda n: " ".join(f"w{rng.randrange(10**9)}" for _ in range(n))
    passage = words(200)
    texts = [f"{words(40)} {passage} {words(40)}" for _ in range(3)]
    rows = debruijn.repeated_paths(frame(spark, texts)).collect()
    assert len({r["path"] for r in rows}) == 1 and len(rows) == 3
    assert all([(s["start"], s["end"]) for s in r["spans"]] == [(40, 240)] for r in rows)


def test_circle_of_edges(spark):
    """Edges on a circle have no first one and stay single."""
    edges = spark.createDataFrame([(bytes([i]), bytes([i]), bytes([(i + 1) % 3]), 2) for i in range(3)] + [(b"x", b"p", b"q", 5), (b"y", b"q", b"r", 1)], "edge binary, from_node binary, to_node binary, n int")
    rows = {bytes(r["edge"]): (bytes(r["path"]), r["ahead"]) for r in debruijn.compact_paths(edges).collect()}
    assert rows[b"y"] == (b"x", 5) and rows[b"x"] == (b"x", 0)
    assert all(rows[bytes([i])] == (bytes([i]), 0) for i in range(3))


def test_trie_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 60, dtype=np.uint64)
    near = np.concatenate([base ^ np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (k, 60)).astype(np.uint64), axis=0) for k in range(1, 7)])
    values = np.unique(np.concatenate([base, near]))
    want = {(i, j) for i in range(len(values)) for j in range(i + 1, len(values)) if (int(values[i]) ^ int(values[j])).bit_count() <= 4}
    straight = {(int(i), int(j)) for a, b in simhash.trie_pairs(values, (0, len(values)), None, 0, 0, 32, 4) for i, j in zip(a, b)}
    assert straight == want
    halves = {(int(i), int(j)) for a, b in simhash.trie_pairs(values, (0, len(values)), None, 0, 0, 2, 4) for i, j in zip(a, b)}
    assert halves == {(i, j) for i, j in want if (int(values[i] ^ values[j]) >> 32).bit_count() <= 2}


def test_links_over_prefixes(spark):
    rng = random.Random(6)
    values = [rng.getrandbits(64) for _ in range(200)]
    values += [v ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 7))) for v in values for _ in range(2)]
    signed = [v - (1 << 64) if v >> 63 else v for v in dict.fromkeys(values)]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r["node"]: r["root"] for r in components(simhash.trie_links(nodes)).collect()}
    want = brute.linked_components(list(range(len(signed))), [v & (1 << 64) - 1 for v in signed])
    groups = {}
    for v, w in zip(signed, want):
        groups.setdefault(w, set()).add(roots.get(v, v))
    assert all(len(g) == 1 for g in groups.values()) and len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (5, 5)], "a long, b long")
    roots = {r["node"]: r["root"] for r in components(links).collect()}
    assert len({roots[i] for i in range(61)}) == 1 and roots[100] == roots[101] != roots[0]


def test_keep_one(spark):
    texts = ["the same words as before here", "the same words as before here", "something else entirely is said in this one", None, "", "alone it stands with its own words"]
    docs = frame(spark, texts, [4, 2, 7, None, None, None]).union(frame(spark, [texts[2]], [7]))
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    rows = sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in kept.collect())
    assert rows == [(False, 2, texts[1]), (False, 7, texts[2]), (True, 0, ""), (True, 0, texts[5])]

"""The pipeline's stages against what their operators decide, planted cases, and run() as a whole."""

import random

import brute
import corpus_pipeline
import pytest
import test_near_copies
from pyspark.sql import functions as F

from linewright.llm import decontaminate, quality
from linewright.llm.common import stored

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    model = quality.learn(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality.scored(docs, model, keep=["doc_id"]).where("predicted = 1").collect()}
    first = stored(corpus_pipeline.quality_stage(spark, docs, SF), "t1")
    assert {r["doc_id"] for r in first.collect()} == good and first.columns == columns

    rows = sorted(first.collect(), key=lambda r: r["doc_id"])
    want = {rows[i]["doc_id"] for i in test_near_copies.groups([r["text"] if (r["text"] or "").strip() else "blank blank" for r in rows])}
    second = stored(corpus_pipeline.near_copies_stage(spark, first, SF), "t2")
    assert {r["doc_id"] for r in second.collect()} == want and second.columns == columns

    rows = second.collect()
    left = brute.without_repeated_runs([(r["text"] or "").encode() for r in rows], corpus_pipeline.REPEATED_BYTES, corpus_pipeline.REPEATED_WORDS)
    third = stored(corpus_pipeline.repeated_text_stage(spark, second, SF), "t3")
    texts = {r["doc_id"]: r for r in third.collect()}
    assert third.columns == columns and all(r["n_chars"] == len(r["text"]) for r in texts.values() if r["text"])
    for r, kept in zip(rows, left):
        if kept == (r["text"] or "").encode():
            assert texts[r["doc_id"]]["text"] == r["text"]
        elif kept.split():
            assert texts[r["doc_id"]]["text"] == kept.decode("utf-8", "ignore")
        else:
            assert r["doc_id"] not in texts

    flagged = decontaminate.contamination(third, spark.read.parquet(f"{SF}/benchmark.parquet"), keep=["doc_id"])
    clean = {r["doc_id"] for r in flagged.where(~F.col("contaminated")).collect()}
    fourth = stored(corpus_pipeline.decontamination_stage(spark, third, SF), "t4")
    assert {r["doc_id"] for r in fourth.collect()} == clean and fourth.columns == columns

    last = corpus_pipeline.mixing_stage(spark, fourth, SF)
    assert last.columns[: len(columns)] == columns
    total = sum(len((r["text"] or "").split()) for r in fourth.collect())
    assert abs(last.agg(F.sum("words")).first()[0] - total) <= 25


CLASHING = (
    "doc_id long, text string, lang string, source string, n_chars long, _key string, text_key string, kept string, N_bytes long, n_removed string, n_spans string,"
    " kept_sha256 string, own_kept string, `pass` int, position string, words string, size string, node string, bands string, suffix_key string, anchor string"
)


def frame(spark, rows):
    more = ("k", "t", "kept", 7, "r", "s", "h", "o", 3, "p", "w", "z", "n", "b", "sk", "a")
    return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), *more) for i, t, s in rows], CLASHING)


def prose(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.choice([2, 3, 4, 5, 5, 6, 8]))) for _ in range(n))


@pytest.mark.parametrize("length", [51, 53, 56, 60, 90])
def test_planted_passages(spark, length):
    """Passages of over 50 words that two documents share go from both; shorter ones, and texts of their own, stay."""
    rng = random.Random(length)
    rows, passages = [], []
    for n in range(12):
        passage = prose(rng, length)
        passages.append(passage)
        for k in range(2):
            rows.append((2 * n + k, f"{prose(rng, 60)} {passage} {prose(rng, 70)}", "a"))
    clean = [(100 + n, prose(rng, 200), "b") for n in range(20)]
    shared = prose(rng, 30)
    clean += [(200 + n, f"{prose(rng, 90)} {shared} {prose(rng, 90)}", "b") for n in range(6)]
    found = {r["doc_id"]: r for r in corpus_pipeline.repeated_text_stage(spark, frame(spark, rows + clean), SF).collect()}
    for i, text, _ in rows:
        middle = passages[i // 2]
        assert middle[5:-5] not in found[i]["text"] and len(text) - len(found[i]["text"]) >= len(middle)
    for i, text, _ in clean:
        assert found[i]["text"] == text


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_edge_cases(spark, name):
    """Nulls, empty texts, ties, repeated rows, a null source, an empty table, and columns with the operators' own names."""
    stage = dict(corpus_pipeline.STAGES)[name]
    rng = random.Random(1)
    long = prose(rng, 400)
    rows = [(1, long, "a"), (1, long, "a"), (2, long, None), (None, prose(rng, 80), "b"), (3, None, "b"), (4, "", None), (5, "  ", "b"), (6, prose(rng, 90), "c"), (6, prose(rng, 90), "c")]
    docs = frame(spark, rows)
    out = stage(spark, docs, SF)
    added = out.columns[len(docs.columns) :]
    assert out.columns[: len(docs.columns)] == docs.columns and len(set(map(str.lower, out.columns))) == len(out.columns)
    assert len(added) == (3 if name == "mixing" else 0)
    given = {(i, t) for i, t, _ in rows}
    for r in out.collect():
        assert r["kept"] == "kept" and r["N_bytes"] == 7 and r["_key"] == "k" and r["position"] == "p" and r["own_kept"] == "o"
        assert (r["doc_id"], r["text"]) in given
    kept = [(r["doc_id"], r["text"]) for r in out.collect()]
    if name == "near_copies":
        assert kept.count((1, long)) == 1 and (2, long) not in kept and sum(not (t or "").strip() for _, t in kept) == 1 and (3, None) in kept
    if name == "repeated_text":
        assert (1, long) not in kept and (2, long) not in kept and {(3, None), (4, ""), (5, "  ")} <= set(kept)
    if name == "decontamination":
        assert len(kept) == len(rows)
    if name == "mixing":
        assert not {(3, None), (4, ""), (5, "  ")} & set(kept)
    assert stage(spark, docs.limit(0), SF).count() == 0


def test_decontamination_drops_planted_items(spark):
    item = next(r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if len(r["text"].split()) >= 14)
    rng = random.Random(2)
    docs = frame(spark, [(1, f"{prose(rng, 30)} {item} {prose(rng, 30)}", "a"), (2, prose(rng, 100), "a")])
    assert [r["doc_id"] for r in corpus_pipeline.decontamination_stage(spark, docs, SF).collect()] == [2]


def test_run_repeats(spark):
    """Two runs give the same rows, in which no document that a stage rejected is left."""
    first, second = (sorted((r["doc_id"], r["pass"], r["words"], r["position"]) for r in corpus_pipeline.run(spark, SF).collect()) for _ in range(2))
    assert first == second and first

"""The registered queries against their SQL, and those without SQL against plain versions or held-out rows."""

import random
import re
import zlib

import oracle
import pytest

from linewright.llm import chat, decontaminate, language, licenses, mixing, quality, queries, topk

SF = "/root/testdata/sf0.001"
MORE = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_against_sql(spark, duck, name):
    count, difference = oracle.compare(queries.QUERIES[name](spark, SF), duck, queries.ORACLES[name])
    assert difference is None and count > 0


def words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


CLASHING = "doc_id long, text string, offset string, words string, win string, key string, `_row` string, size string, label string, keyword string"


def clashing(spark, rows):
    return spark.createDataFrame([(*r, "o", "w", "x", "k", "r", "s", "l", "y") for r in rows], CLASHING)


def plain_contamination(docs, items, window):
    found = {}
    wins = {}
    for item, text in items:
        w = words(text)
        for i in range(max(len(w) - window, 0) + 1) if w else ():
            wins.setdefault(tuple(w[i : i + window]), set()).add(item)
    for doc, text in docs:
        w, hit, of = words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    of |= wins[tuple(w[i : i + n])]
        found[doc] = len(w), len(hit), sorted(str(x) for x in of)
    return found


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_WORDS, 0])
def test_contamination(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_WORDS", most)
    monkeypatch.setattr(decontaminate, "BROADCAST_PLACES", most)
    rng = random.Random(1)
    vocabulary = ["The", "of", "Ä", "x9", "and", "é"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12)))) for i in range(12)] + [(90, None), (91, ""), (92, "of"), (5, "the the the the")]
    docs = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(60)))) for i in range(60)] + [(100, None), (101, ""), (102, "...")]
    docs += [(103, items[3][1] + "! " + items[5][1])] * 1
    frame = clashing(spark, docs)
    bench = spark.createDataFrame([(*i, "clash") for i in items], "item_id long, text string, words string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(frame, bench, keep=["doc_id"], window=6).collect()}
    for doc, (n, hit, of) in plain_contamination(docs, items, 6).items():
        assert (got[doc]["n_words"], got[doc]["n_hit"], list(got[doc]["items"])) == (n, hit, of), doc
    none = decontaminate.contamination(frame, bench.limit(0), keep=["doc_id"], window=6).collect()
    assert len(none) == len(docs) and all(r["n_hit"] == 0 and not r["contaminated"] for r in none)
    assert decontaminate.contamination(frame.limit(0), bench, keep=["doc_id"]).count() == 0


def held_out_accuracy(spark, rows, label):
    return sum(r["guess"] == r[label] for r in rows) / len(rows)


def test_language_held_out(spark):
    found = queries.op2(spark, MORE)
    docs = spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(docs, "doc_id").where("held_out").collect()
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    real = [r for r in rows if any(c.isalpha() for c in r["text"] or "") and r["lang"]]
    assert sum(r["lang_pred"] == r["lang"] for r in real) / len(real) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_language_odd_texts(spark):
    docs = spark.createDataFrame(
        [(i, "der die das und nicht " * 5, "de", "s") for i in range(30)] + [(i, "the and of with not " * 5, "en", "s") for i in range(30, 60)],
        "doc_id long, text string, lang string, score string",
    )
    model = language.learn(docs)
    odd = spark.createDataFrame([(1, None, None, "s"), (2, "", None, "s"), (3, "123 !?", None, "s"), (4, "und " * 200_000, None, "s"), (4, "ab", None, "s"), (5, "Ж", None, "s")], docs.schema)
    got = {(r["doc_id"], r["lang_pred"]) for r in language.identified(odd, model, keep=["doc_id"]).collect()}
    assert {(1, "und"), (2, "und"), (3, "und"), (4, "de")} <= got and len(got) >= 5
    assert language.identified(odd.limit(0), model, keep=["doc_id"]).count() == 0
    nothing = language.learn(docs.limit(0))
    assert {r["lang_pred"] for r in language.identified(docs, nothing, keep=["doc_id"]).collect()} == {"und"}


@pytest.mark.parametrize("languages", [1, 2, 3, 4, 6, 9, 40])
def test_codewords_differ(languages):
    code = language.codebook(languages)
    assert code.shape[0] == languages and len({tuple(r) for r in code.tolist()}) == languages


def test_quality_held_out(spark):
    rows = queries.op5(spark, MORE).join(spark.read.parquet(f"{MORE}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.95
    good, bad = ([r["score"] for r in rows if r["quality"] == q] for q in (1, 0))
    ordered = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert ordered > 0.95


def test_quality_odd_texts(spark):
    docs = clashing(spark, [(i, f"word{i} and more, said plainly." * (i + 1)) for i in range(20)] + [(21, None), (22, ""), (22, ""), (None, "x" * 300_000)])
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(20)] + [(None, 1, "x"), (3, None, "x")], "doc_id long, quality int, text string")
    model = quality.learn(docs, labels)
    rows = quality.scored(docs, model, keep=["doc_id"]).collect()
    assert len(rows) == 24 and all(0 <= r["score"] <= 1 for r in rows)
    kept = quality.keep_good(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(r["predicted"] for r in rows)
    constant = quality.learn(docs, labels.limit(0))
    assert {r["score"] for r in quality.scored(docs, constant, keep=["doc_id"]).collect()} == {0.5}


def test_topk_odd_rows(spark):
    rng = random.Random(2)
    vec = lambda: [rng.uniform(-1, 1) for _ in range(5)]
    same = vec()
    rows = [(i, same if i % 3 == 0 else vec()) for i in range(200)] + [(300, None), (301, [None, 1.0, 1.0, 1.0, 1.0]), (302, [float("nan")] * 5), (None, vec()), (320, [0.0] * 5), (340, [1.0, 2.0])]
    frame = spark.createDataFrame([(i, v, "x", "y") for i, v in rows], "vec_id long, embedding array<double>, id string, block string")
    got = {}
    for r in topk.top_products(frame, k=7).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    import math

    clean = {i: [math.floor(64 * x) for x in v] for i, v in rows if i is not None and v and len(v) == 5 and all(x is not None and math.isfinite(x) for x in v)}
    for q in (i for i in clean if i % 20 == 0):
        want = sorted((-sum(a * b for a, b in zip(clean[q], v)), i) for i, v in clean.items() if i != q)[:7]
        assert sorted(got[q]) == [(n + 1, i, -s) for n, (s, i) in enumerate(want)]
    assert 340 not in got and topk.top_products(frame.limit(0)).count() == 0


def test_licenses_base(spark):
    docs = spark.read.parquet(f"{MORE}/documents.parquet").select("doc_id", "text")
    extra = ["MIT License. mit license! cc BY-SA 4.0", None, "", "xcc by", "Licensed under the Apache License, Version 2.0", "the GNU Lesser General Public License v2.1", "cc by " * 3000]
    table = docs.unionByName(spark.createDataFrame([(-1 - i, t) for i, t in enumerate(extra)], docs.schema))
    texts = {r["doc_id"]: r["text"] for r in table.collect()}
    got = {r["doc_id"]: r for r in licenses.license_scan(table, keep=["doc_id"]).collect()}
    assert len(got) == len(texts)
    for i, text in texts.items():
        w = words(text)
        at = sorted((k, label) for phrase, label in licenses.BASE for p in [phrase.split()] for k in range(len(w)) if w[k : k + len(p)] == p)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["base_labels"]) == (len(w), len(at), ",".join(sorted({x for _, x in at}))), i
        assert (r["first_word"], r["last_word"]) == ((at[0][0], at[-1][0]) if at else (None, None))
        assert set(r["base_labels"].split(",")) <= set(r["labels"].split(",")) or not at
    assert got[-5]["labels"] == "apache,apache-2.0" and got[-6]["labels"] == "lgpl-2.1" or got[-6]["base_labels"] == ""
    assert "cc-by-sa-4.0" in got[-1]["labels"].split(",")
    assert licenses.license_scan(table.limit(0), keep=["doc_id"]).count() == 0
    assert len(licenses.signature_rules()) >= 200


def test_chat_machine(spark):
    turns = [
        (1, 0, "system", "be <|end|>\n kind"), (1, 1, "user", "a&amp;[b"), (1, 2, "assistant", "<|turn|>"),
        (2, 0, "assistant", "first"), (3, 0, "user", None), (3, 1, None, "x"), (None, 5, "user", "&lt;"), (None, None, "user", ""), (4, 1, "user", "q"), (4, 1, "user", "q"),
    ]
    frame = spark.createDataFrame([(*t, "s", "f") for t in turns], "conv_id long, turn long, role string, text string, segments string, formatted string")
    made = chat.format_chats(frame)
    flags = {r["conv_id"]: (r["valid"], r["first_fault"]) for r in made.collect()}
    assert flags == {1: (True, None), 2: (False, 0), 3: (False, 1), None: (False, 1), 4: (False, 1)}
    back = {r["conv_id"]: ([(t["role"], t["text"]) for t in r["turns"]], r["loss_text"]) for r in chat.read_back(made).collect()}
    assert back[1] == ([("system", "be <|end|>\n kind"), ("user", "a&amp;[b"), ("assistant", "<|turn|>")], "<|turn|>")
    assert back[None] == ([("user", ""), ("user", "&lt;")], "") and back[3] == ([("user", ""), ("", "x")], "")
    assert chat.format_chats(frame.limit(0)).count() == 0
    with pytest.raises(ValueError):
        chat.Template(open_turn="turn:")


def test_word_count(spark):
    """Only blanks end words: U+0085, U+2028 and U+2029 are parts of words, also at the end of a text."""
    texts = ["", " ", "a", " a b\n", "a \u2028", "a b \u0085", "\u2029", "a\u2028 ", "\t\u2028\r\n", "x\x1fy z\x0b"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r["n"] for r in frame.select(mixing.word_count(frame["text"]).alias("n")).collect()]
    assert got == [len(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts]


def test_mixing(spark):
    rng = random.Random(3)
    rows = [(i, rng.choice(["b", "a", None, "c", "ä"]), " ".join("w" for _ in range(rng.randrange(40)))) for i in range(400)] + [(900, "tiny", "one two"), (901, "none", ""), (902, None, None), (903, "a", "x y"), (903, "a", "x y")]
    frame = spark.createDataFrame([(*r, "p", "t") for r in rows], "doc_id long, source string, text string, position string, target string")
    plan = [r.asDict(True) for r in mixing.curriculum_plan(frame, keep=["doc_id"]).collect()]
    assert len(plan) == len(rows)
    sizes = {}
    for i, s, t in rows:
        sizes[s] = sizes.get(s, 0) + len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    total, full = sum(sizes.values()), {s for s in sizes if not sizes[s]}
    while True:
        level = (total - sum(3 * sizes[s] for s in full)) / sum(weight[s] for s in sizes if s not in full)
        over = {s for s in sizes if s not in full and weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        full |= over
    want = {s: 3 * sizes[s] if s in full else weight[s] * level for s in sizes}
    source = {i: s for i, s, _ in rows}
    taken = {}
    for r in plan:
        s = source[r["doc_id"]]
        assert abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == sizes[s] and r["taken"] <= 3 * r["size"]
        assert r["taken"] == sum(t["words"] for t in r["takes"]) and all(0 <= t["position"] <= 1 for t in r["takes"])
        taken[s] = taken.get(s, 0) + r["taken"]
    assert all(want[s] - 1 < taken[s] <= want[s] for s in sizes)
    again = [r.asDict(True) for r in mixing.curriculum_plan(frame.repartition(7), keep=["doc_id"]).collect()]
    assert sorted((r["doc_id"], r["taken"]) for r in again) == sorted((r["doc_id"], r["taken"]) for r in plan)
    mix = mixing.training_order(frame).collect()
    assert sum(r["words"] for r in mix) == sum(r["taken"] for r in plan) and {r["position"] for r in mix} == {"p"}
    at = [r["_position"] for r in mix]
    assert at == sorted(at)
    assert mixing.curriculum_plan(frame.limit(0), keep=["doc_id"]).count() == 0


def test_schedule_inverse(spark):
    """Over many documents of one source the words by time follow the integral of its schedule."""
    frame = spark.createDataFrame([(i, "s", "w w w w") for i in range(2000)], "doc_id long, source string, text string")
    rows = mixing.curriculum_plan(frame, keep=["doc_id"], weights=(1.0,), schedules=(((0.0, 0.5), (1.0, 1.5)),)).collect()
    for t in (0.25, 0.5, 0.75):
        share = sum(x["words"] for r in rows for x in r["takes"] if x["position"] < t) / 8000
        assert abs(share - (0.5 * t + t * t / 2)) < 0.01

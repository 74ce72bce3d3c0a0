"""License scan: ordered signature rules behind a keyword prefilter. SQL functions only.

A text is brought to lower-case words with single blanks. A rule is a regular
expression over that form with a keyword, a label, a priority and a confidence;
its pattern is tried only on texts that hold the keyword. Detections are word
intervals. An interval inside one of higher priority (or of the same priority
and longer) is suppressed, so "gnu general public license version 3" speaks for
itself and not once more as its parts. The base phrases are rules that nothing
suppresses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewright.llm.common import spaced_words, stored, text_of

#: Phrase and label of the base rules.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))

#: Family, keyword, names as patterns, versions (label suffix, pattern), by hand.
V = r"(?: version| v)? ?"
FAMILIES: tuple[tuple[str, str, tuple[str, ...], tuple[tuple[str, str], ...]], ...] = (
    ("gpl", "general public", (r"(?:gnu )?general public licen[sc]e",), (("1", "1(?: 0)?"), ("2", "2(?: 0)?"), ("3", "3(?: 0)?"))),
    ("gpl", "gpl", (r"gpl", r"gplv", r"gnu gpl"), (("1", "1(?: 0)?"), ("2", "2(?: 0)?"), ("3", "3(?: 0)?"))),
    ("lgpl", "lesser general", (r"(?:gnu )?lesser general public licen[sc]e",), (("2.1", "2 1"), ("3", "3(?: 0)?"))),
    ("lgpl", "library general", (r"(?:gnu )?library general public licen[sc]e",), (("2", "2(?: 0)?"),)),
    ("lgpl", "lgpl", (r"(?:gnu )?lgpl",), (("2", "2(?: 0)?"), ("2.1", "2 1"), ("3", "3(?: 0)?"))),
    ("agpl", "affero", (r"(?:gnu )?affero general public licen[sc]e",), (("1", "1(?: 0)?"), ("3", "3(?: 0)?"))),
    ("agpl", "agpl", (r"(?:gnu )?agpl",), (("3", "3(?: 0)?"),)),
    ("gfdl", "free documentation", (r"(?:gnu )?free documentation licen[sc]e",), (("1.1", "1 1"), ("1.2", "1 2"), ("1.3", "1 3"))),
    ("apache", "apache", (r"apache(?: software)? licen[sc]e", r"apache"), (("1.0", "1 0"), ("1.1", "1 1"), ("2.0", "2(?: 0)?"))),
    ("mit", "mit", (r"(?:the )?mit licen[sc]e", r"mit x11 licen[sc]e"), ()),
    ("mit", "permission is hereby", (r"permission is hereby granted free of charge to any person obtaining a copy",), ()),
    ("bsd", "bsd", (r"(?:new |modified |simplified |original )?bsd licen[sc]e", r"bsd style licen[sc]e"), ()),
    ("bsd-2", "bsd", (r"(?:bsd 2 clause|2 clause bsd|bsd two clause|two clause bsd)(?: licen[sc]e)?",), ()),
    ("bsd-3", "bsd", (r"(?:bsd 3 clause|3 clause bsd|bsd three clause|three clause bsd)(?: licen[sc]e)?",), ()),
    ("bsd-4", "bsd", (r"(?:bsd 4 clause|4 clause bsd|bsd four clause|four clause bsd)(?: licen[sc]e)?",), ()),
    ("bsd", "redistribution and use", (r"redistribution and use in source and binary forms with or without modification",), ()),
    ("mpl", "mozilla", (r"mozilla public licen[sc]e",), (("1.0", "1 0"), ("1.1", "1 1"), ("2.0", "2(?: 0)?"))),
    ("mpl", "mpl", (r"mpl",), (("1.1", "1 1"), ("2.0", "2 0"))),
    ("epl", "eclipse", (r"eclipse public licen[sc]e",), (("1.0", "1 0"), ("2.0", "2(?: 0)?"))),
    ("cddl", "common development", (r"common development and distribution licen[sc]e",), (("1.0", "1 0"), ("1.1", "1 1"))),
    ("cpl", "common public", (r"common public licen[sc]e",), (("1.0", "1 0"),)),
    ("eupl", "european union", (r"european union public licen[sc]e",), (("1.1", "1 1"), ("1.2", "1 2"))),
    ("cecill", "cecill", (r"cecill(?: licen[sc]e)?", r"licence cecill"), (("2.0", "2 0"), ("2.1", "2 1"))),
    ("artistic", "artistic", (r"artistic licen[sc]e",), (("1.0", "1 0"), ("2.0", "2(?: 0)?"))),
    ("isc", "isc", (r"isc licen[sc]e",), ()),
    ("zlib", "zlib", (r"zlib(?: libpng)? licen[sc]e",), ()),
    ("boost", "boost", (r"boost software licen[sc]e",), (("1.0", "1 0"),)),
    ("unlicense", "unlicense", (r"(?:the )?unlicense",), ()),
    ("wtfpl", "wtfpl", (r"wtfpl",), (("2", "2"),)),
    ("python", "python software", (r"python software foundation licen[sc]e",), (("2", "2(?: 0)?"),)),
    ("ofl", "open font", (r"(?:sil )?open font licen[sc]e",), (("1.0", "1 0"), ("1.1", "1 1"))),
    ("odbl", "open database", (r"open database licen[sc]e",), (("1.0", "1 0"),)),
    ("odc-by", "open data commons", (r"open data commons attribution licen[sc]e",), (("1.0", "1 0"),)),
    ("pddl", "public domain dedication", (r"public domain dedication and licen[sc]e",), (("1.0", "1 0"),)),
    ("public-domain", "public domain", (r"(?:released|placed|dedicated|put) (?:in|into|to) the public domain", r"is in the public domain"), ()),
    ("cc0", "cc0", (r"(?:creative commons )?cc0",), (("1.0", "1 0(?: universal)?"),)),
    ("ms-pl", "microsoft public", (r"microsoft public licen[sc]e",), ()),
    ("ms-rl", "microsoft reciprocal", (r"microsoft reciprocal licen[sc]e",), ()),
    ("osl", "open software", (r"open software licen[sc]e",), (("2.1", "2 1"), ("3.0", "3 0"))),
    ("afl", "academic free", (r"academic free licen[sc]e",), (("2.1", "2 1"), ("3.0", "3 0"))),
    ("upl", "universal permissive", (r"universal permissive licen[sc]e",), (("1.0", "1 0"),)),
    ("bsl", "business source", (r"business source licen[sc]e",), (("1.1", "1 1"),)),
    ("sspl", "server side", (r"server side public licen[sc]e",), (("1", "1"),)),
    ("elastic", "elastic", (r"elastic licen[sc]e",), (("2.0", "2(?: 0)?"),)),
    ("polyform", "polyform", (r"polyform (?:noncommercial|small business|shield|strict|perimeter) licen[sc]e",), (("1.0", "1 0 0"),)),
    ("openrail", "openrail", (r"(?:creativeml |bigscience )?openrail(?: m)?(?: licen[sc]e)?",), ()),
    ("llama", "llama", (r"llama (?:\d+ )?community licen[sc]e",), ()),
    ("proprietary", "all rights reserved", (r"all rights reserved",), ()),
    ("proprietary", "proprietary and confidential", (r"proprietary and confidential",), ()),
)
CC_PARTS = (("cc-by", "by", "attribution"), ("cc-by-sa", "by sa", "attribution share ?alike"), ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s"), ("cc-by-nc", "by nc", "attribution non ?commercial"), ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"), ("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s"))
CC_VERSIONS = ("1 0", "2 0", "2 5", "3 0", "4 0")
#: Ways to say that a text is under a license.
GRANTS = r"(?:(?:is|are|was) )?(?:licensed|licenced|released|distributed|available|published|provided) under (?:the )?(?:terms of )?(?:the )?"


def signature_rules() -> list[tuple[str, str, str, int, float, bool]]:
    """keyword, pattern, label, priority, confidence, base: a few hundred rules from the tables above."""
    rules = [(phrase, phrase, label, 0, 0.9, True) for phrase, label in BASE]
    for family, keyword, names, versions in FAMILIES:
        for name in names:
            rules.append((keyword, name, family, 1, 0.7, False))
            rules.append((keyword, GRANTS + name, family, 2, 0.9, False))
            for suffix, pattern in versions:
                versioned = f"{name}{V}{pattern}"
                rules.append((keyword, versioned, f"{family}-{suffix}", 3, 0.95, False))
                rules.append((keyword, GRANTS + versioned, f"{family}-{suffix}", 4, 1.0, False))
                rules.append((keyword, f"{versioned} or(?: at your option)? (?:any )?later(?: version)?", f"{family}-{suffix}-or-later", 5, 1.0, False))
    for label, short, long in CC_PARTS:
        for keyword, name in (("cc by", f"cc {short}"), ("creative commons", f"creative commons {long}(?: licen[sc]e)?")):
            rules.append((keyword, name, label, 1 + len(short.split()), 0.8, False))
            for version in CC_VERSIONS:
                rules.append((keyword, f"{name} {version}(?: international| unported)?", f"{label}-{version.replace(' ', '.')}", 6 + len(short.split()), 1.0, False))
    return rules


def rule_table(spark: SparkSession) -> DataFrame:
    rows = [(k, rf"(?<= ){p}(?= )", label, prio, sure, base) for k, p, label, prio, sure, base in signature_rules()]
    return spark.createDataFrame(rows, "keyword string, pattern string, label string, priority int, confidence double, base boolean")


def _blanks(text: Column) -> Column:
    return F.char_length(text) - F.char_length(F.replace(text, F.lit(" "), F.lit("")))


def detections(found: Column, pieces: Column) -> Column:
    """(first, last) word of each match: ``pieces`` lie between the ``found`` strings, in order."""
    start = F.struct(F.lit(-1).alias("words"), F.array().cast("array<struct<first:int,last:int>>").alias("out"))
    pairs = F.zip_with(found, F.slice(pieces, 1, F.size(found)), lambda m, before: F.struct(_blanks(before).alias("skip"), _blanks(m).alias("more")))
    return F.aggregate(
        pairs,
        start,
        lambda a, x: F.struct(
            (a["words"] + x["skip"] + x["more"]).alias("words"),
            F.concat(a["out"], F.array(F.struct((a["words"] + x["skip"]).alias("first"), (a["words"] + x["skip"] + x["more"]).alias("last")))).alias("out"),
        ),
        lambda a: a["out"],
    )


def license_scan(docs: DataFrame, *, keep: list[str], text: str = "text") -> DataFrame:
    """One row per document: ``keep``, n_words, n_base, first_word, last_word, base_labels, labels, score, found.

    ``found`` lists the detections left (label, first, last, priority,
    confidence); labels are theirs and the base ones. score is the largest
    confidence, 0 without any. Null texts are empty; repeated rows get a row each;
    an empty table stays empty; other columns play no part.
    """
    spark = docs.sparkSession
    rules = rule_table(spark)
    keywords = sorted({r[0] for r in signature_rules()})
    row = "scan_row"
    whole = docs.select(F.struct(*keep).alias("_kept_row"), spaced_words(text_of(text)).alias("_words"))
    whole = whole.withColumns({
        "n_words": F.when(F.col("_words") == "", F.lit(0)).otherwise(_blanks(F.col("_words")) + 1).cast("long"),
        # Keywords of one word are parts of longer ones and of every pattern's text, so a plain search is a safe gate.
        "_gates": F.filter(F.array(*[F.when(F.contains("_words", F.lit(k)), F.lit(k)) for k in keywords]), lambda k: k.isNotNull()),
    })
    whole = whole.withColumn(row, F.monotonically_increasing_id())
    padded = F.concat(F.lit(" "), F.col("_words"), F.lit(" "))
    # The empty keyword has no rule: its row stands for the document itself.
    gates = F.explode(F.concat(F.array(F.lit("")), F.col("_gates"))).alias("keyword")
    opened = whole.select(row, "_kept_row", "n_words", F.when(F.size("_gates") > 0, padded).alias("_padded"), gates)
    tried = opened.join(F.broadcast(rules), "keyword", "left")
    matches = F.when(F.expr("_padded rlike pattern"), F.regexp_extract_all("_padded", F.col("pattern"), F.lit(0)))
    seen = tried.withColumn("_found", matches).where("keyword = '' or size(_found) > 0").withColumn(
        "_at", F.when(F.size("_found") > 0, detections(F.col("_found"), F.split("_padded", F.col("pattern"))))
    )
    rows = stored(seen.select(row, "_kept_row", "n_words", "keyword", "label", "priority", "confidence", "base", "_at"), "detections")

    # Detections that touch no other one are settled alone; only those of one cluster are compared.
    places = rows.where("size(_at) > 0").select(row, "label", "priority", "confidence", "base", F.explode("_at").alias("x")).select(row, "label", "priority", "confidence", "base", "x.first", "x.last")
    order = Window.partitionBy(row).orderBy("first", F.col("last").desc())
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = places.withColumn("_new", (reach.isNull() | (F.col("first") > reach)).cast("int"))
    clusters = marked.withColumn("_cluster", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    one = F.struct("label", "first", "last", "priority", "confidence", "base")
    grouped = clusters.groupBy(row, "_cluster").agg(F.array_distinct(F.collect_list(one)).alias("_all"))
    kept = F.filter(
        "_all",
        lambda x: x["base"]
        | ~F.exists(
            "_all",
            lambda y: ~y["base"]
            & (y["first"] <= x["first"])
            & (y["last"] >= x["last"])
            & ((y["priority"] > x["priority"]) | ((y["priority"] == x["priority"]) & (y["last"] - y["first"] > x["last"] - x["first"]))),
        ),
    )
    found = grouped.groupBy(row).agg(F.array_sort(F.flatten(F.collect_list(kept))).alias("_kept"))
    none = F.array().cast(found.schema["_kept"].dataType)
    shown = rows.where("keyword = ''").join(found, row, "left").withColumn("_kept", F.coalesce("_kept", none))
    shown = shown.withColumn("_base", F.filter("_kept", lambda x: x["base"]))
    label = lambda column: F.transform(column, lambda x: x["label"])
    return shown.select(
        *[F.col(f"_kept_row.`{c}`").alias(c) for c in keep],
        "n_words",
        F.size("_base").cast("long").alias("n_base"),
        F.array_min(F.transform("_base", lambda x: x["first"])).cast("long").alias("first_word"),
        F.array_max(F.transform("_base", lambda x: x["first"])).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct(label("_base"))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(label("_kept"))), ",").alias("labels"),
        F.coalesce(F.array_max(F.transform("_kept", lambda x: x["confidence"])), F.lit(0.0)).alias("score"),
        F.transform("_kept", lambda x: F.struct(x["label"].alias("label"), x["first"].alias("first"), x["last"].alias("last"), x["priority"].alias("priority"), x["confidence"].alias("confidence"))).alias("found"),
    )

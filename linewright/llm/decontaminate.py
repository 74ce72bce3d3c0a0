"""Benchmark decontamination: a prefix-filtered set join, in SQL functions alone.

A document holds a window of benchmark words only if it holds all the window's
shingles, so one of them, the rarest, is a sufficient prefix. One pass over the
corpus keeps the places of all benchmark shingles; their counts rank them, and
a window with a shingle that stands nowhere is out at once. The places of the
prefixes alone go on: a prefix's offset in its window gives the one place where
the window could start (positional bound), which must leave room for its length
in the text, and there the words are compared. Sides as large as the benchmark
or as the candidates are broadcast below a checked size, joined by shuffle beyond it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import spaced_words, stored, text_key, text_of

WINDOW = 13
SHINGLE = 4
#: Benchmark words (counted over all windows) up to which shingles and windows are broadcast: about 64 MB.
BROADCAST_WORDS = 4_000_000
#: Candidate places up to which their lists are broadcast: at about 270 bytes each some 110 MB.
BROADCAST_PLACES = 400_000


def word_array(text: Column) -> Column:
    joined = spaced_words(text)
    return F.when(joined == "", F.array().cast("array<string>")).otherwise(F.split(joined, " "))


def benchmark_windows(benchmark: DataFrame, text: str, item: str, window: int) -> DataFrame:
    """item, words: every window of every item; an item of fewer words is one window."""
    return (
        benchmark.select(F.col(item).cast("string").alias("item"), word_array(text_of(text)).alias("w"))
        .where("size(w) > 0")
        .select("item", "w", F.explode(F.expr(f"sequence(0, greatest(size(w) - {window}, 0))")).alias("start"))
        .select("item", F.slice("w", F.col("start") + 1, window).alias("words"))
        .distinct()
    )


def shingle_keys(words: Column, at: Column, length: int) -> Column:
    """The hash of ``length`` words from ``at`` (0-based); equality is settled on the words later."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(length)])


def contamination(docs: DataFrame, benchmark: DataFrame, *, keep: list[str], text: str = "text", item: str = "item_id", item_text: str = "text", window: int = WINDOW, shingle: int = SHINGLE, share: int = 20) -> DataFrame:
    """One row per document: the ``keep`` columns, n_words, n_hit, n_items, items_sha256, contaminated, items.

    A word is hit inside any occurrence of a benchmark window; contaminated is
    n_hit > 0 and ``share`` * n_hit >= n_words. Null texts have no words. Items
    with null ids hit but are not listed. Repeated rows get a row each; an empty
    table or benchmark gives no hits; other columns of either table play no part.
    """
    found = benchmark_windows(benchmark, item_text, item, window)
    # Ids of windows are fixed by writing them before anything refers to them.
    windows = stored(found.groupBy("words").agg(F.collect_set("item").alias("items")).withColumn("win", F.monotonically_increasing_id()), "windows")
    pieces = windows.select(
        "win", "words", F.least(F.size("words"), F.lit(shingle)).alias("length"), F.explode(F.expr(f"sequence(0, size(words) - least(size(words), {shingle}))")).alias("offset")
    )
    key = None
    for n in range(1, shingle + 1):
        here = shingle_keys(F.col("words"), F.col("offset"), n)
        key = F.when(F.col("length") == n, here) if key is None else key.when(F.col("length") == n, here)
    pieces = pieces.withColumn("key", key)
    lengths = sorted(r[0] for r in pieces.select("length").distinct().collect())  # at most `shingle` values
    total = windows.agg(F.sum(F.size("words"))).first()[0] or 0
    near = F.broadcast if total <= BROADCAST_WORDS else (lambda side: side)

    # Rows of one text have one result, so places are kept by the text's key. The outer generators keep the optimiser
    # from testing the arrays first, which would split the text anew for each of its words.
    words = docs.select(text_key(text).alias("id"), word_array(text_of(text)).alias("w"))
    at = {n: F.expr(f"if(size(w) >= {n}, sequence(0, size(w) - {n}), cast(array() AS array<int>))") for n in lengths}

    def placed(n: int) -> Column:
        return F.transform(at[n], lambda i: F.struct(i.alias("at"), shingle_keys(F.col("w"), i, n).alias("key")))

    size = F.size("w").alias("n")
    if len(lengths) == 1:
        length = lengths[0]
        keys = F.transform(at[length], lambda i: shingle_keys(F.col("w"), i, length))
        places = words.select("id", size, keys.alias("keys")).select("id", "n", F.posexplode_outer("keys").alias("at", "key"))
    elif lengths:
        places = words.select("id", size, F.concat(*map(placed, lengths)).alias("all")).select("id", "n", F.inline_outer("all"))
    else:
        places = words.where("false").select("id", size, F.lit(0).alias("at"), F.lit(0).cast("long").alias("key"))
    wanted = pieces.select("key").distinct()
    matches = stored(places.join(near(wanted), "key"), "matches")

    counts = matches.groupBy("key").agg(F.count("*").alias("places"))
    ranked = pieces.join(counts, "key", "left").withColumn("places", F.coalesce("places", F.lit(0).cast("long")))
    prefix = ranked.groupBy("win").agg(F.min(F.struct("places", "key", "offset")).alias("p"), F.first("words").alias("words")).where("p.places > 0")
    prefixes = stored(prefix.select(F.col("p.key").alias("key"), F.col("p.offset").alias("offset"), "win", F.size("words").alias("length")), "prefixes")
    starts = matches.join(near(prefixes), "key").where("at >= offset AND at - offset + length <= n")
    lists = starts.select("id", "win", F.expr("at - offset").alias("start")).distinct().join(near(windows.select("win", "words")), "win")
    candidates = stored(lists.groupBy("id").agg(F.collect_list(F.struct("start", "words", "win")).alias("places")), "candidates")
    count = candidates.agg(F.sum(F.size("places"))).first()[0] or 0

    # One struct holds the kept columns, so that no name of theirs can clash.
    whole = docs.select(F.struct(*keep).alias("_kept"), text_key(text).alias("id"), word_array(text_of(text)).alias("_w"))
    side = F.broadcast(candidates) if count <= BROADCAST_PLACES else candidates
    checked = whole.join(side, "id", "left").select(
        "_kept",
        "id",
        F.size("_w").cast("long").alias("n_words"),
        F.expr(
            """CASE WHEN places IS NOT NULL THEN transform(
                 filter(places, x -> slice(_w, x.start + 1, size(x.words)) = x.words),
                 x -> struct(x.start AS start, size(x.words) AS n, x.win AS win)) END"""
        ).alias("hits"),
    )
    base = stored(
        checked.select(
            "_kept",
            "id",
            "n_words",
            F.expr("CASE WHEN hits IS NULL THEN 0L ELSE cast(size(array_distinct(flatten(transform(hits, x -> sequence(x.start, x.start + x.n - 1))))) AS long) END").alias("n_hit"),
            F.expr("array_distinct(transform(hits, x -> x.win))").alias("wins"),
        ),
        "hits",
    )
    listed = base.where("size(wins) > 0").select("id", F.explode("wins").alias("win")).distinct().join(near(windows.select("win", "items")), "win")
    items = listed.select("id", F.explode("items").alias("item")).groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"))
    listed_items = F.coalesce("items", F.array().cast("array<string>"))
    return base.join(items, "id", "left").select(
        *[F.col(f"_kept.`{c}`").alias(c) for c in keep],
        "n_words",
        "n_hit",
        F.size(listed_items).cast("long").alias("n_items"),
        F.sha2(F.array_join(listed_items, ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (F.lit(share) * F.col("n_hit") >= F.col("n_words"))).alias("contaminated"),
        listed_items.alias("items"),
    )

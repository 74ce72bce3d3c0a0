"""Substring dedup over words: compaction of the de Bruijn graph of repeated windows.

Edges are windows of consecutive words, nodes the windows less a word. Edges
are bucketed by their anchors (see repeats.py): inside a bucket every window
that occurs at several places is found on its words, and stretches of such
windows are compacted to one edge. Spark joins then compact what continues
from bucket to bucket: where a node has one edge in and one out, the two belong
to one path, and pointer doubling numbers all paths in a logarithm of their
length. A path's occurrences are verified by source coordinates: windows of one
text that lie on one path at one distance form one long repeated span.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import byte_views, free_name, stored, text_key, text_of
from linewright.llm.repeats import RUN_SCHEMA, joined_ranges, repeated_runs, run_table
from linewright.llm.suffixes import BATCH, _table, once_each

WINDOW = 35
ANCHOR = 8


class Words:
    """The words of a text, and the bytes of any stretch of them joined by blanks."""

    def __init__(self, text: bytes) -> None:
        self.words = text.split()
        self.joined = b" ".join(self.words)
        ends = np.cumsum(np.fromiter(map(len, self.words), np.int64, len(self.words)) + 1) - 1
        self.ends = ends.tolist()
        self.starts = [0, *(ends + 1).tolist()[:-1]] if len(ends) else []

    def stretch(self, start: int, end: int) -> bytes:
        return self.joined[self.starts[start] : self.ends[end - 1]]


def text_runs(text: bytes, key: bytes, window: int, anchor: int) -> Iterator[tuple]:
    """The runs of a text in words, one row for contents that repeat inside it."""
    held = Words(text)
    n = len(held.words)
    if n < window:
        return
    digest = xxhash.xxh64_intdigest
    values = np.fromiter(map(digest, held.words), np.uint64, n)
    hashes, places, firsts, lasts = run_table(values, window, anchor)
    joined, starts, ends = held.joined, held.starts, held.ends
    seen: dict[bytes, tuple] = {}
    more: dict[bytes, list[tuple[int, int]]] = {}
    for h, m, p, q in zip(hashes.view(np.int64).tolist(), places.tolist(), firsts.tolist(), lasts.tolist()):
        content = xxhash.xxh3_128_digest(joined[starts[p] : ends[q + window - 1]], seed=m - p)
        if content in seen:
            more.setdefault(content, []).append((p, q + window))
        else:
            seen[content] = (key, h, content, m, p, q)
    for content, row in seen.items():
        again = [x for r in joined_ranges(more[content]) for x in r] if content in more else None
        yield (*row, again)


def _run_batches(window: int, anchor: int):
    schema = pa.schema([("key", pa.binary()), ("anchor", pa.int64()), ("content", pa.binary()), ("place", pa.int32()), ("first", pa.int32()), ("last", pa.int32()), ("again", pa.list_(pa.int32()))])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for part in parts:
            rows: list[tuple] = []
            for key, view in zip(part.column(0).to_pylist(), byte_views(part.column(1))):
                if key not in done:
                    done.add(key)
                    rows.extend(text_runs(bytes(view), key, window, anchor))
                if len(rows) > 50_000:
                    yield _table(rows, schema)
                    rows = []
            yield _table(rows, schema)

    return batches


_PIECE = "anchor long, content binary, words binary, offset int, key binary, first int, repeats boolean, from_node binary, to_node binary"


def _pieces(window: int):
    """(key, text, runs) -> the words of each run, with its first and last node."""
    schema = pa.schema([("anchor", pa.int64()), ("content", pa.binary()), ("words", pa.binary()), ("offset", pa.int32()), ("key", pa.binary()), ("first", pa.int32()), ("repeats", pa.bool_()), ("from_node", pa.binary()), ("to_node", pa.binary())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows: list[tuple] = []
            for key, view, runs in zip(part.column(0).to_pylist(), byte_views(part.column(1)), part.column(2).to_pylist()):
                held = Words(bytes(view))
                for r in runs:
                    p, q = r["first"], r["last"]
                    nodes = (xxhash.xxh3_128_digest(held.stretch(i, i + window - 1)) for i in (p, q + 1))
                    words = held.stretch(p, q + window) if r["contents"] > 1 else None
                    rows.append((r["anchor"], r["content"], words, r["place"] - p, key, p, r["repeats"], *nodes))
                if len(rows) > 20_000:
                    yield _table(rows, schema)
                    rows = []
            yield _table(rows, schema)

    return batches


_EDGE = "key binary, start int, n int, edge binary, from_node binary, to_node binary"


def _bucket(window: int):
    """Pieces sorted by anchor -> edges: stretches of repeated windows of contents that do not repeat whole."""
    schema = pa.schema([("key", pa.binary()), ("start", pa.int32()), ("n", pa.int32()), ("edge", pa.binary()), ("from_node", pa.binary()), ("to_node", pa.binary())])

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        # A window's place before the anchor is part of what it is, so equal windows meet under one offset.
        where: dict[tuple[int, bytes], int] = {}
        several: set[tuple[int, bytes]] = set()
        texts = [(Words(r[2]), r) for r in {r[1]: r for r in rows}.values()]
        for t, (held, r) in enumerate(texts):
            for i in range(len(held.words) - window + 1):
                edge = (r[3] - i, held.stretch(i, i + window))
                if where.setdefault(edge, t) != t:
                    several.add(edge)
        for held, r in texts:
            if r[6]:
                continue
            hit = [(r[3] - i, held.stretch(i, i + window)) in several for i in range(len(held.words) - window + 1)]
            change = np.flatnonzero(np.diff(np.array([False, *hit, False]).astype(np.int8))).tolist()
            for a, b in zip(change[::2], change[1::2]):
                digest = xxhash.xxh3_128_digest
                yield r[4], r[5] + a, b - a, digest(held.stretch(a, b - 1 + window)), digest(held.stretch(a, a + window - 1)), digest(held.stretch(b, b + window - 1))

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple] = []
        found: list[tuple] = []
        for part in parts:
            for row in zip(*(part.column(c).to_pylist() for c in range(part.num_columns))):
                if group and row[0] != group[0][0]:
                    found.extend(solve(group))
                    group = []
                    if len(found) > 20_000:
                        yield _table(found, schema)
                        found = []
                group.append(row)
        found.extend(solve(group))
        yield _table(found, schema)

    return batches


def compact_paths(edges: DataFrame) -> DataFrame:
    """``edges`` (edge, from_node, to_node, n; distinct) -> edge, path, ahead.

    ``path`` is the first edge of the unbranched path, ``ahead`` the number of
    windows before this edge on it. Pointers double each round; edges on a
    closed circle, which has no first edge, are paths of their own.
    """
    outs = edges.groupBy(F.col("from_node").alias("node")).agg(F.count("*").alias("o"), F.min("edge").alias("next"))
    ins = edges.groupBy(F.col("to_node").alias("node")).agg(F.count("*").alias("i"), F.min("edge").alias("edge"), F.min("n").alias("n"))
    plain = outs.join(ins, "node").where("o = 1 and i = 1 and next <> edge")
    back = plain.select(F.col("next").alias("edge"), F.col("edge").alias("before"), F.col("n").cast("long").alias("way"))
    # `before` null: this edge is a first one, or has reached one, in `path`.
    state = stored(
        edges.select("edge").join(back, "edge", "left").select("edge", "before", F.coalesce("way", F.lit(0).cast("long")).alias("ahead"), F.when(F.col("before").isNull(), F.col("edge")).alias("path")), "paths"
    )
    waiting = state.where("before is not null").count()
    while waiting:
        to = state.select(F.col("edge").alias("before"), F.col("before").alias("further"), F.col("ahead").alias("more"), F.col("path").alias("reached"))
        moving = state.where("before is not null").join(to, "before").select("edge", F.col("further").alias("before"), (F.col("ahead") + F.col("more")).alias("ahead"), F.col("reached").alias("path"))
        state = stored(state.where("before is null").unionByName(moving), "paths")
        left = state.where("before is not null").count()
        if left == waiting:
            break
        waiting = left
    whole = F.col("before").isNull()
    return state.select("edge", F.when(whole, F.col("path")).otherwise(F.col("edge")).alias("path"), F.when(whole, F.col("ahead")).otherwise(F.lit(0).cast("long")).alias("ahead"))


def _cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text, spans) -> the words left."""
    schema = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
    for part in parts:
        rows, size = [], 0
        for key, view, ranges in zip(part.column(0).to_pylist(), byte_views(part.column(1)), part.column(2).to_pylist()):
            words = bytes(view).split()
            spans = joined_ranges([(r["start"], r["end"]) for r in ranges])
            edges = [0, *(x for s in spans for x in s), len(words)]
            left = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
            kept = b" ".join(left)
            rows.append((key, len(words) - len(left), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode()))
            size += len(kept)
            if size > BATCH:
                yield _table(rows, schema)
                rows, size = [], 0
        yield _table(rows, schema)


def _all_words(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(rest..., text) -> rest..., number of words and the digest of all of them."""
    for part in parts:
        n, digest = [], []
        for view in byte_views(part.column(part.num_columns - 1)):
            words = bytes(view).split()
            n.append(len(words))
            digest.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(n, pa.int64()), pa.array(digest, pa.string())], names=[*part.schema.names[:-1], "n_words", "all_sha256"])


def repeated_paths(docs: DataFrame, *, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, bodies: DataFrame | None = None) -> DataFrame:
    """key (of a text), path, spans (array of start, end in words), n_edges.

    A row for each place where a text follows an unbranched path of repeated
    windows. Copies of one text count as one place (see ``without_repeated_words``).
    """
    bodies = once_each(docs, text) if bodies is None else bodies
    keyed = docs.select(text_key(text).alias("key"), text_of(text).alias("body"))
    tagged = repeated_runs(keyed.mapInArrow(_run_batches(window, anchor), RUN_SCHEMA))
    part = tagged.where("shown").groupBy("key").agg(F.collect_list(F.struct("anchor", "content", "place", "first", "last", "contents", "repeats")).alias("runs"))
    pieces = stored(bodies.join(part, "key").mapInArrow(_pieces(window), _PIECE), "pieces")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part_edges = stored(pieces.where("words is not null").repartition(spread, "anchor").sortWithinPartitions("anchor").mapInArrow(_bucket(window), _EDGE), "edges")

    # The anchor is part of a whole content's name, its windows' number follows from it.
    name = F.unhex(F.sha2(F.concat(F.hex("anchor"), F.hex("content")), 256))
    whole = tagged.where("repeats")
    long_name = whole.select("key", name.alias("edge"), F.col("first").alias("start"), (F.col("last") - F.col("first") + 1).alias("n"), "again")
    shown = pieces.where("repeats").select(name.alias("edge"), "from_node", "to_node")
    lengths = long_name.groupBy("edge").agg(F.max("n").alias("n"))
    edges = shown.groupBy("edge").agg(F.min("from_node").alias("from_node"), F.min("to_node").alias("to_node")).join(lengths, "edge").select("edge", "from_node", "to_node", "n")
    edges = edges.union(part_edges.groupBy("edge").agg(F.min("from_node"), F.min("to_node"), F.max("n")))
    paths = compact_paths(stored(edges, "graph"))

    places = long_name.select("key", "edge", "start", "n").union(part_edges.select("key", "edge", "start", "n"))
    along = places.join(paths, "edge").groupBy("key", "path", (F.col("start") - F.col("ahead")).alias("_from"))
    spans = along.agg(
        F.min("start").alias("low"), F.max(F.col("start") + F.col("n")).alias("high"), F.sum("n").alias("total"), F.count("*").alias("n_edges"),
        F.collect_list(F.struct(F.col("start").cast("int").alias("start"), (F.col("start") + F.col("n") + window - 1).cast("int").alias("end"))).alias("each"),
    )
    # All windows between the first and the last are there, or each edge stands for itself.
    one = F.array(F.struct(F.col("low").cast("int").alias("start"), (F.col("high") + window - 1).cast("int").alias("end")))
    joined = spans.select("key", "path", F.when(F.col("total") == F.col("high") - F.col("low"), one).otherwise(F.col("each")).alias("spans"), "n_edges")
    inside = long_name.where("again is not null").select(
        "key", F.col("edge").alias("path"), F.expr("transform(sequence(0, size(again) div 2 - 1), i -> struct(again[2 * i] AS start, again[2 * i + 1] AS end))").alias("spans"), F.lit(1).cast("long").alias("n_edges")
    )
    return joined.union(inside)


def without_repeated_words(docs: DataFrame, *, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, with_text: bool = False, keep: list[str] | None = None) -> DataFrame:
    """``docs`` (or its columns ``keep``) with n_words, n_removed, kept_sha256, n_paths (and ``kept``, the words left, if asked for).

    Removes every word covered by a window of ``window`` words that also starts
    anywhere else, judged on the input. Words are what blanks separate. Null texts
    have none; repeated rows are copies of each other; shorter texts keep all; an
    empty table stays empty. Columns with the names of results are replaced.
    """
    bodies = once_each(docs, text)
    paths = repeated_paths(docs, text=text, window=window, anchor=anchor, bodies=bodies)
    lists = paths.groupBy("key").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.count("*").alias("n_paths"))
    columns = ["n_removed", "kept_sha256", *(["kept"] if with_text else [])]
    cut = bodies.join(lists, "key").select("key", "body", "spans", "n_paths")
    counts = lists.select("key", "n_paths")
    cut = cut.select("key", "body", "spans").mapInArrow(_cut, "key binary, n_removed long, n_spans long, kept_sha256 string, kept string").groupBy("key").agg(*[F.min(c).alias(c) for c in columns])
    cut = stored(cut.join(counts, "key"), "cut")
    own, body, size, digest = (free_name(n, docs.columns) for n in ("word_key", "word_body", "word_count", "word_digest"))
    rest = [c for c in keep or docs.columns if c.lower() not in {"n_words", "n_paths", *columns}]
    slim = docs.select(*rest, text_key(text).alias(own), text_of(text).alias(body))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]), f"`{size}` long, `{digest}` string"])
    base = stored(slim.mapInArrow(_all_words, schema), "words")
    copies = base.groupBy(own).agg(F.count("*").alias("n"), F.first(size).alias("n_words")).where((F.col("n") > 1) & (F.col("n_words") >= window))
    copied = copies.select(F.col(own).alias("key"), F.col("n_words").alias("n_removed"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), *([F.lit("").alias("kept")] if with_text else []), F.lit(1).cast("long").alias("n_paths"))
    found = copied.unionByName(cut).groupBy("key").agg(F.max(F.struct(*columns, "n_paths")).alias("_found"))
    side, told = free_name(own + "_side", base.columns), free_name("_told", base.columns)
    out = base.join(found.select(F.col("key").alias(side), F.col("_found").alias(told)), F.col(own) == F.col(side), "left")
    values = {
        "n_words": F.col(size),
        "n_removed": F.coalesce(f"{told}.n_removed", F.lit(0).cast("long")),
        "kept_sha256": F.coalesce(f"{told}.kept_sha256", digest),
        "n_paths": F.coalesce(f"{told}.n_paths", F.lit(0).cast("long")),
    }
    if with_text:
        values["kept"] = F.coalesce(f"{told}.kept", text_of(text))
    return out.select(*[F.col(f"`{c}`") for c in rest], *[e.alias(n) for n, e in values.items()])

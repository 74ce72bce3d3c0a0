"""Suffix-array dedup: bytes of 400-byte strings that start at several places.

A sparse suffix array: only the suffixes at anchors are sorted (see repeats.py),
to the right and, reversed, to the left, inside the group of runs that share an
anchor. Sorting is deep-shallow: multikey quicksort by 8-byte characters down to
a shallow depth, then a blind trie for each group that still agrees. Two windows
at one offset from their anchors are equal exactly if both the left and the
right parts lie in one interval of the sorted orders, read off the longest
common prefixes of neighbours.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import BLANK, byte_views, free_name, stored, text_key, text_of
from linewright.llm.repeats import RUN_SCHEMA, joined_ranges, repeated_runs, run_table

WINDOW = 400
ANCHOR = 48
#: A passage that repeats: so many words, made of strings of so many bytes that start elsewhere too.
PASSAGE_WORDS, PASSAGE_BYTES = 50, 200
#: Depth in bytes of the multikey quicksort.
SHALLOW = 64
#: Contents of one anchor beyond which they are dealt by what they hold around it, in SLICES ranges of offsets.
MANY_CONTENTS = 2_000
SLICES = 8
#: Bytes of contents sorted together.
BATCH = 24 << 20


def text_runs(text: bytes, key: bytes, window: int, anchor: int) -> Iterator[tuple]:
    """The runs of a text, one row for contents that repeat inside it."""
    values = np.frombuffer(text, np.uint8).astype(np.uint64) + np.uint64(1)
    if len(values) < window:
        return
    hashes, places, firsts, lasts = run_table(values, window, anchor)
    seen: dict[bytes, tuple] = {}
    more: dict[bytes, list[tuple[int, int]]] = {}
    for h, m, p, q in zip(hashes.view(np.int64).tolist(), places.tolist(), firsts.tolist(), lasts.tolist()):
        content = xxhash.xxh3_128_digest(text[p : q + window], seed=m - p)
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
            rows = []
            for key, view in zip(part.column(0).to_pylist(), byte_views(part.column(1))):
                if key in done:
                    continue
                done.add(key)
                rows.extend(text_runs(bytes(view), key, window, anchor))
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)

    return batches


def once_per_task(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, text) rows without those whose key this task has passed on before."""
    done: set[bytes] = set()
    for part in parts:
        keys = part.column(0).to_pylist()
        new = []
        for i, key in enumerate(keys):
            if key not in done:
                done.add(key)
                new.append(i)
        yield part if len(new) == len(keys) else part.take(pa.array(new, pa.int64()))


def _common(a: bytes, b: bytes) -> int:
    """Length of the common prefix, by bisection."""
    low, high = 0, min(len(a), len(b))
    if a[:high] == b[:high]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        if a[low:mid] == b[low:mid]:
            low = mid
        else:
            high = mid
    return low


def blind_trie(strings: list[bytes], members: list[int]) -> list[int]:
    """``members`` in the order of their strings.

    Inner nodes hold a depth and the byte there only; a string is compared once,
    with the leaf that a blind descent ends in. A string that ends at the depth
    takes the branch -1; equal strings share a leaf.
    """
    root: list = [members[:1]]
    for s in members[1:]:
        text = strings[s]
        node = root[0]
        while isinstance(node, tuple):
            depth, kids = node
            node = kids.get(text[depth] if depth < len(text) else -1) or next(iter(kids.values()))
        other = strings[node[0]]
        same = _common(text, other)
        if same == len(text) == len(other):
            node.append(s)
            continue
        parent, branch, node = root, 0, root[0]
        while isinstance(node, tuple) and node[0] < same:
            parent, branch = node[1], text[node[0]]
            node = parent[branch]
        edge = text[same] if same < len(text) else -1
        if isinstance(node, tuple) and node[0] == same:
            node[1][edge] = [s]
        else:
            parent[branch] = (same, {edge: [s], other[same] if same < len(other) else -1: node})
    out: list[int] = []
    todo = [root[0]]
    while todo:
        node = todo.pop()
        if isinstance(node, tuple):
            todo.extend(node[1][b] for b in sorted(node[1], reverse=True))
        else:
            out.extend(node)
    return out


def deep_shallow(groups: np.ndarray, strings: list[bytes], width: int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sorted order of (group, string), and the common prefix of each with its predecessor (-1: other group)."""
    n = len(strings)
    wide = -(-max(width, shallow) // 8) * 8
    table = np.zeros((n, wide), np.uint8)
    lengths = np.fromiter(map(len, strings), np.int64, n)
    for i, s in enumerate(strings):
        table[i, : len(s)] = np.frombuffer(s, np.uint8)
    order = np.argsort(groups, kind="stable")
    start = np.concatenate([[True], groups[order][1:] != groups[order][:-1]])
    for word in range(shallow // 8):
        class_of = np.cumsum(start)
        sizes = np.bincount(class_of, minlength=n + 1)
        open_ = np.flatnonzero(sizes[class_of] > 1)
        if not len(open_):
            break
        keys = np.ascontiguousarray(table[order[open_], 8 * word : 8 * word + 8]).view(">u8").ravel()
        by = np.lexsort((keys, class_of[open_]))
        order[open_] = order[open_][by]
        keys = keys[by]
        fresh = np.concatenate([[True], (keys[1:] != keys[:-1])])
        start[open_] |= fresh
    edges = np.append(np.flatnonzero(start), n)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b - a > 1:
            order[a:b] = blind_trie(strings, order[a:b].tolist())
    shared = np.full(n, -1, np.int64)
    for low in range(1, n, 20_000):
        high = min(low + 20_000, n)
        x, y = order[low - 1 : high - 1], order[low:high]
        unlike = table[x] != table[y]
        first = np.where(unlike.any(axis=1), unlike.argmax(axis=1), wide)
        shared[low:high] = np.where(groups[x] == groups[y], np.minimum(first, np.minimum(lengths[x], lengths[y])), -1)
    return order, shared


def repeated_offsets(groups: np.ndarray, lefts: list[bytes], rights: list[bytes], low: np.ndarray, high: np.ndarray, window: int) -> np.ndarray:
    """[i, a]: whether the window of i that starts a bytes before its anchor occurs in another member of its group.

    ``low`` and ``high`` bound the offsets of each member that are looked at.
    """
    n = len(groups)
    most = int(high.max()) + 1
    right, right_lcp = deep_shallow(groups, rights, window)
    left, left_lcp = deep_shallow(groups, [x[::-1] for x in lefts], window)
    len_l, len_r = np.fromiter(map(len, lefts), np.int64, n), np.fromiter(map(len, rights), np.int64, n)
    out = np.zeros((n, most), bool)
    class_l, class_r = np.empty(n, np.int64), np.empty(n, np.int64)
    for a in range(most):
        fits = np.flatnonzero((low <= a) & (high >= a) & (len_l >= a) & (len_r >= window - a))
        if len(fits) < 2:
            continue
        class_r[right] = np.cumsum(right_lcp < window - a)
        class_l[left] = np.cumsum(left_lcp < a)
        codes = class_r[fits] * (n + 1) + class_l[fits]
        by = np.argsort(codes, kind="stable")
        same = codes[by][1:] == codes[by][:-1]
        hit = np.zeros(len(fits), bool)
        hit[by[1:][same]] = True
        hit[by[:-1][same]] = True
        out[fits, a] = hit
    return out


def _pieces(window: int, many: int):
    """Rows (key, text, runs of one text) -> the bytes of the runs, dealt by anchor."""
    width = max(1, window // SLICES)
    schema = pa.schema([("deal", pa.int64()), ("bytes", pa.binary()), ("place", pa.int32()), ("low", pa.int32()), ("high", pa.int32()), ("key", pa.binary()), ("at", pa.int32()), ("known", pa.bool_())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows = []
            for key, view, runs in zip(part.column(0).to_pylist(), byte_views(part.column(1)), part.column(2).to_pylist()):
                for r in runs:
                    m, p, q = r["place"], r["first"], r["last"]
                    if r["contents"] <= many:
                        rows.append((r["anchor"], bytes(view[p : q + window]), m - p, m - q, m - p, key, m, r["repeats"]))
                        continue
                    for cut in range((m - q) // width, (m - p) // width + 1):
                        low, high = max(m - q, cut * width), min(m - p, cut * width + width - 1)
                        core = bytes(view[m - cut * width : m + window - cut * width - width + 1])
                        deal = xxhash.xxh64_intdigest(core, seed=cut) - (1 << 63)
                        rows.append((deal, bytes(view[m - high : m - low + window]), high, low, high, key, m, r["repeats"]))
                if len(rows) > 20_000:
                    yield _table(rows, schema)
                    rows = []
            yield _table(rows, schema)

    return batches


def _table(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _compare(window: int):
    """Pieces sorted by deal -> ranges (key, start, end) of repeated windows, for contents that do not repeat whole."""
    schema = pa.schema([("key", pa.binary()), ("start", pa.int32()), ("end", pa.int32())])

    def solve(rows: list[tuple]) -> Iterator[tuple]:
        unique = {}
        for r in rows:
            unique[(r[0], r[1], r[2], *((r[5], r[6]) if not r[7] else ()))] = r
        rows = list(unique.values())
        if len(rows) < 2:
            return
        groups = np.array([r[0] for r in rows], np.int64)
        low, high = np.array([r[3] for r in rows]), np.array([r[4] for r in rows])
        hits = repeated_offsets(groups, [r[1][: r[2]] for r in rows], [r[1][r[2] :] for r in rows], low, high, window)
        for i in np.flatnonzero(hits.any(axis=1)).tolist():
            if rows[i][7]:
                continue
            edge = np.flatnonzero(np.diff(np.concatenate([[False], hits[i], [False]]).astype(np.int8)))
            at, key = rows[i][6], rows[i][5]
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist()):
                yield key, at - (b - 1), at - a + window

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0
        for part in parts:
            for row in zip(*(part.column(c).to_pylist() for c in range(part.num_columns))):
                if size > BATCH and row[0] != held[-1][0]:
                    yield _table(list(solve(held)), schema)
                    held, size = [], 0
                held.append(row)
                size += len(row[1])
        yield _table(list(solve(held)), schema)

    return batches


def _cut(least_words: int):
    """(key, text, ranges) -> what is left of the text."""

    def cut(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _cut_batches(parts, least_words)

    return cut


def _cut_batches(parts: Iterator[pa.RecordBatch], least_words: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("key", pa.binary()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string()), ("spans", pa.list_(pa.list_(pa.int32())))])
    for part in parts:
        rows, size = [], 0
        for key, view, flat in zip(part.column(0).to_pylist(), byte_views(part.column(1)), part.column(2).to_pylist()):
            spans = joined_ranges([(r["start"], r["end"]) for r in flat])
            if least_words:
                spans = [(a, b) for a, b in spans if len(bytes(view[a:b]).split()) >= least_words]
            edges = [0, *(x for s in spans for x in s), len(view)]
            kept = b"".join(view[a:b] for a, b in zip(edges[::2], edges[1::2]))
            rows.append((key, len(view) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(), kept.decode("utf-8", "ignore"), [list(s) for s in spans]))
            size += len(kept)
            if size > BATCH:
                yield _table(rows, schema)
                rows, size = [], 0
        yield _table(rows, schema)


def _passages(least_words: int, window: int):
    """(key, text, ranges) -> passages of so many words, and the text if some range holds a whole window."""
    schema = pa.schema([("key", pa.binary()), ("passage_bytes", pa.int64()), ("n_passages", pa.int64()), ("body", pa.binary())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            rows, size = [], 0
            for key, view, flat in zip(part.column(0).to_pylist(), byte_views(part.column(1)), part.column(2).to_pylist()):
                spans = joined_ranges([(r["start"], r["end"]) for r in flat])
                body = bytes(view) if any(b - a >= window for a, b in spans) else None
                spans = [(a, b) for a, b in spans if len(bytes(view[a:b]).split()) >= least_words]
                rows.append((key, sum(b - a for a, b in spans), len(spans), body))
                size += len(body or b"")
                if size > BATCH:
                    yield _table(rows, schema)
                    rows, size = [], 0
            yield _table(rows, schema)

    return batches


def once_each(docs: DataFrame, text: str) -> DataFrame:
    """key, body: the texts, each at most once for a task (which bounds the copies of a hot one)."""
    return docs.select(text_key(text).alias("key"), text_of(text).alias("body")).mapInArrow(once_per_task, "key binary, body string")


def repeated_spans(docs: DataFrame, *, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, many: int = MANY_CONTENTS, bodies: DataFrame | None = None) -> DataFrame:
    """key (of a text), start, end: byte ranges covered by a ``window``-byte string that also starts elsewhere.

    Ranges may overlap. Copies of one text count as one place here; a text that
    is there several times repeats as a whole (see ``without_repeats``).
    """
    bodies = once_each(docs, text) if bodies is None else bodies
    keyed = docs.select(text_key(text).alias("key"), text_of(text).alias("body"))
    runs = keyed.where(F.octet_length("body") >= window).mapInArrow(_run_batches(window, anchor), RUN_SCHEMA)
    tagged = repeated_runs(runs)
    whole = tagged.where("repeats")
    known = whole.select("key", F.col("first").alias("start"), (F.col("last") + window).alias("end"))
    step = F.expr("explode(transform(sequence(0, size(again) div 2 - 1), i -> struct(again[2 * i] AS start, again[2 * i + 1] AS end)))")
    inside = whole.where("again is not null").select("key", step.alias("r")).select("key", "r.start", "r.end")
    part = (
        tagged.where("contents > 1 and shown")
        .groupBy("key")
        .agg(F.collect_list(F.struct("anchor", "place", "first", "last", "contents", "repeats")).alias("runs"))
    )
    pieces = bodies.join(part, "key").mapInArrow(_pieces(window, many), "deal long, bytes binary, place int, low int, high int, key binary, at int, known boolean")
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = pieces.repartition(spread, "deal").sortWithinPartitions("deal").mapInArrow(_compare(window), "key binary, start int, end int")
    return known.union(inside).union(found)


def _listed(ranges: DataFrame) -> DataFrame:
    return ranges.groupBy("key").agg(F.collect_list(F.struct("start", "end")).alias("ranges"))


def without_repeats(
    docs: DataFrame, *, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, many: int = MANY_CONTENTS, with_text: bool = False, least_words: int = 0, passages: tuple[int, int] | None = None
) -> DataFrame:
    """``docs`` with n_bytes, n_removed, n_spans, kept_sha256 (and ``kept``, the text left, if asked for).

    Removes every byte covered by a ``window``-byte string that also starts
    anywhere else, in this document or another; judged on the input. Null texts
    count as empty; repeated rows are copies of each other; texts shorter than
    the window keep everything; an empty table stays empty. The digest is of all
    bytes left; ``kept`` leaves out what a cut leaves of a multi-byte character.
    Columns of ``docs`` with the names of results are replaced. With ``least_words``
    only removed runs of so many blank-separated words (cut ones counted) go.

    ``passages``, (words, bytes), adds n_passages and passage_bytes: the maximal runs
    of so many words or more that consist of strings of so many bytes, at most
    ``window``, that start elsewhere too. They are counted, not removed. Each string
    of ``window`` bytes that repeats lies in such a run of any number of words, so
    only texts with a run of that length are searched for the longer strings then.
    """
    bodies = searched = once_each(docs, text)
    words, least_bytes = passages or (least_words, window)
    if passages:
        runs = _listed(repeated_spans(docs, text=text, window=least_bytes, anchor=anchor, many=many, bodies=bodies))
        noted = stored(bodies.join(runs, "key").mapInArrow(_passages(words, window), "key binary, passage_bytes long, n_passages long, body binary"), "passages")
        searched = noted.where("body is not null").select("key", F.col("body").cast("string").alias("body"))
        lists = _listed(repeated_spans(searched, text="body", window=window, anchor=anchor, many=many, bodies=searched))
    else:
        lists = _listed(repeated_spans(docs, text=text, window=window, anchor=anchor, many=many, bodies=bodies))
    columns = ["n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])]
    counts = ["passage_bytes", "n_passages"] if passages else []
    cut = (
        searched.join(lists, "key")
        .mapInArrow(_cut(least_words), "key binary, n_removed long, n_spans long, kept_sha256 string, kept string, spans array<array<int>>")
        .groupBy("key")
        .agg(*[F.min(c).alias(c) for c in columns])
    )
    results = {"n_bytes", *columns, *counts}
    own, size, digest, count = (free_name(n, docs.columns) for n in ("suffix_key", "suffix_size", "suffix_digest", "suffix_words"))
    body = text_of(text)
    base = docs.withColumns({own: text_key(text), size: F.octet_length(body).cast("long"), digest: F.sha2(body, 256)})
    base = base.withColumn(count, F.size(F.filter(F.split(body, BLANK), lambda w: w != "")) if words else F.lit(0))
    copies = base.groupBy(own).agg(F.count("*").alias("n"), F.first(size).alias("size"), F.first(count).alias("words")).where("n > 1")
    copied = copies.where((F.col("size") >= window) & (F.col("words") >= least_words))
    copied = copied.select(F.col(own).alias("key"), F.col("size").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.lit(hashlib.sha256(b"").hexdigest()).alias("kept_sha256"), *([F.lit("").alias("kept")] if with_text else []))
    found = copied.unionByName(cut)
    if passages:
        whole = copies.where((F.col("size") >= least_bytes) & (F.col("words") >= words))
        whole = whole.select(F.col(own).alias("key"), F.col("size").alias("passage_bytes"), F.lit(1).cast("long").alias("n_passages"))
        found = found.unionByName(whole.unionByName(noted.drop("body")), allowMissingColumns=True)
    # Both may know a text that is there twice; the whole removal has the larger count.
    side, told, seen = free_name(own + "_side", base.columns), free_name("_told", base.columns), free_name("_seen", base.columns)
    found = found.groupBy("key").agg(F.max(F.struct(*columns)).alias(told), *([F.max(F.struct(*counts)).alias(seen)] if passages else []))
    joined = base.join(found.withColumnRenamed("key", side), F.col(own) == F.col(side), "left")
    values = {
        "n_bytes": F.col(size),
        "n_removed": F.coalesce(f"{told}.n_removed", F.lit(0).cast("long")),
        "n_spans": F.coalesce(f"{told}.n_spans", F.lit(0).cast("long")),
        "kept_sha256": F.coalesce(f"{told}.kept_sha256", digest),
    }
    if with_text:
        values["kept"] = F.coalesce(f"{told}.kept", body)
    for c in counts:
        values[c] = F.coalesce(f"{seen}.{c}", F.lit(0).cast("long"))
    names = [c for c in docs.columns if c.lower() not in results]
    return joined.select(*[F.col(f"`{c}`") for c in names], *[e.alias(n) for n, e in values.items()])

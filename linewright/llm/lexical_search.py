"""Ranked lexical search over bit-sliced Bloom signatures.

Documents of like size lie in blocks. A block keeps one Bloom filter for each
document, stored crosswise: slice j is a bitmap of the documents that have bit j.
A document enters each of its terms, and again for every level of the term's
count that it reaches (2, 3, 5, 9, ...). The bitmaps of a term's hash places,
and-ed, name all documents that have the term (and a few others) and, level by
level, an upper bound of its count; sums of the level bitmaps weighted by the
terms' weights bound every document's score from above. The documents of the
highest bounds are scored exactly first: an item's kth score among them is a floor
under its true kth score. Every document whose bound reaches that floor is then
scored exactly on its text; all others are proved to lie below.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from linewright.llm.common import byte_views, spaced_words, stored, text_of

#: Bits of a filter for each entry that its size class may have, and hash places of an entry.
BITS, PLACES = 8, 3
#: Most documents, and most packed bytes, of one block.
BLOCK_ROWS, BLOCK_BYTES = 2048, 1 << 22
#: Levels of a count: level 0 is one occurrence, level i up to 2**i, the last one has no end.
LEVELS = 16
ITEMS_PER_PACK = 256
#: Up to so many flags and weights a level is summed by one matrix product, beyond item by item.
DENSE_FLAGS, DENSE_WEIGHTS = 1 << 19, 1 << 22
#: So many times k documents of the highest bounds are scored to find the floor.
PROBES = 2
#: Up to so many terms of the items are sent to all tasks (about 40 MB, with their weights); beyond, the counts of all terms are joined, and packs meet blocks by shuffle.
VOCABULARY = 1_000_000
#: Up to so many candidate keys (8 bytes each) are broadcast to thin the documents before the join, and up to so many pairs so that no text is shuffled.
BROADCAST_KEYS = 2_000_000
#: Distinct terms that a task counts before it passes them on.
COUNTED_TERMS = 200_000

#: Upper case to lower case, everything that is no part of a term to a blank.
_TO_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_STEPS = np.array([0x9E3779B97F4A7C15 * (i + 1) % (1 << 64) for i in range(LEVELS)], np.uint64)

SIGNATURES = "slices int, keys array<long>, sizes array<long>, bits binary, terms array<binary>, counts array<long>"


def terms_of(text: bytes | memoryview) -> list[bytes]:
    """The terms of a UTF-8 text: maximal runs of digits, letters and everything beyond ASCII, A-Z in lower case."""
    return bytes(text).translate(_TO_TERMS).split()


def places(hashes: np.ndarray, level: int, slices: int) -> np.ndarray:
    """The slices of entries (term hash, level): one row for each entry, PLACES columns."""
    h = (hashes ^ _STEPS[level]) * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    step = (h >> np.uint64(17)) | np.uint64(1)
    return ((h[:, None] + step[:, None] * np.arange(PLACES, dtype=np.uint64)) & np.uint64(slices - 1)).astype(np.int64)


def term_hashes(terms: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, terms), np.uint64, len(terms))


def level_start(level: int) -> int:
    """The smallest count on a level."""
    return 1 if level == 0 else (1 << (level - 1)) + 1


class Shelf:
    """Documents of one size class, gathered until they fill a block."""

    def __init__(self, slices: int) -> None:
        self.slices = slices
        self.most = min(BLOCK_ROWS, max(8, BLOCK_BYTES * 8 // slices))
        self.keys: list[int] = []
        self.sizes: list[int] = []
        self.bits: list[np.ndarray] = []

    def add(self, key: int, size: int, hashes: np.ndarray, counts: np.ndarray) -> bool:
        """Whether the block is full now."""
        found = []
        for level in range(LEVELS):
            reached = hashes if level == 0 else hashes[counts >= level_start(level)]
            if not len(reached):
                break
            found.append(places(reached, level, self.slices).ravel())
        self.keys.append(key)
        self.sizes.append(size)
        self.bits.append(np.concatenate(found))
        return len(self.keys) >= self.most

    def block(self) -> tuple:
        """The block's row, after which the shelf is empty."""
        rows = np.repeat(np.arange(len(self.keys)), [len(b) for b in self.bits])
        whole = np.zeros((self.slices, len(self.keys)), bool)
        whole[np.concatenate(self.bits), rows] = True
        made = self.slices, self.keys, self.sizes, np.packbits(whole, axis=1).tobytes(), None, None
        self.keys, self.sizes, self.bits = [], [], []
        return made


def _signatures(vocabulary: frozenset[bytes] | None):
    schema = pa.schema([("slices", pa.int32()), ("keys", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("bits", pa.binary()), ("terms", pa.list_(pa.binary())), ("counts", pa.list_(pa.int64()))])

    def row(values: tuple) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

    def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks of signatures, and in rows of their own the number of documents of every term asked for."""
        shelves: dict[int, Shelf] = {}
        documents: Counter = Counter()
        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), byte_views(batch.column(1))):
                found = Counter(terms_of(text))
                if not found:
                    continue
                documents.update(found.keys() if vocabulary is None else found.keys() & vocabulary)
                terms = list(found)
                counts = np.fromiter(found.values(), np.int64, len(found))
                entries = len(terms) + sum(int((counts >= level_start(level)).sum()) for level in range(1, LEVELS))
                slices = BITS << (entries - 1).bit_length()
                shelf = shelves.setdefault(slices, Shelf(slices))
                if shelf.add(key, int(counts.sum()), term_hashes(terms), counts):
                    yield row(shelf.block())
                if len(documents) > COUNTED_TERMS:
                    yield row((None, None, None, None, list(documents), list(documents.values())))
                    documents = Counter()
        for shelf in shelves.values():
            if shelf.keys:
                yield row(shelf.block())
        if documents:
            yield row((None, None, None, None, list(documents), list(documents.values())))

    return signatures


def normaliser(size: int, documents: int, terms: int) -> int:
    return 25 + 75 * size * documents // terms


def share(count: int, m: int) -> int:
    """What one unit of weight gives for ``count`` occurrences in a document of normaliser ``m``."""
    return 1_000_000_000 * count // (1000 * count + 8 * m)


class Pack:
    """Items with their weighted terms: ``offsets`` cut ``terms`` and ``weights`` item by item."""

    def __init__(self, items: np.ndarray, offsets: np.ndarray, terms: list[bytes], weights: np.ndarray) -> None:
        self.items = items
        number = {t: i for i, t in enumerate(dict.fromkeys(terms))}
        self.hashes = term_hashes(list(number))
        # One entry for each term of each item: its item's place, its term's place, its weight.
        self.terms = np.array([number[t] for t in terms], np.int64)
        self.owners = np.repeat(np.arange(len(items)), np.diff(offsets))
        self.weights = weights.astype(np.float32)
        self.cuts = offsets

    def bounds(self, slices: int, sizes: list[int], bits: bytes, documents: int, terms: int) -> np.ndarray:
        """No document's score for an item exceeds its value here: one row for each item, one column for each document."""
        count = len(sizes)
        m = np.array([normaliser(n, documents, terms) for n in sizes], np.float64)
        held = np.frombuffer(bits, np.uint8).reshape(slices, -1)
        total = np.zeros((len(self.items), count))
        present, before = None, np.zeros(count)
        alive = np.arange(len(self.hashes))
        for level in range(LEVELS):
            maps = np.bitwise_and.reduce(held[places(self.hashes[alive], level, slices)], axis=1)
            if present is not None:
                maps &= present
            some = maps.any(axis=1)
            alive, present = alive[some], maps[some]
            if not len(alive):
                break
            most = np.minimum(np.full(count, 1 << level if level < LEVELS - 1 else 1 << 62, np.float64), np.array(sizes, np.float64))
            # The real quotient, a little raised, is above its floor.
            upto = 1e9 * most / (1000 * most + 8 * m) * (1 + 1e-9)
            total += self.weighted(alive, np.unpackbits(present, axis=1, count=count)) * (upto - before)
            before = upto
        # Sums in float32 of at most that many positive numbers are off by no more than this factor.
        return total * (1 + 2.0**-22 * (4 + np.diff(self.cuts)))[:, None]

    def weighted(self, alive: np.ndarray, flags: np.ndarray) -> np.ndarray:
        """Sums of the items' weights over the terms ``alive``, for the documents flagged for them."""
        where = np.full(len(self.hashes), -1)
        where[alive] = np.arange(len(alive))
        rows = where[self.terms]
        if flags.size <= DENSE_FLAGS and len(self.items) * len(alive) <= DENSE_WEIGHTS:
            used = rows >= 0
            matrix = np.zeros((len(self.items), len(alive)), np.float32)
            matrix[self.owners[used], rows[used]] = self.weights[used]
            return matrix @ flags.astype(np.float32)
        out = np.zeros((len(self.items), flags.shape[1]), np.float32)
        for i, (start, end) in enumerate(zip(self.cuts[:-1], self.cuts[1:])):
            own = rows[start:end]
            used = own >= 0
            if used.any():
                out[i] = self.weights[start:end][used] @ flags[own[used]].astype(np.float32)
        return out


def _pack_of(batch: pa.RecordBatch, i: int, cache: dict) -> Pack:
    """The pack in columns 0 to 4 (number, items, lengths, terms, weights), the last one kept."""
    number = batch.column(0)[i].as_py()
    if cache.get("of") != number:
        items, lengths, weights = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (1, 2, 4))
        terms = [bytes(v) for v in byte_views(batch.column(3)[i].values)]
        cache["of"], cache["pack"] = number, Pack(items, np.concatenate([[0], np.cumsum(lengths)]), terms, weights)
        cache["floors"] = batch.column(5)[i].values.to_numpy(zero_copy_only=False)
    return cache["pack"]


def _blocks_in(batches: Iterator[pa.RecordBatch], documents: int, terms: int) -> Iterator[tuple]:
    """(pack, floors, keys, bounds) of every row: a pack in columns 0 to 5, a block in 6 to 9."""
    cache: dict = {}
    for batch in batches:
        for i in range(batch.num_rows):
            pack = _pack_of(batch, i, cache)
            keys, sizes = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in (7, 8))
            yield pack, cache["floors"], keys, pack.bounds(batch.column(6)[i].as_py(), sizes.tolist(), batch.column(9)[i].as_py(), documents, terms)


def _probes(k: int, documents: int, terms: int):
    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each item's ``k`` documents of the highest bounds among the task's blocks."""
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for pack, _, keys, bounds in _blocks_in(batches, documents, terms):
            enough = np.array([held[i][0].min() if i in held and len(held[i][0]) >= k else 0.0 for i in pack.items.tolist()])
            for place in np.flatnonzero(bounds.max(axis=1, initial=0) > enough):
                item, row = int(pack.items[place]), bounds[place]
                at = np.flatnonzero(row > enough[place])
                values, found = row[at], keys[at]
                if item in held:
                    values, found = np.concatenate([held[item][0], values]), np.concatenate([held[item][1], found])
                if len(values) > k:
                    top = np.argpartition(-values, k - 1)[:k]
                    values, found = values[top], found[top]
                held[item] = values, found
        for item, (values, found) in held.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), item)), pa.array(found), pa.array(values)], names=["item", "key", "bound"])

    return probes


def _candidates(documents: int, terms: int):
    def candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Every (item, document) whose bound reaches the item's floor."""
        for pack, floors, keys, bounds in _blocks_in(batches, documents, terms):
            rows, columns = np.nonzero(bounds >= np.maximum(floors, 1)[:, None])
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(pack.items[rows]), pa.array(keys[columns])], names=["item", "key"])

    return candidates


def _scorer(documents: int, terms: int, known: Broadcast | None):
    def scores(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Exact scores of whole texts: doc_id, key, text, asked (items if their terms and weights are ``known``, else item, terms, weights)."""
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            for doc, key, text, asked in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), byte_views(batch.column(2)), batch.column(3)):
                words = terms_of(text)
                found = Counter(words)
                m = normaliser(len(words), documents, terms) if words else 1
                shares = {t: share(c, m) for t, c in found.items()}
                for one in asked.as_py():
                    item, of = (one["item"], zip(one["terms"], one["weights"])) if known is None else (one, known.value[one])
                    score = sum(w * shares[t] for t, w in of if t in shares)
                    if score > 0:
                        out.append((item, doc, key, score))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names=["item", "doc_id", "key", "score"])

    return scores


def document_key(id_column: str, text: str) -> Column:
    """64 bits of id and text. Documents that share them are scored each, so a clash costs time only."""
    return F.xxhash64(F.col(id_column).cast("long"), text_of(text))


def ranked_search(
    docs: DataFrame, items: DataFrame, *, id_column: str = "doc_id", text: str = "text", item_column: str = "item_id", item_text: str = "text", k: int = 10
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` highest-scoring documents of every item, scores above 0 only.

    Terms and scores as in ``terms_of``, ``normaliser`` and ``share``: an item's
    score of a document sums weight * share over the item's terms, repeats included,
    weight being floor(1000 * ln((2N + 2) / (2df + 1))). Equal scores are ranked by
    rising doc_id, null last.

    A null text has no terms; documents without terms are not counted and never
    found. Repeated rows of documents are documents each; rows of items equal in id
    and text are one item, items that share an id only are ranked each. Items
    without terms give no rows, and so do empty tables. Other columns are ignored.
    """
    given = items.select(F.col(item_column).alias("item_id"), text_of(item_text).alias("text")).distinct()
    asked = stored(given.select(F.monotonically_increasing_id().alias("item"), "item_id", spaced_words(F.col("text")).alias("words")).where("words <> ''"), "items")
    words = asked.select("item", F.explode(F.split("words", " ")).alias("word")).groupBy("item", F.col("word").cast("binary").alias("term")).agg(F.count("*").alias("times"))
    vocabulary = words.select("term").distinct()
    size = vocabulary.limit(VOCABULARY + 1).count()
    known = frozenset(bytes(r["term"]) for r in vocabulary.collect()) if size <= VOCABULARY else None

    texts = docs.select(F.col(id_column).cast("long").alias("doc_id"), document_key(id_column, text).alias("key"), text_of(text).alias("text"))
    kept = stored(texts.select("key", "text").mapInArrow(_signatures(known), SIGNATURES), "signatures")
    blocks = kept.where(F.col("keys").isNotNull()).select("slices", "keys", "sizes", "bits")
    summed = blocks.agg(F.sum(F.size("keys")).alias("n"), F.sum(F.aggregate("sizes", F.lit(0).cast("long"), lambda a, b: a + b)).alias("l")).first()
    n, length = summed["n"] or 0, summed["l"] or 1

    counted = kept.where(F.col("keys").isNull()).select(F.explode(F.arrays_zip("terms", "counts")).alias("t")).groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.counts").alias("df"))
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double")))
    weighted = words.join(counted, "term").select("item", "term", (F.col("times") * weight).alias("weight")).where("weight > 0")
    wanted = weighted.groupBy("item").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("of"))
    wanted = stored(wanted.select("item", F.transform("of", lambda t: t["term"]).alias("terms"), F.transform("of", lambda t: t["weight"]).alias("weights")), "wanted")
    held = wanted.agg(F.count("*").alias("items"), F.sum(F.size("terms")).alias("terms")).first()
    packs = max(1, math.ceil(held["items"] / ITEMS_PER_PACK))
    few_terms = (held["terms"] or 0) <= VOCABULARY
    known = None
    if few_terms:
        whole = {r["item"]: list(zip(map(bytes, r["terms"]), r["weights"])) for r in wanted.toLocalIterator()}
        known = docs.sparkSession.sparkContext.broadcast(whole)
    spread = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pack = F.pmod(F.xxhash64("item"), F.lit(packs)).cast("int").alias("pack")

    def against(floors: DataFrame | None) -> DataFrame:
        """Every pack of items (number, items, lengths, terms, weights, floors) beside every block."""
        rows = wanted.withColumn("floor", F.lit(0).cast("long")) if floors is None else wanted.join(floors, "item", "left").withColumn("floor", F.coalesce("floor", F.lit(0).cast("long")))
        gathered = rows.groupBy(pack).agg(F.collect_list(F.struct("item", "terms", "weights", "floor")).alias("rows"))
        flat = gathered.select(
            "pack",
            F.transform("rows", lambda r: r["item"]).alias("items"),
            F.transform("rows", lambda r: F.size(r["terms"])).alias("lengths"),
            F.flatten(F.transform("rows", lambda r: r["terms"])).alias("terms"),
            F.flatten(F.transform("rows", lambda r: r["weights"])).alias("weights"),
            F.transform("rows", lambda r: r["floor"]).alias("floors"),
        )
        dealt = blocks.withColumn("pack", F.explode(F.sequence(F.lit(0), F.lit(packs - 1))))
        if few_terms:
            both = dealt.join(F.broadcast(flat), "pack")
        else:
            # A copy of each pack for every task, so that a few packs do not gather all blocks in a few tasks.
            copies = F.explode(F.sequence(F.lit(0), F.lit(spread - 1))).alias("copy")
            both = dealt.withColumn("copy", F.pmod(F.xxhash64("keys"), F.lit(spread)).cast("int")).join(flat.select("*", copies), ["pack", "copy"])
        return both.select("pack", "items", "lengths", "terms", "weights", "floors", "slices", "keys", "sizes", "bits")

    def scored(pairs: DataFrame) -> DataFrame:
        """item, doc_id, key, score of the documents of ``pairs`` (item, key), from their whole texts."""
        if known is None:
            full = pairs.distinct().join(wanted, "item").groupBy("key", pack).agg(F.collect_list(F.struct("item", "terms", "weights")).alias("asked"))
        else:
            # A pair is two numbers; the items' terms are at the tasks already.
            full = pairs.groupBy("key").agg(F.collect_set("item").alias("asked"))
        full = stored(full, "asked")
        if known is not None and (full.agg(F.sum(F.size("asked"))).first()[0] or 0) <= BROADCAST_KEYS:
            asking = texts.join(F.broadcast(full), "key")
        else:
            keys = full.select("key").distinct()
            few = keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS
            asking = (texts.join(F.broadcast(keys), "key", "left_semi") if few else texts).join(full, "key")
        return asking.select("doc_id", "key", "text", "asked").mapInArrow(_scorer(n, length, known), "item long, doc_id long, key long, score long")

    def first(rows: DataFrame, by: str, most: int) -> DataFrame:
        order = Window.partitionBy("item").orderBy(F.col(by).desc(), *([F.col("doc_id").asc_nulls_last()] if by == "score" else []), "key")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)

    probed = first(against(None).mapInArrow(_probes(PROBES * k, n, length), "item long, key long, bound double"), "bound", PROBES * k)
    floors = first(scored(probed.select("item", "key")), "score", k).where(F.col("rank") == k).select("item", F.col("score").alias("floor"))
    pairs = against(stored(floors, "floors")).mapInArrow(_candidates(n, length), "item long, key long")
    top = first(scored(pairs), "score", k)
    return top.join(asked.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")

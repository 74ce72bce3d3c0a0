"""Language identification with error-correcting output codes.

Every language has a codeword; one binary classifier of byte trigrams (naive
Bayes over hashed trigrams) predicts each bit. Decoding weighs the loss of each
bit by how well its two sides differ, and takes the codeword of least loss. A
text is flagged ambiguous if another codeword is nearly as near, or if even the
nearest one disagrees with many bits.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linewright.llm.common import byte_views, text_of

SLOTS = 1 << 15
#: Most texts of a language to learn from.
MAX_TEXTS = 4_000
NONE = "und"
#: Trigrams looked up at once.
STRETCH = 1 << 19
SHARPNESS = 4.0

_LETTER = np.array([chr(i).isalpha() for i in range(128)] + [False] * 128)
_FOLD = np.array([i + 32 if 65 <= i <= 90 else i if _LETTER[i] or i > 127 else 32 for i in range(256)], np.uint32)


def slots(text: np.ndarray) -> np.ndarray:
    """A slot for each byte trigram; ASCII is folded to lower case, all but letters to blanks."""
    b = _FOLD[text]
    if len(b) < 3:
        b = np.concatenate([b, np.full(3 - len(b), 32, np.uint32)])
    h = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA77)) ^ (b[2:] * np.uint32(0xC2B2AE3D))
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return (h >> np.uint32(17)).astype(np.int32)


def has_letter(text: bytes) -> bool:
    """Any letter of any script."""
    return bool(_LETTER[np.frombuffer(text, np.uint8)].any()) or (not text.isascii() and any(c.isalpha() for c in text.decode("utf-8", "replace")))


def codebook(languages: int) -> np.ndarray:
    """languages x bits of +-1: all splits of few languages, else seeded random ones that differ from each other."""
    if languages <= 6:
        columns = [[1 if (i == 0 or not (m >> (i - 1)) & 1) else -1 for i in range(languages)] for m in range(1, 1 << (languages - 1))]
        return np.array(columns, np.int8).reshape(-1, languages).T
    rng = np.random.default_rng(7)
    bits = max(24, 10 * math.ceil(math.log2(languages)))
    best, gap = None, -1
    for _ in range(20):
        trial = rng.choice(np.array([-1, 1], np.int8), (languages, bits))
        trial = trial[:, np.abs(trial.sum(axis=1 - 1)) < languages]
        near = trial.astype(np.int32) @ trial.T.astype(np.int32)
        np.fill_diagonal(near, -trial.shape[1])
        apart = (trial.shape[1] - near.max()) // 2
        if apart > gap:
            best, gap = trial, apart
    return best


@dataclass
class CodeModel:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray  # slots x bits, log odds of the bit being +1, scaled by the bit's usual margin
    trust: np.ndarray  # weight of a bit's loss
    offset: np.ndarray

    def margins(self, text: np.ndarray) -> np.ndarray:
        total, count = np.zeros(self.code.shape[1]), 0
        for low in range(0, max(len(text) - 2, 1), STRETCH):
            s = slots(text[low : low + STRETCH + 2])
            total += self.weights[s].sum(axis=0, dtype=np.float64)
            count += len(s)
        return total / count + self.offset / count

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """language index, score and ambiguity of each row of margins."""
        loss = np.zeros((len(margins), len(self.languages)))
        for k in range(len(self.languages)):
            z = np.clip(margins * self.code[k], -8, 8)
            loss[:, k] = (np.log1p(np.exp(-SHARPNESS * z)) * self.trust).sum(axis=1)
        low = loss.min(axis=1, keepdims=True)
        p = np.exp(low - loss)
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        score = p[np.arange(len(p)), best]
        wrong = ((margins * self.code[best]) < 0).mean(axis=1) if self.code.shape[1] else np.zeros(len(p))
        return best, score, (score < 0.75) | (wrong > 0.3)


def learn(docs: DataFrame, *, text: str = "text", lang: str = "lang", id_column: str = "doc_id", max_texts: int = MAX_TEXTS) -> CodeModel:
    """A model from at most about ``max_texts`` texts of each language, picked by hash.

    Rows without a language or with an empty text teach nothing. Trigrams are
    counted in the tasks; counts of slots by language (bounded by their product)
    reach the driver.
    """
    known = docs.where(F.col(lang).isNotNull() & (F.length(text_of(text)) > 0)).select(F.col(lang).alias("lang"), F.xxhash64(id_column).alias("at"), text_of(text).alias("body"))
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(sizes)
    index = {x: i for i, x in enumerate(languages)}
    if not languages:
        return CodeModel([], np.zeros((0, 0), np.int8), np.zeros((SLOTS, 0), np.float32), np.zeros(0), np.zeros(0))
    share = F.lit(1_000_000)
    for x, n in sizes.items():
        if n > max_texts:
            share = F.when(F.col("lang") == x, F.lit(int(1_000_000 * max_texts / n))).otherwise(share)
    sample = known.where(F.pmod("at", F.lit(1_000_000)) < share)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for part in parts:
            for name, view in zip(part.column(0).to_pylist(), byte_views(part.column(1))):
                table = counts.setdefault(name, np.zeros(SLOTS, np.int64))
                body = np.frombuffer(view, np.uint8)
                for low in range(0, max(len(body) - 2, 1), STRETCH):
                    table += np.bincount(slots(body[low : low + STRETCH + 2]), minlength=SLOTS)
        for name, table in counts.items():
            used = np.flatnonzero(table)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(used)), pa.array(used), pa.array(table[used])], names=["lang", "slot", "n"])

    table = sample.select("lang", "body").mapInArrow(batches, "lang string, slot long, n long").groupBy("lang", "slot").agg(F.sum("n").alias("n")).toPandas()
    counts = np.zeros((len(languages), SLOTS))
    counts[table["lang"].map(index).to_numpy(int), table["slot"].to_numpy(int)] = table["n"].to_numpy(float)
    rates = (counts + 0.5) / (counts.sum(axis=1, keepdims=True) + 0.5 * SLOTS)
    code = codebook(len(languages))
    weights, trust = np.zeros((SLOTS, code.shape[1]), np.float32), np.zeros(code.shape[1])
    for b in range(code.shape[1]):
        up, down = rates[code[:, b] > 0].mean(axis=0), rates[code[:, b] < 0].mean(axis=0)
        odds = np.log(up / down)
        apart = float(((up - down) * odds).sum()) / 2
        weights[:, b] = odds / max(apart, 1e-6)
        trust[b] = apart
    trust = trust / max(trust.mean(), 1e-9) if len(trust) else trust
    return CodeModel(languages, code, weights, trust, np.zeros(code.shape[1]))


def identified(docs: DataFrame, model: CodeModel, *, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns, lang_pred, score and ambiguous for every row.

    Null texts and texts without a letter are ``und`` with score 0, and so is
    everything under a model without languages. One language: always that one,
    score 1. Repeated rows get equal results; an empty table stays empty.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            n = part.num_rows
            margins, lettered = np.zeros((n, model.code.shape[1])), np.zeros(n, bool)
            for i, view in enumerate(byte_views(part.column(part.num_columns - 1))):
                body = bytes(view)
                if model.languages and has_letter(body):
                    lettered[i] = True
                    margins[i] = model.margins(np.frombuffer(body, np.uint8))
            names, score, doubt = [NONE] * n, np.zeros(n), np.zeros(n, bool)
            if lettered.any():
                best, sure, unsure = model.decode(margins[lettered])
                for i, k in zip(np.flatnonzero(lettered).tolist(), best.tolist()):
                    names[i] = model.languages[k]
                score[lettered], doubt[lettered] = sure, unsure
            yield pa.RecordBatch.from_arrays([*part.columns[:-1], pa.array(names, pa.string()), pa.array(score), pa.array(doubt)], names=[*part.schema.names[:-1], "lang_pred", "score", "ambiguous"])

    slim = docs.select(*keep, text_of(text).alias("_language_text"))
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1]), "lang_pred string, score double, ambiguous boolean"])
    return slim.mapInArrow(batches, schema)

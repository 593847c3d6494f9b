"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1. The vector of an n-gram binds (multiplies) its letters'
vectors, each rotated by its position; a text bundles (adds) the vectors of all its n-grams, and a
language's prototype bundles its training texts. A text gets the language of the prototype
with the largest cosine. Counting first and multiplying the counts with the n-gram vectors is the same
sum with fewer operations.

Defined cases: a text that is null or has no letter gets `und` and score 0; texts of any length are
read whole, in pieces of PIECE characters that overlap by N - 1; a null lang never trains; repeated rows
count once each; without any training row all texts get `und`; an empty table gives an empty
result; a null doc_id is never held out and never trains; extra columns are ignored. Letters other than a to z share the 37 remaining
symbols by a hash, so scripts with many letters are told apart more coarsely.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Dimensions, letters of an n-gram, symbols (0: anything but letters; 1-26: a-z; the rest: other letters, hashed).
DIM, N, SYMBOLS = 1024, 3, 64
#: A language's prototype is fitted on about this many training rows, chosen by a hash of the id, or on all where it has fewer.
TRAIN_ROWS = 5_000
PIECE, BATCH = 1_000_000, 1_500_000
#: Cells of the largest matrix of counts, texts by n-grams.
CELLS = 10_000_000
UNKNOWN = "und"


def _symbols() -> np.ndarray:
    table = np.zeros(0x110000, np.uint8)
    for cp in range(0x110000):
        ch = chr(cp)
        if ch.isalpha():
            low = ord(ch.lower()[0])
            table[cp] = low - 96 if 97 <= low <= 122 else 27 + low * 2654435761 % 2**32 % (SYMBOLS - 27)
    return table


class Encoder:
    """Counts n-grams of texts and bundles their vectors."""

    def __init__(self):
        self.symbol = _symbols()
        letters = np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (SYMBOLS, DIM))
        self.at = [np.roll(letters, N - 1 - i, axis=1) for i in range(N)]

    def vectors(self, codes: np.ndarray) -> np.ndarray:
        out = np.ones((len(codes), DIM), np.int8)
        for i in range(N):
            out *= self.at[i][codes // SYMBOLS ** (N - 1 - i) % SYMBOLS]
        return out

    def grams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(text, n-gram code) of every n-gram of texts; runs of other characters count as one, and none is a gram's middle."""
        pieces = [(i, t[k : k + PIECE + N - 1]) for i, t in enumerate(texts) if t for k in range(0, max(1, len(t) - N + 1), PIECE)]
        joined = np.frombuffer("".join(f" {t} " for _, t in pieces).encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.array([i for i, _ in pieces], np.int64), [len(t) + 2 for _, t in pieces])
        s = self.symbol[joined].astype(np.int32)
        keep = np.ones(len(s), bool)
        keep[1:] = (s[1:] > 0) | (s[:-1] > 0) | (owner[1:] != owner[:-1])
        s, owner = s[keep], owner[keep]
        if len(s) < N:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        code = sum(s[i : len(s) - N + 1 + i] * SYMBOLS ** (N - 1 - i) for i in range(N))
        inside = (owner[N - 1 :] == owner[: len(owner) - N + 1]) & (s[1 : len(s) - N + 2] > 0)
        return owner[: len(inside)][inside], code[inside]

    def sum(self, code: np.ndarray) -> np.ndarray:
        """The bundle of some n-grams, in whole numbers."""
        counts = np.bincount(code, minlength=SYMBOLS**N)
        have = np.flatnonzero(counts)
        return (counts[have].astype(np.float64) @ self.vectors(have).astype(np.float32)).astype(np.int64)

    def bundle(self, texts: list[str | None]) -> np.ndarray:
        """A row for each text."""
        owner, code = self.grams(texts)
        present = np.zeros(SYMBOLS**N, bool)
        present[code] = True
        codes, column = np.flatnonzero(present), np.cumsum(present) - 1
        if len(texts) > 1 and len(texts) * len(codes) > CELLS:
            half = len(texts) // 2
            return np.concatenate([self.bundle(texts[:half]), self.bundle(texts[half:])])
        counts = np.bincount(owner * len(codes) + column[code], minlength=len(texts) * len(codes)).reshape(len(texts), len(codes))
        return counts.astype(np.float32) @ self.vectors(codes).astype(np.float32)


def _groups(texts: list[str | None]):
    return common.by_bytes(texts, [len(t or "") + 2000 for t in texts], BATCH)


def prototypes(labelled: DataFrame) -> tuple[list[str], np.ndarray]:
    """Languages and their prototypes from rows (text, lang).

    Each task adds up its texts; the sums meet by language and dimension, and the driver gets
    languages x DIM numbers, whatever the input's size.
    """

    def run(batches):
        encoder, sums = Encoder(), {}
        for b in batches:
            texts, langs = b["text"].to_pylist(), np.array(b["lang"].to_pylist())
            for i, j in _groups(texts):
                owner, code = encoder.grams(texts[i:j])
                for lang in set(langs[i:j].tolist()):
                    sums[lang] = sums.get(lang, 0) + encoder.sum(code[(langs[i:j] == lang)[owner]])
        for lang, v in sums.items():
            yield pa.RecordBatch.from_pydict({"lang": [lang] * DIM, "at": np.arange(DIM), "value": v})

    parts = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(run, "lang string, at long, value long")
    total = parts.groupBy("lang", "at").agg(F.sum("value").alias("value")).toPandas()
    if total.empty:
        return [], np.zeros((0, DIM))
    square = total.pivot(index="lang", columns="at", values="value").sort_index()
    norms = np.linalg.norm(square.to_numpy(float), axis=1, keepdims=True)
    keep = norms[:, 0] > 0
    return [str(x) for x in square.index[keep]], square.to_numpy(float)[keep] / norms[keep]


def predict(docs: DataFrame, langs: list[str], protos: np.ndarray, keep: list[str] | None = None) -> DataFrame:
    """docs (all columns or those in keep) with lang_pred and score, the cosine with the chosen prototype (0 at least)."""
    keep = [c for c in keep or docs.columns if c not in ("lang_pred", "score")]

    def run(batches):
        encoder = Encoder()
        base = protos.astype(np.float32).T
        for b in batches:
            texts = b["text"].to_pylist()
            lang, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
            for i, j in _groups(texts):
                v = encoder.bundle(texts[i:j])
                norm = np.linalg.norm(v, axis=1)
                if not len(langs):
                    continue
                cos = (v @ base) / np.maximum(norm, 1e-9)[:, None]
                for k in np.flatnonzero(norm > 0):
                    best = int(cos[k].argmax())
                    lang[i + k], score[i + k] = langs[best], min(1.0, max(0.0, float(cos[k, best])))
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(lang, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"])

    return docs.mapInArrow(run, common.schema_with(docs, keep, lang_pred="string", score="double"))


def training_rows(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Rows with a language outside the held-out fold, those of each language thinned to about `rows` by a hash of the id; rare languages keep all."""
    fit = docs.filter((common.fold(F.col("doc_id")) != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    large = fit.groupBy("lang").agg(F.count("*").alias("n")).filter(F.col("n") > rows).collect()  # a number for each frequent language
    share = F.lit(2**20)
    if large:
        shares = F.create_map(*[F.lit(x) for r in large for x in (r.lang, math.ceil(2**20 * rows / r.n))])
        share = F.coalesce(F.try_element_at(shares, F.col("lang")), share)
    return fit.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2**20)) < share)


def identified(docs: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """Every row of docs with lang_pred and score; the prototypes come from docs' own labelled rows."""
    langs, protos = prototypes(training_rows(docs, rows))
    return predict(docs, langs, protos)


def op2(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    langs, protos = prototypes(training_rows(docs))
    found = predict(docs.select("doc_id", "text"), langs, protos, ["doc_id"])
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

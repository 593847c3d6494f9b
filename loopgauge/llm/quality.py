"""Quality classifier by compression.

Two zstandard dictionaries are built from good and from bad labelled text. A text is cut into blocks of
BLOCK bytes, each block is compressed with either dictionary, and the difference of the summed sizes over the
text's bytes is its feature. A logistic curve, fitted on other labelled rows, turns it into a
probability of label 1.

Defined cases: null and empty texts have feature 0 and get the curve's value there; texts are read whole;
without labelled rows of both kinds every text gets score 0.5; several labels for a document count
each; null labels and null ids never train; an empty table gives an empty result.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

BLOCK, LEVEL, DICT_BYTES = 512, 3, 256 * 1024
#: Labelled rows of each class that the dictionaries and the curve are fitted on, at most, and blocks of those rows' texts that make a dictionary, at most:
#: drawn by hash from all their blocks, so every part of a text counts alike.
DICT_ROWS, CURVE_ROWS, DICT_BLOCKS = 2500, 4000, 10_000
THRESHOLD = 0.7


def blocks(text: str | None) -> list[bytes]:
    data = (text or "").encode("utf-8", "replace")
    return [data[i : i + BLOCK] for i in range(0, len(data), BLOCK)]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary, or the samples themselves (the last DICT_BYTES of them) where they are too few to train on."""
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICT_BYTES:]


class Sizes:
    def __init__(self, good: bytes, bad: bytes):
        self.coders = []
        for raw in (good, bad):
            d = zstandard.ZstdCompressionDict(raw)
            d.precompute_compress(level=LEVEL)
            self.coders.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def feature(self, text: str | None) -> float:
        """Positive: the good dictionary compresses the text better."""
        parts = blocks(text)
        if not parts:
            return 0.0
        good, bad = (sum(len(c.compress(p)) for p in parts) for c in self.coders)
        return (bad - good) / sum(map(len, parts))


def with_feature(docs: DataFrame, good: bytes, bad: bytes) -> DataFrame:
    keep = [c for c in docs.columns if c != "text"]

    def run(batches):
        sizes = Sizes(good, bad)
        for b in batches:
            x = [sizes.feature(t) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b[c] for c in keep), pa.array(x, pa.float64())], [*keep, "feature"])

    return docs.mapInArrow(run, common.schema_with(docs, keep, feature="double"))


def labelled_ids(labels: DataFrame, salt: int, rows: int) -> DataFrame:
    """At most `rows` rows (doc_id, quality) of each class outside the held-out fold; salt 0 and 1 give disjoint halves."""
    x = labels.filter((common.fold(F.col("doc_id")) != 2) & F.col("quality").isin(0, 1)).select("doc_id", "quality")
    x = x.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == salt).withColumn("h", F.xxhash64(F.lit(salt), "doc_id"))
    both = [x.filter(F.col("quality") == q).orderBy("h", "doc_id").limit(rows) for q in (0, 1)]
    return both[0].union(both[1]).select("doc_id", "quality")


def fit_curve(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Logistic regression of y on x with classes of equal weight and a small ridge, by Newton's method."""
    if not len(x) or y.min() == y.max():
        return 0.0, 0.0
    weight = np.where(y == 1, 0.5 / (y == 1).mean(), 0.5 / (y == 0).mean())
    scale = x.std() or 1.0
    design, beta = np.stack([np.ones_like(x), x / scale], axis=1), np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        grad = design.T @ (weight * (y - p)) - 1e-2 * beta
        hess = (design * (weight * p * (1 - p))[:, None]).T @ design + 1e-2 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-9:
            break
    return float(beta[0]), float(beta[1] / scale)


def fit(docs: DataFrame, labels: DataFrame) -> tuple[bytes, bytes, float, float] | None:
    """Dictionaries and curve from bounded samples of labelled rows."""
    chosen = docs.select("doc_id", "text").join(F.broadcast(labelled_ids(labels, 0, DICT_ROWS)), "doc_id").filter(F.length("text") > 0)
    data = chosen.select("doc_id", "quality", F.encode("text", "UTF-8").alias("data"))
    parts = data.select("doc_id", "quality", "data", F.explode(F.sequence(F.lit(0), F.expr(f"CAST((length(data) - 1) div {BLOCK} AS INT)"))).alias("i"))
    blocks = parts.select("doc_id", "quality", "i", F.expr(f"substring(data, i * {BLOCK} + 1, {BLOCK})").alias("data")).withColumn("h", F.xxhash64("doc_id", "i"))
    by = {q: [bytes(r.data) for r in blocks.filter(F.col("quality") == q).orderBy("h", "doc_id", "i", "data").limit(DICT_BLOCKS).collect()] for q in (0, 1)}
    if not by[0] or not by[1]:
        return None
    good, bad = build_dictionary(by[1]), build_dictionary(by[0])
    scored = with_feature(docs.select("doc_id", "text").join(F.broadcast(labelled_ids(labels, 1, CURVE_ROWS)), "doc_id"), good, bad).withColumn("h", F.xxhash64("doc_id"))
    # limited once more: an id may stand in any number of rows
    rows = [r for q in (0, 1) for r in scored.filter(F.col("quality") == q).orderBy("h", "doc_id", "feature").limit(CURVE_ROWS).select("feature", "quality").collect()]
    a, b = fit_curve(np.array([r.feature for r in rows]), np.array([r.quality for r in rows]))
    return good, bad, a, b


def scored(docs: DataFrame, model: tuple[bytes, bytes, float, float] | None) -> DataFrame:
    """docs without text, with feature and score."""
    if model is None:
        return docs.drop("text").withColumn("feature", F.lit(0.0)).withColumn("score", F.lit(0.5))
    good, bad, a, b = model
    return with_feature(docs, good, bad).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-60.0), F.least(F.lit(60.0), F.lit(a) + F.lit(b) * F.col("feature"))))))


def op1(spark, sf_dir: str) -> DataFrame:
    docs, labels = common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels")
    found = scored(docs.select("doc_id", "text"), fit(docs, labels))
    return found.select("doc_id", common.held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"), "feature")

"""Benchmark decontamination by latent semantic retrieval.

Benchmark items are cut into passages of WINDOW words. Their TF-IDF rows (document frequencies are counted over
all documents) get a randomised SVD: tasks multiply their rows with a random matrix, small Gram and projection matrices meet
on the driver. Every window of every document is projected into the same latent space and
compared with all benchmark passages by cosine; candidates are checked by their longest common subsequence of
words with the passage and by whether the passage's answer, the weighted words of its last third, occurs nearby.

Words in more than COMMON of the documents have no weight, unless a passage would keep fewer than FEW weighted words: then all of its words
are weighed, so that passages that stand in very many documents, and those of small tables, can be found. Verbatim copies do not depend
on the latent search: each passage's rarest word is looked up in the documents and the words around it are compared.

The benchmark is a stated query set. Document frequencies of its words come from one read of the documents. Then it is handled in blocks of about BLOCK passages,
each with its own decomposition and one more read, so what a task holds of it is bounded: BLOCK x WINDOW words and as many vectors of RANK numbers at most.

Defined cases: null and empty texts match nothing; an item without words is ignored; texts are read whole, in windows that
overlap by half; items or rows that repeat give one finding for each pair of ids; null ids are carried as nulls; an empty table
on either side gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Words of a block of text; a window is two blocks. Passages of the benchmark that are searched at a time.
STEP, BLOCK = 24, 2048
WINDOW = 2 * STEP
#: Latent dimensions and further random directions.
RANK, OVER = 128, 32
#: Words in more than this share of documents carry no weight.
COMMON = 0.2
#: A passage with fewer different weighted words than this has all its words weighed.
FEW = 8
#: Smallest cosine of a candidate, and smallest share of the passage's length that the window reaches in its direction:
#: without it, any window with a single weighted word would point somewhere.
COSINE, REACH = 0.3, 0.3
#: Shares of a passage's words in common order and of its answer that make a finding.
OVERLAP, ANSWER = 0.7, 0.5
#: Weighted words whose vectors a task adds up at a time.
HITS = 60_000

_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").translate(_WORDS).split()


def passages_of(words: list[bytes]) -> list[list[bytes]]:
    """Windows of WINDOW words at every STEP, the last one full where there are enough words."""
    if len(words) <= WINDOW:
        return [words] if words else []
    return [words[min(i, len(words) - WINDOW) :][:WINDOW] for i in range(0, len(words) - STEP, STEP)]


def common_subsequence(a: list[bytes], b: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit of a machine integer for each word of a."""
    at: dict[bytes, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for w in b:
        if m := at.get(w):
            x = row & m
            row = (row + x | row - x) & full
    return len(a) - row.bit_count()


@dataclass
class Model:
    """What a task holds: passages of one block, the weighted words' vectors and the passages' unit vectors."""

    items: list
    passages: list[list[bytes]]
    answers: list[set[bytes]]
    index: dict[bytes, int]
    vectors: np.ndarray
    latent: np.ndarray
    lengths: np.ndarray
    anchors: dict[bytes, list[tuple[int, int]]]


def document_frequencies(docs: DataFrame, vocabulary: list[bytes]) -> tuple[np.ndarray, int]:
    """In how many documents each word occurs, and the number of documents: over all of them."""
    known = docs.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(vocabulary)})

    def run(batches):
        index, counts, n = known.value, np.zeros(len(known.value) + 1, np.int64), 0
        for b in batches:
            for text in b["text"].to_pylist():
                got = index.keys() & set(words_of(text))
                counts[[index[w] for w in got]] += 1
                counts[-1] += 1
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(counts[at], pa.int64())], ["at", "n"])

    rows = docs.select("text").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(len(vocabulary) + 1, np.int64)
    for r in rows:
        df[r["at"]] = r["n"]
    return df[:-1], int(df[-1])


def randomised_svd(rows: DataFrame, width: int, rank: int = RANK, over: int = OVER) -> np.ndarray:
    """Right singular vectors (width x rank) of a sparse matrix with rows (at array<int>, weight array<double>).

    Range finder with one power iteration. Tasks return products of their rows with small matrices:
    (rank + over) x width numbers each; the matrix itself stays distributed.
    """
    p = min(rank + over, width)
    sc = rows.sparkSession.sparkContext

    def product(left: np.ndarray) -> np.ndarray:
        """A'A left, added up over the tasks."""
        held = sc.broadcast(left)

        def run(batches):
            total = np.zeros(held.value.shape)
            for b in batches:
                for at, w in zip(b["at"].to_pylist(), b["weight"].to_pylist(), strict=True):
                    if at:
                        w = np.array(w)
                        total[at] += w[:, None] * (w @ held.value[at])
            yield pa.RecordBatch.from_pydict({"part": [total.tobytes()]})

        parts = rows.mapInArrow(run, "part binary").toLocalIterator()
        return sum(np.frombuffer(r.part).reshape(left.shape) for r in parts)

    basis = np.linalg.qr(product(np.random.default_rng(11).standard_normal((width, p))))[0]
    basis = np.linalg.qr(product(basis))[0]
    values, turn = np.linalg.eigh(basis.T @ product(basis))
    keep = np.argsort(-values)[:rank]
    return basis @ turn[:, keep[values[keep] > 1e-9]]


def weighted_rows(passages: DataFrame, index: dict[bytes, int], idf: np.ndarray) -> DataFrame:
    """(at, weight): the TF-IDF rows of passages (words), of length one."""
    held = passages.sparkSession.sparkContext.broadcast((index, idf))

    def run(batches):
        at_of, weights = held.value
        for b in batches:
            rows = []
            for words in b["words"].to_pylist():
                at, tf = np.unique(np.array([at_of[w] for w in words.split(b" ") if w in at_of], np.int64), return_counts=True)
                w = tf * weights[at]
                rows.append((at.tolist(), (w / (np.linalg.norm(w) or 1)).tolist()))
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.list_(pa.float64()))], ["at", "weight"])

    return passages.select("words").mapInArrow(run, "at array<int>, weight array<double>")


def fit(passages: DataFrame, frequency: dict[bytes, int], n: int) -> Model:
    """The model of one block of passages (item_id, n, words), with the number of documents and those that hold each word."""
    bench = [(r.item_id, bytes(r.words).split(b" ")) for r in passages.orderBy("item_id", "n").collect()]
    vocabulary = sorted({w for _, p in bench for w in p})
    df = np.array([frequency[w] for w in vocabulary], np.int64)
    idf = np.where(df <= COMMON * n, np.log((1 + n) / (1 + df)), 0.0)
    at_of = {w: i for i, w in enumerate(vocabulary)}
    every = [sorted({at_of[w] for w in p}) for _, p in bench]
    thin = sorted({i for at in every if (idf[at] > 0).sum() < FEW for i in at})
    idf[thin] = np.where(idf[thin] > 0, idf[thin], np.log1p(n / np.maximum(df[thin], 1)))
    kept = np.flatnonzero(idf > 0)
    index, idf = {vocabulary[i]: k for k, i in enumerate(kept)}, idf[kept]
    basis = randomised_svd(common.stored(weighted_rows(passages, index, idf), "tfidf-rows"), len(index))
    vectors = (basis * idf[:, None]).astype(np.float32)
    latent = np.array([sum((vectors[index[w]] for w in p if w in index), np.zeros(vectors.shape[1], np.float32)) for _, p in bench])
    lengths = np.maximum(np.linalg.norm(latent, axis=1), 1e-9).astype(np.float32)
    latent /= lengths[:, None]
    answers = [{w for w in p[2 * len(p) // 3 :] if w in index} or {w for w in p if w in index} for _, p in bench]
    anchors: dict[bytes, list[tuple[int, int]]] = {}
    for k, (_, p) in enumerate(bench):
        first = min(range(len(p)), key=lambda i: (df[at_of[p[i]]], i))
        anchors.setdefault(p[first], []).append((k, first))
    return Model([i for i, _ in bench], [p for _, p in bench], answers, index, vectors, latent, lengths, anchors)


def verbatim(model: Model, words: list[bytes]) -> set[int]:
    """The passages whose words stand in words, one after the other."""
    found: set[int] = set()
    for i, w in enumerate(words):
        for k, before in model.anchors.get(w, ()):
            if i >= before and k not in found and words[i - before : i - before + len(model.passages[k])] == model.passages[k]:
                found.add(k)
    return found


def candidates(model: Model, texts: list[list[bytes]]):
    """(text, block, passage, cosine) of the windows whose cosine reaches COSINE; a window is blocks block and block + 1."""
    ids, owner = [], []
    base, first_block = 0, []
    for words in texts:
        got = [(i, model.index[w]) for i, w in enumerate(words) if w in model.index]
        first_block.append(base)
        ids += [k for _, k in got]
        owner += [base + i // STEP for i, _ in got]
        base += len(words) // STEP + 2  # a block of its own between texts
    if not ids:
        return
    ids, owner = np.array(ids), np.array(owner)
    starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    used, sums = owner[starts], np.add.reduceat(model.vectors[ids], starts, axis=0)
    at = np.unique(np.r_[used, np.maximum(used - 1, 0)])  # windows that begin at or one before a block with weighted words
    full = np.zeros((len(at) + 1, sums.shape[1]), np.float32)
    for shift in (0, 1):
        where = np.searchsorted(used, at + shift)
        have = (where < len(used)) & (used[np.minimum(where, len(used) - 1)] == at + shift)
        full[:-1][have] += sums[where[have]]
    norm = np.maximum(np.linalg.norm(full[:-1], axis=1, keepdims=True), 1e-9)
    reach = full[:-1] @ model.latent.T
    chosen = (reach >= COSINE * norm) & (reach >= REACH * model.lengths)
    text_of = np.searchsorted(np.array(first_block), at, side="right") - 1
    for w, passage in zip(*np.nonzero(chosen), strict=True):
        t = int(text_of[w])
        yield t, int(at[w]) - first_block[t], int(passage), float(reach[w, passage] / norm[w, 0])


def verified(model: Model, words: list[bytes], block: int, passage: int) -> tuple[float, float] | None:
    """(overlap, answer) of a candidate if both reach their limits."""
    p, answer = model.passages[passage], model.answers[passage]
    near = words[max(0, (block - 1) * STEP) : (block + 3) * STEP]
    share = len(answer.intersection(near)) / len(answer) if answer else 1.0
    if share < ANSWER:
        return None
    overlap = common_subsequence(p, near) / len(p)
    return (overlap, share) if overlap >= OVERLAP else None


def _search(docs: DataFrame, model: Model) -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = held.value
        for b in batches:
            ids, texts = b["doc_id"].to_pylist(), b["text"].to_pylist()
            best: dict = {}
            for i, j in common.by_bytes(texts, [len(t or "") // 6 for t in texts], HITS):
                words = [words_of(t) for t in texts[i:j]]
                for t, block, passage, cos in candidates(m, words):
                    if got := verified(m, words[t], block, passage):
                        key = (ids[i + t], m.items[passage])
                        best[key] = max(best.get(key, (0, 0, 0)), (got[0], got[1], cos))
                for t, text in enumerate(words):
                    for passage in verbatim(m, text):
                        best.setdefault((ids[i + t], m.items[passage]), (1.0, 1.0, 1.0))
            cols = [[k[0] for k in best], [k[1] for k in best], *([v[c] for v in best.values()] for c in range(3))]
            kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["doc_id", "item_id", "overlap", "answer", "cosine"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, item_id long, overlap double, answer double, cosine double")


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, overlap, answer, cosine): a row for each document and benchmark item found in it."""
    spark = docs.sparkSession

    def cut(batches):
        for b in batches:
            got = [(i, n, b" ".join(p)) for i, t in zip(b["item_id"].to_pylist(), b["text"].to_pylist(), strict=True) for n, p in enumerate(passages_of(words_of(t)))]
            cols = list(zip(*got, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["item_id", "n", "words"])

    bench = common.stored(benchmark.select(F.col("item_id").cast("long"), "text").mapInArrow(cut, "item_id long, n long, words binary").distinct(), "passages")
    blocks = math.ceil(bench.count() / (BLOCK * 0.8))
    word = F.explode(F.split(F.decode("words", "ISO-8859-1"), " "))  # a character for each byte
    vocabulary = sorted(r.word.encode("latin-1") for r in bench.select(word.alias("word")).distinct().collect())
    frequencies, n = document_frequencies(docs, vocabulary)
    frequency, out = dict(zip(vocabulary, frequencies.tolist(), strict=True)), None
    for k in range(blocks):
        part = bench.filter(F.pmod(F.xxhash64("item_id", "n"), F.lit(blocks)) == k)
        if not part.isEmpty():
            found = _search(docs, fit(part, frequency, n))
            out = found if out is None else out.union(found)
    if out is None:
        return spark.createDataFrame([], "doc_id long, item_id long, overlap double, answer double, cosine double")
    return out.groupBy("doc_id", "item_id").agg(F.max("overlap").alias("overlap"), F.max("answer").alias("answer"), F.max("cosine").alias("cosine"))


def op4(spark, sf_dir: str) -> DataFrame:
    return contaminated(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))

"""Fingerprints of improbable features: digests that show how much of two texts is alike.

The entropy of every window of WINDOW bytes is ranked by its rarity in the corpus. Sliding over RANGE windows at a time, the rarest (leftmost of
ties) scores a point, and windows with POINTS or more are features. Each feature's hash sets five bits of a Bloom filter of BITS bits; after
FEATURES features the next filter of the chain begins. Fingerprints are compared by the bits their filters share, less what chance
shares, against what filters as full could share.

`rarity()` counts the entropies of all windows of all documents (at most LEVELS + 1 numbers come to the driver); a fitted table may
be kept, and only fingerprints of one table compare. `edited()` needs each document's successor by id: documents are dealt to ranges of
ids, sorted, and read in order, so texts are shuffled once, and the first document of a range goes to the range before too.

Defined cases: a null text is an empty one, whose fingerprint has no filter and is like another empty one only; a text without a window that counts
(under WINDOW bytes, or all of low entropy) is a feature as a whole; rows that repeat id and text count as one document with several rows; null ids come
last, equal ids go by a hash of their texts; the last document is followed by the first, a single one by itself; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW, RANGE, POINTS = 16, 64, 16
#: Levels of entropy, and the level below which a window says nothing.
LEVELS, LEAST = 1000, 100
BITS, FEATURES, HASHES = 2048, 160, 5
#: Overlap of two filters counts from so many standard deviations above chance.
CLEAR = 3
#: Windows ranked at once, and bytes of texts that are.
SEGMENT, SLICE = 1 << 20, 2 << 20
#: Bytes of text in a range of ids, about, and ranges at most: their first ids are sent to all tasks. Ranges are read as streams.
PART, PARTS = 64 << 20, 20_000

_NONE = 1023
_PAD = RANGE
_SCALE = 16
_counts = np.arange(1, WINDOW + 1)
_TERM = np.r_[0, np.round(_counts * np.log2(_counts) * 2**_SCALE)].astype(np.int32)
#: What the c-th equal byte of a window adds to the sum of c log c.
_STEP = np.diff(_TERM)
_MOST = WINDOW * int(np.log2(WINDOW)) << _SCALE
_BYTE = (np.array([xxhash.xxh64_intdigest(bytes([i]), 7) for i in range(256)], np.uint64) | np.uint64(1))
_POWER = np.cumprod(np.full(WINDOW, 0x9E3779B97F4A7C15, np.uint64))


def levels(data: np.ndarray) -> np.ndarray:
    """Entropy of the window at each byte that has one, in LEVELS steps: 0 for equal bytes, LEVELS for all different ones."""
    out = np.zeros(max(0, len(data) - WINDOW + 1), np.int16)
    for a in range(0, len(out), SEGMENT):
        part = data[a : a + SEGMENT + WINDOW - 1]
        before, after = np.zeros(len(part), np.uint8), np.zeros(len(part), np.uint8)  # equal bytes among the WINDOW - 1 on either side
        for j in range(1, WINDOW):
            same = (part[j:] == part[:-j]).view(np.uint8)
            before[j:] += same
            after[:-j] += same
        total = np.empty(len(part) - WINDOW + 1, np.int32)
        total[0] = _TERM[np.bincount(part[:WINDOW])].sum()
        total[1:] = _STEP[before[WINDOW:]]
        total[1:] -= _STEP[after[: len(part) - WINDOW]]
        np.cumsum(total, out=total)
        out[a : a + SEGMENT] = LEVELS - (total * (LEVELS / _MOST)).astype(np.int16)
    return out


def _laid_out(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts one after the other with gaps between, the start of each, and its size."""
    gap = bytes(_PAD)
    flat = np.frombuffer(gap + b"".join(x for t in texts for x in (t, gap)), np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    return flat, np.cumsum(size + _PAD) - size, size


def _inside(start: np.ndarray, size: np.ndarray, n: int) -> np.ndarray:
    """Which of n windows lie in a text."""
    edge = np.zeros(n + 1, np.int8)
    has = size >= WINDOW
    np.add.at(edge, start[has], 1)
    np.add.at(edge, start[has] + size[has] - WINDOW + 1, -1)
    return np.cumsum(edge[:-1], dtype=np.int8) > 0


def histogram(texts: list[bytes]) -> np.ndarray:
    """Windows of each level."""
    flat, start, size = _laid_out(texts)
    found = levels(flat)
    return np.bincount(found[_inside(start, size, len(found))], minlength=LEVELS + 1)


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each level: 0 for the rarest; ties go to the lower level, and levels under LEAST have none."""
    out = np.full(LEVELS + 1, _NONE, np.uint32)
    order = np.lexsort((np.arange(LEVELS + 1), counts))
    out[order] = np.arange(LEVELS + 1)
    out[:LEAST] = _NONE
    return out


def chosen(rank: np.ndarray) -> np.ndarray:
    """Places that are the leftmost rarest of POINTS ranges or more."""
    places, points = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for a in range(0, len(rank) - RANGE + 1, SEGMENT):
        part = rank[a : a + SEGMENT + RANGE - 1]
        least = part << np.uint32(21) | np.arange(len(part), dtype=np.uint32)
        for s in (1, 2, 4, 8, 16, 32):  # the least of 2, 4, and so on up to RANGE
            least = np.minimum(least[:-s], least[s:])
        turn = np.flatnonzero(np.r_[True, least[1:] != least[:-1]])
        use = least[turn] >> np.uint32(21) != _NONE
        places.append((least[turn] & np.uint32((1 << 21) - 1))[use].astype(np.int64) + a)
        points.append(np.diff(np.r_[turn, len(least)])[use])
    place, point = np.concatenate(places), np.concatenate(points)
    if not len(place):
        return place
    turn = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])  # a place may win on both sides of a segment's end
    return place[turn][np.add.reduceat(point, turn) >= POINTS]


def features(texts: list[bytes], rank_of: np.ndarray) -> list[np.ndarray]:
    """Distinct hashes of each text's features, in the order of their first places."""
    flat, start, size = _laid_out(texts)
    found = levels(flat)
    rank = np.full(len(flat), _NONE, np.uint32)
    rank[: len(found)] = np.where(_inside(start, size, len(found)), rank_of[found], _NONE)
    at = chosen(rank)
    hashes = np.zeros(len(at), np.uint64)
    for j in range(WINDOW):
        hashes += _BYTE[flat[at + j]] * _POWER[j]
    hashes = (hashes ^ hashes >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    hashes ^= hashes >> np.uint64(29)
    ends = np.searchsorted(at, start + size)
    out, a = [], 0
    for text, b in zip(texts, ends, strict=True):
        own = hashes[a:b] if b > a else np.array([xxhash.xxh64_intdigest(text)][: len(text)], np.uint64)
        _, first = np.unique(own, return_index=True)
        out.append(own[np.sort(first)])
        a = b
    return out


class Fingerprint:
    """A chain of Bloom filters, and how many features it holds."""

    def __init__(self, n: int, filters: np.ndarray):
        self.n, self.filters = n, filters

    @classmethod
    def of(cls, hashes: np.ndarray) -> Fingerprint:
        bits = np.zeros((-(-len(hashes) // FEATURES), BITS), np.uint8)
        chain = np.arange(len(hashes)) // FEATURES
        for i in range(HASHES):
            bits[chain, (hashes >> np.uint64(11 * i) & np.uint64(BITS - 1)).astype(np.int64)] = 1
        return cls(len(hashes), bits)

    def __str__(self) -> str:
        return f"{self.n}:{base64.b64encode(np.packbits(self.filters).tobytes()).decode()}"

    @classmethod
    def read(cls, text: str) -> Fingerprint:
        n, _, data = text.partition(":")
        return cls(int(n), np.unpackbits(np.frombuffer(base64.b64decode(data), np.uint8)).reshape(-1, BITS))

    def weights(self) -> np.ndarray:
        """Features in each filter."""
        w = np.full(len(self.filters), FEATURES)
        w[-1:] = self.n - FEATURES * (len(w) - 1)
        return w

    def likeness(self, other: Fingerprint) -> float:
        """0 to 1: how far each filter is found in the other chain, weighted by features, both ways."""
        if not self.n or not other.n:
            return float(self.n == other.n)
        mine, its = np.zeros(len(self.filters)), np.zeros(len(other.filters))
        for a in range(0, len(mine), 512):
            for b in range(0, len(its), 512):
                s = _alike(self.filters[a : a + 512], other.filters[b : b + 512])
                mine[a : a + 512] = np.maximum(mine[a : a + 512], s.max(1))
                its[b : b + 512] = np.maximum(its[b : b + 512], s.max(0))
        return float((mine @ self.weights() + its @ other.weights()) / (self.n + other.n))


def _alike(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Normalised overlap of each filter of x with each of y."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    full_x, full_y = x.sum(1, dtype=np.float64)[:, None], y.sum(1, dtype=np.float64)[None, :]
    shared, chance = (x @ y.T).astype(np.float64), full_x * full_y / BITS
    most = (full_x + full_y) / 2
    clear = shared - chance > CLEAR * np.sqrt(chance * (1 - full_x / BITS) * (1 - full_y / BITS))
    return np.where(clear, np.clip((shared - chance) / np.maximum(most - chance, 1e-9), 0, 1), 0)


def fingerprints(texts: list[bytes], rank_of: np.ndarray) -> list[Fingerprint]:
    out = []
    for i, j in common.by_bytes(texts, [len(t) + _PAD for t in texts], SLICE):
        out += [Fingerprint.of(h) for h in features(texts[i:j], rank_of)]
    return out


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def rarity(docs: DataFrame) -> np.ndarray:
    """Ranks of the levels of entropy, from all windows of all documents."""

    def run(batches):
        total = np.zeros(LEVELS + 1, np.int64)
        for b in batches:
            texts = [_bytes(t) for t in b["text"].to_pylist()]
            for i, j in common.by_bytes(texts, [len(t) + _PAD for t in texts], SLICE):
                total += histogram(texts[i:j])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(LEVELS + 1)), pa.array(total)], ["level", "n"])

    counts = np.zeros(LEVELS + 1, np.int64)
    for level, n in docs.select("text").mapInArrow(run, "level long, n long").groupBy("level").agg(F.sum("n")).collect():
        counts[level] = n
    return ranks(counts)


def edit(text: str, following: str) -> str:
    """The text with its last third replaced by the first characters of the following one."""
    k = len(text) // 3
    return text[: len(text) - k] + following[:k]


_KINDS = {
    "doc_id": pa.int64(), "n_chars": pa.int64(), "edited_sha256": pa.string(), "fingerprint": pa.string(), "edited_fingerprint": pa.string(),
    "near_edited": pa.float64(), "near_next": pa.float64(), "times": pa.int64(),
}
_DDL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, times long"


def in_order(rows: Iterator[tuple], rank_of: np.ndarray) -> Iterator[list[tuple]]:
    """Results of rows (part, borrowed, doc_id, text, times) that come sorted; each part ends with borrowed rows, which only follow."""
    part: list[list] = []  # distinct documents: part, borrowed, doc_id, text, times
    known: Fingerprint | None = None  # of part[0]
    size = 0

    def results(last: bool):
        nonlocal known
        marks = fingerprints([_bytes(d[3]) for d in part[known is not None :]], rank_of) if part else []
        marks = [known, *marks] if known is not None else marks
        pairs = [(i, i + 1) for i in range(len(part) - 1) if part[i][0] == part[i + 1][0] and not part[i][1]]
        changed = [edit(part[i][3], part[j][3]) for i, j in pairs]
        marks_of = fingerprints([_bytes(x) for x in changed], rank_of)
        out = []
        for (i, j), text, mark in zip(pairs, changed, marks_of, strict=True):
            d, own = part[i], marks[i]
            out.append((d[2], len(d[3]), hashlib.sha256(_bytes(text)).hexdigest(), str(own), str(mark), own.likeness(mark), own.likeness(marks[j]), d[4]))
        known = None if last else marks[-1]
        return out

    for where, borrowed, doc_id, text, times in rows:
        if part and part[-1][:4] == [where, borrowed, doc_id, text]:
            part[-1][4] += times
            continue
        if size > SLICE:
            yield results(False)
            part, size = part[-1:], len(part[-1][3])
        part.append([where, borrowed, doc_id, text, times])
        size += len(text)
    if part:
        yield results(True)


def _ordered(docs: DataFrame) -> DataFrame:
    """docs with the columns by which documents follow each other: descending ids, null ids last, then a hash of the text."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return docs.withColumns({"none": F.isnull("doc_id"), "down": F.bitwise_not(F.coalesce("doc_id", F.lit(0))), "digest": F.xxhash64("text")})


def _folded(docs: DataFrame, keys: DataFrame, total: int) -> DataFrame:
    """docs with times: rows of an id and text that make up over one in common.HOT of all are one row, counted before they are dealt out."""
    hot = keys.filter((F.col("times") > 1) & (F.col("times") * common.HOT > total)).select("none", "down", "digest")
    if hot.isEmpty():
        return docs.withColumn("times", F.lit(1).cast("long"))
    on = ["none", "down", "digest"]
    rest = docs.join(F.broadcast(hot), on, "left_anti").withColumn("times", F.lit(1).cast("long"))
    return rest.unionByName(docs.join(F.broadcast(hot), on).groupBy(*docs.columns).agg(F.count("*").alias("times")))


def edited(docs: DataFrame, rank_of: np.ndarray, part_bytes: int = PART) -> DataFrame:
    """For each row of docs (doc_id, text): n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    docs = _ordered(docs)
    keys = common.stored(docs.groupBy("none", "down", "digest").agg(F.count("*").alias("times"), F.sum(F.octet_length("text")).alias("size")), "digest-keys")
    total, size = (x or 0 for x in keys.agg(F.sum("times"), F.sum("size")).first())
    n_parts = min(PARTS, max(2 * docs.sparkSession.sparkContext.defaultParallelism, size // part_bytes + 1))
    ranged = keys.repartitionByRange(n_parts, "none", "down", "digest").withColumn("part", F.spark_partition_id())
    heads = sorted(tuple(r.head) for r in ranged.groupBy("part").agg(F.min(F.struct("none", "down", "digest")).alias("head")).collect())

    @F.udf("struct<part: int, head: boolean>", useArrow=True)
    def place(none, down, digest):
        i = max(0, bisect.bisect_right(heads, (none, down, digest)) - 1)
        return {"part": i, "head": heads[i] == (none, down, digest)}

    own = _folded(docs, keys, total).withColumn("at", place("none", "down", "digest"))
    here = F.struct(F.col("at.part").alias("part"), F.lit(False).alias("borrowed"))
    before = F.struct(F.pmod(F.col("at.part") - 1, F.lit(max(1, len(heads)))).cast("int").alias("part"), F.lit(True).alias("borrowed"))
    dealt = own.withColumn("to", F.explode(F.when(F.col("at.head"), F.array(here, before)).otherwise(F.array(here)))).select("to.*", "none", "down", "digest", "doc_id", "text", "times")
    rows = dealt.repartitionById(n_parts, "part").sortWithinPartitions("part", "borrowed", "none", "down", "digest", "text").select("part", "borrowed", "doc_id", "text", "times")

    def run(batches):
        each = (r for b in batches for r in zip(*(b[c].to_pylist() for c in ("part", "borrowed", "doc_id", "text", "times")), strict=True))
        for out in in_order(each, rank_of):
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), _KINDS.values(), strict=True)], list(_KINDS))

    found, some = rows.mapInArrow(run, _DDL), 10_000
    found = found.withColumn("left", F.explode(F.sequence(F.col("times"), F.lit(1), F.lit(-some).cast("long"))))
    found = found.withColumn("left", F.explode(F.sequence(F.lit(1).cast("long"), F.least("left", F.lit(some)))))
    return found.drop("times", "left")


def op11(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return edited(docs, rarity(docs))

"""Spelling variants: words that differ by one inserted, deleted or replaced letter, found by rolling-hash deletions.

For each word, prefix and suffix polynomial hashes give the hash of the word without each of its letters, as numpy integers for a
whole batch of words at once. Keys are dealt out by their upper bits (a radix partition) and sorted; two words are
candidates if their deletions meet at one place (a replaced letter), or if one's deletion is the other word (an inserted letter). Only for candidates
are the strings fetched, and compared: groups go by the strings themselves, so a collision of hashes links nothing.

No pairs of a group are made. Words that share a deletion at one place are all near each other, so their number and their best two
say all; at most as many as there are letters (90) can share it. A word and its deletions form a star, a row for each.

Defined cases: a null text has no words; a null doc_id hashes as an empty one; a run that becomes empty or short by its deletion is no word; repeated rows
count as often as they stand; ties go to the smallest word in code-point order; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Letters of a word at least, occurrences of a word at least, and how many times more frequent a word's form is.
LETTERS, COUNT, TIMES = 6, 5, 5
#: One run in so many loses a letter.
EVERY = 199
#: Upper bits of a key that choose its partition.
RADIX = 12
#: Letters hashed at once in a task.
SLICE = 1 << 20

_BASE = 0x9E3779B97F4A7C15
_INVERSE = np.uint64(pow(_BASE, -1, 2**64))
_LENGTH = np.uint64(0xD6E8FEB86659FD93)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads them evenly."""
    x = (x ^ x >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ x >> np.uint64(29)


_LETTER = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(_BASE))


def deletion_keys(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(owner, place, first, key): for each word a key of itself (place -1), then one without the letter at each place.

    first: the letter differs from the one before it; the other deletions repeat strings.
    """
    flat = np.frombuffer("".join(words).encode("latin-1"), np.uint8)
    size = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(size) - size
    owner = np.repeat(np.arange(len(words)), size)
    place = np.arange(len(flat)) - start[owner]
    power = np.full(int(size.max(initial=0)) + 1, _BASE, np.uint64)
    power[0] = 1
    power = np.cumprod(power)
    upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_LETTER[flat] * power[place])])
    whole = upto[start + size] - upto[start]
    prefix = upto[:-1] - upto[start][owner]
    suffix = (upto[start + size][owner] - upto[1:]) * _INVERSE  # one place to the left
    first = np.ones(len(flat), bool)
    first[1:] = (flat[1:] != flat[:-1]) | (place[1:] == 0)
    length = size.astype(np.uint64) * _LENGTH
    keys = mixed(np.concatenate([whole ^ length, (prefix + suffix) ^ (length - _LENGTH)[owner]]))
    here = np.arange(len(words))
    return np.concatenate([here, owner]), np.concatenate([np.full(len(words), -1), place]), np.concatenate([np.zeros(len(words), bool), first]), keys


def counted(docs: DataFrame) -> DataFrame:
    """(word, n): words of the texts, one run in EVERY with a letter less."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(lower, F.lit("[a-zÀ-ÿ]+"), F.lit(0))).alias("run")).filter(F.length("run") >= LETTERS)
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), "run"))
    at = (F.col("h") % F.length("run")).cast("int")
    less = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))
    words = runs.withColumn("h", h).select(F.when(F.col("h") % EVERY == 0, less).otherwise(F.col("run")).alias("word"))
    return words.filter(F.length("word") >= LETTERS).groupBy("word").agg(F.count("*").alias("n"))


def _keys(words: DataFrame) -> DataFrame:
    names = ["key", "place", "first", "wid"]

    def run(batches):
        for b in batches:
            texts = b["word"].to_pylist()
            for i, j in common.by_bytes(texts, [len(t) for t in texts], SLICE):
                owner, place, first, key = deletion_keys(texts[i:j])
                wid = b["wid"].slice(i, j - i).to_numpy()[owner]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(first), pa.array(wid)], names)

    return words.select("wid", "word").mapInArrow(run, "key long, place int, first boolean, wid long")


def meeting(key: np.ndarray, place: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of rows sorted by key and place: those that share both with another, and those of a word whose key is another's deletion, with these deletions."""
    if not len(key):
        return np.zeros(0, bool), np.zeros(0, bool)
    new_key = np.r_[True, key[1:] != key[:-1]]
    new_place = new_key | np.r_[True, place[1:] != place[:-1]]
    group, pair = np.cumsum(new_key) - 1, np.cumsum(new_place) - 1
    replaced = (np.bincount(pair)[pair] > 1) & (place >= 0)
    whole, lost = np.bincount(group, place < 0) > 0, np.bincount(group, first) > 0
    return replaced, ((whole & lost)[group]) & ((place < 0) | first)


def _candidates(keys: DataFrame) -> DataFrame:
    """(wid, place, replaced, inserted) of keys that meet; dealt by the keys' upper bits, sorted, and read group by group."""
    names = ["wid", "place", "replaced", "inserted"]

    def found(rows):
        replaced, inserted = meeting(*rows[:3])
        use = replaced | inserted
        return pa.RecordBatch.from_arrays([pa.array(rows[3][use]), pa.array(rows[1][use]), pa.array(replaced[use]), pa.array(inserted[use])], names)

    def run(batches):
        rest = None
        for b in batches:
            rows = [b[c].to_numpy(zero_copy_only=False) for c in ("key", "place", "first", "wid")]
            if rest is not None:
                rows = [np.concatenate(x) for x in zip(rest, rows, strict=True)]
            if len(rows[0]):
                last = np.searchsorted(rows[0], rows[0][-1])  # the last group may go on in the next batch
                yield found([x[:last] for x in rows])
                rest = [x[last:] for x in rows]
        if rest is not None:
            yield found(rest)

    dealt = keys.repartition(F.shiftrightunsigned("key", 64 - RADIX)).sortWithinPartitions("key", "place")
    return dealt.mapInArrow(run, "wid long, place int, replaced boolean, inserted boolean")


def near_words(words: DataFrame) -> DataFrame:
    """(wid, n_near, best): of words (wid, word, n) that have near ones, how many, and the most frequent (minus n, word)."""
    met = _candidates(_keys(words)).join(words, "wid")
    text = F.when(F.col("place") < 0, F.col("word")).otherwise(F.concat(F.substring("word", F.lit(1), F.col("place")), F.substring("word", F.col("place") + 2, F.length("word"))))
    met = common.stored(met.select("wid", "place", "replaced", "inserted", text.alias("rest"), F.struct((-F.col("n")).alias("less"), "word").alias("me")), "variant-candidates")

    alike = met.filter("replaced").groupBy("rest", "place").agg(F.array_sort(F.collect_list(F.struct("me", "wid"))).alias("all")).filter("size(all) > 1")
    alike = alike.select("all", F.posexplode("all").alias("i", "x")).select(
        F.col("x.wid").alias("wid"), (F.size("all") - 1).cast("long").alias("n_near"), F.element_at("all", F.when(F.col("i") == 0, 2).otherwise(1))["me"].alias("best")
    )
    whole = met.filter("inserted AND place < 0").select("rest", F.struct("wid", "me").alias("short"))
    stars = met.filter("inserted AND place >= 0").select("rest", F.struct("wid", "me").alias("long")).join(whole, "rest")
    both = stars.select(F.explode(F.array(F.struct(F.col("long.wid").alias("wid"), F.col("short.me").alias("best")), F.struct(F.col("short.wid").alias("wid"), F.col("long.me").alias("best")))).alias("x"))
    inserted = both.select("x.wid", F.lit(1).cast("long").alias("n_near"), "x.best")
    return alike.unionByName(inserted).groupBy("wid").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def roots(links: DataFrame, most: int) -> DataFrame:
    """(word, root) of links (word, form): the last form, by pointer doubling.

    Each form is TIMES as frequent as its word, so a chain's length is bounded by the logarithm of the largest count, `most`,
    and so is the number of joins.
    """
    longest = int(math.log(max(most, COUNT) / COUNT, TIMES) + 1e-9)
    up = common.stored(links.select("word", F.col("form").alias("root")), "variant-roots")
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        further = up.select(F.col("word").alias("root"), F.col("root").alias("next"))
        up = common.stored(up.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "variant-roots")
    return up


def grouped(docs: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the words of docs (doc_id, text), and the spelling each is a variant of."""
    words = common.stored(counted(docs).filter(F.col("n") >= COUNT).withColumn("wid", F.monotonically_increasing_id()), "variant-words")
    most = words.agg(F.max("n")).first()[0] or 0
    found = words.join(near_words(words), "wid", "left")
    better = -F.col("best.less") >= TIMES * F.col("n")
    found = common.stored(found.select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(better, F.col("best.word")).alias("form"), F.when(better, -F.col("best.less")).alias("form_n")), "variant-forms")
    last = roots(found.filter("form IS NOT NULL").select("word", "form"), most)
    return found.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op13(spark, sf_dir: str) -> DataFrame:
    return grouped(common.table(spark, sf_dir, "documents").select("doc_id", "text"))

import collections
import random
import re
import zlib

import numpy as np
import pytest

from loopgauge.llm import common, variants


def words_of(docs):
    """By brute force: occurrences of each word."""
    count = collections.Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 199 == 0:
                word = word[: h % len(word)] + word[h % len(word) + 1 :]
            count[word] += 1
    return {w: n for w, n in count.items() if len(w) >= 6 and n >= 5}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(docs):
    """All pairs of words."""
    n = words_of(docs)
    size = collections.defaultdict(list)
    for w in n:
        size[len(w)].append(w)
    form, count = {}, {}
    for w in n:
        close = [x for k in (-1, 0, 1) for x in size[len(w) + k] if near(w, x)]
        best = min(close, key=lambda x: (-n[x], x), default=None)
        count[w], form[w] = len(close), best if best and n[best] >= 5 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n[w], count[w], n[form[w]] if form[w] else None))
    return sorted(out)


def found(spark, docs):
    df = variants.grouped(spark.createDataFrame(docs, "doc_id long, text string"))
    assert df.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(tuple(r) for r in df.collect())


def test_op13_against_brute_force(spark, sf):
    docs = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    rows = sorted(tuple(r) for r in variants.op13(spark, sf).collect())
    assert rows == brute(docs) and sum(1 for r in rows if r[1]) > 10


@pytest.mark.parametrize("seed", range(3))
def test_planted_variants(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(5, 9))) for _ in range(12)] + ["aaaaaaa", "aaaaaa", "aaaaaab", "×÷×÷×÷a", "ÀÀÀÀÀÀ", "àààààà"]
    text = []
    for w in base:
        for _ in range(rng.choice([5, 30, 200])):
            text.append(w)
        for _ in range(6):
            k = rng.randrange(len(w))
            changed = rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice("abZ") + w[k:], w[:k] + rng.choice("abé") + w[k + 1 :]])
            text += [changed] * rng.choice([1, 5, 7, 40])
    rng.shuffle(text)
    docs = [(i, " ".join(text[i::20])) for i in range(20)]
    rows = found(spark, docs)
    assert rows == brute(docs) and any(r[1] for r in rows)


def test_long_chain_of_forms(spark):
    words = ["abcdefgh", "abcdefgx", "abcdefyx", "abcdezyx"]
    docs = [(None, " ".join([w] * 5 * 5**i)) for i, w in enumerate(words)]
    rows = found(spark, docs)
    assert rows == brute(docs) and {r[2] for r in rows if r[0] == "abcdefgh"} == {"abcdezyx"}


def test_odd_rows(spark, odd, empty):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    rows = sorted(tuple(r) for r in variants.grouped(odd).collect())
    assert rows == brute(docs)
    assert variants.grouped(empty).count() == 0
    long = "".join(random.Random(1).choice("abcd") for _ in range(30_000))
    assert found(spark, [(1, " ".join([long] * 25)), (2, " ".join([long[:500] + "x" + long[501:]] * 5)), (3, " ".join([long[1:]] * 5))])[0][4] >= 1


def test_collisions_of_hashes_link_nothing(spark, monkeypatch):
    docs = [(i, " ".join(["planted"] * 6 + ["plantet"] * 6 + ["whatever"] * 6 + ["something"] * 6)) for i in range(3)]
    keys = variants.deletion_keys

    def colliding(words):
        owner, place, first, key = keys(words)
        return owner, place, first, key % np.uint64(3)

    monkeypatch.setattr(variants, "deletion_keys", colliding)
    import pyarrow as pa

    owner, place, first, key = colliding(["planted", "plantet", "whatever"])
    order = np.lexsort((place, key.view(np.int64)))
    replaced, inserted = variants.meeting(key[order].view(np.int64), place[order], first[order])
    assert replaced.sum() > 2 and pa.array(inserted) is not None
    assert found(spark, docs) == brute(docs)


def test_keys_are_those_of_the_strings():
    words = ["banana", "bananas", "xanana", "aaabbb", "éàéàéà"]
    owner, place, first, key = variants.deletion_keys(words)
    by_text = {}
    for o, p, k in zip(owner, place, key, strict=True):
        text = words[o] if p < 0 else words[o][:p] + words[o][p + 1 :]
        assert by_text.setdefault(text, k) == k
    assert len(set(by_text.values())) == len(by_text)
    assert [bool(f) for o, p, f in zip(owner, place, first, strict=True) if o == 3 and p >= 0] == [True, False, False, True, False, False]

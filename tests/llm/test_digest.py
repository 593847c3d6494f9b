import collections
import hashlib
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loopgauge.llm import common, digest


def brute_features(data, rank_of):
    """Distinct windows chosen by going through every range."""
    def level(window):
        return digest.LEVELS - int(sum(int(digest._TERM[c]) for c in collections.Counter(window).values()) * (digest.LEVELS / digest._MOST))

    w = digest.WINDOW
    rank = [int(rank_of[level(data[i : i + w])]) for i in range(len(data) - w + 1)]
    points = collections.Counter()
    for a in range(1 - digest.RANGE, len(rank)):
        inside = [(rank[i], i) for i in range(max(a, 0), min(a + digest.RANGE, len(rank))) if rank[i] != digest._NONE]
        if inside:
            points[min(inside)[1]] += 1
    windows = [data[i : i + w] for i in sorted(points) if points[i] >= digest.POINTS]
    return list(dict.fromkeys(windows)) or ([data] if data else [])


def brute_hash(window):
    if len(window) != digest.WINDOW:
        return digest.xxhash.xxh64_intdigest(window)
    h = sum(int(digest._BYTE[c]) * int(digest._POWER[j]) for j, c in enumerate(window)) % 2**64
    h = (h ^ h >> 32) * 0xD6E8FEB86659FD93 % 2**64
    return h ^ h >> 29


def brute_print(data, rank_of):
    hashes = [brute_hash(w) for w in brute_features(data, rank_of)]
    filters = np.zeros((-(-len(hashes) // digest.FEATURES), digest.BITS), np.uint8)
    for i, h in enumerate(hashes):
        for k in range(digest.HASHES):
            filters[i // digest.FEATURES, h >> 11 * k & digest.BITS - 1] = 1
    return str(digest.Fingerprint(len(hashes), filters))


def brute(docs):
    """op11's rows of distinct (doc_id, text), from scratch."""
    docs = sorted(((d, t or "") for d, t in docs), key=lambda x: -x[0])
    counts = np.zeros(digest.LEVELS + 1, np.int64)
    for _, t in docs:
        data = t.encode()
        for i in range(len(data) - digest.WINDOW + 1):
            terms = sum(int(digest._TERM[c]) for c in collections.Counter(data[i : i + digest.WINDOW]).values())
            counts[digest.LEVELS - int(terms * (digest.LEVELS / digest._MOST))] += 1
    rank_of = digest.ranks(counts)
    out = {}
    for i, (d, t) in enumerate(docs):
        follows = docs[(i + 1) % len(docs)][1]
        k = len(t) // 3
        changed = t[: len(t) - k] + follows[:k]
        out[d] = (len(t), hashlib.sha256(changed.encode()).hexdigest(), brute_print(t.encode(), rank_of), brute_print(changed.encode(), rank_of))
    return out


def test_op11_against_brute_force(spark, sf):
    docs = common.table(spark, sf, "documents").select("doc_id", "text").filter("length(text) < 1500")
    rows = digest.edited(docs, digest.rarity(docs), part_bytes=4000).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()])
    assert {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) for r in rows} == want and len(rows) == len(want)


def test_op11_tells_edited_from_next(spark, sf):
    docs = {r.doc_id: r.text or "" for r in common.table(spark, sf, "documents").collect()}
    rows = digest.op11(spark, sf).collect()
    assert len(rows) == len(docs)
    ids = sorted(docs, reverse=True)
    after = dict(zip(ids, ids[1:] + ids[:1], strict=True))
    mark = {r.doc_id: r.fingerprint for r in rows}
    for r in rows:
        assert r.edited_sha256 == hashlib.sha256(digest.edit(docs[r.doc_id], docs[after[r.doc_id]]).encode()).hexdigest()
        own, edited, following = (digest.Fingerprint.read(x) for x in (r.fingerprint, r.edited_fingerprint, mark[after[r.doc_id]]))
        assert r.near_edited == pytest.approx(own.likeness(edited)) and r.near_next == pytest.approx(own.likeness(following))
    long = [r for r in rows if r.n_chars >= 100]
    assert np.mean([r.near_edited > r.near_next for r in long]) > 0.99
    assert np.median([r.near_edited for r in long]) > 0.5 and np.median([r.near_next for r in long]) < 0.05
    by_text = collections.defaultdict(set)
    for r in rows:
        by_text[docs[r.doc_id]].add(r.fingerprint)
    assert all(len(x) == 1 for x in by_text.values())


def test_odd_rows(spark, odd, empty):
    rows = digest.edited(odd, digest.rarity(odd), part_bytes=10_000).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    assert by_id[3].fingerprint == by_id[4].fingerprint == "0:" and by_id[3].n_chars == 0
    assert by_id[4].near_next == 1.0  # 3 follows 4, and both are empty
    assert len({r.fingerprint for r in rows if r.doc_id in (1, 2)}) == 1 and by_id[2].near_next == 1.0
    one = next(r for r in rows if r.doc_id == 1)  # ids without value come last, the first id follows them
    texts = {r.doc_id: r.text or "" for r in odd.collect()}
    assert one.edited_sha256 == hashlib.sha256(digest.edit(texts[1], texts[None]).encode()).hexdigest()
    none = next(r for r in rows if r.doc_id is None)
    assert none.edited_sha256 == hashlib.sha256(digest.edit(texts[None], texts[8]).encode()).hexdigest()
    assert digest.edited(empty, digest.rarity(empty)).count() == 0
    alone = digest.edited(odd.filter("doc_id = 5"), digest.rarity(odd)).collect()
    assert len(alone) == 1 and alone[0].near_next == 1.0 and alone[0].edited_sha256 == hashlib.sha256(digest.edit(texts[5], texts[5]).encode()).hexdigest()


def test_repeated_rows_are_folded(spark):
    docs = [(None, "the same text without an id, many times over")] * 40_000 + [(1, "another text that stands here twice and has a few words")] * 2 + [(i, f"a text of its own with number {i}, and some words") for i in range(5, 60)]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    rows = digest.edited(df, digest.rarity(df), part_bytes=500).collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(d for d, _ in docs)
    assert len({tuple(r) for r in rows if r.doc_id is None}) == 1 and len({tuple(r) for r in rows if r.doc_id == 1}) == 1


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.binary(max_size=300), st.text(alphabet="ab c", max_size=200).map(str.encode)), max_size=6))
def test_features_of_any_bytes(texts):
    rank_of = digest.ranks(digest.histogram(texts))
    assert [[int(h) for h in f] for f in digest.features(texts, rank_of)] == [list(map(brute_hash, brute_features(t, rank_of))) for t in texts]


def test_segments_change_nothing(monkeypatch):
    rng = random.Random(5)
    texts = [bytes(rng.choice(b"abcdefgh \n") for _ in range(n)) for n in (5, 900, 0, 2000, 17)]
    whole = digest.histogram(texts)
    rank_of = digest.ranks(whole)
    want = [str(x) for x in digest.fingerprints(texts, rank_of)]
    monkeypatch.setattr(digest, "SEGMENT", 100)
    monkeypatch.setattr(digest, "SLICE", 300)
    assert (digest.histogram(texts) == whole).all() and [str(x) for x in digest.fingerprints(texts, rank_of)] == want


def test_likeness():
    rng = random.Random(2)
    a, b = (np.array([rng.getrandbits(64) for _ in range(1000)], np.uint64) for _ in range(2))
    x, y = digest.Fingerprint.of(a), digest.Fingerprint.of(b)
    assert x.likeness(x) == pytest.approx(1) and x.likeness(y) == y.likeness(x) < 0.05
    half = digest.Fingerprint.of(np.concatenate([a[:500], b[:500]]))
    assert 0.4 < x.likeness(half) < 0.65 and str(digest.Fingerprint.read(str(x))) == str(x)
    none = digest.Fingerprint.of(a[:0])
    assert none.likeness(none) == 1 and none.likeness(x) == 0 and str(none) == "0:"

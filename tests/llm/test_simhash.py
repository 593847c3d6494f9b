import collections
import random
import re

import numpy as np
import pytest
import xxhash

from loopgauge.llm import common, simhash


def plain_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def classes(fps, ids, radius=4):
    fps, label = np.array(fps, np.uint64), np.array(ids)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= radius
    while True:
        new = np.where(near, label[None], 2**62).min(1)
        if (new == label).all():
            return label
        label = new


def test_op10_against_brute_force(spark, sf):
    rows = simhash.op10(spark, sf).collect()
    texts = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    assert len(rows) == len(texts) and all(r.fingerprint == f"{plain_fingerprint(texts[r.doc_id]):016x}" for r in rows)
    want = classes([int(r.fingerprint, 16) for r in rows], [r.doc_id for r in rows])
    assert [r.component_id for r in rows] == want.tolist()


@pytest.mark.parametrize("tile, bin_rows", [(8, 50), (2048, 150_000)])
def test_links_in_hot_buckets(spark, monkeypatch, tile, bin_rows):
    monkeypatch.setattr(simhash, "TILE", tile)
    monkeypatch.setattr(simhash, "BIN", bin_rows)
    rng, points = random.Random(3), set()
    for _ in range(4):
        base = rng.getrandbits(64)
        for _ in range(60):
            x = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                x ^= 1 << b
            points.add(x)
    points = sorted(points)
    signed = np.array(points, np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame(list(zip(signed, range(len(points)))), "fp long, node long")
    got = list(range(len(points)))
    for r in common.components(simhash.links(df, 4, simhash.block_keys(4), ["fp"])).collect():
        got[r.node] = r.component
    assert got == classes(points, range(len(points))).tolist()


def test_masks_cover_all_links():
    rng = random.Random(1)
    for _ in range(300):
        flips = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(flips & (m % 2**64) == 0 for m in simhash.masks(4, 2))


def test_long_chains(spark):
    edges = [(i + 1, i) for i in range(200)] + [(500, 501), (7, 7)]
    got = {r.node: r.component for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(201), 0), 500: 500, 501: 500}


def test_odd_rows(spark, odd, empty):
    rows = [tuple(r) for r in simhash.near_duplicates(odd).collect()]
    assert len(rows) == odd.count()
    by_id = {r[0]: r for r in rows}
    assert by_id[3][1] == by_id[4][1] == 0 and by_id[3][2] == by_id[4][2] == 3 and by_id[2][2] == 1
    assert simhash.near_duplicates(empty).count() == 0
    assert simhash.near_copies(odd).count() == odd.count() and simhash.near_copies(empty).count() == 0


def test_ids_do_not_tie_fingerprints(spark, monkeypatch):
    def found(rows):
        df = spark.createDataFrame(rows, "doc_id long, fp long")
        monkeypatch.setattr(simhash, "fingerprints", lambda docs, width: df)
        return [(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(df).collect()]

    far = 2**40
    assert sorted(found([(5, 0), (3, 1), (5, far - 1), (6, far - 2)])) == [(3, 1, 3), (5, 0, 3), (5, far - 1, 5), (6, far - 2, 5)]
    assert {(a, c) for a, _, c in found([(1, 0), (None, 0x0F), (2, 0xFF)])} == {(1, 1), (None, 1), (2, 1)}
    assert sorted(found([(None, 0), (None, 1), (4, -1)]), key=str) == sorted([(None, 0, None), (None, 1, None), (4, -1, 4)], key=str)


def similar_classes(rows, least=0.8):
    """Smallest (null id, id) of each class of texts that share `least` of their shingles of five words, by comparing all pairs."""
    sets = [set(simhash.shingle_bytes(t, 5)) for _, t in rows]
    label = list(range(len(rows)))
    where = {}
    for i, x in enumerate(sets):
        for g in x or [b""]:
            where.setdefault(g, []).append(i)
    near = []
    for x in sets:
        shared = collections.Counter(j for g in x or [b""] for j in where[g])
        near.append([j for j, n in shared.items() if sets[j] == x or n >= least * (len(x) + len(sets[j]) - n)])
    while True:
        new = [min(label[j] for j in near[i]) for i in range(len(rows))]
        if new == label:
            return label
        label = new


def copies(rng, groups, size, changes):
    """Groups of texts around a common one, each with some words changed."""
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    rows = []
    for _ in range(groups):
        base = rng.choices(vocabulary, k=300)
        for _ in range(size):
            words = list(base)
            for at in rng.sample(range(300), rng.choice(changes)):
                words[at] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(words)))
    return rows


def classes_found(spark, rows):
    got = simhash.near_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    assert all(r.first == (r.component_id == r.doc_id) for r in got)
    return {r.doc_id: r.component_id for r in got}


@pytest.mark.parametrize("chunk, cells", [(512, 4_000_000), (7, 300)])
def test_near_copies_against_all_pairs(spark, monkeypatch, chunk, cells):
    monkeypatch.setattr(simhash, "CHUNK", chunk)
    monkeypatch.setattr(simhash, "CELLS", cells)
    rows = copies(random.Random(31), 6, 40, (0, 2, 6, 8, 12, 16, 22))  # pairs from equal texts to a similarity under 0.5
    got, want = classes_found(spark, rows), similar_classes(rows)
    wrong = [i for i, w in enumerate(want) if got[i] != w]
    assert len(wrong) <= 1 and len(set(want)) > 60  # candidates come by keys of the smallest shingles: a pair at 0.8 is missed with a chance of 0.001


def test_texts_under_the_similarity_are_not_linked(spark):
    rows = copies(random.Random(17), 1, 60, (9, 10))  # two of them share about 0.5 to 0.6
    assert similar_classes(rows) == list(range(60))
    assert classes_found(spark, rows) == {i: i for i in range(60)}


def test_near_copies_of_the_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    want = similar_classes(rows)
    got = classes_found(spark, rows)
    same = [got[r[0]] == rows[w][0] for r, w in zip(rows, want)]
    assert sum(same) >= 0.995 * len(rows)


def test_near_copies_find_similar_texts(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(4000)]
    texts, pairs = [], []
    for i in range(60):
        words = rng.choices(vocabulary, k=300)
        texts.append((2 * i, " ".join(words)))
        changed = list(words)
        for at in rng.sample(range(300), 4):  # about 0.88 of the shingles stay
            changed[at] = rng.choice(vocabulary)
        texts.append((2 * i + 1, " ".join(changed)))
        a, b = (set(simhash.shingle_bytes(t, 5)) for _, t in texts[-2:])
        pairs.append(len(a & b) / len(a | b) >= simhash.SIMILAR)
    got = {r.doc_id: r.component_id for r in simhash.near_copies(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    found = [got[2 * i + 1] == 2 * i for i in range(60)]
    assert sum(f for f, p in zip(found, pairs) if p) >= 0.95 * sum(pairs)
    assert all(got[2 * i] == 2 * i for i in range(60))

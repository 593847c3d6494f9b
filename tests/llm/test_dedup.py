"""Line chunks, suffixes, and decontamination."""

import collections
import hashlib
import random
import re

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loopgauge.llm import common, decontaminate, linedup, suffixdedup


def plain_lines(rows):
    """Pairs of neighbouring lines seen before, in order of (id, place), are cut but for lines of a pair's first place, and blank lines between cut ones."""
    places, out = collections.defaultdict(list), {}
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0))
    for n, (_, text) in enumerate(rows):
        lines = text.split("\n") if text else []
        for i in range(len(lines) - 1):
            if (lines[i] + lines[i + 1]).strip():
                places[lines[i], lines[i + 1]].append((n, i))
    drop, keep = collections.defaultdict(set), collections.defaultdict(set)
    for at in places.values():
        if len(at) > 1:
            keep[at[0][0]] |= {at[0][1], at[0][1] + 1}
        for n, i in at[1:]:
            drop[n] |= {i, i + 1}
    for n, (doc, text) in enumerate(rows):
        lines = text.split("\n") if text else []
        gone = drop[n] - keep[n]
        marks = "".join("x" if i in gone else " " if not x.strip() else "o" for i, x in enumerate(lines))
        gone |= {i for m in re.finditer("(?<=x) +(?=x)", marks) for i in range(*m.span())}
        out[doc, text] = (len(lines), len(gone), text if not gone else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    return out


def test_windows_resist_shifts():
    rng = random.Random(2)
    lines = [str(rng.random()).encode() for _ in range(300)]
    assert set(linedup.rolling(lines)) < set(linedup.rolling([b"new"] * 3 + lines + [b"end"]))
    assert len(linedup.rolling(lines[:1])) == 0 and linedup.rolling([b"a", b"b"]) != linedup.rolling([b"b", b"a"])


def test_lines_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    want = plain_lines(rows)
    got = linedup.op8(spark, sf).collect()
    assert len(got) == len(rows) and any(r.n_removed for r in got)
    by_id = dict(rows)
    assert all((r.n_lines, r.n_removed, r.text) == want[r.doc_id, by_id[r.doc_id]] for r in got)


def test_equal_hashes_of_different_chunks_stay(spark, monkeypatch):
    real = linedup.chunk_table
    monkeypatch.setattr(linedup, "chunk_table", lambda docs: real(docs).withColumn("h", F.lit(1).cast("long")))
    rows = [(i, f"line {i}\nother {i}\nthird {i % 2}") for i in range(6)] + [(9, "line 0\nother 0\nthird 0")]
    got = {r.doc_id: r.n_removed for r in linedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got.values()) == got[9] > 0


def test_odd_lines(spark, odd, empty):
    got = linedup.deduplicated(odd)
    rows = {(r.doc_id, r.n_removed, r.text) for r in got.collect()}
    assert got.count() == odd.count() and got.columns == [*odd.columns, "n_lines", "n_removed"]
    assert all(r.k == r.score == r.found == "clash" for r in got.collect())
    assert (3, 0, None) in rows and (4, 0, "") in rows and (1, 0, "The of and that.\nSecond line here.\nThird line.") in rows
    assert {x[1] for x in rows if x[0] == 2} != {0}
    assert linedup.deduplicated(empty).count() == 0


def test_a_very_common_chunk_is_dealt_to_many_tasks(spark):
    rows = [(i, f"own {i}\nthe same line\nand another\nend {i}") for i in range(400)] + [(900 + i, f"rare {i % 20}\nlines {i % 20}\n{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.text): (r.n_lines, r.n_removed) for r in linedup.deduplicated(df).collect()}
    want = plain_lines(rows)
    assert got == {(doc, out): (n, m) for (doc, _), (n, m, out) in want.items()}
    assert max(r.s for r in df.select(common.salts(F.lit(400), 1000).alias("s")).collect()) > 100


def plain_runs(rows):
    """Lines inside a run of two or more lines (not all blank) that stands at an earlier place, by comparing all pairs of places; first places of repeated pairs stay."""
    at = [(k, i) for k, (_, t) in enumerate(rows) for i in range(t.count("\n") + 1)]
    lines = [t.split("\n") for _, t in rows]
    gone = [set() for _ in rows]
    for p, (k, i) in enumerate(at):
        for m, j in at[:p]:
            n = 0
            while i + n < len(lines[k]) and j + n < len(lines[m]) and lines[k][i + n] == lines[m][j + n]:
                n += 1
            if n >= 2 and "".join(lines[k][i : i + n]).strip():
                gone[k] |= set(range(i, i + n))
    first, again = {}, set()
    for k, i in at:
        pair = tuple(lines[k][i : i + 2])
        if len(pair) == 2 and "".join(pair).strip():
            again |= {pair} if first.setdefault(pair, (k, i)) != (k, i) else set()
    for pair in again:
        k, i = first[pair]
        gone[k] -= {i, i + 1}
    return {doc: (len(gone[k]), "\n".join(x for i, x in enumerate(lines[k]) if i not in gone[k])) for k, (doc, _) in enumerate(rows)}


def test_pipeline_cuts_repeated_runs_whole(spark):
    import corpus_pipeline

    rng, rows = random.Random(12), []
    runs = [[f"run {r} line {i} {rng.random()}" for i in range(n)] for r, n in enumerate((2, 2, 3, 3, 4, 5, 6, 8, 12))]
    runs.append(["before a gap", "", " ", "", "after the gap"])
    for doc in range(60):
        own = [f"own {doc} {i} {rng.random()}" for i in range(rng.randint(1, 6))]
        at = rng.randint(0, len(own))
        own[at:at] = rng.choice(runs)
        rows.append((doc, "\n".join(own)))
    rows += [(90, "\n".join(runs[4])), (91, "once more\nonce more\nonce more"), (92, "\n".join([*runs[0], "its own end"]))]
    want = plain_runs(rows)
    df = spark.createDataFrame([(i, t, len(t)) for i, t in rows], "doc_id long, text string, n_chars long")
    got = {r.doc_id: (r.n_removed, r.text) for r in linedup.deduplicated(df).collect()}
    assert got == want and sum(n for n, _ in want.values()) > 150
    stage = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup(spark, df, None).collect()}
    assert stage == {i: (t, len(t)) for i, (n, t) in want.items() if t.strip()} and 90 not in stage


def test_what_is_cut_stands_elsewhere(spark):
    rng, rows = random.Random(3), [(1, "alpha one\nbeta two"), (2, "alpha one\nbeta two\ngamma three"), (3, "beta two\ngamma three")]
    rows += [(i, "\n".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))) for i in range(10, 60)]
    found = linedup.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: (r.n_removed, r.text) for r in found.collect()}
    assert got[2] == (1, "beta two\ngamma three") and got[3] == (2, "") and sum(n for n, _ in got.values()) > 30
    pairs = lambda texts: collections.Counter(p for t in texts for p in zip(t.split("\n"), t.split("\n")[1:], strict=False))
    repeated = {p for p, n in pairs(t for _, t in rows).items() if n > 1}
    assert len(repeated) > 40 and repeated <= set(pairs(t for _, t in got.values()))


def plain_suffixes(rows):
    counts, out = collections.Counter(), []
    data = [(i, (t or "").encode()) for i, t in rows]
    for _, d in data:
        counts.update(d[a : a + 200] for a in range(len(d) - 199))
    for i, d in data:
        gone = np.zeros(len(d) + 1, bool)
        for a in range(len(d) - 199):
            if counts[d[a : a + 200]] > 1:
                gone[a : a + 200] = True
        kept = bytes(x for x, g in zip(d, gone) if not g)
        out.append((i, len(d), int(gone.sum()), int(np.diff(np.r_[False, gone].astype(int)).clip(0).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found_suffixes(df):
    return sorted((tuple(r) for r in suffixdedup.removed(df).selectExpr("doc_id", "n_bytes", "n_removed", "n_spans", "sha2(kept, 256)").collect()), key=str)


def test_op6_against_brute_force(spark, sf):
    rows = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    got = sorted((tuple(r) for r in suffixdedup.op6(spark, sf).collect()), key=str)
    assert got == plain_suffixes(rows)


@pytest.mark.parametrize("limit", [0, 4, 20_000])
def test_suffixes_of_shaped_texts(spark, monkeypatch, limit):
    rng = random.Random(7)
    monkeypatch.setattr(suffixdedup, "LIMIT", limit)  # 0: every repeated gram counts as hot
    base = "".join(rng.choice("ab cdé") for _ in range(1500))
    rows = [(1, base), (2, base[:700] + "X" + base[700:]), (3, base[200:600]), (4, None), (5, ""), (6, "short"), (7, "a" * 600), (8, "xy" * 300), (9, "q" + "a" * 199), (10, base[100:299]), (11, base[700:900]), (None, base[:500]), (12, base[:500]), (12, base[:500]), (13, "z" * 200), (14, "k" * 201)]
    for j in range(25):
        t = list(base)
        for _ in range(rng.randint(1, 8)):
            t[rng.randrange(len(t))] = rng.choice("xyz")
        rows.append((100 + j, "".join(t)))
    monkeypatch.setattr(suffixdedup, "MERGE", 3000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert found_suffixes(df) == plain_suffixes(rows)


def test_a_hot_phrase_in_many_contexts(spark, monkeypatch):
    rng = random.Random(3)
    phrase, letters = "".join(rng.choices("abcdefgh ", k=330)), "ijklmnop"
    rows = [(i, "".join(rng.choices(letters, k=rng.randint(0, 150))) + phrase[: rng.choice((170, 199, 200, 230, 330))] + "".join(rng.choices(letters, k=rng.randint(0, 150)))) for i in range(300)]
    monkeypatch.setattr(suffixdedup, "LIMIT", 50)
    assert found_suffixes(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == plain_suffixes(rows)


def test_odd_suffixes(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.filter("doc_id IS NULL OR doc_id <> 5").collect()]
    assert found_suffixes(odd.filter("doc_id IS NULL OR doc_id <> 5")) == plain_suffixes(rows)
    assert suffixdedup.removed(odd).count() == odd.count() and suffixdedup.removed(empty).count() == 0


class Row(suffixdedup.Run):
    def __init__(self, entries):
        entries = sorted(entries)
        super().__init__(suffixdedup.front_coded([(e, [(0, 0, i)]) for i, e in enumerate(entries)]))


@settings(deadline=None, max_examples=60)
@given(st.lists(st.lists(st.binary(max_size=5), max_size=12, unique=True), min_size=1, max_size=9))
def test_merge_keeps_order_and_prefixes(runs):
    runs = [[suffixdedup.entry(b"y" * 40 + e, 0) for e in r] for r in runs]
    got = [(z, n) for z, n, _, _ in suffixdedup.merged([Row(r) for r in runs if r])]
    assert [z for z, _ in got] == sorted(z for r in runs for z in r)
    for (a, _), (b, n) in zip(got, got[1:]):
        assert n == suffixdedup.shared_prefix(a, b)


@settings(deadline=None, max_examples=60)
@given(st.lists(st.tuples(st.sampled_from([b"aa", b"ab", b"b"]), st.sampled_from([b"q", b"qr", b"s"]), st.booleans()), min_size=1, max_size=8, unique_by=lambda x: x[:2]))
def test_offsets_against_pairs(parts):
    width, left = suffixdedup.WIDTH, suffixdedup.LEFT
    rows = sorted((right.rjust(120, b"m").ljust(width, b"n") + back.rjust(50, b"k").ljust(left, b"j"), many) for right, back, many in parts)
    entries, many = [r[0] for r in rows], [r[1] for r in rows]
    shared = [0, *(suffixdedup.shared_prefix(a, b) for a, b in zip(entries, entries[1:]))]
    got = suffixdedup.repeated_offsets(entries, shared, many)
    for i, a in enumerate(entries):
        for o in range(suffixdedup.GRAMS):
            window = lambda z: (z[: width - o], z[width : width + o])
            assert got[i, o] == (many[i] or any(window(a) == window(b) for j, b in enumerate(entries) if j != i))


def words(rng, n):
    return ["".join(rng.choices("abcdefghijk", k=5)) for _ in range(n)]


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row = _next(row, x, b)
        return row[-1]

    def _next(row, x, b):
        new = [0]
        for j, y in enumerate(b):
            new.append(max(row[j + 1], new[j], row[j] + (x == y)))
        return new

    rng = random.Random(4)
    for _ in range(200):
        a, b = (rng.choices([b"a", b"b", b"c", b"d"], k=rng.randint(0, 12)) for _ in "ab")
        assert decontaminate.common_subsequence(a, b) == plain(a, b)


def test_paraphrases_are_found_and_others_are_not(spark):
    rng = random.Random(9)
    filler = words(rng, 3000)
    items = [(i, " ".join(words(rng, rng.randint(14, 55)))) for i in range(40)] + [(99, None), (98, ""), (97, " ".join(words(rng, 400)))]
    docs, wanted = [], set()
    for i in range(200):
        text = rng.choices(filler, k=rng.randint(60, 900))
        if i % 4 == 0:
            item, passage = items[rng.randrange(40)]
            passage = passage.split()
            for at in rng.sample(range(len(passage)), len(passage) // 7):  # about one word in seven is another one
                passage[at] = rng.choice(filler)
            at = rng.randrange(len(text))
            text[at:at] = passage
            wanted.add((i, item))
        docs.append((i, " ".join(text)))
    part = items[-1][1].split()[150:220]
    docs.append((500, " ".join([*filler[:100], *part, *filler[:50]])))
    wanted.add((500, 97))
    docs += [(501, None), (502, "")]
    found = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert got <= wanted and len(got) >= 0.95 * len(wanted)


def test_recall_of_candidates(spark, sf):
    docs, bench = common.table(spark, sf, "documents"), common.table(spark, sf, "benchmark")
    norm = lambda t: b" " + b" ".join(decontaminate.words_of(t)) + b" "
    texts = [(r.doc_id, norm(r.text)) for r in docs.collect()]
    exact = {(d, b.item_id) for b in bench.collect() for d, t in texts if norm(b.text) in t}
    got = {(r.doc_id, r.item_id) for r in decontaminate.op4(spark, sf).collect()}
    assert exact and len(exact & got) >= 0.9 * len(exact)
    assert exact <= got


def test_odd_contamination(spark, odd, empty):
    bench = spark.createDataFrame([(1, "Second line here. Third line."), (1, "Second line here. Third line."), (None, None), (2, "")], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(odd, bench).collect()}
    assert got == {(1, 1), (2, 1)}
    assert decontaminate.contaminated(empty, bench).count() == 0
    assert decontaminate.contaminated(odd, bench.limit(0)).count() == 0


def test_blocks_of_the_benchmark(spark, monkeypatch):
    rng = random.Random(3)
    items = [(i, " ".join(words(rng, 20))) for i in range(30)]
    docs = spark.createDataFrame([(i, "x y z " + t) for i, t in items], "doc_id long, text string")
    monkeypatch.setattr(decontaminate, "BLOCK", 10)
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {(i, i) for i in range(30)}


def found_pairs(spark, docs, items):
    return {(r.doc_id, r.item_id) for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()}


def test_passages_in_a_third_of_all_documents(spark):
    rng = random.Random(21)
    filler = words(rng, 2000)
    items = [(i, " ".join(words(rng, 40))) for i in range(12)]  # the first is hot, the others keep the index alive
    docs = [(i, " ".join([*rng.choices(filler, k=80), *(items[0][1].split() if i % 3 == 0 else []), *rng.choices(filler, k=80)])) for i in range(90)]
    docs += [(100 + i, " ".join([*rng.choices(filler, k=50), t])) for i, t in items[1:]]
    near = items[0][1].split()
    for at in (5, 12, 19, 26):
        near[at] = rng.choice(filler)  # a paraphrase of the hot passage
    docs.append((200, " ".join([*rng.choices(filler, k=60), *near, *rng.choices(filler, k=60)])))
    assert found_pairs(spark, docs, items) == {(i, 0) for i in range(0, 90, 3)} | {(100 + i, i) for i in range(1, 12)} | {(200, 0)}


@pytest.mark.parametrize("n", [3, 4, 5])
def test_passages_in_small_tables(spark, n):
    rng = random.Random(n)
    items = [(i, " ".join(words(rng, 30))) for i in range(2)]
    docs = [(i, " ".join([*words(rng, 60), *(items[0][1].split() if i < 2 else []), *(items[1][1].split() if i == 2 else [])])) for i in range(n)]
    assert found_pairs(spark, docs, items) == {(0, 0), (1, 0), (2, 1)}


def test_verbatim_copies_need_no_candidates(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(words(rng, 20 + 30 * i))) for i in range(5)]
    docs = [(i, " ".join([*words(rng, 37 * i), t, *words(rng, 50)])) for i, t in items]
    monkeypatch.setattr(decontaminate, "COSINE", 9.0)
    assert found_pairs(spark, docs, items) == {(i, i) for i in range(5)}


def test_randomised_svd(spark):
    rng = np.random.default_rng(1)
    a = rng.random((40, 30)) * (rng.random((40, 30)) < 0.3)
    rows = [(np.flatnonzero(r).tolist(), r[r > 0].tolist()) for r in a]
    v = decontaminate.randomised_svd(spark.createDataFrame(rows, "at array<int>, weight array<double>").repartition(3), 30, rank=5, over=25)
    exact = np.linalg.svd(a)[2][:5]
    assert np.allclose(np.abs(exact @ v), np.eye(5), atol=1e-6)


def plain_search(docs, items, rank):
    """Contaminated (doc, item) pairs by an exact decomposition, all cosines and plain longest common subsequences."""
    d = decontaminate
    passages = [(i, p) for i, t in items for p in d.passages_of(d.words_of(t))]
    texts = [(i, d.words_of(t)) for i, t in docs]
    vocabulary = {w: k for k, w in enumerate(sorted({w for _, p in passages for w in p}))}
    df = collections.Counter(w for _, t in texts for w in set(t) & vocabulary.keys())
    n, idf = len(texts), np.zeros(len(vocabulary))
    for w, k in vocabulary.items():
        idf[k] = np.log((1 + n) / (1 + df[w])) if df[w] <= d.COMMON * n else 0
    for _, p in passages:
        if len({w for w in p if idf[vocabulary[w]] > 0}) < d.FEW:
            for w in p:
                k = vocabulary[w]
                idf[k] = idf[k] or np.log1p(n / max(1, df[w]))

    def bag(words):
        v = np.zeros(len(vocabulary))
        for w in words:
            if w in vocabulary:
                v[vocabulary[w]] += idf[vocabulary[w]]
        return v

    rows = np.array([bag(p) for _, p in passages])
    unit = rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
    basis = np.linalg.svd(unit, full_matrices=False)[2][:rank].T
    latent = rows @ basis
    lengths = np.linalg.norm(latent, axis=1)
    found = set()
    for doc, t in texts:
        for block in range(-1, len(t) // d.STEP + 1):
            window = bag(t[max(0, block * d.STEP) : (block + 2) * d.STEP]) @ basis
            if not (norm := np.linalg.norm(window)):
                continue
            reach = latent @ window / np.maximum(lengths, 1e-12)
            for k in np.flatnonzero((reach >= d.COSINE * norm) & (reach >= d.REACH * lengths)):
                item, p = passages[k]
                near = t[max(0, (block - 1) * d.STEP) : max(0, block + 3) * d.STEP]
                weighted = {w for w in p if idf[vocabulary[w]] > 0}
                answer = {w for w in p[2 * len(p) // 3 :] if w in weighted} or weighted
                row = [0] * (len(near) + 1)
                for x in p:
                    new = [0]
                    for j, y in enumerate(near):
                        new.append(max(row[j + 1], new[j], row[j] + (x == y)))
                    row = new
                if row[-1] >= d.OVERLAP * len(p) and len(answer & set(near)) >= d.ANSWER * len(answer):
                    found.add((doc, item))
        line = b" " + b" ".join(t) + b" "
        found |= {(doc, item) for item, p in passages if b" " + b" ".join(p) + b" " in line}
    return found


def test_op4_against_plain_search(spark, sf):
    docs = [(r.doc_id, r.text) for r in common.table(spark, sf, "documents").collect()]
    items = [(r.item_id, r.text) for r in common.table(spark, sf, "benchmark").collect()]
    assert {(r.doc_id, r.item_id) for r in decontaminate.op4(spark, sf).collect()} == plain_search(docs, items, decontaminate.RANK)
    rng, planted = random.Random(13), []
    for i in range(80):  # paraphrases from equal to beyond recognition
        words = rng.choice(items)[1].split()
        for at in rng.sample(range(len(words)), int(len(words) * rng.choice((0, 0.1, 0.2, 0.28, 0.33, 0.5)))):
            words[at] = rng.choice(docs[rng.randrange(50)][1].split() or ["x"])
        planted.append((10_000 + i, docs[i][1] + " " + " ".join(words) + " " + docs[i + 80][1]))
    want = plain_search(docs + planted, items, decontaminate.RANK)
    got = found_pairs(spark, docs + planted, items)
    assert 80 > len(want) > 30 and len(got ^ want) <= 0.04 * len(want)  # the basis is random, so pairs at a limit may fall on either side

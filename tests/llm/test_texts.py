"""Quality, language and licenses."""

import re
import struct
import zlib

import numpy as np
import xxhash
import zstandard
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loopgauge.llm import common, langid, licenses, quality

SF = "/root/testdata/sf0.01"


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def test_op2_on_held_out_rows(spark, sf):
    rows = langid.op2(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in common.table(spark, SF, "documents").collect()}
    assert len(rows) == len(truth) and all(r.held_out == held(r.doc_id) and 0 <= r.score <= 1 for r in rows)
    tested = [r.lang_pred == truth[r.doc_id] for r in rows if r.held_out and truth[r.doc_id]]
    assert np.mean(tested) >= 0.97


def test_language_of_odd_rows(spark, odd, empty):
    rows = langid.identified(odd).select("doc_id", "lang_pred", "score").collect()
    by_id = {r.doc_id: r for r in rows}
    assert len(rows) == odd.count()
    assert {i for i, r in by_id.items() if r.lang_pred == "und"} == {3, 4, 8} and by_id[3].score == 0
    assert langid.identified(empty).count() == 0
    none = odd.withColumn("lang", odd.lang.substr(0, 0))
    assert {r.lang_pred for r in langid.identified(none.filter("lang IS NULL")).collect()} == {"und"}


def test_counts_equal_bound_vectors():
    e = langid.Encoder()
    text = "Abc dé.  xyz"
    symbols = [0, *(int(e.symbol[ord(c)]) for c in text), 0]
    kept = [s for i, s in enumerate(symbols) if s or i == 0 or symbols[i - 1]]
    want = np.zeros(langid.DIM)
    for i in range(len(kept) - 2):
        if kept[i + 1]:
            want += np.prod([e.at[k][kept[i + k]].astype(int) for k in range(3)], axis=0)
    assert (e.bundle([text])[0] == want).all()


def test_long_texts_are_read_in_pieces(monkeypatch):
    e, text = langid.Encoder(), "some words and others, " * 40
    whole = e.bundle([text, None, "", "a"])
    monkeypatch.setattr(langid, "PIECE", 50)
    parts = langid.Encoder().bundle([text, None, "", "a"])
    cos = (whole[0] @ parts[0]) / np.linalg.norm(whole[0]) / np.linalg.norm(parts[0])
    assert cos > 0.98 and not parts[1].any() and not parts[2].any() and parts[3].any()


def test_op1_on_held_out_rows(spark, sf):
    rows = quality.op1(spark, SF).collect()
    truth = {r.doc_id: r.quality for r in common.table(spark, SF, "labels").collect()}
    assert all(r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1 and r.held_out == held(r.doc_id) for r in rows)
    tested = [r.predicted == truth[r.doc_id] for r in rows if r.held_out and r.doc_id in truth]
    assert np.mean(tested) >= 0.8  # 300 labelled rows; sf0.1 reaches 0.99


def test_quality_of_odd_rows(spark, odd, empty):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 9)] + [(None, 1, 0), (1, None, 0)], "doc_id long, quality int, toxic int")
    docs = odd.select("doc_id", "text")
    rows = quality.scored(docs, quality.fit(docs, labels)).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert quality.fit(empty, labels) is None and quality.fit(docs, labels.limit(0)) is None
    assert quality.scored(docs, None).first().score == 0.5
    assert quality.scored(empty.select("doc_id", "text"), None).count() == 0


def test_curve():
    x = np.r_[np.linspace(-1, 0.2, 50), np.linspace(-0.2, 1, 50)]
    y = np.r_[np.zeros(50), np.ones(50)].astype(int)
    a, b = quality.fit_curve(x, y)
    assert b > 0 and abs(a) < 0.5
    assert quality.fit_curve(x, np.ones(100)) == (0.0, 0.0)


def plain_scan(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    found = [(i, label) for phrase, label in licenses.BASE.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(found)


PARTS = ["under the MIT license", "Apache License, Version 2.0", "CC BY-NC 4.0", "é", " ", "\n", "word", "under", "the", "cc", "by", "nc", ".", "GNU GPL v3"]


@given(st.lists(st.sampled_from(PARTS), max_size=12).map(" ".join))
def test_base_places(text):
    got = SCANNER.scan(text)
    assert (got["n_words"], got["base"]) == plain_scan(text)
    assert {label for _, label in got["base"]} <= {d[2] for d in got["detections"]}


SCANNER = licenses.Scanner()


def test_rules_overlap():
    labels = lambda t: sorted({d[2] for d in SCANNER.scan(t)["detections"]})
    assert labels("Released under the GNU General Public License v3 or later.") == ["gpl-3+"]
    assert labels("SPDX-License-Identifier: MPL-2.0") == ["mpl-2"]
    assert labels("Copyright 2020 X. All rights reserved.") == ["copyright", "proprietary"]
    assert labels("Redistribution and use in source and binary forms, with or without modification") == ["bsd"]
    assert labels("Creative Commons Attribution-ShareAlike 4.0 International") == ["cc-by-sa-4.0"]
    assert labels("permit license") == [] and labels(None) == []
    assert len(SCANNER.rules) > 300


@given(st.lists(st.sampled_from(PARTS), max_size=30).map(" ".join))
def test_suppressed_detections_lie_inside_accepted_ones(text):
    found = [(a, z) for a, z, _, _ in SCANNER.scan(text)["detections"]]
    base = {(i, i + len(phrase.split()) - 1) for i, label in plain_scan(text)[1] for phrase, name in licenses.BASE.items() if name == label}
    assert all(not (a <= c and d <= b) for k, (c, d) in enumerate(found) if (c, d) not in base for a, b in found[:k])


def test_op3(spark, sf, odd, empty):
    texts = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    for r in licenses.op3(spark, sf).collect():
        n, base = plain_scan(texts[r.doc_id])
        assert (r.n_words, r.n_base, r.base_labels) == (n, len(base), ",".join(sorted({x for _, x in base})))
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
        assert set(r.base_labels.split(",")) - {""} <= set(r.labels.split(",")) and 0 <= r.score <= 1
    assert licenses.scanned(odd).count() == odd.count() and licenses.scanned(empty).count() == 0


def test_many_kinds_of_letters_are_split(monkeypatch):
    e = langid.Encoder()
    texts = ["".join(chr(c) for c in range(a, a + 400)) for a in (0x61, 0x400, 0x4E00, 0xAC00)]
    whole = e.bundle(texts)
    monkeypatch.setattr(langid, "CELLS", 100)
    assert (langid.Encoder().bundle(texts) == whole).all()


def shortest(parsed):
    """A text that a parsed regex matches: first branches, fewest repeats."""
    out = ""
    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            out += chr(arg)
        elif name in ("MAX_REPEAT", "MIN_REPEAT"):
            out += shortest(arg[2]) * arg[0]
        elif name == "SUBPATTERN":
            out += shortest(arg[3])
        elif name == "BRANCH":
            out += shortest(arg[1][0])
        elif name == "IN":
            out += next((chr(a) for o, a in arg if str(o) == "LITERAL"), "7")  # else a digit
        elif name == "ANY":
            out += "x"
    return out


def test_every_license_rule_finds_its_text():
    import re._parser as parser

    scanner = licenses.Scanner()
    assert len(licenses.NOTICES.splitlines()) > 150 and len(scanner.rules) > 500
    for rule in scanner.rules:
        text = shortest(parser.parse(rule.regex.pattern.decode().removeprefix("(?<= )").removesuffix("(?= )")))
        found = scanner.scan(f"Before it, {text}. After.")["detections"]
        covered = {i for a, z, _, _ in found for i in range(a, z + 1)}
        assert covered >= set(range(2, 2 + len(text.split()))), (rule.label, text, found)


def test_rare_languages_keep_all_training_rows(spark):
    df = spark.createDataFrame([(i, "text", "big" if i % 10 else "rare") for i in range(4000)] + [(9999, "x", None)], "doc_id long, text string, lang string")
    got = {r.lang: r["count"] for r in langid.training_rows(df, 500).groupBy("lang").count().collect()}
    every = {r.lang: r["count"] for r in langid.training_rows(df, 10**6).groupBy("lang").count().collect()}
    assert got["rare"] == every["rare"] < 500 and 350 < got["big"] < 650 < every["big"]


def test_repeated_ids_do_not_swell_the_fit(spark, monkeypatch):
    monkeypatch.setattr(quality, "CURVE_ROWS", 30)
    monkeypatch.setattr(quality, "DICT_BLOCKS", 40)
    rows = [(i, f"good words {i} of prose " * 60 if i % 2 else f"zzz!!! {i} buy now " * 60) for i in range(200)] + [(7, "good words of prose " * 900)] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int")
    got = quality.scored(docs, quality.fit(docs, labels)).groupBy((F.col("doc_id") % 2).alias("good")).agg(F.avg("score").alias("s")).collect()
    by = {r.good: r.s for r in got}
    assert by[1] > 0.7 > 0.3 > by[0]


def ungated(text):
    """Labels and best confidence by trying every rule at every place, and comparing every pair of intervals."""
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode("utf-8", "replace")))
    line = b" " + b" ".join(words) + b" "
    hits = []
    for i, rule in enumerate(SCANNER.rules):
        at = 0
        while m := rule.regex.search(line, at):
            hits.append((rule.priority, -m[0].count(b" "), line[: m.start()].count(b" ") - 1, i, line[: m.end()].count(b" ") - 1))
            at = m.start() + 1 if rule.priority == 0 else m.end()
    kept = []
    for priority, _, first, i, last in sorted(hits):
        if priority == 0 or not any(a <= first and last <= z for a, z, _ in kept):
            kept.append((first, last, i))
    return sorted({SCANNER.rules[i].label for _, _, i in kept}), max((SCANNER.rules[i].confidence for _, _, i in kept), default=0.0)


def test_op3_against_an_ungated_scan(spark, sf):
    texts = {r.doc_id: r.text for r in common.table(spark, sf, "documents").collect()}
    rows = licenses.op3(spark, sf).collect()
    assert len(rows) == len(texts) and len({r.labels for r in rows}) > 2
    for r in rows:
        labels, score = ungated(texts[r.doc_id])
        assert (r.labels, r.score) == (",".join(labels), score)


@given(st.lists(st.sampled_from(PARTS), max_size=10).map(" ".join))
def test_labels_of_any_text(text):
    got = SCANNER.scan(text)
    assert sorted({d[2] for d in got["detections"]} | {b[1] for b in got["base"]}) == ungated(text)[0]


def spark_hash(*values):
    """Spark's xxhash64 of whole numbers: each value's hash is the seed of the next; short ones are 4 bytes."""
    h = 42
    for v, short in values:
        h = xxhash.xxh64_intdigest(struct.pack("<i" if short else "<q", v), seed=h)
    return h - 2**64 if h >= 2**63 else h


def test_op1_against_a_plain_run(spark, sf):
    texts = {r.doc_id: r.text for r in common.table(spark, SF, "documents").collect()}
    labels = [(r.doc_id, r.quality) for r in common.table(spark, SF, "labels").collect() if not held(r.doc_id) and r.quality in (0, 1)]
    half = lambda salt: [(d, q) for d, q in labels if spark_hash((d, False)) % 2 == salt]
    samples = {q: [p for *_, p in sorted((spark_hash((d, False), (i, True)), d, i, p) for d, k in half(0) if k == q and d in texts for i, p in enumerate(quality.blocks(texts[d])))] for q in (0, 1)}
    coders = {}
    for q, parts in samples.items():
        assert 0 < len(parts) <= quality.DICT_BLOCKS
        coders[q] = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(quality.build_dictionary(parts)), write_content_size=False, write_checksum=False, write_dict_id=False)
    gain = lambda t: sum(len(coders[0].compress(p)) - len(coders[1].compress(p)) for p in quality.blocks(t)) / max(1, len((t or "").encode()))
    x = np.array([[gain(texts[d]), q] for d, q in half(1) if d in texts])
    a, b = quality.fit_curve(x[:, 0], x[:, 1].astype(int))
    rows = quality.op1(spark, SF).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert abs(r.score - 1 / (1 + np.exp(-(a + b * gain(texts[r.doc_id]))))) < 1e-6

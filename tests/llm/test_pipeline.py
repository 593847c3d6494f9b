import collections
import subprocess
import sys
import zlib
from concurrent.futures import ThreadPoolExecutor

import duckdb
import numpy as np
import pandas as pd
from test_dedup import plain_lines, plain_search
from test_simhash import similar_classes

import corpus_pipeline
from loopgauge.llm import common, decontaminate, langid, mixing


def test_stages(spark, sf):
    docs = common.table(spark, sf, "documents")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        out = common.stored(stage(spark, docs, sf), "stage")
        if name != "source_mixing":
            assert out.columns == columns
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.7 * counts[0]
    assert docs.select("place").distinct().count() == counts[-1]
    assert decontaminate.contaminated(docs, common.table(spark, sf, "benchmark")).count() == 0


def test_stages_take_odd_and_empty_rows(spark, sf, odd, empty):
    for rows in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, sf)
            places = ["source_block", "slot", "place"] if name == "source_mixing" else []
            assert out.columns == [c for c in rows.columns if c not in places] + places
            got = out.collect()
            assert len(got) <= rows.count() and all(r.found == r.block == r.score == r.k == "clash" for r in got if rows is odd)


def test_repeated_and_missing_ids_and_clashing_names(spark, sf):
    bad = common.table(spark, sf, "benchmark").first().text
    own = lambda i: " ".join(f"{w}{i}" for w in "some words of a document that is unlike all others here".split())
    rows = [(1, own(1)), (1, bad + " " + own(2)), (None, bad + " " + own(3)), (None, own(4)), (5, own(5) + "\nshared line one\nshared line two"), (6, own(6) + "\nshared line one\nshared line two")]
    docs = spark.createDataFrame([(i, t, "en", "s", 77, 88) for i, t in rows], "doc_id long, text string, lang string, source string, n_removed long, n_lines long")
    left = corpus_pipeline.decontamination(spark, docs, sf)
    assert left.columns == docs.columns and sorted((r.text for r in left.collect())) == sorted(t for _, t in rows if bad not in t)
    cut = corpus_pipeline.line_dedup(spark, docs, sf)  # a table without n_chars
    assert cut.columns == docs.columns and {(r.n_removed, r.n_lines) for r in cut.collect()} == {(77, 88)} and cut.filter("doc_id = 6").first().text == own(6)
    kept = corpus_pipeline.near_dedup(spark, left.union(left.filter("doc_id = 1")), sf)
    assert sorted(r.text for r in kept.collect()) == sorted([own(1), *(t for _, t in rows if bad not in t)])  # rows that repeat id and text are one document
    assert corpus_pipeline.language_id(spark, docs, sf).count() == len(rows)


def test_two_runs_side_by_side(spark, sf):
    with ThreadPoolExecutor(2) as pool:
        a, b = pool.map(lambda _: sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect()), range(2))
    assert a == b and a


def test_run_equals_its_stages(spark, sf):
    first = corpus_pipeline.run(spark, sf).collect()
    assert sorted(r.doc_id for r in first) == sorted(r.doc_id for r in corpus_pipeline.run(spark, sf).collect())


def plain_profile(encoder, text):
    """The bundle of a text's trigrams, each bound letter by letter."""
    symbols = [0, *(int(encoder.symbol[ord(c)]) for c in text or ""), 0]
    kept = [s for i, s in enumerate(symbols) if s or i == 0 or symbols[i - 1]]
    total = np.zeros(langid.DIM)
    for gram, n in collections.Counter(g for g in zip(kept, kept[1:], kept[2:]) if g[1]).items():
        total += n * np.prod([encoder.at[k][s].astype(int) for k, s in enumerate(gram)], axis=0)
    return total


def plain_languages(rows):
    """Rows (id, text, lang, ...) that the first stage keeps."""
    encoder, sums = langid.Encoder(), collections.defaultdict(lambda: np.zeros(langid.DIM))
    profiles = [plain_profile(encoder, r[1]) for r in rows]
    for r, v in zip(rows, profiles):
        if r[2] is not None and zlib.crc32(str(r[0]).encode()) % 4 != 2:
            sums[r[2]] += v
    kept = []
    for r, v in zip(rows, profiles):
        if norm := np.linalg.norm(v):
            best = max(v @ p / norm / np.linalg.norm(p) for p in sums.values())
            if max(0.0, best) >= corpus_pipeline.LEAST - corpus_pipeline.DEVIATIONS / len(r[1]) ** 0.5:
                kept.append(r)
    return kept


def plain_run(rows, items):
    """(doc_id, text, lang, source, n_chars, source_block, slot, place) of rows (doc_id, text, lang, source, n_chars), stage after stage without Spark."""
    rows = plain_languages(sorted(rows))
    cut = plain_lines([r[:2] for r in rows])
    lines = [(r, *cut[r[:2]]) for r in rows]
    rows = [(r[0], text, *r[2:4], len(text) if gone else r[4]) for r, _, gone, text in lines if not gone or text.strip(" ")]
    rows = [r for i, (r, least) in enumerate(zip(rows, similar_classes([r[:2] for r in rows]))) if least == i]
    bad = {doc for doc, _ in plain_search([r[:2] for r in rows], items, decontaminate.RANK)}
    rows = [r for r in rows if r[0] not in bad]
    documents = pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"])  # noqa: F841, read by DuckDB
    places = {p[0]: p[1:] for p in duckdb.sql(f"SELECT doc_id, source_block, slot, place FROM ({mixing.ORACLE})").fetchall()}
    return sorted((*r, *places[r[0]]) for r in rows)


def test_run_against_brute_force(spark, sf):
    rows = [tuple(r) for r in common.table(spark, sf, "documents").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    items = [(r.item_id, r.text) for r in common.table(spark, sf, "benchmark").collect()]
    names = ["doc_id", "text", "lang", "source", "n_chars", "source_block", "slot", "place"]
    want = plain_run(rows, items)
    assert 0.5 * len(rows) < len(want) < len(rows)
    assert sorted(tuple(r) for r in corpus_pipeline.run(spark, sf).select(*names).collect()) == want


def test_the_rest_works_without_llm(tmp_path):
    code = "import sys; sys.modules['loopgauge.llm'] = None; sys.modules['corpus_pipeline'] = None\nimport __spark_entry__ as e\nassert e.queries() and not any(q.startswith('op') for q in e.queries()) and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=corpus_pipeline.__file__.rsplit("/", 1)[0])

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import verify
from loopgauge.llm import fim


def against_sql(spark, docs, result):
    con = duckdb.connect()
    con.register("documents", docs)
    cursor = con.execute(fim.ORACLE)
    names = [d[0] for d in cursor.description]
    return verify.rows_of(names, cursor.fetchall()) == verify.rows_of(result.columns, result.collect())


def digests(found):
    return found.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"),
    )


def test_op12_against_sql(spark, sf):
    import pyarrow.parquet as pq

    assert against_sql(spark, pq.read_table(f"{sf}/documents.parquet"), fim.op12(spark, sf))


def test_odd_rows(spark, odd, empty):
    rows = fim.filled(odd)
    assert set(rows.columns) == (set(odd.columns) | set(fim.RESULT)) and rows.filter("k = 'clash'").count() == odd.count()
    assert against_sql(spark, odd.select("doc_id", "text").toArrow(), digests(rows))
    assert rows.filter("restored <> coalesce(text, '')").count() == 0
    by_id = {r.doc_id: r for r in rows.collect()}
    assert by_id[3].form == by_id[4].form == "plain" and by_id[3].n == 0 and by_id[3].prefix is None and by_id[3].output == ""
    assert fim.filled(empty).count() == 0


@pytest.mark.parametrize("char", [fim.END, fim.ESCAPE, fim.WAS_END, fim.WAS_ESCAPE, "$", "\\", "\n", "<", "é", "\U0001f600"])
def test_signs_of_the_method_in_texts(spark, char):
    pieces = ["ab", char, char + fim.WAS_END, fim.ESCAPE + char, char * 3, "x<P", ">y"]
    rows = [(i, "".join(pieces[(i * k + k * k) % 7] for k in range(1, 9))) for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = fim.filled(docs)
    assert against_sql(spark, docs.toArrow(), digests(found))
    forms = {r.form for r in found.collect()}
    assert forms == {"plain", "psm", "spm"}


def test_parts_are_the_text(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = fim.filled(docs).filter("form <> 'plain'").select("doc_id", "prefix", "middle", "suffix", "restored").join(docs.select("doc_id", F.col("text").alias("was")), "doc_id")
    assert found.count() > 0 and found.filter(F.concat("prefix", "middle", "suffix") != F.col("was")).count() == 0
    assert found.filter("restored <> was").count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(codec="utf-8"), max_size=40), min_size=1, max_size=20))
def test_any_text_comes_back(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert against_sql(spark, docs.toArrow(), digests(fim.filled(docs)))

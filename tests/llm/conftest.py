import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    import os

    if not os.path.isdir(SF):
        pytest.skip("the tables are not here")
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Rows that every operator must take: nulls, empty and very long texts, ties, repeats, extra columns with clashing names."""
    from pyspark.sql import functions as F

    long = "the of and that in with on by ".split()
    texts = [
        (1, "The of and that.\nSecond line here.\nThird line."), (2, "The of and that.\nSecond line here.\nThird line."), (2, "The of and that.\nSecond line here.\nThird line."),
        (3, None), (4, ""), (None, "words without an id that are few"), (5, " ".join(long[i * 7 % 8] + str(i % 97) for i in range(60_000))), (6, "\x00퟿ é 日本語 \n\n\n"), (7, "x" * 3000), (8, "..."),
    ]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    return df.withColumns({
        "lang": F.when(F.col("doc_id") == 3, None).otherwise("en"), "source": F.when(F.col("doc_id") == 4, None).otherwise("s1"), "n_chars": F.length("text").cast("long"),
        "k": F.lit("clash"), "score": F.lit("clash"), "fp": F.lit("clash"), "slot": F.lit("clash"), "n": F.lit("clash"), "h": F.lit(None).cast("string"), "page_id": F.col("doc_id"),
        **{c: F.lit("clash") for c in ("found", "gone", "cycle_slot", "_before", "before", "block", "bucket", "row", "first", "lang_pred", "gone_id", "keep", "times", "node", "ranges")},
    })


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")

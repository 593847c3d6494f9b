import os

import pytest

import verify
from loopgauge.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equal_to_sql(spark, name):
    assert verify.compare(spark, SF, name)[0] is True


def test_entry_has_all_queries():
    import __spark_entry__ as entry

    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())


def both(spark, tmp_path, name, **tables):
    """Rows of a query over given tables (Arrow), from Spark and from its SQL, without order."""
    import duckdb
    import pyarrow.parquet as pq

    con = duckdb.connect()
    for t, rows in tables.items():
        pq.write_table(rows, f"{tmp_path}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet'")
    df = queries.QUERIES[name](spark, str(tmp_path))
    cursor = con.execute(queries.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(d[0] for d in cursor.description)
    return verify.rows_of(df.columns, df.collect()), verify.rows_of([d[0] for d in cursor.description], cursor.fetchall())


def test_hits_of_every_text_itself(spark, tmp_path):
    import pyarrow as pa

    from loopgauge.functions import patterns

    own = ["prose", "", None, "while it was mid afternoon, for l and r: left += 1 mid = 2", "call xs.sort() for all", "for i in range(n) for j", "for i in range(a:b) and for j", "while left < right: low += 2", "while x: i += 1", "while left < 3: i += 1", "Éwhile mid l=mid"]
    rows = [(10 * i + k, text) for i, text in enumerate(own) for k in range(10)]
    got, wanted = both(spark, tmp_path, "pattern_hits_in_documents", documents=pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows]}))
    assert got == wanted and len(got) == 100  # every text, with the code behind it or not
    code_hit, doc_id, hit, pattern = zip(*got)
    assert {p for p in pattern if p != "None"} == {d.name for d in patterns.DETECTORS}
    assert {d for d, h in zip(doc_id, hit) if h != "None"} == {str(10 * i + k) for i in (3, 4, 5, 6, 7, 8) for k in range(10)}


def test_callers_are_listed(spark, tmp_path):
    import pyarrow as pa

    got, wanted = both(spark, tmp_path, "called_by", supplier=pa.table({"s_suppkey": [3, 27]}))
    assert got == wanted and len(got) == 12
    lists = {r[0]: r[1] for r in got}  # block_id, called_by
    assert lists["pkg27/s12.py:Box_27.size_27"] == "pkg27/s12.py:Box_27,pkg27/s12.py:Box_27.total_27"

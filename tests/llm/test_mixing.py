import duckdb
import numpy as np
import pytest

import verify
from loopgauge.llm import mixing


@pytest.mark.parametrize("weights", [{"a": 1, "b": 1}, {"a": 70, "b": 20, "c": 9, "d": 1}, {"a": 333, "b": 333, "c": 334}, {"x": 1}, {str(i): i * i + 1 for i in range(30)}, {"a": 1, "b": 100_000}, {"a": 7, "b": 11_003, "c": 13}])
def test_deviation_is_under_one_block(spark, weights):
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(weights)], "doc_id long, source string")
    given = spark.createDataFrame(list(weights.items()), "source string, weight long")
    plan = mixing.schedule(mixing.shares(docs, given)).toPandas()
    cycle = int(plan.cycle.iloc[0])
    assert sorted(plan.cycle_slot) == list(range(cycle))
    total = sum(weights.values())
    for s, g in plan.groupby("source"):
        ran = np.cumsum(np.tile(np.isin(np.arange(cycle), g.cycle_slot), 3))  # three cycles against the weights themselves
        assert np.abs(ran - np.arange(1, 3 * cycle + 1) * weights[s] / total).max() < 1


def test_op7_against_sql(spark, sf):
    df = mixing.op7(spark, sf)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    cursor = con.execute(mixing.ORACLE)
    names = [d[0] for d in cursor.description]
    assert verify.rows_of(names, cursor.fetchall()) == verify.rows_of(df.columns, df.collect())


def test_no_python_in_the_plan(spark, sf):
    plan = mixing.op7(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_places_are_unique_and_blocks_hold(spark):
    docs = spark.range(500).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', concat('s', id % 7)) AS source", "'t' AS text", "'clash' AS slot", "'clash' AS _h2")
    got = mixed = mixing.mixed(docs, block=8).toPandas()
    assert len(got) == 500 and got.place.is_unique and (got.place // 8 == got.slot).all()
    assert (mixed.groupby(["source", "source_block"]).size() <= 8).all() and mixed.groupby("source").source_block.max().lt(63).all()


def test_odd_rows(spark, odd, empty):
    got = mixing.mixed(odd)
    assert got.count() == odd.count() and got.select("place").distinct().count() == odd.count()
    assert mixing.mixed(empty).count() == 0


@pytest.mark.parametrize("weights", [{"a": 0.6, "b": 0.3, "c": 0.1}, {"a": 6e-9, "b": 3e-9, "c": 1e-9}, {"a": 2.5, "b": 7.5}])
def test_fractional_weights_are_kept(spark, weights):
    total = sum(weights.values())
    docs = spark.createDataFrame([(i, s) for i, s in enumerate(weights)], "doc_id long, source string")
    given = spark.createDataFrame(list(weights.items()), "source string, weight double")
    plan = mixing.schedule(mixing.shares(docs, given)).toPandas()
    cycle = int(plan.cycle.iloc[0])
    for s, g in plan.groupby("source"):
        ran = np.cumsum(np.tile(np.isin(np.arange(cycle), g.cycle_slot), 5))  # five cycles against the weights themselves
        assert np.abs(ran - np.arange(1, 5 * cycle + 1) * weights[s] / total).max() < 1


def test_sources_without_weight_get_no_slot(spark):
    docs = spark.createDataFrame([(i, "abcd"[i % 4]) for i in range(400)] + [(900, None)], "doc_id long, source string")
    given = spark.createDataFrame([("a", 3.0), ("b", 0.0), ("c", float("nan")), ("a", 1.0), (None, 1.0)], "source string, weight double")
    got = mixing.mixed(docs, given).toPandas()
    assert len(got) == 401 and got[got.source.isin(["b", "c", "d"])].slot.isna().all()
    placed = got[got.slot.notna()]
    assert len(placed) == 101 and placed.place.is_unique and placed[placed.source == "a"].slot.max() < 10


def test_weights_with_a_too_long_cycle_are_rounded(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CYCLE", 900)
    docs = spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")], "doc_id long, source string")
    given = spark.createDataFrame([("a", 1 / 3), ("b", 2 / 3), ("c", 1e-9)], "source string, weight double")
    assert {r.source: r.q for r in mixing.shares(docs, given).collect()} == {"a": 300, "b": 600, "c": 1}

"""Rounds over the call graph: cycles, levels and classes against plain computations, and how many tables a long chain takes."""

import random

import pytest

from loopgauge.operators import classify, graph
from loopgauge.plans import project


def reachable(edges, nodes):
    after = {n: {t for s, t in edges if s == n} for n in nodes}
    for k in nodes:
        for n in nodes:
            if k in after[n]:
                after[n] |= after[k]
    return after


def graphs():
    rng = random.Random(5)
    tail = [(f"t{i:02d}", f"t{i + 1:02d}") for i in range(20)]
    ring = [(f"r{i:02d}", f"r{(i + 1) % 13:02d}") for i in range(13)]
    yield tail
    yield ring
    yield [*tail, *ring, ("t20", "r05"), ("r07", "u0"), ("u0", "u1"), ("u1", "u2"), ("u2", "v0"), ("v0", "v1"), ("v1", "v0"), ("v1", "w"), ("w", "w")]
    yield [*((b, a) for a, b in tail), *ring, ("r03", "t20"), ("t00", "a"), ("a", "b"), ("b", "a"), ("b", "c"), ("c", "d"), ("d", "b")]
    for n, m in ((12, 12), (20, 30), (30, 36)):
        names = [f"n{i:02d}" for i in range(n)]
        yield [(rng.choice(names), rng.choice(names)) for _ in range(m)]


def test_components_against_reachability(spark):
    edges = [(f"{i}{s}", f"{i}{t}") for i, g in enumerate(graphs()) for s, t in g]
    nodes = sorted({n for e in edges for n in e})
    after = reachable(edges, nodes)
    expected = {(n, min(m for m in nodes if m in after[n] and n in after[m])) for n in nodes if n in after[n]}
    got = graph.strongly_connected(spark.createDataFrame(edges, "source string, target string"))
    assert {tuple(r) for r in got.select("node", "component").collect()} == expected


def counted(monkeypatch):
    """How many tables are written from now on."""
    seen, cut, add = [0], graph.cut, graph.Growing.add
    monkeypatch.setattr(graph, "cut", lambda df: (seen.__setitem__(0, seen[0] + 1), cut(df))[1])
    monkeypatch.setattr(graph.Growing, "add", lambda self, df: (seen.__setitem__(0, seen[0] + 1), add(self, df))[1])
    return seen


def test_levels_against_a_plain_walk(spark):
    rng = random.Random(1)
    nodes = [f"n{i:02d}" for i in range(40)]
    edges = [(nodes[i], nodes[rng.randrange(max(0, i - rng.choice([1, 1, 1, 9])), i)]) for i in range(1, 40) for _ in range(rng.choice([1, 1, 2]))]
    level = {}
    for n in nodes:
        level[n] = max((level[t] + 1 for s, t in edges if s == n), default=0)
    found = graph.levels_of(spark.createDataFrame([(n,) for n in nodes], "node string"), spark.createDataFrame(edges, "source string, target string"))
    assert {r.node: r.level for r in found.collect()} == level


def test_a_cycle_is_no_order(spark):
    with pytest.raises(ValueError):
        graph.levels_of(spark.createDataFrame([("a",), ("b",)], "node string"), spark.createDataFrame([("a", "b"), ("b", "a")], "source string, target string"))


def test_a_long_chain_takes_few_rounds(spark, monkeypatch):
    n = 10_000
    nodes = spark.range(n + 1).selectExpr("lpad(id, 6, '0') AS node")
    edges = spark.range(n).selectExpr("lpad(id, 6, '0') AS source", "lpad(id + 1, 6, '0') AS target")
    seen = counted(monkeypatch)
    assert graph.strongly_connected(edges).count() == 0 and seen[0] < 40
    ring = edges.union(spark.createDataFrame([(f"{n:06d}", "000000")], "source string, target string"))
    found = graph.strongly_connected(ring)
    assert found.count() == n + 1 and found.select("component").distinct().collect()[0][0] == "000000" and seen[0] < 100
    seen[0] = 0
    levels = graph.levels_of(nodes, edges)
    assert levels.filter("level != %d - CAST(node AS INT)" % n).count() == 0 and levels.count() == n + 1 and seen[0] < 50


CODE = {
    "a.py": "".join(f"def f{i}(n):\n" + ("    for i in range(n):\n" if i % 4 == 2 else "    if n:\n") + f"        f{i + 1}(n)\n\n" for i in range(6)) + "def f6(n):\n    return n\n",
    "b.py": "def left(n):\n    f1(n)\n    for i in n:\n        f5(i)\n\ndef right(n):\n    left(n)\n    odd(n)\n\ndef odd(x):\n    return eval(x)\n\ndef top(n):\n    right(n)\n    for i in n:\n        left(i)\n\ndef peak(n):\n    top(n)\n\ndef ring(n):\n    return gnir(n)\n\ndef gnir(n):\n    return ring(n)\n\ndef above(n):\n    ring(n)\n    peak(n)\n",
}


def test_classes_at_once_equal_those_level_by_level(spark, monkeypatch, fallback=True):
    files = spark.createDataFrame([(p, "python", c) for p, c in CODE.items()], "file_path string, language string, content string")
    blocks = graph.cut(project.extract(files))
    found = classify.Graph.of(blocks, graph.resolve(blocks))
    seen = counted(monkeypatch)
    once = classify.Run(found, fallback)
    rows = lambda df: sorted((r.node, r.complexity, r.confidence, r.needs_review, r.rule, tuple(r.flags), r.analyzer_kind) for r in df.collect())
    got = rows(once.results())
    assert once.computed == len(got) == found.facts.count() and seen[0] < 70
    nothing = spark.createDataFrame([], "node string, complexity string, confidence string, needs_review boolean, rule string, flags array<string>, analyzer_kind string, usable boolean")
    assert got == rows(classify.Run(found, fallback, old=nothing).results())


def test_tables_of_an_analysis_meet_by_shuffles(spark, tmp_path, monkeypatch):
    """No step of an analysis with a store plans to send one of its tables through the driver, small as these are."""
    from pyspark.sql import functions as F

    from loopgauge.sources.store import Store

    plans, cut = [], graph.cut
    planned = lambda df: df._jdf.queryExecution().sparkPlan().toString()
    monkeypatch.setattr(graph, "cut", lambda df: plans.append(planned(df)) or cut(df))
    code = {"a": "def a(n):\n    b(n)\n", "b": "def b(n):\n    for i in range(n):\n        c(i)\n", "c": "def c(n):\n    return 1\n", "d": "def d(n):\n    return e(n)\n", "e": "def e(n):\n    return d(n)\n"}
    files = spark.createDataFrame([(f"{k}.py", "python", v) for k, v in code.items()], "file_path string, language string, content string")
    store = Store(spark, f"file://{tmp_path}/store")
    project.analyse_files(files, store=store)
    second = project.analyse_files(files.withColumn("content", F.replace("content", F.lit("return 1"), F.lit("return sorted(n)"))), store=store).joined()
    plans.append(planned(second))
    assert sum("SortMergeJoin" in p for p in plans) > 20
    assert not [p for p in plans if "Broadcast" in p]
    assert {r.name: r.complexity for r in second.collect()} == {"a": "O(n^2 log n)", "b": "O(n^2 log n)", "c": "O(n log n)", "d": "O(1)", "e": "O(1)"}

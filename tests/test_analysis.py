import hashlib
import os

import pytest
from pyspark.sql import functions as F

from loopgauge.operators import classify, graph, report, scoring
from loopgauge.plans import project
from loopgauge.sources import files as sources
from loopgauge.sources import python_blocks as pb
from loopgauge.sources import store as stores
from loopgauge.streaming import incremental

CODE = {
    "a/m1.py": "import m2\nfrom m3 import helper as hp\n\nclass Box:\n    def total(self):\n        t = 0\n        for x in self.xs:\n            t += x\n        return t\n    def twice(self):\n        for i in range(n):\n            self.total()\n\ndef fact(n):\n    return n * fact(n - 1)\n\ndef ev(x):\n    return eval(x)\n\ndef ping(n):\n    return pong(n)\n\ndef pong(n):\n    return ping(n)\n\nhp(1)\n",
    "a/m2.py": "def scan(x):\n    return sorted(x)\n\ndef outer(xs):\n    for i in range(n):\n        scan(xs)\n\ndef three():\n    p()\n    q()\n    r()\n",
    "a/m0.py": "def scan(y):\n    return y\n",
    "a/m3.py": "def helper(x):\n    while x:\n        x -= 1\n",
}


@pytest.fixture(scope="module")
def analysis(spark):
    rows = [(p, "python", c) for p, c in CODE.items()]
    return project.analyse_files(spark.createDataFrame(rows, "file_path string, language string, content string"))


def test_classes(analysis):
    got = {(r.file_path, r.qualified_name): r for r in analysis.joined().collect()}
    cls = lambda p, n: got[p, n].complexity
    assert cls("a/m1.py", "Box") == "N/A"
    assert cls("a/m1.py", "Box.total") == "O(n)"
    assert cls("a/m1.py", "Box.twice") == "O(n^2)"  # a loop around self.total()
    assert cls("a/m1.py", "fact") == "O(n)" and "unresolved_call:fact" in got["a/m1.py", "fact"].flags
    assert cls("a/m1.py", "ev") == "unknown" and got["a/m1.py", "ev"].needs_review
    assert cls("a/m2.py", "scan") == "O(n log n)" and cls("a/m0.py", "scan") == "O(1)"
    assert cls("a/m2.py", "outer") == "O(n^2 log n)"  # the last definition of scan, inside a loop
    assert cls("a/m2.py", "three") == "unknown"
    assert cls("a/m1.py", "<top-level>") == "O(n)"  # through the import alias


def test_edges(analysis):
    got = {(r.call_name, r.state, r.resolved) for r in analysis.edges.collect()}
    assert ("total", "resolved", True) in got and ("scan", "resolved", True) in got and ("hp", "resolved", True) in got
    assert ("fact", "unresolved", False) in got and ("eval", "unresolved", False) in got


def test_ambiguous_names(spark):
    rows = [("x.py", "python", "def go(o):\n    o.f()\n"), ("y.py", "python", "class A:\n    def f(self):\n        pass\n"), ("z.py", "python", "class B:\n    def f(self):\n        pass\n")]
    blocks = pb.extract(spark.createDataFrame(rows, "file_path string, language string, content string"))
    (e,) = graph.resolve(blocks).filter("call_name = 'f' AND start_line = 2").collect()
    assert (e.state, e.resolved, e.target, e.candidates, e.confidence) == ("ambiguous", False, None, 2, "low")


def test_hot_names_are_never_paired(spark):
    """20,000 definitions of a name and 20,000 calls of it: what goes through the joins grows with their sum."""
    from loopgauge.operators import blocks as ops
    from loopgauge.plans.queries import as_blocks, one_call

    n = 20_000
    ids = spark.range(n)
    rows = as_blocks(ids, stable_id=F.concat(F.lit("d"), "id"), block_id=F.concat(F.lit("d"), "id"), name=F.lit("get"), qualified_name=F.concat(F.lit("C"), "id", F.lit(".get")), file_path=F.concat(F.lit("d"), "id", F.lit(".py")), ordinal=F.col("id"))
    rows = rows.unionByName(as_blocks(ids, stable_id=F.concat(F.lit("c"), "id"), block_id=F.concat(F.lit("c"), "id"), name=F.concat(F.lit("f"), "id"), qualified_name=F.concat(F.lit("f"), "id"), file_path=F.concat(F.lit("c"), "id", F.lit(".py")), ordinal=F.col("id"), calls=F.array(F.lit("get")), call_sites=one_call(F.lit("get"))))
    rows = graph.cut(rows)
    edges = graph.cut(graph.resolve(rows))
    assert [tuple(r) for r in edges.groupBy("state", "target", "candidates", "candidate_class").count().collect()] == [("ambiguous", None, n, "name\x1fget", n)]
    some = edges.filter("source = 'c7'")
    assert graph.candidates_of(some, rows).count() == n
    assert [tuple(r) for r in ops.callers(rows).groupBy("n_callers", "first_caller").count().collect()] == [(n, "c0", n)]
    (one,) = ops.called_by(rows, spark.createDataFrame([("d5",)], "block_id string")).collect()
    assert len(one.called_by) == n


def test_calls_of_a_name_that_the_caller_bears(spark):
    code = {"a.py": "def go(x):\n    x.go()\n", "b.py": "def go(y):\n    return y\n", "c.py": "def other(z):\n    z.other()\n    go(z)\n"}
    blocks = pb.extract(project_files(spark, code))
    name = {r.stable_id: r.file_path for r in blocks.collect()}
    got = {(name[r.source], r.call_name): (r.state, name.get(r.target), r.candidates) for r in graph.resolve(blocks).collect()}
    assert got == {("a.py", "go"): ("resolved", "b.py", 1), ("c.py", "other"): ("unresolved", None, 0), ("c.py", "go"): ("resolved", "b.py", 1)}  # of one full name the last stands


def test_overlaps_by_a_sweep(spark):
    rng = __import__("random").Random(4)
    make = lambda n: [(f"f{rng.randrange(3)}", a, a + rng.randrange(6)) for a in (rng.randrange(80) for _ in range(n))]
    chosen, taken = make(60), make(20)
    frame = lambda rows: spark.createDataFrame(rows, "file_path string, start_line int, end_line int")
    got = sorted(tuple(r) for r in project.overlapping(frame(chosen), frame(taken)).collect())
    assert got == sorted(s for s in chosen if any(t[0] == s[0] and max(s[1], t[1]) <= min(s[2], t[2]) for t in taken)) and 0 < len(got) < 60
    many = spark.range(300_000).select(F.lit("one").alias("file_path"), (F.col("id") * 4).alias("start_line"), (F.col("id") * 4 + 1).alias("end_line"))
    assert project.overlapping(many.withColumn("end_line", F.col("end_line") + F.when(F.col("start_line") % 8 == 0, 3).otherwise(0)), many.filter("start_line % 8 = 4")).count() == 300_000


def test_cycles_and_levels(spark, analysis):
    edges = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c"), ("d", "d"), ("e", "a")], "source string, target string")
    assert {(r.node, r.component) for r in graph.strongly_connected(edges).collect()} == {("a", "a"), ("b", "a"), ("d", "d")}
    assert graph.strongly_connected(edges.limit(0)).count() == 0
    levels, flow = graph.processing_levels(analysis.blocks, analysis.edges)
    at = {r.node: r.level for r in levels.collect()}
    for r in flow.collect():
        assert at[r.target] < at[r.source]


def test_structure_edges(analysis):
    assert graph.contains_edges(analysis.blocks).filter("source LIKE 'file:%'").count() == analysis.blocks.count()
    assert {r.call_name for r in graph.import_edges(analysis.blocks).collect()} == {"m2", "m3"}


def test_reports(analysis):
    done = graph.cut(analysis.joined())
    counts = {r.complexity: r.n for r in report.histogram(done, True).collect()}
    assert counts["O(n!)"] == 0 and counts["unknown"] == 2 and sum(counts.values()) == done.filter("complexity <> 'N/A'").count()
    assert report.project_verdict(done).first().verdict == "mostly_good"
    assert [r.name for r in report.hotspots(done).collect()] == ["Box.twice"]
    assert report.recommended_blocks(done).first().complexity == "O(n^2 log n)"
    row = report.overlay(done).filter("complexity = 'O(n^2)'").first()
    assert (row.color, row.label, row.sourceKind) == ("red", "O(n^2)", "static")
    assert "verdict: mostly_good" in report.project_review(done).first().text
    assert {r.group for r in report.by_class(done).collect()} == {"Box", "<top-level>"}
    assert report.edge_counts(analysis.edges).first().unresolved >= 4
    zones = report.visible_zones(report.overlay(done), F.lit(3)).collect()
    assert max(z.endLine for z in zones) <= 3


def test_recommendations_are_not_similar(spark):
    long = "Replace the nested loops over all orders by a dictionary lookup"
    rows = [(1, long), (2, long + " now"), (3, "Cache it"), (4, "cache it!"), (5, "Performance advice")]
    got = report.recommendations(spark.createDataFrame(rows, "seq int, text string")).collect()
    assert [r.seq for r in got] == [1, 3]


class Fake:
    def __init__(self, reply):
        self.reply = reply

    def is_available(self):
        return True

    def estimate(self, payload):
        if self.reply is None:
            raise TimeoutError("late")
        return self.reply


@pytest.mark.parametrize("estimator, kinds", [(None, {"llm_error"}), (Fake('```json\n{"complexity": "o(N^2)", "confidence": "medium"}\n```'), {"llm"}), (Fake(None), {"llm_error"}), (Fake("no idea"), {"llm_error"})])
def test_scoring(analysis, estimator, kinds):
    facts = classify.features(analysis.blocks, analysis.edges).join(analysis.results.drop("analyzer_kind"), "node")
    got = scoring.score(facts, estimator).collect()
    assert len(got) >= 2 and {r.analyzer_kind for r in got} == kinds
    assert all(r.complexity != "unknown" for r in got)


def test_scan_and_store(spark, tmp_path):
    for path, code in CODE.items():
        os.makedirs(tmp_path / "src" / os.path.dirname(path), exist_ok=True)
        (tmp_path / "src" / path).write_text(code)
    os.makedirs(tmp_path / "src/.git")
    (tmp_path / "src/.git/x.py").write_text("x = 1\n")
    (tmp_path / "src/bad.py").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "src/notes.xyz").write_text("no language")
    files = sources.scan(spark, str(tmp_path / "src"))
    assert files.count() == len(CODE)
    store = stores.Store(spark, str(tmp_path / "store"))
    blocks = pb.extract(files)
    for run in ("r1", "r2"):
        store.save_index(files, blocks, run)
    assert store.read("blocks").count() == blocks.count() and "source" not in store.read("blocks").columns
    assert {r.run_id for r in store.read("files").collect()} == {"r2"}
    facts = {r.file_path.rsplit("/", 1)[1]: r for r in store.read("files").collect()}["m2.py"]
    code = CODE["a/m2.py"].encode()
    assert (facts.size, facts.content_hash) == (len(code), hashlib.sha1(code).hexdigest()) and facts.modified is not None
    store.begin_run("r1", 1.0)
    store.finish_run("r1", "done", 2.0)
    assert [r.status for r in store.read("runs").collect()] == ["done"]
    rows = [("n", "k", "O(n)", "rule", 1.0), ("m", "k2", "O(1)", "llm_error", 1.0), ("u", "k3", "unknown", "rule", 1.0)]
    store.save_results(spark.createDataFrame(rows, "node string, cache_key string, complexity string, analyzer_kind string, created_at double"))
    wanted = spark.createDataFrame([("n", "k"), ("m", "k2"), ("u", "k3")], "node string, cache_key string")
    assert [r.node for r in store.cached(wanted).collect()] == ["n"]
    store.delete("results", spark.createDataFrame([("k",)], "cache_key string"), "cache_key")
    assert store.read("results").count() == 2
    store.delete("results", None, "cache_key")
    assert store.read("results").count() == 0
    (tmp_path / "cache.json").write_text('{"version": 2, "items": {"a": "1"}}')
    assert stores.read_json_cache(spark, str(tmp_path / "cache.json")).count() == 1
    (tmp_path / "cache.json").write_text('{"version": 1, "items": {"a": "1"}}')
    assert stores.read_json_cache(spark, str(tmp_path / "cache.json")).count() == 0


def test_writes_of_a_store_follow_the_batch(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    store = stores.Store(spark, str(tmp_path))
    size = lambda: sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(tmp_path) for f in fs)
    store.upsert("t", spark.range(200_000).select("id", F.sha1(F.col("id").cast("string")).alias("v")), ["id"])
    whole = size()
    store.upsert("t", spark.createDataFrame([(5, "five", 1), (200_000, "new", 2)], "id long, v string, more int"), ["id"])
    store.delete("t", spark.createDataFrame([(6,), (7,)], "id long"), "id")
    assert size() - whole < whole / 20
    got = store.read("t").filter("id IN (4, 5, 6, 7, 200000)").orderBy("id").collect()
    assert [(r.id, r.v[:4], r.more) for r in got] == [(4, "1b64", None), (5, "five", 1), (200_000, "new", 2)] and store.read("t").count() == 199_999
    store.upsert("t", spark.createDataFrame([(6, "back", 3)], "id long, v string, more int"), ["id"])
    assert store.read("t").filter("id = 6").first().v == "back"
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: store.upsert("t", spark.createDataFrame([(300_000 + i, "side", i)], "id long, v string, more int"), ["id"]), range(4)))
    assert sorted(r.more for r in store.read("t").filter("v = 'side'").collect()) == [0, 1, 2, 3]  # no writer is lost
    before = sorted(tuple(r) for r in store.read("t").filter("id > 199990").collect())
    store.compact("t", 1)
    assert len(store._log("t")) == 1 and sorted(tuple(r) for r in store.read("t").filter("id > 199990").collect()) == before
    number = store._log("t")[0][0]
    with pytest.raises(stores.Conflict):
        store._commit("t", number, {"kind": "delete"})
    store.delete("t", None, "id")
    assert store.read("t").count() == 0 and store.read("nothing") is None


def test_json_cache_reads_what_it_writes(spark, tmp_path):
    items = [(f"k{i}", '{"a": "line\\n\\n{\\"version\\": 1}", "n": %d}' % i) for i in range(3000)]
    stores.write_json_cache(spark.createDataFrame(items, "key string, row string"), str(tmp_path / "c"))
    assert sorted(tuple(r) for r in stores.read_json_cache(spark, str(tmp_path / "c")).collect()) == sorted(items)
    stores.write_json_cache(spark.createDataFrame([], "key string, row string"), str(tmp_path / "none"))
    assert stores.read_json_cache(spark, str(tmp_path / "none")).count() == 0


def test_deleting_files_takes_all_that_hangs_on_them(spark, tmp_path, analysis):
    store = stores.Store(spark, str(tmp_path / "store"))
    files = spark.createDataFrame([(p, "python", c) for p, c in CODE.items()], "file_path string, language string, content string")
    analysis.save(store, files, "r1")
    store.save_results(analysis.results.withColumn("cache_key", F.col("node")))
    edges = store.read("edges")
    assert {r.edge_type for r in edges.select("edge_type").distinct().collect()} == {"CALLS", "CONTAINS", "IMPORTS"} and edges.count() == analysis.graph().count()
    store.delete_files(files.filter("file_path = 'a/m2.py'"))
    gone = analysis.blocks.filter("file_path = 'a/m2.py'").select("stable_id")
    assert store.read("files").count() == len(CODE) - 1 and store.read("blocks").filter("file_path = 'a/m2.py'").count() == 0
    for name, key in (("block_features", "stable_id"), ("edges", "source"), ("edges", "target"), ("results", "node")):
        assert store.read(name).count() and store.read(name).join(gone.withColumnRenamed("stable_id", key), key).count() == 0


def test_relative_paths(spark):
    df = spark.createDataFrame([("/x/a/b.py",), ("/xa/b.py",)], "p string")
    assert [r[0] for r in df.select(sources.relative_path(F.col("p"), "/x/")).collect()] == ["a/b.py", "/xa/b.py"]
    ignored = spark.createDataFrame([("/x/old/b.py", b"1"), ("/x/new/b.py", b"1")], "path string, content binary")
    assert [r.file_path for r in sources.decoded(ignored, ("old",)).collect()] == ["/x/new/b.py"]


def test_sites_and_neighbours_of_edges(spark, analysis):
    code = "def f(x):\n    return x\n\ndef g(x):\n    f(1)\n    for i in x:\n        f(i)\n"
    blocks = pb.extract(spark.createDataFrame([("s.py", "python", code)], "file_path string, language string, content string"))
    got = graph.sites_of_edges(blocks, graph.resolve(blocks)).orderBy("k").collect()
    assert [(r.k, r.site_line, r.site_depth, r.start_line) for r in got] == [(1, 5, 0, 5), (2, 7, 1, 7)]
    pair = [(r.source, r.target) for r in graph.callees(analysis.edges, analysis.blocks.filter("name = 'twice'").select(F.col("stable_id").alias("node"))).collect()]
    assert len(pair) == 1
    back = graph.callers(analysis.edges, spark.createDataFrame([(pair[0][1],)], "node string")).collect()
    assert [(r.source, r.target) for r in back] == pair


def test_texts_without_a_model(spark, analysis):
    done = graph.cut(analysis.joined())
    texts = report.fallback_texts(done)
    assert report.recommendations(texts).count() == texts.count() == report.recommended_blocks(done).count() > 1
    assert texts.orderBy("seq").first().text == "outer (a/m2.py:4): cut the work of O(n^2 log n) with an index or a cheaper structure."
    blocks = spark.createDataFrame([("i1", "a", 1), ("i2", "b", 2), ("i3", "c", 3)], "node string, name string, position int")
    replies = spark.createDataFrame([(3, "i1", "b", "x"), (9, "no", "b", "y"), (3, None, "no", "z"), (7, None, None, "w")], "position int, block_id string, name string, text string")
    assert {(r.node, r.text) for r in report.replies_to_blocks(replies, blocks).collect()} == {("i1", "x"), ("i2", "y"), ("i3", "z")}
    facts = classify.features(analysis.blocks, analysis.edges).join(analysis.results, "node")
    assert "excerpt" not in scoring.compact(facts).first().payload and scoring.outcome(scoring.score(facts)).first().errors >= 2
    labels = {r.x for r in done.select(classify.short_label().alias("x")).distinct().collect()}
    assert "O(?)" in labels and "unknown" not in labels


CHAIN = {
    "c/base.py": "def base(n):\n    return n\n",
    "c/mid.py": "def mid(n):\n    for i in range(n):\n        base(i)\n",
    "c/top.py": "def top(n):\n    mid(n)\n\ndef far(n):\n    return n\n",
    "c/peak.py": "def peak(n):\n    top(n)\n",
    "c/odd.py": "def odd(x):\n    return eval(x)\n\ndef asks(x):\n    odd(x)\n    for i in range(x):\n        odd(i)\n\ndef asks_asks(x):\n    asks(x)\n",
    "c/ring.py": "def ring(n):\n    return gnir(n)\n\ndef gnir(n):\n    return ring(n)\n\ndef above(n):\n    ring(n)\n",
}


def project_files(spark, code):
    return spark.createDataFrame([(p, "python", c) for p, c in code.items()], "file_path string, language string, content string")


def rows_of(done):
    return sorted((r.file_path, r.qualified_name, r.complexity, r.confidence, r.needs_review, r.rule, tuple(r.flags), r.analyzer_kind) for r in done.joined().collect())


def test_second_run_computes_what_changed_and_what_hangs_on_it(spark, tmp_path):
    store = stores.Store(spark, str(tmp_path / "store"))
    run = lambda code, kept=store: project.analyse_files(project_files(spark, code), rescore=True, store=kept)
    first = run(CHAIN)
    assert first.computed == 11
    fell = [r for r in rows_of(first) if r[7] == "llm_error"]  # a result that only falls back is no result to keep
    second = run(CHAIN)
    assert second.computed == len(fell) and "odd" in {r[1] for r in fell} and rows_of(second) == rows_of(first)
    same = {**CHAIN, "c/base.py": "def base(n):\n    return n + 1\n"}  # another text of the same class: its caller sees another block, nobody beyond it
    assert run(same).computed == len(fell) + 2
    dearer = {**same, "c/base.py": "def base(n):\n    return sorted(n)\n", "c/ring.py": CHAIN["c/ring.py"].replace("return ring", "return n + ring")}
    del dearer["c/odd.py"]  # and of the ring only gnir, as ring stands earlier and looks at no later class
    third = run(dearer)
    assert third.computed == 4 + 1 and rows_of(third) == rows_of(run(dearer, None))
    assert {r[1]: r[2] for r in rows_of(third)}["peak"] == "O(n^2 log n)"
    assert {r.node for r in store.read("results").collect()} <= {r.node for r in third.results.collect()}  # what is gone has left the cache


def test_callers_see_the_class_of_an_uncertain_callee(spark):
    by = lambda done: {r[1]: r for r in rows_of(done)}
    plain, fell = by(project.analyse_files(project_files(spark, CHAIN))), by(project.analyse_files(project_files(spark, CHAIN), rescore=True))
    assert plain["odd"][2] == "unknown" and plain["asks"][2] == "O(n)"
    assert fell["odd"][2:4] == ("O(n)", "low") and fell["odd"][7] == "llm_error" and fell["asks"][2] == "O(n^2)" and fell["asks_asks"][2] == "O(n^2)"
    model = Fake('{"complexity": "O(n^3)", "confidence": "high"}')
    done = project.analyse_files(project_files(spark, CHAIN), rescore=True, estimator=model, budget=1)
    sent = by(done)
    assert done.scored == 1 and sent["odd"][2] == "O(n^3)" and sent["odd"][7] == "llm"
    assert sent["asks"][2] == "O(n)"  # computed before the estimator's answer came, as the rules left its callee open


def test_budget_goes_by_processing_order(spark):
    code = {"a.py": "def late(x):\n    early(x)\n    eval(x)\n", "b.py": "def early(x):\n    return eval(x)\n"}
    done = project.analyse_files(project_files(spark, code), rescore=True, estimator=Fake('{"complexity": "O(1)"}'), budget=1)
    assert {r[1]: r[7] for r in rows_of(done)} == {"late": "llm_error", "early": "llm"}


def test_requests_at_a_time_and_deadlines():
    import threading
    import time

    class Slow:
        def __init__(self):
            self.now, self.most, self.lock = 0, 0, threading.Lock()

        def estimate(self, payload):
            with self.lock:
                self.now += 1
                self.most = max(self.most, self.now)
            time.sleep(30 if payload == "hang" else 0.05)
            with self.lock:
                self.now -= 1
            if payload == "fail":
                raise ValueError("no")
            return payload.upper()

    slow, ticks, began = Slow(), [], time.time()
    got = scoring.asked(slow, ["a", "hang", "b", "fail", *"cdefgh"], 4, 0.6, lambda: ticks.append(1))
    assert time.time() - began < 5 and slow.most == 4 and len(ticks) == 10
    assert got[0] == "A" and got[2] == "B" and got[4:] == list("CDEFGH") and "deadline" in got[1] and "no" in got[3]
    assert scoring.asked(slow, []) == []


def test_progress_of_scoring(spark, analysis):
    facts = classify.features(analysis.blocks, analysis.edges).join(analysis.results.drop("analyzer_kind"), "node")
    count = spark.sparkContext.accumulator(0)
    n = scoring.score(facts, Fake('{"complexity": "O(1)"}'), progress=count).count()
    assert count.value == n > 1


def test_canonical_form(spark):
    from loopgauge.functions import text

    one = spark.sql("SELECT named_struct('b', 1, 'a', array(named_struct('y', null, 'x', 'q\"')), 'm', map('k', 1.5D, 'c', 2D)) AS v")
    two = spark.sql("SELECT named_struct('m', map('c', 2D, 'k', 1.5D), 'a', array(named_struct('x', 'q\"', 'y', null)), 'b', 1) AS v")
    texts = [df.select(text.canonical(F.col("v"), df.schema["v"].dataType).alias("t")).first().t for df in (one, two)]
    assert texts[0] == texts[1] == '{"a":[{"x":"q\\"","y":null}],"b":1,"m":{"c":2.0,"k":1.5}}'
    none = spark.sql("SELECT CAST(null AS STRUCT<a INT>) AS v")
    assert none.select(text.canonical(F.col("v"), none.schema["v"].dataType).alias("t")).first().t == "null"


def test_cache_keys(analysis):
    deps = stores.dependency_hash(analysis.edges)
    keyed = stores.cache_key(analysis.blocks.withColumn("node", F.col("stable_id")).join(deps, "node", "left"), ["1", "2"])
    assert keyed.select("cache_key").distinct().count() > 5


def test_incremental(spark, tmp_path):
    os.makedirs(tmp_path / "src")
    (tmp_path / "src/one.py").write_text("def a():\n    pass\n")
    store = stores.Store(spark, str(tmp_path / "store"))
    for extra, wanted in ((None, 1), ("two.py", 2)):
        if extra:
            (tmp_path / "src" / extra).write_text("def b():\n    pass\n")
        q = incremental.watch(spark, str(tmp_path / "src"), store, str(tmp_path / "cp"))
        q.awaitTermination(120)
        assert q.exception() is None and store.read("blocks").count() == wanted


def test_selection(spark):
    block = pb.selection(spark, "f.py", "    for i in xs:\n        while i:\n            i -= 1\n", 10, 12)
    row = block.first()
    assert (row.kind, row.loops[0].start_line, row.loops[0].estimated_complexity, row.loops[1].estimated_complexity) == ("selection", 10, "O(n)", "unknown")
    assert pb.selection(spark, "f.py", " ", 1, 1).count() == 0
    other = spark.createDataFrame([("f.py", 12, 20)], "file_path string, start_line int, end_line int")
    assert project.overlapping(block.select("file_path", "start_line", "end_line"), other).count() == 1


def test_empty_project(spark):
    none = spark.createDataFrame([], "file_path string, language string, content string")
    done = project.analyse_files(none).joined()
    assert done.count() == 0 and report.project_verdict(done).first().verdict == "empty"

import itertools

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loopgauge.functions import lattice, patterns, text
from loopgauge.sources import python_blocks as pb
from loopgauge.sources import records

ALL = [*lattice.CLASSES, "unknown", "N/A", "container", None]


def test_rank_max_and_product_of_all_pairs(spark):
    pairs = list(itertools.product(ALL, ALL))
    rows = spark.createDataFrame(pairs, "a string, b string").select("a", "b", lattice.rank("a").alias("r"), lattice.class_max("a", "b").alias("m"), lattice.multiply("a", "b").alias("p")).collect()
    rank = {c: i for i, c in enumerate(lattice.CLASSES)}
    for r in rows:
        ra, rb = rank.get(r.a, -1), rank.get(r.b, -1)
        assert r.r == ra
        assert r.m == (r.b if rb > ra else r.a)
        if r.a in lattice.DEGREES and r.b in lattice.DEGREES:
            (d1, g1), (d2, g2) = lattice.DEGREES[r.a], lattice.DEGREES[r.b]
            total = (d1 + d2, min(g1 + g2, 1) if d1 + d2 == 0 else g1 + g2)
            assert r.p == {v: k for k, v in lattice.DEGREES.items()}.get(total)
        else:
            assert r.p is None


def test_labels_and_colours(spark):
    df = spark.createDataFrame([("O(N^2)",), (" o(n log n)",), ("O(n²)",), ("fast",), ("",), (None,)], "c string")
    assert [r[0] for r in df.select(lattice.normalise("c")).collect()] == ["O(n^2)", "O(n log n)", "O(n^2)", "unknown", "unknown", "unknown"]
    df = spark.createDataFrame([(c,) for c in ("O(1)", "O(n)", "O(n log n)", "O(2^n)", "unknown", None)], "c string")
    assert [r[0] for r in df.select(lattice.colour("c")).collect()] == ["green", "gray", "yellow", "red", "gray", "gray"]


def test_fold_product_stops_at_null(spark):
    df = spark.createDataFrame([(["O(n)", "O(log n)"],), (["O(n)", "unknown", "O(1)"],), ([],)], "a array<string>")
    assert [r[0] for r in df.select(lattice.fold_product(F.col("a"))).collect()] == ["O(n log n)", None, "O(1)"]


def test_normalised_source_and_similarity(spark):
    df = spark.createDataFrame([("a = 1  # c\n\n   b\t=  2\n#x\n",)], "t string")
    assert df.select(text.normalised_source(F.col("t"))).first()[0] == "a = 1\nb = 2"
    df = spark.createDataFrame([("Größe_x: 1!",)], "t string")
    assert df.select(text.similarity_key(F.col("t"))).first()[0] == "größex1"
    long = "a" * 41
    df = spark.createDataFrame([("", "x"), ("x", "x"), ("x", "xy"), (long, long + "b")], "a string, b string")
    assert [r[0] for r in df.select(text.similar(F.col("a"), F.col("b"))).collect()] == [True, True, False, True]


def test_sanitised(spark):
    texts = [("- Совет: вынести цикл ",), ("Recommendation: improve performance",), ("Use a set",), ("w" * 100 + " " + "v" * 100,), (None,)]
    got = [r[0] for r in spark.createDataFrame(texts, "t string").select(text.sanitised(F.col("t"))).collect()]
    assert got == ["вынести цикл.", "", "Use a set.", "w" * 100 + ".", ""]


def test_json_object(spark):
    texts = [('{"a": 1}',), ('so:\n```json\n{"a": 2}\n```',), ('x {"a": 3} y',), ("none",), ("[1]",)]
    got = [r[0] for r in spark.createDataFrame(texts, "t string").select(F.get_json_object(text.json_object(F.col("t")), "$.a")).collect()]
    assert got == ["1", "2", "3", None, None]


@pytest.mark.parametrize("code, wanted", [
    ("while left < right:\n  mid = 1\n  left = mid + 1", "binary_search"),
    ("for i in range(n):\n  for j in range(n): pass", "dependent_nested_loop"),
    ("for x in a:\n  b.sort()", "sort_then_scan"),
    ("while low < high:\n  low += 1", "two_pointers"),
    ("for r in xs:\n  while ok:\n    left += 1", "sliding_window"),
    ("while i < n:\n  i += 1", "linear_while_pointer"),
    ("éwhile i: i += 1", None),
    ("x = 1", None),
])
def test_patterns(spark, code, wanted):
    hit = patterns.best_hit(F.col("c"), F.lit(0), F.lit(0), F.lit(False))
    best = spark.createDataFrame([(code,)], "c string").select(hit.alias("h")).first().h
    assert (best.pattern if best else None) == wanted


@given(st.text(max_size=300))
def test_extraction_never_fails(code):
    for b in pb.blocks("x.py", code):
        assert b["start_line"] >= 1 and b["end_line"] >= b["start_line"]


def test_blocks_of_a_file():
    code = "import os as o\n\nclass A:\n    def __init__(self, x=lim):\n        self.x = x\n    def f(self):\n        for i in range(3):\n            while i:\n                g(i)\n\ndef g(a: T):\n    def inner():\n        return a\n    return inner()\n\nprint(g(1))\n"
    rows = {b["qualified_name"]: b for b in pb.blocks("p/x.py", code)}
    assert [b["kind"] for b in rows.values()] == ["class", "constructor", "method", "function", "function", "top_level_executable"]
    assert rows["A.f"]["loop_count"] == 2 and rows["A.f"]["max_loop_depth"] == 2
    assert [x["bound_hint"] for x in rows["A.f"]["loops"]] == ["constant", "unknown"]
    assert rows["A.f"]["call_sites"][1]["inside_loop_depth"] == 2 and rows["A.f"]["calls"] == ["g"]
    assert rows["A.__init__"]["parameters"] == ["self", "x", "lim"] and rows["A.__init__"]["parent_id"] == rows["A"]["stable_id"]
    assert rows["g.inner"]["kind"] == "function" and rows["g"]["parameters"] == ["a", "T"]
    assert rows["<top-level>"]["start_line"] == 16 and rows["g"]["imports"][0]["alias"] == "o"
    assert code.encode()[rows["g"]["start_byte"] : rows["g"]["end_byte"]].decode() == rows["g"]["source"]


@pytest.mark.parametrize("code, hint", [("for i in range(10): pass", "constant"), ("for i in range(0, 10): pass", "linear"), ("for i in [1, 2]: pass", "constant"), ("for i in xs: pass", "data_dependent"), ("while n:\n  n //= 2", "logarithmic"), ("while n:\n  n -= 1", "linear"), ("while n: f()", "unknown")])
def test_bound_hints(code, hint):
    assert records.bound_hint("while" if code.startswith("while") else "for", code) == hint


def test_a_broken_file_gives_what_parses():
    (b,) = pb.blocks("x.py", "def f(:\n  go(1)\n")
    assert b["error_state"] and b["calls"] == ["go"] and (b["kind"], b["name"]) == ("function", "f")
    assert pb.blocks("x.py", "") == []
    (b,) = pb.blocks("x.py", "((((")
    assert b["kind"] == "top_level_executable" and b["error_state"]


GOOD = [
    "import os",
    "X = '''\ndef not_this(:\n'''",
    "@deco\nclass A(Base):\n    \"\"\"doc\"\"\"\n    y = 1\n\n    def one(self):\n        for i in range(3):\n            go(i)\n\n    @property\n    def two(self):\n        def deep():\n            return 1\n        return deep()\n\n    class In:\n        def three(self):\n            return 2",
    "def f(x):\n    while x:\n        x -= 1",
    "TABLE = [\n1,\n2,\n]",
    "async def g(a):\n    s = '''\nmulti\n'''\n    return s",
    "if __name__ == '__main__':\n    f(1)\nelse:\n    f(2)",
]


@given(st.data())
def test_damage_stays_in_its_function(data):
    """A line of one function is spoiled: that function and the classes around it are flagged, all other blocks stay as they were."""
    text = "\n\n".join(GOOD) + "\n"
    whole = pb.blocks("x.py", text)
    assert not any(b["error_state"] for b in whole)
    hit = data.draw(st.sampled_from([b for b in whole if b["kind"] in ("function", "method") and b["name"] != "deep"]))
    damage = data.draw(st.sampled_from(["((", "= =", "for in", "x = [", "return (1", "def", "\u00a7", "'open"]))
    lines = text.split("\n")
    at = data.draw(st.integers(hit["body_start_line"] if hit["name"] != "g" else hit["body_end_line"], hit["body_end_line"])) - 1
    lines[at] = lines[at][: len(lines[at]) - len(lines[at].lstrip())] + damage
    got = {b["qualified_name"]: b for b in pb.blocks("x.py", "\n".join(lines))}
    inside = {"deep"} if hit["name"] == "two" else set()
    around = {b["qualified_name"] for b in whole if b["kind"] == "class" and b["start_line"] <= hit["start_line"] <= b["end_line"]}
    for b in whole:
        name, now = b["qualified_name"], got.get(b["qualified_name"])
        if name == hit["qualified_name"]:
            assert now["error_state"] and (now["start_line"], now["kind"]) == (b["start_line"], b["kind"])
        elif name == "<top-level>" or b["name"] in inside:
            continue
        elif name in around:
            assert now["error_state"] and (now["start_line"], now["end_line"]) == (b["start_line"], b["end_line"])
        else:
            assert not now["error_state"] and all(now[k] == b[k] for k in ("start_line", "end_line", "kind", "calls", "loop_count", "source"))


@given(st.text(alphabet="def class():\n\t '\"\\#@x=[]é", max_size=200))
def test_any_text_gives_blocks(code):
    for b in pb.blocks("x.py", code):
        assert 1 <= b["start_line"] <= b["end_line"] and 0 <= b["start_byte"] <= b["end_byte"] <= len(code.encode())


def test_spared_searches_find_the_same(spark):
    """Each regex where _found() looks for it, on texts whose cut falls next to words, steps, capitals and a letter that grows in lower case."""
    import itertools

    words = ["", "while", "awhile", "WHILE left <", "\u0130\u0130\u0130\u0130 while low < high", " += 1", "i+=1", "left", "MiD =", "= mid", "\u00e9", "for x in range(n)", "for", ".sort(", "xsorted (", "r -="]
    texts = [sep.join(x) for x in itertools.product(words, repeat=3) for sep in ("", " ")]
    df = spark.createDataFrame([(t,) for t in texts], "code string").repartition(4)
    for p in [*patterns.HEADS, *patterns.PARTS, patterns.BOUND_WORD]:
        needs_loop = p in (patterns.NARROWING, patterns.BOUND_STEP, patterns.POINTER_STEP, patterns.BOUND_WORD)  # looked for only where WHILE is found
        rows = df.filter(F.col("code").rlike(patterns.WHILE)) if needs_loop else df
        n, wrong = rows.select(F.count_if(F.col("code").rlike(p)), F.count_if(patterns._found(p, F.col("code"), F.lower("code")) != F.col("code").rlike(p))).first()
        assert n > 0 and wrong == 0 or p == patterns.RANGE_WITH_COLON, p


def test_long_prose_before_code_is_not_searched_by_every_regex(spark):
    """100 texts of 100,000 words with a loop at their end: the regexes skip the prose."""
    import time

    code = F.concat(F.repeat(F.lit("lorem "), 100_000), F.lit("\nwhile low < high:\n    mid = low\n    low = mid\n"), F.col("id").cast("string"))
    best = patterns.best_hit(code, F.lit(0), F.lit(0), F.lit(False))["pattern"].alias("p")
    spark.range(1).select(best).collect()
    began = time.time()
    assert {r.p for r in spark.range(0, 100, 1, 4).select(best).collect()} == {"binary_search"}
    assert time.time() - began < 8

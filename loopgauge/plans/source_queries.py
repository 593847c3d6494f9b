"""Queries over source texts that columns of a table make: what the analysis finds in them is told by SQL from the same columns."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import graph
from ..sources.python_blocks import extract
from ..sources.store import Store
from . import project

#: Per language: what opens a file and a function called NAME, the head of a loop, a call of F, what closes a brace, the function and the file. Strings and
#: comments hold what would be blocks, loops and calls if they were code.
TEMPLATES = {
    "javascript": ("// function no() { for (;;) f(1) }\nclass KNAME {\n  NAME(a, b) {\n", "for (let i = 0; i < a; i++) { ", "F(`while (1) { ${a} f(2) }`); ", "}", "\n  }\n", "}\n"),
    "typescript": ("/* class No { */\nclass KNAME {\n  private NAME(a: number, b: {c: string}): Promise<void> {\n", "while (a) { ", 'F("for (;;) {"); ', "}", "\n  }\n", "}\n"),
    "java": ("/** void no() { */\nclass KNAME {\n  @Override\n  public static int NAME(int a, List<String> b) {\n", "for (String s : b) { ", 'F("} f(3)", \'{\'); ', "}", "\n  }\n", "}\n"),
    "cpp": ("#define LOOP for (;;) {\nclass KNAME {\npublic:\n  int NAME(int a, std::vector<int> b) const {\n", "for (auto x : b) { ", 'F(R"(while (1) { f(4); )"); ', "}", "\n  }\n", "};\n"),
    "csharp": ("namespace N {\nclass KNAME {\n  public int NAME(int a, List<int> b) {\n", "foreach (var x in b) { ", 'F(@"c:\\{"); ', "}", "\n  }\n", "}\n}\n"),
    "c": ("#include <x.h>\n/* int no(void) { */\nstatic int NAME(int a, char *b) {\n", "do { ", "F('}'); ", "} while (a);", "\n}\n", ""),
    "go": ("package p\n// func no() {\nfunc NAME(a int, b []string) error {\n", "for range b { ", "F(`for { f(5)`); ", "}", "\n}\n", ""),
    "rust": ("/* fn no() { /* } */ */\npub fn NAME(a: u8, b: &[u8]) {\n", "while a > 0 { ", 'F(r#"loop { " f(6)"#); ', "}", "\n}\n", ""),
}
#: Languages whose function stands in a class.
CLASSED = ("javascript", "typescript", "java", "cpp", "csharp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, key: str) -> DataFrame:
    """Few bytes a row and much work behind: dealt to all cores."""
    return rows.repartition(rows.sparkSession.sparkContext.defaultParallelism, key)


def repeated(text: Column, n: Column) -> Column:
    return F.repeat(text, n.cast("int"))


def brace_sources(rows: DataFrame, key: Column, language: Column, depth: Column, calls: Column) -> DataFrame:
    """Files with a function f<key> of `depth` loops, one in the other, and `calls` calls of g0, g1 and so on in the innermost."""
    part = lambda i: F.try_element_at(F.create_map(*[F.lit(x) for k, v in TEMPLATES.items() for x in (k, v[i])]), F.col("language"))
    made = rows.select(key.cast("string").alias("key"), language.alias("language"), depth.alias("depth"), calls.alias("calls"))
    each = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: F.when(i < F.col("calls"), F.replace(part(2), F.lit("F("), F.concat(F.lit("g"), i.cast("string"), F.lit("(")))))
    text = F.concat(F.replace(part(0), F.lit("NAME"), F.concat(F.lit("f"), "key")), repeated(part(1), F.col("depth")), F.array_join(each, ""), repeated(part(3), F.col("depth")), part(4), part(5))
    return made.select(F.concat("language", F.lit("/"), "key").alias("file_path"), "language", text.alias("content"))


_LANGUAGES = list(TEMPLATES)


def source_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file for each customer, in one of eight languages: its blocks, loops, their depth, and calls."""
    key = F.col("c_custkey")
    language = F.array(*[F.lit(x) for x in _LANGUAGES])[(key % len(_LANGUAGES)).cast("int")]
    files = brace_sources(spread(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), "c_custkey"), key, language, F.col("c_nationkey") % 4, F.floor(key / 8) % 5)
    return extract(files).select("file_path", "language", "kind", "name", "qualified_name", "loop_count", "max_loop_depth", F.size("calls").alias("n_calls"), F.array_join("parameters", ",").alias("parameters"), "error_state")


SOURCE_BLOCKS = f"""
WITH f AS (SELECT c_custkey AS k, [{", ".join(f"'{x}'" for x in _LANGUAGES)}][(c_custkey % {len(_LANGUAGES)}) + 1] AS language, (c_nationkey % 4)::INTEGER AS depth, least((c_custkey // 8) % 5, 4)::INTEGER AS calls FROM customer)
SELECT language || '/' || k AS file_path, language, 'class' AS kind, 'Kf' || k AS name, 'Kf' || k AS qualified_name, depth AS loop_count, depth AS max_loop_depth, calls AS n_calls, '' AS parameters, false AS error_state FROM f WHERE language IN {CLASSED}
UNION ALL SELECT language || '/' || k, language, CASE WHEN language IN {CLASSED} THEN 'method' ELSE 'function' END, 'f' || k, CASE WHEN language IN {CLASSED} THEN 'Kf' || k || '.' ELSE '' END || 'f' || k, depth, depth, calls, 'a,b', false FROM f
"""


def python_project(spark: SparkSession, sf_dir: str, dearer: bool = False) -> DataFrame:
    """Files of a project: a function for each region, for each nation one that calls its region's, for each supplier one that calls its nation's.

    Odd regions sort; nations with an odd key call in a loop, and so do suppliers with a key divisible by 3 whose nation has an even one. dearer: nations with a key
    divisible by 5 have a comment behind their function, which changes no block, and the even ones of them a loop.
    """
    function = lambda name, loop, call: F.concat(F.lit("def "), name, F.lit("(n):\n"), F.when(loop, "    for i in range(n):\n        ").otherwise("    "), call, F.lit("\n"))
    call = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"), F.lit("(n)"))
    name = lambda kind, key: F.concat(F.lit(kind), F.col(key).cast("string"))
    region = table(spark, sf_dir, "region").select(name("r", "r_regionkey").alias("name"), F.lit(False).alias("loop"), F.when(F.col("r_regionkey") % 2 == 1, "sorted(n)").otherwise("n = 1").alias("call"))
    changed = F.lit(dearer) & (F.col("n_nationkey") % 5 == 0)
    nation = table(spark, sf_dir, "nation")
    nations = nation.select(name("n", "n_nationkey").alias("name"), ((F.col("n_nationkey") % 2 == 1) | changed).alias("loop"), F.concat(call("r", "n_regionkey"), F.when(changed, "  # changed").otherwise("")).alias("call"))
    supplier = table(spark, sf_dir, "supplier").select(name("s", "s_suppkey").alias("name"), ((F.col("s_suppkey") % 3 == 0) & (F.col("s_nationkey") % 2 == 0)).alias("loop"), call("n", "s_nationkey").alias("call"))
    files = region.unionByName(nations).unionByName(supplier).select(F.concat(F.lit("p/"), "name", F.lit(".py")).alias("file_path"), F.lit("python").alias("language"), function(F.col("name"), F.col("loop"), F.col("call")).alias("content"))
    return spread(files, "file_path")


#: Classes by degree * 10 + number of logarithms.
_CLASS = "CASE {} WHEN 0 THEN 'O(1)' WHEN 10 THEN 'O(n)' WHEN 11 THEN 'O(n log n)' WHEN 20 THEN 'O(n^2)' WHEN 21 THEN 'O(n^2 log n)' WHEN 30 THEN 'O(n^3)' END"
_PROJECT = """
WITH r AS (SELECT r_regionkey AS rk, CASE WHEN r_regionkey % 2 = 1 THEN 11 ELSE 0 END AS d FROM region),
n AS (SELECT n_nationkey AS nk, r.d + CASE WHEN n_nationkey % 2 = 1{more} THEN 10 ELSE 0 END AS d FROM nation JOIN r ON rk = n_regionkey),
s AS (SELECT s_suppkey AS sk, nk, n.d + CASE WHEN s_suppkey % 3 = 0 AND nk % 2 = 0 THEN 10 ELSE 0 END AS d FROM supplier JOIN n ON nk = s_nationkey),
done AS (SELECT 'r' || rk AS name, d FROM r UNION ALL SELECT 'n' || nk, d FROM n UNION ALL SELECT 's' || sk, d FROM s)
"""


def classified_project(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions, nations and suppliers as functions that call each other: the class of each, with that of what it calls."""
    return project.analyse_files(python_project(spark, sf_dir)).joined().select("name", "complexity")


CLASSIFIED = _PROJECT.format(more="") + f"SELECT name, {_CLASS.format('d')} AS complexity FROM done"


def cached_reanalysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same project analysed, changed and analysed again with the stored results.

    The second run computes the changed functions and those that hang on them, and its result is that of a whole run.
    """
    store = Store(spark, f"{graph.shared_path(spark)}/reanalysis-{uuid.uuid4().hex}")
    project.analyse_files(python_project(spark, sf_dir), store=store)
    second = project.analyse_files(python_project(spark, sf_dir, dearer=True), store=store)
    return second.joined().select("name", "complexity", F.lit(second.computed).cast("long").alias("computed"))


REANALYSIS = _PROJECT.format(more=" OR n_nationkey % 5 = 0") + f"""
SELECT name, {_CLASS.format('d')} AS complexity, (SELECT count(*) FROM n WHERE nk % 10 = 0) + (SELECT count(*) FROM s WHERE nk % 10 = 0) AS computed FROM done
"""

QUERIES = {"source_blocks": source_blocks, "classified_project": classified_project, "cached_reanalysis": cached_reanalysis}
ORACLE_SQL = {"source_blocks": SOURCE_BLOCKS, "classified_project": CLASSIFIED, "cached_reanalysis": REANALYSIS}

"""Queries over the supplied tables, one for each operator shape, and the same in DuckDB SQL.

Code analysis queries make source texts from rows of a table: a copy of SNIPPETS for each, or templates filled by columns (source_queries).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType

from ..functions import lattice, patterns, text
from ..operators import classify, graph, report
from ..operators.blocks import called_by as blocks_called_by
from ..operators.blocks import callers
from ..sources import store
from ..sources.python_blocks import KEYWORDS, block_schema, extract
from .project import analyse_files, live_only, overlapping

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def as_blocks(df: DataFrame, **given) -> DataFrame:
    """Rows as blocks: the given columns, functions by default, empty lists and nulls for the rest of the block schema."""
    given = {"kind": F.lit("function"), "is_container": F.lit(False), **given}

    def column(field):
        if field.name in given:
            return given[field.name]
        return F.array().cast(field.dataType) if isinstance(field.dataType, ArrayType) else F.lit(None).cast(field.dataType)

    return df.select(*[column(f).cast(f.dataType).alias(f.name) for f in block_schema().fields])


def text_of(kind: str, key: str):
    return F.concat(F.lit(kind), F.col(key).cast("string"))


def one_call(name):
    """Call sites with a single plain call of that name."""
    value = lambda f: name if f.name == "call_name" else F.lit(False) if isinstance(f.dataType, BooleanType) else F.lit(None)
    return F.array(F.struct(*[value(f).cast(f.dataType).alias(f.name) for f in block_schema()["call_sites"].dataType.elementType.fields]))


#: (id, code, class that the detectors give or null)
SNIPPETS = [
    (1, "def find(xs, t):\n    left, right = 0, len(xs)\n    while left < right:\n        mid = (left + right) // 2\n        left = mid + 1\n"),
    (2, "def pairs(n):\n    for i in range(n):\n        for j in range(n):\n            use(i, j)\n"),
    (3, "def scan(xs):\n    xs.sort()\n    for x in xs:\n        use(x)\n"),
    (4, "def two(xs):\n    low, high = 0, 9\n    while low < high:\n        low += 1\n"),
    (5, "def window(xs):\n    left = 0\n    for r in xs:\n        while left < r:\n            left += 1\n"),
    (6, "def step(n):\n    i = 0\n    while i < n:\n        i += 1\n"),
    (7, "def plain(a):\n    return a + 1\n"),
    (8, "def éwhile(x):\n    éwhile = x\n    return éwhile\n"),
    (9, "def both(xs):\n    for i in range(0, n):\n        for j in sorted(xs):\n            pass\n"),
    (10, "def nothing():\n    '''while left mid'''\n"),
]


def _values(rows: list[tuple], names: str) -> str:
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    body = ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)
    return f"(VALUES {body}) AS t({names})"


_CLASS_ROWS = [(i, c) for i, c in enumerate(lattice.CLASSES)]


def _rank_sql(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{x}' THEN {i}" for i, x in _CLASS_ROWS) + " ELSE -1 END"


def _degree_sql(c: str) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{x}' THEN {d * 10 + g}" for x, (d, g) in lattice.DEGREES.items()) + " END"


_LABELS = ["O(1)", " o( N ^2 ) ", "O(n²)", "o(nlogn)", "O(N!)", "cubic", "", "O(2^n)", "O(log n)", None]


_ALL = (*lattice.CLASSES, "unknown", "N/A")
_PRODUCTS = "CASE {} WHEN 0 THEN 'O(1)' WHEN 1 THEN 'O(log n)' WHEN 2 THEN 'O(log n)' WHEN 10 THEN 'O(n)' WHEN 11 THEN 'O(n log n)' WHEN 20 THEN 'O(n^2)' WHEN 21 THEN 'O(n^2 log n)' WHEN 30 THEN 'O(n^3)' END"


def _list_sql(values) -> str:
    return "[" + ", ".join("NULL" if v is None else "'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(values, at):
    """The value at a row's position (from 0) in a short list."""
    return F.array(*[F.lit(v) for v in values])[at.cast("int")]


@query(f"""
WITH p AS (SELECT {_list_sql(_ALL)}[(l_partkey % 11) + 1] AS a, {_list_sql(_ALL)}[(l_suppkey % 11) + 1] AS b FROM lineitem)
SELECT a, b, {_PRODUCTS.format(f"{_degree_sql('a')} + {_degree_sql('b')}")} AS product, CASE WHEN {_rank_sql('b')} >= 0 AND {_rank_sql('b')} > {_rank_sql('a')} THEN b ELSE a END AS larger, count(*) AS n FROM p GROUP BY ALL
""")
def class_multiply_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Products and maxima of two classes of each line item, by part and supplier."""
    pairs = table(spark, sf_dir, "lineitem").select(_pick(_ALL, F.col("l_partkey") % 11).alias("a"), _pick(_ALL, F.col("l_suppkey") % 11).alias("b"))
    return pairs.select("a", "b", lattice.multiply("a", "b").alias("product"), lattice.class_max("a", "b").alias("larger")).groupBy("a", "b", "product", "larger").agg(F.count("*").alias("n"))


@query(f"""
SELECT raw, CASE WHEN trim(raw) IN {tuple(lattice.CLASSES)} THEN trim(raw) ELSE coalesce(CASE lower(replace(trim(raw), ' ', ''))
 {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in lattice.SPELLINGS.items())} END, 'unknown') END AS label, count(*) AS n
FROM (SELECT {_list_sql(_LABELS)}[(o_orderkey % 10) + 1] || CASE WHEN o_custkey % 3 = 0 THEN ' ' WHEN o_custkey % 3 = 1 THEN '' ELSE o_orderstatus END AS raw FROM orders) GROUP BY ALL
""")
def class_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes from free labels: one for each order, some with a space or the order's status behind it."""
    end = F.when(F.col("o_custkey") % 3 == 0, " ").when(F.col("o_custkey") % 3 == 1, "").otherwise(F.col("o_orderstatus"))
    raw = table(spark, sf_dir, "orders").select(F.concat(_pick(_LABELS, F.col("o_orderkey") % 10), end).alias("raw"))
    return raw.select("raw", lattice.normalise("raw").alias("label")).groupBy("raw", "label").agg(F.count("*").alias("n"))


_PRIORITY_CLASS = {"1-URGENT": "O(n!)", "2-HIGH": "O(n^2)", "3-MEDIUM": "O(n)", "4-NOT SPECIFIED": "unknown", "5-LOW": "O(1)"}
_priority_case = "CASE o_orderpriority " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _PRIORITY_CLASS.items()) + " END"


def _orders_as_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    to_class = F.create_map(*[F.lit(x) for kv in _PRIORITY_CLASS.items() for x in kv])
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.try_element_at(to_class, F.col("o_orderpriority")).alias("complexity"), F.lit("function").alias("kind"), F.lit(False).alias("is_container"))


@query(f"""
SELECT c.position, c.complexity, count(o.o_orderkey)::BIGINT AS n FROM {_values([*_CLASS_ROWS, (9, 'unknown')], 'position, complexity').replace(' AS t(', ' AS c(')}
LEFT JOIN (SELECT o_orderkey, coalesce({_priority_case}, 'unknown') AS k FROM orders) o ON o.k = c.complexity GROUP BY ALL
""")
def class_histogram_zero_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A2, A3: counts of every class, also of those that do not occur."""
    return report.histogram(_orders_as_blocks(spark, sf_dir), with_unknown=True)


@query(f"""
SELECT total, heavy, light, CASE WHEN total = 0 THEN 'empty' WHEN heavy = 0 THEN 'moderate' WHEN heavy <= greatest(1, total // 5) THEN 'mostly_good' WHEN light >= heavy THEN 'mixed' ELSE 'heavy' END AS verdict, custkey
FROM (SELECT o_custkey AS custkey, count(*) AS total, count(*) FILTER (WHERE k IN {lattice.HEAVY}) AS heavy, count(*) FILTER (WHERE k IN {lattice.LINEAR_OR_BETTER}) AS light FROM (SELECT o_custkey, {_priority_case} AS k FROM orders) GROUP BY 1)
""")
def verdict_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The verdict of each customer's orders."""
    c = F.col("complexity")
    sums = _orders_as_blocks(spark, sf_dir).groupBy(F.col("o_custkey").alias("custkey")).agg(F.count("*").alias("total"), F.count_if(c.isin(*lattice.HEAVY)).alias("heavy"), F.count_if(c.isin(*lattice.LINEAR_OR_BETTER)).alias("light"))
    return sums.select("total", "heavy", "light", report.verdict(F.col("total"), F.col("heavy"), F.col("light")).alias("verdict"), "custkey")


@query(f"""
SELECT c.position, c.complexity, n, n * 100 // greatest(max(n) OVER (), 1) AS height FROM (
 SELECT c.position, c.complexity, count(o.k)::BIGINT AS n FROM {_values(_CLASS_ROWS, 'position, complexity').replace(' AS t(', ' AS c(')} LEFT JOIN (SELECT {_priority_case} AS k FROM orders) o ON o.k = c.complexity GROUP BY ALL) c
""")
def chart_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole bar heights against the largest count."""
    return report.chart_heights(report.histogram(_orders_as_blocks(spark, sf_dir)))


_NORMAL = r"""list_aggregate(list_filter(list_transform(string_split_regex(text, '\r\n|[\n\r\x0b\f\x1c\x1d\x1e\x{85}\x{2028}\x{2029}]'), lambda x: trim(regexp_replace(regexp_replace(x, '#.*$', ''), '[ \t\r\x0b\f]+', ' ', 'g'))), lambda x: x <> ''), 'string_agg', chr(10))"""


@query(f"SELECT h, count(*) AS n, min(doc_id) AS first_id FROM (SELECT doc_id, sha1(coalesce({_NORMAL}, '')) AS h FROM documents WHERE text IS NOT NULL) GROUP BY h HAVING count(*) > 1")
def normalized_hash_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with equal normalised text."""
    hashed = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", text.normalised_hash(F.col("text")).alias("h"))
    return hashed.groupBy("h").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).filter("n > 1")


@query(r"SELECT sha1(k) AS h, count(*) AS n FROM (SELECT regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g') AS k FROM documents WHERE text IS NOT NULL) GROUP BY 1 HAVING count(*) > 1")
def similarity_key_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with equal letters and digits."""
    keyed = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select(F.sha1(text.similarity_key(F.col("text"))).alias("h"))
    return keyed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1")


@query("SELECT doc_id, md5(list_aggregate(string_split(text, chr(10))[1:45], 'string_agg', chr(10))) AS excerpt_md5, md5(list_aggregate(string_split(text, chr(10))[1:80], 'string_agg', chr(10))) AS long_md5 FROM documents WHERE text IS NOT NULL")
def excerpt_first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 45 and 80 lines of each text."""
    return table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", F.md5(text.excerpt(F.col("text"), 45)).alias("excerpt_md5"), F.md5(text.excerpt(F.col("text"), 80)).alias("long_md5"))


_BODY = "CASE WHEN len(string_split(html, chr(10))) > 1 THEN list_aggregate(string_split(html, chr(10))[2:], 'string_agg', chr(10)) ELSE html END"


@query(rf"""
SELECT call_name, count(*) AS n, count(DISTINCT page_id) AS pages FROM (SELECT page_id, unnest(list_filter(regexp_extract_all({_BODY}, '(?:^|[^\p{{L}}\p{{N}}_])([A-Za-z_][A-Za-z0-9_]*)[ \t\r\n]*\(', 1), lambda x: x NOT IN {KEYWORDS})) AS call_name FROM pages WHERE html IS NOT NULL) GROUP BY 1
""")
def regex_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers before brackets in pages."""
    names = table(spark, sf_dir, "pages").filter("html IS NOT NULL").select("page_id", F.explode(text.regex_calls(F.col("html"), list(KEYWORDS))).alias("call_name"))
    return names.groupBy("call_name").agg(F.count("*").alias("n"), F.count_distinct("page_id").alias("pages"))


#: What the detectors say of each snippet, by hand.
_BEST = [
    ("O(log n)", "binary_search"), ("O(n^2)", "dependent_nested_loop"), ("O(n log n)", "sort_then_scan"), ("O(n)", "two_pointers"), ("O(n)", "two_pointers"),
    ("O(n)", "linear_while_pointer"), (None, None), (None, None), ("O(n^2)", "dependent_nested_loop"), (None, None),
]


@query(f"SELECT p_partkey, {_list_sql([n for _, n in _BEST])}[(p_partkey % 10) + 1] AS pattern, {_list_sql([c for c, _ in _BEST])}[(p_partkey % 10) + 1] AS complexity FROM part")
def pattern_best_hit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best pattern of a snippet for each part, the part's name in a comment behind it."""
    code = F.concat(_pick([c for _, c in SNIPPETS], F.col("p_partkey") % 10), F.lit("\n# "), "p_name")
    hit = patterns.best_hit(F.col("code"), F.lit(0), F.lit(0), F.lit(False))
    return table(spark, sf_dir, "part").select("p_partkey", code.alias("code")).withColumn("best", hit).select("p_partkey", F.col("best.pattern").alias("pattern"), F.col("best.complexity").alias("complexity"))


def _pattern_sql(hit: str) -> str:
    return f"CASE {hit} " + " ".join(f"WHEN {lattice.CLASSES.index(d.result) * 100 - i} THEN '{d.name}'" for i, d in enumerate(patterns.DETECTORS)) + " END"


@query(f"""
SELECT doc_id, hit, code_hit, {_pattern_sql('code_hit')} AS pattern FROM (
 SELECT doc_id, {patterns.best_hit_sql('text')} AS hit, {patterns.best_hit_sql('code')} AS code_hit FROM (SELECT doc_id, text, text || chr(10) || {_list_sql([c for _, c in SNIPPETS])}[(doc_id % 10) + 1] AS code FROM documents WHERE text IS NOT NULL))
""")
def pattern_hits_in_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """R1-R7 over every text, by itself and with a snippet behind it: the best hit of each (rank * 100 + preference), null for none."""
    docs = table(spark, sf_dir, "documents").filter("text IS NOT NULL").select("doc_id", "text", F.concat("text", F.lit("\n"), _pick([c for _, c in SNIPPETS], F.col("doc_id") % 10)).alias("code"))
    best = lambda c: patterns.best_hit(F.col(c), F.lit(0), F.lit(0), F.lit(False))
    number = lambda c: F.col(f"{c}.rank") * 100 + F.col(f"{c}.preference")
    return docs.select("doc_id", best("text").alias("own"), best("code").alias("best")).select("doc_id", number("own").alias("hit"), number("best").alias("code_hit"), F.col("best.pattern").alias("pattern"))


@query("""
SELECT cost, has_while, count(*) AS n, count(DISTINCT l_orderkey) AS orders FROM (
 SELECT l_orderkey, d BETWEEN 20 AND 70 AS has_while, CASE WHEN d BETWEEN 0 AND 60 AND d BETWEEN 20 AND 70 THEN 'O(n log n)' WHEN d BETWEEN 0 AND 60 THEN 'O(n)' WHEN d BETWEEN 20 AND 70 THEN 'O(log n)' ELSE 'O(1)' END AS cost
 FROM (SELECT l_orderkey, date_diff('day', o_orderdate, l_shipdate) AS d FROM lineitem JOIN orders ON l_orderkey = o_orderkey)) GROUP BY 1, 2
""")
def interval_contains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cost of the loops around each call: days of an order as lines, with a for loop on days 0 to 60 and a while loop on days 20 to 70."""
    items, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    line = F.date_diff("l_shipdate", "o_orderdate")
    loop = lambda kind, a, b, cost: F.struct(F.lit(kind).alias("kind"), F.lit(a).alias("start_line"), F.lit(b).alias("end_line"), F.lit(cost).alias("estimated_complexity"))
    each = items.join(orders, items.l_orderkey == orders.o_orderkey).select("l_orderkey", line.alias("line"), F.array(loop("for", 0, 60, "O(n)"), loop("while", 20, 70, "O(log n)")).alias("loops"))
    costs = each.select("l_orderkey", classify.loop_cost(F.col("line"), F.col("line")).alias("c")).select("l_orderkey", "c.*")
    return costs.groupBy("cost", "has_while").agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"))


@query("""
WITH r AS (SELECT user_id, event_type, min(event_id) AS a, max(event_id) AS b FROM events GROUP BY ALL)
SELECT user_id, event_type FROM r x WHERE event_type IN ('click', 'view') AND EXISTS (SELECT 1 FROM r y WHERE y.user_id = x.user_id AND y.event_type NOT IN ('click', 'view') AND greatest(x.a, y.a) <= least(x.b, y.b))
""")
def overlap_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's ranges of two event types, as selections, that overlap a range of another type, as taken ones."""
    r = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("file_path"), "event_type").agg(F.min("event_id").alias("start_line"), F.max("event_id").alias("end_line"))
    selected = F.col("event_type").isin("click", "view")
    return overlapping(r.filter(selected), r.filter(~selected)).select(F.col("file_path").alias("user_id"), "event_type")


@query("""
WITH k AS (SELECT conv_id, role, turn, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS k FROM conversations)
SELECT u.conv_id, u.k, u.turn AS user_turn, a.turn AS assistant_turn FROM k u JOIN k a ON u.conv_id = a.conv_id AND u.k = a.k WHERE u.role = 'user' AND a.role = 'assistant'
""")
def positional_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The k-th turn of a user with the k-th answer."""
    u, a = (table(spark, sf_dir, "conversations").filter(F.col("role") == r).select("conv_id", F.col("turn").alias(f"{r}_turn"), F.col("text").alias(f"{r}_text")) for r in ("user", "assistant"))
    order = lambda r: [F.col(f"{r}_turn").asc_nulls_last(), F.col(f"{r}_text").asc_nulls_last()]
    return graph.in_order(u, a, ["conv_id"], order("user"), order("assistant")).select("conv_id", F.col("k").cast("bigint").alias("k"), "user_turn", "assistant_turn")


@query("SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS n FROM events) WHERE n = 1")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest event of each user and type, as a store keeps it."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "ts", "event_id", "value")
    return store.keep_latest(events, ["user_id", "event_type"], "ts", "event_id").drop("ts")


@query(f"""
SELECT name, complexity, max_loop_depth, n_calls FROM (SELECT 'f' || o_orderkey AS name, {_priority_case} AS complexity, o_custkey % 4 AS max_loop_depth, o_orderkey % 7 AS n_calls, o_orderstatus, o_orderkey FROM orders)
WHERE complexity IN {lattice.HEAVY} OR complexity = 'unknown' OR complexity IS NULL OR max_loop_depth >= 2
ORDER BY {_rank_sql('complexity')} DESC, coalesce(complexity, 'unknown') = 'unknown' DESC, max_loop_depth DESC, n_calls DESC, o_orderstatus, o_orderkey LIMIT 5
""")
def topk_composite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """O2: the five worst blocks by several falling columns, ties in source order."""
    blocks = as_blocks(
        table(spark, sf_dir, "orders"), name=text_of("f", "o_orderkey"), file_path=F.col("o_orderstatus"), ordinal=F.col("o_orderkey"), max_loop_depth=F.expr("o_custkey % 4"),
        calls=F.expr("array_repeat('g', CAST(o_orderkey % 7 AS INT))"), language=F.col("o_orderpriority"),
    )
    to_class = F.create_map(*[F.lit(x) for kv in _PRIORITY_CLASS.items() for x in kv])
    done = blocks.withColumn("complexity", F.try_element_at(to_class, F.col("language")))
    return report.recommended_blocks(done).select("name", "complexity", F.col("max_loop_depth").cast("bigint").alias("max_loop_depth"), F.size("calls").cast("bigint").alias("n_calls"))


@query("""
WITH f AS (SELECT 's:' || s_suppkey AS target, s_suppkey % 60 AS name, s_nationkey AS file FROM supplier), c AS (SELECT c_custkey, c_custkey % 70 AS name, c_nationkey AS file FROM customer),
 near AS (SELECT c_custkey, count(*) AS n, min(target) AS target FROM c JOIN f USING (name, file) GROUP BY 1), far AS (SELECT c_custkey, count(*) AS n, min(target) AS target FROM c JOIN f USING (name) GROUP BY 1)
SELECT 'c:' || c_custkey AS source, CASE WHEN coalesce(near.n, far.n) = 1 THEN coalesce(near.target, far.target) END AS target,
 CASE WHEN coalesce(near.n, far.n) IS NULL THEN 'unresolved' WHEN coalesce(near.n, far.n) = 1 THEN 'resolved' ELSE 'ambiguous' END AS state,
 CASE WHEN coalesce(near.n, far.n) = 1 THEN 'high' ELSE 'low' END AS confidence, coalesce(near.n, far.n, 0)::BIGINT AS candidates
FROM c LEFT JOIN near USING (c_custkey) LEFT JOIN far USING (c_custkey)
""")
def resolve_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as blocks that call a supplier's name: the definition in their own file (nation), else anywhere."""
    called = table(spark, sf_dir, "supplier").withColumn("f", F.expr("concat('f', s_suppkey % 60)"))
    calling = table(spark, sf_dir, "customer").withColumn("f", F.expr("concat('f', c_custkey % 70)"))
    blocks = as_blocks(called, stable_id=text_of("s:", "s_suppkey"), name=F.col("f"), qualified_name=F.col("f"), file_path=text_of("n", "s_nationkey"), ordinal=F.col("s_suppkey")).unionByName(
        as_blocks(calling, stable_id=text_of("c:", "c_custkey"), name=text_of("c", "c_custkey"), qualified_name=text_of("c", "c_custkey"), file_path=text_of("n", "c_nationkey"), ordinal=F.col("c_custkey"), call_sites=one_call(F.col("f")))
    )
    return graph.resolve(blocks).select("source", "target", "state", "confidence", F.col("candidates").cast("bigint").alias("candidates"))


@query("SELECT doc_id, source FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def prune_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cached rows whose block still exists."""
    cached = table(spark, sf_dir, "documents").select("doc_id", "source", F.col("doc_id").cast("string").alias("node"))
    return live_only(cached, as_blocks(table(spark, sf_dir, "labels"), stable_id=F.col("doc_id"))).select("doc_id", "source")


@query("SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def delete_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left after a deletion by ids."""
    return store.without(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("""
WITH b AS (SELECT 'nation:' || n_nationkey AS id, NULL AS parent, 'region:' || n_regionkey AS file FROM nation UNION ALL
 SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 'region:' || n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey)
SELECT 'file:' || file AS source, id AS target, 'CONTAINS' AS edge_type FROM b UNION ALL SELECT parent, id, 'CONTAINS' FROM b WHERE parent IS NOT NULL
""")
def contains_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containment edges of files (regions), containers (nations) and their blocks (customers)."""
    nation = table(spark, sf_dir, "nation")
    customer = table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    file = text_of("region:", "n_regionkey")
    blocks = as_blocks(nation, stable_id=text_of("nation:", "n_nationkey"), file_path=file, kind=F.lit("class"), is_container=F.lit(True)).unionByName(
        as_blocks(customer, stable_id=text_of("customer:", "c_custkey"), parent_id=text_of("nation:", "n_nationkey"), file_path=file)
    )
    return graph.contains_edges(blocks).select("source", "target", "edge_type")


@query("""
SELECT 'r' || r_regionkey AS node, 0 AS level FROM region UNION ALL SELECT 'n' || n_nationkey, 1 FROM nation UNION ALL SELECT 'c' || c_custkey, 2 FROM customer
""")
def dag_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Processing levels, callees first: regions, the nations that call them, and the customers that call those."""
    region, nation, customer = (table(spark, sf_dir, t) for t in ("region", "nation", "customer"))
    blocks = as_blocks(region, stable_id=text_of("r", "r_regionkey"), file_path=F.lit("a")).unionByName(as_blocks(nation, stable_id=text_of("n", "n_nationkey"), file_path=F.lit("b"))).unionByName(as_blocks(customer, stable_id=text_of("c", "c_custkey"), file_path=F.lit("c")))
    up = nation.select(text_of("n", "n_nationkey").alias("source"), text_of("r", "n_regionkey").alias("target")).unionByName(customer.select(text_of("c", "c_custkey").alias("source"), text_of("n", "c_nationkey").alias("target")))
    levels, _ = graph.processing_levels(blocks, up.withColumns({"edge_type": F.lit("CALLS"), "resolved": F.lit(True)}))
    return levels.select("node", "level")


@query("""
SELECT doc_id, line, (sum(strlen(x) + 1) OVER (PARTITION BY doc_id ORDER BY line) - strlen(x) - 1)::BIGINT AS start
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents WHERE text IS NOT NULL)
""")
def running_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The byte offset of every line of every text."""
    starts = text.line_starts(table(spark, sf_dir, "documents").filter("text IS NOT NULL"), "doc_id")
    return starts.select("doc_id", F.col("line").cast("bigint").alias("line"), "start")


@query("SELECT 'o' || l_orderkey AS node, sha1(string_agg(p, '|' ORDER BY p)) AS dependency_hash FROM (SELECT l_orderkey, 'p' || l_partkey || '|s' || l_suppkey || '|' || CASE WHEN l_returnflag = 'R' THEN 'false' ELSE 'true' END AS p FROM lineitem) GROUP BY 1")
def dependency_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10: a hash of the sorted calls of each block: orders that call parts."""
    edges = table(spark, sf_dir, "lineitem").select(text_of("o", "l_orderkey").alias("source"), text_of("p", "l_partkey").alias("target"), text_of("s", "l_suppkey").alias("call_name"), (F.col("l_returnflag") != "R").alias("resolved"), F.lit("CALLS").alias("edge_type"))
    return store.dependency_hash(edges)


@query(f"""
WITH b AS (SELECT o_orderkey, o_custkey, o_orderstatus, {_priority_case} AS complexity FROM orders)
SELECT 'file' AS kind, o_orderstatus AS name, complexity, count(*) AS n FROM b GROUP BY ALL
UNION ALL SELECT 'class', CASE WHEN c_custkey % 2 = 0 THEN c_mktsegment ELSE '<?>' END, complexity, count(*) FROM b JOIN customer ON c_custkey = o_custkey GROUP BY ALL
UNION ALL SELECT 'edges', 'resolved', NULL, count(*) FILTER (WHERE l_returnflag <> 'R') FROM lineitem UNION ALL SELECT 'edges', 'unresolved', NULL, count(*) FILTER (WHERE l_returnflag = 'R') FROM lineitem
""")
def group_file_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by file (order status), by enclosing class (customers, every second one known), and of edges."""
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    to_class = F.create_map(*[F.lit(x) for kv in _PRIORITY_CLASS.items() for x in kv])
    blocks = as_blocks(orders, stable_id=text_of("o", "o_orderkey"), parent_id=text_of("c", "o_custkey"), name=text_of("f", "o_orderkey"), file_path=F.col("o_orderstatus"), language=F.col("o_orderpriority"))
    classes = as_blocks(customer.filter("c_custkey % 2 = 0"), stable_id=text_of("c", "c_custkey"), name=F.col("c_mktsegment"), kind=F.lit("class"), is_container=F.lit(True))
    done = blocks.unionByName(classes).withColumn("complexity", F.try_element_at(to_class, F.coalesce("language", F.lit(""))))
    edges = table(spark, sf_dir, "lineitem").select(F.lit("CALLS").alias("edge_type"), (F.col("l_returnflag") != "R").alias("resolved"))
    totals = report.edge_counts(edges).select(F.explode(F.create_map(F.lit("resolved"), "resolved", F.lit("unresolved"), "unresolved")).alias("name", "n"))
    return (
        report.by_file(done).select(F.lit("file").alias("kind"), F.col("file_path").alias("name"), "complexity", "n")
        .unionByName(report.by_class(done).select(F.lit("class").alias("kind"), F.col("group").alias("name"), "complexity", "n"))
        .unionByName(totals.select(F.lit("edges").alias("kind"), "name", F.lit(None).cast("string").alias("complexity"), "n"))
    )


@query("SELECT event_type, count(*) AS n, count(j) AS parsed FROM (SELECT event_type, CASE WHEN json_valid(props) AND starts_with(trim(props), '{') THEN props END AS j FROM events) GROUP BY 1")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSON objects in a text column."""
    return table(spark, sf_dir, "events").select("event_type", text.json_object(F.col("props")).alias("j")).groupBy("event_type").agg(F.count("*").alias("n"), F.count("j").alias("parsed"))


@query("""
SELECT 'c' || c_custkey AS block_id, count(DISTINCT s_suppkey) AS n_callers, 's' || min(s_suppkey::VARCHAR) AS first_caller FROM customer JOIN supplier ON s_nationkey = c_nationkey GROUP BY 1
""")
def called_by_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Callers by bare name: suppliers that call a nation's name, which its customers bear."""
    supplier, customer = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "customer")
    blocks = as_blocks(supplier, block_id=text_of("s", "s_suppkey"), name=text_of("s", "s_suppkey"), calls=F.array(text_of("n", "s_nationkey"))).unionByName(as_blocks(customer, block_id=text_of("c", "c_custkey"), name=text_of("n", "c_nationkey")))
    return callers(blocks).select("block_id", "n_callers", "first_caller")


@query("SELECT a.n_nationkey AS source, min(b.n_nationkey) AS component FROM nation a JOIN nation b USING (n_regionkey) GROUP BY 1")
def recursive_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strongly connected groups of a graph in which each region's nations form a ring."""
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    nation = table(spark, sf_dir, "nation")
    ring = nation.select(F.col("n_nationkey").alias("source"), F.coalesce(F.lead("n_nationkey").over(w), F.min("n_nationkey").over(Window.partitionBy("n_regionkey"))).alias("target"))
    return graph.strongly_connected(ring).select(F.col("node").alias("source"), "component")


#: Further files, that call the snippets and each other.
CALLING = [
    (11, "def run(xs):\n    for x in xs:\n        pairs(x)\n"),
    (12, "class Box:\n    def total(self):\n        return self.size()\n\n    def size(self):\n        return len(self.items)\n"),
    (13, "from pkg.s3 import scan as look\n\ndef outer(xs):\n    look(xs)\n    plain(1)\n"),
    (14, "def ping(n):\n    return pong(n)\n\ndef pong(n):\n    return ping(n - 1)\n"),
]


#: Names in the snippets that call each other; each copy of the corpus has its own.
_NAMES = "find|pairs|scan|two|window|step|plain|both|nothing|run|Box|total|size|outer|ping|pong|use"


def _corpus(rows: DataFrame, key: str, snippets) -> DataFrame:
    """Python files: a copy of the snippets for each row, names and folder marked by its key."""
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(code).alias("code")) for i, code in snippets])).alias("s")
    mark = F.col(key).cast("string")
    rows = rows.select(key).repartition(rows.sparkSession.sparkContext.defaultParallelism, key)  # few bytes a row, and much work
    code = F.regexp_replace(F.col("s.code"), F.lit(rf"\b({_NAMES})\b"), F.concat(F.lit("$1_"), "mark"))
    return rows.select(mark.alias("mark"), each).select(F.concat(F.lit("pkg"), "mark", F.lit("/s"), F.col("s.i").cast("string"), F.lit(".py")).alias("file_path"), F.lit("python").alias("language"), code.alias("content"))


@query(f"""
SELECT name || '_' || s_suppkey AS name, complexity, confidence FROM supplier, {_values([('find', 'O(log n)', 'high'), ('pairs', 'O(n^2)', 'medium'), ('scan', 'O(n log n)', 'high'), ('two', 'O(n)', 'high'), ('window', 'O(n)', 'high'), ('step', 'O(n)', 'medium'),
 ('plain', 'O(1)', 'high'), ('éwhile', 'O(1)', 'high'), ('both', 'O(n^2)', 'medium'), ('nothing', 'O(1)', 'high')], 'name, complexity, confidence')} WHERE name <> 'éwhile'
""")
def classify_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of a copy of the snippets for each supplier by the local rules."""
    blocks = extract(_corpus(table(spark, sf_dir, "supplier"), "s_suppkey", [s for s in SNIPPETS if s[0] != 8]))
    return classify.local_rules(classify.features(blocks)).select("name", "complexity", "confidence")


@query(f"""
SELECT 'pkg' || n_nationkey || '/' || file || '.py' AS file_path, CASE WHEN qualified_name LIKE '%.%' THEN replace(qualified_name, '.', '_' || n_nationkey || '.') || '_' || n_nationkey ELSE qualified_name || '_' || n_nationkey END AS qualified_name,
 kind, complexity, confidence, false AS needs_review, rule FROM nation, {_values([
    ('s1', 'find', 'function', 'O(log n)', 'high', 'pattern'), ('s2', 'pairs', 'function', 'O(n^2)', 'medium', 'pattern'), ('s3', 'scan', 'function', 'O(n log n)', 'medium', 'pattern'),
    ('s4', 'two', 'function', 'O(n)', 'high', 'pattern'), ('s5', 'window', 'function', 'O(n)', 'high', 'pattern'), ('s6', 'step', 'function', 'O(n)', 'medium', 'pattern'),
    ('s7', 'plain', 'function', 'O(1)', 'high', 'constant'), ('s9', 'both', 'function', 'O(n^2)', 'medium', 'pattern'),
    ('s10', 'nothing', 'function', 'O(1)', 'high', 'constant'), ('s11', 'run', 'function', 'O(n)', 'high', 'one_loop'), ('s12', 'Box', 'class', 'N/A', 'high', 'container'),
    ('s12', 'Box.total', 'method', 'O(1)', 'high', 'constant'), ('s12', 'Box.size', 'method', 'O(1)', 'high', 'constant'), ('s13', 'outer', 'function', 'O(n log n)', 'high', 'constant'),
    ('s14', 'ping', 'function', 'O(1)', 'high', 'constant'), ('s14', 'pong', 'function', 'O(1)', 'high', 'constant')], 'file, qualified_name, kind, complexity, confidence, rule')}
""")
def analyse_snippets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole analysis of a copy of the snippets for each nation, with their graph."""
    done = analyse_files(_corpus(table(spark, sf_dir, "nation"), "n_nationkey", [s for s in SNIPPETS + CALLING if s[0] != 8])).joined()
    return done.select("file_path", "qualified_name", "kind", "complexity", "confidence", "needs_review", "rule")


@query(f"""
SELECT 'pkg' || s_suppkey || '/' || replace(block, '#', '_' || s_suppkey) AS block_id, n_callers::BIGINT AS n_callers, 'pkg' || s_suppkey || '/' || replace(first_caller, '#', '_' || s_suppkey) AS first_caller,
 replace(replace(called_by, '@', 'pkg' || s_suppkey || '/'), '#', '_' || s_suppkey) AS called_by FROM supplier, {_values([
    ('s2.py:pairs#', 1, 's11.py:run#', '@s11.py:run#'), ('s7.py:plain#', 1, 's13.py:outer#', '@s13.py:outer#'), ('s12.py:Box#.total#', 1, 's12.py:Box#', '@s12.py:Box#'), ('s12.py:Box#.size#', 2, 's12.py:Box#', '@s12.py:Box#,@s12.py:Box#.total#'),
    ('s14.py:ping#', 1, 's14.py:pong#', '@s14.py:pong#'), ('s14.py:pong#', 1, 's14.py:ping#', '@s14.py:ping#')], 'block, n_callers, first_caller, called_by')}
""")
def called_by(spark: SparkSession, sf_dir: str) -> DataFrame:
    """J1, A1 on blocks: which blocks call a block's name, how many and the first, in a copy of all snippets for each supplier."""
    names = extract(_corpus(table(spark, sf_dir, "supplier"), "s_suppkey", SNIPPETS + CALLING)).select(F.concat("file_path", F.lit(":"), "qualified_name").alias("block_id"), "name", "calls")
    names = graph.cut(names)  # parsed once
    counted = callers(names).select("block_id", "n_callers", "first_caller")
    return counted.join(blocks_called_by(names, names).withColumn("called_by", F.array_join("called_by", ",")), "block_id", "left")


from . import source_queries  # noqa: E402

QUERIES |= source_queries.QUERIES
ORACLE_SQL |= source_queries.ORACLE_SQL

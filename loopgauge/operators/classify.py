"""Features, the local rules, and the cost of called blocks, as Columns and joins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lattice, patterns
from . import graph
from .blocks import by_key, is_analyzable, node_id

RULES_VERSION = "rules-1"
_NONE = "CAST(array() AS ARRAY<STRING>)"


def _flags(*parts: Column) -> Column:
    return F.array_sort(F.array_distinct(F.concat(*parts)))


def _when_flag(condition: Column, flag: str | Column) -> Column:
    return F.when(condition, F.array(F.lit(flag) if isinstance(flag, str) else flag)).otherwise(F.expr(_NONE))


def features(blocks: DataFrame, edges: DataFrame | None = None, recursive: DataFrame | None = None) -> DataFrame:
    """Analysable blocks with what the rules look at. edges: call edges of the graph; recursive: (node, component) on its cycles."""
    b = blocks.filter(is_analyzable()).withColumn("node", node_id())
    sites = F.filter("call_sites", lambda c: ~c["is_builtin_like"])
    first_of = lambda n: F.filter(sites, lambda c: c["call_name"] == n)[0]
    in_loop = F.filter(F.array_distinct(F.transform(sites, lambda c: c["call_name"])), lambda n: first_of(n)["inside_loop_depth"] > 0)
    b = b.withColumns({
        "has_log_pattern": F.col("source").rlike(patterns.LOG_TEXT), "has_sorting": F.col("source").rlike(patterns.SORT_TEXT),
        "self_call_count": F.size(F.filter("calls", lambda c: c == F.col("name"))), "branch_count": F.size(F.regexp_extract_all("source", F.lit(patterns.BRANCH_TEXT), F.lit(1))),
        "call_count": F.size("calls"), "dynamic_text": F.col("source").rlike(patterns.DYNAMIC_TEXT), "names_in_loop": in_loop,
    })
    if edges is None:
        b = b.withColumns({"edge_names": F.expr(_NONE), "unresolved": F.expr(_NONE), "loop_edges": F.expr(_NONE), "unresolved_count": F.lit(0)})
    else:
        open_edge = ~F.col("resolved")
        per = edges.filter("edge_type = 'CALLS'").groupBy(F.col("source").alias("node")).agg(
            F.collect_set("call_name").alias("edge_names"), F.collect_set(F.when(open_edge, F.col("call_name"))).alias("unresolved"),
            F.collect_set(F.when(open_edge & (F.col("inside_loop_depth") > 0), F.col("call_name"))).alias("loop_edges"), F.count_if(open_edge).cast("int").alias("unresolved_count"))
        b = b.join(by_key(per), "node", "left")
        b = b.withColumns({c: F.coalesce(c, F.expr(_NONE)) for c in ("edge_names", "unresolved", "loop_edges")} | {"unresolved_count": F.coalesce("unresolved_count", F.lit(0))})
    b = b.join(by_key(recursive.select("node", F.lit(True).alias("on_cycle"))), "node", "left") if recursive is not None else b.withColumn("on_cycle", F.lit(False))
    unknown = F.filter(F.array_except("calls", "edge_names"), lambda n: n != F.col("name"))
    b = b.withColumns({
        "on_cycle": F.coalesce("on_cycle", F.lit(False)), "unknown_names": unknown,
        "has_recursion": (F.col("self_call_count") >= 1) | F.coalesce("on_cycle", F.lit(False)),
        "recursion_kind": F.when(F.col("self_call_count") >= 2, "multi_branch").when(F.col("self_call_count") == 1, "linear").when(F.coalesce("on_cycle", F.lit(False)), "mutual"),
        "external_call_count": F.col("unresolved_count") + F.size(unknown),
        "opaque_in_loop": (F.size("loop_edges") > 0) | (F.size(F.array_intersect(unknown, "names_in_loop")) > 0),
    })
    dynamic_sites = F.transform(F.filter("call_sites", lambda c: c["is_dynamic"]), lambda c: F.concat(F.lit("dynamic_call:"), c["call_name"]))
    return b.withColumn("base_flags", _flags(
        _when_flag(F.col("dynamic_text"), "dynamic_call:runtime_dispatch"), dynamic_sites, _when_flag(F.coalesce("error_state", F.lit(False)), "syntax_error"),
        F.transform("unresolved", lambda n: F.concat(F.lit("unresolved_call:"), n)), F.transform("unknown_names", lambda n: F.concat(F.lit("unknown_call:"), n)),
    ))


def local_rules(b: DataFrame, project_calls: Column | None = None) -> DataFrame:
    """Adds complexity, confidence, needs_review, rule and flags by the first rule that holds. project_calls: calls with a known ranked target."""
    c = F.col
    project = F.coalesce(project_calls, F.lit(0)) if project_calls is not None else F.lit(0)
    many = (c("call_count") >= 3) & (c("max_loop_depth") == 0) & ~c("has_recursion") & (project == 0)
    flags = _flags(c("base_flags"), _when_flag(many, "many_calls_no_loops"))
    b = b.withColumn("flags", flags).withColumn("hit", patterns.best_hit(c("source"), c("loop_count"), c("max_loop_depth"), c("has_sorting")))
    unclear = F.exists("flags", lambda f: (f == "syntax_error") | f.startswith("dynamic_call:"))
    opaque = F.size(F.filter("flags", lambda f: f.startswith("unknown_call:") | f.startswith("unresolved_call:")))
    late = (F.array_contains("flags", "loop_bound_unknown") & (c("max_loop_depth") > 0)) | c("opaque_in_loop") | ((c("max_loop_depth") == 0) & ~c("has_recursion") & (opaque >= 3))
    name, nests, calls = F.lower(F.coalesce("name", F.lit(""))), c("max_loop_depth"), c("self_call_count")
    sort_or_log = c("has_sorting") | c("has_log_pattern")

    def verdict(cls, confidence, rule, review=False):
        return F.struct(F.lit(cls).alias("complexity") if isinstance(cls, str) else cls.alias("complexity"), F.lit(confidence).alias("confidence") if isinstance(confidence, str) else confidence.alias("confidence"), F.lit(rule).alias("rule"), F.lit(review).alias("needs_review"))

    chosen = (
        F.when((calls >= 1) & (F.contains(name, F.lit("factorial")) | F.contains(name, F.lit("permut"))), verdict("O(n!)", "medium", "factorial_name"))
        .when(calls >= 2, verdict("O(2^n)", "high", "branching_recursion"))
        .when(unclear, verdict("unknown", "low", "dynamic_or_invalid", True))
        .when(c("hit").isNotNull(), verdict(c("hit.complexity"), c("hit.confidence"), "pattern"))
        .when(late, verdict("unknown", "low", "opaque_calls", True))
        .when(nests >= 3, verdict("O(n^3)", "high", "three_loops"))
        .when(nests == 2, verdict("O(n^2)", "high", "two_loops"))
        .when((nests == 1) & sort_or_log, verdict("O(n log n)", "medium", "loop_with_sort_or_log"))
        .when(nests == 1, verdict("O(n)", "high", "one_loop"))
        .when((calls == 1) & c("has_log_pattern"), verdict("O(log n)", "medium", "halving_recursion"))
        .when(calls == 1, verdict("O(n)", "medium", "recursion"))
        .when(c("has_sorting"), verdict("O(n log n)", "high", "sorting"))
        .when((c("call_count") >= 3) & F.array_contains("flags", "many_calls_no_loops"), verdict("unknown", "low", "many_calls", True))
        .otherwise(verdict("O(1)", "high", "constant"))
    )
    b = b.withColumn("v", chosen)
    extra = _when_flag(c("v.needs_review"), "needs_ai_or_human")
    from_hit = F.when((c("v.rule") == "pattern") & c("hit.flag").isNotNull(), F.array(c("hit.flag"))).otherwise(F.expr(_NONE))
    return b.withColumn("flags", _flags(c("flags"), extra, from_hit)).select("*", "v.*").drop("v", "base_flags")


def loop_cost(start: Column, end: Column) -> Column:
    """struct(cost, has_while) of the loops of column loops that enclose lines start to end: product of their classes, null where it has none."""
    around = F.filter("loops", lambda x: (x["start_line"] <= start) & (end <= x["end_line"]))
    ranked = F.transform(around, lambda x: F.coalesce(x["estimated_complexity"], F.lit("O(n)")))
    return F.struct(lattice.fold_product(ranked).alias("cost"), F.exists(around, lambda x: x["kind"] == "while").alias("has_while"))


def call_costs(blocks: DataFrame, flow: DataFrame, known: DataFrame) -> DataFrame:
    """(node, project_calls, callee_max, no_product, has_while) from call edges with a ranked known callee (node, complexity).

    All edges of one name take the place of the last call of that name, as sites and edges are matched in order.
    """
    ranked = known.filter(lattice.is_ranked("complexity")).select(F.col("node").alias("target"), F.col("complexity").alias("callee"))
    w = W.partitionBy("source", "call_name").orderBy(F.desc("site"))
    placed = flow.filter("resolved AND target IS NOT NULL").withColumn("last_start", F.first("start_line").over(w)).withColumn("last_end", F.first("end_line").over(w))
    rows = placed.join(by_key(ranked), "target").join(by_key(blocks.select(F.col("node").alias("source"), "loops")), "source").withColumn("around", loop_cost(F.col("last_start"), F.col("last_end")))
    cost = F.when(F.col("last_start").isNull() | (F.size(F.filter("loops", lambda x: (x["start_line"] <= F.col("last_start")) & (F.col("last_end") <= x["end_line"]))) == 0), F.col("callee")).otherwise(lattice.multiply("around.cost", "callee"))
    rows = rows.withColumn("cost", cost)
    return rows.groupBy(F.col("source").alias("node")).agg(
        F.count("*").alias("project_calls"), F.max(F.when(F.col("cost").isNotNull(), F.struct(lattice.rank("cost").alias("r"), "cost")))["cost"].alias("callee_max"),
        F.max(F.col("cost").isNull()).alias("no_product"), F.max("around.has_while").alias("has_while"))


def merge(local: DataFrame) -> DataFrame:
    """Raises each local class to that of its calls and lowers the confidence; rows under review stay as they are."""
    c = F.col
    go = ~c("needs_review")
    conf = F.when(c("unresolved_count") >= 2, "low").when((c("unresolved_count") == 1) & (c("confidence") == "high"), "medium").when(F.coalesce("has_while", F.lit(False)) & (c("confidence") == "high"), "medium").otherwise(c("confidence"))
    return local.withColumns({
        "complexity": F.when(go, lattice.class_max("complexity", "callee_max")).otherwise(c("complexity")), "confidence": F.when(go, conf).otherwise(c("confidence")),
        "flags": F.when(go, _flags(c("flags"), _when_flag(F.coalesce("has_while", F.lit(False)), "while_loop_bound_unknown"), _when_flag(F.coalesce("no_product", F.lit(False)), "complexity_multiply_unknown"))).otherwise(c("flags")),
    })


RESULT = ["node", "complexity", "confidence", "needs_review", "rule", "flags"]


def skipped(blocks: DataFrame) -> DataFrame:
    """Results of blocks that are not analysed."""
    return blocks.filter(~is_analyzable()).select(node_id().alias("node"), F.lit("N/A").alias("complexity"), F.lit("high").alias("confidence"), F.lit(False).alias("needs_review"), F.lit("container").alias("rule"), F.expr(_NONE).alias("flags"), F.lit("none").alias("analyzer_kind"))


@dataclass
class Graph:
    """What the analysis of a project starts from: facts of each analysable block, the calls that results flow along, and their (source, target)."""

    facts: DataFrame
    calls: DataFrame
    flow: DataFrame

    @classmethod
    def of(cls, blocks: DataFrame, edges: DataFrame) -> Graph:
        edges = graph.cut(edges)
        cycles = graph.cut(graph.strongly_connected(edges.filter("edge_type = 'CALLS' AND resolved")))
        facts = graph.cut(both_ways(features(blocks, edges, cycles).dropDuplicates(["node"])))
        flow = graph.flow_of(blocks, edges, cycles)
        return cls(facts, graph.cut(edges.filter("edge_type = 'CALLS'").join(by_key(flow), ["source", "target"], "left_semi")), flow)


def both_ways(facts: DataFrame) -> DataFrame:
    """facts with what the local rules say of each block, `quiet` without and `busy` with known calls into the project: the rules look at nothing else of the callees."""
    verdict = F.struct("complexity", "confidence", "needs_review", "rule", "flags")
    quiet = local_rules(facts.withColumn("_flags", F.col("base_flags"))).withColumn("quiet", verdict)
    again = quiet.drop("complexity", "confidence", "needs_review", "rule", "flags", "hit").withColumn("base_flags", F.col("_flags"))
    busy = local_rules(again, F.lit(1)).withColumn("busy", verdict)
    return busy.drop("complexity", "confidence", "needs_review", "rule", "flags", "hit").withColumnRenamed("_flags", "base_flags")


def evaluate(now: DataFrame, calls: DataFrame, known: DataFrame | None) -> DataFrame:
    """Results of facts `now` of both_ways(), given the results (node, complexity) of the blocks they call."""
    if known is None:
        costs = now.select("node", F.lit(0).alias("project_calls"), F.lit(None).cast("string").alias("callee_max"), F.lit(False).alias("no_product"), F.lit(False).alias("has_while"))
    else:
        costs = call_costs(now, calls.join(by_key(now.select(F.col("node").alias("source"))), "source", "left_semi"), known)
    local = now.join(by_key(costs), "node", "left").withColumn("v", F.when(F.coalesce("project_calls", F.lit(0)) > 0, F.col("busy")).otherwise(F.col("quiet")))
    return merge(local.select("*", "v.*"))


def settled(done: DataFrame, sent: list[str]) -> DataFrame:
    """Rows of evaluate() in a run that leaves nothing open: uncertain blocks get a conservative class, which their callers see, but for those that are sent to an estimator."""
    falls = needs_scoring() & ~F.col("node").isin(sent)
    return done.select(
        "node", F.when(falls, conservative(done)).otherwise(F.col("complexity")).alias("complexity"), F.when(falls, "low").otherwise(F.col("confidence")).alias("confidence"),
        (F.col("needs_review") | needs_scoring()).alias("needs_review"), "rule", "flags", F.when(falls, "llm_error").otherwise("rule").alias("analyzer_kind"),
    )


def _classes(ranks: DataFrame) -> DataFrame:
    """(node, complexity) of (node, value), values being ranks; null below 0."""
    return ranks.select("node", F.when(F.col("value") >= 0, F.array(*[F.lit(c) for c in lattice.CLASSES])[F.col("value")]).alias("complexity"))


class Run:
    """Results of a graph, callees before callers: all at once, or level by level where a budget or an old run goes by the order.

    fallback: uncertain blocks get a conservative class at once, and callers see it; the first `budget` of them in processing order (level, then place in the source)
    keep the rules' class and are left in `sent` for an estimator. old: results of the last run of the same nodes; those that are `usable` are taken.
    Then only blocks without a usable one and the callers of blocks whose class is not what it was are computed.
    """

    def __init__(self, found: Graph, fallback: bool = False, budget: int = 0, old: DataFrame | None = None):
        self.found, self.fallback, self.budget, self.sent, self.computed = found, fallback, budget, [], 0
        self.old = self.before = None
        if old is not None:
            before = graph.cut(old.select(*RESULT, "analyzer_kind", "usable").dropDuplicates(["node"]))
            self.old, self.before = before.filter("usable").drop("usable"), before.select("node", F.col("complexity").alias("was"), F.lit(True).alias("known"))

    def results(self) -> DataFrame | None:
        if self.old is None and not self.budget:
            return self._at_once()
        facts, flow = self.found.facts, self.found.flow
        nodes = facts.select("node")
        changed = nodes
        if self.old is not None:
            changed = graph.cut(nodes.join(by_key(self.old), "node", "left_anti"))
            nodes = graph.upward(flow, changed)  # no other block can get another class
        levels = graph.levels_of(nodes, flow)
        known = graph.Growing(facts.sparkSession)
        if self.old is not None:
            known.add(self.old.join(by_key(nodes), "node", "left_anti"))
        for (level,) in levels.select("level").distinct().orderBy("level").collect():  # as many as the longest chain of calls among them
            here = levels.filter(F.col("level") == level).select("node")
            todo = here
            if self.old is not None:
                told = flow.join(by_key(self._other(known)), "target", "left_semi").select(F.col("source").alias("node")) if known.parts else changed
                todo = graph.cut(here.join(by_key(changed.unionByName(told)), "node", "left_semi"))
                known.add(self.old.join(by_key(here.join(by_key(todo), "node", "left_anti")), "node", "left_semi"))
            seen = Observation()
            known.add(self._level(facts.join(by_key(todo), "node", "left_semi"), known.read()).observe(seen, F.count("*").alias("n")))
            self.computed += seen.get.get("n") or 0
        return known.read()

    def _outcome(self, now: DataFrame, calls: DataFrame, known: DataFrame | None) -> DataFrame:
        done = evaluate(now, calls, known)
        return settled(done, []) if self.fallback else done.select(*RESULT, F.lit("rule").alias("analyzer_kind"))

    def _at_once(self) -> DataFrame | None:
        """Results of all blocks: they look at nothing but the ranks of the classes they call, so ranks alone go through the graph, chains of calls in one step."""
        facts, calls = self.found.facts, self.found.calls
        ranks = graph.settle(facts.select("node"), self.found.flow, self._ranks, self._choices, lambda step, then: F.transform(then, lambda x: step[x + 1]), lambda step, value: step[value + 1])
        if ranks is None:
            return None
        self.computed = facts.count()
        return graph.cut(self._outcome(facts, calls, _classes(ranks)))

    def _ranks(self, ready: DataFrame, known: DataFrame | None) -> DataFrame:
        now = self.found.facts.join(by_key(ready), "node", "left_semi")
        return self._outcome(now, self.found.calls, None if known is None else _classes(known)).select("node", lattice.rank("complexity").alias("value"))

    def _choices(self, waiting: DataFrame, known: DataFrame | None) -> DataFrame:
        """(node, step): the rank of each block waiting for one callee, for each rank that this may get, from none (-1) on: blocks and callees are tried once for each."""
        ranks = F.explode(F.sequence(F.lit(-1), F.lit(len(lattice.CLASSES) - 1))).alias("r")
        tried = waiting.select("node", F.col("target").alias("open"), ranks)
        marked = lambda c: F.concat(c, F.lit("\x01"), F.col("r").cast("string"))
        now = self.found.facts.join(by_key(tried), "node").withColumn("node", marked(F.col("node"))).drop("open", "r")
        calls = self.found.calls.join(by_key(tried.withColumnRenamed("node", "source")), "source").withColumn("target", F.when(F.col("target") == F.col("open"), marked(F.col("target"))).otherwise(F.col("target")))
        calls = calls.withColumn("source", marked(F.col("source"))).drop("open", "r")
        guessed = waiting.select(F.col("target")).distinct().select("target", ranks).select(marked(F.col("target")).alias("node"), F.col("r").alias("value"))
        done = self._outcome(now, calls, _classes(guessed if known is None else guessed.unionByName(known)))
        tries = F.struct(F.regexp_extract("node", "\x01(-?[0-9]+)$", 1).cast("int").alias("r"), lattice.rank("complexity").alias("value"))
        return done.groupBy(F.regexp_replace("node", "\x01-?[0-9]+$", "").alias("node")).agg(F.transform(F.array_sort(F.collect_list(tries)), lambda x: x["value"]).alias("step"))

    def _other(self, known: graph.Growing) -> DataFrame:
        """(target): blocks whose class is not what it was, or was not known."""
        now = known.read().select("node", "complexity").join(by_key(self.before), "node", "left")
        return now.filter(~(F.coalesce("known", F.lit(False)) & F.col("complexity").eqNullSafe(F.col("was")))).select(F.col("node").alias("target"))

    def _level(self, now: DataFrame, known: DataFrame | None) -> DataFrame:
        """Results of a level; how many are counted when they are written."""
        done = evaluate(now, self.found.calls, known)
        if not self.fallback:
            return done.select(*RESULT, F.lit("rule").alias("analyzer_kind"))
        left, now_sent = self.budget - len(self.sent), []
        if left > 0:
            done = graph.cut(done)
            now_sent = [r.node for r in done.filter(needs_scoring()).orderBy("file_path", "ordinal").limit(left).select("node").collect()]
            self.sent += now_sent
        return settled(done, now_sent)


def analyse(blocks: DataFrame, edges: DataFrame | None = None, fallback: bool = False) -> DataFrame:
    """Results (node, complexity, confidence, needs_review, rule, flags, analyzer_kind) of all blocks; containers get N/A.

    With edges, callees are done before callers, a level of the call graph at a time; each level is a few joins.
    """
    if edges is None:
        done = local_rules(features(blocks))
        rows = settled(done, []) if fallback else done.select(*RESULT, F.lit("rule").alias("analyzer_kind"))
    else:
        rows = Run(Graph.of(blocks, edges), fallback).results()
    return rows.unionByName(skipped(blocks))


def short_label() -> Column:
    """The class, or O(?) where there is none."""
    shown = F.coalesce("complexity", F.lit("unknown"))
    return F.when(shown == "unknown", "O(?)").otherwise(shown)


def needs_scoring() -> Column:
    c = F.col
    return c("complexity").isNull() | (c("complexity") == "unknown") | c("needs_review") | (c("confidence") == "low")


def conservative(b: DataFrame) -> Column:
    """A ranked class from features alone, for rows of features() joined with their results."""
    c = F.col
    return (
        F.when(lattice.is_ranked("complexity"), c("complexity"))
        .when((c("self_call_count") >= 2) | (c("recursion_kind") == "multi_branch"), "O(2^n)")
        .when(c("has_recursion") | (c("self_call_count") == 1), "O(n)").when(c("has_sorting"), "O(n log n)")
        .when(c("max_loop_depth") >= 3, "O(n^3)").when(c("max_loop_depth") == 2, "O(n^2)").when(c("max_loop_depth") == 1, "O(n)")
        .when(F.size("container_operations") > 0, "O(n)").when((c("call_count") > 0) | (c("external_call_count") > 0) | (F.size("flags") > 0), "O(n)").otherwise("O(1)")
    )

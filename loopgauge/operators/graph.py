"""Call resolution and the dependency graph: edges by joins, strongly connected groups and order by rounds of joins.

Definitions form classes (one name in one scope) that carry their number and two members; a call is joined with the classes it may mean,
so neither names nor calls are ever compared or listed in pairs.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .blocks import by_key, is_analyzable, node_id

EDGE_COLUMNS = ["source", "target", "call_name", "edge_type", "resolved", "state", "confidence", "start_line", "inside_loop_depth", "site", "candidates", "candidate_class"]


_local: dict[str, str] = {}


def shared_path(spark) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset and all tasks run on this machine."""
    context = spark.sparkContext
    path = context.getConf().get("spark.checkpoint.dir") or _local.get(context.applicationId)
    if not path:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _local[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="cut-")
    return path.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    target = f"{shared_path(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(target)
    return df.sparkSession.read.schema(df.schema).parquet(target)


class Growing:
    """A table that parts are added to, in one folder of the shared storage: however many there are, it is read as one."""

    def __init__(self, spark):
        self.spark, self.path, self.schema, self.parts = spark, f"{shared_path(spark)}/growing-{uuid.uuid4().hex}", None, 0

    def add(self, rows: DataFrame) -> None:
        self.schema = self.schema or rows.schema
        rows.write.parquet(f"{self.path}/part={self.parts}")
        self.parts += 1

    def read(self) -> DataFrame | None:
        """All parts; none before the first."""
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.path) if self.parts else None


def module_name(path: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(path, r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")


def _class_prefix(name: Column) -> Column:
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.[^.]*$", ""))


def call_sites(blocks: DataFrame) -> DataFrame:
    """A row for each call of an analysable block that is no builtin: its sites, or its bare names where there are none."""
    sites = F.when(F.size("call_sites") > 0, F.transform("call_sites", lambda c: F.struct(
        c["call_name"].alias("call_name"), c["receiver"].alias("receiver"), c["qualified_hint"].alias("hint"), c["is_dynamic"].alias("is_dynamic"),
        c["is_builtin_like"].alias("is_builtin"), c["start_line"].alias("start_line"), c["end_line"].alias("end_line"), c["inside_loop_depth"].alias("depth"))))
    bare = F.transform("calls", lambda n: F.struct(
        n.alias("call_name"), F.lit(None).cast("string").alias("receiver"), F.lit("").alias("hint"), F.lit(False).alias("is_dynamic"),
        F.lit(False).alias("is_builtin"), F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(0).alias("depth")))
    return (
        blocks.filter(is_analyzable())
        .select(node_id().alias("source"), "file_path", _class_prefix(F.col("qualified_name")).alias("own_class"), "imports", F.posexplode(F.coalesce(sites, bare)).alias("site", "c"))
        .select("source", "file_path", "own_class", "imports", "site", "c.*").filter(~F.coalesce("is_builtin", F.lit(False)))
    )


def _class_of(scope: str, *parts: Column | str) -> Column:
    """Key of a set of definitions: those of one name in one scope; null where a part is."""
    return F.concat(F.lit(scope), *[F.concat(F.lit("\x1f"), p) for p in parts])


def definitions(blocks: DataFrame) -> DataFrame:
    """(candidate_class, target): each analysable block in the classes that calls may mean: by name, by file and name, by module and name, by class and name, by full name."""
    known = blocks.filter(is_analyzable()).select(
        node_id().alias("target"), "name", "qualified_name", "file_path", module_name(F.col("file_path")).alias("module"), _class_prefix(F.col("qualified_name")).alias("own_class"), "ordinal").distinct()
    keys = F.array(_class_of("name", "name"), _class_of("file", "file_path", "name"), _class_of("module", "module", "name"), _class_of("class", "own_class", "name"))
    by_name = known.select("target", F.explode(keys).alias("candidate_class")).filter("candidate_class IS NOT NULL").distinct()
    last = known.filter("qualified_name <> ''").groupBy("qualified_name").agg(F.max(F.struct("file_path", "ordinal", "target"))["target"].alias("target"))  # of one full name the last stands
    return by_name.select("candidate_class", "target").unionByName(last.select(_class_of("full", "qualified_name").alias("candidate_class"), "target"))


def resolve(blocks: DataFrame) -> DataFrame:
    """Call edges. One target: resolved; several by name: ambiguous, without target; none, empty or dynamic: unresolved.

    A call looks into up to five classes of definitions, best first, and the first that holds another block decides. Classes carry their number of
    definitions and two of them, which settle every case, so the work grows with calls and definitions, not with their pairs; an edge names
    its class (candidate_class) and how many of it were meant (candidates), and candidates_of() lists them.
    """
    calls = call_sites(blocks)
    names = blocks.filter(is_analyzable()).select(node_id().alias("source"), F.col("name").alias("own_name")).dropDuplicates(["source"])
    live = calls.join(by_key(names), "source").filter((F.coalesce("call_name", F.lit("")) != "") & ~F.coalesce("is_dynamic", F.lit(False)))
    alias = lambda i: F.coalesce(i["alias"], i["name"])
    live = live.withColumn("by_receiver", F.try_element_at(F.filter("imports", lambda i: alias(i) == F.col("receiver")), F.lit(-1)))
    live = live.withColumn("by_name", F.when(F.col("by_receiver").isNull(), F.try_element_at(F.filter("imports", lambda i: alias(i) == F.col("call_name")), F.lit(-1))))
    last = lambda m: F.element_at(F.split(m, r"\."), -1)
    module = last(F.coalesce(F.nullif(F.col("by_receiver.module"), F.lit("")), F.col("by_receiver.name")))
    self_call = F.col("own_name") == F.col("call_name")  # the calling block is one of the definitions of that name, and not meant
    look = lambda n, key, less: F.struct(F.lit(n).alias("priority"), key.alias("candidate_class"), less.alias("less"))
    none = F.lit(False)
    looks = F.array(
        look(0, F.when(F.col("receiver") == "self", _class_of("class", "own_class", "call_name")), none),
        look(1, F.when(F.col("by_receiver").isNotNull(), _class_of("module", module, "call_name")).otherwise(_class_of("name", "by_name.name")), none),
        look(2, _class_of("full", "hint"), none), look(3, _class_of("file", "file_path", "call_name"), self_call), look(4, _class_of("name", "call_name"), self_call),
    )
    key = ["source", "site"]
    sets = definitions(blocks).groupBy("candidate_class").agg(F.count("*").alias("n"), F.min("target").alias("first"), F.max("target").alias("last"))
    met = live.select(*key, F.explode(looks).alias("look")).select(*key, "look.*").filter("candidate_class IS NOT NULL").join(by_key(sets), "candidate_class")
    met = met.withColumn("less", F.col("less") | ((F.col("priority") == 2) & (F.col("first") == F.col("source"))))
    met = met.withColumn("candidates", (F.col("n") - F.col("less").cast("long")).cast("int")).filter("candidates > 0")
    single = F.when(F.col("candidates") == 1, F.when(F.col("less") & (F.col("first") == F.col("source")), F.col("last")).otherwise(F.col("first")))
    best = met.select(*key, F.struct("priority", "candidate_class", "candidates", single.alias("target")).alias("best")).groupBy(*key).agg(F.min("best").alias("best"))
    out = calls.join(by_key(best), key, "left").withColumn("n", F.coalesce("best.candidates", F.lit(0)))
    state = F.when(F.col("n") == 0, "unresolved").when((F.col("n") == 1) | (F.col("best.priority") == 0), "resolved").otherwise("ambiguous")
    resolved = F.col("n") == 1
    return out.select(
        "source", "best.target", "call_name", F.lit("CALLS").alias("edge_type"), resolved.alias("resolved"), state.alias("state"), F.when(resolved, "high").otherwise("low").alias("confidence"),
        "start_line", "end_line", F.coalesce("depth", F.lit(0)).alias("inside_loop_depth"), "site", F.col("n").alias("candidates"), "best.candidate_class",
    )


def candidates_of(edges: DataFrame, blocks: DataFrame) -> DataFrame:
    """(source, site, target): every definition that some chosen edges may mean. A row for each pair: choose the edges first."""
    wanted = edges.filter("candidate_class IS NOT NULL").select("source", "site", "candidate_class")
    return wanted.join(by_key(definitions(blocks)), "candidate_class").filter("source <> target OR candidate_class LIKE 'class%' OR candidate_class LIKE 'module%'").select("source", "site", "target")


def file_node() -> Column:
    return F.concat(F.lit("file:"), F.col("file_path"))


def contains_edges(blocks: DataFrame) -> DataFrame:
    """File to block and parent to block."""
    from_file = blocks.select(file_node().alias("source"), node_id().alias("target"))
    parents = blocks.filter("stable_id <> ''").select(F.col("stable_id").alias("source")).distinct()
    from_parent = blocks.filter("parent_id IS NOT NULL").select(F.col("parent_id").alias("source"), node_id().alias("target")).join(by_key(parents), "source", "left_semi")
    return from_file.unionByName(from_parent).withColumns({"edge_type": F.lit("CONTAINS"), "resolved": F.lit(True), "confidence": F.lit("high")})


def import_edges(blocks: DataFrame) -> DataFrame:
    """One edge for each file, module and alias; the first import in source order stays."""
    rows = blocks.select(file_node().alias("source"), "ordinal", F.posexplode("imports").alias("at", "i")).withColumn("call_name", F.coalesce(F.nullif(F.col("i.module"), F.lit("")), F.col("i.name")))
    w = W.partitionBy("source", "call_name", F.coalesce("i.alias", F.lit(""))).orderBy("ordinal", "at")
    return (
        rows.filter("call_name <> ''").withColumn("_n", F.row_number().over(w)).filter("_n = 1")
        .select("source", "call_name", F.col("i.line").alias("start_line"), F.lit("IMPORTS").alias("edge_type"), F.lit(False).alias("resolved"), F.lit("medium").alias("confidence"))
    )


def structure(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """The whole graph: call edges with those of containment and imports."""
    return edges.unionByName(contains_edges(blocks), allowMissingColumns=True).unionByName(import_edges(blocks), allowMissingColumns=True)


def callees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Targets of the resolved calls of nodes (node)."""
    calls = edges.filter("edge_type = 'CALLS' AND resolved")
    return calls.join(by_key(nodes.select(F.col("node").alias("source"))), "source", "left_semi").select("source", "target").distinct()


def callers(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Sources of the resolved calls to nodes (node)."""
    calls = edges.filter("edge_type = 'CALLS' AND resolved")
    return calls.join(by_key(nodes.select(F.col("node").alias("target"))), "target", "left_semi").select("source", "target").distinct()


def in_order(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[Column], right_order: list[Column]) -> DataFrame:
    """The k-th row of left beside the k-th of right for each value of keys, with column k (from 1); rows without a partner go."""
    number = lambda df, order: df.withColumn("k", F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
    return number(left, left_order).join(by_key(number(right, right_order)), [*keys, "k"])


def sites_of_edges(blocks: DataFrame, edges: DataFrame) -> DataFrame:
    """Call edges beside the call site they came from: the k-th edge of a name in a block with its k-th site."""
    sites = call_sites(blocks).select("source", "call_name", F.col("site").alias("at"), F.col("start_line").alias("site_line"), F.col("depth").alias("site_depth"))
    return in_order(edges.filter("edge_type = 'CALLS'"), sites, ["source", "call_name"], [F.col("site")], [F.col("at")])


def along(links: DataFrame, compose: Callable[[Column, Column], Column]) -> DataFrame:
    """links (node, target, step), one for each node, after each has gone on along the links that follow it: target is then a node without a link, step the
    composition of the steps on the way. Each round doubles the length. On rings of links no target is the last; there it ends once the steps stay, which must be
    the smallest of something then.
    """
    links, before = cut(links.select("node", "target", "step")), None
    while True:
        on = links.select(F.col("node").alias("target"), F.col("target").alias("far"), F.col("step").alias("then"))
        further, step = F.col("far").isNotNull(), F.when(F.col("far").isNotNull(), compose(F.col("step"), F.col("then"))).otherwise(F.col("step"))
        seen = Observation()
        moved = links.join(by_key(on), "target", "left").withColumn("next", step).observe(seen, F.count_if(further).alias("n"), F.count_if(~F.col("next").eqNullSafe(F.col("step"))).alias("changed"))
        links = cut(moved.select("node", F.coalesce("far", "target").alias("target"), F.col("next").alias("step")))
        n = seen.get.get("n")
        if not n or (n == before and not seen.get.get("changed")):
            return links
        before = n


def lone(edges: DataFrame, node: str = "source", other: str = "target") -> DataFrame:
    """(node, target) of nodes with one edge."""
    ends = edges.groupBy(F.col(node).alias("node")).agg(F.count("*").alias("n"), F.max(other).alias("target"))
    return ends.filter("n = 1").select("node", "target")


def leading_on(edges: DataFrame) -> DataFrame:
    """Edges (source, target) from whose target a cycle is reached. Nodes without a way out go, and with them all that hang on one by a chain of nodes with one way out."""
    while True:
        ends = cut(edges.select(F.col("target").alias("node")).distinct().join(by_key(edges.select(F.col("source").alias("node"))), "node", "left_anti"))
        if ends.isEmpty():
            return edges
        chains = along(lone(edges).withColumn("step", F.lit(0)), F.least)
        dead = ends.unionByName(chains.join(by_key(ends.withColumnRenamed("node", "target")), "target", "left_semi").select("node"))
        edges = cut(edges.join(by_key(dead.withColumnRenamed("node", "target")), "target", "left_anti").select("source", "target"))


def turned(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("target").alias("source"), F.col("source").alias("target"))


def strongly_connected(edges: DataFrame) -> DataFrame:
    """(node, component) of nodes on cycles of edges (source, target): groups of several nodes and self loops; component is the smallest node.

    What no cycle leads to or from goes first. Then rounds of colouring: the smallest label that reaches each node goes forward along the edges; among nodes of one
    label those that reach the label's node form a component. Edges between different labels lie on no cycle and go, so
    the rest is smaller in every round and done when no edge is left.
    """
    left = cut(edges.filter("source IS NOT NULL AND target IS NOT NULL").select("source", "target").distinct())
    out = left.filter("source = target").select(F.col("source").alias("node"), F.col("source").alias("component"))
    left = left.filter("source <> target")
    while True:
        left = turned(leading_on(turned(leading_on(cut(left)))))
        if left.isEmpty():
            break
        colour = spread(left, left.select(F.explode(F.array("source", "target")).alias("node")).distinct().withColumn("label", F.col("node")))
        of = lambda end, name: colour.select(F.col("node").alias(end), F.col("label").alias(name))
        same = cut(left.join(by_key(of("source", "a")), "source").join(by_key(of("target", "b")), "target").filter("a = b").select("source", "target"))
        reached = spread(turned(same), colour.select("node", F.when(F.col("node") == F.col("label"), F.col("node")).alias("label"))).filter("label IS NOT NULL")
        several = reached.join(by_key(reached.groupBy("label").agg(F.count("*").alias("n")).filter("n > 1")), "label")
        out = cut(out.unionByName(several.select("node", F.col("label").alias("component"))))
        done = reached.select("node")
        left = same.join(by_key(done.withColumnRenamed("node", "source")), "source", "left_anti").join(by_key(done.withColumnRenamed("node", "target")), "target", "left_anti").select("source", "target")
    return out.groupBy("node").agg(F.min("component").alias("component"))


def spread(edges: DataFrame, values: DataFrame) -> DataFrame:
    """values (node, label) after the smallest label has gone along all edges (source, target) as far as it gets.

    Chains of nodes with one way in are taken at once: each has the smallest label on the way from the chain's head, and the head's. The heads get theirs by a round for each step between them.
    """
    values = cut(values)
    chains = cut(along(lone(edges, "target", "source").join(by_key(values.withColumnRenamed("label", "step")), "node"), F.least))
    heads = values.join(by_key(chains), "node", "left_anti")
    # a chain's members pass on the smallest label on their way at once, the head's follows
    ends = cut(edges.join(by_key(chains.select(F.col("node").alias("target"))), "target", "left_anti").join(by_key(chains.select(F.col("node").alias("source"), F.col("target").alias("head"), "step")), "source", "left"))
    first = ends.groupBy(F.col("target").alias("node")).agg(F.min("step").alias("step"))
    top = cut(heads.join(by_key(first), "node", "left").select("node", F.least("label", "step").alias("label")))
    between = cut(ends.select(F.coalesce("head", "source").alias("source"), "target").distinct())
    while True:
        offers = between.join(by_key(top.select(F.col("node").alias("source"), F.col("label").alias("offer"))), "source").groupBy(F.col("target").alias("node")).agg(F.min("offer").alias("offer"))
        better = F.coalesce(F.col("offer") < F.col("label"), F.col("label").isNull() & F.col("offer").isNotNull())
        seen = Observation()
        top = cut(top.join(by_key(offers), "node", "left").observe(seen, F.count_if(better).alias("n")).select("node", F.least("label", "offer").alias("label")))
        if not seen.get.get("n"):
            break
    inner = chains.join(by_key(top.withColumnRenamed("node", "target")), "target", "left").select("node", F.least("step", "label").alias("label"))
    return cut(top.unionByName(inner))


def settle(
    nodes: DataFrame, flow: DataFrame, value: Callable[[DataFrame, DataFrame | None], DataFrame], choice: Callable[[DataFrame, DataFrame | None], DataFrame],
    compose: Callable[[Column, Column], Column], apply: Callable[[Column, Column], Column],
) -> DataFrame | None:
    """(node, value) of nodes that depend on those they call, by edges (source, target) without cycles; none without nodes.

    value(ready, known): values of nodes (node) whose callees are all known. choice(open, known): for nodes that wait for one callee (node, target), what their value
    depends on that one's by: (node, step). apply(step, value) is that value, compose(step, then) the step over two links. Each round does
    the nodes whose callees are known, and joins chains of nodes that wait for one callee each to a single step, so a chain takes as many rounds as its length has binary digits.
    """
    left, known, hung = cut(nodes.select("node").distinct()), Growing(nodes.sparkSession), None
    inside = lambda end: left.select(F.col("node").alias(end))
    waiting = cut(flow.join(by_key(inside("source")), "source", "left_semi").join(by_key(inside("target")), "target", "left_semi").select("source", "target").distinct())
    while not left.isEmpty():
        ready = cut(left.join(by_key(waiting.select(F.col("source").alias("node"))), "node", "left_anti"))
        if ready.isEmpty():
            raise ValueError("the edges have a cycle")
        new = cut(value(ready, known.read()).select("node", "value"))
        if hung is not None:
            freed = hung.join(by_key(new.select(F.col("node").alias("target"), "value")), "target")
            new = cut(new.unionByName(freed.select("node", apply(F.col("step"), F.col("value")).alias("value"))))
            hung = cut(hung.join(by_key(new.select("node")), "node", "left_anti"))
        known.add(new)
        left = cut(left.join(by_key(new), "node", "left_anti"))
        waiting = cut(waiting.join(by_key(new.select(F.col("node").alias("target"))), "target", "left_anti").select("source", "target"))
        chained = cut(lone(waiting))
        behind = chained.select("node") if hung is None else chained.select("node").unionByName(hung.select("node"))
        if chained.join(by_key(behind.withColumnRenamed("node", "target")), "target", "left_semi").isEmpty():
            continue
        steps = chained.join(by_key(choice(chained, known.read())), "node").select("node", "target", "step")
        hung = along(steps if hung is None else steps.unionByName(hung.select("node", "target", "step")), compose)
        left = cut(left.join(by_key(chained), "node", "left_anti"))
        waiting = cut(waiting.join(by_key(chained.select(F.col("node").alias("source"))), "source", "left_anti").select("source", "target"))
    return known.read()


def upward(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(node): seeds and all nodes that reach one along edges (source, target); each round goes on from the nodes that the last one added."""
    reached = fresh = cut(seeds.select("node").distinct())
    while True:
        more = edges.join(by_key(fresh.withColumnRenamed("node", "target")), "target", "left_semi").select(F.col("source").alias("node")).distinct()
        fresh = cut(more.join(by_key(reached), "node", "left_anti"))
        if fresh.isEmpty():
            return reached
        reached = cut(reached.unionByName(fresh))


def flow_of(blocks: DataFrame, edges: DataFrame, cycles: DataFrame) -> DataFrame:
    """(source, target) that a result can flow along, without cycles. Blocks on cycles (node) or above them are handled in source order, so among
    them only callees that come earlier count."""
    nodes = cut(blocks.filter(is_analyzable()).select(node_id().alias("node"), F.struct("file_path", "ordinal").alias("pos")).groupBy("node").agg(F.min("pos").alias("pos")))
    calls = edges.filter("edge_type = 'CALLS' AND resolved AND target IS NOT NULL").select("source", "target").distinct()
    calls = cut(calls.join(by_key(nodes.select(F.col("node").alias("source"))), "source", "left_semi").join(by_key(nodes.select(F.col("node").alias("target"))), "target", "left_semi"))
    stuck = upward(calls, cycles)
    if stuck.isEmpty():
        return calls
    late = nodes.join(by_key(stuck), "node")
    a, b = (late.select(F.col("node").alias(x), F.col("pos").alias(p)) for x, p in (("source", "ps"), ("target", "pt")))
    backward = calls.join(by_key(a), "source").join(by_key(b), "target").filter("pt >= ps").select("source", "target")
    return cut(calls.join(by_key(backward), ["source", "target"], "left_anti"))


def levels_of(nodes: DataFrame, flow: DataFrame) -> DataFrame:
    """(node, level) of nodes, callees before callers, by edges (source, target) without cycles between them."""
    inner = flow.join(by_key(nodes.select(F.col("node").alias("source"))), "source", "left_semi").join(by_key(nodes.select(F.col("node").alias("target"))), "target", "left_semi")
    inner = cut(inner.select("source", "target").distinct())

    def above(some: DataFrame, known: DataFrame | None) -> DataFrame:
        """(node, least): one more than the highest level of the known callees."""
        if known is None:
            return some.select("node", F.lit(0).alias("least"))
        calls = inner.join(by_key(known.select(F.col("node").alias("target"), "value")), "target").groupBy(F.col("source").alias("node")).agg((F.max("value") + 1).alias("least"))
        return some.join(by_key(calls), "node", "left").select("node", F.coalesce("least", F.lit(0)).alias("least"))

    found = settle(
        nodes, inner, lambda ready, known: above(ready, known).withColumnRenamed("least", "value"),
        lambda open_, known: above(open_, known).select("node", F.struct("least", F.lit(1).alias("more")).alias("step")),
        lambda step, then: F.struct(F.greatest(step["least"], then["least"] + step["more"]).alias("least"), (step["more"] + then["more"]).alias("more")),
        lambda step, value: F.greatest(step["least"], value + step["more"]),
    )
    return nodes.select("node", F.lit(0).alias("level")) if found is None else found.select("node", F.col("value").alias("level"))


def processing_levels(blocks: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(levels, deps). levels: (node, level), callees before callers. deps: (source, target) that a result can flow along.

    Nodes on no cycle and above none get their levels first. The others follow in source order: only callees that come earlier there count, so the remaining edges have no cycle.
    """
    nodes = cut(blocks.filter(is_analyzable()).select(node_id().alias("node")).distinct())
    calls = edges.filter("edge_type = 'CALLS' AND resolved")
    cycles = cut(strongly_connected(calls.join(by_key(nodes.select(F.col("node").alias("source"))), "source", "left_semi").join(by_key(nodes.select(F.col("node").alias("target"))), "target", "left_semi")))
    flow = flow_of(blocks, edges, cycles)
    if cycles.isEmpty():
        return levels_of(nodes, flow), flow
    stuck = upward(calls.filter("target IS NOT NULL").join(by_key(nodes.select(F.col("node").alias("source"))), "source", "left_semi"), cycles)
    placed = cut(levels_of(nodes.join(by_key(stuck), "node", "left_anti"), flow))
    top = placed.agg(F.max("level")).first()[0]
    late = levels_of(stuck, flow).select("node", (F.col("level") + F.lit(0 if top is None else top + 1)).alias("level"))
    return placed.unionByName(late), flow

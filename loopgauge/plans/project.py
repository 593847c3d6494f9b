"""A whole analysis: files, blocks, edges, results, and what they are joined to."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..operators import classify, graph, scoring
from ..operators.blocks import by_key, is_analyzable, node_id
from ..sources import files as sources
from ..sources.python_blocks import extract
from ..sources.store import Store, result_keys


#: What keys of cached results depend on besides the block: a change of the rules makes all of them anew.
VERSIONS = [classify.RULES_VERSION, "analysis-1", "prompt-1"]


@dataclass
class Analysis:
    blocks: DataFrame
    edges: DataFrame
    results: DataFrame
    computed: int | None = None  # blocks whose result was not taken from a store, where results flow along a graph
    scored: int = 0  # blocks that went to an estimator

    def graph(self) -> DataFrame:
        """All edges: calls, containment and imports."""
        return graph.structure(self.blocks, self.edges)

    def save(self, store: Store, files: DataFrame, run_id: str) -> None:
        """Files, blocks, features and the whole graph."""
        store.save_index(files, self.blocks, run_id)
        store.save_edges(self.graph())

    def joined(self) -> DataFrame:
        """Blocks with their results, the input of operators.report."""
        return self.blocks.withColumn("node", node_id()).join(by_key(self.results), "node", "left")


def analyse_files(
    files: DataFrame, with_graph: bool = True, estimator: scoring.Estimator | None = None, budget: int = scoring.MAX_BLOCKS, rescore: bool = False, store: Store | None = None, model: str = "",
) -> Analysis:
    """Analyses files (file_path, language, content).

    rescore: uncertain blocks get a conservative class that their callers see; the first `budget` of them in processing order go to the estimator,
    if there is one, once all others are done. store: results of unchanged blocks come from there, those of this run go there, and
    those of blocks that are gone leave it.
    """
    blocks = graph.cut(extract(files))
    edges = graph.cut(graph.resolve(blocks))
    if not with_graph:
        return Analysis(blocks, edges, classify.analyse(blocks, None, rescore))
    found = classify.Graph.of(blocks, edges)
    keys = graph.cut(result_keys(found.facts, found.calls, [*VERSIONS, f"fallback={rescore}"], model)) if store is not None else None
    ready = rescore and estimator is not None and estimator.is_available()
    run = classify.Run(found, rescore, budget if ready else 0, store.stored_results(keys) if store is not None else None)
    results = run.results()
    if results is None:
        return Analysis(blocks, edges, classify.skipped(blocks), 0)
    if run.sent:
        sent = found.facts.filter(F.col("node").isin(run.sent))
        better = graph.cut(scoring.score(sent.join(by_key(results.drop("analyzer_kind")), "node"), estimator, len(run.sent)))
        results = results.join(by_key(better.select("node")), "node", "left_anti").unionByName(better.join(by_key(results.select("node", "rule", "flags")), "node"), allowMissingColumns=True)
    results = graph.cut(results)
    if store is not None:
        kept = results.join(by_key(keys), "node").withColumn("created_at", F.unix_micros(F.current_timestamp()) / 1e6)
        store.save_results(kept)
        gone = store.read("results").join(by_key(blocks.filter(is_analyzable()).select(node_id().alias("node"))), "node", "left_anti").select("node")
        if not gone.isEmpty():
            store.delete("results", gone, "node")
    return Analysis(blocks, edges, results.unionByName(classify.skipped(blocks)), run.computed, len(run.sent))


def analyse_tree(spark: SparkSession, root: str, **options) -> Analysis:
    return analyse_files(sources.scan(spark, root), **options)


def overlapping(selection: DataFrame, taken: DataFrame) -> DataFrame:
    """Selections (file_path, start_line, end_line) that overlap a taken range of the same file.

    A sweep through each file: among the taken ranges that begin no later than a selection ends, the furthest end decides. Ranges are sorted, not paired.
    """
    kept = F.struct(*selection.columns)
    marks = selection.filter("start_line IS NOT NULL AND end_line IS NOT NULL").select("file_path", F.col("end_line").alias("at"), F.lit(1).alias("kind"), F.lit(None).cast("long").alias("reach"), kept.alias("row"))
    ranges = taken.filter("start_line IS NOT NULL AND end_line IS NOT NULL").select("file_path", F.col("start_line").alias("at"), F.lit(0).alias("kind"), F.col("end_line").cast("long").alias("reach"))
    sweep = W.partitionBy("file_path").orderBy("at", "kind").rowsBetween(W.unboundedPreceding, W.currentRow)
    swept = marks.unionByName(ranges, allowMissingColumns=True).withColumn("furthest", F.max("reach").over(sweep))
    return swept.filter((F.col("kind") == 1) & (F.col("furthest") >= F.col("row.start_line"))).select("row.*")


def live_only(cached: DataFrame, blocks: DataFrame) -> DataFrame:
    """Cached rows whose block still exists."""
    return cached.join(blocks.filter(is_analyzable()).select(node_id().alias("node")).distinct(), "node", "left_semi")

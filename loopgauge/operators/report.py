"""Counts, verdict, hotspots, overlay rows, recommendations and review texts of analysed blocks.

Input `done` is blocks joined with results: the block columns plus complexity, confidence, needs_review and analyzer_kind.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lattice, text
from .blocks import display_name, is_analyzable, is_overlayable, node_id


def _classes(spark, *more: str) -> DataFrame:
    return spark.createDataFrame([(i, c) for i, c in enumerate((*lattice.CLASSES, *more))], "position int, complexity string")


def histogram(done: DataFrame, with_unknown: bool = False) -> DataFrame:
    """(position, complexity, n): every class, also those without a block; null counts as unknown, other labels do not count."""
    spark = done.sparkSession
    counts = done.filter(is_analyzable()).groupBy(F.coalesce("complexity", F.lit("unknown")).alias("complexity")).agg(F.count("*").alias("n"))
    names = _classes(spark, *(["unknown"] if with_unknown else []))
    return F.broadcast(names).join(counts, "complexity", "left").select("position", "complexity", F.coalesce("n", F.lit(0)).alias("n"))


def chart_heights(counts: DataFrame, height: int = 100) -> DataFrame:
    """Bar heights of a histogram: whole numbers against its maximum."""
    top = F.greatest(F.max("n").over(W.partitionBy()), F.lit(1))  # a row for each class
    return counts.select("position", "complexity", "n", top.alias("top")).select("position", "complexity", "n", F.expr(f"n * {height} div top").alias("height"))


def source_kind(kind: Column) -> Column:
    return F.when(kind.isin("llm", "llm_error"), "llm").when(kind == "cache", "cache").otherwise("static")


def source_kind_counts(done: DataFrame) -> DataFrame:
    return done.filter(is_analyzable()).groupBy(source_kind(F.coalesce("analyzer_kind", F.lit("static"))).alias("source_kind")).agg(F.count("*").alias("n"))


def unknown_count(done: DataFrame) -> DataFrame:
    return done.filter(is_analyzable()).agg(F.count_if(F.coalesce("complexity", F.lit("unknown")) == "unknown").alias("n"))


def by_file(done: DataFrame) -> DataFrame:
    return done.filter(is_analyzable()).groupBy("file_path", "complexity").agg(F.count("*").alias("n"))


def by_class(done: DataFrame) -> DataFrame:
    """Counts by the enclosing class: its qualified name, else the name before the last dot, else <top-level>."""
    parents = done.select(F.col("stable_id").alias("parent_id"), display_name().alias("parent_name"))
    prefix = F.when(F.contains("qualified_name", F.lit(".")), F.regexp_replace("qualified_name", r"\.[^.]*$", ""))
    grouped = done.filter(is_analyzable()).join(parents, "parent_id", "left").withColumn("group", F.coalesce("parent_name", prefix, F.when(F.col("parent_id").isNotNull(), "<?>"), F.lit("<top-level>")))
    return grouped.groupBy("group", "complexity").agg(F.count("*").alias("n"))


def edge_counts(edges: DataFrame) -> DataFrame:
    calls = edges.filter("edge_type = 'CALLS'")
    return calls.agg(F.count_if("resolved").alias("resolved"), F.count_if(~F.col("resolved")).alias("unresolved"))


def verdict(total: Column, heavy: Column, light: Column) -> Column:
    """empty, moderate, mostly_good, mixed or heavy."""
    return (
        F.when(total == 0, "empty").when(heavy == 0, "moderate").when(heavy <= F.greatest(F.lit(1), F.floor(total / 5)), "mostly_good")
        .when(light >= heavy, "mixed").otherwise("heavy")
    )


def project_verdict(done: DataFrame) -> DataFrame:
    c = F.col("complexity")
    return done.filter(is_analyzable()).agg(F.count("*").alias("total"), F.count_if(c.isin(*lattice.HEAVY)).alias("heavy"), F.count_if(c.isin(*lattice.LINEAR_OR_BETTER)).alias("light")).withColumn("verdict", verdict(F.col("total"), F.col("heavy"), F.col("light")))


def hotspots(done: DataFrame, limit: int = 10) -> DataFrame:
    return done.filter(F.col("complexity").isin(*lattice.HEAVY_REVIEW)).select("file_path", "start_line", "end_line", display_name().alias("name"), "complexity").orderBy("file_path", "start_line").limit(limit)


def recommended_blocks(done: DataFrame, limit: int = 5) -> DataFrame:
    """The worst blocks: by class, then unknown ones, nesting and calls, all falling; ties in source order."""
    c = F.col
    picked = done.filter(is_analyzable() & (c("complexity").isin(*lattice.HEAVY) | _is_unknown() | (c("max_loop_depth") >= 2)))
    return picked.orderBy(*_order()).limit(limit)


def _is_unknown() -> Column:
    return F.coalesce("complexity", F.lit("unknown")) == "unknown"


def _order() -> list[Column]:
    return [lattice.rank("complexity").desc(), _is_unknown().desc(), F.col("max_loop_depth").desc(), F.size("calls").desc(), F.col("file_path").asc(), F.col("ordinal").asc()]


def _worst_first():
    return W.partitionBy().orderBy(*_order())  # over recommended_blocks only


def overlay(done: DataFrame) -> DataFrame:
    """Rows for an editor overlay: colour, label, hover and lines of each overlayable block."""
    kind = source_kind(F.coalesce("analyzer_kind", F.lit("static")))
    shown = F.when(F.coalesce("complexity", F.lit("unknown")) == "unknown", F.lit("unknown")).otherwise(F.col("complexity"))
    label = F.when(kind == "llm", F.concat(shown, F.lit(" · AI"))).otherwise(shown)
    hover = F.concat_ws(" — ", shown, F.when(kind == "llm", "estimated by a model").when(kind == "cache", "from the cache"), F.col("rule"))
    return done.filter(is_overlayable()).select(
        node_id().alias("blockId"), F.col("file_path").alias("filePath"), F.col("start_line").alias("startLine"), F.col("end_line").alias("endLine"), F.col("complexity"),
        lattice.colour("complexity").alias("color"), label.alias("label"), hover.alias("hover"), kind.alias("sourceKind"), F.col("confidence"))


def visible_zones(rows: DataFrame, line_count: Column) -> DataFrame:
    """Overlay rows with lines inside the document, one for each file and start line (the first)."""
    clamp = lambda c: F.greatest(F.lit(1), F.least(F.col(c), line_count))
    w = W.partitionBy("filePath", "startLine").orderBy("endLine", "blockId")
    return rows.withColumns({"startLine": clamp("startLine"), "endLine": clamp("endLine")}).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def review_text(done: DataFrame, edges: DataFrame | None = None) -> DataFrame:
    """(node, text): a few lines on each block; lines without a value are left out."""
    calls = F.array_join(F.slice("calls", 1, 8), ", ")
    more = F.when(F.size("calls") > 8, F.concat(F.lit(" +"), (F.size("calls") - 8).cast("string"))).otherwise("")
    return done.filter(is_analyzable()).select(node_id().alias("node"), F.concat_ws(
        "\n", display_name(), F.concat(F.lit("file: "), "file_path", F.lit(":"), F.col("start_line").cast("string")), F.concat(F.lit("class: "), "complexity"),
        F.concat(F.lit("confidence: "), "confidence"), F.when(F.col("max_loop_depth") > 0, F.concat(F.lit("loops: "), F.col("loop_count").cast("string"), F.lit(", depth "), F.col("max_loop_depth").cast("string"))),
        F.when(F.size("calls") > 0, F.concat(F.lit("calls: "), calls, more)), F.when(F.size("flags") > 0, F.concat(F.lit("flags: "), F.array_join("flags", ", "))),
    ).alias("text"))


def project_review(done: DataFrame) -> DataFrame:
    """One row (text): the verdict, the histogram and the hotspots."""
    head = project_verdict(done).select(F.lit(0).alias("part"), F.lit("").alias("key"), F.concat(F.lit("verdict: "), "verdict").alias("line"))
    counts = histogram(done).filter("n > 0").select(F.lit(1), F.format_string("%02d", "position"), F.format_string("%s: %d", "complexity", "n"))
    spots = hotspots(done, 20).select(F.lit(2), F.format_string("%s:%09d", "file_path", "start_line"), F.format_string("%s:%d %s %s", "file_path", "start_line", "name", "complexity"))
    lines = head.union(counts).union(spots).agg(F.array_sort(F.collect_list(F.struct("part", "key", "line"))).alias("lines"))  # 30 rows at most
    return lines.select(F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("text"))


def fallback_texts(done: DataFrame, limit: int = 5) -> DataFrame:
    """(node, seq, text) for recommended_blocks without a model: a sentence for each block from its class, loops and calls."""
    what = (
        F.when(F.col("complexity").isin(*lattice.HEAVY), F.concat(F.lit("cut the work of "), F.col("complexity"), F.lit(" with an index or a cheaper structure")))
        .when(F.coalesce("complexity", F.lit("unknown")) == "unknown", F.lit("make its calls and loop bounds explicit"))
        .otherwise(F.concat(F.lit("flatten its "), F.col("max_loop_depth").cast("string"), F.lit(" nested loops")))
    )
    picked = recommended_blocks(done, limit).select(node_id().alias("node"), F.row_number().over(_worst_first()).alias("seq"), display_name().alias("name"), "file_path", "start_line", what.alias("what"))
    return picked.select("node", "seq", F.format_string("%s (%s:%d): %s.", "name", "file_path", "start_line", "what").alias("text"))


def replies_to_blocks(replies: DataFrame, blocks: DataFrame) -> DataFrame:
    """(position, node, text): replies (position, block_id, name, text) beside blocks (node, name, position): by id, else by name, else by place."""
    by_id = blocks.select(F.col("node").alias("block_id"), F.col("node").alias("by_id"))
    by_name = blocks.groupBy("name").agg(F.min_by("node", "position").alias("by_name"))
    by_place = blocks.select("position", F.col("node").alias("by_place"))
    found = replies.join(by_id, "block_id", "left").join(by_name, "name", "left").join(by_place, "position", "left")
    return found.select("position", F.coalesce("by_id", "by_name", "by_place").alias("node"), "text").filter("node IS NOT NULL")


def recommendations(texts: DataFrame, limit: int = 5) -> DataFrame:
    """The first `limit` recommendations (seq, text) that are not similar to an earlier kept one.

    Texts of equal keys are one before they are folded in one row, in order of seq; an estimator makes them for recommended_blocks, so they are few.
    """
    clean = texts.withColumn("text", text.sanitised(F.col("text"))).filter("text <> ''").withColumn("key", text.similarity_key(F.col("text")))
    rows = clean.groupBy("key").agg(F.min_by("text", "seq").alias("text"), F.min("seq").alias("seq")).agg(F.array_sort(F.collect_list(F.struct("seq", "text", "key"))).alias("rows"))
    empty = F.filter("rows", lambda x: F.lit(False))
    kept = F.aggregate("rows", empty, lambda acc, x: F.when((F.size(acc) < limit) & ~F.exists(acc, lambda y: text.similar(x["key"], y["key"])), F.array_append(acc, x)).otherwise(acc))
    return rows.select(F.explode(kept).alias("r")).select("r.seq", "r.text")

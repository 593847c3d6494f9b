"""Which blocks are analysed, and their identity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import lattice

#: Kinds that are never analysed, kinds that are, and parser kinds that older tables carry.
NEVER = ("class", "container", "module", "namespace", "file", "interface")
ALWAYS = ("function", "method", "lambda", "constructor", "selection", "top_level_executable")
LEGACY = ("function_definition", "function_declaration", "method_definition", "method_declaration", "function_item", "constructor_declaration", "lambda_expression")


def by_key(df: DataFrame) -> DataFrame:
    """A side of a join that shuffles by its keys. An analysis has many joins over its own tables, and each that broadcast one would send it through the driver."""
    return df.hint("merge")


def is_analyzable() -> Column:
    return F.coalesce(~F.col("is_container"), F.lit(True)) & ~F.col("kind").isin(*NEVER) & F.col("kind").isin(*ALWAYS, *LEGACY)


def is_overlayable() -> Column:
    return is_analyzable() & F.coalesce(F.col("complexity").isin(*lattice.CLASSES, "unknown"), F.lit(False))


def node_id() -> Column:
    return F.coalesce(F.nullif(F.col("stable_id"), F.lit("")), F.col("block_id"))


def display_name() -> Column:
    return F.coalesce(F.nullif(F.col("qualified_name"), F.lit("")), F.nullif(F.col("name"), F.lit("")), F.col("kind"))


def distinct_blocks(blocks: DataFrame) -> DataFrame:
    """The first block of each id in source order."""
    w = W.partitionBy("node").orderBy("file_path", "ordinal")
    return blocks.withColumn("node", node_id()).withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def caller_rows(blocks: DataFrame) -> DataFrame:
    """(name, caller): the blocks that call each name, a row for each."""
    return blocks.select(F.col("block_id").alias("caller"), F.explode(F.array_distinct("calls")).alias("name")).distinct()


def callers(blocks: DataFrame) -> DataFrame:
    """(block_id, name, n_callers, first_caller) of blocks whose name another block calls: the callers of a name are counted once for all blocks that bear it."""
    rows = caller_rows(blocks)
    first = rows.groupBy("name").agg(F.count("*").alias("n"), F.min("caller").alias("first"))
    second = rows.join(by_key(first), "name").filter("caller <> first").groupBy("name").agg(F.min("caller").alias("second"))
    own = blocks.select("block_id", "name", F.array_contains("calls", F.col("name")).alias("calls_itself"))
    each = own.join(by_key(first), "name").join(by_key(second), "name", "left").withColumn("itself", F.coalesce("calls_itself", F.lit(False)).cast("long"))
    found = each.select("block_id", "name", (F.col("n") - F.col("itself")).alias("n_callers"), F.when((F.col("itself") == 1) & (F.col("first") == F.col("block_id")), F.col("second")).otherwise(F.col("first")).alias("first_caller"))
    return found.filter("n_callers > 0")


def called_by(blocks: DataFrame, chosen: DataFrame) -> DataFrame:
    """(block_id, called_by): sorted ids of other blocks that call the name of each chosen block (block_id). The lists are as long as a name has callers: choose the blocks first."""
    wanted = blocks.join(by_key(chosen.select("block_id").distinct()), "block_id", "left_semi").select("block_id", "name")
    return wanted.join(by_key(caller_rows(blocks)), "name").filter("caller <> block_id").groupBy("block_id").agg(F.array_sort(F.collect_set("caller")).alias("called_by"))

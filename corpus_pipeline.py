"""From raw documents to a training mixture: five stages, each written as Parquet and read again.

Language ID drops what has no language, line dedup cuts repeated runs of lines, SimHash keeps one of each group
of near copies, decontamination drops documents that hold benchmark passages, and mixing gives the rest their places.

Every stage keeps rows with null ids or texts unless its rule names them; see the operators' docstrings for empty tables, ties and
repeated rows. Documents are told apart by id and text: rows that repeat both stay or go together, while of rows that repeat an id alone
each is judged by its text. Other columns pass unchanged, whatever their names; n_chars is renewed where there is one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loopgauge.llm import common, decontaminate, langid, linedup, mixing, simhash

#: A text is no language if its cosine with every one is below LEAST, less DEVIATIONS of a cosine of that many characters: short texts vary more.
LEAST, DEVIATIONS = 0.1, 3.0


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a letter, and those that resemble no language by more than their length explains."""
    rest = F.struct(*[c for c in docs.columns if c != "text"])  # so that no column's name can clash with the result's
    found = langid.identified(docs.select("doc_id", "text", "lang", rest.alias("row")))
    least = LEAST - DEVIATIONS / F.sqrt(F.greatest(F.length("text"), F.lit(1)))  # at 900 characters 0, at 10,000 0.07
    rejected = (F.col("lang_pred") == langid.UNKNOWN) | (F.col("score") < least)
    return found.filter(~F.coalesce(rejected, F.lit(False))).select(*["text" if c == "text" else f"row.{c}" for c in docs.columns])


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts repeated runs of two or more lines; documents of which nothing stays are copies and go."""
    found = linedup.deduplicated(docs.select("doc_id", "text", F.struct(*[F.col(c) for c in docs.columns if c != "text"]).alias("row")))
    kept = found.filter((F.col("n_removed") == 0) | (F.trim("text") != ""))
    renewed = lambda c: F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col(f"row.{c}")).cast(docs.schema[c].dataType).alias(c)
    return kept.select(*["text" if c == "text" else renewed(c) if c == "n_chars" else f"row.{c}" for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group of near copies."""
    found = simhash.near_copies(docs)
    gone = found.filter("NOT first").select(F.col("doc_id").alias("gone_id"), "k").distinct()
    here = docs.select(F.struct("*").alias("row"))
    same = (simhash.row_key("row.doc_id", "row.text") == F.col("k")) & F.col("row.doc_id").eqNullSafe(F.col("gone_id"))
    return here.join(gone, same, "left_anti").select("row.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark passage was found."""
    keyed = docs.select(F.struct("*").alias("row"), F.xxhash64("doc_id", "text").alias("doc_id"), "text")
    found = decontaminate.contaminated(keyed.select("doc_id", "text"), common.table(spark, sf_dir, "benchmark"))
    return keyed.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select("row.*")


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Adds source_block, slot and place: the documents' order in the mixture."""
    return mixing.mixed(docs)


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("simhash_near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mixing", source_mixing),
]

#: SQL can express neither language profiles nor fingerprints; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents; the last one's rows."""
    docs, before = common.table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        path = f"{common.shared_dir(spark)}/pipeline-{name}-{uuid.uuid4().hex}"
        with common.recorded() as stored:
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        common.clean(spark, [*before, *stored])  # the last stage's rows, and what this one stored on its way
        before = [path]
    return docs

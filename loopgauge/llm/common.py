"""Shared helpers: reading, shared storage, folds, and connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a local one only where that is unset and all tasks run on this machine (tests)."""
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or _fallback.get(spark.sparkContext.applicationId)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = _fallback[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="shared-")
    return path.rstrip("/")


_fallback: dict[str, str] = {}


_stored: ContextVar[list[str]] = ContextVar("stored", default=[])


@contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that stored() writes in this context, and in no other thread's."""
    paths: list[str] = []
    token = _stored.set(paths)
    try:
        yield paths
    finally:
        _stored.reset(token)


def stored(df: DataFrame, tag: str) -> DataFrame:
    """Writes df to the shared folder and reads it again: cuts the lineage and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}"
    _stored.get().append(path)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def dropped(*frames: DataFrame) -> None:
    """Deletes tables that stored() wrote and nothing reads any more."""
    for df in frames:
        for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
            remove_path(df.sparkSession, f)


def schema_with(df: DataFrame, names: list[str], **more: str) -> str:
    """DDL of df's columns `names` and of further ones."""
    have = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in names]
    return ", ".join([*have, *(f"`{k}` {v}" for k, v in more.items())])


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 4; null for a null id."""
    return F.crc32(doc_id.cast("string")) % 4


def held_out(doc_id: Column) -> Column:
    return F.coalesce(fold(doc_id) == 2, F.lit(False))


def clean(spark: SparkSession, paths: list[str]) -> None:
    """Deletes stored tables. Call it once the results that read them are written."""
    for path in paths:
        remove_path(spark, path)


#: A key is hot from this share of all rows on: one in HOT, so fewer than HOT keys are.
HOT = 1000


def join_repeated(rows: DataFrame, repeated: DataFrame, key: str | list[str]) -> DataFrame:
    """rows joined with repeated (a row for each key, its number of rows in column times); repeated is a stored table, and rows one or a few columns made of one.

    Hot keys, fewer than HOT by definition, come by broadcast, so their rows stay where they are; the others are dealt by key, and
    none of them fills a task.
    """
    hot = F.col("times") * HOT > rows.count()
    few = F.broadcast(repeated.filter(hot))
    return rows.join(few, key).unionByName(rows.join(few.select(key), key, "left_anti").join(repeated.filter(~hot), key))


def salts(times: Column, total: int) -> Column:
    """Tasks that the rows of a key are dealt to: one, and one more for each HOT-th of all rows."""
    return (F.floor(times * HOT / F.lit(max(1, total))) + 1).cast("int")


def by_bytes(items: list, sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """Ranges [i, j) of items whose sizes sum to at most `most`; a larger item stands alone."""
    i, total = 0, 0
    for j, n in enumerate(sizes):
        if j > i and total + n > most:
            yield i, j
            i, total = j, 0
        total += n
    if i < len(items):
        yield i, len(items)


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component), component the smallest node.

    Min-hooking with pointer jumping. Each round takes the minimum over a node's neighbours, aggregated before it is joined, and
    two joins that may meet hot keys: a node with very many edges, and a label that very many nodes carry. Both go through
    join_repeated(), so the rows of neither meet in a task. Each round's labels are written to the shared folder.
    """
    both = stored(
        edges.filter("a IS NOT NULL AND b IS NOT NULL AND a <> b").select("a", "b").union(edges.filter("a <> b").select("b", "a")).distinct(),
        "edges",
    )
    degrees = stored(both.groupBy(F.col("a").alias("b")).agg(F.count("*").alias("times"), F.min("b").alias("least")), "degrees")
    labels = stored(degrees.select(F.col("b").alias("node"), F.least("b", "least").alias("label")), "labels")
    while True:
        near = stored(degrees.select("b", "times").join(labels.withColumnRenamed("node", "b"), "b"), "degree-labels")
        offer = join_repeated(both, near, "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("offer"))
        lower = labels.join(offer, "node").filter("offer < label")
        offers = lower.select(F.explode(F.array("node", "label")).alias("node"), "offer").groupBy("node").agg(F.min("offer").alias("offer"))
        hooked = stored(labels.join(offers, "node", "left").select("node", F.col("label").alias("was"), F.least("label", "offer").alias("label")), "hooked")
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        ups = stored(hooked.groupBy("label").agg(F.count("*").alias("times")).join(up, "label"), "label-ups")
        seen_moves = Observation()
        jumped = join_repeated(hooked, ups, "label").select("node", F.col("up").alias("label"), "was")
        new = stored(jumped.observe(seen_moves, F.count_if(F.col("label") != F.col("was")).alias("moved")).select("node", "label"), "labels")
        dropped(labels, near, hooked, ups)
        labels = new
        if not seen_moves.get.get("moved"):
            dropped(both, degrees)
            return labels.select("node", F.col("label").alias("component"))

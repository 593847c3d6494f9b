"""Tables of an analysis on disk as Parquet: keep-latest upserts, replacement, deletion, runs and the result cache.

A write goes to a folder of its own and counts once its commit is in the table's log, so a lost executor never leaves a half-written table.
"""

from __future__ import annotations

import json
import os
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.blocks import by_key

#: Fixed value: version of JSON caches that are read.
CACHE_VERSION = 2
NO_RESULTS = "node string, cache_key string, complexity string, confidence string, needs_review boolean, rule string, flags array<string>, analyzer_kind string"


def keep_latest(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """One row for each key: the largest by `order`, then by its other columns in turn; a maximum that is taken before the shuffle, not a sort."""
    rest = [c for c in rows.columns if c not in keys and c not in order]
    return rows.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("latest")).select(*[c if c in keys else f"latest.`{c}`" for c in rows.columns])


def without(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """The rows whose key is not among ids."""
    return rows.join(ids.select(key), key, "left_anti")


class Conflict(RuntimeError):
    """Another writer has committed first."""


class Store:
    """Tables in a folder. Each is a log of numbered commits: replacements, upserts and deletions, each with a folder of its own rows.

    A write costs what it brings: an upsert adds its rows and a deletion its ids, and reading merges them, newest first. After MERGE such commits
    a table is written anew. A commit is a small file that is created only if its number is free, so of two writers each gets a number and neither is lost.
    """

    #: Commits that reading merges at most, before a writer puts one table in their place.
    MERGE = 16

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _fs(self, path: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self, name: str) -> bool:
        fs, path = self._fs(f"{self.root}/{name}/log")
        return fs.exists(path)

    def _log(self, name: str) -> list[tuple[int, dict]]:
        """Commits from the last replacement on."""
        if not self.exists(name):
            return []
        rows = self.spark.read.text(f"{self.root}/{name}/log", wholetext=True).select("_metadata.file_name", "value").collect()
        log = sorted((int(r.file_name), json.loads(r.value)) for r in rows)
        last = max((i for i, (_, c) in enumerate(log) if c["kind"] == "replace"), default=0)
        return log[last:]

    def _commit(self, name: str, number: int, commit: dict) -> None:
        """Creates the commit's file, or raises Conflict where the number is taken."""
        fs, path = self._fs(f"{self.root}/{name}/log/{number:012d}")
        data = json.dumps(commit)
        fs.mkdirs(path.getParent())
        if fs.getScheme() == "file":  # Hadoop's own local files know no exclusive creation
            target = path.toUri().getPath()
            beside = f"{os.path.dirname(os.path.dirname(target))}/.{uuid.uuid4().hex}"
            with open(beside, "w") as f:
                f.write(data)
            try:
                os.link(beside, target)
            except FileExistsError as e:
                raise Conflict(f"{name}: commit {number} is taken") from e
            finally:
                os.remove(beside)
            return
        try:
            out = fs.create(path, False)
        except Py4JJavaError as e:
            if not fs.exists(path):
                raise
            raise Conflict(f"{name}: commit {number} is taken") from e
        out.write(bytearray(data.encode()))
        out.close()

    def _add(self, name: str, rows: DataFrame, **commit) -> int:
        """Writes rows and commits them under the next free number."""
        folder = f"d-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{name}/{folder}")
        while True:
            log = self._log(name)
            number = log[-1][0] + 1 if log else 1
            try:
                self._commit(name, number, {**commit, "folder": folder})
                return number
            except Conflict:
                continue

    def _rows(self, name: str, commit: dict) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}/{commit['folder']}")

    def read(self, name: str) -> DataFrame | None:
        return self._merged(name, self._log(name))

    def _merged(self, name: str, log: list[tuple[int, dict]]) -> DataFrame | None:
        state, fresh = None, []  # fresh: upserts of the same keys that no deletion parts

        def merged() -> DataFrame:
            if not fresh:
                return state
            keys = fresh[0][1]["keys"]
            parts = ([state.withColumn("_at", F.lit(0).cast("long"))] if state is not None else []) + [self._rows(name, c).withColumn("_at", F.lit(n).cast("long")) for n, c in fresh]
            whole = parts[0]
            for p in parts[1:]:
                whole = whole.unionByName(p, allowMissingColumns=True)
            columns = [c for c in whole.columns if c != "_at"]
            return whole.groupBy(*keys).agg(F.max_by(F.struct(*columns), "_at").alias("_row")).select("_row.*")

        for n, c in log:
            if fresh and (c["kind"] != "upsert" or c["keys"] != fresh[0][1]["keys"]):
                state, fresh = merged(), []
            if c["kind"] == "replace":
                state = self._rows(name, c)
            elif c["kind"] == "upsert":
                fresh.append((n, c))
            elif state is not None:
                state = state.limit(0) if c["everything"] else without(state, self._rows(name, c), c["key"])
        return merged()

    def replace(self, name: str, rows: DataFrame) -> None:
        self._add(name, rows, kind="replace")

    def upsert(self, name: str, rows: DataFrame, keys: list[str]) -> None:
        """New rows win over stored ones of the same key; of equal new keys one stays."""
        self._add(name, rows.dropDuplicates(keys), kind="upsert", keys=keys)
        self.compact(name)

    def delete(self, name: str, ids: DataFrame | None, key: str) -> None:
        """Deletes the rows with these ids; without ids, or with none, all rows."""
        if self.exists(name):
            everything = ids is None or ids.limit(1).count() == 0
            rows = self.spark.createDataFrame([], "none int") if everything else ids.select(key).distinct()
            self._add(name, rows, kind="delete", key=key, everything=everything)
            self.compact(name)

    def compact(self, name: str, least: int | None = None) -> None:
        """Puts one table in the place of the commits, if there are more than `least`; a commit that comes in between wins."""
        log = self._log(name)
        if len(log) <= (self.MERGE if least is None else least):
            return
        folder = f"d-{uuid.uuid4().hex}"
        self._merged(name, log).write.parquet(f"{self.root}/{name}/{folder}")
        try:
            self._commit(name, log[-1][0] + 1, {"kind": "replace", "folder": folder})
        except Conflict:
            fs, path = self._fs(f"{self.root}/{name}/{folder}")
            fs.delete(path, True)

    def delete_files(self, paths: DataFrame) -> None:
        """Deletes files (file_path) and all that hangs on them: blocks, their features and edges, then results and reviews of blocks that are gone."""
        blocks = self.read("blocks")
        gone = blocks.join(by_key(paths.select("file_path")), "file_path", "left_semi").select("stable_id") if blocks is not None else None
        if gone is not None and gone.limit(1).count():
            self.replace("deleted", gone.distinct())  # the ids outlive the tables they came from
            ids = self.read("deleted")
            for name, key in (("block_features", "stable_id"), ("edges", "source"), ("edges", "target"), ("results", "node"), ("reviews", "node"), ("blocks", "stable_id")):
                if self.exists(name):
                    self.delete(name, ids.withColumnRenamed("stable_id", key), key)
        if self.exists("files"):
            self.delete("files", paths, "file_path")

    def save_edges(self, edges: DataFrame) -> None:
        """The whole graph in place of the stored one."""
        self.replace("edges", edges)

    def save_index(self, files: DataFrame, blocks: DataFrame, run_id: str) -> None:
        """Files, blocks without their text, and features apart."""
        wrong = blocks.groupBy("file_path").agg(F.max("error_state").alias("has_error"))
        facts = files.withColumns({"size": F.octet_length("content").cast("long"), "content_hash": F.sha1("content")})
        self.upsert("files", facts.drop("content").join(by_key(wrong), "file_path", "left").withColumns({"has_error": F.coalesce("has_error", F.lit(False)), "run_id": F.lit(run_id)}), ["file_path"])
        inside = blocks.join(by_key(files.select("file_path").distinct()), "file_path", "left_semi")
        facts = ["parameters", "calls", "loop_count", "max_loop_depth", "loops", "call_sites", "branches", "container_operations", "imports", "defined_symbols", "local_symbols"]
        self.upsert("blocks", inside.drop("source", *facts).withColumn("run_id", F.lit(run_id)), ["stable_id"])
        self.upsert("block_features", inside.select("stable_id", *facts), ["stable_id"])

    def begin_run(self, run_id: str, at: float) -> None:
        self.finish_run(run_id, "running", at)

    def finish_run(self, run_id: str, status: str, at: float) -> None:
        self.upsert("runs", self.spark.createDataFrame([(run_id, status, at)], "run_id string, status string, at double"), ["run_id"])

    def save_results(self, results: DataFrame) -> None:
        self.upsert("results", results, ["node", "cache_key"])

    def save_reviews(self, reviews: DataFrame) -> None:
        self.upsert("reviews", reviews, ["node", "payload_hash", "prompt_version"])

    def stored_results(self, wanted: DataFrame) -> DataFrame:
        """The last run's result of each node of wanted (node, cache_key), whatever its key; usable: its key is the wanted one, and it is neither unknown nor failed."""
        kept = self.read("results")
        if kept is None:
            kept = self.spark.createDataFrame([], f"{NO_RESULTS}, created_at double")
        last = keep_latest(kept, ["node"], "created_at").withColumnRenamed("cache_key", "last_key")
        usable = (F.col("last_key") == F.col("cache_key")) & F.col("complexity").isNotNull() & (F.col("complexity") != "unknown") & (F.col("analyzer_kind") != "llm_error")
        return wanted.select("node", "cache_key").join(by_key(last), "node").withColumn("usable", F.coalesce(usable, F.lit(False)))


    def cached(self, wanted: DataFrame) -> DataFrame:
        """Stored results for wanted (node, cache_key): the latest of each, without unknown and failed ones."""
        kept = self.read("results")
        if kept is None:
            return wanted.limit(0)
        usable = kept.filter("complexity IS NOT NULL AND complexity <> 'unknown' AND analyzer_kind <> 'llm_error'")
        return wanted.join(by_key(keep_latest(usable, ["node", "cache_key"], "created_at")), ["node", "cache_key"])


def dependency_hash(edges: DataFrame) -> DataFrame:
    """(node, dependency_hash): sha1 of the sorted targets and names of a block's calls, repeats included."""
    part = F.concat_ws("|", F.coalesce("target", F.lit("")), "call_name", F.col("resolved").cast("string"))
    return edges.filter("edge_type = 'CALLS'").groupBy(F.col("source").alias("node")).agg(F.sha1(F.array_join(F.array_sort(F.collect_list(part)), "|")).alias("dependency_hash"))


def cache_key(blocks: DataFrame, versions: list[str], model: str = "") -> DataFrame:
    """blocks with cache_key: language, kind, name, normalised text, dependencies, versions and model decide."""
    parts = blocks.select("*", F.struct("language", "kind", "qualified_name", text.normalised_hash(F.col("source")).alias("text"), F.coalesce("dependency_hash", F.lit("")).alias("deps"), F.lit("|".join(versions)).alias("versions"), F.lit(model).alias("model")).alias("_key"))
    return parts.withColumn("cache_key", F.sha1(text.canonical(F.col("_key"), parts.schema["_key"].dataType))).drop("_key")


def json_cache_key(blocks: DataFrame) -> DataFrame:
    """blocks with json_key, their key in a JSON cache: place, kind, name and text."""
    parts = blocks.select("*", F.struct("file_path", "start_line", "end_line", "kind", "name", "source_hash").alias("_key"))
    return parts.withColumn("json_key", F.sha1(text.canonical(F.col("_key"), parts.schema["_key"].dataType))).drop("_key")


#: Of a block's facts, those that come from outside its text or tell where it stands.
_OUTSIDE = ("start_line", "base_flags", "edge_names", "unresolved", "loop_edges", "unresolved_count", "on_cycle")


def result_keys(facts: DataFrame, calls: DataFrame, versions: list[str], model: str = "") -> DataFrame:
    """(node, dependency_hash, cache_key) of blocks, given their facts and the calls that results flow along.

    The key covers all that decides a block's result but the classes of the blocks it calls: whether one of those has changed is for the run to tell.
    """
    kind = calls.select("call_name", "target", "site", "start_line", "end_line").schema
    one = text.canonical(F.struct(*kind.names), kind)
    deps = calls.groupBy(F.col("source").alias("node")).agg(F.array_sort(F.collect_list(one)).alias("deps"))
    all_ = facts.join(by_key(deps), "node", "left").withColumn("_seen", F.struct(*[(F.array_sort(c) if t.startswith("array") else F.col(c)).alias(c) for c, t in facts.select(*_OUTSIDE).dtypes]))
    outside = text.canonical(F.col("_seen"), all_.schema["_seen"].dataType)
    all_ = all_.withColumn("dependency_hash", F.sha1(F.concat_ws("|", outside, F.array_join(F.coalesce("deps", F.array()), "|"))))
    return cache_key(all_, versions, model).select("node", "dependency_hash", "cache_key")


def read_json_cache(spark: SparkSession, path: str) -> DataFrame:
    """Items (key, row as JSON) of a JSON cache file of the right version; none otherwise."""
    lines = spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=\{\"version\")")).alias("value"))
    doc = lines.select(F.from_json("value", "version int, items map<string,string>").alias("d"))
    return doc.filter(F.col("d.version") == CACHE_VERSION).select(F.explode("d.items").alias("key", "row"))


def write_json_cache(items: DataFrame, path: str) -> None:
    """Items (key, row) in the layout that read_json_cache reads, an object in each part; partitions are written side by side.

    An object holds the items of a hash range, some thousand at most on average.
    """
    parts = max(1, items.count() // 1000)
    pairs = items.dropDuplicates(["key"]).groupBy(F.pmod(F.xxhash64("key"), F.lit(parts)).alias("part")).agg(F.map_from_entries(F.collect_list(F.struct("key", "row"))).alias("items"))
    pairs.select(F.to_json(F.struct(F.lit(CACHE_VERSION).alias("version"), "items")).alias("value")).write.mode("overwrite").text(path)

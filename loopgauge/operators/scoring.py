"""External scoring of uncertain blocks: an estimator runs in partitions, every failure becomes a conservative row."""

from __future__ import annotations

import json
import queue
import threading
import time
from collections import deque
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import lattice, text
from .classify import conservative, needs_scoring

#: Blocks that are scored in a run, requests at a time, and seconds for each.
MAX_BLOCKS, WORKERS, DEADLINE = 32, 4, 12.0


class Estimator(Protocol):
    """Scores one payload (JSON text) with a reply (JSON text with complexity, confidence, reason)."""

    def is_available(self) -> bool: ...

    def estimate(self, payload: str) -> str: ...


class Offline:
    """No model: all rows get the conservative class."""

    def is_available(self) -> bool:
        return False

    def estimate(self, payload: str) -> str:
        raise RuntimeError("no model")


def payloads(uncertain: DataFrame) -> DataFrame:
    """(node, payload, fallback) of features joined with results: name, class, excerpt and short lists of facts."""
    facts = F.struct("loop_count", "max_loop_depth", "branch_count", F.slice("call_sites", 1, 10).alias("calls"), F.slice("loops", 1, 8).alias("loops"), F.slice("container_operations", 1, 10).alias("container_ops"), "has_recursion", "recursion_kind", "has_sorting", "has_log_pattern", F.slice("flags", 1, 12).alias("uncertainty_flags"))
    return uncertain.select("node", F.to_json(F.struct("name", "kind", "language", F.col("complexity").alias("rule_complexity"), text.excerpt(F.col("source")).alias("source"), facts.alias("features"))).alias("payload"), conservative(uncertain).alias("fallback"))


def outcome(scored: DataFrame) -> DataFrame:
    """One row: blocks that a model scored, and those that fell back."""
    return scored.agg(F.count_if(F.col("analyzer_kind") == "llm").alias("scored"), F.count_if(F.col("analyzer_kind") == "llm_error").alias("errors"))


def compact(uncertain: DataFrame) -> DataFrame:
    """(node, payload) for recommendations: shorter excerpts and lists than those for estimates."""
    facts = F.struct("loop_count", "max_loop_depth", F.slice("call_sites", 1, 8).alias("calls"), F.slice("loops", 1, 6).alias("loops"), F.slice("container_operations", 1, 5).alias("container_ops"))
    return uncertain.select("node", F.to_json(F.struct("name", "kind", "complexity", text.excerpt(F.col("source"), text.RECOMMENDATION_LINES).alias("source"), facts.alias("features"))).alias("payload"))


def failure(reason: str) -> str:
    return json.dumps({"error": reason})


def asked(estimator: Estimator, payloads: list[str], workers: int = WORKERS, deadline: float = DEADLINE, answered: Callable[[], None] = lambda: None) -> list[str]:
    """Replies in the payloads' order: up to `workers` requests at a time, each given up after `deadline` seconds; a request that fails or is given up costs no other."""
    replies, waiting, running, came = [failure("none")] * len(payloads), deque(range(len(payloads))), {}, queue.SimpleQueue()

    def ask(i: int) -> None:
        try:
            came.put((i, estimator.estimate(payloads[i])))
        except Exception as e:  # an estimator's failure is a result, not an end of the job
            came.put((i, failure(str(e))))

    while waiting or running:
        while waiting and len(running) < workers:
            i = waiting.popleft()
            running[i] = time.monotonic() + deadline
            threading.Thread(target=ask, args=(i,), daemon=True).start()
        try:
            i, reply = came.get(timeout=max(0.0, min(running.values()) - time.monotonic()))
            done = {i: reply} if i in running else {}  # a late reply to a request that was given up
        except queue.Empty:
            done = {i: failure("deadline") for i, t in running.items() if t <= time.monotonic()}
        for i, reply in done.items():
            replies[i] = reply
            del running[i]
            answered()
    return replies


def score(uncertain: DataFrame, estimator: Estimator | None = None, budget: int = MAX_BLOCKS, workers: int = WORKERS, deadline: float = DEADLINE, progress=None) -> DataFrame:
    """(node, complexity, confidence, needs_review, analyzer_kind): the first `budget` uncertain blocks in source order go to the estimator, all others fall back.

    progress: an accumulator that counts the blocks answered or given up, visible on the driver as tasks end.
    """
    estimator = estimator or Offline()
    todo = uncertain.filter(needs_scoring())
    chosen = todo.orderBy("file_path", "ordinal").limit(budget).select("node", F.lit(True).alias("sent"))
    rows = payloads(todo).join(F.broadcast(chosen), "node", "left").withColumn("sent", F.coalesce("sent", F.lit(False)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ready = estimator.is_available()
        for frame in frames:
            reply = pd.Series([None] * len(frame), dtype=object, index=frame.index)
            if ready and frame["sent"].any():
                reply[frame["sent"]] = asked(estimator, frame.loc[frame["sent"], "payload"].tolist(), workers, deadline, (lambda: progress.add(1)) if progress is not None else lambda: None)
            yield frame[["node", "fallback"]].assign(reply=reply)

    said = rows.mapInPandas(run, "node string, fallback string, reply string").withColumn("object", text.json_object(F.col("reply")))
    got = said.withColumn("label", lattice.normalise(F.coalesce(F.get_json_object("object", "$.complexity"), F.lit("")))).withColumn("ok", lattice.is_ranked("label"))
    confidence = F.get_json_object("object", "$.confidence")
    return got.select(
        "node", F.when(F.col("ok"), F.col("label")).otherwise(F.col("fallback")).alias("complexity"),
        F.when(F.col("ok") & confidence.isin("high", "medium", "low"), confidence).otherwise("low").alias("confidence"), (~F.col("ok")).alias("needs_review"),
        F.when(F.col("ok"), "llm").otherwise("llm_error").alias("analyzer_kind"))

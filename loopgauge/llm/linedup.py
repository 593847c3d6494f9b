"""Line dedup: repeated chunks of two or more lines are cut, wherever they lie.

A rolling hash over the hashes of WINDOW neighbouring lines is taken at every line. A chunk is a stretch of lines whose windows all
stand at an earlier place too; it begins and ends where the windows stop repeating, so its boundaries follow the
content and survive insertions elsewhere. Windows with a repeated hash are compared byte for byte with their first occurrence
(smallest doc_id, then place) and go where they are equal to it, but for lines that are part of another window's first occurrence: each window
that is cut anywhere stands whole in the result. Stretches of blank lines between removed lines go too.

Only hashes are gathered for all windows; texts meet only for windows with a repeated hash. Windows that hold over one in common.HOT
of all rows are joined by broadcast, and compared with their first occurrence in several tasks.

Defined cases: null texts stay null, empty texts stay empty; windows without a visible character and single lines stay;
a text whose every line is removed becomes empty; rows that repeat both id and text count as one document; a null doc_id sorts first;
an empty table gives an empty result; all other columns pass unchanged, whatever their names, but those named n_lines or n_removed
are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Lines under the rolling hash, which is also the fewest lines of a chunk.
WINDOW = 2
_FACTORS = [np.uint64(0x9E3779B97F4A7C15 * (2 * i + 1) % 2**64) for i in range(WINDOW)]


def rolling(lines: list[bytes]) -> np.ndarray:
    """Hashes of the WINDOW lines that begin at each line."""
    h = np.array([xxhash.xxh64_intdigest(x) for x in lines], np.uint64)
    n = max(0, len(h) - WINDOW + 1)
    out = np.zeros(n, np.uint64)
    for i, f in enumerate(_FACTORS):
        out += h[i : i + n] * f
    return out ^ out >> np.uint64(29)


def _lines(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text else []


def _blank_between(lines: list[str], drop: set[int]) -> set[int]:
    """Lines without a visible character whose stretch lies between dropped lines."""
    at = sorted(drop)
    return {x for a, b in zip(at, at[1:], strict=False) if not "".join(lines[a + 1 : b]).strip() for x in range(a + 1, b)}


def chunk_table(docs: DataFrame) -> DataFrame:
    """(doc_id, k, first, h) of every window with a visible character."""
    names = ["doc_id", "k", "first", "h"]

    def run(batches):
        for b in batches:
            lines = [_lines(t) for t in b["text"].to_pylist()]
            hashes = [rolling(x) for x in lines]
            seen = [np.array([bool(x.strip()) for x in ls], bool) for ls in lines]
            use = [np.flatnonzero(np.logical_or.reduce([s[i : i + len(h)] for i in range(WINDOW)])) if len(h) else np.zeros(0, np.int64) for s, h in zip(seen, hashes, strict=True)]
            owner = pa.array(np.repeat(np.arange(len(use)), [len(u) for u in use]))
            first = np.concatenate([*use, np.zeros(0, np.int64)])
            h = np.concatenate([*(x[u] for x, u in zip(hashes, use, strict=True)), np.zeros(0, np.uint64)])
            yield pa.RecordBatch.from_arrays([b["doc_id"].take(owner), b["k"].take(owner), pa.array(first), pa.array(h.view(np.int64))], names)

    return docs.select("doc_id", "k", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def chunk_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, k, first, h, keeper, salts, data): the bytes of the windows listed in column found."""
    kinds = {"doc_id": pa.int64(), "k": pa.int64(), "first": pa.int64(), "h": pa.int64(), "keeper": pa.bool_(), "salts": pa.int32(), "data": pa.binary()}

    def run(batches):
        for b in batches:
            for i, j in common.by_bytes(list(range(len(b))), [len(t or "") for t in b["text"].to_pylist()], 8 << 20):
                rows = []
                for doc, k, text, found in zip(*(b[c].slice(i, j - i).to_pylist() for c in ("doc_id", "k", "text", "found")), strict=True):
                    lines = _lines(text)
                    rows += [(doc, k, f["first"], f["h"], f["keeper"], f["salts"], b"\n".join(lines[f["first"] : f["first"] + WINDOW])) for f in found]
                cols = list(zip(*rows, strict=True)) or [()] * len(kinds)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds.values(), strict=True)], list(kinds))

    return docs.mapInArrow(run, "doc_id long, k long, first long, h long, keeper boolean, salts int, data binary")


def _same_row(left: str, right: str) -> Column:
    return (F.col(f"{left}.k") == F.col(f"{right}.k")) & F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with repeated chunks cut out of text, n_lines (before) and n_removed."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("k"), F.struct(*[c for c in names if c != "text"]).alias("row"))
    table = common.stored(chunk_table(keyed).distinct(), "line-windows")
    repeated = common.stored(
        table.groupBy("h").agg(F.count("*").alias("times"), F.min(F.struct("doc_id", "k", "first")).alias("keep")).filter("times > 1"), "line-repeated"
    )
    found = common.join_repeated(table, repeated, "h").select(
        "doc_id", "k", F.struct("first", "h", F.struct("doc_id", "k", "first").eqNullSafe(F.col("keep")).alias("keeper"), common.salts(F.col("times"), table.count()).alias("salts")).alias("f")
    )
    by_doc = common.stored(found.groupBy("doc_id", "k").agg(F.collect_list("f").alias("found")), "line-found")
    # all columns stay in both joins, so that the texts are dealt out once and read twice
    texts = chunk_texts(keyed.alias("d").join(by_doc.alias("f"), _same_row("d", "f")).select("d.*", "f.found"))
    keepers = texts.filter("keeper").dropDuplicates(["h"]).select("h", F.col("data").alias("kept"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    others = texts.filter("NOT keeper").withColumn("salt", F.pmod(F.xxhash64("k", "first"), F.col("salts")).cast("int"))
    equal = others.join(keepers, ["h", "salt"]).filter("data = kept")
    # the first occurrence of a repeated window stays whole, whatever else its lines belong to
    needed = by_doc.select("doc_id", "k", F.explode(F.filter("found", lambda f: f["keeper"])).alias("f")).select("doc_id", "k", F.col("f.first").alias("kept"))
    marks = equal.select("doc_id", "k", F.col("first").alias("gone")).unionByName(needed, allowMissingColumns=True)
    gone = marks.groupBy("doc_id", "k").agg(F.collect_set("gone").alias("gone"), F.collect_set("kept").alias("kept")).filter(F.size("gone") > 0)
    joined = keyed.alias("d").join(gone.alias("g"), _same_row("d", "g"), "left").select("d.*", "g.gone", "g.kept")

    def cut(batches):
        for b in batches:
            texts, total, removed = [], [], []
            for text, parts, needed in zip(b["text"].to_pylist(), b["gone"].to_pylist(), b["kept"].to_pylist(), strict=True):
                lines = text.split("\n") if text else []
                total.append(len(lines))
                drop = {i for p in parts or [] for i in range(p, p + WINDOW)} - {i for p in needed or [] for i in range(p, p + WINDOW)}
                drop |= _blank_between(lines, drop)
                removed.append(len(drop))
                texts.append("\n".join(x for i, x in enumerate(lines) if i not in drop) if drop else text)
            rest = iter(b["row"].flatten())
            have = [pa.array(texts, pa.string()) if c == "text" else next(rest) for c in names]
            yield pa.RecordBatch.from_arrays([*have, pa.array(total, pa.int64()), pa.array(removed, pa.int64())], [*names, "n_lines", "n_removed"])

    return joined.mapInArrow(cut, common.schema_with(docs, names, n_lines="bigint", n_removed="bigint"))


def op8(spark, sf_dir: str) -> DataFrame:
    return deduplicated(common.table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")

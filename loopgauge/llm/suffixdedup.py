"""Suffix-array dedup of byte strings: every byte under a string of WIDTH bytes that starts elsewhere too is removed.

1. Of all suffixes those are kept that begin at a minimizer: the GRAM-byte string with the smallest hash under some stretch of
   WIDTH bytes. Equal WIDTH-byte strings hold the same minimizer at the same place.
2. Suffixes whose first GRAM bytes are unique in the corpus (counted by hash) cannot matter and go.
3. Tasks sort the other suffixes, WIDTH bytes long and followed by the bytes before them read backwards, collapse equal ones, and
   exchange the sorted runs front-coded (length of the prefix shared with the last one, then the rest).
4. Each merge joins its runs in a loser tree that keeps, for every run, the prefix it shares with the last winner: strings
   are only compared beyond it. Neighbours that share GRAM bytes form a class; inside it the shared prefixes to the
   right and to the left tell exactly which WIDTH-byte strings around the minimizer occur twice.
5. The byte ranges come back to their documents by one join.
6. Suffixes whose first GRAM bytes stand at more than LIMIT places do not go through a merge, which would have to hold them all. Their entries
   are refined by counting (see refined), which no frequency of a string can crowd into one task.

Defined cases: null and empty texts and those shorter than WIDTH bytes keep all bytes; a document may match
itself, overlaps included; rows that repeat id and text are different places of the same string and so are removed;
a null doc_id is an id like any other; strings that begin at the gram of very many places are compared by MD5; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Bytes of a repeated string and of a minimizer; grams under one string.
WIDTH, GRAM = 200, 40
GRAMS = WIDTH - GRAM + 1
#: Bytes to the left that a suffix carries, and of a whole entry. FILL never occurs in UTF-8.
LEFT = GRAMS - 1
ENTRY, FILL = WIDTH + LEFT, b"\xff"
#: Bytes hashed at a time, entries of a sorted run, entries that one merge should get.
BATCH, RUN, MERGE = 2 << 20, 60_000, 80_000
#: Places of a gram that a merge takes; widths of the bands of offsets in which entries with more frequent grams are refined.
LIMIT, BANDS = 20_000, (41, 11, 3, 1)
#: Grams of more than LIMIT places that are looked up at a time: 8 MB for a task.
KEYS = 1_000_000
NO_ID = -(2**63)

_BASE = 0x9E3779B97F4A7C15 | 1


class Hasher:
    """Hashes of all GRAM-byte strings of a buffer, and the minimizers among them."""

    def __init__(self):
        self.power, self.inverse = np.ones(0, np.uint64), np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            n = max(n, BATCH + (1 << 16))
            up, down = np.full(n, _BASE, np.uint64), np.full(n, pow(_BASE, -1, 1 << 64), np.uint64)
            up[0] = down[0] = 1
            self.power, self.inverse = np.cumprod(up), np.cumprod(down)

    def minimizers(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(text, position, hash) of the minimizers of texts, each at least WIDTH bytes long."""
        size = np.array([len(t) for t in texts])
        begin = np.cumsum(size) - size
        data = np.frombuffer(b"".join(texts), np.uint8)
        self._powers(len(data) + 1)
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data + np.uint64(1)) * self.power[: len(data)], out=total[1:])
        h = (total[GRAM:] - total[:-GRAM]) * self.inverse[: len(data) - GRAM + 1]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        low = np.maximum((h >> np.uint64(32)).astype(np.uint32), 1)  # 0 stands for none
        least = _sliding(low, GRAMS, np.minimum)  # of the grams under the string that starts at each byte
        inside = np.zeros(len(least) + 1, np.int32)
        np.add.at(inside, begin, 1)
        np.add.at(inside, np.minimum(begin + size - WIDTH + 1, len(least)), -1)
        least = np.where(np.cumsum(inside[:-1]) > 0, least, 0)  # strings that cross into the next text choose nothing
        spread = _sliding(np.concatenate([np.zeros(GRAMS - 1, np.uint32), least, np.zeros(GRAMS - 1, np.uint32)]), GRAMS, np.maximum)
        at = np.flatnonzero((spread == low) & (low > 0))
        owner = np.searchsorted(begin, at, side="right") - 1
        return owner, at - begin[owner], h[at]


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each stretch of `width` values, by doubling."""
    have = 1
    while 2 * have <= width:
        x = op(x[:-have], x[have:])
        have *= 2
    return op(x[: len(x) - (width - have)], x[width - have :]) if width > have else x


def _utf8(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "replace") for t in texts]


def anchors(docs: DataFrame) -> DataFrame:
    """(key, k, doc_id, pos) of every minimizer."""
    names = ["key", "k", "doc_id", "pos"]

    def run(batches):
        hasher = Hasher()
        for b in batches:
            texts = _utf8(b["text"].to_pylist())
            for i, j in common.by_bytes(texts, [len(t) for t in texts], BATCH):
                rows = [r for r in range(i, j) if len(texts[r]) >= WIDTH]
                if rows:
                    owner, pos, h = hasher.minimizers([texts[r] for r in rows])
                    at = pa.array(np.array(rows)[owner])
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), b["k"].take(at), b["doc_id"].cast(pa.int64()).take(at), pa.array(pos, pa.int32())], names)

    return docs.select("k", "doc_id", "text").mapInArrow(run, "key long, k long, doc_id long, pos int")


def entry(data: bytes, pos: int) -> bytes:
    """The suffix at pos, then the bytes before it backwards, each filled up."""
    right, left = data[pos : pos + WIDTH], data[max(0, pos - LEFT) : pos][::-1]
    return right.ljust(WIDTH, FILL) + left.ljust(LEFT, FILL)


def shared_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix of two entries that agree on their first `known` bytes."""
    x = int.from_bytes(a[known:], "big") ^ int.from_bytes(b[known:], "big")
    return ENTRY - (x.bit_length() + 7) // 8


def front_coded(entries: list[tuple[bytes, list]]) -> dict:
    """Columns of a sorted run: shared prefixes, packed rests, and the places (k, doc_id, pos) of each entry."""
    last, shared, rest = b"", [], []
    for z, _ in entries:
        n = shared_prefix(last, z) if last else 0
        shared.append(n)
        rest.append(z[n:])
        last = z
    places = [p for _, ps in entries for p in ps]
    k, doc, pos = zip(*places, strict=True)
    return {
        "shared": np.array(shared, np.uint16).tobytes(), "rest": zstandard.compress(b"".join(rest), 1),
        "times": np.array([len(ps) for _, ps in entries], np.uint32).tobytes(), "k": np.array(k, np.int64).tobytes(),
        "doc": np.array(doc, np.int64).tobytes(), "pos": np.array(pos, np.int32).tobytes(),
    }


RUN_SCHEMA = "p long, shared binary, rest binary, times binary, k binary, doc binary, pos binary"


def sorted_runs(docs: DataFrame, parts: int) -> DataFrame:
    """Front-coded sorted runs for each of `parts` merges, from docs (k, doc_id, text, found)."""

    def flush(entries: dict[bytes, list]):
        by_part: dict[int, list] = {}
        for z in sorted(entries):
            by_part.setdefault(xxhash.xxh64_intdigest(z[:GRAM], 3) % parts, []).append((z, entries[z]))
        rows = [{"p": p, **front_coded(es)} for p, es in by_part.items()]
        if rows:
            kinds = [pa.int64()] + [pa.binary()] * 6
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in zip(rows[0], kinds, strict=True)], list(rows[0]))

    def run(batches):
        entries: dict[bytes, list] = {}
        n = 0
        for b in batches:
            for k, doc, text, found in zip(*(b[c].to_pylist() for c in ("k", "doc_id", "text", "found")), strict=True):
                data = text.encode("utf-8", "replace")
                doc = NO_ID if doc is None else doc
                for pos in found:
                    entries.setdefault(entry(data, pos), []).append((k, doc, pos))
                n += len(found)
                if n >= RUN:
                    yield from flush(entries)
                    entries, n = {}, 0
        yield from flush(entries)

    return docs.mapInArrow(run, RUN_SCHEMA)


class Run:
    """Reads a front-coded run entry by entry."""

    def __init__(self, row: dict):
        self.shared, self.times = np.frombuffer(row["shared"], np.uint16).tolist(), np.frombuffer(row["times"], np.uint32)
        self.rest, self.at, self.i, self.now = zstandard.decompress(row["rest"]), 0, -1, b""
        self.places = [np.frombuffer(row[c], t) for c, t in (("k", np.int64), ("doc", np.int64), ("pos", np.int32))]
        self.first = np.cumsum(self.times) - self.times

    def next(self) -> int:
        """Moves on; the prefix shared with the entry before, or -1 at the end."""
        self.i += 1
        if self.i == len(self.shared):
            return -1
        n = self.shared[self.i]
        stop = self.at + ENTRY - n
        self.now = self.now[:n] + self.rest[self.at : stop]
        self.at = stop
        return n

    def place(self, i: int) -> tuple[np.ndarray, ...]:
        a = int(self.first[i])
        return tuple(x[a : a + int(self.times[i])] for x in self.places)


def merged(runs: list[Run]):
    """(entry, prefix shared with the entry before, run, index in the run) of all runs in order, by a loser tree.

    known[r]: the prefix that run r's entry shares with the last winner. Of two contenders the one with the longer known prefix
    is smaller; only equal ones are compared, from there on.
    """
    n = len(runs)
    known = [r.next() for r in runs]
    losers = [-1] * n

    def play(r: int, node: int) -> int:
        while node:
            other = losers[node]
            if other < 0:
                losers[node] = r
                return -1
            a, b = known[r], known[other]
            if a < b:
                losers[node], r = r, other
            elif a == b >= 0:
                x, y = runs[r].now, runs[other].now
                h = ENTRY if x == y else shared_prefix(x, y, a)
                if h < ENTRY and x[h] > y[h]:
                    known[r], losers[node], r = h, r, other
                else:
                    known[other] = h
            node //= 2
        return r

    best = -1
    for r in range(n):
        best = max(best, play(r, (r + n) // 2))
    while n and known[best] >= 0:
        run = runs[best]
        yield run.now, known[best], run, run.i
        known[best] = run.next()
        best = play(best, (best + n) // 2)


def repeated_offsets(entries: list[bytes], shared: list[int], many: list[bool]) -> np.ndarray:
    """For sorted distinct entries of a class: whether the WIDTH-byte string that starts o bytes before the minimizer occurs again.

    shared[i]: prefix shared with entry i - 1. many[i]: entry i itself occurs more than once.
    Strings at offset o are equal where the first WIDTH - o bytes to the right and o bytes to the left are: both are numbered in sorted order,
    and pairs of numbers that occur twice are repeated.
    """
    m = len(entries)
    out = np.zeros((m, GRAMS), bool)
    if m == 2:
        r = min(shared[1], WIDTH)
        a, b = (int.from_bytes(z[WIDTH:], "big") for z in entries)
        left = LEFT - ((a ^ b).bit_length() + 7) // 8
        out[:, WIDTH - r : left + 1] = True
    elif m > 2:
        right = np.minimum(np.array(shared), WIDTH)
        right[0] = 0
        lefts = [z[WIDTH:] for z in entries]
        order = sorted(range(m), key=lefts.__getitem__)
        grid = np.frombuffer(b"".join(lefts[i] for i in order), np.uint8).reshape(m, LEFT)
        differs = grid[1:] != grid[:-1]
        left = np.r_[0, np.where(differs.any(axis=1), differs.argmax(axis=1), LEFT)]
        order = np.array(order)
        for o in range(0, GRAMS, span := max(1, min(GRAMS, 2_000_000 // m))):
            offsets = np.arange(o, min(GRAMS, o + span))
            number = np.cumsum(right[:, None] < WIDTH - offsets, axis=0) * m
            by_left = np.cumsum(left[:, None] < offsets, axis=0)
            number[order] += by_left
            ranks = np.argsort(number, axis=0, kind="stable")
            ordered = np.take_along_axis(number, ranks, axis=0)
            same = np.zeros((m + 1, len(offsets)), bool)
            same[1:-1] = ordered[1:] == ordered[:-1]
            np.put_along_axis(out[:, o : o + len(offsets)], ranks, same[:-1] | same[1:], axis=0)
    out[np.array(many)] = True
    return out


def _valid(z: bytes) -> tuple[int, int]:
    """Offsets from which to which the strings around an entry's minimizer lie inside its text."""
    right, left = z.find(FILL, 0, WIDTH), z.find(FILL, WIDTH)
    return (0 if right < 0 else WIDTH - right), (LEFT if left < 0 else left - WIDTH)


def merge_ranges(group: pa.Table) -> pa.Table:
    """Byte ranges (k, doc_id, start, stop) of repeated strings, from all runs of one merge."""
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []

    def close(entries, shared, places):
        many = [len(ps) > 1 or len(ps[0][0]) > 1 for ps in places]
        if len(entries) == 1 and not many[0]:
            return
        flags = repeated_offsets(entries, shared, many)
        for z, flag, ps in zip(entries, flags, places, strict=True):
            lo, hi = _valid(z)
            edges = np.flatnonzero(np.diff(np.r_[False, flag[lo : hi + 1], False]))
            for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):  # offsets lo + a to lo + b - 1
                for k, doc, pos in ps:
                    out.append((k, doc, pos - (lo + b - 1), pos - (lo + a) + WIDTH))

    entries: list[bytes] = []
    shared: list[int] = []
    places: list[list] = []
    for z, n, run, i in merged([Run(r) for r in group.to_pylist()]):
        if n >= GRAM and entries:
            if n == ENTRY:
                places[-1].append(run.place(i))
                continue
        elif entries:
            close(entries, shared, places)
            entries, shared, places = [], [], []
        entries.append(z)
        shared.append(n)
        places.append([run.place(i)])
    if entries:
        close(entries, shared, places)
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 4
    doc = pa.array(cols[1], pa.int64(), mask=cols[1] == NO_ID)
    return pa.table({"k": pa.array(cols[0], pa.int64()), "doc_id": doc, "start": pa.array(cols[2], pa.int64()), "stop": pa.array(cols[3], pa.int64())})


def _same_row(left: str, right: str) -> Column:
    return (F.col(f"{left}.k") == F.col(f"{right}.k")) & F.col(f"{left}.doc_id").eqNullSafe(F.col(f"{right}.doc_id"))


def _union(ranges: list[dict]) -> list[tuple[int, int]]:
    """Maximal ranges: those that touch or overlap are one."""
    out: list[list[int]] = []
    for r in sorted((r["start"], r["stop"]) for r in ranges):
        if out and r[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], r[1])
        else:
            out.append(list(r))
    return [(a, b) for a, b in out]


def hot_entries(docs: DataFrame, keys: list[int]) -> DataFrame:
    """(entry, lo, hi, places) at the minimizers of docs (k, doc_id, text) whose hashes are in keys: equal entries of a batch are one row; lo to hi are the offsets inside the text."""
    place = pa.struct([("k", pa.int64()), ("doc_id", pa.int64()), ("pos", pa.int32())])
    wanted = docs.sparkSession.sparkContext.broadcast(np.sort(np.array(keys, np.int64)))

    def run(batches):
        hasher, sought = Hasher(), wanted.value
        for b in batches:
            texts = _utf8(b["text"].to_pylist())
            for i, j in common.by_bytes(texts, [len(t) for t in texts], BATCH):
                rows = [r for r in range(i, j) if len(texts[r]) >= WIDTH]
                if not rows:
                    continue
                owner, at, h = hasher.minimizers([texts[r] for r in rows])
                h = h.view(np.int64)
                hit = np.flatnonzero(sought[np.minimum(np.searchsorted(sought, h), len(sought) - 1)] == h)
                ks, ids = b["k"].to_pylist(), b["doc_id"].to_pylist()
                entries: dict[bytes, list] = {}
                for r, pos in zip(np.array(rows)[owner[hit]].tolist(), at[hit].tolist(), strict=True):
                    entries.setdefault(entry(texts[r], pos), []).append({"k": ks[r], "doc_id": ids[r], "pos": pos})
                lo, hi = zip(*map(_valid, entries), strict=True) if entries else ((), ())
                yield pa.RecordBatch.from_arrays([pa.array(list(entries), pa.binary()), pa.array(lo, pa.int32()), pa.array(hi, pa.int32()), pa.array(list(entries.values()), pa.list_(place))], ["entry", "lo", "hi", "places"])

    return docs.select("k", "doc_id", "text").mapInArrow(run, "entry binary, lo int, hi int, places array<struct<k:bigint,doc_id:bigint,pos:int>>")


def refined(entries: DataFrame) -> DataFrame:
    """(id, o0, o1): bands of offsets none of whose strings is repeated, of a table (id, entry, weight); all other strings are.

    A band of offsets has a core, the bytes that all its strings share, and bytes to the right and left of it that only some of them hold.
    An entry alone with its core has no repeated string in the band. Entries alike in all these bytes are equal at all its offsets and go on as one;
    those that share no more than the core go on in narrower bands. Strings are counted by MD5, with partial counts before each shuffle.
    """
    sub = f"transform(sequence(o0, o1, %d), x -> named_struct('p0', x, 'p1', least(o1, x + %d)))"  # noqa: F541
    state = entries.select("id", "weight", F.lit(0).alias("o0"), F.lit(LEFT).alias("o1"), F.expr(f"substring(entry, 1, {GRAM})").alias("core"), F.expr(f"substring(entry, {GRAM + 1}, {LEFT})").alias("er"), F.expr(f"substring(entry, {WIDTH + 1}, {LEFT})").alias("el"))
    out = None
    for width in BANDS:
        bands = state.select("*", F.inline(F.expr(sub % (width, width - 1))))
        keyed = common.stored(bands.selectExpr(
            "id", "weight", "p0 AS o0", "p1 AS o1", "unhex(md5(concat(core, encode(concat(p0, ' ', p1, ' '), 'UTF-8'), substring(er, 1, o1 - p1), substring(el, 1, p0 - o0)))) AS core",
            "substring(er, o1 - p1 + 1, p1 - p0) AS er", "substring(el, p0 - o0 + 1, p1 - p0) AS el",
        ), "bands")
        cores = common.stored(keyed.groupBy("core").agg(F.sum("weight").alias("times"), F.min("id").alias("id"), F.min("o0").alias("o0"), F.min("o1").alias("o1")), "cores")
        alone = cores.filter("times = 1").select("id", "o0", "o1")
        out = alone if out is None else out.unionByName(alone)
        if width == 1:
            break
        shared = common.stored(cores.filter("times > 1").select("core", "times"), "shared-cores")
        alike = ["core", "o0", "o1", "er", "el"]
        hulls = common.stored(common.join_repeated(keyed, shared, "core").groupBy(*alike).agg(F.sum("weight").alias("weight"), F.min("id").alias("id")), "hulls")
        common.dropped(keyed)
        still = hulls.groupBy("core").agg(F.count("*").alias("times"), F.count_if(F.col("weight") == 1).alias("open")).filter("times > 1 AND open > 0")
        state = common.join_repeated(hulls, common.stored(still.select("core", "times"), "open-cores"), "core").select("id", "weight", *alike)
    return out


def _kept_ranges(batches):
    """Byte ranges around the places of each entry at the offsets from lo to hi that are in none of its bands `alone`."""
    for b in batches:
        out: list[tuple] = []
        for lo, hi, places, alone in zip(*(b[c].to_pylist() for c in ("lo", "hi", "places", "alone")), strict=True):
            flag = np.ones(GRAMS, bool)
            for x in alone or []:
                flag[x["o0"] : x["o1"] + 1] = False
            edges = np.flatnonzero(np.diff(np.r_[False, flag[lo : hi + 1], False])).tolist()
            out += [(p["k"], p["doc_id"], p["pos"] - (lo + z - 1), p["pos"] - (lo + a) + WIDTH) for a, z in zip(edges[::2], edges[1::2], strict=True) for p in places]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out, strict=True) if out else [[]] * 4)], ["k", "doc_id", "start", "stop"])


def hot_ranges(docs: DataFrame, hot: DataFrame) -> DataFrame:
    """Byte ranges (k, doc_id, start, stop) of repeated strings around the places of the grams in hot (key), in docs (k, doc_id, text).

    The grams are handled in blocks of about KEYS, which tasks look up in the texts that they read once more for each block.
    """
    found, blocks = None, math.ceil(hot.count() / KEYS)
    for i in range(blocks):
        part = hot_entries(docs, [r.key for r in hot.filter(F.pmod(F.xxhash64("key"), F.lit(blocks)) == i).select("key").collect()])
        found = part if found is None else found.union(part)
    table = common.stored(found.withColumn("id", F.monotonically_increasing_id()).withColumn("weight", F.size("places").cast("long")), "hot-entries")
    alone = refined(table.select("id", "entry", "weight")).groupBy("id").agg(F.collect_list(F.struct("o0", "o1")).alias("alone"))
    return table.drop("entry", "weight").join(alone, "id", "left").mapInArrow(_kept_ranges, "k long, doc_id long, start long, stop long")


def repeated_ranges(docs: DataFrame) -> DataFrame:
    """(doc_id, text, ranges): ranges are the maximal byte ranges (start, stop) under repeated strings, null if none."""
    keyed = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("doc_id", "text").alias("k"))
    table = common.stored(anchors(keyed), "anchors")
    again = common.stored(table.groupBy("key").agg(F.count("*").alias("times")).filter("times > 1"), "anchors-repeated")
    found = common.stored(common.join_repeated(table, again, "key").filter(F.col("times") <= LIMIT).groupBy("k", "doc_id").agg(F.collect_set("pos").alias("found")), "anchors-found")
    common.dropped(table)
    hits = found.agg(F.sum(F.size("found"))).first()[0] or 0
    parts = max(1, math.ceil(hits / MERGE))
    beside = keyed.alias("d").join(found.alias("f"), _same_row("d", "f")).select("d.k", "d.doc_id", "d.text", "f.found")
    ranges = sorted_runs(beside, parts).groupBy("p").applyInArrow(merge_ranges, "k long, doc_id long, start long, stop long")
    hot = again.filter(F.col("times") > LIMIT)
    if not hot.isEmpty():
        ranges = ranges.union(hot_ranges(keyed, hot))
    by_doc = ranges.groupBy("k", "doc_id").agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))
    return keyed.alias("d").join(by_doc.alias("r"), _same_row("d", "r"), "left").select("d.doc_id", "d.text", "r.ranges")


def removed(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept): kept holds the remaining bytes."""
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"]

    def run(batches):
        for b in batches:
            cols: list[list] = [[], [], [], []]
            for data, ranges in zip(_utf8(b["text"].to_pylist()), b["ranges"].to_pylist(), strict=True):
                spans, at, kept = _union(ranges or []), 0, []
                for start, stop in spans:
                    kept.append(data[at:start])
                    at = stop
                kept.append(data[at:])
                for c, v in zip(cols, (len(data), sum(z - a for a, z in spans), len(spans), b"".join(kept)), strict=True):
                    c.append(v)
            kinds = [pa.int64()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, kinds, strict=True))], names)

    return repeated_ranges(docs).mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op6(spark, sf_dir: str) -> DataFrame:
    return removed(common.table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

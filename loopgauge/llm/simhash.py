"""SimHash near-duplicates by tiled exact comparison.

64-bit fingerprints that differ in at most `radius` bits are linked. The bits are cut into
radius + extra blocks; two linked fingerprints agree on at least `extra` of them, so every link lies inside
a bucket of equal values of some choice of `extra` blocks. A bucket is a tile: numpy exclusive-or and bit counts
compare all its pairs in population-count order and stop where the counts differ beyond the radius.
A bucket above TILE rows is cut by population count and hash into several tiles; pairs of tiles
whose counts lie beyond the radius are skipped, all others are compared. Nothing is capped.

Defined cases: null and empty texts and texts without words have fingerprint zero and link like any
other; rows of one text share a fingerprint, rows of one id with different texts do not and are not tied by the id; a null doc_id gets the
component of its fingerprint and links like any other, and a component without any id is null; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common

#: Rows of a tile: 2048 x 2048 comparisons of 8 bytes fit a few MB of a task.
TILE = 2048
#: Rows of exploded keys that one numpy call sorts and compares.
BIN = 150_000


def shingle_bytes(text: str | None, width: int) -> list[bytes]:
    words = (text or "").encode("utf-8", "replace").lower().split()
    if len(words) <= width:
        return [b" ".join(words)] if words else []
    return [b" ".join(t) for t in zip(*(words[i:] for i in range(width)), strict=False)]


def fingerprint(shingles: list[bytes]) -> int:
    """Bit i is 1 if set in over half of the XXH64 values."""
    if not shingles:
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(shingles), 16384):
        digest = xxhash.xxh64_digest
        h = np.frombuffer(b"".join([digest(s, 42) for s in shingles[i : i + 16384]]), np.uint8).reshape(-1, 8)
        counts += np.unpackbits(h, axis=1).sum(axis=0, dtype=np.uint32)
    return int.from_bytes(np.packbits(counts * 2 > len(shingles)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """(doc_id, fp): fp is the unsigned fingerprint's bits in a signed long."""

    def run(batches):
        for b in batches:
            fps = [fingerprint(shingle_bytes(t, width)) for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"].cast(pa.int64()), pa.array(np.array(fps, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def masks(radius: int, extra: int) -> list[int]:
    """Masks over `extra` of radius + extra blocks of the 64 bits, as signed longs."""
    n = radius + extra
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:], strict=False)]
    return [m - (1 << 64) if m >> 63 else m for m in (sum(c) for c in combinations(blocks, extra))]


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index reachable from each of n points over links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for x in (a, b, label[a], label[b]):
            np.minimum.at(new, x, low)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def links_within(tile: np.ndarray, fp: np.ndarray, radius: int) -> np.ndarray:
    """For rows sorted by tile and population count: the smallest row that links reach inside the tile."""
    pop = np.bitwise_count(fp).sum(axis=1, dtype=np.int16)
    at, out_a, out_b, gathered, step, label = np.arange(len(fp) - 1), [], [], 0, 1, np.arange(len(fp))
    while len(at):
        keep = (tile[at] == tile[at + step]) & (pop[at + step] - pop[at] <= radius)  # counts only drift apart at later steps
        at = at[keep]
        near = at[np.bitwise_count(fp[at] ^ fp[at + step]).sum(axis=1, dtype=np.int16) <= radius]
        out_a.append(near)
        out_b.append(near + step)
        gathered += len(near)
        step += 1
        at = at[at + step < len(fp)]
        if gathered > 2_000_000 or not len(at):
            label = forest(len(fp), np.concatenate([np.arange(len(fp)), *out_a]), np.concatenate([label, *out_b]))
            out_a, out_b, gathered = [], [], 0
    return label


def _words(group: pa.Table, words: list[str]) -> np.ndarray:
    return np.stack([group[w].to_numpy() for w in words], axis=1).view(np.uint64)


def _bins(group: pa.Table, words: list[str], radius: int) -> pa.Table:
    c, key, node = (group[x].to_numpy() for x in ("c", "key", "node"))
    fp = _words(group, words)
    order = np.lexsort((np.bitwise_count(fp).sum(axis=1), key, c))
    c, key, fp, node = c[order], key[order], fp[order], node[order]
    tile = np.cumsum(np.r_[False, (c[1:] != c[:-1]) | (key[1:] != key[:-1])])
    label = links_within(tile, fp, radius)
    nodes, at = np.unique(node, return_inverse=True)  # a point lies in several tiles of a bin
    least = forest(len(nodes), at, at[label])
    linked = least != np.arange(len(nodes))
    return pa.table({"a": nodes[linked], "b": nodes[least[linked]]})


def _tile_pair(group: pa.Table, words: list[str], radius: int) -> pa.Table:
    right, fp, node = group["is_right"].to_numpy(zero_copy_only=False), _words(group, words), group["node"].to_numpy()
    left_i, right_i = np.flatnonzero(~right), np.flatnonzero(right)
    if not len(right_i):  # a tile with itself
        right_i = left_i
    found_a, found_b = [], []
    for i in range(0, len(left_i), 128):
        differ = sum(np.bitwise_count(fp[left_i[i : i + 128], None, w] ^ fp[None, right_i, w]).astype(np.int16) for w in range(len(words)))
        x, y = np.nonzero(differ <= radius)
        label = forest(len(fp), left_i[i + x], right_i[y])
        moved = np.flatnonzero(label != np.arange(len(fp)))
        found_a.append(moved)
        found_b.append(label[moved])
    label = forest(len(fp), np.concatenate(found_a or [[]]).astype(int), np.concatenate(found_b or [[]]).astype(int))
    moved = np.flatnonzero(label != np.arange(len(fp)))
    return pa.table({"a": node[moved], "b": node[label[moved]]})


def links(points: DataFrame, radius: int, keys: list[Column], words: list[str]) -> DataFrame:
    """Edges (a, b) that span the links among distinct points (fingerprint columns `words`, node long) that agree on any of the keys."""
    keyed = points.select(F.posexplode(F.array(*keys)).alias("c", "key"), *words, "node")
    sized = common.stored(keyed.groupBy("c", "key").agg(F.count("*").alias("times")).filter("times > 1"), "tile-sizes")
    met = common.join_repeated(keyed, sized, ["c", "key"]).withColumnRenamed("times", "n")
    shared = common.stored(met.withColumn("pop", sum(F.bit_count(w) for w in words)), "tiles")
    small, big = shared.filter(F.col("n") <= TILE), shared.filter(F.col("n") > TILE)
    bins = max(1, math.ceil(small.count() / BIN))
    within = (
        small.select(F.pmod(F.xxhash64("c", "key"), F.lit(bins)).alias("bin"), "c", "key", *words, "node")
        .groupBy("bin").applyInArrow(lambda g: _bins(g, words, radius), "a long, b long")
    )
    cuts = common.stored(big.groupBy("c", "key", "pop").agg(F.count("*").alias("times")).withColumn("parts", F.ceil(F.col("times") / TILE).cast("int")), "tile-cuts")
    left, other = cuts.alias("l"), cuts.alias("o")
    pairs = left.join(other, (F.col("l.c") == F.col("o.c")) & (F.col("l.key") == F.col("o.key"))).filter(F.abs(F.col("l.pop") - F.col("o.pop")) <= radius)
    whose = [F.col(f"l.{x}").alias(x) for x in ("c", "key", "pop", "parts", "times")]
    near = F.collect_list(F.struct(F.col("o.pop").alias("pop"), F.col("o.parts").alias("parts"))).alias("near")  # one for each population count
    partners = common.stored(pairs.groupBy(*whose).agg(near), "tile-partners")
    mine = F.struct("pop", F.col("part").alias("part"))
    tiles = common.join_repeated(big, partners, ["c", "key", "pop"]).withColumn("part", F.pmod(F.xxhash64(*words), F.col("parts")).cast("int"))
    dealt = (
        tiles.withColumn("o", F.explode("near"))
        .withColumn("o_part", F.explode(F.sequence(F.lit(0), F.col("o.parts") - 1)))
        .withColumn("theirs", F.struct(F.col("o.pop").alias("pop"), F.col("o_part").alias("part")))
        .select("c", "key", F.least(mine, "theirs").alias("lo"), F.greatest(mine, "theirs").alias("hi"), (mine > F.col("theirs")).alias("is_right"), *words, "node")
    )
    across = dealt.groupBy("c", "key", "lo", "hi").applyInArrow(lambda g: _tile_pair(g, words, radius), "a long, b long")
    # a point has at most one link for each tile it is in; its neighbours are tied to the smallest of them, of which there are few
    tied = common.stored(within.union(across).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).withColumn("m", F.min("b").over(W.partitionBy("a"))), "links")
    return tied.select("a", F.col("m").alias("b")).union(tied.filter("b <> m").select("b", "m")).distinct()


def block_keys(radius: int = 4, extra: int = 2) -> list[Column]:
    """Keys of 64-bit fingerprints of which linked ones share at least one."""
    return [F.col("fp").bitwiseAND(F.lit(m)) for m in masks(radius, extra)]


def near_duplicates(docs: DataFrame, width: int = 4, radius: int = 4) -> DataFrame:
    """(doc_id, fp, component_id) of every row of docs (doc_id, text); component_id is the smallest doc_id that links reach.

    Points are the distinct fingerprints and are named by themselves, so neither repeated nor null ids decide which of them are linked.
    """
    prints = common.stored(fingerprints(docs, width), "fingerprints")
    points = common.stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("times")), "points")
    found = common.components(links(points.select("fp", F.col("fp").alias("node")), radius, block_keys(radius), ["fp"]))
    placed = common.stored(points.join(found, F.col("fp") == F.col("node"), "left").select("fp", "least", F.col("times").alias("rows"), F.coalesce("component", "fp").alias("component")), "placed")
    least = common.stored(placed.groupBy("component").agg(F.min("least").alias("component_id"), F.count("*").alias("times")), "component-ids")
    named = common.stored(common.join_repeated(placed, least, "component").select("fp", "component_id", F.col("rows").alias("times")), "point-ids")
    return common.join_repeated(prints, named, "fp").select("doc_id", "fp", "component_id")


#: Near copies share SIMILAR of their distinct shingles of WIDTH words. Wide fingerprints find the candidates: 256 bits, of which such copies
#: differ in 39 on average with a deviation of 6 (the angle between their sets of shingles), so the radius lies over four deviations above.
#: Their tiles are keyed by the smallest shingles: KEYS keys of the minima under KEY_MINIMA hash orders. Such copies agree on a key with a chance
#: of SIMILAR ** KEY_MINIMA, so 0.999 of them meet in a tile; texts that share little hardly do, however many there are.
WIDE, SIMILAR, WIDTH, WIDE_RADIUS, KEYS, KEY_MINIMA = ["f0", "f1", "f2", "f3"], 0.8, 5, 65, 10, 3
TILE_KEYS = [f"k{i}" for i in range(KEYS)]
_ORDERS = np.random.default_rng(5).integers(1, 2**62, KEYS * KEY_MINIMA, np.uint64) * np.uint64(2) + np.uint64(1)
#: Candidates of one group that a task compares at a time, and cells of the largest matrix of texts by shingles.
CHUNK, CELLS = 512, 4_000_000


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 128-bit hashes of a text's shingles: rows of two words."""
    digest, parts = xxhash.xxh3_128_digest, shingle_bytes(text, width)
    h = np.frombuffer(b"".join([digest(x, 1) for x in set(parts)]), np.uint64).reshape(-1, 2)
    return h[np.lexsort((h[:, 1], h[:, 0]))]


def wide_fingerprint(h: np.ndarray) -> tuple[bytes, np.ndarray]:
    """256 bits and KEYS tile keys of distinct shingles."""
    counts, least = np.zeros(256, np.int64), np.full(len(_ORDERS), np.uint64(2**64 - 1))
    for i in range(0, len(h), 8192):
        x = h[i : i + 8192]
        more = (x ^ x >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)  # the other 128 bits: mixed again, each word with the other one's turn
        wide = np.concatenate([x, more[:, ::-1] ^ more >> np.uint64(32)], axis=1)
        counts += np.unpackbits(wide.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint32)
        for k, odd in enumerate(_ORDERS):
            y = x[:, 0] * odd
            least[k] = min(least[k], (y ^ y >> np.uint64(32)).min())
    mixed = least.reshape(KEYS, KEY_MINIMA) * np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)[:KEY_MINIMA]
    return np.packbits(counts * 2 > len(h)).tobytes(), np.bitwise_xor.reduce(mixed, axis=1)


def _set_digest(h: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(h.tobytes(), 9)


#: A set of shingles is named by 128 bits of it.
SET = ["s0", "s1"]


def wide_fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, k, s0, s1, f0 to f3, k0 to k9) of docs (doc_id, k, text)."""
    names = ["doc_id", "k", *SET, *WIDE, *TILE_KEYS]

    def run(batches):
        for b in batches:
            sets, bits, keys = [], [], []
            for t in b["text"].to_pylist():
                h = shingle_hashes(t)
                f, k = wide_fingerprint(h)
                sets.append(_set_digest(h))
                bits.append(f)
                keys.append(k)
            columns = [np.frombuffer(b"".join(sets), np.int64).reshape(-1, 2), np.frombuffer(b"".join(bits), np.int64).reshape(-1, 4), np.array(keys, np.uint64).view(np.int64).reshape(-1, KEYS)]
            flat = [pa.array(np.ascontiguousarray(c)) for x in columns for c in x.T]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["k"], *flat], names)

    return docs.select("doc_id", "k", "text").mapInArrow(run, ", ".join(f"{n} long" for n in names))


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, grp, f0 to f3, hashes) from docs (text, node, grp, s0, s1, f0 to f3): the sorted shingle hashes of those texts that have the wanted set."""
    names = ["node", "grp", *WIDE]

    def run(batches):
        seen: set[int] = set()  # rows that repeat id and text
        for b in batches:
            nodes = b["node"].to_pylist()
            wanted = np.stack([b[c].to_numpy() for c in SET], axis=1)
            for i, j in common.by_bytes(list(range(len(b))), [len(t or "") for t in b["text"].to_pylist()], 4 << 20):
                sets = [shingle_hashes(t) for t in b["text"].slice(i, j - i).to_pylist()]
                at = [r for r, h in enumerate(sets) if nodes[i + r] not in seen and _set_digest(h) == wanted[i + r].tobytes()]
                seen.update(nodes[i + r] for r in at)
                take = pa.array(np.array(at, np.int64) + i)
                yield pa.RecordBatch.from_arrays([*(b[c].take(take) for c in names), pa.array([sets[r].tobytes() for r in at], pa.binary())], [*names, "hashes"])

    return docs.select("text", *SET, *names).mapInArrow(run, ", ".join(f"{n} long" for n in names) + ", hashes binary")


def similar_sets(fp: np.ndarray, sets: list[np.ndarray], label: np.ndarray) -> np.ndarray:
    """Smallest index that links of similarity SIMILAR reach, among texts of one group; texts with one label are tied beforehand.

    Pairs of different labels within the radius are candidates. Shared shingles are counted by products of the texts' incidence matrix, a stretch of shingles at a time.
    """
    n, size = len(fp), np.array([len(h) for h in sets])
    first = np.unique(label, return_inverse=True)[1]
    base = np.full(n, n)
    np.minimum.at(base, first, np.arange(n))
    start = forest(n, np.arange(n), base[first])
    near = np.zeros((n, n), bool)
    for i in range(0, n, 64):
        near[i : i + 64] = sum(np.bitwise_count(fp[i : i + 64, None, w] ^ fp[None, :, w]).astype(np.int16) for w in range(fp.shape[1])) <= WIDE_RADIUS
    near &= (start[:, None] != start[None]) & (np.minimum.outer(size, size) >= SIMILAR * np.maximum.outer(size, size))
    use = np.flatnonzero(near.any(axis=1))
    if not len(use):
        return start
    owner = np.repeat(np.arange(len(use)), size[use])
    every = np.concatenate([sets[i] for i in use])
    order = np.lexsort((every[:, 1], every[:, 0]))
    new = np.r_[True, (every[order][1:] != every[order][:-1]).any(axis=1)]
    number = np.cumsum(new) - 1
    times = np.bincount(number)
    keep = times[number] > 1
    column, row = (np.cumsum(times > 1) - 1)[number[keep]], owner[order][keep]
    shared, step = np.zeros((len(use), len(use)), np.float32), max(1, CELLS // len(use))
    for c in range(0, int(column.max(initial=-1)) + 1, step):
        a, b = np.searchsorted(column, [c, c + step])
        part = np.zeros((len(use), step), np.float32)
        part[row[a:b], column[a:b] - c] = 1
        shared += part @ part.T
    total = size[use][:, None] + size[use][None] - shared
    x, y = np.nonzero(near[np.ix_(use, use)] & (shared >= SIMILAR * total - 1e-6))
    return forest(n, np.r_[np.arange(n), use[x]], np.r_[start, use[y]])


def _edges_of(group: pa.Table, cut: list[str]) -> pa.Table:
    """Links inside each value of the columns `cut` of a table (cut, node, label, f0 to f3, hashes)."""
    keys, fp, node, label = np.stack([group[c].to_numpy() for c in cut], axis=1), _words(group, WIDE), group["node"].to_numpy(), group["label"].to_numpy()
    order = np.lexsort(keys.T[::-1])
    ends = np.flatnonzero(np.r_[(keys[order][1:] != keys[order][:-1]).any(axis=1), True]) + 1
    hashes, a, b = group["hashes"], [], []
    for i, j in zip(np.r_[0, ends[:-1]], ends, strict=True):
        at = order[i:j]
        if len(at) > 1:
            low = similar_sets(fp[at], [np.frombuffer(hashes[int(r)].as_py(), np.uint64).reshape(-1, 2) for r in at], label[at])
            moved = np.flatnonzero(low != np.arange(len(at)))
            a.append(node[at[moved]])
            b.append(node[at[low[moved]]])
    none = np.zeros(0, np.int64)
    return pa.table({"a": np.concatenate([none, *a]), "b": np.concatenate([none, *b])})


def verified_links(members: DataFrame) -> DataFrame:
    """Edges (a, b) that span all links of SIMILAR among the texts of each group grp; members is a stored table (node, grp, f0 to f3, hashes).

    A group above CHUNK texts is cut by hash. Its chunks are compared inside, then the first texts of what was found there; where the group has
    not become one by then, all texts outside its largest part meet every chunk. So groups of true copies cost one comparison a text, and others are compared whole.
    """
    sizes = common.stored(members.groupBy("grp").agg(F.count("*").alias("times")).withColumn("chunks", F.ceil(F.col("times") / CHUNK).cast("int")), "group-sizes")
    cut = lambda chunks: F.pmod(F.xxhash64("node"), chunks).cast("int")
    dealt = common.join_repeated(members, sizes, "grp").withColumn("chunk", cut(F.col("chunks")))
    bins = max(1, math.ceil(members.count() / (2 * CHUNK)))
    by_bin = dealt.withColumn("label", F.col("node")).withColumn("bin", F.pmod(F.xxhash64("grp", "chunk"), F.lit(bins)))
    edges = common.stored(by_bin.groupBy("bin").applyInArrow(lambda g: _edges_of(g, ["grp", "chunk"]), "a long, b long"), "verified")
    large = sizes.filter("chunks > 1")
    if not large.limit(1).count():
        return edges
    rest = common.stored(common.join_repeated(members, large, "grp").drop("times"), "large-groups")

    def labelled(edges: DataFrame) -> DataFrame:
        return rest.join(common.components(edges), "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")

    heads = common.stored(labelled(edges).filter("label = node"), "heads")
    parts = common.stored(heads.groupBy("grp").agg(F.count("*").alias("times")).withColumn("parts", F.ceil(F.col("times") / CHUNK).cast("int")), "head-parts")
    heads = common.join_repeated(heads, parts, "grp").withColumn("chunk", cut(F.col("parts")))
    more = heads.groupBy("grp", "chunk").applyInArrow(lambda g: _edges_of(g, ["grp", "chunk"]), "a long, b long")
    edges = common.stored(edges.union(more), "verified")
    now = common.stored(labelled(edges), "labelled")
    outer = F.ceil((F.sum("n") - F.max("n")) / CHUNK).cast("int").alias("outer")  # parts of the texts outside the largest part
    counts = now.groupBy("grp", "label").agg(F.count("*").alias("n")).groupBy("grp").agg(F.max_by("label", "n").alias("main"), F.count("*").alias("labels"), F.sum("n").alias("times"), outer)
    open_groups = common.stored(counts.filter("labels > 1"), "open-groups")
    if not open_groups.limit(1).count():
        return edges
    left = common.join_repeated(now, open_groups, "grp").withColumn("chunk", cut(F.col("chunks")))
    outside = left.filter("label <> main")
    chunks = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    columns = ["grp", "chunk", "part", "node", "label", *WIDE, "hashes"]
    here = left.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("outer") - 1))).select(*columns)
    visitors = outside.withColumnRenamed("chunk", "own").withColumn("part", cut(F.col("outer"))).withColumn("chunk", chunks).filter("chunk <> own").select(*columns)
    across = here.union(visitors).groupBy("grp", "chunk", "part").applyInArrow(lambda g: _edges_of(g, ["grp", "chunk", "part"]), "a long, b long")
    return common.stored(edges.union(across), "verified")


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Tells rows of one id with different texts apart."""
    return F.xxhash64(F.col(doc_id).cast("long"), text)


def near_copies(docs: DataFrame) -> DataFrame:
    """(doc_id, k, component_id, first) of every row: k is its row_key(), first tells whether no smaller (doc_id, k) is in its component; null ids go last.

    Texts with equal sets of shingles are one point. Candidates are linked by wide fingerprints and stay linked only where the sets of
    five-word shingles themselves share SIMILAR.
    """
    keyed = docs.select(F.col("doc_id").cast("long"), "text", row_key().alias("k"))
    prints = common.stored(wide_fingerprints(keyed), "wide-fingerprints")
    at = F.struct(F.col("doc_id").isNull().alias("null_id"), "doc_id", "k")
    same = prints.groupBy(*SET, *WIDE, *TILE_KEYS).agg(F.min(at).alias("least"), F.min("k").alias("text_key"), F.count("*").alias("rows"))
    points = common.stored(same.withColumn("node", F.monotonically_increasing_id()), "wide-points")
    near = common.components(links(points, WIDE_RADIUS, [F.col(k) for k in TILE_KEYS], WIDE))
    wanted = points.join(near, "node").select("text_key", "node", F.col("component").alias("grp"), *SET, *WIDE)
    members = common.stored(shingle_sets(keyed.join(wanted, F.col("k") == F.col("text_key"))), "shingle-sets")
    found = common.components(verified_links(members))
    placed = common.stored(points.join(found, "node", "left").select(*SET, "least", "rows", F.coalesce("component", "node").alias("component")), "placed")
    least = common.stored(placed.groupBy("component").agg(F.min("least").alias("least"), F.count("*").alias("times")), "component-ids")
    named = common.stored(common.join_repeated(placed.drop("least"), least, "component").select(*SET, "least", F.col("rows").alias("times")), "point-ids")
    return common.join_repeated(prints, named, SET).select("doc_id", "k", F.col("least.doc_id").alias("component_id"), at.eqNullSafe(F.col("least")).alias("first"))


def op10(spark, sf_dir: str) -> DataFrame:
    found = near_duplicates(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")

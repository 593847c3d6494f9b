"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

Each source's documents are cut into blocks. Weights are whole numbers w with sum W, after division by their greatest common divisor, and a cycle
has W slots, one block a slot. The i-th block of a source may run from slot floor(i W / w) and must
run before slot ceil((i + 1) W / w); among the released blocks the one with the earliest deadline goes first
(ties: the source's rank). All deadlines hold, so at any slot each source has had less than one
block more or less than its target. The schedule of a cycle repeats; a source that has run out leaves its slots empty.

Given weights are kept exactly (fractions to 18 decimal places) as long as their cycle has at most CYCLE slots; beyond, they are rounded to
about CYCLE slots, at least one for each weight over 0. Without given weights, a source's target weight is the square root of its rows, in whole
SLOTS-ths of the sum of all, one at least.

Inside a source the order is that of the md5 of the id, cut into BUCKETS ranges: a document's place is the number of
documents in lower ranges plus its place in its own, so that no source is ordered in one task.

Defined cases: a null source is a source of its own, the last; rows that repeat an id keep a place each, ties by nothing but the engine's order
where whole rows are equal; null texts stay; a source with weight 0, without a given weight, or with one that is negative or no number gets no
slot: its documents stay, with null slot and place; of several weights for a source the largest counts; an infinite weight or one of 1e18 or more raises; an empty table gives
an empty result; other columns pass unchanged, whatever their names, but those named as the added ones (slot, place, source_block) are replaced. The cycle
is computed in one row, in time that grows with slots times sources; it is meant for a few thousand sources at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.types import IntegralType

from . import common

#: Slots of a cycle without given weights, about; slots of the longest cycle; documents of a block; ranges of a source's order.
SLOTS, CYCLE, BLOCK, BUCKETS = 1000, 200_000, 16, 4096

#: The schedule: s.ran holds the blocks that each source has run, s.out the sources of past slots, some hundred slots an array.
_SCHEDULE = """
aggregate(
    sequence(0L, (cycle - 1) div 500),
    named_struct('ran', transform(shares, x -> 0L), 'out', CAST(array() AS ARRAY<ARRAY<INT>>)),
    (s, part) -> transform(array(aggregate(
        sequence(part * 500, least(cycle, (part + 1) * 500) - 1),
        named_struct('ran', s.ran, 'out', CAST(array() AS ARRAY<INT>)),
        (r, t) -> transform(
            array(array_min(filter(
                transform(shares, (q, i) -> IF(r.ran[i] < q AND (r.ran[i] * cycle) div q <= t,
                    named_struct('deadline', ((r.ran[i] + 1) * cycle + q - 1) div q, 'source', i), NULL)),
                x -> x IS NOT NULL))),
            best -> named_struct('ran', transform(r.ran, (n, i) -> IF(i = best.source, n + 1, n)), 'out', array_append(r.out, best.source))
        )[0]
    )), r -> named_struct('ran', r.ran, 'out', array_append(s.out, r.out)))[0],
    s -> flatten(s.out)
)
"""
_WHOLE = "DECIMAL(38,0)"
#: Euclid's steps for numbers of 38 digits are fewer than 190.
_DIVISOR = f"""
aggregate(s, CAST(0 AS {_WHOLE}), (g, x) -> aggregate(
    sequence(1, 190), named_struct('a', g, 'b', x.weight),
    (e, i) -> IF(e.b = 0, e, named_struct('a', e.b, 'b', CAST(e.a % e.b AS {_WHOLE}))), e -> e.a))
"""


def shares(docs: DataFrame, weights: DataFrame | None = None, slots: int = SLOTS) -> DataFrame:
    """(source, rank, q): slots of a cycle for each source, from weights (source, weight) or the square roots of the sources' rows."""
    counts = docs.groupBy("source").agg(F.count("*").alias("n"))
    rank = lambda df: df.withColumn("rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)  # noqa: E731, a row for each source
    if weights is None:
        sized = counts.withColumn("weight", F.floor(F.sqrt("n")).cast("long")).withColumn("total", F.greatest(F.sum("weight").over(W.partitionBy()), F.lit(1)))
        q = F.greatest(F.lit(1), F.expr(f"(2 * {slots} * weight + total) div (2 * total)")).cast("long")
        return rank(sized).select("source", "rank", q.alias("q"))
    weight = F.col("weight")
    if not isinstance(weights.schema["weight"].dataType, IntegralType):
        weights = weights.filter(~F.isnan(weight.cast("double")))
        weight = weight.cast("decimal(38,18)") * F.lit(10**18).cast("decimal(19,0)")
    given = weights.groupBy(F.col("source").alias("w_source")).agg(F.greatest(F.max(weight.cast(_WHOLE)), F.lit(0).cast(_WHOLE)).alias("weight"))
    known = counts.join(given, F.col("source").eqNullSafe(F.col("w_source"))).filter("weight > 0")
    one = known.agg(F.array_sort(F.collect_list(F.struct(F.col("source").isNull().alias("last"), "source", F.col("weight").cast(_WHOLE).alias("weight")))).alias("s"))
    summed = one.withColumns({"divisor": F.expr(_DIVISOR), "total": F.expr(f"aggregate(s, CAST(0 AS {_WHOLE}), (a, x) -> CAST(a + x.weight AS {_WHOLE}))")})
    q = f"IF(total <= divisor * {CYCLE}, x.weight div divisor, greatest(1L, CAST(floor(CAST(x.weight AS DOUBLE) * {CYCLE} / CAST(total AS DOUBLE) + 0.5D) AS BIGINT)))"
    return summed.select(F.posexplode(F.expr(f"transform(s, x -> named_struct('source', x.source, 'q', {q}))")).alias("rank", "x")).select("x.source", "rank", "x.q")


def schedule(shared: DataFrame) -> DataFrame:
    """(source, i, q, cycle, cycle_slot): the slot of each source's i-th block in a cycle."""
    one = shared.agg(F.array_sort(F.collect_list(F.struct("rank", "source", "q"))).alias("sources")).filter(F.size("sources") > 0)
    planned = one.select("sources", F.expr("transform(sources, x -> x.q)").alias("shares")).withColumn("cycle", F.expr("aggregate(shares, 0L, (a, x) -> a + x)"))
    out = planned.select("sources", "cycle", F.posexplode(F.expr(_SCHEDULE)).alias("cycle_slot", "rank"))
    named = out.select("cycle", F.col("cycle_slot").cast("long"), F.expr("sources[rank]").alias("s"))
    return named.select(
        F.col("s.source").alias("source"), "cycle", F.col("s.q").alias("q"), "cycle_slot",
        (F.row_number().over(W.partitionBy("s.rank").orderBy("cycle_slot")) - 1).alias("i"),
    )


def mixed(docs: DataFrame, weights: DataFrame | None = None, block: int = BLOCK, slots: int = SLOTS) -> DataFrame:
    """docs with source_block (of its source, from 0), slot (its block's in the mixture) and place (the document's)."""
    docs = docs.drop("source_block", "slot", "place")
    h = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    keyed = docs.select(F.struct("*").alias("row"), "source", "doc_id", h.alias("h")).withColumn("bucket", F.conv(F.substring("h", 1, 3), 16, 10).cast("int"))
    sizes = keyed.groupBy("source", "bucket").agg(F.count("*").alias("n"))
    plan = common.stored(schedule(shares(docs, weights, slots)), "mix-plan")  # a row for each slot: CYCLE + sources at most
    per_source = plan.groupBy(F.col("source").alias("p_source")).agg(F.max("q").alias("q"), F.max("cycle").alias("cycle"))
    before = sizes.withColumn("before", F.sum("n").over(W.partitionBy("source").orderBy("bucket")) - F.col("n"))
    lead = before.join(F.broadcast(per_source), F.col("source").eqNullSafe(F.col("p_source")), "left").select(F.col("source").alias("l_source"), F.col("bucket").alias("l_bucket"), "before", "q", "cycle")
    place = F.row_number().over(W.partitionBy("source", "bucket").orderBy("h", "doc_id")) - 1
    placed = (
        keyed.join(lead, F.col("source").eqNullSafe(F.col("l_source")) & (F.col("bucket") == F.col("l_bucket")))
        .withColumn("rank", place + F.col("before"))
        .withColumn("source_block", F.expr(f"rank div {block}"))
    )
    slots_of = F.broadcast(plan.select(F.col("source").alias("s_source"), F.col("i").cast("long").alias("i"), "cycle_slot"))
    out = placed.join(slots_of, F.col("source").eqNullSafe(F.col("s_source")) & (F.pmod("source_block", "q") == F.col("i")), "left")
    slot = F.expr("(source_block div q) * cycle + cycle_slot")
    return out.withColumn("slot", slot).withColumn("place", F.expr(f"slot * {block} + rank % {block}")).select("row.*", "source_block", "slot", "place")


def op7(spark, sf_dir: str) -> DataFrame:
    return mixed(common.table(spark, sf_dir, "documents").select("doc_id", "source"))


ORACLE = f"""
WITH RECURSIVE counts AS (
    SELECT source, count(*) AS n, CAST(floor(sqrt(count(*))) AS BIGINT) AS weight FROM documents GROUP BY source
), shared AS (
    SELECT source, CAST(row_number() OVER (ORDER BY source ASC NULLS LAST) AS INTEGER) AS rank,
           greatest(1, (2 * {SLOTS} * weight + t) // (2 * t))::BIGINT AS q
    FROM counts, (SELECT greatest(sum(weight), 1)::BIGINT AS t FROM counts)
), lists AS (
    SELECT list(q ORDER BY rank) AS q, sum(q)::BIGINT AS cycle FROM shared
), run(slot, ran, chosen) AS (
    SELECT -1::BIGINT, list_transform(q, lambda x: 0::BIGINT), 0::BIGINT FROM lists
    UNION ALL
    SELECT slot, list_transform(range(1, len(ran) + 1), lambda i: CASE WHEN i = best THEN ran[i] + 1 ELSE ran[i] END), best
    FROM (
        SELECT slot + 1 AS slot, ran, list_min(list_filter(list_transform(range(1, len(q) + 1), lambda i:
            CASE WHEN ran[i] < q[i] AND (ran[i] * cycle) // q[i] <= slot + 1
                 THEN {{'deadline': ((ran[i] + 1) * cycle + q[i] - 1) // q[i], 'source': i}} END), lambda x: x IS NOT NULL)).source AS best
        FROM run, lists WHERE slot + 1 < cycle
    )
), plan AS (
    SELECT chosen, slot, row_number() OVER (PARTITION BY chosen ORDER BY slot) - 1 AS i FROM run WHERE slot >= 0
), placed AS (
    SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY md5(coalesce(CAST(doc_id AS VARCHAR), '')), doc_id) - 1 AS r FROM documents
)
SELECT doc_id, p.source, r // {BLOCK} AS source_block,
       ((r // {BLOCK}) // s.q) * cycle + plan.slot AS slot,
       (((r // {BLOCK}) // s.q) * cycle + plan.slot) * {BLOCK} + r % {BLOCK} AS place
FROM placed p JOIN shared s ON p.source IS NOT DISTINCT FROM s.source CROSS JOIN lists
JOIN plan ON plan.chosen = s.rank AND plan.i = (r // {BLOCK}) % s.q
"""

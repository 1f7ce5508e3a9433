"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grantlens.llm.common import words, written

#: Hash bits, and bits that one histogram resolves.
HASH_BITS, STEP_BITS = 60, 12
#: A source is taken at most so many times.
MOST_PASSES = 3
WEIGHTS = (1, 2, 3)


def row_hash(doc_id) -> F.Column:
    """60 evenly spread bits of an id, the same on every run."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, target) from one row (source, source_size) per source.

    Sources by code point, null last, weigh `weights` in turn and share the whole. A target stops at
    `most` times its source; the excess goes to the others by weight. That ends where every target is
    the smaller of its cap and weight x level, for the one level that uses up the whole; the level
    is the largest of those got by capping the first k sources in order of cap / weight.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    rows = sizes.select("source", "source_size", weight.cast("long").alias("weight"), F.row_number().over(order).alias("place"))
    rows = rows.withColumn("cap", F.col("source_size") * most)
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    capped = F.coalesce(F.sum("cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    open_weight = F.sum("weight").over(by_cap.rowsBetween(0, Window.unboundedFollowing))
    level = (F.sum("source_size").over(Window.partitionBy()) - capped) / open_weight
    rows = rows.withColumn("level", level)
    level = F.max("level").over(Window.partitionBy())
    return rows.select("source", "source_size", F.least(F.col("cap").cast("double"), level * F.col("weight")).alias("target"))


def mix_plan(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_PASSES) -> DataFrame:
    """(source, source_size, target, passes, edge, edge_in) from rows (source, size, h).

    A source is taken whole `passes` times, and once more its rows with hash below `edge` (those at
    the edge itself where `edge_in`). The edge comes from histograms of words by source and hash
    bucket: the first covers all rows, each further one only the bucket that the budget falls into,
    until that holds a single hash value. Nothing is sorted, and budgets nest: a larger target keeps
    all that a smaller one takes. Of the row at the edge the nearer side to the target is chosen.
    """
    sizes = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    plan = source_targets(sizes, weights, most)
    passes = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("passes", passes).withColumn("rest", F.col("target") - F.col("passes") * F.col("source_size"))
    plan = written(plan, "mix-plan")
    found, at = None, plan.filter("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"))
    for shift in range(HASH_BITS - STEP_BITS, -1, -STEP_BITS):
        at = at.withColumnRenamed("source", "of")
        inside = F.col("source").eqNullSafe(F.col("of")) & (F.shiftright("h", shift + STEP_BITS) == F.col("prefix"))
        bars = sized.join(at, inside).groupBy("source", "rest", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("s"), F.min("h").alias("low"), F.max("h").alias("high"))
        run = Window.partitionBy("source").orderBy("bucket")
        bars = bars.withColumn("upto", F.sum("s").over(run)).filter((F.col("upto") >= F.col("rest")) & (F.col("upto") - F.col("s") < F.col("rest")))
        bars = written(bars, "mix-edge")
        single = F.col("low") == F.col("high")
        ends = bars.filter(single).select(
            F.col("source").alias("of"), F.col("low").alias("edge"), (F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("s"))).alias("edge_in"))
        found = ends if found is None else found.union(ends)
        more = bars.filter(~single)
        if more.isEmpty():
            break
        at = more.select("source", (F.col("rest") - (F.col("upto") - F.col("s"))).alias("rest"), F.col("bucket").alias("prefix"))
    return plan.join(found, F.col("source").eqNullSafe(F.col("of")), "left").select(
        "source", "source_size", "target", "passes", F.coalesce("edge", F.lit(-1)).alias("edge"), F.coalesce("edge_in", F.lit(False)).alias("edge_in"))


def with_repeats(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Every row with its source's size and target and `repeats`, how often the mix takes it. `rows` carry source and h."""
    plan = plan.select(F.col("source").alias("of"), *[F.col(c).alias(f"mix_{c}") for c in ("source_size", "target", "passes", "edge", "edge_in")])
    extra = (F.col("h") < F.col("mix_edge")) | ((F.col("h") == F.col("mix_edge")) & F.col("mix_edge_in"))
    return rows.join(plan, F.col("source").eqNullSafe(F.col("of"))).withColumn("repeats", F.col("mix_passes") + extra.cast("long"))


def mix(docs: DataFrame) -> DataFrame:
    """Per document doc_id, size, source_size, target and taken (words, repeats counted).

    Null text has size 0, null source is a source of its own, null ids share a hash value, rows of
    one id are taken or left together. An empty table gives no rows.
    """
    sized = written(docs.select("doc_id", "source", words(F.col("text")).alias("size"), row_hash(F.col("doc_id")).alias("h")), "mix-rows")
    rows = with_repeats(sized, mix_plan(sized))
    return rows.select("doc_id", "size", F.col("mix_source_size").alias("source_size"), F.col("mix_target").alias("target"), (F.col("size") * F.col("repeats")).alias("taken"))


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The documents of the mix, with the columns of `docs`; one row for each time that a document is taken."""
    sized = written(docs.select("doc_id", "source", words(F.col("text")).alias("size"), row_hash(F.col("doc_id")).alias("h")), "mix-rows")
    plan = written(mix_plan(sized), "mix-plan")
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), "source", row_hash(F.col("doc_id")).alias("h"))
    rows = with_repeats(keyed, plan).filter("repeats > 0")
    return rows.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats"))).alias("turn")).select("row.*")


SQL = r"""
with sized as (select doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as bigint) as size,
    cast('0x' || left(md5(coalesce(cast(doc_id as varchar), '')), 15) as bigint) as h from documents),
sources as (select source, cast(sum(size) as bigint) as source_size, (row_number() over (order by encode(source) nulls last) - 1) % 3 + 1 as weight,
    row_number() over (order by encode(source) nulls last) as place from sized group by source),
leveled as (select *, (sum(source_size) over () - coalesce(sum(source_size * 3) over (order by source_size * 3 / weight, place rows between unbounded preceding and 1 preceding), 0))
    / sum(weight) over (order by source_size * 3 / weight, place rows between current row and unbounded following) as lev from sources),
targets as (select source, source_size, least(cast(source_size * 3 as double), max(cast(lev as double)) over () * weight) as target from leveled),
passes as (select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as n from targets),
hashed as (select s.source, s.h, sum(s.size) as s, sum(sum(s.size)) over (partition by s.source order by s.h) as upto from sized s group by s.source, s.h),
taken as (select h.source, h.h, p.n + case when h.upto <= p.target - p.n * p.source_size then 1
    when h.upto - h.s < p.target - p.n * p.source_size and h.upto - (p.target - p.n * p.source_size) < (p.target - p.n * p.source_size) - (h.upto - h.s) then 1 else 0 end as times,
    p.source_size, p.target from hashed h join passes p on h.source is not distinct from p.source)
select d.doc_id, d.size, t.source_size, t.target, cast(d.size * t.times as bigint) as taken
from sized d join taken t on d.source is not distinct from t.source and d.h = t.h
"""

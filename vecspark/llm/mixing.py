"""Mixing sources to target weights by weighted fair queueing, in DataFrame operations only.

Each source queues its documents in a shuffled order (the MD5 of id and text).
A document's virtual finish time is the number of words its source has queued
up to and including it, over the source's target.  A second copy of the whole
queue follows the first, since a source may be repeated.  All queues are put in
one order by finish time and cut where the total budget is spent.

What is taken of a source is a prefix of its queue, so the mix is described by
one key per source and copy.  These few keys, not the texts, meet the documents.

Running sums over rows never stand in one task: the shuffled key is cut into
buckets by its leading hex digits, the buckets' sums are added up first, and
each bucket then counts from its own start.  A source with a third of all rows
is spread over all of its buckets.  The buckets' own running sums go the same
way, over groups of buckets first, and so does the search for the place where
the budget is spent; the longest run that one task adds up grows with the third
root of the rows.  Only the sources themselves, few by nature, are put in order
in one task.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import documents, n_words, packed, small, stage, unpacked

#: Rows that a bucket of a source's queue should hold at most, about.
BUCKET_ROWS = 2048


def _queue_key(docs: DataFrame) -> Column:
    return F.md5(F.concat(F.coalesce(docs["doc_id"].cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(docs["text"], F.lit("")).cast("binary"))).cast("binary"))


def targets(sources: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """Words to take of each source: ``source, source_size, rank, target``.

    ``sources`` has ``source, source_size``.  In code point order, null last,
    the sources weigh ``weights``, repeated as often as needed.  They share
    ``share`` times all words; none gets more than ``repeats`` times its own
    words, and what is left over goes to the others by weight.  With the
    sources in order of size over weight, those that stop at their limit come
    first, so one running sum finds the water level of the rest.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    level = Window.orderBy("ratio", "rank")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    known = (
        sources.withColumn("rank", F.row_number().over(order) - 1)
        .withColumn("weight", w)
        .withColumn("most", F.col("source_size") * F.lit(float(repeats)))
        .withColumn("ratio", F.col("most") / F.col("weight"))
        .withColumn("budget", F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)))
        .withColumn("before", F.sum("most").over(level.rowsBetween(Window.unboundedPreceding, 0)) - F.col("most"))
        .withColumn("rest", F.sum("weight").over(level.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", (F.col("budget") - F.col("before")) / F.col("rest"))
    )
    water = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "rank", "level"))).over(Window.partitionBy())
    return known.withColumn("water", water["level"]).select(
        "source", "source_size", "rank",
        F.when(F.col("water").isNull() | (F.col("most") <= F.col("water") * F.col("weight")), F.col("most")).otherwise(F.col("water") * F.col("weight")).alias("target"),
    )


def _starts(sums: DataFrame, by: str, key: str, size: str, levels: list[int]) -> DataFrame:
    """``sums`` with ``start``, what lies before each row within ``by`` in order of the string ``key``.

    ``levels`` are lengths of prefixes of the key, short ones first; running
    sums stay within one prefix.
    """
    total = None
    for short, long in zip([0, *levels], [*levels, None]):
        name = F.col(key) if long is None else F.substring(key, 1, long)
        rows = sums.groupBy(by, name.alias("_at")).agg(F.sum(size).alias("_size"))
        run = Window.partitionBy(by, "_in").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("_in", F.substring("_at", 1, short)).withColumn("_start", F.sum("_size").over(run) - F.col("_size"))
        if total is not None:
            above = total.withColumnsRenamed({by: "_by", "_at": "_above", "_start": "_more"})
            rows = rows.join(above, rows[by].eqNullSafe(F.col("_by")) & (F.col("_in") == F.col("_above"))).withColumn("_start", F.col("_start") + F.col("_more"))
        total = rows.select(by, "_at", "_start")
    return total.withColumnsRenamed({"_at": key, "_start": "start"})


def _spent(places: DataFrame, fan: int, budget: float) -> tuple[int, int] | None:
    """The slice in which the budget is spent, and the words before it; none if it lasts.

    Groups of ``fan`` times ``fan`` slices are searched first, then groups of
    ``fan``, then slices, each time within the one where the sum goes over.
    """
    sums, before, at = stage(places.groupBy("slice").agg(F.sum("size").alias("words")), "mix-slices", few=True), 0, None
    for step in (fan * fan, fan, 1):
        rows = sums if at is None else sums.where((F.col("slice") >= at) & (F.col("slice") < at + step * fan))
        rows = rows.groupBy((F.floor(F.col("slice") / step) * step).alias("slice")).agg(F.sum("words").alias("words"))
        run = Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)  # one group: about the third root of all slices
        over = rows.withColumn("spent", F.sum("words").over(run) + F.lit(before)).where(F.col("spent") > F.lit(budget)).orderBy("slice").select("slice", F.col("spent") - F.col("words")).first()
        if over is None:
            return None
        at, before = over[0], over[1]
    return at, before


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), share: float = 1.5, repeats: int = 2) -> DataFrame:
    """The documents with ``size``, ``source_size``, ``target`` and ``copies``.

    ``docs`` needs ``doc_id``, ``source`` and ``text``; other columns stay as
    they are, except that ones named like the four new columns are replaced.
    ``copies`` (0 to ``repeats``) is how often the mix takes the document.

    Null and empty texts have size 0 and are never taken.  A null source is a
    source of its own, null ids are ordinary ids.  Rows with equal id and text
    are in the same place of a queue, and are taken alike.  An empty table
    gives an empty result.
    """
    columns, docs = docs.columns, packed(docs, "doc_id", "source", "text")
    queued = stage(docs.select("source", n_words(docs["text"]).alias("size"), _queue_key(docs).alias("key")), "mix-queue")
    rows = queued.count()
    digits = max(1, math.ceil(math.log(max(rows, 1) / BUCKET_ROWS, 16)))

    bucket = F.substring("key", 1, digits)
    summed = queued.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("bucket_size"))
    sources = summed.groupBy("source").agg(F.sum("bucket_size").alias("source_size"))
    goal = stage(targets(sources, weights, share, repeats), "mix-targets", few=True)
    levels = sorted({k for k in (digits // 3, 2 * digits // 3) if 0 < k < digits})
    starts = _starts(summed, "source", "bucket", "bucket_size", levels)
    starts = starts.join(small(goal).withColumnRenamed("source", "goal_source"), F.col("source").eqNullSafe(F.col("goal_source"))).drop("goal_source")
    starts = stage(starts, "mix-starts", few=True).withColumnsRenamed({"source": "start_source", "bucket": "start_bucket"})

    #: one row for each place of a queue, with its running sum
    run = Window.partitionBy("source", "bucket").orderBy("key").rowsBetween(Window.unboundedPreceding, 0)
    places = queued.where("size > 0").withColumn("bucket", bucket).withColumn("up_to", F.sum("size").over(run))
    places = places.join(small(starts), F.col("source").eqNullSafe(F.col("start_source")) & (F.col("bucket") == F.col("start_bucket")))
    places = places.select(
        "rank", "key", "size",
        F.explode(F.transform(F.sequence(F.lit(0), F.lit(repeats - 1)), lambda c: F.struct(c.alias("copy"), ((F.col("up_to") + F.col("start") + c * F.col("source_size")) / F.col("target")).alias("finish")))).alias("turn"),
    ).select(F.struct("turn.finish", "rank", "turn.copy", "key").alias("at"), "size")

    #: where the budget is spent: first the slice of finish times, then the place within it
    n_slices = max(16, math.ceil(rows * repeats / BUCKET_ROWS))
    slice_of = F.least(F.floor(F.col("at.finish") * n_slices), F.lit(2 * n_slices)).cast("long")
    places = places.withColumn("slice", slice_of)
    budget = goal.agg(F.sum("source_size") * F.lit(float(share))).first()[0] or 0.0
    first = _spent(places, math.ceil((2 * n_slices + 1) ** (1 / 3)) + 1, budget)
    if first:
        within = places.where(F.col("slice") == first[0]).withColumn("spent", F.sum("size").over(Window.partitionBy("slice").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)) + F.lit(first[1]))
        last = within.where(F.col("spent") <= F.lit(budget)).agg(F.max("at")).first()[0]
        taken = F.col("slice") < F.lit(first[0])
        if last is not None:
            taken = taken | ((F.col("slice") == F.lit(first[0])) & (F.col("at") <= F.struct(*[F.lit(last[k]).alias(k) for k in ("finish", "rank", "copy", "key")])))
        places = places.where(taken)
    ends = places.groupBy(F.col("at.rank").alias("end_rank"), F.col("at.copy").alias("copy")).agg(F.max("at.key").alias("end"))
    ends = ends.groupBy("end_rank").agg(F.sort_array(F.collect_list("end")).alias("ends"))
    plan = goal.join(ends, goal["rank"] == ends["end_rank"], "left")
    plan = stage(plan.select(F.col("source").alias("plan_source"), "source_size", "target", F.coalesce("ends", F.array().cast("array<string>")).alias("plan_ends")), "mix-plan", few=True)

    out = docs.withColumn("size", n_words(docs["text"])).withColumn("plan_key", _queue_key(docs))
    out = out.join(small(plan), out["source"].eqNullSafe(F.col("plan_source")), "left")
    copies = F.when(F.col("size") > 0, F.size(F.filter("plan_ends", lambda e: e >= F.col("plan_key")))).otherwise(0)
    return unpacked(out.withColumn("copies", copies), columns, "size", "source_size", "target", "copies")


def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mix(documents(spark, sf_dir).select("doc_id", "source", "text"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).cast("long").alias("taken"))


OP10_SQL = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint size,
    md5(coalesce(doc_id::varchar, '') || ':' || md5(coalesce(text, ''))) as key from documents),
s as (select source, sum(size)::bigint source_size, row_number() over (order by source nulls last) - 1 as rank from d group by source),
w as (select *, [5.0::double, 2.0::double, 1.0::double][(rank % 3) + 1] as weight, source_size * 2.0::double as most,
  (sum(source_size) over ())::double * 1.5::double as budget from s),
r as (select *, most / weight as ratio from w),
l as (select *, (budget - (coalesce(sum(most) over (order by ratio, rank rows between unbounded preceding and 1 preceding), 0)))
  / (sum(weight) over (order by ratio, rank rows between current row and unbounded following)) as level from r),
water as (select level as water from l where level <= ratio order by ratio, rank limit 1),
t as (select source, source_size, rank, budget, case when water is null or most <= water * weight then most else water * weight end as target
  from l left join water on true),
q as (select d.*, t.source_size, t.rank, t.target, t.budget,
  sum(size) over (partition by t.rank order by key rows between unbounded preceding and current row)::bigint up_to
  from d join t on d.source is not distinct from t.source),
turns as (select doc_id, key, rank, size, budget, c as copy, ((up_to + c * source_size)::double / target) as finish from q, range(2) x(c) where size > 0),
o as (select *, sum(size) over (order by finish, rank, copy, key rows between unbounded preceding and current row) as spent from turns),
n as (select doc_id, key, count(*) as copies from o where spent <= budget group by doc_id, key)
select q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(n.copies, 0))::bigint as taken
from q left join n on q.doc_id = n.doc_id and q.key = n.key
"""

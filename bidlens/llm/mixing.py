"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (md5 of the id),
repeated up to ``max_repeats`` times.  A copy's virtual finish time is the
source's cumulative tokens up to and including it, divided by the source's
target.  The copies are range-sorted by finish time over all sources and
taken until the total budget is reached.

Only DataFrame functions run here.  The running sum inside a source is made
from blocks (source, first three hex digits of the md5): block totals are
summed over at most 4,096 rows per source, and the row-level window covers
one block, so a source with a third of all rows is spread over 4,096 keys.
The global sort never moves all rows: everything that finishes by time 1 is
inside the budget by construction (each source has then used its target at
most, and the targets add up to the budget); the rest is cut into 4,096
ranges of finish time, and only the range in which the budget ends is sorted.

Defined cases: a null text has size 0; a size of 0 is never taken; a null
source is a source of its own, last in the order; a null id is shuffled as
the text 'null'; rows that agree in id, source and size are one queue entry
(so all of them are taken equally often); an empty table gives an empty
result.  The source table (one row per source) passes through one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.llm.common import WORD, cut_lineage

RANGES = 4096


def word_count(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1),
                   max_repeats: int = 3) -> DataFrame:
    """(source, source_size) -> plus ``target``: the weighted share of all
    sizes, stopped at ``max_repeats`` times the source's size, the excess
    reshared by weight.  Closed form of the resharing: with the sources in
    order of cap/weight, the common level is set by the first source that the
    level of the sources from it on does not fill."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    capped = (sizes.withColumn("weight", w)
              .withColumn("cap", (F.col("source_size") * max_repeats).cast("double"))
              .withColumn("ratio", F.col("cap") / F.col("weight")))
    by_ratio = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, W.unboundedFollowing)
    whole = W.partitionBy()
    levels = (capped
              .withColumn("total", F.sum("source_size").over(whole).cast("double"))
              .withColumn("level", (F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
                          / F.sum("weight").over(after))
              .withColumn("level", F.max(F.when(F.col("level") <= F.col("ratio"), F.col("level")))
                          .over(whole)))
    return levels.select("source", "source_size", F.least(
        F.col("cap"), F.coalesce(F.col("level") * F.col("weight"), F.col("cap"))).alias("target"))


def mix_plan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
             source_col: str = "source", weights: Sequence[float] = (5, 2, 1),
             max_repeats: int = 3, salt: str = "mix:") -> tuple[DataFrame, DataFrame]:
    """Returns (rows, plan).  rows: one (doc_id, source, size) per input row.
    plan: one row per distinct (doc_id, source, size) with source_size,
    target and copies (0 to max_repeats)."""
    rows = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                                   word_count(text_col).alias("size")))
    key = F.md5(F.concat(F.lit(salt), F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
                .cast("binary"))
    units = (rows.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n"))
             .withColumn("unit", F.col("size") * F.col("n"))
             .withColumn("key", key).withColumn("block", F.substring("key", 1, 3)))
    units = cut_lineage(units)
    blocks = units.groupBy("source", "block").agg(F.sum("unit").alias("block_size"))
    ahead = W.partitionBy("source").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.select("source", "block",
                            F.coalesce(F.sum("block_size").over(ahead), F.lit(0)).alias("offset"))
    targets = source_targets(blocks.groupBy("source").agg(F.sum("block_size").alias("source_size")),
                             weights, max_repeats)
    offsets = cut_lineage(offsets.join(targets.withColumnRenamed("source", "__s"),
                                       F.col("source").eqNullSafe(F.col("__s"))).drop("__s"))
    inside = (W.partitionBy("source", "block").orderBy("key", "doc_id", "size")
              .rowsBetween(W.unboundedPreceding, 0))
    o = offsets.select(F.col("source").alias("__s"), F.col("block").alias("__b"),
                       "offset", "source_size", "target")
    queue = (units.withColumn("cum", F.sum("unit").over(inside))
             .join(o, F.col("source").eqNullSafe(F.col("__s")) & (F.col("block") == F.col("__b")))
             .withColumn("cum", F.col("cum") + F.col("offset")).drop("__s", "__b", "offset", "block", "n"))
    finish = F.transform(F.sequence(F.lit(0), F.lit(max_repeats - 1)), lambda k: F.when(
        (F.col("unit") > 0) & (F.col("target") > 0),
        (k * F.col("source_size") + F.col("cum")).cast("double") / F.col("target")))
    queue = cut_lineage(queue.withColumn("finish", finish))

    def range_of(t: Column) -> Column:
        return F.when(t <= 1, F.lit(0)).otherwise(
            1 + F.least(F.floor((t - 1) * RANGES), F.lit(RANGES - 1))).cast("int")

    copies = queue.select("unit", "source", "key", "doc_id", "size",
                          F.posexplode("finish").alias("k", "t")).where("t is not null")
    per_range = copies.groupBy(range_of(F.col("t")).alias("r")).agg(F.sum("unit").alias("s"))
    run = W.orderBy("r").rowsBetween(W.unboundedPreceding, 0)
    total = units.agg(F.sum("unit")).first()[0] or 0
    cut = (per_range.select("r", "s", F.sum("s").over(run).alias("c"))
           .where(F.col("c") > total).orderBy("r").limit(1).collect())
    cut_r, left = (cut[0].r, total - (cut[0].c - cut[0].s)) if cut else (RANGES + 1, 0)
    whole = F.size(F.filter("finish", lambda t: t.isNotNull() & (range_of(t) < cut_r)))
    at_cut = (copies.where(range_of(F.col("t")) == cut_r)
              .withColumn("c", F.sum("unit").over(
                  W.partitionBy(F.lit(0)).orderBy("t", F.col("source").asc_nulls_last(), "key", "doc_id",
                                                  "size", "k").rowsBetween(W.unboundedPreceding, 0)))
              .where(F.col("c") <= left)
              .groupBy(F.col("source").alias("__s"), F.col("doc_id").alias("__d"), F.col("size").alias("__z"))
              .agg(F.count(F.lit(1)).alias("more")))
    plan = (queue.join(at_cut, F.col("source").eqNullSafe(F.col("__s"))
                       & F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("size") == F.col("__z")), "left")
            .select("doc_id", "source", "size", "source_size", "target",
                    (whole + F.coalesce("more", F.lit(0))).cast("int").alias("copies")))
    return rows, cut_lineage(plan)


def _on_plan(plan: DataFrame) -> tuple[DataFrame, Column]:
    p = plan.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"),
                    F.col("size").alias("__z"), F.col("source_size").alias("__source_size"),
                    F.col("target").alias("__target"), F.col("copies").alias("__copies"))
    return p, (F.col("__id").eqNullSafe(F.col("__d")) & F.col("__source").eqNullSafe(F.col("__s"))
               & (F.col("__size") == F.col("__z")))


def mix_report(docs: DataFrame, **kw) -> DataFrame:
    """One row per input row: doc_id, size, source_size, target, taken, copies."""
    rows, plan = mix_plan(docs, **kw)
    p, on = _on_plan(plan)
    return (rows.select(F.col("doc_id").alias("__id"), F.col("source").alias("__source"),
                        F.col("size").alias("__size"))
            .join(p, on, "left")
            .select(F.col("__id").alias("doc_id"), F.col("__size").alias("size"),
                    F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
                    (F.col("__size") * F.col("__copies")).cast("long").alias("taken"),
                    F.col("__copies").alias("copies")))


def mix(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
        source_col: str = "source", **kw) -> DataFrame:
    """The mixed corpus: every input row as often as the mix takes it, with
    the input's columns."""
    _, plan = mix_plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, **kw)
    p, on = _on_plan(plan.where("copies > 0"))
    cols = list(docs.columns)
    out = docs.select("*", F.col(id_col).alias("__id"), F.col(source_col).alias("__source"),
                      word_count(text_col).alias("__size")).join(p, on)
    return (out.withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
            .select(*[F.col(f"`{c}`") for c in cols]))

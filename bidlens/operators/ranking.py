"""Exact global ranks without a single-partition window.

``prefix_sums`` gives, for each distinct value of an order column, the sums
of weight columns over all strictly smaller values.  Two levels:

1. bucket bounds from ``approxQuantile`` (a sketch, merged across tasks);
   ``Bucketizer`` (binary search, JVM-side) assigns each value a bucket;
2. per-bucket totals (one row per bucket — the only data that reaches the
   driver, bounded by the bucket count we choose), turned into offsets and
   joined back; inside a bucket a window over that bucket's rows only.

Callers pre-aggregate to one row per distinct value (partial aggregation),
so a hot value is one row, never a hot task.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ROWS_PER_BUCKET = 2_000_000


def prefix_sums(df: DataFrame, order_col: str, sum_cols: Sequence[str],
                rows_per_bucket: int = ROWS_PER_BUCKET) -> tuple[DataFrame, dict]:
    """Return (df + ``<c>_below`` for each sum column, totals dict).

    ``df`` must hold one row per distinct non-null ``order_col`` value."""
    spark = df.sparkSession
    n = df.count()
    nb = max(1, math.ceil(n / rows_per_bucket))
    if nb > 1:
        probs = [i / nb for i in range(1, nb)]
        bounds = sorted(set(df.approxQuantile(order_col, probs, 1.0 / (4 * nb))))
        splits = [-math.inf] + [b for b in bounds if math.isfinite(b)] + [math.inf]
        b = Bucketizer(splits=splits, inputCol="__v", outputCol="__bucket",
                       handleInvalid="keep")
        bucketed = b.transform(df.withColumn("__v", F.col(order_col).cast("double"))).drop("__v")
        bucketed = bucketed.withColumn("__bucket", F.col("__bucket").cast("int"))
    else:
        bucketed = df.withColumn("__bucket", F.lit(0))
    totals = bucketed.groupBy("__bucket").agg(*[F.sum(c).alias(c) for c in sum_cols]).collect()
    totals = sorted(totals, key=lambda r: r["__bucket"])
    run = {c: 0 for c in sum_cols}
    offsets = []
    for r in totals:
        offsets.append((r["__bucket"], *[run[c] for c in sum_cols]))
        for c in sum_cols:
            run[c] += r[c] or 0
    from pyspark.sql.types import DecimalType, FractionalType
    kinds = {c: ("double" if isinstance(df.schema[c].dataType, (FractionalType, DecimalType)) else "long")
             for c in sum_cols}
    off = spark.createDataFrame(offsets, "__bucket int, " + ", ".join(
        f"__off_{c} {kinds[c]}" for c in sum_cols))
    # ``off`` has exactly one row per bucket (``nb`` rows): a proven bound.
    j = bucketed.join(F.broadcast(off), "__bucket")
    w = (Window.partitionBy("__bucket").orderBy(order_col)
         .rowsBetween(Window.unboundedPreceding, -1))
    out = j.select(*df.columns, *[
        (F.col(f"__off_{c}") + F.coalesce(F.sum(c).over(w), F.lit(0))).alias(f"{c}_below")
        for c in sum_cols])
    return out, run


SKETCH_ERROR = 0.002  # of the ranks between which a quantile is looked for


def _between(v: DataFrame, n: int, ranks: Sequence[int]) -> tuple[DataFrame, int] | None:
    """The rows of ``v`` whose values may have a rank from the first to the last
    of ``ranks`` and the number of smaller ones, or None if the sketch that says
    so was wrong."""
    lo, hi = v.approxQuantile("__x", [max(0.0, ranks[0] / n - 2 * SKETCH_ERROR), min(1.0, (ranks[-1] + 1) / n + 2 * SKETCH_ERROR)],
                              SKETCH_ERROR)
    x = F.col("__x")
    below, upto = v.agg(F.count(F.when(x < lo, 1)), F.count(F.when(x <= hi, 1))).first()
    return (v.where(x.between(lo, hi)), below) if below <= ranks[0] and ranks[-1] < upto else None


def exact_quantiles(df: DataFrame, col: str, probs: Sequence[float], few: int = ROWS_PER_BUCKET) -> list[float | None]:
    """``numpy.quantile`` (linear interpolation) of a numeric column, exact,
    computed by distributed ranks.  Nulls and NaN are ignored.  Of more than
    ``few`` values only those near a quantile by a sketch are ranked, above the
    counted rest; the others aren't shuffled."""
    v = df.select(F.col(col).cast("double").alias("__x")).filter(
        F.col("__x").isNotNull() & ~F.isnan("__x")).persist()
    n = v.count()
    if n == 0:
        v.unpersist()
        return [None for _ in probs]
    if n > few:
        out = []
        for q in probs:
            ranks = [math.floor(q * (n - 1)), math.ceil(q * (n - 1))]
            near = _between(v, n, ranks)
            out += _ranked(*(near or (v, 0)), n, [q])
    else:
        out = _ranked(v, 0, n, probs)
    v.unpersist()
    return out


def _ranked(v: DataFrame, below: int, n: int, probs: Sequence[float]) -> list[float]:
    """Quantiles of ``n`` values, of which ``below`` are smaller than those in ``v``."""
    counts = v.groupBy("__x").agg(F.count(F.lit(1)).alias("__n")).persist()
    pref, _ = prefix_sums(counts, "__x", ["__n"])
    pref = pref.withColumn("__n_below", F.col("__n_below") + F.lit(below))
    wanted = {}
    for q in probs:
        pos = q * (n - 1)
        lo, hi = math.floor(pos), math.ceil(pos)
        wanted[q] = (lo, hi, pos - lo)
    ranks = sorted({r for lo, hi, _ in wanted.values() for r in (lo, hi)})
    cond = F.lit(False)
    for r in ranks:
        cond = cond | ((F.col("__n_below") <= r) & (F.col("__n_below") + F.col("__n") > r))
    rows = pref.filter(cond).select("__x", "__n_below", "__n").collect()

    def at(r):
        for row in rows:
            if row["__n_below"] <= r < row["__n_below"] + row["__n"]:
                return row["__x"]
        return None

    counts.unpersist()
    out = []
    for q in probs:
        lo, hi, frac = wanted[q]
        a, b = at(lo), at(hi)
        out.append(a + (b - a) * frac if frac else a)
    return out

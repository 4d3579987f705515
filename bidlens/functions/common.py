"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.session import cut_lineage


def ensure_columns(df: DataFrame, spec: dict[str, str]) -> DataFrame:
    """Add every column of ``spec`` ({name: spark type}) that ``df`` lacks,
    as a typed null.  Existing columns are left as they are."""
    missing = [F.lit(None).cast(t).alias(n) for n, t in spec.items() if n not in df.columns]
    return df.select("*", *missing) if missing else df


def num_or_null(c: Column) -> Column:
    """Double value; text that is no number, NaN and infinities read as null
    (missing), so they neither reach a score nor spoil an aggregate."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)


def missing_path(e: Exception) -> bool:
    """True for Spark's path-not-found error only; storage and permission
    errors are not an empty input."""
    return isinstance(e, AnalysisException) and e.getCondition() == "PATH_NOT_FOUND"


def first_or(xs: Column, default: Column | None = None) -> Column:
    """PRJ-11: first element of an array, else ``default`` (null-safe)."""
    d = default if default is not None else F.lit(None)
    return F.coalesce(F.get(xs, 0), d)


def present(df: DataFrame, cols: Sequence[str]) -> list[str]:
    """Columns of ``cols`` that ``df`` has, in the order of ``cols``."""
    return [c for c in cols if c in df.columns]


def null_safe_on(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> Column:
    """Join condition where null keys match null keys (pandas merge rule)."""
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


def keep_first(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per ``key``: the row with the smallest ``order`` tuple.

    Built as ``min(struct(order..., rest...))`` per key instead of a
    ``row_number`` window: the aggregate is partial (map-side combine), so a
    hot key — even one holding a third of all rows — reaches the shuffle as
    one row per map task rather than landing whole in one sorting task.
    Null keys form one group, as ``drop_duplicates`` does.
    """
    keys = [key] if isinstance(key, str) else list(key)
    order = list(order)
    at = {c: f"__o{i}" for i, c in reversed(list(enumerate(order)))}  # order columns are packed once
    rest = [c for c in df.columns if c not in keys and c not in at]
    packed = F.struct(*[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)],
                      *[F.col(c) for c in rest])
    out = df.groupBy(*keys).agg(F.min(packed).alias("__first"))
    return out.select(*[F.col(c) if c in keys else F.col(f"__first.{at.get(c, c)}").alias(c) for c in df.columns])


FEW_ROWS = 250_000  # counted rows of a few short columns that are broadcast


def broadcast_if_few(df: DataFrame) -> DataFrame:
    """A stored table of a few short columns, marked for broadcast if its count
    allows it.  A plan made before the count is known shuffles both sides."""
    return F.broadcast(df) if df.count() <= FEW_ROWS else df


def repeated_keys(df: DataFrame, key: str) -> DataFrame | None:
    """``__rh``: the ``xxhash64`` of every ``key`` (null, too) that more than one
    row has, and by chance of a few others; None if there is none.  Runs a job
    whose shuffle holds 8 bytes a row."""
    counts = df.groupBy(F.xxhash64(key).alias("__rh")).agg(F.count(F.lit(1)).alias("__rn"))
    found = cut_lineage(counts.where("__rn > 1").select("__rh"))
    return None if found.isEmpty() else broadcast_if_few(found)


def first_non_null_repeated(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """``first_non_null`` of a stored table in which few keys repeat: only the
    rows of those are folded.  Runs the job that finds them."""
    found = repeated_keys(df, key)
    rest = [c for c in df.columns if c != key and c != order]
    if found is None:
        return df.select(key, *rest)
    at = F.xxhash64(key) == F.col("__rh")
    folded = first_non_null(df.join(found, at, "left_semi"), key, order)
    return df.join(found, at, "left_anti").select(key, *rest).unionByName(folded)


def first_non_null(df: DataFrame, key: str, order: str | None = None) -> DataFrame:
    """Per ``key``, every other column's first non-null value (pandas
    ``groupby().first()``) in the order of column ``order``; without one, in
    the order of the rows' own values, so that reruns agree."""
    rest = [c for c in df.columns if c != key and c != order]
    rank = F.col(order) if order else F.struct(*[F.col(c) for c in rest])
    return df.groupBy(key).agg(*[F.min_by(F.col(c), F.when(F.col(c).isNotNull(), rank)).alias(c)
                                 for c in rest])


def spread(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Round-robin repartition before CPU-heavy narrow work (JSON parsing,
    regex over whole texts), where the caller knows that the input has few
    splits (a gzip file, one large row group) and names the number.  Without
    a number it is a no-op: counting partitions would run the query."""
    return df if partitions is None or df.isStreaming else df.repartition(partitions)


WIDE = 100  # rows of an id on both sides from which its product is dealt out
DEAL_ROWS, DEAL_MOST = 250_000, 1_000  # rows of a product in one piece; pieces of one id


def product_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, deal_by: str, how: str = "inner",
                 left_rows: DataFrame | None = None, right_rows: DataFrame | None = None, eager: bool = False) -> DataFrame:
    """``left`` joined to ``right`` on a key, null matching null, where some keys
    have many rows on both sides.  All rows of such a key meet in one task of a
    plain join, which then makes their whole product; here its ``left`` rows are
    dealt into pieces by ``deal_by`` and its ``right`` rows go to each.
    ``left_rows`` and ``right_rows`` may name cheaper tables with the same
    keys to find those keys by (at least as many rows per key).  ``eager`` looks
    for such keys on the right first, and joins plainly if there are none."""
    lr, rr = left if left_rows is None else left_rows, right if right_rows is None else right_rows
    many_r = (rr.groupBy(F.col(right_key).alias("__w")).agg(F.count(F.lit(1)).alias("__nr"))
              .where(F.col("__nr") >= WIDE))
    if eager:
        many_r = cut_lineage(many_r)
        if many_r.isEmpty():
            return left.join(right, F.col(left_key).eqNullSafe(F.col(right_key)), how)
    many = (lr.select(F.col(left_key).alias("__k"), deal_by).join(many_r, F.col("__k").eqNullSafe(F.col("__w")))
            .groupBy("__w", "__nr").agg(F.approx_count_distinct(deal_by).alias("__nl")).where(F.col("__nl") >= WIDE))
    pieces = F.least(F.ceil(F.col("__nl") * F.col("__nr") / DEAL_ROWS), F.lit(DEAL_MOST)).cast("int")
    wide = many.select("__w", pieces.alias("__pieces"))
    at_l, at_r = F.col(left_key).eqNullSafe(F.col("__w")), F.col(right_key).eqNullSafe(F.col("__w"))
    same = F.col(left_key).eqNullSafe(F.col(right_key))
    plain = left.join(wide, at_l, "left_anti").join(right, same, how)
    dealt_l = left.join(wide, at_l).withColumn("__piece", F.pmod(F.xxhash64(deal_by), "__pieces").cast("int")).drop("__w", "__pieces")
    dealt_r = right.join(wide, at_r).withColumn("__p", F.explode(F.sequence(F.lit(0), F.col("__pieces") - 1))).drop("__w", "__pieces")
    # a number of its own: few bytes make many rows, and AQE merges partitions by bytes
    dealt_r = dealt_r.repartition(4 * left.sparkSession.sparkContext.defaultParallelism, "__p", right_key)
    dealt = dealt_l.join(dealt_r, same & (F.col("__piece") == F.col("__p"))).drop("__piece", "__p")
    return plain.unionByName(dealt)

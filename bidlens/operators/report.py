"""Report operators over scored batches: flattening, previews, filters,
top-k, CSV export."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def max_factor_count(scored: DataFrame, col: str = "top_factors") -> int:
    """AGG-14: the longest factor list (one aggregate row to the driver)."""
    r = scored.agg(F.max(F.size(F.col(col))).alias("m")).first()
    return int(r["m"] or 0) if r is not None else 0


def flatten_factors(scored: DataFrame, col: str = "top_factors", width: int | None = None) -> DataFrame:
    """PRJ-19: ``top_factor_{i}_name`` / ``_value`` for i = 1..width (the
    longest list when ``width`` is None); missing entries and nulls → ""."""
    n = max_factor_count(scored, col) if width is None else int(width)
    arr = F.coalesce(F.col(col), F.array().cast(scored.schema[col].dataType))
    cols = []
    for i in range(n):
        item = F.get(arr, i)
        cols.append(F.coalesce(item["name"].cast("string"), F.lit("")).alias(f"top_factor_{i + 1}_name"))
        cols.append(F.coalesce(item["value"].cast("string"), F.lit("")).alias(f"top_factor_{i + 1}_value"))
    return scored.select(*[c for c in scored.columns if c != col], *cols)


def factor_preview(col: str | Column = "top_factors", n: int = 3) -> Column:
    """PRJ-20: ``name=value (+0.123); …`` for the first ``n`` factors; the
    contribution part only when it is present."""
    c = F.col(col) if isinstance(col, str) else col

    def one(f):
        base = F.concat(f["name"], F.lit("="), F.coalesce(f["value"].cast("string"), F.lit("")))
        return F.when(f["contribution"].isNull(), base).otherwise(
            F.concat(base, F.format_string(" (%+.3f)", f["contribution"])))
    return F.concat_ws("; ", *[one(F.get(c, i)) for i in range(n)])  # a place that is missing is null and left out


def split_errors(scored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """FLT-11: (ok rows, error rows); an empty error text counts as ok."""
    bad = F.col("error").isNotNull() & (F.col("error") != "")
    return scored.filter(~bad | F.col("error").isNull()), scored.filter(bad)


def band_filter(scored: DataFrame, bands: Sequence[str]) -> DataFrame:
    """FLT-12."""
    return scored.filter(F.col("risk_band").isin(list(bands)))


def distinct_bands(scored: DataFrame) -> DataFrame:
    """AGG-15: distinct non-null bands, sorted."""
    return scored.select("risk_band").distinct().na.drop().orderBy("risk_band")


def top_risk(scored: DataFrame, n: int = 20, score: str = "risk_score") -> DataFrame:
    """SRT-05: top-n by score, null scores dropped (TakeOrderedAndProject:
    each task keeps its n best, the driver merges n × tasks rows)."""
    return scored.filter(F.col(score).isNotNull()).orderBy(F.col(score).desc(), "award_id").limit(n)


def preview(df: DataFrame, n: int = 5) -> tuple[list, int]:
    """SNK-11 / SRT-07: the first ``n`` rows and the row count."""
    return df.limit(n).collect(), df.count()


def write_csv_bom(df: DataFrame, path: str) -> None:
    """SNK-10: header CSV whose first header name carries a UTF-8 BOM, so
    spreadsheet tools detect the encoding.  Nested columns must be
    flattened first (``flatten_factors``)."""
    first = df.columns[0]
    df.withColumnRenamed(first, BOM + first).write.mode("overwrite").option("header", True).csv(path)

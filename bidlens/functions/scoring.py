"""Score expressions: pure Catalyst column trees (whole-stage codegen), no UDF."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from bidlens.functions.common import num_or_null

# Default band cut points when no thresholds are known.
DEFAULT_BANDS = {"low_max": 0.33, "medium_max": 0.66}

# Factor list (and its order) reported by the heuristic scorer.
HEURISTIC_FACTORS = [
    "repeat_winner_ratio",
    "amount_zscore_by_category",
    "award_concentration_by_buyer",
    "near_threshold_flag",
    "time_to_award_days",
]


def clamp01(x: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), x))


def num(c: str | Column, default: float = 0.0) -> Column:
    """Numeric coerce with a default for missing values (null, NaN,
    infinities, non-numeric text)."""
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(num_or_null(col), F.lit(default))


def heuristic(near: Column, repeat: Column, z: Column, conc: Column) -> Column:
    """.4·[near = 1] + .3·repeat + .2·clamp(z/3) + .1·clamp(conc), clamped,
    rounded to 6 places.  Inputs are expected null-filled."""
    s = (F.lit(0.4) * F.when(near == 1, 1.0).otherwise(0.0)
         + F.lit(0.3) * repeat
         + F.lit(0.2) * clamp01(z / F.lit(3.0))
         + F.lit(0.1) * clamp01(conc))
    return F.round(clamp01(s), 6)


def record_score(amount: Column, past_awards: Column, sanctioned: Column,
                 media_hits: Column) -> Column:
    """Record-level heuristic: .45·sanctioned + .25·min(media/5, 1)
    + .2·min(awards/10, 1) + .1·min(amount/1e6, 1), rounded to 4 places."""
    s = (F.lit(0.45) * F.when(sanctioned, 1.0).otherwise(0.0)
         + F.lit(0.25) * F.least(F.lit(1.0), media_hits / F.lit(5.0))
         + F.lit(0.2) * F.least(F.lit(1.0), past_awards / F.lit(10.0))
         + F.lit(0.1) * F.least(F.lit(1.0), amount / F.lit(1_000_000.0)))
    return F.round(s, 4)


def risk_band(score: Column, thresholds: dict | None = None) -> Column:
    """≤ low_max → low, ≤ medium_max → medium, else high (NaN → high)."""
    th = thresholds or DEFAULT_BANDS
    lo = float(th.get("low_max", DEFAULT_BANDS["low_max"]))
    md = float(th.get("medium_max", DEFAULT_BANDS["medium_max"]))
    return (F.when(score.isNull(), F.lit(None).cast("string"))
             .when(score <= F.lit(lo), "low")
             .when(score <= F.lit(md), "medium")
             .otherwise("high"))


def _same_length(cols: Sequence[str], coef: Sequence[float]) -> None:
    if len(cols) != len(coef):
        raise ValueError(f"{len(cols)} feature columns but {len(coef)} coefficients")


def linear_logit(cols: Sequence[str], coef: Sequence[float], intercept: float) -> Column:
    """b + Σ wᵢ·xᵢ with nulls as 0; as many coefficients as columns."""
    _same_length(cols, coef)
    z = F.lit(float(intercept))
    for c, w in zip(cols, coef):
        z = z + F.lit(float(w)) * num(c)
    return z


def sigmoid(z: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def sorted_contributions(cols: Sequence[str], coef: Sequence[float]) -> Column:
    """array<struct<size, before, name, value, contribution>> of wᵢ·xᵢ by
    |contribution| desc, ties by feature position: structs sort by their
    fields in turn, as a comparing function would run interpreted."""
    _same_length(cols, coef)
    return F.sort_array(F.array(*[
        F.struct(F.abs(F.lit(float(w)) * num(c)).alias("size"), F.lit(-i).alias("before"), F.lit(c).alias("name"),
                 num(c).alias("value"), (F.lit(float(w)) * num(c)).alias("contribution"))
        for i, (c, w) in enumerate(zip(cols, coef))]), asc=False)


def first_factors(ordered: str, n: int) -> Column:
    """array<struct<name, value, contribution>> of the first ``n`` places of a
    column of ``sorted_contributions`` (a column, as it is named many times)."""
    if n <= 0:
        return F.array().cast("array<struct<name:string,value:double,contribution:double>>")
    return F.array(*[F.struct(*[F.get(ordered, i)[x].alias(x) for x in ("name", "value", "contribution")]) for i in range(n)])


def heuristic_factors(top_k: int) -> Column:
    """Heuristic explanation: fixed factor list prefix, value only."""
    k = max(0, min(int(top_k), len(HEURISTIC_FACTORS)))
    items = [F.struct(F.lit(n).alias("name"), num_or_null(F.col(n)).alias("value"),
                      F.lit(None).cast("double").alias("contribution"))
             for n in HEURISTIC_FACTORS[:k]]
    if not items:
        return F.array().cast("array<struct<name:string,value:double,contribution:double>>")
    return F.array(*items)

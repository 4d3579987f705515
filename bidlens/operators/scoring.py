"""Scoring operators: heuristic, linear model with explanations, batch jobs.

Every scorer is one column expression over the feature row, so a batch of
any size is one narrow stage after the (broadcast or shuffle) join with the
feature table.  One output row per input row, always.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions.common import ensure_columns, first_non_null, first_non_null_repeated
from bidlens.functions.scoring import (DEFAULT_BANDS, first_factors, heuristic, heuristic_factors,
                                       linear_logit, num, record_score, risk_band, sigmoid, sorted_contributions)
from bidlens.operators.features import FEATURE_COLS

DEFAULT_TOP_K = 5
MAX_TOP_K = 20

FACTOR_TYPE = "array<struct<name:string,value:double,contribution:double>>"

# Per-row error texts.
ERR_BLANK = "award_id must be a non-empty string"
ERR_NOT_FOUND = "award_id not found in features"
ERR_NO_FEATURES = "no features found"


@dataclass
class LinearModel:
    """Coefficients of a fitted logistic model (a handful of numbers: the
    driver holds them, executors see them as literals in the plan)."""
    feature_cols: list[str]
    coef: list[float]
    intercept: float
    thresholds: dict = field(default_factory=lambda: dict(DEFAULT_BANDS))
    calibration: tuple[float, float] | None = None  # Platt (a, b): σ(a·logit + b)

    def logit(self) -> Column:
        return linear_logit(self.feature_cols, self.coef, self.intercept)

    def probability(self) -> Column:
        z = self.logit()
        if self.calibration is not None:
            a, b = self.calibration
            z = F.lit(float(a)) * z + F.lit(float(b))
        return sigmoid(z)


def heuristic_score(df: DataFrame) -> DataFrame:
    """Add ``risk_score`` (SCR-06) from the feature columns; nulls count 0."""
    d = ensure_columns(df, {c: "double" for c in FEATURE_COLS})
    return d.withColumn("risk_score", heuristic(
        num("near_threshold_flag"), num("repeat_winner_ratio"),
        num("amount_zscore_by_category"), num("award_concentration_by_buyer")))


def record_level_score(df: DataFrame) -> DataFrame:
    """Add ``risk_score`` from amount, past_awards_count, is_sanctioned,
    adverse_media_count (SCR-07)."""
    d = ensure_columns(df, {"amount": "double", "past_awards_count": "long",
                            "is_sanctioned": "boolean", "adverse_media_count": "long"})
    return d.withColumn("risk_score", record_score(
        num("amount"), num("past_awards_count"),
        F.coalesce(F.col("is_sanctioned").cast("boolean"), F.lit(False)),
        num("adverse_media_count")))


def record_input_errors(df: DataFrame) -> DataFrame:
    """FLT-07: ``error`` for record-level inputs out of range (amount and
    counts must be ≥ 0); rows are kept."""
    d = ensure_columns(df, {"amount": "double", "past_awards_count": "long",
                            "adverse_media_count": "long"})
    msgs = F.array_compact(F.array(
        *[F.when(F.col(c).try_cast("double") < 0, F.lit(f"{c} must be >= 0"))
          for c in ("amount", "past_awards_count", "adverse_media_count")]))
    return d.withColumn("error", F.when(F.size(msgs) > 0, F.array_join(msgs, "; ")))


def with_band(df: DataFrame, thresholds: dict | None = None, score: str = "risk_score") -> DataFrame:
    return df.withColumn("risk_band", risk_band(F.col(score), thresholds))


def linear_score(df: DataFrame, model: LinearModel, top_k: int | None = None,
                 explain: bool = True) -> DataFrame:
    """Add ``risk_score`` (clamped probability), ``risk_band`` and, when
    ``explain``, ``top_factors`` sorted by |contribution| (SCR-01..05)."""
    d = ensure_columns(df, {c: "double" for c in model.feature_cols})
    p = F.greatest(F.lit(0.0), F.least(F.lit(1.0), model.probability()))
    out = d.withColumn("risk_score", p).withColumn("risk_band", risk_band(F.col("risk_score"),
                                                                          model.thresholds))
    if explain:
        n = len(model.feature_cols) if top_k is None else min(int(top_k), len(model.feature_cols))
        out = out.withColumn("__sorted", sorted_contributions(model.feature_cols, model.coef)) if n > 0 else out
        out = out.withColumn("top_factors", first_factors("__sorted", n)).drop("__sorted")
    return out


def top_risk(scored: DataFrame, n: int = 20, score: str = "risk_score") -> DataFrame:
    """Top-n rows by score (see ``report.top_risk``)."""
    from bidlens.operators.report import top_risk as _top
    return _top(scored, n, score)


def normalize_requests(requests: DataFrame) -> DataFrame:
    """Request rows → (input_row_id, award_id, supplier_id, error).

    ``input_row_id`` must be present (it carries the request order); a
    blank or missing award_id gets the per-row error and is kept."""
    r = ensure_columns(requests, {"award_id": "string", "supplier_id": "string"})
    aid = F.col("award_id").cast("string")
    blank = aid.isNull() | (F.regexp_replace(aid, r"(?U)^\s+|\s+$", "") == "")
    return r.select(
        "input_row_id",
        aid.alias("award_id"),
        F.col("supplier_id").cast("string").alias("supplier_id"),
        F.when(blank, F.lit(ERR_BLANK)).alias("error"),
    )


def _request_key(error: Column, value: Column) -> Column:
    """Join key of a request: its value, or a key of its own that matches
    nothing where the row has an error, so that blank ids neither meet in one
    task nor take part in the join."""
    return F.when(error.isNull() & value.isNotNull(), value).otherwise(
        F.concat(F.lit("\0"), F.col("input_row_id").cast("string")))


def _lookup(features: DataFrame, feature_cols: Sequence[str], dedupe: bool, order: str | None) -> DataFrame:
    """Feature rows by award id: as they are when ids are unique, else the
    first non-null value per column (in the order of column ``order``)."""
    f = ensure_columns(features, {c: "double" for c in feature_cols})
    f = f.select(F.col("award_id").alias("__f_award_id"),
                 F.col("supplier_id").cast("string").alias("__f_supplier_id"),
                 *[F.col(c) for c in feature_cols], F.lit(True).alias("__found"),
                 *([F.col(order).alias("__f_order")] if order else []))
    if dedupe:
        f = first_non_null_repeated(f, "__f_award_id", "__f_order" if order else None)
    return f.drop("__f_order")


def _graph_lookup(graph: DataFrame, taken: Sequence[str], dedupe: bool) -> DataFrame:
    """Graph metrics by supplier_id (first non-null per column unless ids are
    unique); columns whose names are already taken get the ``_graph`` suffix."""
    g = graph.filter(F.col("supplier_id").isNotNull())
    if dedupe:
        g = first_non_null(g, "supplier_id")
    reserved = set(taken) | {"risk_score", "risk_band", "top_factors"}
    return g.select(F.col("supplier_id").alias("__g_supplier_id"),
                    *[F.col(c).alias(f"{c}_graph" if c in reserved else c)
                      for c in g.columns if c != "supplier_id"])


def score_batch(requests: DataFrame, features: DataFrame, graph: DataFrame | None = None,
                model: LinearModel | None = None, explain: bool = True,
                top_k: int = DEFAULT_TOP_K, unmatched: str = "error",
                dedupe_features: bool = True, thresholds: dict | None = None,
                feature_order: str | None = None) -> DataFrame:
    """Batch scoring job (SCR-08): one output row per request row.

    Output: input_row_id, award_id, supplier_id, risk_score, risk_band,
    top_factors, error [+ graph columns when ``graph`` is given].
    Request ⟕ features on award_id, optional ⟕ graph metrics on supplier_id:
    one pass over each table.  Rows with an error don't take part in the
    joins and keep a null score.  ``dedupe_features=False`` says that the
    award ids (and the graph's supplier ids) are unique, as the feature and
    graph jobs write them: both sides of the join are then plain shuffles,
    whose skewed partitions AQE splits.  Otherwise the first non-null value
    per id and column counts, in the order of ``feature_order``; a job looks
    for the ids that repeat.  ``features`` should be a stored table, as it is
    read again for its emptiness.
    ``unmatched='score'`` scores awards missing from the features with null
    features (reference behaviour).  ``thresholds`` (the saved model's band
    cut points) also band heuristic scores; the model's own thresholds win
    when a model is given.  ``top_k`` must be 1 to 20."""
    if explain and not 1 <= int(top_k) <= MAX_TOP_K:
        raise ValueError(f"top_k must be between 1 and {MAX_TOP_K}")
    k = int(top_k) if explain else 0
    cols = model.feature_cols if model is not None else FEATURE_COLS
    req = normalize_requests(requests)
    f = _lookup(features, list(dict.fromkeys(list(FEATURE_COLS) + list(cols))), dedupe_features, feature_order)
    j = req.withColumn("__key", _request_key(F.col("error"), F.col("award_id")))
    j = j.join(f, F.col("__key") == F.col("__f_award_id"), "left")
    j = j.withColumn("supplier_id", F.coalesce(F.col("supplier_id"), F.col("__f_supplier_id")))
    miss = F.col("__found").isNull()
    # an uncorrelated EXISTS subquery (CollectLimit 1 in the plan, no extra
    # job over the features) tells "no features at all" from "not found"
    has_features = features.exists()
    err = F.coalesce(F.col("error"),
                     F.when(~has_features, F.lit(ERR_NO_FEATURES)),
                     F.when(miss & F.lit(unmatched == "error"), F.lit(ERR_NOT_FOUND)))
    graph_cols: list[str] = []
    if graph is not None:
        g = _graph_lookup(graph, [c for c in j.columns if c != "__key"], dedupe_features)
        graph_cols = [c for c in g.columns if c != "__g_supplier_id"]
        j = j.withColumn("__key", _request_key(F.lit(None), F.col("supplier_id")))
        j = j.join(g, F.col("__key") == F.col("__g_supplier_id"), "left")
    j = j.withColumn("error", err)
    ok = F.col("error").isNull()
    if model is not None:
        scored = linear_score(j, model, top_k=k, explain=True)
        tf = scored["top_factors"] if explain else F.array().cast(FACTOR_TYPE)
        scored = scored.withColumn("top_factors", tf)
        thresholds = model.thresholds
    else:
        scored = heuristic_score(j).withColumn("top_factors", heuristic_factors(k).cast(FACTOR_TYPE))
    scored = (scored
              .withColumn("risk_score", F.when(ok, F.col("risk_score")))
              .withColumn("risk_band", F.when(ok, risk_band(F.col("risk_score"), thresholds)))
              .withColumn("top_factors", F.when(ok, F.col("top_factors"))
                          .otherwise(F.array().cast(FACTOR_TYPE))))
    return scored.select("input_row_id", "award_id", "supplier_id", "risk_score", "risk_band",
                         "top_factors", "error", *graph_cols)


def validate_batch(requests: DataFrame, features: DataFrame, unique_ids: bool = False) -> DataFrame:
    """Validate-only job (FLT-05/09): input_row_id, award_id, supplier_id,
    valid, error.  Existence is a left join to the feature ids (distinct
    first, unless ``unique_ids`` says they are); blank requests stay out."""
    req = normalize_requests(requests)
    ids = features.select(F.col("award_id").cast("string").alias("__id")).filter(F.col("__id").isNotNull())
    if not unique_ids:
        ids = ids.distinct()
    ids = ids.withColumn("__found", F.lit(True))
    j = req.withColumn("__key", _request_key(F.col("error"), F.col("award_id")))
    j = j.join(ids, F.col("__key") == F.col("__id"), "left")
    missing = F.when(features.exists(), F.lit(ERR_NOT_FOUND)).otherwise(F.lit(ERR_NO_FEATURES))
    err = (F.when(F.col("error").isNotNull(), F.col("error"))
            .when(F.col("__found").isNull(), missing))
    return j.select("input_row_id", "award_id", "supplier_id",
                    err.isNull().alias("valid"), err.alias("error"))

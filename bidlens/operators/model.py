"""Proxy labels, logistic-regression fit, calibration, band thresholds.

The fit takes Newton steps, each one small aggregate over the feature rows;
what comes back to the driver are a step's sums and in the end the weights,
one number per feature, which scoring then inlines as literals in a Catalyst
expression.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from datetime import datetime, timezone

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.functions.common import missing_path
from bidlens.functions.scoring import DEFAULT_BANDS, num, sigmoid
from bidlens.operators.features import FEATURE_COLS
from bidlens.operators.ranking import exact_quantiles
from bidlens.operators.scoring import LinearModel

# Proxy-label rule cut-offs.
Z_CUT, REPEAT_CUT, CONC_CUT = 1.5, 0.8, 0.7
BAND_QUANTILES = (0.33, 0.66)
MAX_ITER = 200


def proxy_label_col(df: DataFrame) -> Column:
    """risky if z > 1.5 or repeat > 0.8 or near = 1 or concentration > 0.7;
    null and missing columns count as 0."""
    def g(c):
        return num(c) if c in df.columns else F.lit(0.0)
    lab = ((g("amount_zscore_by_category") > Z_CUT) | (g("repeat_winner_ratio") > REPEAT_CUT)
           | (g("near_threshold_flag") == 1) | (g("award_concentration_by_buyer") > CONC_CUT))
    return lab.cast("int")


def proxy_label(df: DataFrame, name: str = "label") -> DataFrame:
    return df.withColumn(name, proxy_label_col(df))


def pick_feature_cols(df: DataFrame, cols: Sequence[str] | None = None) -> list[str]:
    """``None``/``['auto']`` → default features present; else the given list
    with absent columns dropped."""
    if not cols or list(cols) == ["auto"]:
        cols = FEATURE_COLS
    return [c for c in cols if c in df.columns]


def _newton(d: DataFrame, k: int, ridge: float, max_iter: int, tol: float) -> list[float]:
    """Weights w0 (intercept, not penalised), w1..wk that minimise the log loss
    summed over the rows of ``d`` (x1..xk, y) plus ridge/2 |w|^2.  A step is
    one aggregate of the loss, gradient and Hessian, sums of (k+1)(k+4)/2 + 1
    products; a step that doesn't lower the loss is halved."""
    x = [F.lit(1.0), *[F.col(f"x{i}") for i in range(1, k + 1)]]
    pairs = [(i, j) for i in range(k + 1) for j in range(i, k + 1)]
    free = np.array([0.0] + [ridge] * k)

    def sums(w):
        z = sum((F.lit(float(w[i])) * x[i] for i in range(1, k + 1)), F.lit(float(w[0])))
        e = d.withColumn("z", z).withColumn("p", sigmoid(F.col("z")))
        z, p, y = F.col("z"), F.col("p"), F.col("y")
        loss = F.greatest(z, F.lit(0.0)) - z * y + F.log1p(F.exp(-F.abs(z)))
        row = e.select(loss.alias("l"), (p - y).alias("g"), (p * (1 - p)).alias("h"), *[c.alias(f"x{i}") for i, c in enumerate(x)]).agg(
            F.sum("l"), *[F.sum(F.col("g") * F.col(f"x{i}")) for i in range(k + 1)],
            *[F.sum(F.col("h") * F.col(f"x{i}") * F.col(f"x{j}")) for i, j in pairs]).first()
        v = np.array([0.0 if r is None else r for r in row])
        hess = np.diag(free)
        for (i, j), s in zip(pairs, v[k + 2:]):
            hess[i, j] += s
            hess[j, i] = hess[i, j]
        return v[0] + float(free @ (w * w)) / 2, v[1:k + 2] + free * w, hess

    w = np.zeros(k + 1)
    loss, grad, hess = sums(w)
    for _ in range(max_iter):
        move = np.linalg.lstsq(hess, grad, rcond=None)[0]
        step = 1.0
        new = sums(w - move)
        while new[0] > loss + 1e-12 * abs(loss) and step > 1e-6:
            step /= 2
            new = sums(w - step * move)
        gain, moved = loss - new[0], np.abs(step * move).max() / (1 + np.abs(w).max())
        w, (loss, grad, hess) = w - step * move, new
        if moved <= tol or (moved < 1e-7 and gain <= 1e-13 * abs(loss)):  # quadratic: the rest is rounding
            break
    return [float(v) for v in w]


def fit(df: DataFrame, cols: Sequence[str] | None = None, max_iter: int = MAX_ITER,
        with_thresholds: bool = True, tol: float = 1e-9) -> LinearModel:
    """L2 logistic regression equal to C = 1 on unscaled features: the summed
    log loss + 1/2 |w|^2, by Newton steps of one small aggregate each (about
    ten passes).  Nulls are filled with 0 in fit and score alike.  With one
    label only, the weights are 0 and the intercept says so surely."""
    cols = pick_feature_cols(df, cols)
    d = df.select(*[num(c).alias(f"x{i + 1}") for i, c in enumerate(cols)], proxy_label_col(df).cast("double").alias("y")).persist()
    n, pos = d.agg(F.count(F.lit(1)), F.sum("y")).first()
    pos = pos or 0.0
    w = [0.0 if not n else 30.0 if pos else -30.0] + [0.0] * len(cols) if pos in (0.0, float(n)) else \
        _newton(d, len(cols), 1.0, max_iter, tol)
    lm = LinearModel(cols, w[1:], w[0], dict(DEFAULT_BANDS))
    if with_thresholds:
        x = d.select(*[F.col(f"x{i + 1}").alias(c) for i, c in enumerate(cols)])
        lm.thresholds = band_thresholds(x.withColumn("p", lm.probability()), "p")
    d.unpersist()
    return lm


def band_thresholds(df: DataFrame, score: str = "risk_score",
                    q: Sequence[float] = BAND_QUANTILES) -> dict:
    """Risk-band cut points = exact quantiles (linear interpolation) of the
    scores; falls back to the defaults when there are none."""
    lo, md = exact_quantiles(df, score, list(q))
    if lo is None or md is None:
        return dict(DEFAULT_BANDS)
    return {"low_max": float(lo), "medium_max": float(md)}


def calibrate(df: DataFrame, model: LinearModel) -> LinearModel:
    """Platt scaling on the training rows: σ(a·logit + b) fitted to the Platt
    targets ((N₊+1)/(N₊+2) for positives, 1/(N₋+2) for negatives), no
    regularisation.  Two parameters need six sums per Newton step, so each
    step is one aggregation; a step that doesn't lower the loss is halved."""
    d = df.select(model.logit().alias("f"), proxy_label_col(df).alias("y")).persist()  # scores hardly repeat: not grouped
    n, pos = d.agg(F.count(F.lit(1)), F.sum("y")).first()
    pos = pos or 0
    neg = n - pos
    hi, lo = (pos + 1.0) / (pos + 2.0), 1.0 / (neg + 2.0)
    t = F.when(F.col("y") == 1, F.lit(hi)).otherwise(F.lit(lo))

    def sums(a: float, b: float):
        z = F.lit(a) * F.col("f") + F.lit(b)
        p, f = sigmoid(z), F.col("f")
        w = p * (1 - p)
        loss = F.greatest(z, F.lit(0.0)) - z * t + F.log1p(F.exp(-F.abs(z)))
        return d.select(*[F.sum(x) for x in (loss, (p - t) * f, p - t, w * f * f, w * f, w)]).first()

    a = b = 0.0
    now = sums(a, b)
    for _ in range(MAX_ITER):
        _, ga, gb, haa, hab, hbb = now
        det = haa * hbb - hab * hab
        if not det:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        step = 1.0
        nxt = sums(a - da, b - db)
        while nxt[0] > now[0] + 1e-9 * abs(now[0]) and step > 1e-4:
            step /= 2
            nxt = sums(a - step * da, b - step * db)
        a, b, now = a - step * da, b - step * db, nxt
        if max(abs(da), abs(db)) < 1e-11 * (1 + abs(a) + abs(b)):
            break
    d.unpersist()
    return LinearModel(model.feature_cols, model.coef, model.intercept, model.thresholds, (a, b))


def top_weights(spark: SparkSession, model: LinearModel, feature_cols: Sequence[str] | None = None,
                n: int = 10) -> DataFrame:
    """Top-n coefficients by |weight|; names ``f{i}`` when the feature list
    does not match the coefficient count."""
    names = list(feature_cols) if feature_cols is not None else list(model.feature_cols)
    if len(names) != len(model.coef):
        names = [f"f{i}" for i in range(len(model.coef))]
    rows = [(nm, float(w), i) for i, (nm, w) in enumerate(zip(names, model.coef))]
    df = spark.createDataFrame(rows, "feature string, weight double, pos int")
    return (df.withColumn("abs_weight", F.abs("weight"))
              .orderBy(F.col("abs_weight").desc(), "pos").limit(n).drop("pos"))


def model_meta(model: LinearModel, model_path: str | None = None,
               trained_at: str | None = None, extra: dict | None = None) -> dict:
    meta = {
        "trained_at": trained_at or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%S.%fZ"),
        "feature_cols": list(model.feature_cols),
        "class_weight": None,
        "risk_band_thresholds": dict(model.thresholds),
        "model_path": model_path,
        "coef": list(model.coef),
        "intercept": model.intercept,
    }
    if model.calibration is not None:
        meta["calibration_method"] = "sigmoid"
        meta["calibration"] = list(model.calibration)
    meta.update(extra or {})
    return meta


def save_model(spark: SparkSession, model: LinearModel, path: str,
               extra: dict | None = None) -> dict:
    """Persist the model (weights, thresholds, calibration) as one JSON record
    under ``path/meta``."""
    p = path.rstrip("/")
    meta = model_meta(model, f"{p}/meta", extra=extra)
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1) \
        .write.mode("overwrite").text(f"{p}/meta")
    return meta


def load_model(spark: SparkSession, path: str) -> LinearModel | None:
    """Model from ``save_model``'s meta; None when there is none or its text
    isn't a model.  Other storage errors are raised."""
    try:
        txt = spark.read.text(f"{path.rstrip('/')}/meta").first()
    except AnalysisException as e:
        if not missing_path(e):
            raise
        return None
    if txt is None:
        return None
    try:
        meta = json.loads(txt["value"])
        return LinearModel(list(meta["feature_cols"]), [float(x) for x in meta["coef"]],
                           float(meta["intercept"]),
                           meta.get("risk_band_thresholds") or dict(DEFAULT_BANDS),
                           tuple(meta["calibration"]) if meta.get("calibration") else None)
    except (ValueError, KeyError, TypeError):
        return None

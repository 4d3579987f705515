"""Evaluation metrics of scored rows: ROC AUC (ties count half), average
precision (step-wise, no interpolation), Brier score, log loss, positive
rate and n — all exact and distributed (``ranking.prefix_sums``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.operators.ranking import prefix_sums
from bidlens.session import cut_lineage

EPS = 1e-6


def flip_if_degenerate(df: DataFrame, label: str, order: str) -> DataFrame:
    """When every label is equal, flip the label of one row, the first by
    ``order``, so both classes exist — the reference's guard.  Of rows that
    share the smallest order key one is flipped."""
    st = df.agg(F.min(label).alias("lo"), F.max(label).alias("hi")).first()
    if st["lo"] is None or st["lo"] != st["hi"]:
        return df
    numbered = cut_lineage(df.withColumn("__row", F.monotonically_increasing_id()))
    first = numbered.agg(F.min_by("__row", F.struct(F.col(order).isNull(), F.col(order), F.col("__row")))).first()[0]
    return numbered.withColumn(label, F.when(F.col("__row") == F.lit(first), 1 - F.col(label))
                               .otherwise(F.col(label))).drop("__row")


def metrics(scored: DataFrame, label: str = "label", prob: str = "p",
            order: str | None = None) -> DataFrame:
    """One-row DataFrame: auc_roc, avg_precision, brier, log_loss, pos_rate, n."""
    spark = scored.sparkSession
    d = scored.select(F.col(label).cast("int").alias("y"), F.col(prob).cast("double").alias("p"),
                      *([F.col(order).alias("__ord")] if order else []))
    if order:
        d = flip_if_degenerate(d, "y", "__ord").drop("__ord")
    d = d.persist()  # (y, p) only: reused by the moments and the rank pass
    simple = d.agg(
        F.avg(F.pow(F.col("p") - F.col("y"), 2)).alias("brier"),
        F.avg(-(F.col("y") * F.log(F.least(F.greatest("p", F.lit(EPS)), F.lit(1 - EPS)))
                + (1 - F.col("y")) * F.log(1 - F.least(F.greatest("p", F.lit(EPS)), F.lit(1 - EPS)))))
        .alias("log_loss"),
        F.avg("y").cast("double").alias("pos_rate"),
        F.count(F.lit(1)).alias("n"),
    )
    by_score = d.groupBy("p").agg(F.sum("y").cast("long").alias("pos"),
                                  F.sum(1 - F.col("y")).cast("long").alias("neg")).persist()
    pref, tot = prefix_sums(by_score, "p", ["pos", "neg"])
    P, N = float(tot["pos"]), float(tot["neg"])
    auc_term = F.col("pos") * (F.col("neg_below") + F.col("neg") / 2.0)
    tp = F.lit(P) - F.col("pos_below")
    fp = F.lit(N) - F.col("neg_below")
    ap_term = F.when(F.col("pos") > 0, F.col("pos") / F.lit(P) * tp / (tp + fp)).otherwise(0.0)
    ranked = pref.agg(
        (F.sum(auc_term) / F.lit(P * N if P * N > 0 else float("nan"))).alias("auc_roc"),
        (F.sum(ap_term) if P > 0 else F.lit(float("nan"))).alias("avg_precision"))
    out = _one_row(spark, ranked, simple)
    by_score.unpersist()
    d.unpersist()
    return out


def _one_row(spark, a: DataFrame, b: DataFrame) -> DataFrame:
    """Both inputs are single-row aggregates: combine them on the driver."""
    ra, rb = a.first(), b.first()
    return spark.createDataFrame(
        [(ra["auc_roc"], ra["avg_precision"], rb["brier"], rb["log_loss"], rb["pos_rate"],
          int(rb["n"]))],
        "auc_roc double, avg_precision double, brier double, log_loss double, "
        "pos_rate double, n long")

"""Record-level risk (SCR-07 / SCR-09): per supplier, derive the inputs the
record heuristic needs — past award count, sanction flag, adverse-media
hits — with aggregations and joins, then score every award."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.functions.common import num_or_null
from bidlens.functions.text import graph_name_key
from bidlens.operators.scoring import record_level_score


def supplier_signals(awards: DataFrame, sanctions: DataFrame | None = None,
                     media: DataFrame | None = None) -> DataFrame:
    """(supplier_id, name_key, past_awards_count, is_sanctioned,
    adverse_media_count) per supplier_id.

    Award counts are a partial aggregation; the sanction flag is a left join
    to the distinct sanction name keys; media hits join on the name key."""
    a = awards.select(F.col("supplier_id").cast("string").alias("supplier_id"),
                      F.col("supplier_name"), F.col("award_id"))
    per = a.groupBy("supplier_id").agg(
        F.count("award_id").alias("past_awards_count"),
        F.min(graph_name_key(F.col("supplier_name"))).alias("name_key"))
    if sanctions is not None:
        src = "normalized_name" if "normalized_name" in sanctions.columns else "name"
        keys = (sanctions.select(graph_name_key(F.col(src)).alias("name_key"))
                .filter(F.col("name_key").isNotNull()).distinct()
                .withColumn("__s", F.lit(True)))
        per = per.join(keys, "name_key", "left")
    else:
        per = per.withColumn("__s", F.lit(None).cast("boolean"))
    if media is not None:
        per = per.join(media.select("name_key", "adverse_media_count"), "name_key", "left")
    else:
        per = per.withColumn("adverse_media_count", F.lit(None).cast("long"))
    return per.select("supplier_id", "name_key", "past_awards_count",
                      F.coalesce(F.col("__s"), F.lit(False)).alias("is_sanctioned"),
                      F.coalesce(F.col("adverse_media_count"), F.lit(0)).cast("long")
                      .alias("adverse_media_count"))


def score_awards(awards: DataFrame, signals: DataFrame) -> DataFrame:
    """Every award with its supplier's signals and the record-level score."""
    a = awards.select("award_id", F.col("supplier_id").cast("string").alias("supplier_id"),
                      num_or_null(F.col("amount")).alias("amount"))
    j = a.join(signals, "supplier_id", "left")
    return record_level_score(j)

"""Invariants over the driver tables (sf0.001): shares per buyer sum to 1,
z-scores are centred per category, BFS distances differ by at most one
along an edge, AUC(1 − p) = 1 − AUC, one output row per request."""
import pytest
from pyspark.sql import functions as F

from bidlens.operators import evaluate as ev
from bidlens.operators import features as feat
from bidlens.operators import graph as gr
from bidlens.operators import scoring
from bidlens.plans import adapters as ad
from bidlens.plans import registry as R

SF = "/root/testdata/sf0.001"


def test_shares_sum_to_one(spark):
    rows = feat.joined_awards(ad.tenders(spark, SF), ad.awards(spark, SF))
    c = feat.concentration(rows)
    sums = c.groupBy("__buyer_name").agg(F.sum("share").alias("s")).collect()
    assert sums and all(abs(r.s - 1.0) < 1e-9 for r in sums)


def test_zscores_centred(spark):
    rows = feat.award_feature_rows(ad.tenders(spark, SF), ad.awards(spark, SF))
    st = rows.groupBy("__category").agg(F.avg("amount_zscore_by_category").alias("m"),
                                        F.stddev_pop("amount_zscore_by_category").alias("s")).collect()
    for r in st:
        assert abs(r.m) < 1e-9 and abs(r.s - 1.0) < 1e-9


def test_bfs_distance_lipschitz(spark):
    v, e = R.graph_parts(spark, SF)
    sup = gr.sanctioned_suppliers(v, R.sanctions_df(spark, SF))
    d = gr.distance_to(e, sup.filter("is_sanctioned").select(F.col("id").alias("node")))
    a = e.join(d.select(F.col("node").alias("src"), F.col("dist").alias("ds")), "src") \
         .join(d.select(F.col("node").alias("dst"), F.col("dist").alias("dd")), "dst")
    assert a.filter(F.abs(F.col("ds") - F.col("dd")) > 1).count() == 0
    assert d.filter("dist = 0").count() == sup.filter("is_sanctioned").count()


def test_auc_complement(spark):
    s = R.mdl.proxy_label(R.fixed_scores(spark, SF, explain=False)).withColumn("p", R.FIXED_MODEL.probability())
    m1 = ev.metrics(s, "label", "p").first()
    m2 = ev.metrics(s.withColumn("p", 1 - F.col("p")), "label", "p").first()
    assert m1.auc_roc + m2.auc_roc == pytest.approx(1.0, abs=1e-12)


def test_batch_is_one_to_one(spark):
    req = ad.requests(spark, SF)
    out = scoring.score_batch(req, R.features_df(spark, SF))
    assert out.count() == req.count()
    assert out.select("input_row_id").distinct().count() == req.select("input_row_id").distinct().count()

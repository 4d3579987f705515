from pyspark.sql import functions as F

from bidlens.operators import features as feat

TENDERS = "tender_id string, buyer_name string, main_category string, tender_date string"
AWARDS = "award_id string, tender_id string, supplier_id string, supplier_name string, amount double, date string, pos int"


def _feats(spark, tenders, awards, **kw):
    t = spark.createDataFrame(tenders, TENDERS)
    a = spark.createDataFrame(awards, AWARDS)
    return {r.award_id: r for r in feat.build_features(t, a, order_key=["pos"], **kw).collect()}


def test_fixture_f2(spark):
    out = _feats(spark, [("T1", "Buyer A", "goods", "2024-01-01T00:00:00Z")],
                 [("A1", "T1", "S1", "ACME", 10000.0, "2024-01-03T00:00:00Z", 0)])
    r = out["A1"]
    assert r.supplier_id == "S1"
    assert r.award_concentration_by_buyer == 1.0 and r.repeat_winner_ratio == 1.0
    assert r.amount_zscore_by_category == 0.0
    assert r.near_threshold_flag == 1
    assert r.time_to_award_days == 2


def test_near_threshold_scalars(spark):
    df = spark.createDataFrame([(10000.0,), (10500.0,), (16000.0,), (None,), (-10000.0,), (float("nan"),),
                                (9500.0,), (1_050_000.0,), (9499.99,)], "a double")
    got = [r[0] for r in df.select(feat.near_threshold(F.col("a"))).collect()]
    assert got == [1, 1, 0, 0, 0, 0, 1, 1, 0]


def test_days_clip_and_negative(spark):
    out = _feats(spark, [("T1", "B", "goods", "2000-01-01T00:00:00Z"), ("T2", "B", "goods", "2024-01-02T00:00:00Z")],
                 [("A1", "T1", "S1", "x", 1.0, "2024-01-01T00:00:00Z", 0),       # > 3650 → 3650
                  ("A2", "T2", "S1", "x", 1.0, "2024-01-01T12:00:00Z", 1),       # −12 h → −1 → 0
                  ("A3", "T2", "S1", "x", 1.0, None, 2),                         # null → 0
                  ("A4", "T2", "S1", "x", 1.0, "2024-01-04T23:00:00Z", 3)])      # 2 d 23 h → 2
    assert out["A1"].time_to_award_days == 3650
    assert out["A2"].time_to_award_days == 0
    assert out["A3"].time_to_award_days == 0
    assert out["A4"].time_to_award_days == 2


def test_shares_zscore_and_nulls(spark):
    tenders = [("T1", "B1", "goods", None), ("T2", "B1", "works", None), ("T3", None, None, None)]
    awards = [("A1", "T1", "S1", "a", 100.0, None, 0), ("A2", "T1", "S1", "a", 300.0, None, 1),
              ("A3", "T2", "S2", "b", 50.0, None, 2), ("A4", "T3", None, "c", None, None, 3),
              ("A5", "T3", None, "c", 7.0, None, 4)]
    out = _feats(spark, tenders, awards)
    assert abs(out["A1"].award_concentration_by_buyer - 2 / 3) < 1e-12
    assert abs(out["A3"].award_concentration_by_buyer - 1 / 3) < 1e-12
    # null buyer + null supplier form one group
    assert out["A4"].award_concentration_by_buyer == 1.0
    # goods: mean 200, population sd 100
    assert abs(out["A1"].amount_zscore_by_category + 1.0) < 1e-12
    assert abs(out["A2"].amount_zscore_by_category - 1.0) < 1e-12
    # works: one row → σ = 0 → 0; null amount → 0; null category is a group
    assert out["A3"].amount_zscore_by_category == 0.0
    assert out["A4"].amount_zscore_by_category == 0.0
    assert out["A5"].amount_zscore_by_category == 0.0


def test_duplicate_tenders_fan_out_and_switch(spark):
    tenders = [("T1", "B1", "goods", None), ("T1", "B1", "goods", None), ("T2", "B1", "goods", None)]
    awards = [("A1", "T1", "S1", "a", 1.0, None, 0), ("A2", "T2", "S2", "b", 1.0, None, 1)]
    fan = _feats(spark, tenders, awards)
    # A1 counted twice among B1's 3 joined rows (reference behaviour)
    assert abs(fan["A1"].award_concentration_by_buyer - 2 / 3) < 1e-12
    dd = _feats(spark, tenders, awards, dedupe_tenders=True)
    assert abs(dd["A1"].award_concentration_by_buyer - 0.5) < 1e-12


def test_keep_first_and_partition_invariance(spark):
    tenders = [("T1", "B1", "goods", "2024-01-01")]
    awards = [("A1", "T1", "S9", "z", 1.0, "2024-01-05", 1), ("A1", "T1", "S1", "a", 1.0, "2024-01-02", 0)]
    out = _feats(spark, tenders, awards)
    assert len(out) == 1 and out["A1"].supplier_id == "S1" and out["A1"].time_to_award_days == 1
    t = spark.createDataFrame(tenders, TENDERS)
    a = spark.createDataFrame(awards * 5, AWARDS)
    x = sorted(feat.build_features(t, a, ["pos"]).collect())
    y = sorted(feat.build_features(t.repartition(3), a.repartition(7), ["pos"]).collect())
    assert x == y

import pytest
from pyspark.sql import functions as F

from bidlens.operators import scoring
from bidlens.operators.scoring import LinearModel

FEAT = ("award_id string, supplier_id string, award_concentration_by_buyer double, repeat_winner_ratio double, "
        "amount_zscore_by_category double, near_threshold_flag int, time_to_award_days int")
F6 = [("A1", "S1", 1.0, 1.0, 2.0, 1, 5), ("A2", "S2", 0.0, 0.0, -1.0, 0, 0)]
REQ = "input_row_id long, award_id string, supplier_id string"


def test_heuristic_f6(spark):
    s = {r.award_id: r.risk_score for r in scoring.heuristic_score(spark.createDataFrame(F6, FEAT)).collect()}
    assert s["A1"] == pytest.approx(0.933333, abs=1e-9)
    assert s["A2"] == 0.0


def test_record_score_f12(spark):
    df = spark.createDataFrame([(0.0, 0, False, 0), (0.0, 0, True, 0), (100000.0, 2, False, 0), (50000.0, 1, False, 1)],
                               "amount double, past_awards_count int, is_sanctioned boolean, adverse_media_count int")
    got = [r.risk_score for r in scoring.record_level_score(df).collect()]
    assert got == [0.0, 0.45, 0.05, 0.075]


def test_risk_band_edges(spark):
    df = spark.createDataFrame([(0.33,), (0.3300001,), (0.66,), (0.9,), (float("nan"),), (None,)], "s double")
    got = [r[0] for r in df.select(scoring.risk_band(F.col("s"))).collect()] if hasattr(scoring, "risk_band") else None
    from bidlens.functions.scoring import risk_band
    got = [r[0] for r in df.select(risk_band(F.col("s"))).collect()]
    assert got == ["low", "medium", "medium", "high", "high", None]


def test_linear_factors_sorted_stable_and_topk(spark):
    m = LinearModel(["a", "b", "c"], [1.0, -2.0, 1.0], 0.0)
    df = spark.createDataFrame([(1.0, 1.0, 1.0)], "a double, b double, c double")
    r = scoring.linear_score(df, m, top_k=None).first()
    assert [f.name for f in r.top_factors] == ["b", "a", "c"]  # |−2| first, tie a/c by position
    assert r.risk_score == pytest.approx(1 / (1 + 2.718281828459045 ** 0))
    r2 = scoring.linear_score(df, m, top_k=2).first()
    assert len(r2.top_factors) == 2


def test_score_batch_rows_errors_and_order(spark):
    feats = spark.createDataFrame(F6 + [("A1", None, None, None, None, None, None)], FEAT)
    req = spark.createDataFrame([(0, "A1", None), (1, "A2", "SX"), (2, "  ", None), (3, "ZZ", None), (4, None, None)], REQ)
    out = {r.input_row_id: r for r in scoring.score_batch(req, feats).collect()}
    assert len(out) == 5
    assert out[0].supplier_id == "S1" and out[0].risk_score == pytest.approx(0.933333)
    assert out[0].risk_band == "high" and len(out[0].top_factors) == 5
    assert out[1].supplier_id == "SX" and out[1].risk_score == 0.0
    assert out[2].error == scoring.ERR_BLANK and out[2].risk_score is None and out[2].top_factors == []
    assert out[3].error == scoring.ERR_NOT_FOUND and out[3].risk_score is None
    assert out[4].error == scoring.ERR_BLANK


def test_score_batch_explain_off_and_unmatched_score(spark):
    feats = spark.createDataFrame(F6, FEAT)
    req = spark.createDataFrame([(0, "A1", None), (1, "ZZ", None)], REQ)
    out = {r.input_row_id: r for r in scoring.score_batch(req, feats, explain=False).collect()}
    assert out[0].top_factors == []
    m = LinearModel(list(scoring.FEATURE_COLS), [0.1] * 5, -1.0)
    out = {r.input_row_id: r for r in scoring.score_batch(req, feats, model=m, top_k=3).collect()}
    assert len(out[0].top_factors) == 3 and 0 <= out[0].risk_score <= 1
    loose = {r.input_row_id: r for r in scoring.score_batch(req, feats, unmatched="score").collect()}
    assert loose[1].error is None and loose[1].risk_score == 0.0


def test_no_features_and_validate(spark):
    empty = spark.createDataFrame([], FEAT)
    req = spark.createDataFrame([(0, "A1", None), (1, "", None)], REQ)
    out = {r.input_row_id: r for r in scoring.score_batch(req, empty).collect()}
    assert out[0].error == scoring.ERR_NO_FEATURES and out[1].error == scoring.ERR_BLANK
    v = {r.input_row_id: r for r in scoring.validate_batch(req, empty).collect()}
    assert v[0].error == scoring.ERR_NO_FEATURES and not v[0].valid
    feats = spark.createDataFrame(F6[:1], FEAT)
    req2 = spark.createDataFrame([(0, "A1", None), (1, "A2", None)], REQ)
    v = {r.input_row_id: r for r in scoring.validate_batch(req2, feats).collect()}
    assert v[0].valid and v[0].error is None
    assert not v[1].valid and v[1].error == scoring.ERR_NOT_FOUND


def test_graph_join_in_batch(spark):
    feats = spark.createDataFrame(F6, FEAT)
    graph = spark.createDataFrame([("S1", 5, 0.2, 1), ("S1", None, None, 3), ("S2", 1, 0.0, 4)],
                                  "supplier_id string, degree long, betweenness double, distance_to_sanctioned long")
    req = spark.createDataFrame([(0, "A1", None), (1, "A2", None)], REQ)
    out = {r.input_row_id: r for r in scoring.score_batch(req, feats, graph=graph).collect()}
    assert out[0].degree == 5 and out[1].distance_to_sanctioned == 4

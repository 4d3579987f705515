"""NaN, infinities and text count as missing; lengths and limits are checked."""
import math

import pytest

from bidlens.functions.common import missing_path
from bidlens.operators import features as feat
from bidlens.operators import model as mdl
from bidlens.operators import scoring
from bidlens.operators.graph import bipartite_graph
from bidlens.plans import jobs

NAN, INF = float("nan"), float("inf")


def tenders(spark):
    return spark.createDataFrame([("t1", "b1", "B", "works", "2024-01-01")],
                                 "tender_id string, buyer_id string, buyer_name string, main_category string, tender_date string")


def test_one_nan_amount_leaves_its_category_alone(spark):
    rows = [("a1", "t1", "s", "S", "100"), ("a2", "t1", "s", "S", "300"), ("a3", "t1", "s", "S", "NaN"),
            ("a4", "t1", "s", "S", "Infinity"), ("a5", "t1", "s", "S", "n/a")]
    aw = spark.createDataFrame(rows, "award_id string, tender_id string, supplier_id string, supplier_name string, amount string")
    z = {r.award_id: r.amount_zscore_by_category
         for r in feat.build_features(tenders(spark), aw, order_key=["award_id"]).collect()}
    assert z == {"a1": -1.0, "a2": 1.0, "a3": 0.0, "a4": 0.0, "a5": 0.0}
    _, e = bipartite_graph(tenders(spark), aw)
    assert e.first().total_amount == 400.0


FEATURES = ("award_id string, supplier_id string, award_concentration_by_buyer double, repeat_winner_ratio double, "
            "amount_zscore_by_category double, near_threshold_flag int, time_to_award_days int")


def test_a_nan_feature_scores_like_a_null_one(spark):
    m = scoring.LinearModel(list(feat.FEATURE_COLS), [0.4, 0.3, 2.0, 0.1, 0.01], -1.8)
    f = spark.createDataFrame([("n", "s", 0.2, 0.1, None, 0, 3), ("x", "s", 0.2, 0.1, NAN, 0, 3),
                               ("i", "s", 0.2, 0.1, INF, 0, 3)], FEATURES)
    req = spark.createDataFrame([(i, a) for i, a in enumerate("nxi")], "input_row_id long, award_id string")
    for model in (None, m):
        rows = scoring.score_batch(req, f, model=model).collect()
        assert len({(r.risk_score, r.risk_band) for r in rows}) == 1
        assert not any(v is not None and math.isnan(v) for r in rows for t in r.top_factors for v in (t.value, t.contribution))
    assert {r.label for r in mdl.proxy_label(f).collect()} == {0}


def test_top_k_and_lengths_are_checked(spark):
    f = spark.createDataFrame([("n", "s", 0.2, 0.1, None, 0, 3)], FEATURES)
    req = spark.createDataFrame([(0, "n")], "input_row_id long, award_id string")
    for k in (0, 21):
        with pytest.raises(ValueError, match="top_k"):
            scoring.score_batch(req, f, top_k=k)
    with pytest.raises(ValueError, match="coefficients"):
        scoring.linear_score(f, scoring.LinearModel(list(feat.FEATURE_COLS), [1.0], 0.0))


def test_blank_requests_stay_out_of_the_join(spark):
    f = spark.createDataFrame([("", "blank", 1.0, 1.0, 9.0, 1, 0), ("a", "s", 0.2, 0.1, 0.0, 0, 3)], FEATURES)
    req = spark.createDataFrame([(i, "" if i % 2 else "a") for i in range(50)], "input_row_id long, award_id string")
    got = scoring.score_batch(req, f, dedupe_features=False).collect()
    assert len(got) == 50
    assert all((r.error == scoring.ERR_BLANK) == (r.award_id == "") and (r.risk_score is None) == (r.award_id == "")
               and r.supplier_id == ("s" if r.award_id else None) for r in got)
    ok = scoring.validate_batch(req, f).collect()
    assert sum(r.valid for r in ok) == 25 and len(ok) == 50


def test_unique_features_join_as_two_shuffles(spark):
    f = spark.createDataFrame([("a", "s", 0.2, 0.1, 0.0, 0, 3)], FEATURES)
    req = spark.createDataFrame([(0, "a")], "input_row_id long, award_id string")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scoring.score_batch(req, f, dedupe_features=False)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert plan.count("SortMergeJoin") == 1 and plan.count("ENSURE_REQUIREMENTS") == 2
    assert "Aggregate" not in plan


def test_duplicate_features_give_the_same_answer_every_time(spark):
    rows = [("a", None, 0.2, None, 0.0, 0, 3), ("a", "s2", 0.5, 0.9, 1.0, 0, 3), ("a", "s1", 0.1, 0.4, None, 1, 9)]
    f = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], FEATURES + ", pos int")
    req = spark.createDataFrame([(0, "a")], "input_row_id long, award_id string")
    want = scoring.score_batch(req, f).first()
    for _ in range(3):
        assert scoring.score_batch(req, f.repartition(3)).first() == want
    by_pos = scoring.score_batch(req, f, feature_order="pos").first()
    assert by_pos.supplier_id == "s2" and by_pos.top_factors[0].value == 0.9


def test_only_a_missing_path_reads_as_empty(spark, tmp_dir):
    assert jobs.read_parquet_or_empty(spark, f"{tmp_dir}/none", "a int").count() == 0
    assert mdl.load_model(spark, f"{tmp_dir}/none") is None
    open(f"{tmp_dir}/bad.parquet", "w").write("no parquet file")
    with pytest.raises(Exception):
        jobs.read_parquet_or_empty(spark, f"{tmp_dir}/bad.parquet", "a int").count()
    assert not missing_path(ValueError("x"))


def test_checkpoint_folder_must_be_named_on_a_cluster(spark):
    from types import SimpleNamespace

    from bidlens.session import checkpoint_dir
    sc = SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077", setCheckpointDir=lambda d: None)
    fake = SimpleNamespace(sparkContext=sc, conf=SimpleNamespace(get=lambda k, d=None: None))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        checkpoint_dir(fake)
    sc.master = "local[4]"
    assert checkpoint_dir(fake)

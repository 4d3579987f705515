import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlens.functions.common import first_non_null, first_non_null_repeated, keep_first
from bidlens.operators import features as feat
from bidlens.operators import model as mdl
from bidlens.operators import ranking
from bidlens.operators import report as rep
from bidlens.operators import scoring


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_keep_first_packs_order_columns_once(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), (None, 5, "z"), (None, 5, "w")], "k string, o int, v string")
    out = keep_first(df, "k", ["o"])
    assert out.columns == df.columns
    assert {(r.k, r.o, r.v) for r in out.collect()} == {("a", 1, "y"), (None, 5, "w")}
    packed = plan(out).split("min(struct(")[1].split(")")[0]
    assert packed.count("#") == 2, packed


def test_first_non_null_only_folds_repeated_keys(spark):
    rows = [("a", 1.0, None), ("a", None, "y"), ("b", 2.0, "z"), (None, 3.0, None), (None, None, "n")]
    df = spark.createDataFrame(rows, "k string, x double, s string")
    want = sorted(map(str, first_non_null(df, "k").collect()))
    assert sorted(map(str, first_non_null_repeated(df, "k").select("k", "x", "s").collect())) == want
    unique = df.where("k = 'b'")
    assert "Aggregate" not in plan(first_non_null_repeated(unique, "k"))
    assert [tuple(r) for r in first_non_null_repeated(unique, "k").collect()] == [("b", 2.0, "z")]


def test_factors_sort_without_functions_over_elements(spark):
    m = scoring.LinearModel(["a", "b", "c"], [1.0, -1.0, 2.0], 0.0)
    df = spark.createDataFrame([(1, 3.0, -3.0, 1.0), (2, None, math.nan, None), (3, 0.5, 4.0, -2.0)], "i int, a double, b double, c double")
    out = scoring.linear_score(df, m, top_k=2)
    assert "lambda" not in plan(out)
    got = {r.i: [tuple(f) for f in r.top_factors] for r in out.collect()}
    assert got == {1: [("a", 3.0, 3.0), ("b", -3.0, 3.0)], 2: [("a", 0.0, 0.0), ("b", 0.0, -0.0)],
                   3: [("b", 4.0, -4.0), ("c", -2.0, -4.0)]}
    shown = out.select("i", rep.factor_preview("top_factors", 3).alias("p"))
    assert "lambda" not in plan(shown) and {r.i: r.p for r in shown.collect()}[1] == "a=3.0 (+3.000); b=-3.0 (+3.000)"


def test_rows_are_narrow_before_they_are_shuffled_for_counts(spark):
    t = spark.createDataFrame([("t1", "B", "c1", "2020-01-01"), ("t2", "C", "c2", "2020-01-01")],
                              "tender_id string, buyer_name string, main_category string, tender_date string")
    a = spark.createDataFrame([("a1", "t1", "s", 10.0, "2020-01-03", 0), ("a1", "t2", "s", 20.0, "2020-01-03", 1), ("a2", "t1", "r", 30.0, None, 2)],
                              "award_id string, tender_id string, supplier_id string, amount double, date string, pos int")
    f = feat.build_features(t, a, ["pos"])
    lazy = feat.build_features(t, a, ["pos"], materialize=False)
    assert sorted(map(str, f.collect())) == sorted(map(str, lazy.collect()))
    text = plan(f)
    assert text.index("__pb") < text.index("__cc")  # categories are joined below the pair counts
    assert "rightHint=(strategy=broadcast)" in text or "broadcast" in text.lower()
    assert {(r.award_id, r.time_to_award_days) for r in f.select(F.col("award_id"), "time_to_award_days").collect()} == {("a1", 2), ("a2", 0)}


def test_rows_are_narrow_before_the_first_of_an_award_is_kept(spark):
    t = spark.createDataFrame([("t1", "B", "c1", "2020-01-01")], "tender_id string, buyer_name string, main_category string, tender_date string")
    a = spark.createDataFrame([("a1", "t1", "s", 10.0, "2020-01-03", 0), ("a1", "t1", "r", 20.0, "2020-01-04", 1)],
                              "award_id string, tender_id string, supplier_id string, amount double, date string, pos int")
    f = feat.build_features(t, a, ["pos"])
    packed = plan(f).split("min(struct(")[1].split(")")[0]
    assert "__category" not in packed and "__award_ts" not in packed and "amount_zscore_by_category" in packed
    assert [(r.award_id, r.supplier_id, r.amount_zscore_by_category, r.time_to_award_days) for r in f.collect()] == [("a1", "s", -1.0, 2)]


def test_quantiles_of_many_values_rank_only_those_near(spark, monkeypatch):
    x = [((i * 7919) % 1000) ** 1.5 for i in range(3000)] + [5.0] * 900 + [math.nan, None]
    df = spark.createDataFrame([(v,) for v in x], "x double")
    probs = [0.0, 0.1, 0.33, 0.66, 1.0]
    want = np.quantile([v for v in x if v is not None and not math.isnan(v)], probs)
    assert ranking.exact_quantiles(df, "x", probs, few=100) == pytest.approx(list(want), rel=1e-12)
    seen, ranked = [], ranking._ranked
    monkeypatch.setattr(ranking, "_ranked", lambda v, *rest: seen.append(v.count()) or ranked(v, *rest))
    ranking.exact_quantiles(df, "x", [0.66], few=100)
    assert seen[0] < 200
    monkeypatch.setattr(ranking, "_between", lambda *args: None)
    assert ranking.exact_quantiles(df, "x", probs, few=100) == pytest.approx(list(want), rel=1e-12)


def test_calibration_passes_over_rows_as_they_are(spark, monkeypatch):
    df = spark.createDataFrame([(i % 5 / 4, i % 3 / 2, (i % 7) - 3.0, i % 4 // 3, i) for i in range(60)],
                               "award_concentration_by_buyer double, repeat_winner_ratio double, amount_zscore_by_category double, "
                               "near_threshold_flag int, time_to_award_days int")
    m = scoring.LinearModel(["amount_zscore_by_category"], [1.0], 0.0)
    group = type(df).groupBy
    monkeypatch.setattr(type(df), "groupBy", lambda d, *by: pytest.fail("rows are grouped by score") if by else group(d))
    a, b = mdl.calibrate(df, m).calibration
    assert math.isfinite(a) and math.isfinite(b) and a > 0

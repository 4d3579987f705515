import glob
import json
import time

from pyspark.sql import functions as F

from bidlens.operators import report as rep
from bidlens.operators import runlog as rl

F11 = [("A1", "S1", 0.87, [("repeat_winner_ratio", 0.9, None), ("amount_zscore_by_category", 2.1, None)], None),
       ("A2", "S2", 0.12, [("time_to_award_days", 95.0, 0.25)], ""),
       ("A3", "S3", 0.55, None, "award_id not found in features")]
DDL = ("award_id string, supplier_id string, risk_score double, "
       "top_factors array<struct<name:string,value:double,contribution:double>>, error string")


def test_flatten_f11(spark):
    df = spark.createDataFrame(F11, DDL)
    flat = {r.award_id: r for r in rep.flatten_factors(df).collect()}
    assert flat["A1"].top_factor_1_name == "repeat_winner_ratio" and flat["A1"].top_factor_2_value == "2.1"
    assert flat["A2"].top_factor_2_name == "" and flat["A3"].top_factor_1_name == ""
    assert "top_factors" not in rep.flatten_factors(df).columns
    prev = {r.award_id: r.p for r in df.select("award_id", rep.factor_preview().alias("p")).collect()}
    assert prev["A1"] == "repeat_winner_ratio=0.9; amount_zscore_by_category=2.1"
    assert prev["A2"] == "time_to_award_days=95.0 (+0.250)" and prev["A3"] == ""


def test_split_filter_top(spark):
    df = spark.createDataFrame(F11, DDL).withColumn("risk_band", F.lit("high"))
    ok, bad = rep.split_errors(df)
    assert sorted(r.award_id for r in ok.collect()) == ["A1", "A2"] and bad.count() == 1
    assert [r.award_id for r in rep.top_risk(df, 2).collect()] == ["A1", "A3"]
    assert rep.band_filter(df, ["low"]).count() == 0
    assert [r.risk_band for r in rep.distinct_bands(df).collect()] == ["high"]


def test_csv_bom(spark, tmp_dir):
    df = spark.createDataFrame([("A1", 0.1, "f1", 1.23)], "award_id string, risk_score double, n string, v double")
    rep.write_csv_bom(df.coalesce(1), f"{tmp_dir}/out")
    txt = open(glob.glob(f"{tmp_dir}/out/*.csv")[0], encoding="utf-8").read()
    assert txt.startswith("﻿award_id,")
    assert txt.lstrip("﻿").splitlines()[1] == "A1,0.1,f1,1.23"


def test_dataset_status_f13(spark, tmp_dir):
    paths = {}
    for name, n in [("features", 5), ("graph", 2), ("sanctions", 7), ("tenders", 11), ("awards", 13)]:
        p = f"{tmp_dir}/{name}.parquet"
        spark.range(n).withColumnRenamed("id", "x").write.parquet(p)
        paths[name] = p
    paths["missing"] = f"{tmp_dir}/nope.parquet"
    got = {r.dataset: (r.rows, r.available) for r in rl.dataset_status(spark, paths).collect()}
    assert got == {"features": (5, True), "graph": (2, True), "sanctions": (7, True), "tenders": (11, True),
                   "awards": (13, True), "missing": (None, False)}


def test_run_log_append_and_rollup(spark, tmp_dir):
    t0 = time.time()
    payload = {"items": [{"award_id": f"A{i}"} for i in range(10)]}
    r1 = rl.run_record(spark, "/v1/score/batch", t0, num_items=10, payload=payload,
                       paths={"features_path": "f.parquet"}, used_model=False, join_graph=False, explain=True)
    r2 = rl.run_record(spark, "/v1/score/validate", t0, status="error", error="validation", num_items=2)
    assert rl.append_run_log(r1, f"{tmp_dir}/log") and rl.append_run_log(r2, f"{tmp_dir}/log")
    log = rl.read_run_log(spark, f"{tmp_dir}/log")
    rec = log.filter("endpoint = '/v1/score/batch'").first()
    assert rec.request_id == r1.first().request_id and rec.features_path == "f.parquet"
    assert len(json.loads(rec.payload_preview)["items"]) == 3
    roll = {(r.endpoint, r.status): r for r in rl.run_rollup(log).collect()}
    assert roll[("/v1/score/batch", "ok")].items == 10 and roll[("/v1/score/validate", "error")].requests == 1
    items = {(r.used_model, r.join_graph, r.explain): r.items for r in rl.items_rollup(log).collect()}
    assert items[(False, False, True)] == 10 and items[(None, None, None)] == 2
    assert rl.append_run_log(r1, "/proc/forbidden/log") is False

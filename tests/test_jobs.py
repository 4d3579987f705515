"""End-to-end jobs on landed files: releases → curated tables → features →
graph → model → batch scoring with run log (the sinks SNK-01..10)."""
import glob
import json
import os

from pyspark.sql import functions as F

from bidlens.plans import jobs


def _release(i, buyer, supplier, amount):
    return {"ocid": f"ocds-{i}", "id": str(i), "date": f"2024-01-{1 + i % 20:02d}T00:00:00Z",
            "tender": {"id": f"T{i}", "mainProcurementCategory": ["goods", "works"][i % 2],
                       "value": {"amount": amount, "currency": "USD"}},
            "buyer": {"id": buyer, "name": f"Buyer {buyer}"},
            "parties": [{"id": supplier, "name": f"Supplier {supplier}", "roles": ["supplier"],
                         "address": {"countryName": "Kenya"}}],
            "awards": [{"id": f"A{i}", "date": f"2024-02-{1 + i % 20:02d}T00:00:00Z", "status": "active",
                        "value": {"amount": amount, "currency": "USD"},
                        "suppliers": [{"id": supplier, "name": f"Supplier {supplier}"}]}]}


def test_pipeline_end_to_end(spark, tmp_dir):
    rels = [_release(i, f"B{i % 3}", f"S{i % 4}", [10000, 52000, 7000, 250000, 31000][i % 5]) for i in range(40)]
    src = os.path.join(tmp_dir, "in")
    os.makedirs(src)
    with open(os.path.join(src, "releases.jsonl"), "w") as f:
        f.write("\n".join(json.dumps(r) for r in rels) + "\n{broken\n")
    cur = os.path.join(tmp_dir, "curated")
    counts = jobs.ingest_releases(spark, os.path.join(src, "releases.jsonl"), cur)
    assert (counts["tenders"], counts["awards"], counts["suppliers"]) == (40, 40, 4)
    assert spark.read.parquet(f"{cur}/_quarantine").count() == 1
    assert glob.glob(f"{cur}/_counts_*")

    with open(os.path.join(src, "sanctions.csv"), "w") as f:
        f.write("Firm Name,Country,Grounds,From,To\nSupplier S1,Kenya,Fraud,29-JUN-2016,Ongoing\n")
    sanc = jobs.ingest_sanctions(spark, os.path.join(src, "sanctions.csv"), cur, "http://list")
    assert spark.read.parquet(sanc).first().start_date == "2016-06-29"

    feats = jobs.features_job(spark, f"{cur}/tenders.parquet", f"{cur}/awards.parquet",
                              os.path.join(tmp_dir, "features.parquet"))
    f = spark.read.parquet(feats)
    assert f.count() == 40 and f.filter("near_threshold_flag = 1").count() == 24

    gpath = jobs.graph_job(spark, f"{cur}/tenders.parquet", f"{cur}/awards.parquet", sanc, tmp_dir,
                           ego_supplier_id="S1")
    g = {r.supplier_id: r for r in spark.read.parquet(gpath).collect()}
    assert g["S1"].distance_to_sanctioned == 0 and g["S0"].distance_to_sanctioned == 2
    assert os.path.exists(os.path.join(tmp_dir, "graph", "ego_S1.parquet"))

    meta = jobs.train_job(spark, feats, os.path.join(tmp_dir, "model"), calibrate=True)
    assert set(meta["last_evaluation"]) >= {"auc_roc", "avg_precision", "brier", "log_loss", "pos_rate", "n"}
    out_dir = jobs.evaluate_job(spark, feats, os.path.join(tmp_dir, "model"), os.path.join(tmp_dir, "metrics"))
    assert glob.glob(f"{out_dir}/*.json")
    info = jobs.model_info(spark, os.path.join(tmp_dir, "model"), os.path.join(tmp_dir, "metrics"))
    assert info["available"] and len(info["top_weights"]) == 5 and info["latest_evaluation"]["n"] == 40

    req = spark.createDataFrame([(i, f"A{i}" if i < 5 else "missing", None) for i in range(6)],
                                "input_row_id long, award_id string, supplier_id string")
    scored = jobs.batch_job(spark, req, feats, os.path.join(tmp_dir, "scored"), graph_path=gpath,
                            model_dir=os.path.join(tmp_dir, "model"), top_k=3,
                            run_log_path=os.path.join(tmp_dir, "log"))
    rows = scored.orderBy("input_row_id").collect()
    assert len(rows) == 6 and rows[5].error is not None and all(r.risk_band for r in rows[:5])
    assert all(len(r.top_factors) == 3 for r in rows[:5]) and rows[0].degree is not None
    log = spark.read.json(os.path.join(tmp_dir, "log"))
    assert log.first().num_items == 6 and "date" in log.columns
    missing = jobs.read_parquet_or_empty(spark, os.path.join(tmp_dir, "nope"), "x long")
    assert missing.count() == 0


def test_projects_job_and_csv_features(spark, tmp_dir):
    pages = os.path.join(tmp_dir, "pages")
    os.makedirs(pages)
    for off, recs in [(0, {"P1": {"id": "P1", "countrycode": ["KE"]}}), (500, {}), (1000, {"P2": {"id": "P2"}})]:
        with open(os.path.join(pages, f"page_{off}.json"), "w") as f:
            json.dump({"projects": recs, "total": 2}, f)
    out = jobs.ingest_projects(spark, pages, tmp_dir)
    rows = spark.read.parquet(out).collect()
    by = {r.id: r for r in rows}  # every landed page counts, also those after an empty one
    assert set(by) == {"P1", "P2"} and by["P1"].countrycode == "KE"
    csv = os.path.join(tmp_dir, "f.csv")
    with open(csv, "w") as f:
        f.write("award_id,supplier_id,award_concentration_by_buyer,repeat_winner_ratio,amount_zscore_by_category,"
                "near_threshold_flag,time_to_award_days\nA1,S1,1.0,1.0,2.0,1,5\n")
    df = jobs.read_features_any(spark, csv)
    assert df.first().near_threshold_flag == 1 and df.schema["time_to_award_days"].dataType.simpleString() == "int"
    assert df.select(F.col("award_id")).first()[0] == "A1"

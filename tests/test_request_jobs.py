import json
import os

import pytest

from bidlens.operators import runlog as rl
from bidlens.operators import scoring
from bidlens.plans import jobs

FEATURES = ("award_id string, supplier_id string, award_concentration_by_buyer double, repeat_winner_ratio double, "
            "amount_zscore_by_category double, near_threshold_flag int, time_to_award_days int")


@pytest.fixture()
def features(spark, tmp_dir):
    p = f"{tmp_dir}/features"
    spark.createDataFrame([(f"a{i}", f"s{i}", 0.1 * i, 0.2, 0.5, i % 2, 10) for i in range(5)], FEATURES).write.parquet(p)
    return p


def log(spark, path):
    return [r.asDict() for r in rl.read_run_log(spark, path).collect()]


def test_requests_from_json_and_csv(spark, tmp_dir, features):
    items = [{"award_id": "a1"}, {"award_id": "", "supplier_id": "x"}, {"award_id": "zz"}, 7]
    open(f"{tmp_dir}/r.json", "w").write(json.dumps({"items": items}))
    open(f"{tmp_dir}/r.csv", "w").write("Award ID,Supplier ID\na1,\nzz,q\n")
    out = jobs.batch_job(spark, f"{tmp_dir}/r.json", features, f"{tmp_dir}/out", run_log_path=f"{tmp_dir}/log")
    rows = out.orderBy("input_row_id").collect()
    assert [r.award_id for r in rows] == ["a1", "", "zz", None]
    assert [r.error for r in rows] == [None, scoring.ERR_BLANK, scoring.ERR_NOT_FOUND, scoring.ERR_BLANK]
    csv = jobs.batch_job(spark, f"{tmp_dir}/r.csv", features, f"{tmp_dir}/out2", unique_features=True).collect()
    assert {r.award_id: (r.supplier_id, r.error) for r in csv} == {"a1": ("s1", None), "zz": ("q", scoring.ERR_NOT_FOUND)}
    rec = log(spark, f"{tmp_dir}/log")
    assert len(rec) == 1 and rec[0]["num_items"] == 4 and rec[0]["status"] == "ok" and rec[0]["used_model"] is False


def test_requests_from_a_folder_keep_rows_apart(spark, tmp_dir, features):
    os.makedirs(f"{tmp_dir}/in")
    for n in range(3):
        open(f"{tmp_dir}/in/p{n}.json", "w").write(json.dumps([{"award_id": "a1"}, {"award_id": f"a{n}"}]))
    rows = jobs.read_requests(spark, f"{tmp_dir}/in").collect()
    assert len(rows) == 6 and len({r.input_row_id for r in rows}) == 6


def test_validate_job(spark, tmp_dir, features):
    req = spark.createDataFrame([(0, "a3"), (1, " "), (2, "no")], "input_row_id long, award_id string")
    rows = jobs.validate_job(spark, req, features, f"{tmp_dir}/v", f"{tmp_dir}/log").orderBy("input_row_id").collect()
    assert [(r.valid, r.error) for r in rows] == [(True, None), (False, scoring.ERR_BLANK), (False, scoring.ERR_NOT_FOUND)]
    rows = jobs.validate_job(spark, req, f"{tmp_dir}/none", f"{tmp_dir}/v2").orderBy("input_row_id").collect()
    assert [r.error for r in rows] == [scoring.ERR_NO_FEATURES, scoring.ERR_BLANK, scoring.ERR_NO_FEATURES]
    assert log(spark, f"{tmp_dir}/log")[0]["num_items"] == 3


def test_record_score_job(spark, tmp_dir):
    rec = spark.createDataFrame([(1, 1e6, 10, True, 5), (2, -1.0, 0, False, 0), (3, None, None, None, None), (4, 5.0, 1, False, -2)],
                                "id int, amount double, past_awards_count long, is_sanctioned boolean, adverse_media_count long")
    rows = {r.id: r for r in jobs.record_score_job(spark, rec, f"{tmp_dir}/s", f"{tmp_dir}/log").collect()}
    assert rows[1].risk_score == 1.0 and rows[3].risk_score == 0.0
    assert rows[2].risk_score is None and "amount" in rows[2].error
    assert rows[4].risk_score is None and "adverse_media_count" in rows[4].error


def test_failures_are_logged_and_raised(spark, tmp_dir, features):
    req = spark.createDataFrame([(0, "a3")], "input_row_id long, award_id string")
    with pytest.raises(ValueError):
        jobs.batch_job(spark, req, features, f"{tmp_dir}/o", top_k=99, run_log_path=f"{tmp_dir}/log")
    with pytest.raises(Exception):
        jobs.validate_job(spark, f"{tmp_dir}/missing.csv", features, f"{tmp_dir}/o", run_log_path=f"{tmp_dir}/log")
    got = {r["endpoint"]: r for r in log(spark, f"{tmp_dir}/log")}
    assert {r["status"] for r in got.values()} == {"error"} and len(got) == 2
    assert "top_k" in got["/v1/score/batch"]["error"]


def test_page_tables_as_a_sanctions_sheet(spark):
    from bidlens.sources import pages as pg
    from bidlens.sources import sanctions as sanc
    html = ("<table><tr><th>Firm Name</th><th>Country</th><th>From</th></tr><tr><td>Brno Cranes</td><td>Chad</td>"
            "<td>2 May 2020</td></tr><tr><td>BRNO cranes</td><td>Peru</td><td>2020-05-02</td></tr></table>")
    pages = spark.createDataFrame([(1, "http://h/", html), (2, "http://h/2", "<p>none</p>")], "page_id long, url string, html string")
    sheet = pg.table_sheet(pg.html_tables(pages))
    rows = sanc.normalize_sanctions(sheet, "u", "t").collect()
    assert {r.name for r in rows} <= {"Brno Cranes", "BRNO cranes"}
    assert sheet.count() == 2 and {"Firm Name", "Country", "From"} <= set(sheet.columns)

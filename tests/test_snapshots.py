import json
import os
import random
import time
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from bidlens.operators import runlog as rl
from bidlens.plans import jobs, lookups
from bidlens.plans import snapshots as sn


def test_a_failed_job_leaves_the_old_version(spark, tmp_dir):
    t = f"{tmp_dir}/t.parquet"
    sn.publish(spark.range(5), t)
    bad = spark.range(10).select(F.when(F.col("id") > 7, F.raise_error(F.lit("boom")).cast("long")).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="boom"):
        sn.publish(bad, t)
    assert sn.read_published(spark, t).count() == 5
    reader = sn.read_published(spark, t)  # keeps its version while another is committed
    sn.publish(spark.range(7), t)
    assert reader.count() == 5 and sn.read_published(spark, t).count() == 7
    sn.publish(spark.range(2), t)
    assert sn.drop_old(spark, t, keep=1) == 2 and sn.read_published(spark, t).count() == 2
    assert sn.drop_old(spark, t, keep=1) == 0


def test_ingest_fails_half_way(spark, tmp_dir, monkeypatch):
    rel = {"ocid": "o1", "tender": {"id": "T1"}, "awards": [{"id": "A1", "suppliers": [{"id": "S", "name": "s"}]}]}
    open(f"{tmp_dir}/a.jsonl", "w").write(json.dumps(rel) + "\n")
    jobs.ingest_releases(spark, f"{tmp_dir}/a.jsonl", f"{tmp_dir}/out")
    open(f"{tmp_dir}/a.jsonl", "w").write(json.dumps(rel) + "\n" + json.dumps({**rel, "ocid": "o2"}) + "\n")
    monkeypatch.setattr(jobs.ocds, "suppliers", lambda r: r.select(F.raise_error(F.lit("lost")).alias("x")))
    with pytest.raises(Exception, match="lost"):
        jobs.ingest_releases(spark, f"{tmp_dir}/a.jsonl", f"{tmp_dir}/out")
    assert sn.read_published(spark, f"{tmp_dir}/out/suppliers.parquet").count() == 1
    assert sn.read_published(spark, f"{tmp_dir}/out/awards.parquet").count() >= 1


def write_pull(folder, records):
    os.makedirs(folder)
    for i in range(0, len(records), 7):
        open(f"{folder}/page_{i}.json", "w").write(json.dumps({"projects": {r["id"]: r for r in records[i:i + 7]}, "total": 9}))


def test_pulls_add_up_to_a_full_pull(spark, tmp_dir):
    rng = random.Random(5)
    day = lambda d: f"2024-01-{d:02d} 10:00:00"
    first = [{"id": f"P{i}", "project_name": f"n{i}", "countrycode": ["KE"], "p2a_updated_date": day(1 + i % 9)} for i in range(60)]
    later = [{**r, "project_name": r["project_name"] + "+", "p2a_updated_date": day(10 + rng.randrange(5))}
             for r in rng.sample(first, 6)] + [{"id": "Q1", "p2a_updated_date": day(12)}, {"id": "Q2"}]
    write_pull(f"{tmp_dir}/p1", first)
    write_pull(f"{tmp_dir}/p2", later)
    t = f"{tmp_dir}/projects"
    jobs.pull_projects(spark, f"{tmp_dir}/p1", t, buckets=32)
    before = sn.current(spark, t)["bucket_folders"]
    got = jobs.pull_projects(spark, f"{tmp_dir}/p2", t)
    after = sn.current(spark, t)["bucket_folders"]
    moved = {b for b in after if after[b] != before.get(b)}
    assert len(moved) == got["changed_buckets"] <= 8 and got["mark"] == sn.high_water(spark, t) >= day(10)
    newest = {}
    for r in [*first, *later]:
        newest[r["id"]] = r
    rows = {r.id: r for r in sn.read_published(spark, t).collect()}
    assert set(rows) == set(newest) and sn.read_published(spark, t).count() == len(newest)
    assert all(rows[k].project_name == newest[k].get("project_name") for k in newest)
    jobs.pull_projects(spark, f"{tmp_dir}/p2", t)  # a retry changes nothing
    assert sorted(map(str, sn.read_published(spark, t).collect())) == sorted(map(str, rows.values()))
    jobs.pull_projects(spark, f"{tmp_dir}/p1", t)  # older than the mark
    assert sorted(map(str, sn.read_published(spark, t).collect())) == sorted(map(str, rows.values()))


def test_lookups_read_the_requested_buckets(spark, tmp_dir):
    df = spark.range(4000).select(F.concat(F.lit("A"), "id").alias("award_id"), (F.col("id") * 2).alias("x"))
    lookups.publish_lookup(df, f"{tmp_dir}/f", "award_id", 16)
    table = sn.read_published(spark, f"{tmp_dir}/f")
    req = spark.createDataFrame([("A5",), ("nope",), (None,)], "award_id string")
    part = lookups.requested(table, req)
    assert part.columns == ["award_id", "x"] and part.where("award_id = 'A5'").first().x == 10
    part.collect()
    plan = part._jdf.queryExecution().executedPlan()
    assert "bucket#" in plan.toString().split("PartitionFilters")[1].split("]")[0]
    while plan.children().size():  # down to the scan
        plan = plan.children().apply(0)
    read = plan.metrics().apply("numFiles").value()
    assert 0 < read <= 12 < len(table.inputFiles())  # three of sixteen buckets, four files each
    assert lookups.requested(df, req) is df
    empty = lookups.requested(table, req.where("false"))
    assert empty.columns == ["award_id", "x"]


def test_batch_over_a_bucketed_feature_table(spark, tmp_dir):
    t = spark.createDataFrame([("T1", "B", "goods", None)], "tender_id string, buyer_name string, main_category string, tender_date string")
    a = spark.createDataFrame([(f"A{i}", "T1", "S", "s", float(i), None) for i in range(50)],
                              "award_id string, tender_id string, supplier_id string, supplier_name string, amount double, date string")
    sn.publish(t, f"{tmp_dir}/t")
    sn.publish(a, f"{tmp_dir}/a")
    plain = jobs.features_job(spark, f"{tmp_dir}/t", f"{tmp_dir}/a", f"{tmp_dir}/f1")
    jobs.features_job(spark, f"{tmp_dir}/t", f"{tmp_dir}/a", f"{tmp_dir}/f2", buckets=8)
    req = spark.createDataFrame([(0, "A7"), (1, "zz"), (2, "")], "input_row_id long, award_id string")
    one = jobs.batch_job(spark, req, plain, f"{tmp_dir}/o1").orderBy("input_row_id").collect()
    two = jobs.batch_job(spark, req, f"{tmp_dir}/f2", f"{tmp_dir}/o2").orderBy("input_row_id").collect()
    assert one == two and one[0].error is None


def record(spark, i, day):
    now = datetime(2024, 3, day, 12, tzinfo=timezone.utc)
    return rl.run_record(spark, "/v1/score/batch", now.timestamp() - i / 1000, num_items=i, now=now)


def test_run_log_once_and_compacted(spark, tmp_dir):
    log = f"{tmp_dir}/log"
    for day in (1, 2):
        for i in range(4):
            r = record(spark, 10 * day + i, day)
            r = spark.createDataFrame(r.collect(), r.schema)  # one run id, appended twice
            assert rl.append_run_log(r, log) and rl.append_run_log(r, log)
    rows = rl.read_run_log(spark, log)
    assert rows.count() == 8 and sorted(r.num_items for r in rows.collect()) == [10, 11, 12, 13, 20, 21, 22, 23]
    before = sorted(map(str, rows.collect()))
    assert rl.compact_run_log(spark, log, before="2024-03-02") == 4
    assert sorted(map(str, rl.read_run_log(spark, log).collect())) == before
    assert len(os.listdir(f"{log}/date=2024-03-01")) == 1 and len(os.listdir(f"{log}/date=2024-03-02")) == 4
    late = record(spark, 99, 1)
    rl.append_run_log(spark.createDataFrame(late.collect(), late.schema), log)  # a record of a compacted day
    assert rl.compact_run_log(spark, log, before="2024-03-03") == 6
    assert rl.read_run_log(spark, log).count() == 9
    assert all(len(os.listdir(f"{log}/date=2024-03-0{d}")) == 1 for d in (1, 2))


def test_latency_sketches_merge(spark):
    rng = random.Random(8)
    rows = [(f"2024-01-{1 + i % 5:02d}", "/a", "ok", int(rng.expovariate(0.01)), 1) for i in range(20000)]
    rows += [("2024-01-01", "/b", "error", None, None), ("2024-01-02", "/b", "error", 7, 3)]
    log = spark.createDataFrame(rows, "date string, endpoint string, status string, duration_ms long, num_items long")
    got = {r.endpoint: r for r in rl.latency_rollup(rl.latency_state(log)).collect()}
    ms = sorted(r[3] for r in rows[:-2])
    for q, v in zip((0.5, 0.9, 0.99), got["/a"].p50_p90_p99_ms):
        rank = sum(x <= v for x in ms) / len(ms)
        assert abs(rank - q) < 0.02
    assert got["/a"].requests == 20000 and got["/a"].max_ms == ms[-1] and abs(got["/a"].avg_ms - sum(ms) / len(ms)) < 1e-6
    assert got["/b"].requests == 2 and got["/b"].p50_p90_p99_ms == [7, 7, 7] and got["/b"].items == 3

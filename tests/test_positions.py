import json
import os
import random

import pytest
from pyspark.sql import functions as F

from bidlens.operators import positions
from bidlens.plans import jobs

FEATURES = ("award_id string, supplier_id string, award_concentration_by_buyer double, repeat_winner_ratio double, "
            "amount_zscore_by_category double, near_threshold_flag int, time_to_award_days int")


@pytest.fixture()
def small_splits(spark):
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_csv_rows_follow_file_and_line(spark, tmp_dir, small_splits):
    rng, want = random.Random(1), []
    for name, n in (("a", 2), ("b", 3000), ("c", 0), ("d", 700), ("e", 1)):
        ids = [f"{name}{i}-{rng.randrange(10 ** rng.randint(1, 9))}" for i in range(n)]
        open(f"{tmp_dir}/{name}.csv", "w").write("Award ID,Supplier ID\n" + "".join(f"{x},s\n" for x in ids))
        want += ids
    rows = jobs.read_requests(spark, f"{tmp_dir}/*.csv")
    assert spark.read.csv(f"{tmp_dir}/*.csv").rdd.getNumPartitions() > 1
    got = sorted((r.input_row_id, r.award_id) for r in rows.collect())
    assert got == list(enumerate(want))
    first = jobs.read_requests(spark, f"{tmp_dir}/*.csv", max_items=5)
    assert sorted(r.award_id for r in first.collect()) == sorted(want[:5])


def test_payload_items_follow_file_and_place(spark, tmp_dir):
    want = []
    for k, n in enumerate((3, 0, 1, 120, 2)):
        items = [{"award_id": f"p{k}-{i}"} for i in range(n)]
        want += [x["award_id"] for x in items]
        open(f"{tmp_dir}/p{k}.json", "w").write(json.dumps(items if k % 2 else {"items": items}))
    got = sorted((r.input_row_id, r.award_id) for r in jobs.read_requests(spark, tmp_dir).collect())
    assert got == list(enumerate(want))
    assert jobs.read_requests(spark, tmp_dir, max_items=0).count() == 0


def test_jobs_keep_request_order_and_cap(spark, tmp_dir):
    spark.createDataFrame([("a1", "s1", 0.1, 0.2, 0.5, 1, 10)], FEATURES).write.parquet(f"{tmp_dir}/f")
    os.makedirs(f"{tmp_dir}/in")
    for k in range(3):
        open(f"{tmp_dir}/in/r{k}.json", "w").write(json.dumps([{"award_id": "a1"}, {"award_id": f"x{k}"}]))
    out = jobs.batch_job(spark, f"{tmp_dir}/in", f"{tmp_dir}/f", f"{tmp_dir}/out", max_items=5)
    assert [r.award_id for r in out.orderBy("input_row_id").collect()] == ["a1", "x0", "a1", "x1", "a1"]
    table = spark.createDataFrame([(5, "a1"), (2, "no"), (9, "a1")], "input_row_id long, award_id string")
    rows = jobs.validate_job(spark, table, f"{tmp_dir}/f", f"{tmp_dir}/v", max_items=2).orderBy("input_row_id").collect()
    assert [(r.input_row_id, r.valid) for r in rows] == [(2, False), (5, True)]


def test_tables_with_their_own_ids(spark, tmp_dir):
    open(f"{tmp_dir}/t.csv", "w").write("input_row_id,award_id\n7,a\n3,b\n")
    rows = jobs.read_requests(spark, f"{tmp_dir}/t.csv", max_items=1).collect()
    assert [(r.input_row_id, r.award_id) for r in rows] == [(3, "b")]


def test_running_offsets(spark):
    rng = random.Random(3)
    rows = [(i, rng.randrange(5)) for i in range(1000)]
    df = spark.createDataFrame(rng.sample(rows, 1000), "k long, n long").repartition(13)
    got = {r.k: r.offset for r in positions.running_offsets(df, ["k"]).collect()}
    total, want = 0, {}
    for k, n in rows:
        want[k] = total
        total += n
    assert got == want
    assert positions.running_offsets(df.where("k < 0"), ["k"]).count() == 0


def test_empty_input(spark, tmp_dir):
    open(f"{tmp_dir}/t.csv", "w").write("award_id\n")
    assert jobs.read_requests(spark, f"{tmp_dir}/t.csv").count() == 0
    empty = spark.createDataFrame([], "file string, v array<int>")
    assert positions.element_positions(empty, F.col("v"), ["file"]).count() == 0

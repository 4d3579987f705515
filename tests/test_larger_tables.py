"""What larger tables need: products of shared ids dealt over tasks, parsed
releases stored instead of cached, files whose number grows with the rows."""

import glob
import json

from pyspark.sql import functions as F

from bidlens.functions.common import product_join
from bidlens.operators import features as feat
from bidlens.operators import graph as gr
from bidlens.plans import jobs, registry_jobs
from bidlens.sources import ocds

SF = "/root/testdata/sf0.001"


def _wide(spark):
    a = spark.range(400).selectExpr("CAST(NULL AS STRING) AS tender_id", "CONCAT('s', id % 300) AS s", "id AS n").unionByName(
        spark.createDataFrame([("t1", "s1", 7), ("t2", "s2", 8), ("none", "s3", 9)], "tender_id string, s string, n long"))
    t = spark.range(250).selectExpr("CAST(NULL AS STRING) AS tid", "CONCAT('b', id) AS b").unionByName(
        spark.createDataFrame([("t1", "b1"), ("t2", "b2"), ("t2", "b3")], "tid string, b string"))
    return a, t


def test_product_of_a_shared_id_is_dealt_and_whole(spark, monkeypatch):
    monkeypatch.setattr("bidlens.functions.common.DEAL_ROWS", 5000)
    a, t = _wide(spark)
    for how in ("inner", "left"):
        plain = a.join(t, F.col("tender_id").eqNullSafe(F.col("tid")), how)
        dealt = product_join(a, t, "tender_id", "tid", "s", how)
        assert dealt.columns == plain.columns
        assert sorted(map(str, dealt.collect())) == sorted(map(str, plain.collect()))


def test_shared_ids_of_graph_and_pairs_are_dealt(spark):
    tenders = spark.createDataFrame([(None, f"b{i}", f"B{i}", "c", "2024-01-01") for i in range(120)],
                                    "tender_id string, buyer_id string, buyer_name string, main_category string, tender_date string")
    awards = spark.createDataFrame([(f"a{i}", None, f"s{i}", f"S{i}", 1.0, "2024-01-02") for i in range(110)],
                                   "award_id string, tender_id string, supplier_id string, supplier_name string, amount double, date string")
    edges = gr.bipartite_graph(tenders, awards)[1]
    pairs = feat.concentration_totals(tenders, awards)
    for df in (edges, pairs):
        assert "__piece" in df._jdf.queryExecution().analyzed().toString()
        assert df.count() == 120 * 110
    assert edges.agg(F.sum("awards_count")).first()[0] == 120 * 110


def test_ingest_stores_parsed_releases_and_removes_them(spark, tmp_path, monkeypatch):
    lines = [json.dumps({"ocid": f"o{i}", "awards": [{"id": f"a{i}", "suppliers": [{"id": "s", "name": "S"}]}]}) for i in range(5)]
    (tmp_path / "in.jsonl").write_text("\n".join([*lines, '{"broken', " \t"]))

    def persist(*_, **__):
        raise AssertionError("cached rows spill to disk")
    monkeypatch.setattr(type(spark.range(1)), "persist", persist)
    counts = jobs.ingest_releases(spark, str(tmp_path / "in.jsonl"), str(tmp_path / "out"))
    assert (counts["tenders"], counts["awards"], counts["suppliers"]) == (5, 5, 1)
    assert spark.read.parquet(str(tmp_path / "out" / "_quarantine")).count() == 1
    assert not glob.glob(str(tmp_path / "out" / "_parsed_*"))


def test_narrow_types_read_odd_releases_like_the_whole(spark):
    odd = [{"ocid": "1", "tender": {"id": 5, "value": [1]}, "parties": [{"id": "p", "name": "P", "roles": "supplier", "address": 3}],
            "awards": [{"id": "a", "value": {"amount": "7"}}, {"id": "b", "suppliers": [{"name": "N"}], "date": {"x": 1}}]},
           {"ocid": "2", "tender": "none", "parties": {"id": "q", "roles": ["supplier"]}, "awards": {"id": "c", "suppliers": []}},
           {"ocid": "3", "parties": 4, "awards": [{"suppliers": "x"}, 5]}]
    text = spark.createDataFrame([(i, json.dumps(r)) for i, r in enumerate(odd)], "k int, value string")
    for table, fields in ((ocds.awards, ocds.AWARD_FIELDS), (ocds.suppliers, ocds.SUPPLIER_FIELDS)):
        assert isinstance(fields, dict)
        whole = table(ocds.parse_releases(text, order=F.col("k")))
        narrow = table(ocds.parse_releases(text, order=F.col("k"), fields=fields))
        assert sorted(map(str, narrow.collect())) == sorted(map(str, whole.collect()))
    assert table(ocds.parse_releases(text, order=F.col("k"))).count() > 0


def test_request_files_grow_with_the_rows(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry_jobs, "FILE_ROWS", 500)
    monkeypatch.setattr(registry_jobs, "scratch", lambda s, name: str(tmp_path / name))
    out = registry_jobs.q_requests_csv_order(spark, SF)
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert len(glob.glob(str(tmp_path / "requests" / "part-*"))) > 7
    assert out.agg(F.min("input_row_id"), F.max("input_row_id"), F.count_distinct("input_row_id")).first() == (0, n - 1, n)


def test_payloads_hold_more_orders_in_a_larger_table(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(registry_jobs, "PAYLOADS", 1)
    monkeypatch.setattr(registry_jobs, "scratch", lambda s, name: str(tmp_path / name))
    out = registry_jobs.q_requests_json_order(spark, SF)
    rows = spark.read.parquet(f"{SF}/lineitem.parquet")
    n, at = rows.count(), rows.selectExpr("max(l_orderkey)").first()[0]
    assert len(glob.glob(str(tmp_path / "payloads" / "part=*"))) < at // 500 + 1
    assert out.agg(F.count(F.lit(1)), F.max("input_row_id")).first() == (n, n - 1)

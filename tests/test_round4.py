import datetime
import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from bidlens.operators import betweenness as bt
from bidlens.operators import features as feat
from bidlens.plans import registry_jobs as jobs
from test_graph import _brute_betweenness

DAY = datetime.datetime(2020, 1, 1)


def tables(spark, folder, lines):
    """Base tables of (order, buyer, supplier) triples; supplier 1 is on the sanctions list."""
    def write(name, rows, ddl):
        spark.createDataFrame(rows, ddl).write.parquet(f"{folder}/{name}.parquet")
    orders = dict((o, b) for o, b, _ in lines)
    write("customer", [(b, f"Buyer {b}") for b in set(orders.values())], "c_custkey long, c_name string")
    write("orders", [(o, b, "O", 10.0 * (o or 0), DAY, "1-URGENT") for o, b in orders.items()],
          "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    write("supplier", [(s, f"Firm {s}", 0, -1.0 if s == 1 else 1.0) for s in {s for *_, s in lines}],
          "s_suppkey long, s_name string, s_nationkey int, s_acctbal double")
    write("nation", [(0, "X")], "n_nationkey int, n_name string")
    write("part", [(1, "Brand", "TYPE")], "p_partkey long, p_brand string, p_type string")
    write("lineitem", [(o, 1, s, i, 5.0, 100.0 + i, 0.0, 0.0, "N", "O", DAY + datetime.timedelta(days=i)) for i, (o, _, s) in enumerate(lines)],
          "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, "
          "l_discount double, l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp")
    return folder


def test_graph_metrics_query_has_betweenness(spark, tmp_dir):
    lines = [(10, 1, 1), (11, 1, 2), (12, 2, 2), (13, 2, 3), (14, 3, 3), (15, 3, 4), (16, 2, 4)]
    m = {r.supplier_id: r for r in entry.queries()["graph_metrics"](spark, tables(spark, tmp_dir, lines)).collect()}
    edges = [(f"b{b}", str(s)) for _, b, s in lines]
    want = _brute_betweenness(sorted({x for e in edges for x in e}), edges)
    assert {s: r.betweenness for s, r in m.items()} == {s: pytest.approx(want[s], abs=1e-6) for s in "1234"}
    assert m["2"].betweenness > 0 and m["2"].degree == 2 and m["2"].distance_to_sanctioned == 2

def random_classes(seed, n=120, p=0.05):
    rng = np.random.default_rng(seed)
    m = np.triu(rng.random((n, n)) < p, 1)
    m[np.arange(n - 1), np.arange(1, n)] = True
    m |= m.T
    return bt.ReducedGraph(*np.nonzero(m), rng.integers(1, 4, n), rng.integers(1, 9, n), np.zeros(n))


def test_levels_of_few_places_are_not_summed_over_whole_rows(monkeypatch):
    for seed in range(3):
        g, sums = random_classes(seed), []
        pack = np.arange(64)
        for cost in (0, 16, 10 ** 9):  # place by place, by cost, whole rows
            monkeypatch.setattr(bt, "FEW", cost)
            sums.append(g.dependencies(pack, g.weight[pack]))
        assert np.allclose(sums[0], sums[2], rtol=1e-12) and np.allclose(sums[1], sums[2], rtol=1e-12)
    buyers, per = 2000, 3  # buyers of 3 of 100 suppliers: a source's first levels have few places
    rng = np.random.default_rng(1)
    a = np.repeat(np.arange(buyers), per)
    b = buyers + np.concatenate([rng.choice(100, per, replace=False) for _ in range(buyers)])
    ones = np.ones(buyers + 100)
    g = bt.ReducedGraph(np.concatenate([a, b]), np.concatenate([b, a]), ones, ones, ones)
    gather, summed = g.gather, {}
    for cost in (16, 10 ** 9):
        seen = []
        g.gather = lambda matrix, r, seen=seen: seen.append(len(r)) or gather(matrix, r)
        monkeypatch.setattr(bt, "FEW", cost)
        g.dependencies(np.arange(64), g.weight[:64])
        summed[cost] = len(seen)
    assert summed[16] <= summed[10 ** 9] - 3


def test_sources_of_a_component_are_packed_together():
    a = np.concatenate([np.arange(0, 200, 2), np.arange(1, 200, 2)])  # two rings of 100, numbered in turn
    b = np.concatenate([np.roll(np.arange(0, 200, 2), 1), np.roll(np.arange(1, 200, 2), 1)])
    ones = np.ones(200)
    g = bt.ReducedGraph(np.concatenate([a, b]), np.concatenate([b, a]), ones, ones, ones)
    order = g.near(np.arange(200), rounds=60)
    assert sorted(order) == list(range(200)) and len(set(order[:100] % 2)) == 1
    assert sorted(g.near(np.arange(200), rounds=1)) == list(range(200))


def shuffle_files(spark):
    found = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {n for n in (found.apply(i).getName() for i in range(found.size())) if n.startswith("shuffle_")}


def test_shuffle_files_go_with_their_job(spark, tmp_dir):
    before = shuffle_files(spark)
    df = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    df.write.parquet(f"{tmp_dir}/t")
    assert {r["count"] for r in df.collect()} == {r["count"] for r in df.collect()} == {142, 143}  # and run again
    end = time.time() + 20
    while shuffle_files(spark) - before and time.time() < end:
        time.sleep(0.2)
    assert not shuffle_files(spark) - before


def test_ranged_packages_are_on_disk_a_few_at_a_time(spark, tmp_dir, monkeypatch):
    lines = [(o, o % 3, o % 4) for o in range(10, 35)] + [(None, 1, 2)]
    sf, seen = tables(spark, tmp_dir, lines), []
    remove = jobs.sn.remove

    def counted(session, path):
        seen.append(sorted(f for f in os.listdir(path) if f.startswith("package=")))
        return remove(session, path)
    monkeypatch.setattr(jobs.sn, "remove", counted)
    monkeypatch.setattr(jobs, "scratch", lambda _, name: f"{tmp_dir}/{name}-{len(seen)}")
    whole = sorted(map(str, jobs.q_releases_ranged(spark, sf).collect()))
    monkeypatch.setattr(jobs, "PACKAGES_AT_ONCE", 3)
    parts = sorted(map(str, jobs.q_releases_ranged(spark, sf).collect()))
    assert parts == whole and len(parts) == len(lines)
    assert [len(p) for p in seen] == [9, 4, 3, 2]  # 8 packages and that of the missing key
    assert not any(f.startswith("in-") for d in os.listdir(tmp_dir) if d.startswith("packages") for f in os.listdir(f"{tmp_dir}/{d}"))


def test_feature_counts_are_made_before_the_rows_are_shuffled(spark):
    t = spark.createDataFrame([("t1", "B", "c1", "2020-01-01"), (None, "B", "c2", "2020-01-01"), (None, "C", "c2", "2020-01-02")],
                              "tender_id string, buyer_name string, main_category string, tender_date string")
    a = spark.createDataFrame([("a1", "t1", "s", 10.0, "2020-01-03", 0), ("a1", "t1", "r", 20.0, "2020-01-03", 1),
                               ("a2", None, "s", 30.0, None, 2), (None, None, None, None, None, 3), ("a3", "t9", "s", 5.0, None, 4)],
                              "award_id string, tender_id string, supplier_id string, amount double, date string, pos int")
    f = feat.build_features(t, a, ["pos"])
    lazy = feat.build_features(t, a, ["pos"], materialize=False)
    assert sorted(map(str, f.collect())) == sorted(map(str, lazy.collect()))
    text = f._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Aggregate [") == 1 and text.count("Join LeftOuter") == 2  # the first rows, their category and their counts

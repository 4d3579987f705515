from bidlens.functions.common import product_join
from bidlens.operators import graph as gr


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_adjacency_is_shuffled_one_way(spark):
    rows = [("a", "b"), ("b", "a"), ("a", "b"), ("c", "c"), (None, "d"), ("e", None)]
    e = spark.createDataFrame(rows, "src string, dst string")
    got = sorted(map(str, gr.adjacency(e).collect()))
    want = {(a, b) for a, b in rows} | {(b, a) for a, b in rows}
    assert got == sorted(f"Row(node={a!r}, nbr={b!r})" for a, b in want)
    assert "Union" not in plan(gr.adjacency(e))
    for pairs in (gr.stored_pairs(e), gr.stored_pairs(e.where("src != 'b' and src != 'c'"))):
        assert "Aggregate" not in plan(gr.both_ways(pairs))
    assert sorted(map(str, gr.both_ways(gr.stored_pairs(e)).collect())) == got


def test_plain_product_join_when_no_id_is_wide(spark):
    left = spark.createDataFrame([("t", "s", 1), (None, "s", 2), ("u", "r", 3)], "k string, s string, n int")
    right = spark.createDataFrame([("t", "b"), (None, "c"), (None, "d")], "tid string, b string")
    lazy = product_join(left, right, "k", "tid", "s", "left")
    eager = product_join(left, right, "k", "tid", "s", "left", eager=True)
    assert sorted(map(str, eager.collect())) == sorted(map(str, lazy.collect()))
    assert plan(eager).count("Join") == 1 < plan(lazy).count("Join")

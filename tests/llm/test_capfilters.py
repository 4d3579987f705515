import numpy as np
import pytest

from bidlens.llm import capfilters

SCHEMA = "vec_id long, embedding array<float>, label int, gid string, links string, first string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, l, "x", "x", "x") for i, v, l in rows], SCHEMA)


def brute(rows, least):
    ok = [v is not None and l is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v)
          for _, v, l in rows]
    up, links = list(range(len(rows))), [0] * len(rows)

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    for a in range(len(rows)):
        for b in range(a):
            if ok[a] and ok[b] and rows[a][2] == rows[b][2] and len(rows[a][1]) == len(rows[b][1]):
                x, y = (np.array(rows[i][1], np.float32).astype(float) for i in (a, b))
                if x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                    links[a] += 1
                    links[b] += 1
                    p, q = top(a), top(b)
                    up[max(p, q)] = min(p, q)
    names = {}
    for i, (v, _, _) in enumerate(rows):
        if v is not None:
            names[top(i)] = min(v, names.get(top(i), v))
    return sorted(((r[0] is None, r[0] or 0), links[i], names.get(top(i))) for i, r in enumerate(rows))


def vectors(seed, n, dim=64):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if i % 3 == 0 or not rows:
            v = rng.normal(size=dim)
        else:
            v = np.array(rows[rng.integers(len(rows))][1], float) + rng.normal(size=dim) * rng.choice([0.0, 0.1, 0.25])
        rows.append((i, v.astype(np.float32).tolist(), int(i % 2)))
    return rows


@pytest.mark.parametrize("kw", [{}, {"cell_rows": 8}])
def test_matches_brute_force(spark, kw):
    rows = vectors(23, 240)
    z = [0.0] * 64
    rows += [(300, None, 1), (301, z, 1), (302, [None] + z[1:], 1), (303, [float("nan")] + rows[0][1][1:], 0),
             (304, rows[0][1], None), (305, [], 0), (306, rows[0][1][:10], 0), (307, rows[0][1][:10], 0),
             (None, rows[1][1], 1), (4, rows[4][1], 0), (308, [float("inf")] + z[1:], 1)]
    got = capfilters.near_vectors(frame(spark, rows), **kw).collect()
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.n_links, r.component_id) for r in got) == brute(rows, 0.93)
    assert all(r.kept == (r.vec_id is not None and r.vec_id == r.component_id) for r in got)


def test_one_hot_copy_and_empty(spark):
    v = np.random.default_rng(24).normal(size=16).tolist()
    got = capfilters.near_vectors(frame(spark, [(i, v, 7) for i in range(500)])).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(499, 0)}
    assert capfilters.near_vectors(frame(spark, [])).count() == 0


def test_list_decoding_is_exact():
    code = capfilters.ProductCode(20, 12, 9.0, 5)
    x = capfilters.unit_rows(np.random.default_rng(25).normal(size=(50, 20)))
    dirs = np.array([np.concatenate([a, b]) for a in code.books[0] for b in code.books[1]])
    for row, passed in zip(x @ code.turn @ dirs.T, code.decode(x)):
        assert passed.tolist() == np.flatnonzero(row >= min(code.threshold, np.sort(row)[-5] - 1e-12)).tolist()
        assert len(passed) >= 5


def test_labels_with_equal_hashes_stay_apart(spark):
    from pyspark.sql import functions as F
    names = spark.range(300_000).select(F.concat(F.lit("label"), "id").alias("l"), (F.col("id") * 0 + 4).cast("int").alias("n"))
    twins = (names.groupBy(F.hash("l", "n").alias("h")).agg(F.collect_list("l").alias("ls"))
             .where("size(ls) > 1").first().ls[:2])
    rows = [(i, [1.0, 0.5, 0.0, 0.1], twins[i % 2]) for i in range(6)] + [(9, [1.0, 0.5, 0.0, 0.1, 0.0], twins[0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in capfilters.near_vectors(df).collect()}
    assert got == {0: (2, 0), 2: (2, 0), 4: (2, 0), 1: (2, 1), 3: (2, 1), 5: (2, 1), 9: (0, 9)}

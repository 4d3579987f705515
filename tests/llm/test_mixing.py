import hashlib
from collections import defaultdict

import pytest

from bidlens.llm import mixing
from util import awkward, docs


def brute(rows, weights=(5, 2, 1), m=3):
    """Copies per (doc_id, source, size) by a plain queue."""
    units = defaultdict(int)
    for i, t, _, s in rows:
        units[i, s, len((t or "").split())] += 1
    size = defaultdict(int)
    for (i, s, z), n in units.items():
        size[s] += z * n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    w = {s: weights[k % 3] for k, s in enumerate(order)}
    total, target, open_ = sum(size.values()), {}, set(order)
    while open_:
        left, share = total - sum(target.values()), sum(w[s] for s in open_)
        full = {s for s in open_ if left * w[s] / share >= m * size[s]}
        if not full:
            target.update({s: left * w[s] / share for s in open_})
            break
        target.update({s: m * size[s] for s in full})
        open_ -= full
    cum, queue = defaultdict(int), []
    key = lambda i: hashlib.md5(f"mix:{'null' if i is None else i}".encode()).hexdigest()
    for (i, s, z), n in sorted(units.items(), key=lambda u: (key(u[0][0]), u[0][2])):
        cum[s] += z * n
        if z and target[s] > 0:
            queue += [((k * size[s] + cum[s]) / target[s], s is None, s or "", key(i), i, z, k, z * n, s)
                      for k in range(m)]
    used, copies = 0, defaultdict(int)
    for q in sorted(queue, key=lambda q: (q[0], q[1], q[2], q[3], q[5], q[6])):
        used += q[7]
        if used > total:
            break
        copies[q[4], q[8], q[5]] += 1
    return target, copies


def test_matches_a_plain_queue(spark):
    rows = awkward()
    target, copies = brute(rows)
    got = mixing.mix_report(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    _, plan = mixing.mix_plan(docs(spark, rows))
    for r in plan.collect():
        assert r.target == pytest.approx(target[r.source])
        assert r.copies == copies[r.doc_id, r.source, r.size]
    assert sum(r.taken for r in got) <= sum(r.size for r in got)
    assert all(0 <= r.taken <= 3 * r.size for r in got)


def test_mix_repeats_rows_and_keeps_columns(spark):
    rows = awkward(1)
    df = docs(spark, rows)
    out = mixing.mix(df)
    assert out.columns == df.columns
    assert out.count() == sum(r.copies for r in mixing.mix_report(df).collect())
    assert out.where("target != 'x'").count() == 0


def test_empty_and_all_empty(spark):
    assert mixing.mix_report(docs(spark, [])).count() == 0
    got = mixing.mix_report(docs(spark, [(1, None, None, None), (2, "", None, "a")])).collect()
    assert [r.taken for r in got] == [0, 0]


def test_source_caps(spark):
    # the small source is stopped at three times its size, the rest is reshared
    rows = [(1, "a b", None, "a")] + [(i, "x y z", None, "b") for i in range(2, 40)]
    got = mixing.mix_report(docs(spark, rows)).collect()
    t = {r.source_size: r.target for r in got}
    assert t[2] == 6 and t[114] == 110

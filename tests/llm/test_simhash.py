import random

import numpy as np
import xxhash

from bidlens.llm import simhash
from bidlens.llm.common import components
from util import awkward, docs, words


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(w[i:i + 3]) for i in range(len(w) - 2)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def top(n):
        while up[n] != n:
            n = up[n]
        return n
    for a, b in pairs:
        a, b = top(a), top(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: top(n) for n in nodes}


def test_fingerprints(spark):
    texts = ["", None, "One", "one TWO", "a b c", "Ünïcode\x0bÀB c d e f g", "x " * 500] + [
        words(random.Random(i), 70) for i in range(20)]
    for t in texts:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == plain_fingerprint(t)
    assert simhash.fingerprint(None) == 0


def test_long_text_in_blocks(monkeypatch):
    from bidlens.llm import common
    text = words(random.Random(5), 3000)
    small = lambda t: common.word_blocks(t, 64)
    want = simhash.fingerprint(text)
    monkeypatch.setattr(simhash, "word_blocks", small)
    assert simhash.fingerprint(text) == want


def clusters(rng, n=900):
    out = set()
    for _ in range(60):
        x = rng.getrandbits(64)
        for _ in range(n // 60):
            out.add(x)
            for _ in range(rng.randint(1, 3)):
                x ^= 1 << rng.randrange(64)
    return np.array(sorted(out), np.uint64)


def test_links_match_brute_force(spark):
    fps = clusters(random.Random(6))
    ids = fps.view(np.int64).tolist()
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 2
    want = groups([(ids[a], ids[b]) for a, b in zip(*np.nonzero(np.triu(near, 1)))], ids)
    df = spark.createDataFrame([(x,) for x in ids], "fp long")
    for kw in ({"leaf_rows": 40}, {"leaf_rows": 400, "cell_rows": 64}, {}):
        edges = simhash.near_links(df, 2, **kw)
        assert edges.count() <= 12 * len(ids)
        roots = {r.node: r.root for r in components(edges).collect()}
        assert {i: roots.get(i, i) for i in ids} == want


def test_one_tight_ball(spark):
    # no vantage point can cut it: every pair is within four bits
    x = 0x0123456789ABCDEF
    ids = np.array([x] + [x ^ (1 << i) for i in range(64)] + [x ^ (3 << i) for i in range(63)], np.uint64).view(np.int64)
    df = spark.createDataFrame([(v,) for v in ids.tolist()], "fp long")
    roots = components(simhash.near_links(df, 2, leaf_rows=8, cell_rows=32)).collect()
    assert len(roots) == len(ids) and len({r.root for r in roots}) == 1


def test_near_duplicates_and_dedup(spark):
    rows = awkward(7)
    df = docs(spark, rows)
    got = simhash.near_duplicates(df).collect()
    assert len(got) == len(rows)
    by = {}
    for i, t, _, _ in rows:
        by.setdefault(plain_fingerprint(t), []).append(i)
    fps = sorted(by)
    top = groups([(a, b) for a in fps for b in fps if a < b and bin(a ^ b).count("1") <= 2], fps)
    least = {}
    for f in fps:
        ids = [i for i in by[f] if i is not None]
        if ids:
            least[top[f]] = min(ids + [least.get(top[f], min(ids))])
    for r in got:
        assert r.component_id == least.get(top[r.fp & (1 << 64) - 1])
    kept = simhash.dedup(df)
    assert kept.columns == df.columns
    assert kept.count() == len(set(top.values()))


def test_empty(spark):
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.dedup(docs(spark, [])).count() == 0


def test_components_chain_and_hub(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(5000, 5000)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(61)) and all(got[1000 + i] == 1000 for i in range(80))

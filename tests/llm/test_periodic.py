import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from bidlens.llm import periodic, queries
from util import awkward, docs


def brute(w, e=4, least=6):
    """(start, length, period) of every run, by start and period."""
    out = {}
    for q in range(1, len(w) // e + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i + q - s
            if size >= max(least, e * q):
                out.setdefault((s, size), q)  # periods ascend: the smallest stays
    return sorted(((s, n, q) for (s, n), q in out.items()), key=lambda r: (r[0], r[2]))


def collapse(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def planted(text, h):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if h % 10 == 0 and w:
        n, g = len(w), h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def repetitive(rng):
    k, n = rng.choice([1, 2, 2, 3, 50]), rng.choice([0, 1, 5, 6, 20, 100, 400])
    w = [rng.randrange(k) for _ in range(n)]
    for _ in range(rng.randint(0, 4) if n else 0):
        a, p, m = rng.randrange(n), rng.randint(1, max(1, n // 5)), rng.randint(1, n)
        base = w[a:a + p]
        w[a:a + m] = (base * (m // len(base) + 1))[:m]
    return w[:2 * n]


@pytest.mark.parametrize("e,least", [(4, 6), (2, 2), (3, 9)])
def test_runs_match_brute_force(e, least, monkeypatch):
    rng = random.Random(e)
    for places in (periodic.PLACES, 50):  # the grid in one piece, and in many
        monkeypatch.setattr(periodic, "PLACES", places)
        for _ in range(60):
            texts = [repetitive(rng) for _ in range(rng.randint(1, 10))]
            got = periodic.find_runs([np.array(t, np.int64) for t in texts], e, least)
            want = [(k, *r) for k, t in enumerate(texts) for r in brute(t, e, least)]
            assert [tuple(r) for r in got.tolist()] == want


def test_extensions_match_comparison():
    rng = np.random.default_rng(5)
    for k in (1, 2, 4):
        seq = np.concatenate([[0], 2 + rng.integers(0, k, 500), [1]])
        seq[100:300] = np.resize(seq[100:107], 200)
        g = periodic.Grammar(seq, 2, 1)
        x, y = np.sort(rng.integers(1, 501, (2, 400)), axis=0)
        x, y = x[x < y], y[x < y]
        for a, b, n, m in zip(x, y, g.extend(x, y), g.extend(x, y, back=True)):
            forward = next(i for i in range(600) if seq[a + i] != seq[b + i])
            backward = next(i for i in range(600) if seq[a - i] != seq[b - i])
            assert (n, m) == (forward, backward)


def test_long_and_hot_texts():
    n = 200_000
    assert periodic.find_runs([np.zeros(n, np.int64)]).tolist() == [[0, 0, n, 1]]
    w = np.array([0, 1] * n + [0, 0, 1] * n)
    assert periodic.find_runs([w, w[:0], w]).tolist() == [
        [0, 0, 2 * n + 1, 2], [0, 2 * n - 2, 3 * n + 2, 3], [2, 0, 2 * n + 1, 2], [2, 2 * n - 2, 3 * n + 2, 3]]


def test_rows(spark):
    rows = awkward(13) + [(800, "la " * 40, None, None), (801, " ".join(["a b c"] * 9 + ["x x x x x x x"]), "en", "a")]
    got = Counter((r.doc_id, tuple(zip(r.run_start, r.run_length, r.run_period)), r.collapsed)
                  for r in periodic.periodic_runs(docs(spark, rows)).collect())
    want = Counter()
    for i, t, *_ in rows:
        w = planted(t, 1)
        runs = brute(w)
        want[i, tuple(runs), collapse(w, runs)] += 1
    assert got == want
    assert periodic.periodic_runs(docs(spark, [])).count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(docs(spark, []), min_exponent=1)


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    want = {}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = planted(r.text, zlib.crc32(str(r.doc_id).encode()))
        runs = brute(w)
        s, n, q = min(runs, key=lambda x: (-x[1], x[0], x[2])) if runs else (None,) * 3
        want[r.doc_id] = (len(runs), s, n, q, 1000 * n // q if runs else None,
                          sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(collapse(w, runs)))
    got = queries.QUERIES["op13_recompression_runs"](spark, sf).collect()
    assert {r.doc_id: tuple(r)[1:] for r in got} == want
    assert sum(v[0] > 0 for v in want.values()) > 10

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from bidlens.llm import katz
from bidlens.llm.common import held_out
from util import awkward, docs


def good_turing(n, cut=katz.CUT):
    """The stated formula, written out: averaged n, a log-log line, r*, Katz's
    cut, freed mass n[1]."""
    rs = [r for r in range(1, cut + 2) if n[r]]
    b = -2.0
    if len(rs) > 1:
        pts = []
        for k, r in enumerate(rs):
            low = rs[k - 1] if k else 0
            high = rs[k + 1] if k + 1 < len(rs) else 2 * r - rs[k - 1]
            pts.append((math.log(r), math.log(n[r] / ((high - low) / 2))))
        mx, my = sum(x for x, _ in pts) / len(pts), sum(y for _, y in pts) / len(pts)
        b = sum((x - mx) * (y - my) for x, y in pts) / sum((x - mx) ** 2 for x, _ in pts)
    b = min(b, -1.1)
    smooth = lambda r: r ** b
    star = [None] + [(r + 1) * smooth(r + 1) / smooth(r) for r in range(1, cut + 1)]
    big = (cut + 1) * smooth(cut + 1) / smooth(1)
    take = [0.0] + [1 - (star[r] / r - big) / (1 - big) for r in range(1, cut + 1)]
    freed = sum(take[r] * r * n[r] for r in range(1, cut + 1))
    scale = min(n[1] / freed, 0.99 / max(take)) if n[1] else 1.0
    return [1 - scale * t for t in take]


def test_discounts_are_good_turing():
    words = [0, 207344, 59772, 25017, 14274, 13493, 7080]  # of the documents at sf0.1
    rng = np.random.default_rng(2)
    cases = [words, [0, 5, 0, 0, 0, 0, 0], [0, 3, 9, 2, 8, 1, 4], [0, 0, 5, 3, 1, 1, 1], [0, 1, 0, 0, 7, 0, 2]]
    cases += [[0, *rng.integers(0, 1000, katz.CUT + 1).tolist()] for _ in range(50)]
    for n in cases:
        d = katz.discounts(n)
        assert d == pytest.approx(good_turing(n), abs=1e-12)
        assert ((d[1:] > 0) & (d[1:] < 1)).all()
    d = katz.discounts(words)
    assert all(a < b for a, b in zip(d[1:], d[2:]))  # small counts lose the larger part
    assert sum((1 - d[r]) * r * words[r] for r in range(1, katz.CUT + 1)) == pytest.approx(words[1])


def brute(rows):
    def lower(t):
        return (t or "").encode().lower().split() + [b""]
    held = [zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2 for i, *_ in rows]
    c1, c2, ch = Counter(), Counter(), Counter()
    for (_, t, _, _), h in zip(rows, held):
        if not h:
            prev = None
            for w in lower(t):
                c1[w] += 1
                c2[prev, w] += 1
                ch[prev] += 1
                prev = w
    n, v = sum(c1.values()), len(c1)
    few = lambda c: [sum(x == r for x in c.values()) for r in range(katz.CUT + 2)]
    one, d = katz.Unigrams(n, few(c1)), good_turing(few(c2))
    p1 = lambda w: float(one.p(np.array([c1[w]]))[0])
    after = {}
    for (h, w), c in c2.items():
        after.setdefault(h, []).append((w, c))
    disc = lambda c: 1.0 if c > katz.CUT else d[c]

    def history(h):
        if not ch[h]:
            return 1.0, 1
        spare, size = sum((1 - disc(c)) * c for _, c in after[h]), ch[h]
        if spare <= 0:
            spare, size = 1, size + 1
        return spare / size / (1 - sum(p1(w) for w, _ in after[h])), size

    def p(h, w):
        a, size = history(h)
        return disc(c2[h, w]) * c2[h, w] / size if c2[h, w] else a * p1(w)

    for h in list(after)[:50]:  # every history sums to 1 with the unknown word
        a, size = history(h)
        assert sum(p(h, w) for w in c1) + a * one.unknown == pytest.approx(1)
    out = []
    for (i, t, _, _), h in zip(rows, held):
        ws = lower(t)
        out.append((i, h, len(ws), sum(c1[w] > 0 for w in ws), n,
                    sum(math.log10((c1[w] + 1) / (n + v + 1)) for w in ws),
                    sum(math.log10(p(a, w)) for a, w in zip([None, *ws], ws))))
    return out


def close(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert np.allclose([g[5:] for g in got], [w[5:] for w in want], rtol=1e-9)


@pytest.mark.parametrize("kw", [{}, {"chunk_tokens": 60, "least": 5}])
def test_matches_brute_force(spark, kw, monkeypatch):
    rows = awkward(16, 150)
    close(katz.katz_scores(docs(spark, rows).repartition(3), held=held_out("doc_id", 7, 2), **kw).collect(), brute(rows))


def test_dealt_out_histories(spark):
    # one history holds most tokens, so its bigrams lie in several buckets
    rows = [(i, " ".join(f"hot r{(i * 37 + j * j) % 211}" for j in range(40)), None, None) for i in range(120)]
    close(katz.katz_scores(docs(spark, rows), held=held_out("doc_id", 7, 2), least=4).collect(), brute(rows))


def test_requests_hold_a_bigram_once():
    # 3,000 texts "a b" and 3,000 whose first word is unknown: four bigrams go out, however often they occur
    import pandas as pd
    lens = np.array([3] * 6000)
    held = np.arange(6000) % 2 == 1
    tokens = np.where(held[:, None], [3, 2, 0], [1, 2, 0])  # "? b" or "a b", and the end
    chunk = pd.DataFrame({"lens": [katz.pack(lens)], "held": [held.tobytes()], "ids": [b""],
                          "tokens": [katz.pack(tokens.reshape(-1))]})
    counts, numbers = np.array([3000, 3000, 3000, 0]), np.array([2, 3, 4, katz.UNKNOWN])
    answers = pd.DataFrame({"bucket": [0], "answer": [katz.pickle.dumps((katz.pack(numbers), katz.pack(counts)))]})
    rows = katz._bigram_requests((7,), chunk, answers, 4, 1 << 40, 5, 3000)
    sent = [katz.pickle.loads(b) for b in rows["blob"]]
    # START a, START ?, a b, b end
    assert sum(len(katz.unpack(x[3])) for x in sent) == 4 and all(len(katz.unpack(y)) <= 4 for x in sent for y in x)
    assert sum(int(katz.unpack(x[5]).sum()) for x in sent) == 9000


def test_unknown_histories_and_hot_bigrams(spark):
    rows = [(i, " ".join(["x y"] * 40 + [f"only{i} only{i}b z"] * 5), None, None) for i in range(100)]
    close(katz.katz_scores(docs(spark, rows).repartition(3), held=held_out("doc_id", 7, 2), chunk_tokens=500,
                           least=4).collect(), brute(rows))


def test_nothing_to_learn_from_and_empty(spark):
    rows = [(i, "a b", None, None) for i in range(40) if zlib.crc32(str(i).encode()) % 7 == 2]
    got = katz.katz_scores(docs(spark, rows), held=held_out("doc_id", 7, 2)).collect()
    assert {(r.n_tokens, r.n_known, r.train_tokens, r.score) for r in got} == {(3, 0, 0, 0.0)}
    assert katz.katz_scores(docs(spark, []), held=held_out("doc_id", 7, 2)).count() == 0


def test_discounts():
    d = katz.discounts([0, 1000, 400, 220, 140, 100, 75])
    assert all(0 < x < 1 for x in d[1:]) and d[0] == 1
    for n in ([0] * 7, [0, 1, 0, 0, 0, 0, 0], [0, 5, 5, 5, 5, 5, 5], [0, 0, 3, 0, 0, 0, 1]):
        assert all(0 < x <= 1 for x in katz.discounts(n)[1:]) and katz.discounts(n)[1] < 1


def test_packing():
    for x in ([], [0], [255], [256, 1], [1 << 40, 3], list(range(70000))):
        a = np.array(x, np.int64)
        assert (katz.unpack(katz.pack(a)) == a).all()

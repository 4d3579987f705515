import random

from bidlens.llm import decontam
from util import awkward, docs, words


def bench(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def passage(rng, n=30):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def test_planted_passages(spark):
    rng = random.Random(8)
    items = [(i, passage(rng)) for i in range(8)]
    rows, want = [(100 + i, words(rng, 80), "en", "a") for i in range(40)], set()
    for i, p in items:
        rows.append((i, f"{words(rng, 30)}\n{p.upper()}!! {words(rng, 30)}", "en", "a"))
        want.add((i, i))
        w = p.split()
        for j in range(3, 30, 6):  # one word in six is another
            w[j] = "changed"
        rows.append((20 + i, " ".join([words(rng, 40), *w]), "en", "a"))
        want.add((20 + i, i))
        rows.append((40 + i, words(rng, 40) + " " + " ".join(p.split()[8:24]), "en", "a"))  # a part of 16 words
        want.add((40 + i, i))
        w = p.split()
        for j in range(0, 30, 3):  # one in three is another: under 0.8
            w[j] = "changed"
        rows.append((60 + i, " ".join(w), "en", "a"))
        rows.append((80 + i, " ".join(p.split()[:9]), "en", "a"))  # too short a part
    df = docs(spark, rows)
    for kw in ({}, {"block_tokens": 40}):
        found = decontam.contaminations(df, bench(spark, items), **kw).collect()
        assert {(r.doc_id, r.item_id) for r in found} == want
        assert all(r.overlap >= 0.8 and r.tokens >= 13 for r in found)
        kept = decontam.decontaminate(df, bench(spark, items), **kw)
        assert kept.columns == df.columns
        assert {r.doc_id for r in kept.collect()} == {r[0] for r in rows} - {d for d, _ in want}


def test_awkward_rows_and_items(spark):
    rows = awkward(9)
    items = [(1, None), (2, ""), (3, "one two"), (4, "a b c d"), (None, rows[3][1]), (5, rows[3][1]), (5, rows[3][1])]
    df = docs(spark, rows)
    found = decontam.contaminations(df, bench(spark, items)).collect()
    n = sum(1 for r in rows if r[1] == rows[3][1])
    assert {r.item_id for r in found} <= {None, 5} and len({r.doc_id for r in found if r.item_id == 5}) >= n - 1
    assert decontam.contaminations(docs(spark, []), bench(spark, items)).count() == 0
    assert decontam.contaminations(df, bench(spark, [])).count() == 0
    assert decontam.decontaminate(df, bench(spark, [])).count() == len(rows)


def test_short_items_match_whole():
    index = decontam.Index(["red green blue white black", "too short"])
    assert [m[0] for m in index.matches("a red green blue white black b")] == [0]
    assert index.matches("a red green blue black white b") == []
    assert index.matches("too short") == []


def test_verify_finds_the_longest_stretch():
    import numpy as np
    rng = random.Random(10)
    for _ in range(200):
        n = rng.randint(5, 40)
        own = np.arange(1, n + 1)
        doc = np.array([x if rng.random() < 0.75 else 0 for x in own])
        index = decontam.Index([" ".join(map(str, own))], min_tokens=5)
        index.items = [own]
        got = index.verify(doc, 0, 0)
        same = own == doc
        best = 0
        for a in range(n):
            for b in range(a + 1, n + 1):
                if same[a] and same[b - 1] and same[a:b].sum() >= 0.8 * (b - a):
                    best = max(best, b - a)
        assert (got[1] if got else 0) == (best if best >= 5 else 0)


def test_short_items_match_with_any_allowed_substitutions():
    from itertools import combinations
    for n in range(5, 14):
        item = [f"w{i}" for i in range(n)]
        index = decontam.Index([" ".join(item)])
        for k in range(n // 4 + 2):
            for gone in combinations(range(n), k):
                text = ["x", *("other" if i in gone else w for i, w in enumerate(item)), "y"]
                want = [(0, 1, n, n - k)] if n - k >= 0.8 * n - 1e-9 else []
                assert index.matches(" ".join(text)) == want, (n, gone)

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from bidlens.llm import merkle
from util import awkward, docs


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(*fields):
    return sha("".join("-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields))


def tree_of(leaves):
    """Levels of one tree, root last."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][i:i + 16])) for i in range(0, len(levels[-1]), 16)])
    return levels


def path_of(levels, i):
    out = []
    for level in levels[:-1]:
        run = level[i - i % 16:i - i % 16 + 16]
        out.append((run[:i % 16], run[i % 16 + 1:]))
        i //= 16
    return out


def brute(rows):
    """rows (doc_id, source, leaf, claimed) -> Counter of results."""
    by = {}
    for r in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[2])):
        by.setdefault(r[1], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree_of([r[2] for r in by[s]]) for s in order}
    top = tree_of([trees[s][-1][0] for s in order])
    out = Counter()
    for k, s in enumerate(order):
        for i, r in enumerate(by[s]):
            path = path_of(trees[s], i) + path_of(top, k)
            folded = r[3] or r[2]
            for left, right in path:
                folded = sha("".join([*left, folded, *right]))
            out[r[0], s, r[2], trees[s][-1][0], top[-1][0], "".join(x for a, b in path for x in [*a, *b]),
                folded, folded == top[-1][0]] += 1
    return out


def run(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows],
                               "doc_id long, source string, leaf string, claimed string, unit string")
    got = merkle.manifest(df, claimed_col="claimed").collect()
    return Counter((r.doc_id, r.source, r.leaf, r.subroot, r.root, b"".join(map(bytes, r.proof)).hex(), r.folded_root, r.verified)
                   for r in got)


def rows_of(seed, n, sources):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        leaf = sha(f"{seed} {i % 300}")
        s = rng.choice(sources)
        rows.append((rng.choice([i, i // 3, None]), s, leaf, sha("other") if rng.random() < 0.2 else None))
    return rows


@pytest.mark.parametrize("deep", [3, 1])
def test_matches_brute_force(spark, monkeypatch, deep):
    monkeypatch.setattr(merkle, "DEEP", deep)
    monkeypatch.setattr(merkle, "BLOCK", 16 ** deep)
    monkeypatch.setattr(merkle, "UNIT", 2 * 16 ** deep)
    # a hot source of several superblocks, lone leaves, a null and an empty source, more than 16 sources
    sources = [None, "", "ä", "Z", *["hot"] * 30, *[f"s{i}" for i in range(25)]]
    rows = rows_of(11, 1500, sources) + [(1, "lone", sha("1"), None), (2, "lone2", sha("2"), sha("x"))]
    rows = [(i, s, leaf, None) for i, s, leaf, _ in rows[:700]] + rows[700:]
    # rows equal in id, source and leaf agree in the claim, as claims follow from the row
    claim = {r[:3]: r[3] for r in rows}
    rows = [(*r[:3], claim[r[:3]]) for r in rows]
    assert run(spark, rows) == brute(rows)


def test_lone_leaves_and_no_rows(spark):
    one = [(7, "a", sha("7"), None)]
    got = run(spark, one)
    assert got == brute(one) and next(iter(got))[4] == sha("7")  # the leaf is the root, the proof empty
    each = [(i, f"s{i:02}", sha(str(i)), sha("no") if i == 3 else None) for i in range(18)]
    assert run(spark, each) == brute(each)
    assert run(spark, []) == Counter()


def test_leaf_and_awkward_documents(spark):
    rows = awkward(11)
    df = docs(spark, rows)
    leafed = df.withColumn("leaf", merkle.leaf(*[F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]))
    want = [leaf_of(i, s, lang, None if t is None else len(t), t) for i, t, lang, s in rows]
    assert Counter(r.leaf for r in leafed.collect()) == Counter(want)
    got = merkle.manifest(leafed)
    expect = brute([(r[0], r[3], leaf, None) for r, leaf in zip(rows, want)])
    assert Counter((r.doc_id, r.source, r.leaf, r.subroot, r.root, b"".join(map(bytes, r.proof)).hex(), r.folded_root, r.verified)
                   for r in got.collect()) == expect
    positions = sorted((r.source or "", r.position) for r in got.collect())
    assert len(set(positions)) == len(rows)


def test_proof_can_be_checked_alone(spark):
    df = spark.createDataFrame(rows_of(12, 200, ["a", "b"]), "doc_id long, source string, leaf string, claimed string")
    for r in merkle.manifest(df).limit(20).collect():
        got = r.leaf
        for at, others in zip(r.proof_at, map(bytes, r.proof)):
            others = others.hex()
            got = sha(others[:64 * at] + got + others[64 * at:])
        assert r.verified and got == r.root == r.folded_root

import random
from collections import Counter

import numpy as np

from bidlens.llm import linededup
from util import awkward, docs

STRIP = " \t\n\x0b\x0c\r"


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def brute(texts, least):
    seen = Counter(k for t in texts for k in {lower(x.strip(STRIP)) for x in (t or "").split("\n")} if k)
    often = {k for k, n in seen.items() if n >= least}
    out = []
    for t in texts:
        lines = (t or "").split("\n")
        kept = [x for x in lines if lower(x.strip(STRIP)) not in often]
        out.append((len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(13)
    shared = ["All rights reserved.", "  menu\t", "ÄHNLICH ähnlich", "x"]
    rows = awkward(13)
    for i in range(80):
        lines = [f"own line {i} {j}" for j in range(rng.randint(0, 5))]
        lines += [x for x in shared if rng.random() < 0.4]
        lines += ["ALL RIGHTS reserved.\r", "", " menu"] if rng.random() < 0.3 else []
        rng.shuffle(lines)
        rows.append((500 + i, "\n".join(lines), "en", "a"))
    got = linededup.dedup_lines(docs(spark, rows), min_docs=10, bundle_texts=7, least=3)
    want = Counter((i, *b) for (i, *_), b in zip(rows, brute([r[1] for r in rows], 10)))
    assert Counter((r.doc_id, r.n_lines, r.n_dropped, r.kept) for r in got.collect()) == want
    assert got.where("size != 'x'").count() == 0


def test_null_empty_and_no_rows(spark):
    rows = [(i, None, None, None) for i in range(12)] + [(20 + i, "\n\n", None, None) for i in range(12)]
    got = linededup.dedup_lines(docs(spark, rows), min_docs=10).collect()
    assert {(r.n_lines, r.n_dropped, r.kept) for r in got} == {(1, 0, ""), (3, 0, "\n\n")}
    assert linededup.dedup_lines(docs(spark, [])).count() == 0


def test_minimal_perfect_hash():
    rng = np.random.default_rng(14)
    for n in (0, 1, 2, 1000, 50_000):
        keys = np.unique(rng.integers(1, 1 << 63, n, dtype=np.uint64))
        counts = np.arange(1, len(keys) + 1)
        t = linededup.KeyCounts(keys, counts)
        assert sorted(t.slot(keys).tolist()) == list(range(len(keys)))
        assert (t.lookup(keys) == np.minimum(counts, 65535)).all()
        other = rng.integers(1, 1 << 63, 2000, dtype=np.uint64)
        assert (t.lookup(np.setdiff1d(other, keys)) > 0).sum() == 0


def test_leftover_keys(monkeypatch):
    monkeypatch.setattr(linededup.KeyCounts, "LEVELS", 1)
    keys = np.unique(np.random.default_rng(15).integers(1, 1 << 63, 3000, dtype=np.uint64))
    t = linededup.KeyCounts(keys, np.arange(len(keys)))
    assert t.rest and (t.lookup(keys) == np.arange(len(keys))).all()

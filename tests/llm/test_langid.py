import math
import random

import numpy as np

from bidlens.llm import langid
from util import awkward, docs


def recursive_ppm(model, symbol, size, text):
    """Code length of one text in one language by the plain recursion."""
    def counts(order):
        out = {}
        for g, n in model[order].items():
            s = [int(symbol[(g >> (8 * o)) & 255]) for o in range(order, -1, -1)]
            ctx = out.setdefault(tuple(s[:-1]), {})
            ctx[s[-1]] = ctx.get(s[-1], 0) + n
        return out
    tables = [counts(o) for o in range(langid.DEPTH + 1)]

    def p(ctx, s):
        if ctx is None:
            return 1 / size
        shorter = ctx[1:] if ctx else None
        c = tables[len(ctx)].get(tuple(ctx))
        if not c:
            return p(shorter, s)
        t, q = sum(c.values()), 0 if len(c) == size else len(c)
        if s in c:
            return c[s] / (t + q)
        return q / (t + q) * p(shorter, s) / (1 - sum(p(shorter, x) for x in c))

    b = [int(symbol[32])] * langid.DEPTH + [int(symbol[x]) for x in langid._bytes(text)]
    return sum(-math.log2(p(b[i - langid.DEPTH:i], b[i])) for i in range(langid.DEPTH, len(b)))


TEXTS = {"x": ["the cat and the hat", "that then there", "a thin hat"], "y": ["der hund und die katze", "über dem haus"]}


def test_code_lengths_match_the_recursion():
    model = {k: [langid.gram_counts(v, o) for o in range(langid.DEPTH + 1)] for k, v in TEXTS.items()}
    for alphabet in (80, 9):
        coder = langid.Coder(model, alphabet)
        texts = ["the hund", "ÜBER that!", "", "zzz 123 the", "katze " * 30]
        got = coder.code_lengths(texts)
        for i, t in enumerate(texts):
            for j, lang in enumerate(coder.langs):
                assert np.isclose(got[i, j], recursive_ppm(model[lang], coder.symbol, coder.size, t), rtol=1e-5)


def test_frozen_rows_are_distributions():
    model = {k: [langid.gram_counts(v, o) for o in range(langid.DEPTH + 1)] for k, v in TEXTS.items()}
    coder = langid.Coder(model)
    p = np.exp2(-coder.bits.astype(float)).reshape(-1, coder.size, len(coder.langs)).sum(axis=1)
    assert np.allclose(p, 1, atol=1e-4)


def test_long_texts_go_in_blocks(monkeypatch):
    model = {k: [langid.gram_counts(v, o) for o in range(langid.DEPTH + 1)] for k, v in TEXTS.items()}
    coder = langid.Coder(model)
    texts = ["the cat and the hound " * 40, "", "haus"]
    want = coder.code_lengths(texts)
    monkeypatch.setattr(langid, "BLOCK", 50)
    assert np.allclose(coder.code_lengths(texts), want)


def corpus(seed=11, n=200):
    rng = random.Random(seed)
    pools = {"en": "the of and to in that with this from have".split(), "de": "der und die das nicht mit über für".split()}
    return [(i, " ".join(rng.choice(pools[k]) for _ in range(rng.randint(3, 40))), k, "a")
            for i in range(n) for k in [rng.choice(["en", "de"])]]


def test_identify(spark):
    rows = corpus() + [(1000, None, "en", "a"), (1001, "", "en", "a"), (1002, "12 34 !?", "de", "a"), (None, "the of", "en", "a")]
    got = langid.identify(docs(spark, rows)).collect()
    by = {r.doc_id: r for r in got}
    assert sum(by[i].lang_pred == k for i, _, k, _ in rows[:200]) >= 198
    assert [by[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3
    assert all(0 <= r.score <= 1 for r in got) and len(got) == len(rows)
    kept = langid.keep_identified(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns and kept.count() == 201


def test_no_labels_and_empty(spark):
    rows = [(1, "the of and", None, "a"), (2, "x", None, "a")]
    assert {r.lang_pred for r in langid.identify(docs(spark, rows)).collect()} == {"und"}
    assert langid.identify(docs(spark, [])).count() == 0
    assert len(langid.identify(docs(spark, awkward(12))).collect()) == len(awkward(12))

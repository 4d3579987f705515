import random
import zlib

import numpy as np

from bidlens.llm import quality
from util import awkward, docs, words


def labelled(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_separates_held_out_junk(spark):
    rng = random.Random(17)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        w = words(rng, rng.randint(10, 60), 300)
        rows.append((i, w if good else " ".join(x for x in w.split()[:8] for _ in range(7)).upper() + "!!", "en", "a"))
        labels.append((i, int(good), 0))
    got = quality.score_quality(docs(spark, rows), labelled(spark, labels)).collect()
    test = [r for r in got if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert sum((r.score >= 0.3) == (r.doc_id % 4 != 0) for r in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 for r in got)


def test_awkward_rows(spark):
    rows = awkward(18)
    labels = [(i, i % 2, 0) for i in range(60)] + [(3, 1, 0), (None, 1, 0), (5, None, 0), (99999, 1, 0)]
    df = docs(spark, rows)
    got = quality.score_quality(df, labelled(spark, labels)).collect()
    assert len(got) == len(rows) and all(r.score == r.score and 0 <= r.score <= 1 for r in got)
    same = {r.text: set() for r in got}
    for r in got:
        same[r.text].add(r.score)
    assert all(len(s) == 1 for s in same.values())


def test_without_labels_and_empty(spark):
    df = docs(spark, awkward(19))
    assert {r.score for r in quality.score_quality(df, labelled(spark, [])).collect()} == {0.5}
    one = quality.score_quality(df, labelled(spark, [(i, 1, 0) for i in range(60)])).collect()
    assert {r.score for r in one} == {0.99}
    assert quality.score_quality(docs(spark, []), labelled(spark, [])).count() == 0


def test_blocks_agree(monkeypatch):
    from bidlens.llm import common
    pool = quality.Pool(quality.index_vectors(256, 16, 1))
    text = words(random.Random(20), 500) + " same same same"
    want = pool.features(text)
    monkeypatch.setattr(quality, "word_blocks", lambda t: common.word_blocks(t, 1 << 12))
    got = pool.features(text)
    assert np.allclose(got[:16], want[:16]) and np.allclose(got[16:25], want[16:25])


def test_word_vectors_of_all_documents(spark):
    # most words occur in unlabelled texts only, and across blocks of a long one
    rng = random.Random(21)
    rows = [(i, words(rng, rng.randint(0, 9), 300), "en", "a") for i in range(90)] + [(90, None, "en", "a")]
    rows.append((91, " ".join(f"u{i % 1009}" for i in range(600_000)), "en", "a"))
    pool, _ = quality.train(docs(spark, rows).repartition(3), labelled(spark, [(0, 1, 0), (1, 0, 0)]), slots=512, dim=16)
    index, want = quality.index_vectors(512, 16, 11), np.zeros((512, 16))
    for _, text, *_ in rows:
        ids = np.array([zlib.crc32(w.encode()) % 512 for w in (text or "").split()], int)
        for o in (1, 2):
            np.add.at(want, ids[o:], index[ids[:-o]])
            np.add.at(want, ids[:-o], index[ids[o:]])
    norm = np.linalg.norm(want, axis=1, keepdims=True)
    assert np.allclose(pool.vectors, np.where(norm > 0, want / np.maximum(norm, 1e-9), index), atol=1e-3)


def test_long_labelled_texts_count(spark):
    rng = random.Random(22)
    rows = [(i, words(rng, 20_000) if i % 2 else "BUY NOW!! " * 8_000, "en", "a") for i in range(60)]
    got = quality.score_quality(docs(spark, rows), labelled(spark, [(i, i % 2, 0) for i in range(60)])).collect()
    assert all((r.score >= 0.5) == (r.doc_id % 2 == 1) for r in got)

import zlib
from collections import Counter, defaultdict

from bidlens.llm import sharding
from util import awkward, docs, words
import random


def check(rows, got, shards):
    assert len(got) == len(rows)
    want = Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _, _ in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        assert 0 <= r.shard < shards
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_awkward_rows(spark):
    rows = awkward(2)
    check(rows, sharding.shard(docs(spark, rows), 5).collect(), 5)


def test_balanced_and_groups_together(spark):
    rng = random.Random(3)
    rows = [(i, words(rng, rng.randint(5, 60)), None, None) for i in range(3000)]
    rows += [(5000 + i, "same text again", None, None) for i in range(100)]
    got = sharding.shard(docs(spark, rows), 8).collect()
    check(rows, got, 8)
    load, home = Counter(), defaultdict(set)
    for r in got:
        load[r.shard] += r.size
        home[r.text_crc32].add(r.shard)
    assert max(load.values()) < 1.02 * min(load.values())
    assert all(len(h) == 1 for h in home.values())


def test_a_group_larger_than_a_shard_is_split(spark):
    rows = [(i, "copy " * 20, None, None) for i in range(2000)] + [(9000 + i, f"own {i}", None, None) for i in range(500)]
    got = sharding.shard(docs(spark, rows), 6).collect()
    check(rows, got, 6)
    load = Counter()
    for r in got:
        load[r.shard] += r.size
    assert max(load.values()) < 1.1 * min(load.values())


def test_reruns_agree_and_empty(spark):
    df = docs(spark, awkward(4))
    a, b = (sorted(map(tuple, sharding.shard(df, 4).collect()), key=str) for _ in range(2))
    assert a == b
    assert sharding.shard(docs(spark, []), 24).count() == 0

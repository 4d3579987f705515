"""Property tests: column expressions agree with plain-Python statements of
the same rules on generated inputs (one Spark job per generated batch)."""
import math
import re
from datetime import datetime, timedelta, timezone

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from bidlens.functions import text
from bidlens.operators import features as feat


def _near(a):
    if a is None or math.isnan(a) or a <= 0:
        return 0
    return int(any((1 - 0.05) * t <= a <= (1 + 0.05) * t for t in (10_000, 50_000, 250_000, 1_000_000)))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.floats(allow_infinity=False, min_value=-2e6, max_value=2e6),
                          st.sampled_from([9500.0, 10500.0, 47500.0, 52500.0, 1.05e6, 0.0])), min_size=1, max_size=60))
def test_near_threshold_property(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "a double")
    got = [r[0] for r in df.select(feat.near_threshold(F.col("a"))).collect()]
    assert got == [_near(x) for x in xs]


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.integers(-10_000_000, 400_000_000), st.integers(-10_000_000, 400_000_000)),
                min_size=1, max_size=40))
def test_time_to_award_property(spark, pairs):
    base = datetime(2020, 1, 1, tzinfo=timezone.utc)
    rows = [(base + timedelta(seconds=a), base + timedelta(seconds=b)) for a, b in pairs]
    df = spark.createDataFrame(rows, "aw timestamp, td timestamp")
    got = [r[0] for r in df.select(feat.time_to_award(F.col("aw"), F.col("td"))).collect()]
    exp = [min(max((aw - td).days, 0), 3650) for aw, td in rows]
    assert got == exp


@settings(max_examples=5, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from(list("ab Z_-.\téßΣ "))),
                          ), min_size=1, max_size=40))
def test_name_keys_property(spark, xs):
    df = spark.createDataFrame([(x,) for x in xs], "s string")
    got = [(r[0], r[1]) for r in df.select(text.norm_whitespace(F.col("s")),
                                          text.graph_name_key(F.col("s"))).collect()]
    for x, (ws, key) in zip(xs, got):
        if x is None:
            assert ws is None and key is None
            continue
        assert ws == re.sub(r"\s+", " ", x).strip()
        k = re.sub(r"\s+", " ", re.sub(r"[\W_]+", " ", x.casefold())).strip() or None
        assert key == k

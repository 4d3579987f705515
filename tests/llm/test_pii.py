import hashlib
import random
import re

import pytest

from bidlens.llm import pii
from util import awkward, docs

RAW = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
       r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(d):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for k, rx in enumerate(RAW):
        for m in re.finditer(rx, text or ""):
            d = re.sub("[^0-9]", "", m.group())
            ok = (True, all(int(x) <= 255 for x in m.group().split(".")) if k == 1 else True,
                  12 <= len(d) <= 19 and luhn(d), 9 <= len(d) <= 15)[k]
            if ok:
                out.append((k, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], x[0]))


def random_text(rng):
    return "".join(rng.choice(["a", "B7", ".", "-", "@", "+", " ", "1", "23", "456", "9.8", "é", "\n", "%", "(", ")",
                               "4111111111111111", "x@y.z", "1.2.3.4", "+1 (", "@@"]) for _ in range(rng.randint(0, 60)))


def test_base_spans_match_the_patterns():
    rng = random.Random(21)
    for _ in range(3000):
        t = random_text(rng)
        base, cand = pii.find(t)
        assert sorted(base, key=lambda x: (x[1], x[0])) == brute(t)
        assert {c[:3] for c in cand if c[3]} == set(base)


def test_long_runs_take_linear_time():
    for run in ("a" * 200_000, "1" * 200_000, "1." * 100_000, "+" * 100_000, "a@" * 50_000, "+1 " * 50_000):
        pii.find(run)


@pytest.fixture(scope="module")
def found(spark):
    rng = random.Random(22)
    rows = awkward(22)
    for i in range(150):
        c = next(d for d in (f"4{rng.randrange(10**15):015d}" for _ in range(999)) if luhn(d))
        rows.append((1000 + i, f"é mail {chr(97 + i % 26)}.{i}@mail{i}.example.com, tel +1 (555) 555-{1000 + i} ip 23.4.5.{i} card {c}", "en", "a"))
    rows += [(2000, "call +1 (555) 555-1234 4111111111111111 now", "en", "a"),
             (2001, "see version 4.0.1.2 and 12345678901234567890123", "en", "a"),
             (2002, "contact jane.roe (at) mail.example (dot) com please", "en", "a")]
    return rows, {r.doc_id: r for r in pii.find_personal_data(docs(spark, rows)).collect() if r.doc_id is not None}


def test_counts_and_digest(found):
    rows, got = found
    for i, t, _, _ in rows:
        if i is None:
            continue
        base = brute(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b[0] == j for b in base) for j in range(4)]
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in base)
        assert got[i].base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(got[i].spans.split(","))
    assert all(got[1000 + i].n_added == 0 for i in range(150))


def test_added_spans(found):
    _, got = found
    assert got[2000].spans.split(",") == ["phone:5:22", "card:23:39"]
    assert got[2002].spans.startswith("email:8:")
    assert all("card" not in got[i].spans for i in (2001,))


def test_empty(spark):
    assert pii.find_personal_data(docs(spark, [])).count() == 0
    r = pii.find_personal_data(docs(spark, [(1, None, None, None)])).collect()[0]
    assert (r.spans, r.base_sha256, r.n_added) == ("", hashlib.sha256(b"").hexdigest(), 0)


def test_reliabilities_follow_the_majority():
    p = pii.reliabilities({"111": 80, "110": 10, "000": 60, "001": 8, "222": 1})
    assert p["111"] > 0.9 and p["110"] > 0.5 and p["000"] < 0.1

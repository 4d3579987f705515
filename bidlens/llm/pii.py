"""Personal data by weak supervision.

Base spans (email, ip, card, phone) follow fixed patterns and always stand.
The method adds spans that the patterns miss: written-out addresses, local
phone numbers, numbers that run into other digits.

1. Every text yields candidates per kind: the base spans, what the base
   patterns match but their checks drop, and looser look-alikes.
2. Labelers vote yes (1), no (0) or abstain (2) on a candidate: the base
   pattern, its checks (digits, Luhn, ranges), a gazetteer (top-level domains,
   card issuers, calling codes, public address ranges), the words before it,
   and its edges.
3. The votes of all documents are counted by (kind, votes, shape).
   Expectation-maximisation on these counts estimates per kind how often each
   labeler votes what for true and for false candidates, starting from the
   majority, and gives every pattern of votes a probability.
4. A logistic model per kind learns these probabilities from votes and shape
   (number of digits, separators, brackets, leading +) and judges the
   candidates: those with probability ``accept`` or more that don't overlap a
   base span are added, likeliest first.

Texts are read once; candidates stay with their document, so nothing is
shuffled but the counted patterns, whose number is bounded by their
categories (4 kinds x 3^5 votes x shapes).

Defined cases: a null text is empty and has no span; equal spans of different
kinds all stand among the base spans; repeated rows are judged alike; without
candidates nothing is learned or added; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.llm.common import cut_lineage

# The kinds in order and the base patterns of the contract.
KINDS = ("email", "ip", "card", "phone")
EMAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
EMAIL_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

# Looser look-alikes.
AT, DOT = r"(?:@|\(at\)|\[at\])", r"(?:\.|\(dot\)|\[dot\])"
LOOSE_EMAIL = re.compile(rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{{1,64}} ?{AT} ?[A-Za-z0-9-]+(?: ?{DOT} ?[A-Za-z0-9-]+)+",
                         re.IGNORECASE)
LOOSE_PHONE = re.compile(r"(?<![0-9A-Za-z.+-])(?:(?:\+|00)[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{3,4}"
                         r"[ .-]?[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])")
LOOSE_CARD = re.compile(r"(?<![0-9A-Za-z.+-])[0-9]{4}([ .-]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}(?![0-9A-Za-z]|[.-][0-9])")

# Gazetteers and cue words (short lists of our own).
DOMAINS = frozenset("com org net edu gov info io de fr es uk eu it nl ch at be pt ca us co".split())
CALLING = ("1", "7", "20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47",
           "48", "49", "51", "52", "54", "55", "56", "57", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84",
           "86", "90", "91", "92", "351", "352", "353", "354", "358", "420", "421", "852", "971", "972")
CUES = {"email": ("mail", "contact", "write to", "correo", "courriel"),
        "ip": ("ip", "host", "server", "address", "serveur", "servidor"),
        "card": ("card", "visa", "mastercard", "credit", "karte", "carte", "tarjeta"),
        "phone": ("phone", "tel", "call", "fax", "mobile", "telefon", "llame")}
CUE = {k: re.compile(r"(?<![a-z])(?:" + "|".join(v) + ")") for k, v in CUES.items()}
NOT_CODE = re.compile(r"(?:version|v|section|license|cc by[a-z-]*)\s*$")
SHAPES = ("plus", "bracket", "space", "dash", "dot", "few", "many")
CANDIDATE = "array<struct<kind:int,start:int,stop:int,base:boolean,votes:string,shape:string>>"


# --------------------------------------------------------------- base spans

def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d)
    return total % 10 == 0


def in_range(ip: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in ip.split("."))


def raw_emails(text: str) -> Iterator[tuple[int, int]]:
    """Matches of the email pattern.  Each holds one @, so it's enough to look
    around every @ (the pattern itself would rescan long runs)."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in EMAIL_LOCAL:
            start -= 1
        m = EMAIL_DOMAIN.match(text, at + 1) if start < at else None
        if m:
            yield start, m.end()
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", max(done, at + 1))


def raw_spans(text: str) -> Iterator[tuple[int, int, int, bool]]:
    """(kind, start, end, passes its checks) of all base pattern matches."""
    for s, e in raw_emails(text):
        yield 0, s, e, True
    for m in IP.finditer(text):
        yield 1, m.start(), m.end(), in_range(m.group())
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12:
            d = _digits(m.group())
            if len(d) >= 12:
                yield 2, m.start(), m.end(), len(d) <= 19 and luhn(d)
    if "+" in text:
        for m in PHONE.finditer(text):
            yield 3, m.start(), m.end(), 9 <= len(_digits(m.group())) <= 15


def write_spans(spans) -> str:
    """kind:start:end by start, then kind, comma-joined."""
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted((s, k, e) for k, s, e in spans))


# --------------------------------------------------------------- candidates

def loose_spans(text: str) -> Iterator[tuple[int, int, int]]:
    low = text.lower() if "(" in text or "[" in text else ""
    if "(at)" in low or "[at]" in low or "@ " in text or " @" in text:
        yield from ((0, m.start(), m.end()) for m in LOOSE_EMAIL.finditer(text))
    yield from ((2, m.start(), m.end()) for m in LOOSE_CARD.finditer(text))
    yield from ((3, m.start(), m.end()) for m in LOOSE_PHONE.finditer(text))


def _yes(x: bool) -> str:
    return "1" if x else "0"


def votes(text: str, kind: int, s: int, e: int, base: bool) -> str:
    """One character per labeler: pattern, checks, gazetteer, cue, edges."""
    body, d = text[s:e], _digits(text[s:e])
    before = text[max(0, s - 32):s].lower()
    edges = not (s and text[s - 1].isalnum()) and not (e < len(text) and text[e].isalnum())
    if kind == 0:
        labels = re.split(r"\s*(?:\.|\(dot\)|\[dot\])\s*", re.split(AT, body, flags=re.IGNORECASE)[-1].strip().lower())
        check = _yes(len(labels) > 1 and labels[-1].isalpha() and all(x and x[0] != "-" != x[-1] for x in labels))
        known = "1" if labels[-1] in DOMAINS else "2"
    elif kind == 1:
        first = body.split(".")[0].lstrip("0") or "0"
        check = _yes(in_range(body) and not NOT_CODE.search(before))
        known = _yes(len(first) < 4 and 0 < int(first) < 224 and first != "127")
    elif kind == 2:
        check = _yes(12 <= len(d) <= 19 and luhn(d))
        known = _yes(d[:1] in ("3", "4", "5", "6") or d[:2] == "22")
    else:
        check = "1" if 9 <= len(d) <= 15 else "2" if 7 <= len(d) < 9 else "0"
        known = _yes(any(d.startswith(c) for c in CALLING)) if body[0] == "+" else "2"
    near = re.split("[0-9]", before)[-1]  # cues in front of another number speak of that one
    cues = [k for k in KINDS if CUE[k].search(near)]
    cue = "1" if KINDS[kind] in cues else "0" if cues else "2"
    return ("1" if base else "2") + check + known + cue + _yes(edges)


def shape(body: str) -> str:
    d = len(_digits(body))
    return "".join(_yes(x) for x in (body[:1] == "+", "(" in body or "[" in body, " " in body, "-" in body, "." in body,
                                     d < 10, d > 12))


def find(text: str | None) -> tuple[list, list]:
    """(base spans, candidates) of a text."""
    text = text or ""
    base, seen, found = [], set(), []
    for k, s, e, good in raw_spans(text):
        if good:
            base.append((k, s, e))
        seen.add((k, s, e))
        found.append((k, s, e, good))
    found.extend((k, s, e, False) for k, s, e in loose_spans(text) if (k, s, e) not in seen)
    return base, [(k, s, e, good, votes(text, k, s, e, good), shape(text[s:e])) for k, s, e, good in found]


# -------------------------------------------------------------------- model

def reliabilities(patterns: dict[str, float], rounds: int = 60) -> dict[str, float]:
    """Expectation-maximisation on counted vote strings of one kind: the
    probability that a candidate with these votes is true."""
    names = sorted(patterns)
    n = np.array([patterns[v] for v in names])
    # pattern, labeler, vote; an abstention says nothing about the candidate
    one_hot = np.array([[[c == x for x in "01"] for c in v] for v in names], float)
    yes, no = one_hot[:, :, 1].sum(axis=1), one_hot[:, :, 0].sum(axis=1)
    p = (yes + 0.5) / (yes + no + 1)  # the majority, not counting abstentions
    for _ in range(rounds):
        like = []
        for w, prior in ((n * p, 1.0), (n * (1 - p), 1.0)):
            votes_ = np.einsum("i,ijk->jk", w, one_hot) + prior
            like.append(np.log((w.sum() + 1) / (n.sum() + 2))
                        + np.einsum("ijk,jk->i", one_hot, np.log(votes_ / votes_.sum(axis=1, keepdims=True))))
        p = 1 / (1 + np.exp(np.clip(like[1] - like[0], -30, 30)))
    return dict(zip(names, p.tolist()))


def features(v: str, s: str) -> np.ndarray:
    return np.array([1.0] + [c == x for c in v for x in "01"] + [c == "1" for c in s], float)


def fit(counts: dict[tuple[int, str, str], float], rounds: int = 50, ridge: float = 1.0) -> dict[int, np.ndarray]:
    """Weights of the span classifier per kind."""
    model = {}
    for kind in sorted({k for k, _, _ in counts}):
        own = {(v, s): n for (k, v, s), n in counts.items() if k == kind}
        by_votes: dict[str, float] = {}
        for (v, _), n in own.items():
            by_votes[v] = by_votes.get(v, 0.0) + n
        p = reliabilities(by_votes)
        x = np.array([features(v, s) for v, s in own])
        y = np.array([p[v] for v, _ in own])
        n = np.array(list(own.values()))
        w = np.zeros(x.shape[1])
        for _ in range(rounds):  # Newton steps on the weighted log loss
            q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (n * (q - y)) + ridge * w
            hess = (x * (n * q * (1 - q))[:, None]).T @ x + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step * min(1.0, 4.0 / (np.abs(step).max() + 1e-12))
            if np.abs(step).max() < 1e-9:
                break
        model[kind] = w
    return model


def added(base: list, candidates: list, model: dict[int, np.ndarray], accept: float) -> list:
    """Candidates that the classifier accepts beside the base spans."""
    taken, out, judged = [(s, e) for _, s, e in base], [], []
    for k, s, e, good, v, sh in candidates:
        if not good and k in model:
            p = 1 / (1 + np.exp(-np.clip(features(v, sh) @ model[k], -30, 30)))
            if p >= accept:
                judged.append((-p, s, k, e))
    for _, s, k, e in sorted(judged):
        if all(e <= a or b <= s for a, b in taken):
            taken.append((s, e))
            out.append((k, s, e))
    return out


def find_personal_data(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                       accept: float = 0.9) -> DataFrame:
    """One row per input row: doc_id, n_email, n_ip, n_card, n_phone (base
    spans), base_sha256, spans (base and added), n_added."""
    @F.pandas_udf(f"counts array<long>, base string, candidates {CANDIDATE}")
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                base, cand = find(t)
                rows.append(([sum(k == i for k, _, _ in base) for i in range(4)], write_spans(base),
                             [dict(zip(("kind", "start", "stop", "base", "votes", "shape"), c)) for c in cand]))
            yield pd.DataFrame(rows, columns=["counts", "base", "candidates"])

    found = cut_lineage(docs.select(F.col(id_col).alias("doc_id"), scan(F.col(text_col)).alias("f"))
                        .select("doc_id", "f.*"))
    counted = (found.select(F.explode("candidates").alias("c")).groupBy("c.kind", "c.votes", "c.shape")
               .count().collect())
    model = fit({(r.kind, r.votes, r["shape"]): float(r["count"]) for r in counted})

    @F.pandas_udf("spans string, n_added long")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for cands in batches:
            rows = []
            for cs in cands:
                cs = [tuple(c[f] for f in ("kind", "start", "stop", "base", "votes", "shape")) for c in cs]
                base = [c[:3] for c in cs if c[3]]
                more = added(base, cs, model, accept)
                rows.append((write_spans(base + more), len(more)))
            yield pd.DataFrame(rows, columns=["spans", "n_added"])

    some = F.exists("candidates", lambda c: ~c["base"])
    return (found.withColumn("j", judge(F.when(some, F.col("candidates")).otherwise(F.array().cast(CANDIDATE))))
            .select("doc_id", *[F.get("counts", i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
                    F.sha2(F.col("base").cast("binary"), 256).alias("base_sha256"),
                    F.when(some, F.col("j.spans")).otherwise(F.col("base")).alias("spans"),
                    F.when(some, F.col("j.n_added")).otherwise(F.lit(0)).cast("long").alias("n_added")))

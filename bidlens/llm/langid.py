"""Language identification by prediction by partial matching (PPM).

Each language gets a context tree over bytes, up to three bytes deep, from a
bounded sample of labelled documents (``docs_per_lang`` expected, drawn by a
hash of the id; whole texts).  Statistics are frozen after training.  A byte
seen ``n`` times in a context with ``t`` occurrences and ``q`` distinct
successors costs -log2(n / (t + q)); any other byte costs the escape
-log2(q / (t + q)) plus its cost in the next shorter context, renormalised
over the bytes that the longer context doesn't predict (exclusion), down to
the uniform distribution.  A text's code length is the sum over its bytes;
the shortest code names the language, and ``score`` is the posterior of that
language given equal priors.

Texts are lower-cased, ASCII bytes that aren't letters count as one symbol;
byte values rarer than the ``alphabet`` commonest share a symbol.  As the
statistics are frozen, the code lengths of all contexts are tabulated once
per worker and whole batches are scored by table look-up.

Defined cases: null texts and texts without a letter are ``und`` with score
0; without any labelled row all are ``und``; ties go to the language that is
first by name; rows are scored one by one, so repeats agree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.llm.common import id_crc

DEPTH = 3
BLOCK = 1 << 20


def _bytes(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").lower().encode("utf-8", "surrogatepass"), np.uint8)


def _plain_bytes() -> np.ndarray:
    """Byte -> byte with every ASCII byte that is no letter mapped to 32."""
    t = np.arange(256, dtype=np.uint8)
    letters = np.zeros(256, bool)
    letters[ord("a"):ord("z") + 1] = True
    letters[128:] = True
    t[~letters] = 32
    return t


def gram_counts(texts, order: int) -> dict[int, int]:
    """Counts of the byte strings of length order + 1 (packed big-endian);
    every text starts after ``DEPTH`` spaces."""
    plain, total = _plain_bytes(), {}
    for text in texts:
        b = np.concatenate([np.full(DEPTH, 32, np.uint8), plain[_bytes(text)]]).astype(np.int64)
        n = len(b) - DEPTH
        g = np.zeros(n, np.int64)
        for o in range(order, -1, -1):
            g = (g << 8) | b[DEPTH - o:DEPTH - o + n]
        for k, c in zip(*(x.tolist() for x in np.unique(g, return_counts=True))):
            total[k] = total.get(k, 0) + c
    return total


def train(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
          docs_per_lang: int = 300, labelled: Column | None = None) -> dict[str, list[dict[int, int]]]:
    """Language -> byte-string counts for the orders 0 to DEPTH.  ``labelled``
    says which rows may be learned from."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    rows = rows.where("lang is not null" if labelled is None else labelled & F.col("lang").isNotNull())
    sizes = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    if not sizes:
        return {}
    draw = F.pmod(F.xxhash64(F.lit("langid"), "id"), F.lit(1 << 30))
    share = F.create_map(*[x for k, n in sizes.items() for x in
                           (F.lit(k), F.lit(int(min(1.0, docs_per_lang / n) * (1 << 30))))])
    sample = rows.where(draw < share[F.col("lang")])

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for lang, texts in pdf.groupby("lang")["text"]:
                for order in range(DEPTH + 1):
                    c = gram_counts(texts, order)
                    yield pd.DataFrame({"lang": lang, "ord": order, "gram": list(c.keys()), "n": list(c.values())})

    found = (sample.mapInPandas(count, "lang string, ord int, gram long, n long")
             .groupBy("lang", "ord", "gram").agg(F.sum("n").alias("n")).toPandas())
    model: dict[str, list[dict[int, int]]] = {k: [{} for _ in range(DEPTH + 1)] for k in sorted(sizes)}
    for (lang, order), g in found.groupby(["lang", "ord"]):
        model[lang][order] = dict(zip(g["gram"].tolist(), g["n"].tolist()))
    return {k: v for k, v in model.items() if v[0]}


class Coder:
    """The frozen statistics as tables: ``row_of`` maps the last three symbols
    to a row of ``bits``, whose entries are code lengths per language."""

    def __init__(self, model: dict[str, list[dict[int, int]]], alphabet: int = 80):
        self.langs = sorted(model)
        total: dict[int, int] = {}
        for m in self.langs:
            for b, n in model[m][0].items():
                total[b] = total.get(b, 0) + n
        known = sorted(sorted(total, key=lambda b: (-total[b], b))[:alphabet - 1])
        self.size = a = len(known) + 1
        symbol = np.full(256, a - 1, np.int64)
        symbol[known] = np.arange(a - 1)
        self.symbol = symbol[_plain_bytes()]
        grams, contexts = {}, set()
        for m in self.langs:
            for order in range(DEPTH + 1):
                keys = np.array(list(model[m][order].keys()), np.int64)
                n = np.array(list(model[m][order].values()), np.float64)
                g = np.zeros(len(keys), np.int64)
                for o in range(order, -1, -1):
                    g = g * a + symbol[(keys >> (8 * o)) & 255]
                g, back = np.unique(g, return_inverse=True)
                grams[m, order] = g, np.bincount(back, n, len(g))
            contexts.update((grams[m, DEPTH][0] // a).tolist())
        deep = np.array(sorted(contexts), np.int64)
        self.row_of = np.tile(np.arange(a * a, dtype=np.int32), a)
        self.row_of[deep] = a * a + np.arange(len(deep), dtype=np.int32)
        tables = []
        for m in self.langs:
            p = np.full((1, a), 1.0 / a)
            for order in range(DEPTH + 1):
                g, n = grams[m, order]
                if order < DEPTH:
                    rows, at = a ** order, g // a
                    low = p if order == 0 else np.tile(p, (a, 1))  # a longer context extends to the left
                else:
                    rows, at, low = len(deep), np.searchsorted(deep, g // a), p[deep % (a * a)]
                counts = np.zeros((rows, a))
                counts[at, g % a] = n
                p2, p = p, self._blend(counts, low)
            tables.append(np.concatenate([p2, p]).reshape(-1))
        self.bits = np.ascontiguousarray(-np.log2(np.stack(tables, axis=1)), dtype=np.float32)

    @staticmethod
    def _blend(counts: np.ndarray, low: np.ndarray) -> np.ndarray:
        """Escape method C with exclusion; every row sums to 1."""
        seen = counts > 0
        t, q = counts.sum(axis=1, keepdims=True), seen.sum(axis=1, keepdims=True)
        rest = 1 - np.where(seen, low, 0).sum(axis=1, keepdims=True)
        q = np.where(q == counts.shape[1], 0, q)  # all symbols seen: nothing to escape to
        with np.errstate(divide="ignore", invalid="ignore"):
            p = np.where(seen, counts / (t + q), q / (t + q) * low / np.maximum(rest, 1e-12))
        return np.where(t > 0, p, low)

    def code_lengths(self, texts) -> np.ndarray:
        """Bits per text and language."""
        out = np.zeros((len(texts), len(self.langs)))
        a, waiting, owner, size = self.size, [], [], 0

        def settle():
            lens = np.array([len(x) for x in waiting])
            x = np.concatenate(waiting)
            starts = np.cumsum(lens) - lens
            ctx = (x[:-3] * a + x[1:-2]) * a + x[2:-1]
            g = np.zeros(len(x), np.int64)
            g[3:] = self.row_of[ctx] * np.int64(a) + x[3:]
            bits = self.bits[g]
            bits[(starts[:, None] + np.arange(DEPTH)).ravel()] = 0  # the context in front of each piece
            np.add.at(out, owner, np.add.reduceat(bits, starts, axis=0, dtype=np.float64))

        for i, text in enumerate(texts):
            s = self.symbol[_bytes(text)]
            front = np.full(DEPTH, self.symbol[32])
            for j in range(0, len(s), BLOCK):
                piece = np.concatenate([front if j == 0 else s[j - DEPTH:j], s[j:j + BLOCK]])
                waiting.append(piece)
                owner.append(i)
                size += len(piece)
                if size >= BLOCK:
                    settle()
                    waiting, owner, size = [], [], 0
        if waiting:
            settle()
        return out

    def predict(self, texts) -> tuple[list[str], np.ndarray]:
        bits = self.code_lengths(texts)
        best = bits.argmin(axis=1)
        gap = bits - bits.min(axis=1, keepdims=True)
        return [self.langs[i] for i in best], 1.0 / np.exp2(-np.minimum(gap, 1000)).sum(axis=1)


def prediction(spark: SparkSession, model: dict, text: Column) -> Column:
    """struct<lang, score> of a text column."""
    letters = F.coalesce(F.rlike(text, F.lit(r"\p{L}")), F.lit(False))
    und = F.struct(F.lit("und").alias("lang"), F.lit(0.0).alias("score"))
    if not model:
        return und
    frozen = spark.sparkContext.broadcast(model)  # bounded by the sample

    @F.pandas_udf("lang string, score double")
    def ppm(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = Coder(frozen.value)
        for s in texts:
            lang, score = coder.predict(s.tolist())
            yield pd.DataFrame({"lang": lang, "score": score})

    return F.when(letters, ppm(text)).otherwise(und)


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             folds: int = 5, fold: int = 0, docs_per_lang: int = 300) -> DataFrame:
    """The rows with lang_pred and score added; learns from rows outside the
    held-out fold (crc32 of the id modulo ``folds`` equal to ``fold``)."""
    model = train(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, docs_per_lang=docs_per_lang,
                  labelled=id_crc(F.col("id")) % folds != fold)
    return (docs.withColumn("__p", prediction(docs.sparkSession, model, F.col(text_col)))
            .withColumn("lang_pred", F.col("__p.lang")).withColumn("score", F.col("__p.score")).drop("__p"))


def keep_identified(docs: DataFrame, *, text_col: str = "text", min_score: float = 0.5, **kw) -> DataFrame:
    """The documents whose language could be told (not ``und``, score at
    least ``min_score``), with the input's columns."""
    cols = list(docs.columns)
    model = train(docs, text_col=text_col, labelled=id_crc(F.col("id")) % 5 != 0, **kw)
    p = docs.withColumn("__p", prediction(docs.sparkSession, model, F.col(text_col)))
    return (p.where((F.col("__p.lang") != "und") & (F.col("__p.score") >= min_score))
            .select(*[F.col(f"`{c}`") for c in cols]))

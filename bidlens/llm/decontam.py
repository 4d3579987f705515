"""Benchmark decontamination with spaced seeds.

A seed mask is a fixed pattern of positions that must agree (1) or are
ignored (0); a window of tokens hashes by its 1-positions only, so a
substituted token at a 0-position doesn't break the hit.  The hashes of all
benchmark windows form a sorted index; each document's windows are looked up
in it (the join of test and training hashes), every hit names an alignment of
the item with the text, and the alignment is verified: the longest stretch
around the hit in which at least ``min_share`` of the tokens agree must be as
long as ``min_tokens``.  An item of ``min_tokens`` words or fewer must lie in
the text as a whole, with at least ``min_share`` of its words, whichever these are.

The benchmark is dealt into blocks of about ``block_tokens`` tokens (by a
hash of the item id); one block's index is what a task holds, and the
documents pass once per block, so neither side's size is limited.  Documents
are never shuffled.

Defined cases: a null text or an item without words matches nothing; an item
with fewer words than ``shortest`` (five) is not searched; an item of up to
``min_tokens`` words is looked up by masks of its own (see ``short_masks``); repeated documents are judged alike, repeated
items are reported once per item id; empty tables give an empty result.
"""

from __future__ import annotations

import string
from collections.abc import Iterator, Sequence
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.common import share, shared, word_blocks

# Masks of weight five.
MASKS = ("11111", "1101011", "11001101", "101100011")
PUNCTUATION = string.punctuation.encode()
MATCH = "array<struct<item:long,start:long,tokens:int,agree:int>>"


def token_blocks(text: str | None):
    """Lists of tokens: words, lower-cased, without ASCII punctuation."""
    return word_blocks((text or "").lower(), delete=PUNCTUATION)


def _window_keys(ids: np.ndarray, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions whose 1-positions all hold known tokens, and their hashes."""
    at = np.flatnonzero(np.frombuffer(mask.encode(), np.uint8) == ord("1"))
    pos = np.flatnonzero(ids[at[0]:at[0] + max(0, len(ids) - len(mask) + 1)])
    for o in at[1:]:
        pos = pos[ids[pos + o] > 0]
    key = np.zeros(len(pos), np.uint64)
    for o in at:
        key = (key ^ ids[pos + o].astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(29)
    return pos, key


def short_masks(n: int, min_share: float) -> list[str]:
    """Masks of which one survives any allowed number of substitutions in an
    item of n words: with k of them some of k + 1 parts is untouched; up to
    one, all but one position."""
    k = int((1 - min_share) * n + 1e-9)
    if k == 0:
        return ["1" * n]
    if k == 1:
        return ["1" * i + "0" + "1" * (n - i - 1) for i in range(n)]
    ends = [n * i // (k + 1) for i in range(k + 2)]
    return ["0" * a + "1" * (b - a) + "0" * (n - b) for a, b in zip(ends[:-1], ends[1:])]


class Index:
    """The benchmark items of one block: vocabulary, token ids, and for each
    mask the sorted window hashes with their item and position."""

    def __init__(self, texts: Sequence[str | None], masks: Sequence[str] = MASKS, shortest: int = 5,
                 min_tokens: int = 13, min_share: float = 0.8):
        self.vocab: dict[bytes, int] = {}
        self.items, self.min_tokens, self.min_share = [], min_tokens, min_share
        found: dict[str, list] = {}
        for n, text in enumerate(texts):
            words = [w for block in token_blocks(text) for w in block]
            ids = np.array([self.vocab.setdefault(w, len(self.vocab) + 1) for w in words], np.int64)
            self.items.append(ids)
            if len(ids) < shortest:
                continue
            for mask in short_masks(len(ids), min_share) if len(ids) <= min_tokens else masks:
                pos, key = _window_keys(ids, mask)
                found.setdefault(mask, []).append((key, np.full(len(pos), n), pos))
        self.masks = {}
        for mask, parts in found.items():
            key, item, pos = (np.concatenate(x) for x in zip(*parts))
            order = np.argsort(key, kind="stable")
            self.masks[mask] = key[order], item[order], pos[order]

    def alignments(self, ids: np.ndarray) -> set[tuple[int, int]]:
        """(item, document position of the item's token 0) of every hit."""
        out: set[tuple[int, int]] = set()
        for mask, (keys, item, at) in self.masks.items():
            pos, key = _window_keys(ids, mask)
            lo, hi = np.searchsorted(keys, key), np.searchsorted(keys, key, "right")
            hit = np.flatnonzero(hi > lo)
            for p, a, b in zip(pos[hit].tolist(), lo[hit].tolist(), hi[hit].tolist()):
                out.update(zip(item[a:b].tolist(), (p - at[a:b]).tolist()))
        return out

    def whole(self, ids: np.ndarray, item: int, shift: int) -> tuple[int, int, int] | None:
        """The same for the whole of a short item."""
        own = self.items[item]
        if shift < 0 or shift + len(own) > len(ids):
            return None
        agree = int((own == ids[shift:shift + len(own)]).sum())
        return (shift, len(own), agree) if agree >= self.min_share * len(own) - 1e-9 else None

    def verify(self, ids: np.ndarray, item: int, shift: int) -> tuple[int, int, int] | None:
        """(start, tokens, agreeing tokens) of the longest stretch of this
        alignment that is long and alike enough."""
        own = self.items[item]
        first, last = max(0, -shift), min(len(own), len(ids) - shift)
        same = own[first:last] == ids[first + shift:last + shift]
        need = min(self.min_tokens, len(own))
        if last - first < need:
            return None
        s = np.concatenate([[0.0], np.cumsum(same - self.min_share + 1e-9)])
        # a stretch starts and ends with agreeing tokens: lowest start so far, highest end from here on
        low = np.minimum.accumulate(np.where(np.append(same, False), s, np.inf))
        high = np.maximum.accumulate(np.where(np.insert(same, 0, False), s, -np.inf)[::-1])[::-1]
        a = b = i = 0
        for j in range(len(s)):
            while i < j and high[j] < low[i]:
                i += 1
            if high[j] >= low[i] and j - i > b - a:
                a, b = i, j
        agree = int(same[a:b].sum())
        if b - a < need or agree < self.min_share * (b - a):
            return None
        return first + shift + a, b - a, agree

    def matches(self, text: str | None) -> list[tuple[int, int, int, int]]:
        """(item, start, tokens, agree): the longest match of each item."""
        get = self.vocab.get
        parts = [np.fromiter(map(get, words, repeat(0)), np.int64, len(words)) for words in token_blocks(text)]
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int64)
        best: dict[int, tuple[int, int, int]] = {}
        for item, shift in sorted(self.alignments(ids)):
            short = len(self.items[item]) <= self.min_tokens
            m = self.whole(ids, item, shift) if short else self.verify(ids, item, shift)
            if m and (item not in best or m[1] > best[item][1]):
                best[item] = m
        return [(i, *m) for i, m in sorted(best.items())]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_tokens: int) -> Iterator[tuple[list, list]]:
    """Item ids and texts of each block; a block holds about block_tokens."""
    items = benchmark.select(F.col(id_col).alias("item_id"), F.col(text_col).alias("text"))
    sizes = items.agg(F.sum(F.octet_length("text")).alias("bytes")).first()
    blocks = max(1, -(-(sizes.bytes or 0) // (6 * block_tokens)))
    for b in range(blocks):
        of = F.pmod(F.xxhash64(F.lit("block"), "item_id"), F.lit(blocks)) == b
        rows = sorted(items.where(of).collect(), key=lambda r: (r.item_id is None, str(r.item_id), r.text or ""))
        yield [r.item_id for r in rows], [r.text for r in rows]


def _matches_col(index, text: Column) -> Column:
    @F.pandas_udf(MATCH)
    def spaced_seeds(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        look = shared(index)
        for s in texts:
            yield pd.Series([[dict(zip(("item", "start", "tokens", "agree"), m)) for m in look.matches(t)]
                             for t in s], dtype=object)
    return spaced_seeds(text)


def contaminations(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                   item_col: str = "item_id", item_text: str = "text", block_tokens: int = 500_000,
                   **kw) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id,
    start (token position), tokens (length), agree, overlap (agree / tokens)."""
    spark = docs.sparkSession
    out = None
    for ids, texts in _blocks(benchmark, item_col, item_text, block_tokens):
        index = share(spark, Index(texts, **kw))
        names = spark.createDataFrame(list(enumerate(ids)), f"item long, item_id {benchmark.schema[item_col].dataType.simpleString()}")
        found = (docs.select(F.col(id_col).alias("doc_id"), F.explode(_matches_col(index, F.col(text_col))).alias("m"))
                 .select("doc_id", "m.*").join(F.broadcast(names), "item")
                 .select("doc_id", "item_id", "start", "tokens", "agree",
                         (F.col("agree") / F.col("tokens")).alias("overlap")))
        out = found if out is None else out.unionAll(found)
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, text_col: str = "text", item_col: str = "item_id",
                  item_text: str = "text", block_tokens: int = 500_000, **kw) -> DataFrame:
    """The documents in which no benchmark item was found."""
    for _, texts in _blocks(benchmark, item_col, item_text, block_tokens):
        index = share(docs.sparkSession, Index(texts, **kw))
        docs = docs.where(F.size(_matches_col(index, F.col(text_col))) == 0)
    return docs

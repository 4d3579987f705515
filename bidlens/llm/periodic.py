"""Periodic runs of words, found with a recompression grammar.

A run is a stretch of words with smallest period q and at least
``min_exponent`` periods (and ``min_words`` words) that neither neighbour
extends with that period.

1. The words of a batch of texts become numbers, texts divided by numbers of
   their own.  Recompression alternates two steps until each text is one
   symbol: every maximal block a^k becomes a symbol (a, k); symbols are put
   on two sides by a hash and each left-right neighbour pair becomes a
   symbol.  Equal stretches are cut alike but near their ends, so the levels
   form a run-length grammar of about four symbols per word.
2. Candidates lie on a harmonic grid: a run of period q holds e consecutive
   multiples of q with equal words (e the least exponent), one of the first
   e-1 of them a multiple of (e-1)q.  For all q this is n log n / (e-1)
   places; those without the equal words are dropped.
3. Two extension queries per candidate, forward and backward, climb the
   grammar while both places begin (or end) equal symbols and descend where
   symbols differ: a few steps per level, blocks in one step.  They give the
   stretch's exact ends.  Of equal stretches the smallest period stays; a
   candidate inside a run of a period that divides its own is that run again
   and is skipped.

All queries of a batch are numpy arrays; there is no shuffle.  A task holds
one batch: about 300,000 words, or one longer text (some 100 bytes a word).

Defined cases: null and empty texts have no words, no runs and the collapsed
text ''; repeated rows and ties (equal runs at other places) are separate;
an empty table has no rows; extra columns pass through.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BATCH = 300_000
PLACES = 2_000_000  # grid places held at a time


def _sides(sym: np.ndarray, level: int) -> np.ndarray:
    """One bit per symbol, anew on every level."""
    x = sym.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * level & (2 ** 64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x >= np.uint64(1 << 63)


class Grammar:
    """Levels of a recompressed sequence in flat arrays.  Numbers below
    ``dividers`` stay apart; the sequence begins and ends with one."""

    def __init__(self, seq: np.ndarray, dividers: int, texts: int):
        self.n = len(seq)
        sym, child, base, level = seq.astype(np.int64), np.full(len(seq), -1, np.int64), 0, 0
        top = int(sym.max()) + 1
        syms, parents, children, blocks = [], [], [], []

        def lift(first: np.ndarray, is_block: bool) -> None:
            """Closes a level; ``first`` marks the symbols that begin one of the next."""
            nonlocal child, base
            syms.append(sym)
            children.append(child)
            blocks.append(np.full(len(sym), is_block))
            above = base + len(sym)
            parents.append(above - 1 + np.cumsum(first))
            child = base + np.flatnonzero(first)
            base = above

        while True:
            first = np.empty(len(sym), bool)
            first[0] = True
            np.not_equal(sym[1:], sym[:-1], out=first[1:])
            at = np.flatnonzero(first)
            if len(at) < len(sym):  # blocks
                times = np.diff(np.append(at, len(sym)))
                many = times > 1
                made, which = np.unique(sym[at[many]] * (self.n + 1) + times[many], return_inverse=True)
                new = sym[at]
                new[many] = top + which
                lift(first, True)
                sym, top = new, top + len(made)
            if len(sym) <= dividers + texts:
                break
            level += 1
            side = _sides(sym, level)
            word = sym >= dividers
            pair = np.flatnonzero((word & ~side)[:-1] & (word & side)[1:])
            if len(pair):
                made, which = np.unique(sym[pair] * top + sym[pair + 1], return_inverse=True)
                first = np.ones(len(sym), bool)
                first[pair + 1] = False
                new = sym[first]
                new[pair - np.arange(len(pair))] = top + which
                lift(first, False)
                sym, top = new, top + len(made)
        syms.append(sym)
        children.append(child)
        parents.append(np.full(len(sym), -1, np.int64))
        blocks.append(np.zeros(len(sym), bool))
        small = np.int32 if base + len(sym) < 1 << 31 and top < 1 << 31 else np.int64
        self.sym = np.concatenate([*syms, [-1]]).astype(small)
        self.parent = np.concatenate([*parents, [-1]]).astype(small)
        self.child = np.concatenate([*children, [-1]]).astype(small)  # first symbol below
        self.block = np.concatenate([*blocks, [False]])

    def extend(self, x: np.ndarray, y: np.ndarray, back: bool = False) -> np.ndarray:
        """How many symbols agree from places x and y on (or up to them)."""
        start, out = x, np.zeros(len(x), np.int64)
        live = np.arange(len(x))
        x, y, rising = x.astype(np.int64), y.astype(np.int64), np.ones(len(x), bool)
        while len(live):
            same = self.sym[x] == self.sym[y]
            ended = ~same & (x < self.n)
            if ended.any():
                out[live[ended]] = np.abs(x[ended] - start[live[ended]])
                go = ~ended
                live, x, y, rising, same = live[go], x[go], y[go], rising[go], same[go]
            px, py = self.parent[x].astype(np.int64), self.parent[y].astype(np.int64)
            if back:
                down_x, down_y = self.child[x + 1] - 1, self.child[y + 1] - 1
                edge = (self.child[px + 1] - 1 == x) & (self.child[py + 1] - 1 == y)
                left = np.minimum(x - self.child[px], y - self.child[py]) + 1
            else:
                down_x, down_y = self.child[x], self.child[y]
                edge = (self.child[px] == x) & (self.child[py] == y)
                left = np.minimum(self.child[px + 1] - x, self.child[py + 1] - y)
            climb = same & rising & (px >= 0) & edge & (self.sym[px] == self.sym[py])
            step = np.where(self.block[x], left, 1)
            step = np.where(same, -step if back else step, 0)
            x = np.where(climb, px, np.where(same, x + step, down_x))
            y = np.where(climb, py, np.where(same, y + step, down_y))
            rising &= same
        return out


def _grid(length: np.ndarray, low: int, high: int, spread: int, exponent: int) -> Iterator[tuple]:
    """(text, period, place) of the grid for periods low <= q < high, some
    ``PLACES`` at a time."""
    many = np.maximum(np.minimum(high - 1, length // exponent) - low + 1, 0)
    ends = np.cumsum(many)
    for a in range(0, int(ends[-1]) if len(ends) else 0, PLACES):
        i = np.arange(a, min(a + PLACES, int(ends[-1])))
        text = np.searchsorted(ends, i, side="right")
        period = low + i - (ends[text] - many[text])
        places = (length[text] - 1 - period) // (spread * period) + 1
        stop = np.cumsum(places)
        cut = 0
        while cut < len(i):
            to = max(cut + 1, int(np.searchsorted(stop, (stop[cut - 1] if cut else 0) + PLACES)))
            c = places[cut:to]
            t = np.arange(int(c.sum())) - np.repeat(np.cumsum(c) - c, c)
            q = np.repeat(period[cut:to], c)
            yield np.repeat(text[cut:to], c), q, t * q * spread
            cut = to


def find_runs(texts: list[np.ndarray], exponent: int = 4, least: int = 6) -> np.ndarray:
    """Rows (text, start, length, period) by text, start and period; texts
    are arrays of word numbers."""
    length = np.array([len(t) for t in texts], np.int64)
    offset = np.cumsum(length + 1) - length
    dividers = len(texts) + 1
    seq = np.empty(int(length.sum()) + dividers, np.int64)
    seq[0] = 0
    for k, (o, t) in enumerate(zip(offset.tolist(), texts)):
        seq[o:o + len(t)] = t
        seq[o:o + len(t)] += dividers
        seq[o + len(t)] = k + 1
    grammar = Grammar(seq, dividers, int((length > 0).sum()))
    found = [np.zeros((0, 4), np.int64)]
    cover_end, cover_period = np.zeros(len(seq), np.int64), np.ones(len(seq), np.int64)
    low, longest = 1, int(length.max(initial=0)) // exponent
    while low <= longest:
        band = [found[0][:0]]
        for text, q, place in _grid(length, low, low * 8, exponent - 1, exponent):
            x = offset[text] + place
            y = x + q
            on = np.flatnonzero(seq[x] == seq[y])
            on = on[(y[on] >= cover_end[x[on]]) | (q[on] % cover_period[x[on]] != 0)]
            text, q, x = text[on], q[on], x[on]
            fits = np.zeros(len(on), bool)
            first, last = offset[text], offset[text] + length[text]
            for back in range(exponent - 1):  # e words in step, x among the first e - 1
                a = x - back * q
                z = a + (exponent - 1) * q
                ok = np.flatnonzero((a >= first) & (z < last) & ~fits)
                for k in range(exponent):
                    ok = ok[seq[a[ok] + k * q[ok]] == seq[x[ok]]]
                fits[ok] = True
            text, q, x = text[fits], q[fits], x[fits]
            if not len(x):
                continue
            back = grammar.extend(x - 1, x + q - 1, back=True)
            size = back + grammar.extend(x, x + q) + q
            big = size >= np.maximum(least, exponent * q)
            rows = np.stack([text[big], (x - back)[big], size[big], q[big]], axis=1)
            band.append(rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))])
        rows = np.concatenate(band)
        rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))]
        new = np.ones(len(rows), bool)
        new[1:] = (rows[1:, 1:3] != rows[:-1, 1:3]).any(axis=1)
        rows = rows[new]
        for _, start, size, q in rows.tolist():
            own = slice(start, start + size)
            longer = cover_end[own] < start + size
            cover_period[own][longer] = q
            cover_end[own][longer] = start + size
        found.append(rows)
        low *= 8
    rows = np.concatenate(found)
    rows = rows[np.lexsort((rows[:, 3], rows[:, 2], rows[:, 1]))]
    new = np.ones(len(rows), bool)
    new[1:] = (rows[1:, 1:3] != rows[:-1, 1:3]).any(axis=1)
    rows = rows[new]
    rows[:, 1] -= offset[rows[:, 0]]
    return rows[np.lexsort((rows[:, 3], rows[:, 1], rows[:, 0]))]


def plant(words: list[bytes], h: int) -> list[bytes]:
    """The contract's planted repeat: from word a on, the p words from a on
    over and over."""
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a:a + p] * (-(-(n - a) // p)))[:n - a]


def _analyse(texts: list[list[bytes]], exponent: int, least: int) -> Iterator[tuple]:
    number = defaultdict(count().__next__).__getitem__
    runs = find_runs([np.fromiter(map(number, words), np.int64, len(words)) for words in texts], exponent, least)
    ends = np.searchsorted(runs[:, 0], np.arange(len(texts) + 1))
    for words, a, b in zip(texts, ends.tolist(), ends[1:].tolist()):
        _, start, size, period = runs[a:b].T
        if b > a:
            change = np.zeros(len(words) + 1, np.int64)
            np.add.at(change, start + period, 1)
            np.add.at(change, start + size, -1)
            words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
        yield start, size, period, b" ".join(words).decode("utf-8", "surrogatepass")


def periodic_runs(docs: DataFrame, *, text_col: str = "text", plant_by: Column | None = None,
                  min_exponent: int = 4, min_words: int = 6) -> DataFrame:
    """Every row of ``docs`` with run_start, run_length and run_period (word
    numbers, by start and period) and collapsed (the words that no run holds
    after its first period, joined by spaces).  ``plant_by``: a number per row
    that plants a repeat first (see ``plant``)."""
    if min_exponent < 2:
        raise ValueError("a run has at least two periods")

    @F.pandas_udf("run_start array<long>, run_length array<long>, run_period array<long>, collapsed string")
    def analyse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, seeds in batches:
            out, held, n = [], [], 0
            for t, h in zip(texts, seeds):
                held.append(plant((t or "").encode("utf-8", "surrogatepass").split(), h))
                n += len(held[-1])
                if n >= BATCH:
                    out.extend(_analyse(held, min_exponent, min_words))
                    held, n = [], 0
            if held:
                out.extend(_analyse(held, min_exponent, min_words))
            yield pd.DataFrame(out, columns=["run_start", "run_length", "run_period", "collapsed"])

    seed = F.lit(1).cast("long") if plant_by is None else plant_by.cast("long")  # 1 plants nothing
    return (docs.withColumn("__runs", analyse(F.col(text_col), seed))
            .withColumns({c: F.col(f"__runs.{c}") for c in ("run_start", "run_length", "run_period", "collapsed")})
            .drop("__runs"))

"""Katz backoff language model (bigrams over unigrams).

    P(w | h) = d(c) c(h, w) / c(h)            if c(h, w) > 0
             = alpha(h) P(w)                  otherwise
    alpha(h) = (1 - sum of P(v | h) over seen v) / (1 - sum of P(v) over them)
    P(w)     = d(c) c(w) / N, and what is left for the unknown word

d is the Good-Turing discount with Katz's cut-off: counts above ``CUT`` are
kept as they are, 1..CUT are discounted so that the mass of the unseen is
that of the singletons (see ``discounts``).  alpha makes every P(. | h) sum
to 1 over the training words, the end of text and the unknown word.

How it runs, with tokens packed so that no row is a token:

1. Chunks: a task turns about ``chunk_tokens`` tokens of whole documents into
   one row: token numbers, and the hashes of the distinct words, ordered by
   the bucket that counts them.
2. Unigram table: a bucket sums its words' training counts over all chunks
   and answers every chunk with number and count of each of its words;
   frequent words get small numbers, so the rest packs well.
3. Bigram table: each chunk sends its distinct bigrams, with their training
   counts, to the bucket of the history, so that a bigram is one entry per
   chunk however often it occurs.  A history with more than its share of all
   tokens is dealt over several buckets by the next word.  Where the history
   is unknown nothing is sent, as P(w) is all its tokens need.
4. The buckets are read twice.  First for the counts of counts and the sums
   of the histories that were dealt out (a bounded number); these make the
   discounts.  Then every bucket answers each chunk with c(h, w) of its
   bigrams and alpha of their histories.
5. A chunk turns the answers into log P of its tokens and adds them up per
   document.

Words are told apart by 64-bit hashes.  A document isn't split over chunks:
a task holds the token numbers (8 bytes each, a few copies) of its longest
document or of a chunk, whichever is longer.  Defined cases: a null text is empty
and holds the end token alone; without training rows every word is unknown
and P(unknown) = 1; null ids and repeated rows are scored like any other; an
empty table gives an empty result.
"""

from __future__ import annotations

import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.common import cut_lineage, word_blocks

CUT = 5
UNKNOWN, START, FIRST = 0, 1, 2  # word numbers; known words count from FIRST


# ------------------------------------------------------------------ packing

def pack(x: np.ndarray) -> bytes:
    """Non-negative integers, bytes of equal weight together, compressed."""
    top = int(x.max()) if len(x) else 0
    kind = "<u1" if top < 1 << 8 else "<u2" if top < 1 << 16 else "<u4" if top < 1 << 32 else "<u8"
    planes = x.astype(kind).view(np.uint8).reshape(len(x), np.dtype(kind).itemsize).T
    return kind[1:].encode() + zstandard.ZstdCompressor(level=3).compress(planes.tobytes())


def unpack(b: bytes) -> np.ndarray:
    kind = "<" + b[:2].decode()
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(b[2:]), np.uint8)
    width = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(width, -1).T).view(kind).reshape(-1).astype(np.int64)


# -------------------------------------------------------------------- model

def discounts(n: list[int], cut: int = CUT) -> np.ndarray:
    """d(0..cut), the Good-Turing factors of counts up to ``cut`` from the
    counts of counts n[1..cut+1].

    n is smoothed first (each n[r] spread over its gap to the neighbouring
    non-zero ones, then a line through log n over log r with slope b < -1), so
    that r*/r = (1 + 1/r)^(b+1) falls short of 1 for every r; Katz's
    formula takes (r*/r - A)/(1 - A) with A = (cut+1)^(b+1), so that larger
    counts stay.  The amounts taken are then scaled to free n[1] in all, the
    Good-Turing mass of the unseen; without singletons they stay as the line
    gives them.  Every factor lies in (0, 1)."""
    d = np.ones(cut + 1)
    r = np.array([i for i in range(1, cut + 2) if n[i]], float)
    slope = -2.0  # where one point fits any line
    if len(r) > 1:
        gap = (np.append(r[1:], 2 * r[-1] - r[-2]) - np.append(0.0, r[:-1])) / 2
        slope = float(np.polyfit(np.log(r), np.log([n[int(i)] for i in r] / gap), 1)[0])
    slope = min(slope, -1.1)
    at = np.arange(1, cut + 1, dtype=float)
    keep, rest = (1 + 1 / at) ** (slope + 1), (cut + 1.0) ** (slope + 1)
    take = 1 - (keep - rest) / (1 - rest)
    freed = float(take @ (at * np.array(n[1:cut + 1], float)))
    d[1:] = 1 - take * (min(n[1] / freed, 0.99 / take.max()) if n[1] else 1.0)
    return d


class Unigrams:
    """P(w) as a function of the word's training count (0: unknown)."""

    def __init__(self, total: int, counts_of_counts: list[int]):
        self.total, self.d = total, discounts(counts_of_counts)
        left = sum((1 - self.d[r]) * r * counts_of_counts[r] for r in range(1, CUT + 1))
        self.size = total + (0 if left > 0 else 1)  # nothing to discount: one more count for the unknown
        self.unknown = (left if left > 0 else 1) / self.size if total else 1.0

    def p(self, c: np.ndarray) -> np.ndarray:
        d = self.d[np.minimum(c, CUT) * (c <= CUT)]
        d = np.where(c > CUT, 1.0, d)
        return np.where(c > 0, d * c / max(1, self.size), self.unknown)


# ------------------------------------------------------------------- chunks

def _mix(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return (x ^ (x >> np.uint64(29))).astype(np.int64) & np.int64(0x7FFFFFFFFFFFFFFF)


def _chunk_rows(frames: Iterator[pd.DataFrame], buckets: int, chunk_tokens: int) -> Iterator[pd.DataFrame]:
    """One row per chunk; the empty word stands for the end of a text."""
    task, made = TaskContext.get().partitionId(), 0

    def fresh():
        v: dict[bytes, int] = defaultdict()
        v.default_factory = v.__len__
        return v

    vocab, ids, held, lens, parts, size = fresh(), [], [], [], [], 0

    def row() -> pd.DataFrame:
        tokens = np.concatenate(parts)
        h = xxhash.xxh64_intdigest
        words = np.array([h(w) for w in vocab], np.uint64)
        order = np.argsort(words % np.uint64(buckets), kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        tokens = place[tokens]
        train = np.bincount(tokens[np.repeat(~np.array(held), lens)], minlength=len(words))
        return pd.DataFrame({"chunk": [task * (1 << 32) + made], "ids": [pickle.dumps(ids)],
                             "held": [np.array(held).tobytes()], "lens": [pack(np.array(lens))],
                             "tokens": [pack(tokens)], "words": [words[order].tobytes()], "train": [pack(train)]})

    for pdf in frames:
        for doc, text, out in zip(pdf["id"].tolist(), pdf["text"].tolist(), pdf["held"].tolist()):
            n = 0
            for words in word_blocks(text):
                parts.append(np.fromiter(map(vocab.__getitem__, words), np.int32, len(words)))
                n += len(words)
            parts.append(np.array([vocab[b""]], np.int32))
            ids.append(doc)
            held.append(bool(out))
            lens.append(n + 1)
            size += n + 1
            if size >= chunk_tokens:
                yield row()
                made += 1
                vocab, ids, held, lens, parts, size = fresh(), [], [], [], [], 0
    if ids:
        yield row()


def _word_requests(frames: Iterator[pd.DataFrame], buckets: int) -> Iterator[pd.DataFrame]:
    for pdf in frames:
        for chunk, words, train in zip(pdf["chunk"], pdf["words"], pdf["train"]):
            w, c = np.frombuffer(words, np.uint64), unpack(train)
            at = (w % np.uint64(buckets)).astype(np.int64)
            cuts = np.searchsorted(at, np.arange(buckets + 1))
            rows = [(b, chunk, w[s:e].tobytes(), pack(c[s:e]))
                    for b, (s, e) in enumerate(zip(cuts[:-1], cuts[1:])) if e > s]
            yield pd.DataFrame(rows, columns=["bucket", "chunk", "words", "train"])


def _count_words(key, pdf: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """Answers per chunk, and one row of totals (chunk -1)."""
    lens = [len(w) // 8 for w in pdf["words"]]
    words = np.frombuffer(b"".join(pdf["words"]), np.uint64)
    train = np.concatenate([unpack(t) for t in pdf["train"]])
    _, inv = np.unique(words, return_inverse=True)
    c = np.bincount(inv, train).astype(np.int64)
    rank = np.empty(len(c), np.int64)
    rank[np.argsort(-c, kind="stable")] = np.arange(len(c))
    number = np.where(c > 0, rank * buckets + key[0] + FIRST, UNKNOWN)
    cuts = np.cumsum([0, *lens])
    rows = [(key[0], chunk, pickle.dumps((pack(number[inv[s:e]]), pack(c[inv[s:e]]))))
            for chunk, s, e in zip(pdf["chunk"], cuts[:-1], cuts[1:])]
    few = np.bincount(c[c <= CUT + 1], minlength=CUT + 2)
    rows.append((key[0], -1, pickle.dumps((int(c.sum()), int((c > 0).sum()), int(number.max()), few.tolist()))))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "answer"])


# ------------------------------------------------------------------ bigrams

def _spread(h: np.ndarray, ch: np.ndarray, w: np.ndarray, buckets: int, hot: int) -> np.ndarray:
    """Bucket of a bigram: that of its history, or one of several where the
    history has more than ``hot`` tokens."""
    ways = np.maximum(1, -(-ch // hot))
    return (_mix(h) % buckets + _mix(w) % ways) % buckets


class Tokens:
    """The tokens of a chunk with word number ``w``, history ``h`` and their
    training counts, and the distinct bigrams of known history by bucket:
    ``one`` is a token of each, ``kind`` the bigram of each token in ``seen``."""

    def __init__(self, row, answers: list, buckets: int, hot: int, width: int, starts: int):
        got = [pickle.loads(a) for a in answers]
        number = np.concatenate([unpack(n) for n, _ in got])
        count = np.concatenate([unpack(c) for _, c in got])
        self.lens, self.held, tokens = unpack(row["lens"]), np.frombuffer(row["held"], bool), unpack(row["tokens"])
        self.first = np.cumsum(self.lens) - self.lens
        self.w, self.c = number[tokens], count[tokens]
        self.h = np.concatenate([[START], self.w[:-1]])
        self.h[self.first] = START
        self.ch = np.concatenate([[0], self.c[:-1]])
        self.ch[self.first] = starts
        self.seen = np.flatnonzero(self.ch > 0)
        _, one, kind = np.unique(self.h[self.seen] * width + self.w[self.seen], return_index=True, return_inverse=True)
        one = self.seen[one]
        bucket = _spread(self.h[one], self.ch[one], self.w[one], buckets, hot)
        order = np.argsort(bucket, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        self.one, self.kind, self.bucket = one[order], place[kind], bucket[order]

    def runs(self) -> np.ndarray:
        """Where a history begins, among the distinct bigrams of a bucket."""
        h, b = self.h[self.one], self.bucket
        return np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (b[1:] != b[:-1])])) if len(h) else self.one

    def log_probs(self, answers: list, one: Unigrams, d: np.ndarray) -> np.ndarray:
        """log10 P(w | h) of every token; ``answers`` are the buckets', in order."""
        p = one.p(self.c)
        if len(self.one):
            got = [pickle.loads(a) for a in answers]
            times = np.diff(self.runs(), append=len(self.one))
            c = np.concatenate([unpack(x) for x, _, _ in got])
            alpha = np.ones(len(times))
            unseen = np.add.reduceat(c == 0, self.runs(), dtype=np.int64) > 0
            alpha[unseen] = np.concatenate([np.frombuffer(x) for _, x, _ in got])
            alpha = np.repeat(alpha, times)
            more = np.repeat(np.concatenate([unpack(x) for _, _, x in got]), times)
            dc = np.where(c > CUT, 1.0, d[np.minimum(c, CUT)])
            q = np.where(c > 0, dc * c / (self.ch[self.one] + more), alpha * p[self.one])
            p[self.seen] = q[self.kind]
        return np.log10(np.maximum(p, 1e-300))


def _bigram_requests(key, chunks: pd.DataFrame, answers: pd.DataFrame, buckets: int, hot: int, width: int,
                     starts: int) -> pd.DataFrame:
    if not len(chunks):
        return pd.DataFrame([], columns=["bucket", "chunk", "blob"])
    t = Tokens(chunks.iloc[0], list(answers.sort_values("bucket")["answer"]), buckets, hot, width, starts)
    learn = ~np.repeat(t.held, t.lens)[t.seen]
    train = np.bincount(t.kind[learn], minlength=len(t.one))
    hs, ws, ch, c = t.h[t.one], t.w[t.one], t.ch[t.one], t.c[t.one]
    runs = t.runs()
    cuts = np.searchsorted(t.bucket, np.arange(buckets + 1))
    rows = []
    for b in np.flatnonzero(np.diff(cuts)).tolist():
        s, e = cuts[b], cuts[b + 1]
        run = runs[slice(*np.searchsorted(runs, [s, e]))]
        rows.append((b, key[0], pickle.dumps((
            pack(np.diff(hs[run], prepend=0)), pack(np.diff(run, append=e)), pack(ch[run]),
            pack(ws[s:e]), pack(c[s:e]), pack(train[s:e])))))
    return pd.DataFrame(rows, columns=["bucket", "chunk", "blob"])


class Bucket:
    """The bigrams of one bucket, merged over its chunks."""

    def __init__(self, rows: list, width: int):
        self.chunks, keys, train, hc, wc = [], [], [], [], []
        for r in rows:
            dh, runs, ch, ws, c, times = pickle.loads(bytes(r["blob"]))
            hs, runs = np.cumsum(unpack(dh)), unpack(runs)
            keys.append(np.repeat(hs, runs) * width + unpack(ws))
            hc.append(np.repeat(unpack(ch), runs))
            wc.append(unpack(c))
            train.append(unpack(times))
            self.chunks.append((r["chunk"], runs))
        keys = np.concatenate(keys)
        uniq, first, self.inverse = np.unique(keys, return_index=True, return_inverse=True)
        self.h, self.w = uniq // width, uniq % width
        self.c = np.bincount(self.inverse, np.concatenate(train)).astype(np.int64)
        self.ch, self.wc = np.concatenate(hc)[first], np.concatenate(wc)[first]
        self.run = np.flatnonzero(np.concatenate([[True], self.h[1:] != self.h[:-1]]))
        self.run_of = np.repeat(np.arange(len(self.run)), np.diff(self.run, append=len(self.h)))

    def counts_of_counts(self) -> np.ndarray:
        return np.bincount(self.c[(self.c > 0) & (self.c <= CUT + 1)], minlength=CUT + 2)

    def history_sums(self, one: Unigrams) -> np.ndarray:
        """Per history: number of successors seen 1..CUT times, and the sum of
        P(w) over the seen successors."""
        out = np.zeros((len(self.run), CUT + 1))
        for r in range(1, CUT + 1):
            out[:, r - 1] = np.bincount(self.run_of, self.c == r, len(self.run))
        out[:, CUT] = np.bincount(self.run_of, np.where(self.c > 0, one.p(self.wc), 0), len(self.run))
        return out

    def backoff(self, one: Unigrams, d: np.ndarray, hot: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """alpha of every history, and what its size is above c(h)."""
        sums = self.history_sums(one)
        heads = self.h[self.run]
        for i in np.flatnonzero(np.isin(heads, np.array(list(hot), np.int64))).tolist():
            sums[i] = hot[int(heads[i])]
        spare = sums[:, :CUT] @ ((1 - d[1:]) * np.arange(1, CUT + 1))
        more = (spare <= 0).astype(np.int64)           # nothing to discount: one more count
        spare = np.where(spare > 0, spare, 1.0)
        return spare / (self.ch[self.run] + more) / np.maximum(1 - sums[:, CUT], 1e-300), more

    def answers(self, alpha: np.ndarray, more: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """Per chunk: c(h, w) of its bigrams, ``more`` of its histories, and
        alpha of those with an unseen bigram in the chunk."""
        at = 0
        for chunk, runs in self.chunks:
            own = self.inverse[at:at + int(runs.sum())]
            at += len(own)
            first = np.cumsum(runs) - runs
            c, of = self.c[own], self.run_of[own[first]]
            unseen = np.add.reduceat(c == 0, first, dtype=np.int64) > 0
            yield chunk, pickle.dumps((pack(c), alpha[of[unseen]].tobytes(), pack(more[of])))


def _buckets(rows: Iterator, width: int) -> Iterator[tuple[int, Bucket]]:
    """The buckets of a partition, one after the other."""
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r["bucket"], []).append(r)
    for b in sorted(by):
        yield b, Bucket(by.pop(b), width)


# -------------------------------------------------------------------- scores

def katz_scores(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", held: Column,
                chunk_tokens: int = 2_000_000, bucket_tokens: int = 1_500_000, least: int = 64) -> DataFrame:
    """One row per input row: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score (add-one unigrams) and score (Katz), both log10.
    Rows where ``held`` is true are scored but not learned from."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), held.alias("held"))
    size = rows.agg(F.sum(F.octet_length("text")).alias("bytes"), F.count_if(~F.col("held")).alias("train")).first()
    buckets = int(max(least, (size["bytes"] or 0) // 6 // bucket_tokens))
    chunks = cut_lineage(rows.mapInPandas(
        lambda it: _chunk_rows(it, buckets, chunk_tokens),
        "chunk long, ids binary, held binary, lens binary, tokens binary, words binary, train binary"))
    asked = chunks.select("chunk", "words", "train").mapInPandas(
        lambda it: _word_requests(it, buckets), "bucket int, chunk long, words binary, train binary")
    answers = cut_lineage(asked.groupBy("bucket").applyInPandas(
        lambda k, p: _count_words(k, p, buckets), "bucket int, chunk long, answer binary"))
    totals = [pickle.loads(bytes(r.answer)) for r in answers.where("chunk = -1").select("answer").collect()]
    total, kinds = sum(t[0] for t in totals), sum(t[1] for t in totals)
    width = max([FIRST, *(t[2] for t in totals)]) + 1
    one = Unigrams(total, [sum(t[3][r] for t in totals) for r in range(CUT + 2)])
    hot = max(1000, total // (8 * buckets))
    starts = int(size["train"] or 0)

    words = answers.where("chunk >= 0")
    sent = (chunks.select("chunk", "held", "lens", "tokens").groupBy("chunk").cogroup(words.groupBy("chunk"))
            .applyInPandas(lambda k, a, b: _bigram_requests(k, a, b, buckets, hot, width, starts),
                           "bucket int, chunk long, blob binary"))
    # one shuffle, read twice: the second pass needs what the first adds up
    table = sent.repartition(buckets, "bucket").rdd

    def survey(part):
        few, sums = np.zeros(CUT + 2, np.int64), []
        for _, b in _buckets(part, width):
            few += b.counts_of_counts()
            s = b.history_sums(one)
            for i in np.flatnonzero(b.ch[b.run] > hot).tolist():
                sums.append((int(b.h[b.run[i]]), s[i]))
        yield few, sums

    few, dealt = np.zeros(CUT + 2, np.int64), {}
    for f, sums in table.mapPartitions(survey).collect():
        few = few + f
        for h, s in sums:
            dealt[h] = dealt.get(h, 0) + s
    d = discounts(few.tolist())

    def evaluate(part):
        for n, b in _buckets(part, width):
            for chunk, blob in b.answers(*b.backoff(one, d, dealt)):
                yield n, chunk, blob, True

    grams = spark.createDataFrame(table.mapPartitions(evaluate), "bucket int, chunk long, answer binary, gram boolean")
    id_type = docs.schema[id_col].dataType.simpleString()

    def scores(key, chunk: pd.DataFrame, got: pd.DataFrame) -> pd.DataFrame:
        row, got = chunk.iloc[0], got.sort_values("bucket")
        t = Tokens(row, list(got.loc[~got["gram"], "answer"]), buckets, hot, width, starts)
        logs = t.log_probs(list(got.loc[got["gram"], "answer"]), one, d)
        return pd.DataFrame({"doc_id": pd.Series(pickle.loads(row["ids"]), dtype=object), "held_out": t.held,
                             "n_tokens": t.lens, "n_known": np.add.reduceat((t.c > 0).astype(np.int64), t.first),
                             "train_tokens": total,
                             "base_score": np.add.reduceat(np.log10((t.c + 1) / (total + kinds + 1)), t.first),
                             "score": np.add.reduceat(logs, t.first)})

    back = words.withColumn("gram", F.lit(False)).unionByName(grams)
    own = chunks.select("chunk", "ids", "held", "lens", "tokens").groupBy("chunk")
    return own.cogroup(back.groupBy("chunk")).applyInPandas(
        scores, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                "base_score double, score double")

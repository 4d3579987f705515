"""Quality classifier: random-indexing word vectors, pooled per document, and
a two-layer network with calibrated probabilities.

Words are hashed to ``slots`` ids.  Every id has a fixed sparse ternary index
vector; the vector of a word is the sum of the index vectors of its
neighbours (``window`` words to both sides) in all documents, scaled to
length 1, or its own index vector if it never has a neighbour.  A document is the
mean of its words' vectors, plus a few shares that a bag of words loses
(repeated neighbours, character classes, length).  A network with one hidden
layer is trained on the labelled sample in numpy; a fifth of the sample, not
trained on, sets the temperature that divides the logits.

The word vectors are one pass over all documents: a task adds up one
slots x dim array of integers and sends the slots it has seen, so the sums
don't depend on how the documents are dealt.  What is bounded is the table of
vectors (slots x dim) and the labelled sample that the network learns from:
``sample_docs`` documents (expected) of any length, drawn by a hash of the
id, of which only the pooled features reach the driver.  Scoring is one pass
over whole texts without a shuffle.

Defined cases: a null text is scored as an empty one, from the length
features alone; without labelled rows every score is 0.5; if the labels know
one class only, the score is 0.99 or 0.01; conflicting labels of a document
are averaged; rows are scored one by one, so repeats agree.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.common import id_crc, share, shared, word_blocks

_CLASS = np.zeros(256, np.int64)  # 0 other ASCII, 1 lower, 2 upper, 3 digit, 4 space, 5 newline, 6 beyond ASCII
_CLASS[ord("a"):ord("z") + 1] = 1
_CLASS[ord("A"):ord("Z") + 1] = 2
_CLASS[ord("0"):ord("9") + 1] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[128:] = 6
N_SHARES = 11


def index_places(slots: int, dim: int, seed: int) -> np.ndarray:
    """Where the fixed sparse ternary vector of each id has its two +1 (the
    first two columns) and two -1."""
    rng = np.random.default_rng(seed)
    return np.argsort(rng.random((slots, dim), dtype=np.float32), axis=1)[:, :4]


def index_vectors(slots: int, dim: int, seed: int) -> np.ndarray:
    """These vectors, scaled to length 1."""
    out = np.zeros((slots, dim), np.float32)
    np.put_along_axis(out, index_places(slots, dim, seed), np.array([[0.5, 0.5, -0.5, -0.5]], np.float32), axis=1)
    return out


def word_ids(words: list[bytes], slots: int) -> np.ndarray:
    return np.fromiter(map(crc32, words), np.int64, len(words)) % slots


class Pool:
    """Pooled document features."""

    def __init__(self, vectors: np.ndarray):
        self.vectors = vectors

    def features(self, text: str | None) -> np.ndarray:
        slots, dim = self.vectors.shape
        total, n, repeats, kinds, last = np.zeros(dim), 0, 0, 0, -1
        for words in word_blocks(text):
            ids = word_ids(words, slots)
            if not len(ids):
                continue
            total += self.vectors[ids].sum(axis=0, dtype=np.float64)
            repeats += int((ids[1:] == ids[:-1]).sum()) + int(ids[0] == last)
            kinds += len(np.unique(ids))
            n, last = n + len(ids), ids[-1]
        data = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
        shares = np.bincount(_CLASS, np.bincount(data, minlength=256), 7) / max(1, len(data))
        extra = [np.log1p(n), repeats / max(1, n), kinds / max(1, n) * np.log1p(n), len(data) / max(1, n) / 10]
        return np.concatenate([total / max(1, n), shares, extra])


class Network:
    """Standardised inputs, one hidden layer of rectified units, one logit."""

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 32, epochs: int = 150, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.constant = None
        if len(y) < 10 or y.min() > 0.5 or y.max() < 0.5:
            self.constant = 0.5 if not len(y) else float(np.clip(y.mean(), 0.01, 0.99))
            return
        held = rng.permutation(len(y)) % 5 == 0
        self.mean, self.scale = x.mean(axis=0), x.std(axis=0) + 1e-6
        z = self._scaled(x)
        p = {"w1": rng.normal(0, np.sqrt(2 / z.shape[1]), (z.shape[1], hidden)), "b1": np.zeros(hidden),
             "w2": rng.normal(0, np.sqrt(1 / hidden), hidden), "b2": np.zeros(1)}
        m, v = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}
        train, step = np.flatnonzero(~held), 0
        for _ in range(epochs):  # Adam with weight decay
            for batch in np.array_split(rng.permutation(train), max(1, len(train) // 256)):
                a = np.maximum(z[batch] @ p["w1"] + p["b1"], 0)
                d = (_sigmoid(a @ p["w2"] + p["b2"]) - y[batch]) / len(batch)
                back = np.outer(d, p["w2"]) * (a > 0)
                g = {"w1": z[batch].T @ back + 1e-3 * p["w1"], "b1": back.sum(axis=0),
                     "w2": a.T @ d + 1e-3 * p["w2"], "b2": d.sum(keepdims=True)}
                step += 1
                for k in p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    p[k] -= 2e-3 * (m[k] / (1 - 0.9 ** step)) / (np.sqrt(v[k] / (1 - 0.999 ** step)) + 1e-8)
        self.p, self.temperature = p, 1.0
        logits, truth = self._logits(z[held]), y[held]
        if len(truth):
            grid = np.exp(np.linspace(np.log(0.5), np.log(8), 60))
            self.temperature = float(min(grid, key=lambda t: _log_loss(_sigmoid(logits / t), truth)))

    def _scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def _logits(self, z: np.ndarray) -> np.ndarray:
        return np.maximum(z @ self.p["w1"] + self.p["b1"], 0) @ self.p["w2"] + self.p["b2"]

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return np.clip(_sigmoid(self._logits(self._scaled(x)) / self.temperature), 1e-6, 1 - 1e-6)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def _log_loss(p: np.ndarray, y: np.ndarray) -> float:
    p = np.clip(p, 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


class Contexts:
    """Sums of the neighbours' index vectors per id, times two (integers)."""

    def __init__(self, slots: int, dim: int, window: int, seed: int):
        self.slots, self.dim, self.window = slots, dim, window
        # id ``slots`` stands between documents; its vector is +1 +1 -1 -1 in one place
        self.places = np.vstack([index_places(slots, dim, seed), np.zeros((1, 4), np.int64)])
        self.total = np.zeros((slots + 1) * dim, np.int64)
        self.gap = np.full(window, slots, np.int64)
        self.parts, self.size = [self.gap], 0

    def add(self, text: str | None) -> None:
        for words in word_blocks(text):
            self.parts.append(word_ids(words, self.slots))
            self.size += len(words)
            if self.size >= 1 << 19:
                self._flush()
        self.parts.append(self.gap)

    def _flush(self) -> None:
        """Pairs whose later word is new; the last words stay for the next."""
        ids = np.concatenate(self.parts)
        w = self.window
        if len(ids) > w:
            pairs = [(ids[w:], ids[w - o:-o]) for o in range(1, w + 1)]
            word = np.concatenate([x for late, early in pairs for x in (late, early)]) * self.dim
            near = np.concatenate([x for late, early in pairs for x in (early, late)])
            for k, sign in enumerate((1, 1, -1, -1)):
                self.total += sign * np.bincount(word + self.places[near, k], minlength=len(self.total))
        self.parts, self.size = [ids[len(ids) - w:]], 0

    def sums(self) -> np.ndarray:
        self._flush()
        return self.total.reshape(-1, self.dim)[:self.slots]


def _smallest(x: np.ndarray) -> np.ndarray:
    top = np.abs(x).max(initial=0)
    return x.astype(next(k for k in (np.int8, np.int16, np.int32, np.int64) if top <= np.iinfo(k).max))


def context_vectors(texts: DataFrame, slots: int, dim: int, window: int, seed: int, piece: int = 32) -> np.ndarray:
    """The words' vectors from all rows of the one column of ``texts``."""

    def per_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        contexts = Contexts(slots, dim, window, seed)
        for pdf in frames:
            for text in pdf.iloc[:, 0]:
                contexts.add(text)
        sums = contexts.sums()
        seen = np.flatnonzero(sums.any(axis=1))
        for own in np.split(seen, np.flatnonzero(np.diff(seen // piece)) + 1):
            if len(own):
                yield pd.DataFrame({"piece": [own[0] // piece], "sums": [pickle.dumps((own, _smallest(sums[own])))]})

    def added(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        by: dict[int, np.ndarray] = {}
        for pdf in frames:
            for n, blob in zip(pdf["piece"].tolist(), pdf["sums"]):
                own, sums = pickle.loads(blob)
                by.setdefault(n, np.zeros((piece, dim), np.int64))[own - n * piece] += sums
        yield pd.DataFrame({"piece": list(by), "sums": [x.tobytes() for x in by.values()]})

    total = np.zeros((-(-slots // piece), piece, dim), np.int64)
    rows = (texts.mapInPandas(per_task, "piece int, sums binary").repartition("piece")
            .mapInPandas(added, "piece int, sums binary"))
    for r in rows.collect():  # slots x dim numbers
        total[r.piece] += np.frombuffer(r.sums, np.int64).reshape(piece, dim)
    total = total.reshape(-1, dim)[:slots].astype(np.float64)
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    return np.where(norm > 0, total / np.maximum(norm, 1e-9), index_vectors(slots, dim, seed)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_id: str = "doc_id", label_col: str = "quality", labelled: Column | None = None,
          sample_docs: int = 4000, slots: int = 1 << 16, dim: int = 48, window: int = 2,
          seed: int = 11) -> tuple[Pool, Network]:
    """``labelled`` is a condition on the column "id" of the label rows."""
    known = labels.select(F.col(label_id).alias("id"), F.col(label_col).cast("double").alias("y")).dropna()
    if labelled is not None:
        known = known.where(labelled)
    known = known.groupBy("id").agg(F.avg("y").alias("y"))
    n = known.count()
    draw = F.pmod(F.xxhash64(F.lit("quality"), "id"), F.lit(1 << 30))
    drawn = known.where(draw < F.lit(int(min(1.0, sample_docs / max(1, n)) * (1 << 30))))
    vectors = context_vectors(docs.select(text_col), slots, dim, window, seed).astype(np.float16)
    half = share(docs.sparkSession, vectors)

    @F.pandas_udf("array<double>")
    def features(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        p = Pool(shared(half).astype(np.float32))
        for s in batches:
            yield pd.Series([p.features(t) for t in s], dtype=object)

    rows = (docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
            .join(F.broadcast(drawn), "id").select("id", "y", features("text").alias("x"))).collect()  # bounded sample
    rows.sort(key=lambda r: (r.id, r.x))
    x = np.array([r.x for r in rows]).reshape(len(rows), dim + N_SHARES)
    return Pool(vectors.astype(np.float32)), Network(x, np.array([float(r.y >= 0.5) for r in rows]))


def score_quality(docs: DataFrame, labels: DataFrame, *, text_col: str = "text", folds: int = 5, fold: int = 0,
                  **kw) -> DataFrame:
    """Every row of ``docs`` with ``score``, the probability of label 1;
    learns from labels outside the held-out fold."""
    pool, net = train(docs, labels, text_col=text_col, labelled=id_crc(F.col("id")) % folds != fold, **kw)
    half = share(docs.sparkSession, (pool.vectors.astype(np.float16), net))

    @F.pandas_udf("double")
    def probability(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        vectors, network = shared(half)
        p = Pool(vectors.astype(np.float32))
        for s in batches:
            x = [p.features(t) for t in s]
            yield pd.Series(network.score(np.array(x)) if x else np.zeros(0))

    return docs.withColumn("score", probability(F.col(text_col)))

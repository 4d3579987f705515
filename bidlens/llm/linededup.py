"""Line dedup: lines found in many documents leave every document.

1. Texts fold to distinct texts (by a 64-bit hash) with their number of
   documents, so a large group of copies is one row; each carries the hashes
   of its line keys (stripped, A-Z lower-cased), 0 for an empty key.
2. A count per distinct key: documents that hold it.
3. The keys are dealt into shards.  Each shard becomes a minimal perfect hash
   (levels of bit arrays: a key sits on the first level on which no other key
   shares its position; its slot is the rank of that bit) that indexes a
   compact fingerprint array and a saturating count array: about 6 bytes per
   key instead of the lines.
4. Texts probe the arrays in bundles: a bundle asks each shard once for its
   distinct keys, packed in one row, and gets back the frequent ones.  No
   line or (line, document) row is joined, and a line that most documents
   share is one entry per bundle.
5. Documents whose text holds frequent keys are rewritten.

Defined cases: null and empty texts are one empty line and keep it; an empty
key is never frequent; every row counts as a document, repeated rows too; a
text whose lines are all dropped becomes ''; an empty table gives an empty
result.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.llm.common import cut_lineage

STRIP = b" \t\n\x0b\x0c\r"


def line_keys(text: str | None) -> list[int]:
    """Signed 64-bit hash of each line's key, in order; 0 for an empty key."""
    h = xxhash.xxh64_intdigest
    out = []
    for line in (text or "").encode("utf-8", "surrogatepass").lower().split(b"\n"):
        key = line.strip(STRIP)
        x = h(key) if key else 0
        out.append(x - (1 << 64) if x >> 63 else x)
    return out


def _mix(keys: np.ndarray, level: int) -> np.ndarray:
    x = (keys ^ np.uint64(level * 0x9E3779B9 + 1)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


class KeyCounts:
    """Counts of distinct 64-bit keys behind a minimal perfect hash."""

    LEVELS = 40

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        self.levels, left, slots = [], np.arange(len(keys)), np.zeros(len(keys), np.int64)
        first = 0
        for level in range(self.LEVELS):
            if not len(left):
                break
            m = 2 * len(left) + 64
            pos = (_mix(keys[left], level) % np.uint64(m)).astype(np.int64)
            bits = np.bincount(pos, minlength=m) == 1
            alone = bits[pos]
            rank = np.cumsum(bits) - 1
            slots[left[alone]] = first + rank[pos[alone]]
            self.levels.append((m, np.packbits(bits), first))
            first += int(bits.sum())
            left = left[~alone]
        self.rest = {int(k): first + i for i, k in enumerate(keys[left].tolist())}  # as good as never any
        slots[left] = first + np.arange(len(left))
        self.prints = np.zeros(len(keys), np.uint32)
        self.counts = np.zeros(len(keys), np.uint16)
        self.prints[slots] = self._print(keys)
        self.counts[slots] = np.minimum(counts, 65535)

    @staticmethod
    def _print(keys: np.ndarray) -> np.ndarray:
        return (_mix(keys, 1 << 20) >> np.uint64(32)).astype(np.uint32)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        """Slot per key, -1 where no level has it."""
        out, left = np.full(len(keys), -1, np.int64), np.arange(len(keys))
        for level, (m, packed, first) in enumerate(self.levels):
            bits = np.unpackbits(packed, count=m).view(bool)
            pos = (_mix(keys[left], level) % np.uint64(m)).astype(np.int64)
            hit = bits[pos]
            out[left[hit]] = first + (np.cumsum(bits) - 1)[pos[hit]]
            left = left[~hit]
        if self.rest:
            out[left] = [self.rest.get(k, -1) for k in keys[left].tolist()]
        return out

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Count per key; 0 for a key whose fingerprint isn't there."""
        s = self.slot(keys)
        known = (s >= 0) & (self.prints[s] == self._print(keys)) if len(self.prints) else np.zeros(len(keys), bool)
        return np.where(known, self.counts[s] if len(self.counts) else 0, 0)


def _texts(docs: DataFrame, text_col: str) -> DataFrame:
    """Distinct texts: text_hash, keys, n (documents)."""
    @F.pandas_udf("array<long>")
    def keys_of(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([line_keys(t) for t in s], dtype=object)

    rows = docs.select(F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("text_hash"),
                       keys_of(F.col(text_col)).alias("keys"))
    return rows.groupBy("text_hash").agg(F.first("keys").alias("keys"), F.count(F.lit(1)).alias("n"))


def frequent_lines(docs: DataFrame, *, text_col: str = "text", min_docs: int = 10,
                   shard_keys: int = 100_000, bundle_texts: int = 2_000, least: int = 64) -> DataFrame:
    """(text_hash, drop): the keys of a text that at least ``min_docs``
    documents hold, for every text that has any."""
    texts = cut_lineage(_texts(docs, text_col))
    counts = cut_lineage(texts.select(F.explode(F.array_distinct("keys")).alias("key"), "n").where("key != 0")
                         .groupBy("key").agg(F.sum("n").alias("docs")))
    shards = max(least, -(-counts.count() // shard_keys))
    bundles = max(least, -(-texts.count() // bundle_texts))

    def build(key, pdf: pd.DataFrame) -> pd.DataFrame:
        made = KeyCounts(pdf["key"].to_numpy(np.int64).view(np.uint64), pdf["docs"].to_numpy(np.int64))
        arrays = (made.levels, made.rest, made.prints, made.counts)
        return pd.DataFrame({"shard": [key[0]], "arrays": [pickle.dumps(arrays)]})

    index = cut_lineage(counts.withColumn("shard", F.pmod("key", F.lit(shards)).cast("int"))
                        .groupBy("shard").applyInPandas(build, "shard int, arrays binary"))

    def ask(key, pdf: pd.DataFrame) -> pd.DataFrame:
        k = np.unique(np.concatenate(pdf["keys"].to_list()))
        k = k[k != 0]
        shard = k % shards
        order = np.argsort(shard, kind="stable")
        k, shard = k[order], shard[order]
        at, first = np.unique(shard, return_index=True)
        return pd.DataFrame({"bundle": key[0], "shard": at.astype(np.int32),
                             "asked": [x.tobytes() for x in np.split(k, first[1:])] if len(at) else []})

    bundled = texts.select("text_hash", "keys", F.pmod("text_hash", F.lit(bundles)).cast("int").alias("bundle"))
    asked = bundled.groupBy("bundle").applyInPandas(ask, "bundle int, shard int, asked binary")

    def probe(key, asks: pd.DataFrame, arrays: pd.DataFrame) -> pd.DataFrame:
        got = []
        if len(arrays) and len(asks):
            table = KeyCounts.__new__(KeyCounts)
            table.levels, table.rest, table.prints, table.counts = pickle.loads(arrays["arrays"].iloc[0])
            lens = [len(x) // 8 for x in asks["asked"]]
            k = np.frombuffer(b"".join(asks["asked"]), np.int64)
            hit = table.lookup(k.view(np.uint64)) >= min_docs
            for b, kk, hh in zip(asks["bundle"], np.split(k, np.cumsum(lens)[:-1]), np.split(hit, np.cumsum(lens)[:-1])):
                if hh.any():
                    got.append((b, kk[hh].tobytes()))
        return pd.DataFrame(got, columns=["bundle", "found"])

    found = (asked.groupBy("shard").cogroup(index.groupBy("shard"))
             .applyInPandas(probe, "bundle int, found binary"))

    def tell(key, texts_: pd.DataFrame, found_: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(found_):
            often = np.sort(np.frombuffer(b"".join(found_["found"]), np.int64))
            lens = texts_["keys"].map(len).to_numpy()
            k = np.concatenate(texts_["keys"].to_list())
            at = np.minimum(np.searchsorted(often, k), len(often) - 1)
            hit = often[at] == k
            starts = np.cumsum(lens) - lens
            for i in np.flatnonzero(np.add.reduceat(hit, starts)).tolist():
                own = slice(starts[i], starts[i] + lens[i])
                out.append((texts_["text_hash"].iloc[i], np.unique(k[own][hit[own]]).tolist()))
        return pd.DataFrame(out, columns=["text_hash", "drop"])

    return (bundled.groupBy("bundle").cogroup(found.groupBy("bundle"))
            .applyInPandas(tell, "text_hash long, drop array<long>"))


def dedup_lines(docs: DataFrame, *, text_col: str = "text", **kw) -> DataFrame:
    """Every row of ``docs`` with n_lines (before), n_dropped and kept (the
    text without its frequent lines)."""
    drops = cut_lineage(frequent_lines(docs, text_col=text_col, **kw)).select(
        F.col("text_hash").alias("__h"), F.col("drop").alias("__drop"))

    @F.pandas_udf("n_dropped long, kept string")
    def rewrite(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for texts, drop in batches:
            n, kept = [], []
            for t, d in zip(texts, drop):
                if t is None or d is None:
                    n.append(0)
                    kept.append(None)
                    continue
                gone = set(d)
                lines = t.split("\n")
                stay = [x for x, k in zip(lines, line_keys(t)) if k not in gone]
                n.append(len(lines) - len(stay))
                kept.append("\n".join(stay))
            yield pd.DataFrame({"n_dropped": n, "kept": kept})

    text = F.coalesce(F.col(text_col), F.lit(""))
    out = (docs.withColumn("__t", text).withColumn("__h0", F.xxhash64(text))
           .join(drops, F.col("__h0") == F.col("__h"), "left")
           .withColumn("__r", rewrite(F.when(F.col("__drop").isNotNull(), F.col("__t")), F.col("__drop"))))
    return (out.withColumn("n_lines", (F.length("__t") - F.length(F.replace("__t", F.lit("\n"), F.lit(""))) + 1).cast("long"))
            .withColumn("n_dropped", F.col("__r.n_dropped"))
            .withColumn("kept", F.coalesce("__r.kept", "__t"))
            .drop("__t", "__h0", "__h", "__drop", "__r"))

"""SimHash near-duplicates through vantage-point trees.

1. A fingerprint per document: 64 bits, one set where more than half of the
   XXH64 hashes of the word shingles have it set (repeats count).
2. Documents fold to distinct fingerprints.  A vantage-point tree over a
   bounded sample of them (``sample`` fingerprints) partitions Hamming space:
   a node sends fingerprints within ``radius`` of its vantage point inside,
   the others outside.
3. Every fingerprint has one home leaf (shard).  By the triangle inequality a
   fingerprint outside can only have neighbours inside if it lies within
   ``radius + max_bits`` of the vantage point; exactly those boundary
   fingerprints are sent into the inside branch too, as queries, and prune
   the branches below it in the same way.  So every pair within ``max_bits``
   meets in the home leaf of one of the two.
4. A leaf finds its exact pairs with a local tree of the same kind and hands
   on a spanning forest of them, never the pairs: at most one row per
   fingerprint.  An oversized leaf is cut into a grid of (home chunk, query
   chunk) cells, which together still compare every pair.
5. The forest's edges go through ``common.components``.

Defined cases: null and empty texts and texts without a word have fingerprint
0 and link like any other; fewer words than a shingle form one shingle;
component_id is the smallest non-null doc_id of the component (null if it has
none); repeated rows are in one component; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.llm.common import components, cut_lineage, word_blocks


# ------------------------------------------------------------ fingerprints

def _bit_counts(words: list[bytes], k: int, seed: int) -> tuple[np.ndarray, int]:
    """Set bits per position over the shingles of ``words``, and their number."""
    text = b" ".join(words)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens).tolist()
    ends = ends.tolist()[k - 1:]
    h64 = xxhash.xxh64_intdigest
    h = np.array([h64(text[s:e], seed) for s, e in zip(starts, ends)], dtype="<u8")
    total = np.zeros(64, np.int64)
    for i in range(0, len(h), 1 << 14):
        part = h[i:i + (1 << 14)].view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return total, len(h)


def fingerprint(text: str | None, k: int = 3, seed: int = 42) -> int:
    """The 64-bit SimHash of a text as a signed integer."""
    total, n, carry = np.zeros(64, np.int64), 0, []
    for words in word_blocks(text):
        words = carry + words
        if len(words) >= k:
            t, m = _bit_counts(words, k, seed)
            total, n = total + t, n + m
            carry = words[-(k - 1):] if k > 1 else []
        else:
            carry = words
    if not n and carry:
        total, n = _bit_counts([b" ".join(carry)], 1, seed)
    bits = np.packbits(2 * total > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprint_col(text: Column, k: int = 3, seed: int = 42) -> Column:
    @F.pandas_udf("long")
    def simhash64(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in texts:
            yield pd.Series([fingerprint(t, k, seed) for t in s], dtype="int64")
    return simhash64(text)


# -------------------------------------------------------- vantage-point tree

def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int16)


def build_tree(points: np.ndarray, depth: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Vantage points and radii of a complete tree in heap order.  Of a few
    points at a node, the one with the widest spread of distances becomes the
    vantage point; the radius halves the points as evenly as it can."""
    rng = np.random.default_rng(seed)
    n = (1 << depth) - 1
    vantage = rng.integers(0, 1 << 63, n, dtype=np.uint64) if n else np.zeros(0, np.uint64)
    radius = np.full(n, 31, np.int16)
    at = np.zeros(len(points), np.int64)
    for level in range(depth):
        first = (1 << level) - 1
        order = np.argsort(at, kind="stable")
        cuts = np.searchsorted(at[order], np.arange(first, 2 * first + 2))
        for node in range(first, 2 * first + 1):
            mine = order[cuts[node - first]:cuts[node - first + 1]]
            if len(mine) < 2:
                at[mine] = 2 * node + 1
                continue
            own = points[mine]
            picks = own[rng.integers(0, len(own), 6)]
            best = max(picks, key=lambda v: _distance(own, v).var())
            d = _distance(own, best)
            inside = np.cumsum(np.bincount(d, minlength=65))
            vantage[node] = best
            radius[node] = int(np.argmin(np.abs(inside - len(own) / 2)))
            at[mine] = 2 * node + 1 + (d > radius[node])
    return vantage, radius


def route(tree: tuple[np.ndarray, np.ndarray], depth: int, fps: np.ndarray, max_bits: int,
          queries: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(position, leaf, is_query): each of ``fps`` at its home leaf, and as a
    query wherever a neighbour may be at home that doesn't come to it.
    ``queries`` marks fingerprints that are at home elsewhere."""
    vantage, radius = tree
    q = np.zeros(len(fps), bool) if queries is None else queries.copy()
    pos, node = np.arange(len(fps)), np.zeros(len(fps), np.int64)
    for _ in range(depth):
        d, r = _distance(fps[pos], vantage[node]), radius[node]
        left, right = 2 * node + 1, 2 * node + 2
        near = d <= r + max_bits
        go_in = np.where(q, near, d <= r)
        go_out = np.where(q, d > r - max_bits, d > r)
        visit = ~q & (d > r) & near
        pos, node, q = (np.concatenate([pos[go_in], pos[go_out], pos[visit]]),
                        np.concatenate([left[go_in], right[go_out], left[visit]]),
                        np.concatenate([q[go_in], q[go_out], np.ones(int(visit.sum()), bool)]))
    return pos, node - ((1 << depth) - 1), q


class Forest:
    """Union-find over positions, whole arrays of pairs at a time."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        while len(a):
            a, b = self.up[a], self.up[b]
            differ = a != b
            a, b = a[differ], b[differ]
            np.minimum.at(self.up, np.maximum(a, b), np.minimum(a, b))
            while True:
                top = self.up[self.up]
                if (top == self.up).all():
                    break
                self.up = top


def link_leaf(fps: np.ndarray, query: np.ndarray, max_bits: int, small: int = 96) -> np.ndarray:
    """Root position per fingerprint, linking all pairs within ``max_bits`` of
    which at least one is at home."""
    forest = Forest(len(fps))
    depth = max(0, int(np.ceil(np.log2(max(1, (~query).sum()) / small))))
    tree = build_tree(fps[~query][:1 << 15], depth)
    pos, leaf, q = route(tree, depth, fps, max_bits, query)
    order = np.lexsort((q, leaf))
    pos, leaf, q = pos[order], leaf[order], q[order]
    cuts = np.flatnonzero(np.r_[True, leaf[1:] != leaf[:-1], True])
    pairs_a, pairs_b, waiting = [], [], 0
    for s, e in zip(cuts[:-1], cuts[1:]):
        homes = pos[s:e][~q[s:e]]
        for i in range(0, len(homes), 256):  # bounded blocks, also where a leaf can't be cut
            some = homes[i:i + 256]
            for j in range(s, e, 1 << 14):
                other = pos[j:min(e, j + (1 << 14))]
                x, y = np.nonzero(_distance(fps[some][:, None], fps[other][None, :]) <= max_bits)
                a, b = some[x], other[y]
                keep = a != b
                pairs_a.append(a[keep])
                pairs_b.append(b[keep])
                waiting += len(a)
                if waiting > 1 << 20:
                    forest.add(np.concatenate(pairs_a), np.concatenate(pairs_b))
                    pairs_a, pairs_b, waiting = [], [], 0
    if pairs_a:
        forest.add(np.concatenate(pairs_a), np.concatenate(pairs_b))
    return forest.up


def near_links(distinct: DataFrame, max_bits: int = 2, *, fp: str = "fp", leaf_rows: int = 1024,
               sample: int = 50_000, max_depth: int = 16, cell_rows: int = 60_000) -> DataFrame:
    """Edges (a, b) of a spanning forest of all pairs of distinct fingerprints
    that differ in at most ``max_bits`` bits."""
    n = distinct.count()
    depth = min(max_depth, max(0, int(np.ceil(np.log2(max(1, n) / leaf_rows)))))
    draw = F.pmod(F.xxhash64(F.lit("sample"), F.col(fp)), F.lit(1 << 30))
    drawn = distinct.where(draw < F.lit(int(min(1.0, sample / max(1, n)) * (1 << 30)))).select(fp)
    points = np.sort(np.array([r[0] for r in drawn.collect()], np.int64)).view(np.uint64)
    tree = build_tree(points, depth)

    def to_leaves(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            x = pdf[fp].to_numpy(np.int64)
            for i in range(0, len(x), 4096):
                own = x[i:i + 4096]
                pos, leaf, q = route(tree, depth, own.view(np.uint64), max_bits)
                yield pd.DataFrame({"leaf": leaf.astype(np.int32), "fp": own[pos], "query": q})

    routed = cut_lineage(distinct.select(fp).mapInPandas(to_leaves, "leaf int, fp long, query boolean"))
    over = (routed.groupBy("leaf").agg(F.count_if(~F.col("query")).alias("h"), F.count(F.lit(1)).alias("q"))
            .where(F.col("q") > cell_rows))  # one row per leaf at most
    cells = [(r.leaf, -(-r.h // (cell_rows // 4)), -(-r.q // (cell_rows // 2))) for r in over.collect()]
    grid = distinct.sparkSession.createDataFrame(cells, "leaf int, hs int, qs int")
    mixed = F.xxhash64(F.lit("cell"), "fp")
    own = F.pmod(mixed, F.col("hs")).cast("int"), F.pmod(F.shiftright(mixed, 20), F.col("qs")).cast("int")
    placed = routed.join(F.broadcast(grid), "leaf", "left")
    plain = placed.where("hs is null").select("leaf", F.lit(0).alias("i"), F.lit(0).alias("j"), "fp", "query")
    cut = placed.where("hs is not null")
    as_home = cut.where(~F.col("query")).select("leaf", own[0].alias("i"), F.explode(
        F.sequence(F.lit(0), F.col("qs") - 1)).alias("j"), "fp", F.lit(False).alias("query"))
    as_query = cut.select("leaf", F.explode(F.sequence(F.lit(0), F.col("hs") - 1)).alias("i"),
                          own[1].alias("j"), "fp", F.lit(True).alias("query"))

    def link(pdf: pd.DataFrame) -> pd.DataFrame:
        fps = pdf["fp"].to_numpy(np.int64)
        up = link_leaf(fps.view(np.uint64), pdf["query"].to_numpy(bool), max_bits)
        linked = up != np.arange(len(up))
        out = pd.DataFrame({"a": fps[linked], "b": fps[up[linked]]})
        return out[out.a != out.b]

    return (plain.unionAll(as_home).unionAll(as_query).groupBy("leaf", "i", "j")
            .applyInPandas(link, "a long, b long"))


# ------------------------------------------------------------- near-duplicates

def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                    shingle: int = 3, max_bits: int = 2, seed: int = 42) -> DataFrame:
    """One row per input row: doc_id, row_key (hash of id and text), fp
    (signed fingerprint), component_id and keeper: the row_key of the one row
    that stands for the component."""
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("row_key"),
        fingerprint_col(F.col(text_col), shingle, seed).alias("fp")))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no"), "doc_id", "row_key"))
    distinct = cut_lineage(rows.groupBy("fp").agg(first.alias("first")))
    roots = components(near_links(distinct, max_bits))
    linked = distinct.join(roots, distinct.fp == roots.node, "left").select(
        "fp", F.coalesce("root", "fp").alias("root"), "first")
    heads = linked.groupBy("root").agg(F.min("first").alias("head"))
    named = cut_lineage(linked.select("fp", "root").join(heads, "root").select(
        F.col("fp").alias("__fp"), F.col("head.doc_id").alias("component_id"),
        F.col("head.row_key").alias("keeper")))
    return rows.join(named, rows.fp == named["__fp"], "left").drop("__fp")


def fingerprint_hex(fp: str = "fp") -> Column:
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The documents with one of each component kept (the smallest id; of
    repeated rows of that id and text, any one), with the input's columns."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col, **kw)
    keep = cut_lineage(found.where(F.col("row_key") == F.col("keeper")).select("row_key").distinct())
    keyed = docs.withColumn("__row_key", F.xxhash64(F.col(id_col), F.col(text_col)))
    return (keyed.join(keep, keyed["__row_key"] == keep.row_key, "left_semi")
            .dropDuplicates(["__row_key"]).drop("__row_key"))

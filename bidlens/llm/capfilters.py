"""Embedding near-duplicates through spherical-cap filters.

A filter is a direction; a vector passes it when its cosine with the
direction exceeds a threshold, so similar vectors pass common filters.  The
directions form a structured random product code: after a random rotation the
coordinates fall into two blocks, each with its own random codebook of k unit
directions, and a filter is a pair of codewords (k * k filters from 2 k
codewords).  A vector is list-decoded to all filters it exceeds: its inner
products with the two codebooks are sorted, and for every first codeword the
second ones that reach the threshold are a prefix.

Vectors meet in the buckets (label, filter) and are verified there by exact
cosine in double precision.  A pair is counted in the first filter its two
vectors share, so no pair is ever written: a bucket returns, per vector, its
number of links and its root in the bucket's spanning forest.  Exact copies
fold to one vector first.  A bucket with more than ``cell_rows`` vectors is
cut into a grid of cells that together still compare every pair.

The number of filters grows with the number of distinct vectors, so that
buckets keep their size; ``filters`` is the expected number that a vector
passes.  As a cap may be out of a vector's way altogether, one that exceeds
fewer than ``least`` directions takes its ``least`` nearest: similar vectors
share many of those too.  Both set the recall (measured in the README).

Defined cases: vectors that are null, empty, zero or hold null or non-finite
components, or whose label is null, link with nothing and are their own
component; so do vectors of different length with each other; repeated rows
are copies of each other; a null id doesn't name a component unless nothing
else can; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.llm.common import components, cut_lineage
from bidlens.llm.simhash import Forest


class ProductCode:
    """k * k filter directions in ``dim`` dimensions."""

    def __init__(self, dim: int, k: int, filters: float, least: int, seed: int = 7):
        rng = np.random.default_rng([seed, dim, k])
        self.k, self.half, self.least = k, (dim + 1) // 2, min(least, k * k)
        self.turn = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
        self.books = []
        for width in (self.half, dim - self.half):
            book = rng.normal(size=(k, max(1, width)))
            self.books.append(book / np.linalg.norm(book, axis=1, keepdims=True) / np.sqrt(2))
        tail = min(0.5, filters / (k * k))
        self.threshold = NormalDist().inv_cdf(1 - tail) / np.sqrt(dim)

    def decode(self, unit: np.ndarray) -> list[np.ndarray]:
        """Sorted filter numbers that each unit vector exceeds; at least its
        ``least`` nearest ones."""
        x = unit @ self.turn
        first = x[:, :self.half] @ self.books[0].T
        second = x[:, self.half:] @ self.books[1][:, :x.shape[1] - self.half].T
        order = np.argsort(-second, axis=1)
        top = min(self.least, self.k)  # the least-th best sum lies among the best of both lists
        out = []
        for a, b, o in zip(first, second, order):
            sums = np.add.outer(np.sort(a)[::-1][:top], b[o[:top]]).ravel()
            least = np.partition(sums, len(sums) - self.least)[len(sums) - self.least]
            n = np.searchsorted(-b[o], a - min(self.threshold, least - 1e-12), side="right")
            i = np.flatnonzero(n)
            out.append(np.sort(np.concatenate([i_ * self.k + o[:c] for i_, c in zip(i, n[i])])
                               if len(i) else np.zeros(0, np.int64)))
        return out


def unit_rows(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1 in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # against overflow of the squares
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def link_bucket(unit: np.ndarray, code: ProductCode, here: int, home: np.ndarray, other: np.ndarray,
                copies: np.ndarray, min_cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """Links and forest roots in one cell: pairs (home, other) with the cosine
    reached that share no filter before ``here``.  The filters of the vectors
    in such pairs are decoded again, which is cheaper than sending them."""
    links, forest, member = np.zeros(len(unit), np.int64), Forest(len(unit)), None
    same = len(home) and len(other) and home[0] == other[0]  # a chunk with itself: each pair once
    for i in range(0, len(home), 512):
        a = home[i:i + 512]
        hit = unit[a] @ unit[other].T >= min_cosine
        if hit.sum() <= same * len(a):
            continue  # nothing but each vector with itself
        if member is None:
            early = [p[p < here] for p in code.decode(unit)]
            names, col = np.unique(np.concatenate(early), return_inverse=True)
            member = np.zeros((len(unit), max(1, len(names))), np.float32)
            member[np.repeat(np.arange(len(unit)), [len(e) for e in early]), col] = 1
        x, y = np.nonzero(hit & (member[a] @ member[other].T == 0))
        p, q = a[x], other[y]
        if same:
            p, q = p[p < q], q[p < q]
        np.add.at(links, p, copies[q])
        np.add.at(links, q, copies[p])
        forest.add(p, q)
    return links, forest.up


def near_vectors(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding",
                 label_col: str = "label", min_cosine: float = 0.93, filters: float = 24.0, least: int = 40,
                 bucket_rows: int = 24, cell_rows: int = 2048, lot_filters: int = 32,
                 broadcast_rows: int = 100_000) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept."""
    v = F.col(vec_col)
    good = (F.col(label_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)
            & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
            & F.exists(v, lambda x: x != 0))
    rows = cut_lineage(vectors.select(
        F.col(id_col).alias("vec_id"), F.when(good, F.xxhash64(F.col(label_col), v)).alias("gid"),
        F.when(good, F.concat(F.size(v).cast("string"), F.lit(":"), F.col(label_col).cast("string"))).alias("part"),
        F.when(good, v).alias("vec")))
    distinct = cut_lineage(rows.where("gid is not null").groupBy("gid").agg(
        F.first("part").alias("part"), F.first("vec").alias("vec"),
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("copies")))
    largest = distinct.groupBy("part").count().agg(F.max("count")).first()[0] or 0
    k = max(8, int(np.ceil(np.sqrt(largest * filters / bucket_rows))))

    kind = "<f4" if "float" in vectors.schema[vec_col].dataType.simpleString() else "<f8"

    def decode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes: dict[int, ProductCode] = {}
        for pdf in frames:
            for at in range(0, len(pdf), 512):
                some = pdf.iloc[at:at + 512]
                for dim, same in some.groupby(some["vec"].map(len)):
                    if dim not in codes:
                        codes[dim] = ProductCode(dim, k, filters, least)
                    x = np.stack(same["vec"].to_list()).astype(kind)
                    found = codes[dim].decode(unit_rows(x))
                    times = [len(f) for f in found]
                    rows_ = {"vec": np.array([v_.tobytes() for v_ in x], object),
                             **{c: same[c].to_numpy() for c in ("part", "gid", "copies")}}
                    yield pd.DataFrame({"filter": np.concatenate(found).astype(np.int32),
                                        **{c: np.repeat(a, times) for c, a in rows_.items()}})

    passed = distinct.select("gid", "part", "copies", "vec").mapInPandas(
        decode, "filter int, vec binary, part string, gid long, copies long")
    over = cut_lineage(passed.groupBy("part", "filter").count().where(F.col("count") > cell_rows)
                       .select(F.col("part").alias("p"), F.col("filter").alias("f"),
                               F.ceil(F.col("count") / (cell_rows // 2)).cast("int").alias("cuts")))
    if over.count() <= broadcast_rows:  # 12 bytes a row; more of them meet the vectors in a shuffle
        over = F.broadcast(over)
    placed = passed.join(over, (passed.part == over.p) & (passed["filter"] == over.f), "left")
    own = F.pmod(F.xxhash64(F.lit("cell"), "gid"), F.col("cuts")).cast("int")
    # cell (i, j) with i <= j: the home rows of chunk i meet the rows of chunk j
    cells = F.when(F.col("cuts").isNull(), F.array(F.struct(F.lit(0).alias("i"), F.lit(0).alias("j")))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("cuts") - 1), lambda o: F.struct(
            F.least(o, own).alias("i"), F.greatest(o, own).alias("j"))))
    # small buckets go through one task's hands a lot at a time, a cell of a large one alone
    lots = max(1, k * k // lot_filters)
    lot = F.when(F.col("cuts").isNull(), F.pmod("filter", F.lit(lots))).otherwise(-1 - F.col("filter"))
    dealt = (placed.withColumn("own", F.coalesce(own, F.lit(0))).withColumn("lot", lot)
             .withColumn("cell", F.explode(cells))
             .select("part", "lot", "cell.i", "cell.j", "filter", "own", "gid", "copies", "vec"))

    codes: dict[int, ProductCode] = {}  # filled in the workers

    def link(key, pdf: pd.DataFrame) -> pd.DataFrame:
        _, _, i, j = key
        dim = len(pdf["vec"].iloc[0]) // int(kind[2])
        if dim not in codes:
            codes[dim] = ProductCode(dim, k, filters, least)
        pdf = pdf.sort_values(["filter", "gid"], ignore_index=True)
        here, own_, g, copies = (pdf[c].to_numpy() for c in ("filter", "own", "gid", "copies"))
        links, roots = np.zeros(len(pdf), np.int64), g.copy()
        cuts = np.flatnonzero(np.concatenate([[True], here[1:] != here[:-1], [True]]))
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e - s < 2:
                continue
            unit = unit_rows(np.stack([np.frombuffer(x, kind) for x in pdf["vec"].iloc[s:e]]))
            home, other = np.flatnonzero(own_[s:e] == i), np.flatnonzero(own_[s:e] == j)
            links[s:e], up = link_bucket(unit, codes[dim], here[s], home, other, copies[s:e], min_cosine)
            roots[s:e] = g[s:e][up]
        some = links > 0
        return pd.DataFrame({"gid": g[some], "links": links[some], "root": roots[some]})

    found = cut_lineage(dealt.groupBy("part", "lot", "i", "j").applyInPandas(link, "gid long, links long, root long"))
    roots = components(found.select("gid", "root"), "gid", "root")
    links = found.groupBy("gid").agg(F.sum("links").alias("links"))
    named = (distinct.select("gid", "copies", "first")
             .join(roots.withColumnRenamed("node", "gid"), "gid", "left")
             .join(links, "gid", "left")
             .select("gid", F.coalesce("root", "gid").alias("root"), "first",
                     (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links")))
    heads = named.groupBy("root").agg(F.min("first").alias("component_id"))
    named = cut_lineage(named.join(heads, "root").select(F.col("gid").alias("__g"), "n_links", "component_id"))
    return (rows.select("vec_id", "gid").join(named, F.col("gid") == F.col("__g"), "left")
            .select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                    F.when(F.col("gid").isNull(), F.col("vec_id")).otherwise(F.col("component_id")).cast("long")
                    .alias("component_id"))
            .withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False))))

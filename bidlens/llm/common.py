"""Helpers shared by the corpus operators."""

from __future__ import annotations

import pickle
import re

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.session import cut_lineage

# Fixed value: the word rule of the contracts.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def share(spark: SparkSession, thing):
    """Broadcast an object of this package (pickled by value, see __init__)."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(thing))


def shared(broadcast):
    return pickle.loads(broadcast.value)


def id_crc(id_col: str | Column = "doc_id") -> Column:
    """crc32 of the id written as text (unsigned); a null id reads as ''."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary"))


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    return id_crc(id_col) % F.lit(modulus) == F.lit(remainder)


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Connected components of an undirected edge table: (node, root), root
    being the smallest node reachable, one row per node that has an edge.

    Each round every node hooks to its smallest neighbour (a partial ``min``
    aggregate, so a hub reaches the shuffle as one row per task), the
    resulting forest is flattened by pointer jumping, and the edges are
    rewritten between roots.  A root that has absorbed no neighbour has a
    smaller one in the next round, so the roots of unfinished components halve
    every two rounds at least.  Every round is a reliable checkpoint; nothing
    is collected but whether rows are left."""
    e = cut_lineage(edges.where(F.col(a) != F.col(b))
                    .select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct())
    mapping = None
    while not e.isEmpty():
        both = e.select(F.col("a").alias("node"), F.col("b").alias("nbr")).unionAll(
            e.select(F.col("b").alias("node"), F.col("a").alias("nbr")))
        hook = both.groupBy("node").agg(F.min("nbr").alias("m")).select(
            "node", F.least("node", "m").alias("up"))
        hook = cut_lineage(hook)
        while True:  # pointer jumping
            up = hook.select(F.col("node").alias("up"), F.col("up").alias("top"))
            nxt = cut_lineage(hook.join(up, "up", "left").select(
                "node", F.col("up").alias("old"), F.coalesce("top", "up").alias("up")))
            moved = not nxt.where(F.col("old") != F.col("up")).isEmpty()
            hook = nxt.select("node", "up")
            if not moved:
                break
        if mapping is None:
            mapping = hook.select("node", F.col("up").alias("root"))
        else:
            h = hook.select(F.col("node").alias("root"), F.col("up").alias("__r"))
            mapping = cut_lineage(mapping.join(h, "root", "left").select(
                "node", F.coalesce("__r", "root").alias("root")))
        ra = hook.select(F.col("node").alias("a"), F.col("up").alias("ra"))
        rb = hook.select(F.col("node").alias("b"), F.col("up").alias("rb"))
        e = cut_lineage(e.join(ra, "a").join(rb, "b").where(F.col("ra") != F.col("rb"))
                        .select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b"))
                        .distinct())
    if mapping is None:
        return e.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return mapping


_SPACE = re.compile(rb"[ \t-\r]")


def word_blocks(text: str | None, size: int = 1 << 20, delete: bytes = b""):
    """Lists of the UTF-8 words of a text, A-Z lower-cased, a block of about ``size`` bytes at
    a time, so that a very long text never becomes one list.  The bytes in
    ``delete`` are left out first.  (bytes.lower() and bytes.split() treat
    exactly A-Z and the six ASCII spaces, and no byte of a longer UTF-8
    sequence is one of them.)"""
    data = (text or "").encode("utf-8", "surrogatepass").lower().translate(None, delete)
    start = 0
    while start < len(data):
        end = start + size
        m = _SPACE.search(data, end) if end < len(data) else None
        end = m.start() if m else len(data)
        yield data[start:end].split()
        start = end

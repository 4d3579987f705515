"""Merkle manifest of a dataset by cogrouped subtree exchange.

Every row is a leaf; the leaves of a source, in id order, form a tree of
runs of 16, and the sources' roots, in source order, form a tree above.

1. Leaves (32 bytes each, never the texts) are range-partitioned by
   (source, id) and numbered from per-partition counts; no window sorts a
   source.  A superblock is 4,096 consecutive nodes of one tree, a unit a hash
   bucket of a few superblocks, so a hot source is spread over many units and
   thousands of small sources share one.
2. Going up, each unit reduces its superblocks to one node each; the nodes
   are the leaves of the next round, until every tree has one node.  The
   sources' roots are numbered and reduced the same way.
3. Going down, a round's nodes and the outer nodes their superblocks need
   (the siblings on the way from the superblock to the root: at most 15 per
   level) are cogrouped by unit in applyInPandas.  One pass finishes the
   local reduction, joins the inner and outer siblings to whole proofs and,
   for the leaves, folds each claimed leaf up to a root.

H is the hex sha256 of its inputs' hex texts put together.  Bounded: a unit
holds some superblocks (8,192 nodes expected), the driver gets two counts
per tree level; every round is a reliable checkpoint.

Defined cases: a null source is a source of its own and comes first; null
ids come first in their source; repeated rows are leaves of their own, in
any order among themselves (they agree in everything); a lone leaf is its
source's root and a lone source's root the dataset's; a proof without
siblings is empty; an empty table has no rows.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bidlens.llm.common import cut_lineage

FAN = 16  # nodes of a run
DEEP = 3  # levels of a superblock
BLOCK = FAN ** DEEP
UNIT = 2 * BLOCK  # nodes expected in a unit

NODE = "tree string, pos long, size long, digest binary"
PATH = "indexes array<int>, siblings array<binary>, subroot binary, root binary"


def leaf(*fields: Column) -> Column:
    """Hex digest of a row: each field as its UTF-8 byte count, a colon and
    its value, ``-`` if null."""
    def framed(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*map(framed, fields)).cast("binary"), 256)


def join_digests(parts: Sequence[bytes]) -> bytes:
    """H of some nodes: sha256 of their hex texts put together."""
    return hashlib.sha256(b"".join(parts).hex().encode()).digest()


def local_levels(digests: list[bytes], size: int) -> list[list[bytes]]:
    """The levels of a superblock, lowest first.  The superblock of a tree of
    more than one superblock has all its levels, however few nodes it has; a
    smaller tree ends with its root."""
    levels = [digests]
    while len(levels) <= DEEP and (size > BLOCK or len(levels[-1]) > 1):
        below = levels[-1]
        levels.append([join_digests(below[i:i + FAN]) for i in range(0, len(below), FAN)])
    return levels


def local_path(levels: list[list[bytes]], i: int) -> tuple[list[int], list[bytes]]:
    """Per level the node's place in its run and the run's other nodes."""
    at, around = [], []
    for level in levels[:-1]:
        run = i - i % FAN
        at.append(i - run)
        around.append(b"".join(level[run:i]) + b"".join(level[i + 1:run + FAN]))
        i //= FAN
    return at, around


def fold(digest: bytes, at: Sequence[int], around: Sequence[bytes]) -> bytes:
    """Root that a leaf and its siblings give."""
    for i, others in zip(at, around):
        digest = hashlib.sha256((others[:32 * i] + digest + others[32 * i:]).hex().encode()).digest()
    return digest


def _superblocks(nodes: pd.DataFrame):
    """(tree, block, size, rows in order) of each superblock of a unit."""
    held: dict = {}
    for i, (tree, pos) in enumerate(zip(nodes["tree"], nodes["pos"])):
        held.setdefault((tree, pos // BLOCK), []).append((pos, i))
    for (tree, block), rows in held.items():
        rows.sort()
        yield tree, block, int(nodes["size"].iloc[rows[0][1]]), [i for _, i in rows]


def _number(rows: DataFrame, tree: Column, order: Sequence[str]) -> DataFrame:
    """rows with tree, pos (place in the tree's order) and size (of the tree).
    Rows equal in the order are told apart by a hash of their place."""
    by = [F.col("tree").asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order], F.col("__tie")]
    rows = rows.withColumn("tree", tree).withColumn("__tie", F.xxhash64(F.monotonically_increasing_id()))
    place = F.monotonically_increasing_id()
    rows = cut_lineage(rows.repartitionByRange(*by).sortWithinPartitions(*by).drop("__tie")
                       .withColumn("__part", F.shiftright(place, 33).cast("int"))
                       .withColumn("__row", place.bitwiseAND(F.lit((1 << 33) - 1))))
    parts = rows.groupBy("tree", "__part").agg(F.min("__row").alias("__first"), F.count(F.lit(1)).alias("__n"))
    w = W.partitionBy("tree").orderBy("__part")  # one row per source and partition
    parts = parts.select(
        F.col("tree").alias("__tree"), F.col("__part").alias("__p"),
        (F.coalesce(F.sum("__n").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)) - F.col("__first")).alias("__add"),
        F.sum("__n").over(W.partitionBy("tree")).alias("size"))
    on = (F.col("__part") == F.col("__p")) & F.col("tree").eqNullSafe(F.col("__tree"))
    return (rows.join(cut_lineage(parts), on)
            .withColumn("pos", F.col("__row") + F.col("__add"))
            .drop("__part", "__row", "__tree", "__p", "__add"))


def _units(nodes: DataFrame, units: int, block: Column | None = None) -> DataFrame:
    block = F.floor(F.col("pos") / BLOCK) if block is None else block
    return nodes.withColumn("unit", F.pmod(F.xxhash64("tree", block), F.lit(units)).cast("int"))


def _reduce(nodes: DataFrame, units: int) -> DataFrame:
    """One node per superblock: the nodes of the next round."""
    def up(key, pdf: pd.DataFrame) -> pd.DataFrame:
        digest = pdf["digest"].tolist()
        return pd.DataFrame([(tree, block, -(-size // BLOCK), local_levels([digest[i] for i in at], size)[-1][0])
                             for tree, block, size, at in _superblocks(pdf)], columns=["tree", "pos", "size", "digest"])
    return (_units(nodes.select("tree", "pos", "size", "digest"), units)
            .groupBy("unit").applyInPandas(up, NODE))


def _rounds(nodes: DataFrame) -> list[tuple[DataFrame, int]]:
    """(nodes, units) of every round, the roots (one node per tree) last."""
    out = []
    while True:
        n, largest = nodes.agg(F.count(F.lit(1)), F.max("size")).first()
        units = max(1, -(-n // UNIT))
        out.append((nodes, units))
        if (largest or 0) <= 1:
            return out
        nodes = cut_lineage(_reduce(nodes, units))


def _exchange(nodes: DataFrame, outer: DataFrame, units: int, down, schema: str) -> DataFrame:
    """Cogroups nodes and the paths of their superblocks by unit; ``down``
    gets (nodes, rows of a superblock, levels, outer path) and yields rows."""
    names = [c.strip().split()[0] for c in schema.split(",")]

    def finish(key, own: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        paths = {(t, p): rest for t, p, *rest in outside[
            ["tree", "pos", "indexes", "siblings", "subroot", "root"]].itertuples(index=False)}
        digest, out = own["digest"].tolist(), []
        for tree, block, size, at in _superblocks(own):
            levels = local_levels([digest[i] for i in at], size)
            out.extend(down(own, at, levels, paths[tree, block]))
        return pd.DataFrame(out, columns=names)

    return (_units(nodes, units).groupBy("unit")
            .cogroup(_units(outer, units, F.col("pos")).groupBy("unit")).applyInPandas(finish, schema))


def _descend(rounds: list[tuple[DataFrame, int]], paths: DataFrame) -> DataFrame:
    """Paths of the superblocks of the lowest round, from the roots' own."""
    def down(own, at, levels, outside):
        for k, i in enumerate(at):
            where, around = local_path(levels, k)
            yield (own["tree"].iloc[i], own["pos"].iloc[i], [*where, *outside[0]], [*around, *outside[1]], *outside[2:])

    for nodes, units in reversed(rounds[1:-1]):
        paths = cut_lineage(_exchange(nodes, paths, units, down, f"tree string, pos long, {PATH}"))
    return paths


def manifest(rows: DataFrame, *, id_col: str = "doc_id", tree_col: str = "source", leaf_col: str = "leaf",
             claimed_col: str | None = None) -> DataFrame:
    """Per row: its id and source, leaf, subroot and root (hex), position in
    its source, proof_at (place in its run, level by level), proof (per level
    the siblings' digests, 32 bytes each, left to right), folded_root (what ``claimed_col``, or the leaf where that is null, and the
    siblings give) and verified (it is the root)."""
    kind = dict(rows.dtypes)[id_col]
    claimed = F.unhex(F.col(claimed_col)) if claimed_col else F.lit(None).cast("binary")
    leaves = _number(rows.select(F.col(id_col).alias("id"), F.col(tree_col).cast("string").alias("__source"),
                                 F.unhex(F.col(leaf_col)).alias("digest"), claimed.alias("claimed")),
                     F.col("__source"), ["id", "digest"]).withColumn("id", F.col("id").cast("string")).drop("__source")
    rounds = _rounds(leaves)
    if len(rounds) == 1:  # only lone leaves: their paths are the roots' own
        rounds.append((cut_lineage(_reduce(*rounds[0])), 1))
    subroots = rounds[-1][0].select(F.col("tree").alias("source"), "digest")
    tops = _number(subroots, F.lit(None).cast("string"), ["source"])
    above = _rounds(tops)
    if len(above) == 1:
        above.append((cut_lineage(_reduce(*above[0])), 1))
    ends = above[-1][0].select("tree", "pos", F.array().cast("array<int>").alias("indexes"),
                               F.array().cast("array<binary>").alias("siblings"),
                               F.col("digest").alias("subroot"), F.col("digest").alias("root"))

    def source_paths(own, at, levels, outside):
        for k, i in enumerate(at):
            where, around = local_path(levels, k)
            yield (own["source"].iloc[i], 0, [*where, *outside[0]], [*around, *outside[1]],
                   own["digest"].iloc[i], outside[3])

    paths = cut_lineage(_exchange(tops, _descend(above, ends), above[0][1], source_paths, f"tree string, pos long, {PATH}"))

    def prove(own, at, levels, outside):
        subroot, root = outside[2].hex(), outside[3]
        ids, claims, tree = own["id"].tolist(), own["claimed"].tolist(), own["tree"].iloc[at[0]]
        first = int(own["pos"].iloc[at[0]])
        for k, i in enumerate(at):
            where, around = local_path(levels, k)
            where.extend(outside[0])
            around.extend(outside[1])
            folded = fold(claims[i] or levels[0][k], where, around)
            yield (ids[i], tree, first + k, levels[0][k].hex(), subroot, root.hex(), where, around,
                   folded.hex(), folded == root)

    out = _exchange(leaves, _descend(rounds, paths), rounds[0][1], prove,
                    "id string, tree string, position long, leaf string, subroot string, root string, "
                    "proof_at array<int>, proof array<binary>, folded_root string, verified boolean")
    return out.withColumn("id", F.col("id").cast(kind)).withColumnsRenamed({"id": id_col, "tree": tree_col})

"""Sharding by sampled splitters.

Records are keyed by a hash of their text.  A size-weighted sample of keys
gives quantile boundaries for ``fine`` key ranges; records are
range-partitioned by them and the ranges' sizes summed exactly.  Overfull
ranges are subdivided: a key (group of equal texts) that alone outweighs a
range becomes a range of its own, what is left is cut into equal parts of its
hash interval.  The ranges are packed into the shards, largest first into the
lightest shard.  Law: ``bytes`` (sizes near equal).

Equal texts stay in one shard unless their group alone is larger than a
shard's fair share; such a group is split by a hash of the id.  The tables on
the driver are bounded by ``fine``: the sample, the boundaries, one row per
range or part, and the heavy keys (at most ``fine`` keys can outweigh
1/fine of all bytes).  Slots are numbered inside small pieces (range part x
id hash) and offset by the pieces' counts, so no shard is sorted in one task.

Defined cases: a null text counts as empty (8 bytes); a null id is hashed as
'null'; repeated rows are records of their own; an empty table gives an empty
result; more shards than records leave shards empty.
"""

from __future__ import annotations

import heapq

import numpy as np
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from bidlens.llm.common import cut_lineage

KEY_BITS = 52  # a key is exact as a double


def _records(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    name = F.coalesce(F.col(id_col).cast("string"), F.lit("null"))
    return docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text) + 8).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.shiftrightunsigned(F.xxhash64(text), 64 - KEY_BITS).cast("double").alias("key"),
        F.shiftrightunsigned(F.xxhash64(F.lit("id"), name), 1).alias("id_hash"))


def _splitters(records: DataFrame, total: int, fine: int, oversample: int) -> list[float]:
    """Quantile boundaries of a size-weighted key sample of expected size
    fine * oversample (a record is drawn with probability proportional to its
    size, decided by its hash, so reruns agree)."""
    draw = (F.xxhash64(F.lit("sample"), "id_hash", "key").bitwiseAND(F.lit((1 << 40) - 1))).cast("double")
    p = F.col("size") * (fine * oversample / max(1, total)) * float(1 << 40)
    keys = np.sort(np.array([r[0] for r in records.where(draw < p).select("key").collect()]))
    if not len(keys):
        return []
    cuts = np.quantile(keys, np.arange(1, fine) / fine, method="lower")
    return [float(x) for x in np.unique(cuts) if x > 0]


def shard(docs: DataFrame, shards: int = 24, *, id_col: str = "doc_id", text_col: str = "text",
          fine_per_shard: int = 64, oversample: int = 16) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot for every row of ``docs``."""
    fine = shards * fine_per_shard
    rec = cut_lineage(_records(docs, id_col, text_col))
    total = rec.agg(F.sum("size")).first()[0] or 0
    cuts = _splitters(rec, total, fine, oversample)
    splits = [float("-inf"), *cuts, float("inf")] if cuts else [float("-inf"), 0.0, float("inf")]
    ranged = Bucketizer(splits=splits, inputCol="key", outputCol="range").transform(rec)
    ranged = ranged.withColumn("range", F.col("range").cast("int"))
    share, even = total / shards, total / fine
    # keys that outweigh an even range: at most `fine` of them
    heavy = {r.key: r.bytes for r in ranged.groupBy("key").agg(F.sum("size").alias("bytes"))
             .where(F.col("bytes") > even).collect()}
    heavy_df = docs.sparkSession.createDataFrame(
        [(k, i, int(-(-b // even)), b > share) for i, (k, b) in enumerate(sorted(heavy.items()))],
        "key double, heavy int, parts int, split boolean")
    ranged = ranged.join(F.broadcast(heavy_df), "key", "left")
    light = {r.range: r.bytes for r in ranged.where("heavy is null").groupBy("range")
             .agg(F.sum("size").alias("bytes")).collect()}
    lo = [max(0.0, s) for s in splits[:-1]]
    hi = [min(float(1 << KEY_BITS), s) for s in splits[1:]]
    over = [(r, lo[r], max(1.0, hi[r] - lo[r]), int(-(-b // even))) for r, b in light.items() if b > 1.5 * even]
    over_df = docs.sparkSession.createDataFrame(over, "range int, lo double, width double, cuts int")
    ranged = ranged.join(F.broadcast(over_df), "range", "left")
    # unit: what is packed as a whole; piece: what is numbered by one window
    by_id = (F.col("id_hash") % F.col("parts")).cast("int")
    part = F.least(F.floor((F.col("key") - F.col("lo")) / F.col("width") * F.col("cuts")), F.col("cuts") - 1)
    ranged = ranged.withColumn(
        "unit", F.when(F.col("heavy").isNotNull(),
                       F.concat_ws(".", F.lit("k"), "heavy", F.when(F.col("split"), by_id).otherwise(F.lit(0))))
        .otherwise(F.concat_ws(".", F.lit("r"), "range", F.coalesce(part.cast("int"), F.lit(0))))
    ).withColumn("piece", F.when(F.col("heavy").isNotNull(), by_id).otherwise(F.lit(0)))
    ranged = cut_lineage(ranged.select("doc_id", "size", "text_crc32", "id_hash", "unit", "piece"))
    pieces = ranged.groupBy("unit", "piece").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n")).collect()
    units: dict[str, int] = {}
    for p in pieces:
        units[p.unit] = units.get(p.unit, 0) + p.bytes
    load = [(0, s) for s in range(shards)]
    home: dict[str, int] = {}
    for unit, b in sorted(units.items(), key=lambda x: (-x[1], x[0])):
        had, s = heapq.heappop(load)
        home[unit] = s
        heapq.heappush(load, (had + b, s))
    first: dict[int, int] = {}
    placed = []
    for p in sorted(pieces, key=lambda p: (home[p.unit], p.unit, p.piece)):
        s = home[p.unit]
        placed.append((p.unit, p.piece, s, first.get(s, 0)))
        first[s] = first.get(s, 0) + p.n
    at = docs.sparkSession.createDataFrame(placed, "unit string, piece int, shard int, first long")
    order = W.partitionBy("unit", "piece").orderBy("id_hash", "doc_id", "text_crc32", "size")
    return (ranged.withColumn("rank", F.row_number().over(order))
            .join(F.broadcast(at), ["unit", "piece"])
            .select("doc_id", "size", "text_crc32", "shard",
                    (F.col("first") + F.col("rank") - 1).cast("long").alias("slot")))

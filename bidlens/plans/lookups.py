"""Lookup tables that a small batch reads in part.

A table is stored by hash bucket of its key (partition column ``bucket``,
their number in ``buckets``) and sorted by the key inside a bucket.  A batch
hashes its keys, and the buckets it needs become a partition filter of the
scan: files of other buckets aren't opened.  Where the buckets are still
large, the keys' range inside each is left to the row groups' statistics and
to the Bloom filter that Spark pushes into the scan side of such joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlens.plans.snapshots import bucket_of, publish_parts


def publish_lookup(df: DataFrame, table: str, key: str, buckets: int) -> str:
    """Publishes ``df`` stored by bucket; its folder."""
    placed = df.withColumn("buckets", F.lit(buckets)).withColumn("bucket", bucket_of(F.col(key), buckets))
    placed = placed.repartition("bucket", F.pmod(F.xxhash64(key, F.lit(7)), F.lit(4))).sortWithinPartitions("bucket", key)
    return publish_parts(placed, table, ["buckets", "bucket"])


def requested(table: DataFrame, requests: DataFrame, key: str = "award_id") -> DataFrame:
    """The part of a lookup table that can hold the requests' keys; a table
    that isn't stored by bucket stays as it is.  At most one row per bucket
    goes to the driver."""
    if not {"bucket", "buckets"} <= set(table.columns) or key not in requests.columns:
        return table
    n = table.select("buckets").first()
    if n is None:
        return table.drop("bucket", "buckets")
    needed = requests.select(bucket_of(F.col(key), n["buckets"]).alias("b")).distinct().collect()
    wanted = [r["b"] for r in needed] or [0]
    return table.where(F.col("bucket").isin(wanted)).drop("bucket", "buckets")

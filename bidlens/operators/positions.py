"""Dense global row positions without a one-task window.

Rows that are read from files have an order: file path, then place in the
file.  A split of a file is read in order by one task, so a row's position
is the number of rows in earlier splits plus its place in its own split.
Two passes: rows per split (one partial aggregation), then offsets joined
back.  The rows themselves aren't shuffled or sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from bidlens.session import cut_lineage

SMALL_SPLITS = 50_000  # splits whose offsets are broadcast: about 10 MB
_ROW_BITS = 33  # monotonically_increasing_id: partition number above, row number below


def running_offsets(counts: DataFrame, order: Sequence[str], n: str = "n", name: str = "offset") -> DataFrame:
    """``counts`` with the sum of ``n`` over all rows earlier in ``order``
    (unique per row).  The rows are range-partitioned and summed per
    partition; only one row per partition passes a single task."""
    at = F.monotonically_increasing_id()
    rows = cut_lineage(counts.repartitionByRange(*order).sortWithinPartitions(*order)
                       .withColumn("__part", F.shiftright(at, _ROW_BITS).cast("int"))
                       .withColumn("__at", at))

    def before(c: str, w) -> Column:
        return F.coalesce(F.sum(c).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    parts = rows.groupBy("__part").agg(F.sum(n).alias("__n")).select(
        F.col("__part").alias("__p"), before("__n", W.orderBy("__part")).alias("__base"))
    own = before(n, W.partitionBy("__part").orderBy("__at"))
    return (rows.withColumn("__own", own).join(parts, F.col("__part") == F.col("__p"))
            .withColumn(name, (F.col("__own") + F.col("__base")).cast("long"))
            .drop("__part", "__at", "__own", "__p", "__base"))


def file_positions(rows: DataFrame, name: str = "position") -> DataFrame:
    """Rows of a file read with their dense position in (file path, line)
    order.  ``rows`` must be the read itself, as the files' metadata is used."""
    tagged = rows.select("*", F.col("_metadata.file_path").alias("__file"),
                         F.col("_metadata.file_block_start").alias("__start"),
                         F.monotonically_increasing_id().alias("__seq"))
    splits = tagged.groupBy(F.col("__file").alias("__f"), F.col("__start").alias("__s")).agg(
        F.min("__seq").alias("__first"), F.count(F.lit(1)).alias("__n"))
    splits = cut_lineage(running_offsets(splits, ["__f", "__s"], "__n", "__offset").drop("__n"))
    if splits.count() <= SMALL_SPLITS:  # else a shuffle join
        splits = F.broadcast(splits)
    return (tagged.join(splits, (F.col("__file") == F.col("__f")) & (F.col("__start") == F.col("__s")))
            .withColumn(name, F.col("__offset") + F.col("__seq") - F.col("__first"))
            .drop("__file", "__start", "__seq", "__f", "__s", "__first", "__offset"))


def element_positions(rows: DataFrame, elements: Column, order: Sequence[str], name: str = "position",
                      element: str = "element") -> DataFrame:
    """One row per element of an array column, with its dense position in
    (``order``, place in the array) order; ``order`` is unique per row."""
    sized = rows.withColumn("__elements", elements)
    offsets = running_offsets(sized.select(*order, F.coalesce(F.size("__elements"), F.lit(0)).alias("__n")),
                              order, "__n", "__offset").drop("__n")
    on = [F.col(c).eqNullSafe(F.col(f"__k{i}")) for i, c in enumerate(order)]
    offsets = offsets.withColumnsRenamed({c: f"__k{i}" for i, c in enumerate(order)})
    out = sized.join(offsets, on).select(*rows.columns, "__offset", F.posexplode("__elements").alias("__at", element))
    return out.withColumn(name, F.col("__offset") + F.col("__at")).drop("__offset", "__at")

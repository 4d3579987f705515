"""Scoring a stream of requests.

The batch scorer is row-wise after one stream–static left join against the
feature table, so the same operator runs on a streaming DataFrame: each
micro-batch of request files is joined to the (static, deduplicated)
features and scored; the sink and its checkpoint live in shared storage, so
a restarted query resumes exactly where it stopped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from bidlens.operators import scoring

REQUEST_DDL = "input_row_id string, award_id string, supplier_id string"


def read_request_stream(spark: SparkSession, source_dir: str, fmt: str = "json",
                        max_files_per_trigger: int | None = None) -> DataFrame:
    r = spark.readStream.schema(REQUEST_DDL).format(fmt)
    if fmt == "csv":
        r = r.option("header", True)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source_dir)


def score_request_stream(requests: DataFrame, features: DataFrame, sink_path: str,
                         checkpoint_location: str, graph: DataFrame | None = None,
                         model: scoring.LinearModel | None = None, explain: bool = True,
                         top_k: int = scoring.DEFAULT_TOP_K, available_now: bool = False) -> StreamingQuery:
    """Start the scoring query: append mode into a parquet sink."""
    scored = scoring.score_batch(requests, features, graph=graph, model=model, explain=explain, top_k=top_k)
    w = (scored.writeStream.format("parquet").outputMode("append")
         .option("path", sink_path).option("checkpointLocation", checkpoint_location))
    w = w.trigger(availableNow=True) if available_now else w
    return w.start()

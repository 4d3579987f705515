"""Run log (provenance) and dataset status.

A job appends one record per run to a JSON table partitioned by ``date``;
rollups (request/item counters, latency distribution by endpoint and
status) are ordinary aggregations over that table.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.functions.common import missing_path
from bidlens.sources.requests import text_preview

RUN_LOG_DDL = (
    "request_id string, endpoint string, timestamp_utc string, duration_ms long, client_host string, "
    "payload_preview string, num_items long, features_path string, graph_metrics_path string, "
    "wb_ineligible_path string, ocds_tenders_path string, ocds_awards_path string, status string, "
    "error string, used_model boolean, join_graph boolean, explain boolean, date string"
)

def run_record(spark: SparkSession, endpoint: str, started_at: float, *, status: str = "ok",
               error: str | None = None, num_items: int | None = None, payload=None,
               paths: Mapping[str, str | None] | None = None, client_host: str | None = None,
               used_model: bool | None = None, join_graph: bool | None = None,
               explain: bool | None = None, now: datetime | None = None) -> DataFrame:
    """PRV-01: one-row DataFrame describing a job run.  ``payload`` is JSON
    text, or anything that ``json`` can write; the record shows its start."""
    text = payload if isinstance(payload, str) or payload is None else json.dumps(payload, default=str)
    ts = now or datetime.now(timezone.utc)
    paths = dict(paths or {})
    row = (uuid.uuid4().hex, endpoint, ts.isoformat(), int((ts.timestamp() - started_at) * 1000),
           client_host, text, num_items,
           paths.get("features_path"), paths.get("graph_metrics_path"), paths.get("wb_ineligible_path"),
           paths.get("ocds_tenders_path"), paths.get("ocds_awards_path"), status, error,
           used_model, join_graph, explain, ts.date().isoformat())
    return spark.createDataFrame([row], RUN_LOG_DDL).withColumn("payload_preview", text_preview(F.col("payload_preview")))


def append_run_log(records: DataFrame, path: str) -> bool:
    """SNK-07: put the record of one run into the JSON log, by day.  The
    record's folder is named by its run id and overwritten as a whole, so a
    retried append leaves one record.  Never raises: a logging failure must
    not fail the job (returns False instead)."""
    try:
        run = records.select("date", "request_id").first()
        records.drop("date").coalesce(1).write.mode("overwrite").json(f"{path.rstrip('/')}/date={run['date']}/run={run['request_id']}")
        return True
    except Exception:  # noqa: BLE001 - logging is best-effort by contract
        return False


def read_run_log(spark: SparkSession, path: str) -> DataFrame:
    """One row per run id, also while a day is being compacted."""
    log = spark.read.schema(f"{RUN_LOG_DDL}, run string").json(path).drop("run")
    return log.dropDuplicates(["request_id"])


def compact_run_log(spark: SparkSession, path: str, before: str) -> int:
    """Rewrites each day earlier than ``before`` that has single-run folders
    as one folder (one file), then deletes those.  A compaction that stops
    half-way leaves records twice at most, which readers fold; the next one
    finishes it.  Returns the number of folders deleted."""
    base = path.rstrip("/")
    runs = (spark.read.schema(f"{RUN_LOG_DDL}, run string").json(base).where(F.col("date") < before)
            .select("date", "run").distinct().groupBy("date").agg(F.collect_set("run").alias("runs"))
            .where(F.size("runs") > 1).collect())  # folder names of the days to compact
    gone = 0
    for day in sorted(runs, key=lambda r: str(r["date"])):
        folder, whole = f"{base}/date={day['date']}", f"day-{uuid.uuid4().hex}"
        records = spark.read.schema(RUN_LOG_DDL).json([f"{folder}/run={r}" for r in day["runs"]]).drop("date")
        records.dropDuplicates(["request_id"]).coalesce(1).write.json(f"{folder}/run={whole}")
        for r in day["runs"]:
            p = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/run={r}")
            gone += bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True))
    return gone


SKETCH_K = 400  # rank error of a sketch: under 1 %


def latency_state(log: DataFrame, k: int = SKETCH_K) -> DataFrame:
    """AGG-16 as mergeable daily state: per day, endpoint and status the
    counts and a quantile sketch of the durations (a few KB however many
    runs).  A day is sketched once; ``latency_rollup`` merges any range."""
    return log.groupBy("date", "endpoint", "status").agg(
        F.count(F.lit(1)).alias("requests"), F.coalesce(F.sum("num_items"), F.lit(0)).cast("long").alias("items"),
        F.sum("duration_ms").alias("total_ms"), F.count("duration_ms").alias("timed"), F.max("duration_ms").alias("max_ms"),
        F.kll_sketch_agg_bigint("duration_ms", F.lit(k)).alias("sketch"))


def latency_rollup(state: DataFrame, by: tuple[str, ...] = ("endpoint", "status")) -> DataFrame:
    """Requests, items, mean, maximum and approximate p50, p90, p99 from the
    daily states of any range of days."""
    merged = state.groupBy(*by).agg(
        F.sum("requests").alias("requests"), F.sum("items").cast("long").alias("items"),
        F.try_divide(F.sum("total_ms"), F.sum("timed")).alias("avg_ms"), F.max("max_ms").alias("max_ms"),
        F.kll_merge_agg_bigint(F.when(F.col("timed") > 0, F.col("sketch"))).alias("sketch"))

    def quantile(q):
        return F.when(F.col("max_ms").isNotNull(), F.kll_sketch_get_quantile_bigint("sketch", F.lit(q)))
    return merged.withColumn("p50_p90_p99_ms", F.array(*map(quantile, (0.5, 0.9, 0.99)))).drop("sketch")


def run_rollup(log: DataFrame) -> DataFrame:
    """AGG-16: requests, items and latency per (endpoint, status).  The
    percentiles are exact: whole milliseconds keep the counts per distinct
    value, which is what the aggregate holds, few."""
    return log.groupBy("endpoint", "status").agg(
        F.count(F.lit(1)).alias("requests"),
        F.coalesce(F.sum("num_items"), F.lit(0)).cast("long").alias("items"),
        F.avg("duration_ms").alias("avg_ms"),
        F.max("duration_ms").alias("max_ms"),
        F.percentile("duration_ms", [0.5, 0.9, 0.99]).alias("p50_p90_p99_ms"),
    )


def items_rollup(log: DataFrame) -> DataFrame:
    """AGG-16: scored items per (used_model, join_graph, explain)."""
    return log.groupBy("used_model", "join_graph", "explain").agg(
        F.coalesce(F.sum("num_items"), F.lit(0)).cast("long").alias("items"))


def dataset_status(spark: SparkSession, paths: Mapping[str, str | None]) -> DataFrame:
    """SRC-15: (dataset, path, rows, available) per named parquet path.

    The counts run on the v2 parquet reader with aggregate push-down, so
    ``count()`` is answered from the file footers and no data pages are
    read.  The reader setting is made in a session of its own, so that other
    jobs of the caller's session don't see it.  A missing path is
    unavailable; other storage errors are raised."""
    own = spark.newSession()
    own.conf.set("spark.sql.sources.useV1SourceList", ",".join(
        x for x in spark.conf.get("spark.sql.sources.useV1SourceList").split(",") if x.strip().lower() != "parquet"))
    own.conf.set("spark.sql.parquet.aggregatePushdown", "true")
    rows = []
    for name, p in paths.items():
        n = None
        if p:
            try:
                n = own.read.parquet(p).count()
            except AnalysisException as e:
                if not missing_path(e):
                    raise
        rows.append((name, p, n, n is not None))
    return spark.createDataFrame(rows, "dataset string, path string, rows long, available boolean")

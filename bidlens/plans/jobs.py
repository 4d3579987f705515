"""End-to-end jobs: read landed inputs, run the operators, write curated
tables.  Each job is a function of paths; all heavy work stays in Spark.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.functions.common import missing_path
from bidlens.operators import evaluate as ev
from bidlens.operators import features as feat
from bidlens.operators import graph as gr
from bidlens.operators import model as mdl
from bidlens.operators import runlog as rl
from bidlens.operators import scoring
from bidlens.operators.positions import element_positions, file_positions
from bidlens.plans.lookups import publish_lookup, requested
from bidlens.plans.snapshots import high_water, publish, read_published, remove, upsert
from bidlens.session import stored
from bidlens.sources import ocds
from bidlens.sources import projects as prj
from bidlens.sources import requests as rq
from bidlens.sources import sanctions as sanc


def _stamp() -> str:
    return datetime.now(timezone.utc).strftime("%Y%m%dT%H%M%SZ")


def read_parquet_or_empty(spark: SparkSession, path: str | None, ddl: str) -> DataFrame:
    """SRC-06: a missing path reads as an empty frame of ``ddl``."""
    if path:
        try:
            return read_published(spark, path)
        except AnalysisException as e:
            if not missing_path(e):
                raise
    return spark.createDataFrame([], ddl)


def read_features_any(spark: SparkSession, path: str) -> DataFrame:
    """SRC-07: parquet, or CSV with header by suffix (CSV is read with the
    feature schema, not inferred)."""
    if path.lower().endswith(".csv"):
        ddl = ", ".join(f"{n} {t}" for n, t in feat.FEATURES_SCHEMA)
        return spark.read.option("header", True).schema(ddl).csv(path)
    return read_published(spark, path)


def with_file_order(df: DataFrame, name: str = "__file_order") -> DataFrame:
    """Input order of rows read from files: (file path, row index in file)."""
    return df.withColumn(name, F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")))


def ingest_releases(spark: SparkSession, in_path: str, out_dir: str, take: int | None = None,
                    jsonl: bool | None = None) -> dict:
    """OCDS files → tenders / awards / suppliers tables + counts snapshot
    (SNK-01, SNK-06).  Each table is a new version, committed when it is
    whole.  Corrupt documents go to ``_quarantine``."""
    out = out_dir.rstrip("/")
    parsed = f"{out}/_parsed_{uuid.uuid4().hex}"  # read by every table, removed at the end
    rel = stored(ocds.read_releases(spark, in_path, jsonl=jsonl, take=take), parsed)
    t, a, s = ocds.tenders(rel), ocds.awards(rel), ocds.suppliers(rel)
    made = [publish(df, f"{out}/{name}.parquet") for df, name in ((t, "tenders"), (a, "awards"), (s, "suppliers"))]
    rel.filter(F.col("_corrupt_record").isNotNull()).select("release_pos", "_corrupt_record") \
        .write.mode("overwrite").parquet(f"{out}/_quarantine")
    remove(spark, parsed)
    counts = ocds.release_counts(*map(spark.read.parquet, made), _stamp())
    counts.coalesce(1).write.mode("overwrite").json(f"{out}/_counts_{_stamp()}")
    return counts.first().asDict()


def ingest_sanctions(spark: SparkSession, sheet_path: str, out_dir: str, source_url: str,
                     fmt: str = "csv", sep: str = ",") -> str:
    """Sanctions sheet → raw JSON snapshot + curated parquet (SNK-04)."""
    sheet = sanc.read_sheet(spark, sheet_path, fmt, sep)
    out = out_dir.rstrip("/")
    ts = _stamp()
    sheet.drop(sanc.ROW_ORDER).write.mode("overwrite").json(f"{out}/raw/ineligible_{ts}")
    norm = sanc.normalize_sanctions(sheet, source_url)
    return publish(norm, f"{out}/ineligible.parquet")


def ingest_projects(spark: SparkSession, pages_path: str, out_dir: str) -> str:
    """Landed project pages → JSONL snapshot + parquet (SNK-05)."""
    recs = prj.read_project_pages(spark, pages_path)
    out = out_dir.rstrip("/")
    recs.select("record").write.mode("overwrite").text(f"{out}/raw/projects_{_stamp()}")
    return publish(prj.normalize_projects(recs), f"{out}/projects.parquet")


def pull_projects(spark: SparkSession, pages_path: str, table: str, buckets: int = 64) -> dict:
    """SRC-14 incrementally: the records of a pull that are not older than the
    table's high-water mark (``p2a_updated_date``; records without a date
    always count) go into a keyed table, of which only the hash buckets with
    changes are rewritten.  Pulls in any number give the table of one full
    pull."""
    mark = high_water(spark, table)
    recs = prj.normalize_projects(prj.read_project_pages(spark, pages_path))
    if mark is not None:
        recs = recs.where(F.col("p2a_updated_date").isNull() | (F.col("p2a_updated_date") >= mark))
    return upsert(recs, table, "id", "p2a_updated_date", buckets)


def features_job(spark: SparkSession, tenders_path: str, awards_path: str, out_path: str,
                 dedupe_tenders: bool = False, buckets: int | None = None) -> str:
    """Curated tenders + awards → feature table (SNK-02), a new version; its
    folder.  The award input order is the file order (path, row index).
    ``buckets`` stores it by hash bucket of the award id, sorted, so that batch
    scoring reads the buckets of its requests only."""
    t = with_file_order(read_published(spark, tenders_path), "__tender_pos")
    a = with_file_order(read_published(spark, awards_path))
    f = feat.build_features(t, a, order_key=["__file_order"], dedupe_tenders=dedupe_tenders)
    return publish_lookup(f, out_path, "award_id", buckets) if buckets else publish(f, out_path)


def graph_job(spark: SparkSession, tenders_path: str, awards_path: str, sanctions_path: str | None,
              out_dir: str, ego_supplier_id: str | None = None, with_betweenness: bool = False,
              pivots: int | None = None) -> str:
    """Graph metrics parquet without ``node`` (SNK-03); optional ego edges.
    Betweenness is asked for by the caller: exact it costs vertices x edges,
    with ``pivots`` it is an estimate."""
    t, a = read_published(spark, tenders_path), read_published(spark, awards_path)
    s = read_parquet_or_empty(spark, sanctions_path, "name string, normalized_name string") \
        if sanctions_path else None
    m = gr.graph_metrics(t, a, s, with_betweenness=with_betweenness, pivots=pivots)
    out = out_dir.rstrip("/")
    metrics = publish(m.drop("node"), f"{out}/graph/metrics.parquet")
    if ego_supplier_id:
        _, e = gr.bipartite_graph(t, a)
        gr.ego_edges(e, ego_supplier_id).write.mode("overwrite").parquet(
            f"{out}/graph/ego_{ego_supplier_id}.parquet")
    return metrics


def train_job(spark: SparkSession, features_path: str, model_dir: str,
              feature_cols: Sequence[str] | None = None, calibrate: bool = False) -> dict:
    """Fit → thresholds → (calibrate) → evaluate → save model and meta with
    ``last_evaluation`` (MOD-07, SNK-09).  The table is read by column for each
    of these; what a fit passes over many times it holds itself."""
    f = read_features_any(spark, features_path)
    lm = mdl.fit(f, feature_cols)
    extra = {}
    if calibrate:
        try:
            lm = mdl.calibrate(f, lm)
        except Exception as e:  # noqa: BLE001 - calibration is optional
            extra["calibration_error"] = str(e)
    scored = mdl.proxy_label(f).withColumn("p", lm.probability())
    metrics = ev.metrics(scored, "label", "p", order="award_id").first().asDict()
    extra["last_evaluation"] = metrics
    return mdl.save_model(spark, lm, model_dir, extra)


def evaluate_job(spark: SparkSession, features_path: str, model_dir: str, out_dir: str) -> str:
    """Evaluate a saved model (fit one when none exists) → timestamped
    metrics JSON (EVL-01, SNK-08)."""
    f = read_features_any(spark, features_path)
    lm = mdl.load_model(spark, model_dir)
    if lm is None:
        lm = mdl.fit(f)
    scored = mdl.proxy_label(f).withColumn("p", lm.probability())
    m = ev.metrics(scored, "label", "p", order="award_id")
    m = m.withColumn("feature_cols", F.array(*[F.lit(c) for c in lm.feature_cols]))
    path = f"{out_dir.rstrip('/')}/baseline_metrics_{_stamp()}"
    m.coalesce(1).write.mode("overwrite").json(path)
    return path


def latest_metrics(spark: SparkSession, metrics_dir: str) -> DataFrame:
    """SRC-16: the lexicographically last ``baseline_metrics_*`` artifact."""
    m = spark.read.json(f"{metrics_dir.rstrip('/')}/baseline_metrics_*").withColumn(
        "__f", F.col("_metadata.file_path"))
    return m.agg(F.max_by(F.struct(*[c for c in m.columns if c != "__f"]), "__f").alias("m")).select("m.*")


def read_requests(spark: SparkSession, path: str, max_items: int | None = None) -> DataFrame:
    """SRC-08/19: request files → (input_row_id, award_id, supplier_id).
    CSV tables by suffix; anything else is JSON payloads, one per file (a
    list or an ``items`` envelope).  Row ids are dense and follow file path and
    place in the file, unless a table brings its own; ``max_items`` keeps the
    first ones (FLT-10)."""
    if path.lower().split("?")[0].endswith((".csv", ".csv.gz", ".tsv")):
        sep = "\t" if path.lower().endswith(".tsv") else ","
        table = spark.read.option("header", True).option("inferSchema", False).option("sep", sep).csv(path)
        if any(c.strip().lower().replace(" ", "_") == "input_row_id" for c in table.columns):
            return rq.first_requests(rq.coerce_award_rows(table), max_items)  # the table brings its ids
        rows = rq.coerce_award_rows(file_positions(table, "input_row_id"))
    else:
        text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
        rows = element_positions(text, rq.payload_items(F.col("value")), ["file"], "input_row_id", "item").select(
            "input_row_id", *rq.item_fields(F.col("item")))
    return rows if max_items is None else rows.where(F.col("input_row_id") < int(max_items))


def _requests(spark: SparkSession, requests: DataFrame | str, max_items: int | None) -> DataFrame:
    return read_requests(spark, requests, max_items) if isinstance(requests, str) else rq.first_requests(requests, max_items)


@contextmanager
def _logged(spark: SparkSession, run_log_path: str | None, endpoint: str, **fields):
    """One run-log record per job run: the caller fills in what it learns;
    a failure is logged with status ``error`` and raised again."""
    started, learned = time.time(), {}
    try:
        yield learned
    except Exception as e:
        if run_log_path:
            rl.append_run_log(rl.run_record(spark, endpoint, started, status="error",
                                            error=f"{type(e).__name__}: {str(e)[:500]}", **{**fields, **learned}), run_log_path)
        raise
    if run_log_path:
        rl.append_run_log(rl.run_record(spark, endpoint, started, **{**fields, **learned}), run_log_path)


def _features_or_empty(spark: SparkSession, path: str) -> DataFrame:
    return read_parquet_or_empty(spark, path, ", ".join(f"{n} {t}" for n, t in feat.FEATURES_SCHEMA))


def batch_job(spark: SparkSession, requests: DataFrame | str, features_path: str, out_path: str,
              graph_path: str | None = None, model_dir: str | None = None, explain: bool = True,
              top_k: int = scoring.DEFAULT_TOP_K, run_log_path: str | None = None,
              unique_features: bool = False, max_items: int | None = None) -> DataFrame:
    """Batch scoring (SCR-08) over a request table or request files →
    parquet, ordered by input row; one run-log record, also of a failure.
    ``unique_features``: the tables are the feature and graph jobs' own;
    ``max_items``: only the first requests (FLT-10)."""
    paths = {"features_path": features_path, "graph_metrics_path": graph_path}
    with _logged(spark, run_log_path, "/v1/score/batch", paths=paths, join_graph=graph_path is not None,
                 explain=explain) as log:
        model = mdl.load_model(spark, model_dir) if model_dir else None
        log["used_model"] = model is not None
        graph = read_parquet_or_empty(spark, graph_path, "supplier_id string") if graph_path else None
        asked = _requests(spark, requests, max_items)
        out = scoring.score_batch(asked, requested(_features_or_empty(spark, features_path), asked), graph=graph,
                                  model=model, explain=explain, top_k=top_k, dedupe_features=not unique_features)
        out.orderBy("input_row_id").write.mode("overwrite").parquet(out_path)
        written = spark.read.parquet(out_path)
        if run_log_path:
            log["num_items"] = written.count()
    return written


def validate_job(spark: SparkSession, requests: DataFrame | str, features_path: str, out_path: str,
                 run_log_path: str | None = None, max_items: int | None = None) -> DataFrame:
    """Validate-only run (FLT-05/09): input_row_id, award_id, supplier_id,
    valid, error → parquet, ordered by input row, with a run-log record."""
    with _logged(spark, run_log_path, "/v1/validate/batch", paths={"features_path": features_path}) as log:
        asked = _requests(spark, requests, max_items)
        out = scoring.validate_batch(asked, requested(_features_or_empty(spark, features_path), asked))
        out.orderBy("input_row_id").write.mode("overwrite").parquet(out_path)
        written = spark.read.parquet(out_path)
        if run_log_path:
            log["num_items"] = written.count()
    return written


def record_score_job(spark: SparkSession, records: DataFrame, out_path: str,
                     run_log_path: str | None = None) -> DataFrame:
    """Record-level scores (SCR-07) of a table with amount,
    past_awards_count, is_sanctioned and adverse_media_count → parquet.
    Rows whose inputs are out of range (FLT-07) carry the error and no score."""
    with _logged(spark, run_log_path, "/v1/score") as log:
        out = scoring.record_level_score(scoring.record_input_errors(records))
        out = out.withColumn("risk_score", F.when(F.col("error").isNull(), F.col("risk_score")))
        out.write.mode("overwrite").parquet(out_path)
        written = spark.read.parquet(out_path)
        if run_log_path:
            log["num_items"] = written.count()
    return written


def model_info(spark: SparkSession, model_dir: str, metrics_dir: str | None = None, n: int = 10) -> dict:
    """MOD-06: availability, meta, top weights by |coefficient| and the
    latest evaluation artifact (small driver-side dict)."""
    lm = mdl.load_model(spark, model_dir)
    info: dict = {"available": lm is not None}
    if lm is None:
        return info
    info["feature_cols"] = lm.feature_cols
    info["risk_band_thresholds"] = lm.thresholds
    info["calibrated"] = lm.calibration is not None
    info["top_weights"] = [r.asDict() for r in mdl.top_weights(spark, lm, n=n).collect()]
    if metrics_dir:
        try:
            info["latest_evaluation"] = latest_metrics(spark, metrics_dir).first().asDict(recursive=True)
        except AnalysisException as e:
            if not missing_path(e):
                raise
            info["latest_evaluation"] = None
    return info

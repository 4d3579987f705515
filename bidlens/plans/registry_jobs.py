"""Registered round trips: jobs write to the shared checkpoint folder, readers
read back, and the rows are checked against SQL over the base tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.functions.dates import parse_timestamp
from bidlens.operators import runlog as rl
from bidlens.operators import scoring
from bidlens.plans import adapters as ad
from bidlens.plans import jobs
from bidlens.plans import oracle as O
from bidlens.plans import registry as R
from bidlens.plans import snapshots as sn
from bidlens.plans.lookups import requested
from bidlens.plans.registry import SQL, register, rounded
from bidlens.session import checkpoint_dir
from bidlens.sources import ocds
from bidlens.sources import pages as pg
from bidlens.sources import projects as prj
from bidlens.sources.requests import text_preview


def scratch(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def ranged_session(spark: SparkSession, split_bytes: str) -> SparkSession:
    """A session that reads files in small splits, so that small test files
    are cut like large ones."""
    own = spark.newSession()
    own.conf.set("spark.sql.session.timeZone", "UTC")
    own.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    return own


# --------------------------------------------------------------- request order

FILE_ROWS = 1_000_000  # rows of a written table that one file (and the task that sorts it) gets
PACKAGE_ROWS = 250_000  # releases of a package, from which there are more packages
PACKAGES_AT_ONCE = 16  # packages whose text is on disk at a time
PAYLOADS = 2_000  # payload files, from which a payload gets more than 500 orders


def _grown(rows: DataFrame, least: int, per: int) -> int:
    """``least``, or more where the table has more than ``least * per`` rows
    (its count is in the Parquet footers)."""
    return max(least, -(-rows.count() // per))


REQUEST_ROWS = """
SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS award_id, CAST(l_suppkey AS VARCHAR) AS supplier_id,
       ROW_NUMBER() OVER (ORDER BY l_orderkey // 500, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) - 1
       AS input_row_id FROM lineitem"""


def _request_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = ad.table(spark, sf_dir, "lineitem")
    return li.select(F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("award_id"),
                     F.col("l_suppkey").cast("string").alias("supplier_id"), *ad.AWARD_ORDER)


@register("requests_csv_order", REQUEST_ROWS)
def q_requests_csv_order(spark, sf_dir):
    """Uploaded tables in several files and many splits: ids follow file and line."""
    path = scratch(spark, "requests")
    files = _grown(ad.table(spark, sf_dir, "lineitem"), 7, FILE_ROWS)
    _request_rows(spark, sf_dir).repartitionByRange(files, *ad.AWARD_ORDER).sortWithinPartitions(*ad.AWARD_ORDER).select(
        F.col("award_id").alias("Award ID"), F.col("supplier_id").alias("Supplier ID")).write.option("header", True).csv(path)
    # 64 KiB splits, or 2,000 splits of about 20 bytes a row
    split = 64 * _grown(ad.table(spark, sf_dir, "lineitem"), 1, 2000 * 3000)
    return jobs.read_requests(ranged_session(spark, f"{split}k"), f"{path}/*.csv")


@register("requests_json_order", REQUEST_ROWS)
def q_requests_json_order(spark, sf_dir):
    """One payload per 500 orders (10,000 at most, where there are more than
    ``PAYLOADS`` files), lists and envelopes in turn; file names in order."""
    path = scratch(spark, "payloads")
    orders = 500 * min(20, _grown(ad.table(spark, sf_dir, "orders"), 1, 500 * PAYLOADS))
    rows = _request_rows(spark, sf_dir).withColumn("bucket", F.floor(F.col("l_orderkey") / orders).cast("int"))
    item = F.struct(F.struct(*ad.AWARD_ORDER).alias("o"), F.to_json(F.struct("award_id", "supplier_id")).alias("j"))
    items = F.concat(F.lit("["), F.array_join(F.transform(F.array_sort(F.collect_list(item)), lambda x: x["j"]), ", "), F.lit("]"))
    text = rows.groupBy("bucket").agg(items.alias("items")).select(
        F.format_string("b%08d", "bucket").alias("part"),
        F.when(F.col("bucket") % 2 == 0, F.col("items")).otherwise(F.concat(F.lit('{"items": '), F.col("items"), F.lit("}"))).alias("value"))
    text.write.partitionBy("part").text(path)
    return jobs.read_requests(spark, path)


@register("requests_capped", f"""
WITH r AS ({REQUEST_ROWS}), f AS (SELECT DISTINCT award_id FROM r)
SELECT input_row_id, award_id, CAST(true AS BOOLEAN) AS valid FROM r WHERE input_row_id < 1000""")
def q_requests_capped(spark, sf_dir):
    """The first 1,000 requests of a folder of tables, through the validate job."""
    path = scratch(spark, "requests")
    files = _grown(ad.table(spark, sf_dir, "lineitem"), 7, FILE_ROWS)
    _request_rows(spark, sf_dir).repartitionByRange(files, *ad.AWARD_ORDER).sortWithinPartitions(*ad.AWARD_ORDER).select(
        "award_id", "supplier_id").write.option("header", True).csv(f"{path}/in")
    R.features_df(spark, sf_dir).write.parquet(f"{path}/features")
    out = jobs.validate_job(spark, f"{path}/in/*.csv", f"{path}/features", f"{path}/out", max_items=1000)
    return out.select("input_row_id", "award_id", "valid")


# --------------------------------------------------------------- large documents

@register("releases_ranged", SQL["awards"])
def q_releases_ranged(spark, sf_dir):
    """Packages of many releases, read in byte ranges of 256 KiB, or 2,000 of
    about 360 releases each where there are more.  The rows are dealt and
    sorted while they are narrow; a package's task makes their text.  All are
    landed and read, ``PACKAGES_AT_ONCE`` at a time, as their text takes thirty
    times the bytes of the tables."""
    path = scratch(spark, "packages")
    li = ad.table(spark, sf_dir, "lineitem")
    packages = _grown(li, 8, PACKAGE_ROWS)
    own = ranged_session(spark, f"{256 * _grown(li, 1, 2000 * 360)}k")
    package = F.pmod("l_orderkey", F.lit(packages))
    line = (F.when(F.col("k") == 0, F.lit('{"uri": "http://x/{id}", "links": [{"a": 1}], "releases": [null'))
            .when(F.col("k") == 2, F.lit('], "meta": {"releases": [{"ocid": "none"}]}}'))
            .otherwise(F.concat(F.lit(", "), ad.release_text())))
    for begin in range(0, packages, PACKAGES_AT_ONCE):
        now = F.coalesce(package, F.lit(0)).between(begin, begin + PACKAGES_AT_ONCE - 1)
        ends = li.where(now).select(package.alias("package")).distinct()
        rows = ad.release_rows(spark, sf_dir).where(now).select("*", package.alias("package"), F.lit(1).alias("k"))
        for k in (0, 2):
            rows = rows.unionByName(ends.select("package", F.lit(k).alias("k")), allowMissingColumns=True)
        rows.repartition(min(packages, 2 * PACKAGES_AT_ONCE), "package").sortWithinPartitions("package", "k").select(
            "package", line.alias("value")).write.partitionBy("package").text(f"{path}/in-{begin}")
        found = ocds.awards(ocds.read_releases(own, f"{path}/in-{begin}", jsonl=False, split_above=1))
        found.write.mode("append").option("compression", "zstd").parquet(f"{path}/awards")
        sn.remove(spark, f"{path}/in-{begin}")
    return rounded(spark.read.schema(found.schema).parquet(f"{path}/awards"))


# --------------------------------------------------------------- incremental pulls, published tables

def _project_pull(spark, sf_dir, path: str, later: bool) -> None:
    """The project pages as landed files: the first pull has all projects, the
    second every seventh again, renamed and dated ten days on."""
    recs = prj.page_records(ad.project_pages(spark, sf_dir), "value", None)
    m = F.from_json("record", "map<string,string>")
    recs = recs.select("project_key", m.alias("m"))
    if later:
        recs = recs.where(F.pmod(F.col("project_key").cast("long"), F.lit(7)) == 0)
        changed = F.create_map(
            F.lit("project_name"), F.concat(F.col("m")["project_name"], F.lit(" again")), F.lit("p2a_updated_date"),
            F.date_format(F.col("m")["p2a_updated_date"].cast("timestamp") + F.expr("INTERVAL 3650 DAYS"), "yyyy-MM-dd HH:mm:ss"))
        recs = recs.select("project_key", F.map_concat(F.map_filter("m", lambda k, v: ~k.isin("project_name", "p2a_updated_date")), changed).alias("m"))
    page = F.pmod(F.xxhash64("project_key"), F.lit(40))
    pages = recs.groupBy(page.alias("page")).agg(F.map_from_entries(F.collect_list(F.struct("project_key", "m"))).alias("projects"))
    pages.select("page", F.to_json(F.struct("projects")).alias("value")).write.partitionBy("page").text(path)


@register("projects_incremental", SQL["projects"])
def q_projects_incremental(spark, sf_dir):
    """A pull of all projects into a keyed table, read back."""
    path = scratch(spark, "pulls")
    _project_pull(spark, sf_dir, f"{path}/p1", False)
    jobs.pull_projects(spark, f"{path}/p1", f"{path}/t")
    return sn.read_published(spark, f"{path}/t")


@register("projects_two_pulls", f"""
WITH p AS ({SQL["projects"]})
SELECT id, CASE WHEN CAST(substr(id, 2) AS BIGINT) % 7 = 0 THEN project_name || ' again' ELSE project_name END AS project_name,
       CASE WHEN CAST(substr(id, 2) AS BIGINT) % 7 = 0
            THEN strftime(strptime(p2a_updated_date, '%Y-%m-%d %H:%M:%S') + INTERVAL 3650 DAY, '%Y-%m-%d %H:%M:%S')
            ELSE p2a_updated_date END AS p2a_updated_date FROM p""")
def q_projects_two_pulls(spark, sf_dir):
    """Two pulls give the table of one full pull: the newest record per project."""
    path = scratch(spark, "pulls")
    for k, later in enumerate((False, True)):
        _project_pull(spark, sf_dir, f"{path}/p{k}", later)
        jobs.pull_projects(spark, f"{path}/p{k}", f"{path}/t")
    return sn.read_published(spark, f"{path}/t").select("id", "project_name", "p2a_updated_date")


@register("ingest_published", SQL["awards"])
def q_ingest_published(spark, sf_dir):
    """Releases as JSON Lines through the ingest job, twice; the awards of the
    current version (SNK-01)."""
    path = scratch(spark, "ingest")
    ad.releases_json(spark, sf_dir).select("value").write.option("compression", "gzip").text(f"{path}/in")
    for _ in range(2):
        jobs.ingest_releases(spark, f"{path}/in", f"{path}/out", jsonl=True)
    return rounded(sn.read_published(spark, f"{path}/out/awards.parquet"))


@register("ingest_counts", f"""
SELECT (SELECT COUNT(*) FROM ({SQL["tenders"]})) AS tenders, (SELECT COUNT(*) FROM ({SQL["awards"]})) AS awards,
       (SELECT COUNT(*) FROM ({SQL["suppliers"]})) AS suppliers""")
def q_ingest_counts(spark, sf_dir):
    """The counts snapshot that the ingest job leaves (SNK-06)."""
    path = scratch(spark, "counts")
    ad.releases_json(spark, sf_dir).select("value").write.option("compression", "gzip").text(f"{path}/in")
    jobs.ingest_releases(spark, f"{path}/in", f"{path}/out", jsonl=True)
    return spark.read.json(f"{path}/out/_counts_*").select("tenders", "awards", "suppliers")


@register("features_bucketed", SQL["award_features"])
def q_features_bucketed(spark, sf_dir):
    """The feature job into 32 buckets, asked for by all award ids (SNK-02, JOIN-05)."""
    path = scratch(spark, "features")
    sn.publish(ad.tenders(spark, sf_dir).sort("__tender_pos").drop("__tender_pos"), f"{path}/t")
    sn.publish(ad.awards(spark, sf_dir, keep_order=False, sort=True), f"{path}/a")
    jobs.features_job(spark, f"{path}/t", f"{path}/a", f"{path}/f", buckets=32)
    table = sn.read_published(spark, f"{path}/f")
    return rounded(requested(table, ad.awards(spark, sf_dir).select("award_id")))


# --------------------------------------------------------------- run log, model artifacts

@register("runlog_daily", """
WITH r AS (SELECT '/v1/' || event_type AS endpoint, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
                  CAST(round(value * 10) AS BIGINT) AS ms, CAST(json_extract_string(props, '$.k') AS BIGINT) AS items FROM events)
SELECT endpoint, status, COUNT(*) AS requests, CAST(COALESCE(SUM(items), 0) AS BIGINT) AS items, ROUND(AVG(ms), 6) AS avg_ms,
       MAX(ms) AS max_ms, true AS p50_close, true AS p90_close, true AS p99_close FROM r GROUP BY 1, 2""")
def q_runlog_daily(spark, sf_dir):
    """Daily latency sketches merged over all days; a percentile is close if the
    share of durations up to it is within 2 % of what it stands for (or the
    share below it, among equal durations)."""
    log = ad.run_log(spark, sf_dir)
    path = scratch(spark, "latency")
    rl.latency_state(log).write.partitionBy("date").parquet(path)
    roll = rl.latency_rollup(spark.read.parquet(path))
    q = roll.select(F.col("endpoint").alias("e"), F.col("status").alias("s"), "p50_p90_p99_ms")
    ranks = log.join(q, (F.col("endpoint") == F.col("e")) & (F.col("status") == F.col("s"))).groupBy("e", "s")

    def close(i, share):
        v = F.col("p50_p90_p99_ms")[i]
        below, upto = F.avg((F.col("duration_ms") < v).cast("double")), F.avg((F.col("duration_ms") <= v).cast("double"))
        return ((below <= share + 0.02) & (upto >= share - 0.02)).alias(f"p{int(share * 100)}_close")

    near = ranks.agg(close(0, 0.5), close(1, 0.9), close(2, 0.99))
    out = roll.join(near, (F.col("endpoint") == F.col("e")) & (F.col("status") == F.col("s")))
    return rounded(out.drop("e", "s", "p50_p90_p99_ms"))


@register("runlog_records", """
SELECT '/v1/' || event_type AS endpoint, COUNT(*) AS runs, CAST(SUM(length(props)) AS BIGINT) AS preview_chars
FROM events GROUP BY 1""")
def q_runlog_records(spark, sf_dir):
    """Run records with their payload previews, written by day, read once each
    (SNK-07, PRJ-21)."""
    e = ad.table(spark, sf_dir, "events")
    path = scratch(spark, "log")
    rows = e.select(F.col("event_id").cast("string").alias("request_id"), F.concat(F.lit("/v1/"), "event_type").alias("endpoint"),
                    text_preview(F.col("props")).alias("payload_preview"), F.date_format("ts", "yyyy-MM-dd").alias("date"))
    rows = rows.withColumn("run", F.lit("day"))
    rows.unionByName(rows.where(F.col("request_id").cast("long") % 3 == 0).withColumn("run", F.lit("retry"))).write.partitionBy(
        "date", "run").json(path)
    log = rl.read_run_log(spark, path)
    return log.groupBy("endpoint").agg(F.count(F.lit(1)).alias("runs"), F.sum(F.length("payload_preview")).alias("preview_chars"))


@register("model_artifacts", SQL["fit_logreg"])
def q_model_artifacts(spark, sf_dir):
    """Train job → saved model → model info: the top weights (MOD-05/06, SNK-09)."""
    path = scratch(spark, "model")
    R.features_df(spark, sf_dir).write.parquet(f"{path}/features")
    jobs.train_job(spark, f"{path}/features", f"{path}/model")
    info = jobs.model_info(spark, f"{path}/model")
    rows = spark.createDataFrame([(w["feature"], w["weight"]) for w in info["top_weights"]], "feature string, weight double")
    return rounded(rows, 3)


@register("train_evaluation", "WITH " + O.FEATURE_ROWS_CTE + f"""
SELECT COUNT(*) AS n, ROUND(AVG({R.PROXY_SQL}), 6) AS pos_rate FROM features_x""")
def q_train_evaluation(spark, sf_dir):
    """Train, evaluate and read the latest metrics artifact (MOD-07, SNK-08, SRC-16)."""
    path = scratch(spark, "metrics")
    R.features_df(spark, sf_dir).write.parquet(f"{path}/features")
    jobs.train_job(spark, f"{path}/features", f"{path}/model", calibrate=True)
    jobs.evaluate_job(spark, f"{path}/features", f"{path}/model", f"{path}/out")
    return rounded(jobs.latest_metrics(spark, f"{path}/out").select("n", "pos_rate"))


@register("text_dates", """
SELECT o_orderkey % 4 AS layout, CAST(SUM(datediff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE))) AS BIGINT) AS days,
       COUNT(*) AS n FROM orders GROUP BY 1""")
def q_text_dates(spark, sf_dir):
    """Order dates written in four layouts, parsed back (FN-06)."""
    o = ad.table(spark, sf_dir, "orders")
    d, k = F.col("o_orderdate").cast("timestamp"), F.col("o_orderkey") % 4
    text = (F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
            .when(k == 2, F.date_format(d, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ssXXX")))
    rows = o.select(k.alias("layout"), text.alias("t"))
    return rows.select("layout", F.datediff(parse_timestamp(rows, "t").cast("date"), F.lit("1970-01-01").cast("date")).alias("d")).groupBy(
        "layout").agg(F.sum("d").alias("days"), F.count("d").alias("n"))


@register("record_inputs", """
SELECT CASE WHEN l_quantity < 10 THEN 'amount must be >= 0' WHEN l_linenumber = 2 THEN 'past_awards_count must be >= 0' END AS error,
       COUNT(*) AS n FROM lineitem GROUP BY 1""")
def q_record_inputs(spark, sf_dir):
    """Range checks of record-score inputs (FLT-07)."""
    li = ad.table(spark, sf_dir, "lineitem")
    rec = li.select(F.when(F.col("l_quantity") < 10, -F.col("l_extendedprice")).otherwise(F.col("l_extendedprice")).alias("amount"),
                    F.when((F.col("l_linenumber") == 2) & (F.col("l_quantity") >= 10), F.lit(-1)).otherwise(F.lit(3)).alias("past_awards_count"),
                    F.lit(False).alias("is_sanctioned"), F.lit(0).alias("adverse_media_count"))
    return scoring.record_input_errors(rec).groupBy("error").agg(F.count(F.lit(1)).alias("n"))


# --------------------------------------------------------------- nested tables

@register("nested_tables", """
WITH s AS (SELECT s_nationkey, s_name, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i FROM supplier),
h AS (SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT s_nationkey FROM supplier))
SELECT n_nationkey AS page_id, 0 AS table_no, 0 AS row_no, c AS col_no, 'Firms & names of ' || n_name AS text
FROM h, (SELECT unnest([0, 1, 2]) AS c)
UNION ALL SELECT s_nationkey, 0, i, 0, s_name FROM s
UNION ALL SELECT s_nationkey, 0, i, 1, '' FROM s
UNION ALL SELECT s_nationkey, 0, i, 2, 'all' FROM s
UNION ALL SELECT s_nationkey, i, 0, 0, CAST(s_suppkey AS VARCHAR) FROM s""")
def q_nested_tables(spark, sf_dir):
    """A page per nation: a table of its suppliers with a spanning header, a
    column that one cell spans, unclosed cells and a nested table per row."""
    s = ad.table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", "s_name")
    n = ad.table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    rows = s.groupBy("s_nationkey").agg(F.array_sort(F.collect_list(F.struct("s_suppkey", "s_name"))).alias("s"))

    def row(x, i):
        return F.concat(F.lit("<tr><td> "), x["s_name"], F.lit("<td><TABLE><tr><td>"), x["s_suppkey"].cast("string"), F.lit("</td></TABLE>"),
                        F.when(i == 0, F.concat(F.lit("<td rowspan='"), F.size("s").cast("string"), F.lit("'>all</td>"))).otherwise(F.lit("")))
    page = F.concat(F.lit("<p>x</p><table><tr><th colspan=3>Firms &amp; names&nbsp;of "), F.col("n_name"), F.lit("</th></tr>"),
                    F.array_join(F.transform("s", row), "</tr>\n"), F.lit("</table>"))
    pages = rows.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(
        F.col("s_nationkey").alias("page_id"), F.lit("u").alias("url"), page.alias("html"))
    return pg.table_grid(pages)

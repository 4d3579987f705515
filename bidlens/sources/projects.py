"""Project records (search-API pages) → the 11-column ``projects`` table.

A landed page is ``{"projects": {"P…": {…}, …}, "total": N}``; the map of
records is exploded and each record is read as ``map<string,string>``
(nested values keep their JSON text), so list-valued fields can be reduced
to their first element with a second ``from_json``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kept project fields, in output order.
FIELDS = [
    "id",
    "project_name",
    "regionname",
    "countryshortname",
    "countrycode",
    "projectstatusdisplay",
    "totalcommamt",
    "totalamt",
    "approvalfy",
    "board_approval_month",
    "p2a_updated_date",
]
# Fields that arrive as one-element lists.
LIST_FIELDS = ["countryshortname", "countrycode", "source"]

PAGE_DDL = "projects map<string,string>, total long"


def page_records(pages: DataFrame, text_col: str = "value", offset_col: str | None = "offset",
                 stop_at_empty: bool = False, run_col: str | None = None) -> DataFrame:
    """SRC-14: one row per project record (``record`` = JSON text).

    All landed pages count.  ``stop_at_empty`` reproduces a pull that stops
    at its first empty page: per run (``run_col``; all pages are one run
    without it), pages at or after the smallest empty offset are dropped.
    Pages without an offset are always kept."""
    p = pages.select("*", F.from_json(F.col(text_col), PAGE_DDL).alias("__page"))
    if stop_at_empty and offset_col and offset_col in pages.columns:
        run = F.col(run_col) if run_col else F.lit(0)
        empty = F.get_json_object(text_col, "$.projects").isin("{}", "[]") | F.get_json_object(
            text_col, "$.projects").isNull()
        stops = (pages.filter(empty & F.col(offset_col).isNotNull()).groupBy(run.alias("__run"))
                 .agg(F.min(offset_col).alias("__stop")))
        p = (p.join(stops, run.eqNullSafe(F.col("__run")), "left")
             .filter(F.col("__stop").isNull() | F.col(offset_col).isNull() | (F.col(offset_col) < F.col("__stop"))))
    return p.select(*([F.col(offset_col)] if offset_col and offset_col in pages.columns else []),
                    F.explode("__page.projects").alias("project_key", "record"))


def read_project_pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed page files (one JSON document each); the page offset is the
    number after "offset" or "os" in the file name, when there is one."""
    t = spark.read.text(path, wholetext=True).select(
        "value", F.col("_metadata.file_name").alias("file_name"))
    t = t.withColumn("offset", F.regexp_extract("file_name", r"(?i)(?:^|[^a-z])(?:offset|os)[=_-]?(\d+)", 1).try_cast("long"))
    return page_records(t, "value", "offset")


def _first_if_list(v: Column) -> Column:
    arr = F.from_json(v, "array<string>")
    is_list = F.regexp_replace(v, r"(?U)^\s+", "").startswith("[")
    return F.when(is_list, F.get(arr, 0)).otherwise(v)


def normalize_projects(records: DataFrame, record_col: str = "record") -> DataFrame:
    """PRJ-12: fixed 11 string columns; lists reduced to their first item;
    absent fields are null."""
    m = F.from_json(F.col(record_col), "map<string,string>")
    r = records.select(m.alias("__m"))
    cols = []
    for f in FIELDS:
        v = F.try_element_at(F.col("__m"), F.lit(f))
        cols.append((_first_if_list(v) if f in LIST_FIELDS else v).alias(f))
    return r.select(*cols)

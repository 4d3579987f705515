"""Scoring requests: JSON payloads (list or ``{"items": [...]}``) and
uploaded CSV tables → request rows with a stable ``input_row_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ITEM_DDL = "award_id string, supplier_id string"


def payload_items(text: Column) -> Column:
    """The items (JSON texts) of a payload: its list, or the list under ``items``."""
    return F.when(F.ltrim(text).startswith("["), F.from_json(text, "array<string>")).otherwise(
        F.coalesce(F.from_json(text, "items array<string>")["items"], F.array().cast("array<string>")))


def item_fields(item: Column) -> list[Column]:
    """award_id and supplier_id of an item; null where it is no object."""
    parsed = F.when(F.ltrim(item).startswith("{"), F.from_json(item, ITEM_DDL))
    return [parsed["award_id"].alias("award_id"), parsed["supplier_id"].alias("supplier_id")]


def parse_request_payloads(payloads: DataFrame, text_col: str = "payload", key_col: str = "payload_id",
                           max_items: int | None = None) -> DataFrame:
    """SRC-19 + FLT-10: one row per item of each payload.

    A payload starting with ``[`` is the item list; otherwise its ``items``
    member is (an object without ``items``, or anything else, gives no
    rows).  Items that are not objects keep a row with null fields (the
    validator turns that into a per-row error).  ``input_row_id`` is the
    item position; ``max_items`` keeps the first items of each payload."""
    items = payloads.select(F.col(key_col).alias("payload_id"),
                            F.posexplode(payload_items(F.col(text_col))).alias("input_row_id", "item"))
    if max_items is not None:
        items = items.filter(F.col("input_row_id") < int(max_items))
    return items.select("payload_id", F.col("input_row_id").cast("long").alias("input_row_id"), *item_fields(F.col("item")))


def coerce_award_rows(df: DataFrame, row_id: str = "input_row_id") -> DataFrame:
    """PRJ-17: an uploaded table → (input_row_id, award_id, supplier_id).

    Headers are matched case- and space-insensitively; values become
    strings, NaN becomes null.  A table without an award_id column is an
    error (raised at planning time, from the schema only)."""
    names = {c.strip().lower().replace(" ", "_"): c for c in df.columns}
    if "award_id" not in names:
        raise ValueError("CSV must contain an 'award_id' column")

    def txt(c: str) -> Column:
        col = F.col(f"`{c}`")
        s = col.cast("string")
        return F.when(s.isin("NaN", "nan") | col.isNull(), F.lit(None).cast("string")).otherwise(s)
    rid = F.col(names[row_id]) if row_id in names else F.monotonically_increasing_id()
    return df.select(rid.cast("long").alias("input_row_id"), txt(names["award_id"]).alias("award_id"),
                     (txt(names["supplier_id"]) if "supplier_id" in names else F.lit(None).cast("string"))
                     .alias("supplier_id"))


def first_requests(requests: DataFrame, max_items: int | None) -> DataFrame:
    """FLT-10: the first ``max_items`` requests by ``input_row_id``."""
    return requests if max_items is None else requests.orderBy("input_row_id").limit(int(max_items))


def payload_preview(items: Column, n: int = 3, max_chars: int = 4000) -> Column:
    """PRJ-21 as an expression: JSON of the first ``n`` items, cut at
    ``max_chars`` characters with a marker."""
    return _cut(F.to_json(F.slice(items, 1, n)), max_chars)


def text_preview(text: Column, n: int = 3, max_chars: int = 4000) -> Column:
    """PRJ-21 of a payload's JSON text: an envelope of its first ``n`` items; a
    payload without items shows its own text."""
    items = payload_items(text)
    shown = F.when(F.size(items) > 0, F.concat(F.lit('{"items": ['), F.array_join(F.slice(items, 1, n), ", "), F.lit("]}")))
    return _cut(F.coalesce(shown, text), max_chars)


def _cut(text: Column, max_chars: int) -> Column:
    return F.when(F.length(text) > max_chars,
                  F.concat(F.substring(text, 1, max_chars), F.lit("...<truncated>"))).otherwise(text)

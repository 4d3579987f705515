"""Adverse-media payloads: schema validation, item explode, hit counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions.text import graph_name_key

# The item's fields and their types.
ITEM_DDL = ("entity string, allegation_type string, date string, location string, "
            "source_url string, confidence double, snippet string")
TEXT_FIELDS = [f.split()[0] for f in ITEM_DDL.split(", ") if f.endswith(" string")]
# Items stay JSON text here: one mistyped item must not cost its siblings.
PAYLOAD_DDL = "items array<string>, _corrupt_record string"

# An absolute http(s) URL with a host.
URL_RE = r"^https?://[^\s/?#]+[^\s]*$"


def _type_of(v: Column, path: str) -> Column:
    return F.schema_of_variant(F.variant_get(v, path, "variant"))


def read_item(v: Column) -> tuple[Column, Column]:
    """(item struct, its type violations) of one item, a variant.  Text fields
    must hold text; the confidence a number, or text that is one."""
    is_object = F.coalesce(F.schema_of_variant(v).startswith("OBJECT"), F.lit(False))
    v = F.when(is_object, v)
    item = F.struct(*[F.try_variant_get(v, f"$.{n}", t).alias(n)
                      for n, t in (f.split() for f in ITEM_DDL.split(", "))])
    wrong = [F.when(~_type_of(v, f"$.{n}").isin("STRING", "VOID"), F.lit(f"{n}: must be text")) for n in TEXT_FIELDS]
    wrong.append(F.when((_type_of(v, "$.confidence") != "VOID") & item["confidence"].isNull(),
                        F.lit("confidence: must be a number")))
    bad = F.when(~is_object, F.array(F.lit("item: must be an object"))).otherwise(F.array_compact(F.array(*wrong)))
    return item, bad


def item_violations(it: Column) -> Column:
    """FLT-08: array of rule violations of one item (empty = valid)."""
    return F.array_compact(F.array(
        F.when(it["entity"].isNull(), F.lit("entity: field required")),
        F.when(it["allegation_type"].isNull(), F.lit("allegation_type: field required")),
        F.when(it["confidence"].isNotNull() & ((it["confidence"] < 0) | (it["confidence"] > 1)
                                               | F.isnan(it["confidence"])),
               F.lit("confidence: must be within [0, 1]")),
        F.when(it["source_url"].isNotNull() & ~it["source_url"].rlike(URL_RE),
               F.lit("source_url: invalid http(s) URL")),
    ))


def validate_media(payloads: DataFrame, text_col: str = "payload",
                   key_col: str = "payload_id") -> tuple[DataFrame, DataFrame]:
    """SRC-18 + FLT-08: (valid items, rejects).

    valid: key, item_no and the 7 item fields.  rejects: key, item_no
    (null for payload-level problems) and ``errors`` (array of messages).
    A payload that is not JSON, or lacks ``items``, is one reject row."""
    p = payloads.select(F.col(key_col).alias("payload_id"),
                        F.explode(F.array(F.from_json(F.col(text_col), PAYLOAD_DDL, {
                            "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}))).alias("p"))
    bad_doc = F.col("p._corrupt_record").isNotNull() | F.col("p").isNull()
    doc_err = (F.when(bad_doc, F.array(F.lit("payload: invalid JSON")))
                .when(F.col("p.items").isNull(), F.array(F.lit("items: field required"))))
    payload_rejects = p.filter(doc_err.isNotNull()).select(
        "payload_id", F.lit(None).cast("int").alias("item_no"), doc_err.alias("errors"))
    items = p.filter(doc_err.isNull()).select("payload_id", F.posexplode("p.items").alias("item_no", "txt"))
    # each Generate computes its value once, however often the fields above name it
    items = items.select("payload_id", "item_no", F.explode(F.array(F.try_parse_json("txt"))).alias("v"))
    item, bad = read_item(F.col("v"))
    items = items.select("payload_id", "item_no", F.explode(F.array(F.struct(item.alias("it"), bad.alias("bad")))).alias("r"))
    items = items.select("payload_id", "item_no", "r.it", F.when(F.size("r.bad") > 0, F.col("r.bad")).otherwise(
        item_violations(F.col("r.it"))).alias("errors"))
    valid = items.filter(F.size("errors") == 0).select(
        "payload_id", "item_no", *[F.col(f"it.{f.split()[0]}").alias(f.split()[0])
                                   for f in ITEM_DDL.split(", ")])
    rejects = items.filter(F.size("errors") > 0).select("payload_id", "item_no", "errors")
    return valid, payload_rejects.unionByName(rejects)


def media_hits(items: DataFrame) -> DataFrame:
    """LBL-01: adverse-media hit count per entity name key (partial
    aggregation, so a much-reported entity is no hot task)."""
    return (items.select(graph_name_key(F.col("entity")).alias("name_key"))
                 .filter(F.col("name_key").isNotNull())
                 .groupBy("name_key").agg(F.count(F.lit(1)).alias("adverse_media_count")))

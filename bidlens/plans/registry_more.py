"""More registered queries: feeds with unusual types, missing numbers,
reports, rollups and generic graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from bidlens.operators import evaluate as ev
from bidlens.operators import features as feat
from bidlens.operators import graph as gr
from bidlens.operators import report as rep
from bidlens.operators import runlog as rl
from bidlens.operators import scoring
from bidlens.plans import adapters as ad
from bidlens.plans import oracle as O
from bidlens.plans import registry as R
from bidlens.plans.registry import FIXED_MODEL, SQL, register, rounded
from bidlens.session import cut_lineage
from bidlens.sources import ocds
from bidlens.sources import pages as pg


# --------------------------------------------------------------- unusual feeds

def _odd_releases(spark, sf_dir):
    """The releases with numbers as text (every third line number) and the
    role as a scalar (line numbers 1 and 5)."""
    j = ad.releases_json(spark, sf_dir)
    line = F.col("release_order.l_linenumber")
    v = F.when(line % 3 == 0, F.regexp_replace("value", r'"amount":([0-9.E+-]+)', r'"amount":"$1"')).otherwise(F.col("value"))
    v = F.when(line % 4 == 1, F.regexp_replace(v, r'"roles":\["supplier"\]', '"roles":"supplier"')).otherwise(v)
    return j.select(v.alias("value"), "release_order")


@register("releases_package", SQL["awards"])
def q_releases_package(spark, sf_dir):
    """One package per order (a handful of releases), each with an element
    that is no release."""
    j = _odd_releases(spark, sf_dir)
    packed = j.groupBy(F.col("release_order.l_orderkey").alias("k")).agg(F.sort_array(F.collect_list("value")).alias("v"))
    text = F.concat(F.lit('{"releases": ["no release", null, '), F.array_join("v", ", "), F.lit("]}"))
    rel = ocds.parse_releases(packed.select(text.alias("value"), "k"), "value", jsonl=False, order=F.col("k"))
    return rounded(ocds.awards(rel))


@register("releases_mixed", SQL["tenders"])
def q_releases_mixed(spark, sf_dir):
    """JSON Lines with a broken line for every supplier."""
    broken = ad.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit('{"ocid": "'), F.col("s_suppkey").cast("string")).alias("value"))
    lines = _odd_releases(spark, sf_dir).select("value").unionByName(broken)
    return rounded(ocds.tenders(ocds.parse_releases(lines, "value", jsonl=True)))


@register("releases_quarantine", """
SELECT CAST(s_suppkey AS VARCHAR) AS supplier_id, CAST(1 AS BIGINT) AS n FROM supplier""")
def q_releases_quarantine(spark, sf_dir):
    broken = ad.table(spark, sf_dir, "supplier").select(
        F.concat(F.lit('{"ocid": "'), F.col("s_suppkey").cast("string")).alias("value"))
    lines = _odd_releases(spark, sf_dir).select("value").unionByName(broken)
    rel = ocds.parse_releases(lines, "value", jsonl=True)
    return (rel.filter("_corrupt_record is not null")
            .groupBy(F.regexp_extract("_corrupt_record", r"(\d+)$", 1).alias("supplier_id"))
            .agg(F.count(F.lit(1)).alias("n")))


# --------------------------------------------------------------- shared tender ids

def _shared(spark, sf_dir):
    return ad.shared_tenders(spark, sf_dir), ad.shared_awards(spark, sf_dir)


@register("features_shared_ids", "WITH " + O.SHARED_ROWS_CTE + """
SELECT award_id, supplier_id, ROUND(award_concentration_by_buyer, 6) AS award_concentration_by_buyer,
       ROUND(repeat_winner_ratio, 6) AS repeat_winner_ratio,
       ROUND(amount_zscore_by_category, 6) AS amount_zscore_by_category, near_threshold_flag, time_to_award_days
FROM features_x""")
def q_features_shared_ids(spark, sf_dir):
    """Missing and repeated tender ids on both sides (the SQL multiplies them out)."""
    return rounded(feat.build_features(*_shared(spark, sf_dir), order_key=ad.AWARD_ORDER))


@register("concentration_shared_ids", "WITH " + O.SHARED_CTE + """,
j AS (SELECT a.supplier_id, t.buyer_name FROM awards_x a
      LEFT JOIN tenders_x t ON a.tender_id IS NOT DISTINCT FROM t.tender_id),
p AS (SELECT buyer_name, supplier_id, COUNT(*) AS awards_by_pair FROM j GROUP BY ALL),
b AS (SELECT buyer_name, COUNT(*) AS awards_by_buyer FROM j GROUP BY ALL)
SELECT p.buyer_name, p.supplier_id, p.awards_by_pair, b.awards_by_buyer,
       ROUND(CAST(p.awards_by_pair AS DOUBLE) / b.awards_by_buyer, 6) AS share
FROM p LEFT JOIN b ON p.buyer_name IS NOT DISTINCT FROM b.buyer_name""")
def q_concentration_shared_ids(spark, sf_dir):
    c = feat.concentration_totals(*_shared(spark, sf_dir))
    return rounded(c.select(F.col("__buyer_name").alias("buyer_name"), F.col("__supplier_id").alias("supplier_id"),
                            "awards_by_pair", "awards_by_buyer", "share"))


@register("category_stats_shared_ids", "WITH " + O.SHARED_CTE + """
SELECT t.main_category, COUNT(a.amount) AS n_amount, ROUND(AVG(a.amount), 4) AS mean_amount,
       ROUND(STDDEV_POP(a.amount), 4) AS std_amount
FROM awards_x a LEFT JOIN tenders_x t ON a.tender_id IS NOT DISTINCT FROM t.tender_id GROUP BY 1""")
def q_category_stats_shared_ids(spark, sf_dir):
    return rounded(feat.category_totals(*_shared(spark, sf_dir)).withColumnRenamed("__category", "main_category"), 4)


@register("edges_shared_ids", "WITH " + O.SHARED_CTE + """
SELECT 'buyer:' || COALESCE(buyer_id, 'unknown-buyer') AS src, a.supplier_id AS dst, COUNT(a.award_id) AS awards_count,
       ROUND(COALESCE(SUM(a.amount), 0.0), 2) AS total_amount
FROM awards_x a LEFT JOIN tenders_x t ON a.tender_id IS NOT DISTINCT FROM t.tender_id GROUP BY 1, 2""")
def q_edges_shared_ids(spark, sf_dir):
    return rounded(gr.bipartite_graph(*_shared(spark, sf_dir))[1], 2)


@register("vertices_shared_ids", "WITH " + O.SHARED_CTE + """,
j AS (SELECT a.supplier_id, a.supplier_name, t.buyer_id, t.buyer_name FROM awards_x a
      LEFT JOIN tenders_x t ON a.tender_id IS NOT DISTINCT FROM t.tender_id)
SELECT 'buyer:' || COALESCE(buyer_id, 'unknown-buyer') AS id, 'buyer' AS bipartite, max(buyer_name) AS name, buyer_id,
       NULL AS supplier_id FROM j GROUP BY buyer_id
UNION ALL
SELECT supplier_id, 'supplier', max(supplier_name), NULL, supplier_id FROM j GROUP BY supplier_id""")
def q_vertices_shared_ids(spark, sf_dir):
    return gr.bipartite_graph(*_shared(spark, sf_dir))[0]


# --------------------------------------------------------------- missing numbers

@register("features_nan", "WITH " + O.FEATURE_ROWS_CTE.replace(
    "l.l_extendedprice AS amount", "CASE WHEN l.l_linenumber <> 3 THEN l.l_extendedprice END AS amount") + """
SELECT award_id, supplier_id, ROUND(award_concentration_by_buyer, 6) AS award_concentration_by_buyer,
       ROUND(repeat_winner_ratio, 6) AS repeat_winner_ratio,
       ROUND(amount_zscore_by_category, 6) AS amount_zscore_by_category, near_threshold_flag, time_to_award_days
FROM features_x""")
def q_features_nan(spark, sf_dir):
    """Amounts as text, NaN on line 3."""
    aw = ad.awards(spark, sf_dir).withColumn("amount", F.when(F.col("l_linenumber") == 3, F.lit("NaN"))
                                             .otherwise(F.col("amount").cast("string")))
    return rounded(feat.build_features(ad.tenders(spark, sf_dir), aw, order_key=ad.AWARD_ORDER))


_NAN_FEATURES = "WITH " + O.FEATURE_ROWS_CTE + """,
nan_x AS (SELECT award_id, supplier_id, award_concentration_by_buyer, repeat_winner_ratio,
                 CASE WHEN time_to_award_days % 3 <> 0 THEN amount_zscore_by_category END AS amount_zscore_by_category,
                 near_threshold_flag, time_to_award_days FROM features_x)"""


@register("scores_nan", _NAN_FEATURES + f"""
SELECT award_id, {R.HEUR_SQL} AS heuristic, ROUND(GREATEST(0.0, LEAST(1.0, {R.linear_sql(FIXED_MODEL)})), 6) AS linear,
       {R.PROXY_SQL} AS label FROM nan_x""")
def q_scores_nan(spark, sf_dir):
    """NaN in a feature scores and labels like a null."""
    from bidlens.operators import model as mdl
    f = R.features_df(spark, sf_dir).withColumn("amount_zscore_by_category", F.when(
        F.col("time_to_award_days") % 3 == 0, F.lit(float("nan"))).otherwise(F.col("amount_zscore_by_category")))
    h = scoring.heuristic_score(f).withColumnRenamed("risk_score", "heuristic")
    s = mdl.proxy_label(scoring.linear_score(h, FIXED_MODEL, explain=False))
    return rounded(s.select("award_id", "heuristic", F.col("risk_score").alias("linear"), "label"))


# --------------------------------------------------------------- batch with graph, reports

@register("score_batch_graph", "WITH " + O.FEATURE_ROWS_CTE + "," + R.REQUESTS_CTE + """,
gdeg AS (SELECT a.supplier_id, COUNT(DISTINCT t.buyer_id) AS degree FROM awards_x a
         JOIN tenders_x t ON a.tender_id = t.tender_id GROUP BY 1)
SELECT b.input_row_id, b.supplier_id, CASE WHEN b.error IS NULL THEN """ + R.HEUR_SQL + """ END AS risk_score,
       b.error, g.degree, CASE WHEN g.degree IS NOT NULL THEN 'graph' END AS risk_band_graph
FROM breq_x b LEFT JOIN gdeg g ON b.supplier_id = g.supplier_id""")
def q_score_batch_graph(spark, sf_dir):
    """Supplier degrees beside the scores; a column whose name is taken gets
    a suffix; a second, emptier row per supplier is folded in."""
    _, e = R.graph_parts(spark, sf_dir)
    deg = gr.degree(e).filter(~F.col("node").startswith("buyer:")).select(
        F.col("node").alias("supplier_id"), "degree", F.lit("graph").alias("risk_band"))
    deg = cut_lineage(deg)  # a row per supplier, read twice below
    twice = deg.unionByName(deg.select("supplier_id", F.lit(None).cast("long").alias("degree"),
                                       F.lit(None).cast("string").alias("risk_band")))
    out = scoring.score_batch(R.requests_df(spark, sf_dir), R.features_df(spark, sf_dir, stored=True), graph=twice)
    return rounded(out.select("input_row_id", "supplier_id", "risk_score", "error", "degree", "risk_band_graph"))


def _short_sql(x: str, scale: float) -> str:
    """Fewer digits by floor: the engines round decimal ties differently."""
    return f"(floor({x} * {scale} + 0.500001) / {scale} + 0.0)"


@register("factor_preview", "WITH " + O.FEATURE_ROWS_CTE + "," + R.REQUESTS_CTE + "," + R.FACTOR_ROWS_CTE + f""",
p AS (SELECT input_row_id, string_agg(name || '=' || CAST({_short_sql('value', 100.0)} AS VARCHAR)
             || printf(' (%+.3f)', {_short_sql('contribution', 10.0)}), '; ' ORDER BY rk) AS preview
      FROM fr WHERE rk <= 2 GROUP BY 1)
SELECT b.input_row_id, COALESCE(p.preview, '') AS preview FROM breq_x b LEFT JOIN p ON b.input_row_id = p.input_row_id""")
def q_factor_preview(spark, sf_dir):
    out = scoring.score_batch(R.requests_df(spark, sf_dir), R.features_df(spark, sf_dir, stored=True), model=FIXED_MODEL, top_k=3,
                              dedupe_features=False)

    def short(x, scale):
        return F.floor(x * scale + 0.500001).cast("double") / F.lit(scale)

    factors = F.transform("top_factors", lambda f: F.struct(
        f["name"].alias("name"), short(f["value"], 100.0).alias("value"), short(f["contribution"], 10.0).alias("contribution")))
    return out.select("input_row_id", rep.factor_preview(factors, 2).alias("preview"))


@register("distinct_bands", "WITH " + O.FEATURE_ROWS_CTE + """
SELECT DISTINCT """ + O.band_sql(R.HEUR_SQL) + """ AS risk_band FROM features_x WHERE """ + R.HEUR_SQL + """ IS NOT NULL""")
def q_distinct_bands(spark, sf_dir):
    return rep.distinct_bands(scoring.with_band(scoring.heuristic_score(R.features_df(spark, sf_dir))))


@register("eval_degenerate", R.EVAL_SQL.replace(
    f"s AS (SELECT {R.PROXY_SQL} AS y, {R.linear_sql(FIXED_MODEL)} AS p FROM features_x)",
    f"""s AS (SELECT CASE WHEN award_id = (SELECT min(award_id) FROM features_x) THEN 0 ELSE 1 END AS y,
          {R.linear_sql(FIXED_MODEL)} AS p FROM features_x)"""))
def q_eval_degenerate(spark, sf_dir):
    """All labels are 1: one row, the first award, is flipped."""
    s = scoring.linear_score(R.features_df(spark, sf_dir, stored=True), FIXED_MODEL, explain=False).withColumn(
        "label", F.lit(1))
    return rounded(ev.metrics(s.withColumn("p", FIXED_MODEL.probability()), "label", "p", order="award_id"))


@register("items_rollup", """
SELECT event_type <> 'error' AS used_model, value > 25 AS join_graph,
       CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 0 AS explain,
       CAST(COALESCE(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS items
FROM events GROUP BY 1, 2, 3""")
def q_items_rollup(spark, sf_dir):
    e = ad.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("long")
    return rl.items_rollup(e.select((F.col("event_type") != "error").alias("used_model"),
                                    (F.col("value") > 25).alias("join_graph"), (k % 2 == 0).alias("explain"),
                                    k.alias("num_items")))


# --------------------------------------------------------------- generic graph

@register("graph_lists", """
WITH e AS (SELECT DISTINCT least(a, b) AS src, greatest(a, b) AS dst FROM (
             SELECT CAST(l_suppkey AS VARCHAR) AS a, CAST(l_partkey AS VARCHAR) AS b FROM lineitem) WHERE a <> b),
adj AS (SELECT src AS node FROM e UNION ALL SELECT dst FROM e),
n AS (SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer UNION SELECT node FROM adj)
SELECT n.id, COUNT(adj.node) AS degree FROM n LEFT JOIN adj ON n.id = adj.node GROUP BY n.id""")
def q_graph_lists(spark, sf_dir):
    """Vertices from a list and from the edges' ends, self loops and repeated
    edges dropped; with their degrees."""
    li = ad.table(spark, sf_dir, "lineitem")
    v, e = gr.graph_from_lists(ad.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id")),
                               li.select(F.col("l_suppkey").alias("src"), F.col("l_partkey").alias("dst")))
    d = gr.degree(e).withColumnRenamed("node", "id")
    return v.join(d, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


# --------------------------------------------------------------- pages

# The test pages hold lists, not tables; ul, li and a stand for
# table, row and cell, and common words for the header names.
LIST_TAGS, LIST_HEADERS = ("ul", "li", "a"), ("The", "en", "de", "on")


@register("html_tables", """
WITH t AS (SELECT page_id, regexp_extract_all(html, '(?is)<ul\\b.*?</ul>') AS ts FROM pages),
t2 AS (SELECT page_id, unnest(range(0, len(ts))) AS table_no, ts FROM t),
r AS (SELECT page_id, table_no, regexp_extract_all(ts[table_no + 1], '(?is)<li\\b.*?</li>') AS rs FROM t2),
r2 AS (SELECT page_id, table_no, unnest(range(0, len(rs))) AS row_no, rs FROM r),
c AS (SELECT page_id, table_no, row_no, regexp_extract_all(rs[row_no + 1], '(?is)<a\\b[^>]*>(.*?)</a>', 1) AS cs FROM r2),
c2 AS (SELECT page_id, table_no, row_no, unnest(range(0, len(cs))) AS col_no, cs FROM c),
x AS (SELECT page_id, table_no, row_no, col_no, trim(regexp_replace(replace(replace(
        regexp_replace(cs[col_no + 1], '(?s)<[^>]*>', '', 'g'), '&nbsp;', ' '), '&amp;', '&'), '\\s+', ' ', 'g')) AS text FROM c2),
f AS (SELECT page_id, min(table_no) AS table_no FROM x WHERE row_no = 0 AND ("""
          + " OR ".join(f"contains(text, '{h}')" for h in LIST_HEADERS) + """) GROUP BY page_id)
SELECT x.page_id, CAST(x.table_no AS INTEGER) AS table_no, CAST(row_no AS INTEGER) AS row_no,
       CAST(col_no AS INTEGER) AS col_no, text
FROM x JOIN f ON x.page_id = f.page_id AND x.table_no = f.table_no""")
def q_html_tables(spark, sf_dir):
    return pg.html_tables(ad.table(spark, sf_dir, "pages"), LIST_HEADERS, LIST_TAGS).select(
        "page_id", "table_no", "row_no", "col_no", "text")


@register("redirect_target", """
WITH h AS (SELECT page_id, url, regexp_extract(html, '(?i)href=["'']([^"'']+\\.)["'']', 1) AS href FROM pages)
SELECT page_id, CASE WHEN href <> '' THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1) || href END AS url
FROM h""")
def q_redirect_target(spark, sf_dir):
    """The first link of every page that ends with a period (the test pages
    have no file links)."""
    return pg.redirect_target(ad.table(spark, sf_dir, "pages"), ("",))

"""Registered queries: one callable per operator group, each reading the
driver's whole tables through ``plans/adapters``; and the matching DuckDB SQL.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlens.operators import features as feat
from bidlens.operators import scoring
from bidlens.plans import adapters as ad
from bidlens.plans import oracle as O
from bidlens.session import cut_lineage
from bidlens.session import stored as as_parquet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round every double column (cross-engine float noise)."""
    return df.select([F.round(F.col(f.name), digits).alias(f.name)
                      if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f.name)
                      for f in df.schema.fields])


def features_df(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    """The feature table; ``stored`` for queries that read it several times."""
    f = feat.build_features(ad.tenders(spark, sf_dir), ad.awards(spark, sf_dir),
                            order_key=ad.AWARD_ORDER)
    return as_parquet(f) if stored else f


# --------------------------------------------------------------- features

@register("award_features", "WITH " + O.FEATURE_ROWS_CTE + """
SELECT award_id, supplier_id,
       ROUND(award_concentration_by_buyer, 6) AS award_concentration_by_buyer,
       ROUND(repeat_winner_ratio, 6) AS repeat_winner_ratio,
       ROUND(amount_zscore_by_category, 6) AS amount_zscore_by_category,
       near_threshold_flag, time_to_award_days
FROM features_x""")
def q_award_features(spark, sf_dir):
    return rounded(features_df(spark, sf_dir))


@register("award_concentration", "WITH " + O.TENDERS_CTE + "," + O.AWARDS_CTE + """,
j AS (SELECT a.supplier_id, t.buyer_name FROM awards_x a
      LEFT JOIN tenders_x t ON a.tender_id IS NOT DISTINCT FROM t.tender_id),
p AS (SELECT buyer_name, supplier_id, COUNT(*) AS awards_by_pair FROM j GROUP BY ALL),
b AS (SELECT buyer_name, COUNT(*) AS awards_by_buyer FROM j GROUP BY ALL)
SELECT p.buyer_name, p.supplier_id, p.awards_by_pair, b.awards_by_buyer,
       ROUND(COALESCE(CAST(p.awards_by_pair AS DOUBLE) / NULLIF(b.awards_by_buyer, 0), 0.0), 6) AS share
FROM p LEFT JOIN b ON p.buyer_name IS NOT DISTINCT FROM b.buyer_name""")
def q_award_concentration(spark, sf_dir):
    c = feat.concentration_totals(ad.tenders(spark, sf_dir), ad.awards(spark, sf_dir))
    return rounded(c.select(F.col("__buyer_name").alias("buyer_name"),
                            F.col("__supplier_id").alias("supplier_id"),
                            "awards_by_pair", "awards_by_buyer", "share"))


@register("amount_zscore", "WITH " + O.FEATURE_ROWS_CTE + """
SELECT award_id, main_category, ROUND(amount_zscore_by_category, 6) AS amount_zscore_by_category
FROM rows_x""")
def q_amount_zscore(spark, sf_dir):
    rows = feat.award_feature_rows(ad.tenders(spark, sf_dir), ad.awards(spark, sf_dir))
    return rounded(rows.select("award_id", F.col("__category").alias("main_category"),
                               "amount_zscore_by_category"))


@register("category_stats", "WITH " + O.TENDERS_CTE + "," + O.AWARDS_CTE + """
SELECT t.main_category, COUNT(a.amount) AS n_amount, ROUND(AVG(a.amount), 6) AS mean_amount,
       ROUND(STDDEV_POP(a.amount), 6) AS std_amount
FROM awards_x a LEFT JOIN tenders_x t ON a.tender_id IS NOT DISTINCT FROM t.tender_id
GROUP BY t.main_category""")
def q_category_stats(spark, sf_dir):
    c = feat.category_totals(ad.tenders(spark, sf_dir), ad.awards(spark, sf_dir))
    return rounded(c.withColumnRenamed("__category", "main_category"))


@register("near_threshold", "WITH " + O.AWARDS_CTE + """
SELECT award_id, amount, """ + O.near_sql("amount") + """ AS near_threshold_flag FROM awards_x""")
def q_near_threshold(spark, sf_dir):
    a = ad.awards(spark, sf_dir)
    return rounded(a.select("award_id", "amount",
                            feat.near_threshold(F.col("amount")).alias("near_threshold_flag")))


@register("time_to_award", "WITH " + O.TENDERS_CTE + "," + O.AWARDS_CTE + """
SELECT a.award_id, """ + O.days_sql("a.award_date", "t.tender_date") + """ AS time_to_award_days
FROM awards_x a LEFT JOIN tenders_x t ON a.tender_id IS NOT DISTINCT FROM t.tender_id""")
def q_time_to_award(spark, sf_dir):
    rows = feat.joined_awards(ad.tenders(spark, sf_dir), ad.awards(spark, sf_dir))
    return rows.select("award_id", feat.time_to_award(F.col("__award_ts"), F.col("__tender_ts"))
                       .alias("time_to_award_days"))


# --------------------------------------------------------------- scores

HEUR_SQL = O.heuristic_sql("near_threshold_flag", "repeat_winner_ratio",
                           "amount_zscore_by_category", "award_concentration_by_buyer")


@register("heuristic_score", "WITH " + O.FEATURE_ROWS_CTE + """
SELECT award_id, supplier_id, """ + HEUR_SQL + """ AS risk_score,
       """ + O.band_sql(HEUR_SQL) + """ AS risk_band
FROM features_x""")
def q_heuristic_score(spark, sf_dir):
    s = scoring.with_band(scoring.heuristic_score(features_df(spark, sf_dir)))
    return s.select("award_id", "supplier_id", "risk_score", "risk_band")


@register("top20", "WITH " + O.FEATURE_ROWS_CTE + """
SELECT award_id, supplier_id, risk_score, risk_band FROM (
  SELECT award_id, supplier_id, """ + HEUR_SQL + """ AS risk_score,
         """ + O.band_sql(HEUR_SQL) + """ AS risk_band
  FROM features_x)
WHERE risk_score IS NOT NULL
ORDER BY risk_score DESC, award_id LIMIT 20""")
def q_top20(spark, sf_dir):
    s = scoring.with_band(scoring.heuristic_score(features_df(spark, sf_dir)))
    return scoring.top_risk(s, 20).select("award_id", "supplier_id", "risk_score", "risk_band")


# --------------------------------------------------------------- model / labels

from bidlens.operators import evaluate as ev  # noqa: E402
from bidlens.operators import model as mdl  # noqa: E402

PROXY_SQL = ("CAST((COALESCE(amount_zscore_by_category, 0) > 1.5 OR COALESCE(repeat_winner_ratio, 0) > 0.8"
             " OR COALESCE(near_threshold_flag, 0) = 1 OR COALESCE(award_concentration_by_buyer, 0) > 0.7)"
             " AS INTEGER)")

# A fixed coefficient set for the linear-scoring checks (the
# cross-check needs numbers both engines share; ``fit`` is checked apart).
FIXED_MODEL = scoring.LinearModel(
    feature_cols=list(feat.FEATURE_COLS),
    coef=[0.8, 1.2, 0.5, 1.5, -0.002],
    intercept=-2.0,
    thresholds={"low_max": 0.2, "medium_max": 0.5})


def logit_sql(m: scoring.LinearModel) -> str:
    terms = " + ".join(f"({w!r}) * COALESCE(CAST({c} AS DOUBLE), 0.0)"
                       for c, w in zip(m.feature_cols, m.coef))
    return f"(({m.intercept!r}) + {terms})"


def linear_sql(m: scoring.LinearModel) -> str:
    return f"(1.0 / (1.0 + exp(-({logit_sql(m)}))))"


def fixed_scores(spark, sf_dir, explain=True, top_k=None):
    return scoring.linear_score(features_df(spark, sf_dir), FIXED_MODEL, top_k=top_k,
                                explain=explain)


@register("proxy_label", "WITH " + O.FEATURE_ROWS_CTE + f"""
SELECT award_id, {PROXY_SQL} AS label FROM features_x""")
def q_proxy_label(spark, sf_dir):
    return mdl.proxy_label(features_df(spark, sf_dir)).select("award_id", "label")


@register("band_thresholds", "WITH " + O.FEATURE_ROWS_CTE + f""",
s AS (SELECT {HEUR_SQL} AS risk_score FROM features_x)
SELECT ROUND(quantile_cont(risk_score, 0.33), 6) AS low_max,
       ROUND(quantile_cont(risk_score, 0.66), 6) AS medium_max FROM s""")
def q_band_thresholds(spark, sf_dir):
    s = scoring.heuristic_score(features_df(spark, sf_dir, stored=True))
    th = mdl.band_thresholds(s, "risk_score")
    return rounded(spark.createDataFrame([(th["low_max"], th["medium_max"])],
                                         "low_max double, medium_max double"))


@register("risk_band", "WITH " + O.FEATURE_ROWS_CTE + f""",
s AS (SELECT award_id, {HEUR_SQL} AS risk_score FROM features_x),
q AS (SELECT quantile_cont(risk_score, 0.33) AS lo, quantile_cont(risk_score, 0.66) AS md FROM s)
SELECT award_id, risk_score,
       CASE WHEN risk_score <= lo THEN 'low' WHEN risk_score <= md THEN 'medium' ELSE 'high' END
       AS risk_band
FROM s, q""")
def q_risk_band(spark, sf_dir):
    s = scoring.heuristic_score(features_df(spark, sf_dir, stored=True))
    th = mdl.band_thresholds(s, "risk_score")
    return scoring.with_band(s, th).select("award_id", "risk_score", "risk_band")


@register("linear_score_fixed", "WITH " + O.FEATURE_ROWS_CTE + f""",
s AS (SELECT award_id, supplier_id, GREATEST(0.0, LEAST(1.0, {linear_sql(FIXED_MODEL)})) AS p
      FROM features_x)
SELECT award_id, supplier_id, ROUND(p, 6) AS risk_score,
       {O.band_sql('p', 0.2, 0.5)} AS risk_band FROM s""")
def q_linear_score_fixed(spark, sf_dir):
    s = fixed_scores(spark, sf_dir, explain=False)
    return rounded(s.select("award_id", "supplier_id", "risk_score", "risk_band"))


def _factor_rows_sql(m: scoring.LinearModel, k: int) -> str:
    parts = " UNION ALL ".join(
        f"SELECT award_id, '{c}' AS name, COALESCE(CAST({c} AS DOUBLE), 0.0) AS value, "
        f"({w!r}) * COALESCE(CAST({c} AS DOUBLE), 0.0) AS contribution, {i} AS pos FROM features_x"
        for i, (c, w) in enumerate(zip(m.feature_cols, m.coef)))
    return f"""
SELECT award_id, CAST(rk AS INTEGER) AS factor_rank, name, ROUND(value, 6) AS value,
       ROUND(contribution, 6) AS contribution
FROM (SELECT f.*, ROW_NUMBER() OVER (PARTITION BY award_id ORDER BY abs(contribution) DESC, pos) AS rk
      FROM ({parts}) f)
WHERE rk <= {k}"""


@register("top_factors", "WITH " + O.FEATURE_ROWS_CTE + _factor_rows_sql(FIXED_MODEL, 3))
def q_top_factors(spark, sf_dir):
    s = fixed_scores(spark, sf_dir, explain=True, top_k=3)
    e = s.select("award_id", F.posexplode("top_factors").alias("pos", "f"))
    return rounded(e.select("award_id", (F.col("pos") + 1).cast("int").alias("factor_rank"),
                            F.col("f.name").alias("name"), F.col("f.value").alias("value"),
                            F.col("f.contribution").alias("contribution")))


EVAL_SQL = "WITH " + O.FEATURE_ROWS_CTE + f""",
s AS (SELECT {PROXY_SQL} AS y, {linear_sql(FIXED_MODEL)} AS p FROM features_x),
g AS (SELECT p, SUM(y) AS pos, SUM(1 - y) AS neg FROM s GROUP BY p),
c AS (SELECT p, pos, neg,
        COALESCE(SUM(pos) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos_below,
        COALESCE(SUM(neg) OVER (ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS neg_below
      FROM g),
t AS (SELECT CAST(SUM(pos) AS DOUBLE) AS tot_pos, CAST(SUM(neg) AS DOUBLE) AS tot_neg FROM g),
r AS (SELECT SUM(pos * (neg_below + neg / 2.0)) / (tot_pos * tot_neg) AS auc_roc,
             SUM(CASE WHEN pos > 0 THEN pos / tot_pos * (tot_pos - pos_below)
                      / ((tot_pos - pos_below) + (tot_neg - neg_below)) ELSE 0 END) AS avg_precision
      FROM c, t GROUP BY tot_pos, tot_neg),
m AS (SELECT AVG((p - y) * (p - y)) AS brier,
             AVG(-(y * ln(LEAST(GREATEST(p, 1e-6), 1 - 1e-6))
                   + (1 - y) * ln(1 - LEAST(GREATEST(p, 1e-6), 1 - 1e-6)))) AS log_loss,
             AVG(y) AS pos_rate, COUNT(*) AS n FROM s)
SELECT ROUND(auc_roc, 6) AS auc_roc, ROUND(avg_precision, 6) AS avg_precision,
       ROUND(brier, 6) AS brier, ROUND(log_loss, 6) AS log_loss, ROUND(pos_rate, 6) AS pos_rate,
       n FROM r, m"""


@register("eval_metrics", EVAL_SQL)
def q_eval_metrics(spark, sf_dir):
    s = mdl.proxy_label(scoring.linear_score(features_df(spark, sf_dir, stored=True), FIXED_MODEL, explain=False))
    s = s.withColumn("p", FIXED_MODEL.probability())
    return rounded(ev.metrics(s, "label", "p", order="award_id"))


@register("fit_logreg", "WITH " + O.FEATURE_ROWS_CTE + f""",
design AS MATERIALIZED (SELECT {", ".join(f"COALESCE(CAST({c} AS DOUBLE), 0.0) AS x{i + 1}" for i, c in enumerate(feat.FEATURE_COLS))},
                 {PROXY_SQL} AS y FROM features_x),
""" + O.newton_sql("design", len(feat.FEATURE_COLS) + 1, 14, 1.0) + "\n" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, ROUND(w{i + 1}, 3) AS weight FROM fit" for i, c in enumerate(feat.FEATURE_COLS)))
def q_fit_logreg(spark, sf_dir):
    """Fit on the whole feature table; the coefficients."""
    lm = mdl.fit(features_df(spark, sf_dir), with_thresholds=False, tol=1e-13)
    return rounded(mdl.top_weights(spark, lm).select("feature", "weight"), 3)


@register("calibrated_score", "WITH " + O.FEATURE_ROWS_CTE + f""",
lg AS (SELECT award_id, supplier_id, {logit_sql(FIXED_MODEL)} AS x1, {PROXY_SQL} AS label FROM features_x),
design AS MATERIALIZED (SELECT x1, CASE WHEN label = 1 THEN (pos + 1.0) / (pos + 2.0) ELSE 1.0 / (n - pos + 2.0) END AS y
           FROM lg, (SELECT SUM(label) AS pos, COUNT(*) AS n FROM lg)),
""" + O.newton_sql("design", 2, 25) + f"""
SELECT award_id, supplier_id, ROUND(1.0 / (1.0 + exp(-(w1 * x1 + w0))), 6) AS risk_score,
       {O.band_sql("(1.0 / (1.0 + exp(-(w1 * x1 + w0))))", 0.2, 0.5)} AS risk_band FROM lg, fit""")
def q_calibrated_score(spark, sf_dir):
    """The fixed model's scores after Platt scaling on the proxy labels."""
    f = features_df(spark, sf_dir, stored=True)
    return rounded(scoring.linear_score(f, mdl.calibrate(f, FIXED_MODEL), explain=False).select(
        "award_id", "supplier_id", "risk_score", "risk_band"))


# --------------------------------------------------------------- sanctions + graph

from bidlens.operators import graph as gr  # noqa: E402
from bidlens.sources import sanctions as sanc  # noqa: E402

SANCTIONS_URL = "https://example.org/debarred-firms.csv"
STAMP = "2024-01-01T00:00:00Z"


def sanctions_df(spark, sf_dir):
    return sanc.normalize_sanctions(ad.sanctions_sheet(spark, sf_dir), SANCTIONS_URL, STAMP)


SANCTIONS_SQL_CTE = f"""
sheet_x AS (
  SELECT s.s_suppkey, s.s_name, s.s_nationkey, n.n_name,
         DATE '2010-01-01' + CAST(s.s_suppkey % 3000 AS INTEGER) AS d0
  FROM supplier s LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  WHERE s.s_acctbal < 0
),
sanc_rows_x AS (
  SELECT trim(s_name) AS name, lower(trim(s_name)) AS normalized_name, n_name AS country,
         'Fraudulent Practice' AS grounds, strftime(d0, '%Y-%m-%d') AS start_date,
         CASE WHEN s_nationkey % 5 = 0 THEN NULL
              ELSE strftime(d0 + CAST(365 + s_nationkey * 30 AS INTEGER), '%Y-%m-%d') END AS end_date,
         '{SANCTIONS_URL}' AS source_url, '{STAMP}' AS updated_at
  FROM sheet_x
),
sanctions_x AS (
  SELECT name, normalized_name, country, grounds, start_date, end_date, source_url, updated_at
  FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY normalized_name, start_date, end_date
                                       ORDER BY name, country, grounds) AS rn FROM sanc_rows_x r)
  WHERE rn = 1
)"""


@register("sanctions_norm", f"""
WITH s AS (
  SELECT s_suppkey, s_name, s_nationkey, n_name, DATE '2010-01-01' + CAST(s_suppkey % 3000 AS INTEGER) AS d0
  FROM supplier LEFT JOIN nation ON s_nationkey = n_nationkey),
r AS (
  SELECT s_suppkey AS pos, 0 AS copy, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE trim(s_name) END AS name, n_name AS country,
         d0, s_nationkey FROM s
  UNION ALL
  SELECT s_suppkey, 1, upper(trim(s_name)), 'AAA', d0, s_nationkey FROM s WHERE s_suppkey % 7 = 0 AND s_suppkey % 11 <> 0),
o AS (
  SELECT pos, copy, name, lower(name) AS normalized_name, country, 'Fraudulent Practice' AS grounds,
         strftime(d0, '%Y-%m-%d') AS start_date,
         CASE WHEN s_nationkey % 5 = 0 THEN NULL
              ELSE strftime(d0 + CAST(365 + s_nationkey * 30 AS INTEGER), '%Y-%m-%d') END AS end_date
  FROM r WHERE name <> '')
SELECT name, normalized_name, country, grounds, start_date, end_date, '{SANCTIONS_URL}' AS source_url, '{STAMP}' AS updated_at
FROM (SELECT o.*, ROW_NUMBER() OVER (PARTITION BY normalized_name, start_date, end_date ORDER BY pos, copy) AS rn FROM o)
WHERE rn = 1""")
def q_sanctions_norm(spark, sf_dir):
    return sanc.normalize_sanctions(ad.period_sheet(spark, sf_dir), SANCTIONS_URL, STAMP)


def graph_parts(spark, sf_dir, materialize=False):
    return gr.bipartite_graph(ad.tenders(spark, sf_dir), ad.awards(spark, sf_dir, keep_order=False), materialize)


def name_key_sql(x: str) -> str:
    return (f"NULLIF(trim(regexp_replace(regexp_replace(lower({x}), '[\\W_]+', ' ', 'g'),"
            f" '\\s+', ' ', 'g')), '')")


GRAPH_CTE = "WITH RECURSIVE " + O.TENDERS_CTE + "," + O.AWARDS_CTE + "," + SANCTIONS_SQL_CTE + """,
gj AS (SELECT a.award_id, a.supplier_id, a.supplier_name, a.amount, t.buyer_id, t.buyer_name
       FROM awards_x a LEFT JOIN tenders_x t ON a.tender_id IS NOT DISTINCT FROM t.tender_id),
ge AS (SELECT 'buyer:' || buyer_id AS src, supplier_id AS dst, COUNT(award_id) AS awards_count,
              COALESCE(SUM(amount), 0.0) AS total_amount FROM gj GROUP BY 1, 2),
gadj AS (SELECT src AS node, dst AS nbr FROM ge UNION SELECT dst AS node, src AS nbr FROM ge),
gsup AS (SELECT supplier_id AS id, max(supplier_name) AS supplier_name FROM gj GROUP BY 1),
gkeys AS (SELECT DISTINCT """ + name_key_sql("name") + """ AS k FROM sanctions_x),
gsan AS (SELECT s.id, s.supplier_name,
                (""" + name_key_sql("s.supplier_name") + """ IN (SELECT k FROM gkeys WHERE k IS NOT NULL))
                IS TRUE AS is_sanctioned
         FROM gsup s)"""


def bfs_sql(seed_sql: str, levels: int | None = None) -> str:
    """Levels of a breadth-first search from the seed, to any depth: the
    recursion keeps one row per node (its first level)."""
    stop = f" AND b.d < {levels}" if levels is not None else ""
    return f"""gbfs(node, d) USING KEY (node) AS (
  SELECT DISTINCT node, 0 AS d FROM ({seed_sql})
  UNION
  SELECT a.nbr, min(b.d + 1) FROM gbfs b JOIN gadj a ON a.node = b.node
  WHERE a.nbr NOT IN (SELECT node FROM recurring.gbfs){stop} GROUP BY a.nbr),
gdist AS (SELECT node, d FROM gbfs)"""


@register("edges", GRAPH_CTE + """
SELECT src, dst, awards_count, ROUND(total_amount, 6) AS total_amount FROM ge""")
def q_edges(spark, sf_dir):
    _, e = graph_parts(spark, sf_dir)
    return rounded(e)


@register("degree", GRAPH_CTE + """
SELECT node, COUNT(*) AS degree FROM gadj GROUP BY node""")
def q_degree(spark, sf_dir):
    _, e = graph_parts(spark, sf_dir)
    return gr.degree(e)


@register("sanction_match", GRAPH_CTE + """
SELECT id, supplier_name, is_sanctioned FROM gsan""")
def q_sanction_match(spark, sf_dir):
    v, _ = graph_parts(spark, sf_dir)
    return gr.sanctioned_suppliers(v, sanctions_df(spark, sf_dir)).select(
        "id", "supplier_name", "is_sanctioned")


@register("distance_to_sanctioned", GRAPH_CTE + ",\n" + bfs_sql(
    "SELECT id AS node FROM gsan WHERE is_sanctioned") + """
SELECT s.id AS supplier_id, CAST(d.d AS BIGINT) AS distance_to_sanctioned
FROM gsan s LEFT JOIN gdist d ON s.id = d.node""")
def q_distance_to_sanctioned(spark, sf_dir):
    v, e = graph_parts(spark, sf_dir, materialize=True)
    sup = cut_lineage(gr.sanctioned_suppliers(v, sanctions_df(spark, sf_dir)))  # a row per supplier, read twice
    dist = gr.distance_to(e, sup.filter("is_sanctioned").select(F.col("id").alias("node")))
    return sup.join(dist.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias("supplier_id"), F.col("dist").cast("long").alias("distance_to_sanctioned"))


BETWEENNESS_LEVELS = 8  # of the SQL; the test graphs are at most five wide


@register("graph_metrics", GRAPH_CTE + ",\n" + bfs_sql(
    "SELECT id AS node FROM gsan WHERE is_sanctioned") + ",\n" + O.betweenness_sql(BETWEENNESS_LEVELS) + """,
gdeg AS (SELECT node, COUNT(*) AS degree FROM gadj GROUP BY node),
gn AS (SELECT CAST(COUNT(DISTINCT node) AS DOUBLE) AS n FROM gadj)
SELECT s.id AS supplier_id, s.supplier_name, CAST(g.degree AS BIGINT) AS degree,
       ROUND(COALESCE(b.delta, 0.0) / CASE WHEN n > 2 THEN (n - 1) * (n - 2) ELSE 1.0 END, 6) AS betweenness,
       CAST(d.d AS BIGINT) AS distance_to_sanctioned
FROM gsan s LEFT JOIN gdeg g ON s.id = g.node LEFT JOIN gdist d ON s.id = d.node LEFT JOIN gbet b ON s.id = b.node, gn""")
def q_graph_metrics(spark, sf_dir):
    """Degree, exact betweenness and distance of every supplier."""
    m = gr.graph_metrics(ad.tenders(spark, sf_dir), ad.awards(spark, sf_dir, keep_order=False),
                         sanctions_df(spark, sf_dir))
    return rounded(m.drop("node"))


EGO_NODE = "1"


@register("ego_edges", GRAPH_CTE + ",\n" + bfs_sql(f"SELECT '{EGO_NODE}' AS node", 2) + """
SELECT src, dst, awards_count, ROUND(total_amount, 6) AS total_amount FROM ge
WHERE src IN (SELECT node FROM gdist) AND dst IN (SELECT node FROM gdist)""")
def q_ego_edges(spark, sf_dir):
    _, e = graph_parts(spark, sf_dir)
    return rounded(gr.ego_edges(e, EGO_NODE, 2))


@register("betweenness", GRAPH_CTE + ",\n" + O.betweenness_sql(BETWEENNESS_LEVELS) + """,
gn AS (SELECT CAST(COUNT(DISTINCT node) AS DOUBLE) AS n FROM gadj)
SELECT s.id AS supplier_id, ROUND(COALESCE(b.delta, 0.0) / ((n - 1) * (n - 2)), 6) AS betweenness
FROM gsup s LEFT JOIN gbet b ON s.id = b.node, gn""")
def q_betweenness(spark, sf_dir):
    """Exact normalised betweenness of every supplier."""
    v, e = graph_parts(spark, sf_dir, materialize=True)
    bt = gr.betweenness(v, e)
    sup = v.filter(F.col("bipartite") == "supplier").select(F.col("id").alias("node"), "supplier_id")
    return rounded(sup.join(bt, "node", "left").select("supplier_id", "betweenness"))


# --------------------------------------------------------------- OCDS ingestion

from bidlens.sources import ocds  # noqa: E402


def releases_df(spark, sf_dir, fields=None):
    txt = ad.releases_json(spark, sf_dir)
    return ocds.parse_releases(txt, "value", jsonl=True, order=F.col("release_order"), fields=fields)


RELEASE_ROWS_CTE = """
rel_x AS (
  SELECT l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice,
         l.l_returnflag, l.l_linestatus, o.o_orderdate, o.o_orderstatus, o.o_orderpriority, o.o_totalprice,
         c.c_custkey, c.c_name, s.s_suppkey, s.s_name, n.n_name, p.p_brand, p.p_type,
         'ocds-' || CAST(l.l_orderkey AS VARCHAR) AS ocid
  FROM lineitem l
  LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
  LEFT JOIN customer c ON o.o_custkey = c.c_custkey
  LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
  LEFT JOIN nation n ON s.s_nationkey = n.n_nationkey
  LEFT JOIN part p ON l.l_partkey = p.p_partkey
),
rel_tid_x AS (
  SELECT r.*, CASE WHEN o_orderstatus <> 'P' THEN 'T-' || CAST(l_orderkey AS VARCHAR)
                   ELSE ocid || '-tender' END AS tender_id,
         CASE WHEN l_returnflag = 'A' THEN substr(sha1(COALESCE(NULLIF(s_name, ''), 'unknown') || '|' || ocid), 1, 16)
              ELSE CAST(s_suppkey AS VARCHAR) END AS supplier_id
  FROM rel_x r
)"""


@register("tenders", "WITH " + RELEASE_ROWS_CTE + """
SELECT tender_id, ocid, CAST(c_custkey AS VARCHAR) AS buyer_id, c_name AS buyer_name,
       o_orderpriority AS main_category, 'open' AS method, o_orderstatus AS status,
       ROUND(o_totalprice, 6) AS value_amount, 'USD' AS value_currency,
       NULLIF(array_to_string(list_sort(list_distinct(list_filter([p_brand, p_type, p_brand],
              lambda x: x IS NOT NULL AND x <> ''))), ';'), '') AS cpv_ids,
       strftime(o_orderdate, '%Y-%m-%dT%H:%M:%SZ') AS tender_date
FROM rel_tid_x""")
def q_tenders(spark, sf_dir):
    return rounded(ocds.tenders(releases_df(spark, sf_dir, ocds.TENDER_FIELDS)))


@register("awards", "WITH " + RELEASE_ROWS_CTE + """
SELECT CASE WHEN l_linenumber <> 1 THEN CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR)
            ELSE ocid || '-award-0000' END AS award_id,
       ocid, tender_id, supplier_id, s_name AS supplier_name, ROUND(l_extendedprice, 6) AS amount,
       'USD' AS currency, strftime(l_shipdate, '%Y-%m-%dT%H:%M:%SZ') AS date, l_linestatus AS status
FROM rel_tid_x""")
def q_awards(spark, sf_dir):
    return rounded(ocds.awards(releases_df(spark, sf_dir, ocds.AWARD_FIELDS)))


@register("suppliers", "WITH " + RELEASE_ROWS_CTE + """,
cand AS (
  SELECT supplier_id, s_name AS name, CASE WHEN l_returnflag = 'A' THEN NULL ELSE n_name END AS country,
         0 AS phase, """ + O.AWARD_ORDER_SQL + """ FROM rel_tid_x
  UNION ALL
  SELECT CAST(s_suppkey AS VARCHAR), s_name, n_name, 1, """ + O.AWARD_ORDER_SQL + """ FROM rel_tid_x
)
SELECT supplier_id, name, country FROM (
  SELECT cand.*, ROW_NUMBER() OVER (PARTITION BY supplier_id ORDER BY """ + O.AWARD_ORDER_SQL + """, phase) AS rn
  FROM cand) WHERE rn = 1""")
def q_suppliers(spark, sf_dir):
    return ocds.suppliers(releases_df(spark, sf_dir, ocds.SUPPLIER_FIELDS))


# --------------------------------------------------------------- batch scoring

ROW_KEY_SQL = """concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), CAST(l_partkey AS VARCHAR),
                   CAST(l_suppkey AS VARCHAR),
                   CAST(date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS VARCHAR),
                   CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR))"""

REQUESTS_CTE = """
req_x AS (
  SELECT """ + ROW_KEY_SQL + """ AS input_row_id,
         CASE WHEN l_quantity < 2 THEN ''
              WHEN l_quantity > 49 THEN CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-x'
              ELSE CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) END AS award_id,
         CASE WHEN l_linenumber = 2 THEN CAST(l_suppkey AS VARCHAR) END AS supplier_id
  FROM lineitem
),
breq_x AS (
  SELECT r.input_row_id, r.award_id, COALESCE(r.supplier_id, f.supplier_id) AS supplier_id,
         f.award_concentration_by_buyer, f.repeat_winner_ratio, f.amount_zscore_by_category,
         f.near_threshold_flag, f.time_to_award_days,
         CASE WHEN r.award_id IS NULL OR trim(r.award_id) = '' THEN '""" + scoring.ERR_BLANK + """'
              WHEN f.award_id IS NULL THEN '""" + scoring.ERR_NOT_FOUND + """' END AS error
  FROM req_x r LEFT JOIN features_x f ON r.award_id = f.award_id
)"""


from bidlens.functions.scoring import HEURISTIC_FACTORS  # noqa: E402


def requests_df(spark, sf_dir):
    return ad.requests(spark, sf_dir)


def factor_names(col="top_factors"):
    return F.array_join(F.transform(col, lambda f: f["name"]), ",")


def factor_values(n, col="top_factors"):
    """f1_value, f1_contribution, ... of the first n factors."""
    return [F.get(F.col(col), i)[x].alias(f"f{i + 1}_{x}") for i in range(n) for x in ("value", "contribution")]


FACTOR_ROWS_CTE = """
fx AS (
  SELECT input_row_id, f.name, f.value, f.contribution, f.pos FROM (
    SELECT input_row_id, unnest([""" + ", ".join(
        f"{{'name': '{c}', 'value': COALESCE(CAST({c} AS DOUBLE), 0.0), "
        f"'contribution': ({w!r}) * COALESCE(CAST({c} AS DOUBLE), 0.0), 'pos': {i}}}"
        for i, (c, w) in enumerate(zip(FIXED_MODEL.feature_cols, FIXED_MODEL.coef))) + """]) AS f
    FROM breq_x WHERE error IS NULL)
),
fr AS (SELECT input_row_id, name, value, contribution,
              ROW_NUMBER() OVER (PARTITION BY input_row_id ORDER BY abs(contribution) DESC, pos) AS rk FROM fx)"""


@register("score_batch", "WITH " + O.FEATURE_ROWS_CTE + "," + REQUESTS_CTE + """
SELECT input_row_id, award_id, supplier_id,
       CASE WHEN error IS NULL THEN """ + HEUR_SQL + """ END AS risk_score,
       CASE WHEN error IS NULL THEN """ + O.band_sql(HEUR_SQL) + """ END AS risk_band,
       CASE WHEN error IS NULL THEN '""" + ",".join(HEURISTIC_FACTORS) + """' ELSE '' END AS factor_names,
       """ + ", ".join(f"CASE WHEN error IS NULL THEN ROUND(CAST({c} AS DOUBLE), 6) END AS f{i + 1}_value, "
                       f"CAST(NULL AS DOUBLE) AS f{i + 1}_contribution" for i, c in enumerate(HEURISTIC_FACTORS)) + """,
       error
FROM breq_x""")
def q_score_batch(spark, sf_dir):
    out = scoring.score_batch(requests_df(spark, sf_dir), features_df(spark, sf_dir, stored=True), dedupe_features=False)
    return rounded(out.select("input_row_id", "award_id", "supplier_id", "risk_score", "risk_band",
                              factor_names().alias("factor_names"), *factor_values(5), "error"))


@register("score_batch_model", "WITH " + O.FEATURE_ROWS_CTE + "," + REQUESTS_CTE + """,
""" + FACTOR_ROWS_CTE + """,
fn AS (SELECT input_row_id, string_agg(name, ',' ORDER BY rk) AS names, """ + ", ".join(
        f"max(CASE WHEN rk = {i} THEN ROUND({x}, 6) END) AS f{i}_{x}" for i in (1, 2, 3) for x in ("value", "contribution")) + """
       FROM fr WHERE rk <= 3 GROUP BY input_row_id)
SELECT b.input_row_id, b.award_id, b.supplier_id,
       CASE WHEN error IS NULL THEN ROUND(GREATEST(0.0, LEAST(1.0, """ + linear_sql(FIXED_MODEL) + """)), 6) END
       AS risk_score,
       CASE WHEN error IS NULL THEN """ + O.band_sql("GREATEST(0.0, LEAST(1.0, " + linear_sql(FIXED_MODEL) + "))",
                                                     0.2, 0.5) + """ END AS risk_band,
       COALESCE(fn.names, '') AS factor_names, f1_value, f1_contribution, f2_value, f2_contribution,
       f3_value, f3_contribution, error
FROM breq_x b LEFT JOIN fn ON b.input_row_id = fn.input_row_id""")
def q_score_batch_model(spark, sf_dir):
    out = scoring.score_batch(requests_df(spark, sf_dir), features_df(spark, sf_dir, stored=True),
                              model=FIXED_MODEL, explain=True, top_k=3, dedupe_features=False)
    return rounded(out.select("input_row_id", "award_id", "supplier_id", "risk_score", "risk_band",
                              factor_names().alias("factor_names"), *factor_values(3), "error"))


@register("validate_batch", "WITH " + O.FEATURE_ROWS_CTE + "," + REQUESTS_CTE + """
SELECT input_row_id, award_id, supplier_id, error IS NULL AS valid, error FROM (
  SELECT r.input_row_id, r.award_id, r.supplier_id,
         CASE WHEN r.award_id IS NULL OR trim(r.award_id) = '' THEN '""" + scoring.ERR_BLANK + """'
              WHEN r.award_id NOT IN (SELECT award_id FROM features_x WHERE award_id IS NOT NULL)
              THEN '""" + scoring.ERR_NOT_FOUND + """' END AS error
  FROM req_x r)""")
def q_validate_batch(spark, sf_dir):
    return scoring.validate_batch(requests_df(spark, sf_dir), features_df(spark, sf_dir, stored=True), unique_ids=True)


# --------------------------------------------------------------- projects, pages, media

from bidlens.operators import record_score as rec  # noqa: E402
from bidlens.operators import report as rep  # noqa: E402
from bidlens.operators import runlog as rl  # noqa: E402
from bidlens.sources import media as med  # noqa: E402
from bidlens.sources import pages as pg  # noqa: E402
from bidlens.sources import projects as prj  # noqa: E402


@register("projects", """
SELECT 'P' || lpad(CAST(event_id AS VARCHAR), 6, '0') AS id,
       event_type || ' project ' || CAST(event_id AS VARCHAR) AS project_name,
       upper(event_type) AS regionname,
       CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS countryshortname,
       CASE WHEN event_type <> 'error' THEN json_extract_string(props, '$.k') END AS countrycode,
       CASE WHEN value > 25 THEN 'Active' ELSE 'Closed' END AS projectstatusdisplay,
       CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS totalcommamt,
       CAST(CAST(round(value * 100) AS BIGINT) AS VARCHAR) AS totalamt,
       CAST(year(ts) AS VARCHAR) AS approvalfy,
       strftime(ts, '%B') AS board_approval_month,
       strftime(ts, '%Y-%m-%d %H:%M:%S') AS p2a_updated_date
FROM events""")
def q_projects(spark, sf_dir):
    recs = prj.page_records(ad.project_pages(spark, sf_dir), "value", "offset")
    return prj.normalize_projects(recs)


# Suffixes and keywords for the link-ranking check (the test
# pages hold no spreadsheet links, so the check ranks word links instead).
LINK_SUFFIXES = ("en", "er", "es", "in")
LINK_KEYWORDS = ("the", "de", "en", "ie")


def _link_sql() -> str:
    score = " + ".join(f"(CASE WHEN contains(lower(href), '{k}') THEN 1 ELSE 0 END)" for k in LINK_KEYWORDS)
    ends = " OR ".join(f"lower(href) LIKE '%{s}'" for s in LINK_SUFFIXES)
    origin = "regexp_extract(base, '^([A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*)', 1)"
    return f"""
WITH h AS (SELECT page_id, url AS base,
                  unnest(regexp_extract_all(html, '(?i)href=["'']([^"'']+)["'']', 1)) AS href
           FROM pages),
c AS (SELECT page_id, {score} AS score,
             CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN href
                  WHEN href LIKE '/%' THEN {origin} || href
                  ELSE regexp_replace(regexp_replace(base, '[?#].*$', ''), '/[^/]*$', '/') || href END AS url
      FROM h WHERE {ends})
SELECT page_id, url, CAST(score AS INTEGER) AS score FROM (
  SELECT c.*, ROW_NUMBER() OVER (PARTITION BY page_id ORDER BY score DESC, url) AS rn FROM c)
WHERE rn = 1"""


@register("page_links", _link_sql())
def q_page_links(spark, sf_dir):
    return pg.page_links(ad.table(spark, sf_dir, "pages"), LINK_SUFFIXES, LINK_KEYWORDS)


MEDIA_CTE = """
mi_x AS (
  SELECT doc_id AS payload_id, 0 AS item_no, n_chars,
         NULLIF(regexp_extract(text, '([A-Z][a-z]+)', 1), '') AS entity, source AS allegation_type,
         CAST(NULL AS VARCHAR) AS date, lang AS location,
         CASE WHEN lang = 'de' THEN 'news.example.org/' || CAST(doc_id AS VARCHAR)
              ELSE 'https://news.example.org/a/' || CAST(doc_id AS VARCHAR) END AS source_url,
         n_chars / 10000.0 AS confidence, CAST(NULL AS VARCHAR) AS snippet
  FROM documents
),
mv_x AS (
  SELECT * FROM mi_x WHERE n_chars >= 50 AND entity IS NOT NULL AND allegation_type IS NOT NULL
    AND (confidence BETWEEN 0 AND 1) AND regexp_matches(source_url, '^https?://[^\\s/?#]+[^\\s]*$')
)"""


@register("media_valid", "WITH " + MEDIA_CTE + """
SELECT payload_id, CAST(item_no AS INTEGER) AS item_no, entity, allegation_type, date, location,
       source_url, ROUND(confidence, 6) AS confidence, snippet FROM mv_x""")
def q_media_valid(spark, sf_dir):
    valid, _ = med.validate_media(ad.media_payloads(spark, sf_dir))
    return rounded(valid)


@register("media_rejects", "WITH " + MEDIA_CTE + """
SELECT payload_id, CAST(CASE WHEN n_chars < 50 THEN NULL ELSE 0 END AS INTEGER) AS item_no,
       CAST(CASE WHEN n_chars < 50 THEN 1 ELSE
         (entity IS NULL)::INT + (confidence > 1)::INT
         + (NOT regexp_matches(source_url, '^https?://[^\\s/?#]+[^\\s]*$'))::INT END AS INTEGER) AS n_errors
FROM mi_x
WHERE n_chars < 50 OR entity IS NULL OR confidence > 1
   OR NOT regexp_matches(source_url, '^https?://[^\\s/?#]+[^\\s]*$')""")
def q_media_rejects(spark, sf_dir):
    _, rej = med.validate_media(ad.media_payloads(spark, sf_dir))
    return rej.select("payload_id", "item_no", F.size("errors").cast("int").alias("n_errors"))


@register("media_hits", "WITH " + MEDIA_CTE + """
SELECT """ + name_key_sql("entity") + """ AS name_key, COUNT(*) AS adverse_media_count
FROM mv_x WHERE """ + name_key_sql("entity") + """ IS NOT NULL GROUP BY 1""")
def q_media_hits(spark, sf_dir):
    valid, _ = med.validate_media(ad.media_payloads(spark, sf_dir))
    return med.media_hits(valid)


@register("demo_score", "WITH " + O.AWARDS_CTE + "," + SANCTIONS_SQL_CTE + "," + MEDIA_CTE + """,
keys AS (SELECT DISTINCT """ + name_key_sql("name") + """ AS k FROM sanctions_x),
hits AS (SELECT """ + name_key_sql("entity") + """ AS k, COUNT(*) AS n FROM mv_x GROUP BY 1),
sig AS (SELECT supplier_id, COUNT(award_id) AS past, min(""" + name_key_sql("supplier_name") + """) AS k
        FROM awards_x GROUP BY supplier_id),
sig2 AS (SELECT s.supplier_id, s.past, (s.k IN (SELECT k FROM keys WHERE k IS NOT NULL)) IS TRUE AS sanctioned,
                COALESCE(h.n, 0) AS media
         FROM sig s LEFT JOIN hits h ON s.k = h.k)
SELECT a.award_id, a.supplier_id,
       ROUND(0.45 * (CASE WHEN sanctioned THEN 1.0 ELSE 0.0 END) + 0.25 * LEAST(1.0, media / 5.0)
             + 0.2 * LEAST(1.0, past / 10.0) + 0.1 * LEAST(1.0, COALESCE(a.amount, 0.0) / 1000000.0), 4)
       AS risk_score
FROM awards_x a LEFT JOIN sig2 ON a.supplier_id = sig2.supplier_id""")
def q_demo_score(spark, sf_dir):
    aw = ad.awards(spark, sf_dir, keep_order=False)
    valid, _ = med.validate_media(ad.media_payloads(spark, sf_dir))
    sig = rec.supplier_signals(aw, sanctions_df(spark, sf_dir), med.media_hits(valid))
    return rec.score_awards(aw, sig).select("award_id", "supplier_id", "risk_score")


# --------------------------------------------------------------- reports, run log

@register("flat_factors", "WITH " + O.FEATURE_ROWS_CTE + "," + REQUESTS_CTE + """,
""" + FACTOR_ROWS_CTE + """
SELECT b.input_row_id,
       COALESCE(max(CASE WHEN rk = 1 THEN name END), '') AS top_factor_1_name,
       max(CASE WHEN rk = 1 THEN ROUND(value, 6) END) AS top_factor_1_value,
       COALESCE(max(CASE WHEN rk = 2 THEN name END), '') AS top_factor_2_name,
       max(CASE WHEN rk = 2 THEN ROUND(value, 6) END) AS top_factor_2_value
FROM breq_x b LEFT JOIN fr ON b.input_row_id = fr.input_row_id
GROUP BY b.input_row_id""")
def q_flat_factors(spark, sf_dir):
    out = scoring.score_batch(requests_df(spark, sf_dir), features_df(spark, sf_dir, stored=True),
                              model=FIXED_MODEL, explain=True, top_k=2, dedupe_features=False)
    flat = rep.flatten_factors(out.select("input_row_id", "top_factors"), width=2)
    # the export is text; the check compares the numbers in it
    return rounded(flat.select("input_row_id", "top_factor_1_name", "top_factor_2_name",
                               *[F.col(f"top_factor_{i}_value").try_cast("double").alias(f"top_factor_{i}_value")
                                 for i in (1, 2)]))


@register("band_filter", "WITH " + O.FEATURE_ROWS_CTE + """
SELECT award_id, risk_band FROM (SELECT award_id, """ + O.band_sql(HEUR_SQL) + """ AS risk_band FROM features_x)
WHERE risk_band IN ('high', 'medium')""")
def q_band_filter(spark, sf_dir):
    s = scoring.with_band(scoring.heuristic_score(features_df(spark, sf_dir)))
    return rep.band_filter(s, ["high", "medium"]).select("award_id", "risk_band")


@register("error_rows", "WITH " + O.FEATURE_ROWS_CTE + "," + REQUESTS_CTE + """
SELECT input_row_id, award_id, error FROM breq_x WHERE error IS NOT NULL AND error <> ''""")
def q_error_rows(spark, sf_dir):
    out = scoring.score_batch(requests_df(spark, sf_dir), features_df(spark, sf_dir, stored=True), dedupe_features=False)
    _, bad = rep.split_errors(out)
    return bad.select("input_row_id", "award_id", "error")


@register("runlog_rollup", """
SELECT '/v1/' || event_type AS endpoint, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS status,
       COUNT(*) AS requests, CAST(COALESCE(SUM(CAST(json_extract_string(props, '$.k') AS BIGINT)), 0) AS BIGINT) AS items,
       ROUND(AVG(CAST(round(value * 10) AS BIGINT)), 6) AS avg_ms, MAX(CAST(round(value * 10) AS BIGINT)) AS max_ms,
       """ + ", ".join(f"ROUND(quantile_cont(CAST(round(value * 10) AS BIGINT), {q}), 6) AS p{round(q * 100)}_ms"
                       for q in (0.5, 0.9, 0.99)) + """
FROM events GROUP BY 1, 2""")
def q_runlog_rollup(spark, sf_dir):
    r = rl.run_rollup(ad.run_log(spark, sf_dir))
    return rounded(r.select("endpoint", "status", "requests", "items", "avg_ms", "max_ms",
                            *[F.get("p50_p90_p99_ms", i).alias(f"p{q}_ms") for i, q in enumerate((50, 90, 99))]))


DATASETS = {"ocds_tenders": "orders", "ocds_awards": "lineitem", "wb_ineligible": "supplier",
            "features": "customer", "graph_metrics": "graph_metrics_missing"}


@register("dataset_status", " UNION ALL ".join(
    f"SELECT '{k}' AS dataset, (SELECT COUNT(*) FROM {v}) AS rows, true AS available" if not v.endswith("_missing")
    else f"SELECT '{k}' AS dataset, CAST(NULL AS BIGINT) AS rows, false AS available"
    for k, v in DATASETS.items()))
def q_dataset_status(spark, sf_dir):
    paths = {k: f"{sf_dir.rstrip('/')}/{v}.parquet" for k, v in DATASETS.items()}
    return rl.dataset_status(spark, paths).select("dataset", "rows", "available")


# --------------------------------------------------------------- request payloads

from bidlens.sources import requests as rq  # noqa: E402


@register("request_items", """
WITH p AS (
  SELECT """ + ROW_KEY_SQL.replace("l_", "l.l_") + """ AS payload_id,
         l.l_orderkey, l.l_linenumber, l.l_suppkey, l.l_quantity, o.o_orderstatus
  FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey
)
SELECT payload_id, CAST(0 AS BIGINT) AS input_row_id,
       CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) AS award_id,
       CAST(l_suppkey AS VARCHAR) AS supplier_id
FROM p WHERE l_quantity <= 48
UNION ALL
SELECT payload_id, CAST(1 AS BIGINT), NULL, NULL FROM p WHERE l_quantity <= 48 AND o_orderstatus = 'P'""")
def q_request_items(spark, sf_dir):
    return rq.parse_request_payloads(ad.request_payloads(spark, sf_dir))

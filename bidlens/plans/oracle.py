"""DuckDB SQL for the cross-check of every registered query.

The entity mappings of ``plans/adapters.py`` are repeated here as CTEs so
each oracle query reads the same base tables the Spark query reads.
Doubles are rounded to 6 places on both sides.
"""

from __future__ import annotations

from bidlens.operators.features import GENERIC_THRESHOLDS, NEAR_PCT

TENDERS_CTE = """
tenders_x AS (
  SELECT CAST(o.o_orderkey AS VARCHAR) AS tender_id,
         CAST(o.o_custkey AS VARCHAR) AS buyer_id,
         c.c_name AS buyer_name,
         o.o_orderpriority AS main_category,
         o.o_orderdate AS tender_date,
         o.o_totalprice AS value_amount,
         o.o_orderkey AS tender_pos
  FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey
)"""

AWARDS_CTE = """
awards_x AS (
  SELECT CAST(l.l_orderkey AS VARCHAR) || '-' || CAST(l.l_linenumber AS VARCHAR) AS award_id,
         CAST(l.l_orderkey AS VARCHAR) AS tender_id,
         CAST(l.l_suppkey AS VARCHAR) AS supplier_id,
         s.s_name AS supplier_name,
         l.l_extendedprice AS amount,
         l.l_shipdate AS award_date,
         l.l_orderkey, l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice
  FROM lineitem l LEFT JOIN supplier s ON l.l_suppkey = s.s_suppkey
)"""

AWARD_ORDER_SQL = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice"


def near_sql(col: str) -> str:
    parts = " OR ".join(
        f"({col} BETWEEN {(1 - NEAR_PCT) * t!r} AND {(1 + NEAR_PCT) * t!r})" for t in GENERIC_THRESHOLDS)
    return f"CASE WHEN {col} IS NOT NULL AND NOT isnan({col}) AND {col} > 0 AND ({parts}) THEN 1 ELSE 0 END"


def days_sql(later: str, earlier: str) -> str:
    d = (f"CAST(floor((epoch_us(CAST({later} AS TIMESTAMP)) - epoch_us(CAST({earlier} AS TIMESTAMP)))"
         f" / 86400000000.0) AS BIGINT)")
    return f"CAST(LEAST(GREATEST(COALESCE({d}, 0), 0), 3650) AS INTEGER)"


# joined award rows with every per-row feature (before keep-first)
FEATURE_ROWS_CTE = TENDERS_CTE + "," + AWARDS_CTE + """,
joined_x AS (
  SELECT a.*, t.buyer_name, t.main_category, t.tender_date, t.tender_pos
  FROM awards_x a LEFT JOIN tenders_x t ON a.tender_id IS NOT DISTINCT FROM t.tender_id
),
moments_x AS (
  SELECT j.*,
         COUNT(*) OVER (PARTITION BY buyer_name, supplier_id) AS pair_n,
         COUNT(*) OVER (PARTITION BY buyer_name) AS buyer_n,
         AVG(amount) OVER (PARTITION BY main_category) AS mu,
         STDDEV_POP(amount) OVER (PARTITION BY main_category) AS sd
  FROM joined_x j
),
rows_x AS (
  SELECT award_id, supplier_id, supplier_name, buyer_name, main_category, amount, tender_pos,
         """ + ", ".join(AWARD_ORDER_SQL.split(", ")) + """,
         COALESCE(CAST(pair_n AS DOUBLE) / NULLIF(buyer_n, 0), 0.0) AS award_concentration_by_buyer,
         COALESCE(CAST(pair_n AS DOUBLE) / NULLIF(buyer_n, 0), 0.0) AS repeat_winner_ratio,
         COALESCE((amount - mu) / NULLIF(sd, 0), 0.0) AS amount_zscore_by_category,
         """ + near_sql("amount") + """ AS near_threshold_flag,
         """ + days_sql("award_date", "tender_date") + """ AS time_to_award_days
  FROM moments_x
),
features_x AS (
  SELECT award_id, supplier_id, award_concentration_by_buyer, repeat_winner_ratio,
         amount_zscore_by_category, near_threshold_flag, time_to_award_days
  FROM (SELECT r.*, ROW_NUMBER() OVER (PARTITION BY award_id ORDER BY """ + AWARD_ORDER_SQL \
    + """, tender_pos) AS rn FROM rows_x r) WHERE rn = 1
)"""


# the same entities with missing, repeated and unknown tender ids
SHARED_CTE = (TENDERS_CTE.replace("tenders_x", "tenders_0") + "," + AWARDS_CTE.replace("awards_x", "awards_0") + """,
tenders_x AS (
  SELECT CASE WHEN tender_pos % 20 <> 0 THEN tender_id END AS tender_id, buyer_id, buyer_name, main_category,
         tender_date, value_amount, tender_pos * 2 AS tender_pos FROM tenders_0
  UNION ALL
  SELECT CASE WHEN tender_pos % 20 <> 0 THEN tender_id END, '2-' || buyer_id, 'Second ' || buyer_name, '9-COPY',
         tender_date, value_amount, tender_pos * 2 + 1 FROM tenders_0 WHERE tender_pos % 7 = 0
),
awards_x AS (
  SELECT * REPLACE (CASE WHEN l_orderkey % 20 = 0 THEN NULL WHEN l_orderkey % 23 = 0 THEN 'none-' || tender_id
                    ELSE tender_id END AS tender_id) FROM awards_0
)""")
SHARED_ROWS_CTE = SHARED_CTE + FEATURE_ROWS_CTE[len(TENDERS_CTE + "," + AWARDS_CTE):]


def heuristic_sql(near: str, repeat: str, z: str, conc: str) -> str:
    c01 = "GREATEST(0.0, LEAST(1.0, {}))"
    s = (f"0.4 * (CASE WHEN COALESCE({near}, 0) = 1 THEN 1.0 ELSE 0.0 END)"
         f" + 0.3 * COALESCE({repeat}, 0.0)"
         f" + 0.2 * {c01.format(f'COALESCE({z}, 0.0) / 3.0')}"
         f" + 0.1 * {c01.format(f'COALESCE({conc}, 0.0)')}")
    return f"ROUND({c01.format(s)}, 6)"


def band_sql(score: str, low: float = 0.33, med: float = 0.66) -> str:
    return (f"CASE WHEN {score} IS NULL THEN NULL WHEN {score} <= {low!r} THEN 'low' "
            f"WHEN {score} <= {med!r} THEN 'medium' ELSE 'high' END")


def newton_sql(rows: str, k: int, steps: int, ridge: float = 0.0) -> str:
    """CTEs that fit a logistic regression by Newton's method: ``rows`` names
    a relation with the inputs x1..x{k-1} and the target y in [0, 1]; x0 is
    the intercept, which the ridge leaves alone.  Every step sums gradient and
    Hessian over all rows and solves the k x k system by elimination.  The
    last relation is ``fit(w0, ..., w{k-1})``."""
    x = ["1.0"] + [f"x{i}" for i in range(1, k)]
    parts = ["n0 AS (SELECT " + ", ".join(f"CAST(0.0 AS DOUBLE) AS w{i}" for i in range(k)) + ")"]
    for s in range(1, steps + 1):
        z = " + ".join(f"w{i} * {x[i]}" for i in range(k))
        cols = [f"sum((p - y) * {x[i]})" + (f" + {ridge!r} * any_value(w{i})" if ridge and i else "") + f" AS b{i}"
                for i in range(k)]
        cols += [f"sum(p * (1 - p) * {x[i]} * {x[j]})" + (f" + {ridge!r}" if ridge and i == j and i else "") + f" AS a{i}_{j}"
                 for i in range(k) for j in range(k)]
        keep = ", ".join(f"any_value(w{i}) AS w{i}" for i in range(k))
        parts.append(f"p{s} AS (SELECT r.*, n.*, 1.0 / (1.0 + exp(-({z}))) AS p FROM {rows} r, n{s - 1} n)")
        parts.append(f"e{s}_0 AS (SELECT {keep}, {', '.join(cols)} FROM p{s})")
        for c in range(k):  # eliminate column c from the rows below and above
            out = []
            for i in range(k):
                f = f"a{i}_{c} / a{c}_{c}"
                out += [f"a{i}_{j}" + (f" - {f} * a{c}_{j}" if i != c else "") + f" AS a{i}_{j}" for j in range(k)]
                out.append(f"b{i}" + (f" - {f} * b{c}" if i != c else "") + f" AS b{i}")
            parts.append(f"e{s}_{c + 1} AS (SELECT {', '.join(f'w{i}' for i in range(k))}, {', '.join(out)} FROM e{s}_{c})")
        parts.append(f"n{s} AS MATERIALIZED (SELECT " + ", ".join(f"w{i} - b{i} / a{i}_{i} AS w{i}" for i in range(k))
                     + f" FROM e{s}_{k})")
    parts.append(f"fit AS (SELECT * FROM n{steps})")
    return ",\n".join(parts)


def betweenness_sql(levels: int) -> str:
    """CTEs for Brandes' sums over the adjacency ``gadj(node, nbr)``: path
    counts level by level from every source, then the dependencies back;
    ``gbet(node, delta)``.  ``levels`` must reach the graph's diameter."""
    parts = ["b0 AS (SELECT DISTINCT node AS s, node AS v, CAST(1.0 AS DOUBLE) AS sigma FROM gadj)"]
    for i in range(1, levels + 1):
        seen = " ".join(f"AND NOT EXISTS (SELECT 1 FROM b{j} q WHERE q.s = p.s AND q.v = a.nbr)" for j in range(max(0, i - 2), i))
        parts.append(f"b{i} AS MATERIALIZED (SELECT p.s, a.nbr AS v, sum(p.sigma) AS sigma FROM b{i - 1} p "
                     f"JOIN gadj a ON a.node = p.v WHERE true {seen} GROUP BY p.s, a.nbr)")
    parts.append(f"d{levels} AS (SELECT s, v, sigma, CAST(0.0 AS DOUBLE) AS delta FROM b{levels})")
    for i in range(levels - 1, 0, -1):
        parts.append(f"c{i} AS (SELECT w.s, a.node AS v, sum((1 + w.delta) / w.sigma) AS c FROM d{i + 1} w "
                     f"JOIN gadj a ON a.nbr = w.v GROUP BY 1, 2)")
        parts.append(f"d{i} AS MATERIALIZED (SELECT p.s, p.v, p.sigma, p.sigma * COALESCE(c.c, 0) AS delta FROM b{i} p "
                     f"LEFT JOIN c{i} c ON p.s = c.s AND p.v = c.v)")
    both = " UNION ALL ".join(f"SELECT v, delta FROM d{i}" for i in range(1, levels + 1))
    parts.append(f"gbet AS (SELECT v AS node, sum(delta) AS delta FROM ({both}) GROUP BY v)")
    return ",\n".join(parts)

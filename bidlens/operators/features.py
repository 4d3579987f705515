"""Award-level risk features (one row per award_id).

Awards join tenders on ``tender_id``, null matching null, and duplicate ids
on both sides multiply.  The multiplied rows are never made:

* Each id's tenders fold to one row (the first tender by a partial
  ``min(struct)``, the number of tenders) that the awards join once.  If an
  id's tenders agree in buyer and category, as a lone one does, its awards
  count with that number as weight.
* Ids whose tenders differ (missing ids, mostly) fold on both sides, awards
  to (id, supplier) and tenders to (id, buyer, category), each with a
  multiplicity; counts, sums and sums of squares of the join are products of
  the folded ones.  Buyer totals and category moments need as many rows as
  tender groups.  Pair counts of ids with many groups on both sides are
  looked up for the pairs the feature table asks for, not multiplied out.

Group statistics are *not* windows: a window over ``main_category`` would
put all rows of a category (there are a handful) into one task.  AQE turns
joins of a small measured side into broadcast joins and splits skewed ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlens.functions.common import (broadcast_if_few, ensure_columns, keep_first, null_safe_on, num_or_null,
                                      product_join)
from bidlens.functions.dates import elapsed_days, parse_timestamp
from bidlens.functions.text import strip
from bidlens.session import cut_lineage, stored

# Procurement thresholds and the ±window around them.
GENERIC_THRESHOLDS = [10_000, 50_000, 250_000, 1_000_000]
NEAR_PCT = 0.05
MAX_DAYS = 3650
SHARED = 64  # suppliers and tender groups from which a tender id is looked up, not multiplied out

FEATURE_COLS = [
    "award_concentration_by_buyer",
    "repeat_winner_ratio",
    "amount_zscore_by_category",
    "near_threshold_flag",
    "time_to_award_days",
]

FEATURES_SCHEMA = [
    ("award_id", "string"),
    ("supplier_id", "string"),
    ("award_concentration_by_buyer", "double"),
    ("repeat_winner_ratio", "double"),
    ("amount_zscore_by_category", "double"),
    ("near_threshold_flag", "int"),
    ("time_to_award_days", "int"),
]


def near_threshold(amount: Column, thresholds: Sequence[float] = GENERIC_THRESHOLDS,
                   pct: float = NEAR_PCT) -> Column:
    """1 when ``amount`` lies within ±pct of any threshold (inclusive);
    null, NaN and amounts ≤ 0 give 0."""
    hit = F.lit(False)
    for t in thresholds:
        hit = hit | amount.between(F.lit((1 - pct) * t), F.lit((1 + pct) * t))
    ok = amount.isNotNull() & ~F.isnan(amount) & (amount > 0)
    return F.when(ok & hit, 1).otherwise(0).cast("int")


def time_to_award(award_ts: Column, tender_ts: Column, max_days: int = MAX_DAYS) -> Column:
    """Whole days from tender to award; negative → 0, null → 0, capped."""
    d = F.coalesce(elapsed_days(award_ts, tender_ts), F.lit(0))
    return F.least(F.greatest(d, F.lit(0)), F.lit(max_days)).cast("int")


def zscore(x: Column, mu: Column, sd: Column) -> Column:
    """(x − μ)/σ; σ = 0 or null → 0; null x → 0."""
    return F.coalesce((x - mu) / F.when(sd != 0, sd), F.lit(0.0))


def clean_awards(awards: DataFrame) -> DataFrame:
    a = ensure_columns(awards, {"award_id": "string", "tender_id": "string",
                                "supplier_id": "string", "supplier_name": "string",
                                "amount": "double", "date": "string"})
    return a.select(
        "*",
        strip(F.col("supplier_id").cast("string")).alias("__supplier_id"),
        num_or_null(F.col("amount")).alias("__amount"),
        parse_timestamp(a, "date").alias("__award_ts"),
    )


def clean_tenders(tenders: DataFrame) -> DataFrame:
    t = ensure_columns(tenders, {"tender_id": "string", "buyer_name": "string",
                                 "main_category": "string", "tender_date": "string"})
    return t.select(
        F.col("tender_id"),
        strip(F.col("buyer_name").cast("string")).alias("__buyer_name"),
        strip(F.col("main_category").cast("string")).alias("__category"),
        parse_timestamp(t, "tender_date").alias("__tender_ts"),
        *([F.col("__tender_pos")] if "__tender_pos" in t.columns else []),
    )


def joined_awards(tenders: DataFrame, awards: DataFrame, dedupe_tenders: bool = False,
                  tender_order: Sequence[str] | None = None) -> DataFrame:
    """awards ⟕ tenders on tender_id, null matching null (pandas merge).

    Duplicate tender_ids fan out the award rows (reference behaviour) unless
    ``dedupe_tenders`` keeps the first tender per id (``tender_order``)."""
    t = clean_tenders(tenders)
    if dedupe_tenders:
        if tender_order:
            order = list(tender_order)
        elif "__tender_pos" in t.columns:
            order = ["__tender_pos"]
        else:
            order = ["__buyer_name", "__category", "__tender_ts"]
        t = keep_first(t, "tender_id", order)
    t = t.withColumnRenamed("tender_id", "__t_tender_id")
    a = clean_awards(awards)
    return a.join(t, a["tender_id"].eqNullSafe(t["__t_tender_id"]), "left")


def concentration(rows: DataFrame) -> DataFrame:
    """Per (buyer_name, supplier_id): pair count, buyer total and share.

    Both counts are partial aggregations; null keys form their own group."""
    pair = rows.groupBy("__buyer_name", "__supplier_id").agg(F.count(F.lit(1)).alias("awards_by_pair"))
    buyer = rows.groupBy("__buyer_name").agg(F.count(F.lit(1)).alias("awards_by_buyer"))
    j = pair.join(buyer, null_safe_on(pair, buyer, ["__buyer_name"]), "left").select(
        pair["__buyer_name"], pair["__supplier_id"], "awards_by_pair", "awards_by_buyer")
    share = F.coalesce(F.col("awards_by_pair") / F.when(F.col("awards_by_buyer") != 0,
                                                        F.col("awards_by_buyer")), F.lit(0.0))
    return j.withColumn("share", share)


def category_moments(rows: DataFrame) -> DataFrame:
    """Mean and population std of amount per main_category (null = a group)."""
    return rows.groupBy("__category").agg(
        F.count("__amount").alias("n_amount"),
        F.avg("__amount").alias("mean_amount"),
        F.stddev_pop("__amount").alias("std_amount"),
    )


def award_feature_rows(tenders: DataFrame, awards: DataFrame, thresholds=GENERIC_THRESHOLDS,
                       pct: float = NEAR_PCT, dedupe_tenders: bool = False,
                       keep: Sequence[str] = (), materialize: bool = False) -> DataFrame:
    """Feature values for every joined award row (before the keep-first).

    The joined rows feed four consumers (pair counts, buyer totals, category
    moments and the row output).  With ``materialize`` the narrow projection
    of the join is checkpointed once to the shared checkpoint folder, so the
    awards ⋈ tenders shuffle runs once instead of once per consumer, and the
    lineage of the later joins starts there."""
    rows = joined_awards(tenders, awards, dedupe_tenders)
    cols = ["award_id", *keep, "__supplier_id", "__buyer_name", "__category", "__amount",
            "__award_ts", "__tender_ts"] + (["__tender_pos"] if "__tender_pos" in rows.columns else [])
    rows = rows.select(*dict.fromkeys(cols))
    if materialize:
        rows = cut_lineage(rows)
    conc = concentration(rows).select(
        F.col("__buyer_name").alias("__cb"), F.col("__supplier_id").alias("__cs"), "share")
    cat = category_moments(rows).withColumnRenamed("__category", "__cc")
    j = (rows.join(conc, rows["__buyer_name"].eqNullSafe(conc["__cb"])
                   & rows["__supplier_id"].eqNullSafe(conc["__cs"]), "left")
             .join(cat, rows["__category"].eqNullSafe(cat["__cc"]), "left"))
    conc_col = F.coalesce(F.col("share"), F.lit(0.0))
    return j.select(
        "*",
        conc_col.alias("award_concentration_by_buyer"),
        conc_col.alias("repeat_winner_ratio"),
        zscore(F.col("__amount"), F.col("mean_amount"), F.col("std_amount"))
        .alias("amount_zscore_by_category"),
        near_threshold(F.col("__amount"), thresholds, pct).alias("near_threshold_flag"),
        time_to_award(F.col("__award_ts"), F.col("__tender_ts")).alias("time_to_award_days"),
    )


def _sums(x: Column, m: Column) -> list[Column]:
    """Rows n, amounts k, their sum s, sum of squares q, least and greatest."""
    return [F.sum(m).alias("n"), F.sum(F.when(x.isNotNull(), m)).alias("k"), F.sum(x * m).alias("s"),
            F.sum(x * x * m).alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi")]


def _added(m: Column | None = None) -> list[Column]:
    """The same over rows that hold such sums, each counted ``m`` times."""
    m = F.lit(1) if m is None else m
    return [F.sum(F.col(c) * m).alias(c) for c in ("n", "k", "s", "q")] + [F.min("lo").alias("lo"), F.max("hi").alias("hi")]


class JoinedAwards:
    """Awards with the first tender of their id, and the folded groups of the
    ids whose tenders differ.  With ``materialize`` the joined rows are
    stored once, as several aggregates read some of their columns, and groups that turn
    out to be empty are left out of the plan."""

    def __init__(self, tenders: DataFrame, awards: DataFrame, keep: Sequence[str] = (), dedupe_tenders: bool = False,
                 tender_order: Sequence[str] | None = None, materialize: bool = True):
        t, a = clean_tenders(tenders), clean_awards(awards)
        if dedupe_tenders:
            t = keep_first(t, "tender_id", tender_order or (
                ["__tender_pos"] if "__tender_pos" in t.columns else ["__buyer_name", "__category", "__tender_ts"]))
        pos = F.col("__tender_pos") if "__tender_pos" in t.columns else F.lit(0)
        group = F.struct("__buyer_name", "__category")
        first = t.groupBy(F.col("tender_id").alias("__tid")).agg(
            F.min(F.struct(pos.alias("pos"), "__buyer_name", "__category", "__tender_ts")).alias("f"),
            F.count(F.lit(1)).alias("__m"), (F.min(group) != F.max(group)).alias("__differ"))
        self.rows = a.join(first, F.col("tender_id").eqNullSafe(F.col("__tid")), "left").select(
            *dict.fromkeys(["award_id", *keep]), "tender_id", "__supplier_id", "__amount", "__award_ts",
            *[F.col(f"f.{c}").alias(c) for c in ("__buyer_name", "__category", "__tender_ts")],
            F.coalesce("__m", F.lit(1)).alias("__m"), F.coalesce("__differ", F.lit(False)).alias("__differ"))
        some = True
        if materialize:
            self.rows = stored(self.rows)
            some = not self.rows.where("__differ").isEmpty()
        self.plain = self.rows.where(~F.col("__differ"))
        self.by_award = self.by_tender = None
        if some:
            shared = self.rows.where("__differ")
            self.by_award = shared.groupBy("tender_id", "__supplier_id").agg(*_sums(F.col("__amount"), F.lit(1)))
            ids = first.where("__differ").select(F.col("__tid").alias("__shared"))
            self.by_tender = (t.join(ids, F.col("tender_id").eqNullSafe(F.col("__shared")), "left_semi")
                              .groupBy(F.col("tender_id").alias("__tid"), "__buyer_name", "__category")
                              .agg(F.count(F.lit(1)).alias("m")))

    def _by_group(self) -> DataFrame:
        """Awards of each shared id x its tender groups."""
        a = self.by_award.groupBy("tender_id").agg(*_added())
        return a.join(self.by_tender, F.col("tender_id").eqNullSafe(F.col("__tid")))

    def buyer_totals(self) -> DataFrame:
        out = self.plain.groupBy("__buyer_name").agg(F.sum("__m").alias("awards_by_buyer"))
        if self.by_award is None:
            return out
        more = self._by_group().groupBy("__buyer_name").agg(F.sum(F.col("n") * F.col("m")).alias("awards_by_buyer"))
        return out.unionByName(more).groupBy("__buyer_name").agg(F.sum("awards_by_buyer").alias("awards_by_buyer"))

    def moments(self) -> DataFrame:
        """Mean and population deviation per category; equal amounts deviate by
        exactly 0."""
        out = self.plain.groupBy("__category").agg(*_sums(F.col("__amount"), F.col("__m")))
        if self.by_award is not None:
            more = self._by_group().groupBy("__category").agg(*_added(F.col("m")))
            out = out.unionByName(more).groupBy("__category").agg(*_added())
        k = F.coalesce("k", F.lit(0))
        same = F.col("lo") == F.col("hi")
        mean = F.when(same, F.col("lo")).otherwise(F.try_divide("s", k))
        sd = F.when(same, F.lit(0.0)).otherwise(F.sqrt(F.greatest(F.try_divide("q", k) - mean * mean, F.lit(0.0))))
        return out.select("__category", k.alias("n_amount"), mean.alias("mean_amount"), sd.alias("std_amount"))

    def pairs(self, wanted: DataFrame | None = None, shared: int = 0) -> DataFrame:
        """Awards of each (buyer, supplier): all pairs, or at least those in
        ``wanted``, for which ids with ``shared`` or more suppliers and groups
        are looked up instead of multiplied out."""
        out = self.plain.groupBy("__buyer_name", "__supplier_id").agg(F.sum("__m").alias("awards_by_pair"))
        if self.by_award is None:
            return out
        a = self.by_award.select("tender_id", "__supplier_id", "n")
        t = self.by_tender.groupBy("__tid", "__buyer_name").agg(F.sum("m").alias("m"))
        n = F.sum(F.col("n") * F.col("m")).alias("awards_by_pair")
        if wanted is not None:
            many_t = t.groupBy("__tid").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= shared)
            many_a = a.groupBy("tender_id").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= shared)
            wide = many_a.join(many_t, F.col("tender_id").eqNullSafe(F.col("__tid"))).select(F.col("tender_id").alias("__w"))
            is_wide = F.col("tender_id").eqNullSafe(F.col("__w"))
            heavy_a = a.join(wide, is_wide, "left_semi").withColumnRenamed("__supplier_id", "__hs")
            heavy_t = t.withColumnRenamed("__buyer_name", "__hb")
            heavy = (wanted.join(heavy_a, F.col("__supplier_id").eqNullSafe(F.col("__hs")))
                     .join(heavy_t, F.col("tender_id").eqNullSafe(F.col("__tid")) & F.col("__buyer_name").eqNullSafe(F.col("__hb")))
                     .groupBy("__buyer_name", "__supplier_id").agg(n))
            out, a = out.unionByName(heavy), a.join(wide, is_wide, "left_anti")
        light = (product_join(a, t, "tender_id", "__tid", "__supplier_id") if wanted is None  # all pairs of a wide id
                 else a.join(t, F.col("tender_id").eqNullSafe(F.col("__tid")))).groupBy("__buyer_name", "__supplier_id").agg(n)
        return out.unionByName(light).groupBy("__buyer_name", "__supplier_id").agg(
            F.sum("awards_by_pair").alias("awards_by_pair"))


def category_totals(tenders: DataFrame, awards: DataFrame, materialize: bool = True) -> DataFrame:
    """``category_moments`` of the join, without making it."""
    return JoinedAwards(tenders, awards, materialize=materialize).moments()


def concentration_totals(tenders: DataFrame, awards: DataFrame, materialize: bool = True) -> DataFrame:
    """``concentration`` of the join (every pair is a row of the result)."""
    joined = JoinedAwards(tenders, awards, materialize=materialize)
    buyer = joined.buyer_totals().withColumnRenamed("__buyer_name", "__b")
    return (joined.pairs().join(buyer, F.col("__buyer_name").eqNullSafe(F.col("__b")), "left").drop("__b")
            .withColumn("share", F.coalesce(F.try_divide("awards_by_pair", "awards_by_buyer"), F.lit(0.0))))


def build_features(tenders: DataFrame, awards: DataFrame, order_key: Sequence[str],
                   thresholds=GENERIC_THRESHOLDS, pct: float = NEAR_PCT,
                   dedupe_tenders: bool = False, materialize: bool = True, shared: int = SHARED) -> DataFrame:
    """Feature table keyed by award_id (FEA-01).

    ``order_key`` names award columns that give the input order; the first
    award row per award_id in that order is kept (``drop_duplicates``), with
    the first tender of its id (``__tender_pos`` if present, else by value).
    Shares and z-scores count every joined row, without making them.

    By default the awards with their first tender are stored as Parquet, as the
    table and three aggregates read them, and so are the pair counts; the
    category moments are checkpointed; the rest is a lazy plan, which the
    feature job writes once as Parquet for every later job.
    ``materialize=False`` keeps all of it lazy.
    """
    order = [c for c in order_key if c != "award_id"]
    joined = JoinedAwards(tenders, awards, order, dedupe_tenders, materialize=materialize)
    rows = joined.rows.select("award_id", *[F.col(c).alias(f"__ord{i}") for i, c in enumerate(order)],
                              "__supplier_id", "__amount", "__award_ts", "__buyer_name", "__category", "__tender_ts")
    cat = joined.moments().withColumnRenamed("__category", "__cc")
    at = [f"__ord{i}" for i in range(len(order))]

    def first_rows(df: DataFrame) -> DataFrame:
        return keep_first(df, "award_id", at or ["award_id"])

    def with_own_values(df: DataFrame, *more: str) -> DataFrame:
        return df.join(cat, F.col("__category").eqNullSafe(F.col("__cc")), "left").select(
            "award_id", "__supplier_id", "__buyer_name", *more,
            zscore(F.col("__amount"), F.col("mean_amount"), F.col("std_amount")).alias("amount_zscore_by_category"),
            near_threshold(F.col("__amount"), thresholds, pct).alias("near_threshold_flag"),
            time_to_award(F.col("__award_ts"), F.col("__tender_ts")).alias("time_to_award_days"))

    if materialize:  # few categories, known before the rows are shuffled, which then carry three numbers
        cat = broadcast_if_few(cut_lineage(cat))
        kept = first_rows(with_own_values(rows, *at))
    else:
        kept = first_rows(rows)
    asking = rows if materialize else kept  # stored rows ask for no fewer pairs, without the shuffle for the first ones
    wanted = asking.select("__buyer_name", "__supplier_id").distinct() if joined.by_award is not None else None
    pair = joined.pairs(wanted, shared).select(
        F.col("__buyer_name").alias("__pb"), F.col("__supplier_id").alias("__ps"), "awards_by_pair")
    buyer = joined.buyer_totals().withColumnRenamed("__buyer_name", "__bb")

    def with_buyers(df: DataFrame, name: str) -> DataFrame:
        return df.join(buyer, F.col(name).eqNullSafe(F.col("__bb")), "left").drop("__bb")

    if materialize:  # counts of a job of its own: its shuffle files are gone when the rows are shuffled, and once for both counts
        pair = stored(with_buyers(pair, "__pb"))
    j = kept.join(pair, F.col("__buyer_name").eqNullSafe(F.col("__pb"))
                  & F.col("__supplier_id").eqNullSafe(F.col("__ps")), "left")
    if not materialize:
        j = with_own_values(with_buyers(j, "__buyer_name"), "awards_by_pair", "awards_by_buyer")
    share = F.coalesce(F.try_divide("awards_by_pair", "awards_by_buyer"), F.lit(0.0))
    out = j.select("award_id", F.col("__supplier_id").alias("supplier_id"),
                   share.alias("award_concentration_by_buyer"), share.alias("repeat_winner_ratio"),
                   "amount_zscore_by_category", "near_threshold_flag", "time_to_award_days")
    return out.select([F.col(n).cast(t).alias(n) for n, t in FEATURES_SCHEMA])

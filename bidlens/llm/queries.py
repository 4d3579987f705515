"""Registered queries of the corpus operators: each applies its operator with
production parameters to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlens.llm import (capfilters, decontam, katz, langid, linededup, merkle, mixing, periodic, piecebpe, pii,
                         quality, sharding, simhash)
from bidlens.llm.common import held_out, id_crc, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn
    return deco


@register("op1_simhash_vp_tree")
def op1(spark, sf_dir):
    return (simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_bits=2)
            .select("doc_id", simhash.fingerprint_hex().alias("fingerprint"), "component_id"))


@register("op2_katz_backoff")
def op2(spark, sf_dir):
    return katz.katz_scores(table(spark, sf_dir, "documents"), held=held_out("doc_id", 7, 2))


@register("op3_ppm_language_id")
def op3(spark, sf_dir):
    return langid.identify(table(spark, sf_dir, "documents")).select(
        "doc_id", held_out("doc_id", 5, 0).alias("held_out"), "lang_pred", "score")


@register("op4_weak_supervision_pii")
def op4(spark, sf_dir):
    return pii.find_personal_data(table(spark, sf_dir, "documents"))


@register("op5_spherical_cap_filters")
def op5(spark, sf_dir):
    return capfilters.near_vectors(table(spark, sf_dir, "embeddings"), min_cosine=0.93)


@register("op6_sampled_splitters")
def op6(spark, sf_dir):
    return (sharding.shard(table(spark, sf_dir, "documents"), 24)
            .select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                    F.lit(None).cast("int").alias("grown_shard")))


OP7_SQL = r"""
WITH l AS (SELECT doc_id, i, string_split(coalesce(text, ''), chr(10))[i] AS line FROM
             (SELECT doc_id, text, unnest(range(1, len(string_split(coalesce(text, ''), chr(10))) + 1)) AS i FROM documents)),
k AS (SELECT doc_id, i, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
             'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10)
SELECT doc_id, count(*) AS n_lines, count(f.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE f.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN f ON k.key = f.key GROUP BY doc_id"""


@register("op7_line_dedup_mph", OP7_SQL)
def op7(spark, sf_dir):
    return linededup.dedup_lines(table(spark, sf_dir, "documents"), min_docs=10).select(
        "doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@register("op8_random_indexing_quality")
def op8(spark, sf_dir):
    scored = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score",
                         (F.col("score") >= 0.3).cast("int").alias("predicted"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, source,
             len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight,
             (source_size * 3)::DOUBLE AS cap, sum(source_size) OVER ()::DOUBLE AS total FROM s),
l AS (SELECT *, cap / weight AS ratio,
             (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, max(CASE WHEN level <= ratio THEN level END) OVER () * weight) AS target FROM l),
q AS (SELECT d.doc_id, d.source, d.size, t.source_size, t.target, md5('mix:' || d.doc_id::VARCHAR) AS key,
             sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix:' || d.doc_id::VARCHAR), d.doc_id) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT q.*, k, (k * source_size + cum)::DOUBLE / target AS finish
      FROM q, (SELECT unnest([0, 1, 2]) AS k) WHERE size > 0),
g AS (SELECT *, sum(size) OVER (ORDER BY finish, source, key, doc_id, k
                                ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS used FROM c),
n AS (SELECT doc_id, count(*) AS copies FROM g WHERE used <= (SELECT sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.source_size, q.target, (q.size * coalesce(n.copies, 0))::BIGINT AS taken
FROM q LEFT JOIN n ON q.doc_id = n.doc_id"""


@register("op9_weighted_fair_queueing", OP9_SQL)
def op9(spark, sf_dir):
    return (mixing.mix_report(table(spark, sf_dir, "documents"))
            .select("doc_id", "size", "source_size", "target", "taken"))


@register("op10_spaced_seed_decontamination")
def op10(spark, sf_dir):
    return decontam.contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH RECURSIVE framed AS (
  SELECT *, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') || coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS head,
         translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low,
         4294967295 - list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
             string_split(coalesce(doc_id::VARCHAR, ''), ''),
             lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
           lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS crc FROM documents),
d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
             row_number() OVER () AS rid, count(*) OVER (PARTITION BY source) AS n
      FROM (SELECT doc_id, source, sha256(head || coalesce(strlen(text) || ':' || text, '-')) AS leaf,
                   sha256(head || coalesce(strlen(low) || ':' || low, '-')) AS lowered, crc FROM framed)),
t(source, lvl, pos, h, n) AS (
  SELECT source, 0, pos, leaf, n FROM d
  UNION ALL
  SELECT source, lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 15) // 16
  FROM t WHERE n > 1 GROUP BY source, lvl, pos // 16),
r AS (SELECT source, lvl AS depth, h AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos,
             count(*) OVER () AS n FROM t WHERE n = 1),
u(lvl, pos, h, n) AS (
  SELECT 0, pos, subroot, n FROM r
  UNION ALL
  SELECT lvl + 1, pos // 16, sha256(string_agg(h, '' ORDER BY pos)), (max(n) + 15) // 16
  FROM u WHERE n > 1 GROUP BY lvl, pos // 16),
steps AS (
  SELECT rid, t.lvl AS step,
         coalesce(string_agg(h, '' ORDER BY t.pos) FILTER (t.pos < d.pos // pow(16, t.lvl)::BIGINT), '') AS lft,
         coalesce(string_agg(h, '' ORDER BY t.pos) FILTER (t.pos > d.pos // pow(16, t.lvl)::BIGINT), '') AS rgt
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source AND t.n > 1
               AND t.pos // 16 = d.pos // pow(16, t.lvl + 1)::BIGINT GROUP BY rid, t.lvl
  UNION ALL
  SELECT rid, depth + u.lvl,
         coalesce(string_agg(h, '' ORDER BY u.pos) FILTER (u.pos < r.pos // pow(16, u.lvl)::BIGINT), ''),
         coalesce(string_agg(h, '' ORDER BY u.pos) FILTER (u.pos > r.pos // pow(16, u.lvl)::BIGINT), '')
  FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
         JOIN u ON u.n > 1 AND u.pos // 16 = r.pos // pow(16, u.lvl + 1)::BIGINT GROUP BY rid, depth, u.lvl),
proofs AS (SELECT rid, string_agg(lft || rgt, '' ORDER BY step) AS proof FROM steps GROUP BY rid),
f(rid, step, h) AS (
  SELECT rid, 0, CASE WHEN crc % 5 = 0 THEN lowered ELSE leaf END FROM d
  UNION ALL
  SELECT f.rid, f.step + 1, sha256(lft || f.h || rgt) FROM f JOIN steps ON f.rid = steps.rid AND f.step = steps.step),
e AS (SELECT rid, arg_max(h, step) AS folded_root FROM f GROUP BY rid)
SELECT d.doc_id, d.leaf, r.subroot, u.h AS root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root,
       folded_root = u.h AS verified
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source JOIN u ON u.n = 1 JOIN e ON d.rid = e.rid
LEFT JOIN proofs ON d.rid = proofs.rid"""


@register("op11_merkle_manifest", OP11_SQL)
def op11(spark, sf_dir):
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    lowered = merkle.leaf(*fields, F.translate("text", upper, upper.lower()))
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", "source", merkle.leaf(*fields, F.col("text")).alias("leaf"),
        F.when(id_crc() % F.lit(5) == 0, lowered).alias("claimed"))
    return merkle.manifest(docs, claimed_col="claimed").select(
        "doc_id", "leaf", "subroot", "root",
        F.sha2(F.lower(F.array_join(F.transform("proof", F.hex), "")).cast("binary"), 256).alias("proof_sha256"),
        "folded_root", "verified")


@register("op12_piece_bpe")
def op12(spark, sf_dir):
    import public_tokenizers
    rows = piecebpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"),
                           public_tokenizers.path("piece_bpe_32k.model"), decoded_col="decoded")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                       F.sha2(F.array_join("ids", ",").cast("binary"), 256).alias("ids_sha256"),
                       F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@register("op13_recompression_runs")
def op13(spark, sf_dir):
    found = periodic.periodic_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), plant_by=id_crc())
    runs = F.arrays_zip(F.col("run_start").alias("start"), F.col("run_length").alias("length"),
                        F.col("run_period").alias("period"))
    rows = found.select("doc_id", "collapsed", runs.alias("runs"), F.array_max(F.transform(
        runs, lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"),
                                 (-r["period"]).alias("period")))).alias("top"))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return rows.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.start")).alias("start"),
        F.col("top.length").alias("length"), (-F.col("top.period")).alias("period"),
        F.expr("1000 * top.length div -top.period").alias("exponent_milli"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))

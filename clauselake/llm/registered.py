"""The queries and oracle SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clauselake.llm import decontaminate, filter_audit, hard_negatives, hidden_markov, language_crf, mixing, near_dedup, neighbours, quality, sanitize, substrings, suffixes, toxicity

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(build: Query) -> Query:
    QUERIES[build.__name__] = build
    return build


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


@query
def op4_cube_mix(spark, sf):
    mixed = mixing.mix_sources(table(spark, sf, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query
def op3_decontaminate(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    judged = decontaminate.judge(docs, table(spark, sf, "benchmark"))
    return judged.select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "item_ids"), 256).alias("items_sha256"), "contaminated",
    )


ORACLES["op3_decontaminate"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
  FROM documents),
b AS (
  SELECT item_id, w, least(len(w), 13) AS k FROM (
    SELECT item_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w
    FROM benchmark) WHERE len(w) > 0),
g AS (SELECT DISTINCT item_id, k, w[i : i + k - 1] AS gram FROM (SELECT item_id, k, w, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
p AS (SELECT rid, k, i, w[i : i + k - 1] AS gram FROM (
        SELECT rid, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM g) WHERE len(w) >= k)),
h AS (SELECT p.rid, p.i, p.k, g.item_id FROM p JOIN g ON p.gram = g.gram AND p.k = g.k),
c AS (SELECT rid, count(DISTINCT j) AS n_hit FROM (SELECT rid, unnest(range(i, i + k)) AS j FROM (SELECT DISTINCT rid, i, k FROM h)) GROUP BY rid),
m AS (SELECT rid, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
      FROM (SELECT DISTINCT rid, item_id FROM h) GROUP BY rid)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(c.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(m.ids, '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN c USING (rid) LEFT JOIN m USING (rid)
"""


@query
def op5_disclosure(spark, sf):
    found = sanitize.find_spans(table(spark, sf, "documents").select("doc_id", "text"))
    counts = [F.coalesce(F.size(kind), F.lit(0)).cast("long").alias(f"n_{kind}") for kind in sanitize.PATTERNS]
    return found.select(
        "doc_id", *counts, F.sha2(sanitize.span_list(list(sanitize.PATTERNS)), 256).alias("base_sha256"),
        sanitize.span_list(sanitize.KINDS).alias("spans"),
    )


@query
def op2_rabin_karp(spark, sf):
    left = substrings.remove_repeated_windows(table(spark, sf, "documents"))
    return left.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLES["op2_rabin_karp"] = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER () AS rid,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
p AS (SELECT doc_id, rid, i, w[i : i + 19] AS gram FROM (SELECT doc_id, rid, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20)),
r AS (SELECT rid, i FROM (
        SELECT rid, i, rank() OVER (PARTITION BY gram ORDER BY doc_id, i) AS k FROM p) WHERE k > 1),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS j FROM r),
k AS (SELECT rid, list(j) AS gone FROM c GROUP BY rid),
o AS (SELECT d.doc_id, d.w, coalesce(k.gone, []) AS gone FROM d LEFT JOIN k USING (rid))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(gone) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN len(gone) = 0 THEN w
         ELSE [x.v FOR x IN list_transform(w, lambda v, i: {'v': v, 'i': i}) IF NOT list_contains(gone, x.i)] END, ' ')) AS kept_sha256
FROM o
"""


@query
def op8_suffix_merge(spark, sf):
    left = suffixes.remove_repeated_bytes(table(spark, sf, "documents"))
    return left.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


@query
def op9_kmeans_tree(spark, sf):
    return neighbours.nearest(table(spark, sf, "embeddings"))


@query
def op7_baum_welch(spark, sf):
    learn = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) != 1
    return hidden_markov.score_documents(table(spark, sf, "documents"), learn)


@query
def op1_crf_language(spark, sf):
    docs = table(spark, sf, "documents")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    return language_crf.identify(docs, remainder != 2, remainder == 2).select("doc_id", "held_out", "lang_pred", "score")


@query
def op6_kneser_ney(spark, sf):
    return quality.judge(table(spark, sf, "documents"), table(spark, sf, "labels"))[0]


@query
def op10_order_minhash(spark, sf):
    found = near_dedup.near_duplicates(table(spark, sf, "documents"))
    return found.select("doc_id", "class_id", "shingles", "kept")


@query
def op11_filter_diagrams(spark, sf):
    return filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


ORACLES["op11_filter_diagrams"] = r"""
WITH d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS text,
         coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
l AS (SELECT doc_id, coalesce(max(quality = 1), false) AS good, coalesce(max(toxic = 1), false) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT d.part, coalesce(l.good, false) AS good, coalesce(l.toxic, false) AS toxic, {
         'A': len(w) < 200, 'B': 100 * len(list_distinct(w)) < 50 * len(w),
         'C': 100 * len(regexp_extract_all(text, '[A-Z]')) > 2 * length(text), 'D': regexp_matches(text, '[#$%&*|]'),
         'E': coalesce(d.doc_id > min(d.doc_id) OVER (PARTITION BY text), false)} AS f
  FROM d LEFT JOIN l USING (doc_id)),
c AS (SELECT part, f, count(*) AS n, count(*) FILTER (good) AS good, count(*) FILTER (toxic) AS toxic FROM m GROUP BY part, f),
e AS (SELECT part, [x.k FOR x IN [{'k': 'A', 'v': f.A}, {'k': 'B', 'v': f.B}, {'k': 'C', 'v': f.C}, {'k': 'D', 'v': f.D}, {'k': 'E', 'v': f.E}] IF x.v] AS failed,
             n, good, toxic FROM c),
k AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.x, b.x, c.x, d.x, e.x] AS seq
      FROM k a, k b, k c, k d, k e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, seq, unnest(range(1, 6)) AS step FROM o),
t AS (
  SELECT part, filter_order, step, seq[step] AS x,
         sum(CASE WHEN NOT list_has_any(failed, seq[1:step]) THEN n ELSE 0 END) AS kept,
         sum(CASE WHEN list_contains(failed, seq[step]) AND NOT list_has_any(failed, seq[1:step - 1]) THEN n ELSE 0 END) AS removed,
         sum(CASE WHEN list_contains(failed, seq[step]) AND list_has_any(failed, seq[1:step - 1]) THEN n ELSE 0 END) AS redundant,
         sum(CASE WHEN failed = [seq[step]] THEN n ELSE 0 END) AS unique_fails,
         sum(CASE WHEN list_contains(failed, seq[step]) AND NOT list_has_any(failed, seq[1:step - 1]) THEN good ELSE 0 END) AS good_lost,
         sum(CASE WHEN list_contains(failed, seq[step]) AND NOT list_has_any(failed, seq[1:step - 1]) THEN toxic ELSE 0 END) AS toxic_lost
  FROM e, s GROUP BY part, filter_order, step, seq[step])
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
       CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
       CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, x) AS BIGINT) AS shapley
FROM t
"""


@query
def op13_noisy_channel(spark, sf):
    docs = table(spark, sf, "documents")
    remainder = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4))
    scored = toxicity.score_documents(docs, table(spark, sf, "labels"), remainder != 2)
    return scored.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "score", "predicted")


@query
def op12_shared_lists(spark, sf):
    return hard_negatives.mine(table(spark, sf, "embeddings"))


ORACLES["op12_shared_lists"] = r"""
WITH e AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.id AS anchor_id, e.id, a.label = e.label AS same, CAST(list_dot_product(a.v, e.v) AS BIGINT) AS score
      FROM e a, e WHERE a.id % 50 = 0 AND a.id <> e.id),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
      QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) AS INTEGER) AS rank,
       id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, id) <= 3
"""

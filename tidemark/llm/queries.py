"""One registered query per operator, over the whole ``documents`` table, with
production parameters; DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import (
    bpe, exact_dedup, filter_audit, labelled, language_id, license_scan, near_dedup, packing, quality_classifier,
    quality_rules, sharding, subword_lm, target_resampling, toxicity)
from tidemark.llm.common import ascii_lower, fold, table

SHARDS = 8
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def _query(f):
    QUERIES[f.__name__] = f
    return f


# --- 1: toxicity ------------------------------------------------------------

@_query
def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 3) == 1
    sample = labelled.sample(docs, table(spark, sf_dir, "labels"), "toxic", ~held_out)
    return toxicity.score(docs, toxicity.fit(sample)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


# --- 2: language identification ---------------------------------------------

@_query
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 4) == 2
    return language_id.predict(docs, language_id.fit(docs.where(~held_out))).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score")


# --- 3: quality rules -------------------------------------------------------

BASE_STATISTICS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


@_query
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return (quality_rules.cascade(table(spark, sf_dir, "documents"), statistics=BASE_STATISTICS)
            .select("doc_id", *BASE_STATISTICS, base.alias("base_failed"), "kept"))


ORACLE_SQL["op3_quality_rules"] = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws FROM d),
win AS (SELECT doc_id, k, ws[k] || chr(10) || ws[k + 1] || chr(10) || ws[k + 2] AS g
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS k FROM w)),
rep AS (SELECT doc_id, k FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
cov AS (SELECT doc_id, count(DISTINCT k + o) AS n FROM rep, (SELECT unnest([0, 1, 2]) AS o) GROUP BY 1),
lin AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l FROM d),
dup AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n
        FROM lin WHERE regexp_matches(l, '[^\x20\x09-\x0D]') GROUP BY 1),
s AS (SELECT w.doc_id, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars,
             length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
             coalesce(dup.n_lines, 0) AS n_lines, coalesce(dup.n, 0) AS n_dup_lines,
             coalesce(cov.n, 0) AS n_repeat_words
      FROM w LEFT JOIN dup ON dup.doc_id = w.doc_id LEFT JOIN cov ON cov.doc_id = w.doc_id),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars,
       CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
       CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
       NOT base_failed AND 100 * n_symbols <= 25 * n_words AND 100 * n_dup_lines <= 60 * n_lines
       AND word_chars BETWEEN 2 * n_words AND 15 * n_words AS kept
FROM b
"""


# --- 4: language-model scores -----------------------------------------------

@_query
def op4_subword_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 1
    vocabulary = subword_lm.read_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))
    model = subword_lm.fit(docs.where(~held_out), vocabulary)
    return subword_lm.score(docs, model).withColumn("held_out", held_out).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")


# --- 5: quality classifier --------------------------------------------------

@_query
def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held_out = table(spark, sf_dir, "documents"), fold(F.col("doc_id"), 5) == 0
    sample = labelled.sample(docs, table(spark, sf_dir, "labels"), "quality", ~held_out)
    return quality_classifier.score(docs, quality_classifier.fit(sample)).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


# --- 6: near duplicates -----------------------------------------------------

@_query
def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


ORACLE_SQL["op6_near_dedup"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(ws[k:k + least(3, len(ws)) - 1], ' ') AS s
       FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 2, 1) + 1)) AS k FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
both_in AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i
            FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_in JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b
         WHERE 100 * i >= 85 * (x.n + y.n - i)),
reach AS (SELECT a, b FROM link UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b),
c AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(w.doc_id, coalesce(c.m, w.doc_id)) AS component_id,
       w.doc_id = least(w.doc_id, coalesce(c.m, w.doc_id)) AS kept
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN c ON c.doc_id = w.doc_id
"""


# --- 7: exact duplicates ----------------------------------------------------

@_query
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"), keep="largest")


ORACLE_SQL["op7_exact_dedup"] = """
WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                    'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM n
"""


# --- 8: packing -------------------------------------------------------------

@_query
def op8_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal texts (after lower-casing A-Z) are one duplicate cluster."""
    docs = table(spark, sf_dir, "documents").withColumn(
        "cluster", F.md5(ascii_lower(F.coalesce(F.col("text"), F.lit("")))))
    return packing.pack(docs, cluster_col="cluster")


# --- 9: sharding ------------------------------------------------------------

@_query
def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    even = [1.0] * SHARDS
    return sharding.shard(table(spark, sf_dir, "documents"), even, grown=[*even, 1.0]).select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


# --- 10: byte-level BPE -----------------------------------------------------

@_query
def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(spark, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    ids = bpe.encode(table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)
    return bpe.decode(ids, ranks).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


# --- 11: filter interactions ------------------------------------------------

@_query
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = filter_audit.statistics(table(spark, sf_dir, "documents"))
    failed = filter_audit.failures(rows, table(spark, sf_dir, "labels"))
    return filter_audit.audit(failed, "ABCDE")


ORACLE_SQL["op11_filter_audit"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
l AS (SELECT doc_id, max(quality) = 1 AS good, max(toxic) = 1 AS toxic FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic,
             (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
             + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT
             + 8 * regexp_matches(t, '[#$%&*|]')::INT
             + 16 * (d.doc_id > min(d.doc_id) OVER (PARTITION BY t))::INT AS failed
      FROM d LEFT JOIN l ON l.doc_id = d.doc_id),
c AS (SELECT part, failed, count(*) AS n, count(*) FILTER (WHERE good) AS g, count(*) FILTER (WHERE toxic) AS x
      FROM f GROUP BY 1, 2),
o AS (SELECT '' AS filter_order UNION ALL
      SELECT filter_order || k FROM o, unnest(['A', 'B', 'C', 'D', 'E']) AS u(k)
      WHERE instr(filter_order, k) = 0),
s AS (SELECT filter_order, step, substr(filter_order, step, 1) AS k, substr(filter_order, 1, step - 1) AS earlier
      FROM o, range(1, 6) AS r(step) WHERE length(filter_order) = 5),
b AS (SELECT filter_order, step, 1 << (instr('ABCDE', k) - 1) AS bit,
             coalesce(list_sum([1 << (instr('ABCDE', e) - 1) FOR e IN string_split(earlier, '') IF e <> '']), 0) AS before
      FROM s)
SELECT part, filter_order, CAST(step AS INTEGER) AS step,
       CAST(sum(n) FILTER (WHERE failed & (before::INT | bit::INT) = 0) AS BIGINT) AS kept,
       CAST(sum(n) FILTER (WHERE failed & bit::INT <> 0 AND failed & before::INT = 0) AS BIGINT) AS removed,
       CAST(sum(n) FILTER (WHERE failed & bit::INT <> 0 AND failed & before::INT <> 0) AS BIGINT) AS redundant,
       CAST(sum(n) FILTER (WHERE failed = bit::INT) AS BIGINT) AS unique_fails,
       CAST(sum(g) FILTER (WHERE failed & bit::INT <> 0 AND failed & before::INT = 0) AS BIGINT) AS good_lost,
       CAST(sum(x) FILTER (WHERE failed & bit::INT <> 0 AND failed & before::INT = 0) AS BIGINT) AS toxic_lost,
       CAST(sum(n * 120 // nullif(bit_count(failed), 0)) FILTER (WHERE failed & bit::INT <> 0) AS BIGINT) AS shapley
FROM c, b GROUP BY part, filter_order, step
"""
# Sums over no rows are 0.
ORACLE_SQL["op11_filter_audit"] = (
    "SELECT part, filter_order, step, " + ", ".join(
        f"coalesce({n}, 0) AS {n}" for n in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost",
                                             "shapley"))
    + f" FROM ({ORACLE_SQL['op11_filter_audit']}) AS audit")


# --- 12: licences -----------------------------------------------------------

@_query
def op12_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda p: p["base"])
    starts = F.transform(base, lambda p: p["first"])

    def labels(places):
        return F.array_join(F.array_sort(F.array_distinct(F.transform(places, lambda p: p["label"]))), ",")

    return found.select(
        "doc_id", "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"), labels(base).alias("base_labels"), labels(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda p: p["share"])), F.lit(0.0)).alias("score"))


# --- 13: resampling towards the benchmark -----------------------------------

@_query
def op13_target_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = target_resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")

"""The queries opN_* of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voxelore.llm import attention_lm, audio, exact_dedup, html_text, licenses, line_dedup, mixing, packing, simhash, toxicity
from voxelore.llm.text import in_fold


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scores = toxicity.score(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))
    return scores.select("doc_id", (in_fold(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


#: Weights in the mixing tree that differ from 1.
MIX_WEIGHTS = {"domain": {"domain0": 2.0}, "lang": {"en": 3.0}}


def mix_levels() -> dict:
    return {"domain": mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mixing.select_mix(_read(spark, sf_dir, "documents"), mix_levels(), MIX_WEIGHTS)
    return rows.select(F.col("id").alias("doc_id"), "domain", "lang", "source", "n_tokens", "epoch", "budget")


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.page_texts(_read(spark, sf_dir, "pages"))


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_read(spark, sf_dir, "documents"))


def op5_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.audio_features(_read(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(_read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


def op7_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = attention_lm.lm_scores(_read(spark, sf_dir, "documents"))
    held = (in_fold(F.col("doc_id"), attention_lm.FOLDS) == 0).alias("held_out")
    return rows.select("doc_id", held, "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = line_dedup.dedup_lines(_read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_lines", "n_dropped", exact_dedup.sha256(F.col("kept_text")).alias("kept_sha256"))


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_groups(_read(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return licenses.scan(docs, licenses.train(spark, docs))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_toxicity, op2_source_mixing, op3_html_text, op4_best_fit_packing, op5_audio_features, op6_exact_dedup, op7_attention_lm, op8_line_dedup, op9_simhash, op10_license_scan,
    )}


_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLE_SQL = {
    "op2_source_mixing": """
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                          'domain' || (coalesce(try_cast(nullif(regexp_extract(source, '([0-9]{1,9})$', 1), '') AS bigint), 0) % 4) AS domain,
                          len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) + 1 AS n_tokens FROM documents),
             leaf AS (SELECT domain, lang, source, sum(n_tokens)::bigint AS tokens, sum(n_tokens)::double * 2 AS cap FROM d GROUP BY ALL),
             root AS (SELECT least(floor(sum(tokens) * 0.5::double), sum(cap)) AS given FROM leaf),
             k1 AS (SELECT domain, sum(cap) AS cap, CASE domain WHEN 'domain0' THEN 2.0::double ELSE 1.0::double END AS w FROM leaf GROUP BY domain),
             a1 AS (SELECT *, given - coalesce(sum(cap) OVER (ORDER BY cap / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                           sum(w) OVER (ORDER BY cap / w, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM k1, root),
             b1 AS (SELECT *, CASE WHEN rest < cap / w * open_w THEN rest / open_w END AS lvl FROM a1),
             g1 AS (SELECT domain, CASE WHEN lvl IS NULL THEN cap ELSE max(lvl) OVER () * w END AS given FROM b1),
             k2 AS (SELECT domain, lang, sum(cap) AS cap, CASE lang WHEN 'en' THEN 3.0::double ELSE 1.0::double END AS w FROM leaf GROUP BY domain, lang),
             a2 AS (SELECT *, given - coalesce(sum(cap) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                           sum(w) OVER (PARTITION BY domain ORDER BY cap / w, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open_w FROM k2 JOIN g1 USING (domain)),
             b2 AS (SELECT *, CASE WHEN rest < cap / w * open_w THEN rest / open_w END AS lvl FROM a2),
             g2 AS (SELECT domain, lang, CASE WHEN lvl IS NULL THEN cap ELSE max(lvl) OVER (PARTITION BY domain) * w END AS given FROM b2),
             a3 AS (SELECT *, given - coalesce(sum(cap) OVER (PARTITION BY domain, lang ORDER BY cap, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
                           (count(*) OVER (PARTITION BY domain, lang ORDER BY cap, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::double AS open_w
                    FROM leaf JOIN g2 USING (domain, lang)),
             b3 AS (SELECT *, CASE WHEN rest < cap * open_w THEN rest / open_w END AS lvl FROM a3),
             g3 AS (SELECT domain, lang, source, tokens, floor(CASE WHEN lvl IS NULL THEN cap ELSE max(lvl) OVER (PARTITION BY domain, lang) END + 1e-6::double)::bigint AS budget FROM b3),
             r AS (SELECT d.*, budget, budget // tokens AS whole, budget % tokens AS rest FROM d JOIN g3 USING (domain, lang, source)),
             p AS (SELECT *, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('11|' || whole || '|' || doc_id), doc_id) AS upto FROM r WHERE rest > 0)
        SELECT doc_id, domain, lang, source, n_tokens, unnest(range(whole)) AS epoch, budget FROM r
        UNION ALL SELECT doc_id, domain, lang, source, n_tokens, whole AS epoch, budget FROM p WHERE upto <= rest""",
    "op6_exact_dedup": f"""
        WITH d AS (SELECT doc_id, sha256({_LOWER.format("coalesce(text, '')")}) AS text_sha256 FROM documents),
             g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, text_sha256
        FROM d JOIN g USING (text_sha256)""",
    "op8_line_dedup": f"""
        WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                          generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
             k AS (SELECT *, {_LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key FROM l),
             c AS (SELECT key, max(doc_id) AS keep_id FROM k WHERE length(key) >= 20
                   GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
             m AS (SELECT k.doc_id, pos, line, c.keep_id IS NOT NULL AND c.keep_id <> k.doc_id AS dropped
                   FROM k LEFT JOIN c ON k.key = c.key)
        SELECT doc_id, count(*) AS n_lines, cast(sum(dropped::int) AS bigint) AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
        FROM m GROUP BY doc_id""",
}

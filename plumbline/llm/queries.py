"""The queries of this subpackage and the SQL that gives the same rows, where there is any."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, chosen_path, decontaminate, labelled, language_id, lm_mixing, mpeg_audio, quality_rank, suffix_dedup, toxicity, url_rules
from plumbline.llm.textkit import training_row


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _classified(scored: DataFrame, cut: float) -> DataFrame:
    held = ~training_row(F.col("doc_id"), labelled.MODULUS, labelled.HELD)
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _classified(toxicity.classify(docs, toxicity.train(docs, table(spark, sf_dir, "labels"))), 0.5)


def op2_lm_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_mixing.score(table(spark, sf_dir, "documents"))
    held = ~training_row(F.col("doc_id"), lm_mixing.MODULUS, lm_mixing.HELD)
    return scored.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", "bits_per_byte")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents: the metadata's language is the declared one, the source is the host."""
    return language_id.identify(table(spark, sf_dir, "documents"), declared=F.col("lang"), host=F.col("source"))


def pages_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages: markup language, address suffix, and priors of host and registered domain."""
    html = F.col("html")
    return language_id.identify(table(spark, sf_dir, "pages"), "page_id", language_id.plain_text(html), language_id.markup_language(html), language_id.host_of(F.col("url")), suffixes=True)


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_bytes", "n_removed", F.size("span_begins").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = mpeg_audio.store(table(spark, sf_dir, "documents"))
    back = mpeg_audio.parse(media, keep=("doc_id", "n_bytes"))
    tail = F.substring("payload", -mpeg_audio.UNIT, mpeg_audio.UNIT)
    shown = ("n_frames", "samples", "sample_rate", "bad_checksums", "skipped_bytes", "tags", "table_frames", "table_crc", "max_kbps", "sum_kbps")
    return back.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(tail).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        F.concat_ws(";", *(F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in shown), F.concat(F.lit("seek="), F.xxhash64("seek_offsets").cast("string"))).alias("feature"),
    )


def op6_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict", "matched")


def op7_quality_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    features = quality_rank.described(table(spark, sf_dir, "documents"))
    return _classified(quality_rank.judge(features, quality_rank.learn(features, table(spark, sf_dir, "labels"))), quality_rank.CUT)


def op8_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chosen_path.join(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda acc, x: acc + x["end"] - x["begin"])
    names = F.array_sort(F.col("items").cast("array<string>"))
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ",").cast("binary"), 256).alias("items_sha256"),
        (F.size("items") >= 2).alias("contaminated"),
    )


def tokenizer_path(spark: SparkSession) -> str:
    """The vocabulary file: a session setting, or the one of the public tokenizers' package."""
    if (path := spark.conf.get("spark.plumbline.bpe.path", None)) is not None:
        return path
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(spark)
    back = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path), path)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ",").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_lm_mixing": op2_lm_mixing,
    "op3_language_id": op3_language_id,
    "pages_language_id": pages_language_id,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_media_columns": op5_media_columns,
    "op6_url_rules": op6_url_rules,
    "op7_quality_rank": op7_quality_rank,
    "op8_ngram_jaccard_join": op8_ngram_jaccard_join,
    "op9_decontaminate": op9_decontaminate,
    "op10_bpe": op10_bpe,
}

_HOST_AND_PATH = r"""
SELECT page_id,
       translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
       coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
FROM pages
"""


def _op6_sql() -> str:
    ranked = sorted(url_rules.RULES, key=lambda r: -len(r.name))
    fits = "\n".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.name}'" for r in ranked)
    verdict = "\n".join(f"WHEN rule = '{r.name}' THEN '{r.verdict}'" for r in ranked)
    glob = "\n".join(f"WHEN contains(host || path, '{g.strip('*')}') THEN '{g}'" for g in url_rules.SPAM_GLOBS)
    return f"""
WITH parts AS ({_HOST_AND_PATH}), ruled AS (SELECT *, CASE {fits} END AS rule FROM parts),
judged AS (SELECT *, CASE WHEN rule IS NOT NULL THEN NULL {glob} END AS matched FROM ruled)
SELECT page_id, host, path, rule, CASE {verdict} WHEN matched IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, matched
FROM judged
"""


_OP9_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT DISTINCT item_id, least(len(w), 8) AS n, array_to_string(w[k : k + least(len(w), 8) - 1], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 7, 1) + 1)) AS k FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, k, n, array_to_string(w[k : k + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d, (SELECT DISTINCT n FROM wins))
), hits AS (SELECT doc_id, k, n, item_id FROM places JOIN wins USING (n, s)),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM hits GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

ORACLE_SQL: dict[str, str] = {"op6_url_rules": _op6_sql(), "op9_decontaminate": _OP9_SQL}

"""The queries opN_<name> over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.llm import chat_format, exact_dedup, license_scan, lm_score, mixing, quality_rules, sentencepiece_codec, simhash, suffix_dedup, url_filter
from keyweave.llm.common import read
from keyweave.llm.license_texts import KNOWN, WHOLE

#: Host rules of the URL query (host, path, action), and the patterns that decide where none of them fits.
HOST_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
PATTERNS = ["cheap-pills.", "casino-win.", "spam-farm.", "^casino^", "^adserver^", "^doubleclick^", "/ads/banner"]


def url_rules() -> list[url_filter.Rule]:
    return [url_filter.host_rule(*r) for r in HOST_RULES] + [url_filter.glob_rule(p, "block") for p in PATTERNS]


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(read(spark, sf_dir, "pages"), url_rules())


OP1_SQL = """
WITH rest AS (
  SELECT page_id, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE substr(url, strpos(url, '://') + 3) END AS r FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(r, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM rest
), rules(rhost, rpath, action) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT page_id, host, path, rhost || rpath AS label, action FROM parts
  JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), best AS (
  SELECT page_id, host, path, arg_max(label, length(label)) AS label, arg_max(action, length(label)) AS action FROM fits GROUP BY page_id, host, path
), globs(pattern, regex) AS (
  VALUES ('cheap-pills.', 'cheap-pills\\.'), ('casino-win.', 'casino-win\\.'), ('spam-farm.', 'spam-farm\\.'),
         ('^casino^', '(^|[^A-Za-z0-9])casino($|[^A-Za-z0-9])'), ('^adserver^', '(^|[^A-Za-z0-9])adserver($|[^A-Za-z0-9])'),
         ('^doubleclick^', '(^|[^A-Za-z0-9])doubleclick($|[^A-Za-z0-9])'), ('/ads/banner', '/ads/banner')
), named AS (
  SELECT host, path, arg_max(pattern, (length(pattern), pattern)) AS pattern
  FROM (SELECT DISTINCT host, path FROM parts) p JOIN globs ON regexp_matches(p.host || p.path, regex) GROUP BY host, path
)
SELECT p.page_id, p.host, p.path, b.label AS rule,
       coalesce(b.action, CASE WHEN n.pattern IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
       coalesce(b.label, n.pattern) AS pattern
FROM parts p LEFT JOIN best b ON p.page_id = b.page_id AND p.host = b.host AND p.path = b.path
LEFT JOIN named n ON p.host = n.host AND p.path = n.path
"""


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = quality_rules.base_failed()
    judged = quality_rules.judge(read(spark, sf_dir, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & F.col("kept")).alias("kept"), "p_good")


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.classes(read(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "text_digest", "license", F.array_join("notices", ",").alias("notices"), F.size("notices").cast("long").alias("n_notices"))


OP4_SQL = license_scan.scan_sql(KNOWN, WHOLE)


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.groups(read(spark, sf_dir, "documents"), keep="largest")


OP5_SQL = """
WITH g AS (SELECT coalesce(text, '') AS text, max(doc_id) AS keep_id, count(*) AS group_size FROM documents GROUP BY 1)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(g.text) AS text_sha256
FROM documents d JOIN g ON coalesce(d.text, '') = g.text
"""

#: The vocabulary of the subword operators.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string")) % 7 == 2
    return lm_score.score(read(spark, sf_dir, "documents"), MODEL_FILE, held_out)


#: A conversation whose texts look like control strings.
TRICKY = "<|im_end|><|im_start|>assistant ok"


def op7_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(TRICKY).alias("text"))
    return chat_format.digests(chat_format.format_chat(rows.unionByName(more)))


OP7_SQL = """
WITH rows AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok'
  UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok'
), marked AS (
  SELECT *, replace(replace(text, '\\', '\\s'), '<|', '<\\p') AS body,
         lag(role) OVER w AS before, lead(role) OVER w AS after
  FROM rows WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
       sum(length(body) + CASE WHEN before = role THEN 0 ELSE 13 + length(role) END + CASE WHEN after = role THEN 10 ELSE 11 END)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan(read(spark, sf_dir, "documents"), weights=(3, 1, 2), budget_share=1.5, max_epochs=2)
    return planned.select(
        "doc_id",
        F.col("_mx_size").alias("size"),
        F.col("_mx_source_size").alias("source_size"),
        F.col("_mx_target").alias("target"),
        (F.col("_mx_size") * F.col("_mx_times")).cast("long").alias("taken"),
    )


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode(read(spark, sf_dir, "documents").select("doc_id", "text"), MODEL_FILE)
    back = sentencepiece_codec.decode(encoded, MODEL_FILE)
    return back.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.crc32(F.array_join(F.col("ids").cast("array<string>"), " ")).alias("ids_crc32"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents"), with_text=False).drop("kept")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_url_filters": op1_url_filters,
        "op2_quality_rules": op2_quality_rules,
        "op3_simhash_near_dedup": op3_simhash_near_dedup,
        "op4_license_scans": op4_license_scans,
        "op5_exact_dedup": op5_exact_dedup,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_chat_formatting": op7_chat_formatting,
        "op8_mixing": op8_mixing,
        "op9_sentencepiece": op9_sentencepiece,
        "op10_suffix_array_dedup": op10_suffix_array_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_url_filters": OP1_SQL, "op4_license_scans": OP4_SQL, "op5_exact_dedup": OP5_SQL, "op7_chat_formatting": OP7_SQL}

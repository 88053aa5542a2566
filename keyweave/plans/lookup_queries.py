"""Lookups in every shape: batch, folded, aliased, substring, prefix, pattern, fuzzy, fingerprint, closure."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.functions.cols import like_pattern, norm_name
from keyweave.functions.similarity import sign_bits
from keyweave.operators import lookup as lk
from keyweave.plans.registry import Registry, table

REG = Registry()


@REG.query("""
SELECT k.query, p.p_partkey, p.p_name FROM (SELECT o_orderkey * 3 AS query FROM orders) k LEFT JOIN part p ON k.query = p.p_partkey""")
def lookup_exact_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 3).alias("query"))
    return lk.lookup(keys, table(spark, sf_dir, "part").select("p_partkey", "p_name"), "query", "p_partkey", ["p_partkey"])


@REG.query("""
SELECT k.query, p.p_partkey FROM (SELECT DISTINCT p_name AS query FROM part UNION SELECT 'no such name') k
LEFT JOIN (SELECT p_name, min(p_partkey) AS p_partkey FROM part GROUP BY p_name) p ON k.query = p.p_name""")
def lookup_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    keys = part.select(F.col("p_name").alias("query")).unionByName(spark.createDataFrame([("no such name",)], "query string")).distinct()
    return lk.lookup(keys, part, "query", "p_name", ["p_partkey"]).select("query", "p_partkey")


@REG.query("""
SELECT k.query, p.p_partkey FROM (SELECT DISTINCT upper(p_name) AS query FROM part) k JOIN part p ON lower(k.query) = lower(p.p_name)""")
def lookup_casefold(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    keys = part.select(F.upper("p_name").alias("query")).distinct()
    return lk.lookup(keys, part, "query", "p_name", ["p_partkey"], k=None, fold=F.lower).select("query", "p_partkey")


@REG.query("""
SELECT k.query, count(p.p_partkey) AS n, min(p.p_partkey) AS first_key FROM
(SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN 'raw-' || s_suppkey ELSE s_suppkey::VARCHAR END AS raw, s_suppkey::VARCHAR AS canonical, s_suppkey AS query FROM supplier) k
JOIN part p ON p.p_partkey::VARCHAR IN (k.raw, k.canonical) GROUP BY k.query""")
def lookup_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("query"))
    canonical = F.col("query").cast("string")
    keys = s.select("query", F.when(F.col("query") % 2 == 0, F.concat(F.lit("raw-"), canonical)).otherwise(canonical).alias("raw"), canonical.alias("canonical"))
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_partkey").cast("string").alias("key"))
    found = lk.lookup_cascade(keys, part, ["raw", "canonical"], "key", "query", ["p_partkey"]).where("p_partkey is not null")
    return found.groupBy("query").agg(F.count("p_partkey").alias("n"), F.min("p_partkey").alias("first_key"))


@REG.query("""
SELECT DISTINCT k.query, p.p_partkey FROM (SELECT DISTINCT upper(p_name) AS query FROM part UNION SELECT 'BRAND#7' UNION SELECT 'brand#12') k
JOIN part p ON lower(p.p_name) = lower(k.query) OR lower(p.p_brand) = lower(k.query)""")
def search_exact_or_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    keys = part.select(F.upper("p_name").alias("query")).unionByName(spark.createDataFrame([("BRAND#7",), ("brand#12",)], "query string"))
    return lk.exact_or_alias(keys, part, "query", ["p_name", "p_brand"], "p_partkey").select("query", "p_partkey").distinct()


@REG.query("""
WITH k(key) AS (VALUES ('ring'), ('economy'), ('SMALL'), ('zz'), ('gear'), ('e')),
m AS (SELECT key, p_partkey AS id, 1 AS pass FROM k JOIN part ON contains(lower(p_name), lower(key))
      UNION ALL SELECT key, p_partkey, 2 FROM k JOIN part ON contains(lower(p_type), lower(key))),
b AS (SELECT key, id, min(pass) AS pass FROM m GROUP BY key, id)
SELECT key, id, pass, rank FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY pass, id)::INT AS rank FROM b) WHERE rank <= 10""")
def search_substring_topup(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = spark.createDataFrame([("ring",), ("economy",), ("SMALL",), ("zz",), ("gear",), ("e",)], "query string")
    return lk.search_top_up(keys, table(spark, sf_dir, "part"), "query", "p_name", "p_type", "p_partkey", 10)


@REG.query("SELECT p_partkey, p_name FROM part WHERE p_name ILIKE '%red_b%t' ")
def search_pattern_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lk.pattern_search(table(spark, sf_dir, "part").select("p_partkey", "p_name"), "p_name", like_pattern(".*red.b.*t"), ["p_partkey"])


@REG.query("SELECT p_partkey, p_name FROM part WHERE p_partkey IN (3, 5, 8, 13, 21, 34, 55, 89) OR p_name IN ('red bolt', 'old bolt')")
def lookup_in_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    ids = spark.createDataFrame([(i,) for i in (3, 5, 8, 13, 21, 34, 55, 89)], "p_partkey bigint")
    names = spark.createDataFrame([("red bolt",), ("old bolt",)], "p_name string")
    return part.join(ids, "p_partkey", "left_semi").unionByName(part.join(names, "p_name", "left_semi")).distinct()


@REG.query("""
SELECT b.doc_id AS query_id, count(*) AS n, min(d.doc_id) AS first_id FROM documents b JOIN documents d
ON substr(b.text, 1, 14) = substr(d.text, 1, 14) AND length(b.text) >= 14 GROUP BY b.doc_id""")
def prefix_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.substring("text", 1, 14).alias("prefix")).where(F.length("prefix") == 14)
    groups = docs.groupBy("prefix").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return docs.join(groups, "prefix").select(F.col("doc_id").alias("query_id"), "n", "first_id")


@REG.query("""
WITH q AS (SELECT DISTINCT substr(p_name, 1, 14) AS query FROM part), c AS (
  SELECT query, p_partkey, row_number() OVER (PARTITION BY query ORDER BY p_partkey)::INT AS rank FROM q JOIN part ON substr(p_name, 1, 6) = substr(query, 1, 6) AND length(query) >= 6)
SELECT * FROM c WHERE rank <= 20""")
def prefix_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return lk.prefix_lookup(part.select(F.substring("p_name", 1, 14).alias("query")), part, "query", "p_name", 6, "p_partkey", 20).select("query", "p_partkey", "rank")


#: Misspelt names: the second character is dropped, and one that fits nothing.
_MISSPELT_SQL = "SELECT DISTINCT substr(p_name, 1, 1) || substr(p_name, 3) AS query FROM part UNION SELECT 'zzzznosuchname'"
def ratio_sql(pairs: str) -> str:
    """CTEs up to ratio(a, b, score): 200 x the longest common subsequence over the summed lengths, by its textbook recursion."""
    return f"""
pairs_ AS ({pairs}),
dp(a, b, i, r) AS (
  SELECT a, b, 0, list_transform(range(0, length(b) + 1), lambda x: 0) FROM pairs_
  UNION ALL
  SELECT a, b, i + 1, list_reduce(list_transform(range(1, length(b) + 1), lambda j: [j]),
    lambda acc, e: list_append(acc, CASE WHEN substr(b, e[1]::INT, 1) = substr(a, i + 1, 1) THEN r[e[1]] + 1 ELSE greatest(r[e[1] + 1], acc[-1]) END), [0::BIGINT])
  FROM dp WHERE i < length(a)),
ratio AS (SELECT a, b, 200.0 * r[-1] / (length(a) + length(b)) AS score FROM dp WHERE i = length(a))"""


_RATIO_SQL = ratio_sql("SELECT q.query AS a, n.name AS b FROM q, (SELECT DISTINCT p_name AS name FROM part) n") + """,
top AS (SELECT a AS query, b AS name, score, row_number() OVER (PARTITION BY a ORDER BY score DESC, b)::INT AS rank FROM ratio WHERE score >= 80)
"""


def _misspelt(part: DataFrame, spark: SparkSession) -> DataFrame:
    wrong = part.select(F.concat(F.substring("p_name", 1, 1), F.expr("substr(p_name, 3)")).alias("query"))
    return wrong.unionByName(spark.createDataFrame([("zzzznosuchname",)], "query string")).distinct()


@REG.query(f"WITH RECURSIVE q AS ({_MISSPELT_SQL}), {_RATIO_SQL} SELECT query, name, round(score, 6)::DOUBLE AS score, rank FROM top WHERE rank <= 5")
def fuzzy_top_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_name").distinct()
    return lk.fuzzy_top_n(_misspelt(part, spark), part, "query", "p_name").withColumn("score", F.round("score", 6))


@REG.query(f"""
WITH RECURSIVE q AS (SELECT DISTINCT p_name AS query FROM part UNION {_MISSPELT_SQL}), {_RATIO_SQL},
exact AS (SELECT query FROM q WHERE query IN (SELECT p_name FROM part))
SELECT query, query AS name, 100.0::DOUBLE AS score, 1 AS rank, 'exact_name' AS match_method FROM exact
UNION ALL SELECT query, name, round(score, 6)::DOUBLE, rank, 'fuzzy_name' FROM top WHERE rank <= 5 AND query NOT IN (SELECT query FROM exact)""")
def exact_then_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    names = part.select("p_name").distinct()
    keys = names.select(F.col("p_name").alias("query")).unionByName(_misspelt(names, spark)).distinct()
    return lk.exact_then_fuzzy(keys, names, "query", "p_name", norm_name).withColumn("score", F.round("score", 6))


@REG.query("""
WITH f AS (SELECT vec_id, list_reduce(list_transform(range(1, 65), lambda i: CASE WHEN embedding[i] > 0 THEN '1' ELSE '0' END), lambda a, b: a || b) AS bits FROM embeddings),
n AS (SELECT vec_id, list_sum(list_transform(range(1, 65), lambda i: substr(bits, i, 1)::INT)) AS c, bits FROM f),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, list_sum(list_transform(range(1, 65), lambda i: substr(a.bits, i, 1)::INT * substr(b.bits, i, 1)::INT)) AS common, a.c + b.c AS total FROM n a, n b WHERE a.c > 0),
t AS (SELECT query_id, id, common::DOUBLE / (total - common) AS score FROM s)
SELECT query_id, id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id)::INT AS rank FROM t WHERE score >= 0.5) WHERE rank <= 5""")
def tanimoto_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    prints = table(spark, sf_dir, "embeddings").select("vec_id", sign_bits("embedding").alias("bits"))
    return lk.tanimoto_top_k(prints, prints, "vec_id", "bits", 0.5, 5).withColumn("score", F.round("score", 6))


@REG.query("""
WITH RECURSIVE e AS (SELECT n_name AS child, r_name AS parent FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT r_name, 'ROOT' FROM region),
up(node, ancestor) AS (SELECT child, parent FROM e UNION SELECT u.node, e.parent FROM up u JOIN e ON u.ancestor = e.child)
SELECT node, ancestor FROM up""")
def ontology_closure(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    edges = nation.join(region, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("child"), F.col("r_name").alias("parent"))
    return lk.closure(edges.unionByName(region.select(F.col("r_name").alias("child"), F.lit("ROOT").alias("parent"))), "child", "parent")

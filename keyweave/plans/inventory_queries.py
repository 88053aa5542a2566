"""Inventory questions: part = items, lineitem = who lists what, supplier = sources, nation = countries, region = regions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.operators import inventory as inv
from keyweave.operators.durable import shared_folder
from keyweave.plans.registry import Registry, table

REG = Registry()


def star(spark: SparkSession, sf_dir: str) -> inv.Star:
    t = lambda n: table(spark, sf_dir, n)
    return inv.Star(
        items=t("part").select(F.col("p_partkey").alias("item_key"), F.col("p_name").alias("item_name")),
        links=t("lineitem").select(F.col("l_partkey").alias("item_key"), F.col("l_suppkey").alias("source_id")),
        sources=t("supplier").select(F.col("s_suppkey").alias("source_id"), F.col("s_name").alias("source_name"), F.col("s_nationkey").alias("country_id")),
        countries=t("nation").select(F.col("n_nationkey").alias("country_id"), F.col("n_name").alias("country"), F.col("n_regionkey").alias("region_id")),
        regions=t("region").select(F.col("r_regionkey").alias("region_id"), F.col("r_name").alias("region")),
    )


@REG.query("""
SELECT DISTINCT p.p_partkey AS item_key, p.p_name AS item_name, r.r_name AS region, n.n_name AS country, s.s_name AS source_name
FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey WHERE r.r_name ILIKE '%europe%'""")
def region_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.members(star(spark, sf_dir), "region", name="Europe")


@REG.query("""
SELECT DISTINCT p.p_partkey AS item_key, p.p_name AS item_name, n.n_name AS country, s.s_name AS source_name
FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_name ILIKE '%nation_1%'""")
def country_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.members(star(spark, sf_dir), "country", name="nation_1")


@REG.query("""
SELECT DISTINCT p.p_partkey AS item_key, p.p_name AS item_name, s.s_name AS source_name
FROM part p JOIN lineitem l ON p.p_partkey = l.l_partkey JOIN supplier s ON l.l_suppkey = s.s_suppkey WHERE s.s_suppkey = 3""")
def inventory_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.members(star(spark, sf_dir), "source", id_=3)


@REG.query("""
SELECT s.s_suppkey AS source_id, s.s_name AS source_name, count(DISTINCT l.l_partkey) AS n_items
FROM supplier s LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey GROUP BY ALL""")
def count_by_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.count_members(star(spark, sf_dir), "source")


@REG.query("""
SELECT n.n_nationkey AS country_id, n.n_name AS country, count(DISTINCT l.l_partkey) AS n_items
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey GROUP BY ALL""")
def count_by_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.count_members(star(spark, sf_dir), "country")


@REG.query("""
SELECT r.r_regionkey AS region_id, r.r_name AS region, count(DISTINCT l.l_partkey) AS n_items
FROM supplier s JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey
LEFT JOIN lineitem l ON l.l_suppkey = s.s_suppkey GROUP BY ALL""")
def count_by_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.count_members(star(spark, sf_dir), "region")


@REG.query("""
SELECT DISTINCT n_nationkey AS country_id, n_name AS country, r_name AS region
FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name ILIKE '%asia%'""")
def countries_for_region(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.countries_of(star(spark, sf_dir), "asia")


@REG.query("""
SELECT DISTINCT s_suppkey AS source_id, s_name AS source_name, n_name AS country
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_name ILIKE '%NATION_2%'""")
def inventories_for_country(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.sources_of(star(spark, sf_dir), "NATION_2")


@REG.query("""
SELECT 'items' AS name, count(*) AS n FROM part UNION ALL SELECT 'links', count(*) FROM lineitem
UNION ALL SELECT 'sources', count(*) FROM supplier UNION ALL SELECT 'countries', count(*) FROM nation
UNION ALL SELECT 'distinct_names', count(DISTINCT p_name) FROM part UNION ALL SELECT 'listed_items', count(DISTINCT l_partkey) FROM lineitem""")
def database_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    tables = {"items": s.items, "links": s.links, "sources": s.sources, "countries": s.countries}
    return inv.table_stats(tables, {"distinct_names": ("items", "item_name"), "listed_items": ("links", "item_key")})


@REG.query("""
SELECT p_name AS item_name, string_agg(DISTINCT l_suppkey::VARCHAR, ',' ORDER BY l_suppkey::VARCHAR) AS source_ids
FROM part JOIN lineitem ON p_partkey = l_partkey GROUP BY p_name""")
def name_to_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = star(spark, sf_dir)
    pairs = s.items.join(s.links, "item_key").select("item_name", F.col("source_id").cast("string").alias("source_id"))
    return inv.keys_of(pairs, "item_name", "source_id").select("item_name", F.array_join("keys", ",").alias("source_ids"))


@REG.query("""
SELECT p_type AS formula, count(DISTINCT p_partkey) AS n_keys, string_agg(DISTINCT p_brand, ',' ORDER BY p_brand) AS brands
FROM part GROUP BY p_type""")
def formula_to_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    brands = inv.keys_of(part, "p_type", "p_brand").select("p_type", F.array_join("keys", ",").alias("brands"))
    return brands.join(part.groupBy("p_type").agg(F.countDistinct("p_partkey").alias("n_keys")), "p_type").select(F.col("p_type").alias("formula"), "n_keys", "brands")


@REG.query("""
SELECT o_orderkey, nullif(string_agg(DISTINCT l_partkey::VARCHAR, '; ' ORDER BY l_partkey::VARCHAR), '') AS parts,
       nullif(string_agg(DISTINCT l_returnflag, '; ' ORDER BY l_returnflag), '') AS flags
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def id_table_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_partkey").cast("string").alias("part"), "l_returnflag")
    return inv.id_table(table(spark, sf_dir, "orders").select("o_orderkey"), links, "o_orderkey", parts="part", flags="l_returnflag")


@REG.query("""
SELECT d.doc_id, d.lang, 'labelled' AS part FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id WHERE b.quality IS NOT NULL AND b.quality = 1
UNION ALL SELECT d.doc_id, d.lang, 'open' FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id WHERE b.quality IS NULL""")
def id_table_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    labelled = inv.filtered(both, "quality", present=True, value=1).select("doc_id", "lang", F.lit("labelled").alias("part"))
    return labelled.unionByName(inv.filtered(both, "quality", present=False).select("doc_id", "lang", F.lit("open").alias("part")))


@REG.query("""
SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY l_orderkey""")
def best_rank_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.best_ranked(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_partkey", "l_linenumber")


@REG.query("""
SELECT c_custkey, c_name, count(o_orderkey) AS n_children FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY ALL""")
def children_count_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "c_custkey")
    return inv.children_count(table(spark, sf_dir, "customer"), orders, "c_custkey", "o_orderkey", ["c_name"])


@REG.query("""
SELECT s_suppkey, s_name, count(l_orderkey) AS n_children FROM supplier LEFT JOIN lineitem ON s_suppkey = l_suppkey
WHERE s_name ILIKE '%supplier%7' GROUP BY ALL""")
def count_like_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "s_suppkey")
    return inv.children_count(table(spark, sf_dir, "supplier").where(F.col("s_name").ilike("%supplier%7")), lines, "s_suppkey", "l_orderkey", ["s_name"])


@REG.query("SELECT doc_id, lang FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def semi_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_semi")


@REG.query("SELECT doc_id, lang FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_pending(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti")


@REG.query("SELECT d.doc_id, d.source, b.quality, b.toxic FROM documents d LEFT JOIN labels b ON d.doc_id = b.doc_id")
def probabilities_left_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id", "left")


@REG.query("""
SELECT c.conv_id, c.turn, c.role, p.role AS parent_role, a.role AS active_role, c.turn = 0 AS is_parent
FROM conversations c LEFT JOIN conversations p ON c.conv_id = p.conv_id AND p.turn = c.turn - 1
LEFT JOIN conversations a ON c.conv_id = a.conv_id AND a.turn = c.turn + 1""")
def hierarchy_self_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    parent = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("parent_role"))
    active = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("role").alias("active_role"))
    return c.join(parent, ["conv_id", "turn"], "left").join(active, ["conv_id", "turn"], "left").withColumn("is_parent", F.col("turn") == 0)


@REG.query("""
SELECT o_orderkey, coalesce(string_agg(l_partkey::VARCHAR || ':' || l_quantity::BIGINT::VARCHAR, ';' ORDER BY l_linenumber, l_partkey, l_quantity), '') AS components
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def nested_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    packed = inv.nested(table(spark, sf_dir, "orders").select("o_orderkey"), lines, "o_orderkey", ["l_linenumber", "l_partkey", "l_quantity"], ["l_partkey", "l_quantity"])
    shown = F.transform("components", lambda x: F.concat_ws(":", x["l_partkey"].cast("string"), x["l_quantity"].cast("long").cast("string")))
    return packed.select("o_orderkey", F.coalesce(F.array_join(shown, ";"), F.lit("")).alias("components"))


@REG.query("SELECT s_suppkey AS source_id, s_name AS source_name FROM supplier")
def export_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import os
    import uuid

    shared = shared_folder(spark)
    path = os.path.join(shared, f"export-{uuid.uuid4().hex}")
    inv.export_csv(star(spark, sf_dir).sources.select("source_id", "source_name"), path)
    return spark.read.csv(path, header=True, schema="source_id bigint, source_name string")

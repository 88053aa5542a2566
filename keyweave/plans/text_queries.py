"""Scalar functions, parsers and memo tables, on identifiers and documents made from the driver's tables by the same rule in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.functions import chem, cols, parse
from keyweave.operators import classify, memo
from keyweave.plans.registry import Registry, table
from keyweave.sources.files import min_stars

REG = Registry()

#: A registry number for an order key: first group, two digits, a digit that is the check digit for some.
_CAS_SQL = "(100 + o_orderkey) || '-' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '-' || (o_orderkey % 10)"


def _cas(key: Column) -> Column:
    text = lambda c: c.cast("string")
    return F.concat_ws("-", text(key + 100), F.lpad(text(key % 100), 2, "0"), text(key % 10))


@REG.query(f"""
WITH i AS (SELECT o_orderkey, {_CAS_SQL} AS cas FROM orders), z AS (SELECT *, reverse(split_part(cas, '-', 1) || split_part(cas, '-', 2)) AS d FROM i)
SELECT o_orderkey, cas, list_sum(list_transform(range(1, length(d) + 1), lambda i: i * CAST(substr(d, i::INT, 1) AS INT))) % 10 = CAST(split_part(cas, '-', 3) AS INT) AS valid FROM z
UNION ALL SELECT -1, 'abc', false UNION ALL SELECT -2, '1-2', false""")
def cas_check_digit(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = table(spark, sf_dir, "orders").select("o_orderkey", _cas(F.col("o_orderkey")).alias("cas"))
    more = spark.createDataFrame([(-1, "abc"), (-2, "1-2")], "o_orderkey bigint, cas string")
    return ids.unionByName(more).withColumn("valid", cols.cas_valid(F.col("cas")))


@REG.query(f"""
SELECT c.c_custkey, coalesce((SELECT string_agg(DISTINCT x, ',' ORDER BY x) FROM (SELECT {_CAS_SQL} AS x FROM orders WHERE o_custkey = c.c_custkey)), '') AS found FROM customer c""")
def cas_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.collect_list(F.concat(F.lit("see CAS "), _cas(F.col("o_orderkey")), F.lit("; x"))), ", ").alias("text"))
    joined = table(spark, sf_dir, "customer").select("c_custkey").join(texts, F.col("c_custkey") == F.col("o_custkey"), "left")
    return joined.select("c_custkey", F.array_join(cols.extract_cas(F.col("text")), ",").alias("found"))


@REG.query(f"""
WITH s AS (SELECT o_orderkey, unnest([{_CAS_SQL}, ' InChI=1S/' || o_orderkey || '/c1 ', 'ABCDEFGHIJKLMN-OPQRSTUVWX-' || chr((65 + o_orderkey % 26)::INT), o_orderpriority, '']) AS s FROM orders)
SELECT kind, count(*) AS n, count(DISTINCT value) AS n_values, min(value) AS first_value FROM (
  SELECT CASE WHEN regexp_matches(s, '[0-9]{{2,7}}-[0-9]{{2}}-[0-9]') THEN 'cas' WHEN regexp_matches(s, '[A-Z]{{14}}-[A-Z]{{10}}-[A-Z]') THEN 'inchikey' WHEN starts_with(trim(s), 'InChI=') THEN 'inchi' ELSE 'synonym' END AS kind,
         trim(s) AS value FROM s WHERE trim(s) <> '') GROUP BY kind""")
def synonym_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    joined = F.concat_ws(
        "|", _cas(key), F.concat(F.lit(" InChI=1S/"), key.cast("string"), F.lit("/c1 ")), F.concat(F.lit("ABCDEFGHIJKLMN-OPQRSTUVWX-"), F.char(65 + key % 26)), F.col("o_orderpriority"), F.lit("")
    )
    each = table(spark, sf_dir, "orders").select(F.explode(cols.split_list(joined, "|")).alias("s")).select(cols.classify_synonym(F.col("s")).alias("c")).select("c.*")
    return each.groupBy("kind").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"), F.min("value").alias("first_value"))


@REG.query("""
SELECT p_partkey, (100 + p_partkey) || '-17-4' AS casrn, 'NSC' || p_partkey AS nsc, 'DTXSID' || (p_partkey * 7) AS dtxsid, 'DTXCID' || p_size AS dtxcid,
       '1.' || p_size || '.3.4' AS ec_number, 'CHEBI:' || p_partkey AS chebi_id, CASE WHEN p_partkey % 2 = 0 THEN 'CHEMBL' || p_partkey ELSE '' END AS chembl FROM part""")
def id_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey").cast("string")
    size = F.col("p_size").cast("string")
    names = F.array(
        F.concat(F.lit("CAS: "), (F.col("p_partkey") + 100).cast("string"), F.lit("-17-4")),
        F.concat(F.lit("nsc "), key),
        F.concat(F.lit("dtxsid"), (F.col("p_partkey") * 7).cast("string"), F.lit(" or DTXCID"), size),
        F.concat(F.lit("EC 1."), size, F.lit(".3.4")),
        F.concat(F.lit("CHEBI: "), key),
        F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("chembl"), key)),
        F.col("p_name"),
    )
    ids = table(spark, sf_dir, "part").select("p_partkey", cols.extract_ids(names).alias("i"))
    return ids.select("p_partkey", *[F.array_join(F.col(f"i.{f}"), ",").alias(f) for f in cols.ID_FAMILIES])


@REG.query("""
SELECT DISTINCT raw, CASE WHEN raw = ' MEK ' THEN 'methyl ethyl ketone' WHEN raw = 'DMSO' THEN 'dimethyl sulfoxide' ELSE p_name END AS normal FROM (
  SELECT p_name, unnest(['D-' || upper(p_name), '(±)-' || p_name, ' rac-' || replace(p_name, ' ', '   '), p_name, '(RS)-' || p_name, ' MEK ', 'DMSO']) AS raw FROM part)""")
def name_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("p_name")
    forms = [F.concat(F.lit("D-"), F.upper(name)), F.concat(F.lit("(±)-"), name), F.concat(F.lit(" rac-"), F.replace(name, F.lit(" "), F.lit("   "))), name, F.concat(F.lit("(RS)-"), name), F.lit(" MEK "), F.lit("DMSO")]
    raw = table(spark, sf_dir, "part").select(F.explode(F.array(*forms)).alias("raw")).distinct()
    return raw.withColumn("normal", cols.norm_name(F.col("raw")))


@REG.query("""
SELECT doc_id, len(l) AS n_items, list_sum(list_transform(l, lambda x: length(x))) AS n_chars FROM (
  SELECT doc_id, list_filter(list_transform(string_split(text, '. '), lambda x: trim(x)), lambda x: x <> '') AS l FROM documents)""")
def list_split_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = table(spark, sf_dir, "documents").select("doc_id", cols.split_list(F.col("text"), ". ").alias("l"))
    return parts.select("doc_id", F.size("l").cast("long").alias("n_items"), F.aggregate("l", F.lit(0).cast("long"), lambda a, x: a + F.length(x)).alias("n_chars"))


@REG.query("SELECT page_id, split_part(url, '/', 2) AS layer2, split_part(url, '/', 4) AS layer4 FROM pages WHERE split_part(url, '/', 4) = 'en'")
def inchi_layer_formula(spark: SparkSession, sf_dir: str) -> DataFrame:
    layers = table(spark, sf_dir, "pages").select("page_id", cols.formula_layer(F.col("url")).alias("layer2"), F.split_part("url", F.lit("/"), F.lit(4)).alias("layer4"))
    return layers.where("layer4 = 'en'")


@REG.query("""
SELECT event_id, event_type, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k, round(value, 2) AS value FROM events WHERE regexp_extract(props, '[0-9]+') <> ''""")
def json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", "event_type", F.from_json("props", "k bigint")["k"].alias("k"), F.round("value", 2).alias("value")).where("k is not null")


@REG.query("""
SELECT user_id, max(CASE WHEN event_type = 'click' THEN value END) AS click, max(CASE WHEN event_type = 'error' THEN value END) AS error, max(CASE WHEN event_type = 'view' THEN value END) AS view
FROM events GROUP BY user_id""")
def eav_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error", "view"]).agg(F.max("value"))


@REG.query("""
SELECT p_partkey, p_type AS "MolecularFormula", (100 + p_size)::VARCHAR AS "MolecularWeight", p_brand AS "SMILES", p_name AS own FROM part""")
def eav_known_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    def item(label: str, name: str, sval: Column | None = None, ival: Column | None = None) -> Column:
        none = F.lit(None)
        urn = F.struct(F.lit(label).alias("label"), F.lit(name).alias("name"))
        value = F.struct((none.cast("string") if sval is None else sval).alias("sval"), (none.cast("bigint") if ival is None else ival).alias("ival"), none.cast("double").alias("fval"), none.cast("string").alias("binary"))
        return F.struct(urn.alias("urn"), value.alias("value"))

    props = F.array(
        item("Molecular Formula", "", F.col("p_type")),
        item("Molecular Weight", "", ival=(F.col("p_size") + 100).cast("bigint")),
        item("SMILES", "Absolute", F.lit("overwritten")),
        item("SMILES", "Absolute", F.col("p_brand")),
        item("Own Label", "a-b", F.col("p_name")),
        item("Empty", ""),
    )
    # through JSON text, as documents come
    packed = table(spark, sf_dir, "part").select("p_partkey", F.from_json(F.to_json(props), parse.PROPERTY_LIST).alias("props"))
    m = packed.select("p_partkey", parse.property_map(F.col("props")).alias("m"))
    return m.select("p_partkey", *[F.col("m")[k].alias(k) for k in ("MolecularFormula", "MolecularWeight", "SMILES")], F.col("m")["OwnLabel_ab"].alias("own"))


@REG.query("""
SELECT p_partkey, p_size::VARCHAR AS melting_value, '°C' AS melting_unit, NULL::VARCHAR AS melting_at,
       p_size || '.5e-3' AS vapor_value, 'mmHg' AS vapor_unit, '25°C' AS vapor_at, '3 mmHg; Estimated' AS vapor_more,
       p_size || '.25' AS sol_value, CASE WHEN p_size % 2 = 0 THEN 'μg/mL' ELSE 'g/L' END AS sol_unit,
       CASE WHEN p_size % 2 = 0 THEN '1.' || p_size ELSE '-0.' || p_size END AS logp_value,
       p_size || '-' || (p_size + 3) AS general_value, '°F' AS general_unit FROM part""")
def value_unit_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size").cast("string")
    even = F.col("p_size") % 2 == 0
    texts = {
        "melting": (F.concat(size, F.lit(" °C")), "Melting Point"),
        "vapor": (F.concat(size, F.lit(".5X10-3 mmHg at 25 °C /Estimated/")), "Vapor Pressure"),
        "sol": (F.when(even, F.concat(size, F.lit(".25 [ug/mL] (in water)"))).otherwise(F.concat(F.lit("Solubility in water: "), size, F.lit(".25 g/L at 20 °C"))), "Solubility"),
        "logp": (F.when(even, F.concat(F.lit("log Kow = 1."), size)).otherwise(F.concat(F.lit("-0."), size)), "LogP"),
        "general": (F.concat(size, F.lit("-"), (F.col("p_size") + 3).cast("string"), F.lit(" °F")), None),
    }
    parsed = table(spark, sf_dir, "part").select("p_partkey", *[parse.parse_value(t, p).alias(n) for n, (t, p) in texts.items()])
    shown = {"melting_value": "melting.value", "melting_unit": "melting.unit", "melting_at": "melting.temperature", "vapor_value": "vapor.value", "vapor_unit": "vapor.unit", "vapor_at": "vapor.temperature", "vapor_more": "vapor.conditions"}
    shown |= {"sol_value": "sol.value", "sol_unit": "sol.unit", "logp_value": "logp.value", "general_value": "general.value", "general_unit": "general.unit"}
    return parsed.select("p_partkey", *[F.col(c).alias(n) for n, c in shown.items()])


@REG.query("""
SELECT s_suppkey AS cid, 'v ' || s_suppkey || ' °C' AS raw, 'Source: S' || s_nationkey || ' | Name: ' || s_name AS reference FROM supplier""")
def property_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = table(spark, sf_dir, "supplier")
    text = F.concat(F.lit("v "), F.col("s_suppkey").cast("string"), F.lit(" °C"))
    info = F.array(F.struct(F.col("s_nationkey").cast("bigint").alias("ReferenceNumber"), F.struct(F.array(F.struct(text.alias("String"))).alias("StringWithMarkup")).alias("Value")))
    leaf = F.array(F.struct(F.lit("Melting Point").alias("TOCHeading"), info.alias("Information")))
    mid = F.array(F.struct(F.lit("Experimental Properties").alias("TOCHeading"), leaf.alias("Section")))
    top = F.array(F.struct(F.lit("Chemical and Physical Properties").alias("TOCHeading"), mid.alias("Section")))
    refs = F.array(F.struct(F.col("s_nationkey").cast("bigint").alias("ReferenceNumber"), F.concat(F.lit("S"), F.col("s_nationkey").cast("string")).alias("SourceName"), F.col("s_name").alias("Name")))
    record = F.struct(F.col("s_suppkey").alias("RecordNumber"), F.col("s_name").alias("RecordTitle"), top.alias("Section"), refs.alias("Reference"))
    docs = row.select(F.to_json(F.struct(record.alias("Record"))).alias("json"))
    return parse.property_table(docs, "Melting Point").select("cid", "raw", "reference")


@REG.query("""
SELECT event_type, count(k) AS n_values, string_agg(DISTINCT unit, ',' ORDER BY unit) AS units, count(DISTINCT k) AS n_distinct FROM (
  SELECT event_type, regexp_extract(props, '[0-9]+') AS k, CASE WHEN user_id % 2 = 0 THEN 'kPa' ELSE 'bar' END AS unit FROM events) GROUP BY event_type""")
def property_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").alias("value"), F.when(F.col("user_id") % 2 == 0, "kPa").otherwise("bar").alias("unit"))
    return parse.property_summary(rows, ["event_type"]).select("event_type", "n_values", F.array_join("units", ",").alias("units"), F.size("values").cast("long").alias("n_distinct"))


@REG.query("SELECT p_partkey, p_size % 5 AS star FROM part WHERE p_size % 5 >= 3 AND p_partkey % 7 <> 0")
def star_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = table(spark, sf_dir, "part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, "n/a").otherwise((F.col("p_size") % 5).cast("string")).alias("star"))
    return min_stars(rated, 3).withColumn("star", F.col("star").cast("int"))


@REG.query("""
SELECT o_custkey, string_agg(o_orderpriority, '; ' ORDER BY first_at) AS priorities FROM (
  SELECT o_custkey, o_orderpriority, min(o_orderkey) AS first_at FROM orders GROUP BY o_custkey, o_orderpriority) GROUP BY o_custkey""")
def ordered_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = F.collect_list(F.struct("o_orderkey", F.col("o_orderpriority").alias("value")))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(cols.ordered_distinct(pairs), "; ").alias("priorities"))


@REG.query("SELECT p_partkey, 'C' || p_size || 'H' || (p_size * 2) || 'O' AS formula, round(p_size * 12.011 + p_size * 2 * 1.008 + 15.999, 4) AS mass FROM part")
def formula_mass(spark: SparkSession, sf_dir: str) -> DataFrame:
    formula = F.concat(F.lit("C"), F.col("p_size").cast("string"), F.lit("H"), (F.col("p_size") * 2).cast("string"), F.lit("O"))
    return table(spark, sf_dir, "part").select("p_partkey", formula.alias("formula")).withColumn("mass", F.round(chem.formula_mass(F.col("formula")), 4))


@REG.query("""
SELECT sha256(coalesce(text, '')) AS key, max(length(text))::BIGINT AS value, bool_or(doc_id % 3 = 0) AS known FROM documents GROUP BY 1""")
def memo_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("key"), F.length("text").cast("long").alias("value"))
    stored = docs.where("doc_id % 3 = 0").select("key", "value").distinct()
    everything, new = memo.memoised(docs, stored, lambda misses: misses.join(docs, "key").select("key", "value").distinct())
    return everything.join(new.select("key", F.lit(False).alias("known")), "key", "left").withColumn("known", F.coalesce("known", F.lit(True)))


@REG.query("""
SELECT number, max(p_partkey) AS class_id FROM part JOIN (SELECT unnest(['red', 'blue', 'small', 'old']) AS element, unnest([1, 2, 3, 4]) AS number) ON split_part(p_name, ' ', 1) = element GROUP BY number""")
def element_class_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    elements = spark.createDataFrame([("red", 1), ("blue", 2), ("small", 3), ("old", 4)], "element string, number int")
    return classify.element_classes(table(spark, sf_dir, "part"), elements, r"^([a-z]+) ", "p_partkey", "p_name")


@REG.query("""
SELECT c_name, arg_max(o_orderpriority, o_orderkey) AS label FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY c_name""")
def labels_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "orders"), F.col("c_custkey") == F.col("o_custkey"))
    return classify.to_labels(rows, "c_name", "o_orderpriority", "o_orderkey").select("c_name", F.col("o_orderpriority").alias("label"))


@REG.query("SELECT doc_id, sha256('{\"function\":\"f\",\"a0\":' || doc_id || ',\"a1\":\"' || lang || '\"}') AS key FROM documents")
def memo_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", cols.memo_key("f", F.col("doc_id"), F.col("lang")).alias("key"))


@REG.query("SELECT s_suppkey, 'https://example.org/id/' || replace(replace(s_name, '#', '%23'), ' ', '%20') || '/JSON' AS url FROM supplier")
def request_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select("s_suppkey", cols.request_url("https://example.org/id", F.col("s_name"), F.lit("JSON")).alias("url"))

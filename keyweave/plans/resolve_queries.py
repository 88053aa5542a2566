"""Entity resolution and enrichment over catalogs made from the driver's tables: part seen by three sources that differ in coverage, mass and gaps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.functions.cols import rounded
from keyweave.operators import enrich as en
from keyweave.operators import identify
from keyweave.operators import resolve as rs
from keyweave.plans.lookup_queries import ratio_sql
from keyweave.plans.registry import Registry, table

REG = Registry()

#: How each source sees a part; the first column is its id as text.
_VIEWS = {
    "chebi": "p_partkey % 2 = 0",
    "comptox": "p_partkey % 3 = 0",
    "pubchem": "p_partkey % 5 = 0",
}
_FIELDS = {
    "chebi": dict(formula="p_type", mass="p_retailprice", smiles="NULL", dtxsid="NULL", iupac="p_brand"),
    "comptox": dict(formula="p_type", mass="p_retailprice + 0.1", smiles="p_name || '@' || p_brand", dtxsid="'D' || p_partkey", iupac="NULL"),
    "pubchem": dict(formula="CASE WHEN p_size > 25 THEN p_type END", mass="p_retailprice + 0.5", smiles="p_name || '@' || p_brand", dtxsid="NULL", iupac="NULL"),
}


def _view_sql(source: str, function: str) -> str:
    f = _FIELDS[source]
    text = "VARCHAR" if function == "duckdb" else "STRING"
    none = f"CAST(NULL AS {text})"
    value = lambda x: none if x == "NULL" else x
    cas = "[p_brand]" if function == "duckdb" else "array(p_brand)"
    return f"""
      SELECT CAST(p_partkey AS {text}) AS id, p_name AS name, {value(f["iupac"])} AS iupac_name, {f["formula"]} AS formula, {value(f["smiles"])} AS smiles,
             {value(f["smiles"])} AS canonical_smiles, {none} AS inchi, upper(md5(p_name || p_brand)) AS inchikey, {value(f["dtxsid"]).replace("p_partkey", f"CAST(p_partkey AS {text})")} AS dtxsid,
             CAST({f["mass"]} AS DOUBLE) AS mass, {none} AS synonyms, {cas} AS cas FROM part WHERE {_VIEWS[source]}"""


def catalogs(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    part = table(spark, sf_dir, "part")
    return {s: spark.sql(_view_sql(s, "spark").replace("FROM part", "FROM {part}"), part=part) for s in _VIEWS}


def queries_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct names in upper case, and one that no source has; q_idx in the order of the names."""
    part = table(spark, sf_dir, "part")
    names = part.groupBy(F.upper("p_name").alias("query")).agg(F.min("p_partkey").alias("q_idx"))
    return names.select("q_idx", "query").unionByName(spark.createDataFrame([(-1, "NO SUCH NAME")], "q_idx bigint, query string"))


_SOURCE_ROWS = " UNION ALL ".join(f"SELECT {i} AS pr, '{s}' AS source, * FROM ({_view_sql(s, 'duckdb')})" for i, s in enumerate(_VIEWS))


def _pool_sql(on: str, keys: str, score: str = "1.0", order: str = "id", method: str = "exact_name", joined: str = "", top: int = 5, hop: str = "") -> str:
    """CTEs from queries to hits, by the rules of the resolver: at most top rows of each source; hop names the sources that are reached by the key the others know."""
    hop_sql = (
        f"""known AS (SELECT q_idx, query, arg_min(inchikey, (pr, origin_rank)) AS key FROM direct WHERE inchikey IS NOT NULL GROUP BY ALL),
second AS (SELECT q_idx, query, s.*, {score}::DOUBLE AS query_match_score FROM known JOIN sources s ON s.inchikey = known.key AND s.source IN ({hop})),
both_ AS (SELECT * FROM direct UNION ALL SELECT *, row_number() OVER (PARTITION BY q_idx, source ORDER BY {order}) - 1 AS origin_rank FROM second),"""
        if hop
        else "both_ AS (SELECT * FROM direct),"
    )
    first = f" AND s.source NOT IN ({hop})" if hop else ""
    return f"""
sources AS ({_SOURCE_ROWS}), keys AS ({keys}),
met AS (SELECT q_idx, query, s.*, {score}::DOUBLE AS query_match_score FROM keys JOIN sources s ON {on}{first} {joined}),
direct AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_idx, source ORDER BY {order}) - 1 AS origin_rank FROM met) WHERE origin_rank < {top}),
{hop_sql}
pool AS (SELECT *, '{method}' AS match_method, row_number() OVER (PARTITION BY q_idx ORDER BY pr, origin_rank) - 1 AS pool_pos FROM both_ WHERE origin_rank < {top}),
clustered AS (SELECT *, 'skel:' || substr(inchikey, 1, 14) AS cluster FROM pool),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q_idx, cluster, source ORDER BY origin_rank, query_match_score DESC, pool_pos) AS nth FROM clustered) WHERE nth = 1),
pairs AS (SELECT a.q_idx, a.cluster, a.source, a.pr, b.source AS other, b.pr AS other_pr, CASE WHEN a.source = b.source THEN 1.0 ELSE
   (CASE WHEN len(list_intersect(a.cas, b.cas)) > 0 THEN 3.0 ELSE 0 END
    + CASE WHEN a.canonical_smiles = b.canonical_smiles THEN 4.0 ELSE 0 END + CASE WHEN a.inchikey = b.inchikey THEN 3.0 ELSE 0 END
    + CASE WHEN a.formula = b.formula THEN 1.0 ELSE 0 END
    + CASE WHEN abs(a.mass - b.mass) <= 0.2 THEN 2.0 WHEN abs(a.mass - b.mass) <= 1.0 THEN 1.0 ELSE 0 END
    + CASE WHEN lower(trim(a.name)) = lower(trim(b.name)) THEN 1.0 ELSE 0 END)
   / (3.0 + CASE WHEN a.canonical_smiles IS NOT NULL AND b.canonical_smiles IS NOT NULL THEN 4.0 ELSE 0 END + 3.0
    + CASE WHEN a.formula IS NOT NULL AND b.formula IS NOT NULL THEN 1.0 ELSE 0 END + 2.0
    + CASE WHEN lower(trim(a.name)) = lower(trim(b.name)) THEN 1.0 ELSE 0 END) END AS similarity
  FROM best a JOIN best b ON a.q_idx = b.q_idx AND a.cluster = b.cluster),
support AS (SELECT q_idx, cluster, source, pr, coalesce(avg(CASE WHEN source <> other THEN similarity END), 1.0) AS support FROM pairs GROUP BY ALL),
anchor AS (SELECT q_idx, cluster, arg_min(source, pr) AS anchor FROM (SELECT *, max(support) OVER (PARTITION BY q_idx, cluster) AS top FROM support) WHERE support >= top - 0.05 GROUP BY ALL),
scored AS (SELECT b.*, a.anchor, p.similarity AS match_score, avg(p.similarity) OVER (PARTITION BY b.q_idx, b.cluster) AS consensus
  FROM best b JOIN anchor a ON b.q_idx = a.q_idx AND b.cluster = a.cluster
  JOIN pairs p ON p.q_idx = b.q_idx AND p.cluster = b.cluster AND p.source = b.source AND p.other = a.anchor),
merged AS (SELECT q_idx, cluster, anchor, consensus, count(*) AS n_source_support,
   arg_min(name, pr) FILTER (ok AND name IS NOT NULL) AS name, arg_min(formula, pr) FILTER (ok AND formula IS NOT NULL) AS formula,
   arg_min(mass, pr) FILTER (ok AND mass IS NOT NULL) AS mass, arg_min(smiles, pr) FILTER (ok AND smiles IS NOT NULL) AS smiles,
   arg_min(dtxsid, pr) FILTER (ok AND dtxsid IS NOT NULL) AS dtxsid, arg_min(inchikey, pr) FILTER (ok AND inchikey IS NOT NULL) AS inchikey,
   arg_min(source, pr) FILTER (ok AND smiles IS NOT NULL) AS source
  FROM (SELECT *, match_score >= 0.35 OR source = anchor AS ok FROM scored) GROUP BY ALL),
whole AS (SELECT q_idx, cluster, max(query_match_score) AS query_score, min(origin_rank) AS least_rank, min(pool_pos) AS first_pos FROM clustered GROUP BY ALL),
judged AS (SELECT m.*, w.query_score, w.least_rank, w.first_pos,
   CASE WHEN consensus = 0 THEN 0.0 ELSE round(least(greatest(BASE_OF * (0.5 * w.query_score + 0.5) * (0.5 + 0.5 * consensus) * CASE n_source_support WHEN 1 THEN 0.85 WHEN 2 THEN 0.95 ELSE 1.0 END, 0), 1), 4) END::DOUBLE AS confidence
  FROM merged m JOIN whole w ON m.q_idx = w.q_idx AND m.cluster = w.cluster),
ranked AS (SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY confidence DESC, n_source_support DESC, query_score DESC, least_rank, first_pos) AS place FROM judged)
""".replace("BASE_OF", str(rs.BASE[method]))


_NAME_KEYS = "SELECT min(p_partkey) AS q_idx, upper(p_name) AS query FROM part GROUP BY upper(p_name) UNION ALL SELECT -1, 'NO SUCH NAME'"
#: The score of a name is the best ratio, with case, of the query and a candidate's names.
_NAME_PAIRS = "SELECT DISTINCT upper(p_name) AS a, p_name AS b FROM part UNION SELECT DISTINCT upper(p_name), p_brand FROM part"
_BY_NAME = ratio_sql(_NAME_PAIRS) + "," + _pool_sql(
    "lower(s.name) = lower(keys.query)",
    _NAME_KEYS,
    "greatest(one.score, coalesce(two.score, 0)) / 100",
    joined="JOIN ratio one ON one.a = query AND one.b = s.name LEFT JOIN ratio two ON two.a = query AND two.b = s.iupac_name",
)
_SHOWN = ["q_idx", "query", "name", "formula", "mass", "smiles", "dtxsid", "source", "consensus_source", "consensus", "confidence", "n_source_support", "hit_rank"]
_SHOWN_SQL = """k.q_idx, k.query, h.name, h.formula, round(h.mass, 4)::DOUBLE AS mass, h.smiles, h.dtxsid, h.source, h.anchor AS consensus_source,
round(h.consensus, 6)::DOUBLE AS consensus, h.confidence, h.n_source_support, h.hit_rank"""


def _shown(hits: DataFrame) -> DataFrame:
    return hits.withColumns({"mass": rounded(F.col("mass"), 4), "consensus": rounded(F.col("consensus"), 6), "consensus_source": F.col("anchor"), "hit_rank": F.col("hit_rank").cast("long")}).select(*_SHOWN)


def _resolved(spark: SparkSession, sf_dir: str, config: rs.ResolverConfig, kind: str = "name", queries: DataFrame | None = None) -> DataFrame:
    asked = queries_of(spark, sf_dir) if queries is None else queries
    return rs.resolve(asked, rs.pool(asked, catalogs(spark, sf_dir), kind, config), config)


@REG.query(f"WITH RECURSIVE {_BY_NAME} SELECT {_SHOWN_SQL} FROM keys k LEFT JOIN (SELECT *, place AS hit_rank FROM ranked WHERE place = 1) h ON k.q_idx = h.q_idx")
def resolve_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_resolved(spark, sf_dir, rs.ResolverConfig()))


@REG.query(f"WITH RECURSIVE {_BY_NAME} SELECT {_SHOWN_SQL} FROM keys k LEFT JOIN (SELECT *, place AS hit_rank FROM ranked) h ON k.q_idx = h.q_idx")
def resolve_all_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_resolved(spark, sf_dir, rs.ResolverConfig(n_hits="all")))


@REG.query(f"""WITH RECURSIVE {_BY_NAME} SELECT {_SHOWN_SQL} FROM keys k LEFT JOIN
(SELECT *, row_number() OVER (PARTITION BY q_idx ORDER BY place) AS hit_rank FROM ranked WHERE n_source_support >= 2 AND confidence >= 0.5) h ON k.q_idx = h.q_idx AND h.hit_rank <= 3""")
def resolve_min_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_resolved(spark, sf_dir, rs.ResolverConfig(n_hits=3, min_source_support=2, min_confidence=0.5)))


_has = lambda *fields: " + ".join(f"({f} IS NOT NULL)::INT" for f in fields)
_COMPLETE = f"({_has('smiles', 'inchikey', 'inchi', 'mass', 'name', 'dtxsid')} + 1) / 7.0"
_PRESENT = _has("id", "name", "iupac_name", "formula", "smiles", "canonical_smiles", "inchi", "inchikey", "dtxsid", "mass", "synonyms")
_BY_FORMULA = _pool_sql("s.formula = keys.query", "SELECT min(p_partkey) AS q_idx, p_type AS query FROM part GROUP BY p_type", _COMPLETE, f"{_PRESENT} DESC, id", "formula")


@REG.query(f"WITH {_BY_FORMULA} SELECT {_SHOWN_SQL} FROM keys k LEFT JOIN (SELECT *, place AS hit_rank FROM ranked WHERE place <= 5) h ON k.q_idx = h.q_idx")
def resolve_formula_completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("query")).agg(F.min("p_partkey").alias("q_idx")).select("q_idx", "query")
    return _shown(_resolved(spark, sf_dir, rs.ResolverConfig(n_hits=5), "formula", asked))


_TOP1 = f"SELECT {_SHOWN_SQL} FROM keys k LEFT JOIN (SELECT *, place AS hit_rank FROM ranked WHERE place = 1) h ON k.q_idx = h.q_idx"
_BY_CAS = _pool_sql("list_contains(s.cas, keys.query)", "SELECT min(p_partkey) AS q_idx, p_brand AS query FROM part GROUP BY p_brand", method="exact_cas")
_BY_SMILES = _pool_sql("s.smiles = keys.query", "SELECT min(p_partkey) AS q_idx, p_name || '@' || p_brand AS query FROM part GROUP BY 2", method="exact_smiles", hop="'chebi'")
_KEY_SQL = "SELECT min(p_partkey) AS q_idx, upper(md5(p_name || p_brand)) AS query FROM part GROUP BY 2"
_BY_KEY = _pool_sql("s.inchikey = keys.query", _KEY_SQL, method="exact_inchikey")
_OTHER_KEY_SQL = f"SELECT q_idx, substr(query, 1, 14) || '-OTHERFORM' AS query FROM ({_KEY_SQL})"
_BY_SKELETON = _pool_sql("substr(s.inchikey, 1, 14) = substr(keys.query, 1, 14)", _OTHER_KEY_SQL, method="inchikey_skeleton", top=1)


def _asked(spark: SparkSession, sf_dir: str, query) -> DataFrame:
    return table(spark, sf_dir, "part").groupBy(query.alias("query")).agg(F.min("p_partkey").alias("q_idx")).select("q_idx", "query")


@REG.query(f"WITH {_BY_CAS} SELECT {_SHOWN_SQL} FROM keys k LEFT JOIN (SELECT *, place AS hit_rank FROM ranked) h ON k.q_idx = h.q_idx")
def resolve_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_resolved(spark, sf_dir, rs.ResolverConfig(n_hits="all"), "cas", _asked(spark, sf_dir, F.col("p_brand"))))


@REG.query(f"WITH {_BY_SMILES} {_TOP1}")
def resolve_smiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_resolved(spark, sf_dir, rs.ResolverConfig(), "smiles", _asked(spark, sf_dir, F.concat("p_name", F.lit("@"), "p_brand"))))


@REG.query(f"WITH {_BY_KEY} {_TOP1}")
def resolve_inchikey(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_resolved(spark, sf_dir, rs.ResolverConfig(), "inchikey", _asked(spark, sf_dir, F.upper(F.md5(F.concat("p_name", "p_brand"))))))


@REG.query(f"WITH {_BY_SKELETON} {_TOP1}")
def resolve_skeleton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of another form with the same connectivity."""
    other = F.concat(F.substring(F.upper(F.md5(F.concat("p_name", "p_brand"))), 1, 14), F.lit("-OTHERFORM"))
    return _shown(_resolved(spark, sf_dir, rs.ResolverConfig(inchikey_skeleton=True), "inchikey", _asked(spark, sf_dir, other)))


@REG.query(f"""
WITH s AS ({_SOURCE_ROWS}), k AS (SELECT p_partkey AS q_idx, 'D' || p_partkey AS query FROM part),
first AS (SELECT k.q_idx, s.inchikey FROM k JOIN s ON s.source = 'comptox' AND s.dtxsid = k.query),
hop AS (SELECT q_idx, 'comptox' AS source, 1 AS n FROM first UNION ALL
  SELECT q_idx, source, least(count(*), 5) FROM first JOIN s ON s.inchikey = first.inchikey AND s.source <> 'comptox' GROUP BY ALL)
SELECT k.q_idx, k.query, coalesce(sum(n), 0)::BIGINT AS n_candidates, coalesce(string_agg(DISTINCT source, ',' ORDER BY source), '') AS sources FROM k LEFT JOIN hop ON k.q_idx = hop.q_idx GROUP BY ALL""")
def resolve_dtxsid_two_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("q_idx"), F.concat(F.lit("D"), F.col("p_partkey").cast("string")).alias("query"))
    found = rs.pool(asked, catalogs(spark, sf_dir), "dtxsid").groupBy("q_idx").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("s"))
    return asked.join(found, "q_idx", "left").select("q_idx", "query", F.coalesce("n", F.lit(0)).alias("n_candidates"), F.coalesce("s", F.lit("")).alias("sources"))


@REG.query(f"WITH RECURSIVE {_BY_NAME} SELECT q_idx, cluster, source, other, round(similarity, 6)::DOUBLE AS similarity FROM pairs WHERE source <> other")
def candidate_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from keyweave.functions.similarity import candidate_similarity as similarity

    asked = queries_of(spark, sf_dir)
    best = rs.best_members(rs.pool(asked, catalogs(spark, sf_dir), "name").withColumn("cluster", rs.cluster_key()))
    fields = ["cas", "canonical_smiles", "inchikey", "inchi", "formula", "mass", "name"]
    a = best.select("q_idx", "cluster", "source", *[F.col(f).alias(f"a_{f}") for f in fields])
    b = best.select("q_idx", "cluster", F.col("source").alias("other"), *[F.col(f).alias(f"b_{f}") for f in fields])
    return a.join(b, ["q_idx", "cluster"]).where("source <> other").select("q_idx", "cluster", "source", "other", F.round(similarity("a_", "b_"), 6).alias("similarity"))


@REG.query(f"WITH RECURSIVE {_BY_NAME} SELECT q_idx, cluster, source, anchor, round(match_score, 6)::DOUBLE AS match_score, round(consensus, 6)::DOUBLE AS consensus FROM scored")
def consensus_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = queries_of(spark, sf_dir)
    best = rs.best_members(rs.pool(asked, catalogs(spark, sf_dir), "name").withColumn("cluster", rs.cluster_key()))
    return rs.consensus(best).select("q_idx", "cluster", "source", "anchor", F.round("match_score", 6).alias("match_score"), F.round("consensus", 6).alias("consensus"))


@REG.query("""
SELECT cluster, count(*) AS n, min(doc_id) AS first_id FROM (
  SELECT doc_id, CASE WHEN doc_id % 4 = 0 AND length(text) >= 14 THEN 'skel:' || substr(text, 1, 14) WHEN doc_id % 4 = 0 THEN 'ik:' || text WHEN doc_id % 4 = 1 THEN 'smi:' || lang
    WHEN doc_id % 4 = 2 THEN 'name:' || lower(source) ELSE 'uniq:' || doc_id END AS cluster FROM documents) GROUP BY cluster""")
def cluster_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("doc_id") % 4
    cands = table(spark, sf_dir, "documents").select(
        "doc_id", F.when(kind == 0, F.col("text")).alias("inchikey"), F.when(kind == 1, F.col("lang")).alias("smiles"), F.lit(None).cast("string").alias("canonical_smiles"), F.when(kind == 2, F.col("source")).alias("name"), F.col("doc_id").alias("pool_pos")
    )
    return cands.withColumn("cluster", rs.cluster_key()).groupBy("cluster").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))


_METHODS = {**rs.BASE, "fuzzy_name": None, "tanimoto": None}
_GRID = ", ".join(f"('{m}', {'NULL' if b is None else b}::DOUBLE, {rs.SCORED.get(m, 'NULL')}::DOUBLE)" for m, b in _METHODS.items())


@REG.query(f"""
WITH m(method, base, scaled) AS (VALUES {_GRID}), g AS (SELECT *, s * 0.191371 AS q, c * 0.231713 AS consensus FROM m, range(0, 5) n(n), range(0, 6) s(s), range(0, 5) c(c))
SELECT method, n AS n_sources, s AS score_step, c AS consensus_step, CASE WHEN consensus = 0 THEN 0.0 ELSE
  round(least(greatest(coalesce(base, scaled * q) * (0.5 * CASE WHEN base IS NULL THEN 1.0 ELSE q END + 0.5) * (0.5 + 0.5 * consensus) * CASE n WHEN 1 THEN 0.85 WHEN 2 THEN 0.95 ELSE 1.0 END, 0), 1), 4) END::DOUBLE AS confidence FROM g""")
def confidence_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    grid = spark.createDataFrame([(m,) for m in _METHODS], "method string")
    for name, n in (("n_sources", 5), ("score_step", 6), ("consensus_step", 5)):
        grid = grid.withColumn(name, F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint"))))
    return grid.withColumn("confidence", rs.confidence(F.col("method"), F.col("consensus_step") * 0.231713, F.col("score_step") * 0.191371, F.col("n_sources")))


@REG.query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 7 = 0 THEN 'nan' ELSE ' ' || l_partkey || ' ' END AS part_text, p.p_name AS kw_name
FROM lineitem LEFT JOIN part p ON l_partkey = p_partkey AND l_partkey % 7 <> 0""")
def enrich_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("query"), F.col("p_name").alias("name"))
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_partkey") % 7 == 0, "nan").otherwise(F.concat(F.lit(" "), F.col("l_partkey").cast("string"), F.lit(" "))).alias("part_text"))
    return en.enrich(rows, "part_text", lambda keys: keys.join(part, "query", "left"))


@REG.query("""
SELECT c_custkey, coalesce(CASE WHEN c_custkey % 2 = 0 THEN c_name END, CASE WHEN c_custkey % 3 = 0 THEN c_name END) AS name,
  coalesce(CASE WHEN c_custkey % 4 = 0 THEN c_mktsegment END, CASE WHEN c_custkey % 2 <> 0 AND c_custkey % 3 = 0 THEN upper(c_name) END, CASE WHEN c_custkey % 5 = 0 THEN c_mktsegment END) AS segment,
  CASE WHEN c_custkey % 2 = 0 THEN 'a' WHEN c_custkey % 3 = 0 THEN 'b' END AS foundby FROM customer""")
def waterfall_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    none = F.lit(None).cast("string")
    a = c.where("c_custkey % 2 = 0").withColumn("segment", F.when(F.col("c_custkey") % 4 == 0, F.col("segment")))
    b = c.where("c_custkey % 3 = 0").withColumn("segment", F.upper("name"))
    last = c.where("c_custkey % 5 = 0").withColumn("name", none)
    return en.waterfall(c.select("c_custkey"), [("a", a), ("b", b), ("last", last)], "c_custkey", ["name", "segment"], until="name", last=1)


@REG.query("""
WITH r AS (SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE (o_orderkey % 4000)::VARCHAR END AS k1, CASE WHEN o_orderkey % 2 = 0 THEN (o_custkey % 3000)::VARCHAR END AS k2,
  CASE WHEN o_orderkey % 3 = 0 THEN 'x' END AS k3 FROM orders),
p AS (SELECT p_partkey::VARCHAR AS query, p_name AS name, p_retailprice AS price FROM part),
one AS (SELECT r.*, p.name, p.price, 'first' AS resolved_by FROM r JOIN p ON r.k1 = p.query AND abs(r.o_totalprice % 1000 - p.price) <= 200),
two AS (SELECT r.*, p.name, p.price, 'second' AS resolved_by FROM r JOIN p ON r.k2 = p.query AND abs(r.o_totalprice % 1000 - p.price) <= 200 WHERE o_orderkey NOT IN (SELECT o_orderkey FROM one))
SELECT o_orderkey, name AS kw_name, resolved_by, 'value' AS validated_by FROM one UNION ALL SELECT o_orderkey, name, resolved_by, 'value' FROM two
UNION ALL SELECT o_orderkey, NULL, CASE WHEN k3 IS NOT NULL THEN 'structure' ELSE 'none' END, NULL FROM r WHERE o_orderkey NOT IN (SELECT o_orderkey FROM one) AND o_orderkey NOT IN (SELECT o_orderkey FROM two)""")
def resolve_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("query"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    key = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        (F.col("o_totalprice") % 1000).alias("value"),
        F.when(key % 5 == 0, "").otherwise((key % 4000).cast("string")).alias("k1"),
        F.when(key % 2 == 0, (F.col("o_custkey") % 3000).cast("string")).alias("k2"),
        F.when(key % 3 == 0, "x").alias("k3"),
    )
    find = lambda keys: keys.join(part, "query")
    found = en.resolve_cascade(rows, "o_orderkey", [("first", "k1", find), ("second", "k2", find)], en.within_tolerance("value", "kw_price", 200), fallback=("structure", "k3"))
    return found.select("o_orderkey", "kw_name", "resolved_by", "validated_by")


@REG.query("""
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN abs(l_extendedprice / l_quantity - p_retailprice) <= 700 THEN
  'value' || CASE WHEN lower(p_brand) = lower('BRAND#' || (l_partkey % 25)) THEN '+name' ELSE '' END ELSE '' END AS accepted
FROM lineitem JOIN part ON l_partkey = p_partkey""")
def tolerance_accept(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = rows.withColumns({"unit_price": F.col("l_extendedprice") / F.col("l_quantity"), "wanted": F.concat(F.lit("BRAND#"), (F.col("l_partkey") % 25).cast("string"))})
    accept = en.within_tolerance("unit_price", "p_retailprice", 700, {"name": ("p_brand", "wanted")})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(accept(), "+").alias("accepted"))


_CAS_KEYS = "SELECT DISTINCT p_brand AS casrn FROM part UNION ALL SELECT 'NO SUCH NUMBER'"


@REG.query(f"""
WITH keys AS ({_CAS_KEYS}), a AS ({_view_sql("chebi", "duckdb")}), b AS ({_view_sql("comptox", "duckdb")}), c AS ({_view_sql("pubchem", "duckdb")}),
first AS (SELECT cas[1] AS casrn, arg_min(a, id) AS r FROM a GROUP BY 1), second AS (SELECT cas[1] AS casrn, arg_min(b, id) AS r FROM b GROUP BY 1), third AS (SELECT cas[1] AS casrn, arg_min(c, id) AS r FROM c GROUP BY 1),
met AS (SELECT k.casrn, f.r AS f, s.r AS s, CASE WHEN s.r.smiles IS NULL THEN t.r END AS t FROM keys k LEFT JOIN first f USING (casrn) LEFT JOIN second s USING (casrn) LEFT JOIN third t USING (casrn))
SELECT casrn, coalesce(f.name, s.name, t.name) AS name, coalesce(f.name, s.name, t.name) AS iupac_name, coalesce(f.formula, s.formula, t.formula) AS formula,
  coalesce(s.smiles, t.smiles) AS smiles, coalesce(f.inchikey, s.inchikey, t.inchikey) AS inchikey, s.dtxsid AS dtxsid, round(coalesce(s.mass, t.mass), 4) AS mass,
  CASE WHEN s.smiles IS NOT NULL THEN 'comptox' WHEN t.smiles IS NOT NULL THEN 'pubchem' END AS source FROM met""")
def ids_from_cas(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "part").select(F.col("p_brand").alias("query")).unionByName(spark.createDataFrame([("NO SUCH NUMBER",)], "query string"))
    found = identify.ids_from_cas(keys, catalogs(spark, sf_dir))
    return found.select("casrn", "name", "iupac_name", "formula", "smiles", "inchikey", "dtxsid", F.round("mass", 4).alias("mass"), "source")

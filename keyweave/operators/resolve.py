"""Entity resolution: pool candidates, group those of one entity, measure agreement, merge, score, rank.

Candidates are a long table: q_idx, query, source, origin_rank, pool_pos, match_method,
query_match_score and the fields of RECORD. Every step is a join or an aggregation keyed by the query,
so a batch of queries is one plan.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyweave.functions import chem
from keyweave.functions.cols import has_attachment_point, norm_name, rounded, skeleton
from keyweave.functions.similarity import best_name_score, candidate_similarity, name_matrix, tanimoto
from keyweave.operators.durable import checkpointed
from keyweave.operators.lookup import first_k, fuzzy_top_n

#: Catalogs in order of priority.
SOURCES = ("chebi", "comptox", "pubchem", "zeropm", "chembl")
#: Fields of a candidate record that are merged.
RECORD = ("name", "iupac_name", "formula", "smiles", "canonical_smiles", "inchi", "inchikey", "dtxsid", "mass", "synonyms")
#: How far a match method is trusted by itself; the last two are multiplied by their score.
BASE = {
    "exact_inchikey": 1.0,
    "opsin": 0.97,
    "exact_smiles": 0.95,
    "inchi": 0.95,
    "exact_cas": 0.90,
    "dtxsid": 0.90,
    "exact_name": 0.80,
    "inchikey_skeleton": 0.75,
    "unknown": 0.50,
    "formula": 0.30,
}
SCORED = {"fuzzy_name": 0.80, "tanimoto": 0.85}
#: Factor by the number of sources that agree; three or more count 1.
SUPPORT = {0: 1.0, 1: 0.85, 2: 0.95}
#: Which key of each catalog answers an identifier of a kind; chained ones go through another catalog's key.
DISPATCH = {
    "cas": ("exact_cas", {"chebi": "cas", "comptox": "cas", "pubchem": "cas", "zeropm": "cas", "chembl": "smiles"}),
    "name": ("exact_name", {s: "name" for s in SOURCES}),
    "smiles": ("exact_smiles", {"chebi": "inchikey", "comptox": "smiles", "pubchem": "smiles", "zeropm": "inchi", "chembl": "smiles"}),
    "inchi": ("inchi", {"chebi": "inchi", "comptox": "inchikey", "pubchem": "inchi", "zeropm": "inchi", "chembl": "smiles"}),
    "inchikey": ("exact_inchikey", {s: "inchikey" for s in SOURCES}),
    "dtxsid": ("dtxsid", {"comptox": "dtxsid", "chebi": "inchikey", "pubchem": "inchikey", "zeropm": "inchikey", "chembl": "inchikey"}),
    "formula": ("formula", {"chebi": "formula", "comptox": "formula", "pubchem": "formula"}),
}
#: Which catalogs use synonyms only where no name is equal; the others add them after the names.
SYNONYMS_LAST = ("chebi", "comptox")
#: Which catalogs take a second, canonical structure, a shared skeleton, a similar fingerprint.
CANONICAL, SKELETON, SIMILAR = ("comptox", "pubchem"), ("comptox", "pubchem", "chebi"), ("chembl", "pubchem")


@dataclass(frozen=True)
class ResolverConfig:
    n_hits: int | str = 1
    min_confidence: float = 0.0
    min_source_support: int = 0
    top_k_per_source: int = 5
    cluster_by_skeleton: bool = True
    compatible_from: float = 0.35
    query_weight: float = 0.5
    anchor_window: float = 0.05
    alternatives: bool = False
    fuzzy: bool = False
    fuzzy_cutoff: float = 80.0
    similarity_threshold: float = 0.0
    inchikey_skeleton: bool = False
    sources: tuple[str, ...] = field(default=SOURCES)

    def __post_init__(self) -> None:
        hits = self.n_hits
        if isinstance(hits, str) and hits.lower() == "all":
            return
        if isinstance(hits, bool) or not isinstance(hits, int) or hits < 1:
            raise ValueError("n_hits is a positive integer or 'all'")

    @property
    def limit(self) -> int | None:
        return None if isinstance(self.n_hits, str) else self.n_hits


def base_confidence(method: Column, score: Column) -> Column:
    out = F.when(method == "fuzzy_name", SCORED["fuzzy_name"] * F.coalesce(score, F.lit(0.0))).when(method == "tanimoto", SCORED["tanimoto"] * F.coalesce(score, F.lit(0.0)))
    for name, value in BASE.items():
        out = out.when(method == name, value)
    return out.otherwise(BASE["unknown"])


def confidence(method: Column, consensus: Column, query_score: Column, n_sources: Column, query_weight: float = 0.5) -> Column:
    """base x (w q + 1 - w) x (0.5 + 0.5 consensus) x support in [0, 1], 4 decimals; 0 without any consensus."""
    q = F.when(method.isin(*SCORED), 1.0).otherwise(F.coalesce(query_score, F.lit(1.0)))
    support = F.lit(1.0)
    for n, factor in SUPPORT.items():
        support = F.when(n_sources == n, factor).otherwise(support)
    value = base_confidence(method, query_score) * (query_weight * q + (1 - query_weight)) * (0.5 + 0.5 * consensus) * support
    return F.when(consensus == 0, 0.0).otherwise(rounded(F.least(F.greatest(value, F.lit(0.0)), F.lit(1.0)), 4))


def completeness() -> Column:
    """The share of seven facts that a candidate has: six fields, and any registry number."""
    present = [F.col(c).isNotNull().cast("int") for c in ("smiles", "inchikey", "inchi", "mass", "name", "dtxsid")]
    return (sum(present[1:], present[0]) + (F.size(F.coalesce("cas", F.array().cast("array<string>"))) > 0).cast("int")) / 7.0


def n_present() -> Column:
    """How many fields of a catalog's row have a value."""
    fields = [F.col(c).isNotNull().cast("int") for c in ("id", *RECORD)]
    return sum(fields[1:], fields[0]) + (F.size(F.coalesce("cas", F.array().cast("array<string>"))) > 0).cast("int")


def cluster_key(by_skeleton: bool = True) -> Column:
    """Candidates of one entity share it: key or skeleton, else structure, else name, else nothing.

    Two candidates can only meet inside one family, so a group key replaces union-find.
    """
    ik = F.col("inchikey")
    key = F.when(ik.isNotNull() & (F.length(ik) >= 14), F.concat(F.lit("skel:"), skeleton(ik))) if by_skeleton else F.when(F.lit(False), ik)
    structure = F.coalesce("canonical_smiles", "smiles")
    return (
        key.when(ik.isNotNull(), F.concat(F.lit("ik:"), ik))
        .when(structure.isNotNull(), F.concat(F.lit("smi:"), structure))
        .when(F.col("name").isNotNull(), F.concat(F.lit("name:"), F.lower(F.trim("name"))))
        .otherwise(F.concat(F.lit("uniq:"), F.col("pool_pos").cast("string")))
    )


def priority(source: Column, sources: tuple[str, ...] = SOURCES) -> Column:
    return F.coalesce(*[F.when(source == s, F.lit(i)) for i, s in enumerate(sources)], F.lit(len(sources)))


def best_members(clustered: DataFrame) -> DataFrame:
    """Per cluster and source one candidate: lowest origin rank, then highest score, then first in the pool."""
    order = Window.partitionBy("q_idx", "cluster", "source").orderBy("origin_rank", F.desc("query_match_score"), "pool_pos")
    return clustered.withColumn("_nth", F.row_number().over(order)).where("_nth = 1").drop("_nth")


def _member(source: Column | str, record: dict[str, Column], config: ResolverConfig) -> Column:
    """A cluster's member as a struct that sorts by the priority of its source."""
    of = F.col(source) if isinstance(source, str) else source
    return F.struct(priority(of, config.sources).alias("at"), of.alias("source"), *[c.alias(n) for n, c in record.items()])


def _agree(packed: DataFrame, config: ResolverConfig) -> DataFrame:
    """packed (members, an array of _member in order) with scores, anchor_at, anchor and consensus.

    A source's support is its mean similarity to the others, 1 if it is alone. Of the sources within
    anchor_window of the best the one of highest priority is the anchor; a score is the similarity to
    it, the consensus their mean. A cluster has one member per source, so this is at most 25 pairs,
    compared inside the row.
    """
    alike = lambda i, j: F.get(F.get(F.col("_names"), i), j)
    packed = packed.withColumn("_names", name_matrix(F.transform("members", lambda m: m["name"])))
    sims = F.transform("members", lambda a, i: F.transform("members", lambda b, j: F.when(i == j, 1.0).otherwise(candidate_similarity(a, b, alike(i, j)))))
    n = F.size("members")
    total = lambda xs: F.aggregate(xs, F.lit(0.0), lambda s, x: s + x)
    support = F.transform("_sims", lambda row, i: F.when(n == 1, 1.0).otherwise(total(F.filter(row, lambda x, j: j != i)) / (n - 1)))
    near = F.transform("_support", lambda x: x >= F.array_max("_support") - config.anchor_window)
    out = packed.withColumn("_sims", sims).withColumn("_support", support).withColumn("anchor_at", (F.array_position(near, True) - 1).cast("int"))
    out = out.withColumn("scores", F.transform("_sims", lambda row: F.get(row, F.col("anchor_at"))))
    return out.withColumns({"anchor": F.get("members", "anchor_at")["source"], "consensus": total(F.col("scores")) / n}).drop("_sims", "_support", "_names")


def consensus(members: DataFrame, config: ResolverConfig = ResolverConfig()) -> DataFrame:
    """q_idx, cluster, source, anchor, match_score and consensus of the members (one per cluster and source)."""
    record = {c: F.col(c) for c in (*RECORD, "cas")}
    packed = members.groupBy("q_idx", "cluster").agg(F.array_sort(F.collect_list(_member("source", record, config))).alias("members"))
    agreed = _agree(packed, config)
    pairs = F.arrays_zip(F.transform("members", lambda m: m["source"]).alias("source"), F.col("scores").alias("match_score"))
    return agreed.select("q_idx", "cluster", "anchor", "consensus", F.explode(pairs).alias("p")).select("q_idx", "cluster", "p.source", "anchor", "p.match_score", "consensus")


def _merged(config: ResolverConfig) -> list[Column]:
    """Each field from the first compatible member that has it, and what each source had."""
    compatible = lambda i: (F.get("scores", i) >= config.compatible_from) | (i == F.col("anchor_at"))
    first = lambda value: F.get(F.filter(F.transform("members", lambda m, i: F.when(compatible(i), value(m))), lambda v: v.isNotNull()), F.lit(0))
    has = lambda m, c: F.size(m[c]) > 0 if c == "cas" else m[c].isNotNull()
    fields = lambda m: F.array_sort(F.filter(F.array(*[F.when(has(m, c), F.lit(c)) for c in (*RECORD, "cas")]), lambda x: x.isNotNull()))
    sources = F.transform("members", lambda m: m["source"])
    return [
        *[first(lambda m, c=c: m[c]).alias(c) for c in RECORD],
        F.array_sort(F.array_distinct(F.flatten(F.filter(F.transform("members", lambda m: m["cas"]), lambda x: x.isNotNull())))).alias("cas"),
        first(lambda m: F.when(m["smiles"].isNotNull(), m["source"])).alias("source"),
        F.map_from_arrays(sources, "scores").alias("source_match_scores"),
        F.map_from_arrays(sources, F.transform("members", lambda m: F.struct(F.lit(True).alias("found"), fields(m).alias("fields")))).alias("source_details"),
        F.size("members").cast("long").alias("n_source_support"),
    ]


def resolve(queries: DataFrame, pool: DataFrame, config: ResolverConfig = ResolverConfig()) -> DataFrame:
    """Ranked hits per query: at least one row for each (q_idx, query), all null on a miss.

    Group structures (a ``*`` in the structure) are dropped unless the query has one. Hits below the
    floors are dropped before the first n_hits are taken; alternatives are the next five before floors.
    """
    kept = pool.where(~has_attachment_point(F.col("smiles")) | has_attachment_point(F.col("query")))
    clustered = kept.withColumn("cluster", cluster_key(config.cluster_by_skeleton))
    strength = base_confidence(F.col("match_method"), F.col("query_match_score"))
    # the best member of each source, then the members of each cluster: two aggregations over one pool
    score = F.coalesce("query_match_score", F.lit(float("-inf")))
    by_source = clustered.groupBy("q_idx", "cluster", "source").agg(
        F.min_by(F.struct(*RECORD, "cas"), F.struct("origin_rank", -score, "pool_pos")).alias("r"),
        F.max(F.struct(strength.alias("strength"), (-F.col("pool_pos")).alias("early"), "match_method")).alias("strongest"),
        F.max("query_match_score").alias("query_score"),
        F.min("origin_rank").alias("least_rank"),
        F.min("pool_pos").alias("first_pos"),
    )
    packed = by_source.groupBy("q_idx", "cluster").agg(
        F.array_sort(F.collect_list(_member("source", {c: F.col("r")[c] for c in (*RECORD, "cas")}, config))).alias("members"),
        F.max("strongest")["match_method"].alias("match_method"),
        F.max("query_score").alias("query_score"),
        F.min("least_rank").alias("least_rank"),
        F.min("first_pos").alias("first_pos"),
    )
    merged = _agree(packed, config).select("q_idx", "cluster", "anchor", "consensus", "match_method", "query_score", "least_rank", "first_pos", *_merged(config))
    merged = merged.withColumn("confidence", confidence(F.col("match_method"), F.col("consensus"), F.col("query_score"), F.col("n_source_support"), config.query_weight))
    by_query = Window.partitionBy("q_idx")
    order = by_query.orderBy(F.desc("confidence"), F.desc("n_source_support"), F.desc("query_score"), "least_rank", "first_pos")
    ranked = merged.withColumn("_rank", F.row_number().over(order))
    if config.alternatives:
        near = ranked.where("_rank between 2 and 6").groupBy("q_idx").agg(F.array_sort(F.collect_list(F.struct("_rank", "name", "inchikey", "confidence", "source"))).alias("_next"))
        next_ = F.transform("_next", lambda x: F.struct(x["name"].alias("name"), x["inchikey"].alias("inchikey"), x["confidence"].alias("confidence"), x["source"].alias("source")))
        ranked = ranked.join(near, "q_idx", "left").withColumn("alternatives", next_).drop("_next")
    hits = ranked.where((F.col("confidence") >= config.min_confidence) & (F.col("n_source_support") >= config.min_source_support))
    hits = hits.withColumn("hit_rank", F.row_number().over(by_query.orderBy("_rank"))).drop("_rank", "cluster", "least_rank", "first_pos")
    if config.limit is not None:
        hits = hits.where(F.col("hit_rank") <= config.limit)
    return queries.select("q_idx", "query").join(hits, "q_idx", "left")


def pool(queries: DataFrame, catalogs: dict[str, DataFrame], kind: str, config: ResolverConfig = ResolverConfig()) -> DataFrame:
    """Candidates for queries (q_idx, query) from every catalog by the keys of DISPATCH, k per source at most.

    A catalog has the columns of RECORD, cas and id. Names and synonyms are compared without case.
    Where a catalog has no key of the query's kind, the structure key that the others found leads to
    it. A structure that a catalog doesn't have is looked up again in canonical form, where a
    structure backend is installed. Queries that nothing answers are widened, if the config says so:
    names to similar ones, structures to similar fingerprints, keys to their skeleton.
    """
    method, keys = DISPATCH[kind]
    direct = {s: c for s, c in keys.items() if s in catalogs and c == kind}
    # a part that later ones or fallbacks build on is computed once
    further = any(s in catalogs and s not in direct for s in keys) or config.fuzzy or config.inchikey_skeleton or config.similarity_threshold > 0
    once = checkpointed if further else (lambda df: df)
    parts = []
    for source, column in direct.items():
        keyed = queries.select("q_idx", "query", F.col("query").alias("_key"))
        parts.append(once(_candidates(keyed, catalogs[source], source, column, method, config)))
        if kind == "smiles" and source in CANONICAL and chem.available():
            again = keyed.join(parts[-1].select("q_idx"), "q_idx", "left_anti").withColumn("_key", chem.normalise_structure("query")["canonical_smiles"])
            parts.append(once(_candidates(again, catalogs[source], source, column, method, config)))
    for source, column in keys.items():
        if source in catalogs and source not in direct and parts:
            # the first structure that a source of higher priority knows
            known = parts[0]
            for p in parts[1:]:
                known = known.unionByName(p)
            best = known.where(F.col(column).isNotNull()).groupBy("q_idx", "query").agg(F.min_by(column, F.struct(priority(F.col("source")), "origin_rank")).alias("_key"))
            parts.append(once(_candidates(best, catalogs[source], source, column, method, config)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    pending = queries.select("q_idx", "query").join(out.select("q_idx"), "q_idx", "left_anti")
    wider = []
    if kind == "name" and config.fuzzy:
        wider = [_similar_names(pending, c, s, config) for s, c in catalogs.items() if s in keys]
    elif kind == "inchikey" and config.inchikey_skeleton:
        wider = [_by_skeleton(pending, catalogs[s], s) for s in SKELETON if s in catalogs]
    elif kind == "smiles" and config.similarity_threshold > 0 and chem.available():
        wider = [_by_fingerprint(pending, catalogs[s], s, config) for s in SIMILAR if s in catalogs]
    for p in wider:
        out = out.unionByName(p)
    if kind == "smiles" and wider:
        # a query's candidates share the score of the most similar one
        best = F.max("query_match_score").over(Window.partitionBy("q_idx"))
        out = out.withColumn("query_match_score", F.when(F.col("match_method") == "tanimoto", best).otherwise(F.col("query_match_score")))
    place = Window.partitionBy("q_idx").orderBy(priority(F.col("source")), "origin_rank")
    return out.withColumn("pool_pos", F.row_number().over(place) - 1)


def _candidates(keyed: DataFrame, catalog: DataFrame, source: str, column: str, method: str, config: ResolverConfig) -> DataFrame:
    fold = F.lower if column == "name" else (lambda c: c)
    if column == "cas":
        right = catalog.withColumn("_on", F.explode("cas"))
    elif column == "name":
        right = _named(catalog).withColumn("_on", F.col("_name"))
    else:
        right = catalog.withColumn("_on", fold(F.col(column)))
    met = keyed.withColumn("_key", fold(F.col("_key"))).join(right, F.col("_key") == F.col("_on")).drop("_on")
    first = [F.desc("_present"), "id"] if method == "formula" else ["id"]
    if column == "name":
        first = ["_via", "id"]
        if source in SYNONYMS_LAST:
            met = met.withColumn("_least", F.min("_via").over(Window.partitionBy("q_idx"))).where("_via = _least")
    met = met.withColumn("_present", n_present())
    rank = F.row_number().over(Window.partitionBy("q_idx").orderBy(*first)) - 1
    score = completeness() if method == "formula" else best_name_score(F.col("query"), _all_names()) if method == "exact_name" else F.lit(1.0)
    ranked = met.withColumn("origin_rank", rank).where(F.col("origin_rank") < config.top_k_per_source)
    return ranked.select("q_idx", "query", F.lit(source).alias("source"), "origin_rank", F.lit(method).alias("match_method"), score.alias("query_match_score"), *RECORD, "cas")


def _all_names() -> Column:
    """A row's name, IUPAC name and synonyms, without missing ones."""
    synonyms = F.transform(F.split(F.coalesce(F.col("synonyms").cast("string"), F.lit("")), ";"), lambda n: F.trim(n))
    return F.filter(F.concat(F.array("name", "iupac_name"), synonyms), lambda n: n.isNotNull() & (n != ""))


def _named(catalog: DataFrame, iupac: bool = False) -> DataFrame:
    """A catalog's rows once for each different name in lower case: _via 0 for the name, 1 for synonyms, 2 for the IUPAC name."""
    clean = lambda via, names: F.transform(names, lambda n: F.struct(F.lit(via).alias("via"), F.lower(n).alias("name")))
    synonyms = F.transform(F.split(F.coalesce(F.col("synonyms").cast("string"), F.lit("")), ";"), lambda n: F.trim(n))
    every = [clean(0, F.array("name")), clean(1, synonyms)] + ([clean(2, F.array("iupac_name"))] if iupac else [])
    held = F.filter(F.concat(*every), lambda n: n["name"].isNotNull() & ((n["via"] == 0) | (n["name"] != "")))
    # of equal names the first
    once = F.filter(held, lambda n, i: F.array_position(F.transform(held, lambda x: x["name"]), n["name"]) == i + 1)
    return catalog.withColumn("_n", F.explode(once)).withColumn("_via", F.col("_n.via")).withColumn("_name", F.col("_n.name")).drop("_n")


def _tagged(found: DataFrame, source: str, method: str, score: Column) -> DataFrame:
    return found.select("q_idx", "query", F.lit(source).alias("source"), (F.col("rank") - 1).alias("origin_rank"), F.lit(method).alias("match_method"), score.alias("query_match_score"), *RECORD, "cas")


def _similar_names(pending: DataFrame, catalog: DataFrame, source: str, config: ResolverConfig) -> DataFrame:
    """Rows of which a name reaches the cutoff; zeropm gives its most similar one, the others rows that contain the normalised query."""
    named = _named(catalog, iupac=True)
    near = fuzzy_top_n(pending, named.select("_name"), "query", "_name", config.fuzzy_cutoff, None, F.lower).select("query", F.col("name").alias("_name"), "score")
    met = pending.join(near, "query").join(named, "_name")
    by_row = Window.partitionBy("q_idx", "id")
    met = met.withColumn("_best", F.max("score").over(by_row)).where("_via < 2")
    if source != "zeropm":
        met = met.where(F.contains(F.col("_name"), norm_name(F.col("query"))))
    met = met.withColumn("_nth", F.row_number().over(by_row.orderBy("_via", F.desc("score"), "_name"))).where("_nth = 1")
    if source in SYNONYMS_LAST:
        met = met.withColumn("_least", F.min("_via").over(Window.partitionBy("q_idx"))).where("_via = _least")
    order, k = ([F.desc("_best"), "id"], 1) if source == "zeropm" else (["_via", "id"], config.top_k_per_source)
    return _tagged(first_k(met, ["q_idx"], order, k), source, "fuzzy_name", F.col("_best") / 100)


def _by_skeleton(pending: DataFrame, catalog: DataFrame, source: str) -> DataFrame:
    """The first row with the connectivity of the key."""
    met = pending.withColumn("_skeleton", skeleton(F.col("query"))).join(catalog.withColumn("_skeleton", skeleton(F.col("inchikey"))), "_skeleton")
    return _tagged(first_k(met, ["q_idx"], ["id"], 1), source, "inchikey_skeleton", F.lit(1.0))


def _by_fingerprint(pending: DataFrame, catalog: DataFrame, source: str, config: ResolverConfig, salts: int = 16) -> DataFrame:
    """The row with the most similar fingerprint at or above the threshold: an equi-join on (bit count, salt)."""
    t = config.similarity_threshold
    ones = lambda c: F.aggregate(c, F.lit(0), lambda s, x: s + F.bit_count(x))
    left = pending.withColumn("_a", chem.morgan_bits("query")).withColumn("_n", ones(F.col("_a"))).where("_n > 0")
    counts = F.sequence(F.ceil(F.col("_n") * t - 1e-9).cast("int"), F.floor(F.col("_n") / t + 1e-9).cast("int"))
    left = left.where(F.lit(t <= 1)).withColumn("_count", F.explode(counts)).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    right = catalog.withColumn("_b", chem.morgan_bits("smiles")).withColumn("_count", ones(F.col("_b"))).withColumn("_salt", F.pmod(F.xxhash64("id"), F.lit(salts)).cast("int"))
    met = left.join(right, ["_count", "_salt"]).withColumn("_score", tanimoto(F.col("_a"), F.col("_b"))).where(F.col("_score") >= t)
    return _tagged(first_k(met, ["q_idx"], [F.desc("_score"), "id"], 1), source, "tanimoto", F.col("_score"))

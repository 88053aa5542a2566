import zipfile

import pytest
from pyspark.sql import functions as F

from keyweave.functions.cols import norm_name
from keyweave.operators import classify, enrich, identify, inventory, lookup, memo
from keyweave.operators import resolve as rs
from keyweave.plans import catalogue, resolve_queries
from keyweave.sources import files, rest
from keyweave.sources.catalogs import COLUMN_MAPS, Registry, as_candidates
from keyweave.streaming.enrich import enrich_stream

NAMES = ["aspirin", "caffeine", "toluene", "ethanol"]


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture
def names(spark):
    return spark.createDataFrame([(i, n) for i, n in enumerate(NAMES)], "id bigint, name string")


def test_lookup_keeps_queries_and_takes_the_first(spark):
    catalog = spark.createDataFrame([(1, "a"), (2, "a"), (3, "B"), (4, None)], "id bigint, k string")
    queries = spark.createDataFrame([("a",), ("b",), ("zz",), (None,)], "q string")
    got = lookup.lookup(queries, catalog, "q", "k", ["id"])
    assert {r["q"]: r["id"] for r in got.collect()} == {"a": 1, "b": None, "zz": None, None: None}
    folded = lookup.lookup(queries, catalog, "q", "k", ["id"], k=None, fold=F.lower)
    assert sorted((r["q"], r["id"]) for r in folded.where("id is not null").collect()) == [("a", 1), ("a", 2), ("b", 3)]


def test_substring_search(spark, names):
    queries = spark.createDataFrame([("FF",), ("pirin",), ("nothing",), ("e",)], "q string")
    got = lookup.contains_pairs(queries, names, "q", "name", "id")
    assert rows(got, "key", "id") == [("FF", 1), ("e", 1), ("e", 2), ("e", 3), ("pirin", 0)]


@pytest.mark.parametrize("typo, name", [("asprin", "aspirin"), ("caffiene", "caffeine"), ("tolune", "toluene"), ("zzzznotachemical", None)])
def test_fuzzy(spark, names, typo, name):
    queries = spark.createDataFrame([(typo,)], "q string")
    got = lookup.exact_then_fuzzy(queries, names, "q", "name", norm_name).collect()
    assert [r["name"] for r in got] == ([name] if name else [])
    assert all(r["match_method"] == "fuzzy_name" and r["score"] < 100 for r in got)
    right = lookup.exact_then_fuzzy(spark.createDataFrame([("Aspirin",)], "q string"), names, "q", "name", norm_name).collect()
    assert [(r["name"], r["match_method"], r["score"]) for r in right] == [("aspirin", "exact_name", 100.0)]


def test_fuzzy_loses_nothing_against_all_pairs(spark):
    import random

    from keyweave.functions.similarity import _indel

    rng = random.Random(3)
    words = ["".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = {(r["query"], r["name"]) for r in lookup.fuzzy_top_n(df, df, "w", "w", 70, 1000).collect()}
    assert got == {(a, b) for a in words for b in words if _indel(a, b) >= 70}


@pytest.mark.parametrize("bad", [0, -1, True, "x", 1.5])
def test_n_hits(bad):
    with pytest.raises(ValueError):
        rs.ResolverConfig(n_hits=bad)
    assert rs.ResolverConfig(n_hits="ALL").limit is None and rs.ResolverConfig(n_hits=5).limit == 5


def scored(spark, method, consensus, q, n):
    df = spark.createDataFrame([(method, consensus, q, n)], "m string, c double, q double, n int")
    return df.select(rs.confidence(F.col("m"), F.col("c"), F.col("q"), F.col("n"))).first()[0]


def test_confidence(spark):
    assert scored(spark, "exact_cas", 1.0, 1.0, 1) == 0.765
    assert scored(spark, "exact_cas", 0.9506, 1.0, 3) == 0.8778
    assert scored(spark, "opsin", 1.0, 1.0, 0) == 0.97
    assert scored(spark, "exact_cas", 0.0, 1.0, 3) == 0.0
    for method in [*rs.BASE, *rs.SCORED]:
        by_support = [scored(spark, method, 1.0, 0.9, n) for n in range(1, 6)]
        assert by_support == sorted(by_support) and all(0 <= x <= 1 for x in by_support)


def test_a_confidence_just_under_a_half_is_rounded_down(spark):
    """0.9 x 0.95 x 0.95 is 0.8122499999999999 as a double."""
    assert scored(spark, "exact_cas", 0.9, 1.0, 2) == 0.8122


def test_a_key_confirmed_by_two_catalogs_has_the_confidence_of_the_sql(spark):
    """Two catalogs that agree in 9 of 10 points: 0.95 x 0.975 is 0.9262499999999999 as a double."""
    asked = spark.createDataFrame([(1, ASPIRIN["inchikey"])], "q_idx bigint, query string")
    # number 3, key 3, formula 1, name 1 and 1 of 2 for a mass within 1
    held = {"chebi": catalog(spark, dict(smiles=None)), "comptox": catalog(spark, dict(mass=180.66))}
    got = rs.resolve(asked, rs.pool(asked, held, "inchikey")).first()
    assert (got["consensus"], got["confidence"]) == (0.95, 0.9262)


def test_masses_of_keys_are_rounded_as_in_the_sql(spark, tmp_path):
    """Masses at a half of the fourth decimal, as doubles under it, over it and on it."""
    duckdb = pytest.importorskip("duckdb")
    prices = [2.69445, 2.18035, 7075.61005, 183.97005, 0.00005, 901.25, -2.69445, None]
    # numbers that only the first source sees, so the price is the mass
    parts = [(2 + 30 * i, f"n{i}", "b", "t", 1, x) for i, x in enumerate(prices)]
    spark.createDataFrame(parts, "p_partkey bigint, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(str(tmp_path / "part.parquet"))
    got = resolve_queries.resolve_inchikey(spark, str(tmp_path))
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW part AS SELECT * FROM read_parquet('{tmp_path}/part.parquet/*.parquet')")
        want = con.execute(f"SELECT q_idx, mass FROM ({catalogue.oracle_sql()['resolve_inchikey']}) ORDER BY ALL").fetchall()
    assert len(want) == len(prices) and rows(got, "q_idx", "mass") == want


ASPIRIN = dict(name="aspirin", iupac_name=None, formula="C9H8O4", smiles="CC(=O)Oc1ccccc1C(=O)O", canonical_smiles=None, inchi=None, inchikey="BSYNRYMUTXBXSQ-UHFFFAOYSA-N", dtxsid=None, mass=180.16, synonyms=None, cas=["50-78-2"])
SCHEMA = "id string, name string, iupac_name string, formula string, smiles string, canonical_smiles string, inchi string, inchikey string, dtxsid string, mass double, synonyms string, cas array<string>"


def catalog(spark, *records):
    columns = [c.split()[0] for c in SCHEMA.split(", ")]
    return spark.createDataFrame([tuple({"id": str(i), **ASPIRIN, **r}[c] for c in columns) for i, r in enumerate(records)], SCHEMA)


@pytest.fixture
def catalogs(spark):
    return {
        "chebi": catalog(spark, {}),
        "comptox": catalog(spark, {"dtxsid": "DTXSID5020108"}, {"name": "ethanol", "inchikey": "LFQSCWFLJHTTHZ-UHFFFAOYSA-N", "smiles": "CCO", "formula": "C2H6O", "mass": 46.07, "cas": ["64-17-5"]}),
        "pubchem": catalog(spark, {"name": "Aspirin"}, {"name": "poly*", "smiles": "*CC*", "inchikey": None, "formula": "C9H8O4", "cas": []}),
    }


@pytest.mark.parametrize(
    "kind, query, sources",
    [("cas", "50-78-2", 3), ("name", "ASPIRIN", 3), ("inchikey", ASPIRIN["inchikey"], 3), ("smiles", ASPIRIN["smiles"], 3), ("dtxsid", "DTXSID5020108", 3), ("formula", "C9H8O4", 3), ("name", "nonsense", None)],
)
def test_resolve(spark, catalogs, kind, query, sources):
    asked = spark.createDataFrame([(7, query)], "q_idx bigint, query string")
    got = rs.resolve(asked, rs.pool(asked, catalogs, kind)).collect()
    assert len(got) == 1 and got[0]["query"] == query
    assert got[0]["n_source_support"] == sources
    if sources:
        assert got[0]["inchikey"] == ASPIRIN["inchikey"] and got[0]["dtxsid"] == "DTXSID5020108" and got[0]["cas"] == ["50-78-2"]
        assert got[0]["source_details"]["comptox"]["found"] and "dtxsid" in got[0]["source_details"]["comptox"]["fields"]


def test_group_structures_are_dropped_unless_asked_for(spark, catalogs):
    config = rs.ResolverConfig(n_hits="all", alternatives=True)
    asked = spark.createDataFrame([(1, "C9H8O4")], "q_idx bigint, query string")
    assert all("*" not in (r["smiles"] or "") for r in rs.resolve(asked, rs.pool(asked, catalogs, "formula"), config).collect())
    asked = spark.createDataFrame([(1, "*CC*")], "q_idx bigint, query string")
    assert [r["smiles"] for r in rs.resolve(asked, rs.pool(asked, catalogs, "smiles")).collect()] == ["*CC*"]



def _pool_of(spark, query, catalogs, kind, **settings):
    asked = spark.createDataFrame([(7, query)], "q_idx bigint, query string")
    found = rs.pool(asked, catalogs, kind, rs.ResolverConfig(**settings)).orderBy("pool_pos").collect()
    return [(r["source"], r["match_method"], round(r["query_match_score"], 4), r["name"]) for r in found]


def test_names_fall_back_to_synonyms(spark):
    both = [{"name": "aspirin", "synonyms": "ASA; aspirin"}, {"name": "asa", "synonyms": "x;ASA"}, {"name": "other", "synonyms": "Asa"}]
    held = {"chebi": catalog(spark, *both), "pubchem": catalog(spark, *both)}
    assert _pool_of(spark, "ASA", held, "name") == [("chebi", "exact_name", 1.0, "asa"), *[("pubchem", "exact_name", x, n) for n, x in (("asa", 1.0), ("aspirin", 1.0), ("other", 0.3333))]]
    assert [x[::3] for x in _pool_of(spark, "X", held, "name")] == [("chebi", "asa"), ("pubchem", "asa")]


def test_names_are_widened_if_asked(spark):
    rows_ = [{"name": "acetylsalicylic acid", "iupac_name": None}, {"name": "aspirin"}, {"name": "aspirins", "iupac_name": "aspirin x"}]
    held = {s: catalog(spark, *rows_) for s in ("chebi", "zeropm")}
    assert _pool_of(spark, "asprin", held, "name") == []
    assert _pool_of(spark, "asprin", held, "name", fuzzy=True) == [("zeropm", "fuzzy_name", round(12 / 13, 4), "aspirin")]
    assert _pool_of(spark, "spirin", held, "name", fuzzy=True) == [("chebi", "fuzzy_name", round(12 / 13, 4), "aspirin"), ("chebi", "fuzzy_name", round(12 / 14, 4), "aspirins"), ("zeropm", "fuzzy_name", round(12 / 13, 4), "aspirin")]
    assert {x[1] for x in _pool_of(spark, "aspirin", held, "name", fuzzy=True)} == {"exact_name"}


def test_keys_fall_back_to_the_skeleton_if_asked(spark, catalogs):
    key = ASPIRIN["inchikey"][:14] + "-AAAAAAAAAA-N"
    assert _pool_of(spark, key, catalogs, "inchikey") == []
    assert [x[:3] for x in _pool_of(spark, key, catalogs, "inchikey", inchikey_skeleton=True)] == [(s, "inchikey_skeleton", 1.0) for s in ("chebi", "comptox", "pubchem")]


def test_structures_fall_back_to_canonical_and_similar_ones(spark, monkeypatch):
    from pyspark.sql import functions as F

    # a stand-in for the structure backend: lower case is canonical, each letter a bit
    monkeypatch.setattr(rs.chem, "available", lambda: True)
    monkeypatch.setattr(rs.chem, "normalise_structure", lambda c: F.struct(F.upper(F.col(c)).alias("canonical_smiles")))
    bits = lambda c: F.array(F.expr(f"aggregate(array_distinct(split(upper({c}), '')), 0L, (s, x) -> s | shiftleft(1L, ascii(x) % 64))"))
    monkeypatch.setattr(rs.chem, "morgan_bits", bits)
    held = {s: catalog(spark, {"name": "one", "smiles": "CNO"}, {"name": "two", "smiles": "CNOPS"}, {"name": "far", "smiles": "F"}) for s in ("comptox", "pubchem", "chembl")}
    assert _pool_of(spark, "cno", held, "smiles") == [(s, "exact_smiles", 1.0, "one") for s in ("comptox", "pubchem")]
    assert _pool_of(spark, "CNOP", held, "smiles") == []
    assert _pool_of(spark, "CNOP", held, "smiles", similarity_threshold=0.6) == [(s, "tanimoto", 0.8, "two") for s in ("pubchem", "chembl")]
    assert _pool_of(spark, "CNOP", held, "smiles", similarity_threshold=0.9) == []


def test_resolve_does_not_depend_on_partitions(spark, catalogs):
    asked = spark.createDataFrame([(i, q) for i, q in enumerate(["aspirin", "ethanol", "x"])], "q_idx bigint, query string")
    want = None
    for n in (1, 16):
        moved = {k: v.repartition(n) for k, v in catalogs.items()}
        got = rows(rs.resolve(asked.repartition(n), rs.pool(asked, moved, "name")), "q_idx", "name", "confidence", "source", "anchor")
        assert want in (None, got)
        want = got


@pytest.mark.parametrize("by_skeleton, n", [(True, 3), (False, 4)])
def test_clusters(spark, by_skeleton, n):
    data = [("AAAAAAAAAAAAAA-BBBBBBBBBB-N", None, None, 0), ("AAAAAAAAAAAAAA-CCCCCCCCCC-N", None, None, 1), (None, None, "Name ", 2), (None, None, "name", 3), (None, None, None, 4)]
    df = spark.createDataFrame(data, "inchikey string, smiles string, name string, pool_pos int").withColumn("canonical_smiles", F.lit(None).cast("string"))
    assert df.select(rs.cluster_key(by_skeleton)).distinct().count() == n


def test_enrich(spark):
    df = spark.createDataFrame([(1, " a "), (2, "a"), (3, None), (4, "nan"), (5, "zz")], "id int, k string")
    asked = []

    def find(keys):
        asked.extend(sorted(r["query"] for r in keys.collect()))
        return keys.join(spark.createDataFrame([("a", 10)], "query string, v int"), "query", "left")

    got = enrich.enrich(df, "k", find)
    assert {r["id"]: r["kw_v"] for r in got.collect()} == {1: 10, 2: 10, 3: None, 4: None, 5: None}
    assert asked == ["a", "zz"] and got.columns == ["id", "k", "kw_v"]
    with pytest.raises(ValueError):
        enrich.enrich(df.withColumn("kw_v", F.lit(1)), "k", find)
    with pytest.raises(KeyError):
        enrich.enrich(df, "none", find)


def test_cascade(spark):
    df = spark.createDataFrame([(1, "a", None, 5.0, None), (2, "b", "c", 9.0, None), (3, "", "c", 9.0, None), (4, None, None, 1.0, "x")], "id int, k1 string, k2 string, v double, s string")
    known = spark.createDataFrame([("a", 5.2), ("b", 1.0), ("c", 9.1)], "query string, w double")
    find = lambda keys: keys.join(known, "query")
    got = enrich.resolve_cascade(df, "id", [("one", "k1", find), ("two", "k2", find)], enrich.within_tolerance("v", "kw_w", 0.5), fallback=("structure", "s"))
    assert [(r["id"], r["kw_w"], r["resolved_by"], r["validated_by"]) for r in got.orderBy("id").collect()] == [(1, 5.2, "one", "value"), (2, 9.1, "two", "value"), (3, 9.1, "two", "value"), (4, None, "structure", None)]


def test_waterfall(spark):
    keys = spark.createDataFrame([("x",), ("y",), ("z",)], "k string")
    a = spark.createDataFrame([("x", "S1", None), ("y", None, "n")], "k string, smiles string, name string")
    b = spark.createDataFrame([("x", "S2", "late"), ("y", "S3", "other")], "k string, smiles string, name string")
    c = spark.createDataFrame([("x", "S4", "last")], "k string, smiles string, name string")
    got = enrich.waterfall(keys, [("a", a), ("b", b), ("c", c)], "k", ["smiles", "name"], until="smiles", last=1)
    assert {r["k"]: tuple(r)[1:] for r in got.collect()} == {"x": ("S1", "last", "a"), "y": ("S3", "n", "b"), "z": (None, None, None)}


def test_ids_from_cas(spark):
    def catalog(*records):
        columns = {c: c for c in ("id", "name", "iupac_name", "smiles", "inchikey", "mass", "cas")}
        return as_candidates(spark.createDataFrame(list(records), "id string, name string, iupac_name string, smiles string, inchikey string, mass double, cas string"), columns)

    catalogs = {
        "chebi": catalog(("2", "late", "x", "S9", None, 9.0, "50-78-2"), ("1", "one", "x", None, "K1", 9.0, "50-78-2"), ("3", "two", None, "S2", None, 9.0, "58-08-2")),
        "comptox": catalog(("4", "other", "iupac", "S1", "K9", None, "50-78-2"), ("5", "unasked", None, "S8", None, 1.0, "58-08-2")),
        "zeropm": catalog(("6", "no name taken", None, None, "K3", 3.0, "64-17-5")),
        "chembl": catalog(("8", "of the structure", None, "S1", "K8", 180.2, None), ("7", "of the structure", None, "S1", "K7", 180.1, None)),
    }
    keys = spark.createDataFrame([("50-78-2",), (" 50-78-2 ",), ("58-08-2",), ("64-17-5",), ("7732-18-5",), ("",), (None,)], "query string")
    got = {r["casrn"]: tuple(r)[1:] for r in identify.ids_from_cas(keys, catalogs).select("casrn", "name", "iupac_name", "smiles", "inchikey", "mass", "source").collect()}
    assert got == {
        "50-78-2": ("one", "one", "S1", "K1", 180.1, "comptox"),
        "58-08-2": ("two", "two", "S2", None, None, "chebi"),
        "64-17-5": (None, None, None, "K3", None, None),
        "7732-18-5": (None, None, None, None, None, None),
    }
    assert identify.ids_from_cas(keys, {}).count() == 4


def test_stream(spark, tmp_path):
    spark.createDataFrame([("a",), ("b",)], "k string").write.parquet(str(tmp_path / "in"))
    known = spark.createDataFrame([("a", 1)], "query string, v int")
    stream = spark.readStream.schema("k string").parquet(str(tmp_path / "in"))
    query = enrich_stream(stream, "k", lambda keys: keys.join(known, "query", "left"), str(tmp_path / "out"), str(tmp_path / "check"), once=True)
    query.awaitTermination(120)
    assert {r["k"]: r["kw_v"] for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"a": 1, "b": None}


def test_memo(spark, tmp_path):
    store = memo.MemoStore(spark, str(tmp_path), "s", "key string, value string")
    calls = []

    def compute(misses):
        found = [r["key"] for r in misses.collect()]
        calls.append(sorted(found))
        return spark.createDataFrame([(k, None if k == "n" else k * 2) for k in found], "key string, value string")

    keys = spark.createDataFrame([("a",), ("a",), ("n",)], "key string")
    for _ in range(2):
        everything, new = memo.memoised(keys, store.table(), compute)
        assert {r["key"]: r["value"] for r in everything.collect()} == {"a": "aa", "n": None}
        if not calls[1:]:
            store.append(new)
    assert calls == [["a", "n"], []] and store.info()["entries"] == 2
    store.export(str(tmp_path / "e"), "json")
    store.load(str(tmp_path / "e"), "json", merge=False)
    assert store.info()["entries"] in (0, 2)
    store.clear()
    assert store.info() == {"entries": 0, "bytes": 0}


def test_classify(spark):
    data = spark.createDataFrame([("CCO", "K1"), ("CCO", "K1"), ("C", None), ("bad", "K3")], "structure string, inchikey string")
    known = spark.createDataFrame([("K1::1", {"7": 0.5})], "key string, labels map<string,double>")
    got, new = classify.classify(data, lambda batch: [None if s == "bad" else {"9": 1.0, "10": 0.25} for s in batch], known, "1")
    shown = classify.label_columns(got, spark.createDataFrame([("9", "nine")], "id string, name string"))
    assert sorted((r["structure"], r["class_ids"], r["class_scores"], r["class_names"]) for r in shown.where("labels is not null").collect()) == [("C", "10|9", "0.25|1", "10|nine"), ("CCO", "7", "0.5", "7"), ("CCO", "7", "0.5", "7")]
    assert sorted(r["key"] for r in new.collect()) == ["C::1", "K3::1"]


def test_inventory_level_needs_a_place():
    with pytest.raises(ValueError):
        inventory.at_level("country")


SDF = """
  x
M  END
> <ChEBI ID>
CHEBI:15365

> <ChEBI NAME>
aspirin

> <STAR>
3

> <CAS Registry Numbers>
50-78-2; 11126-35-5

> <MASS>
180.16

$$$$
> <ChEBI NAME>
no id
$$$$
"""


def test_sdf(spark, tmp_path):
    (tmp_path / "a.sdf").write_text(SDF)
    got = files.read_sdf(spark, str(tmp_path / "a.sdf"))
    row = got.collect()
    assert len(row) == 1 and (row[0]["chebi_id"], row[0]["name"], row[0]["star"], row[0]["cas"], row[0]["mass"], row[0]["synonyms"]) == ("CHEBI:15365", "aspirin", 3, ["50-78-2", "11126-35-5"], 180.16, [])
    assert as_candidates(got, COLUMN_MAPS["chebi"]).first()["cas"] == ["11126-35-5", "50-78-2"]


def workbook(path):
    main, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{main}" xmlns:r="{rel}"><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="x"><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>UUID</t></si><si><r><t>Na</t></r><r><t>me</t></r></si></sst>')
        cells = '<row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>7</v></c><c r="C2" t="inlineStr"><is><t>x</t></is></c></row><row><c r="C3"><v>8</v></c></row>'
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData>{cells}</sheetData></worksheet>')


def test_xlsx(spark, tmp_path):
    workbook(tmp_path / "a.xlsx")
    assert [tuple(r) for r in files.read_xlsx(spark, str(tmp_path / "a.xlsx"), ["Name", "UUID"]).collect()] == [("x", "7"), ("8", None)]
    with pytest.raises(ValueError):
        files.sheet_rows((tmp_path / "a.xlsx").read_bytes(), "other")
    with pytest.raises(Exception, match="missing"):
        files.read_xlsx(spark, str(tmp_path / "a.xlsx"), ["Nope"]).collect()


def test_split_export(spark):
    df = spark.createDataFrame([(1, "a", "50-00-0|x|InChI=1S/y|BSYNRYMUTXBXSQ-UHFFFAOYSA-N", None), (2, "b", None, "OWN")], "cid bigint, cmpdname string, cmpdsynonym string, inchikey string")
    got = files.split_export(df)
    assert rows(got["cas_numbers"], "cid", "cas") == [(1, "50-00-0")] and rows(got["synonyms"], "cid", "synonym") == [(1, "x")]
    assert {r["cid"]: (r["inchi"], r["inchikey"]) for r in got["compounds"].collect()} == {1: ("InChI=1S/y", "BSYNRYMUTXBXSQ-UHFFFAOYSA-N"), 2: (None, "OWN")}


def test_registry_records_what_fails(spark):
    got = Registry().add("chebi", lambda: spark.read.parquet("/nowhere")).add("pubchem", spark.createDataFrame([(1, "n")], "cid bigint, cmpdname string"))
    assert list(got.catalogs) == ["pubchem"] and "chebi" in got.failed


def test_rest(spark, tmp_path):
    keys = spark.createDataFrame([("a b",), ("a b",), (None,), ("c",)], "k string")
    got = rest.fetch(keys, "k", "opsin", get=lambda url: (200, url) if "a%20b" in url else (404, None), pause=0.0)
    assert rows(got, "key", "status") == [("a b", 200), ("c", 404)]
    assert rest.build_url("nci", "x/y", "smiles").endswith("/x%2Fy/smiles")
    settings = rest.Settings(str(tmp_path / "s.json"))
    settings.set_key("cas", "k")
    assert settings.key("cas") == "k" and settings.services() == ["cas"] and settings.remove_key("cas") and not settings.remove_key("cas")


def test_two_hops_over_every_part(spark):
    from keyweave.plans import resolve_queries as rq

    sf = "/root/testdata/sf0.001"
    held = {s: c.select("id", "inchikey", "dtxsid").collect() for s, c in rq.catalogs(spark, sf).items()}
    parts = [r["p_partkey"] for r in spark.read.parquet(f"{sf}/part.parquet").select("p_partkey").collect()]
    want = {}
    for p in parts:
        first = [r["inchikey"] for r in held["comptox"] if r["dtxsid"] == f"D{p}"]
        want[p] = sorted(["comptox"] * len(first) + [s for s in held if s != "comptox" for _ in [r for r in held[s] if first and r["inchikey"] == first[0]][:5]])
    asked = spark.createDataFrame([(p, f"D{p}") for p in parts], "q_idx bigint, query string")
    got = {p: [] for p in parts}
    for r in rs.pool(asked, rq.catalogs(spark, sf), "dtxsid").collect():
        got[r["q_idx"]].append(r["source"])
    assert {p: sorted(x) for p, x in got.items()} == want and any(want[p] for p in parts if p % 4)


def test_exact_then_fuzzy_over_every_part(spark):
    from keyweave.functions.similarity import _indel

    names = [r[0] for r in spark.read.parquet("/root/testdata/sf0.001/part.parquet").select("p_name").distinct().collect()]
    keys = sorted({*names, *(n[0] + n[2:] for n in names), "zzzznosuchname"})
    want = set()
    for q in keys:
        near = sorted((-_indel(q, n), n) for n in names if _indel(q, n) >= 80)[:5]
        want |= {(q, q, "exact_name")} if q in names else {(q, n, "fuzzy_name") for _, n in near}
    got = lookup.exact_then_fuzzy(spark.createDataFrame([(k,) for k in keys], "query string"), spark.createDataFrame([(n,) for n in names], "p_name string"), "query", "p_name", norm_name)
    assert {(r["query"], r["name"], r["match_method"]) for r in got.collect()} == want


def test_closure_of_long_chains_and_cycles(spark):
    edges = [(i, i + 1) for i in range(130)] + [(1000, 1001), (1001, 1002), (1002, 1000), (2000, 1000), (7, 7), (5, 9), (5, 9), (3000, None)]
    up = {}
    for a, b in edges:
        up.setdefault(a, set()).add(b)
    want = set()
    for a in up:
        seen, todo = set(), list(up[a])
        while todo:
            b = todo.pop()
            if b not in seen:
                seen.add(b)
                todo += up.get(b, ())
        want |= {(a, b) for b in seen}
    got = lookup.closure(spark.createDataFrame(edges, "c bigint, p bigint"), "c", "p").collect()
    assert len(got) == len(want) and {(r["node"], r["ancestor"]) for r in got} == want


def test_names_count_in_a_consensus(spark):
    """Names that are alike but not equal weigh as their Ratcliff-Obershelp ratio says."""
    from difflib import SequenceMatcher

    from keyweave.functions.similarity import name_matrix

    names = ["Acetylsalicylic acid", "acetylsalicylic acid ", "acetyl salicylate", "zinc", None]
    df = spark.createDataFrame([(names,)], "n array<string>")
    got = df.select(name_matrix("n").alias("m")).first()["m"]
    clean = [n.strip().lower() if n else None for n in names]
    assert got == [[0.0 if not x or not y else SequenceMatcher(None, x, y).ratio() for y in clean] for x in clean]
    rows = [{"name": n, "cas": [], "inchikey": "K" * 14 + s, "smiles": None, "canonical_smiles": None, "formula": None, "mass": None} for n, s in (("acetylsalicylic acid", "A"), ("acetylsalicylate acid", "A"), ("zinc", "A"))]
    members = spark.createDataFrame([(1, "c", s, r["name"], r["inchikey"]) for s, r in zip(("chebi", "comptox", "pubchem"), rows)], "q_idx bigint, cluster string, source string, name string, inchikey string")
    for c in (*rs.RECORD, "cas"):
        if c not in members.columns:
            members = members.withColumn(c, F.lit(None).cast("double" if c == "mass" else "array<string>" if c == "cas" else "string"))
    found = {r["source"]: r["match_score"] for r in rs.consensus(members).collect()}
    ratio = lambda a, b: SequenceMatcher(None, rows[a]["name"], rows[b]["name"]).ratio()
    gain = lambda x: 1.0 if x >= 0.9 else 0.5 if x >= 0.7 else 0.0
    assert found["chebi"] == 1.0 and found["comptox"] == pytest.approx((3 + gain(ratio(0, 1))) / 4) and found["pubchem"] == pytest.approx((3 + gain(ratio(0, 2))) / 4)


def test_scores_of_names(spark):
    """The best ratio over name, IUPAC name and synonyms, with case, tells how well a name was met."""
    held = {"pubchem": catalog(spark, {"name": "Aspirin", "synonyms": "ASPIRIN; x"}, {"name": "aspirin", "iupac_name": "y", "synonyms": None})}
    got = {x[3]: x[2] for x in _pool_of(spark, "ASPIRIN", held, "name")}
    assert got == {"Aspirin": 1.0, "aspirin": 0.0}


@pytest.mark.parametrize(
    "name, a, b, want",
    [
        ("ratio", "abc", "abd", 200 * 2 / 6), ("partial_ratio", "bcd", "abcde", 100), ("partial_ratio", "", "", 100), ("token_sort_ratio", "new york mets", "mets new york", 100), ("token_set_ratio", "fuzzy was a bear", "fuzzy fuzzy was a bear", 100),
        ("token_set_ratio", "", "x", 0), ("WRatio", "", "x", 0), ("WRatio", "caffiene", "ne", 90), ("WRatio", "abc def", "def abc", 95), ("QRatio", "", "", 0), ("QRatio", "ab", "ab", 100),
    ],
)
def test_scorers(spark, name, a, b, want):
    from keyweave.functions.similarity import scorer

    row = spark.createDataFrame([(a, b)], "a string, b string").select(scorer(name)("a", "b").alias("s")).first()
    assert row["s"] == pytest.approx(want)


def test_fuzzy_without_a_cutoff(spark):
    """Every name is returned at cutoff 0, however long."""
    names = ["abc", "x" * 1_500, "", "abd"]
    df = spark.createDataFrame([(n,) for n in names], "w string")
    got = lookup.fuzzy_top_n(df, df, "w", "w", 0, 10).collect()
    assert {(r["query"], r["name"]) for r in got} == {(a, b) for a in names for b in names}


def test_each_miss_and_stage_is_computed_once(spark, tmp_path):
    from keyweave.operators import enrich as en

    seen = spark.sparkContext.accumulator(0)

    def counted(keys):
        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return keys.mapInArrow(run, keys.schema).withColumn("v", F.lit("x"))

    memo_table = spark.createDataFrame([("a", "x")], "key string, v string")
    every, new = memo.memoised(spark.createDataFrame([(c,) for c in "abcab"], "key string"), memo_table, counted)
    assert every.count() == 3 and new.count() == 2 and seen.value == 2
    rows = spark.createDataFrame([(i, f"k{i}", f"m{i}") for i in range(6)], "id bigint, a string, b string")
    stage = lambda keep: lambda keys: counted(keys).where(keep)
    found = en.resolve_cascade(rows, "id", [("one", "a", stage("query < 'k2'")), ("two", "b", stage("query < 'm4'")), ("three", "a", stage("true"))])
    assert sorted((r["id"], r["resolved_by"]) for r in found.collect()) == [(0, "one"), (1, "one"), (2, "two"), (3, "two"), (4, "three"), (5, "three")]
    assert seen.value == 2 + 6 + 4 + 2


def test_long_fingerprints(spark):
    import random

    rng = random.Random(2)
    prints = [[rng.getrandbits(63) & rng.getrandbits(63) for _ in range(32)] for _ in range(30)] + [[0] * 32]
    prints += [[p[0] ^ 5, *p[1:]] for p in prints[:5]]
    df = spark.createDataFrame(list(enumerate(prints)), "id bigint, fp array<bigint>")
    ones = lambda xs: sum(x.bit_count() for x in xs)
    score = lambda a, b: ones(x & y for x, y in zip(a, b)) / ones(x | y for x, y in zip(a, b))
    want = {(i, j) for i, a in enumerate(prints) for j, b in enumerate(prints) if ones(a) and ones(b) and score(a, b) >= 0.6}
    assert {(r["query_id"], r["id"]) for r in lookup.tanimoto_top_k(df, df, "id", "fp", 0.6, 100).collect()} == want


@pytest.mark.parametrize("threshold, k, chunked_from", [(0.5, 5, 1), (0.3, 2, 1), (0.9, 3, 1), (0.5, 5, 1 << 30), (0.3, None, 1)])
def test_nearest_fingerprints_by_chunks_and_by_blocks(spark, threshold, k, chunked_from):
    """With copies, ties, few and many bits; text ids; several blocks."""
    import random

    from keyweave.operators.nearest import nearest

    rng = random.Random(4)
    prints = [rng.getrandbits(64) & (rng.getrandbits(64) | rng.getrandbits(64)) for _ in range(300)] + [1, 1, 3, (1 << 64) - 1]
    prints += prints[:20] + [p ^ (1 << rng.randrange(64)) for p in prints[:100]]
    held = [(f"k{i:04}", p) for i, p in enumerate(prints)]
    signed = [(i, [p - (1 << 64) if p >> 63 else p]) for i, p in held] + [("none", None), ("null", [None]), ("wide", [7, 7])]
    df = spark.createDataFrame(signed, "id string, bits array<bigint>")
    got = lookup.first_k(nearest(df, df.where("id <> 'wide'"), threshold, k, 100, 150, chunked_from), ["query_id"], [F.desc("score"), "id"], k)
    score = lambda a, b: (a & b).bit_count() / (a | b).bit_count()
    want = []
    for i, a in held:
        best = sorted((-score(a, b), j) for j, b in held if score(a, b) >= threshold)[:k]
        want += [(i, j, -s, rank) for rank, (s, j) in enumerate(best, 1)]
    assert rows(got, "query_id", "id", "score", "rank") == sorted(want)


def test_many_fingerprints_in_a_minute(spark):
    import time

    df = spark.range(30_000).select("id", F.xxhash64("id").alias("fp"))
    began = time.time()
    assert lookup.tanimoto_top_k(df, df, "id", "fp", 0.5, 1).where("id = query_id and score = 1").count() == 30_000
    assert time.time() - began < 60

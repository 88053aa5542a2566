import pytest
from pyspark.sql import functions as F

from keyweave.functions import chem, cols
from keyweave.functions.similarity import _indel, candidate_similarity, indel_ratio, may_reach, sign_bits, tanimoto, text_similarity, token_sort


def one(spark, value, column, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("cas, valid", [("50-00-0", True), ("64-17-5", True), ("7732-18-5", True), ("50-00-1", False), ("abc", False), ("1-2", False), (None, False), ("", False)])
def test_check_digit(spark, cas, valid):
    assert one(spark, cas, cols.cas_valid(F.col("x"))) is valid


@pytest.mark.parametrize("value, missing", [(None, True), ("", True), ("  ", True), ("nan", True), ("NaN", True), ("none", False), ("x", False)])
def test_missing(spark, value, missing):
    assert one(spark, value, cols.is_missing(F.col("x"))) is missing
    assert one(spark, value, cols.nullif_missing(F.col("x"))) == (None if missing else value)


def test_missing_in_dossiers_and_nan(spark):
    assert one(spark, " NA ", cols.is_missing(F.col("x"), cols.MISSING_IN_DOSSIERS)) is True
    assert one(spark, float("nan"), cols.is_missing(F.col("x")), "double") is True


@pytest.mark.parametrize("raw, name", [("D-Aspirin", "aspirin"), ("MEK", "methyl ethyl ketone"), (" (±)-Foo  Bar ", "foo bar"), ("d-l-x", "l-x"), ("Ethanol", "ethanol"), (None, None)])
def test_norm_name(spark, raw, name):
    assert one(spark, raw, cols.norm_name(F.col("x"))) == name


def test_extract_ids(spark):
    names = ["CAS: 50-00-0 and 64-17-5", "nsc 123", "NSC123", "DTXSID5 x DTXCID6", "EC 1.2.3.4", "chebi: 15", "CHEMBL9", None, ""]
    got = one(spark, names, cols.extract_ids(F.col("x")), "array<string>").asDict()
    assert got == {"casrn": ["50-00-0", "64-17-5"], "nsc": ["NSC123"], "dtxsid": ["DTXSID5"], "dtxcid": ["DTXCID6"], "ec_number": ["1.2.3.4"], "chebi_id": ["CHEBI:15"], "chembl": ["CHEMBL9"]}


@pytest.mark.parametrize(
    "text, kind",
    [("50-00-0", "cas"), ("BSYNRYMUTXBXSQ-UHFFFAOYSA-N", "inchikey"), ("InChI=1S/H2O/h1H2", "inchi"), (" aspirin ", "synonym"), ("  ", None), (None, None), ("see 50-00-0 InChI=1S/x", "cas")],
)
def test_classify_synonym(spark, text, kind):
    got = one(spark, text, cols.classify_synonym(F.col("x")))
    assert (got and got["kind"]) == kind


def test_lists_and_layers(spark):
    assert one(spark, " a ; ;b;", cols.split_list(F.col("x"), ";")) == ["a", "b"]
    assert one(spark, ["a", " ", None, "nan", "b"], cols.join_list(F.col("x")), "array<string>") == "a; b"
    assert one(spark, "InChI=1S/C2H6O/c1", cols.formula_layer(F.col("x"))) == "C2H6O"
    assert one(spark, "CCO.[Na+].CCCC", cols.largest_fragment(F.col("x"))) == "CCCC"
    assert one(spark, "x 7732-18-5, 50-00-0; 50-00-0", cols.extract_cas(F.col("x"))) == ["50-00-0", "7732-18-5"]
    assert cols.like_pattern("a.*b.c%") == "a%b_c\\%"


@pytest.mark.parametrize("a, b, ratio", [("asprin", "aspirin", 92.3077), ("caffiene", "caffeine", 87.5), ("asprin", "evasprin", 85.7143), ("", "", 100.0), ("a", "", 0.0)])
def test_indel(spark, a, b, ratio):
    assert _indel(a, b) == pytest.approx(ratio, abs=1e-4)
    row = spark.createDataFrame([(a, b)], "a string, b string").select(indel_ratio("a", "b").alias("r"), may_reach(F.col("a"), F.col("b"), ratio - 0.01).alias("m")).first()
    assert row["r"] == pytest.approx(ratio, abs=1e-4) and row["m"]


def test_indel_against_plain_recursion():
    import random

    rng = random.Random(1)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(9))) for _ in range(2))
        row = [0] * (len(b) + 1)
        for x in a:
            new = [0]
            for j, y in enumerate(b):
                new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
            row = new
        want = 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0
        assert _indel(a, b) == pytest.approx(want)


def test_other_similarities(spark):
    row = spark.createDataFrame([([1.0, -1.0, 2.0], [3, 0], [1, 4])], "v array<double>, a array<bigint>, b array<bigint>")
    got = row.select(sign_bits("v"), tanimoto(F.col("a"), F.col("b")), token_sort(F.lit(" b  a c"))).first()
    assert got[0] == 5 and got[1] == pytest.approx(1 / 3) and got[2] == "a b c"
    names = spark.createDataFrame([("Aspirin ", "aspirin"), ("abcd", "bcde"), (None, "x")], "a string, b string").select(text_similarity("a", "b").alias("s"))
    assert [r["s"] for r in names.collect()] == [1.0, 0.75, 0.0]


def test_candidate_similarity(spark):
    fields = "cas array<string>, canonical_smiles string, inchikey string, inchi string, formula string, mass double, name string"
    left = spark.createDataFrame([(["1"], "CCO", None, None, "C2H6O", 46.07, "ethanol")], fields)
    right = spark.createDataFrame([(["1", "2"], "CCO", "K", None, "C2H6", 46.5, "Wrong")], fields)
    pair = left.select([F.col(c).alias(f"a_{c}") for c in left.columns]).join(right.select([F.col(c).alias(f"b_{c}") for c in right.columns]))
    # registry numbers 3 of 3, structure 4 of 4, formula 0 of 1, mass half of 2; the names don't count
    assert pair.select(candidate_similarity("a_", "b_")).first()[0] == pytest.approx(8 / 10)


def test_formula_mass(spark):
    assert one(spark, "C9H8O4", chem.formula_mass(F.col("x"))) == pytest.approx(180.159, abs=0.01)
    assert one(spark, "Xx2", chem.formula_mass(F.col("x"))) is None
    assert one(spark, "C(OH)", chem.formula_mass(F.col("x"))) is None


def test_structures_are_null_without_a_backend(spark):
    if chem.available():
        pytest.skip("a backend is installed")
    assert one(spark, "CCO", chem.normalise_structure(F.col("x")))["inchikey"] is None

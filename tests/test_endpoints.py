import json

import pytest
from pyspark.sql import functions as F

from keyweave.sources import endpoints as ep

#: A stand-in for the services: what they answer to a call of that URL.
ANSWERS = {
    "compound/name/aspirin/cids/JSON?name_type=word": {"IdentifierList": {"CID": [2244, 5]}},
    "substance/name/odd%20one/cids/JSON?name_type=word": {"IdentifierList": {"CID": [7, 7, 8]}},
    "compound/cid/2244,5/property/MolecularFormula,XLogP/JSON": {"PropertyTable": {"Properties": [{"CID": 2244, "MolecularFormula": "C9H8O4", "XLogP": 1.2}]}},
    "compound/cid/2244/synonyms/JSON": {"InformationList": {"Information": [{"CID": 2244, "Synonym": ["aspirin", "50-78-2"]}, {"CID": 1}]}},
}


def send(url, body=None, headers=None):
    for end, answer in ANSWERS.items():
        if url.endswith("/rest/pug/" + end):
            return 200, json.dumps(answer)
    if "cactus" in url:
        return (200, " 180.16\n") if url.endswith("/mw") else (200, "a\n\nb\n") if url.endswith("/names") else (404, None)
    if body is not None:
        return 200, json.dumps({"sent": body, "type": headers["Content-Type"]})
    if "commonchemistry" in url:
        return (200, json.dumps({"results": [{"rn": "50-78-2"}]})) if headers.get("X-API-KEY") == "k" else (401, None)
    return 404, None


def keys(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "k string")


def test_answers_are_tables(spark):
    got = {r["key"]: (r["cids"], r["failure"]) for r in ep.call(keys(spark, "aspirin", "aspirin", "none", None), "k", "pubchem.cids_by_name", send=send, pause=0).select("key", ep.cids(F.col("body")).alias("cids"), ep.failure()).collect()}
    assert got == {"aspirin": ([2244, 5], None), "none": (None, "not_found")}
    row = ep.call(keys(spark, "2244,5"), "k", "pubchem.properties", "MolecularFormula,XLogP", send=send, pause=0).select(ep.properties(F.col("body")).alias("p")).first()
    assert row["p"][0]["MolecularFormula"] == "C9H8O4" and row["p"][0]["XLogP"] == "1.2"
    assert ep.call(keys(spark, "2244"), "k", "pubchem.synonyms", send=send, pause=0).select(ep.synonyms(F.col("body")).alias("s")).first()["s"] == ["aspirin", "50-78-2"]


def test_names_fall_back_to_substances(spark):
    got = {r["key"]: (r["cids"], r["found_in"]) for r in ep.find_cids(keys(spark, "aspirin", "odd one", "none"), "k", send=send, pause=0).collect()}
    assert got == {"aspirin": ([2244, 5], "compound"), "odd one": ([7, 8], "substance"), "none": (None, None)}


def test_representations(spark):
    found = ep.representations(keys(spark, "x y"), "k", ["mw", "names", "cas"], send=send, pause=0)
    row = found.select("found", ep.number(F.col("found")["mw"]).alias("mw"), ep.lines(F.col("found")["names"]).alias("names")).first()
    assert row["mw"] == 180.16 and row["names"] == ["a", "b"] and row["found"]["cas"] is None
    assert spark.range(1).select(ep.image_url(F.lit("C#C x"), width="200")).first()[0] == "https://cactus.nci.nih.gov/chemical/structure/C%23C%20x/image?width=200"


def test_posts_and_keys(spark):
    sent = json.loads(ep.call(keys(spark, "7,CHEBI:8"), "k", "chebi.compounds", send=send, pause=0).first()["body"])
    assert json.loads(sent["sent"]) == {"chebi_ids": ["CHEBI:7", "CHEBI:8"]}
    assert json.loads(ep.call(keys(spark, "CCO"), "k", "chebi.average_mass", send=send, pause=0).first()["body"]) == {"sent": "CCO", "type": "text/plain"}
    sent = json.loads(ep.call(keys(spark, "CCO"), "k", "classyfire.submit", send=send, pause=0, label="l").first()["body"])
    assert json.loads(sent["sent"]) == {"label": "l", "query_input": "CCO", "query_type": "STRUCTURE"}
    asked = lambda key: ep.call(keys(spark, "aspirin"), "k", "cas.search", send=send, pause=0, api_key=key).select(ep.cas_numbers(F.col("body")).alias("rn"), ep.failure()).first()
    assert tuple(asked("k")) == (["50-78-2"], None) and tuple(asked(None)) == (None, "request")


@pytest.mark.parametrize(
    "name, key, option, params, url",
    [
        ("pubchem.similarity", "C#C", "smiles", {"Threshold": 80}, "https://pubchem.ncbi.nlm.nih.gov/rest/pug/compound/fastsimilarity_2d/smiles/C%23C/cids/JSON?Threshold=80"),
        ("pubchem.substructure", "2244", "cid", {"MatchIsotopes": True}, "https://pubchem.ncbi.nlm.nih.gov/rest/pug/compound/fastsubstructure/cid/2244/cids/JSON?MatchIsotopes=true"),
        ("chebi.search", "a b", "", {"page": 2}, "https://www.ebi.ac.uk/chebi/backend/api/public/es_search/?term=a%20b&page=2&size=15"),
        ("classyfire.result", "12", "sdf", {}, "http://classyfire.wishartlab.com/queries/12.sdf"),
    ],
)
def test_urls(name, key, option, params, url):
    assert ep.ENDPOINTS[name].request(key, option, params)[0] == url

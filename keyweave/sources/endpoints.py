"""Remote services as tables: an endpoint says how a key becomes a call, fetch() makes the calls, and the parsers here read their bodies with Spark expressions.

    found = call(keys, "cas", "pubchem.cids_by_name", name_type="complete")
    found.select("key", failure(), cids(F.col("body")))
"""

from __future__ import annotations

import json
import urllib.parse
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.operators.durable import checkpointed
from keyweave.sources.rest import http_send, run_calls

_PUG = "https://pubchem.ncbi.nlm.nih.gov/rest/pug"
_VIEW = "https://pubchem.ncbi.nlm.nih.gov/rest/pug_view/data/compound"
_NCI = "https://cactus.nci.nih.gov/chemical/structure"
_CHEBI = "https://www.ebi.ac.uk/chebi/backend/api/public"
_CAS = "https://commonchemistry.cas.org/api"
_CLASSYFIRE = "http://classyfire.wishartlab.com"


@dataclass(frozen=True)
class Endpoint:
    """url has {key} and may have {option}; parameters are appended to it. A body makes the call a POST."""

    url: str
    pause: float = 0.0
    body: Callable[[str, dict], str] | None = None
    safe: str = ""
    defaults: tuple[tuple[str, str], ...] = ()
    content: str = "application/json"

    def request(self, key: str, option: str, params: dict) -> tuple[str, str | None]:
        """URL and body of one call."""
        every = {**dict(self.defaults), **{k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in params.items()}}
        url = self.url.format(key=urllib.parse.quote(str(key), safe=self.safe), option=urllib.parse.quote(option, safe=",/"))
        if self.body is not None:
            return url, self.body(key, every)
        if every:
            url += ("&" if "?" in url else "?") + urllib.parse.urlencode(every, quote_via=urllib.parse.quote)
        return url, None


def _pug(path: str, **defaults: str) -> Endpoint:
    return Endpoint(f"{_PUG}/{path}", 0.2, safe=",", defaults=tuple(defaults.items()))


def _chebi_id(key: str) -> str:
    key = str(key).strip()
    return key if key.upper().startswith("CHEBI:") else f"CHEBI:{key}"


def _plain(key: str, params: dict) -> str:
    return key


#: What the services offer, service.operation -> endpoint.
ENDPOINTS: dict[str, Endpoint] = {
    "pubchem.compound_by_cid": _pug("compound/cid/{key}/record/JSON"),
    "pubchem.compounds_by_name": _pug("compound/name/{key}/record/JSON"),
    "pubchem.compounds_by_smiles": _pug("compound/smiles/{key}/record/JSON"),
    "pubchem.compounds_by_inchikey": _pug("compound/inchikey/{key}/record/JSON"),
    "pubchem.properties": _pug("compound/cid/{key}/property/{option}/JSON"),
    "pubchem.synonyms": _pug("compound/cid/{key}/synonyms/JSON"),
    "pubchem.cids_by_name": _pug("compound/name/{key}/cids/JSON", name_type="word"),
    "pubchem.cids_by_substance_name": _pug("substance/name/{key}/cids/JSON", name_type="word"),
    "pubchem.cids_by_smiles": _pug("compound/smiles/{key}/cids/JSON"),
    "pubchem.cids_by_inchikey": _pug("compound/inchikey/{key}/cids/JSON"),
    "pubchem.cids_by_formula": _pug("compound/fastformula/{key}/cids/JSON"),
    "pubchem.substructure": _pug("compound/fastsubstructure/{option}/{key}/cids/JSON"),
    "pubchem.superstructure": _pug("compound/fastsuperstructure/{option}/{key}/cids/JSON"),
    "pubchem.similarity": _pug("compound/fastsimilarity_2d/{option}/{key}/cids/JSON", Threshold="90"),
    "pubchem.identity": _pug("compound/fastidentity/{option}/{key}/cids/JSON", identity_type="same_connectivity"),
    "pubchem.substance_by_sid": _pug("substance/sid/{key}/record/JSON"),
    "pubchem.substances_by_name": _pug("substance/name/{key}/record/JSON"),
    "pubchem.sids_by_name": _pug("substance/name/{key}/sids/JSON", name_type="word"),
    "pubchem.assay_by_aid": _pug("assay/aid/{key}/record/JSON"),
    "pubchem.assay_summary": _pug("compound/cid/{key}/assaysummary/JSON"),
    "pubchemview.experimental": Endpoint(f"{_VIEW}/{{key}}/JSON?heading=Experimental+Properties", 0.2),
    "pubchemview.property": Endpoint(f"{_VIEW}/{{key}}/JSON?heading={{option}}", 0.2),
    "nci.resolve": Endpoint(f"{_NCI}/{{key}}/{{option}}", 0.1),
    "opsin.by_name": Endpoint("https://opsin.ch.cam.ac.uk/opsin/{key}.json", 0.5),
    "chebi.compound": Endpoint(f"{_CHEBI}/compound/{{key}}/"),
    "chebi.compounds": Endpoint(f"{_CHEBI}/compounds/", body=lambda key, params: json.dumps({"chebi_ids": [_chebi_id(k) for k in key.split(",")]})),
    "chebi.search": Endpoint(f"{_CHEBI}/es_search/?term={{key}}", defaults=(("page", "1"), ("size", "15"))),
    "chebi.advanced_search": Endpoint(f"{_CHEBI}/advanced_search/", body=_plain),
    "chebi.sources": Endpoint(f"{_CHEBI}/advanced_search/sources_list"),
    "chebi.parents": Endpoint(f"{_CHEBI}/ontology/parents/{{key}}/"),
    "chebi.children": Endpoint(f"{_CHEBI}/ontology/children/{{key}}/"),
    "chebi.children_in_path": Endpoint(f"{_CHEBI}/ontology/all_children_in_path/?entity={{key}}", defaults=(("relation", "is_a"), ("three_star_only", "true"), ("page", "1"), ("size", "15"), ("download", "false"))),
    "chebi.structure_of": Endpoint(f"{_CHEBI}/compound/{{key}}/structure/"),
    "chebi.structure": Endpoint(f"{_CHEBI}/structure/{{key}}/"),
    "chebi.molfile": Endpoint(f"{_CHEBI}/molfile/{{key}}/"),
    "chebi.structure_search": Endpoint(f"{_CHEBI}/structure_search/?smiles={{key}}", defaults=(("search_type", "connectivity"), ("three_star_only", "true"), ("page", "1"), ("size", "15"), ("download", "false"))),
    "chebi.average_mass": Endpoint(f"{_CHEBI}/structure-calculations/avg-mass/", body=_plain, content="text/plain"),
    "chebi.average_mass_from_formula": Endpoint(f"{_CHEBI}/structure-calculations/avg-mass/from-formula/", body=_plain, content="text/plain"),
    "chebi.formula": Endpoint(f"{_CHEBI}/structure-calculations/mol-formula/", body=_plain, content="text/plain"),
    "chebi.monoisotopic_mass": Endpoint(f"{_CHEBI}/structure-calculations/monoisotopic-mass/", body=_plain, content="text/plain"),
    "chebi.monoisotopic_mass_from_formula": Endpoint(f"{_CHEBI}/structure-calculations/monoisotopic-mass/from-formula/", body=_plain, content="text/plain"),
    "chebi.net_charge": Endpoint(f"{_CHEBI}/structure-calculations/net-charge/", body=_plain, content="text/plain"),
    "cas.detail": Endpoint(f"{_CAS}/detail?cas_rn={{key}}"),
    "cas.search": Endpoint(f"{_CAS}/search?q={{key}}"),
    "classyfire.submit": Endpoint(f"{_CLASSYFIRE}/queries", body=lambda key, params: json.dumps({"label": params.get("label", ""), "query_input": key, "query_type": params.get("type", "STRUCTURE")})),
    "classyfire.status": Endpoint(f"{_CLASSYFIRE}/queries/{{key}}/status.json"),
    "classyfire.result": Endpoint(f"{_CLASSYFIRE}/queries/{{key}}.{{option}}"),
}
#: Representations that the structure resolver gives.
REPRESENTATIONS = (
    "stdinchi stdinchikey smiles ficts ficus uuuuu hashisy sdf names iupac_name cas mw formula image exactmass charge "
    "h_bond_acceptor_count h_bond_donor_count rotor_count effective_rotor_count"
).split()
#: Those that are numbers.
NUMBERS = ("mw", "exactmass", "charge", "h_bond_acceptor_count", "h_bond_donor_count", "rotor_count", "effective_rotor_count")


def call(keys: DataFrame, key: str, name: str, option: str = "", send=http_send, api_key: str | None = None, partitions: int = 4, retries: int = 3, pause: float | None = None, **params) -> DataFrame:
    """key, url, status, body of an endpoint for the distinct present keys; a failed call is a row, not an error."""
    e = ENDPOINTS[name]
    headers = {"Accept": "application/json", "Content-Type": e.content} | ({"X-API-KEY": api_key} if api_key else {})
    form = _chebi_id if name in ("chebi.parents", "chebi.children", "chebi.children_in_path", "chebi.compound") else str
    return run_calls(keys, key, lambda k: e.request(form(k), option, params), lambda url, body: send(url, body, headers=headers), e.pause if pause is None else pause, partitions, retries)


def failure(status: str = "status") -> Column:
    """What became of a call: null for an answer, else not_found, timeout, server, request or no_answer."""
    s = F.col(status)
    kinds = F.when(s == 200, None).when(s == 404, "not_found").when(s.isin(408, 504), "timeout").when(s >= 500, "server").when(s >= 400, "request")
    return kinds.otherwise(F.when(s != 200, "no_answer")).alias("failure")


def cids(body: Column) -> Column:
    return F.from_json(body, "IdentifierList struct<CID: array<bigint>>")["IdentifierList"]["CID"]


def sids(body: Column) -> Column:
    return F.from_json(body, "IdentifierList struct<SID: array<bigint>>")["IdentifierList"]["SID"]


def properties(body: Column) -> Column:
    """An array with a map of property -> text for each compound."""
    return F.from_json(body, "PropertyTable struct<Properties: array<map<string,string>>>")["PropertyTable"]["Properties"]


def synonyms(body: Column) -> Column:
    """The synonyms of all compounds of an answer, in order."""
    found = F.from_json(body, "InformationList struct<Information: array<struct<Synonym: array<string>>>>")["InformationList"]["Information"]
    return F.flatten(F.filter(F.transform(found, lambda x: x["Synonym"]), lambda x: x.isNotNull()))


def lines(body: Column) -> Column:
    """The lines of a plain answer, without blank ones."""
    return F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def number(body: Column) -> Column:
    """A plain answer as a number, null if it is none."""
    return F.trim(body).try_cast("double")


def opsin_record(body: Column) -> Column:
    return F.from_json(body, "smiles string, stdinchi string, stdinchikey string, inchi string, status string, message string")


def cas_detail(body: Column) -> Column:
    return F.from_json(body, "rn string, name string, image string, inchi string, inchiKey string, smile string, canonicalSmile string, molecularFormula string, molecularMass string, synonyms array<string>")


def cas_numbers(body: Column) -> Column:
    """Registry numbers of a search by name or structure."""
    return F.transform(F.from_json(body, "results array<struct<rn: string>>")["results"], lambda x: x["rn"])


def image_url(identifier: Column, **params: str) -> Column:
    """Where the structure resolver has a picture of an identifier."""
    query = "?" + urllib.parse.urlencode(params) if params else ""
    return F.concat(F.lit(_NCI + "/"), F.replace(F.url_encode(identifier), F.lit("+"), F.lit("%20")), F.lit("/image" + query))


def find_cids(keys: DataFrame, key: str, name_type: str = "word", **settings) -> DataFrame:
    """key, cids, found_in: the compounds of a name, those of substances of that name where no compound has it."""
    first = call(keys, key, "pubchem.cids_by_name", name_type=name_type, **settings).select("key", cids(F.col("body")).alias("cids"))
    first = checkpointed(first.withColumn("found_in", F.when(F.size("cids") > 0, "compound")))
    open_ = first.where("found_in is null").select("key")
    second = call(open_, "key", "pubchem.cids_by_substance_name", name_type=name_type, **settings).select("key", F.array_distinct(cids(F.col("body"))).alias("cids"))
    second = second.withColumn("found_in", F.when(F.size("cids") > 0, "substance"))
    return first.where("found_in is not null").unionByName(second)


def representations(keys: DataFrame, key: str, names: list[str] | None = None, **settings) -> DataFrame:
    """key, found: a map of representation -> text for each key; those that the resolver doesn't have are null."""
    wanted = names or [n for n in REPRESENTATIONS if n not in ("sdf", "image")]
    parts = [call(keys, key, "nci.resolve", n, **settings).select("key", F.lit(n).alias("name"), F.when(F.col("status") == 200, F.trim("body")).alias("value")) for n in wanted]
    every = reduce(DataFrame.unionByName, parts)
    return every.groupBy("key").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("name", "value")))).alias("found"))

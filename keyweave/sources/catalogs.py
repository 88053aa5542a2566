"""Registered catalogs: each brought to the columns of a candidate record once, at ingest."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.functions.cols import extract_cas, nullif_missing, split_list
from keyweave.operators.resolve import RECORD

#: Field of a candidate record -> column of each catalog.
COLUMN_MAPS: dict[str, dict[str, str]] = {
    "chebi": {"id": "chebi_id", "name": "name", "formula": "formula", "smiles": "smiles", "inchi": "inchi", "inchikey": "inchikey", "mass": "mass", "synonyms": "synonyms", "cas": "cas"},
    "comptox": {"id": "dtxsid", "name": "preferred_name", "iupac_name": "iupac_name", "formula": "formula", "smiles": "smiles", "inchi": "inchi", "inchikey": "inchikey", "dtxsid": "dtxsid", "mass": "average_mass", "synonyms": "identifiers", "cas": "casrn"},
    "pubchem": {"id": "cid", "name": "cmpdname", "iupac_name": "iupacname", "formula": "mf", "smiles": "smiles", "inchi": "inchi", "inchikey": "inchikey", "mass": "mw", "synonyms": "synonyms", "cas": "cas"},
    "zeropm": {"id": "inchi_id", "name": "name", "inchi": "inchi", "inchikey": "inchikey", "synonyms": "synonyms", "cas": "cas"},
    "chembl": {"id": "molregno", "name": "pref_name", "smiles": "canonical_smiles", "inchi": "standard_inchi", "inchikey": "standard_inchi_key", "mass": "mw_freebase", "synonyms": "synonyms", "cas": "synonyms"},
}


def as_candidates(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """id, the fields of RECORD and cas (array), missing values null; lists may be arrays or texts split at ``;``."""
    kinds = dict(df.dtypes)

    def text(name: str):
        source = columns.get(name)
        if source is None or source not in kinds:
            return F.lit(None).cast("double" if name == "mass" else "string").alias(name)
        if name == "mass":
            return F.col(source).try_cast("double").alias(name)
        if kinds[source].startswith("array"):
            return F.when(F.size(source) > 0, F.array_join(source, "; ")).alias(name)
        return nullif_missing(F.trim(F.col(source).cast("string"))).alias(name)

    source = columns.get("cas")
    if source is None or source not in kinds:
        cas = F.array().cast("array<string>")
    elif kinds[source].startswith("array"):
        cas = extract_cas(F.array_join(source, " "))
    else:
        cas = extract_cas(F.array_join(split_list(F.col(source), ";"), " "))
    record = [text(n) if n != "canonical_smiles" else F.lit(None).cast("string").alias(n) for n in RECORD]
    out = df.select(F.col(columns["id"]).cast("string").alias("id"), *record, cas.alias("cas"))
    return out.withColumn("canonical_smiles", F.col("smiles"))


@dataclass
class Registry:
    """The catalogs that are there; one that can't be opened is recorded and left out."""

    catalogs: dict[str, DataFrame] = field(default_factory=dict)
    failed: dict[str, str] = field(default_factory=dict)

    def add(self, name: str, open_: object, columns: Mapping[str, str] | None = None) -> Registry:
        try:
            df = open_() if callable(open_) else open_
            self.catalogs[name] = as_candidates(df, columns or COLUMN_MAPS[name])
        except Exception as e:  # noqa: BLE001  a missing catalog must not stop the others
            self.failed[name] = str(e).split("\n")[0]
        return self

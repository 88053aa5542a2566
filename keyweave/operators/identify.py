"""Identifier records for registry numbers: catalogs in a fixed order, the next one only while the structure is missing."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keyweave.functions.cols import is_missing
from keyweave.operators.enrich import waterfall
from keyweave.operators.lookup import first_k

#: The order of the catalogs, and what each gives for a registry number (field of the result -> field of the candidate).
GIVES: dict[str, dict[str, str]] = {
    "chebi": {"name": "name", "iupac_name": "name", "formula": "formula", "smiles": "smiles", "inchi": "inchi", "inchikey": "inchikey", "synonyms": "synonyms"},
    "comptox": {"name": "name", "iupac_name": "iupac_name", "formula": "formula", "smiles": "smiles", "inchi": "inchi", "inchikey": "inchikey", "dtxsid": "dtxsid", "mass": "mass", "synonyms": "synonyms"},
    "pubchem": {"name": "name", "iupac_name": "iupac_name", "formula": "formula", "smiles": "smiles", "inchi": "inchi", "inchikey": "inchikey", "mass": "mass", "synonyms": "synonyms"},
    "zeropm": {"smiles": "smiles", "inchi": "inchi", "inchikey": "inchikey", "synonyms": "synonyms"},
}
#: The catalog that is met by the structure found, and what it adds where that is missing.
BY_STRUCTURE, ADDS = "chembl", ("name", "inchi", "inchikey", "synonyms", "mass")
FIELDS = ("name", "iupac_name", "formula", "smiles", "inchi", "inchikey", "dtxsid", "mass", "synonyms")


def ids_from_cas(queries: DataFrame, catalogs: Mapping[str, DataFrame], key: str = "query", structure: Callable[[Column], Column] | None = None) -> DataFrame:
    """One row per distinct registry number: casrn, FIELDS, canonical_smiles, foundby, source.

    catalogs hold candidates (as_candidates()); those that are absent are passed over. Of several
    rows of a catalog for a number that with the smallest id counts. source names the catalog that
    gave the structure, null where none did. structure (such as normalise_structure) gives a struct
    of the canonical SMILES and the mass, the latter for records that have none. Missing keys give no row.
    """
    asked = queries.select(F.trim(F.col(key).cast("string")).alias("casrn")).where(~is_missing(F.col("casrn"))).distinct()
    sources = []
    for name, gives in GIVES.items():
        if name in catalogs:
            # only rows that are asked for are dealt by number
            held = catalogs[name].select("id", *sorted({*gives.values()}), F.explode("cas").alias("casrn")).join(asked, "casrn", "left_semi")
            fields = [(F.col(gives[f]) if f in gives else F.lit(None)).cast("string").alias(f) for f in FIELDS]
            sources.append((name, held.groupBy("casrn").agg(F.min_by(F.struct(*fields), "id").alias("_r")).select("casrn", "_r.*")))
    found = waterfall(asked, sources, "casrn", FIELDS, until="smiles").withColumnRenamed("foundby", "source")
    if BY_STRUCTURE in catalogs:
        wanted = found.select("smiles").where("smiles is not null").distinct()
        more = first_k(catalogs[BY_STRUCTURE].join(wanted, "smiles", "left_semi"), ["smiles"], ["id"], 1)
        more = more.select(F.col("smiles").alias("_smiles"), *[F.col(f).cast("string").alias(f"_{f}") for f in ADDS])
        found = found.join(more, F.col("smiles") == F.col("_smiles"), "left").withColumns({f: F.coalesce(f, f"_{f}") for f in ADDS})
    own = structure(F.col("smiles")) if structure else F.struct(F.lit(None).cast("string").alias("canonical_smiles"), F.lit(None).cast("double").alias("mass"))
    found = found.withColumn("_own", own)
    return found.select(
        "casrn",
        F.coalesce("name", "iupac_name").alias("name"),
        F.coalesce("iupac_name", "name").alias("iupac_name"),
        "formula", "smiles",
        F.col("_own.canonical_smiles").alias("canonical_smiles"),
        "inchi", "inchikey", "dtxsid",
        F.coalesce(F.col("mass").cast("double"), F.col("_own.mass")).alias("mass"),
        "synonyms",
        F.lit("casrn").alias("foundby"),
        "source",
    )

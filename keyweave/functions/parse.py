"""Measured values with units, nested property documents and property lists, without Python on the rows.

A ladder is a table of rules, tried in order; the first whose pattern fits gives value and unit, and a
property's ladder never falls through to another one. Group numbers below refer to the pattern.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed fragments of the patterns. END: no word character follows.
NUM, SCI, END = r"-?[0-9]+(?:\.[0-9]+)?", r"-?[0-9]+(?:\.[0-9]+)?(?:[Ee][+-]?[0-9]+)?", r"(?![\p{L}\p{N}_])"
PRESSURE = r"mmHg|mm\s+Hg|kPa|Pa|atm|bar|torr"
DENSITY, VISCOSITY = r"g/cm³|g/mL|kg/m³|g/L", r"cP|mPa·s|Pa·s|cSt"
MASS, VOLUME = r"[μµ]g|ug|ng|pg|g|mg|kg", r"mL|L|100mL|dl"
#: A percent sign ends a unit only before a word character, other units only before anything else.
CONCENTRATION = r"(?:g/L|mg/L|g/100mL|mg/mL|mol/L|M|ppm|ppb)" + END + r"|%(?=[\p{L}\p{N}_])"
COMPARED = r"(?:greater than or equal to|greater than|less than or equal to|less than|≥|≤|>|<)=?\s*"
SOLUBLE = r"solub[a-z]*[^:]*:\s*"
PERCENT_TAIL = r"%(?:\s+wt|w/w|v/v)?$"


@dataclass(frozen=True)
class Rung:
    """pattern; value and unit as group numbers, a literal unit, or none. times_ten: group 1 x 10 ^ group 2."""

    pattern: str
    value: int | None = 1
    unit: int | str | None = None
    times_ten: bool = False
    any_case: bool = True
    volume: int | None = None  # group behind the slash of a compound unit
    spelt: bool = False  # X10 inside the value is written e
    unit_words: bool = False  # a preposition is no unit
    trim: bool = False


def _either(unit_after: str) -> list[Rung]:
    """The rungs for mass per volume and for other concentrations behind the same head."""
    return [Rung(rf"{unit_after}({SCI})\s*({MASS})/({VOLUME})", 1, 2, volume=3), Rung(rf"{unit_after}({SCI})\s*({CONCENTRATION})", 1, 2)]


#: Property keyword -> rungs. The first keyword that the property's name contains decides.
LADDERS: dict[str, list[Rung]] = {
    "vapor pressure": [
        Rung("negligible", None),
        Rung(rf"^([0-9]+(?:\.[0-9]+)?)X10([+-]?[0-9]+)\s*({PRESSURE})", 1, 3, times_ten=True),
        Rung(r"^([0-9]+(?:\.[0-9]+)?)X10([+-]?[0-9]+)\s", 1, times_ten=True),
        Rung(rf"^({SCI})\s*\[({PRESSURE})\]", 1, 2),
        Rung(rf"vapor\s+pressure(?:[,\s]*([a-zA-Z]+))?[^:]*:\s*({SCI})", 2, 1),
        Rung(rf"({PRESSURE})[^:]*:\s*({SCI})", 2, 1),
        Rung(rf"^({SCI})\s*({PRESSURE}){END}", 1, 2),
    ],
    "logp": [Rung(rf"log\s*(?:p|kow|k[ow]{{1,2}})\s*[=:]\s*({NUM})"), Rung(rf"^({NUM})\s*$", trim=True)],
    "dissociation": [
        Rung(rf"p[Kk][abAB]\s*[=:@]\s*({NUM})"),
        Rung(r"[Kk][abAB0-9]*[=:]\s*([^\s;]+)", spelt=True),
        Rung(r"^([^\s;]+)\s*\(.*?°.*?\)", spelt=True, any_case=False, trim=True),
        Rung(r"^([^\s;]+)\s*$", spelt=True, any_case=False, trim=True),
    ],
    "melting point": [],
    "boiling point": [],
    "temperature": [
        Rung(rf"^({NUM}-[0-9]+(?:\.[0-9]+)?)\s*°?\s*([CFK]){END}", 1, "°", any_case=False),
        Rung(rf"^({NUM})\s*°?\s*([CFK]){END}", 1, "°", any_case=False),
    ],
    "density": [Rung(rf"^({NUM})\s*({DENSITY}){END}", 1, 2, any_case=False)],
    "viscosity": [Rung(rf"^({NUM})\s*({VISCOSITY}){END}", 1, 2, any_case=False)],
    "solubility": [
        *_either(COMPARED),
        Rung(rf"({SCI})\s*\[({MASS})/({VOLUME})\]", 1, 2, volume=3),
        *_either(SOLUBLE),
        *_either("^"),
        Rung(rf"^([0-9.-]+)X10([+-]?[0-9]+)\s*({CONCENTRATION})", 1, 3, times_ten=True),
        Rung(rf"^\[({SCI})\]\s*({CONCENTRATION})", 1, 2),
        Rung(rf"({NUM})X10([+-]?[0-9]+)\s*({CONCENTRATION})", 1, 3, times_ten=True),
        Rung(rf"^({SCI}){PERCENT_TAIL}", 1, "%"),
        Rung(rf"{SOLUBLE}({SCI}){PERCENT_TAIL}", 1, "%"),
        Rung(r"insoluble|very slightly soluble", None),
    ],
}
LADDERS["melting point"] = LADDERS["boiling point"] = LADDERS["temperature"]
#: Without a property. The rung for a bare number stands before that for powers of ten, so ``1.2e-3 g`` reads as 1.2 ``e``; strict=False swaps them.
GENERAL = [
    Rung(rf"^({NUM}-[0-9]+(?:\.[0-9]+)?)\s*(°?[CF]{END}|K{END})?(?![\p{{L}}\p{{N}}_])", 1, 2, any_case=False),
    Rung(rf"^({NUM})\s*°?([CFK]){END}", 1, 2, any_case=False),
    Rung(rf"^({NUM})\s*({DENSITY}){END}", 1, 2, any_case=False),
    Rung(rf"^({NUM})\s*(mmHg|mm Hg|kPa|Pa|atm|bar|torr){END}", 1, 2, any_case=False),
    Rung(rf"^([0-9]+(?:\.[0-9]+)?)\s*({VISCOSITY}){END}", 1, 2, any_case=False),
    Rung(rf"^({NUM})\s*([a-zA-Z/²³·°%]+)?", 1, 2, any_case=False, unit_words=True),
    Rung(rf"^({NUM}[Ee][+-]?[0-9]+)\s*([a-zA-Z/²³·°%]+)?", 1, 2, any_case=False),
    Rung(rf"({NUM})", any_case=False),
]
NO_UNITS = ("at", "in", "on", "to", "from", "with", "and", "or")
AT = rf"(?iu)(?:at|@)\s+({NUM})\s*°?\s*([CFK]){END}"


def conditions(text: Column) -> tuple[Column, Column]:
    """Temperature ("at 25 °C" as 25°C), and pressure and /remarks/ joined by "; ", which count only beside a temperature."""
    found = text.rlike(AT)
    temperature = F.when(found, F.concat(F.regexp_extract(text, AT, 1), F.lit("°"), F.regexp_extract(text, AT, 2)))
    pressure = r"(?iu)([0-9]+(?:\.[0-9]+)?)\s*(mmHg|kPa|Pa|atm|bar)"
    part = F.when(text.rlike(pressure), F.concat(F.regexp_extract(text, pressure, 1), F.lit(" "), F.regexp_extract(text, pressure, 2)))
    parts = F.concat(F.filter(F.array(part), lambda p: p.isNotNull()), F.regexp_extract_all(text, F.lit("/([^/]+)/"), F.lit(1)))
    return temperature, F.when(found & (F.size(parts) > 0), F.array_join(parts, "; "))


def _climb(text: Column, rungs: list[Rung]) -> tuple[Column, Column, Column]:
    """Whether a rung fits, its value, its unit."""
    hit, value, unit = F.lit(False), F.lit(None).cast("string"), F.lit(None).cast("string")
    for r in reversed(rungs):
        of = F.trim(text) if r.trim else text
        pattern = ("(?iu)" if r.any_case else "") + r.pattern
        group = lambda n: F.nullif(F.regexp_extract(of, pattern, n), F.lit(""))  # noqa: B023,E731
        fits = of.rlike(pattern)
        got = F.lit(None).cast("string") if r.value is None else group(r.value)
        if r.times_ten:
            got = F.concat(group(1), F.lit("e"), group(2))
        if r.spelt:
            got = F.regexp_replace(got, "[Xx]10", "e")
        if r.unit is None:
            of_unit = F.lit(None).cast("string")
        elif r.unit == "°":
            of_unit = F.concat(F.lit("°"), group(2))
        elif isinstance(r.unit, str):
            of_unit = F.lit(r.unit)
        else:
            of_unit = group(r.unit)
            if r.volume is not None:
                of_unit = F.concat(F.when(F.lower(of_unit).isin("μg", "µg", "ug"), "μg").otherwise(of_unit), F.lit("/"), group(r.volume))
            if r.unit_words:
                of_unit = F.when(~F.lower(of_unit).isin(*NO_UNITS), of_unit)
        hit = F.when(fits, True).otherwise(hit)
        value = F.when(fits, got).otherwise(value)
        unit = F.when(fits, of_unit).otherwise(unit)
    return hit, value, unit


def parse_value(text: Column, property_name: str | None = None, strict: bool = True) -> Column:
    """Struct (value, unit, temperature, conditions); all null where no rung of the ladder fits."""
    if property_name is None:
        rungs = GENERAL if strict else [*GENERAL[:5], GENERAL[6], GENERAL[5], GENERAL[7]]
    else:
        low = property_name.lower()
        rungs = next((r for k, r in LADDERS.items() if k in low), [])
    text = F.when(text != "", text)
    hit, value, unit = _climb(text, rungs)
    temperature, more = conditions(text)
    return F.struct(value.alias("value"), unit.alias("unit"), F.when(hit, temperature).alias("temperature"), F.when(hit, more).alias("conditions"))


#: Headings under which a document keeps experimental properties.
HEADINGS = ("Chemical and Physical Properties", "Experimental Properties")
_INFORMATION = "ReferenceNumber bigint, Reference array<string>, Name string, Description string, Value struct<StringWithMarkup: array<struct<String: string>>, Number: array<double>, Unit: string>"
_SECTION = f"struct<TOCHeading: string, Information: array<struct<{_INFORMATION}>>>"
DOCUMENT = (
    "struct<Record: struct<RecordNumber: bigint, RecordTitle: string, "
    f"Section: array<struct<TOCHeading: string, Section: array<struct<TOCHeading: string, Section: array<{_SECTION}>>>>>, "
    "Reference: array<struct<ReferenceNumber: bigint, SourceName: string, Name: string, Description: string, URL: string>>>>"
)


def flatten_documents(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """cid, heading, raw, reference_number: a row for each text of each information item under HEADINGS."""
    record = docs.select(F.from_json(json_col, DOCUMENT).alias("d")).select("d.Record.*")
    top = record.select(F.col("RecordNumber").alias("cid"), F.explode("Section").alias("s")).where(F.col("s.TOCHeading") == HEADINGS[0])
    mid = top.select("cid", F.explode("s.Section").alias("s")).where(F.col("s.TOCHeading") == HEADINGS[1])
    leaf = mid.select("cid", F.explode("s.Section").alias("s")).select("cid", F.col("s.TOCHeading").alias("heading"), F.explode("s.Information").alias("i"))
    return leaf.select("cid", "heading", F.explode("i.Value.StringWithMarkup").alias("m"), F.col("i.ReferenceNumber").alias("reference_number")).select("cid", "heading", F.col("m.String").alias("raw"), "reference_number").where("raw is not null")


def references(docs: DataFrame, json_col: str = "json") -> DataFrame:
    """cid, reference_number, reference: source, name, description (cut at 200 characters) and URL, the present ones joined by " | "."""
    record = docs.select(F.from_json(json_col, DOCUMENT).alias("d")).select("d.Record.*")
    each = record.select(F.col("RecordNumber").alias("cid"), F.explode("Reference").alias("r")).select("cid", "r.*")
    cut = F.when(F.length("Description") > 200, F.concat(F.substring("Description", 1, 200), F.lit("..."))).otherwise(F.col("Description"))
    labelled = [F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(f"{n}: "), c)) for n, c in (("Source", F.col("SourceName")), ("Name", F.col("Name")), ("Description", cut), ("URL", F.col("URL")))]
    return each.select("cid", F.col("ReferenceNumber").alias("reference_number"), F.concat_ws(" | ", *labelled).alias("reference"))


def property_table(docs: DataFrame, heading: str, json_col: str = "json") -> DataFrame:
    """cid, raw, value, unit, temperature, conditions, reference for one heading."""
    rows = flatten_documents(docs, json_col).where(F.col("heading") == heading)
    parsed = rows.withColumn("p", parse_value(F.col("raw"), heading))
    return parsed.join(references(docs, json_col), ["cid", "reference_number"], "left").select("cid", "raw", "p.*", "reference")


def property_summary(rows: DataFrame, by: list[str], value: str = "value", unit: str = "unit") -> DataFrame:
    """Per group the number of values, the distinct units and the distinct values, sorted."""
    return rows.groupBy(*by).agg(F.count(value).alias("n_values"), F.array_sort(F.collect_set(unit)).alias("units"), F.array_sort(F.collect_set(value)).alias("values"))


#: Fixed values: (label, name) of a property list -> column.
PROPERTY_KEYS = {
    ("Molecular Formula", ""): "MolecularFormula",
    ("Molecular Weight", ""): "MolecularWeight",
    ("SMILES", "Absolute"): "SMILES",
    ("SMILES", "Connectivity"): "ConnectivitySMILES",
    ("InChI", "Standard"): "InChI",
    ("InChIKey", "Standard"): "InChIKey",
    ("IUPAC Name", "Preferred"): "IUPACName",
    ("Log P", "XLogP3-AA"): "XLogP",
    ("Mass", "Exact"): "ExactMass",
    ("Weight", "MonoIsotopic"): "MonoisotopicMass",
    ("Topological", "Polar Surface Area"): "TPSA",
    ("Compound Complexity", ""): "Complexity",
    ("Count", "Hydrogen Bond Donor"): "HBondDonorCount",
    ("Count", "Hydrogen Bond Acceptor"): "HBondAcceptorCount",
    ("Count", "Rotatable Bond"): "RotatableBondCount",
    ("Fingerprint", "SubStructure Keys"): "Fingerprint2D",
    ("IUPAC Name", "Allowed"): "IUPACName_Allowed",
    ("IUPAC Name", "CAS-like Style"): "IUPACName_CASStyle",
    ("IUPAC Name", "Markup"): "IUPACName_Markup",
    ("IUPAC Name", "Systematic"): "IUPACName_Systematic",
    ("IUPAC Name", "Traditional"): "IUPACName_Traditional",
}
PROPERTY_LIST = "array<struct<urn: struct<label: string, name: string>, value: struct<sval: string, ival: bigint, fval: double, binary: string>>>"


def property_map(props: Column) -> Column:
    """A property list as map<key, value as text>: known (label, name) pairs by their column, others by label_name without blanks and hyphens. The last of equal keys wins."""
    known = F.create_map(*[F.lit(x) for (label, name), key in PROPERTY_KEYS.items() for x in (f"{label}\t{name}", key)])

    def entry(p: Column) -> Column:
        label, name = F.coalesce(p["urn"]["label"], F.lit("")), F.coalesce(p["urn"]["name"], F.lit(""))
        own = F.regexp_replace(F.concat(label, F.when(name != "", F.concat(F.lit("_"), name)).otherwise("")), "[ -]", "")
        value = F.coalesce(p["value"]["sval"], p["value"]["ival"].cast("string"), p["value"]["fval"].cast("string"), p["value"]["binary"])
        return F.struct(F.coalesce(known[F.concat(label, F.lit("\t"), name)], own).alias("key"), value.alias("value"))

    entries = F.filter(F.transform(props, entry), lambda e: e["value"].isNotNull())
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda later: later["key"] == e["key"]))
    return F.map_from_entries(last)

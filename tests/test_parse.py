import json

import pytest
from pyspark.sql import functions as F

from keyweave.functions import parse

CASES = [
    ("275 °F", "Boiling Point", ("275", "°F", None, None)),
    ("135-140 °C", "Melting Point", ("135-140", "°C", None, None)),
    ("138-140", None, ("138-140", None, None, None)),
    ("2.47cP at 20 °C", "Viscosity", ("2.47", "cP", "20°C", None)),
    ("0.79 g/cm³", "Density", ("0.79", "g/cm³", None, None)),
    ("0.79 g/cm³ at 25 °C", "Density", ("0.79", "g/cm³", "25°C", None)),
    ("Vapor pressure at 20°C: negligible", "Vapor Pressure", (None, None, "20°C", None)),
    ("8.5X10-5 mm Hg at 25 °C", "Vapor Pressure", ("8.5e-5", "mm Hg", "25°C", None)),
    ("2.7X10+0 at 25 °C /Estimated/", "Vapor Pressure", ("2.7e+0", None, "25°C", "Estimated")),
    ("0.05 [mmHg]", "Vapor Pressure", ("0.05", "mmHg", None, None)),
    ("Vapor pressure, kPa at 20°C: 24", "Vapor Pressure", ("24", "kPa", "20°C", None)),
    ("log Kow = 1.19", "LogP", ("1.19", None, None, None)),
    ("-2.3", "LogP", ("-2.3", None, None, None)),
    ("soluble", "LogP", (None, None, None, None)),
    ("pKa = 14.31 @ 25 °C", "Dissociation Constants", ("14.31", None, "25°C", None)),
    ("K1=3.3X10-5", "Dissociation Constants", ("3.3e-5", None, None, None)),
    ("2.91 (at 25 °C)", "Dissociation Constants", ("2.91", None, "25°C", None)),
    ("greater than or equal to 100 mg/mL at 72 °F", "Solubility", ("100", "mg/mL", "72°F", None)),
    ("1.2 [ug/mL] (at pH 7)", "Solubility", ("1.2", "μg/mL", None, None)),
    ("Solubility in water: 5.6 g/L at 20 °C", "Solubility", ("5.6", "g/L", "20°C", None)),
    ("0.9%", "Solubility", ("0.9", "%", None, None)),
    ("In water, 1.35X10+5 mg/l", "Solubility", ("1.35e+5", "mg/l", None, None)),
    ("Insoluble in water", "Solubility", (None, None, None, None)),
    ("0.79 g/mL", None, ("0.79", "g/mL", None, None)),
    ("760 mmHg", None, ("760", "mmHg", None, None)),
    ("5 at room temperature", None, ("5", None, None, None)),
    ("1.2e-3 g", None, ("1.2", "e", None, None)),
    ("about 7", None, ("7", None, None, None)),
    ("no number", None, (None, None, None, None)),
    ("", None, (None, None, None, None)),
    (None, "Density", (None, None, None, None)),
    ("12", "Colour", (None, None, None, None)),
]


@pytest.mark.parametrize("text, name, want", CASES)
def test_ladders(spark, text, name, want):
    got = spark.createDataFrame([(text,)], "x string").select(parse.parse_value(F.col("x"), name).alias("p")).first()["p"]
    assert tuple(got) == want


def test_powers_of_ten_without_strict(spark):
    got = spark.range(1).select(parse.parse_value(F.lit("1.2e-3 g"), strict=False).alias("p")).first()["p"]
    assert (got["value"], got["unit"]) == ("1.2e-3", "g")


def document(cid, heading, *texts):
    info = [{"ReferenceNumber": 7, "Value": {"StringWithMarkup": [{"String": t}]}} for t in texts]
    leaf = {"TOCHeading": heading, "Information": info}
    record = {
        "RecordNumber": cid,
        "Section": [{"TOCHeading": "Chemical and Physical Properties", "Section": [{"TOCHeading": "Experimental Properties", "Section": [leaf]}]}, {"TOCHeading": "Other"}],
        "Reference": [{"ReferenceNumber": 7, "SourceName": "S", "Description": "d" * 300, "URL": ""}],
    }
    return json.dumps({"Record": record})


def test_documents(spark):
    docs = spark.createDataFrame([(document(2244, "Melting Point", "135 °C", "275 °F"),), ("{}",), ("not json",), (None,)], "json string")
    rows = parse.property_table(docs, "Melting Point").orderBy("raw").collect()
    assert [(r["cid"], r["value"], r["unit"]) for r in rows] == [(2244, "135", "°C"), (2244, "275", "°F")]
    assert rows[0]["reference"] == "Source: S | Description: " + "d" * 200 + "..."
    assert parse.property_table(docs, "Density").count() == 0


def test_property_map(spark):
    props = [
        {"urn": {"label": "Molecular Formula"}, "value": {"sval": "CH4"}},
        {"urn": {"label": "Count", "name": "Hydrogen Bond Donor"}, "value": {"ival": 2}},
        {"urn": {"label": "New-Label", "name": "a b"}, "value": {"fval": 1.5}},
        {"urn": {"label": "Empty"}, "value": {}},
        {"urn": {"label": "Molecular Formula"}, "value": {"sval": "C2H6"}},
    ]
    df = spark.createDataFrame([(json.dumps(props),), ("[]",)], "j string").select(parse.property_map(F.from_json("j", parse.PROPERTY_LIST)).alias("m"))
    assert df.collect()[0]["m"] == {"MolecularFormula": "C2H6", "HBondDonorCount": "2", "NewLabel_ab": "1.5"}

"""File sources: SDF records, XLSX sheets, delimited exports, and the split of an export into tables.

All of them are read with Spark's own readers, so a path may be in any store that Spark reads.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator, Sequence
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.functions.cols import classify_synonym, split_list

#: Field of an SDF record -> column; the last two are ``;`` lists.
SDF_FIELDS = {
    "ChEBI ID": "chebi_id",
    "ChEBI NAME": "name",
    "STAR": "star",
    "FORMULA": "formula",
    "MASS": "mass",
    "SMILES": "smiles",
    "INCHI": "inchi",
    "INCHIKEY": "inchikey",
    "CAS Registry Numbers": "cas",
    "SYNONYM": "synonyms",
}


def read_sdf(spark: SparkSession, path: str) -> DataFrame:
    """One row per record with the columns of SDF_FIELDS; a field's first value line counts. Records without an id are dropped."""
    records = spark.read.text(path, lineSep="$$$$").select(F.regexp_replace("value", "\r\n?", "\n").alias("record"))

    def item(name: str) -> Column:
        return F.nullif(F.trim(F.regexp_extract("record", rf"(?m)^> *<{re.escape(name)}>[^\n]*\n([^\n]*)", 1)), F.lit(""))

    out = records.select(*[item(n).alias(c) for n, c in SDF_FIELDS.items()]).where("chebi_id is not null")
    return out.withColumns(
        {"star": F.col("star").try_cast("int"), "mass": F.col("mass").try_cast("double"), "cas": split_list(F.col("cas"), ";"), "synonyms": split_list(F.col("synonyms"), ";")}
    )


def min_stars(compounds: DataFrame, least: int = 3) -> DataFrame:
    """Rows rated least or better; a rating that is no number is skipped."""
    return compounds.where(F.col("star").try_cast("int") >= least)


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _column_number(reference: str) -> int:
    number = 0
    for c in re.match("[A-Z]+", reference).group():
        number = 26 * number + ord(c) - 64
    return number - 1


def sheet_rows(data: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """The cells of a sheet (the first one by default) as text, row by row."""
    with zipfile.ZipFile(io.BytesIO(data)) as book:
        names = set(book.namelist())
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = ["".join(t.text or "" for t in s.iter(f"{_NS}t")) for s in ElementTree.fromstring(book.read("xl/sharedStrings.xml")).iter(f"{_NS}si")]
        sheets = [(s.get("name"), s.get(_REL)) for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{_NS}sheet")]
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
        wanted = next((i for n, i in sheets if sheet is None or n == sheet), None)
        if wanted is None:
            raise ValueError(f"no sheet {sheet!r}; there are {[n for n, _ in sheets]}")
        target = targets[wanted].lstrip("/")
        root = ElementTree.fromstring(book.read(target if target.startswith("xl/") else f"xl/{target}"))
    rows = []
    for row in root.iter(f"{_NS}row"):
        cells: dict[int, str | None] = {}
        for cell in row.iter(f"{_NS}c"):
            kind, value = cell.get("t"), cell.find(f"{_NS}v")
            if kind == "inlineStr":
                text = "".join(t.text or "" for t in cell.iter(f"{_NS}t"))
            else:
                text = None if value is None else shared[int(value.text)] if kind == "s" else value.text
            cells[_column_number(cell.get("r"))] = text
        rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def read_xlsx(spark: SparkSession, path: str, columns: Sequence[str], sheet: str | None = None) -> DataFrame:
    """The named columns of workbooks at path, as strings; a missing column is an error. A workbook is read by one task."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for data in batch["content"]:
                rows = sheet_rows(bytes(data), sheet)
                header = rows[0] if rows else []
                if missing := [c for c in columns if c not in header]:
                    raise ValueError(f"columns are missing: {missing}")
                at = [header.index(c) for c in columns]
                yield pd.DataFrame([[r[i] if i < len(r) else None for i in at] for r in rows[1:]], columns=list(columns), dtype="object")

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInPandas(parse, ", ".join(f"`{c}` string" for c in columns))


def require_columns(df: DataFrame, needed: Sequence[str]) -> DataFrame:
    if missing := sorted({*needed} - {*df.columns}):
        raise ValueError(f"columns are missing: {missing}")
    return df


def split_export(rows: DataFrame, id_col: str = "cid", synonyms_col: str = "cmpdsynonym") -> dict[str, DataFrame]:
    """A flat export with pipe-joined synonyms as compounds, cas_numbers and synonyms; missing keys are filled from the synonyms."""
    each = rows.select(id_col, F.explode(split_list(F.col(synonyms_col), "|")).alias("s")).select(id_col, classify_synonym(F.col("s")).alias("c")).select(id_col, "c.kind", "c.value")
    first = each.where("kind in ('inchi', 'inchikey')").groupBy(id_col).agg(F.min(F.when(F.col("kind") == "inchi", F.col("value"))).alias("_inchi"), F.min(F.when(F.col("kind") == "inchikey", F.col("value"))).alias("_inchikey"))
    compounds = rows.drop(synonyms_col).join(first, id_col, "left")
    for c in ("inchi", "inchikey"):
        own = F.col(c) if c in rows.columns else F.lit(None).cast("string")
        compounds = compounds.withColumn(c, F.coalesce(own, F.col(f"_{c}")))
    return {
        "compounds": compounds.drop("_inchi", "_inchikey"),
        "cas_numbers": each.where("kind = 'cas'").select(id_col, F.col("value").alias("cas")).distinct(),
        "synonyms": each.where("kind = 'synonym'").select(id_col, F.col("value").alias("synonym")).distinct(),
    }


def read_queries(spark: SparkSession, path: str, column: str) -> DataFrame:
    """Queries from a CSV or Parquet file, as strings."""
    df = spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, inferSchema=False)
    return require_columns(df, [column]).withColumn(column, F.col(column).cast("string"))

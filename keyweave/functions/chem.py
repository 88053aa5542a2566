"""Structure functions behind an optional backend, and formula arithmetic that needs none."""

from __future__ import annotations

import importlib.util
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Standard atomic weights; of elements without stable isotopes the mass number of the longest-lived one.
ATOMIC_WEIGHTS = {
    "H": 1.008, "He": 4.0026, "Li": 6.94, "Be": 9.0122, "B": 10.81, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998, "Ne": 20.180,
    "Na": 22.990, "Mg": 24.305, "Al": 26.982, "Si": 28.085, "P": 30.974, "S": 32.06, "Cl": 35.45, "Ar": 39.95, "K": 39.098, "Ca": 40.078,
    "Sc": 44.956, "Ti": 47.867, "V": 50.942, "Cr": 51.996, "Mn": 54.938, "Fe": 55.845, "Co": 58.933, "Ni": 58.693, "Cu": 63.546, "Zn": 65.38,
    "Ga": 69.723, "Ge": 72.630, "As": 74.922, "Se": 78.971, "Br": 79.904, "Kr": 83.798, "Rb": 85.468, "Sr": 87.62, "Y": 88.906, "Zr": 91.224,
    "Nb": 92.906, "Mo": 95.95, "Tc": 98.0, "Ru": 101.07, "Rh": 102.91, "Pd": 106.42, "Ag": 107.87, "Cd": 112.41, "In": 114.82, "Sn": 118.71,
    "Sb": 121.76, "Te": 127.60, "I": 126.90, "Xe": 131.29, "Cs": 132.91, "Ba": 137.33, "La": 138.91, "Ce": 140.12, "Pr": 140.91, "Nd": 144.24,
    "Pm": 145.0, "Sm": 150.36, "Eu": 151.96, "Gd": 157.25, "Tb": 158.93, "Dy": 162.50, "Ho": 164.93, "Er": 167.26, "Tm": 168.93, "Yb": 173.05,
    "Lu": 174.97, "Hf": 178.49, "Ta": 180.95, "W": 183.84, "Re": 186.21, "Os": 190.23, "Ir": 192.22, "Pt": 195.08, "Au": 196.97, "Hg": 200.59,
    "Tl": 204.38, "Pb": 207.2, "Bi": 208.98, "Po": 209.0, "At": 210.0, "Rn": 222.0, "Fr": 223.0, "Ra": 226.0, "Ac": 227.0, "Th": 232.04,
    "Pa": 231.04, "U": 238.03, "Np": 237.0, "Pu": 244.0, "Am": 243.0, "Cm": 247.0, "Bk": 247.0, "Cf": 251.0, "Es": 252.0, "Fm": 257.0,
    "Md": 258.0, "No": 259.0, "Lr": 262.0,
}
STRUCTURE = T.StructType([T.StructField(n, T.StringType()) for n in ("canonical_smiles", "kekulized_smiles", "inchi", "inchikey")] + [T.StructField("mass", T.DoubleType())])


def available() -> bool:
    return importlib.util.find_spec("rdkit") is not None


def formula_mass(formula: Column) -> Column:
    """Average mass of a formula without brackets; null if it has an unknown symbol or other characters."""
    table = F.create_map(*[F.lit(x) for kv in ATOMIC_WEIGHTS.items() for x in kv])
    tokens = F.regexp_extract_all(formula, F.lit("([A-Z][a-z]?[0-9]*)"), F.lit(1))
    weights = F.transform(tokens, lambda t: table[F.regexp_extract(t, "^[A-Za-z]+", 0)] * F.coalesce(F.nullif(F.regexp_extract(t, "[0-9]+$", 0), F.lit("")).cast("int"), F.lit(1)))
    total = F.aggregate(weights, F.lit(0.0), lambda a, x: a + x)
    return F.when((formula != "") & (F.array_join(tokens, "") == formula), total)


@F.pandas_udf(STRUCTURE)
def normalise_structure(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    """Struct of STRUCTURE; all null without a backend or for an invalid structure."""
    names = STRUCTURE.names
    chem = None
    if importlib.util.find_spec("rdkit") is not None:
        from rdkit import Chem as chem
        from rdkit.Chem import Descriptors

    def one(smiles: str | None) -> list:
        mol = chem.MolFromSmiles(smiles) if chem and smiles else None
        if mol is None:
            return [None] * 5
        flat = chem.Mol(mol)
        chem.Kekulize(flat, clearAromaticFlags=True)
        return [chem.MolToSmiles(mol), chem.MolToSmiles(flat, kekuleSmiles=True), chem.MolToInchi(mol), chem.MolToInchiKey(mol), Descriptors.MolWt(mol)]

    for batch in batches:
        yield pd.DataFrame([one(s) for s in batch], columns=names)


def substructure(pattern: str):
    """UDF: does a structure match the pattern? Null without a backend."""

    @F.pandas_udf(T.BooleanType())
    def match(smiles: pd.Series) -> pd.Series:
        if importlib.util.find_spec("rdkit") is None:
            return pd.Series([None] * len(smiles), dtype="object")
        from rdkit import Chem

        query = Chem.MolFromSmarts(pattern)
        mols = [Chem.MolFromSmiles(s) if s else None for s in smiles]
        return pd.Series([None if m is None else m.HasSubstructMatch(query) for m in mols], dtype="object")

    return match


@F.pandas_udf(T.ArrayType(T.LongType()))
def morgan_bits(smiles: pd.Series) -> pd.Series:
    """Radius 2, 2048 bits, as 32 longs; null without a backend."""
    if importlib.util.find_spec("rdkit") is None:
        return pd.Series([None] * len(smiles), dtype="object")
    import numpy as np
    from rdkit import Chem
    from rdkit.Chem import rdFingerprintGenerator

    make = rdFingerprintGenerator.GetMorganGenerator(radius=2, fpSize=2048)
    mols = [Chem.MolFromSmiles(s) if s else None for s in smiles]
    return pd.Series([None if m is None else np.packbits(make.GetFingerprintAsNumPy(m).astype(bool), bitorder="little").view(np.int64).tolist() for m in mols], dtype="object")

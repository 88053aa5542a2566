"""Scalar functions on identifiers, names and lists, as Column expressions that stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What stands for a missing value, by source; compared after trimming and lower-casing.
MISSING = ("", "nan")
MISSING_IN_DOSSIERS = ("", "nan", "none", "na")
#: Stereo prefixes that a normalised name loses, one at most.
NAME_PREFIXES = ("(±)-", "(+)-", "(-)-", "rac-", "dl-", "d-", "l-", "(r)-", "(s)-", "(rs)-", "(e)-", "(z)-")
#: Abbreviations that stand for a whole name.
ABBREVIATIONS = {
    "mek": "methyl ethyl ketone",
    "mibk": "methyl isobutyl ketone",
    "dmf": "dimethylformamide",
    "dmso": "dimethyl sulfoxide",
    "thf": "tetrahydrofuran",
    "dcm": "dichloromethane",
    "etoh": "ethanol",
    "meoh": "methanol",
    "acn": "acetonitrile",
    "egme": "ethylene glycol monomethyl ether",
}
#: Fixed patterns of identifiers.
CAS = r"(?<![\p{L}\p{N}_])[0-9]{2,7}-[0-9]{2}-[0-9](?![\p{L}\p{N}_])"
INCHIKEY = r"[A-Z]{14}-[A-Z]{10}-[A-Z]"
INCHI = r"InChI=[^\s]+"
#: Family -> (pattern over the upper-cased text, all matches or the first of each text).
ID_FAMILIES = {
    "casrn": (CAS, True),
    "nsc": (r"\bNSC\s*[0-9]+\b", False),
    "dtxsid": (r"\bDTXSID[0-9]+\b", False),
    "dtxcid": (r"\bDTXCID[0-9]+\b", False),
    "ec_number": (r"\b[0-9]{1,2}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\b", True),
    "chebi_id": (r"\bCHEBI:?\s*[0-9]+\b", False),
    "chembl": (r"\bCHEMBL[0-9]+\b", False),
}


def is_missing(c: Column, words: tuple[str, ...] = MISSING) -> Column:
    return c.isNull() | F.lower(F.trim(c.cast("string"))).isin(*words)


def nullif_missing(c: Column, words: tuple[str, ...] = MISSING) -> Column:
    """Null for a missing value, else the value; applied once at ingest, after which coalesce and joins are right."""
    return F.when(~is_missing(c, words), c)


def first_present(*columns: Column) -> Column:
    return F.coalesce(*[nullif_missing(c) for c in columns])


def to_float(c: Column) -> Column:
    return c.try_cast("double")


def rounded(c: Column, digits: int) -> Column:
    """A double is scaled, then rounded, as SQL engines do: rounding its decimal text ends otherwise near a half."""
    return F.round(c * 10.0**digits) / 10.0**digits


def norm_ws(c: Column) -> Column:
    """Lower case, white space squeezed; two names are the same name if these are equal."""
    return F.regexp_replace(F.trim(F.regexp_replace(F.lower(c), r"[\s ]+", " ")), "^ | $", "")


def norm_name(c: Column) -> Column:
    """norm_ws without one stereo prefix, abbreviations spelt out."""
    low = F.lower(F.trim(c))
    quoted = "|".join("\\Q" + p + "\\E" for p in NAME_PREFIXES)
    bare = norm_ws(F.regexp_replace(low, f"^(?:{quoted})", ""))
    table = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    return F.coalesce(table[bare], bare)


def has_cas_format(c: Column) -> Column:
    """Exactly three groups of digits."""
    return F.coalesce(c.rlike(r"^[0-9]+-[0-9]+-[0-9]+$"), F.lit(False))


def cas_valid(c: Column) -> Column:
    """The check digit equals the sum of position x digit, counted from the right over the first two groups, modulo 10."""
    digits = F.split(F.reverse(F.concat(F.split_part(c, F.lit("-"), F.lit(1)), F.split_part(c, F.lit("-"), F.lit(2)))), "")
    total = F.aggregate(F.transform(digits, lambda x, i: (i + 1) * x.try_cast("int")), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return F.when(has_cas_format(c), total % 10 == F.split_part(c, F.lit("-"), F.lit(3)).try_cast("int")).otherwise(False)


def extract_cas(c: Column) -> Column:
    """Registry numbers in a text: sorted, each once."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(CAS), F.lit(0))))


def extract_ids(synonyms: Column) -> Column:
    """Struct of the seven identifier families found in an array of synonyms, each in order of appearance without repeats."""
    upper = F.transform(F.filter(F.coalesce(synonyms, F.array().cast("array<string>")), lambda s: s.isNotNull()), lambda s: F.upper(F.trim(s)))

    def family(name: str) -> Column:
        pattern, every = ID_FAMILIES[name]
        if every:
            found = F.flatten(F.transform(upper, lambda s: F.regexp_extract_all(s, F.lit(pattern), F.lit(0))))
        else:
            found = F.filter(F.transform(upper, lambda s: F.regexp_extract(s, pattern, 0)), lambda s: s != "")
        if name == "nsc":
            found = F.transform(found, lambda s: F.replace(s, F.lit(" "), F.lit("")))
        if name == "chebi_id":
            found = F.transform(found, lambda s: F.concat(F.lit("CHEBI:"), F.regexp_extract(s, "[0-9]+", 0)))
        return F.array_distinct(found).alias(name)

    return F.struct(*[family(n) for n in ID_FAMILIES])


def classify_synonym(c: Column) -> Column:
    """Struct (kind, value): cas, inchikey, inchi or synonym, the first that fits; null for a blank one."""
    text = F.trim(c)
    tried = [("cas", CAS), ("inchikey", r"\b" + INCHIKEY + r"\b"), ("inchi", INCHI)]
    out = F.when(text.isNull() | (text == ""), F.lit(None))
    for kind, pattern in tried:
        out = out.when(text.rlike(pattern), F.struct(F.lit(kind).alias("kind"), F.regexp_extract(text, pattern, 0).alias("value")))
    return out.otherwise(F.struct(F.lit("synonym").alias("kind"), text.alias("value")))


def identifier_kind(c: Column) -> Column:
    """inchikey, inchi, cas or text, by shape."""
    return F.when(c.rlike(f"^{INCHIKEY}$"), "inchikey").when(c.startswith("InChI="), "inchi").when(cas_valid(c), "cas").when(c.isNotNull(), "text")


def skeleton(inchikey: Column) -> Column:
    """The first 14 characters, which stand for the connectivity."""
    return F.when(F.length(inchikey) >= 14, F.substring(inchikey, 1, 14))


def formula_layer(inchi: Column) -> Column:
    """The second layer of an InChI."""
    return F.when(F.size(F.split(inchi, "/")) > 1, F.split_part(inchi, F.lit("/"), F.lit(2)))


def split_list(c: Column, sep: str) -> Column:
    """A text list as an array: parts trimmed, blank ones dropped; null has none."""
    parts = F.split(F.coalesce(c, F.lit("")), "\\Q" + sep + "\\E")
    return F.filter(F.transform(parts, lambda x: F.trim(x)), lambda x: x != "")


def join_list(c: Column, sep: str = "; ") -> Column:
    """The present members of an array as one text; null if there are none."""
    kept = F.filter(F.transform(c, lambda x: F.trim(x)), lambda x: ~is_missing(x))
    return F.when(F.size(kept) > 0, F.array_join(kept, sep))


def ordered_distinct(pairs: Column) -> Column:
    """Of an array of (position, value) structs the values in order of position, each once, blanks dropped."""
    return F.array_distinct(F.filter(F.transform(F.array_sort(pairs), lambda p: p["value"]), lambda v: v.isNotNull() & (v != "")))


def has_attachment_point(smiles: Column) -> Column:
    return F.coalesce(smiles.contains("*"), F.lit(False))


def largest_fragment(smiles: Column) -> Column:
    """Without a structure backend: of the dot-separated parts the one with most letters, the first of equals."""
    parts = F.transform(F.split(smiles, r"\."), lambda p, i: F.struct(F.length(F.regexp_replace(p, "[^A-Za-z]", "")).alias("n"), (-i).alias("at"), p.alias("part")))
    return F.array_max(parts)["part"]


def like_pattern(pattern: str) -> str:
    """The lookup pattern as LIKE: ``.*`` any run, ``.`` one character; other characters are literal."""
    out, i = [], 0
    while i < len(pattern):
        if pattern[i : i + 2] == ".*":
            out.append("%")
            i += 2
            continue
        out.append("_" if pattern[i] == "." else "\\" + pattern[i] if pattern[i] in "%_\\" else pattern[i])
        i += 1
    return "".join(out)


def request_url(base: str, *parts: Column) -> Column:
    """A path of quoted parts below base."""
    return F.concat_ws("/", F.lit(base), *[F.replace(F.url_encode(p), F.lit("+"), F.lit("%20")) for p in parts])


def memo_key(function: str, *arguments: Column) -> Column:
    """SHA-256 of the function's name and its arguments as JSON."""
    packed = F.struct(F.lit(function).alias("function"), *[a.alias(f"a{i}") for i, a in enumerate(arguments)])
    return F.sha2(F.to_json(packed, {"ignoreNullFields": "false"}), 256)

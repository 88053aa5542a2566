"""License scans by canonical digest, with Spark expressions only.

A text is normalised (case, copyright lines, punctuation, equivalent spellings, white space) and its
SHA-256 looked up among the digests of known licence texts with a hash join. The same lookup runs
over each line and each paragraph, which finds notices and headers that stand in a longer document.
Few known texts are shipped with the plan; more are joined by digest, so their number has no limit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from keyweave.llm.common import checkpointed, text_or_empty
from keyweave.llm.license_texts import KNOWN, WHOLE

#: Most known digests that are part of the plan; a longer list is joined.
LITERAL = 2_000
#: Words that a paragraph of a known text has at least, to stand for it.
PARAGRAPH_WORDS = 20
#: Spellings that count as the same, the second is the canonical one.
SPELLINGS = [
    ("licence", "license"),
    ("sublicence", "sublicense"),
    ("organisation", "organization"),
    ("acknowledgement", "acknowledgment"),
    ("authorisation", "authorization"),
    ("authorised", "authorized"),
    ("favour", "favor"),
    ("fulfil ", "fulfill "),
    ("merchantibility", "merchantability"),
    ("noninfringement", "non infringement"),
    ("whilst", "while"),
    ("per cent", "percent"),
    ("gplv2", "gpl 2"),
    ("gplv3", "gpl 3"),
    (" v2 ", " version 2 "),
    (" v3 ", " version 3 "),
    ("http ", "https "),
]
#: Words after "copyright" that continue a sentence, where a line happens to begin with it.
CONTINUED = (
    "notices?|holders?|owners?|ownership|laws?|interests?|licen[cs]es?|permissions?|statements?|protections?|treat(?:y|ies)|disclaimers?|rights?|acts?|claims?|infringements?|"
    "information|material|resulting|applies|the +(?:software|library|work|program)|and|or|on|in|to|is|as|of|for|from|under|with|that|which|shall|may|must|are|was|were|has|have|does|can|will|if|when|where|but|than|not|at|over|any|such|this|these|those|other"
)
#: Words after "(c)" where it counts the items of a list in a known text.
LISTED = "you must|the licenses|representations|under patent"
# The patterns below mean the same to Java and RE2. A line begins after white space and the marks of comments.
MARKS = r"^[ \t\x0B\f\r/*#;-]+"
_BLANK, _REST = r"[ \t\x0B\f\r]", r"""[^ \t\x0B\f\r,.;:/"')"""
#: A year, sign or holder follows on the line.
HOLDER = rf"^copyright(?::{_BLANK}*{_REST}]|{_BLANK}+{_REST}]|{_REST}\p{{L}}\p{{N}}_-])"
SENTENCE = rf"^copyright:?{_BLANK}+(?:{CONTINUED})(?:[^\p{{L}}\p{{N}}_]|$)"
COUNTED = rf"^\(c\){_BLANK}+(?:{LISTED})(?:[^\p{{L}}\p{{N}}_]|$)"
OTHERS, GAP = r"[^\p{L}\p{N}\n]+", r"\n *\n[ \n]*"


def _is_notice(lines: Column, line: Column, i: Column) -> Column:
    """A copyright notice names a year, sign or holder; the next line shows whether a sentence goes on."""
    bare = lambda x: F.regexp_replace(x, MARKS, "")
    rest = bare(line)
    ahead = F.concat(rest, F.lit(" "), bare(F.coalesce(F.get(lines, i + 1), F.lit(""))))
    by_word = rest.rlike(HOLDER) & ~ahead.rlike(SENTENCE)
    by_sign = F.startswith(rest, F.lit("(c)")) & (F.trim(rest) != "(c)") & ~ahead.rlike(COUNTED)
    return F.startswith(rest, F.lit("©")) | by_word | by_sign


def _plain(text: Column) -> Column:
    """A text in canonical form, with its line breaks; copyright notices are left out."""
    low = F.lower(text)
    lines = F.split(low, "\n")
    marked = F.contains(low, F.lit("copyright")) | F.contains(low, F.lit("(c)")) | F.contains(low, F.lit("©"))
    # lines as a variable of its own: split once, not for each line
    kept = F.get(F.transform(F.array(lines), lambda ls: F.array_join(F.filter(ls, lambda x, i: ~_is_notice(ls, x, i)), "\n")), F.lit(0))
    plain = F.regexp_replace(F.when(marked, kept).otherwise(low), OTHERS, " ")
    for one, other in SPELLINGS:
        plain = F.replace(plain, F.lit(one), F.lit(other))
    return plain


def _lines(plain: Column) -> Column:
    return F.filter(F.transform(F.split(plain, "\n"), lambda line: F.trim(line)), lambda line: line != "")


def _paragraphs(plain: Column) -> Column:
    """Runs of lines without a blank one between them, each on one line; a text of one paragraph counts as its lines only."""
    return F.filter(F.transform(F.split(plain, GAP), lambda p: F.array_join(_lines(p), " ")), lambda p: p != "")


def normalised_lines(text: Column) -> Column:
    """The lines of a text in canonical form, blank lines and copyright notices left out."""
    return _lines(_plain(text))


def digest(lines: Column) -> Column:
    """Of the whole text: line breaks count as white space."""
    return F.sha2(F.array_join(lines, " "), 256)


def known_digests(spark: SparkSession, known: dict[str, str] | None = None) -> DataFrame:
    """license, digest, chars (of the canonical form), whole; by default also those of WHOLE.

    Of texts that are equal in canonical form the first name stays. Rows that are not whole are paragraphs
    of PARAGRAPH_WORDS words or more that the texts of one licence only have.
    """
    more = WHOLE if known is None else {}
    known = KNOWN if known is None else known
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(known.items())], "at int, name string, text string")
    each = rows.select("at", F.regexp_replace("name", "#.*", "").alias("license"), _plain(F.col("text")).alias("plain"))
    size = lambda c: F.length(c).alias("chars")
    whole = each.withColumn("form", F.array_join(_lines(F.col("plain")), " ")).groupBy(F.sha2("form", 256).alias("digest"), size("form")).agg(F.min_by("license", "at").alias("license"))
    part = each.select("license", F.explode(_paragraphs(F.col("plain"))).alias("form")).where(F.size(F.split("form", " ")) >= PARAGRAPH_WORDS)
    part = part.groupBy(F.sha2("form", 256).alias("digest"), size("form")).agg(F.min("license").alias("license"), F.max("license").alias("last")).where("license = last").drop("last")
    part = part.join(whole.select("digest"), "digest", "left_anti")
    long = spark.createDataFrame([(d, n, c) for n, (d, c) in more.items()], "digest string, license string, chars int")
    return whole.unionByName(long).withColumn("whole", F.lit(True)).unionByName(part.withColumn("whole", F.lit(False)))


def scan(docs: DataFrame, known: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", literal: int = LITERAL) -> DataFrame:
    """One row per document: id, text_digest, license, notices.

    license names the known text that the whole document equals, else null; notices is the sorted
    set of known texts that a line or paragraph of it equals, or of which it has a paragraph of its
    own. A null text counts as empty and equals no known text. Repeated rows give a row each. An empty
    table gives no rows. More than literal known digests are joined instead of shipped with the plan.
    """
    spark, digests = docs.sparkSession, known_digests(docs.sparkSession, known)
    listed = digests.head(literal + 1)
    if few := len(listed) <= literal:
        digests = spark.createDataFrame(listed, digests.schema)
        chars = sorted({r["chars"] for r in listed})
    else:
        digests = checkpointed(digests)
        chars = sorted(r["chars"] for r in digests.select("chars").distinct().collect())  # lengths of known texts
    each = docs.select(F.col(id_col).alias("id"), _plain(text_or_empty(text_col)).alias("plain"))
    each = each.select("id", _lines(F.col("plain")).alias("lines"), _paragraphs(F.col("plain")).alias("paragraphs"))
    # a line or paragraph of another length equals no known text, so few need a digest
    some = F.filter(F.array_union("lines", "paragraphs"), lambda x: F.length(x).isin(chars))
    each = each.select("id", digest(F.col("lines")).alias("text_digest"), F.transform(some, lambda x: F.sha2(x, 256)).alias("parts"))
    whole = digests.where("whole").select(F.col("digest").alias("text_digest"), "license")
    each = each.join(F.broadcast(whole) if few else whole, "text_digest", "left")
    if few:
        table = F.create_map(*[F.lit(v) for r in listed for v in (r["digest"], r["license"])]) if listed else F.create_map().cast("map<string,string>")
        notices = F.array_sort(F.array_distinct(F.filter(F.transform("parts", lambda x: table[x]), lambda x: x.isNotNull())))
        return each.select(F.col("id").alias(id_col), "text_digest", "license", notices.alias("notices"))
    # equal texts have equal notices
    met = each.select("text_digest", F.explode("parts").alias("digest")).distinct().join(digests.select("digest", F.col("license").alias("notice")), "digest")
    met = met.groupBy("text_digest").agg(F.array_sort(F.collect_set("notice")).alias("notices"))
    none = F.array().cast("array<string>")
    return each.join(met, "text_digest", "left").select(F.col("id").alias(id_col), "text_digest", "license", F.coalesce("notices", none).alias("notices"))


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def scan_sql(known: dict[str, str], more: dict[str, tuple[str, int]]) -> str:
    """DuckDB SQL for the rows of scan() over documents."""
    bare = lambda x: f"regexp_replace({x}, {_quoted(MARKS)}, '')"
    rest, ahead = bare("x"), f"{bare('x')} || ' ' || {bare('coalesce(ls[i + 1], chr(32))')}"
    notice = (
        f"(starts_with({rest}, '©') OR (regexp_matches({rest}, {_quoted(HOLDER)}) AND NOT regexp_matches({ahead}, {_quoted(SENTENCE)}))"
        f" OR (starts_with({rest}, '(c)') AND trim({rest}) <> '(c)' AND NOT regexp_matches({ahead}, {_quoted(COUNTED)})))"
    )
    plain = f"regexp_replace(array_to_string(list_filter(ls, lambda x, i: NOT {notice}), chr(10)), {_quoted(OTHERS)}, ' ', 'g')"
    for one, other in SPELLINGS:
        plain = f"replace({plain}, {_quoted(one)}, {_quoted(other)})"
    lines = lambda x: f"list_filter(list_transform(string_split({x}, chr(10)), lambda y: trim(y)), lambda y: y <> '')"
    paragraphs = f"list_filter(list_transform(string_split_regex(plain, {_quoted(GAP)}), lambda p: array_to_string({lines('p')}, ' ')), lambda p: p <> '')"
    values = ", ".join(f"({i}, {_quoted(n.split('#')[0])}, {_quoted(t)})" for i, (n, t) in enumerate(known.items()))
    long = ", ".join(f"({_quoted(d)}, {_quoted(n)})" for n, (d, _) in more.items())
    return f"""
WITH texts AS (SELECT doc_id, NULL AS pos, NULL AS license, coalesce(text, '') AS text FROM documents UNION ALL SELECT NULL, * FROM (VALUES {values}) k(pos, license, text)),
split_ AS (SELECT * EXCLUDE (text), string_split(lower(text), chr(10)) AS ls FROM texts),
plain_ AS (SELECT * EXCLUDE (ls), {plain} AS plain FROM split_),
forms AS (SELECT doc_id, pos, license, {lines("plain")} AS lines, {paragraphs} AS paragraphs FROM plain_),
whole AS (SELECT sha256(array_to_string(lines, ' ')) AS digest, arg_min(license, pos) AS license FROM forms WHERE pos IS NOT NULL GROUP BY 1 UNION ALL SELECT * FROM (VALUES {long})),
part AS (SELECT sha256(form) AS digest, min(license) AS license FROM (SELECT license, unnest(paragraphs) AS form FROM forms WHERE pos IS NOT NULL)
  WHERE len(string_split(form, ' ')) >= {PARAGRAPH_WORDS} GROUP BY 1 HAVING min(license) = max(license)),
known AS (SELECT * FROM whole UNION ALL SELECT * FROM part WHERE digest NOT IN (SELECT digest FROM whole)),
docs AS (SELECT row_number() OVER () AS r, doc_id, sha256(array_to_string(lines, ' ')) AS text_digest, list_distinct(list_concat(lines, paragraphs)) AS parts FROM forms WHERE pos IS NULL),
met AS (SELECT r, string_agg(DISTINCT license, ',' ORDER BY license) AS notices, count(DISTINCT license) AS n FROM (SELECT r, sha256(unnest(parts)) AS digest FROM docs) JOIN known USING (digest) GROUP BY r)
SELECT d.doc_id, d.text_digest, w.license, coalesce(m.notices, '') AS notices, coalesce(m.n, 0)::BIGINT AS n_notices
FROM docs d LEFT JOIN whole w ON d.text_digest = w.digest LEFT JOIN met m ON d.r = m.r"""

"""Quality rules as weak supervision.

Each rule looks at whole-text statistics of a document and votes good, bad or abstains. The votes of
all documents are counted by vote pattern (3 to the power of the number of rules at most, whatever
the input), and expectation-maximisation over those counts estimates, for good and for bad documents,
how often each rule that votes votes bad, and how common good documents are. The posterior probability of
being good decides, instead of having to pass every rule.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyweave.llm.common import checkpointed, fresh, text_or_empty

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_ended_lines", "n_caps_words", "n_bangs", "n_symbol_words"]
_ENDED = re.compile(rb'[.!?:;"\')\]]\s*$|(?:\xe2\x80\x9d|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)\s*$')
_SYMBOLS = [x.encode() for x in "#*$%&|<>"]


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that the text holds twice or more, each word once."""
    n = len(words) - 2
    if n < 2:
        return 0
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == n:
        return 0
    ids: dict[tuple, int] = {}
    each = np.fromiter((ids.setdefault(w, len(ids)) for w in windows), np.int64, n)
    starts = np.bincount(each)[each] > 1
    covered = np.zeros(n + 2, bool)
    for k in range(3):
        covered[k : k + n] |= starts
    return int(covered.sum())


def counts(text: str) -> tuple[int, ...]:
    """The statistics named in COUNTS, of the whole text."""
    data = text.encode()
    words = data.split()
    lines = [x for x in data.split(b"\n") if x.strip()]
    joined = b"".join(words)
    upper = sum(1 for w in words if len(w) > 1 and w.isupper()) if words else 0
    with_symbols = sum(data.count(s) for s in _SYMBOLS)
    return (
        len(words),
        len(joined.decode()) if not joined.isascii() else len(joined),
        with_symbols,
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        sum(1 for x in lines if _ENDED.search(x.rstrip()[-8:])),
        upper,
        data.count(b"!"),
        sum(1 for w in words if not w.isalpha() and any(s in w for s in _SYMBOLS)) if with_symbols else 0,
    )


def _count(batches: Iterable[pa.RecordBatch], names: list[str]) -> Iterator[pa.RecordBatch]:
    """The batches without their last column, a text, and with its counts."""
    for batch in batches:
        columns = list(zip(*(counts(x) for x in batch.column(batch.num_columns - 1).to_pylist()))) or [[]] * len(COUNTS)
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *[pa.array(c, pa.int64()) for c in columns]], names=names)


def measured(docs: DataFrame, text_col: str = "text", carry: list[str] | None = None, prefix: str = "") -> DataFrame:
    """The carried columns (all by default) of each document and COUNTS under prefix. A null text has no words."""
    carried = docs.columns if carry is None else carry
    schema = T.StructType([*[docs.schema[c] for c in carried], *[T.StructField(prefix + n, T.LongType()) for n in COUNTS]])
    (text,) = fresh(carried, "_text")
    return docs.select(*carried, text_or_empty(text_col).alias(text)).mapInArrow(lambda b: _count(b, schema.names), schema)


def _between(value: Column, bad: Column, good: Column) -> Column:
    return F.when(value.isNull(), 0).when(bad, -1).when(good, 1).otherwise(0)


def votes(prefix: str = "") -> dict[str, Column]:
    """Rule -> vote (1 good, -1 bad, 0 abstains), over the columns of measured().

    The thresholds are round numbers that prose of any language stays clear of (2.5 to 14 characters a
    word, say) with a gap between good and bad in which a rule abstains; they weren't fitted to labels.
    """
    c = lambda n: F.col(prefix + n)
    words = F.when(c("n_words") > 0, c("n_words"))
    lines = F.when(c("n_lines") > 0, c("n_lines"))
    symbols, repeats = c("n_symbol_words") / words, c("n_repeat_words") / words
    marks = c("n_symbols") / F.when(c("word_chars") > 0, c("word_chars"))
    length, caps, bangs = c("word_chars") / words, c("n_caps_words") / words, c("n_bangs") / words
    dup, ended = c("n_dup_lines") / lines, c("n_ended_lines") / lines
    return {
        # one rule, as both shares count the same characters and EM takes rules to be independent
        "symbols": _between(symbols + marks, (symbols > 0.1) | (marks > 0.05), (symbols < 0.05) & (marks < 0.03)),
        "repeats": _between(repeats, repeats > 0.35, repeats < 0.2),
        "word_length": _between(length, (length < 2.5) | (length > 14), (length > 3) & (length < 10)),
        "capitals": _between(caps, caps > 0.3, caps < 0.15),
        "exclamations": _between(bangs, bangs > 0.15, bangs < 0.05),
        "line_copies": _between(dup, dup > 0.5, (dup < 0.2) & (lines >= 3)),
        "line_ends": _between(ended, (ended < 0.2) & (lines >= 3), ended > 0.6),
    }


def estimate(patterns: np.ndarray, counted: np.ndarray, rounds: int = 100, false_alarms: float = 0.005) -> dict[str, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1) and how many documents have each.

    An abstention says nothing about the document. Bad documents start as those with a bad vote, and
    a rule is taken to be better than chance and to vote bad on false_alarms of the good documents
    at most (what it is written for), else the kinds of junk that are common pass as a trait of good
    text. Returns the share of good documents, table[class, rule]
    = probability of a bad vote given a vote, and the posterior probability of good per pattern.
    """
    if not len(patterns):
        return {"prior": np.array(0.5), "table": np.full((2, patterns.shape[1]), 0.5), "posterior": np.zeros(0)}
    bad, ok = (patterns < 0).astype(float), (patterns > 0).astype(float)
    good = np.where(bad.any(axis=1), 0.1, 0.95)
    for _ in range(rounds):
        weights = np.stack([counted * (1 - good), counted * good])
        said_bad, said_ok = weights @ bad + [[0.3], [0.01]], weights @ ok + [[0.7], [0.99]]
        table = said_bad / (said_bad + said_ok)
        table[1] = np.minimum(table[1], np.minimum(table[0], false_alarms))
        prior = (weights[1].sum() + 1) / (counted.sum() + 2)
        log = np.log(table) @ bad.T + np.log1p(-table) @ ok.T + np.log([[1 - prior], [prior]])
        new = 1 / (1 + np.exp(np.clip(log[0] - log[1], -700, 700)))
        done, good = np.abs(new - good).max() < 1e-9, new
        if done:
            break
    return {"prior": np.array(prior), "table": table, "posterior": good}


def posteriors(voted: DataFrame, names: list[str]) -> DataFrame:
    """names, p_good: the posterior of each vote pattern that occurs, from the counts of all of them."""
    # at most 3 ** len(names) rows, however large voted is
    seen = voted.groupBy(*names).count().orderBy(*names).toPandas()
    fitted = estimate(seen[names].to_numpy(int), seen["count"].to_numpy(float))
    rows = [(*map(int, r), float(p)) for r, p in zip(seen[names].itertuples(index=False), fitted["posterior"])]
    return voted.sparkSession.createDataFrame(rows, ", ".join(f"{n} int" for n in names) + ", p_good double")


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: id, COUNTS, votes (vote_<rule>), p_good, kept (p_good >= least).

    Repeated rows and ids give a row each; where no rule votes the prior decides. An empty table gives
    no rows.
    """
    rules = votes()
    voted = checkpointed(measured(docs, text_col, [id_col]).select("*", *[v.cast("int").alias(f"vote_{n}") for n, v in rules.items()]))
    names = [f"vote_{n}" for n in rules]
    judged = voted.join(F.broadcast(posteriors(voted, names)), names)
    return judged.select(id_col, *COUNTS, *names, "p_good", (F.col("p_good") >= least).alias("kept"))


def keep(docs: DataFrame, text_col: str = "text", least: float = 0.5) -> DataFrame:
    """The rows of docs whose base rules pass and whose p_good >= least, all columns.

    Texts are measured twice, once for the fit and once for the verdict, so that they are never
    shuffled and neither ids nor texts need to be unique. Columns of docs may have any names.
    """
    rules = votes()
    names = [f"vote_{n}" for n in rules]
    table = posteriors(measured(docs, text_col, []).select(*[v.cast("int").alias(f"vote_{n}") for n, v in rules.items()]), names)
    mark = "_kw_"
    while any(c.lower().startswith(mark) for c in docs.columns):
        mark = "_" + mark
    at = measured(docs, text_col, prefix=mark)
    at = at.withColumns({mark + f"vote_{n}": v.cast("int") for n, v in votes(mark).items()})
    good = table.where(F.col("p_good") >= least).select(*[F.col(n).alias(f"{mark}of_{n}") for n in names])
    same = [F.col(mark + n) == F.col(f"{mark}of_{n}") for n in names]
    return at.where(~base_failed(mark)).join(F.broadcast(good), same, "left_semi").select(*docs.columns)


def base_failed(prefix: str = "") -> Column:
    """Too short, or over half of the words in repeated windows."""
    words, repeated = F.col(prefix + "n_words"), F.col(prefix + "n_repeat_words")
    return (words < 50) | (100 * repeated > 50 * words)

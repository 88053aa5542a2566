"""URL filters: pattern rules indexed by their rarest literal token.

A rule is a regular expression over ``host + path`` with the literal tokens that every match must
contain as whole tokens. Counting those tokens over the URLs (a count for each token of the rule
list, nothing else) tells the rarest one of each rule, which becomes its only index entry. A URL's
tokens fetch the candidate rules; only those, and the few rules without a usable token, run their
regular expression, which is compiled the first time it is a candidate. The work for a URL, counting
included, grows with its tokens, not with the rule list.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyweave.llm.common import checkpointed

#: Rules that are broadcast at once; a longer list is worked off in as many passes over the URLs.
PASS_RULES = 200_000
_TOKEN = re.compile(r"[A-Za-z0-9]+")
_LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
_PARTS = re.compile(r"([^/?#]*)([^?#]*)")


@dataclass(frozen=True)
class Rule:
    """Of the rules that fit a URL, the highest tier wins, then the longest label, then the label that sorts last."""

    label: str
    action: str
    regex: str
    tokens: tuple[str, ...]
    tier: int = 0


def host_rule(host: str, path: str, action: str, tier: int = 1) -> Rule:
    """Fits the host and its subdomains where the URL's path starts with path."""
    regex = rf"^(?:[^/]*\.)?{re.escape(host)}" + (re.escape(path) if path else "(?=/|$)")
    inside = [m.group() for m in _TOKEN.finditer(path) if m.start() > 0 and m.end() < len(path)]
    return Rule(host + path, action, regex, tuple(_TOKEN.findall(host) + inside), tier)


def glob_rule(glob: str, action: str, tier: int = 0) -> Rule:
    """``*`` fits any run of characters, ``^`` an end or any character but a letter or digit, the rest itself; the pattern may stand anywhere in host + path."""
    regex = "".join(".*" if c == "*" else "(?:^|$|[^A-Za-z0-9])" if c == "^" else re.escape(c) for c in glob)
    tokens = [m.group() for m in _TOKEN.finditer(glob) if m.start() > 0 and m.end() < len(glob) and glob[m.start() - 1] != "*" and glob[m.end()] != "*"]
    return Rule(glob, action, regex, tuple(tokens), tier)


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path; both empty for a null or one without ``://``."""
    if url is None or (at := url.find("://")) < 0:
        return "", ""
    host, path = _PARTS.match(url, at + 3).groups()
    return host.translate(_LOWER), path


class RuleIndex:
    """Rules by their rarest token; entries are plain values, (tier, length of the label, label, action, regex)."""

    def __init__(self, rules: Sequence[Rule], seen: dict[str, int]) -> None:
        self.by_token: dict[str, list[tuple]] = {}
        self.always: list[tuple] = []
        for rule in rules:
            entry = (rule.tier, len(rule.label), rule.label, rule.action, rule.regex)
            if rule.tokens:
                rarest = min(rule.tokens, key=lambda t: (seen.get(t, 0), -len(t), t))
                self.by_token.setdefault(rarest, []).append(entry)
            else:
                self.always.append(entry)


class Matcher:
    """Looks URLs up in an index; a rule's pattern is compiled when it first becomes a candidate."""

    def __init__(self, by_token: dict[str, list[tuple]], always: list[tuple]) -> None:
        self.by_token, self.always, self.compiled = by_token, always, {}

    def _fits(self, entry: tuple, host_path: str) -> bool:
        pattern = self.compiled.get(entry[4])
        if pattern is None:
            pattern = self.compiled[entry[4]] = re.compile(entry[4], re.S)
        return pattern.search(host_path) is not None

    def best(self, host_path: str) -> tuple | None:
        """The fitting entry of the highest tier, longest label, last label."""
        found = [e for e in self.always if self._fits(e, host_path)]
        for token in {*_TOKEN.findall(host_path)}:
            found += [e for e in self.by_token.get(token, ()) if self._fits(e, host_path)]
        return max(found, key=lambda e: e[:3], default=None)


def token_counts(urls: DataFrame, rules: Sequence[Rule], url_col: str = "url") -> dict[str, int]:
    """How many URLs hold each token of the rules, without case; at most one number for each token reaches the driver."""
    tokens = {t for r in rules for t in r.tokens}
    known = {t.translate(_LOWER) for t in tokens}
    if not known:
        return {}
    shared = urls.sparkSession.sparkContext.broadcast(known)  # tokens of at most PASS_RULES rules

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, seen = shared.value, Counter()
        for batch in batches:
            for url in batch.column(0).to_pylist():
                if url is not None:
                    seen.update(wanted.intersection(_TOKEN.findall(url.translate(_LOWER))))
        yield pa.record_batch([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["token", "n"])

    counted = urls.select(F.col(url_col).cast("string").alias("url")).mapInArrow(run, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    low = {r["token"]: r["n"] for r in counted.collect()}
    return {t: low.get(t.translate(_LOWER), 0) for t in tokens}


_JUDGED = "id long, host string, path string, rule string, verdict string, pattern string, tier int"


def judge(pages: DataFrame, rules: Sequence[Rule], id_col: str = "page_id", url_col: str = "url", default: str = "allow", named_tier: int = 1, pass_rules: int = PASS_RULES) -> DataFrame:
    """One row per page: its id, host, path, rule, verdict, pattern.

    rule is the label of the best fitting rule of named_tier or above, else null; pattern that of
    the best fitting one of any tier; verdict is the action of the best one, else default. Null ids
    and repeated rows pass through as they are, and an empty table gives no rows. Lists of more than
    pass_rules rules take one pass over the URLs for each so many; the result is the same.
    """
    out = pa.schema([("id", pa.int64()), ("host", pa.string()), ("path", pa.string()), ("rule", pa.string()), ("verdict", pa.string()), ("pattern", pa.string()), ("tier", pa.int32())])

    def one_pass(shared) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            match = Matcher(*shared.value)
            for batch in batches:
                columns: list[list] = [[], [], [], [], [], []]
                # of the passes so far: the best entry's label, action and tier
                for url, pattern, action, tier in zip(*(batch.column(n).to_pylist() for n in ("url", "pattern", "verdict", "tier"))):
                    host, path = split_url(url)
                    best = match.best(host + path)
                    if best is not None and (tier is None or best[:3] > (tier, len(pattern), pattern)):
                        tier, pattern, action = best[0], best[2], best[3]
                    rule = pattern if tier is not None and tier >= named_tier else None
                    for column, value in zip(columns, (host, path, rule, action, pattern, tier)):
                        column.append(value)
                yield pa.record_batch([batch.column("id"), *[pa.array(x, t) for x, t in zip(columns, out.types[1:])]], schema=out)

        return run

    context = pages.sparkSession.sparkContext
    named = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"))
    judged, parts = None, [rules[i : i + pass_rules] for i in range(0, len(rules), pass_rules)] or [[]]
    for part in parts:
        index = RuleIndex(part, token_counts(pages, part, url_col))
        shared = context.broadcast((index.by_token, index.always))
        before = named.select("id", "url", F.lit(None).cast("string").alias("pattern"), F.lit(default).alias("verdict"), F.lit(None).cast("int").alias("tier")) if judged is None else judged
        # host + path is all that the next pass needs of the URL
        judged = before.mapInArrow(one_pass(shared), _JUDGED)
        if len(parts) > 1:
            judged = checkpointed(judged.withColumn("url", F.concat(F.lit("://"), "host", "path")))
    return judged.select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "pattern")

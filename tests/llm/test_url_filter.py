import random
import re

from pyspark.sql import functions as F

from keyweave.llm import url_filter as uf
from keyweave.llm.queries import url_rules

URLS = [
    None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/7?x#y", "https://example.com/en/8", "http://notexample.com/en/", "http://example.com?en/", "http://a.b.net/de/8/x",
    "http://example.net/de/81", "http://x.org/es/", "http://org/es/", "http://org.uk/es/", "http://example.com.evil/en/", "ftp://cheap-pills.example.io/", "http://a.io/casino/b", "http://a.io/casinos",
    "http://user:pw@example.com:80/en/7", "a://b://c.com/en/1", "http://EXAMPLE.com/EN/7", "http://ü.net/de/é", "http://x.net/de\n/8",
]


def plain(url, rules):
    if url is None or "://" not in url:
        host = path = ""
    else:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest).group()
        path = re.match("[^?#]*", rest[len(host) :]).group()
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in rules if re.search(r.regex, host + path, re.S)]
    best = max(fits, key=lambda r: (r.tier, len(r.label), r.label), default=None)
    return host, path, best.label if best and best.tier else None, best.action if best else "allow"


def test_against_all_rules(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string").withColumn("host", F.lit(1))
    rules = url_rules()
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.judge(pages, rules).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(URLS)}
    assert got[4] == ("www.example.com", "/en/7", "example.com/en/7", "allow") and got[6][2:] == ("com/en/", "block")


def test_many_random_rules(spark):
    rng = random.Random(4)
    parts = ["a", "bb", "ccc", "com", "net", "en", "7", "x1"]
    rules = [uf.host_rule(".".join(rng.choices(parts, k=rng.randint(1, 3))), rng.choice(["", "/", "/en", "/en/7", "/a/bb/"]), rng.choice(["allow", "block"])) for _ in range(80)]
    rules += [uf.glob_rule(g, "block") for g in ("/en/7", "^bb^", "a*c", "*", "x1.")]
    rules = list({r.label: r for r in rules}.values())
    urls = ["http://" + ".".join(rng.choices(parts, k=rng.randint(1, 4))) + "/" + "/".join(rng.choices(parts, k=rng.randint(0, 3))) for _ in range(300)]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string").repartition(4)
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in uf.judge(pages, rules).collect()}
    assert got == {i: plain(u, rules) for i, u in enumerate(urls)}


def test_only_candidates_are_tried():
    rules = [uf.host_rule(f"site{i}.com", "/en/", "block") for i in range(1000)]
    index = uf.RuleIndex(rules, {"com": 10_000, "en": 500} | {f"example{i}": 500 for i in range(97)})
    assert not index.always and max(map(len, index.by_token.values())) == 1


def test_a_long_list(spark):
    """50,000 rules cost a URL no more than a few: only its own candidates are compiled and tried."""
    rules = [uf.host_rule(f"site{i}.example{i % 97}.com", "/en/", "block") for i in range(50_000)] + url_rules()
    index = uf.RuleIndex(rules, {"com": 10_000, "en": 500} | {f"example{i}": 500 for i in range(97)})
    match = uf.Matcher(index.by_token, index.always)
    assert match.best("www.site7.example7.com/en/1")[2] == "site7.example7.com/en/" and len(match.compiled) <= 2 + len(url_rules())
    urls = [f"http://site{i}.example{i % 89}.com/en/{i}" for i in range(2_000)] + URLS
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id bigint, url string")
    got = {r["page_id"]: r["rule"] for r in uf.judge(pages, rules).collect()}
    known = {r.label for r in rules}
    want = {i: max((x for x in (f"site{i}.example{i % 89}.com/en/", "com/en/") if x in known), key=len) for i in range(2_000)}
    assert {i: got[i] for i in range(2_000)} == want


def test_more_passes_change_nothing(spark):
    pages = spark.createDataFrame(list(enumerate(URLS)), "page_id bigint, url string")
    one, many = (sorted(map(str, uf.judge(pages, url_rules(), pass_rules=n).collect())) for n in (100, 3))
    assert one == many


def test_odd_rows(spark):
    pages = spark.createDataFrame([(None, None), (1, "http://a.com/en/"), (1, "http://a.com/en/")], "page_id bigint, url string")
    assert sorted(str(tuple(r)) for r in uf.judge(pages, url_rules()).select("page_id", "rule").collect()) == ["(1, 'com/en/')", "(1, 'com/en/')", "(None, None)"]
    assert uf.judge(pages.limit(0), url_rules()).count() == 0 and uf.judge(pages, []).count() == 3

import textwrap
from pathlib import Path

import duckdb
import pytest

from keyweave.llm import license_scan as ls
from keyweave.llm.license_texts import KNOWN, WHOLE

MIT = KNOWN["MIT#titled"]


def found(spark, text):
    df = spark.createDataFrame([(1, text)], "doc_id bigint, text string")
    row = ls.scan(df).first()
    return row["license"], row["notices"]


WHOLE_TEXTS = [
    (MIT, "MIT"),
    (MIT.upper().replace(",", " ,") + "\n\n", "MIT"),
    (MIT.replace("License\n", "Licence\n\nCopyright (c) 2020 Someone, All rights reserved\n(C) 2021 other\n"), "MIT"),
    ("# " + MIT.replace("\n", "\n# "), "MIT"),
    (MIT + "\nextra words", None),
    (KNOWN["BSD-3-Clause"], "BSD-3-Clause"),
    (KNOWN["Apache-2.0#header"].replace("http:", "https:"), "Apache-2.0"),
    ("", None),
    (None, None),
]


def test_whole_texts(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(WHOLE_TEXTS)], "doc_id bigint, text string")
    assert [r["license"] for r in ls.scan(df).orderBy("doc_id").collect()] == [x for _, x in WHOLE_TEXTS]


def test_notices(spark):
    text = "Released under the MIT licence.\nSome prose.\n * Licensed under the Apache License, Version 2.0\nreleased under  the MIT License!\nLicensed under the MIT Licence by us"
    assert found(spark, text) == (None, ["Apache-2.0", "MIT"])
    assert found(spark, "Released under the MIT License.") == ("MIT", ["MIT"])


def test_every_known_text_is_found(spark):
    df = spark.createDataFrame(list(KNOWN.items()), "name string, text string")
    got = {r["name"]: r["license"] for r in ls.scan(df, id_col="name").collect()}
    assert got == {n: n.split("#")[0] for n in KNOWN}


def test_own_list_and_odd_rows(spark, docs, empty):
    assert ls.scan(docs).count() == docs.count() and ls.scan(empty).count() == 0
    df = spark.createDataFrame([(None, "Own terms.", 1), (1, "own  TERMS", 2), (1, "own  TERMS", 3)], "doc_id bigint, text string, license int")
    assert [r["license"] for r in ls.scan(df, {"X": "Own terms", "Y": "own terms"}).collect()] == ["X"] * 3
    assert [r["license"] for r in ls.scan(df, {}).collect()] == [None] * 3


@pytest.mark.parametrize("literal", [ls.LITERAL, 3])
def test_long_lists(spark, literal):
    """Lists of any length, shipped with the plan or joined, give the same."""
    known = {f"L{i}": f"Own terms number {i}" for i in range(3_000)}
    texts = ["own terms number 7", "x\nOwn terms, number 2999\nown terms number 4", None, "own terms number 7", "Copyright notice"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r["doc_id"]: (r["license"], r["notices"]) for r in ls.scan(df, known, literal=literal).collect()}
    assert got == {0: ("L7", ["L7"]), 1: (None, ["L2999", "L4"]), 2: (None, []), 3: ("L7", ["L7"]), 4: (None, [])}


def test_headers_inside_documents(spark):
    """A paragraph that one licence only has, wrapped and marked as a comment, in a longer document."""
    for name, want in (("Apache-2.0#header", "Apache-2.0"), ("GPL-3.0#header", "GPL-3.0"), ("MIT", "MIT")):
        text = "#!/bin/sh\n#\n# A tool.\n#\n" + wrapped(KNOWN[name], 60, "# ") + "\n#\n\nset -e\n"
        assert found(spark, text) == (None, [want])


def test_many_blank_lines(spark):
    assert found(spark, "\n" * 300_000 + " " * 100_000 + "\t \n" * 100_000 + MIT)[0] == "MIT"


def test_against_sql(spark, docs):
    texts = [r["text"] for r in docs.collect()] + [*KNOWN.values()] + [wrapped(t, w, m) + "\n\nmore" for t in KNOWN.values() for w, m in ((30, "# "), (70, ""))]
    texts += ["Copyright (c) 2020 x\ncopyright notice\n(c) you must\n(c)\nyou must\n© y\ncopyright the\nlibrary\nCopyright: z", "copyright-free", "copyright", "copyright,"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    con = duckdb.connect()
    con.register("documents", df.toPandas())
    want = {r[0]: r[1:4] for r in con.execute(ls.scan_sql(KNOWN, WHOLE)).fetchall()}
    assert {r["doc_id"]: (r["text_digest"], r["license"], ",".join(r["notices"])) for r in ls.scan(df).collect()} == want


def test_plan_has_no_python(docs):
    plan = ls.scan(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def wrapped(text, width, mark=""):
    lines = [textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False) or [""] for p in text.split("\n")]
    return "\n".join(mark + x for p in lines for x in p)


@pytest.mark.parametrize("mark", ["", " * "])
def test_every_known_text_is_found_at_any_width(spark, mark):
    # at some width each word of a text begins a line, also "copyright"
    rows = [(f"{name}@{w}", wrapped(t, w, mark)) for name, text in KNOWN.items() for t in (text, text.upper()) for w in (1, 20, 40, *range(60, 101))]
    got = ls.scan(spark.createDataFrame(rows, "name string, text string"), id_col="name").collect()
    assert [r["name"] for r in got if r["license"] != r["name"].split("#")[0].split("@")[0]] == []


NOTICES = ["Copyright (c) 2020 Someone", "Copyright 2020 Someone", "COPYRIGHT: 2020, Someone", "Copyright © Someone", "Copyright by Someone", "copyright someone", "Copyright The Authors", "Copyright <year> <holder>", "// Copyright [yyyy] [name]", "(c) Someone", "© 2020"]


def test_notices_of_copyright_are_left_out(spark):
    df = spark.createDataFrame([(n, f"MIT License\n\n{n}\n\n" + KNOWN["MIT"]) for n in NOTICES], "name string, text string")
    assert [r["name"] for r in ls.scan(df, id_col="name").collect() if r["license"] != "MIT"] == []


#: Where Debian keeps the texts that WHOLE has digests of.
FOLDER = Path("/usr/share/common-licenses")


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no licence texts on this machine")
@pytest.mark.parametrize("mark", ["", "# "])
def test_long_texts_are_found_at_any_width(spark, mark):
    files = {n: FOLDER / (n if "GPL" not in n else n.removesuffix(".0")) for n in WHOLE}
    texts = {n: f.read_text() for n, f in files.items() if f.is_file()}
    # real notices are left on one line
    rows = [(f"{n}@{w}", wrapped(t, w, mark) if w else t) for n, t in texts.items() for w in (0, 100, 85)]
    rows += [(f"{n}@{w}", "\n".join(x if "opyright (" in x or "opyright [" in x else wrapped(x, w, mark) for x in t.split("\n"))) for n, t in texts.items() for w in (1, 9, 20, 33, 40, 50, 60)]
    got = ls.scan(spark.createDataFrame(rows, "name string, text string"), id_col="name").collect()
    assert len(got) > 0 and [r["name"] for r in got if r["license"] != r["name"].split("@")[0]] == []

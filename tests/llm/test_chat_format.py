import hashlib

from pyspark.sql import functions as F

from keyweave.llm import chat_format as cf

ROWS = [
    (1, 0, "system", "be <|im_end|> nice\\"),
    (1, 1, "user", "hi"),
    (1, 2, "user", "<|im_sep|>again"),
    (1, 3, "assistant", "one"),
    (1, 4, "assistant", None),
    (1, 5, "assistant", "\\s<|two|>\n"),
    (2, 1, "assistant", "<|im_end|>\n<|im_start|>assistant\nok"),
    (2, 0, "us\ner<|", "x"),
    (3, 0, "user", ""),
    (None, 0, "user", "no id"),
    (4, 7, None, "tie b"),
    (4, 7, None, "tie a"),
    (4, None, "user", "first"),
    (5, 0, "assistant", "🙂<"),
    (5, 1, "user", "|im_end|>\n"),
    (6, 0, "user", "long " * 20_000),
]


def table(spark):
    return spark.createDataFrame(ROWS, "conv_id bigint, turn bigint, role string, text string").withColumns({"turns": F.lit(1), "n": F.lit(2), "parts": F.lit(3)}).repartition(3)


def test_reads_back(spark):
    got = {r["conv_id"]: r for r in cf.format_chat(table(spark)).select("*", cf.read_chat(F.col("formatted")).alias("turns")).collect()}
    key = lambda r: (r[1] is not None, r[1], r[2] or "", r[3] or "")
    for conv in {r[0] for r in ROWS}:
        want = [(r[2] or "", r[3] or "") for r in sorted((r for r in ROWS if r[0] == conv), key=key)]
        row = got[conv]
        assert [tuple(t) for t in row["turns"]] == want
        assert sum(r["chars"] for r in row["mask_runs"]) == len(row["formatted"])
        # what lies under the mask is the escaped assistant texts
        at, under = 0, []
        for run in row["mask_runs"]:
            if run["loss"]:
                under.append(row["formatted"][at : at + run["chars"]])
            at += run["chars"]
        assert [u.replace("\\p", "|").replace("\\s", "\\") for u in under] == [t for r, t in want if r == "assistant"]
    assert got[1]["formatted"].count(cf.START) == 3  # adjacent turns of a role share a block


def test_digests(spark):
    got = {r["conv_id"]: r for r in cf.digests(cf.format_chat(table(spark))).collect()}
    loss = "one" + "\\s<|two|>\n"
    assert (got[1]["n_turns"], got[1]["loss_chars"], got[1]["loss_sha256"]) == (6, len(loss), hashlib.sha256(loss.encode()).hexdigest())
    turns = "user\n\n"
    assert (got[3]["n_turns"], got[3]["turns_sha256"], got[3]["loss_chars"]) == (1, hashlib.sha256(turns.encode()).hexdigest(), 0)


def test_loss_text_is_read_through_the_mask(spark):
    formatted = cf.format_chat(table(spark))
    # a mask that is moved by one character reads another text
    moved = formatted.withColumn("mask_runs", F.transform("mask_runs", lambda r, i: F.struct((r["chars"] + F.when(i == 0, 1).otherwise(0)).cast("int").alias("chars"), r["loss"].alias("loss"))))
    right, wrong = ({r["conv_id"]: r["loss_sha256"] for r in cf.digests(x).collect()} for x in (formatted, moved))
    assert right[1] != wrong[1] and right[3] == wrong[3]


def test_long_conversation(spark):
    """Thousands of turns in a row: each assistant text once, in order."""
    rows = spark.range(6_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é🙂<|"), F.col("id").cast("string")).alias("text"))
    row = cf.digests(cf.format_chat(rows)).first()
    loss = "".join(f"é🙂<|{i}" for i in range(6_000) if i % 3)
    assert (row["n_turns"], row["loss_chars"], row["loss_sha256"]) == (6_000, len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_empty(spark):
    assert cf.digests(cf.format_chat(table(spark).limit(0))).count() == 0


def test_plan_has_no_python(spark):
    plan = cf.digests(cf.format_chat(table(spark)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

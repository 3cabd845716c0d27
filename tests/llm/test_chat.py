import hashlib

from pyspark.sql import functions as F

from aerolith.llm import chat, queries

ROWS = [
    (1, 1, "user", "hello"), (1, 2, "assistant", "</s>[INST] \\ [/INST] \\</s>"), (1, 3, "user", None), (1, 4, "assistant", "é漢🙂"),
    (2, 1, "system", "only <s> a system <|x|> turn"), (3, 1, "assistant", "a"), (3, 1, "assistant", "a"), (3, 2, "user", "b"),
    (None, 1, "user", "nobody"), (None, None, None, "null turn"), (4, 1, "we[INST]rd</s>", "x"), (4, 2, "assistant", ""), (5, 1, "assistant", "\n\\n [/INST"),
]


def expected(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted([((t is not None, t or 0), r or "", x or "") for c, t, r, x in rows if c == conv])
        loss = "".join(x for _, r, x in turns if r == "assistant")
        shown = "".join(f"{r}\n{x}\n" for _, r, x in turns)
        out[conv] = (len(turns), hashlib.sha256(shown.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_read_back(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "conv_id long, turn long, role string, text string, example int, formatted string")
    found = {r.conv_id: tuple(r)[1:5] for r in chat.digests(chat.expand(df)).collect()}
    assert found == expected(ROWS)


def test_examples(spark):
    df = spark.createDataFrame(ROWS, "conv_id long, turn long, role string, text string")
    rows = [r for r in chat.expand(df).collect() if r.conv_id == 1]
    assert [r.example for r in sorted(rows, key=lambda r: r.example)] == [1, 2]
    first, second = sorted(rows, key=lambda r: r.example)
    assert second.formatted.startswith(first.formatted)
    assert second.formatted[second.loss_start : second.loss_start + second.loss_chars] == "é漢🙂"
    for r in chat.expand(df).collect():
        assert r.formatted.count("[INST]") == r.formatted.count("[/INST]") == r.formatted.count("</s>")
        assert (r.loss_start is None) == (r.target_turn is None and r.loss_chars == 0)


def test_escape_round_trip(spark):
    texts = ["", "\\", "\\\\</s>", "</s></s>", "<s[INST]>", "[[INST]]", "<\\s>", "a\nb\\\nc", "<|x|>", "<unk><pad>"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", chat.escaped(F.col("t")))
    for r in df.withColumn("back", chat.unescaped(F.col("e"))).collect():
        assert r.back == r.t and not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]"))


def test_empty(spark):
    assert chat.digests(chat.expand(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_plan_is_native(spark, sf_dir):
    plan = queries.QUERIES["op7_chat_format"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(k in plan for k in ("Python", "Arrow", "Pandas"))


def test_against_sql(spark, sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf_dir}/conversations.parquet'")
    want = sorted(map(tuple, con.execute(chat.ORACLE).fetchall()))
    assert sorted(map(tuple, queries.QUERIES["op7_chat_format"](spark, sf_dir).collect())) == want

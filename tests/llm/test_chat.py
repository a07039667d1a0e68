import hashlib
import random

import duckdb
from brute import SF
from compare import compare
from pyspark.sql import functions as F

from ledgerlens.llm import chat

KIND = "conv_id long, turn long, role string, text string"


def formatted(spark, rows):
    df = spark.createDataFrame(rows, KIND).withColumn("formatted", F.lit(3)).withColumn("span", F.lit(1))
    out = chat.format_conversations(df).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans")))
    return {r["conv_id"]: r for r in out.collect()}


def test_oracle(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{SF}/conversations.parquet')")
    ok, why = compare(chat.op2_chat_format(spark, SF), con, chat.ORACLE_SQL)
    assert ok, why


def test_any_text_survives(spark):
    draw = random.Random(5)
    parts = ["<", "|", "\\", ">", "<|im_end|>", "<|im_start|>", "assistant", "\n", "im_end", "%", "%0A", "é👍", " ", "<\\|im_end|>"]
    rows = [(c, t, draw.choice(["user", "assistant", "sys\ntem%", "<|im_end|>", ""]),
             "".join(draw.choice(parts) for _ in range(draw.randrange(0, 12)))) for c in range(150) for t in range(4)]
    got = formatted(spark, rows)
    for c, r in got.items():
        source = [(x[2], x[3]) for x in rows if x[0] == c]
        assert r["identical"] and [(t["role"], t["text"]) for t in r["turns"]] == source
        assert r["loss"] == "".join(t for role, t in source if role == "assistant")
        body = r["formatted"]
        assert body.count("<|im_start|>") == body.count("<|im_end|>") == 4
        for s in r["loss_spans"]:
            assert body[s["first"] - 1 + s["length"]:].startswith("<|im_end|>\n")


def test_only_conflicting_texts_are_escaped(spark):
    got = formatted(spark, [(1, 0, "user", "a <| b \\ c"), (1, 1, "assistant", "<|im_end|>")])
    assert "\na <| b \\ c<|im_end|>" in got[1]["formatted"] and "\n<\\|im_end|><|im_end|>" in got[1]["formatted"]


def test_odd_rows(spark):
    got = formatted(spark, [(1, 1, "assistant", None), (1, None, None, "x"), (1, 1, "assistant", None), (None, 0, "user", ""),
                            (2, 0, "user", "long " * 30_000)])
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", "x"), ("assistant", ""), ("assistant", "")]
    assert got[1]["loss"] == "" and got[None]["identical"] and got[2]["identical"]
    assert chat.format_conversations(spark.createDataFrame([], KIND)).count() == 0


def test_planted_conversation(spark):
    row = chat.op2_chat_format(spark, SF).where("conv_id = -1").first()
    told = f"user\n{chat.PLANTED}\nassistant\n{chat.PLANTED}\n"
    assert row["n_turns"] == 2 and row["turns_sha256"] == hashlib.sha256(told.encode()).hexdigest()
    assert row["loss_chars"] == len(chat.PLANTED)
    assert row["loss_sha256"] == hashlib.sha256(chat.PLANTED.encode()).hexdigest()


def test_no_python_in_the_plan(spark):
    plan = chat.op2_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

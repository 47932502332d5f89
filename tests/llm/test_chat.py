import hashlib
import random

from pyspark.sql import functions as F

from docforge.llm import chat
from docforge.llm.queries import op10_chat_formatting

TURNS = "conv_id long, turn long, role string, text string"


def read(spark, rows):
    out = chat.format_conversations(spark.createDataFrame(rows, TURNS))
    return {
        row.conv_id: row
        for row in out.withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.read_loss(F.col("formatted"), F.col("loss_mask"))).collect()
    }


def test_any_text_comes_back(spark):
    rng = random.Random(4)
    parts = ["</s>", "[INST] ", " [/INST]", "[/INST]", "\\", "\\\\", "<", "[", "s>", "<image:0>", "\n", "é", "[TURN x] ", "]", "[RESP] ", " ", "ok", "$1"]
    rows = [(conv, turn, rng.choice(["user", "assistant", "system", "tool]", "a\\b", "", None]), "".join(rng.choices(parts, k=rng.randint(0, 8)))) for conv in range(60) for turn in range(rng.randint(1, 6))]
    got = read(spark, rows)
    for conv in range(60):
        own = [(role or "", text) for c, _, role, text in rows if c == conv]
        assert [(t.role, t.text) for t in got[conv].turns] == own
        assert got[conv].loss == [text for role, text in own if role == "assistant"]


def test_typed_parts_become_placeholders(spark):
    parts = [("text", "see </s>", None, None), ("image", None, "i.png", None), ("audio", None, "a.wav", 7), ("text", "and", None, None), ("odd", None, "x", None)]
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], "conv_id long, turn long, role string, parts " + chat.PARTS)
    row = chat.format_conversations(rows, parts="parts").first()
    assert row.formatted == "[INST] see <\\/s><image:0><audio:1>and<file:2> [/INST][RESP]  </s>"
    assert [(a.turn, a.number, a.type, a.uri, a.tokens) for a in row.attachments] == [(0, 0, "image", "i.png", 256), (0, 1, "audio", "a.wav", 7), (0, 2, "odd", "x", 0)]
    assert row.expanded_tokens == 263


def test_order_ties_nulls_and_empty(spark):
    got = read(spark, [(1, 2, "user", "b"), (1, 1, "user", None), (1, 2, "assistant", "a"), (1, 2, "user", "b"), (None, None, None, "x")])
    assert [(t.role, t.text) for t in got[1].turns] == [("user", ""), ("assistant", "a"), ("user", "b"), ("user", "b")]
    assert [(t.role, t.text) for t in got[None].turns] == [("", "x")]
    assert read(spark, []) == {}


def test_long_roles_texts_and_many_turns(spark):
    roles = ["r" * 100_000, "\\]" * 50_000, "]" * 100_000, "assistant"]
    rows = [(1, turn, role, "x" * 1_000_000 if turn == 3 else f"t{turn} </s>") for turn, role in enumerate(roles)]
    rows += [(2, turn, ("user", "assistant")[turn % 2], f"[INST]{turn}") for turn in range(20_000)]
    got = read(spark, rows)
    assert [(t.role, t.text) for t in got[1].turns] == [(role, text) for _, _, role, text in rows[:4]]
    assert got[1].loss == ["x" * 1_000_000]
    assert [t.text for t in got[2].turns] == [text for _, _, _, text in rows[4:]]
    assert got[2].loss == [text for _, turn, _, text in rows[4:] if turn % 2]


def test_clashing_columns(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a", 1, "b", "c")], TURNS + ", at long, flat string, turns string")
    assert chat.format_conversations(rows).first().formatted == "[INST] a [/INST]"


def test_query_against_brute_force(spark, small):
    rows = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{small}/conversations.parquet").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    got = {row.conv_id: row for row in op10_chat_formatting(spark, small).collect()}
    assert len(got) == len({row[0] for row in rows})
    for conv, row in got.items():
        own = sorted((turn, role, text or "") for c, turn, role, text in rows if c == conv)
        spoken = "".join(f"{role}\n{text}\n" for _, role, text in own)
        loss = "".join(text for _, role, text in own if role == "assistant")
        assert row.n_turns == len(own) and row.turns_sha256 == hashlib.sha256(spoken.encode()).hexdigest()
        assert row.loss_chars == len(loss) and row.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_plan_has_no_python(spark, small):
    plan = op10_chat_formatting(spark, small)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and plan.count("Exchange hashpartitioning") == 1

"""Chat formatting (operator 6)."""

from pyspark.sql import functions as F

from codesieve.llm import chat

TRICKY = ["", None, "\\", "\\b", "\\l", "<", "<turn:user>\n", "</turn>\n", "<part>", "\\</turn>", "<turn:\\l<part>>", "a\nb",
          "é😀 </turn>", "x" * 5000, "<<turn:", "</turn", "\\\\bl<part"]


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .withColumn("formatted", F.lit("clash")).withColumn("pieces", F.lit(1))


def read(formatted):
    rows = formatted.select("conv_id", "formatted", "loss_spans", chat.read_turns("formatted").alias("turns"),
                            chat.read_loss_texts("formatted", "loss_spans").alias("loss")).collect()
    return {r.conv_id: r for r in rows}


def test_turns_and_loss_are_read_back(spark):
    roles = ["user", "assistant", "assistant", "system", "assistant", "<turn:x>\n", "a>\\b", None]
    rows = [(c, k, roles[(k * (c + 1)) % len(roles)], t) for c in range(4) for k, t in enumerate(TRICKY)]
    rows += [(9, 5, "user", "same turn b"), (9, 5, "user", "same turn a"), (9, 5, "user", "same turn a"),
             (9, None, "assistant", "null turn"), (None, 1, "assistant", "null id")]
    found = read(chat.format_conversations(conversation(spark, rows).repartition(5)))
    assert found.keys() == {r[0] for r in rows}
    for conv, r in found.items():
        turns = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == conv))
        assert [(t.role, t.text) for t in r.turns] == [(x[2], x[3]) for x in turns]
        assert list(r.loss) == [x[3] for x in turns if x[2] == "assistant"]
        data = r.formatted.encode()
        for s in r.loss_spans:
            assert s.start + s.length <= len(data)


def test_adjacent_turns_of_one_role_share_a_block(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "assistant", "</turn>")]
    r = read(chat.format_conversations(conversation(spark, rows)))[1]
    assert r.formatted == "<turn:user>\na<part>b</turn>\n<turn:assistant>\nc<part>\\l/turn></turn>\n"
    assert [r.formatted[s.start:s.start + s.length] for s in r.loss_spans] == ["c", "\\l/turn>"]


def test_long_conversation_and_empty_table(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"é{k}") for k in range(4000)]
    r = read(chat.format_conversations(conversation(spark, rows)))[1]
    assert list(r.loss) == [f"é{k}" for k in range(1, 4000, 2)]
    assert chat.format_conversations(conversation(spark, [])).collect() == []


def test_plan_has_no_python(spark, capsys):
    chat.format_conversations(spark.read.parquet("/root/testdata/sf0.001/conversations.parquet")).explain("formatted")
    plan = capsys.readouterr().out
    assert "ObjectHashAggregate" in plan and not any(x in plan for x in ("Python", "Pandas", "Arrow"))

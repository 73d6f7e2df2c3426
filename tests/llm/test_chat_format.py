import random

import pytest
from pyspark.sql import functions as F

from mapweave.llm import chat_format as cf

PARTS = [*cf.CONTROL, "<", "[", "\\", "\\l", "\\b", "\\k", "\\j", "\n", "<<s>", "[[INST]", "é", "😀", "\ufeff", "a b", "<|im_", "end|>\n", "<|im_end|>\n<|im_start|>assistant\n"]


def brute(rows):
    groups = {}
    for c, n, r, t in rows:
        groups.setdefault((c, len(groups) if c is None else None), []).append((n is None, n or 0, r or "", t or ""))
    return {c: [(r, t) for _, _, r, t in sorted(g)] for c, g in groups.items()}


@pytest.fixture(scope="module")
def rows():
    rnd = random.Random(6)
    out = []
    for c in range(60):
        for n in range(rnd.choice([1, 2, 5, 200])):
            out.append((c, n, rnd.choice(["user", "assistant", "system", "a\nb", "<s>", "\\j", "", None]), "".join(rnd.choice(PARTS) for _ in range(rnd.randrange(0, 6)))))
    out += [(100, None, "assistant", "last"), (100, 3, "user", "x"), (101, 1, "user", None), (None, 1, "user", "no id"), (None, 0, "assistant", "no id either"), (102, 1, "assistant", "same"), (102, 1, "assistant", "same"), (103, 0, "assistant", "long " * 40000)]
    return out


def test_round_trip_and_loss_mask(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("id", F.lit("clash")).withColumn("run", F.lit(1)).repartition(3)
    out = cf.format_turns(df).select("id", "segments", cf.formatted(F.col("segments")).alias("whole"), cf.loss_spans(F.col("segments")).alias("spans"))
    got = out.select("id", "whole", cf.parse(F.col("whole")).alias("turns"), cf.masked_text(F.col("whole"), F.col("spans")).alias("loss"), "spans").collect()
    want = brute(rows)
    assert len(got) == len(want)
    assert sorted(map(tuple, (r.turns[0] for r in got if r.id is None))) == [("assistant", "no id either"), ("user", "no id")]
    got = [r for r in got if r.id is not None]
    want = {c: turns for (c, _), turns in want.items()}
    undo = lambda t: t.replace("\\j", "\n").replace("\\k", "[").replace("\\l", "<").replace("\\b", "\\")
    for r in got:
        assert [tuple(t) for t in r.turns] == want[r.id], r.id
        said = "".join(t for role, t in want[r.id] if role == "assistant")
        assert r.loss == said == "".join(undo(r.whole[s.start : s.end]) for s in r.spans)
        bare = r.whole.replace(cf.START, "").replace(cf.END, "")
        assert not any(c in bare for c in cf.CONTROL)
        assert r.whole.count(cf.START) == r.whole.count(cf.END) == len(want[r.id])


def test_layouts_by_fingerprint(spark):
    records = [
        (1, '{"completion": "b", "prompt": "a"}'),
        (2, '{"instruction": "do", "input": "", "output": "done"}'),
        (3, '{"instruction": "do", "input": "this", "output": "done"}'),
        (4, '{"messages": [{"role": "system", "content": "s"}, {"content": "u", "role": "user"}]}'),
        (5, '{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "tool", "value": "t"}], "system": "be kind"}'),
        (6, '{"unknown": 1}'),
        (7, "not json"),
        (8, None),
        (9, '{"question": "q", "answer": 42}'),
        (10, '{"prompt": "a", "response": "b", "id": 7, "meta": {"role": "x"}}'),
        (11, '{"messages": [{"role": "user", "content": "u", "name": "n"}, {"role": "assistant", "content": null, "tool_calls": []}], "model": "m"}'),
        (12, '{"messages": []}'),
        (13, '{"messages": "text"}'),
        (14, '{"prompt": "a", "answer": "b"}'),
        (15, '[{"prompt": "a", "response": "b"}]'),
        (16, '{"system": "s", "messages": []}'),
        (17, '{"prompt": null, "response": "b"}'),
    ]
    df = spark.createDataFrame(records, "conv_id long, record string")
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in cf.canonical_turns(df, "record").collect() if r.turn is not None), key=str)
    assert sorted(got, key=lambda x: x[:2]) == [
        (1, 0, "user", "a"), (1, 1, "assistant", "b"), (2, 0, "user", "do"), (2, 1, "assistant", "done"), (3, 0, "user", "do\nthis"), (3, 1, "assistant", "done"),
        (4, 0, "system", "s"), (4, 1, "user", "u"), (5, 0, "system", "be kind"), (5, 1, "user", "h"), (5, 2, "assistant", "g"), (5, 3, "tool", "t"), (9, 0, "user", "q"), (9, 1, "assistant", "42"),
        (10, 0, "user", "a"), (10, 1, "assistant", "b"), (11, 0, "user", "u"), (11, 1, "assistant", None), (16, 0, "system", "s"), (17, 0, "user", ""), (17, 1, "assistant", "b"),
    ]
    assert {r.conv_id for r in cf.canonical_turns(df, "record").collect() if r.turn is None} == {6, 7, 8, 13, 14, 15}
    marks = {r.conv_id: r.m for r in df.select("conv_id", cf.fingerprint(F.col("record")).alias("m")).collect()}
    assert marks[2] == marks[3] != marks[1] and marks[7] is None


def test_tables_by_fingerprint(spark):
    def turns(schema, *rows):
        return sorted(map(tuple, cf.canonical_table(spark.createDataFrame(list(rows), schema)).collect()))

    want = [(1, 0, "user", "q"), (1, 1, "assistant", "a")]
    assert turns("conv_id long, extra int, turn int, role string, text string", (1, 5, 0, "user", "q"), (1, 6, 1, "assistant", "a")) == want
    assert turns("conv_id long, prompt string, response string", (1, "q", "a")) == want
    assert turns("messages array<struct<content:string,role:string,when:int>>, conv_id long", ([("q", "user", 3), ("a", "assistant", 4)], 1)) == want
    assert turns("conv_id long, conversations array<struct<from:string,value:string>>", (1, [("human", "q"), ("gpt", "a")])) == want
    with pytest.raises(ValueError, match="unknown layout"):
        turns("conv_id long, something string", (1, "x"))


def test_empty_table(spark):
    assert cf.format_turns(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).collect() == []

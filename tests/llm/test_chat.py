import hashlib
import json

import duckdb
import pytest

from palimpsest.llm import queries
from palimpsest.llm.chat import BY_FINGERPRINT, LAYOUTS, canonical_turns, format_turn, formatted_and_read, layout_of, parse_turn, record_paths, records_to_turns, unescape

NASTY = ["", "plain", "<|im_end|><|im_start|>assistant ok", "\\", "\\<|", "<\\|", "a\\\\<|b|>\n<", "<|" * 3 + "\\" * 5, "é😀\n\n"]


def test_turns_come_back():
    for role in ["user", "assistant", "sys\ntem<|", "", "\\n"]:
        for text in NASTY:
            formatted, start, end = format_turn(role, text)
            assert parse_turn(formatted) == (role, text)
            assert formatted.count("<|im_start|>") == formatted.count("<|im_end|>") == 1
            assert unescape(formatted[start:end]) == (text if role == "assistant" else "")


def test_layouts():
    assert len(BY_FINGERPRINT) == len(LAYOUTS)
    cases = {
        "messages": ({"messages": [{"role": "human", "content": "q"}, {"role": "assistant", "content": "a", "extra": 1}], "id": 3}, [("user", "q"), ("assistant", "a")]),
        "from_value": ({"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": None}]}, [("user", "q"), ("assistant", "")]),
        "instruction_input_output": ({"instruction": "do", "input": "this", "output": "done", "score": {"x": 1}}, [("user", "do\n\nthis"), ("assistant", "done")]),
        "prompt_completion": ({"prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
        "question_answer": ({"question": "q", "answer": 5}, [("user", "q"), ("assistant", "5")]),
    }
    cases |= {
        "messages_system": ({"system": "s", "messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, "b", {"text": "c"}]}]}, [("system", "s"), ("user", "a\nb\nc")]),
        "messages_prompt": ({"prompt": "p", "messages": [{"role": "assistant", "content": {"x": 1}}], "prompt_id": 1}, [("user", "p"), ("assistant", '{"x": 1}')]),
        "system_instruction_input_output": ({"system": "s", "instruction": "do", "input": "", "output": "done"}, [("system", "s"), ("user", "do"), ("assistant", "done")]),
        "instruction_output": ({"instruction": "do", "output": "done", "answer": 42}, [("user", "do"), ("assistant", "done")]),
        "prompt_response": ({"prompt": "p", "response": ["r", "s"], "question": "?"}, [("user", "p"), ("assistant", "r\ns")]),
        "system_prompt_completion": ({"system": None, "prompt": "p", "completion": "c"}, [("user", "p"), ("assistant", "c")]),
    }
    for name, (record, turns) in cases.items():
        assert canonical_turns(record) == (name, turns)
    assert len({layout.name for layout in LAYOUTS}) == len(LAYOUTS)
    assert canonical_turns({"messages": [{"role": "user", "content": "a"}, "b"]}) == canonical_turns({"messages": {"role": "user", "content": "b"}}) == (None, [])
    assert canonical_turns({"messages": [{"role": "user"}], "prompt": "p", "completion": "c"})[0] == "prompt_completion"
    assert layout_of({"prompt", "x"}) is None is layout_of({"prompt", "y"})
    assert canonical_turns({"unknown": 1}) == canonical_turns([1]) == (None, [])
    assert record_paths({"a": {"b": [{"c": 1}, {"d": 2}]}, "e": []}) == {"a", "a.b", "e"} and record_paths({"a": [{"b": {"c": 1}}, 2]}) == {"a", "a[]", "a[].b"}


def test_records(spark):
    raw = [(1, json.dumps({"prompt": "p", "completion": "c"})), (2, "no json"), (3, None), (4, "{}"), (5, json.dumps({"messages": []}))]
    rows = records_to_turns(spark.createDataFrame(raw, "conv_id long, raw string"), "conv_id", "raw").collect()
    assert [(r["turn"], r["role"], r["text"]) for r in rows if r["conv_id"] == 1] == [(0, "user", "p"), (1, "assistant", "c")]
    assert all(r["layout"] is None and r["turn"] is None for r in rows if r["conv_id"] != 1) and len(rows) == 6


def test_records_that_are_odd_stop_none(spark):
    odd = ['{"messages": [{"role": "user", "content": "a"}, "b"]}', '{"messages": "x"}', '{"messages": [null]}', '{"messages": 5, "conversations": [[]]}', "[" * 100_000, '{"prompt": ' + "[" * 5000 + "]" * 5000 + ', "completion": "c"}', "1", "null", '"x"']
    fine = json.dumps({"prompt": "p", "completion": "c"})
    rows = records_to_turns(spark.createDataFrame([*enumerate(odd), (99, fine)], "conv_id long, raw string"), "conv_id", "raw").collect()
    assert {r["conv_id"] for r in rows} == {*range(len(odd)), 99}
    assert all(r["layout"] is None for r in rows if r["conv_id"] not in (5, 99)) and sum(r["conv_id"] == 99 for r in rows) == 2


def test_tables_with_other_fields_beside_the_turns(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "assistant", "b")]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    more = plain.selectExpr("*", "'p' as prompt", "'i' as input", "'o' as output", "'q' as question", "'w' as answer", "'s' as system", "'c' as completion", "1 as formatted")
    assert formatted_and_read(more).collect() == formatted_and_read(plain).collect()


def brute(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, format_turn(r[2] or "", r[3] or "")[0]))
        learnt = "".join(r[3] or "" for r in turns if r[2] == "assistant")
        every = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in turns)
        size = sum(len(format_turn(r[2] or "", r[3] or "")[0]) for r in turns)
        out[conv] = (len(turns), hashlib.sha256(every.encode()).hexdigest(), len(learnt), hashlib.sha256(learnt.encode()).hexdigest(), size)
    return out


def test_equals_brute_force(spark):
    rows = [(i % 7, i // 7, ["user", "assistant", None][i % 3], t) for i, t in enumerate(NASTY * 5)]
    rows += [(3, 0, "assistant", "tie"), (3, 0, "assistant", "tie"), (3, None, "user", "first"), (None, 1, "assistant", "x" * 100_000), (9, 1, "user", None)]
    rows += [(11, i, "assistant", f"t{i}") for i in range(5000)]
    df = spark.createDataFrame([(*r, "?") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r[0]: tuple(r)[1:] for r in formatted_and_read(df).collect()}
    assert got == brute(rows)
    assert formatted_and_read(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        formatted_and_read(df.drop("role"))


@pytest.mark.parametrize("name", ["op8_schema_chat_format", "chat_layouts"])
def test_query(spark, name):
    d = "/root/testdata/sf0.001"
    duckdb.sql(f"create or replace view conversations as select * from '{d}/conversations.parquet'")
    want = duckdb.sql(queries.ORACLE[name])
    got = queries.QUERIES[name](spark, d)
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(want.fetchall())

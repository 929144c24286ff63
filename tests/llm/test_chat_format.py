import hashlib
import json
from collections import defaultdict

from pyspark.sql import functions as F

from abacusflow.llm import chat_format as C


def esc(x):
    return x.replace("\\", "\\\\").replace("###", "\\h").replace("</turn>", "\\t")


def test_read_back_equals_input(spark, folder):
    turns = defaultdict(list)
    for r in spark.read.parquet(f"{folder}/conversations.parquet").collect():
        turns[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    turns[-7] = [(k, r, "\\### Assistant: </turn> ok") for k, r in enumerate(("user", "assistant"))]
    found = {r["conv_id"]: r for r in C.op5_chat_format(spark, folder).collect()}
    assert found.keys() == turns.keys()
    for k, told in turns.items():
        told.sort(key=lambda x: (x[0] is not None, x))
        loss = "".join(t for _, r, t in told if r == "assistant")
        wanted = (
            k,
            len(told),
            hashlib.sha256("".join(f"{r}\n{t}\n" for _, r, t in told).encode()).hexdigest(),
            len(loss),
            hashlib.sha256(loss.encode()).hexdigest(),
            sum(len(f"### {esc(r).replace(':', chr(92) + 'c')}: {esc(t)} </turn>\n") for _, r, t in told),
        )
        assert tuple(found[k]) == wanted


def test_layouts_become_turns(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "q"}]},
        {"prompt": "p", "completion": "c"},
        {"completion": "c", "prompt": "p", "system": "s"},
        {"question": "p", "answer": "c"},
        {"instruction": "i", "output": "o"},
        {"instruction": "i", "input": "", "output": "o"},
        {"instruction": "i", "input": "x", "output": "o"},
        {"turns": []},
        {"other": 1},
    ]
    rows = [(k, json.dumps(r)) for k, r in enumerate(records)] + [(90, "not json"), (91, None)]
    found = {r["k"]: (r["layout"], None if r["turns"] is None else [tuple(t) for t in r["turns"]]) for r in C.canonical(spark.createDataFrame(rows, "k int, record string")).collect()}
    assert found[0] == ("messages", [("user", "q"), ("assistant", "")])
    assert found[1] == ("conversations", [("human", "q")])
    assert found[2] == ("prompt", [("user", "p"), ("assistant", "c")])
    assert found[3] == ("system_prompt", [("system", "s"), ("user", "p"), ("assistant", "c")])
    assert found[4] == ("question", [("user", "p"), ("assistant", "c")])
    assert found[5] == ("instruction", [("user", "i"), ("assistant", "o")])
    assert found[6][1] == [("user", "i"), ("assistant", "o")]
    assert found[7] == ("instruction_input", [("user", "i\nx"), ("assistant", "o")])
    assert all(found[k] == (None, None) for k in (9, 90, 91))


def test_fields_of_origin_are_no_part_of_a_fingerprint(spark):
    records = {
        '{"id": 7, "messages": [{"role": "user", "content": "q"}], "source": null}': ("messages", [("user", "q")]),
        '{"title": "t", "prompt": "p", "completion": "c", "url": "u"}': ("prompt", [("user", "p"), ("assistant", "c")]),
        '{"source": "s", "other": 1}': (None, None),
        '{"messages": [{"role": "user"}]}': (None, None),
        '{"id": {"x": 1}, "prompt": "p", "completion": "c"}': (None, None),
    }
    for r in C.canonical(spark.createDataFrame([(k,) for k in records], "record string")).collect():
        assert (r["layout"], r["turns"] and [tuple(t) for t in r["turns"]]) == records[r["record"]]


def test_rows_come_back_from_every_layout(spark):
    told = []
    for k in range(120):
        told += [(4 * k, 0, "user", f"q {k}" + "\nmore\nlines" * (k % 2)), (4 * k, 1, "assistant", f'a "{k}" \\'), (4 * k + 1, 0, "system", "s"), (4 * k + 1, 1, "user", "q"), (4 * k + 1, 2, "assistant", "a")]
        told += [(4 * k + 2, 0, "user", ""), (4 * k + 2, 1, "assistant", "x\n"), (4 * k + 3, 0, "user", "\nq"), (4 * k + 3, 1, "assistant", None)]
    rows = spark.createDataFrame(told, "conv_id long, turn long, role string, text string")
    found = C.canonical(C.from_rows(rows)).collect()
    assert {r["layout"] for r in found} == set(C.LAYOUTS)
    assert sorted((r["conv_id"], *t) for r in found for t in r["turns"]) == sorted((k, r, t or "") for k, _, r, t in told)


def test_control_strings_come_back(spark):
    texts = ["", "\\", "\\h", "\\\\h", "####", "######", "</turn></turn>", "a ### b </turn>\n### assistant: c </turn>\n", "\\c:", "😀###😀", "x" * 300_000 + "###"]
    rows = spark.createDataFrame([(k, [(f"r: {k}", t), ("assistant", t)]) for k, t in enumerate(texts)], "k int, turns array<struct<role string, text string>>")
    done = C.formatted(rows).select("k", C.turns_of(F.col("formatted")).alias("t"), C.loss_text(F.col("formatted"), F.col("loss_mask")).alias("loss"))
    for r in done.collect():
        assert [tuple(t) for t in r["t"]] == [(f"r: {r['k']}", texts[r["k"]]), ("assistant", texts[r["k"]])]
        assert r["loss"] == texts[r["k"]]


def test_odd_tables(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert C.formatted(C.canonical(C.from_rows(none))).count() == 0
    assert C.formatted(spark.createDataFrame([(1, [])], "k int, turns array<struct<role string, text string>>")).first()["formatted"] == ""


def test_a_long_text_is_read_back(spark):
    text = F.repeat(F.lit('a"\\\n{,'), 3_600_000)
    rows = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.lit("assistant").alias("role"), text.alias("text"))
    done = C.formatted(C.canonical(C.from_rows(rows))).select("layout", F.size("turns"), F.md5(C.loss_text(F.col("formatted"), F.col("loss_mask")).cast("binary")))
    layout, n, digest = done.first()
    assert layout in ("turns", "messages", "conversations")
    assert (n, digest) == (1, hashlib.md5(('a"\\\n{,' * 3_600_000).encode()).hexdigest())


def test_many_long_turns_keep_their_fingerprint(spark):
    turn = F.concat(F.lit('{"role":"user","text":"'), F.repeat(F.lit("b"), 10_000_000), F.lit('"},'))
    record = F.concat(F.lit('{"turns":['), F.repeat(turn, 14), F.lit('{"role":"","text":""}]}'))
    row = spark.range(1).select(record.alias("r")).select(C.fingerprint(F.col("r")), C.fingerprint(F.lit(C.LAYOUTS["turns"][0]))).first()
    assert row[0] == row[1] is not None


def test_every_layout_may_be_long(spark):
    b = F.repeat(F.lit("b"), 21_000_000)
    for head, tail, layout in (('{"prompt": "p\\"}", "completion": "', '"}', "prompt"), ('{"messages": [{"role": "user", "content": "', '"}]}', "messages"), ('{"other": "', '"}', None), ('{"prompt": "\\q", "completion": "', '"}', None), ("", "", None)):
        row = C.canonical(spark.range(1).select(F.concat(F.lit(head), b, F.lit(tail)).alias("record"))).select("layout", F.length(F.element_at("turns", -1)["text"])).first()
        assert tuple(row) == (layout, layout and 21_000_000)


def test_skeletons_keep_fingerprints(spark):
    records = [*(x[0] for x in C.LAYOUTS.values()), json.dumps({"turns": [{"role": "a\"}", "text": "x: {\\"}] * 3}), '{"a\\"b" : ["x", {"c": "\\u00e9"}, 1.5, null]}', '{"a": "\\q"}', '{"a": "', '{"a": "b"} x', '"s"', "[]"]
    for r in spark.createDataFrame([(x,) for x in records], "r string").select("r", C.fingerprint(F.col("r")).alias("p"), C.fingerprint(C.skeleton(F.col("r"))).alias("q")).collect():
        assert r["p"] == r["q"], r["r"]


def test_only_native_operations(spark, folder):
    plan = C.op5_chat_format(spark, folder)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan

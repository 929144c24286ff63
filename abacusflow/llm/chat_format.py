r"""Chat formatting by schema fingerprints, in DataFrame functions only.

Records come as JSON in many layouts (messages, prompt and completion,
instruction and output, ...). A record's fingerprint is a hash of its nested
field paths, without the types of its scalars; it selects a declarative mapping
(``LAYOUTS``) into canonical turns of role and text. Scalar fields that tell of a
record's origin (``ASIDE``) are no part of its fingerprint. Records with a
fingerprint that no mapping knows have no layout and no turns; they are reported,
not lost.

``from_rows`` makes such records from a row per turn, each conversation in one of
the layouts that can hold it without loss, so that corpora of many layouts can be
made and read back.

Turns are written as ``### role: text </turn>`` and a line end. Inside texts a
backslash becomes ``\\``, ``###`` becomes ``\h`` and ``</turn>`` becomes ``\t``
(and ``:`` becomes ``\c`` in roles), so a control string in the output is always
the template's, and reading back is exact. The loss mask is a list of spans
(start, length in code points) of the assistants' texts.

Defined cases: null texts and roles are empty; turns that tie are ordered by role
and text; a conversation without turns formats to ""; repeated rows are repeated
turns; an empty table gives no rows; other columns may have any name. A
conversation is one record: its turns are gathered in one row. Records from 20 MB
on, which the variant reader may refuse, are fingerprinted by their skeleton.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

ASSISTANT = "assistant"
_TURN = "array<struct<role string, text string>>"

#: Scalar types in the text of a variant's schema.
_SCALAR = r": (STRING|VOID|BOOLEAN|BIGINT|DOUBLE|DECIMAL\(\d+,\d+\)|DECIMAL|DATE|TIMESTAMP|TIMESTAMP_NTZ|FLOAT|BINARY|VARIANT|UUID)\b"

#: Bytes below which no string of a record passes the JSON reader's 20,000,000 characters, and no record a variant's 128 MiB.
_SAFE = 20_000_000
_LONG = {"maxStringLen": str(2**31 - 1)}

#: The inside of a valid JSON string, without backtracking; a field's name with its colon, or the opening quote of a value.
_INSIDE = r'(?:[^"\\\x00-\x1F]++|\\(?:["\\/bfnrt]|u[0-9A-Fa-f]{4}))*+"'
_STRING = rf'("{_INSIDE}\s*+:)|("){_INSIDE}'
#: Equal flat objects in a row.
_REPEATED = r"(\{[^{}\[\]]*+\})(?:\s*+,\s*+\1)++"


#: Scalar fields beside the turns that no mapping reads.
ASIDE = ("id", "source", "lang", "language", "model", "created", "title", "url", "license", "metadata")
_ASIDE = rf"(?<=[<, ])(?:{'|'.join(ASIDE)})(?:, |(?=>))"


def _list(field: str, role: str, text: str):
    """Turns from a list of objects."""

    def mapping(record: Column) -> Column:
        rows = F.from_json(record, f"`{field}` array<struct<`{role}` string, `{text}` string>>", _LONG)[field]
        return F.transform(rows, lambda x: F.struct(x[role].alias("role"), x[text].alias("text")))

    return mapping


def _fields(*pairs: tuple[str, tuple[str, ...]]):
    """One turn per (role, fields); non-empty fields are joined by a line end, turns without any are left out."""

    def mapping(record: Column) -> Column:
        turns = []
        read = F.from_json(record, ", ".join(f"`{f}` string" for _, fields in pairs for f in fields), _LONG)
        for role, fields in pairs:
            told = [F.when(F.octet_length(record) < _SAFE, F.get_json_object(record, f"$.{f}")).otherwise(read[f]) for f in fields]
            parts = F.filter(F.array(*told), lambda x: x.isNotNull() & (x != ""))
            turns.append(F.struct(F.lit(role).alias("role"), F.when(F.size(parts) > 0, F.array_join(parts, "\n")).alias("text")))
        return F.filter(F.array(*turns), lambda x: x["text"].isNotNull())

    return mapping


#: name -> (a record of this layout, mapping to turns). The record only shows its field paths.
LAYOUTS = {
    "turns": ('{"turns": [{"role": "", "text": ""}]}', _list("turns", "role", "text")),
    "messages": ('{"messages": [{"role": "", "content": ""}]}', _list("messages", "role", "content")),
    "conversations": ('{"conversations": [{"from": "", "value": ""}]}', _list("conversations", "from", "value")),
    "prompt": ('{"prompt": "", "completion": ""}', _fields(("user", ("prompt",)), (ASSISTANT, ("completion",)))),
    "system_prompt": ('{"system": "", "prompt": "", "completion": ""}', _fields(("system", ("system",)), ("user", ("prompt",)), (ASSISTANT, ("completion",)))),
    "question": ('{"question": "", "answer": ""}', _fields(("user", ("question",)), (ASSISTANT, ("answer",)))),
    "instruction": ('{"instruction": "", "output": ""}', _fields(("user", ("instruction",)), (ASSISTANT, ("output",)))),
    "instruction_input": ('{"instruction": "", "input": "", "output": ""}', _fields(("user", ("instruction", "input")), (ASSISTANT, ("output",)))),
}


def skeleton(record: Column) -> Column:
    """A JSON record with the same field paths: its texts emptied, equal neighbours told once. Invalid strings stay and keep it invalid."""
    return F.regexp_replace(F.regexp_replace(record, _STRING, "$1$2$2"), _REPEATED, "$1")


def fingerprint(record: Column) -> Column:
    """A hash of the nested field paths of a JSON record, of any length, without those of ``ASIDE``; null if it is not JSON."""
    short = F.when(F.octet_length(record) < _SAFE, record).otherwise(skeleton(record))
    schema = F.schema_of_variant(F.try_parse_json(short))
    paths = F.regexp_replace(F.regexp_replace(schema, _SCALAR, ""), _ASIDE, "")
    return F.when(schema.isNotNull(), F.xxhash64(F.replace(paths, F.lit(", >"), F.lit(">"))))


def canonical(records: DataFrame, record: str = "record") -> DataFrame:
    """Add ``layout`` (null if unknown) and ``turns`` (role, text; nulls empty)."""
    spark = records.sparkSession
    names = list(LAYOUTS)
    known = spark.range(1).select(*[fingerprint(F.lit(LAYOUTS[n][0])).alias(n) for n in names]).first()
    rows = records.withColumn("_print", fingerprint(F.col(record)))
    layout = F.coalesce(*[F.when(F.col("_print") == known[n], n) for n in names])
    turns = F.coalesce(*[F.when(F.col("_print") == known[n], LAYOUTS[n][1](F.col(record))) for n in names])
    clean = F.transform(turns, lambda x: F.struct(F.coalesce(x["role"], F.lit("")).alias("role"), F.coalesce(x["text"], F.lit("")).alias("text")))
    return rows.withColumn("layout", layout).withColumn("turns", clean.cast(_TURN)).drop("_print")


def escaped(text: Column) -> Column:
    for plain, code in (("\\", "\\\\"), ("###", "\\h"), ("</turn>", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    def piece(x: Column) -> Column:
        for plain, code in (("###", "\\h"), ("</turn>", "\\t"), (":", "\\c")):
            x = F.replace(x, F.lit(code), F.lit(plain))
        return x

    return F.array_join(F.transform(F.split(text, r"\\\\"), piece), "\\")


def formatted(rows: DataFrame) -> DataFrame:
    """Add ``formatted`` and ``loss_mask`` (start from 0 and length, in code points) to rows with ``turns``."""
    parts = F.transform(
        "turns",
        lambda x: F.struct(F.concat(F.lit("### "), F.replace(escaped(x["role"]), F.lit(":"), F.lit("\\c")), F.lit(": ")).alias("head"), escaped(x["text"]).alias("body"), (x["role"] == ASSISTANT).alias("loss")),
    )
    tail = " </turn>\n"
    rows = rows.withColumn("_parts", F.coalesce(parts, F.array().cast("array<struct<head string, body string, loss boolean>>")))
    text = F.array_join(F.transform("_parts", lambda x: F.concat(x["head"], x["body"], F.lit(tail))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start int, length int>>").alias("spans"))

    def add(state: Column, x: Column) -> Column:
        begin, length = state["at"] + F.length(x["head"]), F.length(x["body"])
        span = F.struct(begin.alias("start"), length.alias("length"))
        return F.struct((begin + length + len(tail)).alias("at"), F.when(x["loss"], F.array_append(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    return rows.withColumn("formatted", text).withColumn("loss_mask", F.aggregate("_parts", start, add, lambda s: s["spans"])).drop("_parts")


def turns_of(text: Column) -> Column:
    """The turns of a formatted conversation."""
    pieces = F.filter(F.split(text, " </turn>\n"), lambda x: x != "")
    head = lambda x: F.substring_index(x, ": ", 1)
    return F.transform(pieces, lambda x: F.struct(unescaped(F.substr(head(x), F.lit(5))).alias("role"), unescaped(F.substr(x, F.length(head(x)) + 3)).alias("text")))


def loss_text(text: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, nothing between."""
    return F.array_join(F.transform(mask, lambda s: unescaped(F.substr(text, s["start"] + 1, s["length"]))), "")


def from_rows(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, record): a JSON record from a row per turn, in a layout that holds its turns without loss, chosen by a hash of the key.

    Any turns fit the layouts of lists; one question and answer that are not empty
    also the others, with a system turn before them where there is one; a question
    of several lines may be instruction and input.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    packed = rows.groupBy(F.col(key).alias("_key")).agg(F.sort_array(F.collect_list(one)).alias("_t"))
    said = lambda k: F.get("_t", F.lit(k))["text"]
    roles = F.when(F.size("_t") <= 3, F.array_join(F.transform("_t", lambda x: x["role"]), "\n"))
    full = (F.size("_t") <= 3) & ~F.exists("_t", lambda x: x["text"] == "")
    # worked out once, for all the layouts that ask
    packed = packed.withColumns({"_roles": roles, "_full": full, "_at": F.when(full, F.instr(said(0), "\n")), "_pick": F.pmod(F.xxhash64("_key"), F.lit(6))})
    roles, full, cut_at, pick = F.col("_roles"), F.col("_full"), F.col("_at"), F.col("_pick")
    listed = lambda field, r, t: F.to_json(F.struct(F.transform("_t", lambda x: F.struct(x["role"].alias(r), x["text"].alias(t))).alias(field)))
    told = lambda *fields: F.to_json(F.struct(*[c.alias(n) for n, c in fields]))
    lists = [listed("turns", "role", "text"), listed("messages", "role", "content"), listed("conversations", "from", "value")]
    pairs = [told((a, said(0)), (b, said(1))) for a, b in (("prompt", "completion"), ("question", "answer"), ("instruction", "output"))]
    parted = told(("instruction", F.left(said(0), cut_at - 1)), ("input", F.substr(said(0), cut_at + 1)), ("output", said(1)))
    record = F.when((roles == "user\nassistant") & full & (pick == 5) & (cut_at > 1) & (cut_at < F.length(said(0))), parted)
    for k, c in enumerate(pairs):
        record = record.when((roles == "user\nassistant") & full & (pick == 3 + k), c)
    record = record.when((roles == "system\nuser\nassistant") & full & (pick >= 3), told(("system", said(0)), ("prompt", said(1)), ("completion", said(2))))
    for k, c in enumerate(lists[1:]):
        record = record.when(pick % 3 == k + 1, c)
    return packed.select(F.col("_key").alias(key), record.otherwise(lists[0]).alias("record"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, read back from its formatted text."""
    rows = table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    hard = "\\### Assistant: </turn> ok"
    turns = F.array(*[F.struct(F.lit(k).alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", ASSISTANT))])
    kinds = dict(rows.dtypes)
    own = spark.range(1).select(F.explode(turns).alias("t")).select(F.lit(-7).cast(kinds["conv_id"]).alias("conv_id"), F.col("t.turn").cast(kinds["turn"]).alias("turn"), "t.role", F.lit(hard).alias("text"))
    done = formatted(canonical(from_rows(rows.unionByName(own)))).select("conv_id", "formatted", "loss_mask")
    done = done.withColumn("_turns", turns_of(F.col("formatted"))).withColumn("_loss", loss_text(F.col("formatted"), F.col("loss_mask")))
    told = F.array_join(F.transform("_turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return done.select(
        "conv_id",
        F.size("_turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("_loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "replace(replace(replace({0}, '\\', '\\\\'), '###', '\\h'), '</turn>', '\\t')"
ORACLE_SQL = {
    "op5_chat_format": f"""
with c as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, k, r, '\\### Assistant: </turn> ok' from (values (0, 'user'), (1, 'assistant')) v(k, r))
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
  cast(sum(length('### ' || replace({_ESCAPED.format("role")}, ':', '\\c') || ': ' || {_ESCAPED.format("text")} || ' </turn>' || chr(10))) as bigint) as formatted_chars
from c group by conv_id
"""
}

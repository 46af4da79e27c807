"""Chat formatting: layouts recognised by schema fingerprint, one template, a loss mask.

A layout is a set of nested field paths.  The hash of the sorted paths of a
table (or of one JSON record) selects a declarative mapping that makes turns of
it.  Turns are written as `### role: text</turn>` lines; inside roles and texts
the strings that control the template are escaped, so that the turns and every
text under the loss mask can be read back exactly.

Edge cases: null text or role is empty; turns with equal numbers are ordered by
role and text; repeated rows are turns of their own; a null conversation id is
an id like any other; an unknown layout is an error for a table, and null turns
for a record, as a record that isn't JSON has; other columns change the fingerprint and so have to be dropped by
the caller.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

OPEN, CLOSE = "### ", "</turn>\n"
#: Strings that control the template and what stands for them, in the order of escaping.
ESCAPES = (("\\", "\\e"), ("###", "\\h"), ("</turn>", "\\t"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
TURNS = "array<struct<role:string,text:string>>"

# Known layouts, as nested field paths, and how each gives turns.
ROWS = ("conv_id", "role", "text", "turn")
LAYOUTS: tuple[tuple[tuple[str, ...], tuple], ...] = (
    (ROWS, ("rows", "conv_id", "turn", "role", "text")),
    (("messages[].content", "messages[].role"), ("list", "messages", "role", "content")),
    (("conversations[].from", "conversations[].value"), ("list", "conversations", "from", "value")),
    (("completion", "prompt"), ("pair", ("user", "prompt"), ("assistant", "completion"))),
    (("prompt", "response"), ("pair", ("user", "prompt"), ("assistant", "response"))),
    (("instruction", "output"), ("pair", ("user", "instruction"), ("assistant", "output"))),
    (("input", "instruction", "output"), ("pair", ("user", "instruction", "input"), ("assistant", "output"))),
    (("answer", "question"), ("pair", ("user", "question"), ("assistant", "answer"))),
    (("messages[].content[].text", "messages[].content[].type", "messages[].role"), ("blocks", "messages", "role", "content", "text")),
    (("data.messages[].content", "data.messages[].role"), ("list", "data.messages", "role", "content")),
    (("completion", "prompt", "system"), ("pair", ("system", "system"), ("user", "prompt"), ("assistant", "completion"))),
)
#: Other names of roles, as layouts have them.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def paths(kind: T.DataType, before: str = "") -> list[str]:
    """Nested field paths of a type; [] marks the elements of a list."""
    if isinstance(kind, T.StructType):
        dot = f"{before}." if before else ""
        return [p for f in kind.fields for p in paths(f.dataType, dot + f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, f"{before}[]")
    return [before]


def fingerprint(field_paths: list[str] | tuple[str, ...]) -> str:
    """The hash of a layout."""
    return hashlib.sha256("\n".join(sorted(field_paths)).encode()).hexdigest()


MAPPINGS = {fingerprint(p): mapping for p, mapping in LAYOUTS}


def shape(field_paths: tuple[str, ...]) -> str:
    """Nested paths as Spark writes the schema of a JSON value, with * for what isn't nested."""
    if field_paths == ("",):
        return "*"
    if all(p.startswith("[]") for p in field_paths):
        return f"ARRAY<{shape(tuple(p[2:].removeprefix('.') for p in field_paths))}>"
    held: dict[str, list[str]] = {}
    for p in field_paths:
        name = p.split(".")[0].split("[")[0]
        held.setdefault(name, []).append(p[len(name) :].removeprefix("."))
    return f"OBJECT<{', '.join(f'{name}: {shape(tuple(rest))}' for name, rest in sorted(held.items()))}>"


#: What schemas say of values that aren't nested; values that differ in kind are VARIANT and stay so.
PLAIN = r"\b(?!VARIANT\b)[A-Z_]+(\(\d+,\s?\d+\))?(?=[,>]|$)"


def replaced(value: Column, pairs: tuple, back: bool = False) -> Column:
    for a, b in reversed(pairs) if back else pairs:
        value = F.replace(value, F.lit(b if back else a), F.lit(a if back else b))
    return value


def role_of(value: Column) -> Column:
    known = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))
    return F.coalesce(F.try_element_at(known, F.coalesce(value, F.lit(""))), value, F.lit(""))


def turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def joined(columns: list[Column]) -> Column:
    """Fields of one turn, those that are null or empty left out, with an empty line between."""
    return F.array_join(F.filter(F.array(*columns), lambda x: x.isNotNull() & (x != "")), "\n\n")


def listed(items: Column, role: str, text: str) -> Column:
    """Turns of a list of messages, by the names of their two fields."""
    return F.transform(items, lambda m: turn(role_of(m[role]), m[text]))


def joined_blocks(items: Column, role: str, blocks: str, text: str) -> Column:
    """Turns of a list of messages whose texts come in blocks, with an empty line between."""
    return F.transform(items, lambda m: turn(role_of(m[role]), F.array_join(F.transform(m[blocks], lambda x: x[text]), "\n\n")))


def canonical_turns(df: DataFrame, key: str | None = None) -> DataFrame:
    """(conv_id, turns) of a table in a known layout; `key` is an id column that is not part of the layout."""
    kind = T.StructType([f for f in df.schema.fields if f.name != key])
    mapping = MAPPINGS.get(fingerprint(paths(kind)))
    if mapping is None:
        raise ValueError(f"unknown layout: {sorted(paths(kind))}")
    if mapping[0] == "rows":
        _, conv, number, role, text = mapping
        row = F.struct(F.col(number).alias("n"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
        grouped = df.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(row)).alias("rows"))
        return grouped.select("conv_id", F.transform("rows", lambda r: turn(r["role"], r["text"])).alias("turns"))
    ident = F.col(key) if key else F.monotonically_increasing_id()
    if mapping[0] == "list":
        _, column, role, text = mapping
        turns = listed(F.col(column), role, text)
    elif mapping[0] == "blocks":
        _, column, role, list_, text = mapping
        turns = joined_blocks(F.col(column), role, list_, text)
    else:
        turns = F.array(*(turn(F.lit(role), joined([F.col(f) for f in fields])) for role, *fields in mapping[1:]))
    return df.select(ident.alias("conv_id"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def record_turns(records: DataFrame, key: str, column: str) -> DataFrame:
    """(conv_id, layout, turns) of JSON records, each in a layout of its own.

    layout is the fingerprint of the record's nested paths, over all elements of its lists; it is null where the record
    can't be read.  turns is null where the layout is unknown, as it is where elements of a list differ.
    """
    record = F.col(column)
    said = F.regexp_replace(F.schema_of_variant(F.try_parse_json(record)), PLAIN, "*")
    marks = F.create_map(*(F.lit(x) for p, _ in LAYOUTS for x in (shape(p), fingerprint(p))))
    found = records.select(F.col(key).alias("conv_id"), record.alias("record"), said.alias("said"))
    found = found.withColumn("layout", F.coalesce(F.try_element_at(marks, F.coalesce("said", F.lit(""))), F.sha2("said", 256)))
    turns = F.lit(None).cast(TURNS)
    for mark, mapping in MAPPINGS.items():
        if mapping[0] == "list":
            _, name, role, text = mapping
            kind = f"array<struct<`{role}`:string,`{text}`:string>>"
            made = listed(F.from_json(F.get_json_object("record", f"$.{name}"), kind), role, text)
        elif mapping[0] == "blocks":
            _, name, role, list_, text = mapping
            kind = f"array<struct<`{role}`:string,`{list_}`:array<struct<`{text}`:string>>>>"
            items = F.from_json(F.get_json_object("record", f"$.{name}"), kind)
            made = joined_blocks(items, role, list_, text)
        elif mapping[0] == "pair":
            fields = lambda names: joined([F.get_json_object("record", f"$.{n}") for n in names])
            made = F.array(*(turn(F.lit(role), fields(names)) for role, *names in mapping[1:]))
        else:
            continue
        turns = F.when(F.col("layout") == mark, made).otherwise(turns)
    return found.select("conv_id", "layout", turns.alias("turns"))


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans): spans are (start, end) in code points around assistant texts."""
    written = F.transform(
        "turns",
        lambda t: F.struct(
            F.concat(F.lit(OPEN), replaced(t["role"], ROLE_ESCAPES), F.lit(": ")).alias("head"),
            replaced(t["text"], ESCAPES).alias("body"),
            (t["role"] == "assistant").alias("learn"),
        ),
    )
    made = turns.select("conv_id", written.alias("w"))
    whole = F.array_join(F.transform("w", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE))), "")
    sizes = F.transform("w", lambda x: F.length(x["head"]) + F.length(x["body"]) + len(CLOSE))
    before = F.transform("w", lambda x, i: F.aggregate(F.slice("sizes", 1, i), F.lit(0), lambda a, b: a + b))
    made = made.select("conv_id", "w", whole.alias("formatted"), sizes.alias("sizes")).withColumn("before", before)
    spans = F.transform(
        "w",
        lambda x, i: F.when(
            x["learn"],
            F.struct(
                (F.get("before", i) + F.length(x["head"])).alias("start"),
                (F.get("before", i) + F.length(x["head"]) + F.length(x["body"])).alias("end"),
            ),
        ),
    )
    return made.select("conv_id", "formatted", F.filter(spans, lambda s: s.isNotNull()).alias("loss_spans"))


def read_chat(formatted: Column) -> Column:
    """The turns of a formatted conversation."""
    pieces = F.filter(F.split(formatted, CLOSE), lambda x: x != "")
    part = lambda x, i: F.regexp_extract(x, r"(?s)^### ([^:]*): (.*)$", i)
    return F.transform(
        pieces, lambda x: turn(replaced(part(x, 1), ROLE_ESCAPES, True), replaced(part(x, 2), ESCAPES, True))
    )


def read_loss(formatted: str, spans: str) -> Column:
    """All text under the loss mask, unescaped, in order."""
    texts = F.transform(
        spans, lambda s: replaced(F.substring(F.col(formatted), s["start"] + 1, s["end"] - s["start"]), ESCAPES, True)
    )
    return F.array_join(texts, "")


#: Both turns of the conversation that the query adds, and its id.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def op9_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(PROBE_ID).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(PROBE_TEXT).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    made = format_chat(canonical_turns(rows))
    back = made.select("conv_id", "formatted", read_chat(F.col("formatted")).alias("t"), read_loss("formatted", "loss_spans").alias("loss"))
    flat = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def as_records(turns: DataFrame) -> DataFrame:
    """(conv_id, record): conversations as JSON in five layouts, by their ids; prompts and completions where there is one turn of each."""
    t, kind = F.col("turns"), F.pmod(F.col("conv_id"), F.lit(5))
    other = lambda role: F.when(role == "user", "human").when(role == "assistant", "gpt").otherwise(role)
    messages = F.transform(t, lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")
    named = F.transform(t, lambda x: F.struct(other(x["role"]).alias("from"), x["text"].alias("value"))).alias("conversations")
    block = lambda text: F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))).alias("content")
    blocks = F.transform(t, lambda x: F.struct(x["role"].alias("role"), block(x["text"]))).alias("messages")
    pair = (F.size(t) == 2) & (F.get(t, F.lit(0))["role"] == "user") & (F.get(t, F.lit(1))["role"] == "assistant")
    asked = F.struct(F.get(t, F.lit(0))["text"].alias("prompt"), F.get(t, F.lit(1))["text"].alias("completion"))
    record = F.when(kind == 1, F.to_json(F.struct(named))).when(kind == 2, F.to_json(F.struct(blocks))).when(kind == 3, F.to_json(F.struct(F.struct(messages).alias("data"))))
    return turns.select("conv_id", record.when((kind == 4) & pair, F.to_json(asked)).otherwise(F.to_json(F.struct(messages))).alias("record"))


def chat_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as records of mixed layouts, recognised by their fingerprints, formatted and read back."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    found = record_turns(as_records(canonical_turns(rows)), "conv_id", "record")
    back = format_chat(found).join(found.select("conv_id", "layout"), "conv_id").select("conv_id", "layout", read_chat(F.col("formatted")).alias("t"))
    flat = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return back.select("conv_id", "layout", F.size("t").cast("long").alias("n_turns"), F.sha2(flat.cast("binary"), 256).alias("turns_sha256"))


QUERIES = {"op9_chat": op9_chat, "chat_layouts": chat_layouts}
ORACLES = {
    "op9_chat": r"""
WITH p AS (SELECT -7::BIGINT AS conv_id, unnest([0, 1])::BIGINT AS turn, unnest(['user', 'assistant']) AS role, '\### Assistant: </turn> ok' AS text),
c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT * FROM p)),
e AS (SELECT *, replace(replace(replace(text, '\', '\e'), '###', '\h'), '</turn>', '\t') AS esc,
  replace(replace(replace(replace(role, '\', '\e'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS erole FROM c)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(erole) + 2 + length(esc) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id""",
    "chat_layouts": r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
g AS (SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn, role, text) AS roles, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns FROM c GROUP BY conv_id)
SELECT conv_id, n::BIGINT AS n_turns, sha256(turns) AS turns_sha256, sha256(replace(CASE WHEN conv_id % 5 = 1 THEN 'conversations[].from|conversations[].value'
  WHEN conv_id % 5 = 2 THEN 'messages[].content[].text|messages[].content[].type|messages[].role' WHEN conv_id % 5 = 3 THEN 'data.messages[].content|data.messages[].role'
  WHEN conv_id % 5 = 4 AND roles = 'user,assistant' THEN 'completion|prompt' ELSE 'messages[].content|messages[].role' END, '|', chr(10))) AS layout FROM g""",
}

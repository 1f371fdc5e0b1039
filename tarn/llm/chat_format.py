"""Chat formatting with schema fingerprints: DataFrame operations only.

A table's layout is recognised by a fingerprint, the hash of its sorted nested field paths. Each known
fingerprint has a declarative mapping, three SQL expressions or an array of turns, that turns its
rows into canonical turns (conv_id, turn, role, text). Turns are then put between control strings;
whatever in a text or role could be read as one is escaped, so the format can be read back exactly.

    ### User: text</turn>\\n

Escapes: backslash, "#" and "<" become \\b, \\h and \\l: no control string can occur in escaped text.

Edge cases: a null text or role counts as empty; turns of a conversation are ordered by turn, then
role, then text, null turns first; repeated rows are repeated turns; an empty table formats to no
rows; extra columns are ignored; the rows with a null conv_id are one conversation.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template.
OPEN, AFTER_ROLE, CLOSE = "### ", ": ", "</turn>\n"
NAMED = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
LOSS_ROLE = "assistant"


def paths(kind: T.DataType, prefix: str = "") -> list[str]:
    """Nested field paths, arrays marked by []."""
    if isinstance(kind, T.StructType):
        return [p for f in kind.fields for p in paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name)]
    if isinstance(kind, T.ArrayType):
        return paths(kind.elementType, prefix + "[]")
    return [prefix]


def fingerprint(schema: T.StructType, using: set[str] | None = None) -> str:
    """Hash of the sorted paths; with `using`, of those among them."""
    found = sorted(p for p in paths(schema) if using is None or p in using)
    return hashlib.sha256("\n".join(found).encode()).hexdigest()[:16]


@dataclass(frozen=True)
class Mapping:
    """needs: the paths of the layout. turns: SQL for array<struct<turn, role, text>>, or rows: SQL for (turn, role, text) of a row that is one turn."""

    name: str
    needs: frozenset[str]
    turns: str = ""
    rows: tuple[str, str, str] = ("", "", "")

    @property
    def fingerprint(self) -> str:
        return hashlib.sha256("\n".join(sorted(self.needs)).encode()).hexdigest()[:16]


def _turn(n: int, role: str, text: str) -> str:
    return f"named_struct('turn', bigint({n}), 'role', string({role}), 'text', string({text}))"


def _listed(column: str, role: str, text: str) -> str:
    return f"transform({column}, (x, i) -> {_turn('i', f'x.{role}', f'x.{text}')})"


#: Layouts with their mappings; the largest one whose paths a table has is used.
MAPPINGS = (
    Mapping("turn rows", frozenset({"conv_id", "turn", "role", "text"}), rows=("turn", "role", "text")),
    Mapping("turn rows with content", frozenset({"conv_id", "turn", "role", "content"}), rows=("turn", "role", "content")),
    Mapping("messages", frozenset({"conv_id", "messages[].role", "messages[].content"}), _listed("messages", "role", "content")),
    Mapping("from and value", frozenset({"conv_id", "conversations[].from", "conversations[].value"}), "transform(conversations, (x, i) -> " + _turn("i", "CASE x.`from` WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE x.`from` END", "x.value") + ")"),
    Mapping("prompt and response", frozenset({"conv_id", "prompt", "response"}), f"array({_turn(0, chr(39) + 'user' + chr(39), 'prompt')}, {_turn(1, chr(39) + 'assistant' + chr(39), 'response')})"),
    Mapping("instruction", frozenset({"conv_id", "instruction", "input", "output"}), "array(" + _turn(0, "'user'", "CASE WHEN coalesce(input, '') = '' THEN instruction ELSE concat(coalesce(instruction, ''), '\\n\\n', input) END") + ", " + _turn(1, "'assistant'", "output") + ")"),
)


def mapping_for(schema: T.StructType, mappings: tuple[Mapping, ...] = MAPPINGS) -> Mapping:
    """The mapping whose fingerprint the schema has on the mapping's own paths; ValueError if there is none."""
    fits = [m for m in mappings if fingerprint(schema, set(m.needs)) == m.fingerprint]
    if not fits:
        raise ValueError(f"no mapping for the layout {fingerprint(schema)}: {sorted(paths(schema))}")
    return max(fits, key=lambda m: (len(m.needs), m.name))


def canonical_turns(table: DataFrame, mappings: tuple[Mapping, ...] = MAPPINGS) -> DataFrame:
    """conv_id, turn, role, text of any known layout."""
    m = mapping_for(table.schema, mappings)
    if m.turns:
        table = table.select("conv_id", F.explode(F.expr(m.turns)).alias("t")).select("conv_id", "t.turn", "t.role", "t.text")
    else:
        table = table.select("conv_id", *(F.expr(f"`{e}`").alias(n) for e, n in zip(m.rows, ("turn", "role", "text"), strict=True)))
    return table.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def escape(c: Column) -> Column:
    for raw, safe in ESCAPES:
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def unescape(c: Column) -> Column:
    for raw, safe in reversed(ESCAPES):
        c = F.replace(c, F.lit(safe), F.lit(raw))
    return c


def header(role: Column) -> Column:
    """Named roles by name; any other after an @, its colons escaped as \\c."""
    other = F.concat(F.lit("@"), F.replace(escape(role), F.lit(":"), F.lit("\\c")))
    for raw, name in NAMED.items():
        other = F.when(role == raw, F.lit(name)).otherwise(other)
    return F.concat(F.lit(OPEN), other, F.lit(AFTER_ROLE))


def format_chats(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, end>>: code points of assistant texts in formatted, end exclusive."""
    one = turns.select(
        "conv_id",
        F.struct(
            "turn", "role", "text",
            F.concat(header(F.col("role")), escape(F.col("text")), F.lit(CLOSE)).alias("piece"),
            F.char_length(header(F.col("role"))).alias("skip"),
        ).alias("t"),
    )
    chats = one.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    start = F.lit(0).cast("long")
    # Places of the pieces: a fold over their lengths.
    walked = F.aggregate(
        "t",
        F.struct(start.alias("at"), F.array().cast("array<struct<start:bigint,end:bigint>>").alias("spans")),
        lambda a, x: F.struct(
            (a["at"] + F.char_length(x["piece"])).alias("at"),
            F.when(
                x["role"] == LOSS_ROLE,
                F.concat(a["spans"], F.array(F.struct((a["at"] + x["skip"]).alias("start"), (a["at"] + F.char_length(x["piece"]) - len(CLOSE)).alias("end")))),
            ).otherwise(a["spans"]).alias("spans"),
        ),
    )
    return chats.select("conv_id", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("formatted"), walked["spans"].alias("loss_spans"))


def read_back(chats: DataFrame) -> DataFrame:
    """chats with turns array<struct<role, text>>, read from `formatted` alone, and loss_texts, read from it by loss_spans."""
    parts = F.filter(F.split("formatted", CLOSE.replace("\n", "\\n"), -1), lambda x: x != "")

    def turn(x: Column) -> Column:
        body = F.substr(x, F.lit(len(OPEN) + 1))
        name = F.substring_index(body, AFTER_ROLE, 1)
        other = F.replace(F.substr(name, F.lit(2)), F.lit("\\c"), F.lit(":"))
        role = unescape(other)
        for raw, shown in NAMED.items():
            role = F.when(name == shown, F.lit(raw)).otherwise(role)
        return F.struct(role.alias("role"), unescape(F.substr(body, F.char_length(name) + len(AFTER_ROLE) + 1)).alias("text"))

    spans = F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))))
    return chats.withColumns({"turns": F.transform(parts, turn), "loss_texts": spans})


#: The fixed conversation of the contract.
PROBE_ID, PROBE_TEXT = -7, "\\### Assistant: </turn> ok"


def digest(conversations: DataFrame) -> DataFrame:
    """The columns of the formatting contract, for conversations and the probe."""
    spark = conversations.sparkSession
    probe = spark.range(2).select(F.lit(PROBE_ID).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE_TEXT).alias("text"))
    back = read_back(format_chats(canonical_turns(conversations).unionByName(probe)))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), sha(lines).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        sha(loss).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars"),
    )

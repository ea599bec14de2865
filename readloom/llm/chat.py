"""Chat formatting: layouts are told apart by a fingerprint of their nested field paths, a declarative mapping per
layout makes canonical turns, and a reversible template makes training text with a loss mask.

The fingerprint hashes the sorted field paths that any mapping names, so other fields change nothing; where extra
fields bear such names, the largest layout that is all there is taken. A layout without a mapping is an error for a table and gives no turns for a single JSON record.

Defined results: turns of a conversation are ordered by turn, then role, then text, so repeated rows and ties stay and
reruns agree; a null text or role is empty; rows without conv_id form one conversation; a table without rows gives
none. Formatting and reading back stream over sorted rows: memory holds one turn, never a conversation."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_rows

#: What each known layout looks like. turns: rows of one turn each; list: an array of messages; fields: one column per
#: role, joined by a blank line where a role has several.
LAYOUTS = {
    "rows": {"kind": "turns", "paths": ["turn", "role", "text"]},
    "messages": {"kind": "list", "paths": ["messages[].role", "messages[].content"]},
    "from_value": {"kind": "list", "paths": ["conversations[].from", "conversations[].value"]},
    "prompt": {"kind": "fields", "fields": [("user", ["prompt"]), ("assistant", ["completion"])]},
    "prompt_response": {"kind": "fields", "fields": [("user", ["prompt"]), ("assistant", ["response"])]},
    "instruction": {"kind": "fields", "fields": [("user", ["instruction"]), ("assistant", ["output"])]},
    "instruction_input": {"kind": "fields", "fields": [("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "system_instruction_input": {"kind": "fields", "fields": [("system", ["system"]), ("user", ["instruction", "input"]), ("assistant", ["output"])]},
    "question": {"kind": "fields", "fields": [("system", ["system_prompt"]), ("user", ["question"]), ("assistant", ["response"])]},
}
#: Names that layouts give to roles.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}
#: Labels of the template; another role is written as it is, after "role=".
LABELS = {"system": "System", "user": "User", "assistant": "Assistant", "tool": "Tool"}
LABELLED = {v: k for k, v in LABELS.items()}
TURN = re.compile(r"### ((?:[^\\:]++|\\.)*+): ((?:[^\\<]++|\\.|<(?!/turn>))*+)</turn>\n", re.S)
LOSS_ROLES = {"assistant"}


def layout_paths(layout: dict) -> list[str]:
    return sorted(layout["paths"] if "paths" in layout else [f for _, names in layout["fields"] for f in names])


def fingerprint(paths) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:16]


NAMED = {p for layout in LAYOUTS.values() for p in layout_paths(layout)}
REGISTRY = {fingerprint(layout_paths(layout)): layout for layout in LAYOUTS.values()}


def schema_paths(kind: T.DataType, at: str = "") -> Iterator[str]:
    """Leaf paths of a Spark type; [] marks an array's elements."""
    if isinstance(kind, T.StructType):
        for f in kind.fields:
            yield from schema_paths(f.dataType, f"{at}.{f.name}" if at else f.name)
    elif isinstance(kind, T.ArrayType):
        yield from schema_paths(kind.elementType, f"{at}[]")
    else:
        yield at


def value_paths(value, at: str = "") -> Iterator[str]:
    """Leaf paths of a parsed JSON value."""
    if isinstance(value, dict):
        for k, v in value.items():
            yield from value_paths(v, f"{at}.{k}" if at else k)
    elif isinstance(value, list):
        for v in value:
            yield from value_paths(v, f"{at}[]")
    else:
        yield at


def layout_of(paths) -> dict | None:
    """The layout of this fingerprint; if extra fields bear names of other layouts, the largest one that is all there
    (of equal ones the first in LAYOUTS)."""
    named = {p for p in paths if p in NAMED}
    whole = [x for x in REGISTRY.values() if named.issuperset(layout_paths(x))]
    return REGISTRY.get(fingerprint(named)) or max(whole, key=lambda x: len(layout_paths(x)), default=None)


def canonical(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, turn, role, text from a table whose schema matches a layout."""
    layout = layout_of(schema_paths(df.schema))
    if layout is None:
        raise ValueError(f"no mapping for a layout with the fields {sorted(schema_paths(df.schema))}")
    if layout["kind"] == "turns":
        turns = df.select(F.col(conv_id).alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), "role", "text")
    elif layout["kind"] == "list":
        (name, role), (_, text) = (p.split("[].") for p in sorted(layout["paths"], key=lambda p: p.endswith(("content", "value"))))
        turns = df.select(F.col(conv_id).alias("conv_id"), F.posexplode(name).alias("turn", "m")).select("conv_id", F.col("turn").cast("bigint").alias("turn"), F.col(f"m.{role}").alias("role"), F.col(f"m.{text}").alias("text"))
    else:
        made = [F.struct(F.lit(i).cast("bigint").alias("turn"), F.lit(role).alias("role"), F.array_join(F.filter(F.array(*names), lambda x: x.isNotNull() & (x != "")), "\n\n").alias("text")) for i, (role, names) in enumerate(layout["fields"])]
        turns = df.select(F.col(conv_id).alias("conv_id"), F.inline(F.array(*made)))
    renamed = F.create_map(*[F.lit(x) for pair in ROLES.items() for x in pair])
    return turns.withColumn("role", F.coalesce(renamed[F.col("role")], F.col("role")) if layout["kind"] == "list" else F.col("role"))


def canonical_value(record) -> list[tuple[int, str, str]] | None:
    """turn, role, text from one parsed record; None if no layout fits."""
    layout = layout_of(value_paths(record))
    if layout is None or layout["kind"] == "turns":
        return None if layout is None else [(record["turn"], record["role"] or "", record["text"] or "")]
    if layout["kind"] == "fields":
        return [(i, role, "\n\n".join(t for n in names if (t := record.get(n)))) for i, (role, names) in enumerate(layout["fields"])]
    (name, role), (_, text) = (p.split("[].") for p in sorted(layout["paths"], key=lambda p: p.endswith(("content", "value"))))
    return [(i, ROLES.get(m.get(role), m.get(role) or ""), m.get(text) or "") for i, m in enumerate(record[name])]


def canonical_json(df: DataFrame, conv_id: str = "conv_id", record: str = "record") -> DataFrame:
    """The same from rows that each hold one JSON record of any known layout; a record without a mapping, or that is
    not JSON, gives a single row with a null turn and its fingerprint as text."""

    def rows(batches):
        for b in batches:
            for conv, text in zip(b["conv_id"], b["record"], strict=True):
                try:
                    value = json.loads(text or "null")
                except ValueError:
                    value = None
                turns = canonical_value(value) if isinstance(value, dict) else None
                if turns is None:
                    yield conv, None, None, fingerprint(value_paths(value))
                for turn in turns or ():
                    yield conv, *turn

    return map_rows(df.select(F.col(conv_id).alias("conv_id"), F.col(record).alias("record")), "conv_id bigint, turn bigint, role string, text string", rows)


def escape(text: str, also: str = "") -> str:
    text = text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")
    return text.replace(also, "\\" + also) if also else text


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S) if "\\" in text else text


def format_turn(role: str, text: str) -> tuple[str, int]:
    """The turn's template text, and where in it the text begins."""
    head = f"### {LABELS.get(role) or 'role=' + escape(role, ':')}: "
    return f"{head}{escape(text)}</turn>\n", len(head)


def parse_turns(text: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn in template text."""
    at = 0
    while m := TURN.match(text, at):
        yield LABELLED.get(m[1]) or unescape(m[1].removeprefix("role=")), unescape(m[2])
        at = m.end()
    if at != len(text):
        raise ValueError(f"not the template's at code point {at}")


def formatted(turns: DataFrame) -> DataFrame:
    """conv_id, seq, piece, loss_start, loss_end: a row per turn in order; a conversation's text is its pieces
    joined, and the mask holds code points of that text (null where no loss falls on the turn)."""

    def rows(batches):
        now, seq, at = object(), 0, 0
        for b in batches:
            for conv, role, text in zip(b["conv_id"], b["role"], b["text"], strict=True):
                if conv != now:
                    now, seq, at = conv, 0, 0
                piece, start = format_turn(role or "", text or "")
                loss = (at + start, at + len(piece) - len("</turn>\n")) if role in LOSS_ROLES else (None, None)
                yield conv, seq, piece, *loss
                seq, at = seq + 1, at + len(piece)

    ordered = turns.select("conv_id", "turn", "role", "text").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_rows(ordered, "conv_id bigint, seq bigint, piece string, loss_start bigint, loss_end bigint", rows)


def digest(pieces: DataFrame) -> DataFrame:
    """The contract's columns, read back from formatted()'s rows as they come."""

    def rows(batches):
        now, first = None, True

        def done():
            return now, n, turns.hexdigest(), loss_n, loss.hexdigest(), chars

        for b in batches:
            for conv, piece, lo, hi in zip(b["conv_id"], b["piece"], b["loss_start"], b["loss_end"], strict=True):
                if first or conv != now:
                    if not first:
                        yield done()
                    now, first, n, chars, loss_n, turns, loss = conv, False, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
                for role, text in parse_turns(piece):
                    turns.update(f"{role}\n{text}\n".encode())
                    n += 1
                if lo is not None:
                    masked = unescape(piece[lo - chars : hi - chars])
                    loss.update(masked.encode())
                    loss_n += len(masked)
                chars += len(piece)
        if not first:
            yield done()

    return map_rows(pieces, "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint", rows)

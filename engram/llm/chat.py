r"""Chat formatting: layouts found by fingerprints of nested field paths, canonical turns, one reversible template.

A layout is a declarative mapping, looked up by the hash of the sorted nested field paths that a table has among the
paths any layout knows; paths that no layout knows are ignored, so extra columns don't matter. Arrays of structs give
``name[].field``.

Template: ``### <role>:\n<text></turn>\n`` for each turn. In roles and texts ``\`` is written ``\\``, ``#`` ``\h`` and
``<`` ``\l``, in roles ``:`` ``\c`` too, so that neither ``###`` nor ``</turn>`` can occur in them; reading turns
them back. The loss mask holds spans of code points: the escaped text of each assistant turn.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from .common import trimmed

TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Layout:
    """rows: one row a turn, ordered by a column. items: an array of structs. fields: columns, each a turn of one role;
    the texts of a turn's several columns are joined by a blank line, empty ones left out."""

    name: str
    key: str
    paths: tuple[str, ...]
    role: str = ""
    text: str = ""
    order: str = ""
    items: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()


def _fields(name: str, *turns: tuple[str, tuple[str, ...]], key: str = "conv_id") -> Layout:
    return Layout(name, key, tuple(sorted({key, *(c for _, cs in turns for c in cs)})), fields=turns)


def _items(name: str, items: str, role: str, text: str, key: str = "conv_id") -> Layout:
    return Layout(name, key, tuple(sorted((key, items, f"{items}[].{role}", f"{items}[].{text}"))), role, text, items=items)


LAYOUTS: tuple[Layout, ...] = (
    Layout("turn rows", "conv_id", ("conv_id", "role", "text", "turn"), "role", "text", order="turn"),
    _items("messages", "messages", "role", "content"),
    _items("message texts", "messages", "role", "text"),
    _items("conversations", "conversations", "from", "value"),
    _items("dialog", "dialog", "speaker", "text"),
    _fields("prompt and completion", ("user", ("prompt",)), ("assistant", ("completion",))),
    _fields("prompt and response", ("user", ("prompt",)), ("assistant", ("response",))),
    _fields("question and answer", ("user", ("question",)), ("assistant", ("answer",))),
    _fields("instruction", ("user", ("instruction",)), ("assistant", ("output",))),
    _fields("instruction with input", ("user", ("instruction", "input")), ("assistant", ("output",))),
    _fields("system, instruction and input", ("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
    _fields("system, prompt and response", ("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
)

#: Names of roles in other layouts.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def nested_paths(kind: DataType, at: str = "") -> set[str]:
    """Dotted paths of all fields; an array's elements are marked by ``[]``."""
    if isinstance(kind, StructType):
        return {p for f in kind.fields for p in {f"{at}{f.name}"} | nested_paths(f.dataType, f"{at}{f.name}.")}
    if isinstance(kind, ArrayType):
        return nested_paths(kind.elementType, f"{at[:-1]}[].")
    return set()


def fingerprint(paths: Sequence[str]) -> str:
    return hashlib.sha256("\n".join(sorted(paths)).encode()).hexdigest()[:16]


def layout_of(schema: StructType, layouts: Sequence[Layout] = LAYOUTS) -> Layout:
    """The layout whose paths' fingerprint equals that of the known paths of the schema; if extra known paths blur it,
    the one with the most paths that the schema has all of. Raises ValueError if there is none."""
    known = {p for x in layouts for p in x.paths}
    have = nested_paths(schema) & known
    by_print = {fingerprint(x.paths): x for x in layouts}
    if exact := by_print.get(fingerprint(sorted(have))):
        return exact
    fitting = [x for x in layouts if set(x.paths) <= have]
    if not fitting:
        raise ValueError(f"no layout has these paths: {sorted(have)}")
    return max(fitting, key=lambda x: len(x.paths))


def value_paths(value: object, at: str = "") -> set[str]:
    """Dotted paths of the fields of a parsed JSON value, as nested_paths gives them for a schema."""
    if isinstance(value, dict):
        return {p for k, v in value.items() for p in {f"{at}{k}"} | value_paths(v, f"{at}{k}.")}
    if isinstance(value, list):
        return {p for v in value for p in value_paths(v, f"{at[:-1]}[].")}
    return set()


def record_turns(record: object, layout: Layout) -> list[tuple[str, str]]:
    """The canonical turns of one parsed record by its layout's mapping."""

    def clean(x: object) -> str:
        return "" if x is None else x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)

    if layout.items:
        made = [(clean(t.get(layout.role)), clean(t.get(layout.text))) for t in record.get(layout.items) or [] if isinstance(t, dict)]
        return [(ROLES.get(role, role), text) for role, text in made]
    texts = [(role, "\n\n".join(x for c in columns if (x := clean(record.get(c))))) for role, columns in layout.fields]
    return [(role, text) for role, text in texts if role != "system" or text]


def canonical_records(df: DataFrame, record: str = "record", layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, turns, layout) of JSON records of mixed layouts, a conversation each; the key is not part of the print.

    Each record is looked up by the fingerprint of its own paths; one whose known paths no layout has exactly takes
    the layout with the most paths among those it has all of. A record that is null, no JSON object or of no known
    layout keeps its row, with null turns and layout.
    """
    whole = [x for x in layouts if not x.order]
    bare = {x.name: set(x.paths) - {x.key} for x in whole}
    known = set().union(*bare.values())
    by_print = {fingerprint(sorted(bare[x.name])): x for x in whole}

    def find(value: object) -> Layout | None:
        if not isinstance(value, dict):
            return None
        have = value_paths(value) & known
        if exact := by_print.get(fingerprint(sorted(have))):
            return exact
        return max((x for x in whole if bare[x.name] <= have), key=lambda x: len(x.paths), default=None)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
        for batch in batches:
            turns, names = [], []
            for text in batch.column(1).to_pylist():
                try:
                    value = json.loads(text) if text else None
                except ValueError:
                    value = None
                layout = find(value)
                turns.append([{"role": r, "text": t} for r, t in record_turns(value, layout)] if layout else None)
                names.append(layout.name if layout else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(turns, kind), pa.array(names, pa.string())], ["conv_id", "turns", "layout"])

    return df.select(F.col("conv_id").cast("long").alias("conv_id"), F.col(record).cast("string")).mapInArrow(trimmed(run), f"conv_id long, turns {TURNS}, layout string")


def canonical_turns(df: DataFrame, layouts: Sequence[Layout] = LAYOUTS) -> DataFrame:
    """(conv_id, turns) of a table in any known layout; turns is an array of (role, text).

    Null texts and roles are empty; a null list has no turns, and a null element of one is none. Rows by turn are ordered
    by turn, then role and text, so that ties and repeated rows have one result; null turns come first; a row without an
    identifier is a conversation of its own, however many there are. Roles of other layouts take their canonical names. A
    conversation's rows meet in one task, as its text is one value of the result.
    """
    layout = layout_of(df.schema, layouts)

    def clean(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    def named(c: Column) -> Column:
        role = clean(c)
        for old, new in ROLES.items():
            role = F.when(role == old, F.lit(new)).otherwise(role)
        return role

    key = F.col(layout.key).alias("conv_id")
    if layout.order:
        turn = F.struct(F.col(layout.order).alias("o"), clean(F.col(layout.role)).alias("role"), clean(F.col(layout.text)).alias("text"))
        sorted_rows = F.array_sort(F.collect_list(turn))
        known, unknown = df.where(F.col(layout.key).isNotNull()), df.where(F.col(layout.key).isNull())
        whole = known.groupBy(key).agg(F.transform(sorted_rows, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("turns"))
        return whole.unionByName(unknown.select(key, F.array(F.struct(clean(F.col(layout.role)).alias("role"), clean(F.col(layout.text)).alias("text"))).alias("turns")))
    if layout.items:
        items = F.coalesce(F.col(layout.items), F.array().cast(df.schema[layout.items].dataType))
        return df.select(key, F.transform(F.filter(items, lambda t: t.isNotNull()), lambda t: F.struct(named(t[layout.role]).alias("role"), clean(t[layout.text]).alias("text"))).alias("turns"))
    made = [
        F.struct(F.lit(role).alias("role"), F.array_join(F.filter(F.array(*[clean(F.col(c)) for c in columns]), lambda x: x != ""), "\n\n").alias("text"))
        for role, columns in layout.fields
    ]
    turns = F.array(*made)
    return df.select(key, F.filter(turns, lambda t: (t["role"] != "system") | (t["text"] != "")).alias("turns"))


ESCAPES = {"\\": "\\\\", "#": "\\h", "<": "\\l"}
MARKS = {ord(k): v for k, v in ESCAPES.items()}
ROLE_MARKS = MARKS | {ord(":"): "\\c"}
BACK = {"\\": "\\", "h": "#", "l": "<", "c": ":"}
UNESCAPED = re.compile(r"\\([\\hlc])")
TURN = re.compile(r"### ([^:]*):\n([^<]*)</turn>\n")


def format_turns(turns: Sequence[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of its loss mask."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head = f"### {role.translate(ROLE_MARKS)}:\n"
        body = text.translate(MARKS)
        if role == "assistant":
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, "</turn>\n"]
        at += len(head) + len(body) + 8
    return "".join(parts), spans


def unescape(text: str) -> str:
    return UNESCAPED.sub(lambda m: BACK[m[1]], text) if "\\" in text else text


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation; raises ValueError if it is none."""
    turns, at = [], 0
    while at < len(formatted):
        m = TURN.match(formatted, at)
        if not m:
            raise ValueError("no turn starts here")
        turns.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    return turns


FORMATTED = "conv_id long, formatted string, loss array<struct<start:int,end:int>>"


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, turns) to (conv_id, formatted, loss): the template's text and the mask's spans of code points.

    Null turns, as canonical_records gives for a record of no known layout, have no text and no mask: both are null. No
    turns give an empty text. Null roles and texts are empty, null elements are left out. One row per row of turns, rows
    that repeat an identifier included; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                made = [(None, None) if x is None else format_turns([(t["role"] or "", t["text"] or "") for t in x if t]) for x in some.column(1).to_pylist()]
                loss = [None if spans is None else [{"start": a, "end": b} for a, b in spans] for _, spans in made]
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array([f for f, _ in made], pa.string()), pa.array(loss, span)], ["conv_id", "formatted", "loss"])

    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turns").cast(TURNS)).mapInArrow(trimmed(run), FORMATTED)


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss) to digests: turns and masked texts are read from the formatted text alone.

    A null text has null digests and counts. One row per row; an empty table gives no row.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for batch in batches:
            out: list[list] = [[] for _ in names]
            for conv_id, text, loss in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                text = text.as_py()
                if text is None:
                    for column, value in zip(out, (conv_id.as_py(), *[None] * 5), strict=True):
                        column.append(value)
                    continue
                turns = read_turns(text)
                masked = "".join(unescape(text[s["start"] : s["end"]]) for s in loss.as_py() or ())
                whole = "".join(f"{role}\n{x}\n" for role, x in turns)
                row = (conv_id.as_py(), len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(masked), hashlib.sha256(masked.encode()).hexdigest(), len(text))
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(out, kinds, strict=True)], names)

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(trimmed(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")

"""Rows of exported text that fail to parse, with the reason, beside the typed valid rows.

Method: minimum-cost error parse. A line is a sequence of quotes, delimiters and stretches of other text; inserting or
deleting a quote or a delimiter costs one. Lines that parse at cost zero are recognised inside the JVM by the same
grammar as one possessive pattern (time linear in the line, no recursion); only the others reach the dynamic program.
Its costs state the reason: above zero whatever the number of fields, it is the quoting; above zero only for the
required number of fields, it is the columns; at zero with a value outside its type, it is the value.
"""

from __future__ import annotations

import re
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUOTED = '"[^"]*+(?:""[^"]*+)*+"'
FIELD = f'(?:{QUOTED}|[^",]*+)'
WELL_FORMED = rf"\A{FIELD}(?:,{FIELD})*+\z"
CONTROL = "[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F]"
STAMP = r"\A[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}\z"

START, PLAIN, INSIDE, CLOSED = range(4)  # of a field: at its start, in an unquoted one, in a quoted one, after a quote in a quoted one
ACCEPTS = (START, PLAIN, CLOSED)


@dataclass(frozen=True)
class FieldType:
    """One field of a record: ``kind`` is ``digits`` (1 to 18), ``text``, ``rating`` or ``stamp``."""

    name: str
    kind: str
    nullable: bool = False
    max_chars: int | None = None


POST_FIELDS = (
    FieldType("id", "digits"),
    FieldType("author_id", "digits"),
    FieldType("category_id", "digits", nullable=True),
    FieldType("title", "text", max_chars=200),
    FieldType("body", "text"),
    FieldType("rating", "rating", nullable=True),
    FieldType("created_at", "stamp"),
)


def _step(state: int, token: str) -> tuple[int, int] | None:
    """The state after a token (T text, C delimiter, D quote) and whether a field ended; None if the token cannot stand there."""
    if token == "T":
        return {START: (PLAIN, 0), PLAIN: (PLAIN, 0), INSIDE: (INSIDE, 0)}.get(state)
    if token == "C":
        return (INSIDE, 0) if state == INSIDE else (START, 1)
    return {START: (INSIDE, 0), INSIDE: (CLOSED, 0), CLOSED: (INSIDE, 0)}.get(state)


def tokens(line: str) -> list[tuple[str, int]]:
    """The line as tokens with their offsets."""
    return [({",": "C", '"': "D"}.get(m[0], "T"), m.start()) for m in re.finditer(r'[",]|[^",]+', line)]


def cheapest(line: str, fields: int | None) -> tuple[int, list[str]]:
    """The least number of edits under which the line parses, and those edits; for exactly so many fields, or any number if None.

    Dynamic programming in order of cost over (token, state, fields ended): each such place is settled once.
    """
    parts = tokens(line)
    first = (0, START, 0)
    cost, back = {first: 0}, {}
    queue, settled = deque([first]), set()
    while queue:
        here = queue.popleft()
        if here in settled:
            continue
        settled.add(here)
        at, state, ended = here
        if at == len(parts) and state in ACCEPTS and (fields is None or ended == fields - 1):
            edits = []
            while here != first:
                here, edit = back[here]
                if edit:
                    edits.append(edit)
            return cost[(at, state, ended)], edits[::-1]
        offset = parts[at][1] if at < len(parts) else len(line)
        moves = []
        if at < len(parts):
            token = parts[at][0]
            if after := _step(state, token):
                moves.append((0, (at + 1, after[0], after[1]), None))
            if token != "T":
                moves.append((1, (at + 1, state, 0), f"delete {'quote' if token == 'D' else 'delimiter'} at {offset}"))
        for token, name in (("D", "quote"), ("C", "delimiter")):
            if after := _step(state, token):
                moves.append((1, (at, after[0], after[1]), f"insert {name} at {offset}"))
        for price, (to, new, more), edit in moves:
            there = (to, new, 0 if fields is None else ended + more)
            if (fields is not None and there[2] >= fields) or there in settled:
                continue
            if cost[here] + price < cost.get(there, 1 << 60):
                cost[there] = cost[here] + price
                back[there] = (here, edit)
                (queue.append if price else queue.appendleft)(there)
    raise AssertionError("every line has a parse")


def diagnose(line: str | None, fields: int) -> tuple[str | None, int, str]:
    """Reason (``quoting``, ``columns`` or None), cost and edits of one line. A null line has no fields."""
    if line is None:
        return "columns", fields - 1, "null line"
    any_number, _ = cheapest(line, None)
    exact, edits = cheapest(line, fields)
    return ("quoting" if any_number else "columns" if exact else None), exact, "; ".join(edits)


def _value(i: int) -> Column:
    raw = F.get("_fields", F.lit(i))
    return F.when(raw.startswith('"'), F.regexp_replace(F.expr(f"substring(_fields[{i}], 2, length(_fields[{i}]) - 2)"), '""', '"')).when(raw != "", raw)


def _typed(field: FieldType, value: Column) -> tuple[Column, Column]:
    """The typed value, and whether it is valid (never null)."""
    if field.kind == "digits":
        return value.cast("long"), value.rlike(r"\A[0-9]{1,18}\z")
    if field.kind == "rating":
        return value.cast("double"), value.rlike(r"\A(?:[0-4](?:\.[0-9]{1,2})?|5(?:\.0{1,2})?)\z")
    if field.kind == "stamp":
        stamp = value.try_cast("timestamp_ntz")
        return stamp, value.rlike(STAMP) & stamp.isNotNull() & ~value.startswith("0000")
    fits = ~value.rlike(CONTROL)
    return value, fits & (F.length(value) <= field.max_chars) if field.max_chars else fits


def _examined(lines: DataFrame, raw: str, fields: Sequence[FieldType]) -> DataFrame:
    well_formed = F.coalesce(F.col(raw).rlike(WELL_FORMED), F.lit(False))
    split = F.when(well_formed, F.expr(rf"regexp_extract_all(concat(',', `{raw}`), r',({FIELD})', 1)"))
    df = lines.withColumn("_fields", split).withColumn("_shaped", F.coalesce(F.size("_fields") == len(fields), F.lit(False)))
    invalid = []
    for i, field in enumerate(fields):
        value = _value(i)
        _, valid = _typed(field, value)
        invalid.append(F.when(F.when(value.isNull(), F.lit(field.nullable)).otherwise(F.coalesce(valid, F.lit(False))), None).otherwise(F.lit(field.name)))
    return df.withColumn("_invalid", F.when(F.col("_shaped"), F.array_compact(F.array(*invalid))))


def valid_rows(lines: DataFrame, line_id: str = "line_id", raw: str = "raw_line", fields: Sequence[FieldType] = POST_FIELDS) -> DataFrame:
    """The lines that parse at no cost with valid values, typed: line_id and the fields."""
    df = _examined(lines.select(line_id, raw), raw, fields).where("_shaped and size(_invalid) = 0")
    typed = []
    for i, field in enumerate(fields):
        value = _value(i)
        target = {"digits": "long", "rating": "double", "stamp": "timestamp_ntz"}.get(field.kind, "string")
        typed.append((value.try_cast(target) if target != "string" else value).alias(field.name))
    return df.select(line_id, *typed)


def rejected_rows(lines: DataFrame, line_id: str = "line_id", raw: str = "raw_line", fields: Sequence[FieldType] = POST_FIELDS) -> DataFrame:
    """The lines that fail: line_id, reason (``quoting``, ``columns``, ``value``; the first that applies), cost, detail.

    cost: the fewest insertions and deletions of quotes and delimiters that give a record of the right number of
    fields; detail: these edits, or for ``value`` the names of the invalid fields. Defined results: a null line is
    ``columns``, as is an empty one; an unquoted empty field is null, a quoted one the empty string; line breaks and
    tabs may stand in any text; a repeated line_id is reported for each of its lines, equal rows once; other columns
    are ignored; lines of any length are parsed whole.
    """
    width = len(fields)
    # no filter in the JVM: it would be pushed below the parse and repeat it. Only broken lines carry their text to Python
    df = _examined(lines.select(line_id, raw), raw, fields).select(
        line_id, "_shaped", F.when(~F.col("_shaped"), F.col(raw)).alias("_raw"), F.concat_ws(", ", "_invalid").alias("_names")
    )
    schema = df.select(line_id).schema.add("reason", "string").add("cost", "integer").add("detail", "string")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            shaped, names, raws = (batch.column(c) for c in ("_shaped", "_names", "_raw"))
            for i, (ok, name) in enumerate(zip(shaped.to_pylist(), names.to_pylist())):
                if not ok:
                    rows.append((i, *diagnose(raws[i].as_py(), width)))
                elif name:
                    rows.append((i, "value", 0, name))
            at, reasons, costs, details = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(line_id).take(pa.array(at, pa.int64())), pa.array(reasons, pa.string()), pa.array(costs, pa.int32()), pa.array(details, pa.string())],
                names=[line_id, "reason", "cost", "detail"],
            )

    return df.mapInArrow(parse, schema).distinct()

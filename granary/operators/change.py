"""INSERT, UPDATE and DELETE as plans over immutable snapshots, and the constraint checks that come before publication."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granary.errors import Code, DatabaseError, StatementError
from granary.plans.dialect import bound, count_parameters
from granary.plans.statements import Delete, Insert, Update
from granary.sources.store import TableVersion

HIT, FILE = "granary_hit", "granary_file"


def _sql(session, text: str, args: Sequence) -> DataFrame:
    text, named = bound(text, list(args))
    return session.sql(text, args=named)


def new_rows(session, table: TableVersion, statement: Insert, args: Sequence) -> DataFrame:
    """The rows of an INSERT in the table's columns and types; columns that are left out get their default."""
    given = statement.columns or [c.name for c in table.columns]
    seen = {name.lower() for name in given}
    if len(seen) != len(given):
        raise StatementError("a column is named twice", Code.ERROR)
    for name in given:
        table.column(name)
    names = [f"v{k}" for k in range(len(given))]
    if statement.query is not None:
        frame = _sql(session, statement.query, args)
        if len(frame.columns) != len(given):
            raise StatementError(f"{len(given)} columns, {len(frame.columns)} values", Code.ERROR)
        frame = frame.toDF(*names)
    else:
        if not statement.columns and all(len(r) < len(given) for r in statement.rows):
            names = names[: len(statement.rows[0])]  # a missing tail is null or default
        for row in statement.rows:
            if len(row) != len(names):
                raise StatementError(f"{len(names)} columns, {len(row)} values", Code.ERROR)
        kinds = [table.column(n).type for n in given[: len(names)]]
        frame = _literal_rows(session, statement.rows, names, kinds, list(args))
        if frame is None:
            frame = _computed_rows(session, statement.rows, names, kinds, list(args))
    at = {name.lower(): n for name, n in zip(given, names, strict=False)}
    out = []
    for c in table.columns:
        value = F.col(at[c.name.lower()]) if c.name.lower() in at else F.expr(c.default or "NULL")
        out.append(value.cast(c.type).alias(c.name))
    return frame.select(*out)


#: Types that a number and a string are cast to alike, whether they stand in the text or in a table.
_PLAIN_TYPES = re.compile(r"(big|small|tiny)?int|integer|double|float|string|boolean|decimal\(.*\)|date|timestamp(_ntz)?")
_NUMBER = re.compile(r"[+-]?(?:\d+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?D)")
_STRING = re.compile(r"'((?:[^'\\]|\\.)*)'", re.DOTALL)


def _literal(text: str, args: Iterator) -> Any:
    """The value of a literal or parameter in Spark SQL; anything else raises LookupError."""
    if text == "?":
        value = next(args)
        if value is None or type(value) in (int, float, str):
            return value
        raise LookupError
    if _NUMBER.fullmatch(text):
        return float(text[:-1]) if text.endswith("D") else int(text)
    if found := _STRING.fullmatch(text):
        return re.sub(r"\\(.)", r"\1", found[1], flags=re.DOTALL)
    if text.upper() == "NULL":
        return None
    raise LookupError


def _literal_rows(session, rows: list[list[str]], names: list[str], kinds: list[str], args: list) -> DataFrame | None:
    """Rows of literals as one local table, however many; None if some value is no literal. Integers, doubles and strings of a column
    are kept apart until they are cast."""
    if not all(_PLAIN_TYPES.fullmatch(k) for k in kinds):
        return None
    given = iter(args)
    try:
        columns = list(zip(*([_literal(v, given) for v in row] for row in rows), strict=True))
    except LookupError:
        return None
    if any(type(v) is int and not -(1 << 63) <= v < 1 << 63 for column in columns for v in column):
        return None
    parts, out = {}, []
    for name, kind, column in zip(names, kinds, columns, strict=True):
        held = []
        for python, arrow in ((int, pa.int64()), (float, pa.float64()), (str, pa.string())):
            if any(type(v) is python for v in column):
                held.append(f"{name}_{python.__name__}")
                parts[held[-1]] = pa.array([v if type(v) is python else None for v in column], arrow)
        out.append(F.coalesce(*(F.col(h).cast(kind) for h in held)).alias(name) if held else F.lit(None).cast(kind).alias(name))
    parts["granary_row"] = pa.array(range(len(rows)), pa.int64())
    frame = session.createDataFrame(pa.table(parts))
    return frame.coalesce(max(1, len(rows) // 50_000)).select(*out)


#: Rows of one UNION: the parser follows it as deep as it is long.
_UNION = 64


def _computed_rows(session, rows: list[list[str]], names: list[str], kinds: list[str], args: list) -> DataFrame:
    """Rows of expressions: one SELECT for each keeps values of different types apart until they are cast. Unions are balanced."""
    frames, start = [], 0
    for at in range(0, len(rows), _UNION):
        part = rows[at : at + _UNION]
        n = sum(count_parameters(v) for row in part for v in row)
        text = " UNION ALL ".join(
            "SELECT " + ", ".join(f"CAST({v} AS {t}) AS {n}" for v, t, n in zip(row, kinds, names, strict=True)) for row in part
        )
        frames.append(_sql(session, text, args[start : start + n]))
        start += n
    while len(frames) > 1:
        frames = [a.union(b) for a, b in zip(frames[::2], frames[1::2], strict=False)] + ([frames[-1]] if len(frames) % 2 else [])
    return frames[0]


def updated(session, table: TableVersion, view: str, statement: Update, args: Sequence) -> DataFrame:
    """All rows after an UPDATE, with HIT: every SET expression sees the old row, and only rows that match are computed."""
    changes = {}
    for name, value in statement.changes:
        column = table.column(name).name
        if column in changes:
            raise StatementError(f"column {column} is set twice", Code.ERROR)
        changes[column] = value
    where = f"coalesce(({statement.where}), false)" if statement.where else "true"
    columns = ", ".join(
        f"CASE WHEN {HIT} THEN CAST(({changes[c.name]}) AS {c.type}) ELSE `{c.name}` END AS `{c.name}`" if c.name in changes else f"`{c.name}`"
        for c in table.columns
    )
    # parameters stand in the order of the table's columns here, in the order of SET in the statement
    counts = {table.column(n).name: count_parameters(v) for n, v in statement.changes}
    start, slots = 0, {}
    for name, value in statement.changes:
        column = table.column(name).name
        slots[column] = list(args[start : start + counts[column]])
        start += counts[column]
    ordered = [x for c in table.columns for x in slots.get(c.name, [])] + list(args[start:])
    alias = f"`{table.name}`"
    return _sql(session, f"SELECT {columns}, {HIT} FROM (SELECT *, {where} AS {HIT} FROM {view} AS {alias}) AS {alias}", ordered)


def marked(session, table: TableVersion, view: str, statement: Delete, args: Sequence) -> DataFrame:
    """All rows with HIT where a DELETE takes them."""
    where = f"coalesce(({statement.where}), false)" if statement.where else "true"
    return _sql(session, f"SELECT *, {where} AS {HIT} FROM {view} AS `{table.name}`", args)


def files(session, table: TableVersion, view: str, where: str, args: Sequence) -> list[str]:
    """Names of the files that hold rows which the condition is true for. view: the table's rows with FILE."""
    frame = _sql(session, f"SELECT DISTINCT {FILE} FROM {view} AS `{table.name}` WHERE {where}", args)
    return [r[0] for r in frame.collect()]


def check_not_null(table: TableVersion, rows: DataFrame) -> None:
    wanted = [c.name for c in table.columns if c.not_null]
    if not wanted:
        return
    found = rows.agg(*(F.count_if(F.col(f"`{n}`").isNull()).alias(n) for n in wanted)).first()
    for name in wanted:
        if found[name]:
            raise DatabaseError(f"{table.name}.{name} may not be null", Code.CONSTRAINT)


def check_unique(table: TableVersion, rows: DataFrame, old: DataFrame | None = None) -> None:
    """No two rows, nor a new and an old one, may share a key without nulls."""
    for key in table.keys():
        names = [f"`{k}`" for k in key]
        full = rows.select(*names).dropna()
        if full.groupBy(*names).count().filter("count > 1").take(1):
            raise DatabaseError(f"{table.name}({', '.join(key)}) must be unique", Code.CONSTRAINT)
        if old is not None and old.select(*names).join(full, list(key), "left_semi").take(1):
            raise DatabaseError(f"{table.name}({', '.join(key)}) must be unique", Code.CONSTRAINT)

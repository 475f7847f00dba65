"""Result codes and the exceptions that carry them."""

from __future__ import annotations

from enum import IntEnum


class Code(IntEnum):
    """Result codes of the API."""

    OK = 0
    ERROR = 1
    BUSY = 2
    LOCKED = 3
    NOMEM = 4
    READONLY = 5
    IOERR = 6
    CORRUPT = 7
    NOTFOUND = 8
    FULL = 9
    CANTOPEN = 10
    CONSTRAINT = 11
    MISMATCH = 12
    MISUSE = 13
    RANGE = 14
    ROW = 100
    DONE = 101


class GranaryError(Exception):
    """Base of all errors; `code` is the result code."""

    def __init__(self, message: str, code: Code = Code.ERROR):
        super().__init__(message)
        self.code = Code(code)


class DatabaseError(GranaryError):
    """An error of a database: opening, schema, constraint, transaction."""


class StatementError(GranaryError):
    """An error of one statement: syntax, binding, types."""


class CryptoError(GranaryError):
    """An error of keys and ciphers."""


def from_spark(error: Exception) -> GranaryError:
    """The engine's error for one of Spark's."""
    name = type(error).__name__
    text = str(error).split("\n\nJVM stacktrace")[0].strip()
    first = text.split("\n")[0]
    if isinstance(error, GranaryError):
        return error
    if "UNBOUND_SQL_PARAMETER" in text or "INVALID_SQL_ARG" in text:
        return StatementError(first, Code.RANGE)
    if "TABLE_OR_VIEW_NOT_FOUND" in text:
        return StatementError(first, Code.NOTFOUND)
    if any(x in text for x in ("CAST_INVALID_INPUT", "DATATYPE_MISMATCH", "CAST_OVERFLOW", "INVALID_ARRAY")):
        return StatementError(first, Code.MISMATCH)
    if name == "ParseException":
        return StatementError(f"syntax error: {first}", Code.ERROR)
    return StatementError(first, Code.ERROR)

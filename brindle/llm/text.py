"""Expressions and helpers that the text operators share."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: White space of the word rule, as a Java and as a DuckDB regular expression class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"
_KEPT: list[dict] = []


def alone(kept: dict) -> dict:
    """``kept``, what an operator keeps in a Python worker from task to task. Workers serve one operator after the other, so
    what another one kept in this worker is dropped."""
    if not _KEPT or _KEPT[0] is not kept:
        for other in _KEPT:
            other.clear()
        _KEPT[:] = [kept]
        pa.default_memory_pool().release_unused()
    return kept


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once: a lambda over a one-element array binds it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text in order; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), rf"[{SPACE}]+"), "")


def word_count(text: Column) -> Column:
    """The number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def crc_mod(key: Column, modulus: int) -> Column:
    """crc32 of the key's decimal text modulo ``modulus``; a null key counts as the text ``null``."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("null"))) % F.lit(modulus)


def wider(schema: StructType, **columns: str) -> StructType:
    """A copy of ``schema`` with further nullable columns, name=type."""
    ddl = ", ".join(f"{name} {kind}" for name, kind in columns.items())
    return StructType([*schema.fields, *StructType.fromDDL(ddl).fields])

"""First-match lookup of a text in a small dictionary.

The dictionaries are literals of the program, so the lookup is a chain of
substring tests inside the row: no shuffle, no join, nothing to broadcast, and a
location shared by a third of all rows costs what any other one costs.
Dictionaries that come as tables go through ``operators.gazetteer``.

Long expressions are written as SQL text, which the session parses in one go;
put together call by call they would cost the driver more than small jobs take.
"""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, functions as F


def sql_literal(value: str | float | bool | None) -> str:
    """A value as Spark SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        return f"{value!r}D"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    return str(value)


def first_match_sql(column: str, entries: Mapping[str, str | float | bool], default: str = "NULL") -> str:
    """SQL of ``first_match``, with the default given as SQL."""
    tests = [
        f"WHEN contains(lower({column}), {sql_literal(key.lower())}) THEN {sql_literal(value)}"
        for key, value in entries.items()
    ]
    return f"CASE {' '.join(tests)} ELSE {default} END" if tests else default


def first_match(column: str, entries: Mapping[str, str | float | bool], default=None) -> Column:
    """Value of the first entry whose key occurs in the column, ignoring case."""
    return F.expr(first_match_sql(column, entries, sql_literal(default)))


def contains_any(column: str, words: Iterable[str]) -> Column:
    """Whether any of the words occurs in the column, ignoring case; null is no."""
    return first_match(column, {word: True for word in words}, False)

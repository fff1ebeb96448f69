"""Keyword extraction and counting, one pass of plain expressions per row.

The expressions are written as SQL text; see ``matching``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, functions as F

from . import patterns as P
from .matching import sql_literal

#: Keywords up to this length must stand as whole words.
SHORT_WORD = 3


def _has(lowered: str, keyword: str, word_boundary: bool) -> str:
    """Whether a lower-cased column has the keyword.

    The regular expression runs only on texts that hold the literal at all.
    """
    hit = f"contains({lowered}, {sql_literal(keyword)})"
    if len(keyword) <= SHORT_WORD:
        return f"({hit} AND rlike({lowered}, {sql_literal(P.whole_word(keyword))}))"
    if word_boundary:
        apart = f"{re.escape(keyword)}(?<![{P.WORD}]{re.escape(keyword)})(?![{P.WORD}])"
        return f"({hit} AND rlike({lowered}, {sql_literal(apart)}))"
    return hit


def _found(lowered: str, keywords: Sequence[str], word_boundary: bool) -> str:
    marks = [
        f"IF({_has(lowered, keyword, word_boundary)}, {sql_literal(keyword)}, '')" for keyword in keywords
    ]
    return f"array_remove(array({', '.join(marks)}), '')"


def found_keywords(lowered: str, keywords: Sequence[str], word_boundary: bool = False) -> Column:
    """The keywords a lower-cased column has, in dictionary order."""
    return F.expr(_found(lowered, keywords, word_boundary))


def skill_map(found: Mapping[str, str]) -> Column:
    """Category to found keywords, without the categories that have none.

    ``found`` names the column of found keywords per category. Put together
    without lambdas, so that the extraction below it stays in generated code.
    """
    keys = ", ".join(f"IF(size({column}) > 0, {sql_literal(category)}, '')" for category, column in found.items())
    values = ", ".join(found.values())
    none = "CAST(array() AS array<string>)"
    return F.expr(f"map_from_arrays(array_remove(array({keys}), ''), array_remove(array({values}), {none}))")


def keyword_count(lowered: str, keywords: Sequence[str]) -> Column:
    """Occurrences of all keywords, each counted without overlap with itself."""

    def occurrences(keyword: str) -> str:
        word = sql_literal(keyword)
        cut = f"(octet_length({lowered}) - octet_length(replace({lowered}, {word}, '')))"
        return f"IF(contains({lowered}, {word}), {cut} div {len(keyword.encode())}, 0L)"

    return F.expr(" + ".join(occurrences(keyword) for keyword in keywords))

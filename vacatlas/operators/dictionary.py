"""Keywords of a large dictionary, found in one pass over each text by one automaton.

The short dictionaries of the program are matched by plain expressions, keyword by keyword; see ``functions.skills``. That
costs a search of the text for each, so a dictionary of thousands goes through an Aho-Corasick automaton instead: each
character is read once, whatever the number of keywords. Only that step runs in Python, in batches of texts.
"""

from __future__ import annotations

import sys
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from ..functions.skills import SHORT_WORD

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

#: Keywords up to this number are matched by expressions.
MOST_PLAIN = 500


class Scanner:
    """Finds keywords in lower-cased texts. ``short`` ones of up to three characters, or all of them, must be whole words."""

    def __init__(self, words: Sequence[str], word_boundary: bool = False, short: int = SHORT_WORD):
        import ahocorasick

        self.words, self.short = list(dict.fromkeys(w for w in words if w)), short
        self.places = {word: place for place, word in enumerate(self.words)}
        self.machine = ahocorasick.Automaton()
        for word, place in self.places.items():
            kind = 1 if len(word) <= short else 2 if word_boundary else 0
            self.machine.add_word(word, (place, len(word), kind))
        if self.words:
            self.machine.make_automaton()

    @staticmethod
    def _is_word(char: str) -> bool:
        return char.isalnum() or char == "_"

    def _whole(self, text: str, start: int, end: int, kind: int) -> bool:
        """A boundary is where a word character meets another one or an end; ``kind`` 2 only rules word characters out."""
        before = start > 0 and self._is_word(text[start - 1])
        after = end < len(text) and self._is_word(text[end])
        if kind == 2:
            return not before and not after
        return before != self._is_word(text[start]) and after != self._is_word(text[end - 1])

    def counts(self, text: str) -> dict[int, int]:
        """How often each keyword stands in a text, without overlap with itself, by its place in the dictionary."""
        found: dict[int, int] = {}
        ends: dict[int, int] = {}
        if not self.words:
            return found
        for last, (place, length, kind) in self.machine.iter(text):
            start = last + 1 - length
            if start < ends.get(place, 0) or (kind and not self._whole(text, start, last + 1, kind)):
                continue
            ends[place] = last + 1
            found[place] = found.get(place, 0) + 1
        return found


def keyword_hits(
    df: DataFrame, column: str, words: Sequence[str], output: str = "hits", word_boundary: bool = False,
    short: int = SHORT_WORD,
) -> DataFrame:
    """Add ``output``, an array of (word, n) in dictionary order: the keywords of a column's lower-cased text, and how often.

    Keywords of up to ``short`` characters must be whole words, with ``word_boundary`` all of them. Null and empty texts
    have no hits; keywords given twice count once, empty ones never.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType.fromDDL(f"`{output}` array<struct<word:string,n:bigint>>")
    kind = to_arrow_schema(schema).field(0).type
    chosen = list(words)
    rows = df.withColumn("_lowered", F.lower(F.coalesce(F.col(column), F.lit(""))))

    def scan(batches):
        scanner = Scanner(chosen, word_boundary, short)
        for batch in batches:
            hits = []
            for text in batch.column("_lowered"):
                found = scanner.counts(text.as_py())
                hits.append([{"word": scanner.words[place], "n": found[place]} for place in sorted(found)])
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_lowered"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(hits, kind)], [*(batch.schema.names[i] for i in kept), output]
            )

    return rows.mapInArrow(scan, StructType([*df.schema, *schema]))


def extract_many(df: DataFrame, skills: Mapping[str, Sequence[str]], word_boundary: bool = False) -> DataFrame:
    """``key_skills`` of a large dictionary: category to the keywords found, in dictionary order."""
    every = [word for words in skills.values() for word in words]
    hits = keyword_hits(df, "description", every, "_hits", word_boundary)
    homes: dict[str, list[str]] = {}
    for category, words in skills.items():
        for word in dict.fromkeys(words):
            homes.setdefault(word, []).append(category)
    from pyspark.sql.pandas.types import to_arrow_schema

    order = {category: {word: i for i, word in enumerate(words)} for category, words in skills.items()}
    schema = StructType([*df.schema, *StructType.fromDDL("key_skills map<string,array<string>>")])
    kind = to_arrow_schema(schema).field("key_skills").type

    def group(batches):
        for batch in batches:
            maps = []
            for found in batch.column("_hits").to_pylist():
                own: dict[str, list[str]] = {}
                for hit in found:
                    for category in homes[hit["word"]]:
                        own.setdefault(category, []).append(hit["word"])
                maps.append([(c, sorted(own[c], key=order[c].get)) for c in skills if c in own])
            kept = [i for i, name in enumerate(batch.schema.names) if name != "_hits"]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i) for i in kept), pa.array(maps, kind)], [*(batch.schema.names[i] for i in kept), "key_skills"]
            )

    return hits.mapInArrow(group, schema)


def first_of_many(df: DataFrame, column: str, entries: Mapping[str, str], output: str, default: str | None = None) -> DataFrame:
    """Add the value of the first entry, in the order given, whose key stands anywhere in the column, ignoring case."""
    values: dict[str, str] = {}
    for key, value in entries.items():
        values.setdefault(key.lower(), value)
    hits = keyword_hits(df, column, list(values), "_hits", short=0)
    found = F.get(F.col("_hits.word"), F.lit(0))
    table = df.sparkSession.createDataFrame(list(values.items()), f"_word string, `{output}` string")
    joined = hits.withColumn("_word", found).join(table, "_word", "left").drop("_word", "_hits")
    return joined if default is None else joined.withColumn(output, F.coalesce(output, F.lit(default)))

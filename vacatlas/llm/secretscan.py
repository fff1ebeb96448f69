"""Secrets in texts, found through an inverted index of trigrams.

A rule's pattern is read for strings that every match must hold. Each gives its trigrams; alternatives are joined by
OR, pieces by AND. The index lists, for each trigram that some rule asks for, the texts of a segment that hold it,
folded to lower-case ASCII. Postings of a segment are intersected as each rule's query says, and only texts that are
left are searched with the rule's pattern. A rule without a mandatory trigram searches every text.

The index is a table of its own. A segment is a batch of texts, so a trigram that every text holds is one bounded
list per segment, and texts are named by a hash of their id and content: a text met by chance is searched in vain,
none is missed, and nothing depends on the order in which rows are read again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import product
from re import _constants as sre, _parser as reader

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import bounded, record, stored

#: Most strings that a piece of a pattern is spelled out into, and most characters of a class that are.
MOST_STRINGS, MOST_CLASS = 128, 16
#: Bytes of text in a segment, and candidates that go with every task; more are joined by a shuffle.
SEGMENT_BYTES, MOST_CANDIDATES = 4 << 20, 1_000_000


@dataclass(frozen=True)
class Rule:
    """A pattern and what a match must have: ``group`` of at least ``least`` characters. ``fold``: ASCII case is ignored."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0
    fold: bool = False

    def compiled(self) -> re.Pattern:
        return re.compile(self.pattern, re.ASCII | (re.IGNORECASE if self.fold else 0))

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Leftmost matches that do not overlap; then those too short are dropped."""
        return [m.span() for m in self.compiled().finditer(text) if len(m[self.group]) >= self.least]


# The base rules.
BASE = (
    Rule(
        "assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, 2, True
    ),
    Rule("access", r"AKIA[A-Z0-9]+", 18),
    Rule("hex", r"[0-9a-f]{16,}"),  # the runs of 16 characters or more: spans of [0-9a-f]+ with the short ones dropped
)
# Publicly documented shapes of keys and tokens.
MORE = (
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("github_fine", r"github_pat_[A-Za-z0-9_]{60,}"),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"[rs]k_(?:live|test)_[A-Za-z0-9]{16,}"),
    Rule("session_access", r"ASIA[A-Z0-9]{16}"),
    Rule("private_key", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
    Rule("bearer", r"bearer\x20+[A-Za-z0-9._~+/-]{20,}", fold=True),
    Rule("url_password", r"[a-z][a-z0-9+.-]*://[^\x00-\x20/:@]+:[^\x00-\x20/:@]+@[A-Za-z0-9.-]+"),
)


# -- queries ----------------------------------------------------------------

#: None: every text; bytes: a trigram; ("and" | "or", parts).
Query = None | bytes | tuple


def _joined(kind: str, parts: Sequence[Query]) -> Query:
    """AND drops parts that hold for every text; OR with such a part holds for every text."""
    known = [p for p in parts if p is not None]
    if not known or (kind == "or" and len(known) < len(parts)):
        return None
    unique = sorted(set(known), key=repr)
    if kind == "or":  # a part that asks for more than another does leaves no text that the other one would not
        sets = [trigrams(p) for p in unique]
        plain = [isinstance(p, bytes) or (p[0] == "and" and all(isinstance(x, bytes) for x in p[1])) for p in unique]
        unique = [
            p for i, p in enumerate(unique)
            if not any(plain[i] and plain[j] and sets[j] < sets[i] for j in range(len(unique)))
        ]
    return unique[0] if len(unique) == 1 else (kind, tuple(unique))


def _of_string(text: bytes) -> Query:
    return _joined("and", [text[i:i + 3] for i in range(len(text) - 2)])


def _spelled(tokens) -> set[bytes] | None:
    """All strings a piece of a pattern can match, folded; None if they are too many."""
    out = {b""}
    for op, arg in tokens:
        if op is sre.LITERAL:
            own: set[bytes] | None = {chr(arg).encode()}
        elif op is sre.IN:
            own = _class(arg)
        elif op is sre.BRANCH:
            sets = [_spelled(branch) for branch in arg[1]]
            own = None if None in sets else set().union(*sets)
        elif op is sre.SUBPATTERN:
            own = None if arg[1] or arg[2] else _spelled(arg[3])
        elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT) and arg[1] <= 4:
            one = _spelled(arg[2])
            if one is None or len(one) ** arg[1] > MOST_STRINGS:
                return None
            own = {b"".join(p) for n in range(arg[0], arg[1] + 1) for p in product(sorted(one), repeat=n)}
        elif op is sre.AT:
            own = {b""}
        else:
            return None
        if own is None or len(out) * len(own) > MOST_STRINGS:
            return None
        out = {(a + b).lower() for a in out for b in own}
    return out


def _class(items) -> set[bytes] | None:
    chars: set[int] = set()
    for op, arg in items:
        if op is sre.LITERAL:
            chars.add(arg)
        elif op is sre.RANGE and arg[1] - arg[0] < 64:
            chars.update(range(arg[0], arg[1] + 1))
        else:
            return None
    folded = {chr(c).encode().lower() for c in chars}
    return folded if len(folded) <= MOST_CLASS else None


class _Reading:
    """Pieces of a pattern in turn: strings that are open to the right, and what is needed of all before."""

    def __init__(self):
        self.needs: list[Query] = []
        self.open = {b""}

    def close(self) -> None:
        self.needs.append(_joined("or", [_of_string(s) for s in self.open]))
        self.open = {b""}

    def append(self, strings: set[bytes]) -> None:
        if len(self.open) * len(strings) > MOST_STRINGS:
            self.close()
        self.open = {a + b for a in self.open for b in strings}

    def read(self, tokens) -> _Reading:
        for token in tokens:
            op, arg = token
            strings = _spelled([token])
            if strings is not None:
                self.append(strings)
            elif op is sre.SUBPATTERN and not (arg[1] or arg[2]):
                self.read(arg[3])
            elif op is sre.BRANCH:
                self.close()
                self.needs.append(_joined("or", [_Reading().read(branch).query() for branch in arg[1]]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT):
                one = _spelled(arg[2])
                if one is not None:
                    for _ in range(min(arg[0], 8)):
                        self.append(one)
                elif arg[0]:
                    self.close()
                    self.needs.append(_Reading().read(arg[2]).query())
                self.close()
            elif op in (sre.ASSERT, sre.ASSERT_NOT):
                pass  # takes no characters
            else:
                self.close()
        return self

    def query(self) -> Query:
        self.close()
        return _joined("and", self.needs)


def trigram_query(rule: Rule) -> Query:
    """What a text must hold, folded to lower-case ASCII, for the rule to match in it; None if nothing is known."""
    return _Reading().read(reader.parse(rule.pattern, re.ASCII | (re.IGNORECASE if rule.fold else 0))).query()


def trigrams(query: Query) -> set[bytes]:
    if query is None or isinstance(query, bytes):
        return set() if query is None else {query}
    return set().union(*(trigrams(part) for part in query[1]))


def matching(query: Query, postings: dict[bytes, np.ndarray]) -> np.ndarray:
    """The texts that a query leaves, from ascending postings."""
    if isinstance(query, bytes):
        return postings.get(query, np.empty(0, np.int64))
    kind, parts = query
    found = sorted((matching(part, postings) for part in parts), key=len)
    if kind == "or":
        return np.unique(np.concatenate(found))
    out = found[0]
    for other in found[1:]:
        out = out[np.isin(out, other, assume_unique=True)]
    return out


# -- index ------------------------------------------------------------------

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32


def _numbers(grams: Sequence[bytes]) -> np.ndarray:
    return np.array([int.from_bytes(g, "big") for g in grams], np.int64)


def _held(column: pa.Array, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(trigram's place, row) of the wanted trigrams that each text holds, each pair once, ascending."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)[offsets[0]:offsets[-1]]
    if len(data) < 3:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ends = offsets[1:] - offsets[0]
    folded = _FOLD[data].astype(np.int32)
    at = place[(folded[:-2] << 16) | (folded[1:-1] << 8) | folded[2:]]
    where = np.flatnonzero(at)
    row = np.searchsorted(ends, where, "right")
    inside = where + 3 <= ends[row]
    pairs = np.unique((at[where[inside]].astype(np.int64) - 1) * len(column) + row[inside])
    return pairs // len(column), pairs % len(column)


INDEX = pa.schema([("segment", pa.int64()), ("gram", pa.int32()), ("keys", pa.binary())])


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, text and key; null texts are empty."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return rows.withColumn("key", F.xxhash64("id", "text"))


def trigram_index(docs: DataFrame, grams: Sequence[bytes]) -> DataFrame:
    """Postings of the named trigrams, stored: (segment, gram, keys), the keys of the texts that hold it, ascending.

    ``docs`` has key and text. A posting is eight bytes, and a trigram that no text of a segment holds has none.
    """
    numbers = _numbers(grams)

    def post(batches):
        place = np.zeros(1 << 24, np.uint16)
        place[numbers] = np.arange(1, len(numbers) + 1)
        partition, n = TaskContext.get().partitionId(), 0
        for batch in bounded(batches, limit=SEGMENT_BYTES):
            which, row = _held(batch.column("text"), place)
            keys = np.asarray(batch.column("key"))[row]
            found, starts = np.unique(which, return_index=True)
            lists = [np.unique(part).astype("<i8").tobytes() for part in np.split(keys, starts[1:])] if len(found) else []
            yield record(INDEX, {"segment": [(partition << 32) + n] * len(found), "gram": numbers[found], "keys": lists})
            n += 1

    return stored(docs.select("key", "text").mapInArrow(post, "segment bigint, gram int, keys binary"), "trigram-index")


CANDIDATE = pa.schema([("key", pa.int64()), ("rules", pa.int64())])


def candidates(index: DataFrame, queries: Sequence[Query]) -> DataFrame:
    """(key, rules), stored: the texts that the queries leave, and which queries, as bits; None leaves no text here."""
    asked = {int.from_bytes(g, "big") for q in queries for g in trigrams(q)}

    def intersect(table: pa.Table) -> pa.Table:
        postings = {
            g.to_bytes(3, "big"): np.frombuffer(k.as_buffer(), "<i8") for g, k in zip(table["gram"].to_pylist(), table["keys"], strict=True)
        }
        found = [(i, matching(q, postings)) for i, q in enumerate(queries) if q is not None]
        keys, inverse = np.unique(np.concatenate([k for _, k in found]), return_inverse=True) if found else ([], None)
        rules, start = np.zeros(len(keys), np.int64), 0
        for i, own in found:
            rules[inverse[start:start + len(own)]] |= 1 << i
            start += len(own)
        return pa.table({"key": keys, "rules": rules}, schema=CANDIDATE)

    rows = index.where(F.col("gram").isin(*asked)) if asked else index.limit(0)
    met = rows.groupBy("segment").applyInArrow(intersect, "key bigint, rules bigint")
    return stored(met.groupBy("key").agg(F.bit_or("rules").alias("rules")), "candidates")


# -- scan -------------------------------------------------------------------

SPAN = "array<struct<kind:string,start:int,end:int>>"
_SPAN = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _found(text: str, rules: Sequence[tuple[int, Rule]]) -> Iterator[tuple[int, int, int]]:
    for place, rule in rules:
        for start, end in rule.spans(text):
            yield start, place, end


def secret_spans(
    docs: DataFrame, rules: Sequence[Rule] = BASE + MORE, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, spans): the spans of all rules in each whole text, by start, then in the order of the rules.

    A span counts code points, its end is exclusive. One row per row of ``docs``, repeated rows included. Null and
    empty texts have no spans, a null id stays null, and an empty table gives no rows. Other columns are not read. At
    most 63 rules.
    """
    if len(rules) > 63 or len({r.kind for r in rules}) < len(rules):
        raise ValueError("rules need kinds of their own, 63 of them at most")
    queries = [trigram_query(rule) for rule in rules]
    asked = sorted(set().union(*map(trigrams, queries)))
    rows = keyed(docs, id_col, text_col)
    chosen = candidates(trigram_index(rows, asked), queries)
    if chosen.limit(MOST_CANDIDATES + 1).count() <= MOST_CANDIDATES:
        chosen = F.broadcast(chosen)
    marked = rows.join(chosen, "key", "left").select("id", "text", "rules")
    always = [(i, rule) for i, rule in enumerate(rules) if queries[i] is None]
    kinds = [rule.kind for rule in rules]

    def verify(batches):
        sets: dict[int | None, list] = {None: always}
        for batch in bounded(batches):
            spans = []
            for text, bits in zip(batch.column("text").to_pylist(), batch.column("rules").to_pylist(), strict=True):
                if bits not in sets:
                    sets[bits] = [(i, rule) for i, rule in enumerate(rules) if queries[i] is None or bits >> i & 1]
                own = sorted(_found(text, sets[bits]))
                spans.append([{"kind": kinds[place], "start": start, "end": end} for start, place, end in own])
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(spans, _SPAN)], ["doc_id", "spans"])

    kind = rows.schema["id"].dataType.simpleString()
    return marked.mapInArrow(verify, f"doc_id {kind}, spans {SPAN}")

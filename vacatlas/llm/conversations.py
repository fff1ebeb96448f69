"""Repair of the structure of conversations by Four-Russians block tables.

A repaired conversation is empty, or an optional system turn followed by one or more pairs of a user's and an
assistant's turn. The cheapest repair is a shortest path through four states (nothing yet, after the system turn,
after a user's, after an assistant's turn), one step per turn. What remains to be paid from each state is a vector of
four costs; less their least, only a few such vectors exist. So the vectors are enumerated once, and for every block
of ``BLOCK`` symbols and every vector behind it the vector before it is tabled.

A conversation is passed over from its end, block by block, by look-up. Then, from its start, each block is expanded
backward from the vector behind it, and the least letter that keeps to the cheapest cost is taken at each step. As the
costs to the end are known at each step, that gives the least of all cheapest audits; following the least prefix
forward would not, as prefixes differ in length.

Rows are dealt by ranges of (conversation, turn), so a conversation of any length spreads over many tasks. Its parts
are summarised as maps from the vector behind a part to the vector before it and to the state it is left in; these
maps are chained per task's range, then per conversation, and each part is traced on its own.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType
from xxhash import xxh3_128_digest

from .common import stored

#: Symbols in a block, and rows and characters in a part; a part has one row at least.
BLOCK, PART_ROWS, PART_CHARS = 4, 4096, 1 << 20
#: Cost of an edit: deleting, inserting, giving another role, and a truncated turn that stays.
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: Symbols: padding, a turn that must go, then turns by initial s, u, a or any other, first whole, then truncated.
PADDING, GONE, WHOLE, CUT, SYMBOLS = 0, 1, 2, 6, 10
INITIALS = "sua"
#: The state that a user's or assistant's turn leads to, and the states that a turn of each initial can be kept in.
NEXT = (2, 2, 3, 2)
KEPT: tuple[dict[int, int], ...] = ({0: 1}, {0: 2, 1: 2, 3: 2}, {2: 3}, {})
END = (0, 6, 3, 0)
ROLE = {2: "user", 3: "assistant"}
INK, STOP = re.compile(r"[^\x20\x09-\x0D]"), re.compile(r"[.!?][\x20\x09-\x0D]*\Z")


def _moves(symbol: int, after: tuple, here: tuple | None, state: int) -> Iterator[tuple[str, int, int]]:
    """(letter, cost to the end, next state) of the edits at a turn, in the order of their letters."""
    yield "D", DELETE + after[state], state
    if here is not None:
        yield "I", INSERT + here[NEXT[state]], NEXT[state]
    if symbol > GONE:
        extra = TRUNCATED if symbol >= CUT else 0
        target = KEPT[(symbol - WHOLE) % 4].get(state)
        if target is not None:
            yield "K", extra + after[target], target
        yield "R", REROLE + extra + after[NEXT[state]], NEXT[state]


def _before(symbol: int, after: tuple) -> tuple:
    """The costs to the end before a turn, given those behind it."""
    if symbol == PADDING:
        return after
    costs = [min(cost for _, cost, _ in _moves(symbol, after, None, state)) for state in range(4)]
    for _ in range(3):
        costs = [min(costs[q], INSERT + costs[NEXT[q]]) for q in range(4)]
    return tuple(costs)


def _edits(symbol: int, after: tuple, state: int) -> tuple[str, int]:
    """The least letters of a cheapest way past one turn, and the state behind it."""
    here, letters = _before(symbol, after), ""
    while symbol != PADDING:
        letter, _, target = next(m for m in _moves(symbol, after, here, state) if m[1] == here[state])
        letters, state = letters + letter, target
        if letter != "I":
            break
    return letters, state


class Tables:
    """``vectors``: all cost vectors less their least, the first of them at the end of a conversation.

    ``left`` and ``cost`` give, by the vector behind a block and the block's number, the vector before it and what is
    added; ``leaves`` the state a block is left in, by the state it is entered in.
    """

    def __init__(self, length: int = BLOCK):
        self.length, self.vectors, found = length, [END], {END: 0}
        one: list[list[tuple[int, int]]] = []
        for vector in self.vectors:  # grows as vectors are found
            row = []
            for symbol in range(SYMBOLS):
                costs = _before(symbol, vector)
                base = min(costs)
                costs = tuple(c - base for c in costs)
                if costs not in found:
                    found[costs] = len(self.vectors)
                    self.vectors.append(costs)
                row.append((found[costs], base))
            one.append(row)
        n = len(self.vectors)
        self.left1, cost1 = np.moveaxis(np.array(one), 2, 0)
        leaves1 = np.array([[[_edits(s, v, q)[1] for q in range(4)] for s in range(SYMBOLS)] for v in self.vectors])
        self.left = np.arange(n)[:, None]
        self.cost = np.zeros((n, 1), np.int64)
        self.leaves = np.broadcast_to(np.arange(4), (n, 1, 4))
        for _ in range(length):  # a symbol before each block so far; its number is the leading digit
            inner, cost, leaves = self.left, self.cost, self.leaves
            words = inner.shape[1]
            self.left = np.moveaxis(self.left1[inner], 2, 1).reshape(n, -1)
            self.cost = np.moveaxis(cost1[inner] + cost[:, :, None], 2, 1).reshape(n, -1)
            entered = np.moveaxis(leaves1[inner], 2, 1).reshape(n, SYMBOLS * words, 4)
            self.leaves = np.take_along_axis(np.tile(leaves, (1, SYMBOLS, 1)), entered, 2)
        self._traced: dict[tuple[int, int, int], tuple[tuple[str, ...], int]] = {}

    def blocks(self, symbols: bytes) -> list[int]:
        """The numbers of the blocks, padded in front of the first."""
        digits = np.frombuffer(symbols.rjust(-(-len(symbols) // self.length) * self.length, b"\0"), np.uint8)
        return (digits.reshape(-1, self.length) @ 10 ** np.arange(self.length)[::-1]).tolist()

    def trace(self, behind: int, block: int, state: int) -> tuple[tuple[str, ...], int]:
        """The letters at each symbol of a block, which is expanded backward, and the state it is left in."""
        key = behind, block, state
        if key not in self._traced:
            symbols = [block // 10 ** i % 10 for i in reversed(range(self.length))]
            after = list(accumulate(reversed(symbols[1:]), lambda v, s: int(self.left1[v, s]), initial=behind))[::-1]
            letters = []
            for symbol, vector in zip(symbols, after, strict=True):
                own, state = _edits(symbol, self.vectors[vector], state)
                letters.append(own)
            if len(self._traced) > 1_000_000:
                self._traced.clear()
            self._traced[key] = tuple(letters), state
        return self._traced[key]

    def follow(self, symbols: bytes, behind: int, state: int) -> tuple[list[str], int, int]:
        """The letters at each symbol, the state at the end, and the cost from the start of the symbols."""
        blocks, behinds, cost = self.blocks(symbols), [], 0
        entered = state
        for block in reversed(blocks):
            behinds.append(behind)
            cost += int(self.cost[behind, block])
            behind = int(self.left[behind, block])
        cost += self.vectors[behind][entered]
        letters: list[str] = []
        for block, own in zip(blocks, reversed(behinds), strict=True):
            found, state = self.trace(own, block, state)
            letters += found
        return letters[len(letters) - len(symbols):], state, cost

    def summary(self, symbols: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For every vector behind a part: the vector before it, its cost, and the state left in by that entered."""
        blocks, behinds = self.blocks(symbols), []
        left, cost = np.arange(len(self.vectors)), np.zeros(len(self.vectors), np.int64)
        for block in reversed(blocks):
            behinds.append(left)
            cost = cost + self.cost[left, block]
            left = self.left[left, block]
        leaves = np.broadcast_to(np.arange(4), (len(left), 4))
        for block, own in zip(blocks, reversed(behinds), strict=True):
            leaves = np.take_along_axis(self.leaves[own, block], leaves, 1)
        return left, cost, leaves


@lru_cache(maxsize=2)
def tables(length: int = BLOCK) -> Tables:
    return Tables(length)


# -- rows to parts ----------------------------------------------------------

def _legal(before: str, after: str) -> bool:
    return before + after in ("su", "ua", "au")


def _kind(role: str) -> int:
    """The place of a role's initial; -1 never, other initials and no initial are the last."""
    place = INITIALS.find(role[:1]) if role else -1
    return place if place >= 0 else 3


def sorted_turns(turns: DataFrame, conv: str, turn: str, role: str, text: str) -> DataFrame:
    """(conv, turn, role, text, copies): equal rows once, dealt and sorted by ranges of conversation and turn."""
    rows = turns.select(
        F.col(conv).alias("conv"), F.col(turn).cast("bigint").alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text).cast("string"), F.lit(" ")).alias("text"),
    ).groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    # Only the start of a text and its hash are keys: the bounds of the ranges are sampled, and whole texts are long.
    keys = [
        F.col("conv").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", F.substring("text", 1, 64),
        F.xxhash64("text"), "text",
    ]
    return rows.repartitionByRange(*keys[:-1]).sortWithinPartitions(*keys)


PART = (
    "piece int, part int, open boolean, role array<string>, text array<string>, copies array<bigint>, symbols binary,"
    " blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint, low bigint, high bigint,"
    " first_turn bigint, last_turn bigint, first_role string, last_role string"
)


def _named(df: DataFrame, ddl: str) -> StructType:
    """The type of the conversations' ids, then the given columns."""
    return StructType([df.schema["conv"], *StructType.fromDDL(ddl)])


def _records(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


class _Part:
    """What is gathered of one part of a conversation."""

    def __init__(self, conv, number: int):
        self.conv, self.number, self.chars = conv, number, 0
        self.role: list[str] = []
        self.text: list[str] = []
        self.copies: list[int] = []
        self.turn: list[int | None] = []
        self.symbols = bytearray()
        self.n = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "turns"), 0)

    def add(self, turn, role: str, text: str, copies: int, seen: bool, before: tuple | None) -> None:
        kind, n = _kind(role), self.n
        if not INK.search(text):
            n["blank"] += copies
            symbol = GONE
        elif seen:
            n["duplicate"] += copies
            symbol = GONE
        else:
            n["duplicate"] += copies - 1
            cut = not STOP.search(text)
            n["truncated"] += cut
            symbol = (CUT if cut else WHOLE) + kind
        n["illegal"] += copies - 1 + (before is not None and not _legal(before[1][:1], role[:1]))
        n["turns"] += turn is not None and (before is None or before[0] != turn)
        self.symbols.append(symbol)
        self.turn.append(turn)
        self.role.append(role)
        self.text.append(text)
        self.copies.append(copies)
        self.chars += len(text)

    def row(self, piece: int, is_open: bool) -> dict:
        known = [t for t in (self.turn[0], self.turn[-1], *(t for t in self.turn if t is not None)) if t is not None]
        return self.n | {
            "conv": self.conv, "piece": piece, "part": self.number, "open": is_open, "role": self.role, "text": self.text,
            "copies": self.copies, "symbols": bytes(self.symbols), "low": min(known, default=None),
            "high": max(known, default=None), "first_turn": self.turn[0], "last_turn": self.turn[-1],
            "first_role": self.role[0][:1], "last_role": self.role[-1][:1],
        }


def parts_of(turns: DataFrame, part_rows: int = PART_ROWS) -> DataFrame:
    """Parts of conversations, stored: ``open`` ones may continue in, or come after, another part."""
    schema = _named(turns, PART)
    arrow = _arrow(schema)

    def gather(batches):
        piece, part, before, seen, first, out = TaskContext.get().partitionId(), None, None, set(), True, []

        def ready():
            while out and (len(out) >= 512 or sum(map(len, (r["role"] for r in out))) > 20_000):
                yield _records(out, arrow)
                out.clear()

        for batch in batches:
            for conv, turn, role, text, copies in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if part is not None and part.conv != conv:
                    out.append(part.row(piece, first or part.number > 0))
                    first, part = False, None
                    yield from ready()
                if part is None:
                    part, before, seen = _Part(conv, 0), None, set()
                elif len(part.role) >= part_rows or part.chars + len(text) > PART_CHARS:
                    out.append(part.row(piece, True))
                    part = _Part(conv, part.number + 1)
                    yield _records(out, arrow)
                    out.clear()
                digest = xxh3_128_digest(f"{len(role)}:{role}{text}".encode())
                part.add(turn, role, text, copies, digest in seen, before)
                seen.add(digest)
                before = turn, role
        if part is not None:
            out.append(part.row(piece, True))
        if out:
            yield _records(out, arrow)

    return stored(turns.mapInArrow(gather, schema), "conversation-parts")


def _arrow(schema: StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


# -- parts of one conversation ----------------------------------------------

def _same(a: str, b: str):
    return F.col(a).eqNullSafe(F.col(b))


def _late(parts: DataFrame) -> DataFrame:
    """(conv, piece, part, late): the rows of a part whose role and text stand in an earlier task's range.

    Rows of a conversation in the same range are compared there, so a text comes once per range and conversation.
    """
    rows = parts.select("conv", "piece", "part", "symbols", F.posexplode(F.arrays_zip("role", "text")).alias("at", "row"))
    rows = rows.where(F.substring("symbols", F.col("at") + 1, F.lit(1)) != F.lit(bytes([GONE]))).select(
        "conv", "piece", "part", "at",
        F.sha2(F.concat(F.length("row.role").cast("string"), F.lit(":"), "row.role", "row.text"), 256).alias("name"),
    )
    first = rows.groupBy(F.col("conv").alias("c"), F.col("name").alias("m")).agg(F.min("piece").alias("first")).alias("f")
    met = rows.join(first, _same("conv", "c") & (F.col("name") == F.col("m")) & (F.col("first") < F.col("piece")))
    return met.groupBy("conv", "piece", "part").agg(F.collect_list("at").alias("late"))


SUMMARY = "piece int, part int, symbols binary, more_duplicate bigint, less_truncated bigint, left binary, cost binary, leaves binary"


def _summaries(parts: DataFrame) -> DataFrame:
    """The summary of each open part, stored, with the symbols that late rows change."""
    late = _late(parts).select(F.col("conv").alias("c"), F.col("piece").alias("p"), F.col("part").alias("q"), "late")
    rows = parts.select("conv", "piece", "part", "symbols").join(
        late, _same("conv", "c") & (F.col("piece") == F.col("p")) & (F.col("part") == F.col("q")), "left"
    ).select("conv", "piece", "part", "symbols", "late")
    schema = _named(parts, SUMMARY)
    arrow = _arrow(schema)

    def summarise(batches):
        table = tables()
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                symbols, cut = bytearray(row.pop("symbols")), 0
                late_rows = row.pop("late") or []
                for at in late_rows:
                    cut += symbols[at] >= CUT
                    symbols[at] = GONE
                left, cost, leaves = table.summary(bytes(symbols))
                out.append(row | {
                    "symbols": bytes(symbols), "more_duplicate": len(late_rows), "less_truncated": cut,
                    "left": left.astype("<i4").tobytes(), "cost": cost.astype("<i8").tobytes(),
                    "leaves": leaves.astype("<i1").tobytes(),
                })
            yield _records(out, arrow)

    return stored(rows.mapInArrow(summarise, schema), "conversation-summaries")


def _maps(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return (
        np.frombuffer(row.left, "<i4"), np.frombuffer(row.cost, "<i8"), np.frombuffer(row.leaves, "<i1").reshape(-1, 4)
    )


def _composed(maps: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One map for several in a row."""
    left, cost, leaves = maps[-1]
    for own_left, own_cost, own_leaves in reversed(maps[:-1]):
        leaves = np.take_along_axis(leaves, own_leaves[left].astype(np.int64), 1)
        cost = cost + own_cost[left]
        left = own_left[left]
    return left, cost, leaves


def _places(maps: list, behind: int, state: int) -> tuple[list[int], list[int], int]:
    """The vector behind each part, the state each is entered in, and the cost of all, given those of the whole."""
    behinds, states, cost = [], [], 0
    for left, own, _ in reversed(maps):
        behinds.append(behind)
        cost += int(own[behind])
        behind = int(left[behind])
    behinds.reverse()
    cost += tables().vectors[behind][state]
    for (_, _, leaves), own in zip(maps, behinds, strict=True):
        states.append(state)
        state = int(leaves[own, state])
    return behinds, states, cost


PLACE = "piece int, behind int, state int, last boolean, more_illegal bigint, less_turns bigint"


def _placed(parts: DataFrame, summaries: DataFrame) -> DataFrame:
    """The vector behind each open part, the state it is entered in, and what changes in its counts.

    Groups are the parts of a conversation in one task's range, bounded by that, then its ranges, bounded by their number.
    """
    by_piece = _named(parts, "piece int, left binary, cost binary, leaves binary")
    by_part = _named(parts, "piece int, part int, behind int, state int")

    def pieces(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("part")
        left, cost, leaves = _composed([_maps(r) for r in table.itertuples()])
        out = table.iloc[:1][["conv", "piece"]].copy()
        out["left"], out["cost"], out["leaves"] = [left.astype("<i4").tobytes()], [cost.tobytes()], [leaves.astype("<i1").tobytes()]
        return out

    def chain(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("piece")
        behinds, states, _ = _places([_maps(r) for r in table.itertuples()], 0, 0)
        rows = list(table.itertuples())
        illegal = [0] + [int(not _legal(a.last_role, b.first_role)) for a, b in zip(rows, rows[1:], strict=False)]
        shared = [0] + [int(a.last_turn is not None and a.last_turn == b.first_turn) for a, b in zip(rows, rows[1:], strict=False)]
        out = table[["conv", "piece"]].copy()
        out["behind"], out["state"] = behinds, states
        out["last"] = [False] * (len(rows) - 1) + [True]
        out["more_illegal"], out["less_turns"] = illegal, shared
        return out

    def inner(table: pd.DataFrame) -> pd.DataFrame:
        table = table.sort_values("part")
        behinds, states, _ = _places([_maps(r) for r in table.itertuples()], int(table["behind"].iloc[0]), int(table["state"].iloc[0]))
        out = table[["conv", "piece", "part"]].copy()
        out["behind"], out["state"] = behinds, states
        return out

    order = F.struct("part")
    edges = parts.groupBy("conv", "piece").agg(
        F.min_by("first_turn", order).cast("string").alias("first_turn"), F.max_by("last_turn", order).cast("string").alias("last_turn"),
        F.min_by("first_role", order).alias("first_role"), F.max_by("last_role", order).alias("last_role"),
        F.max("part").alias("last_part"),
    ).withColumnsRenamed({"conv": "c", "piece": "p"})
    whole = summaries.groupBy("conv", "piece").applyInPandas(pieces, by_piece)
    whole = whole.join(edges, _same("conv", "c") & (F.col("piece") == F.col("p"))).drop("c", "p")
    chained = stored(whole.groupBy("conv").applyInPandas(chain, _named(parts, PLACE)), "conversation-chains")
    tail = edges.select("c", "p", "last_part")
    chained = chained.join(tail, _same("conv", "c") & (F.col("piece") == F.col("p"))).select(
        F.col("conv").alias("c"), F.col("piece").alias("p"), "behind", "state", "last", "more_illegal", "less_turns", "last_part",
    )
    joined = summaries.join(chained, _same("conv", "c") & (F.col("piece") == F.col("p")))
    places = joined.select("conv", "piece", "part", "left", "cost", "leaves", "behind", "state")
    places = places.groupBy("conv", "piece").applyInPandas(inner, by_part).withColumnsRenamed(
        {"conv": "c2", "piece": "p2", "part": "q2", "behind": "own_behind", "state": "own_state"}
    )
    same = _same("conv", "c2") & (F.col("piece") == F.col("p2")) & (F.col("part") == F.col("q2"))
    return joined.join(places, same).select(
        F.col("conv").alias("c"), F.col("piece").alias("p"), F.col("part").alias("q"), F.col("symbols").alias("new_symbols"),
        F.col("own_behind").alias("behind"), F.col("own_state").alias("state"),
        (F.col("last") & (F.col("part") == F.col("last_part"))).alias("last"), "more_duplicate", "less_truncated",
        F.when(F.col("part") == 0, F.col("more_illegal")).otherwise(0).alias("more_illegal"),
        F.when(F.col("part") == 0, F.col("less_turns")).otherwise(0).alias("less_turns"),
    )


REPAIRED = (
    "piece int, part int, open boolean, blank bigint, duplicate bigint, truncated bigint, illegal bigint, turns bigint,"
    " low bigint, high bigint, cost bigint, audit string, role array<string>, text array<string>"
)
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")


def _repaired(row: dict) -> tuple[str, int, list[str], list[str]]:
    """Audit, cost, and the roles and texts that a part is left with."""
    letters, state, _ = tables().follow(row["symbols"], row["behind"], row["state"])
    roles, texts, audit, cost, at = [], [], [], 0, row["state"]
    for own, symbol, role, text, copies in zip(letters, row["symbols"], row["role"], row["text"], row["copies"], strict=True):
        for letter in own:
            if letter == "D":
                cost += DELETE
                continue
            cost += INSERT if letter == "I" else (TRUNCATED if symbol >= CUT else 0) + (REROLE if letter == "R" else 0)
            kept = letter == "K"
            at = KEPT[(symbol - WHOLE) % 4][at] if kept else NEXT[at]
            roles.append(role if kept else ROLE[at])
            texts.append("" if letter == "I" else text)
        audit.append(own + "D" * (copies - 1))
        cost += DELETE * (copies - 1)
    while row["last"] and at in (1, 2):
        at = NEXT[at]
        audit.append("I")
        cost += INSERT
        roles.append(ROLE[at])
        texts.append("")
    return "".join(audit), cost, roles, texts


def repair(
    turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text",
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The cheapest repair of each conversation, in parts: (conv, piece, part, open, counts, cost, audit, role, text).

    The parts of a conversation in the order of ``piece`` and ``part`` make it up: counts and costs add up, audits,
    roles and texts follow each other. ``open`` is false where a conversation has one part only.

    Rows are taken by turn, nulls first; rows of one turn by role, then by the first 64 characters of the text, then by
    its hash. Equal rows lie side by side, and all but the first are duplicates. Null roles and texts are one space;
    roles and texts can be empty. A null id is a conversation of its own. An empty table gives no rows. Other columns
    are not read.
    """
    parts = parts_of(sorted_turns(turns, conv_col, turn_col, role_col, text_col), part_rows)
    opened = parts.where("open")
    schema = _named(parts, REPAIRED)
    arrow = _arrow(schema)

    def trace(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                audit, cost, roles, texts = _repaired(row)
                out.append({k: row[k] for k in ("conv", "piece", "part", "open", *_COUNTS)} | {
                    "audit": audit, "cost": cost, "role": roles, "text": texts,
                })
            if out:
                yield _records(out, arrow)

    carried = ["conv", "piece", "part", "open", *_COUNTS, "symbols", "role", "text", "copies"]
    alone = parts.where(~F.col("open")).select(
        *carried, F.lit(0).alias("behind"), F.lit(0).alias("state"), F.lit(True).alias("last")
    )
    placed = _placed(opened, _summaries(opened))
    found = opened.join(placed, _same("conv", "c") & (F.col("piece") == F.col("p")) & (F.col("part") == F.col("q")))
    found = found.withColumns({
        "duplicate": F.col("duplicate") + F.col("more_duplicate"), "truncated": F.col("truncated") - F.col("less_truncated"),
        "illegal": F.col("illegal") + F.col("more_illegal"), "turns": F.col("turns") - F.col("less_turns"),
        "symbols": F.col("new_symbols"),
    }).select(*carried, "behind", "state", "last")
    traced = stored(found.mapInArrow(trace, schema), "conversation-repairs")
    return alone.mapInArrow(trace, schema).unionByName(traced)


def repaired_turns(parts: DataFrame) -> DataFrame:
    """The turns that ``repair`` leaves: (conv, piece, part, place, role, text), in the order of these numbers."""
    return parts.select("conv", "piece", "part", F.posexplode(F.arrays_zip("role", "text")).alias("place", "row")).select(
        "conv", "piece", "part", "place", "row.role", "row.text"
    )


def _digests(parts: DataFrame) -> DataFrame:
    """(conv, repaired_sha256) of conversations of several parts, whose texts stream through the digest in order."""
    schema = _named(parts, "repaired_sha256 string")
    arrow = _arrow(schema)
    rows = parts.select("conv", "piece", "part", "role", "text").repartition("conv").sortWithinPartitions("conv", "piece", "part")

    def digest(batches):
        conv, state, begun = None, None, False
        for batch in batches:
            for row in batch.to_pylist():
                if state is None or row["conv"] != conv:
                    if state is not None:
                        yield _records([{"conv": conv, "repaired_sha256": state.hexdigest()}], arrow)
                    conv, state, begun = row["conv"], hashlib.sha256(), False
                for role, text in zip(row["role"], row["text"], strict=True):
                    state.update((("\n" if begun else "") + f"{role}:{text}").encode())
                    begun = True
        if state is not None:
            yield _records([{"conv": conv, "repaired_sha256": state.hexdigest()}], arrow)

    return rows.mapInArrow(digest, schema)


def repair_report(parts: DataFrame) -> DataFrame:
    """One row per conversation: conv, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    The digest of a conversation is sequential: one of several parts streams through one task, in bounded memory.
    """
    gaps = F.coalesce(F.col("high") - F.col("low") + 1 - F.col("turns"), F.lit(0)).cast("bigint").alias("gaps")
    counts = ["blank", "duplicate", "truncated", "illegal", "cost"]
    lines = F.array_join(F.zip_with("role", "text", lambda r, t: F.concat(r, F.lit(":"), t)), "\n")
    alone = parts.where(~F.col("open")).select(
        "conv", gaps, *counts, "audit", F.sha2(lines.cast("binary"), 256).alias("repaired_sha256")
    )
    several = parts.where("open")
    summed = several.groupBy("conv").agg(
        *(F.sum(c).alias(c) for c in (*counts, "turns")), F.min("low").alias("low"), F.max("high").alias("high"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "part", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    digests = _digests(several).withColumnRenamed("conv", "c")
    joined = summed.join(digests, _same("conv", "c")).select("conv", gaps, *counts, "audit", "repaired_sha256")
    return alone.unionByName(joined)

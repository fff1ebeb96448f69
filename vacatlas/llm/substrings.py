"""Long repeated substrings, found by recompression.

A text is a sequence of words, named by hash. In each round a hash bit deals every symbol to one of two sides; a
left symbol followed by a right one becomes one symbol, named from the two. Names are functions of contents, so a
round names equal pairs alike in all texts without moving anything, and rounds run in the task that reads the text.
Left of pairs are runs of one symbol, which no round can pair; they are named by their period.

Equal substrings get equal symbols except near their ends. How near is known exactly: with each symbol goes the
stretch of words that its existence depends on. A symbol whose stretch lies inside a window of ``size`` words is in
every equal window, so a window can repeat only if all such symbols do. That reveals; high symbols of at least
``size`` words that stand in two places, and windows, both by 128-bit names, verify.
"""

from __future__ import annotations

from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from xxhash import xxh3_128_digest

from .batches import ASK, Keys, answers, flags_of, held, numbered, opened, questions, ranges_for
from .common import stored, texts
from .words import mixed, named

#: Rounds to the symbols that reveal, and rounds in all; bytes of text in a batch, and for each range of names.
LOW_ROUNDS, ROUNDS, BATCH_BYTES, RANGE_BYTES = 6, 26, 4 << 20, 8 << 20


class Parse:
    """Symbols of concatenated texts: ``low`` after the first rounds, ``high`` of at least each size, and runs.

    ``low`` holds (symbol, start, end, from, to): the words it spans and those it depends on, which reach beyond a
    text where its end matters. ``high`` holds (start, end), ``runs`` (start, end, period).
    """

    def __init__(self, words: np.ndarray, text: np.ndarray, size: int, low_rounds: int = LOW_ROUNDS, rounds: int = ROUNDS):
        n = len(words)
        sym, s = words.astype(np.uint64), np.arange(n, dtype=np.int64)
        e, near, far, text = s + 1, s.copy(), s + 1, np.asarray(text, np.int64)
        sizes = [size * 4**i for i in range(12)]
        high: list[np.ndarray] = []
        self.low = (sym, s, e, near, far)
        for r in range(rounds):
            if len(sym) < 2:
                break
            left = (mixed(sym + np.uint64((r + 1) << 32)) & np.uint64(1)).astype(bool)
            same = text[:-1] == text[1:]
            pair = same & left[:-1] & ~left[1:]
            if r < low_rounds:
                near, far = self._depend(s, e, near, far, left, same, pair)
            at = np.flatnonzero(pair)
            sym, s, e = sym.copy(), s, e.copy()
            sym[at] = mixed(sym[at] * np.uint64(5) + mixed(sym[at + 1] + np.uint64(r + 1)))
            longer = np.maximum(e[at] - s[at], e[at + 1] - s[at + 1])
            e[at] = e[at + 1]
            for limit in sizes:
                new = at[(e[at] - s[at] >= limit) & (longer < limit)]
                if not len(new) and not (e[at] - s[at] >= limit).any():
                    break
                high.append(np.stack([s[new], e[new]]))
            if r < low_rounds:
                near[at], far[at] = np.minimum(near[at], near[at + 1]), np.maximum(far[at], far[at + 1])
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            sym, s, e, text = sym[keep], s[keep], e[keep], text[keep]
            if r < low_rounds:
                near, far = near[keep], far[keep]
                self.low = (sym, s, e, near, far)
        self.high = np.concatenate(high, axis=1) if high else np.empty((2, 0), np.int64)
        self.runs = self._runs(sym, s, e, text, size)

    @staticmethod
    def _depend(s, e, near, far, left, same, pair):
        """What a symbol that stays single depends on: the neighbour it could have paired with, or the text's end."""
        merged = np.zeros(len(s), bool)
        merged[:-1] |= pair
        merged[1:] |= pair
        after, before = np.append(same, False), np.insert(same, 0, False)
        new_near, new_far = near.copy(), far.copy()
        i = np.flatnonzero(left & ~merged & after)
        new_near[i], new_far[i] = np.minimum(near[i], near[i + 1]), np.maximum(far[i], far[i + 1])
        i = np.flatnonzero(left & ~merged & ~after)
        new_far[i] = e[i] + 1
        i = np.flatnonzero(~left & ~merged & before)
        new_near[i], new_far[i] = np.minimum(near[i], near[i - 1]), np.maximum(far[i], far[i - 1])
        i = np.flatnonzero(~left & ~merged & ~before)
        new_near[i] = s[i] - 1
        return new_near, new_far

    @staticmethod
    def _runs(sym, s, e, text, size) -> np.ndarray:
        """Runs so long that each window of theirs starts again one period on."""
        if not len(sym):
            return np.empty((3, 0), np.int64)
        new = np.ones(len(sym), bool)
        new[1:] = (sym[1:] != sym[:-1]) | (text[1:] != text[:-1])
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(sym)) - 1
        period, start, end = e[first] - s[first], s[first], e[last]
        long = (last > first) & (end - start >= size + period)
        return np.stack([start[long], end[long], period[long]])


def _inside(starts: np.ndarray, stops: np.ndarray, n: int) -> np.ndarray:
    """Which of 0..n-1 lie in any of the ranges."""
    ok = stops > starts
    steps = np.bincount(starts[ok], minlength=n + 1) - np.bincount(stops[ok], minlength=n + 1)
    return np.cumsum(steps[:n]) > 0


class Repeats:
    """A batch of texts: its symbols, and what answers about them and about windows tell of its words."""

    def __init__(self, items: list[str], size: int, low_rounds: int):
        self.size, self.words = size, [item.encode().split() for item in items]
        self.names, self.starts = named(self.words)
        self.text = np.repeat(np.arange(len(items)), np.diff(self.starts))
        self.parse = Parse(self.names, self.text, size, low_rounds)
        sym, _, _, near, far = self.parse.low
        use = far - near <= size  # others are in no window whole
        self.low, self.near, self.far = Keys(sym[use]), near[use], far[use]
        start, end = self.parse.high
        text = self.text[start]
        first = self.starts[text]
        parts = zip(text.tolist(), (start - first).tolist(), (end - first).tolist(), strict=True)
        pair = np.frombuffer(b"".join(xxh3_128_digest(b" ".join(self.words[t][a:b])) for t, a, b in parts), np.uint64).reshape(-1, 2)
        self.high = Keys(pair[:, 0], pair[:, 1])

    def windows(self, low: np.ndarray, high: np.ndarray) -> Keys:
        """The windows to compare, by name, once symbols are told apart.

        Words in a high symbol of two places or in a long run are ``covered``. Windows inside such a symbol repeat;
        they are compared only where the symbol first stands, so that other windows can meet them there. Of a run,
        the windows of one period are.
        """
        size, n = self.size, len(self.names)
        rare = (low[self.low.at] & 1) == 0
        ruled_out = _inside(np.maximum(self.far[rare] - size, 0), np.minimum(self.near[rare] + 1, n), n)
        start, end = self.parse.high
        twice = (high[self.high.at] & 1) == 1
        leads = np.zeros(len(self.high.first), np.int64)  # the first place in this batch
        order = np.argsort(start, kind="stable")[::-1]
        leads[self.high.at[order]] = order
        first = ((high[self.high.at] & 2) == 2) & (leads[self.high.at] == np.arange(len(start)))
        run_start, run_end, period = self.parse.runs
        self.covered = _inside(np.concatenate([start[twice], run_start]), np.concatenate([end[twice], run_end]), n)
        known = twice & ~first
        skip = _inside(
            np.concatenate([start[known], run_start + period]), np.concatenate([end[known], run_end]) - size + 1, n
        )
        whole = np.arange(n) + size <= self.starts[1:][self.text] if n else np.empty(0, bool)
        self.window = np.flatnonzero(whole & ~ruled_out & ~skip)
        told = np.concatenate([[0], np.cumsum(self.covered)])
        self.open = told[self.window + size] - told[self.window] < size
        return Keys(*(_chained(self.names, self.window, size, salt) for salt in (1, 2)))

    def removed(self, keys: Keys, flags: np.ndarray) -> np.ndarray:
        """Which words go, once the windows are answered too."""
        again = self.window[self.open & ((flags[keys.at] & 1) == 1)]
        return self.covered | _inside(again, again + self.size, len(self.names))


def _chained(names: np.ndarray, at: np.ndarray, size: int, salt: int) -> np.ndarray:
    """A name of the ``size`` words from each place."""
    out = np.full(len(at), salt, np.uint64)
    for j in range(size):
        out = mixed(out * np.uint64(2 * salt + 3) + names[at + j])
    return out


def remove_repeats(
    docs: DataFrame, size: int = 35, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (),
    low_rounds: int = LOW_ROUNDS,
) -> DataFrame:
    """Every row of ``docs`` without the words that a window of ``size`` words covers which starts anywhere else too.

    Returns the id, the columns named in ``carry``, the text (kept words joined by one blank), ``n_words`` and
    ``n_removed`` (words before, words taken out), unless a carried column has that name. Words are ASCII-blank separated and compared unchanged; windows are
    judged on the input, within and across texts. Null texts have no words and become empty; texts shorter than a
    window only have their blanks evened. Rows repeated whole repeat each other, so those of a window or more become
    empty. A null id stays null. An empty table gives none; columns not named are not read.
    """
    rows = texts(docs, id_col, text_col)
    if carry:
        rows = docs.select(
            F.col(id_col).cast("bigint").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"),
            F.struct(*(F.col(f"`{c}`") for c in carry)).alias("carried"),
        )
    ranges = ranges_for(rows, RANGE_BYTES)

    def ask_symbols(batches):
        for number, batch in numbered(batches, BATCH_BYTES):
            found = Repeats(batch.column("text").to_pylist(), size, low_rounds)
            yield questions(number, [found.low, found.high], ranges)

    def compared(mine: pa.Table, told: pa.Table) -> tuple[int, pa.Table, Repeats, Keys]:
        number, table = opened(mine)
        found = Repeats(table.column("text").to_pylist(), size, low_rounds)
        return number, table, found, found.windows(*flags_of(told, [(0, found.low), (1, found.high)], ranges))

    def ask_windows(mine: pa.Table, told: pa.Table) -> pa.Table:
        number, _, _, keys = compared(mine, told)
        asked = questions(number, [keys], ranges)
        return pa.Table.from_batches([asked.set_column(0, "part", pa.array(np.asarray(asked.column("part")) + 2 * ranges))])

    def cut(mine: pa.Table, told: pa.Table) -> pa.Table:
        _, table, found, keys = compared(mine, told)
        keep = (~found.removed(keys, *flags_of(told, [(2, keys)], ranges))).tolist()
        starts = found.starts.tolist()
        kept = [list(compress(own, keep[a:b])) for own, a, b in zip(found.words, starts, starts[1:], strict=False)]
        n = np.diff(found.starts)
        columns = {
            "id": table.column("id"), "text": pa.array([b" ".join(x).decode() for x in kept], pa.string()),
            "n_words": pa.array(n, pa.int64()), "n_removed": pa.array(n - [len(x) for x in kept], pa.int64()),
        }
        return pa.table(columns | ({"carried": table.column("carried")} if carry else {}))

    told = stored(answers(rows.mapInArrow(ask_symbols, ASK)), "symbols")
    more = stored(answers(_with(rows, told, ask_windows, ASK)), "windows")
    schema = T.StructType([
        T.StructField("id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("n_words", T.LongType()),
        T.StructField("n_removed", T.LongType()), *(T.StructField(f.name, f.dataType) for f in rows.schema if f.name == "carried"),
    ])
    out = _with(rows, told.union(more), cut, schema)
    return out.select(
        F.col("id").alias(id_col), *(F.col(f"carried.`{c}`").alias(c) for c in carry), F.col("text").alias(text_col),
        *(c for c in ("n_words", "n_removed") if c not in {x.lower() for x in carry}),
    )


def _with(rows: DataFrame, told: DataFrame, step, schema: str | T.StructType) -> DataFrame:
    """``step`` on each batch of texts and the answers to it."""
    return held(rows, BATCH_BYTES).groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(step, schema)

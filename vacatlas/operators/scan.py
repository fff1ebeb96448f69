"""What the market operators read off descriptions, in one pass over batches of bytes.

``clean_text``, ``extract_years``, ``extract_skills`` and the keyword counts of the labels each go over a text again, most of
them once per keyword. Where all rows are read anyway, the texts go to a Python task in batches, as one array of bytes,
and array operations do the same to all of them at once: tags and white space are taken out, three-byte pieces of the
keywords are looked up by a hash at every place, and only places that fit are compared with whole keywords. The results
are those of the expressions, for any text and any dictionary.

Years are left to their patterns, which get the surroundings of each "year" instead of the text: characters that no pattern
can match end an excerpt, so whatever matches in the text matches in an excerpt, and the other way round.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..dictionaries import CATEGORIES, SKILLS
from ..functions import patterns as P
from ..functions.skills import SHORT_WORD

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # tasks need no copy of the package

#: Bytes of text that are gone over together, and places that are hashed at once.
SLICE_BYTES, HASHED = 1 << 20, 1 << 16
#: Bytes before a "year" that are searched for a character no pattern takes; after it, all that a pattern can take.
BEFORE, AFTER = 64, 24
#: Zero bytes behind the texts, so that places near the end can be read in eights.
PAD = 16

KINDS = ("text", "years", "scores", "skills")

_BLANK, _OPEN, _CLOSE = (ord(c) for c in " <>")
_LOWER = bytes(range(256)).lower()
_SPACES = bytes(1 if c < 128 and chr(c) in P.SPACE_CHARS else 0 for c in range(256))
#: The white space beyond ASCII: what follows the first byte of its UTF-8 form, as a number, and the bytes of the form.
_WIDE_SPACES = {
    lead: (np.array(sorted(int.from_bytes(c[1:], "big") for c in forms), np.int64), len(forms[0]))
    for lead, forms in {
        first: [c.encode() for c in P.SPACE_CHARS if c.encode()[0] == first] for first in {c.encode()[0] for c in P.SPACE_CHARS if ord(c) > 127}
    }.items()
}
#: 1 for word characters of ASCII, 2 where the whole character has to be looked at.
_WORDS = bytes(2 if c > 127 else int(chr(c).isalnum() or c == ord("_")) for c in range(256))
#: Bytes that can stand in a phrase before its "year"; every other one ends an excerpt.
_PHRASE = bytes(int(c > 127 or chr(c) in "0123456789 -+" or chr(c).lower() in "tominuales") for c in range(256))
#: Capitals beyond ASCII whose lower case holds ASCII.
_ODD_CAPITALS = ["İ".encode(), "K".encode()]
#: How rare the letters are, from the most frequent; anything else is rarer, but for the blank.
_FREQUENT = " etaoinsrhldcumfpgwybvkxjqz"


def _mapped(data: np.ndarray, table: bytes) -> np.ndarray:
    return np.frombuffer(data.tobytes().translate(table), np.uint8)


def _places(data: np.ndarray, word: bytes) -> np.ndarray:
    """Where a short run of bytes stands."""
    if len(data) < len(word):
        return np.zeros(0, np.int64)
    many = len(data) - len(word) + 1
    hit = data[:many] == word[0]
    for i, byte in enumerate(word[1:], 1):
        hit &= data[i:i + many] == byte
    return np.flatnonzero(hit)


def joined(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, each with an end behind it, and where these ends are. Null is an empty text."""
    none, end = (pa.scalar(text, pa.large_string()) for text in ("", "\n"))
    whole = pc.binary_join_element_wise(pc.fill_null(texts.cast(pa.large_string()), none), none, end)
    edges = np.frombuffer(whole.buffers()[1], np.int64)[whole.offset:whole.offset + len(whole) + 1]
    data = np.frombuffer(whole.buffers()[2], np.uint8)[edges[0]:edges[-1]] if len(whole) else np.zeros(0, np.uint8)
    return data, edges[1:] - edges[0] - 1 if len(whole) else np.zeros(0, np.int64)


def plain(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``text.plain_text`` of joined texts."""
    if not len(ends):
        return data, ends
    data = data.copy()
    starts = np.concatenate([[0], ends[:-1] + 1])
    gone = np.zeros(len(data) + 1, np.int8)
    opened, closed = np.flatnonzero(data == _OPEN), np.flatnonzero(data == _CLOSE)
    if len(opened) and len(closed):
        row = np.searchsorted(ends, closed)
        since = np.maximum(starts[row], np.concatenate([[0], closed[:-1] + 1]))
        at = np.searchsorted(opened, since)
        first = opened[np.minimum(at, len(opened) - 1)]
        tag = (at < len(opened)) & (first < closed - 1)
        first, last = first[tag], closed[tag]
        gone[first + 1], gone[last + 1] = 1, -1
        gone = np.cumsum(gone, dtype=np.int8)
        data[first] = _BLANK
    if (data > 127).any():
        for lead, (forms, size) in _WIDE_SPACES.items():
            at = np.flatnonzero(data == lead)
            form = np.zeros(len(at), np.int64)
            for i in range(1, size):
                form = form << 8 | data[at + i]
            at = at[np.isin(form, forms) & (gone[at] == 0)]
            data[at] = _BLANK
            for i in range(1, size):
                gone[at + i] = 1
    out = np.flatnonzero(gone[:-1])
    if len(out):
        data, ends = data[gone[:-1] == 0], ends - np.searchsorted(out, ends)
        starts = np.concatenate([[0], ends[:-1] + 1])
    kind = _mapped(data, _SPACES).copy()
    kind[ends] = 2
    data = np.where(kind == 1, np.uint8(_BLANK), data)
    blank = kind == 1
    drop = np.zeros(len(data), bool)
    drop[:-1] = blank[:-1] & (kind[1:] > 0)
    leading = np.flatnonzero(kind[starts] == 1)  # the last blank before the first other character is still there
    kept = np.flatnonzero(blank & ~drop)
    if len(leading) and len(kept):
        at = np.searchsorted(kept, starts[leading])
        place = kept[np.minimum(at, len(kept) - 1)]
        drop[place[(at < len(kept)) & (place < ends[leading])]] = True
    out = np.flatnonzero(drop)
    return (data[~drop], ends - np.searchsorted(out, ends)) if len(out) else (data, ends)


def lowered(data: np.ndarray, ends: np.ndarray, ascii_only: bool) -> tuple[np.ndarray, np.ndarray]:
    """Joined texts in lower case. With ``ascii_only``, letters beyond ASCII stay as they are but where they become ASCII."""
    low = _mapped(data, _LOWER)
    if not (data > 127).any() or (ascii_only and not any(len(_places(data, odd)) for odd in _ODD_CAPITALS)):
        return low, ends
    texts = [text.lower() for text in data.tobytes().decode("utf-8", "replace").split("\n")[:-1]]
    return joined(pa.array(texts, pa.string()))


def excerpts(data: np.ndarray, ends: np.ndarray) -> list[str]:
    """Of each text of ``plain`` ones what the patterns of years can match, in pieces parted by semicolons."""
    found: list[list[bytes]] = [[] for _ in range(len(ends))]
    at = _places(_mapped(data, _LOWER), b"year")
    if len(at):
        row = np.searchsorted(ends, at)
        starts = np.concatenate([[0], ends[:-1] + 1])[row]
        phrase = np.concatenate([np.zeros(BEFORE, np.uint8), _mapped(data, _PHRASE)])
        phrase[ends + BEFORE] = 0
        before = np.lib.stride_tricks.sliding_window_view(phrase, BEFORE)[at][:, ::-1]
        other = before == 0
        short = other.any(axis=1)
        first = np.where(short, at - other.argmax(axis=1), starts)
        last = np.minimum(at + len("year") + AFTER, ends[row])
        new = np.concatenate([[True], (first[1:] > last[:-1]) | (row[1:] != row[:-1])])
        edges = np.flatnonzero(new)
        whole = data.tobytes()
        most = np.concatenate([edges[1:], [len(at)]]) - 1
        for r, a, z in zip(row[edges].tolist(), np.minimum.reduceat(first, edges).tolist(), last[most].tolist(), strict=True):
            found[r].append(whole[a:z])
    return [b";".join(own).decode("utf-8", "ignore") for own in found]


class Finder:
    """Finds keywords in joined texts in lower case; ``whole`` ones as ``patterns.whole_word`` does."""

    def __init__(self, words: Mapping[str, bool]):
        self.words = [(word, word.encode(), whole) for word, whole in words.items()]
        self.ascii_only = all(word.isascii() for word in words)
        self.table = np.zeros(1 << 16, bool)
        self.probes: dict[int, list[tuple[int, int]]] = {}
        self.few: list[int] = []
        for i, (_, word, _) in enumerate(self.words):
            if not word or b"\n" in word:
                continue  # clean texts have none
            if len(word) < 3:
                self.few.append(i)
                continue
            offset = max(range(len(word) - 2), key=lambda o: self._rare(word[o:o + 3]))
            probe = int.from_bytes(word[offset:offset + 3], "little")
            self.probes.setdefault(probe, []).append((i, offset))
        self.codes = np.array(sorted(self.probes), np.uint32)
        self.table[self._hash(self.codes)] = True

    @staticmethod
    def _rare(piece: bytes) -> int:
        return sum(_FREQUENT.find(chr(c)) if chr(c) in _FREQUENT else len(_FREQUENT) for c in piece)

    @staticmethod
    def _hash(codes: np.ndarray) -> np.ndarray:
        return (codes * np.uint32(2654435761)) >> np.uint32(16)

    def _candidates(self, low: np.ndarray, padded: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of probes and which probe each is, by probe, then place."""
        found, mask = [np.zeros(0, np.int64)], np.uint32(0xFFFFFF)
        window = np.ndarray((len(low),), "<u4", padded, 0, (1,))
        for start in range(0, len(low), HASHED):
            hit = self.table[self._hash(window[start:start + HASHED] & mask)]
            found.append(np.flatnonzero(hit) + start)
        at = np.concatenate(found)
        codes = window[at] & mask
        probe = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        known = self.codes[probe] == codes
        at, probe = at[known], probe[known]
        order = np.argsort(probe, kind="stable")
        return at[order], probe[order]

    def find(self, low: np.ndarray):
        """(word, places) of the keywords that stand somewhere, places in order, overlapping ones too."""
        padded = np.concatenate([low, np.zeros(PAD, np.uint8)])
        eights = np.ndarray((len(padded) - 7,), "<u8", padded, 0, (1,))
        if len(self.codes):
            at, probe = self._candidates(low, padded)
            edges = np.searchsorted(probe, np.arange(len(self.codes) + 1))
            for code, a, z in zip(self.codes.tolist(), edges, edges[1:], strict=False):
                for i, offset in self.probes[code]:
                    yield from self._checked(i, low, eights, at[a:z] - offset)
        if self.few:
            inside = _mapped(low, _WORDS) == 1
        for i in self.few:
            text, word, whole = self.words[i]
            many = max(0, len(low) - len(word) + 1)
            hit = low[:many] == word[0]
            if whole and _word_char(text[0]):
                hit[1:] &= ~inside[:max(0, many - 1)]
            for k, byte in enumerate(word[1:], 1):
                hit &= low[k:k + many] == byte
            yield from self._checked(i, low, eights, np.flatnonzero(hit))

    def _checked(self, i: int, low: np.ndarray, eights: np.ndarray, at: np.ndarray):
        _, word, whole = self.words[i]
        at = at[(at >= 0) & (at <= len(low) - len(word))]
        for start in range(0, len(word), 8):
            if not len(at):
                return
            piece = word[start:start + 8]
            mask = np.uint64((1 << 8 * len(piece)) - 1)
            at = at[(eights[at + start] & mask) == np.uint64(int.from_bytes(piece, "little"))]
        if whole and len(at):
            at = self._whole(i, low, at)
        if len(at):
            yield i, at

    def _whole(self, i: int, low: np.ndarray, at: np.ndarray) -> np.ndarray:
        text, word, _ = self.words[i]
        words = np.frombuffer(_WORDS, np.uint8)
        before = np.where(at > 0, words[low[at - 1]], 0)
        after_at = at + len(word)
        after = np.where(after_at < len(low), words[low[np.minimum(after_at, len(low) - 1)]], 0)
        for j in np.flatnonzero(before == 2):
            start = int(at[j]) - 1
            while low[start] & 0xC0 == 0x80:
                start -= 1
            # A look behind goes back by one UTF-16 unit, so of characters beyond the first plane it sees none.
            before[j] = low[start] < 0xF0 and _is_word(low[start:int(at[j])].tobytes())
        for j in np.flatnonzero(after == 2):
            start = int(after_at[j])
            after[j] = _is_word(low[start:start + 4].tobytes())
        return at[(before != _word_char(text[0])) & (after != _word_char(text[-1]))]


def _word_char(char: str) -> bool:
    return char.isalnum() or char == "_"


def _is_word(data: bytes) -> bool:
    char = data.decode("utf-8", "ignore")[:1]
    return bool(char) and unicodedata.category(char)[0] in "LN"


def apart(at: np.ndarray, length: int) -> np.ndarray:
    """Of the places of one keyword, in order, those it takes without overlap with itself."""
    if len(at) < 2 or np.diff(at).min() >= length:
        return at
    taken, free = [], -1
    for place in at.tolist():
        if place >= free:
            taken.append(place)
            free = place + length
    return np.array(taken, np.int64)


class Reader:
    """Reads texts for the ``kinds`` asked for: the clean text, excerpts for years, keyword counts, skills."""

    def __init__(self, kinds: Sequence[str], categories: Mapping[str, Sequence[str]], skills: Mapping[str, Sequence[str]]):
        self.kinds, self.categories, self.skills = list(kinds), list(categories), list(skills)
        counted = [(w, False) for words in categories.values() for w in words] if "scores" in kinds else []
        named = [(w, len(w) <= SHORT_WORD) for words in skills.values() for w in words] if "skills" in kinds else []
        self.finder = Finder(dict(counted))  # occurrences anywhere
        self.homes: dict[str, list[int]] = {}
        for c, words in enumerate(categories.values()):
            for word in words:
                self.homes.setdefault(word, []).append(c)
        self.named = Finder(dict(named))
        self.order: dict[str, list[tuple[int, int]]] = {}
        for c, words in enumerate(skills.values()):
            for place, word in enumerate(words):
                self.order.setdefault(word, []).append((c, place))
        self.most = max(map(len, skills.values()), default=1) or 1
        self.places = [list(words) for words in skills.values()]

    def read(self, texts: pa.Array) -> list[pa.Array]:
        data, ends = plain(*joined(texts))
        low = low_ends = None
        if "scores" in self.kinds or "skills" in self.kinds:
            low, low_ends = lowered(data, ends, self.finder.ascii_only and self.named.ascii_only)
        parts = {
            "text": lambda: _texts(data, ends), "years": lambda: pa.array(excerpts(data, ends), pa.string()),
            "scores": lambda: self._scores(low, low_ends), "skills": lambda: self._skills(low, low_ends),
        }
        return [parts[kind]() for kind in self.kinds]

    def _scores(self, low: np.ndarray, ends: np.ndarray) -> pa.Array:
        counts = np.zeros((len(ends), len(self.categories)), np.int64)
        for i, at in self.finder.find(low):
            word, raw, _ = self.finder.words[i]
            own = np.bincount(np.searchsorted(ends, apart(at, len(raw))), minlength=len(ends))
            for c in self.homes[word]:
                counts[:, c] += own
        offsets = np.arange(len(ends) + 1, dtype=np.int32) * len(self.categories)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(counts.ravel()))

    def _skills(self, low: np.ndarray, ends: np.ndarray) -> pa.Array:
        found = [np.zeros(0, np.int64)]
        for i, at in self.named.find(low):
            rows = np.unique(np.searchsorted(ends, at))
            for c, place in self.order[self.named.words[i][0]]:
                found.append((rows * len(self.skills) + c) * self.most + place)
        hits = np.sort(np.concatenate(found))
        names = pa.array([w for own in self.places for w in [*own, *[""] * (self.most - len(own))]], pa.string())
        values = names.take(pa.array(hits % (self.most * max(1, len(self.skills)))))
        groups, first = np.unique(hits // self.most, return_index=True)
        items = pa.ListArray.from_arrays(pa.array(np.append(first, len(hits)).astype(np.int32)), values)
        row, category = np.divmod(groups, max(1, len(self.skills)))
        keys = pa.array(self.skills, pa.string()).take(pa.array(category))
        offsets = np.searchsorted(row, np.arange(len(ends) + 1)).astype(np.int32)
        return pa.MapArray.from_arrays(pa.array(offsets), keys, items)


def _texts(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], ends - np.arange(len(ends))]).astype(np.int32)
    return pa.StringArray.from_buffers(len(ends), pa.py_buffer(offsets.tobytes()), pa.py_buffer(np.delete(data, ends).tobytes()))


#: Column of each kind and its type.
COLUMNS = {
    "text": ("description", "string"), "years": ("_near_years", "string"), "scores": ("_scores", "array<bigint>"),
    "skills": ("key_skills", "map<string,array<string>>"),
}


def scan_texts(
    df: DataFrame, *kinds: str, categories: Mapping[str, Sequence[str]] = CATEGORIES,
    skills: Mapping[str, Sequence[str]] = SKILLS,
) -> DataFrame:
    """Read the raw descriptions once for all ``kinds`` asked for; each is a column, and only "text" keeps the description.

    "text" is the description as ``clean_text`` leaves it, in its place, "years" (``_near_years``) what ``extract_years`` needs of that,
    "scores" (``_scores``) what ``facts.with_scores`` adds, "skills" (``key_skills``) what ``extract_skills`` adds. All rows
    and columns of ``df`` go through the task, so take only the columns that are asked for.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    wanted = [kind for kind in KINDS if kind in kinds]
    added = StructType.fromDDL(", ".join(f"`{COLUMNS[kind][0]}` {COLUMNS[kind][1]}" for kind in wanted))
    types = [field.type for field in to_arrow_schema(added)]
    others = [c for c in df.columns if c not in {"description", *(COLUMNS[kind][0] for kind in wanted)}]
    rows = df.select(*others, "description")

    def scan(batches):
        reader = Reader(wanted, categories, skills)
        for batch in batches:
            texts = batch.column("description")
            sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
            start = 0
            while start < batch.num_rows:
                base = int(sizes[start - 1]) if start else 0
                stop = max(start + 1, int(np.searchsorted(sizes, base + SLICE_BYTES, "right")))
                part = batch.slice(start, stop - start)
                read = reader.read(part.column("description"))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in others), *(a if a.type == t else a.cast(t) for a, t in zip(read, types, strict=True))],
                    [*others, *added.names],
                )
                start = stop

    found = rows.mapInArrow(scan, StructType([*rows.select(*others).schema, *added]))
    return found.select(*(c for c in df.columns if c in found.columns), *(c for c in added.names if c not in df.columns))


def years_source(df: DataFrame) -> str:
    """The column that years are read from: the excerpts of ``scan_texts`` where there are some."""
    return "_near_years" if "_near_years" in df.columns else "description"

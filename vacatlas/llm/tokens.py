"""Token counts and token ids of whole texts by a tokenizer file.

Each distinct piece between safe cuts is encoded once per batch and looked up from then on. Where a cut is safe is
read off the tokenizer's own file:

* byte-level pre-tokenizer with its usual pattern and no normalizer: before a blank that follows a non-blank, since
  a blank there opens a token and no token holds a blank inside. The blank stays with the piece it opens.
* pre-tokenizer that keeps only matches of a pattern without blanks: at ASCII white space, which is in no token.
  NFC does not compose across it, and lower-casing goes by single characters.
* any other file: texts are encoded whole.

Special strings hold no blank, so they are never cut and are found as the library finds them.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from .common import bounded, record, texts

#: Pieces kept with their ids by a worker, and characters cut into pieces at once.
KEPT_PIECES, SEGMENT = 500_000, 1 << 20
BLANK_INSIDE = re.compile(r"(?<=\S) ")
#: A blank that opens a text or follows white space, of any kind, in the syntax of Arrow's patterns.
UNSAFE_BLANK = (
    r"(?:\A|[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]) "
)


def segments(text: str, size: int = SEGMENT) -> Iterator[str]:
    """Parts of a long text of about ``size`` characters, each but the first opening with the blank of a safe cut."""
    start = 0
    while len(text) - start > size and (cut := BLANK_INSIDE.search(text, start + size)):
        yield text[start:cut.start()]
        start = cut.start()
    yield text[start:] if start else text


def _style(path: str) -> str:
    if not path.endswith(".json"):
        return "whole"
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    parts = before.get("pretokenizers", [before])
    if before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"] and not normal:
        return "lead"
    kinds = {x["type"] for x in (normal or {}).get("normalizers", [normal] if normal else [])}
    first = parts[0]
    if (
        first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"]
        and kinds <= {"NFC", "Replace", "Lowercase"} and all(x["type"] == "ByteLevel" for x in parts[1:])
    ):
        return "drop"
    return "whole"


def _library(path: str):
    if path.endswith(".model"):
        import sentencepiece

        return sentencepiece.SentencePieceProcessor(model_file=path)
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tool = Tokenizer.from_file(path)
    tool.no_truncation()
    tool.no_padding()
    return tool


class Encoder:
    """Values of pieces, id bytes or counts; ``known`` holds those met before, by the piece without its blank."""

    def __init__(self, path: str, value: Callable[[bytes], object], kept: int | None = None):
        self.style, self.tool, self.value, self.kept = _style(path), _library(path), value, kept
        self.known: dict = {}
        if self.style == "lead":
            spelled = {i: len(token) for token, i in self.tool.get_vocab().items()}
            spelled |= {i: len(t.content.encode()) for i, t in self.tool.get_added_tokens_decoder().items()}
            self.spelled = np.array([spelled.get(i, 0) for i in range(max(spelled) + 1)])

    def whole(self, item: str) -> bytes:
        """Ids of one text as the library gives them."""
        if self.style == "whole" and not hasattr(self.tool, "encode_batch_fast"):
            return np.asarray(self.tool.encode(item), "<u4").tobytes()
        return np.asarray(self.tool.encode_batch_fast([item], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def _together(self, pieces: list[str]) -> None:
        """Learn pieces in joined texts, which are then taken apart: by the bytes of tokens, or by their places."""
        groups = [pieces[start:start + 64] for start in range(0, len(pieces), 64)]
        sizes = pc.binary_length(pa.array(pieces, pa.string())) if self.style == "lead" else pc.utf8_length(pa.array(pieces, pa.string()))
        ends = np.cumsum(np.asarray(sizes, np.int64) + 1)
        if self.style == "lead":
            found = self.tool.encode_batch_fast([" " + " ".join(own) for own in groups], add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(one.ids for one in found), "<u4")
            cuts = np.searchsorted(np.cumsum(self.spelled[ids]), ends, "right")
        else:
            found = self.tool.encode_batch([" ".join(own) for own in groups], add_special_tokens=False)
            ids = np.fromiter(chain.from_iterable(one.ids for one in found), "<u4")
            counts = [len(one.ids) for one in found]
            places = np.fromiter((place for one in found for place, _ in one.offsets), np.int64, len(ids))
            froms = np.concatenate([[0], ends])[64 * np.arange(len(groups))]  # where each joined text begins in all of them
            cuts = np.searchsorted(places + np.repeat(froms, counts), ends, "left")
        data, cuts = ids.tobytes(), (4 * cuts).tolist()
        value = self.value
        self.known.update(zip(pieces, [value(data[a:b]) for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))

    def _learn(self, missing: list) -> None:
        if self.style == "lead":  # the last piece of a text may end in white space, which binds to what follows
            own = [x for x in missing if not x or x[-1].isspace()]
            if own:
                self.known.update(zip(own, map(self.value, self._apart([" " + x for x in own])), strict=True))
                missing = [x for x in missing if x and not x[-1].isspace()]
        elif "" in missing:  # what white space at an end leaves
            missing = [x for x in missing if x]
            self.known[""] = self.value(b"")
        for start in range(0, len(missing), 4096):
            self._together(missing[start:start + 4096])

    def _apart(self, items: list[str]) -> list[bytes]:
        """Ids of each item on its own."""
        found = self.tool.encode_batch_fast(items, add_special_tokens=False) if items else []
        return [np.asarray(one.ids, "<u4").tobytes() for one in found]

    def _values(self, pieces: list[str]) -> list:
        """The value of each distinct piece; those not known are learnt."""
        values = list(map(self.known.get, pieces))
        gaps = [i for i, value in enumerate(values) if value is None]
        if gaps:
            if len(self.known) + len(gaps) > (self.kept or KEPT_PIECES):  # go on with what this batch needs
                self.known = {p: v for p, v in zip(pieces, values, strict=True) if v is not None}
            self._learn([pieces[i] for i in gaps])
            for i in gaps:
                values[i] = self.known[pieces[i]]
        return values

    def _cut(self, items: pa.Array) -> pa.Array:
        """The pieces of each text between safe cuts."""
        if self.style == "drop":
            return pc.ascii_split_whitespace(items)
        unsafe = pc.match_substring_regex(items, UNSAFE_BLANK)
        if not pc.any(unsafe).as_py():
            return pc.split_pattern(items, " ")
        safe = pc.split_pattern(items.filter(pc.invert(unsafe)), " ")
        rest = pa.array([BLANK_INSIDE.split(x) for x in items.filter(unsafe).to_pylist()], safe.type)
        order = np.argsort(unsafe.to_numpy(zero_copy_only=False), kind="stable")
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return pa.concat_arrays([safe, rest]).take(pa.array(back))

    def coded(self, items: pa.Array) -> tuple[list, np.ndarray, np.ndarray]:
        """Distinct values, the place among them of each piece of all texts in order, and where each text's pieces end.

        A batch's distinct pieces are looked up, not each of its pieces.
        """
        lists = self._cut(items)
        ends = np.asarray(lists.offsets, np.int64)
        flat, ends = lists.values.slice(ends[0], ends[-1] - ends[0]), ends[1:] - ends[0]
        if self.style == "drop":
            names = flat.dictionary_encode()
            return self._values(names.dictionary.to_pylist()), names.indices.to_numpy(), ends
        starts = np.concatenate([[0], ends[:-1]]).astype(np.int64) if len(ends) else ends
        later = np.ones(len(flat), bool)
        later[starts] = False  # a text's first piece has no blank before it
        names = flat.filter(pa.array(later)).dictionary_encode()
        firsts = flat.take(pa.array(starts)).dictionary_encode()
        values = self._values(names.dictionary.to_pylist())
        places = np.empty(len(flat), np.int64)
        places[later] = names.indices.to_numpy()
        places[starts] = len(values) + firsts.indices.to_numpy()
        return values + list(map(self.value, self._apart(firsts.dictionary.to_pylist()))), places, ends


def _size(ids: bytes) -> int:
    return len(ids) // 4


@lru_cache(maxsize=4)
def encoder(path: str, counts: bool, kept: int | None = None) -> Encoder:
    """One per worker process."""
    return Encoder(path, _size if counts else bytes, kept)


def _parts(tool: Encoder, items: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The texts, those longer than a segment in parts, and where each text's parts end."""
    longest = pc.max(pc.utf8_length(items)).as_py() or 0
    if tool.style == "whole" or longest <= SEGMENT:
        return items, np.arange(1, len(items) + 1)
    cut = [list(segments(x)) for x in items.to_pylist()]
    return pa.array([x for own in cut for x in own], pa.string()), np.cumsum([len(own) for own in cut])


def _texts(items: pa.Array | list[str]) -> pa.Array:
    if isinstance(items, pa.ChunkedArray):
        items = items.combine_chunks()
    return items if isinstance(items, pa.Array) else pa.array(items, pa.string())


def _last(totals: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """What running totals come to at each end."""
    return np.concatenate([[0], totals])[ends]


def count_tokens(path: str, items: pa.Array | list[str]) -> list[int]:
    """Tokens of each text."""
    tool, items = encoder(path, True), _texts(items)
    if tool.style == "whole":
        return [_size(tool.whole(x)) for x in items.to_pylist()]
    parts, whole = _parts(tool, items)
    values, places, ends = tool.coded(parts)
    at = _last(np.cumsum(np.array([*values, 0], np.int64)[places]), _last(ends, whole))
    return np.diff(at, prepend=0).tolist()


def encode_ids(path: str, items: pa.Array | list[str], kept: int | None = None) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers. A worker keeps ``kept`` pieces with their ids."""
    tool, items = encoder(path, False, kept), _texts(items)
    if tool.style == "whole":
        return [tool.whole(x) for x in items.to_pylist()]
    parts, whole = _parts(tool, items)
    values, places, ends = tool.coded(parts)
    ids = np.frombuffer(b"".join(values), "<u4")
    sizes = np.array([len(v) // 4 for v in [*values, b""]], np.int64)
    froms = np.cumsum(sizes) - sizes
    n = sizes[places]
    totals = np.cumsum(n)
    # each piece's ids are copied from where they lie once: the place of an id is its piece's start and its own number
    at = np.repeat((froms[places] - totals + n).astype(np.int32 if len(ids) + len(n) < 1 << 30 else np.int64), n)
    at += np.arange(len(at), dtype=at.dtype)
    data = ids[at].tobytes()
    edges = 4 * np.concatenate([[0], _last(totals, _last(ends, whole))])
    return [data[a:b] for a, b in zip(edges.tolist(), edges[1:].tolist(), strict=False)]


COUNTED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])


def token_counts(
    docs: DataFrame, path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Bytes and tokens of every whole text, and whether the tokens exceed ``limit``.

    One row per row of ``docs``, repeated rows included; other columns are not read. Only lengths leave the function
    that encodes. Null and empty texts have 0 bytes and 0 tokens; a null id stays null. An empty table gives none.
    """

    def count(batches):
        for batch in bounded(batches):
            n = count_tokens(path, batch.column("text"))
            size = pc.binary_length(batch.column("text"))
            yield record(COUNTED, {
                "doc_id": batch.column("id"), "n_bytes": size.cast(pa.int64()), "n_tokens": n,
                "over_limit": [x > limit for x in n],
            })

    return texts(docs, id_col, text_col).mapInArrow(count, "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")

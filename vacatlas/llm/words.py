"""Words and word shingles of texts, by hash."""

from __future__ import annotations

import numpy as np
from xxhash import xxh3_64_intdigest

#: Lower-cases A-Z only.
FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))


def mixed(x: np.ndarray) -> np.ndarray:
    """A one-to-one scramble of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def folded(text: str | None) -> list[bytes]:
    """Words between ASCII blanks, A-Z in lower case; none for null."""
    return (text or "").encode().translate(FOLD).split()


def named(words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """The names of all words in a row, and where each text starts, with the end."""
    starts = np.concatenate([[0], np.cumsum([len(own) for own in words])]).astype(np.int64)
    return np.fromiter((xxh3_64_intdigest(w) for own in words for w in own), np.uint64, starts[-1]), starts


def _chain(names: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    out = np.full(len(at), width, np.uint64)
    for j in range(width):
        out = mixed(out * _A + names[at + j])
    return out


def shingles(names: np.ndarray, starts: np.ndarray, width: int, short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(value, text) of every shingle in order; with ``short`` a text of fewer words, if any, is one shingle."""
    sizes = np.diff(starts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(names))
    at = at[at + width <= starts[1:][text]] if len(at) else at
    values, owners = [_chain(names, at, width)], [text[at]]
    if short:
        for n in np.unique(sizes[(sizes > 0) & (sizes < width)]).tolist():
            own = np.flatnonzero(sizes == n)
            values.append(_chain(names, starts[own], n))
            owners.append(own)
    return np.concatenate(values), np.concatenate(owners)


def distinct(values: np.ndarray, owners: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct values in ascending order, in a row, and where each text's start."""
    order = np.lexsort((values, owners))
    values, owners = values[order], owners[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    values, owners = values[keep], owners[keep]
    return values, np.searchsorted(owners, np.arange(n + 1))

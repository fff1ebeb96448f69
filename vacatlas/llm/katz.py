"""Katz backoff bigram scores of whole texts.

A count above zero is discounted by Good-Turing; what a context saves goes to the tokens not seen after it, in
proportion to their lower-order probability, so each context sums to one exactly.

Counts move in packed form. A batch of texts sends each distinct n-gram once, as sorted 64-bit names cut by their top
bits, with its own training count; a range of names adds up all batches, which is the stored model table, and answers
each batch with bare numbers in the order it asked. So an n-gram that every text holds costs one entry per batch, and a
range's size does not depend on any n-gram. Contexts are summed over distinct bigrams by letting one batch, the first
that trains on a bigram, own it.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_64_intdigest

from .batches import cuts, held, numbered, opened, pack, pack_names, ranges_for, unpack, unpack_names
from .common import stored, texts
from .words import folded, mixed, named

#: Bytes of text in a batch and for each range of names; counts up to this are discounted by Good-Turing, larger ones
#: by this much of one count, so that every context can back off.
BATCH_BYTES, RANGE_BYTES, LARGEST, SLIGHT = 6 << 20, 4 << 20, 5, 0.01
#: Names of the end token and of the start context; no word holds a blank.
END, START = (np.uint64(xxh3_64_intdigest(x)) for x in (b" end", b" start"))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def held_out(ids: list[int | None], folds: int, fold: int) -> np.ndarray:
    return np.array([i is not None and zlib.crc32(str(i).encode()) % folds == fold for i in ids], bool)


class Tokens:
    """Tokens of a batch with the end of each text, their contexts, and the distinct names of both orders."""

    def __init__(self, items: list[str], held: np.ndarray):
        names, starts = named([folded(x) for x in items])
        self.sizes = np.diff(starts) + 1
        self.text = np.repeat(np.arange(len(items)), self.sizes)
        self.token = np.insert(names, starts[1:], END)
        self.first = np.cumsum(self.sizes) - self.sizes
        context = np.empty_like(self.token)
        context[1:] = self.token[:-1]
        context[self.first] = START
        self.train = ~held[self.text] if len(items) else np.empty(0, bool)
        n = len(self.token)
        self.words, at = np.unique(np.concatenate([self.token, context[self.first]]), return_inverse=True)
        self.at, start = at[:n], at[n:]
        self.context = np.empty(n, np.int64)
        self.context[1:] = self.at[:-1]
        self.context[self.first] = start
        self.word_counts = np.bincount(self.at, self.train, len(self.words)).astype(np.int64)
        if len(start):  # the start context counts training texts
            self.word_counts[start[0]] = int((~held).sum())
        self.asked = np.bincount(self.context, ~self.train, len(self.words)) > 0
        self.pairs, self.one, self.pair_at = np.unique(mixed(context * _MIX + self.token), return_index=True, return_inverse=True)
        self.pair_counts = np.bincount(self.pair_at, self.train, len(self.pairs)).astype(np.int64)


REQUEST = "part bigint, batch bigint, names_ binary, counts binary, flags binary"


def _requests(rows: DataFrame, ranges: int, folds: int, fold: int) -> DataFrame:
    """A row per batch, order and range of names; part is twice the range, plus the order less one."""
    def emit(batches):
        for number, batch in numbered(batches, BATCH_BYTES):
            t = Tokens(batch.column("text").to_pylist(), held_out(batch.column("id").to_pylist(), folds, fold))
            out: list[tuple] = []
            for order, names, counts, flags in (
                (0, t.words, t.word_counts, t.asked), (1, t.pairs, t.pair_counts, np.zeros(len(t.pairs), bool))
            ):
                for r, own in cuts(names, ranges):
                    out.append((
                        2 * r + order, number, pack_names(names[own]), pack(counts[own].astype("<u4")), pack(np.packbits(flags[own]))
                    ))
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["part", "batch", "names_", "counts", "flags"])

    return rows.mapInArrow(emit, REQUEST)


ANSWER = pa.schema([
    ("kind", pa.string()), ("part", pa.int64()), ("batch", pa.int64()), ("names_", pa.binary()), ("counts", pa.binary()),
    ("flags", pa.binary()), ("tokens", pa.int64()), ("types", pa.int64()), ("of_counts", pa.list_(pa.int64())),
])
ANSWER_DDL = (
    "kind string, part bigint, batch bigint, names_ binary, counts binary, flags binary, tokens bigint, types bigint, "
    "of_counts array<bigint>"
)


def _answers(table: pa.Table) -> pa.Table:
    """A range of names: its model row, and one row for each batch that asked, in the order it asked."""
    names = [unpack_names(x) for x in table.column("names_").to_pylist()]
    counts = [unpack(x, "<u4").astype(np.int64) for x in table.column("counts").to_pylist()]
    asked = [np.unpackbits(unpack(x, np.uint8), count=len(n)) for x, n in zip(table.column("flags").to_pylist(), names, strict=True)]
    batches = table.column("batch").to_numpy()
    sizes = [len(n) for n in names]
    flat, at = np.unique(np.concatenate(names), return_inverse=True)
    own, owner = np.concatenate(counts), np.repeat(batches, sizes)
    total = np.bincount(at, own, len(flat)).astype(np.int64)
    wanted = np.bincount(at, np.concatenate(asked), len(flat)) > 0
    least = np.full(len(flat), np.iinfo(np.int64).max)
    trained = own > 0
    np.minimum.at(least, at[trained], owner[trained])
    flags = (owner == least[at]) + 2 * wanted[at].astype(np.uint8)
    part, seen = table.column("part")[0].as_py(), total > 0
    counted = seen & (flat != START) if part % 2 == 0 else seen
    rows = [(
        "model", part, None, pack_names(flat[seen]), pack(total[seen]), None, int(total[counted].sum()), int(counted.sum()),
        np.bincount(np.minimum(total[counted], LARGEST + 2), minlength=LARGEST + 3)[1:LARGEST + 2].tolist(),
    )]
    cut = np.cumsum([0, *sizes])
    for i, batch in enumerate(batches.tolist()):
        mine = slice(cut[i], cut[i + 1])
        rows.append(("answer", part, batch, None, pack(total[at[mine]]), pack(flags[mine].astype(np.uint8)), None, None, None))
    return pa.table([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ANSWER, strict=True)], schema=ANSWER)


def discounts(of_counts: list[int], largest: int = LARGEST) -> np.ndarray:
    """Good-Turing factor of each count 0..largest; of_counts: types of each count 1..largest+1.

    Katz's factors where they all lie between 0 and 1. Copied texts make types of count 2 so many that they do not;
    then the numbers of types are smoothed by a line in logarithms, as in simple Good-Turing, of slope -1.1 at most.
    """
    n = np.array(of_counts, np.float64)
    c = np.arange(1, largest + 1)
    if (n > 0).all():
        common = (largest + 1) * n[largest] / n[0]
        if common < 1:
            katz = ((c + 1) * n[1:] / (c * n[:-1]) - common) / (1 - common)
            if ((katz > 0) & (katz < 1)).all():
                return np.concatenate([[0.0], katz])
    at = np.flatnonzero(n)
    slope = np.polyfit(np.log(at + 1), np.log(n[at]), 1)[0] if len(at) > 1 else -2.0
    return np.concatenate([[0.0], (1 + 1 / c) ** (min(slope, -1.1) + 1)])


@dataclass
class Model:
    """Totals of the training texts and the discounts of both orders."""

    tokens: int
    types: int
    low: np.ndarray
    high: np.ndarray
    saved: float

    @classmethod
    def of(cls, rows: list) -> "Model":
        found = {r.order: r for r in rows}
        word, pair = found.get(0), found.get(1)
        zero = [0] * (LARGEST + 1)
        n, of_counts = (word.tokens, list(word.of_counts)) if word else (0, zero)
        low, high = discounts(of_counts), discounts(list(pair.of_counts) if pair else zero)
        counts = np.arange(1, LARGEST + 1)
        small = np.array(of_counts[:LARGEST])
        large = (word.types if word else 0) - small.sum()
        saved = float((small * counts * (1 - low[1:])).sum() + SLIGHT * large)
        return cls(n, word.types if word else 0, low, high, saved)

    @staticmethod
    def discounted(counts: np.ndarray, factors: np.ndarray) -> np.ndarray:
        small = counts <= LARGEST
        return np.where(small, counts * factors[np.where(small, counts, 0)], counts - SLIGHT)

    def lower(self, counts: np.ndarray) -> np.ndarray:
        """Probability of single tokens; all unknown ones are one type, which has what the known ones save."""
        if not self.tokens:
            return np.ones(len(counts))
        return np.where(counts > 0, self.discounted(counts, self.low), self.saved) / self.tokens


SCORED = pa.schema([
    ("batch", pa.int64()), ("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
    ("base_score", pa.float64()), ("score", pa.float64()), ("unseen", pa.list_(pa.int64())),
    ("context", pa.int64()), ("total", pa.int64()), ("mass", pa.float64()), ("below", pa.float64()),
])
SCORED_DDL = (
    "batch bigint, row bigint, doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double, "
    "unseen array<bigint>, context bigint, total bigint, mass double, below double"
)


def _scored(ids: list, items: list[str], answers: list[tuple[np.ndarray, np.ndarray]], batch: int, model: Model, folds: int, fold: int) -> pa.Table:
    """Rows of a batch: its texts, scored but for the weights of contexts where a token is unseen, which they list;
    then, for contexts some held-out text asks for, the parts of their sums over the bigrams that this batch owns."""
    held = held_out(ids, folds, fold)
    t = Tokens(items, held)
    (counts, flags), (pair_counts, pair_flags) = answers
    if len(counts) != len(t.words) or len(pair_counts) != len(t.pairs):
        raise RuntimeError("the texts were read in another order than before")
    n, count = len(items), counts[t.at]
    lower = model.lower(counts)
    seen = pair_counts[t.pair_at]
    found = seen > 0
    context = np.maximum(counts[t.context], 1)
    p = np.where(found, model.discounted(seen, model.high) / context, lower[t.at])
    scores = np.bincount(t.text, np.log10(p), n)
    base = np.bincount(t.text, np.log10((count + 1) / (model.tokens + model.types + 1)), n)
    unseen = np.flatnonzero(~found & (counts[t.context] > 0))
    cut = np.searchsorted(t.text[unseen], np.arange(n + 1)).astype(np.int32)
    texts_ = {
        "batch": np.full(n, batch), "row": np.arange(n), "doc_id": pa.array(ids, pa.int64()), "held_out": held, "n_tokens": t.sizes,
        "n_known": np.bincount(t.text, count > 0, n).astype(np.int64), "base_score": base, "score": scores,
        "unseen": pa.ListArray.from_arrays(cut, t.words[t.context[unseen]].view(np.int64)),
    }
    at = t.one  # one occurrence of each distinct bigram
    use = ((pair_flags & 1) == 1) & (pair_counts > 0) & ((flags[t.context[at]] & 2) == 2)
    c, w = t.context[at][use], t.at[at][use]
    mass = np.bincount(c, model.discounted(pair_counts[use], model.high), len(t.words))
    below = np.bincount(c, lower[w], len(t.words))
    own = np.flatnonzero(np.bincount(c, minlength=len(t.words)))
    sums = {"context": t.words[own].view(np.int64), "total": counts[own], "mass": mass[own], "below": below[own]}
    return pa.concat_tables([
        pa.table([pa.array(part[f.name], f.type) if f.name in part else pa.nulls(size, f.type) for f in SCORED], schema=SCORED)
        for part, size in ((texts_, n), (sums, len(own)))
    ])


def katz_scores(
    docs: DataFrame, folds: int = 7, fold: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    The model learns from rows whose crc32(id as text) mod ``folds`` is not ``fold``. Tokens are words between ASCII
    blanks, A-Z in lower case, and one end; the first one follows a start. ``score`` is the log10 probability of the
    tokens under the backoff model, ``base_score`` under add-one single counts with one unknown type. Null and empty
    texts are the end alone; a row without an id trains and keeps its null; repeated rows count each. With no
    training text every token has probability one in ``score``. An empty table gives none. Other columns are not read.
    """
    rows = texts(docs, id_col, text_col)
    ranges = ranges_for(rows, RANGE_BYTES, 16)
    answered = stored(_requests(rows, ranges, folds, fold).groupBy("part").applyInArrow(_answers, ANSWER_DDL), "ngrams")
    order = F.col("part") % 2
    model = Model.of(
        answered.where("kind = 'model'").groupBy(order.cast("int").alias("order")).agg(
            F.sum("tokens").alias("tokens"), F.sum("types").alias("types"),
            F.array(*(F.sum(F.col("of_counts")[i]) for i in range(LARGEST + 1))).alias("of_counts"),
        ).collect()
    )

    def score(mine: pa.Table, answers: pa.Table) -> pa.Table:
        number, table = opened(mine)
        answers = answers.sort_by("part")
        parts = answers.column("part").to_numpy()
        pairs = list(zip(answers.column("counts").to_pylist(), answers.column("flags").to_pylist(), strict=True))
        got = []
        for which in (0, 1):
            own = [pairs[i] for i in np.flatnonzero(parts % 2 == which)]
            got.append((
                np.concatenate([unpack(a, "<i8") for a, _ in own]), np.concatenate([unpack(b, np.uint8) for _, b in own])
            ))
        return _scored(
            table.column("id").to_pylist(), table.column("text").to_pylist(), got, number, model, folds, fold
        )

    asked = answered.where("kind = 'answer'").select("part", "batch", "counts", "flags")
    scored = stored(held(rows, BATCH_BYTES).groupBy("batch").cogroup(asked.groupBy("batch")).applyInArrow(score, SCORED_DDL), "scored")
    sums = scored.where("context is not null").groupBy("context").agg(
        F.max("total").alias("total"), F.sum("mass").alias("mass"), F.sum("below").alias("below")
    )
    weights = sums.select("context", F.log10((1 - F.col("mass") / F.col("total")) / (1 - F.col("below"))).alias("weight"))
    texts_ = scored.where("row is not null")
    backed = (
        texts_.select("batch", "row", F.explode("unseen").alias("context"))
        .groupBy("batch", "row", "context").agg(F.count("*").alias("times"))
        .join(weights, "context").groupBy("batch", "row").agg(F.sum(F.col("times") * F.col("weight")).alias("backed"))
    )
    return texts_.join(backed, ["batch", "row"], "left").select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("bigint").alias("train_tokens"), "base_score",
        (F.col("score") + F.coalesce("backed", F.lit(0.0))).alias("score"),
    )

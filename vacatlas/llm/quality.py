"""Quality of a text by a convolutional network over its bytes, in numpy.

A text is covered by overlapping chunks. Learned filters slide over the embedded bytes of a chunk and are max-pooled;
a dense layer makes hidden features of each chunk; their maximum and mean over all chunks of the text are combined
into one probability. The last chunk ends with the text, so no byte is left out; short texts are filled with zeros.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded, crc_text, record, texts

CHUNK, STEP, WIDTH, STRIDE = 512, 448, 8, 4
EMBED, FILTERS, HIDDEN = 8, 32, 16
#: Labelled rows that the network is fitted on, chosen by hashed id; all chunks of each are.
SAMPLE_ROWS = 3000
#: Steps of fitting, texts in a step, chunks of them that are held under the filters at once, and the first rate.
STEPS, BATCH, HELD, RATE = 400, 64, 1024, 5e-3


def chunk_starts(n: int) -> np.ndarray:
    """Where the chunks of a text of ``n`` bytes start."""
    last = max(0, n - CHUNK)
    return np.append(np.arange(0, last, STEP), last)


def chunks(data: bytes) -> np.ndarray:
    """The chunks of a text, one row each."""
    flat = np.frombuffer(data.ljust(CHUNK, b"\0"), np.uint8)
    return np.lib.stride_tricks.sliding_window_view(flat, CHUNK)[chunk_starts(len(data))]


def initial(seed: int) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(np.float32)

    inputs = WIDTH * EMBED
    return {
        "embed": normal(256, EMBED, scale=0.5), "filters": normal(inputs, FILTERS, scale=inputs**-0.5),
        "bias": np.zeros(FILTERS, np.float32), "dense": normal(FILTERS, HIDDEN, scale=FILTERS**-0.5),
        "dense_bias": np.zeros(HIDDEN, np.float32), "out": normal(2 * HIDDEN, scale=HIDDEN**-0.5),
        "out_bias": np.zeros(1, np.float32),
    }


def _windows(model: dict, rows: np.ndarray) -> np.ndarray:
    """(chunks, places, inputs): the embedded bytes under the filters at each place."""
    embedded = model["embed"][rows].reshape(len(rows), -1)
    view = np.lib.stride_tricks.sliding_window_view(embedded, WIDTH * EMBED, axis=1)[:, ::STRIDE * EMBED]
    return np.ascontiguousarray(view)


def _features(model: dict, rows: np.ndarray, step: int = 128) -> np.ndarray:
    """Max-pooled filters of each chunk."""
    out = np.empty((len(rows), FILTERS), np.float32)
    for a in range(0, len(rows), step):
        part = _windows(model, rows[a:a + step])
        out[a:a + step] = (part.reshape(-1, part.shape[2]) @ model["filters"]).reshape(*part.shape[:2], -1).max(1)
    return out + model["bias"]


def scores(model: dict, items: list[bytes]) -> np.ndarray:
    """Probability of each whole text."""
    if not items:
        return np.empty(0)
    parts = [chunks(item) for item in items]
    hidden = np.concatenate([_features(model, part) for part in _grouped(parts)])
    hidden = np.maximum(np.maximum(hidden, 0) @ model["dense"] + model["dense_bias"], 0)
    first = np.cumsum([0, *map(len, parts[:-1])])
    pooled = np.hstack([
        np.maximum.reduceat(hidden, first), np.add.reduceat(hidden, first) / np.array([len(p) for p in parts])[:, None]
    ])
    logits = pooled.astype(np.float64) @ model["out"] + model["out_bias"]
    return 1 / (1 + np.exp(-np.clip(logits, -30, 30)))


def _grouped(parts: list[np.ndarray], limit: int = 1024):
    """The same chunks in arrays of a bounded number of rows."""
    held, n = [], 0
    for part in parts:
        for a in range(0, len(part), limit):
            held.append(part[a:a + limit])
            n += len(held[-1])
            if n >= limit:
                yield np.concatenate(held)
                held, n = [], 0
    if held:
        yield np.concatenate(held)


def _under_filters(model: dict, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The inputs under the filters at each place of each chunk, each filter's best place, and its value there."""
    windows = _windows(model, rows)
    found = (windows.reshape(-1, windows.shape[2]) @ model["filters"]).reshape(*windows.shape[:2], -1)
    best = found.argmax(1)
    return windows, best, np.take_along_axis(found, best[:, None], 1)[:, 0] + model["bias"]


def _gradients(model: dict, parts: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of the mean weighted loss of some texts, given as their chunks.

    Chunks go under the filters ``HELD`` at a time, so memory does not grow with the texts: first for the hidden features,
    from which texts are pooled, then once more for the gradients.
    """
    rows = np.concatenate(parts)
    sizes = np.array([len(p) for p in parts])
    text, first = np.repeat(np.arange(len(parts)), sizes), np.cumsum(sizes) - sizes
    held = [slice(a, a + HELD) for a in range(0, len(rows), HELD)]
    kept = [_under_filters(model, rows)] if len(held) == 1 else None
    raw = np.concatenate([(kept[0] if kept else _under_filters(model, rows[own]))[2] for own in held])
    z = np.maximum(raw, 0)
    pre = z @ model["dense"] + model["dense_bias"]
    hidden = np.maximum(pre, 0)
    top, mean = np.maximum.reduceat(hidden, first), np.add.reduceat(hidden, first) / sizes[:, None]
    pooled = np.hstack([top, mean])
    p = 1 / (1 + np.exp(-np.clip(pooled @ model["out"] + model["out_bias"], -30, 30)))
    d_logit = ((p - labels) * weights / len(parts)).astype(np.float32)
    d_pooled = d_logit[:, None] * model["out"]
    d_hidden = d_pooled[text, HIDDEN:] / sizes[text, None] + d_pooled[text, :HIDDEN] * (hidden == top[text])
    d_pre = d_hidden * (pre > 0)
    d_raw = (d_pre @ model["dense"].T) * (raw > 0)
    d_embed, d_filters = np.zeros((256, EMBED)), np.zeros(model["filters"].shape)
    for own in held:
        windows, best, _ = kept[0] if kept else _under_filters(model, rows[own])
        under = windows[np.arange(len(windows))[:, None], best]  # (chunks, filters, inputs)
        d_inputs = (d_raw[own][:, :, None] * model["filters"].T).reshape(-1, EMBED)
        places = best[:, :, None] * STRIDE + np.arange(WIDTH)
        at = rows[own][np.arange(len(windows))[:, None, None], places].ravel()
        d_embed += np.stack([np.bincount(at, d_inputs[:, k], 256) for k in range(EMBED)], axis=1)
        d_filters += np.einsum("cf,cfi->if", d_raw[own], under)
    return {
        "embed": d_embed, "filters": d_filters, "bias": d_raw.sum(0),
        "dense": z.T @ d_pre, "dense_bias": d_pre.sum(0), "out": pooled.T @ d_logit, "out_bias": d_logit.sum(keepdims=True),
    }


def fit(parts: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 1) -> dict[str, np.ndarray]:
    """Fit by Adam on the logistic loss, both classes weighing the same in part. Without both classes the network
    keeps its first filters and answers with the share of label 1, or one half without any label."""
    model = initial(seed)
    share = float(labels.mean()) if len(labels) else 0.5
    if not len(labels) or not 0 < share < 1:
        model["out"][:] = 0
        model["out_bias"][:] = np.log((share + 1e-3) / (1 - share + 1e-3))
        return model
    weights = np.where(labels == 1, 1, min(4.0, share / (1 - share)))
    one, two = ({k: np.zeros_like(v) for k, v in model.items()} for _ in range(2))
    rng = np.random.default_rng(seed)
    order = np.concatenate([rng.permutation(len(parts)) for _ in range(-(-steps * BATCH // len(parts)))])
    for t in range(1, steps + 1):
        own = order[(t - 1) * BATCH:t * BATCH]
        rate = RATE * (1 - (t - 1) / steps)
        for k, g in _gradients(model, [parts[i] for i in own], labels[own], weights[own]).items():
            one[k] = 0.9 * one[k] + 0.1 * g
            two[k] = 0.999 * two[k] + 0.001 * g * g
            step = (one[k] / (1 - 0.9**t)) / (np.sqrt(two[k] / (1 - 0.999**t)) + 1e-7)
            model[k] = (model[k] - rate * step).astype(np.float32)
    return model


def train(
    docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, held_out: int = 0,
    sample_rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", seed: int = 1,
) -> dict[str, np.ndarray]:
    """Fit on at most ``sample_rows`` labelled rows whose crc32(id as text) mod ``folds`` is not ``held_out``.

    The rows are those of the least hashed ids, so the choice does not depend on how the table is cut. Null labels
    and ids are left out; of several labels for one id the least counts, and of several texts the least, so that no more
    than ``sample_rows`` texts are collected, whole. Null texts are empty. Without any row see ``fit``.
    """
    chosen = (
        labels.select(F.col(id_col).cast("bigint").alias("id"), F.col(label_col).cast("int").alias("label"))
        .where("id is not null and label in (0, 1)").where(crc_text("id") % folds != held_out)
        .groupBy("id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("id"), "id").limit(sample_rows)
    )

    rows = (
        texts(docs, id_col, text_col).join(F.broadcast(chosen), "id")  # at most sample_rows pairs of numbers
        .groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text")).toPandas().sort_values("id")
    )
    return fit([chunks(text.encode()) for text in rows["text"]], rows["label"].to_numpy(), seed=seed)


SCORED = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])


def quality_scores(
    docs: DataFrame, model: dict[str, np.ndarray], threshold: float = 0.3, folds: int = 5, held_out: int = 0,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """doc_id, held_out, score and predicted of every whole text, one row per row of ``docs``.

    Only the text is an input of the score; null and empty texts are one chunk of zeros. A null id stays null and is
    not held out. An empty table gives none; other columns are not read.
    """

    def score(batches):
        for batch in bounded(batches, limit=4 << 20):
            found = scores(model, [x.encode() for x in batch.column("text").to_pylist()])
            yield record(SCORED, {"doc_id": batch.column("id"), "score": found})

    found = texts(docs, id_col, text_col).mapInArrow(score, "doc_id bigint, score double")
    return found.select(
        "doc_id", F.coalesce(crc_text("doc_id") % folds == held_out, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= threshold, 1).otherwise(0).alias("predicted"),
    )


def keep_quality(docs: DataFrame, model: dict[str, np.ndarray], threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text scores at least ``threshold``, all columns as they are.

    Null and empty texts are one chunk of zeros and stay or go by its score; repeated rows stay or go together, and an
    empty table stays empty.
    """
    schema = docs.schema

    def keep(batches):
        for batch in bounded(batches, text_col, 4 << 20):
            found = scores(model, [(x or "").encode() for x in batch.column(text_col).to_pylist()])
            yield batch.filter(pa.array(found >= threshold))

    return docs.mapInArrow(keep, schema)

import zlib
from collections import Counter, defaultdict
from math import log10

import numpy as np
import pytest

from vacatlas.llm import batches, katz, quality
from vacatlas.llm.words import folded

TEXTS = ["the cat sat on the mat", "The dog sat", "", None, "a  b\nc a b", "the cat sat on the mat", "unknown words here", "the " * 400]


def documents(spark, texts=TEXTS):
    rows = [(i, t, "c") for i, t in enumerate(texts * 6)] + [(None, "no id", "c")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, score string")


def brute_katz(rows):
    words = [[*folded(t), b" end"] for _, t in rows]
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows]
    one, two, after = Counter(), Counter(), defaultdict(set)
    for own, out in zip(words, held, strict=True):
        if not out:
            one.update(own)
            for h, w in zip([b" start", *own], own, strict=False):
                two[h, w] += 1
                after[h].add(w)
    n, total = sum(one.values()), Counter()
    for (h, _), c in two.items():
        total[h] += c
    counts = [[Counter(x.values())[c] for c in range(1, katz.LARGEST + 2)] for x in (one, two)]
    low, high = map(katz.discounts, counts)

    def cut(c, factors):
        return c * factors[c] if c <= katz.LARGEST else c - katz.SLIGHT

    saved = 1 - sum(cut(c, low) for c in one.values()) / n

    def lower(w):
        return cut(one[w], low) / n if one[w] else saved

    def backoff(h):
        return (1 - sum(cut(two[h, w], high) for w in after[h]) / total[h]) / (1 - sum(map(lower, after[h])))

    def prob(h, w):
        if two[h, w]:
            return cut(two[h, w], high) / total[h]
        return (backoff(h) if total[h] else 1) * lower(w)

    for h in [*after, b"never"]:  # every context sums to one
        rest = 0 if h == b"never" else backoff(h) * saved
        assert sum(prob(h, w) for w in one) + (rest or saved) == pytest.approx(1)
    out = []
    for (key, _), own, held_out in zip(rows, words, held, strict=True):
        base = sum(log10((one[w] + 1) / (n + len(one) + 1)) for w in own)
        score = sum(log10(prob(h, w)) for h, w in zip([b" start", *own], own, strict=False))
        out.append((key, held_out, len(own), sum(one[w] > 0 for w in own), n, pytest.approx(base), pytest.approx(score)))
    return out


def test_katz_equals_brute_force(spark):
    df = documents(spark).repartition(3, "doc_id")
    df = spark.createDataFrame(df.collect(), df.schema)
    found = sorted(map(tuple, katz.katz_scores(df).collect()), key=str)
    want = brute_katz([(r.doc_id, r.text) for r in df.collect()])
    assert len(found) == len(want)
    for got, expected in zip(found, sorted(want, key=lambda x: str(x[0])), strict=False):
        assert any(got == w for w in want if w[0] == got[0]), (got, expected)


def test_katz_of_more_than_128_partitions(spark):
    rows = [(r.doc_id, r.text) for r in documents(spark).collect()]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 147), "doc_id bigint, text string")
    found = [tuple(r) for r in katz.katz_scores(df).collect()]
    want = brute_katz(rows)
    assert len(found) == len(want) and all(any(w == got for got in found) for w in want)
    assert all(any(w == got for w in want) for got in found)


def test_katz_of_empty_tables(spark):
    assert katz.katz_scores(documents(spark).limit(0)).count() == 0
    only = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = spark.createDataFrame([(only, "held out")], "doc_id bigint, text string")
    assert tuple(katz.katz_scores(alone).first())[:5] == (only, True, 3, 0, 0)


def test_discounts():
    assert katz.discounts([100, 30, 15, 9, 6, 4])[1] < 1
    for of_counts in ([5, 50, 3, 9, 1, 0], [0] * 6, [7, 0, 0, 0, 0, 0], [100, 40, 20, 12, 8, 6]):
        found = katz.discounts(of_counts)
        assert (found[1:] > 0).all() and (found[1:] < 1).all()


def test_packed_names_and_keys():
    rng = np.random.default_rng(0)
    for n in (0, 1, 1000):
        names = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
        assert (batches.unpack_names(batches.pack_names(names)) == names).all()
        cut = [own for _, own in batches.cuts(names, 16)]
        assert sum(x.stop - x.start for x in cut) == len(names)
    first, second = np.array([3, 1, 3, 3], np.uint64), np.array([1, 1, 2, 1], np.uint64)
    keys = batches.Keys(first, second)
    assert keys.first.tolist() == [1, 3, 3] and keys.at.tolist() == [1, 0, 2, 1] and keys.counts.tolist() == [1, 2, 1]


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 1000, 5000):
        data = np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8).tobytes()
        parts = quality.chunks(data)
        assert parts.shape[1] == quality.CHUNK
        starts = quality.chunk_starts(n)
        covered = {i for s in starts for i in range(s, s + quality.CHUNK)}
        assert covered >= set(range(n)) and len(parts) == len(starts)


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(1)
    model = {k: v.astype(np.float64) for k, v in quality.initial(3).items()}
    parts = [rng.integers(0, 256, (k, quality.CHUNK), dtype=np.uint8) for k in (1, 3)]
    labels, weights = np.array([0, 1]), np.array([1.0, 2.0])

    def loss():
        p = quality.scores({k: v for k, v in model.items()}, [])
        hidden = [np.maximum(np.maximum(quality._features(model, x), 0) @ model["dense"] + model["dense_bias"], 0) for x in parts]
        pooled = np.array([np.concatenate([h.max(0), h.mean(0)]) for h in hidden])
        p = 1 / (1 + np.exp(-(pooled @ model["out"] + model["out_bias"])))
        return float((-(labels * np.log(p) + (1 - labels) * np.log(1 - p)) * weights).mean())

    found = quality._gradients(model, parts, labels, weights)
    for name in ("out", "dense", "filters", "out_bias"):
        at = np.unravel_index(np.abs(found[name]).argmax(), found[name].shape)
        old = model[name][at]
        model[name][at] = old + 1e-3
        up = loss()
        model[name][at] = old - 1e-3
        down = loss()
        model[name][at] = old
        assert found[name][at] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-4)


def plain_score(model, data):
    """The network by loops over chunks, places, filters and bytes."""
    data = data.ljust(quality.CHUNK, b"\0")
    starts = list(range(0, len(data) - quality.CHUNK, quality.STEP)) + [len(data) - quality.CHUNK]
    hidden = []
    for start in starts:
        chunk, best = data[start:start + quality.CHUNK], [-np.inf] * quality.FILTERS
        for place in range(0, quality.CHUNK - quality.WIDTH + 1, quality.STRIDE):
            inputs = np.concatenate([model["embed"][byte] for byte in chunk[place:place + quality.WIDTH]]).astype(float)
            for f in range(quality.FILTERS):
                best[f] = max(best[f], sum(inputs * model["filters"][:, f]) + model["bias"][f])
        z = [max(0.0, x) for x in best]
        hidden.append([max(0.0, sum(z[f] * model["dense"][f, h] for f in range(quality.FILTERS)) + model["dense_bias"][h]) for h in range(quality.HIDDEN)])
    pooled = [max(column) for column in zip(*hidden, strict=True)] + [sum(column) / len(column) for column in zip(*hidden, strict=True)]
    logit = sum(x * w for x, w in zip(pooled, model["out"], strict=True)) + model["out_bias"][0]
    return 1 / (1 + np.exp(-logit))


def test_scores_equal_plain_loops():
    rng = np.random.default_rng(8)
    model = {k: (v + rng.normal(0, 0.05, v.shape)).astype(np.float32) for k, v in quality.initial(4).items()}
    items = [b"", b"a", "é" .encode() * 200, rng.integers(0, 256, 512, dtype=np.uint8).tobytes(), rng.integers(0, 256, 1500, dtype=np.uint8).tobytes()]
    found = quality.scores(model, items)
    assert found == pytest.approx([plain_score(model, item) for item in items], abs=1e-4)
    assert quality.scores(model, items[::-1])[::-1] == pytest.approx(found, abs=1e-6)


def test_gradients_do_not_depend_on_the_chunks_held(monkeypatch):
    rng = np.random.default_rng(5)
    model = quality.initial(2)
    parts = [rng.integers(0, 256, (k, quality.CHUNK), dtype=np.uint8) for k in (1, 7, 2)]
    labels, weights = np.array([0, 1, 1]), np.array([1.0, 2.0, 0.5])
    whole = quality._gradients(model, parts, labels, weights)
    monkeypatch.setattr(quality, "HELD", 3)
    split = quality._gradients(model, parts, labels, weights)
    for name in whole:
        assert np.allclose(whole[name], split[name], rtol=1e-3, atol=1e-6), name


def test_one_text_of_an_id_is_fitted_on(spark, monkeypatch):
    """Of several texts of one id the least is taken, whole, however many rows the id has."""
    seen = {}
    monkeypatch.setattr(quality, "fit", lambda parts, labels, **_: seen.update(parts=parts, labels=labels))
    long = "long text " * 2000
    rows = [(1, "b"), (1, "a"), (1, "a"), (2, None), (2, "z"), (3, long)] + [(4, "hot")] * 50
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in (1, 2, 3, 4)] + [(1, 0)], "doc_id bigint, quality int")
    quality.train(docs, labels, held_out=9)
    assert [bytes(p[0][:4]).rstrip(b"\0") for p in seen["parts"]] == [b"a", b"", b"long", b"hot"]
    assert seen["labels"].tolist() == [0, 1, 1, 1] and len(seen["parts"][2]) == len(quality.chunk_starts(len(long)))


def test_quality_tells_junk_from_prose(spark):
    rng = np.random.default_rng(2)
    words = ["river", "stone", "walks", "the", "of", "under", "a", "bright", "morning", "sleeps"]
    good = [" ".join(rng.choice(words, 80)) + "." for _ in range(150)]
    bad = [" ".join(w.upper() + "!!" for w in rng.choice(words, 80)) for _ in range(150)]
    docs = spark.createDataFrame(
        [(i, t, "junk") for i, t in enumerate(good + bad)] + [(900, None, ""), (901, "", ""), (None, good[0], ""), (902, good[0] * 300, "")],
        "doc_id bigint, text string, quality string",
    )
    labels = spark.createDataFrame([(i, int(i < 150)) for i in range(300)] + [(None, 1), (5, None), (3, 1)], "doc_id bigint, quality int")
    model = quality.train(docs, labels)
    found = quality.quality_scores(docs, model).collect()
    assert len(found) == 304 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)
    held = [r for r in found if r.held_out and r.doc_id < 300]
    assert held and all(r.predicted == (r.doc_id < 150) for r in held)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    kept = quality.keep_quality(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in found if r.predicted}
    assert quality.quality_scores(docs.limit(0), model).count() == 0
    for few in (labels.limit(0), labels.where("quality = 1")):
        share = {r.score for r in quality.quality_scores(docs.limit(3), quality.train(docs, few)).collect()}
        assert len(share) == 1 and 0 < share.pop() < 1

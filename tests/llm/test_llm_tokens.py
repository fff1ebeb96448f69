import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from vacatlas.llm import packing, tokenfile, tokens

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
PARTS = [
    " ", "  ", "\n", "a", "B", "é", "é", "́", " ́", "12", "'s", "!!", "\t", "\xa0", "　", "\x1c", "\x85",
    "<|endoftext|>", "<|startoftext|>", "Σς", "İ", "​", "中文", "😀", "\r\n", "\x00", "word", "The",
]


def fuzz(n=3000, seed=3):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) for _ in range(rng.randint(0, 14))) for _ in range(n)] + ["", " ", "\n"]


def plain(path, items):
    return [e.ids for e in Tokenizer.from_file(path).encode_batch(items, add_special_tokens=False)]


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_pieces_give_the_ids_of_whole_texts(path, monkeypatch):
    items = fuzz()
    want = plain(path, items)
    assert tokens.count_tokens(path, items) == [len(x) for x in want]
    assert tokens.encode_ids(path, items) == [np.asarray(x, "<u4").tobytes() for x in want]
    long = ["".join(fuzz(200, seed)) for seed in range(5)]
    monkeypatch.setattr(tokens, "SEGMENT", 100)  # long texts are cut, and small tables of pieces renewed
    monkeypatch.setattr(tokens, "KEPT_PIECES", 50)
    assert tokens.count_tokens(path, long) == [len(x) for x in plain(path, long)]


def test_other_tokenizers_encode_whole_texts():
    path = public_tokenizers.path("piece_bpe_32k.model")
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert tokens.count_tokens(path, ["Hello  world", ""]) == [len(model.encode("Hello  world")), 0]


def edge(spark):
    """Nulls in each column, empty and long texts, a repeated row, and columns of clashing names."""
    rows = [
        (5, "The cat sat. " * 900, 1, "x"), (1, None, 2, None), (2, "", 3, "y"), (None, "no id here", 4, "z"),
        (3, "a b c", 5, "x"), (3, "a b c", 5, "x"), (4, " \n ", 6, "x"),
    ]
    return spark.createDataFrame(rows, "doc_id bigint, text string, n_tokens int, start string")


def test_counts_of_edge_cases(spark):
    found = sorted((r.doc_id or -1, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(edge(spark), WORD).collect())
    want = []
    for r in edge(spark).collect():
        n = len(plain(WORD, [r.text or ""])[0])
        want.append((r.doc_id or -1, len((r.text or "").encode()), n, n > 2048))
    assert found == sorted(want)
    assert tokens.token_counts(edge(spark).limit(0), WORD).count() == 0


def test_token_files_round_trip(spark, tmp_path):
    path = str(tmp_path / "t")
    tokenfile.write_tokens(edge(spark), path, BYTE, file_bytes=60)
    found = tokenfile.read_tokens(spark, path, with_ids=True).orderBy("start").collect()
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in edge(spark).collect()))
    at = 0
    for got, (known, key, text) in zip(found, rows, strict=True):
        ids = np.asarray([*plain(BYTE, [text])[0], 2], "<u4")
        assert (got.doc_id, got.start, got.n_tokens) == (key if known else None, at, len(ids))
        assert bytes(got.ids) == ids.tobytes() and got.ids_crc32 == zlib.crc32(ids.tobytes())
        at += len(ids)
    assert spark.read.format("binaryFile").load(f"{path}/data").count() > 1


def test_token_files_of_an_empty_table_and_damage(spark, tmp_path):
    tokenfile.write_tokens(edge(spark).limit(0), str(tmp_path / "none"), BYTE)
    assert tokenfile.read_tokens(spark, str(tmp_path / "none")).count() == 0
    data = tokenfile.build_file(0, 0, b"k" * 32, []) + b"\n"
    with pytest.raises(ValueError, match="another dictionary"):
        tokenfile.TokenFile(data, b"12345678")
    with pytest.raises(ValueError, match="whole"):
        tokenfile.TokenFile(data[:-1], b"12345678")
    assert struct.calcsize(tokenfile.HEAD) == tokenfile.HEAD_BYTES and struct.calcsize(tokenfile.FOOT) == tokenfile.FOOT_BYTES


def brute_first_fit(lengths, room):
    bins, out = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((b for b, free in enumerate(bins) if free >= lengths[i]), len(bins))
        if at == len(bins):
            bins.append(room)
        out[i] = at, room - bins[at]
        bins[at] -= lengths[i]
    return [out[i] for i in range(len(lengths))]


def test_tournament_equals_first_fit_decreasing():
    rng = np.random.default_rng(0)
    for n in (0, 1, 2, 50, 300):
        lengths = rng.integers(1, 65, n)
        bins, places = packing.first_fit_decreasing(lengths, 64)
        assert list(zip(bins.tolist(), places.tolist(), strict=True)) == brute_first_fit(lengths.tolist(), 64)


def test_packing_of_edge_cases(spark):
    found = packing.pack(edge(spark), BYTE, capacity=64, group_pieces=8).toPandas()
    want = sorted(len(plain(BYTE, [r.text or ""])[0]) + 1 for r in edge(spark).collect())
    whole = found[found["start"] == 0].doc_tokens
    assert sorted(whole) == want and found.length.sum() == sum(want)
    for _, own in found.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == (own.length.cumsum() - own.length).tolist()
        n = own.length.sum()
        assert n <= 64 and set(own.padded) == {n if n & (n - 1) == 0 else 64}
    assert packing.pack(edge(spark).limit(0), BYTE).count() == 0

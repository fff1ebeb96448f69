import random
import re

import pytest

from vacatlas.dictionaries import SKILLS
from vacatlas.operators import dictionary as D, enrich as E


def plain_counts(text, words):
    return {w: text.count(w) for w in words if w in text}


def test_ten_thousand_keywords_equal_plain_searches(spark):
    rng = random.Random(1)
    syllables = ["an", "el", "or", "ti", "ka", "mo", "ru", "é", "ß", "x1", "-", " "]
    words = sorted({"".join(rng.choice(syllables) for _ in range(rng.randint(2, 6))) for _ in range(30_000)})
    words = [w for w in words if len(w) > 3][:10_000]
    assert len(words) == 10_000
    texts = ["".join(rng.choice([*syllables, "ÉL", "An"]) for _ in range(rng.randint(0, 300))) for _ in range(60)] + [None, "", "aaaa" * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, description string").repartition(3)
    found = {r.id: {h.word: h.n for h in r.hits} for r in D.keyword_hits(df, "description", [*words, "aaaa", "aaaa", ""]).collect()}
    for i, text in enumerate(texts):
        assert found[i] == plain_counts((text or "").lower(), [*words, "aaaa"]), i
    order = {w: i for i, w in enumerate(words)}
    for r in D.keyword_hits(df, "description", words).collect():
        assert [order[h.word] for h in r.hits] == sorted(order[h.word] for h in r.hits)


@pytest.mark.parametrize("word_boundary", [False, True])
def test_the_automaton_finds_what_the_expressions_find(spark, word_boundary, monkeypatch):
    rng = random.Random(2)
    words = [w for own in SKILLS.values() for w in own]
    pieces = [*words, "r", "R&D", "go", "going", "c++", "c++x", "_sql", "sql.", "ai", "aid", "é", "x", "/", ",", "."]
    texts = [rng.choice(["", " "]).join(rng.choice(pieces) for _ in range(rng.randint(0, 12))) for _ in range(300)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, description string").repartition(4)
    plain = {r.id: r.key_skills for r in E.extract_skills(df, word_boundary=word_boundary).collect()}
    monkeypatch.setattr(E, "MOST_PLAIN", 0)
    assert {r.id: r.key_skills for r in E.extract_skills(df, word_boundary=word_boundary).collect()} == plain
    assert sum(map(len, plain.values())) > 300


def test_first_of_many(spark):
    entries = {"New York": "ny", "York": "y", "new": "n", "Paris": "p"}
    df = spark.createDataFrame([(0, "in NEW YORK city"), (1, "york, new"), (2, "Parish"), (3, None), (4, "new")], "id int, location string")
    found = {r.id: r.place for r in D.first_of_many(df, "location", entries, "place", "none").collect()}
    assert found == {0: "ny", 1: "y", 2: "p", 3: "none", 4: "n"}


def test_words_are_whole_as_patterns_say():
    scanner = D.Scanner(["c++", "r", "go", "long word"])
    for text in ["c++", "c++x", "xc++x", "r", "a r b", "ar", "r2", "go_", "go-go", "long words", "r&r"]:
        expected = {w: len(re.findall(rf"\b{re.escape(w)}\b", text)) for w in ("c++", "r", "go")}
        expected["long word"] = text.count("long word")
        got = {scanner.words[p]: n for p, n in scanner.counts(text).items()}
        assert got == {w: n for w, n in expected.items() if n}, text
    assert D.Scanner([]).counts("text") == {}

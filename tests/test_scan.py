import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vacatlas.catalog.queries import QUERIES
from vacatlas.catalog.tables import postings
from vacatlas.dictionaries import CATEGORIES, SKILLS
from vacatlas.functions import patterns as P
from vacatlas.operators import enrich as E, scan as S
from vacatlas.operators.facts import with_scores
from vacatlas.plans.process import process
from conftest import SMALL

KEYWORDS = sorted({w for own in (*SKILLS.values(), *CATEGORIES.values()) for w in own})
PIECES = [
    *KEYWORDS, *(w.upper() for w in KEYWORDS[::7]), "r", "R&D", "go", "c++x", "ärger r", "é", "日本", "𝐱", "_", "ſ", "İ", "K", "ß", "Σ",
    "<b>", "</b>", "<", ">", "<>", "<a\nb>", "<é >", " ", "  ", "\n", "\t", "\x1c", "\x85", "\xa0", " ", " ", "　", "​",
    "healthealth", "recommenderecommender", "years", "Year", "yearſ", "of experience", "exp", "relevant", "3", "10", "٣", "-", "–", "to",
    "TO", "+", "minimum", "mın", "min", "at least", "at  least", "5-7 years of experience", "2 to 4 years exp", ".", ",", "/", "-", ";",
    "tototo" * 20, "1" * 70, "99999999999 years experience",
]


def texts(seed, many):
    rng = random.Random(seed)
    return [rng.choice(["", " "]).join(rng.choice(PIECES) for _ in range(rng.randint(0, 30))) for _ in range(many)] + [None, "", " ", "<a>", "\n"]


def test_scanned_texts_equal_the_expressions(spark):
    df = spark.createDataFrame(list(enumerate(texts(1, 3000))), "id int, description string").repartition(4)
    plain = with_scores(E.extract_skills(E.extract_years(E.clean_text(df))))
    found = E.extract_years(S.scan_texts(df, *S.KINDS)).drop("_near_years")
    assert set(found.columns) == set(plain.columns)
    expected = {r.id: r.asDict() for r in plain.collect()}
    for row in found.collect():
        assert row.asDict() == expected[row.id], row.id
    assert sum(len(r["key_skills"]) for r in expected.values()) > 3000 and sum(r["yoe_max"] is not None for r in expected.values()) > 100


@pytest.mark.parametrize("size", [1, 50])
def test_slices_do_not_change_what_is_found(monkeypatch, size):
    given = pa.array(texts(2, 200), pa.string())
    reader = S.Reader(S.KINDS, CATEGORIES, SKILLS)
    whole = [a.to_pylist() for a in reader.read(given)]
    parts = [[a.to_pylist() for a in reader.read(given.slice(i, size))] for i in range(0, len(given), size)]
    assert [sum((part[k] for part in parts), []) for k in range(len(S.KINDS))] == whole
    monkeypatch.setattr(S, "HASHED", 7)
    assert [a.to_pylist() for a in reader.read(given)] == whole


def test_other_dictionaries(spark):
    skills = {"a": ["é", "über", "x", "日本語", "aa", "aaaa", "c#", "x y", "", "über"], "b": [], "c": ["x", "ab\ncd", "K"]}
    given = ["É ÜBER x", "日本語 x y aa", "aaaaa c# c#s", "ab\ncd K", "K k", "xé éx", "x́", "𝐱x x𝐱", None]
    df = spark.createDataFrame(list(enumerate(given)), "id int, description string")
    cleaned = E.clean_text(df)
    expected = {r.id: r.key_skills for r in E.extract_skills(cleaned, {"a": skills["a"][:8], "b": [], "c": ["x", "ab\ncd", "K"]}).collect()}
    found = S.scan_texts(df, "skills", skills={"a": skills["a"][:8], "b": [], "c": ["x", "ab\ncd", "K"]})
    assert {r.id: r.key_skills for r in found.collect()} == expected
    counted = {"a": ["é", "aa", "x"], "b": ["aa", "日本語"]}
    expected = {r.id: r._scores for r in with_scores(cleaned, counted).collect()}
    assert {r.id: r._scores for r in S.scan_texts(df, "scores", categories=counted).collect()} == expected


def test_columns_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "u", "<p>5 years exp</p>", 2.0)], "id bigint, url string, description string, pay double")
    kept = S.scan_texts(df, "years")
    assert kept.columns == ["id", "url", "pay", "_near_years"]
    assert E.extract_years(kept).select("id", "pay", "yoe_min").collect() == [(1, 2.0, 5)]
    assert S.scan_texts(df.limit(0), *S.KINDS).count() == 0


def test_excerpts_are_short():
    data, ends = S.plain(*S.joined(pa.array(["x" * 5000 + " 3-5 years of experience " + "y" * 5000])))
    assert S.excerpts(data, ends)[0].strip().startswith("3-5 years of experience") and len(S.excerpts(data, ends)[0]) < 60


def test_market_queries_read_their_texts_in_one_scan(spark):
    """Keywords are not searched one by one over the whole text, and cleaning is no pattern over it."""
    for name in ("top_skills", "skills_long", "cluster_labels"):
        text = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert "large language model" not in text and "<[^>]+>" not in text, name


def test_places_are_found_below_the_scan(spark):
    """Above it they would be compiled together with the counting, which takes gigabytes of the compiler's memory."""
    rows = process(postings(spark, SMALL), read=["years"]).select("region", "state", "latitude", "yoe_min")
    lines = rows._jdf.queryExecution().optimizedPlan().toString().splitlines()
    scan = next(i for i, line in enumerate(lines) if "MapInArrow" in line)
    assert not any("brooklyn" in line.lower() for line in lines[:scan]) and any("brooklyn" in line.lower() for line in lines[scan:])


def test_self_overlap():
    assert S.apart(np.array([0, 5, 10, 20]), 6).tolist() == [0, 10, 20]
    finder = S.Finder({"health": False})
    data, ends = S.joined(pa.array(["healthealth health"]))
    assert [at.tolist() for _, at in finder.find(data)] == [[0, 5, 12]]

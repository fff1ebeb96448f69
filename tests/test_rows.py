import random
import re

import pytest
from pyspark.sql import functions as F

from vacatlas.functions import text as X
from vacatlas.operators import clustering as C, enrich as E, gazetteer
from vacatlas.operators.dedup import dedup
from vacatlas.dictionaries import CITY_COORDINATES
from vacatlas.plans.process import describe


def postings(spark, rows):
    return spark.createDataFrame(rows, "posting_id bigint, title string, company string, location string, url string")


def test_dedup_keeps_first_by_key_then_first_by_url(spark):
    df = postings(spark, [
        (1, "DS", "A", "NYC", "u1"), (2, "DS", "A", "NYC", "u2"), (3, "MLE", "B", "SF", "u2"),
        (4, "RS", "C", "SF", "u1"), (5, " DS", "A", "NYC", "u3"), (6, None, None, None, None),
        (7, None, None, None, "u4"), (8, "X", None, None, None),
    ])
    # 2 goes with the key of 1, so its url does not take 3 along; 8 shares the null url of 6.
    assert sorted(r.posting_id for r in dedup(df).collect()) == [1, 3, 5, 6]
    assert sorted(r.posting_id for r in dedup(df, clean_first=True).collect()) == [1, 3, 6]


def test_dedup_on_the_columns_there_are(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b")], "posting_id int, title string")
    assert dedup(df).count() == 2
    assert dedup(df.drop("title")).count() == 3
    assert dedup(df.limit(0)).count() == 0


def test_dedup_drops_rows_before_the_join_that_adds_the_texts(spark):
    orders = spark.createDataFrame([(1, "a", 7), (2, "a", 7), (3, "b", 8), (None, "c", 8)], "id bigint, title string, doc int")
    texts = spark.createDataFrame([(7, "x"), (8, "y")], "doc int, text string")
    df = orders.join(texts, "doc").select(
        F.col("id").alias("posting_id"), F.upper("title").alias("title"),
        F.concat(F.lit("<p>"), "text", F.lit("</p>")).alias("description"),
    )
    kept = dedup(df)
    lines = kept._jdf.queryExecution().optimizedPlan().toString().splitlines()
    depth = {kind: min(line.index("Join") for line in lines if f"Join {kind}" in line) for kind in ("Inner", "LeftSemi")}
    assert depth["LeftSemi"] > depth["Inner"]
    assert sorted(r.description for r in kept.collect()) == ["<p>x</p>", "<p>y</p>"]


def test_dedup_of_a_hot_key(spark):
    df = spark.range(3000).select(
        F.col("id").alias("posting_id"),
        F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("company"), F.lit(None).cast("string").alias("location"),
        F.when(F.col("id") % 2 == 0, F.lit(None)).otherwise(F.col("id").cast("string")).alias("url"),
    )
    # hot titles leave id 0; of the even ids, whose url is null, the first survivor stays
    odd = sum(1 for i in range(3000) if i % 2 == 1 and i % 3 != 0)
    assert dedup(df).count() == odd + 1


def test_clean_text(spark):
    df = spark.createDataFrame(
        [("  Data ", None, None, "<p>Build <b>ML</b>\n\n models</p> x &amp;")],
        "title string, company string, location string, description string",
    )
    assert tuple(E.clean_text(df).first()) == ("Data", "Unknown", "", "Build ML models x &amp;")
    assert E.clean_text(df.select("title")).columns == ["title"]


def test_geocode_takes_the_first_city_of_the_dictionary(one):
    places = ["New York, NY", "Brooklyn, New York", "Spokane, Washington", "SINGAPORE", "ZZZZZ Unknown Place", None]
    lat = one(places, "location", E.geocode, "latitude")
    assert lat == [40.7128, 40.7128, 38.9072, 1.3521, None, None]


def test_gazetteer_table_agrees_with_the_chain(spark):
    rows = [(i, c, *p) for i, (c, p) in enumerate(CITY_COORDINATES.items())]
    cities = spark.createDataFrame(rows, "ordinal int, city string, latitude double, longitude double")
    texts = [(c.upper() + " and " + d,) for c in CITY_COORDINATES for d in ("newark", "x", "Boston")] + [(None,), ("",)]
    df = spark.createDataFrame(texts, "location string")
    ours = gazetteer.match_dictionary(df, "location", cities, "city", "ordinal", ["latitude", "longitude"])
    chain = E.geocode(df)
    assert sorted(map(str, ours.collect())) == sorted(map(str, chain.collect()))


def test_region_and_state(one):
    regions = one(["New York, NY", "san jose", "Chicago, IL", None], "location", E.assign_region, "region")
    assert regions == ["Greater NYC", "SF Bay Area", "Other", "Other"]
    places = ["new york", "Seattle, WA", "Dallas, TX", "Nowhere"]
    assert one(places, "location", E.assign_state, "state") == ["NY", "WA", None, None]
    strict = one(places, "location", lambda d: E.assign_state(d, case_fold=False), "state")
    assert strict == ["NY", "WA", "TX", None]


@pytest.mark.parametrize(
    "text, low, high",
    [
        ("3-5 years of experience", 3, 5), ("2 to 4 years experience", 2, 4), ("5+ years of experience", 5, None),
        ("minimum 3 years", 3, None), ("at least 2 years", 2, None), ("Great company culture", None, None),
        ("We need someone with 3-5 years of experience in ML", 3, 5), ("5+ years.", None, None),
        ("8+ years of experience or 4-6 years experience", 4, 6), ("10 – 12 Years of Exp", 10, 12),
        ("10 years relevant", 10, None), (None, None, None),
    ],
)
def test_years(spark, text, low, high):
    df = spark.createDataFrame([(text,)], "description string")
    row = E.extract_years(df).first()
    assert (row.yoe_min, row.yoe_max) == (low, high)


def test_salaries(one):
    pay = ["150000", "75", "8000", None, "nan", "$150,000", "$120k", "1_000", "-5", "12.5 an hour", "negotiable", ""]
    found = one(pay, "salary_max", E.normalize_salaries, "salary_max_annual")
    assert found == [150000, 156000, 96000, None, None, 150000, 249600, 12000, -10400, 26000, None, None]
    assert one(pay[:1], "salary_max", E.normalize_salaries, "salary_min_annual") == [None]


def test_skills(one):
    texts = ["Must know Python and SQL", "trust JavaScript", "C++, c++11", "C++, R", "storage; A/B testing, an LLM", ""]
    assert one(texts, "description", E.extract_skills, "key_skills") == [
        {"languages": ["python", "sql"]},
        {"languages": ["java", "javascript", "rust"]},
        {"languages": ["c++"]},
        {"languages": ["r"]},
        {"techniques": ["a/b testing", "llm"]},
        {},
    ]
    bounded = one(texts[1:2], "description", lambda d: E.extract_skills(d, word_boundary=True), "key_skills")
    assert bounded == [{"languages": ["javascript"]}]


def test_summary(one):
    sentences = [
        "Our office is near the river.", "Each machine learning and sql release is yours, with python.",
        "Bring python and sql to the interview.", "Deep learning and nlp fill the week.",
        "Lunch is on the house.", "Start in the spring.",
    ]
    plain = [f"This sentence says little, number {i}." for i in range(5)]
    found = one(["Short.", " ".join(sentences), " ".join(plain), None], "description", E.summarize, "summary")
    # Scores are keywords times 1 to 2 by position; equal scores go to the later sentence.
    assert found == ["Short.", " ".join(sentences[1:4]), " ".join(plain[2:]), ""]


def items(text):
    found = re.findall(r"[-•]\s*(.{20,150}?)(?=[-•\n]|$)", text, re.M)
    found += re.findall(r"\d+\.\s*(.{20,150}?)(?=\d+\.|$)", text, re.M)
    return [i for i in dict.fromkeys(f.strip() for f in found) if len(i) > 20]


def test_responsibilities_against_brute_force(one):
    rng = random.Random(7)
    pieces = ["- ", "• ", "1. ", "22.", "\n", "design systems", "a-b", " ", "x" * 19, "lead the team of analysts ", "é – ö", "\r"]
    texts = ["".join(rng.choice(pieces) for _ in range(rng.randint(0, 40))) for _ in range(300)]
    found = one(texts, "description", E.extract_responsibilities, "responsibilities")
    assert found == [items(t) for t in texts]


def test_descriptions_keep_the_first_ten_items(spark):
    text = "".join(f"- item number {i} of the long list of duties\n" for i in range(14))
    df = spark.createDataFrame([(1, text)], "posting_id int, description string")
    assert len(describe(df).first().responsibilities) == 10 and len(describe(df, None).first().responsibilities) == 14


def test_title_words(spark):
    df = spark.createDataFrame(
        [(0, "Data Scientist"), (0, "Senior Data Scientist"), (0, "Data Scientist II"), (0, "A/B-test Lead"), (1, "VP"), (1, None)],
        "cluster_id int, title string",
    )
    assert [tuple(r) for r in C.title_words(df, "cluster_id").collect()] == [(0, "Data Scientist A/B-Test")]


def test_small_expressions(spark):
    row = spark.range(1).select(
        X.usd(F.lit(12345.5)).alias("usd"), X.decimal(F.lit(1234.25)).alias("one"), X.decimal(F.lit(2.5), 0).alias("even"),
        X.percent(F.lit(12.34)).alias("pct"), X.label_part(F.lit("HUB: a: b")).alias("label"),
        X.body_part(F.lit("HUB: a: b")).alias("body"), X.body_part(F.lit("none")).alias("all"),
        X.slug(F.lit("A-B/C d")).alias("slug"), X.display_name(F.lit("ml_frameworks")).alias("name"),
        X.clip(F.lit(25), 0, 20).alias("clip"), X.clip(F.lit(None).cast("int"), 0, 20).alias("null"),
        X.run_date(F.lit("2024-01-05 10:00:00").cast("timestamp")).alias("date"),
    ).first()
    assert tuple(row) == (
        "$12,346", "1234.2", "2", "12.3%", "HUB", "a: b", "none", "a-b_c_d", "Ml Frameworks", 20, None, "2024-01-05",
    )


def test_a_stated_minimum_folds_cases_as_before(one):
    texts = ["mın 3 years", "MİN 4 years", "aT leaſt 5 YEARS", "MINIMUM 6 year", "no minimum", "x at  least 7 years"]
    assert one(texts, "description", E.extract_years, "yoe_min") == [3, 4, 5, 6, None, 7]

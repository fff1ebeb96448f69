import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from vacatlas.functions.quantiles import quantiles
from vacatlas.operators import advice, aggregates as A, sketches
from vacatlas.operators.facts import facts, kept_facts
from vacatlas.plans import report


@pytest.fixture(scope="module")
def frame():
    rng = np.random.default_rng(3)
    n = 4000
    salary = np.where(rng.random(n) < 0.35, 120000.0, np.round(rng.normal(150000, 40000, n), 2))
    return pd.DataFrame({
        "title": "T", "company": rng.choice([f"C{i}" for i in range(60)], n),
        "region": rng.choice(["Other", "Singapore", "Greater NYC", "LA Area"], n, p=[0.4, 0.1, 0.3, 0.2]),
        "state": rng.choice(["NY", "CA", None], n), "cluster_label": rng.choice(["A/B", "NLP", "X y", "Q", "Z"], n),
        "salary_max_annual": np.where(rng.random(n) < 0.3, np.nan, salary), "salary_min_annual": salary - 5000,
        "yoe_min": [None if x < 0 else float(x) for x in rng.integers(-5, 26, n)],
        "latitude": 1.5, "longitude": np.where(rng.random(n) < 0.5, np.nan, 3.25),
    })


@pytest.fixture(scope="module")
def market(spark, frame):
    schema = (
        "title string, company string, region string, state string, cluster_label string, salary_max_annual double, "
        "salary_min_annual double, yoe_min double, latitude double, longitude double"
    )
    rows = frame.astype(object).where(frame.notna(), None).values.tolist()
    df = spark.createDataFrame(rows, schema).withColumn(
        "key_skills", F.expr("map('languages', array('python', 'go'), 'cloud', array('aws'))")
    )
    return df.repartition(5).persist()


PROBABILITIES = {"p10": 0.1, "p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p0": 0.0, "p100": 1.0}


def test_quantiles_are_exact_on_hot_and_odd_values(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([np.full(2000, 7.0), rng.normal(0, 1e6, 2000), rng.normal(0, 1e-3, 500), [0.0, -1e12, 1e300]])
    pdf = pd.DataFrame({"k": rng.choice(list("ab"), len(values)), "v": values})
    pdf = pd.concat([pdf, pd.DataFrame({"k": ["c", "d"], "v": [5.0, np.nan]})])
    rows = [(k, None if np.isnan(v) else float(v)) for k, v in pdf.values]
    counts = spark.createDataFrame(rows, "k string, v double").groupBy("k", "v").agg(F.count("*").alias("n"))
    found = quantiles(counts, ["k"], "v", "n", PROBABILITIES).toPandas().set_index("k").sort_index()
    expected = pdf.dropna().groupby("k").v.quantile(list(PROBABILITIES.values())).unstack()
    assert list(found.index) == ["a", "b", "c"]
    assert np.allclose(found.values.astype(float), expected.values, rtol=1e-12)


def test_kpis(market, frame):
    row = A.kpis(market).first()
    assert (row.postings, row.companies, row.regions, row.categories) == (4000, 60, 4, 5)
    assert row.median_salary == pytest.approx(frame.salary_max_annual.median())
    assert row.median_yoe == frame.yoe_min.astype(float).median()


def test_nothing_in_nothing_out(market):
    empty = market.where("false")
    row = A.kpis(empty).first()
    assert (row.postings, row.companies, row.median_salary) == (0, 0, None)
    for table in (A.region_stats, A.cluster_summary, A.category_counts, A.salary_benchmarks, A.histogram):
        assert table(empty).count() == 0
    assert A.yoe_histogram(empty).count() == 21
    assert A.region_counts(market.select("title")).count() == 0
    assert A.skill_frequency(market.select("title")).count() == 0
    assert [r.label for r in advice.suggestions(empty).collect()] == advice.GENERAL


def test_counts(market, frame):
    got = {r.region: r.n for r in A.region_counts(market).collect()}
    assert got == frame[frame.region != "Other"].region.value_counts().to_dict()
    first = A.top_companies(market, 3).collect()
    expected = frame.company.value_counts().reset_index().sort_values(["count", "company"], ascending=[False, True])
    assert [(r.company, r.n) for r in first] == list(map(tuple, expected.head(3).values))
    shares = A.category_share(market).agg(F.sum("share")).first()[0]
    assert shares == pytest.approx(1.0)


def test_cluster_summary(market, frame):
    rows = {r.cluster: r for r in A.cluster_summary(market).collect()}
    part = frame[frame.cluster_label == "NLP"]
    assert rows["NLP"]["count"] == len(part)
    assert rows["NLP"].avg_salary_max == pytest.approx(part.salary_max_annual.mean())
    assert rows["NLP"].avg_yoe == pytest.approx(part.yoe_min.astype(float).mean())
    top = part.region.value_counts().head(3)
    assert rows["NLP"].top_regions == ", ".join(f"{r} ({n})" for r, n in top.items())


def test_box_stats(market, frame):
    rows = {r.key: r for r in A.box_stats(market, "salary_region", with_other=False).collect()}
    assert "Other" not in rows
    x = frame[frame.region == "Singapore"].salary_max_annual.dropna()
    q1, q3 = x.quantile(0.25), x.quantile(0.75)
    inside = x[(x >= q1 - 1.5 * (q3 - q1)) & (x <= q3 + 1.5 * (q3 - q1))]
    row = rows["Singapore"]
    assert (row.rows, row.outliers) == (len(x), len(x) - len(inside))
    assert (row.whisker_low, row.whisker_high, row.q1) == pytest.approx((inside.min(), inside.max(), q1))
    few = market.where("salary_max_annual is not null").limit(4)
    assert A.box_stats(few, "salary_region").count() == 0


def test_experience(market, frame):
    years = frame.yoe_min.dropna().astype(float)
    bands = A.yoe_bands(market).first()
    assert (bands.entry, bands.mid, bands.senior) == ((years <= 2).sum(), ((years > 2) & (years <= 5)).sum(), (years > 5).sum())
    assert A.yoe_kpis(market).first().mode == years.mode().iloc[0]
    bins = {r.bin: r.n for r in A.yoe_histogram(market).collect()}
    counts, _ = np.histogram(years.clip(0, 20), bins=range(0, 22))
    assert [bins[i] for i in range(21)] == list(counts)


def test_histogram(market, frame):
    x = frame.salary_max_annual.dropna()
    counts, edges = np.histogram(x, bins=30)
    rows = A.histogram(market).orderBy("bin").collect()
    assert [r.n for r in rows] == list(counts)
    assert [r.low for r in rows] == pytest.approx(list(edges[:-1]))


def test_crosstabs(market, frame):
    wide = {r.region: r.asDict() for r in A.crosstab_wide(market).collect()}
    expected = pd.crosstab(frame.region, frame.cluster_label)
    assert "Other" not in wide and wide["Singapore"]["A/B"] == expected.loc["Singapore", "A/B"]
    assert A.crosstab_long(market).agg(F.sum("n")).first()[0] == 4000


def test_facts_answer_for_postings(market):
    kept = kept_facts(market)
    for table in (A.kpis, A.region_stats, A.yoe_bands, A.category_trends, A.cluster_density, A.map_centre):
        assert sorted(map(str, table(kept).collect())) == sorted(map(str, table(market).collect()))
    assert facts(kept, "state").columns == kept.columns


def test_suggestions(market, frame):
    rows = advice.suggestions(kept_facts(market)).collect()
    said = {r.label: r.body for r in rows}
    assert [r.label for r in rows] == [label for label in advice.ORDER if label in said]
    assert said["MUST-HAVE SKILLS"].startswith("The top 5 most requested skills are: aws, go, python. ")
    assert said["TRENDING SKILLS"].startswith("The most in-demand emerging skills are: go.")
    assert said["CLOUD PLATFORM"].startswith("AWS is the most requested")
    x = frame.salary_max_annual.dropna()
    assert f"Median max salary is ${x.median():,.0f}. Top 25% earn above ${x.quantile(.75):,.0f}," in said["SALARY BENCHMARKS"]
    hot = frame.cluster_label.value_counts()
    assert f"'{hot.index[0]}' represents {hot.iloc[0] / 40:.1f}% of all openings ({hot.iloc[0]} jobs)" in said["HOT CATEGORY"]
    abroad = (frame.region == "Singapore").sum()
    assert said["INTERNATIONAL"].startswith(f"{abroad} openings found")
    assert len(said) == 16


def test_report(market, spark, tmp_path):
    written = report.write_report(market, str(tmp_path), "2024-01-07")
    assert set(written) == set(report.TABLES)
    assert spark.read.parquet(written["suggestions"]).count() == 16


def rank_of(values, value):
    """Least and greatest share of the values that lie below, or at, a value."""
    values = np.sort(values)
    return np.searchsorted(values, value, "left") / len(values), np.searchsorted(values, value, "right") / len(values)


def near(values, value, p, error=sketches.RANK_ERROR):
    low, high = rank_of(values, value)
    return low - error <= p <= high + error


def test_sketched_statistics_stay_within_their_errors(market, frame):
    row = A.kpis(market, exact=False).first()
    assert (row.postings, row.regions) == (4000, 4)
    assert abs(row.companies - 60) <= 60 * sketches.DISTINCT_ERROR + 1 and row.categories == 5
    assert near(frame.salary_max_annual.dropna(), row.median_salary, 0.5)
    assert near(frame.yoe_min.dropna().astype(float), row.median_yoe, 0.5)
    stats = A.salary_stats(market, exact=False).first()
    assert stats.mean == pytest.approx(frame.salary_max_annual.mean())
    for name, p in {"p25": 0.25, "median": 0.5, "p75": 0.75}.items():
        assert near(frame.salary_max_annual.dropna(), stats[name], p)
    for region in A.region_stats(market, exact=False).collect():
        own = frame[frame.region == region.region]
        assert region.jobs == len(own) and near(own.salary_max_annual.dropna(), region.median_salary, 0.5)


def test_sketches_of_many_values(spark):
    df = spark.range(300_000).select(
        F.lit("LA Area").alias("region"), F.concat(F.lit("C"), F.col("id") % 50_000).alias("company"),
        (F.pmod(F.xxhash64("id"), F.lit(10_000_019)) * 1.0).alias("salary_max_annual"),
    ).repartition(6)
    values = np.array([r[0] for r in df.select("salary_max_annual").collect()])
    row = A.salary_stats(df, exact=False).first()
    assert all(near(values, row[n], p) for n, p in {"p25": 0.25, "median": 0.5, "p75": 0.75}.items())
    found = A.kpis(df, exact=False).first()
    assert abs(found.companies - 50_000) < 50_000 * sketches.DISTINCT_ERROR
    assert found.median_yoe is None and found.categories == 0
    assert len(sketches.market_sketches(df).first().salaries) < 40_000


def test_stored_weeks_merge_without_their_postings(market, frame, spark, tmp_path):
    root = str(tmp_path)
    days = ["2024-01-07", "2024-01-14", "2024-01-21"]
    for i, day in enumerate(days):
        sketches.write_sketches(market.where(F.pmod(F.xxhash64("salary_min_annual"), F.lit(3)) == i), root, day)
    stored = sketches.read_sketches(spark, root)
    assert set(stored.columns) == set(sketches.COLUMNS) and "FileScan" in plan_of(stored)
    row = A.kpis(stored, exact=False).first()
    assert row.postings == 4000 and row.regions == 4 and near(frame.salary_max_annual.dropna(), row.median_salary, 0.5)
    assert A.salary_stats(stored, exact=False).first().mean == pytest.approx(frame.salary_max_annual.mean())
    part = A.kpis(sketches.read_sketches(spark, root, since=days[1]), exact=False).first()
    assert 0 < part.postings < 4000
    with pytest.raises(FileNotFoundError):
        sketches.read_sketches(spark, root, since="2025-01-01")


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_sketches_of_nothing(market):
    row = A.kpis(market.limit(0), exact=False).first()
    assert (row.postings, row.companies, row.median_salary) == (0, 0, None)
    assert A.region_stats(market.limit(0), exact=False).count() == 0


@pytest.mark.parametrize(("values", "bins", "step", "first", "number"), [
    ([100.0, 250.0, 999.0], 30, 50.0, 100.0, 18), ([0.0, 10.0], 10, 2.0, 0.0, 6), ([-7.0, 12.0], 20, 1.0, -7.0, 20),
    ([5.0, 5.0], 30, 1.0, 5.0, 1), ([0.1, 0.35], 4, 0.1, 0.1, 3), ([3.0], 5, 1.0, 3.0, 1),
])
def test_readable_edges(spark, values, bins, step, first, number):
    df = spark.createDataFrame([("r", v) for v in values] + [("r", None)], "region string, salary_max_annual double")
    rows = A.readable_histogram(df, bins=bins).orderBy("bin").collect()
    assert len(rows) == number <= bins and sum(r.n for r in rows) == len(values)
    assert rows[0].low == pytest.approx(first) and all(r.high - r.low == pytest.approx(step) for r in rows)
    assert A.readable_histogram(df.limit(0), bins=bins).count() == 0


def test_a_failing_part_of_the_report_is_skipped(market, spark, tmp_path, monkeypatch):
    def broken(table):
        raise ValueError("no such part")

    def late(table):
        return table.select(F.raise_error(F.lit("broken row")).alias("x"))

    monkeypatch.setattr(report, "TABLES", {"kpis": A.kpis, "broken": broken, "late": late, "top_skills": A.top_skills})
    with pytest.raises(ValueError, match="no such part"):
        report.report_tables(market)
    skipped = []
    written = report.write_report(market, str(tmp_path), "2024-01-07", skipped)
    assert set(written) == {"kpis", "top_skills"} and [name for name, _ in skipped] == ["broken", "late"]
    assert spark.read.parquet(written["kpis"]).first().postings == 4000


@pytest.mark.parametrize("name", [
    "yoe_histogram", "years_histogram", "years_histogram_readable", "salary_histogram", "salary_histogram_readable",
    "yoe_bands", "yoe_kpis", "skill_gaps",
])
def test_postings_are_counted_once_for_all_that_is_read_from_them(spark, name, tmp_path):
    from vacatlas.catalog.queries import QUERIES

    spark.range(40).selectExpr("id AS o_orderkey", "id AS o_custkey", "DATE '2024-01-01' AS o_orderdate").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    spark.range(5).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES[name](spark, str(tmp_path))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "parquet" not in plan and "text" not in plan  # the counts are kept; nothing goes back to the texts
    assert found.count() > 0

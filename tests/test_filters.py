import pytest

from vacatlas.operators import filters as B


@pytest.fixture
def sample(spark):
    return spark.createDataFrame(
        [
            ("Data Scientist", "Google", "SF Bay Area", "LLM/GenAI", 200000.0, 3),
            ("ML Engineer", "Meta", "SF Bay Area", "NLP", 220000.0, 5),
            ("Analyst", "Acme", "Greater NYC", "Analytics", 150000.0, 2),
            ("Scientist", "Hong Co", None, None, None, None),
            ("Other", "Z", "Other", "NLP", 190000.0, 9),
        ],
        "title string, company string, region string, cluster_label string, salary_max_annual double, yoe_min int",
    )


@pytest.mark.parametrize(
    "args, rows",
    [
        ({}, 5),
        ({"regions": ["SF Bay Area"]}, 3),
        ({"regions": []}, 1),
        ({"categories": ["LLM/GenAI", "NLP"]}, 4),
        ({"salary_range": (190000, 220000)}, 4),
        ({"yoe_range": (0, 5)}, 4),
        ({"regions": ["SF Bay Area"], "salary_range": (190000, 210000), "yoe_range": (0, 5)}, 2),
    ],
)
def test_apply_filters_passes_nulls(sample, args, rows):
    assert B.apply_filters(sample, **args).count() == rows


def test_absent_columns_do_not_filter(sample):
    df = sample.select("title", "company")
    assert B.apply_filters(df, ["x"], ["y"], (0, 1), (0, 1)).count() == 5


def test_search(sample):
    assert B.search(sample, "SCIENTIST").count() == 2
    assert B.search(sample, "goo.le|meta").count() == 2
    assert B.search(sample, "goo.le", literal=True).count() == 0
    assert B.search(sample, "").count() == 5


def test_domain(sample):
    row = B.filter_domain(sample).first()
    assert row.regions == ["Greater NYC", "Other", "SF Bay Area"]
    assert (row.salary_low, row.salary_high, row.salary_usable, row.yoe_high) == (150000, 220000, True, 20)
    assert B.filter_domain(sample.select("title")).first().regions == []


def test_exclusions(sample):
    assert B.exclude_other(sample).count() == 4
    assert B.drop_null(sample, ["region", "yoe_min"]).count() == 4
    assert B.international(sample).count() == 0
    assert B.project_existing(sample, ["title", "missing", "region"]).columns == ["title", "region"]


def test_min_support(spark):
    df = spark.createDataFrame([("a", i) for i in range(4)] + [("b", 1), ("c", None)], "k string, v int")
    assert B.min_support(df, "k", "v").count() == 4
    assert B.min_support(df.limit(4), "k", "v").count() == 0

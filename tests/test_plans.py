"""The plans, not only the results: what is read, moved and run where."""

import re

from vacatlas.catalog.queries import QUERIES, grouped, processed
from vacatlas.catalog.tables import filled, postings, spread, table
from vacatlas.operators import aggregates as A, clustering as C, enrich as E
from vacatlas.operators.dedup import dedup
from vacatlas.plans.process import describe, process
from conftest import SMALL


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_python_and_no_cross_join(spark):
    df = describe(process(postings(spark, SMALL)))
    for frame in (df, A.kpis(df), A.region_stats(df), C.label_clusters(grouped(df)), QUERIES["geocode_table"](spark, SMALL)):
        text = plan(frame)
        for bad in ("EvalPython", "MapInPandas", "CartesianProduct", "BroadcastNestedLoopJoin"):
            assert bad not in text, bad


def test_dedup_moves_only_keys_before_the_last_join(spark, tmp_path):
    path = str(tmp_path / "p")
    postings(spark, SMALL).write.parquet(path)
    text = plan(dedup(spark.read.parquet(path)))
    scans = re.findall(r"FileScan parquet \[(.*?)\]", text)
    assert len(scans) == 2 and sum("description" in scan for scan in scans) == 1


def test_filters_and_columns_reach_the_scan(spark, tmp_path):
    from vacatlas.operators import filters as B

    path = str(tmp_path / "p")
    process(postings(spark, SMALL)).write.parquet(path)
    table = spark.read.parquet(path)
    text = plan(B.apply_filters(table, regions=["Other"], yoe_range=(0, 5)).select("region", "yoe_min"))
    assert "PushedFilters: [Or(" in text and "ReadSchema: struct<region:string,yoe_min:int>" in text
    assert "description" not in plan(A.region_stats(table))


def test_statistics_read_the_postings_once(spark, tmp_path):
    path = str(tmp_path / "p")
    grouped(processed(spark, SMALL)).write.parquet(path)
    df = spark.read.parquet(path)
    for table in (A.kpis, A.region_stats, A.geo_trends, A.yoe_bands, C.label_clusters):
        result = table(df)
        result.collect()
        final = plan(result).split("Initial Plan")[0]
        assert final.count("FileScan") == 1, (table.__name__, final.count("FileScan"))


def test_extraction_stays_in_generated_code(spark):
    df = E.extract_skills(postings(spark, SMALL).select("posting_id", "description"))
    df.collect()
    final = plan(df).split("Initial Plan")[0]
    extraction = [line for line in final.splitlines() if "Project [" in line and "contains" in line.lower()]
    assert extraction and all(re.match(r"[ :+-]*\*\(", line) for line in extraction)


def test_filters_do_not_copy_expressions_below_the_stages(spark):
    """A filter on years, region or pay reads stored columns: no pattern runs again, and nothing fails to compile."""
    for name in ("filters_combined", "filter_domain", "international"):
        text = plan(QUERIES[name](spark, SMALL))
        assert "regexp_extract_all" not in text and "FileScan parquet" in text, name
    for name in ("search_text", "min_support", "exclude_other"):
        text = QUERIES[name](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert text.count("regexp_extract_all") <= 1, name


def test_postings_fill_all_cores(spark):
    """The documents of one row group are dealt before they are multiplied; tables that fill the cores stay as they are."""
    cores = spark.sparkContext.defaultParallelism
    assert filled(table(spark, SMALL, "documents")) == 1
    assert filled(postings(spark, SMALL)) >= cores - 1
    wide = spark.range(1000, numPartitions=cores)
    assert spread(wide, "id") is wide


def test_years_phrases_are_collected_once(spark):
    rows = spark.createDataFrame([(1, "2 to 4 years experience")], "posting_id bigint, description string")
    text = E.extract_years(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("regexp_extract_all") == 1

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from vacatlas.schema import RAW_POSTING
from vacatlas.sources import postings as S, snapshots


def test_empty_jobs(spark):
    assert S.empty_jobs(spark).schema == RAW_POSTING
    assert S.union_batches([], spark).count() == 0


def test_union_batches_skips_what_fails(spark, tmp_path):
    a = spark.createDataFrame([("x", 1)], "title string, n int")
    b = spark.createDataFrame([("y",)], "title string")
    missing = lambda: spark.read.parquet(str(tmp_path / "none"))
    batches = [(a, "DS", "NY"), (missing, "DS", "LA"), (lambda: b, "MLE", "SF")]
    with pytest.raises(PySparkException):
        S.union_batches(batches)
    skipped = []
    rows = S.union_batches(batches, skipped=skipped).orderBy("title").collect()
    assert [x[:2] for x in skipped] == [("DS", "LA")]
    assert [(r.title, r.n, r.search_query, r.search_location) for r in rows] == [("x", 1, "DS", "NY"), ("y", None, "MLE", "SF")]


def test_search_grid(spark):
    grid = S.search_grid(spark)
    assert grid.count() == 72
    assert grid.where("is_us").select("country").distinct().first()[0] == "USA"
    abroad = S.search_grid(spark, ["DS"], ["LONDON", "Tokyo, JP", "hong kong", "Seattle, WA"]).orderBy("location")
    assert [(r.location, r.is_us, r.country) for r in abroad.collect()] == [
        ("LONDON", False, "UK"), ("Seattle, WA", True, "USA"), ("Tokyo, JP", False, "Japan"), ("hong kong", False, "Hong Kong"),
    ]


def test_standardize(spark):
    df = spark.createDataFrame([("DS", "Google", 100, "u", 1)], "title string, company_name string, min_amount int, job_url string, extra int")
    row = S.standardize_columns(df).first()
    assert (row.company, row.salary_min, row.url, row.salary_max) == ("Google", "100", "u", None)
    both = df.withColumn("company", F.lit(None).cast("string"))
    assert S.standardize_columns(both).first().company is None
    assert S.standardize_columns(df).schema == RAW_POSTING


def test_recent(spark):
    df = spark.createDataFrame([("2024-01-08",), ("2024-01-07",), (None,)], "d string").select(F.col("d").cast("date").alias("date_posted"))
    assert S.recent(df, "2024-01-15").count() == 1
    assert S.recent(df, "2024-01-14T00:00:00").count() == 2
    assert S.recent(df, "2024-01-14T12:00:00").count() == 1


def test_snapshots(spark, tmp_path):
    root = str(tmp_path)
    df = spark.createDataFrame([(1, [0.5]), (2, [0.1])], "posting_id int, embedding array<double>")
    snapshots.write_snapshot(df, root, "processed_jobs", "2024-01-07")
    snapshots.write_snapshot(df, root, "processed_jobs", "2024-01-14")
    snapshots.write_snapshot(df.limit(1), root, "processed_jobs", "2024-01-14")
    latest = snapshots.read_latest(spark, root, "processed_jobs")
    assert latest.columns == ["posting_id"] and latest.count() == 1
    assert snapshots.read_latest(spark, root, "processed_jobs", "2024-01-07").count() == 2
    assert snapshots.run_dates(spark, root, "processed_jobs") == ["2024-01-07", "2024-01-14"]
    snapshots.write_snapshot(df.limit(0), root, "processed_jobs", "2024-01-14")  # no rows replace rows
    assert snapshots.read_latest(spark, root, "processed_jobs").count() == 0
    snapshots.write_snapshot(df.limit(0), root, "empty", "2024-01-14")
    assert snapshots.read_latest(spark, root, "empty").columns == ["posting_id"]
    with pytest.raises(FileNotFoundError):
        snapshots.read_latest(spark, root, "none")


def test_csv_round_trip(spark, tmp_path):
    path = str(tmp_path / "csv")
    df = spark.createDataFrame(
        [("a, \"b\"", "1.5", {"cloud": ["aws"]}), ("c", "n/a", None)],
        "title string, salary_min string, key_skills map<string,array<string>>",
    )
    S.export_csv(df, path)
    rows = S.load_typed(spark, path).orderBy("title").collect()
    assert [tuple(r) for r in rows] == [("a, \"b\"", 1.5, {"cloud": ["aws"]}), ("c", None, {})]
    literal = spark.createDataFrame([("{'languages': ['r']}",)], "key_skills string")
    S.export_csv(literal, path)
    assert S.load_typed(spark, path).first().key_skills == {"languages": ["r"]}
    text = "a\nb\r\n\\n c\\\\ \"d\", e"
    S.export_csv(spark.createDataFrame([("1", text), ("2", None)], "site string, description string"), path)
    assert {r.site: r.description for r in S.load_typed(spark, path).collect()} == {"1": text, "2": None}


def failing(spark, rows):
    """Rows of which the last cannot be computed."""
    return spark.range(rows, numPartitions=4).select(
        F.col("id").alias("posting_id"), F.when(F.col("id") == rows - 1, F.raise_error(F.lit("broken row"))).alias("title")
    )


def test_a_failed_rerun_leaves_the_snapshot(spark, tmp_path):
    root = str(tmp_path)
    first = spark.range(5).select(F.col("id").alias("posting_id"))
    path = snapshots.write_snapshot(first, root, "jobs", "2024-01-07")
    with pytest.raises(Exception, match="broken row"):
        snapshots.write_snapshot(failing(spark, 40), root, "jobs", "2024-01-07")
    assert snapshots.read_latest(spark, root, "jobs").count() == 5 and snapshots.replaced_versions(spark, root, "jobs") == []
    reader = snapshots.read_latest(spark, root, "jobs")
    second = snapshots.write_snapshot(first.limit(2), root, "jobs", "2024-01-07")
    assert second != path and snapshots.read_latest(spark, root, "jobs").count() == 2
    assert reader.count() == 5  # those who read the old version go on
    assert snapshots.replaced_versions(spark, root, "jobs") == [path]
    with pytest.raises(Exception, match="broken row"):  # a first run of a date that fails leaves no snapshot of it
        snapshots.write_snapshot(failing(spark, 40), root, "jobs", "2024-01-14")
    assert snapshots.run_dates(spark, root, "jobs") == ["2024-01-07"]
    with pytest.raises(FileNotFoundError):
        snapshots.read_latest(spark, root, "jobs", "2024-01-14")


def test_damaged_files_are_quarantined(spark, tmp_path):
    source, quarantine = tmp_path / "in", str(tmp_path / "quarantine")
    for i in range(4):
        df = spark.range(i * 100, i * 100 + 100).select(F.col("id").alias("posting_id"), F.concat(F.lit("t"), F.col("id")).alias("title"))
        (df if i else df.withColumn("extra", F.lit(1))).coalesce(1).write.mode("append").parquet(str(source))
    files = sorted(source.glob("*.parquet"), key=lambda f: spark.read.parquet(str(f)).first().posting_id)
    files[1].write_bytes(files[1].read_bytes()[:200])  # cut short
    content = bytearray(files[2].read_bytes())
    content[30:200] = bytes(170)  # its footer is whole, its pages are not
    files[2].write_bytes(bytes(content))
    for crc in source.glob(".*.crc"):
        crc.unlink()
    rows = S.read_batches(spark, str(source), quarantine=quarantine)
    assert sorted(r.posting_id for r in rows.collect()) == [*range(100), *range(300, 400)] and "extra" in rows.columns
    noted = spark.read.parquet(quarantine).collect()
    assert {r.file.rpartition("/")[2] for r in noted} == {files[1].name, files[2].name} and all(r.error for r in noted)
    with pytest.raises(Exception):
        S.read_batches(spark, str(source)).collect()


def test_batches_that_fail_when_read_are_skipped_eagerly(spark):
    good = spark.createDataFrame([(1, "x")], "posting_id bigint, title string")
    skipped = []
    rows = S.union_batches([(good, "DS", "NY"), (failing(spark, 8), "DS", "LA")], skipped=skipped, eager=True)
    assert rows.count() == 1 and [x[:2] for x in skipped] == [("DS", "LA")]
    with pytest.raises(Exception, match="broken row"):
        S.union_batches([(failing(spark, 8), "DS", "LA")], eager=True)

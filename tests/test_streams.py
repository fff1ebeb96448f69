import numpy as np
from pyspark.sql import functions as F

from vacatlas.operators.dedup import dedup
from vacatlas.plans.process import process
from vacatlas.streaming import ingest, keystore

SCHEMA = (
    "posting_id bigint, title string, company string, location string, description string, "
    "salary_min string, salary_max string, url string, date_posted date"
)


def rows(spark, lines):
    df = spark.createDataFrame(lines, "posting_id bigint, title string, url string, day string")
    return df.select(
        "posting_id", "title", F.lit("Co").alias("company"), F.lit("New York, NY").alias("location"),
        F.lit("Python. 3+ years of experience").alias("description"), F.lit("75").alias("salary_min"),
        F.lit(None).cast("string").alias("salary_max"), "url", F.col("day").cast("date").alias("date_posted"),
    )


BATCHES = [
    [(1, "a", "u1", "2024-01-01"), (2, "a", "u2", "2024-01-02"), (3, "b", "u1", "2024-01-02"), (4, "c", None, "2024-01-03")],
    [(5, "b", "u5", "2024-01-04"), (6, "d", "u1", "2024-01-05"), (7, "e", None, "2024-01-05"), (8, "f", "u8", "2024-01-06")],
    [(9, "f", "u9", "2024-01-07"), (10, "g", "u8", "2024-01-07"), (11, "h", "u2", "2024-01-08")],
]


def test_refresh_equals_one_batch(spark, tmp_path):
    source, root, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    for batch in BATCHES:
        rows(spark, batch).coalesce(1).write.mode("append").parquet(source)
        ingest.refresh_snapshot(ingest.posting_stream(spark, source), root, "processed_jobs", checkpoint=state)
    stored = spark.read.parquet(f"{root}/processed_jobs")
    whole = process(rows(spark, [line for batch in BATCHES for line in batch]))
    assert sorted(map(str, stored.drop("batch").collect())) == sorted(map(str, whole.collect()))
    assert {r.batch for r in stored.select("batch").collect()} == {0, 1, 2}


def test_refresh_without_a_checkpoint_goes_on(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for batch in BATCHES:
        rows(spark, batch).coalesce(1).write.mode("append").parquet(source)
        ingest.refresh_snapshot(ingest.posting_stream(spark, source), root, "processed_jobs")
    ids = [r.posting_id for r in spark.read.parquet(f"{root}/processed_jobs").collect()]
    assert len(ids) == len(set(ids))


def test_stream_rows_equal_batch_rows(spark, tmp_path):
    source = str(tmp_path / "in")
    batch = rows(spark, BATCHES[0] + BATCHES[1])
    batch.write.parquet(source)
    streamed = ingest.drain(ingest.posting_stream(spark, source), ingest.enrich_stream)
    assert sorted(map(str, streamed.collect())) == sorted(map(str, ingest.enrich_stream(batch).collect()))


def test_stream_dedup_by_url(spark, tmp_path):
    source = str(tmp_path / "in")
    batch = rows(spark, BATCHES[0] + BATCHES[1])
    batch.write.parquet(source)
    kept = ingest.drain(ingest.posting_stream(spark, source), ingest.dedup_stream)
    assert sorted(str(r.url) for r in kept.collect()) == ["None", "u1", "u2", "u5", "u8"]
    assert dedup(batch.select("posting_id", "url")).count() == 5


def test_weekly_counts_start_on_sunday(spark, tmp_path):
    source = str(tmp_path / "in")
    df = rows(spark, [(1, "a", "u", "2024-01-06"), (2, "a", "u", "2024-01-07"), (3, "a", "u", "2024-01-13")])
    df.write.parquet(source)
    streamed = ingest.drain(
        ingest.posting_stream(spark, source), lambda s: ingest.weekly_counts(s, "title"), mode="complete"
    )
    expected = [("2023-12-31", "a", 1), ("2024-01-07", "a", 2)]
    for found in (streamed, ingest.weekly_counts(df, "title")):
        assert sorted((str(r.week), r.title, r.n) for r in found.collect()) == expected


def test_weeks_close_and_late_rows_count_apart(spark, tmp_path):
    """Every row is in one of closed, late and open weeks, and only open weeks are state."""
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    runs = [
        [("a", "2024-01-01"), ("a", "2024-01-03"), ("b", "2024-01-04")],
        [("a", "2024-01-20"), ("b", "2024-01-06")],  # on time: the watermark stands at 28 December
        [("a", "2024-01-05"), ("b", "2024-01-19"), ("a", "2024-01-31")],  # the first is late: it stands at 13 January
        [("b", "2024-01-02"), ("a", "2024-01-20"), ("a", "2024-01-25"), (None, "2024-02-20"), ("c", None)],
    ]
    held = []
    for lines in runs:
        df = spark.createDataFrame(lines, "title string, day string")
        df.select("title", F.col("day").cast("date").alias("date_posted")).repartition(2).write.mode("append").parquet(source)
        reports = ingest.run_weekly(lambda: ingest.posting_stream(spark, source), root, "title")
        held.append(reports[-1]["stateOperators"][0]["numRowsTotal"])

    def stored(kind):
        return sorted(((str(r.week), r.title, r.n) for r in spark.read.parquet(f"{root}/{kind}").collect()), key=str)

    assert stored("closed") == [
        ("2023-12-31", "a", 2), ("2023-12-31", "b", 2), ("2024-01-14", "a", 1), ("2024-01-14", "b", 1),
        ("2024-01-21", "a", 1), ("2024-01-28", "a", 1),
    ]
    assert stored("late") == [("2023-12-31", "a", 1), ("2023-12-31", "b", 1), ("2024-01-14", "a", 1)]
    assert held == [2, 1, 1, 1]
    before = stored("closed"), stored("late")
    ingest.run_weekly(lambda: ingest.posting_stream(spark, source), root, "title")  # nothing new
    assert (stored("closed"), stored("late")) == before


def test_a_batch_reads_only_files_that_may_hold_its_keys(spark, tmp_path):
    store = keystore.KeyStore(spark, str(tmp_path / "keys"))
    assert store.known(spark.createDataFrame([("a",)], "key string"), 0).count() == 0
    for batch in range(6):
        store.add(spark.range(batch * 3000, batch * 3000 + 3000).select(F.concat(F.lit("k"), F.col("id")).alias("key")), batch)
    assert len({(r.batch, r.bucket) for r in store.keys().select("batch", "bucket").distinct().collect()}) == 6 * keystore.BUCKETS
    asked = spark.createDataFrame([("k3007",), ("k17999",), ("new",), (None,)], "key string")
    known = store.known(asked, 9)
    found = {r.key for r in known.collect()}
    assert {"k3007", "k17999"} <= found and len(found) < 4 * 90  # of 18,000 keys, about 47 in a file
    assert len(store.files_for(asked, 9)) <= 4
    plan = known._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "concat_ws" in plan
    many = spark.range(100_000, 100_500).select(F.concat(F.lit("k"), F.col("id")).alias("key"))
    assert len(store.files_for(many, 9)) < 0.25 * 6 * keystore.BUCKETS  # all of them are new
    assert store.files_for(asked, 1) == [f for f in store.files_for(asked, 9) if not f.startswith("1/")]
    store.add(spark.createDataFrame([("k3007",)], "key string"), 1)  # a batch written again replaces itself
    assert store.keys().where("batch = 1").count() == 1


def test_filters_never_lose_a_key():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 5000):
        own = rng.integers(-(1 << 63), (1 << 63) - 1, n)
        bloom = keystore.bloom_filter(own)
        assert all(keystore.may_hold(bloom, own[i:i + 1]) for i in range(n))
        others = rng.integers(-(1 << 63), (1 << 63) - 1, 2000)
        assert sum(keystore.may_hold(bloom, others[i:i + 1]) for i in range(2000)) < 2000 * 0.03


def test_refresh_of_a_long_history_reads_few_files(spark, tmp_path, monkeypatch):
    source, root, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")
    read = []
    files_for = keystore.KeyStore.files_for
    monkeypatch.setattr(keystore.KeyStore, "files_for", lambda self, *a: read.append(files_for(self, *a)) or read[-1])
    for run in range(4):
        lines = [(run * 100 + i, f"title {run} {i}", f"u{run}-{i}", "2024-01-01") for i in range(60)]
        lines += [(run * 100 + 90, "title 0 1", "u0-1", "2024-01-01")] if run else []
        rows(spark, lines).coalesce(1).write.mode("append").parquet(source)
        ingest.refresh_snapshot(ingest.posting_stream(spark, source), root, "processed_jobs", checkpoint=state)
    stored = spark.read.parquet(f"{root}/processed_jobs")
    assert sorted(r.posting_id for r in stored.collect()) == [run * 100 + i for run in range(4) for i in range(60)]
    files = spark.read.parquet(f"{root}/processed_jobs_keys/keys").select("batch", "bucket").distinct().count()
    assert 1 <= len(read[-2]) < 0.2 * files  # the one repeated key, and what filters hold by chance


def test_stream_dedup_query_moves_no_texts(spark, tmp_path, monkeypatch):
    from vacatlas.catalog import queries

    spark.range(40).selectExpr("id AS o_orderkey", "id AS o_custkey", "DATE '2024-01-01' AS o_orderdate").write.parquet(
        f"{tmp_path}/orders.parquet"
    )
    spark.range(5).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    written, drain = [], ingest.drain
    monkeypatch.setattr(ingest, "drain", lambda *a, **k: written.append(drain(*a, **k)) or written[-1])
    found = {r.url: r.n for r in queries.stream_dedup(spark, str(tmp_path)).collect()}
    assert written[0].columns == ["posting_id", "url"]
    assert set(found.values()) == {1} and len(found) == 36  # 9, 19, 29 and 39 have the url of the key before


def test_refresh_builds_postings_after_choosing_them(spark, tmp_path, monkeypatch):
    """The kept ids reach below what joins the texts, so that no text is moved for them, and rows are those of one batch."""
    from vacatlas.catalog import queries
    from vacatlas.catalog.tables import postings

    orders = f"{tmp_path}/orders.parquet"
    for low in (0, 60):
        spark.range(low, low + 60, numPartitions=1).selectExpr(
            "id AS o_orderkey", "id % 9 AS o_custkey", "DATE '2024-01-01' AS o_orderdate"
        ).write.mode("append").parquet(orders)
    spark.range(5).selectExpr("id AS doc_id", "concat('text ', id) AS text").write.parquet(f"{tmp_path}/documents.parquet")
    plans, enrich = [], ingest.enrich_rows

    def watched(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return enrich(df)

    monkeypatch.setattr(ingest, "enrich_rows", watched)
    found = sorted(map(str, queries.stream_snapshot(spark, str(tmp_path)).collect()))
    whole = process(postings(spark, str(tmp_path))).select("posting_id", "region", "salary_max_annual")
    assert found == sorted(map(str, whole.collect())) and 0 < len(found) < 120
    assert all(text.index(" AS description") < text.index("LeftSemi") for text in plans)


def test_refresh_builds_each_batch(spark, tmp_path):
    source, root, state = str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")

    def build(df):
        return df.withColumn("description", F.concat(F.col("description"), F.lit(" in R and SQL")))

    for batch in BATCHES:
        rows(spark, batch).coalesce(1).write.mode("append").parquet(source)
        ingest.refresh_snapshot(ingest.posting_stream(spark, source), root, "processed_jobs", checkpoint=state, build=build)
    whole = process(build(rows(spark, [line for batch in BATCHES for line in batch])))
    stored = spark.read.parquet(f"{root}/processed_jobs").drop("batch")
    assert sorted(map(str, stored.collect())) == sorted(map(str, whole.collect()))

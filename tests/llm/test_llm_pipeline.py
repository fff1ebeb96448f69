import ast
import pathlib

import pytest

import corpus_pipeline
from conftest import SMALL
from oracle import compare, connect
from vacatlas.llm import decontaminate, neardup, quality
from vacatlas.llm.common import source
from vacatlas.llm.queries import QUERIES, SQL
from __spark_entry__ import oracle_sql, queries


@pytest.fixture(scope="module")
def db():
    return connect(SMALL)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, name):
    assert compare(QUERIES[name](spark, SMALL), db, SQL[name]) == ""


def test_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.partition("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(queries()) and set(SQL) <= set(oracle_sql())


def test_nothing_else_imports_the_subpackage():
    root = pathlib.Path(corpus_pipeline.__file__).parent
    for path in (root / "vacatlas").rglob("*.py"):
        if "llm" not in path.parts:
            names = []
            for n in ast.walk(ast.parse(path.read_text())):
                if isinstance(n, ast.ImportFrom):
                    names += [n.module or "", *(alias.name for alias in n.names)]
                elif isinstance(n, ast.Import):
                    names += [alias.name for alias in n.names]
            assert not [n for n in names if "llm" in n.split(".")], path


def test_stages_take_effect(spark):
    docs = source(spark, SMALL, "documents")
    steps = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SMALL).persist()
        assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
        steps.append((docs, kept))
        docs = kept
    ids = [({r.doc_id for r in a.collect()}, {r.doc_id for r in b.collect()}) for a, b in steps]
    model = quality.train(steps[0][0], source(spark, SMALL, "labels"))
    scored = quality.quality_scores(steps[0][0], model).collect()
    assert ids[0][1] == {r.doc_id for r in scored if r.predicted} < ids[0][0]
    near = neardup.near_duplicates(steps[1][0]).collect()
    assert ids[1][1] == {r.doc_id for r in near if r.kept} < ids[1][0]
    assert ids[2][0] == ids[2][1]
    assert all(r.n_chars == len(r.text) for r in steps[2][1].collect())
    found = decontaminate.contaminated(steps[3][0], source(spark, SMALL, "benchmark")).collect()
    assert ids[3][1] == ids[3][0] - {r.doc_id for r in found}
    packed = corpus_pipeline.packing(spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == ids[3][1]
    assert all(r.n == r.total for r in spark.createDataFrame(packed).groupBy("doc_id").agg({"length": "sum", "doc_tokens": "max"}).toDF("doc_id", "n", "total").collect())


def test_pipeline_on_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        source(spark, SMALL, name).limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0

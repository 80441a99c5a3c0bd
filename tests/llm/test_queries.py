"""The registered queries: SQL where there is some, the pipeline, and what happens without the subpackage."""

import subprocess
import sys
from pathlib import Path

import duckdb
import pytest
from compare import duck_rows, spark_rows
from conftest import DOCUMENTS, ODD

import corpus_pipeline
from eventlens.llm.common import components, settle
from eventlens.llm.oracles import ORACLES
from eventlens.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
ROOT = Path(__file__).resolve().parents[2]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", ORACLES)
def test_sql(spark, con, name):
    columns, rows = spark_rows(QUERIES[name](spark, SF))
    wanted_columns, wanted = duck_rows(con, ORACLES[name])
    assert columns == wanted_columns
    assert rows == wanted


def test_one_query_for_each_operator():
    assert sorted(int(q[2:q.index("_")]) for q in QUERIES) == list(range(1, 14))


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        after = settle(stage(spark, docs, SF))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert after.schema == docs.schema
            if k < 3:  # the first three only take documents or text away
                assert after.exceptAll(after.dropDuplicates()).count() == 0
                assert after.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0
        docs = after
    assert set(docs.columns) == {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"}
    whole = corpus_pipeline.run(spark, SF)
    assert whole.count() == docs.count()


def test_stages_on_odd_rows(spark, odd, nothing):
    for start in (odd, nothing):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = settle(stage(spark, docs, SF))
        assert docs.count() >= 0
    for _, stage in corpus_pipeline.STAGES:  # each alone, on rows that the first would take away
        assert stage(spark, odd, SF).count() <= 3 * len(ODD) * 40


def test_near_duplicates_go_and_clean_documents_stay(spark):
    words = [f"word{i}" for i in range(300)]
    near = words[:150] + ["other"] + words[151:]
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words)), (4, " ".join(reversed(words)))]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], DOCUMENTS)
    kept = corpus_pipeline.near_dedup(spark, docs, SF).collect()
    assert sorted(r["doc_id"] for r in kept) == [1, 4]


def test_components(spark):
    chain = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 100), (300, 300)] + [(500, x) for x in range(501, 560)]
    found = {r["id"]: r["root"] for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, **{x: 500 for x in range(500, 560)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_the_rest_works_without_the_subpackage(tmp_path):
    """What stays when both folders and the pipeline are deleted still imports and registers the other queries."""
    for name in ("__spark_entry__.py", "bench.py"):
        (tmp_path / name).write_bytes((ROOT / name).read_bytes())
    for path in (ROOT / "eventlens").rglob("*.py"):
        if "llm" not in path.parts:
            target = tmp_path / path.relative_to(ROOT)
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(path.read_bytes())
    done = subprocess.run(
        [sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), any('op' == q[:2] for q in e.queries()))"],
        cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
    assert done.stdout.split()[-1] == "False" and int(done.stdout.split()[-2]) > 80

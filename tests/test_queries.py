"""Every query against the SQL that says the same, in DuckDB over the smallest tables."""

import math
import os

import pytest

from sealmark.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    if not os.path.isdir(SF):
        pytest.skip("no test data")
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return bytes(v).hex() if isinstance(v, (bytes, bytearray)) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = sorted(repr(tuple(plain(r[c]) for c in sorted(df.columns))) for r in df.collect())
    assert got
    if name in SQL:
        found = duck.execute(SQL[name])
        names = [d[0] for d in found.description]
        assert sorted(names) == sorted(df.columns)
        order = sorted(range(len(names)), key=lambda k: names[k])
        assert got == sorted(repr(tuple(plain(r[k]) for k in order)) for r in found.fetchall())


def test_admission_reads_whole_texts(spark, tmp_path, monkeypatch):
    """What the operator is given holds every character of the text, and any character is admitted."""
    import hashlib
    import json

    from pyspark.sql import functions as F

    from sealmark.plans import queries

    texts = ["short", "x" * 300 + ' end "quoted" \\ \x01\x0b\x1f\x7f é e\u0301 \U0001f600', "a" * 79 + '"' + "b" * 5000]
    spark.createDataFrame([*enumerate(texts), (9, None)], "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    names = ("schema_article_admission", "schema_photo_admission", "in_toto_admission")
    for name in names:
        got = {tuple(x) for x in QUERIES[name](spark, str(tmp_path)).collect()}
        assert got == {("ok", "", 3), ("invalid", "schema_violation", 3)}, name
    monkeypatch.setattr(queries, "address", lambda raw, format_, axis: F.struct(F.col(raw).alias("status"), F.lit("").alias("violation")))
    seen = {name: [json.loads(x["status"]) for x in QUERIES[name](spark, str(tmp_path)).collect()] for name in names}
    assert {x["headline"] for x in seen[names[0]]} == {x["creator"]["name"] for x in seen[names[1]]} == set(texts)
    digests = {x["subject"][0]["digest"]["sha256"] for x in seen[names[2]]}
    assert digests >= {hashlib.sha256(x.encode()).hexdigest() for x in texts}


def test_bound_labels_are_not_broadcast(spark, duck):
    """The files are small and the labels made of them are not; the plan can't know."""
    df = QUERIES["compose_g2_sha256"](spark, SF)
    rows = sorted(map(tuple, df.collect()))
    assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert rows == sorted(duck.execute(SQL["compose_g2_sha256"]).fetchall())


def test_composed_labels_need_few_python_workers(spark, duck):
    """A task needs a Python worker for each evaluation of its plan, however many labels the plan makes."""
    name = "compose_labels_every_axis"
    df = QUERIES[name](spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert 3 <= plan.count("ArrowEvalPython") <= 5
    assert sorted(map(tuple, df.collect())) == sorted(duck.execute(SQL[name]).fetchall())

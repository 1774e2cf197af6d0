import random

import pytest
from pyspark.sql import functions as F

from helpers import docs, prose

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402


def test_stages(spark, tmp_path):
    r = random.Random(2)
    leak = prose(r, 30)
    clean = [(k, prose(r, 120)) for k in range(20)]
    twin = prose(r, 150)
    rows = [*clean, (30, "too short"), (31, twin), (32, twin + " more"), (33, twin), (40, prose(r, 80) + " " + leak + " " + prose(r, 80)), (50, prose(r, 80) + ' token = "0123456789abcdef01234567" ' + prose(r, 20)), (60, None), (None, prose(r, 100)), (None, None)]
    more = docs(spark, rows)
    for c in ("spans", "redacted", "n_hex", "n_assign", "class_id", "band", "run", "_w", "_row", "containment", "item_id"):
        more = more.withColumn(c, F.lit("clash"))
    cols = more.columns
    more.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, leak)], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    df = spark.read.parquet(str(tmp_path / "documents.parquet"))
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, str(tmp_path))
        seen.append({x["doc_id"]: x for x in df.collect()})
        if name != corpus_pipeline.STAGES[-1][0]:
            assert df.columns == cols
    all_clean = {k for k, _ in clean} | {None}  # rows without an id can't be named, and stay
    assert set(seen[0]) == all_clean | {31, 32, 33, 40, 50}
    assert set(seen[1]) == all_clean | {31, 40, 50}
    assert set(seen[2]) == set(seen[3]) == set(seen[4]) == all_clean | {31, 50}
    assert "[SECRET]" in seen[3][50]["text"] and "0123456789abcdef" not in seen[3][50]["text"] and seen[3][50]["n_chars"] == len(seen[3][50]["text"])
    assert all(x["round_trip"] for x in seen[4].values())
    whole = sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert whole == sorted(map(str, df.collect()))
    assert corpus_pipeline.ORACLE_SQL is None and 4 <= len(corpus_pipeline.STAGES) <= 5


def test_stages_of_nothing(spark, tmp_path):
    none = docs(spark, []).limit(0)
    none.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []

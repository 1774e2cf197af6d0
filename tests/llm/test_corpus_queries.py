import os

import pytest

from sealmark.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.001"
FIRST = {
    "op1": ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"],
    "op2": ["page_id", "url", "text", "n_chars"],
    "op3": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
    "op6": ["doc_id", "start", "n_tokens", "ids_crc32"],
    "op8": ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"],
    "op10": ["doc_id", "held_out", "lang_pred", "score"],
}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", sorted(queries()))
def test_query(spark, name):
    df = queries()[name](spark, SF)
    want = FIRST.get(name.split("_")[0])
    assert want is None or df.columns[: len(want)] == want
    rows = df.collect()
    if name in oracle_sql():
        duckdb = pytest.importorskip("duckdb")
        c = duckdb.connect()
        for t in ("documents", "benchmark"):
            c.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
        found = c.execute(oracle_sql()[name])
        names = [d[0] for d in found.description]
        assert names == df.columns and sorted(map(tuple, rows)) == sorted(found.fetchall())


def test_names():
    assert {n.split("_")[0] for n in queries()} == {f"op{k}" for k in range(1, 11)}

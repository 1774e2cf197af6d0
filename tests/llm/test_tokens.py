import random
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from helpers import docs, edge_rows, prose

from sealmark.llm import sp_codec as C
from sealmark.llm import token_output as T

P = pytest.importorskip("public_tokenizers")
BPE, PIECES = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


def odd_texts(r, n, letters="ab'st 1\n\n .,é\t☃!"):
    return ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(n)]


FIXED = ["", " ", "a b", "a  b", "a\nb", " a", "a ", "\na", "a\n", "it's 2 dogs' a", "x \ny", "x\n y", "a b", "a b c", "<|endoftext|>", "a <|endoftext|> b", "日本 語", "é 1²", "a\x1cb", "don't!!, (ok). ###"]


def test_encoder_equals_the_library():
    e = T.Encoder(BPE)
    texts = [*FIXED, *odd_texts(random.Random(1), 3000), *(prose(random.Random(k), 50).replace(" ", ".,! ", 3) for k in range(50))]
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _ in range(2):  # from the library, then from memory
        assert [np.frombuffer(b, np.int32).tolist() for b in e.encode(texts)] == want


def test_encoder_forgets(monkeypatch):
    monkeypatch.setattr(T, "REMEMBERED", 10)
    e = T.Encoder(BPE)
    for k in range(5):
        texts = [prose(random.Random(k), 60)]
        assert [np.frombuffer(b, np.int32).tolist() for b in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert len(e.seen) <= 400


class Counted(dict):
    looked = 0

    def __getitem__(self, key):
        self.looked += 1
        return super().__getitem__(key)

    def get(self, key, default=None):
        self.looked += 1
        return super().get(key, default)


def test_a_piece_is_looked_up_once_however_often_it_comes():
    e = T.Encoder(BPE)
    texts = [" ".join(["Größe", "ªº", "word", "it's,", f"own{k}"] * 50) + "\nword" for k in range(20)]
    e.seen = Counted()
    ids, at = e.ids(pa.array(["not this", *texts], pa.large_string()).slice(1))
    want = [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:])] == want
    assert e.seen.looked < 200  # of 5020 words, 27 different


def test_all_white_space_goes_to_the_library_whole():
    e = T.Encoder(BPE)
    space = [chr(k) for k in range(0x110000) if chr(k).isspace()]
    texts = [t for s in space for t in (f"a{s}b", f"a {s}b", f"{s}a", f"a{s}")]
    assert e.plain(pa.array(["a b\nc", *texts], pa.large_string())).tolist() == [True, *(t in ("a b", "a\nb") for t in texts)]
    assert [np.frombuffer(b, np.int32).tolist() for b in e.encode(texts)] == [x.ids for x in e.tokenizer.encode_batch(texts, add_special_tokens=False)]


def test_letters_are_pieces_of_their_own():
    e = T.Encoder(BPE)
    words = [chr(k) + "a" + chr(k) for k in range(0x21, 0x2000) if chr(k).isalpha()]
    text = "a " + " ".join(words)
    assert np.frombuffer(e.encode([text])[0], np.int32).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_files_round_trip(spark, tmp_path):
    rows = [*edge_rows(), *((k, prose(random.Random(k), 40)) for k in range(100, 160))]
    path = str(tmp_path / "tokens")
    T.write(docs(spark, rows), path, BPE, shards=3, row_group_bytes=1 << 16)
    e = T.Encoder(BPE)
    ordered = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, x[1] is not None, x[1] or ""))
    ids = [[*e.tokenizer.encode(t or "", add_special_tokens=False).ids, 0] for _, t in ordered]
    got = T.read_digests(spark, path).collect()
    want = sorted((str(k), len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for (k, _), x in zip(ordered, ids))
    assert sorted((str(x["doc_id"]), x["n_tokens"], x["ids_crc32"]) for x in got) == want
    in_order = sorted(got, key=lambda x: x["start"])  # ascending ids, rows without one first; rows of one id in any order
    assert [x["doc_id"] for x in in_order] == [k for k, _ in ordered]
    assert [x["start"] for x in in_order] == [sum(x["n_tokens"] for x in in_order[:k]) for k in range(len(in_order))]
    assert {(x["doc_id"], x["start"]) for x in T.read_offsets(spark, path).collect()} == {(x["doc_id"], x["start"]) for x in got}
    some = T.read_tokens(spark, path, 110, 112)
    assert {x["doc_id"]: list(x["ids"]) for x in some.collect()} == {k: y for (k, _), y in zip(ordered, ids) if k in (110, 111, 112)}
    assert "PushedFilters: [IsNotNull(doc_id), GreaterThanOrEqual(doc_id,110)" in some._jdf.queryExecution().toString()
    column = next(c for f in (tmp_path / "tokens").glob("*.parquet") for g in [pq.ParquetFile(f).metadata.row_group(0)] for c in [g.column(k) for k in range(g.num_columns)] if "ids" in c.path_in_schema)
    assert any("DICTIONARY" in x or "DELTA" in x for x in column.encodings) and column.has_offset_index


def test_rows_of_one_id_are_dealt_over_shards(spark, tmp_path):
    rows = [(7, prose(random.Random(k % 40), 20)) for k in range(400)]
    path = str(tmp_path / "one")
    T.write(docs(spark, rows).repartition(4), path, BPE, shards=8)
    per = [r["count"] for r in spark.read.parquet(path).groupBy("shard").count().collect()]
    assert len(per) >= 6 and max(per) < 200
    got = sorted(T.read_digests(spark, path).collect(), key=lambda x: x["start"])
    assert [x["start"] for x in got] == [sum(x["n_tokens"] for x in got[:k]) for k in range(400)]


def test_files_of_nothing(spark, tmp_path):
    path = str(tmp_path / "none")
    T.write(docs(spark, []).limit(0), path, BPE)
    assert T.read_digests(spark, path).collect() == []


@pytest.fixture(scope="module")
def sp():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def codec():
    return C.Model(PIECES)


TEXTS = ["", " ", "  ", "a", "hello world", "  hello  world\n\tfoo ﬁ é　x", "\n\n\na  b", "日本語テキスト𝕏 😀😀", "a" * 30, "abcabcabc" * 30, "the" * 50, "a\x00b", "     indentation        code\n        return x", "x² y²z 1²3 a_b ٣٤ ½a", "éạ́", "²."]


def many(r):
    return [*TEXTS, *odd_texts(r, 1500, "aeinrstlohdu  cmp\nABé1.,²"), *odd_texts(r, 150, "aeinrst"), *(prose(r, 60) for _ in range(20))]


def test_codec_equals_the_library(sp, codec):
    texts = many(random.Random(2))
    want = [sp.encode(t) for t in texts]
    assert [x.tolist() for x in codec.encode_texts([codec.normalised(t) for t in texts])] == want
    for t, ids in zip(texts, want):
        assert codec.decode(ids) == t == sp.decode(ids)


def test_scan_of_chunks_equals_the_whole(sp, codec):
    r = random.Random(3)
    for t in [*TEXTS, *r.sample(many(r), 150), "".join(r.choice("aeinrst") for _ in range(2000))]:
        for chunk in (1, 2, 5, 17, 64):
            assert C.encode_by_chunks(codec, codec.normalised(t), chunk) == sp.encode(t)


def test_product_is_associative(codec):
    text = codec.normalised("internationalisationofthestandards and more")
    a, b, c, *_ = [C.chunk_matrix(codec, *p) for p in C.chunk_parts(codec, text, 9)]
    assert C.product(C.product(a, b), c) == C.product(a, C.product(b, c))


def test_products_in_a_tree_give_the_states_of_a_pass(codec):
    r = random.Random(5)
    for n in (1, 30, 400, 1500):
        text = codec.normalised("".join(r.choice("aeinrst ") for _ in range(n)))
        matrices = [C.chunk_matrix(codec, *p) for p in C.chunk_parts(codec, text, 7)]
        for fan in (2, 3, 16):
            assert C.tree_states(matrices, fan) == C.inner_states(matrices)


def test_codec_on_tables(spark, sp):
    r = random.Random(7)
    giant = "".join(r.choice("aeinrstlo") for _ in range(3000)) + " " + prose(r, 800)
    rows = [*edge_rows(), (40, giant), (41, giant + "!"), (42, "☃" * 700)]
    out = C.encode(docs(spark, rows), PIECES, chunk=500)
    got = out.collect()
    assert len(got) == len(rows)
    want = {}
    for k, t in ((x[0], x[1]) for x in rows):
        want.setdefault(k, []).append(sp.encode(t or ""))
    for x in got:
        assert list(x["ids"]) in want[x["doc_id"]]
    assert max(x["n_chunks"] for x in got) > 100 and min(x["n_chunks"] for x in got) == 0
    d = C.digest(C.encode(docs(spark, rows), PIECES, chunk=500), PIECES).collect()
    assert len(d) == len(rows) and all(x["round_trip"] for x in d)
    assert sorted(map(str, C.encode(docs(spark, rows), PIECES, chunk=500, digests=True).collect())) == sorted(map(str, d))
    texts = {x["doc_id"]: x["text"] for x in C.decode(out, PIECES).collect()}
    assert texts[40] == giant and texts[1] == ""
    assert C.encode(docs(spark, []).limit(0), PIECES).collect() == []

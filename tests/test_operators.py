import datetime

import pytest
from pyspark.sql import functions as F

from sealmark.formats import schemas, Rejected
from sealmark.functions import builders, compose
from sealmark.functions.labels import AXES, UnknownHash, axis_name, composition_iri, digest_hex, is_label, is_operand, label, label_iri, operand_digest, sigma_axis, width
from sealmark.operators import navigate, registry, witness
from sealmark.operators.address import address, address_label, register, strict, with_labels
from sealmark.streaming.addresses import first_seen, with_address

FOO = "blake3:16b6abe0a77021b88cc14863d696df0c34f82556faadb318f46c384184f8ea71"


def one(df):
    (row,) = df.collect()
    return row


def test_outcomes(spark):
    df = spark.createDataFrame([('{"foo": "bar"}',), ("{",), (None,)], "v string")
    rows = [r["o"] for r in df.select(address("v", "json").alias("o")).collect()]
    assert [r["status"] for r in rows] == ["ok", "invalid", "null"]
    assert rows[0]["label"] == FOO and rows[0]["canonical_len"] == 13 and rows[1]["violation"] == "invalid_json" and rows[2]["label"] is None
    with pytest.raises(Exception, match="invalid-input"):
        df.select(strict(address("v", "json"))).collect()
    assert df.limit(0).select(address_label("v", "json")).collect() == []


def test_all_axes_and_widths(spark):
    df = spark.createDataFrame([('{"foo":"bar"}',)], "v string")
    r = one(with_labels(df, "v", "json"))
    assert r["label_blake3"] == FOO and r["label_sha256"].endswith("7a38bf81f383f69433ad6e900d35b3e2385593f76a7b7ab5d4355b8ba41ee24b")
    for a in AXES:
        assert len(r["label_" + a.replace("-", "_")]) == width(a) == len(one(df.select(label("v", a).alias("l")))["l"])
    assert axis_name(1) == "blake3"
    with pytest.raises(UnknownHash):
        axis_name("md5")


def test_label_parts(spark):
    df = spark.createDataFrame([(FOO,), ("nocolon",), ("sha256:XY",), ("blake3:" + "g" * 64,)], "l string")
    rows = df.select(sigma_axis("l").alias("a"), digest_hex("l").alias("h"), is_label("l").alias("ok"), is_operand("l").alias("op"), operand_digest("l").alias("d")).collect()
    assert rows[0]["a"] == "blake3" and rows[1]["a"] is None and [r["ok"] for r in rows] == [True, False, False, True] and [r["op"] for r in rows] == [True, False, False, False]
    assert bytes(rows[0]["d"]).hex() == rows[0]["h"] and rows[3]["d"] is None
    r = one(df.limit(1).select(label_iri(F.lit("blake3"), "urn:x/").alias("i"), composition_iri("g2", F.lit("sha512"), "urn:x").alias("c")))
    assert r["i"] == "urn:x/AddressLabel/blake3" and r["c"] == "urn:x/composition/g2-product/sha512"


@pytest.mark.parametrize("axis", AXES)
def test_composition_laws(spark, axis):
    hex_ = {"a": "0102" + "5a" * (width(axis) // 2), "z": "0" * 200, "f": "f" * 200, "8": "08" + "11" * 100}
    n = width(axis) - len(axis) - 1
    df = spark.createDataFrame([tuple(f"{axis}:{h[:n]}" for h in hex_.values())], "a string, z string, f string, e string")
    c = compose
    r = one(
        df.select(
            (c.compose_g2("a", "z", axis) == c.compose_g2("z", "a", axis)).alias("commutes"),
            (c.compose_f4("z", axis) == c.compose_f4("f", axis)).alias("folds"),
            (c.compose_e8("a", axis) != F.col("a")).alias("moves"),
            F.size(F.array_distinct(F.array(c.compose_g2("a", "a", axis), c.compose_e6("a", axis), c.compose_e8("a", axis)))).alias("different"),
            F.substring(c.canonical("e6", axis, "z"), 1, 1).alias("five"),
            F.substring(c.canonical("e6", axis, "e"), 1, 1).alias("six"),
            F.length(c.canonical("g2", axis, "a", "z")).alias("g"),
            F.length(c.canonical("e7", axis, "a")).alias("e7"),
            c.compose_status(axis, "a", F.lit("sha256:00")).alias("bad"),
        )
    )
    assert r["commutes"] and r["folds"] and r["moves"] and r["different"] == 3 and r["five"] == "\x05" and r["six"] == "\x06" and r["g"] == 2 * width(axis) and r["e7"] == width(axis) and r["bad"] == "malformed_operand"


def test_axis_mismatch(spark):
    df = spark.createDataFrame([(FOO,)], "a string")
    r = one(df.select(compose.operand_status("a", "sha256").alias("s"), compose.compose_e8("a", "sha256").alias("l")))
    assert r["s"] == "axis_mismatch" and r["l"] is None


def test_witness(spark):
    df = spark.createDataFrame([('{"a":1}', '{"a":2}')], "v string, w string")
    w = df.withColumn("o", address("v", "json", "keccak256")).withColumn("k", witness.mint(F.col("o")))
    r = one(
        w.select(
            witness.verify(F.col("k")).alias("ok"),
            witness.verify(F.col("k").withField("digest", F.lit(b"\0" * 32))).alias("other"),
            witness.verify(F.col("k").withField("label", F.lit("x"))).alias("short"),
            witness.reverify("v", "json", "keccak256", F.col("k")).alias("again"),
            witness.reverify("w", "json", "keccak256", F.col("k")).alias("changed"),
        )
    )
    assert tuple(r) == ("ok", "fingerprint_mismatch", "replay_failed", True, False)


def test_navigation(spark):
    df = spark.createDataFrame([('{"a":[1,"x"],"b":null}',), ("bad",)], "v string")
    rows = df.select(navigate.json_kind("v").alias("k"), navigate.json_get("v", "a").alias("a"), navigate.json_members("v").alias("m"), navigate.json_items(navigate.json_get("v", "a")).alias("i"), navigate.json_scalar(F.lit("1.50")).alias("s")).collect()
    assert rows[0]["k"] == "object" and rows[0]["a"] == '[1,"x"]' and [x["name"] for x in rows[0]["m"]] == ["a", "b"] and rows[0]["i"] == ["1", '"x"'] and rows[0]["s"] == "1.5" and rows[1]["k"] is None


def test_sql_functions(spark):
    names = register(spark)
    assert "json_address" in names and "compose_g2" in names
    assert spark.sql("select json_address(cast('{\"foo\": \"bar\"}' as binary)) as l").first()["l"] == FOO
    assert spark.sql("select json_address_with_hash('[1, 2]', 'sha512') as l").first()["l"].startswith("sha512:")
    a = "sha256:" + "01" * 32
    assert spark.sql(f"select compose_e7_sha256('{a}') as l").first()["l"] == one(spark.createDataFrame([(a,)], "a string").select(compose.compose_e7("a", "sha256").alias("l")))["l"]
    assert spark.sql("select compose_f4_sha256('sha256:zz') as l").first()["l"] is None


def test_builders(spark):
    df = spark.createDataFrame([(-129, "né")], "n long, t string")
    r = one(df.select(F.hex(builders.der_integer("n")).alias("i"), builders.atom("t").alias("a"), F.hex(builders.der_utf8("t")).alias("u"), F.hex(builders.der_boolean(F.lit(True))).alias("b"), F.hex(builders.der_octets(F.repeat(F.lit("x"), 300))).alias("o"), builders.ring_level(builders.ring_element(2, "n")).alias("k")))
    assert r["i"] == "0202FF7F" and r["a"] == "3:né" and r["u"] == "0C036EC3A9" and r["b"] == "0101FF" and r["o"].startswith("0482012C7878") and r["k"] == 2


@pytest.mark.parametrize("bad", ['{"@context":"https://schema.org","@type":"Article","headline":1,"author":"a","datePublished":"d"}', '{"@context":"https://schema.org","@type":"Article","headline":"h","author":[],"datePublished":"d"}', '{"@context":"https://schema.org","@type":"Article","headline":"h","author":"a","datePublished":""}', "[]", "{"])
def test_article_rejects(bad):
    with pytest.raises(Rejected, match="schema_violation"):
        schemas.article(bad.encode())


def test_photo_and_statement():
    photo = '{"@context":"https://schema.org","@type":"Photograph","contentUrl":"u","creator":%s}'
    assert schemas.photo((photo % '"x"').encode()) and schemas.photo((photo % '{"@type":"Person","name":"n"}').encode())
    for bad in ('{"@type":"Robot","name":"n"}', '{"@type":"Person"}', "1", "null"):
        with pytest.raises(Rejected):
            schemas.photo((photo % bad).encode())
    good = '{"_type":"https://in-toto.io/Statement/v1","subject":[{"name":"x","digest":{"sha256":"' + "0a" * 32 + '"}}],"predicateType":"p","predicate":{}}'
    assert schemas.statement(good.encode())
    for a, b in (("v1", "v2"), ("0a0a", "0A0A"), ('"x"', '""'), ('"p"', '""'), ("{}", "[]"), ("sha256", "sha1")):
        with pytest.raises(Rejected):
            schemas.statement(good.replace(a, b, 1).encode())


def test_registry(spark):
    df = spark.createDataFrame([(1, "a"), (2, "a"), (3, "b"), (4, None)], "k long, label string")
    assert {(r["label"], r["keeper"], r["n"]) for r in registry.dedupe(df, "label", "k").collect()} == {("a", 1, 2), ("b", 3, 1), (None, 4, 1)}
    assert [r["k"] for r in registry.missing(df.filter("label is not null"), df.filter("k = 1"), "label").collect()] == [3]
    assert registry.distinct_values(df, "label").count() == 3
    assert registry.collisions(df, "k", "label").count() == 1
    assert one(registry.partitioned(df.limit(0).union(spark.createDataFrame([(9, FOO)], "k long, label string")), "label"))["byte0"] == "16"


def test_stream(spark, tmp_path):
    t = datetime.datetime(2024, 1, 1)
    spark.createDataFrame([("{}", t), ("{ }", t), ("[]", t)], "v string, ts timestamp").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("v string, ts timestamp").parquet(str(tmp_path / "in"))
    out = first_seen(with_address(stream, "v", "json", "sha256").withColumn("label", F.col("address.label")), "label", "ts", "1 hour")
    q = out.select("label").writeStream.format("memory").queryName("seen").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("seen").count() == 2

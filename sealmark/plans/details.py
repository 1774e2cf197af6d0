"""One query for each operator whose rules the others don't show: known answers, limits, rejections, containers.

Inputs are made of table rows, so that every row asks something else; what SQL can't compute (digests of
other hashes, formats of model files) is compared with published answers or with laws that hold for any digest.
"""

from __future__ import annotations

import hashlib
import struct
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..formats import gguf, onnx, safetensors
from ..functions import builders, commitments, compose
from ..functions.labels import AXES, DIGEST_BYTES, composition_iri, hex_digest, label, label_iri
from ..functions.text import to_nfc, utf8_valid
from ..operators import witness
from ..operators.address import address, address_label, canonicalize, register
from ..operators.navigate import json_items, json_kind, json_members, json_scalar, json_tagged
from ..sources import tensors
from .base import Q_SQL, cases, json_text, made, query, quoted, read, text_of


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(k, name): the nations, a few numbered rows."""
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("bigint").alias("k"), F.col("n_name").alias("name"))


ROWS = "(select cast(n_nationkey as bigint) as k, n_name as name from nation)"


def _values(alias: str = "v", **columns: list) -> str:
    """A VALUES list with names."""
    put = lambda v: "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v)
    return "(values " + ", ".join("(" + ", ".join(map(put, row)) + ")" for row in zip(*columns.values(), strict=True)) + f") {alias}({', '.join(columns)})"


def verdicts(rows: DataFrame, format_: str, keep: tuple[str, ...] = ("k", "variant")) -> DataFrame:
    """keep, and ok or the rejection of each raw value."""
    return rows.select(*keep, canonicalize("raw", format_).alias("o")).select(*keep, F.coalesce("o.violation", F.lit("ok")).alias("verdict"))


def _verdicts_sql(**verdict: str) -> str:
    return f"select k, variant, verdict from {ROWS} r, {_values(variant=list(verdict), verdict=list(verdict.values()))}"


# --- hashes and labels ----------------------------------------------------------------------------------

# Published answers for the empty text and for abc.
KNOWN = {
    "sha256": ("e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"),
    "sha3-256": ("a7ffc6f8bf1ed76651c14756a061d662f580ff4de43b49fa82d80a4b80f8434a", "3a985da74fe225b2045c172d6bd390bd855f086e3e9d525b46bfe24511431532"),
    "keccak256": ("c5d2460186f7233c927e7db2dcc703c0e500b653ca82273b7bfad8045d85a470", "4e03657aea45a94fc7d47ba826c8d667c0d1e6e33a64a036ec44f58fa12d6c45"),
    "blake3": ("af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262", "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85"),
    "sha512": (
        "cf83e1357eefb8bdf1542850d66d8007d620e4050b5715dc83f4a921d36ce9ce47d0d13c5d85f2b0ff8318d2877eec2f63b931bd47417a81a538327af927da3e",
        "ddaf35a193617abacc417349ae20413112e6fa4e89a97ea20a9eeee64b55d39a2192992a274fc1a836ba3c23a3feebbd454d4423643ce80e2a9ac94fa54ca49f",
    ),
}
# Published answers of BLAKE3 for the bytes 0, 1, ..., 250, 0, 1, ... up to a size.
KNOWN_BLAKE3 = {
    1023: "10108970eeda3eb932baac1428c7a2163b0e924c9a9e25b35bba72b28f70bd11",
    1024: "42214739f095a406f3fc83deb889744ac00df831c10daa55189b5d121c855af7",
    1025: "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444",
    2048: "e776b6028c7cd22a4d0ba182a8bf62205d2ef576467e838ed6f2529b85fba24a",
    2049: "5f4d72f40d7a5f82b15ca2b2e44b1de3c2ef86c426c95c1af0b6879522563030",
    3072: "b98cb0ff3623be03326b373de6b9095218513e64f1ee2edd2525c7ad1e5cffd2",
    3073: "7124b49501012f81cc7f11ca069ec9226cecb8a2c850cfe644e327d22d3e1cd3",
    4096: "015094013f57a5277b59d8475c0501042c0b642e531b0a1c8f58d2163229e969",
    4097: "9b4052b38f1c5fc8b1f9ff7ac7b27cd242487b3d890d15c96a1c25b8aa0fb995",
    8192: "aae792484c8efe4f19e2ca7d371d8c467ffb10748d8a5a1ae579948f718a2a63",
    8193: "bab6c09cb8ce8cf459261398d2e7aef35700bf488116ceb94a36d0f5f1b7bc3b",
    31744: "62b6960e1a44bcc1eb1a611a8d6235b6b4b78f32e7abc4fb4c6cdcce94895c47",
    102400: "bc3e3d41a1146b069abffad3c0d44860cf664390afce4d9661f7902e7943e085",
    1048577: "2f053cd7472cf0cd2f9adaf45c1180255b91b9a865404a63671a0ee5f792ed33",
}


@query("select * from " + _values(axis=[a for a in KNOWN for _ in "ab"], input=["", "abc"] * len(KNOWN), hex=[h for pair in KNOWN.values() for h in pair]))
def hash_known_answers(spark, sf_dir):
    rows = spark.createDataFrame([("",), ("abc",)], "input string")
    axes = F.array(*(F.struct(F.lit(a).alias("axis"), hex_digest("input", a).alias("hex")) for a in KNOWN))
    return rows.select("input", F.explode(axes).alias("x")).select("x.axis", "input", "x.hex")


@query("select cast(n as bigint) as n, hex from " + _values(n=list(KNOWN_BLAKE3), hex=list(KNOWN_BLAKE3.values())))
def blake3_known_answers(spark, sf_dir):
    sizes = spark.createDataFrame([(n,) for n in KNOWN_BLAKE3], "n bigint")
    raw = made(lambda n: (bytes(range(251)) * (n // 251 + 1))[:n], "n")
    return sizes.select("n", hex_digest(raw, "blake3").alias("hex"))


@query("select c_custkey, sha256(c_name || repeat('x', cast(c_custkey % 300 as integer))) as hex, 128 as sha512_digits, true as sha3_is_not_keccak from customer")
def digests_by_size(spark, sf_dir):
    """Sizes around every block of the hashes."""
    text = F.concat("c_name", F.repeat(F.lit("x"), (F.col("c_custkey") % 300).cast("int")))
    wide = read(spark, sf_dir, "customer").select("c_custkey", *(hex_digest(text, a).alias(a.replace("-", "_")) for a in AXES))
    return wide.select("c_custkey", F.col("sha256").alias("hex"), F.length("sha512").alias("sha512_digits"), ((F.col("sha3_256") != F.col("keccak256")) & (F.col("keccak256") != F.col("blake3"))).alias("sha3_is_not_keccak"))


_BASE = "https://example.org/types"
_IRI_NAMES = {"g2": "g2-product", "f4": "f4-quotient", "e6": "e6-filtration", "e7": "e7-augmentation", "e8": "e8-embedding"}


@query(
    f"select axis, operation, '{_BASE}/AddressLabel/' || axis as label_iri, '{_BASE}/composition/' || name || '/' || axis as composition_iri from "
    + _values(axis=list(DIGEST_BYTES))
    + ", "
    + _values("w", operation=list(_IRI_NAMES), name=list(_IRI_NAMES.values()))
)
def type_iris(spark, sf_dir):
    axes = spark.createDataFrame([(a,) for a in AXES], "axis string")
    each = F.array(*(F.struct(F.lit(o).alias("operation"), composition_iri(o, "axis", _BASE).alias("composition_iri")) for o in _IRI_NAMES))
    return axes.select("axis", label_iri("axis", _BASE).alias("label_iri"), F.explode(each).alias("x")).select("axis", "x.operation", "label_iri", "x.composition_iri")


# What each format says about a row's name, and its canonical form as SQL.
_SAMPLES = {
    "json": (lambda: json_text("n", quoted("name")), """'{"n":"' || name || '"}'"""),
    "sexp": (lambda: F.concat(F.lit("(n "), builders.atom("name"), F.lit(")")), "'(1:n ' || length(name) || ':' || name || ')'"),
    "xml": (lambda: F.concat(F.lit("<n b='1' a='"), "name", F.lit("'/>")), """'<n a="' || name || '" b="1"></n>'"""),
    "asn1": (lambda: builders.der_utf8("name"), "unhex('0C' || printf('%02X', strlen(name)) || hex(name))"),
    "cbor": (lambda: F.unhex(F.concat(F.lit("78"), F.lpad(F.hex(F.octet_length("name").cast("bigint")), 2, "0"), F.hex("name"))), "unhex(printf('%02X', 96 + strlen(name)) || hex(name))"),
    "ring": (lambda: builders.ring_element(1, "k"), "unhex('01' || printf('%02X', k) || '00')"),
    "codemodule": (lambda: builders.module("name", builders.atom(F.col("k").cast("string"))), "'(3:mod ' || length(name) || ':' || name || ' ' || length(k::varchar) || ':' || k || ')'"),
    "schema_photo": (
        lambda: F.concat(F.lit('{"creator":"'), "name", F.lit('","contentUrl":"u","@type":"Photograph","@context":"https://schema.org"}')),
        """'{"@context":"https://schema.org","@type":"Photograph","contentUrl":"u","creator":"' || name || '"}'""",
    ),
    "schema_document": (
        lambda: F.concat(F.lit('{"headline":"'), "name", F.lit('","author":"A","datePublished":"2025-01-15","@type":"Article","@context":"https://schema.org"}')),
        """'{"@context":"https://schema.org","@type":"Article","author":"A","datePublished":"2025-01-15","headline":"' || name || '"}'""",
    ),
    "schema_codemodule_signed": (
        lambda: F.concat(F.lit('{"subject":[{"name":"'), "name", F.lit('","digest":{"sha256":"'), F.sha2("name", 256), F.lit('"}}],"predicateType":"p","predicate":{},"_type":"https://in-toto.io/Statement/v1"}')),
        """'{"_type":"https://in-toto.io/Statement/v1","predicate":{},"predicateType":"p","subject":[{"digest":{"sha256":"' || sha256(name) || '"},"name":"' || name || '"}]}'""",
    ),
}


@query(" union all ".join(f"select '{f}' as format, k, 'sha256:' || sha256({sql}) as label from {ROWS} r" for f, (_, sql) in _SAMPLES.items()))
def every_format_sha256(spark, sf_dir):
    """Value for value; the three schemas' labels are those of their JSON."""
    rows = _rows(spark, sf_dir)
    each = F.array(*(F.struct(F.lit(f).alias("format"), address_label(raw(), f, "sha256").alias("label")) for f, (raw, _) in _SAMPLES.items()))
    return rows.select("k", F.explode(each).alias("x")).select("x.format", "k", "x.label")


def _file(format_: str, k: int) -> bytes:
    data = struct.pack("<q", k)
    if format_ == "gguf":
        return gguf.build([], [("w", (8,), 24, data)])
    if format_ == "safetensors":
        return safetensors.build('{"w":{"dtype":"I8","shape":[8],"data_offsets":[0,8]}}', data)
    return _model(_graph(weights=[onnx.message((1, 8), (2, 3), (8, "w"), (9, data))]))


@query(
    "select format, axis, (select count(*) from nation) as n, (select count(*) from nation) as n_distinct, width from "
    + _values(format=[*_SAMPLES, "gguf", "safetensors", "onnx"])
    + ", "
    + _values("w", axis=list(DIGEST_BYTES), width=[len(a) + 1 + 2 * n for a, n in DIGEST_BYTES.items()])
)
def every_format_every_axis(spark, sf_dir):
    """Of every format on every axis: labels, different ones, and their width."""
    rows = _rows(spark, sf_dir)
    raw = {f: make() for f, (make, _) in _SAMPLES.items()} | {f: made(lambda k, f=f: _file(f, k), "k") for f in ("gguf", "safetensors", "onnx")}
    forms = F.array(*(F.struct(F.lit(f).alias("format"), F.lit(a).alias("axis"), address_label(r, f, a).alias("label")) for f, r in raw.items() for a in AXES))
    long = rows.select(F.explode(forms).alias("x")).select("x.*")
    return long.groupBy("format", "axis").agg(F.count("label").alias("n"), F.countDistinct("label").alias("n_distinct"), F.max(F.length("label")).alias("width"))


@query(" union all ".join(f"select '{f}' as format, k, 'sha256:' || sha256({sql}) as label from {ROWS} r" for f, (_, sql) in _SAMPLES.items() if f in ("json", "sexp", "xml", "schema_photo")))
def sql_entry_points(spark, sf_dir):
    """The registered SQL functions, with the axis as an argument."""
    register(spark)
    rows = _rows(spark, sf_dir)
    parts = []
    for f in ("json", "sexp", "xml", "schema_photo"):
        at = rows.select("k", _SAMPLES[f][0]().cast("binary").alias("raw"))
        parts.append(at.select(F.lit(f).alias("format"), "k", F.expr(f"{f}_address_with_hash(raw, 'sha256')").alias("label")))
    return parts[0].union(parts[1]).union(parts[2]).union(parts[3])


# --- Unicode and JSON -----------------------------------------------------------------------------------


@query("select c_custkey, c_custkey % 40 <= 32 as composed, case when c_custkey % 40 <= 32 then 'ok' else 'invalid_json' end as json from customer")
def nfc_run_limit(spark, sf_dir):
    """A letter with 0 to 39 marks; 33 are too many."""
    text = F.concat(F.lit("a"), F.repeat(F.lit("\u0323"), (F.col("c_custkey") % 40).cast("int")), "c_name")
    return read(spark, sf_dir, "customer").select("c_custkey", to_nfc(text).isNotNull().alias("composed"), F.coalesce(canonicalize(quoted(text), "json")["violation"], F.lit("ok")).alias("json"))


@query("select c_custkey, cast(c_custkey % 2 = 0 as boolean) as valid from customer")
def utf8_validity(spark, sf_dir):
    raw = F.concat(F.col("c_name").cast("binary"), F.when(F.col("c_custkey") % 2 == 0, F.unhex(F.lit("C3A9"))).otherwise(F.unhex(F.lit("EDA080"))))
    return read(spark, sf_dir, "customer").select("c_custkey", utf8_valid(raw).alias("valid"))


@query(f"select k, case when 1012 + k <= 1024 then 'ok' else 'invalid_json' end as around_number, case when 1012 + k <= 1025 then 'ok' else 'invalid_json' end as empty from {ROWS} r")
def json_depth_limit(spark, sf_dir):
    depth = (F.col("k") + 1012).cast("int")
    up, down = F.repeat(F.lit("["), depth), F.repeat(F.lit("]"), depth)
    rows = _rows(spark, sf_dir).select("k", F.concat(up, F.lit("1"), down).alias("a"), F.concat(up, down).alias("b"))
    return rows.select("k", *(F.coalesce(canonicalize(c, "json")["violation"], F.lit("ok")).alias(n) for c, n in (("a", "around_number"), ("b", "empty"))))


_KINDS = {
    "text": (lambda: quoted("c_name"), "'string'", "c_name"),
    "number": (lambda: F.concat("c_custkey", F.lit(".0e1")), "'number'", "cast(cast(c_custkey * 10 as double) as varchar)"),
    "boolean": (lambda: F.when(F.col("c_custkey") % 2 == 0, " true").otherwise("false "), "case when c_custkey % 2 = 0 then 'true' else 'false' end", "case when c_custkey % 2 = 0 then 'true' else 'false' end"),
    "nothing": (lambda: F.lit("null"), "'null'", "null"),
    "list": (lambda: F.concat(F.lit("["), "c_custkey", F.lit("]")), "'array'", "null"),
    "bad": (lambda: F.concat(F.lit("["), "c_custkey"), "null", "null"),
}


@query(" union all ".join(f"select c_custkey, '{v}' as variant, {kind} as kind, {scalar} as scalar from customer" for v, (_, kind, scalar) in _KINDS.items()))
def json_scalars(spark, sf_dir):
    rows = cases(read(spark, sf_dir, "customer"), {v: make() for v, (make, *_) in _KINDS.items()}, ("c_custkey",))
    return rows.select("c_custkey", "variant", json_kind("raw").alias("kind"), json_scalar("raw").alias("scalar"))


@query(
    """select c_custkey, cast(i as integer) as place, case i when 0 then cast(c_custkey as varchar) when 1 then '"' || c_name || '"' else '{"a":[],"b":null}' end as item
 from customer, range(0, 3) t(i)"""
)
def json_array_items(spark, sf_dir):
    raw = F.concat(F.lit("[ "), "c_custkey", F.lit(" ,\n"), quoted("c_name"), F.lit(', {"b" : null, "a" : [ ]}]'))
    return read(spark, sf_dir, "customer").select("c_custkey", F.posexplode(json_items(raw)).alias("place", "item"))


@query(
    """select c_custkey, cast(i as integer) as place, case i when 0 then 'z' when 1 then '\u00e9' else 'a' end as name, case i when 0 then cast(c_custkey as varchar) when 1 then '"' || c_name || '"' else 'true' end as item
 from customer, range(0, 3) t(i)"""
)
def json_object_members(spark, sf_dir):
    """In the order of the text, names composed."""
    raw = F.concat(F.lit('{"z":'), "c_custkey", F.lit(',"e\u0301":'), quoted("c_name"), F.lit(',"a":true}'))
    return read(spark, sf_dir, "customer").select("c_custkey", F.posexplode(json_members(raw)).alias("place", "x")).select("c_custkey", "place", "x.name", F.col("x.value").alias("item"))


@query(
    """select c_custkey, '06' || printf('%016X', 1) || printf('%016X', 1) || hex('k') || '05' || printf('%016X', 4) || '03' || printf('%016X', strlen(c_custkey::varchar)) || hex(c_custkey::varchar)
 || '00' || '02' || '04' || printf('%016X', strlen(c_name)) || hex(c_name) as tagged from customer"""
)
def json_tagged_bytes(spark, sf_dir):
    raw = F.concat(F.lit('{"k":['), "c_custkey", F.lit(",null,true,"), quoted("c_name"), F.lit("]}"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.hex(json_tagged(raw)).alias("tagged"))


# --- XML ------------------------------------------------------------------------------------------------


@query("""select s_suppkey, '<e a="&lt;&gt;&amp;&quot;&#x9;&#xA;&#xD;''' || s_name || '"></e>' as canonical from supplier""")
def xml_attribute_escape(spark, sf_dir):
    raw = F.concat(F.lit("<e a=\"&lt;>&#38;&quot;&#9;\n&#xd;&apos;"), "s_name", F.lit('"/>'))
    return read(spark, sf_dir, "supplier").select("s_suppkey", text_of(canonicalize(raw, "xml")["canonical"]).alias("canonical"))


@query("""select s_suppkey, '<r>' || chr(cast(65 + s_suppkey % 26 as integer)) || chr(cast(12354 + s_suppkey % 26 as integer)) || '''"&lt;&amp;</r>' as canonical from supplier""")
def xml_references(spark, sf_dir):
    code = F.col("s_suppkey") % 26
    raw = F.concat(F.lit("<r>&#"), code + 65, F.lit(";&#x"), F.hex(code + 12354), F.lit(";&apos;&quot;&lt;&amp;</r>"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", text_of(canonicalize(raw, "xml")["canonical"]).alias("canonical"))


@query("""select s_suppkey, '<r><?go ' || s_name || '?>t<?stop?></r>' as canonical from supplier""")
def xml_instructions(spark, sf_dir):
    raw = F.concat(F.lit("<r><?go  "), "s_name", F.lit("  ?>t<?stop ?></r>"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", text_of(canonicalize(raw, "xml")["canonical"]).alias("canonical"))


_XML_BAD = ("entity", "unended", "surrogate", "beyond", "root_instruction", "prolog", "comment", "doctype", "mismatch", "open", "two_roots", "text_root")


@query(_verdicts_sql(**dict.fromkeys(_XML_BAD, "invalid_xml"), fine="ok"))
def xml_verdicts(spark, sf_dir):
    n = F.col("name")
    at = lambda before, after: F.concat(F.lit(before), n, F.lit(after))
    forms = {
        "entity": at("<r>&", ";</r>"), "unended": at("<r>&amp", "</r>"), "surrogate": at("<r>&#xD800;", "</r>"), "beyond": at("<r>&#x110000;", "</r>"),
        "root_instruction": at("<?p ", "?><r/>"), "prolog": at('<?xml version="1.0"?><r>', "</r>"), "comment": at("<r><!--", "--></r>"), "doctype": at("<!DOCTYPE ", "><r/>"),
        "mismatch": at("<a><b>", "</a></b>"), "open": at("<a>", ""), "two_roots": at("<a/><", "/>"), "text_root": n, "fine": at("<r x='", "'/>\n"),
    }
    return verdicts(cases(_rows(spark, sf_dir), forms, ("k",)), "xml")


# --- CBOR and DER ---------------------------------------------------------------------------------------


@query("select s_suppkey, 'sha256:' || sha256(unhex('D820' || printf('%02X', 96 + strlen(s_name)) || hex(s_name))) as label from supplier")
def cbor_tagged_text(spark, sf_dir):
    """Tag 32 and the text's length in more bytes than they need."""
    raw = F.unhex(F.concat(F.lit("DA000000207A"), F.lpad(F.hex(F.octet_length("s_name").cast("bigint")), 8, "0"), F.hex("s_name")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", address_label(raw, "cbor", "sha256").alias("label"))


@query("select s_suppkey, '75' || '65CC81' || hex(s_name) as canonical from supplier")
def cbor_text_stays_decomposed(spark, sf_dir):
    raw = F.unhex(F.concat(F.lit("7F6365CC8172"), F.hex("s_name"), F.lit("FF")))
    return read(spark, sf_dir, "supplier").select("s_suppkey", F.hex(canonicalize(raw, "cbor")["canonical"]).alias("canonical"))


_CBOR_BAD = ("trailing", "reserved", "truncated", "nested_chunk", "mixed_chunk", "twice", "simple", "not_utf8", "deep", "empty", "lone_break", "odd_map")


@query(_verdicts_sql(**dict.fromkeys(_CBOR_BAD, "invalid_cbor"), fine="ok", not_quite_deep="ok"))
def cbor_verdicts(spark, sf_dir):
    byte = F.lpad(F.hex("k"), 2, "0")  # 0 to 24, an unsigned integer up to 23
    small = F.lpad(F.hex(F.col("k") % 24), 2, "0")
    h = lambda before, after="", of=small: F.unhex(F.concat(F.lit(before), of, F.lit(after)))
    forms = {
        "trailing": h("00"), "reserved": h("1C"), "truncated": h("19"), "nested_chunk": h("5F5F41", "FFFF"), "mixed_chunk": h("5F61", "FF"), "twice": F.unhex(F.concat(F.lit("A2"), small, F.lit("00"), small, F.lit("01"))),
        "simple": h("F8", "", byte), "not_utf8": F.unhex(F.concat(F.lit("62FF"), small)), "deep": F.unhex(F.concat(F.repeat(F.lit("81"), 1025), small)), "empty": F.unhex(F.lit("")), "lone_break": h("82", "FF"), "odd_map": h("BF", "FF"),
        "fine": h("83", "F5F6"), "not_quite_deep": F.unhex(F.concat(F.repeat(F.lit("81"), 1024), small)),
    }
    return verdicts(cases(_rows(spark, sf_dir), forms, ("k",)), "cbor")


@query(
    f"""select k, case when k = 0 then 'F98000' else 'F93C00' end as one, 'F97E00' as nan, 'FA' || printf('%08X', 1203982336 + k * 64) as single, case when k % 2 = 0 then 'F97C00' else 'F9FC00' end as infinite from {ROWS} r"""
)
def cbor_floats(spark, sf_dir):
    """One, a NaN with other bits, 100000 + k / 2, and an infinity, each as a double; minus zero for the first row's one."""
    k = F.col("k")
    zero = F.when(k == 0, F.unhex(F.lit("FB8000000000000000"))).otherwise(F.unhex(F.lit("FB3FF0000000000000")))
    nan = F.unhex(F.concat(F.lit("FB7FF80000000000"), F.lpad(F.hex(k + 1), 2, "0")))
    single = made(lambda k: b"\xfb" + struct.pack(">d", 100000 + k / 2), "k")
    infinite = F.when(k % 2 == 0, F.unhex(F.lit("FB7FF0000000000000"))).otherwise(F.unhex(F.lit("FBFFF0000000000000")))
    return _rows(spark, sf_dir).select("k", *(F.hex(canonicalize(c, "cbor")["canonical"]).alias(n) for c, n in ((zero, "one"), (nan, "nan"), (single, "single"), (infinite, "infinite"))))


@query(f"select k, '0302' || '03' || printf('%02X', k * 8) as bits, k = 0 as odd_admitted from {ROWS} r")
def der_bit_strings(spark, sf_dir):
    byte = lambda c: F.unhex(F.lpad(F.hex(c), 2, "0"))
    bits, odd = builders.der_bit_string(byte(F.col("k") * 8), 3), builders.der_bit_string(byte(F.col("k")), 7)
    return _rows(spark, sf_dir).select("k", F.hex(canonicalize(bits, "asn1")["canonical"]).alias("bits"), odd.isNotNull().alias("odd_admitted"))


@query(f"""select k, '06' || printf('%02X', 3 + case when k * 20 < 128 then 1 else 2 end) || '2A' || printf('%02X%02X', 128 + ((840 + k) >> 7), (840 + k) & 127)
 || case when k * 20 < 128 then printf('%02X', k * 20) else printf('%02X%02X', 128 + ((k * 20) >> 7), (k * 20) & 127) end as oid, k < 3 as root_admitted from {ROWS} r""")
def der_object_identifiers(spark, sf_dir):
    k = F.col("k")
    oid = builders.der_object_identifier(F.array(F.lit(1).cast("bigint"), F.lit(2).cast("bigint"), k + 840, k * 20))
    root = builders.der_object_identifier(F.array(k, F.lit(39).cast("bigint")))
    return _rows(spark, sf_dir).select("k", F.hex(canonicalize(oid, "asn1")["canonical"]).alias("oid"), root.isNotNull().alias("root_admitted"))


@query(
    """select p_partkey, '0C' || printf('%02X', strlen(p_name)) || hex(p_name) as utf8, '13' || printf('%02X', strlen(p_name)) || hex(p_name) as printable, '16' || printf('%02X', strlen(p_brand)) || hex(p_brand) as ia5,
 true as brand_is_not_printable, true as accent_is_not_ia5 from part"""
)
def der_strings(spark, sf_dir):
    good = {"utf8": builders.der_utf8("p_name"), "printable": builders.der_printable("p_name"), "ia5": builders.der_ia5("p_brand")}
    return read(spark, sf_dir, "part").select(
        "p_partkey",
        *(F.hex(canonicalize(c, "asn1")["canonical"]).alias(n) for n, c in good.items()),
        builders.der_printable("p_brand").isNull().alias("brand_is_not_printable"),  # a brand has a #
        builders.der_ia5(F.concat("p_brand", F.lit("é"))).isNull().alias("accent_is_not_ia5"),
    )


@query(f"""select k, 'sha256:' || sha256(unhex('04' || case when n < 128 then printf('%02X', n) when n < 256 then '81' || printf('%02X', n) when n < 65536 then '82' || printf('%04X', n) else '83' || printf('%06X', n) end || repeat('41', cast(n as integer)))) as label
 from (select k, k * k * k * 10 as n from {ROWS} r)""")
def der_long_lengths(spark, sf_dir):
    """Octet strings of 0 to 138240 bytes."""
    raw = builders.der_octets(F.repeat(F.lit("A"), (F.col("k") * F.col("k") * F.col("k") * 10).cast("int")))
    return _rows(spark, sf_dir).select("k", address_label(raw, "asn1", "sha256").alias("label"))


_DER_BAD = ("indefinite", "long_form", "padded", "padded_negative", "boolean", "unused", "unused_bits", "arc", "unended_arc", "utf8", "printable", "ia5", "unknown", "truncated", "trailing", "overlap")


@query(_verdicts_sql(**dict.fromkeys(_DER_BAD, "invalid_der"), fine="ok"))
def der_verdicts(spark, sf_dir):
    small = F.lpad(F.hex("k"), 2, "0")
    h = lambda before, after="": F.unhex(F.concat(F.lit(before), small, F.lit(after)))
    forms = {
        "indefinite": h("3080", "0000"), "long_form": h("048101"), "padded": h("020200"), "padded_negative": F.unhex(F.concat(F.lit("0202FF"), F.hex(F.col("k") + 128))), "boolean": F.unhex(F.concat(F.lit("0101"), F.lpad(F.hex(F.col("k") + 1), 2, "0"))),
        "unused": h("030208"), "unused_bits": F.unhex(F.concat(F.lit("030207"), F.lpad(F.hex(F.col("k") + 1), 2, "0"))), "arc": h("06032A80"), "unended_arc": F.unhex(F.concat(F.lit("06022A"), F.hex(F.col("k") + 128))), "utf8": h("0C02FF"), "printable": h("130323", "41"), "ia5": F.unhex(F.concat(F.lit("1601"), F.hex(F.col("k") + 128))),
        "unknown": h("1901"), "truncated": h("0403"), "trailing": h("0500"), "overlap": h("30020403"), "fine": h("30030201"),
    }
    return verdicts(cases(_rows(spark, sf_dir), forms, ("k",)), "asn1")


@query(f"""select k, cast(least(k, 4) as integer) as level_byte, case when k <= 3 then cast(k as integer) end as level, k <= 3 as valid from {ROWS} r""")
def ring_levels(spark, sf_dir):
    """Levels 0 to 3 with one byte more than the level; 4 is none."""
    level = F.least(F.col("k"), F.lit(4)).cast("int")
    raw = F.unhex(F.concat(F.lpad(F.hex(level), 2, "0"), F.repeat(F.lit("AB"), level + 1)))
    return _rows(spark, sf_dir).select("k", level.alias("level_byte"), builders.ring_level(raw).alias("level"), canonicalize(raw, "ring")["violation"].isNull().alias("valid"))


# --- S-expressions --------------------------------------------------------------------------------------

_SEXP_BAD = ("open", "close", "short", "null_byte", "two", "two_lists", "longer")


@query(_verdicts_sql(**dict.fromkeys(_SEXP_BAD, "invalid_sexp"), fine="ok", deep="ok", bare="ok"))
def sexp_verdicts(spark, sf_dir):
    n = F.col("name")
    at = lambda before, after="": F.concat(F.lit(before), n, F.lit(after))
    forms = {
        "open": at("(("), "close": at("(", "))"), "short": at("99:"), "null_byte": F.unhex(F.concat(F.lit("28"), F.hex(n), F.lit("FF29"))), "two": at("", " more"), "two_lists": at("(", ")(b)"), "longer": at("1:"),
        "fine": at("(a (", ") 0:)"), "deep": F.concat(F.repeat(F.lit("("), 4096), n, F.repeat(F.lit(")"), 4096)), "bare": n,
    }
    return verdicts(cases(_rows(spark, sf_dir), forms, ("k",)), "sexp")


# --- compositions, commitments, witnesses ---------------------------------------------------------------


def _operand(axis: str, name: str) -> Column:
    """A label of an axis with the hex of SHA-256 for its digest."""
    one = F.sha2(name, 256)
    return F.concat(F.lit(axis + ":"), one, *([F.sha2(one, 256)] if DIGEST_BYTES[axis] == 64 else []))


def _composed_sql(axis: str) -> str:
    n = DIGEST_BYTES[axis] // 2
    quarters = ", ".join(f"substr(h, {1 + k * n}, {n})" for k in range(4))
    forms = {
        "g2": "least(a, b) || greatest(a, b)",
        "f4": f"'{axis}:' || least(h, translate(h, '0123456789abcdef', 'fedcba9876543210'))",
        "e6": "case when ('0x' || substr(h, 1, 2))::int % 9 = 8 then chr(6) else chr(5) end || a",
        "e7": f"'{axis}:' || array_to_string(list_sort([{quarters}]), '')",
        "e8": "a",
    }
    hex_ = "sha256({0}) || sha256(sha256({0}))" if DIGEST_BYTES[axis] == 64 else "sha256({0})"
    operands = f"(select c_custkey, {hex_.format('c_name')} as h, '{axis}:' || {hex_.format('c_name')} as a, '{axis}:' || {hex_.format('c_mktsegment')} as b from customer)"
    return " union all ".join(f"select c_custkey, '{axis}' as axis, '{o}' as operation, {form} as canonical from {operands} t" for o, form in forms.items())


@query(" union all ".join(_composed_sql(a) for a in DIGEST_BYTES))
def compose_canonical_every_axis(spark, sf_dir):
    """What each operation hashes, on all five axes."""
    c = read(spark, sf_dir, "customer")
    forms = [F.struct(F.lit(x).alias("axis"), F.lit(o).alias("operation"), compose.canonical(o, x, _operand(x, "c_name"), _operand(x, "c_mktsegment")).alias("canonical")) for x in AXES for o in compose.OPERATIONS]
    return c.select("c_custkey", F.explode(F.array(*forms)).alias("x")).select("c_custkey", "x.axis", "x.operation", "x.canonical")


@query("select axis, operation, count(*) as n, count(*) as n_hash_of_canonical, count(*) as n_commutes, width from customer, " + _values(axis=list(DIGEST_BYTES), width=[len(a) + 1 + 2 * n for a, n in DIGEST_BYTES.items()]) + ", " + _values("w", operation=list(_IRI_NAMES)) + " group by axis, operation, width")
def compose_labels_every_axis(spark, sf_dir):
    """Composed labels are those of the canonical texts; the product doesn't depend on the order.

    Each axis is a plan of its own, over operands that are columns: an expression names an operand many times.
    """
    c = read(spark, sf_dir, "customer")
    made_ = {"g2": compose.compose_g2, "f4": compose.compose_f4, "e6": compose.compose_e6, "e7": compose.compose_e7, "e8": compose.compose_e8}

    def of_axis(x: str) -> DataFrame:
        forms = []
        for o, f in made_.items():
            got = f("a", "b", axis=x) if o == "g2" else f("a", axis=x)
            again = f("b", "a", axis=x) if o == "g2" else got
            forms.append(F.struct(F.lit(x).alias("axis"), F.lit(o).alias("operation"), got.alias("label"), label(compose.canonical(o, x, "a", "b"), x).alias("want"), again.alias("again")))
        operands = c.select(_operand(x, "c_name").alias("a"), _operand(x, "c_mktsegment").alias("b"))
        return operands.select(F.explode(F.array(*forms)).alias("x")).select("x.*")

    long = reduce(DataFrame.unionAll, map(of_axis, AXES))
    same = lambda p, q: F.sum(F.when(F.col(p) == F.col(q), 1).otherwise(0))
    return long.groupBy("axis", "operation").agg(F.count("label").alias("n"), same("label", "want").alias("n_hash_of_canonical"), same("label", "again").alias("n_commutes"), F.max(F.length("label")).alias("width"))


@query(
    """select c_custkey, h <= '40' || repeat('0', 62) as at_most_quarter, h <= repeat('f', 64) as at_most_all, right(h, 1) in ('5') as close4, right(h, 2) = 'a5' as close8, right(h, 16) = right(sha256('Customer#000000001'), 16) as close64
 from (select c_custkey, sha256(c_name) as h from customer)"""
)
def commitments_thresholds(spark, sf_dir):
    h = F.sha2("c_name", 256)
    one = hashlib.sha256(b"Customer#000000001").hexdigest()
    return read(spark, sf_dir, "customer").select(
        "c_custkey",
        commitments.at_most(h, "40" + "0" * 62).alias("at_most_quarter"),
        commitments.at_most(h, "F" * 64).alias("at_most_all"),
        commitments.close_to(h, "0" * 62 + "a5", 4).alias("close4"),
        commitments.close_to(h, "0" * 62 + "a5", 8).alias("close8"),
        commitments.close_to(h, one, 64).alias("close64"),
    )


@query(
    """select c_custkey, k, right(h, k // 4) = right(other, k // 4) as close from
 (select c_custkey, sha256(c_name) as h, repeat('0', 64 - cast(c_custkey % 65 as integer)) || right(sha256(c_name), cast(c_custkey % 65 as integer)) as other from customer), (values (0), (4), (60), (64), (68), (128), (256)) t(k)"""
)
def commitments_proximity(spark, sf_dir):
    """Any number of bits up to the whole digest, against a reference that shares a row's last digits with it."""
    h = F.sha2("c_name", 256)
    digits = (F.col("c_custkey") % 65).cast("int")
    other = F.concat(F.repeat(F.lit("0"), 64 - digits), F.substr(h, F.lit(65) - digits, digits))
    each = F.array(*(F.struct(F.lit(k).alias("k"), commitments.close_to(h, other, k).alias("close")) for k in (0, 4, 60, 64, 68, 128, 256)))
    return read(spark, sf_dir, "customer").select("c_custkey", F.explode(each).alias("x")).select("c_custkey", "x.*")


@query("select probability, -log2(probability) as bits from (values (cast(0.5 as double)), (0.25), (0.125), (0.0009765625)) t(probability)")
def commitments_bandwidth(spark, sf_dir):
    chances = (0.5, 0.25, 0.125, 2.0**-10)
    return spark.createDataFrame([(p, commitments.bandwidth_bits(p)) for p in chances], "probability double, bits double")


_WITNESS = {"same": "ok", "other_label": "fingerprint_mismatch", "other_digest": "fingerprint_mismatch", "other_form": "replay_failed", "no_label": "replay_failed", "wrong_axis": "replay_failed", "none": "replay_failed"}


@query("select event_id, variant, status, variant = 'same' as from_text from events, " + _values(variant=list(_WITNESS), status=list(_WITNESS.values())))
def witness_failures(spark, sf_dir):
    """Witnesses sent as JSON text, one of each row as it was and others with a field changed."""
    e = read(spark, sf_dir, "events").select("event_id", address("props", "json", "sha256").alias("o")).select("event_id", witness.mint(F.col("o")).alias("w"))
    kind = "struct<label: string, axis: string, digest: binary, canonical_len: bigint, form: int>"
    sent = e.select("event_id", F.from_json(F.to_json("w"), kind).alias("w"))
    digit = F.concat(F.substring("w.label", 1, 70), F.when(F.substring("w.label", -1, 1) == "0", "1").otherwise("0"))
    forms = {
        "same": F.col("w"),
        "other_label": F.col("w").withField("label", digit),
        "other_digest": F.col("w").withField("digest", F.unhex(F.sha2("w.label", 256))),
        "other_form": F.col("w").withField("form", F.lit(2)),
        "no_label": F.col("w").withField("label", F.lit(None).cast("string")),
        "wrong_axis": F.col("w").withField("axis", F.lit("sha512")),
        "none": F.lit(None).cast(kind),
    }
    each = F.array(*(F.struct(F.lit(n).alias("variant"), witness.verify(w).alias("status"), (F.lit(n) == "same").alias("from_text")) for n, w in forms.items()))
    return sent.select("event_id", F.explode(each).alias("x")).select("event_id", "x.*")


@query("""select event_id, 'sha256:' || sha256(c) as label, upper(sha256(c)) as digest, cast(strlen(c) as bigint) as canonical_len from (select event_id, '{"k":' || json_extract_string(props, '$.k') || '}' as c from events)""")
def witness_fields(spark, sf_dir):
    w = read(spark, sf_dir, "events").select("event_id", address("props", "json", "sha256").alias("o")).select("event_id", witness.mint(F.col("o")).alias("w"))
    return w.select("event_id", witness.kappa_label(F.col("w")).alias("label"), F.hex(witness.content_digest(F.col("w"))).alias("digest"), "w.canonical_len")


# --- GGUF -----------------------------------------------------------------------------------------------


def _text(s: str) -> bytes:
    return struct.pack("<Q", len(s.encode())) + s.encode()


_GGUF_VERDICTS = {
    "fine": "ok", "magic": "gguf_invalid_magic", "version": "gguf_unsupported_version", "truncated": "gguf_truncated", "alignment_3": "gguf_invalid_alignment", "alignment_4": "gguf_invalid_alignment",
    "alignment_as_u64": "ok", "rank_5": "gguf_dims_exceeded", "overflow": "gguf_overflow", "array_depth": "gguf_array_depth", "nested_array": "ok", "value_type": "gguf_truncated", "partial_block": "gguf_unknown_tensor_type", "beyond": "gguf_truncated",
}


def _gguf_case(variant: str, k: int) -> bytes:
    data = struct.pack("<4f", k, 1, 2, 3)
    good = gguf.build([("general.name", 8, _text(f"m{k}"))], [("w", (4,), 0, data)])
    if variant == "magic":
        return bytes([good[0] ^ (k + 1)]) + good[1:]
    if variant == "version":
        return good[:4] + struct.pack("<I", 4 + k) + good[8:]
    if variant == "truncated":
        return good[: len(good) - 1 - k]
    if variant.startswith("alignment"):
        kind, size, value = {"alignment_3": (4, "<I", 24 * (2 * k + 1)), "alignment_4": (4, "<I", k % 8), "alignment_as_u64": (10, "<Q", 3 + k)}[variant]
        return gguf.build([("general.alignment", kind, struct.pack(size, value))], [("w", (4,), 0, data)])
    if variant == "rank_5":
        return gguf.build([], [("w", (1,) * (5 + k), 0, data)])
    if variant == "overflow":
        return gguf.build([], [("w", (1 << 40, (1 << 24) + k), 24, b"")])
    if variant in ("array_depth", "nested_array"):
        deep = 64 + k if variant == "array_depth" else 63 - k
        return gguf.build([("a", 9, struct.pack("<IQ", 9, 1) * deep + struct.pack("<IQ", 0, 0))], [])
    if variant == "value_type":
        return gguf.build([("a", 13 + k, b"")], [])
    if variant == "partial_block":
        return gguf.build([], [("w", (32 * k + 1,), 8, b"\0" * 34 * (k + 1))])
    if variant == "beyond":
        return gguf.build([], [("w", (4 + k,), 0, b"\0")])
    return good


@query(_verdicts_sql(**_GGUF_VERDICTS))
def gguf_verdicts(spark, sf_dir):
    rows = cases(_rows(spark, sf_dir), {v: made(lambda k, v=v: _gguf_case(v, k), "k") for v in _GGUF_VERDICTS}, ("k",))
    return verdicts(rows, "gguf")


@query(f"select k, cast(8 << cast(k % 6 as integer) as bigint) as alignment, cast((20 + (8 << cast(k % 6 as integer)) - 1) // (8 << cast(k % 6 as integer)) * (8 << cast(k % 6 as integer)) as bigint) as second_offset from {ROWS} r")
def gguf_alignment(spark, sf_dir):
    """The alignment of a file and where its second tensor is laid out, as the canonical skeleton says."""

    def build(k: int) -> bytes:
        a = 8 << k % 6
        return gguf.build([("general.alignment", 4, struct.pack("<I", a))], [("b", (2,), 0, b"\1" * 8), ("a", (5,), 0, b"\2" * 20)], a)

    hex_ = F.hex(canonicalize(made(build, "k"), "gguf")["canonical"])
    # head 32 bytes; the key's name digest, type and value 40; a tensor's name digest, rank, one dimension and type before the offset
    number = lambda at: F.conv(F.concat(*(F.substring(hex_, 2 * (at + i) + 1, 2) for i in range(7, -1, -1))), 16, 10).cast("bigint")
    first = 32 + 40
    return _rows(spark, sf_dir).select("k", number(24).alias("alignment"), number(first + 88 + 48).alias("second_offset"))


# Bytes and elements of a block by tensor type.
_GGUF_BLOCKS = {
    0: (4, 1), 1: (2, 1), 2: (18, 32), 3: (20, 32), 6: (22, 32), 7: (24, 32), 8: (34, 32), 9: (36, 32), 10: (84, 256), 11: (110, 256),
    12: (144, 256), 13: (176, 256), 14: (210, 256), 15: (292, 256), 16: (66, 256), 17: (74, 256), 18: (98, 256), 19: (50, 256),
    20: (18, 32), 21: (110, 256), 22: (82, 256), 23: (136, 256), 24: (1, 1), 25: (2, 1), 26: (4, 1), 27: (8, 1), 28: (8, 1), 29: (56, 256), 30: (2, 1),
}


@query(
    "select k, cast(t as bigint) as type_id, k * elements as elements, k * size as bytes, '' as violation from (select k + 1 as k from " + ROWS + " r) r, "
    + _values(t=list(_GGUF_BLOCKS), size=[b for b, _ in _GGUF_BLOCKS.values()], elements=[e for _, e in _GGUF_BLOCKS.values()])
    + " union all select k + 1, t, 256 * (k + 1), null, 'gguf_unknown_tensor_type' from " + ROWS + " r, (values (4), (5), (31), (32), (99)) t(t)"
)
def gguf_tensor_types(spark, sf_dir):
    """A tensor of k blocks of each type, and types that are none, as rows of the reader."""

    def build(k: int, t: int) -> bytes:
        size, elements = _GGUF_BLOCKS.get(t, (1, 256))
        return gguf.build([], [("w", (k * elements,), t, b"\0" * (k * size))])

    kinds = spark.createDataFrame([(t, _GGUF_BLOCKS.get(t, (1, 256))[1]) for t in [*_GGUF_BLOCKS, 4, 5, 31, 32, 99]], "type_id bigint, per bigint")
    rows = _rows(spark, sf_dir).select((F.col("k") + 1).alias("k")).join(F.broadcast(kinds))
    path = F.concat_ws("/", "k", "type_id", F.col("k") * F.col("per"))
    found = tensors.tensors(rows.select(path.alias("path"), made(build, "k", "type_id").alias("content")), "gguf")
    part = lambda i: F.split_part("path", F.lit("/"), F.lit(i)).cast("bigint")
    return found.select(part(1).alias("k"), part(2).alias("type_id"), part(3).alias("elements"), F.col("bytes").cast("bigint").alias("bytes"), F.coalesce("violation", F.lit("")).alias("violation"))


@query(f"select k, 'a.text' as name, 8 as type_id, cast(8 + strlen(r.name) as bigint) as bytes from {ROWS} r union all select k, v.name, type_id, bytes from {ROWS} r, {_values(name=['b.list', 'c.flag', 'd.wide'], type_id=[9, 7, 12], bytes=[24, 1, 8])}")
def gguf_key_rows(spark, sf_dir):
    def build(k: int, name: str) -> bytes:
        return gguf.build([("d.wide", 12, struct.pack("<d", k)), ("b.list", 9, struct.pack("<IQ3I", 4, 3, k, k, k)), ("a.text", 8, _text(name)), ("c.flag", 7, b"\1")], [])

    rows = _rows(spark, sf_dir).select(F.col("k").cast("string").alias("path"), made(build, "k", "name").alias("content"))
    return tensors.gguf_keys(rows).select(F.col("path").cast("bigint").alias("k"), "name", "type_id", "bytes")


# --- ONNX -----------------------------------------------------------------------------------------------

_put = onnx.message


def _graph(nodes: list[bytes] = (), weights: list[bytes] = (), more: tuple = ()) -> bytes:
    return _put(*((1, n) for n in nodes), (2, "g"), *((5, w) for w in weights), *more)


def _model(graph: bytes, ir: int = 13, opsets: tuple = (((2, 17),),), more: tuple = ()) -> bytes:
    return _put((1, ir), (7, graph), *((8, _put(*o)) for o in opsets), *more)


def _node(name: str, attributes: list[bytes] = ()) -> bytes:
    return _put((1, "x"), (2, "y"), (3, name), (4, "Op"), *((5, a) for a in attributes))


def _onnx_subgraphs(depth: int) -> bytes:
    graph = _graph([_node("leaf")])
    for _ in range(depth):
        graph = _graph([_node("n", [_put((1, "body"), (20, 5), (6, graph))])])
    return graph


_ONNX_VERDICTS = {
    "fine": "ok", "first_of_two": "ok", "second_of_two": "onnx_unsupported_ir", "no_ir": "onnx_unsupported_ir", "no_graph": "onnx_missing_graph", "no_opsets": "ok", "opset_0": "onnx_opset_too_old", "opset_negative": "onnx_opset_too_old",
    "only_domain": "onnx_opset_too_old", "cycle": "onnx_graph_cycle", "self_cycle": "onnx_graph_cycle", "subgraphs_64": "ok", "subgraphs_65": "onnx_subgraph_depth", "field_0": "onnx_invalid_wire", "group": "onnx_invalid_wire",
    "long_varint": "onnx_invalid_wire", "truncated": "onnx_invalid_wire",
}


def _onnx_case(variant: str, k: int) -> bytes:
    graph = _graph([_node(f"n{k}")])
    good = _model(graph)
    return {
        "fine": lambda: good,
        "first_of_two": lambda: _put((1, 1 + k % 13), (1, 99)) + good[2:],
        "second_of_two": lambda: _put((1, 14 + k), (1, 9)) + good[2:],
        "no_ir": lambda: good[2:],
        "no_graph": lambda: _put((1, 1 + k % 13), (8, _put((2, 17)))),
        "no_opsets": lambda: _model(graph, opsets=()),
        "opset_0": lambda: _model(graph, opsets=(((2, 0),),)),
        "opset_negative": lambda: _model(graph, opsets=(((2, -1 - k),),)),
        "only_domain": lambda: _model(graph, opsets=(((1, f"ai.x{k}"), (2, 3)),)),
        "cycle": lambda: _model(_graph([_put((1, "b"), (2, "a"), (3, f"p{k}")), _put((1, "a"), (2, "b"), (3, "q"))])),
        "self_cycle": lambda: _model(_graph([_put((1, f"t{k}"), (2, f"t{k}"))])),
        "subgraphs_64": lambda: _model(_onnx_subgraphs(64 - k)),
        "subgraphs_65": lambda: _model(_onnx_subgraphs(65 + k)),
        "field_0": lambda: good + bytes([0, k]),
        "group": lambda: good + bytes([(k % 15 + 1) << 3 | 3]),
        "long_varint": lambda: good + b"\x08" + b"\x80" * (10 + k) + b"\x01",
        "truncated": lambda: good[: -1 - k % 2],
    }[variant]()


@query(_verdicts_sql(**_ONNX_VERDICTS))
def onnx_verdicts(spark, sf_dir):
    rows = cases(_rows(spark, sf_dir), {v: made(lambda k, v=v: _onnx_case(v, k), "k") for v in _ONNX_VERDICTS}, ("k",))
    return verdicts(rows, "onnx")


@query(f"select k, case when k between 1 and 13 then 'ok' else 'onnx_unsupported_ir' end as verdict from {ROWS} r")
def onnx_ir_versions(spark, sf_dir):
    rows = _rows(spark, sf_dir).select("k", made(lambda k: _model(_graph(), ir=k), "k").alias("raw"))
    return verdicts(rows, "onnx", ("k",))


def _attribute(kind: int, k: int, packed: bool = False) -> bytes:
    body = {
        1: b"\x15" + struct.pack("<f", k), 2: _put((3, k)), 3: _put((4, f"s{k}")), 4: _put((5, _put((2, 1), (8, "t"), (9, struct.pack("<f", k))))), 5: _put((6, _graph([_node(f"m{k}")]))),
        6: _put((7, struct.pack("<2f", k, 1))) if packed else b"".join(b"\x3d" + struct.pack("<f", v) for v in (k, 1)), 7: _put((8, bytes([k, 1]))) if packed else _put((8, k), (8, 1)),
        8: _put((9, f"s{k}"), (9, "t")), 9: _put((10, _put((2, 1), (8, f"t{k}")))), 10: _put((11, _graph([_node(f"m{k}")]))), 11: _put((22, _put((2, k)))), 12: _put((23, _put((2, k)))),
        13: _put((14, _put((1, _put((1, k)))))), 14: _put((15, _put((1, _put((1, k)))))), 15: _put((3, k), (4, f"s{k}")),
    }[kind]
    return _put((1, "a"), (20, kind)) + body


_KINDS_OF_ATTRIBUTE = list(range(1, 16))


@query("select cast(kind as bigint) as kind, case when kind = 15 then 1 else count(*) end as n_distinct from " + ROWS + " r, range(1, 16) t(kind) group by kind")
def onnx_attribute_types(spark, sf_dir):
    """Different values of all 14 attribute types give different labels; a type beyond has no value."""
    rows = _rows(spark, sf_dir).join(F.broadcast(spark.createDataFrame([(x,) for x in _KINDS_OF_ATTRIBUTE], "kind bigint")))
    raw = made(lambda k, kind: _model(_graph([_node("n", [_attribute(kind, k)])])), "k", "kind")
    return rows.select("kind", address_label(raw, "onnx").alias("label")).groupBy("kind").agg(F.countDistinct("label").alias("n_distinct"))


@query("select k, true as ints_same, false as floats_same, true as type_order_same, true as metadata_order_same from " + ROWS + " r")
def onnx_encodings(spark, sf_dir):
    """Packed and separate integers agree, floats don't (one is hashed, the other written); the order of a type's fields and of metadata doesn't matter."""
    one = lambda kind, packed: made(lambda k: _model(_graph([_node("n", [_attribute(kind, k, packed)])])), "k")
    def typed(k: int, turn: int) -> bytes:
        shape = _put((1, _put((1, k))))
        kind = [(1, _put((1, 1), (2, shape))), (6, f"d{k}")]
        return _model(_graph(more=((11, _put((1, "x"), (2, _put(*kind[::turn])))),)))

    swap = lambda turn: made(lambda k: typed(k, turn), "k")
    meta = lambda turn: made(lambda k: _model(_graph(), more=tuple([(14, _put((1, f"a{k}"), (2, "1"))), (14, _put((1, f"b{k}"), (2, "2")))][::turn])), "k")
    pairs = {"ints_same": (one(7, True), one(7, False)), "floats_same": (one(6, True), one(6, False)), "type_order_same": (swap(1), swap(-1)), "metadata_order_same": (meta(1), meta(-1))}
    rows = _rows(spark, sf_dir).select("k", *(c.alias(f"{n}_{side}") for n, both in pairs.items() for side, c in zip("ab", both, strict=True)))
    return rows.select("k", *((address_label(f"{n}_a", "onnx") == address_label(f"{n}_b", "onnx")).alias(n) for n in pairs))


# Bytes that a typed value keeps by data type (integers and bit patterns), and the field that it is in.
_ONNX_TYPED = {2: (5, 1), 3: (5, 1), 4: (5, 2), 5: (5, 2), 6: (5, 4), 7: (7, 8), 9: (5, 1), 10: (5, 2), 12: (11, 4), 13: (11, 8), 16: (5, 2), 17: (5, 1), 18: (5, 1), 19: (5, 1), 20: (5, 1), 21: (5, 1), 22: (5, 1), 23: (5, 1)}
_ONNX_FLOATS = {1: (4, "<f"), 11: (10, "<d"), 14: (4, "<f"), 15: (10, "<d")}


def _typed_and_raw(kind: int, k: int) -> tuple[bytes, bytes]:
    head = ((1, 2), (2, kind), (8, "w"))
    if kind in _ONNX_FLOATS:
        field, form = _ONNX_FLOATS[kind]
        raw = struct.pack(form, k) + struct.pack(form, 1)
        return _put(*head, (field, raw)), _put(*head, (9, raw))
    field, size = _ONNX_TYPED.get(kind, (5, 1))
    raw = k.to_bytes(size, "little") + (1).to_bytes(size, "little")
    return _put(*head, (field, k), (field, 1)), _put(*head, (9, raw))


@query("select cast(t as bigint) as type_id, count(*) as n, case when t in (0, 24, 25) then 0 when t = 8 then 0 else count(*) end as n_same, case when t in (0, 24, 25) then 'onnx_unknown_dtype' else '' end as violation from " + ROWS + " r, range(0, 26) t(t) group by t")
def onnx_data_types(spark, sf_dir):
    """Typed and raw data of a tensor agree in all types but strings; types beyond the table are rejected."""
    rows = _rows(spark, sf_dir).join(F.broadcast(spark.createDataFrame([(t,) for t in range(26)], "type_id bigint")))
    side = lambda i: made(lambda k, t: _model(_graph(weights=[_typed_and_raw(t, k)[i]])), "k", "type_id")
    both = rows.select("type_id", side(0).alias("typed"), side(1).alias("raw")).select("type_id", address("typed", "onnx").alias("a"), address("raw", "onnx").alias("b"))
    return both.groupBy("type_id").agg(F.count("*").alias("n"), F.sum(F.when(F.col("a.label") == F.col("b.label"), 1).otherwise(0)).alias("n_same"), F.coalesce(F.max("a.violation"), F.lit("")).alias("violation"))


# --- safetensors ----------------------------------------------------------------------------------------

# Id and bits of an element by dtype.
_DTYPES = {
    "BOOL": (0, 8), "U8": (1, 8), "I8": (2, 8), "I16": (3, 16), "U16": (4, 16), "F16": (5, 16), "BF16": (6, 16), "I32": (7, 32), "U32": (8, 32),
    "F32": (9, 32), "F64": (10, 64), "I64": (11, 64), "U64": (12, 64), "F8_E5M2": (13, 8), "F8_E4M3": (14, 8), "F8_E8M0": (15, 8),
    "F8_E4M3FNUZ": (16, 8), "F8_E5M2FNUZ": (17, 8), "C64": (18, 64), "F4": (19, 4), "F6_E2M3": (20, 6), "F6_E3M2": (21, 6),
}


def _entry(name: str, dtype: str, shape: str, begin: int, end: int) -> str:
    return f'"{name}":{{"dtype":"{dtype}","shape":{shape},"data_offsets":[{begin},{end}]}}'


@query("select k, dtype, cast(id as bigint) as id, k * bits as bytes from (select k + 1 as k from " + ROWS + " r) r, " + _values(dtype=list(_DTYPES), id=[i for i, _ in _DTYPES.values()], bits=[b for _, b in _DTYPES.values()]))
def safetensors_dtypes(spark, sf_dir):
    """A tensor of 8 k elements of each dtype: its id in the skeleton, its bytes as a row of the reader."""

    def build(k: int, dtype: str) -> bytes:
        size = k * _DTYPES[dtype][1]
        return safetensors.build("{" + _entry("w", dtype, f"[{8 * k}]", 0, size) + "}", b"\0" * size)

    rows = _rows(spark, sf_dir).select((F.col("k") + 1).alias("k")).join(F.broadcast(spark.createDataFrame([(d,) for d in _DTYPES], "dtype string")))
    files = rows.select("k", "dtype", made(build, "k", "dtype").alias("content"))
    hex_ = F.hex(canonicalize("content", "safetensors")["canonical"])
    # mark, version and two counts 24 bytes, the name's digest 32, then the id with the low byte first
    ids = files.select("k", "dtype", F.conv(F.substring(hex_, 2 * 56 + 1, 2), 16, 10).cast("bigint").alias("id"))
    found = tensors.tensors(files.select(F.concat_ws("/", "k", "dtype").alias("path"), "content"), "safetensors")
    sizes = found.select(F.split_part("path", F.lit("/"), F.lit(1)).cast("bigint").alias("k"), "dtype", F.col("bytes").cast("bigint").alias("bytes"))
    return ids.join(sizes, ["k", "dtype"])


_SAFE = "safetensors_"
_SAFE_VERDICTS = {
    "fine": "ok", "padded": "ok", "zero_sized": "ok", "short": _SAFE + "truncated", "header_beyond": _SAFE + "truncated", "header_too_large": _SAFE + "header_too_large", "not_utf8": _SAFE + "invalid_header", "space_first": _SAFE + "invalid_header",
    "text_after": _SAFE + "invalid_header", "float_size": _SAFE + "invalid_header", "signed_size": _SAFE + "invalid_header", "leading_zero": _SAFE + "invalid_header", "twice": _SAFE + "duplicate_key", "twice_inside": _SAFE + "duplicate_key", "surrogate": _SAFE + "invalid_header",
    "more_fields": _SAFE + "invalid_header", "metadata_number": _SAFE + "invalid_header", "dtype": _SAFE + "unknown_dtype", "size": _SAFE + "size_mismatch", "half_byte": _SAFE + "size_mismatch", "overflow": _SAFE + "overflow", "hidden_overflow": _SAFE + "overflow",
    "backwards": _SAFE + "invalid_offsets", "gap": _SAFE + "invalid_offsets", "overlap": _SAFE + "invalid_offsets", "data_after": _SAFE + "invalid_offsets",
}


def _safe_case(variant: str, k: int) -> bytes:
    n = k + 1
    data = bytes([k]) * n
    good = _entry("w", "U8", f"[{n}]", 0, n)
    header = {
        "padded": "{" + good + "}" + " " * (k + 1), "zero_sized": "{" + good + "," + _entry("e", "F32", f"[0,{n}]", n, n) + "}", "space_first": " {" + good + "}", "text_after": "{" + good + "}" + "x" * n,
        "float_size": "{" + _entry("w", "U8", f"[{n}.0]", 0, n) + "}", "signed_size": "{" + _entry("w", "U8", f"[-{n}]", 0, n) + "}", "leading_zero": "{" + _entry("w", "U8", f"[0{n}]", 0, n) + "}",
        "twice": "{" + good + "," + _entry("w", "U8", "[0]", n, n) + "}", "twice_inside": '{"w":{"dtype":"U8","dtype":"U8","shape":[' + str(n) + '],"data_offsets":[0,' + str(n) + "]}}", "surrogate": "{" + _entry("\\ud800", "U8", f"[{n}]", 0, n) + "}",
        "more_fields": '{"w":{"dtype":"U8","shape":[' + str(n) + '],"data_offsets":[0,' + str(n) + '],"x":1}}', "metadata_number": '{"__metadata__":{"a":' + str(k) + "}," + good + "}", "dtype": "{" + _entry("w", f"F{100 + k}", f"[{n}]", 0, n) + "}",
        "size": "{" + _entry("w", "U16", f"[{n}]", 0, n) + "}", "half_byte": "{" + _entry("w", "F4", f"[{2 * n + 1}]", 0, n) + "}", "overflow": "{" + _entry("w", "U8", f"[4294967296,{4294967296 + k}]", 0, n) + "}",
        "hidden_overflow": "{" + _entry("w", "U8", f"[0,4294967296,{4294967296 + k}]", 0, 0) + "}", "backwards": "{" + _entry("w", "U8", f"[{n}]", n, 0) + "}", "gap": "{" + _entry("w", "U8", f"[{n}]", 1, n + 1) + "}",
        "overlap": "{" + good + "," + _entry("v", "U8", "[1]", n - 1, n) + "}",
    }.get(variant, "{" + good + "}")
    if variant == "gap":
        data += b"\0"
    if variant == "data_after":
        data += b"\0" * n
    raw = safetensors.build(header, data)
    if variant == "short":
        return raw[: k % 8]
    if variant == "header_beyond":
        return struct.pack("<Q", len(raw) + k) + raw[8:]
    if variant == "header_too_large":
        return struct.pack("<Q", 100_000_001 + k) + raw[8:]
    if variant == "not_utf8":
        return raw[:8] + b"{\xff" + raw[10:]
    return raw


@query(_verdicts_sql(**_SAFE_VERDICTS))
def safetensors_verdicts(spark, sf_dir):
    rows = cases(_rows(spark, sf_dir), {v: made(lambda k, v=v: _safe_case(v, k), "k") for v in _SAFE_VERDICTS}, ("k",))
    return verdicts(rows, "safetensors")


@query(f"select k, name, dtype, cast(n as bigint) as elements, cast(begin_ as bigint) as begin, cast(bytes as bigint) as bytes from (select k, 'b' as name, 'U8' as dtype, k + 1 as n, 0 as begin_, k + 1 as bytes from {ROWS} r union all select k, 'a', 'F32', 2, k + 1, 8 from {ROWS} r)")
def safetensors_rows(spark, sf_dir):
    """A row for each tensor of a file, and whether the ranges cover the data."""

    def build(k: int) -> bytes:
        n = k + 1
        return safetensors.build("{" + _entry("b", "U8", f"[{n}]", 0, n) + "," + _entry("a", "F32", "[2]", n, n + 8) + "}", bytes(n + 8))

    found = tensors.tensors(_rows(spark, sf_dir).select(F.col("k").cast("string").alias("path"), made(build, "k").alias("content")), "safetensors")
    return found.select(F.col("path").cast("bigint").alias("k"), "name", "dtype", F.col("shape")[0].cast("bigint").alias("elements"), F.col("begin").cast("bigint").alias("begin"), F.col("bytes").cast("bigint").alias("bytes"))


@query(f"select k, k % 3 = 0 as ok from {ROWS} r")
def range_covers(spark, sf_dir):
    """Ranges that leave no gap, one that does, and one that ends early."""
    k = F.col("k")
    first = F.struct(F.lit(0).cast("bigint").alias("b"), (k + 1).alias("e"))
    second = F.struct(F.when(k % 3 == 1, k + 2).otherwise(k + 1).alias("b"), (k + 5).alias("e"))
    rows = _rows(spark, sf_dir).select("k", F.explode(F.array(second, first)).alias("x"), F.when(k % 3 == 2, k + 6).otherwise(k + 5).alias("size"))
    return tensors.covers(rows.select("k", "x.b", "x.e", "size"), "k", "b", "e", "size")


# --- published labels of model files --------------------------------------------------------------------


def _floats(*values: float) -> bytes:
    return struct.pack(f"<{len(values)}f", *values)


def _onnx_pair() -> tuple[bytes, bytes]:
    return _put((1, "y"), (1, "w"), (2, "z"), (3, "b"), (4, "Add")), _put((1, "x"), (2, "y"), (3, "a"), (4, "Relu"))


def _golden() -> dict[str, tuple[str, bytes]]:
    """Files with known labels; their content must be exactly this."""
    add, relu = _onnx_pair()
    external = _put((1, 2), (2, 1), (8, "w"), (13, _put((1, "location"), (2, "weights.bin"))), (13, _put((1, "offset"), (2, "0"))), (13, _put((1, "length"), (2, "8"))), (14, 1))
    typed = _put((1, "x"), (2, _put((1, _put((1, 1), (2, _put((1, _put((1, 2))))))))))
    same = [_put((1, f"x{i}"), (2, f"y{i}"), (3, ""), (4, "Relu")) for i in (2, 1)] + [_put((1, "y1"), (1, "y2"), (2, "z"), (3, "m"), (4, "Add"))]
    info = lambda name: _put((1, name))
    parts = [("z.mask", "BOOL", "[3]", 40, 43), ("café.weight", "F32", "[2,2]", 0, 16), ("a.ids", "I64", "[2]", 24, 40), ("m.bf16", "BF16", "[4]", 16, 24), ("q.fp4", "F4", "[4]", 43, 45)]
    mixed = "{" + ",".join(_entry(*p) for p in parts) + ',"__metadata__":{"format":"pt","b":"2","a":"1"}}     '
    data = _floats(1, 2, 3, 4) + bytes.fromhex("803f004040408040") + struct.pack("<2q", 7, -7) + b"\1\0\1" + bytes.fromhex("2143")
    return {
        "synthetic-f32": ("gguf", gguf.build([("general.architecture", 8, _text("llama")), ("general.name", 8, _text("tiny")), ("general.alignment", 4, struct.pack("<I", 32))], [("token_embd.weight", (4,), 0, _floats(1, 2, 3, 4)), ("output.weight", (2,), 0, _floats(5, 6))])),
        "empty-metadata": ("gguf", gguf.build([], [])),
        "aligned-256": ("gguf", gguf.build([("general.alignment", 4, struct.pack("<I", 256))], [("w", (8,), 0, _floats(*range(8)))], 256)),
        "synthetic": ("onnx", _model(_graph([add, relu], [_put((1, 2), (2, 1), (8, "w"), (9, _floats(1, 2)))], ((11, info("x")), (12, info("z")))))),
        "synthetic-typed": ("onnx", _model(_graph([relu, add], [external], ((11, typed), (12, info("z")))))),
        "empty-name-tiebreak": ("onnx", _model(_graph(same, (), ((11, info("x1")), (11, info("x2")), (12, info("z")))))),
        "empty": ("safetensors", safetensors.build("{}", b"")),
        "zero-sized": ("safetensors", safetensors.build("{" + _entry("empty", "F32", "[0,3]", 0, 0) + "," + _entry("x", "U8", "[2]", 0, 2) + "}", b"\x09\x08")),
        "mixed-dtypes": ("safetensors", safetensors.build(mixed, data)),
    }


# The published labels.
GOLDEN = {
    "synthetic-f32": "42855a6a6565c8506385d5194ad85bfc84e9b353c899fbd20dca9251d8e43708",
    "empty-metadata": "8699bd5899c5d95810f3ccca0252893a363bcfdbfc8423845fd0e5542d8e01f6",
    "aligned-256": "13644371e123e82e398dcf5f71b1fbaddb9b4cc71d30e99cace115b77edf4fb5",
    "synthetic": "ec73b3e17ca21365cc310aa89fa63b7cf82da06083b85beedecef07a0d2b4ecc",
    "synthetic-typed": "4f9205541b6e817c46efc69611639897d63788228d80896b5639efbd901833a2",
    "empty-name-tiebreak": "e0ff3c080c0c5a9178dcbf0604daed219345f947c150e3d72cf6e0fb77b1bcb9",
    "empty": "0a3f6678a8f9e29e6b5a4d6ff8e918e4bd324d873ced907fb81be38bb359666b",
    "zero-sized": "59fe65db265f3fc04c3a6fda575694d57dee06ffdc32d01aa721278b4459680d",
    "mixed-dtypes": "159a0c54e579cd8a1785b246b1f089f4aa5e08dd3f9901157d4967abdc6c1f80",
}


@query("select name, 'blake3:' || hex as label from " + _values(name=list(GOLDEN), hex=list(GOLDEN.values())))
def container_known_labels(spark, sf_dir):
    rows = spark.createDataFrame([(n, f, bytearray(raw)) for n, (f, raw) in _golden().items()], "name string, format string, raw binary")
    pick = F.lit(None).cast("string")
    for f in ("gguf", "onnx", "safetensors"):
        pick = F.when(F.col("format") == f, address_label("raw", f)).otherwise(pick)
    return rows.select("name", pick.alias("label"))


# --- documents and schemas ------------------------------------------------------------------------------


@query("select doc_id, 'sha256:' || sha256('{\"@context\":\"https://schema.org\",\"@type\":\"Article\",\"author\":\"A\",\"datePublished\":\"2025-01-15\",\"headline\":' || " + Q_SQL.format("nfc_normalize(text)") + " || '}') as label from documents where text is not null")
def schema_label_is_json_label(spark, sf_dir):
    """A schema admits or not; the label is that of the JSON, whole texts as headlines."""
    d = read(spark, sf_dir, "documents").filter("text is not null")
    raw = F.concat(F.lit('{"headline":'), quoted("text"), F.lit(',"datePublished":"2025-01-15","author":"A","@type":"Article","@context":"https://schema.org"}'))
    return d.select("doc_id", address_label(raw, "schema_document", "sha256").alias("label"))


_PHOTO = {"fine": "ok", "organization": "ok", "http": "ok", "context": "schema_violation", "type": "schema_violation", "no_url": "schema_violation", "robot": "schema_violation", "nameless": "schema_violation", "not_json": "schema_violation"}


@query(_verdicts_sql(**_PHOTO))
def schema_photo_verdicts(spark, sf_dir):
    n = quoted("name")
    photo = lambda context="https://schema.org", kind="Photograph", url='"contentUrl":"u",', creator=n: F.concat(F.lit(f'{{"@context":"{context}","@type":"{kind}",{url}"creator":'), creator, F.lit("}"))
    agent = lambda kind: F.concat(F.lit(f'{{"@type":"{kind}","name":'), n, F.lit("}"))
    forms = {
        "fine": photo(creator=agent("Person")), "organization": photo(creator=agent("Organization")), "http": photo("http://schema.org"), "context": photo("https://schema.org/x"), "type": photo(kind="Article"), "no_url": photo(url=""),
        "robot": photo(creator=agent("Robot")), "nameless": photo(creator=F.concat(F.lit('{"@type":"Person","title":'), n, F.lit("}"))), "not_json": F.col("name"),
    }
    return verdicts(cases(_rows(spark, sf_dir), forms, ("k",)), "schema_photo")


_STATEMENT = {"fine": "ok", "type": "schema_violation", "no_subject": "schema_violation", "no_name": "schema_violation", "no_digest": "schema_violation", "not_hex": "schema_violation", "no_predicate_type": "schema_violation", "predicate": "schema_violation"}


@query(_verdicts_sql(**_STATEMENT))
def in_toto_verdicts(spark, sf_dir):
    sha = F.sha2("name", 256)

    def statement(kind: str = "https://in-toto.io/Statement/v1", subject: Column | None = None, predicate_type: str = "p", predicate: str = "{}") -> Column:
        one = F.concat(F.lit('{"name":"x","digest":{"sha256":"'), sha, F.lit('"}}')) if subject is None else subject
        return F.concat(F.lit(f'{{"_type":"{kind}","subject":['), one, F.lit(f'],"predicateType":"{predicate_type}","predicate":{predicate}}}'))

    subject = lambda name, key, digest: F.concat(F.lit(f'{{"name":"{name}","digest":{{"{key}":"'), digest, F.lit('"}}'))
    forms = {
        "fine": statement(), "type": statement("https://in-toto.io/Statement/v0"), "no_subject": statement(subject=F.lit("")), "no_name": statement(subject=subject("", "sha256", sha)), "no_digest": statement(subject=subject("x", "sha512", sha)),
        "not_hex": statement(subject=subject("x", "sha256", F.upper(F.concat(F.lit("A"), F.substring(sha, 2, 63))))), "no_predicate_type": statement(predicate_type=""), "predicate": statement(predicate="[]"),
    }
    return verdicts(cases(_rows(spark, sf_dir), forms, ("k",)), "schema_codemodule_signed")

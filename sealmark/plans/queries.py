"""Queries over the tables of a folder, each an operator at work, and SQL that says the same.

A query without SQL has none because its hash or its format is beyond DuckDB; tests hold those against
known answers.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import builders, commitments, compose
from ..functions.labels import AXES, digest_hex, is_label, is_operand, label, label_width, sigma_axis
from ..operators import registry, stats, witness
from ..operators.address import address, address_label, canonicalize, with_labels
from ..functions.text import quick_check, to_nfc, utf8_valid
from ..sources.tensors import gguf_layout, safetensors_layout
from .base import QUERIES, Q_SQL, SQL, cases, json_text, query, quoted, read, text_of


def event_labels(spark: SparkSession, sf_dir: str, axis: str = "sha256") -> DataFrame:
    return read(spark, sf_dir, "events").select("event_id", address_label("props", "json", axis).alias("label"))


EVENTS = """events_l as (select event_id, 'sha256:' || sha256('{"k":' || json_extract_string(props, '$.k') || '}') as label from events)"""

# --- labels and hashes ----------------------------------------------------------------------------------


@query("""select event_id, 'sha256:' || sha256('{"k":' || json_extract_string(props, '$.k') || '}') as label from events""")
def json_address_sha256(spark, sf_dir):
    return event_labels(spark, sf_dir)


@query("select c_custkey, 'sha256:' || sha256(c_name) as label from customer")
def raw_label_sha256(spark, sf_dir):
    return read(spark, sf_dir, "customer").select("c_custkey", label("c_name", "sha256").alias("label"))


@query("select n_distinct, n, widths from (select count(distinct text) * 5 as n_distinct, count(*) * 5 as n, '71,71,73,74,135' as widths from documents where text is not null)")
def multi_axis_distinct(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("text is not null").select(json_text("t", quoted("text")).alias("v"))
    wide = with_labels(docs, "v", "json")
    names = ["label_" + a.replace("-", "_") for a in ("sha256", "blake3", "sha3-256", "keccak256", "sha512")]
    long = wide.select(F.explode(F.array(*names)).alias("label"))
    widths = F.array_join(F.sort_array(F.collect_list("width")), ",")  # one of each axis
    per = long.groupBy(sigma_axis("label").alias("axis")).agg(F.countDistinct("label").alias("k"), F.count("label").alias("n"), F.max(F.length("label")).alias("width"))
    return per.agg(F.sum("k").alias("n_distinct"), F.sum("n").alias("n"), widths.alias("widths"))


@query(f"with {EVENTS} select event_id, split_part(label, ':', 1) as axis, split_part(label, ':', 2) as hex, length(label) as width, true as valid, true as operand from events_l")
def label_parts(spark, sf_dir):
    return event_labels(spark, sf_dir).select(
        "event_id", sigma_axis("label").alias("axis"), digest_hex("label").alias("hex"), F.length("label").cast("bigint").alias("width"), is_label("label", "sha256").alias("valid"), is_operand("label").alias("operand")
    )


@query("select * from (values ('sha256', 71), ('blake3', 71), ('sha3-256', 73), ('keccak256', 74), ('sha512', 135)) t(axis, width)")
def label_width_by_axis(spark, sf_dir):
    return spark.createDataFrame([(a,) for a in AXES], "axis string").select("axis", label_width("axis").alias("width"))


@query("select count(*) as n, count(distinct text) as n_distinct from documents where text is not null")
def json_address_blake3(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").filter("text is not null").select(address_label(json_text("t", quoted("text")), "json").alias("label"))
    return registry.label_counts(docs, "label")


@query("select count(*) as n, count(distinct c_name) as n_distinct from customer")
def keccak_labels(spark, sf_dir):
    return registry.label_counts(read(spark, sf_dir, "customer").select(label("c_name", "keccak256").alias("label")), "label")


@query("select count(*) as n, count(distinct c_name) as n_distinct from customer")
def sha3_labels(spark, sf_dir):
    return registry.label_counts(read(spark, sf_dir, "customer").select(label("c_name", "sha3-256").alias("label")), "label")


@query("select count(*) as n, count(distinct c_name) as n_distinct from customer")
def sha512_labels(spark, sf_dir):
    return registry.label_counts(read(spark, sf_dir, "customer").select(label("c_name", "sha512").alias("label")), "label")


# --- JSON -----------------------------------------------------------------------------------------------


@query("""select o_orderkey, '{"cust":' || o_custkey || ',"key":' || o_orderkey || ',"prio":"' || o_orderpriority || '","tags":["' || o_orderstatus || '",null,true]}' as canonical from orders""")
def json_canonical_orders(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    raw = F.concat(F.lit(' { "tags" : [ "'), "o_orderstatus", F.lit('" , null,true ],\n"key":'), "o_orderkey", F.lit(', "prio" : "'), "o_orderpriority", F.lit('","cust"\t:'), "o_custkey", F.lit("} "))
    return o.select("o_orderkey", text_of(canonicalize(raw, "json")["canonical"]).alias("canonical"))


@query("""select o_orderkey, '{"p":' || cast(cast(round(o_totalprice * 100) as bigint) / 100.0 as varchar) || '}' as canonical from orders""")
def json_float_canonical(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    raw = json_text("p", F.concat(cents.cast("string"), F.lit("e-2")))
    return o.select("o_orderkey", text_of(canonicalize(raw, "json")["canonical"]).alias("canonical"))


@query("select doc_id, " + Q_SQL.format("nfc_normalize(text)") + " as canonical from documents where text is not null")
def json_nfc_canonical(spark, sf_dir):
    d = read(spark, sf_dir, "documents").filter("text is not null")
    apart = F.replace(F.col("text"), F.lit("é"), F.lit("é"))
    return d.select("doc_id", text_of(canonicalize(quoted(apart), "json")["canonical"]).alias("canonical"))


@query("select count(*) as n, count(*) as n_same from orders")
def json_key_order_invariance(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    a = F.concat(F.lit('{"a":'), "o_orderkey", F.lit(',"b":{"x":1,"y":"'), "o_orderpriority", F.lit('"}}'))
    b = F.concat(F.lit('{ "b": {"y": "'), "o_orderpriority", F.lit('", "x": 1}, "a": '), "o_orderkey", F.lit(" }"))
    both = o.select(address_label(a, "json", "sha256").alias("a"), address_label(b, "json", "sha256").alias("b"))
    return both.agg(F.count("*").alias("n"), F.sum(F.when(registry.same(F.col("a"), F.col("b")), 1).otherwise(0)).alias("n_same"))


@query("select variant, count(*) as n, 'invalid_json' as violation from customer, (values ('open'), ('comma'), ('twice'), ('bare'), ('control'), ('surrogate'), ('nan')) v(variant) group by variant")
def json_reject_counts(spark, sf_dir):
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("k"))
    forms = {
        "open": F.concat(F.lit('{"a":'), "k"),
        "comma": F.concat(F.lit("[1,"), "k", F.lit(",]")),
        "twice": F.concat(F.lit('{"a":1,"\\u0061":'), "k", F.lit("}")),
        "bare": F.concat(F.lit("key"), "k"),
        "control": F.concat(F.lit('"'), "k", F.lit('\n"')),
        "surrogate": F.concat(F.lit('"\\ud800'), "k", F.lit('"')),
        "nan": F.concat(F.lit("[NaN,"), "k", F.lit("]")),
    }
    rows = c.select(F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), f.alias("raw")) for n, f in forms.items()))).alias("x")).select("x.*")
    seen = rows.select("variant", canonicalize("raw", "json").alias("o"))
    return seen.groupBy("variant", F.col("o.violation").alias("violation")).agg(F.count("*").alias("n"))


@query("select count(*) as n, count(*) as n_distinct from (select o_orderkey from orders union all select o_orderkey from orders union all select o_orderkey from orders)")
def typed_distinction(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    rows = read(spark, sf_dir, "orders").select(F.explode(F.array(k, F.concat(F.lit('"'), k, F.lit('"')), F.concat(F.lit("["), k, F.lit("]")))).alias("v"))
    return registry.label_counts(rows.select(address_label("v", "json", "sha256").alias("label")), "label")


@query("select count(*) as n, count(*) as n_ok from documents where text is not null")
def canonicalize_idempotent(spark, sf_dir):
    once = read(spark, sf_dir, "documents").filter("text is not null").select(canonicalize(quoted("text"), "json")["canonical"].alias("a"))
    twice = once.select("a", canonicalize("a", "json")["canonical"].alias("b"))
    return twice.agg(F.count("*").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), 1).otherwise(0)).alias("n_ok"))


@query("select event_id, json_extract_string(props, '$.k') as k, 'object' as kind from events")
def json_member(spark, sf_dir):
    from ..operators.navigate import json_get, json_kind

    return read(spark, sf_dir, "events").select("event_id", json_get("props", "k").alias("k"), json_kind("props").alias("kind"))


@query("select doc_id, nfc_normalize(text) as composed, true as valid from documents where text is not null")
def nfc_documents(spark, sf_dir):
    apart = F.replace(F.replace(F.col("text"), F.lit("é"), F.lit("e\u0301")), F.lit("ü"), F.lit("u\u0308"))
    return read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", to_nfc(apart).alias("composed"), utf8_valid("text").alias("valid"))


@query("select c_custkey, case c_custkey % 4 when 0 then 'yes' when 1 then 'maybe' when 2 then 'no' else 'no' end as answer from customer")
def nfc_quick_checks(spark, sf_dir):
    """ASCII; a mark that may combine; a sign that composition never yields; marks out of order."""
    k = F.col("c_custkey") % 4
    text = F.concat("c_name", F.when(k == 0, "").when(k == 1, "e\u0301").when(k == 2, "\u212b").otherwise("a\u0301\u0323"))
    return read(spark, sf_dir, "customer").select("c_custkey", quick_check(text).alias("answer"))


# --- S-expressions and code modules ---------------------------------------------------------------------


@query("select n_nationkey, '(6:nation ' || length(n_name) || ':' || n_name || ' ' || length(cast(n_regionkey as varchar)) || ':' || n_regionkey || ')' as canonical from nation")
def sexp_canonical_nation(spark, sf_dir):
    name = F.when(F.col("n_name").rlike("^[A-Za-z_][A-Za-z_0-9]*$"), F.col("n_name")).otherwise(builders.atom("n_name"))  # others need their length
    raw = F.concat(F.lit("( nation\t"), name, F.lit("  0"), F.length(F.col("n_regionkey").cast("string")), F.lit(":"), "n_regionkey", F.lit(")"))
    return read(spark, sf_dir, "nation").select("n_nationkey", text_of(canonicalize(raw, "sexp")["canonical"]).alias("canonical"))


@query("select s_suppkey, 'sha256:' || sha256('(4:supp ' || length(s_name) || ':' || s_name || ')') as label from supplier")
def sexp_address_sha256(spark, sf_dir):
    raw = F.concat(F.lit("(supp "), F.length("s_name"), F.lit(":"), "s_name", F.lit(")"))
    return read(spark, sf_dir, "supplier").select("s_suppkey", address_label(raw, "sexp", "sha256").alias("label"))


@query("select c_custkey, case when c_custkey % 3 = 0 then '' else 'invalid_sexp' end as violation from customer")
def sexp_rejects(spark, sf_dir):
    """The right length, one byte more than there is, and text after the list."""
    k, n = F.col("c_custkey") % 3, F.octet_length("c_name")
    raw = F.concat(F.lit("("), n + F.when(k == 1, 2).otherwise(0), F.lit(":"), "c_name", F.when(k == 2, ") x").otherwise(")"))
    return read(spark, sf_dir, "customer").select("c_custkey", F.coalesce(canonicalize(raw, "sexp")["violation"], F.lit("")).alias("violation"))


@query("select p_partkey, '(3:mod ' || strlen(p_name) || ':' || p_name || ' ' || strlen(p_brand) || ':' || p_brand || ')' as module from part")
def codemodule_module(spark, sf_dir):
    built = builders.module("p_name", builders.atom("p_brand"))
    return read(spark, sf_dir, "part").select("p_partkey", text_of(canonicalize(built, "codemodule")["canonical"]).alias("module"))


@query("select p_partkey, '(3:fun ' || strlen(p_name) || ':' || p_name || ' (1:x 1:y) 3:u32 ' || length(cast(p_size as varchar)) || ':' || p_size || ')' as fn from part")
def codemodule_function(spark, sf_dir):
    built = builders.function("p_name", F.array(F.lit("x"), F.lit("y")), F.lit("u32"), builders.atom(F.col("p_size").cast("string")))
    return read(spark, sf_dir, "part").select("p_partkey", built.alias("fn"))


# --- XML, CBOR, DER, ring -------------------------------------------------------------------------------


@query("""select s_suppkey, '<s a="' || s_suppkey || '" b="' || s_name || '"><n></n></s>' as canonical from supplier""")
def xml_canonical_supplier(spark, sf_dir):
    raw = F.concat(F.lit(" <s b = '"), "s_name", F.lit("'  a=\""), "s_suppkey", F.lit('"><n /></s >\n'))
    return read(spark, sf_dir, "supplier").select("s_suppkey", text_of(canonicalize(raw, "xml")["canonical"]).alias("canonical"))


@query("""select doc_id, '<t>' || replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(13), '&#xD;') || '</t>' as canonical from documents where text is not null""")
def xml_cdata_documents(spark, sf_dir):
    inside = F.replace("text", F.lit("]]>"), F.lit("]]]]><![CDATA[>"))  # a section's end is split between two sections
    raw = F.concat(F.lit("<t><![CDATA["), inside, F.lit("]]></t>"))
    return read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", text_of(canonicalize(raw, "xml")["canonical"]).alias("canonical"))


@query("select 'invalid_xml' as violation, count(*) as n from pages where html is not null")
def xml_reject_pages(spark, sf_dir):
    return read(spark, sf_dir, "pages").filter("html is not null").groupBy(canonicalize("html", "xml")["violation"].alias("violation")).agg(F.count("*").alias("n"))


@query("""select o_orderkey, case when o_orderkey < 24 then printf('%02X', o_orderkey) when o_orderkey < 256 then '18' || printf('%02X', o_orderkey)
 when o_orderkey < 65536 then '19' || printf('%04X', o_orderkey) when o_orderkey < 4294967296 then '1A' || printf('%08X', o_orderkey) else '1B' || printf('%016X', o_orderkey) end as canonical from orders""")
def cbor_uint_shorten(spark, sf_dir):
    raw = F.unhex(F.concat(F.lit("1B"), F.lpad(F.hex("o_orderkey"), 16, "0")))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.hex(canonicalize(raw, "cbor")["canonical"]).alias("canonical"))


@query("""select n_nationkey, case when n_nationkey = 12 then 'invalid_cbor' else 'A2' || case when least(a, b) < 24 then printf('%02X', least(a, b)) else '18' || printf('%02X', least(a, b)) end || 'F4'
 || case when greatest(a, b) < 24 then printf('%02X', greatest(a, b)) else '18' || printf('%02X', greatest(a, b)) end || 'F5' end as canonical from (select n_nationkey, n_nationkey as a, abs(24 - n_nationkey) as b from nation)""")
def cbor_map_sort(spark, sf_dir):
    """Two keys, the greater one first and in more bytes than it needs; equal ones are rejected."""
    k, o = F.col("n_nationkey").cast("bigint"), F.abs(24 - F.col("n_nationkey")).cast("bigint")
    key = lambda c: F.concat(F.lit("19"), F.lpad(F.hex(c), 4, "0"))
    raw = F.unhex(F.concat(F.lit("BF"), key(F.greatest(k, o)), F.lit("F5"), key(F.least(k, o)), F.lit("F4FF")))
    seen = read(spark, sf_dir, "nation").select("n_nationkey", canonicalize(raw, "cbor").alias("o"))
    return seen.select("n_nationkey", F.coalesce(F.hex("o.canonical"), "o.violation").alias("canonical"))


@query("select c_custkey, 'FB' || printf('%016X', 4607182418800017409 + c_custkey * 2) as double, 'FA' || printf('%08X', 1065353217 + c_custkey * 2) as single, 'F9' || printf('%04X', 15360 + c_custkey % 1024) as half from customer")
def cbor_float_shorten(spark, sf_dir):
    """Doubles of 53, 24 and 11 significant bits at and above one, made of a row's key."""
    k = F.col("c_custkey")
    double = F.unhex(F.concat(F.lit("FB"), F.hex(F.lit(4607182418800017409) + k * 2)))
    single = F.unhex(F.concat(F.lit("FB"), F.hex(F.lit(4607182418800017408) + (k * 2 + 1) * (1 << 29))))
    half = F.unhex(F.concat(F.lit("FA"), F.lpad(F.hex(F.lit(1065353216) + k % 1024 * (1 << 13)), 8, "0")))
    c = read(spark, sf_dir, "customer")
    return c.select("c_custkey", *(F.hex(canonicalize(raw, "cbor")["canonical"]).alias(n) for n, raw in (("double", double), ("single", single), ("half", half))))


@query("""select o_orderkey, case when o_orderkey < 128 then '0201' || printf('%02X', o_orderkey) when o_orderkey < 32768 then '0202' || printf('%04X', o_orderkey)
 when o_orderkey < 8388608 then '0203' || printf('%06X', o_orderkey) when o_orderkey < 2147483648 then '0204' || printf('%08X', o_orderkey) when o_orderkey < 549755813888 then '0205' || printf('%010X', o_orderkey)
 when o_orderkey < 140737488355328 then '0206' || printf('%012X', o_orderkey) when o_orderkey < 36028797018963968 then '0207' || printf('%014X', o_orderkey) else '0208' || printf('%016X', o_orderkey) end as der from orders""")
def der_integer(spark, sf_dir):
    o = read(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.hex(canonicalize(builders.der_integer("o_orderkey"), "asn1")["canonical"]).alias("der"))


@query("select n_nationkey, '3006' || '0201' || printf('%02X', n_nationkey) || '0201' || printf('%02X', n_regionkey) as seq, '3106' || '0201' || printf('%02X', least(n_nationkey, n_regionkey)) || '0201' || printf('%02X', greatest(n_nationkey, n_regionkey)) as st from nation")
def der_sequence(spark, sf_dir):
    a, b = builders.der_integer("n_nationkey"), builders.der_integer("n_regionkey")
    return read(spark, sf_dir, "nation").select("n_nationkey", F.hex(builders.der_sequence(a, b)).alias("seq"), F.hex(builders.der_set(a, b)).alias("st"))


@query("select c_custkey, case when c_custkey % 3 = 0 then '' else 'invalid_der' end as violation from customer")
def der_reject(spark, sf_dir):
    """A string of its length, an indefinite length, and a length that the long form writes in too many bytes."""
    k, hex_, n = F.col("c_custkey") % 3, F.hex("c_name"), F.lpad(F.hex(F.octet_length("c_name").cast("bigint")), 2, "0")
    raw = F.unhex(F.concat(F.lit("0C"), F.when(k == 0, n).when(k == 1, F.lit("80")).otherwise(F.concat(F.lit("81"), n)), hex_))
    return read(spark, sf_dir, "customer").select("c_custkey", F.coalesce(canonicalize(raw, "asn1")["violation"], F.lit("")).alias("violation"))


@query("""select n_nationkey, k, 'sha256:' || sha256(unhex(printf('%02X', k) || left(printf('%02X', n_nationkey) || '000000', cast(2 * (k + 1) as integer)))) as label
 from nation, (values (0), (1), (2), (3)) t(k)""")
def ring_address_sha256(spark, sf_dir):
    made = F.array(*(F.struct(F.lit(k).alias("k"), builders.ring_element(k, "n_nationkey").alias("raw")) for k in range(4)))
    rows = read(spark, sf_dir, "nation").select("n_nationkey", F.explode(made).alias("x"))
    return rows.filter(builders.ring_valid("x.raw")).select("n_nationkey", F.col("x.k").alias("k"), label("x.raw", "sha256").alias("label"))


# --- composition and commitments ------------------------------------------------------------------------


def _compose(name: str, form: str) -> None:
    sql = f"with {EVENTS} select event_id, 'sha256:' || sha256({form}) as composed from (select event_id, label as a, substr(label, 8) as h from events_l)"

    def run(spark, sf_dir):
        return event_labels(spark, sf_dir).select("event_id", getattr(compose, f"compose_{name}")("label", axis="sha256").alias("composed"))

    QUERIES[f"compose_{name}_sha256"], SQL[f"compose_{name}_sha256"] = run, sql


_compose("f4", "'sha256:' || least(h, translate(h, '0123456789abcdef', 'fedcba9876543210'))")
_compose("e6", "case when ('0x' || substr(h, 1, 2))::int % 9 = 8 then chr(6) else chr(5) end || a")
_compose("e7", "'sha256:' || array_to_string(list_sort([substr(h, 1, 16), substr(h, 17, 16), substr(h, 33, 16), substr(h, 49, 16)]), '')")
_compose("e8", "a")


@query(f"with {EVENTS} select a.event_id, 'sha256:' || sha256(least(a.label, b.label) || greatest(a.label, b.label)) as bound from events_l a join (select event_id, 'sha256:' || sha256('\"' || event_type || '\"') as label from events) b using (event_id)")
def compose_g2_sha256(spark, sf_dir):
    kinds = read(spark, sf_dir, "events").select("event_id", address_label(quoted("event_type"), "json", "sha256").alias("label"))
    return registry.bind(event_labels(spark, sf_dir), kinds, "event_id", "label", "sha256")


@query("select status, count(*) as n from customer, (values ('axis_mismatch'), ('malformed_operand'), ('ok')) t(status) group by status")
def compose_axis_mismatch(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    forms = F.array(label("c_name", "sha512"), F.concat(F.lit("sha256:"), "c_name"), label("c_name", "sha256"))
    return c.select(F.explode(forms).alias("a")).groupBy(compose.operand_status("a", "sha256").alias("status")).agg(F.count("*").alias("n"))


@query(f"with {EVENTS} select event_id, substr(label, 8, 1) < '8' as storage, right(label, 1) in ('0','2','4','6','8','a','c','e') as signed, substr(label, 8, 1) < '8' and right(label, 1) in ('0','2','4','6','8','a','c','e') as both_of, right(label, 1) in ('0','8') as close3 from events_l")
def commitments_admitted(spark, sf_dir):
    h = digest_hex("label")
    s, g = commitments.storage_admitted(h), commitments.signed_admitted(h)
    return event_labels(spark, sf_dir).select("event_id", s.alias("storage"), g.alias("signed"), commitments.all_of(s, g).alias("both_of"), commitments.close_to(h, "0" * 64, 3).alias("close3"))


# --- schemas and witnesses ------------------------------------------------------------------------------


def _admission(name: str, format_: str, raw: Callable[[], F.Column], bad: Callable[[], F.Column]) -> None:
    def run(spark, sf_dir):
        d = read(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("t")).filter("t is not null")
        rows = d.select(F.explode(F.array(raw(), bad())).alias("raw"))
        return rows.select(address("raw", format_, "sha256").alias("o")).groupBy(F.col("o.status").alias("status"), F.coalesce("o.violation", F.lit("")).alias("violation")).agg(F.count("*").alias("n"))

    QUERIES[name] = run
    SQL[name] = "select status, violation, count(*) as n from documents, (values ('ok', ''), ('invalid', 'schema_violation')) t(status, violation) where text is not null group by status, violation"


def _string(c: str) -> F.Column:
    """A JSON string of any text."""
    made = F.to_json(F.struct(F.col(c).alias("s")))  # {"s":"..."}
    return F.substring(made, F.lit(6), F.length(made) - 6)


def _article(kind: str) -> F.Column:
    return F.concat(F.lit(f'{{"@context":"https://schema.org","@type":"{kind}","headline":'), _string("t"), F.lit(',"author":["A",{"@type":"Person","name":"B"}],"datePublished":"2025-01-15"}'))


def _photo(context: str) -> F.Column:
    return F.concat(F.lit(f'{{"@context":"{context}","@type":"Photograph","contentUrl":"u","creator":{{"@type":"Organization","name":'), _string("t"), F.lit("}}"))


def _statement(sha: F.Column) -> F.Column:
    return F.concat(F.lit('{"_type":"https://in-toto.io/Statement/v1","subject":[{"name":"x","digest":{"sha256":"'), sha, F.lit('"}}],"predicateType":"p","predicate":{}}'))


_admission("schema_article_admission", "schema_document", lambda: _article("Report"), lambda: _article("Recipe"))
_admission("schema_photo_admission", "schema_photo", lambda: _photo("http://schema.org"), lambda: _photo("https://example.org"))
_admission("in_toto_admission", "schema_codemodule_signed", lambda: _statement(F.sha2("t", 256)), lambda: _statement(F.substring(F.sha2("t", 256), 1, 63)))


@query("select 'ok' as status, count(*) as n, count(*) as n_again from events")
def witness_verify(spark, sf_dir):
    e = read(spark, sf_dir, "events").select("props", address("props", "json", "sha256").alias("o"))
    w = e.select("props", witness.mint(F.col("o")).alias("w"))
    again = witness.reverify("props", "json", "sha256", F.col("w"))
    return w.select(witness.verify(F.col("w")).alias("status"), again.alias("again")).groupBy("status").agg(F.count("*").alias("n"), F.sum(F.col("again").cast("int")).alias("n_again"))


# --- patterns over many values --------------------------------------------------------------------------


def document_labels(spark: SparkSession, sf_dir: str, axis: str = "blake3") -> DataFrame:
    docs = read(spark, sf_dir, "documents").filter("text is not null")
    return docs.select("doc_id", address_label(quoted("text"), "json", axis).alias("label"))


@query("select min(doc_id) as keeper, count(*) as n from documents where text is not null group by nfc_normalize(text)")
def dedupe_documents_blake3(spark, sf_dir):
    return registry.dedupe(document_labels(spark, sf_dir), "label", "doc_id").select("keeper", "n")


@query("select n, count(*) as groups from (select count(*) as n from documents where text is not null group by nfc_normalize(text)) group by n")
def duplicate_group_sizes(spark, sf_dir):
    sizes = registry.dedupe(document_labels(spark, sf_dir), "label", "doc_id")
    return sizes.groupBy("n").agg(F.count("*").alias("groups"))


@query("select d.doc_id, k.keeper from documents d join (select nfc_normalize(text) as t, min(doc_id) as keeper from documents where text is not null group by 1) k on nfc_normalize(d.text) = k.t")
def registry_lookup(spark, sf_dir):
    labels = document_labels(spark, sf_dir).repartition("label")  # hashed once: both sides read this exchange
    known = registry.dedupe(labels, "label", "doc_id").select("label", "keeper")
    return registry.lookup(labels, known, "label").select("doc_id", "keeper")


@query("select doc_id from documents where text is not null and doc_id % 7 = 0")
def registry_missing(spark, sf_dir):
    labels = document_labels(spark, sf_dir, "sha256")
    tampered = read(spark, sf_dir, "documents").filter("text is not null").select("doc_id", F.when(F.col("doc_id") % 7 == 0, F.concat("text", F.lit("☃"), F.col("doc_id").cast("string"))).otherwise(F.col("text")).alias("text"))
    now = tampered.select("doc_id", address_label(quoted("text"), "json", "sha256").alias("label"))
    return registry.missing(now, labels, "label").select("doc_id")


@query(f"with {EVENTS} select ('0x' || substr(label, 8, 2))::int as byte0, count(*) as n from events_l group by 1")
def digest_byte0_histogram(spark, sf_dir):
    return stats.byte0_histogram(event_labels(spark, sf_dir), "label")


@query(f"with {EVENTS} select cast(i - 1 as integer) as position, substr(label, cast(7 + i as integer), 1) as digit, count(*) as n from events_l, range(1, 65) t(i) group by 1, 2")
def hex_position_histogram(spark, sf_dir):
    return stats.hex_histogram(event_labels(spark, sf_dir), "label")


@query(f"with {EVENTS}, h as (select substr(label, 8, 2) as b, count(*) as n from events_l group by 1) select sum(n)::bigint as total, round(sum(n * n) / (sum(n) / 256) - sum(n), 6) as chi2 from h")
def digest_chi_square(spark, sf_dir):
    return stats.chi_square(stats.byte0_histogram(event_labels(spark, sf_dir), "label"), 256).select("total", F.round("chi2", 6).alias("chi2"))


@query("select count(*) as n, count(*) as n_far from orders")
def avalanche(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("string").alias("a"), F.concat(F.lit("-"), F.col("o_orderkey").cast("string")).alias("b"))
    pairs = o.select(address_label("a", "json", "sha256").alias("a"), address_label("b", "json", "sha256").alias("b"))
    return stats.avalanche(pairs, "a", "b", 80)


@query("select 0 as n_collisions, count(distinct o_orderkey) as n from orders")
def collision_check(spark, sf_dir):
    o = read(spark, sf_dir, "orders").select("o_orderkey", address_label(F.col("o_orderkey").cast("string"), "json", "blake3").alias("label"))
    per = o.groupBy("label").agg(F.countDistinct("o_orderkey").alias("k"))
    return per.agg(F.sum(F.when(F.col("k") > 1, 1).otherwise(0)).cast("int").alias("n_collisions"), F.sum("k").alias("n"))


@query("select 3 * count(*) as n, 3 * count(distinct c_name) as n_distinct from customer")
def cross_format_distinction(spark, sf_dir):
    c = read(spark, sf_dir, "customer")
    sides = [
        c.select(address_label(quoted("c_name"), "json", "sha256").alias("label")),
        c.select(address_label(builders.atom("c_name"), "sexp", "sha256").alias("label")),
        c.select(address_label(F.concat(F.lit("<n>"), "c_name", F.lit("</n>")), "xml", "sha256").alias("label")),
    ]
    return registry.label_counts(sides[0].union(sides[1]).union(sides[2]), "label")


# --- containers -----------------------------------------------------------------------------------------

_OFFSETS = """select vec_id, tensor, cast(sum({size}) over (partition by vec_id order by tensor) - {size} as bigint) as canonical_offset
 from (select vec_id, tensor, bytes from embeddings, (values ('a', 256), ('b', 100), ('c', 12)) t(tensor, bytes))"""


def _tensor_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = F.array(*(F.struct(F.lit(n).alias("tensor"), F.lit(b).cast("bigint").alias("bytes")) for n, b in (("c", 12), ("a", 256), ("b", 100))))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.explode(sizes).alias("x")).select("vec_id", "x.tensor", "x.bytes")


@query(_OFFSETS.format(size="(bytes + 31) // 32 * 32"))
def gguf_offsets(spark, sf_dir):
    return gguf_layout(_tensor_rows(spark, sf_dir), "vec_id", "tensor", "bytes", 32)


@query(_OFFSETS.format(size="bytes"))
def safetensors_offsets(spark, sf_dir):
    return safetensors_layout(_tensor_rows(spark, sf_dir), "vec_id", "tensor", "bytes")


def _same_under_order(name: str, format_: str) -> None:
    def run(spark, sf_dir):
        from ..sources.tensors import files_of_vectors

        both = files_of_vectors(read(spark, sf_dir, "embeddings"), format_)
        labels = both.select(address_label("one", format_).alias("a"), address_label("other", format_).alias("b"), (F.col("one") != F.col("other")).alias("differ"))
        return labels.agg(F.count("*").alias("n"), F.sum(F.when(registry.same(F.col("a"), F.col("b")) & F.col("differ"), 1).otherwise(0)).alias("n_same"), F.countDistinct("a").alias("n_distinct"))

    QUERIES[name] = run
    SQL[name] = "select count(*) as n, count(*) as n_same, count(distinct embedding) as n_distinct from embeddings where embedding is not null"


for _f in ("gguf", "safetensors", "onnx"):
    _same_under_order(f"{_f}_reorder_invariance", _f)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are equal by their address on the default axis, with the size of each group."""
    return registry.dedupe(document_labels(spark, sf_dir), "label", "doc_id")


from . import details  # noqa: E402, F401 - adds its queries

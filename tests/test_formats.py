import random
import unicodedata

import pytest

from sealmark.formats import FORMATS, Rejected, asn1, base, cbor, json, ring, sexp


def rejected(format_, raw):
    try:
        FORMATS[format_](raw)
    except Rejected:
        return True
    return False


# a value for each rule of the grammar and of the canonical form
JSON = {
    '{"zeta" : [ true ], "alpha":{ } }': '{"alpha":{},"zeta":[true]}',
    '{"k2":{"y":[],"x":"2"},"k10":0}': '{"k10":0,"k2":{"x":"2","y":[]}}',
    '{"\\u0061b":1,"a":2}': '{"a":2,"ab":1}',
    '{"n\u0303o": "si\u0301"}': '{"\u00f1o":"s\u00ed"}',
    "[\t7 ,\r\n-8,9\n]": "[7,-8,9]",
    "\n false\t": "false",
    '"\\u00fc\\ud83d\\ude80\\/\\u0002\\b"': '"\u00fc\U0001f680/\\u0002\\b"',
    '[{"q":[{}]},[[0]],""]': '[{"q":[{}]},[[0]],""]',
    "7.0": "7.0",
    "3e3": "3000.0",
    "-0": "-0.0",
    "2e-5": "0.00002",
    "2e-7": "2e-7",
    "8.25E200": "8.25e200",
    "4e17": "4e17",
    "998877665544332211009988776655": "998877665544332211009988776655",
    "1e400": "inf",
    "0.3": "0.3",
}


@pytest.mark.parametrize("raw", JSON)
def test_json(raw):
    assert json.canonicalize(raw.encode()).decode() == JSON[raw]


@pytest.mark.parametrize(
    "raw",
    [
        b" \n", b"[[]", b'{"p"', b'{"p":', b'{"p":3,}', b"]", b"nul", b"True", b'"open', b'"\\x41"', b'"\\u12"', b"+5", b"00", b".5", b"6.", b"2e", b"-", b"-Infinity", b"[4 5]", b'{"p" 3}', b"{p:3}", b"/* */ 1", b"1 1",
        b'{"p":1,"q":2,"\\u0070":3}', b'[{"\xc3\xb1":1,"n\xcc\x83":2}]', b'"\\udc00\\ud800"', b'"\t"', b"\xef\xbb\xbf[]", b'"\xc3"', b'"\xed\xa0\x80"', b"[" * 1300,
    ],
)
def test_json_rejects(raw):
    assert rejected("json", raw)


def test_json_depth():
    nested = lambda n, x: ("[" * n + x + "]" * n).encode()
    assert json.canonicalize(nested(1024, "1")) == nested(1024, "1")
    assert json.canonicalize(nested(1025, "")) == nested(1025, "")
    assert rejected("json", nested(1025, "1")) and rejected("json", nested(1026, ""))
    assert json.canonicalize(b'{"a":' * 1024 + b"1" + b"}" * 1024)
    assert rejected("json", b'{"a":' * 1025 + b"1" + b"}" * 1025)
    assert json.canonicalize(b"[" + b"[]," * 3000 + b"[]]")  # many, not deep


def test_json_many_marks():
    assert rejected("json", ('"a' + "́" * 33 + '"').encode())
    assert json.canonicalize(('"a' + "́" * 32 + '"').encode())


def test_json_navigation():
    raw = b'{"b":[1,{"x":2}],"e\xcc\x81":"s","n":null}'
    assert json.get(raw, "é") == '"s"' and json.get(raw, "zz") is None
    assert json.items(json.get(raw, "b").encode()) == ["1", '{"x":2}']
    assert [k for k, _ in json.members(raw)] == ["b", "é", "n"]
    assert json.scalar(b'"q"') == "q" and json.scalar(b"1.50") == "1.5" and json.scalar(b"{}") is None
    assert [json.kind(x) for x in (b"null", b"true", b"1", b'"1"', b"[]", b"{}")] == ["null", "true", "number", "string", "array", "object"]
    assert json.tagged(b"[1]")[0] == json.TAGS["array"]


def test_float_text_round_trips():
    r = random.Random(3)
    import struct

    for _ in range(3000):
        (x,) = struct.unpack("<d", r.randbytes(8))
        if x == x and abs(x) != float("inf"):
            assert float(json.float_text(x)) == x


def test_random_json_is_stable():
    import json as std

    r = random.Random(5)

    def make(d):
        k = r.randint(0, 6 if d < 4 else 4)
        if k == 5:
            return [make(d + 1) for _ in range(r.randint(0, 4))]
        if k == 6:
            return {str(r.random()): make(d + 1) for _ in range(r.randint(0, 4))}
        return [None, True, r.randint(-99, 99), r.random() * 10 ** r.randint(-20, 20), "".join(r.choices('abé́"\\\nÅ', k=5))][k]

    for _ in range(400):
        raw = std.dumps(make(0), ensure_ascii=r.random() < 0.5, indent=r.choice((None, 2))).encode()
        once = json.canonicalize(raw)
        assert json.canonicalize(once) == once
        assert b"\n" not in once


@pytest.mark.parametrize(
    "text,answer",
    [("abc", "yes"), ("é", "yes"), ("é", "maybe"), ("Å", "no"), ("ạ́", "no"), ("가", "maybe"), ("가", "yes")],
)
def test_quick_check(text, answer):
    assert base.nfc_quick_check(text.encode()) == answer
    if answer == "yes":
        assert unicodedata.is_normalized("NFC", text)


SEXP = {
    "( )": "()", "(()( ()))": "(() (()))", "3:a b": "3:a b", "(0: x)": "(0: 1:x)", "tree": "4:tree", "(leaf)": "(4:leaf)", "( oak\n\tash  )": "(3:oak 3:ash)",
    "((p q)r s)": "((1:p 1:q) 1:r 1:s)", "(book(title Emma)(year 1815))": "(4:book (5:title 4:Emma) (4:year 4:1815))", "007:seven!!": "7:seven!!", "(2:()pq)": "(2:() 2:pq)", "(4:\u00fc\u00fc z)": "(4:\u00fc\u00fc 1:z)",
}


@pytest.mark.parametrize("raw", SEXP)
def test_sexp(raw):
    assert sexp.canonicalize(raw.encode()).decode() == SEXP[raw]


@pytest.mark.parametrize("raw", [b"", b"\t", b"(x (y)", b"x)", b"(x))", b"(12:too few)", b"6:words", b"two words", b"(x) y", b"()()", b"(3:\xc3\x28x)", b"\xfe"])
def test_sexp_rejects(raw):
    assert rejected("sexp", raw) and rejected("codemodule", raw)


def test_sexp_has_no_depth_limit():
    assert sexp.canonicalize(b"(" * 4096 + b")" * 4096)


XML = {
    "<tag z='26' m='13' b='2'/>": '<tag b="2" m="13" z="26"></tag>',
    '<t say="&quot;1 &lt; 2&quot; &amp;c">y</t>': '<t say="&quot;1 &lt; 2&quot; &amp;c">y</t>',
    "<t><![CDATA[if (a < b && b > c)]]></t>": "<t>if (a &lt; b &amp;&amp; b &gt; c)</t>",
    "<t>p<![CDATA[]]>q</t>": "<t>pq</t>",
    "<x.1><y-2/><_z/></x.1>": "<x.1><y-2></y-2><_z></_z></x.1>",
    "<t><?sort by=name?>u</t>": "<t><?sort by=name?>u</t>",
    "<t><?p   q r  ?><?s?></t>": "<t><?p q r?><?s?></t>",
    "<t>&#90;&#x5a;&#X5A;&gt;</t>": "<t>ZZZ&gt;</t>",
    "\n<t b='&#10;'a=\"'\">v<w/>x</t\t> ": '<t a="\'" b="&#xA;">v<w></w>x</t>',
    "<t>one\r\ntwo&#+33;</t>": "<t>one&#xD;\ntwo!</t>",
}


@pytest.mark.parametrize("raw", XML)
def test_xml(raw):
    assert FORMATS["xml"](raw.encode()).decode() == XML[raw]


@pytest.mark.parametrize(
    "raw",
    [
        "", "  ", "text", "<t>", "</t>", "<t></T>", "<t><u></t></u>", "<t/><t/>", "<t/>end", "<t x>1</t>", "<t x=1/>", "<t x='1/>", "<t", "<t><", "<t>&none;</t>", "<t>&lt</t>", "<t>&#xDFFF;</t>", "<t>&#x;</t>",
        "<t><!-- note --></t>", "<!-- note --><t/>", "<?xml version='1.1'?><t/>", "<!DOCTYPE t><t/>", "<n:t/>", "<t><![CDATA[open</t>", "<t><?p</t>", "<t>" * 1100 + "</t>" * 1100,
    ],
)
def test_xml_rejects(raw):
    assert rejected("xml", raw.encode())


def test_xml_depth():
    assert FORMATS["xml"](b"<a>" * 1025 + b"</a>" * 1025)


# Examples of RFC 8949, appendix A, and what its deterministic encoding makes of others.
SAME = "00 01 0a 17 1818 1819 1864 1903e8 1a000f4240 20 3863 3903e7 f4 f5 f6 40 4401020304 60 6161 6449455446 62225c 80 83010203 8301820203820405 a0 a201020304 a26161016162820203 826161a161626163 a56161614161626142616361436164614461656145 f90000 f98000 f93c00 f93e00 f97bff fa47c35000 fb3ff199999999999a f97c00 f97e00 c063323031 f820".split()
CBOR = {"1817": "17", "1b00000000000f4240": "1a000f4240", "9f010203ff": "83010203", "bf01020304ff": "a201020304", "5f41014102ff": "420102", "7f61616162ff": "626162", "a2616201616102": "a2616102616201", "a202000100": "a201000200", "fb3ff8000000000000": "f93e00", "fa3f800000": "f93c00", "fb7ff8000000000000": "f97e00", "fa7fc00000": "f97e00", "1f": "00", "3f": "20", "9fff": "80", "d81801": "d81801", "9f9fff80ff": "828080"}


@pytest.mark.parametrize("raw", [*SAME, *CBOR])
def test_cbor(raw):
    assert cbor.canonicalize(bytes.fromhex(raw)).hex() == CBOR.get(raw, raw)


@pytest.mark.parametrize("raw", ["", "0000", "1c", "61ff", "a201010102", "44", "ff", "f800", "f81f", "5f5f4101ffff", "5f6161ff", "df00", "bf01ff", "9f", "81", "fc"])
def test_cbor_rejects(raw):
    assert rejected("cbor", bytes.fromhex(raw))


def test_cbor_depth():
    assert cbor.canonicalize(b"\x81" * 1024 + b"\x01")
    assert rejected("cbor", b"\x81" * 1025 + b"\x01")


@pytest.mark.parametrize(
    "built,expected",
    [
        (asn1.boolean(True), "0101ff"), (asn1.boolean(False), "010100"), (asn1.null(), "0500"), (asn1.integer(5), "020105"), (asn1.integer(-1), "0201ff"), (asn1.integer(200), "020200c8"), (asn1.integer(-200), "0202ff38"),
        (asn1.integer(2**31), "02050080000000"), (asn1.integer(-(2**63)), "02088000000000000000"), (asn1.octet_string(b""), "0400"), (asn1.octet_string(b"\xde\xad"), "0402dead"), (asn1.object_identifier([0, 9]), "060109"),
        (asn1.object_identifier([2, 5, 4, 3]), "0603550403"), (asn1.object_identifier([2, 999, 16384]), "06058837818000"), (asn1.bit_string(b""), "030100"), (asn1.bit_string(b"\xa0", 5), "030205a0"), (asn1.utf8_string("ñ"), "0c02c3b1"),
        (asn1.printable_string("A?"), "1302413f"), (asn1.ia5_string("a@b"), "1603614062"), (asn1.sequence([asn1.null(), asn1.boolean(True)]), "300505000101ff"), (asn1.set_of([asn1.octet_string(b"x"), asn1.integer(9)]), "3106020109040178"), (asn1.set_of([]), "3100"),
    ],
)
def test_der_builders(built, expected):
    assert built.hex() == expected and asn1.canonicalize(built) == built


@pytest.mark.parametrize(
    "raw", ["", "02", "0202", "020300ffff00", "0203007fff", "0202ff91", "0200", "048103ababab", "0482000101", "3080020101", "010100ff", "010102", "0300", "030209c0", "03020301", "0601a0", "0603808001", "0501aa", "0c02c328", "13012a", "1601e9", "1e020041", "3004020105", "300302010500", "a003020101"]
)
def test_der_rejects(raw):
    assert rejected("asn1", bytes.fromhex(raw))


def test_der_depth_and_long_lengths():
    def nest(n):
        v = b""
        for _ in range(n):
            v = asn1.value(asn1.SEQUENCE, v)
        return v

    assert asn1.canonicalize(nest(1025)) and rejected("asn1", nest(1028))
    assert asn1.canonicalize(asn1.octet_string(b"x" * 70000))


@pytest.mark.parametrize("arcs", [[], [2], [0, 41], [1, 99, 3], [4, 2, 1], [2, -1]])
def test_oid_arcs(arcs):
    with pytest.raises(Rejected):
        asn1.object_identifier(arcs)


def test_ring():
    assert [ring.from_components(k, 0xA1B2C3D4).hex() for k in range(4)] == ["00d4", "01d4c3", "02d4c3b2", "03d4c3b2a1"]
    for raw in (b"", b"\2", b"\1\7", b"\0\7\7", b"\2" * 5, b"\5" * 7, b"\1" * 4000):
        assert rejected("ring", raw)

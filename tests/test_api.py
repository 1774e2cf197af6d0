import pytest

from sealmark import api
from sealmark.functions import compose
from sealmark.functions.labels import AXES

FOO = "blake3:16b6abe0a77021b88cc14863d696df0c34f82556faadb318f46c384184f8ea71"


def test_addresses():
    assert api.json_address('{"foo": "bar"}') == FOO == api.json_address_with_hash(b'{"foo":"bar"}', 1)
    w = api.json_address_with_witness_hash("[]", "sha256")
    assert w.verify() == w.kappa_label() == "sha256:4f53cda18c2baa0c0354bb5f9a3ecbe5ed12ab4d8e11ba873c2f11161202b945" and w.content_fingerprint() == w.digest
    assert api.codemodule_address("(a)") == api.sexp_address("( a )")
    for f in ("json", "sexp", "xml", "asn1", "ring", "codemodule", "cbor", "gguf", "onnx", "safetensors", "schema_photo", "schema_document", "schema_codemodule_signed"):
        with pytest.raises(api.InvalidInput):
            getattr(api, f"{f}_address_with_witness")(b"\xff\xfe(")
    with pytest.raises(api.UnknownHash):
        api.json_address_with_hash("1", 9)


def test_composition_errors():
    with pytest.raises(api.AxisMismatch):
        api.compose_e8(FOO, axis="sha256")
    for bad in ("", "x", FOO[:-1], FOO.upper(), "md5:" + "0" * 32):
        with pytest.raises(api.InvalidInput):
            api.compose_f4(bad)


@pytest.mark.parametrize("axis", AXES)
def test_same_as_the_expressions(spark, axis):
    a, b = (api.json_address_with_hash(x, axis) for x in ('"a"', '"b"'))
    df = spark.createDataFrame([(a, b)], "a string, b string")
    row = df.select(compose.compose_g2("a", "b", axis).alias("g2"), *(getattr(compose, f"compose_{o}")("a", axis).alias(o) for o in ("f4", "e6", "e7", "e8"))).first()
    assert row["g2"] == api.compose_g2(b, a, axis=axis)
    for o in ("f4", "e6", "e7", "e8"):
        assert row[o] == getattr(api, f"compose_{o}")(a, axis=axis) == getattr(api, f"compose_{o}_with_witness")(a, axis=axis).kappa_label()

import struct

import pytest

from sealmark.formats import FORMATS, Rejected, gguf, onnx, safetensors
from sealmark.functions.hashes import blake3


def label(format_, raw):
    return blake3(FORMATS[format_](raw)).hex()


def floats(*xs):
    return struct.pack(f"<{len(xs)}f", *xs)


def text(s):
    return struct.pack("<Q", len(s)) + s.encode()


def test_gguf_known():
    keys = [("general.architecture", 8, text("llama")), ("general.name", 8, text("tiny")), ("general.alignment", 4, struct.pack("<I", 32))]
    tensors = [("token_embd.weight", (4,), 0, floats(1, 2, 3, 4)), ("output.weight", (2,), 0, floats(5, 6))]
    want = "42855a6a6565c8506385d5194ad85bfc84e9b353c899fbd20dca9251d8e43708"
    assert label("gguf", gguf.build(keys, tensors)) == want
    assert label("gguf", gguf.build(keys[::-1], tensors[::-1])) == want
    assert label("gguf", gguf.build([], [])) == "8699bd5899c5d95810f3ccca0252893a363bcfdbfc8423845fd0e5542d8e01f6"
    wide = gguf.build([("general.alignment", 4, struct.pack("<I", 256))], [("w", (8,), 0, floats(*range(8)))], 256)
    assert label("gguf", wide) == "13644371e123e82e398dcf5f71b1fbaddb9b4cc71d30e99cace115b77edf4fb5"


def test_gguf_rejects():
    good = gguf.build([], [("w", (4,), 0, floats(1, 2, 3, 4))])
    for raw, why in (
        (b"XXXX" + good[4:], "gguf_invalid_magic"),
        (good[:4] + struct.pack("<I", 2) + good[8:], "gguf_unsupported_version"),
        (good[:-1], "gguf_truncated"),
        (gguf.build([], [("w", (4,), 4, floats(1))]), "gguf_unknown_tensor_type"),
        (gguf.build([], [("w", (3,), 2, b"\0" * 18)]), "gguf_unknown_tensor_type"),
        (gguf.build([("general.alignment", 4, struct.pack("<I", 12))], []), "gguf_invalid_alignment"),
        (gguf.build([], [("w", (1, 1, 1, 1, 1), 0, floats(1))]), "gguf_dims_exceeded"),
        (gguf.build([("k", 99, b"")], []), "gguf_truncated"),
        (gguf.build([("k", 9, struct.pack("<IQ", 9, 1) * 70)], []), "gguf_array_depth"),
    ):
        with pytest.raises(Rejected, match=why):
            FORMATS["gguf"](raw)


def put(*items):
    return onnx.message(*items)


def value(name, type_=b""):
    return put((1, name), *([(2, type_)] if type_ else []))


def model(graph, opsets=((2, 17),), ir=13):
    return put((1, ir), (7, graph), (8, put(*opsets)))


def test_onnx_known():
    b = put((1, "y"), (1, "w"), (2, "z"), (3, "b"), (4, "Add"))
    a = put((1, "x"), (2, "y"), (3, "a"), (4, "Relu"))
    w = put((1, 2), (2, 1), (8, "w"), (9, floats(1, 2)))
    for nodes in ((b, a), (a, b)):
        graph = put(*((1, n) for n in nodes), (2, "g"), (5, w), (11, value("x")), (12, value("z")))
        assert label("onnx", model(graph)) == "ec73b3e17ca21365cc310aa89fa63b7cf82da06083b85beedecef07a0d2b4ecc"
    one = put((1, "x2"), (2, "y2"), (3, ""), (4, "Relu"))
    two = put((1, "x1"), (2, "y1"), (3, ""), (4, "Relu"))
    m = put((1, "y1"), (1, "y2"), (2, "z"), (3, "m"), (4, "Add"))
    graph = put((1, one), (1, two), (1, m), (2, "g"), (11, value("x1")), (11, value("x2")), (12, value("z")))
    assert label("onnx", model(graph)) == "e0ff3c080c0c5a9178dcbf0604daed219345f947c150e3d72cf6e0fb77b1bcb9"


def test_onnx_rejects():
    node = put((1, "x"), (2, "x"), (4, "Relu"))
    for raw, why in (
        (model(put((2, "g")), ir=14), "unsupported_ir"),
        (put((7, put((2, "g")))), "unsupported_ir"),
        (put((1, 9)), "missing_graph"),
        (model(put((2, "g")), opsets=((2, 0),)), "opset"),
        (model(put((1, node), (2, "g"))), "cycle"),
        (model(put((2, "g"), (5, put((2, 99), (8, "t"))))), "dtype"),
        (b"\x0b", "wire"),
        (b"\xff" * 11, "wire"),
    ):
        with pytest.raises(Rejected, match=why):
            FORMATS["onnx"](raw)


def test_onnx_typed_data_and_attributes():
    packed = put((1, 3), (2, 7), (8, "t"), (7, b"\x01\x02\x03"))
    apart = put((1, 3), (2, 7), (8, "t"), (7, 1), (7, 2), (7, 3))
    assert label("onnx", model(put((2, "g"), (5, packed)))) == label("onnx", model(put((2, "g"), (5, apart))))
    kinds = [put((1, f"a{k}"), (20, k), (3, 5), (4, "s"), (8, 7), (9, "x"), (6, put((2, "sub"))), (5, packed), (10, packed), (11, put((2, "s2"))), (22, b""), (14, put((1, 1)))) for k in range(15)]
    node = lambda order: put((1, "x"), (2, "y"), *((5, kinds[k]) for k in order))
    assert label("onnx", model(put((1, node(range(15))), (2, "g")))) == label("onnx", model(put((1, node(reversed(range(15)))), (2, "g"))))


def test_safetensors_known():
    assert label("safetensors", safetensors.build("{}", b"")) == "0a3f6678a8f9e29e6b5a4d6ff8e918e4bd324d873ced907fb81be38bb359666b"
    zero = '{"empty":{"dtype":"F32","shape":[0,3],"data_offsets":[0,0]},"x":{"dtype":"U8","shape":[2],"data_offsets":[0,2]}}'
    assert label("safetensors", safetensors.build(zero, b"\x09\x08")) == "59fe65db265f3fc04c3a6fda575694d57dee06ffdc32d01aa721278b4459680d"
    mixed = (
        '{"z.mask":{"dtype":"BOOL","shape":[3],"data_offsets":[40,43]},"café.weight":{"dtype":"F32","shape":[2,2],"data_offsets":[0,16]},'
        '"a.ids":{"dtype":"I64","shape":[2],"data_offsets":[24,40]},"m.bf16":{"dtype":"BF16","shape":[4],"data_offsets":[16,24]},'
        '"q.fp4":{"dtype":"F4","shape":[4],"data_offsets":[43,45]},"__metadata__":{"format":"pt","b":"2","a":"1"}}     '
    )
    data = floats(1, 2, 3, 4) + bytes.fromhex("803f004040408040") + struct.pack("<2q", 7, -7) + b"\1\0\1" + bytes.fromhex("2143")
    assert label("safetensors", safetensors.build(mixed, data)) == "159a0c54e579cd8a1785b246b1f089f4aa5e08dd3f9901157d4967abdc6c1f80"


@pytest.mark.parametrize(
    "header,data",
    [
        ("[]", b""), ("{} x", b""), (" {}", b""), ('{"a":1}', b""), ('{"a":{"dtype":"F32","shape":[1]}}', b"\0" * 4),
        ('{"a":{"dtype":"F99","shape":[1],"data_offsets":[0,4]}}', b"\0" * 4), ('{"a":{"dtype":"F32","shape":[1.0],"data_offsets":[0,4]}}', b"\0" * 4),
        ('{"a":{"dtype":"F32","shape":[1],"data_offsets":[0,4]},"a":{"dtype":"F32","shape":[0],"data_offsets":[4,4]}}', b"\0" * 4),
        ('{"a":{"dtype":"F32","shape":[1],"data_offsets":[1,5]}}', b"\0" * 5), ('{"a":{"dtype":"F32","shape":[2],"data_offsets":[0,4]}}', b"\0" * 4),
        ('{"a":{"dtype":"F4","shape":[3],"data_offsets":[0,2]}}', b"\0" * 2), ('{"a":{"dtype":"U8","shape":[-0],"data_offsets":[0,0]}}', b""),
        ('{"a":{"dtype":"U8","shape":[18446744073709551616],"data_offsets":[0,0]}}', b""), ('{"__metadata__":{"a":1}}', b""), ('{"a":{"dtype":"U8","shape":[true],"data_offsets":[0,1]}}', b"\0"),
        ('{"a":{"dtype":"U8","shape":[1],"data_offsets":[0,1],"x":0}}', b"\0"), ("{}", b"\0"),
    ],
)
def test_safetensors_rejects(header, data):
    with pytest.raises(Rejected):
        safetensors.canonicalize(safetensors.build(header, data))


def test_skeleton_does_not_grow_with_data():
    for format_, build in (("gguf", lambda n: gguf.build([], [("w", (n,), 24, b"\1" * n)])), ("safetensors", lambda n: safetensors.build(f'{{"w":{{"dtype":"U8","shape":[{n}],"data_offsets":[0,{n}]}}}}', b"\1" * n))):
        assert len(FORMATS[format_](build(1024))) == len(FORMATS[format_](build(1 << 20))) < 256


def test_tensor_tables(spark):
    from sealmark.sources import tensors

    header = '{"b":{"dtype":"F32","shape":[2],"data_offsets":[0,8]},"a":{"dtype":"U8","shape":[],"data_offsets":[8,9]}}'
    raw = safetensors.build(header, floats(1, 2) + b"\7")
    files = spark.createDataFrame([("f", raw), ("g", b"bad"), ("n", None)], "path string, content binary")
    rows = {(r["path"], r["name"]): r for r in tensors.tensors(files, "safetensors").collect()}
    assert set(rows) == {("f", "a"), ("f", "b"), ("g", None)}
    assert bytes(rows["f", "a"]["digest"]) == blake3(b"\7") and rows["g", None]["violation"]
    g = spark.createDataFrame([("f", gguf.build([], [("w", (4,), 0, floats(1, 2, 3, 4))]))], "path string, content binary")
    assert [int(r["bytes"]) for r in tensors.tensors(g, "gguf").collect()] == [16]
    ranges = spark.createDataFrame([("f", 0, 4, 6), ("f", 4, 6, 6), ("g", 0, 2, 6), ("g", 3, 6, 6)], "file string, b long, e long, n long")
    assert {r["file"]: r["ok"] for r in tensors.covers(ranges, "file", "b", "e", "n").collect()} == {"f": True, "g": False}


def test_keys_of_files(spark):
    from sealmark.sources import tensors

    files = spark.createDataFrame([("f", gguf.build([("a", 8, text("x")), ("b", 4, b"\1\0\0\0")], [])), ("g", b"bad"), ("n", None)], "path string, content binary")
    assert sorted(map(tuple, tensors.gguf_keys(files).collect())) == [("f", "a", 8, 9), ("f", "b", 4, 4)]

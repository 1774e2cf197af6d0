"""safetensors: a model file as a short skeleton of names, shapes and BLAKE3 digests."""

from __future__ import annotations

import json
import re
import struct
from dataclasses import dataclass

from ..functions.hashes import Digest, Parts, joined
from .base import Rejected

# Fixed values: (id, bits) of an element by dtype; the longest header; the skeleton's version.
DTYPES = {
    "BOOL": (0, 8), "U8": (1, 8), "I8": (2, 8), "I16": (3, 16), "U16": (4, 16), "F16": (5, 16), "BF16": (6, 16), "I32": (7, 32), "U32": (8, 32),
    "F32": (9, 32), "F64": (10, 64), "I64": (11, 64), "U64": (12, 64), "F8_E5M2": (13, 8), "F8_E4M3": (14, 8), "F8_E8M0": (15, 8),
    "F8_E4M3FNUZ": (16, 8), "F8_E5M2FNUZ": (17, 8), "C64": (18, 64), "F4": (19, 4), "F6_E2M3": (20, 6), "F6_E3M2": (21, 6),
}
HEADER_BYTES, FORM = 100_000_000, 2
_COUNT = re.compile(r"0|[1-9][0-9]*")


@dataclass
class Tensor:
    name: str
    dtype: str
    shape: tuple[int, ...]
    begin: int
    end: int


def _bad(reason: str = "safetensors_invalid_header") -> Rejected:
    return Rejected(reason)


def _unique(pairs: list) -> dict:
    out = dict(pairs)
    if len(out) != len(pairs):
        raise _bad("safetensors_duplicate_key")
    return out


def _whole(text: str) -> int:
    if not _COUNT.fullmatch(text) or len(text) > 20 or int(text) >= 1 << 64:
        raise _bad()
    return int(text)


def _refuse(text: str) -> None:
    raise _bad()


_decoder = json.JSONDecoder(object_pairs_hook=_unique, parse_int=_whole, parse_float=_refuse, parse_constant=_refuse, strict=True)


def _counts(value: object) -> tuple[int, ...]:
    if type(value) is not list or any(type(x) is not int for x in value):
        raise _bad()
    return tuple(value)


def read(raw: bytes) -> tuple[list[Tensor], dict[str, str], int]:
    """The tensors in the header's order, the metadata, and where the data begin."""
    if len(raw) < 8:
        raise _bad("safetensors_truncated")
    size = int.from_bytes(raw[:8], "little")
    if size > HEADER_BYTES:
        raise _bad("safetensors_header_too_large")
    if size > len(raw) - 8:
        raise _bad("safetensors_truncated")
    try:
        text = raw[8 : 8 + size].decode("utf-8")
        if text[:1] != "{":
            raise _bad()
        header, end = _decoder.raw_decode(text)
    except Rejected:
        raise
    except (ValueError, RecursionError) as e:
        raise _bad() from e
    if text[end:].strip(" \t\r\n"):
        raise _bad()
    data = len(raw) - 8 - size
    metadata = header.pop("__metadata__", {})
    if type(metadata) is not dict or any(type(v) is not str for v in metadata.values()):
        raise _bad()
    tensors = []
    for name, entry in header.items():
        if type(entry) is not dict or set(entry) != {"dtype", "shape", "data_offsets"}:
            raise _bad()
        if type(entry["dtype"]) is not str or entry["dtype"] not in DTYPES:
            raise _bad("safetensors_unknown_dtype")
        shape, offsets = _counts(entry["shape"]), _counts(entry["data_offsets"])
        if len(offsets) != 2 or offsets[0] > offsets[1]:
            raise _bad("safetensors_invalid_offsets")
        bits = DTYPES[entry["dtype"]][1]
        product = 1
        for d in shape:  # zeros don't hide an overflow of the others
            product *= d or 1
            if product * bits >= 1 << 64:
                raise _bad("safetensors_overflow")
        total = 0 if 0 in shape else product * bits
        if total % 8 or total // 8 != offsets[1] - offsets[0]:
            raise _bad("safetensors_size_mismatch")
        tensors.append(Tensor(name, entry["dtype"], shape, *offsets))
    reach = 0
    for t in sorted(tensors, key=lambda t: (t.begin, t.end)):
        if t.begin != reach:
            raise _bad("safetensors_invalid_offsets")
        reach = t.end
    if reach != data:
        raise _bad("safetensors_invalid_offsets")
    try:
        [x.encode() for t in tensors for x in (t.name,)] + [x.encode() for kv in metadata.items() for x in kv]
    except UnicodeEncodeError as e:
        raise _bad() from e
    return tensors, metadata, 8 + size


def skeleton(raw: bytes) -> Parts:
    """The canonical form, with digests yet to be made."""
    tensors, metadata, start = read(raw)
    out: Parts = [b"SAFE", struct.pack("<IQQ", FORM, len(tensors), len(metadata))]
    for k, v in sorted((k.encode(), v.encode()) for k, v in metadata.items()):
        out += [Digest(k), struct.pack("<Q", len(v)), Digest(v)]
    offset = 0
    for name, t in sorted(((t.name.encode(), t) for t in tensors), key=lambda x: x[0]):
        out += [Digest(name), struct.pack(f"<II{len(t.shape)}QQ", DTYPES[t.dtype][0], len(t.shape), *t.shape, offset), Digest(raw[start + t.begin : start + t.end])]
        offset += t.end - t.begin
    return out


def canonicalize(raw: bytes) -> bytes:
    return joined([skeleton(raw)])[0]


def build(header: str, data: bytes) -> bytes:
    text = header.encode()
    return len(text).to_bytes(8, "little") + text + data

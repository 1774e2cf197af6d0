"""ONNX models: a model file as a skeleton of sizes, types and BLAKE3 digests, independent of serialisation order.

Messages are read into lists of (number, wire type, value) once; everything else works on those lists.
Nodes are written in topological order, the least ready one first, kept in a heap.
"""

from __future__ import annotations

import heapq
import struct
from collections import defaultdict

from ..functions.hashes import Digest, Parts, joined
from .base import Rejected

# Limits, and by data type the field its values are in and the bytes that a value keeps.
IR_VERSIONS, SUBGRAPHS, PROTO_DEPTH = range(1, 14), 64, 32
FLOAT_FIELDS = {1: 4, 11: 10, 14: 4, 15: 10}
VARINT_FIELDS = {
    2: (5, 1), 3: (5, 1), 4: (5, 2), 5: (5, 2), 6: (5, 4), 7: (7, 8), 9: (5, 1), 10: (5, 2), 12: (11, 4), 13: (11, 8),
    16: (5, 2), 17: (5, 1), 18: (5, 1), 19: (5, 1), 20: (5, 1), 21: (5, 1), 22: (5, 1), 23: (5, 1),
}
STRINGS = 8
VARINT, FIXED64, BYTES, FIXED32 = 0, 1, 2, 5
EXTERNAL = b"onnx:external-data:v1"


def _varint(raw: bytes, at: int) -> tuple[int, int]:
    out = 0
    for k in range(10):
        if at >= len(raw):
            raise Rejected("onnx_invalid_wire")
        b = raw[at]
        at += 1
        out |= (b & 0x7F) << 7 * k
        if b < 0x80:
            if out >= 1 << 64:
                raise Rejected("onnx_invalid_wire")
            return out, at
    raise Rejected("onnx_invalid_wire")


def fields(raw: bytes) -> list[tuple[int, int, int | bytes]]:
    """A message's fields in the order of the bytes."""
    out, at = [], 0
    while at < len(raw):
        key, at = _varint(raw, at)
        number, wire = key >> 3, key & 7
        if number == 0:
            raise Rejected("onnx_invalid_wire")
        if wire == VARINT:
            value, at = _varint(raw, at)
        elif wire in (FIXED64, FIXED32):
            n = 8 if wire == FIXED64 else 4
            if at + n > len(raw):
                raise Rejected("onnx_invalid_wire")
            value, at = int.from_bytes(raw[at : at + n], "little"), at + n
        elif wire == BYTES:
            n, at = _varint(raw, at)
            if n > len(raw) - at:
                raise Rejected("onnx_invalid_wire")
            value, at = raw[at : at + n], at + n
        else:
            raise Rejected("onnx_invalid_wire")
        out.append((number, wire, value))
    return out


class Message:
    """Fields by number; a field that should occur once is its first occurrence."""

    def __init__(self, raw: bytes):
        self.by: dict[int, list] = defaultdict(list)
        for number, wire, value in fields(raw):
            self.by[number].append((wire, value))

    def first(self, number: int) -> tuple[int, int | bytes] | None:
        return self.by[number][0] if number in self.by else None

    def varint(self, number: int) -> int | None:
        f = self.first(number)
        return f[1] if f and f[0] == VARINT else None

    def bytes(self, number: int) -> bytes:
        f = self.first(number)
        return f[1] if f and f[0] == BYTES else b""

    def all_bytes(self, number: int) -> list[bytes]:
        return [v for w, v in self.by.get(number, ()) if w == BYTES]

    def varints(self, number: int) -> list[int]:
        """All values of a repeated number, packed or not."""
        out = []
        for wire, value in self.by.get(number, ()):
            if wire == VARINT:
                out.append(value)
            elif wire == BYTES:
                at = 0
                while at < len(value):
                    v, at = _varint(value, at)
                    out.append(v)
        return out


def _i64(v: int | None) -> bytes:
    return ((v or 0) & ((1 << 64) - 1)).to_bytes(8, "little")


def _u32(v: int) -> bytes:
    return struct.pack("<I", v & 0xFFFFFFFF)


def proto_digest(raw: bytes, depth: int = 0) -> Digest:
    """A digest of any message that the order of its fields doesn't change."""
    out: Parts = []
    for number, wire, value in sorted(fields(raw), key=lambda f: f[0]):
        out += [_i64(number), bytes([wire])]
        if wire == BYTES:
            if depth < PROTO_DEPTH and value:
                try:
                    out.append(proto_digest(value, depth + 1))
                    continue
                except Rejected:
                    pass
            out.append(Digest(value))
        else:
            out.append(value.to_bytes(4 if wire == FIXED32 else 8, "little"))
    return Digest(*out)


def skeleton(raw: bytes) -> Parts:
    """The canonical form, with digests yet to be made."""
    model = Message(raw)
    version = model.varint(1)
    if version not in IR_VERSIONS:
        raise Rejected("onnx_unsupported_ir")
    graph = model.bytes(7)
    out = [_i64(version), *_opsets(model)]
    if not graph:
        raise Rejected("onnx_missing_graph")
    out += _graph(Message(graph), 0)
    out += [Digest(model.bytes(k)) for k in (2, 3, 4)]
    return [*out, _i64(model.varint(5)), *_pairs(model, 14)]


def canonicalize(raw: bytes) -> bytes:
    return joined([skeleton(raw)])[0]


def _signed(v: int) -> int:
    return v - (1 << 64) if v >= 1 << 63 else v


def _opsets(model: Message) -> Parts:
    found = sorted((m.bytes(1), m.varint(2) or 0) for m in map(Message, model.all_bytes(8)))
    if found and not any(not domain and _signed(v) >= 1 for domain, v in found):
        raise Rejected("onnx_opset_too_old")
    return [x for domain, v in found for x in (Digest(domain), _i64(v))]


def _pairs(owner: Message, number: int) -> Parts:
    """String pairs sorted by key; equal keys stay in order."""
    found = sorted(((m.bytes(1), m.bytes(2)) for m in map(Message, owner.all_bytes(number))), key=lambda p: p[0])
    return [_u32(len(found)), *(Digest(x) for pair in found for x in pair)]


class _Rank:
    """The order of ready nodes: names first, then outputs, then a digest that is made only if it decides.

    Of nodes that are equal in everything the later one goes first.
    """

    def __init__(self, raw: bytes, node: Message, place: int):
        self.raw, self.place, self._digest = raw, place, b""
        outputs = node.all_bytes(2)
        self.names = (node.bytes(3), node.bytes(4), node.bytes(7))
        self.outputs = outputs

    def digest(self) -> bytes:
        if not self._digest:
            self._digest = joined([[proto_digest(self.raw)]])[0]
        return self._digest

    def __lt__(self, other: _Rank) -> bool:
        if self.names != other.names:
            return self.names < other.names
        for a, b in zip(self.outputs, other.outputs, strict=False):
            if a != b:
                return a < b
        if len(self.outputs) != len(other.outputs):
            return len(self.outputs) < len(other.outputs)
        if self.digest() != other.digest():
            return self.digest() < other.digest()
        return self.place > other.place


def order(raw_nodes: list[bytes]) -> list[int]:
    """Places of the nodes in topological order; a node waits for all producers of its inputs, itself included."""
    nodes = [Message(r) for r in raw_nodes]
    producers = defaultdict(set)
    for k, n in enumerate(nodes):
        for name in n.all_bytes(2):
            producers[name].add(k)
    waits = [set().union(*(producers.get(i, ()) for i in n.all_bytes(1) if i)) for n in nodes]
    follow = defaultdict(list)
    for k, w in enumerate(waits):
        for p in w:
            follow[p].append(k)
    ranks = [_Rank(r, n, k) for k, (r, n) in enumerate(zip(raw_nodes, nodes, strict=True))]
    ready = [ranks[k] for k, w in enumerate(waits) if not w]
    heapq.heapify(ready)
    out = []
    while ready:
        k = heapq.heappop(ready).place
        out.append(k)
        for f in follow[k]:
            waits[f].discard(k)
            if not waits[f]:
                heapq.heappush(ready, ranks[f])
    if len(out) != len(nodes):
        raise Rejected("onnx_graph_cycle")
    return out


def _graph(graph: Message, depth: int) -> Parts:
    if depth > SUBGRAPHS:
        raise Rejected("onnx_subgraph_depth")
    raw_nodes = graph.all_bytes(1)
    out: Parts = [Digest(graph.bytes(2)), _u32(len(raw_nodes))]
    for k in order(raw_nodes):
        out += _node(Message(raw_nodes[k]), depth)
    tensors = sorted(map(Message, graph.all_bytes(5)), key=lambda t: t.bytes(8))
    out.append(_u32(len(tensors)))
    for t in tensors:
        out += _tensor(t)
    for number in (11, 12, 13):
        infos = sorted(map(Message, graph.all_bytes(number)), key=lambda i: i.bytes(1))
        out.append(_u32(len(infos)))
        for i in infos:
            out += [Digest(i.bytes(1)), proto_digest(i.bytes(2))]
    return out


def _node(node: Message, depth: int) -> Parts:
    out: Parts = [Digest(node.bytes(k)) for k in (3, 4, 7, 8)]
    for number in (1, 2):
        out.append(_u32(len(node.by.get(number, ()))))
        out += map(Digest, node.all_bytes(number))
    attributes = sorted(map(Message, node.all_bytes(5)), key=lambda a: a.bytes(1))
    out.append(_u32(len(attributes)))
    for a in attributes:
        kind = (a.varint(20) or 0) & 0xFFFFFFFF
        out += [Digest(a.bytes(1)), _u32(kind), *_attribute(a, kind, depth)]
    return out


def _attribute(a: Message, kind: int, depth: int) -> Parts:
    if kind == 1:
        f = a.first(2)
        return [_u32(f[1])] if f and f[0] == FIXED32 else []
    if kind == 2:
        return [_i64(a.varint(3))]
    if kind == 3:
        return [Digest(a.bytes(4))]
    if kind == 4:
        return _tensor(Message(a.bytes(5)))
    if kind == 5:
        return _graph(Message(a.bytes(6)), depth + 1)
    if kind == 6:
        return [Digest(v) if w == BYTES else _u32(v) for w, v in a.by.get(7, ()) if w in (BYTES, FIXED32)]
    if kind == 7:
        return [*map(_i64, a.varints(8))]
    if kind == 8:
        return [*map(Digest, a.all_bytes(9))]
    if kind == 9:
        return [x for t in a.all_bytes(10) for x in _tensor(Message(t))]
    if kind == 10:
        return [x for g in a.all_bytes(11) for x in _graph(Message(g), depth + 1)]
    if kind in (11, 13):
        return [proto_digest(a.bytes(22 if kind == 11 else 14))]
    if kind in (12, 14):
        return [*map(proto_digest, a.all_bytes(23 if kind == 12 else 15))]
    return []


def _tensor(t: Message) -> Parts:
    kind = (t.varint(2) or 0) & 0xFFFFFFFF
    if kind not in FLOAT_FIELDS and kind not in VARINT_FIELDS and kind != STRINGS:
        raise Rejected("onnx_unknown_dtype")
    dims = t.varints(1)
    return [Digest(t.bytes(8)), _u32(kind), _u32(len(dims)), *map(_i64, dims), tensor_data(t, kind)]


def tensor_data(t: Message, kind: int) -> Digest:
    if t.varint(14) == 1:
        return Digest(EXTERNAL, *_pairs(t, 13))
    if t.bytes(9):
        return Digest(t.bytes(9))
    if kind == STRINGS:
        return Digest(*map(Digest, t.all_bytes(6)))
    if kind in FLOAT_FIELDS:
        parts = [v if w == BYTES else v.to_bytes(4 if w == FIXED32 else 8, "little") for w, v in t.by.get(FLOAT_FIELDS[kind], ()) if w != VARINT]
    else:
        number, width = VARINT_FIELDS[kind]
        parts = [_i64(v)[:width] for v in t.varints(number)]
    return Digest(*parts)


# --- writing messages, for tests and queries -----------------------------------------------------------


def _put_varint(v: int) -> bytes:
    out = bytearray()
    v &= (1 << 64) - 1
    while v >= 0x80:
        out.append(v & 0x7F | 0x80)
        v >>= 7
    out.append(v)
    return bytes(out)


def message(*items: tuple[int, int | bytes | str]) -> bytes:
    """A message of (number, value): integers as varints, text and bytes behind their length."""
    out = b""
    for number, value in items:
        if isinstance(value, int):
            out += _put_varint(number << 3) + _put_varint(value)
        else:
            body = value.encode() if isinstance(value, str) else value
            out += _put_varint(number << 3 | BYTES) + _put_varint(len(body)) + body
    return out

"""ASN.1 DER: validated, and then its own canonical form. Also encoders of single values."""

from __future__ import annotations

from .base import DEPTH, Rejected

# Universal tags.
BOOLEAN, INTEGER, BIT_STRING, OCTET_STRING, NULL, OID = 0x01, 0x02, 0x03, 0x04, 0x05, 0x06
UTF8, PRINTABLE, IA5, UTC_TIME, GENERALIZED_TIME, SEQUENCE, SET = 0x0C, 0x13, 0x16, 0x17, 0x18, 0x30, 0x31
PRINTABLE_CHARACTERS = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 '()+,-./:=?")


def _bad() -> Rejected:
    return Rejected("invalid_der")


def _oid_ok(b: bytes) -> bool:
    """Whether the bytes are whole base-128 numbers without leading zeros; a lone 80 byte begins no number."""
    if not b or b[-1] & 0x80:
        return False
    return all(not (b[k] == 0x80 and (k == 0 or b[k - 1] < 0x80)) for k in range(len(b)))


def _primitive_ok(tag: int, b: bytes) -> bool:
    if tag == BOOLEAN:
        return b in (b"\x00", b"\xff")
    if tag == INTEGER:
        return len(b) == 1 or len(b) > 1 and not (b[0] == 0 and b[1] < 0x80 or b[0] == 0xFF and b[1] >= 0x80)
    if tag == BIT_STRING:
        return bool(b) and b[0] <= 7 and (b[0] == 0 or len(b) > 1 and b[-1] & ((1 << b[0]) - 1) == 0)
    if tag == OCTET_STRING:
        return True
    if tag == NULL:
        return not b
    if tag == OID:
        return _oid_ok(b)
    if tag == UTF8:
        try:
            b.decode("utf-8")
        except UnicodeDecodeError:
            return False
        return True
    if tag == PRINTABLE:
        return PRINTABLE_CHARACTERS.issuperset(b)
    return tag in (IA5, UTC_TIME, GENERALIZED_TIME) and b.isascii()


def canonicalize(raw: bytes) -> bytes:
    """raw itself if it is one value in DER."""
    ends = []  # of open sequences and sets
    at, size, first = 0, len(raw), True
    while first or ends:
        while ends and at == ends[-1]:
            ends.pop()
        if not ends and not first:
            break
        first = False
        limit = size
        if at >= limit or len(ends) > DEPTH:
            raise _bad()
        tag = raw[at]
        at += 1
        if at >= size:
            raise _bad()
        length = raw[at]
        at += 1
        if length >= 0x80:
            n = length & 0x7F
            if not 1 <= n <= 8 or at + n > size:
                raise _bad()
            length = int.from_bytes(raw[at : at + n], "big")
            at += n
            if length < 128:
                raise _bad()
        if at + length > size:
            raise _bad()
        if tag in (SEQUENCE, SET):
            ends.append(at + length)
        else:
            if not _primitive_ok(tag, raw[at : at + length]):
                raise _bad()
            at += length
        if ends and at > ends[-1]:
            raise _bad()
    if at != size:
        raise _bad()
    return raw


# --- encoders ------------------------------------------------------------------------------------------


def length_octets(n: int) -> bytes:
    if n < 128:
        return bytes([n])
    b = n.to_bytes((n.bit_length() + 7) // 8, "big")
    return bytes([0x80 | len(b)]) + b


def value(tag: int, content: bytes) -> bytes:
    if tag not in (SEQUENCE, SET) and not _primitive_ok(tag, content):
        raise _bad()
    return bytes([tag]) + length_octets(len(content)) + content


def boolean(v: bool) -> bytes:
    return value(BOOLEAN, b"\xff" if v else b"\x00")


def null() -> bytes:
    return value(NULL, b"")


def integer(v: int) -> bytes:
    return value(INTEGER, v.to_bytes((v if v >= 0 else ~v).bit_length() // 8 + 1, "big", signed=True))


def octet_string(b: bytes) -> bytes:
    return value(OCTET_STRING, b)


def bit_string(bits: bytes, unused: int = 0) -> bytes:
    if not 0 <= unused <= 7:
        raise _bad()
    return value(BIT_STRING, bytes([unused]) + bits)


def object_identifier(arcs: list[int]) -> bytes:
    if len(arcs) < 2 or arcs[0] > 2 or min(arcs) < 0 or arcs[0] < 2 and arcs[1] >= 40:
        raise _bad()
    out = b""
    for n in (40 * arcs[0] + arcs[1], *arcs[2:]):
        groups = [n & 0x7F]
        while n := n >> 7:
            groups.append(n & 0x7F | 0x80)
        out += bytes(reversed(groups))
    return value(OID, out)


def utf8_string(s: str) -> bytes:
    return value(UTF8, s.encode())


def printable_string(s: str) -> bytes:
    return value(PRINTABLE, s.encode())


def ia5_string(s: str) -> bytes:
    return value(IA5, s.encode())


def sequence(children: list[bytes]) -> bytes:
    return value(SEQUENCE, b"".join(children))


def set_of(children: list[bytes]) -> bytes:
    return value(SET, b"".join(sorted(children)))

"""CBOR in its deterministic encoding: shortest heads and floats, definite lengths, sorted unique keys.

Items are read into a stack of open containers; each container, once complete, becomes the bytes of one
item of the container around it.
"""

from __future__ import annotations

import math
import struct

from .base import DEPTH, Rejected

UINT, NINT, BYTES, TEXT, ARRAY, MAP, TAG, OTHER = range(8)


def _bad() -> Rejected:
    return Rejected("invalid_cbor")


def head(major: int, value: int) -> bytes:
    """The shortest head of a major type and an argument."""
    if value < 24:
        return bytes([major << 5 | value])
    for extra, size in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if value < 1 << 8 * size:
            return bytes([major << 5 | extra]) + value.to_bytes(size, "big")
    raise _bad()


def short_float(value: float) -> bytes:
    """The shortest float that is the same double."""
    if math.isnan(value):
        return b"\xf9\x7e\x00"
    for mark, form in ((b"\xf9", ">e"), (b"\xfa", ">f")):
        try:
            packed = struct.pack(form, value)
        except OverflowError:
            continue
        if struct.unpack(form, packed)[0] == value:
            return mark + packed
    return b"\xfb" + struct.pack(">d", value)


class _Open:
    """A container that still takes items: how many, or None until a break."""

    __slots__ = ("major", "left", "items", "tag")

    def __init__(self, major: int, left: int | None, tag: bytes = b""):
        self.major, self.left, self.items, self.tag = major, left, [], tag

    def done(self) -> bytes:
        if self.major == TAG:
            return self.tag + self.items[0]
        if self.major == ARRAY:
            return head(ARRAY, len(self.items)) + b"".join(self.items)
        if len(self.items) % 2:
            raise _bad()
        pairs = sorted(zip(self.items[::2], self.items[1::2], strict=True))
        if any(a[0] == b[0] for a, b in zip(pairs[:-1], pairs[1:], strict=True)):
            raise _bad()
        return head(MAP, len(pairs)) + b"".join(k + v for k, v in pairs)


def canonicalize(raw: bytes) -> bytes:
    at = 0
    size = len(raw)
    stack: list[_Open] = []

    def take(n: int) -> bytes:
        nonlocal at
        if n > size - at:
            raise _bad()
        at += n
        return raw[at - n : at]

    def argument(extra: int) -> int:
        if extra < 24:
            return extra
        if extra > 27:
            raise _bad()
        return int.from_bytes(take(1 << extra - 24), "big")

    while True:
        item: bytes | None = None
        if stack and stack[-1].left is None and raw[at : at + 1] == b"\xff":
            if stack[-1].major == MAP and len(stack[-1].items) % 2:
                raise _bad()
            at += 1
            item = stack.pop().done()
        else:
            if len(stack) > DEPTH:
                raise _bad()
            first = take(1)[0]
            major, extra = first >> 5, first & 31
            value = 0 if extra == 31 else argument(extra)
            if major in (UINT, NINT):
                item = head(major, value)
            elif major in (BYTES, TEXT):
                if extra == 31:
                    parts = []
                    while (mark := take(1)[0]) != 0xFF:
                        if mark >> 5 != major or mark & 31 == 31:
                            raise _bad()
                        parts.append(take(argument(mark & 31)))
                    body = b"".join(parts)
                else:
                    body = take(value)
                if major == TEXT:
                    try:
                        body.decode("utf-8")
                    except UnicodeDecodeError as e:
                        raise _bad() from e
                item = head(major, len(body)) + body
            elif major in (ARRAY, MAP):
                if extra != 31 and value == 0:
                    item = head(major, 0)
                else:
                    stack.append(_Open(major, None if extra == 31 else value * (1 + (major == MAP))))
                    if len(stack) > DEPTH and extra == 31 and raw[at : at + 1] == b"\xff":
                        continue
            elif major == TAG:
                if extra == 31:
                    raise _bad()
                stack.append(_Open(TAG, 1, head(TAG, value)))
            elif extra < 20 or extra in (20, 21, 22, 23):
                item = bytes([first])
            elif extra == 24:
                if value < 32:
                    raise _bad()
                item = bytes([0xF8, value])
            elif extra in (25, 26, 27):
                packed = raw[at - (1 << extra - 24) : at]
                item = short_float(struct.unpack({25: ">e", 26: ">f", 27: ">d"}[extra], packed)[0])
            else:
                raise _bad()
        while item is not None:
            if not stack:
                if at != size:
                    raise _bad()
                return item
            top = stack[-1]
            top.items.append(item)
            item = None
            if top.left is not None and len(top.items) == top.left:
                item = stack.pop().done()

"""S-expressions: atoms with their length in front, one space between siblings.

Code modules are written in the same form; builders for their parts are Spark expressions in
functions.builders.
"""

from __future__ import annotations

import re

from .base import Rejected, utf8

_token = re.compile(rb"[ \t\n\x0c\r]+|(\()|(\))|(\d+):|[^ \t\n\x0c\r()]+")


def canonicalize(raw: bytes, reason: str = "invalid_sexp") -> bytes:
    utf8(raw, reason)
    out: list[bytes] = []
    depth = at = tops = 0
    gap = False  # whether a sibling stands before
    while at < len(raw):
        m = _token.match(raw, at)
        at = m.end()
        piece = m.group()
        if m.group(2):
            depth -= 1
            if depth < 0:
                raise Rejected(reason)
            out.append(b")")
            gap = True
            tops += depth == 0
            continue
        if piece[0] in b" \t\n\x0c\r":
            continue
        if depth == 0 and tops:
            raise Rejected(reason)
        if gap:
            out.append(b" ")
        if m.group(1):
            out.append(b"(")
            depth += 1
            gap = False
            continue
        if m.group(3):
            digits = m.group(3).lstrip(b"0") or b"0"
            if len(digits) > 12 or at + int(digits) > len(raw):
                raise Rejected(reason)
            atom = raw[at : at + int(digits)]
            at += len(atom)
        else:
            atom = piece
        out.append(b"%d:%b" % (len(atom), atom))
        gap = True
        tops += depth == 0
    if depth or tops != 1:
        raise Rejected(reason)
    return b"".join(out)


def canonicalize_module(raw: bytes) -> bytes:
    return canonicalize(raw, "invalid_ast")

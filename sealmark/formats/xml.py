"""XML, a subset without namespaces, prologs, comments and document types, in canonical form.

Attributes are sorted by name, empty elements get an end tag, CDATA becomes text, references are decoded
and only what must be is escaped. The reader is a loop over one pattern per kind of markup.
"""

from __future__ import annotations

import re

from .base import DEPTH, Rejected, utf8

_S = r"[ \t\n\x0c\r]*"
_NAME = r"[A-Za-z0-9_.-]+"
_open = re.compile(rf"<({_NAME}){_S}")
_attribute = re.compile(rf"({_NAME}){_S}={_S}(?:\"([^\"]*)\"|'([^']*)'){_S}")
_close = re.compile(rf"</({_NAME}){_S}>")
_cdata = re.compile(r"<!\[CDATA\[(.*?)\]\]>", re.S)
_instruction = re.compile(rf"<\?({_NAME}){_S}(.*?)\?>", re.S)
_space = re.compile(_S)
_reference = re.compile(r"&([^;]*);?")
_FIVE = {"lt": "<", "gt": ">", "amp": "&", "quot": '"', "apos": "'"}
_IN_TEXT = str.maketrans({"<": "&lt;", ">": "&gt;", "&": "&amp;", "\r": "&#xD;"})
_IN_VALUE = str.maketrans({"<": "&lt;", ">": "&gt;", "&": "&amp;", '"': "&quot;", "\t": "&#x9;", "\n": "&#xA;", "\r": "&#xD;"})


def _bad() -> Rejected:
    return Rejected("invalid_xml")


def _decoded(m: re.Match) -> str:
    name = m.group(1)
    if not m.group().endswith(";"):
        raise _bad()
    if name in _FIVE:
        return _FIVE[name]
    number = re.fullmatch(r"#[xX](\+?[0-9A-Fa-f]+)|#(\+?[0-9]+)", name, re.A)
    if number is None:
        raise _bad()
    digits = (number.group(1) or number.group(2)).lstrip("+").lstrip("0") or "0"
    code = int(digits, 16 if number.group(1) else 10) if len(digits) < 12 else 1 << 40
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        raise _bad()
    return chr(code)


def _plain(text: str) -> str:
    return _reference.sub(_decoded, text) if "&" in text else text


def canonicalize(raw: bytes) -> bytes:
    text = utf8(raw, "invalid_xml")
    at = _space.match(text).end()
    out: list[str] = []
    names: list[str] = []
    while True:
        if names and text[at : at + 1] != "<":
            end = text.find("<", at)
            if end < 0:
                raise _bad()
            out.append(_plain(text[at:end]).translate(_IN_TEXT))
            at = end
        if names and (m := _close.match(text, at)):
            if m.group(1) != names.pop():
                raise _bad()
            out.append(f"</{m.group(1)}>")
            at = m.end()
        elif names and (m := _cdata.match(text, at)):
            out.append(m.group(1).translate(_IN_TEXT))
            at = m.end()
            continue
        elif names and (m := _instruction.match(text, at)):
            data = m.group(2).rstrip(" \t\n\x0c\r")
            out.append(f"<?{m.group(1)} {data}?>" if data else f"<?{m.group(1)}?>")
            at = m.end()
            continue
        else:
            m = _open.match(text, at)
            if m is None or len(names) > DEPTH:
                raise _bad()
            at = m.end()
            values = []
            while a := _attribute.match(text, at):
                values.append((a.group(1), _plain(a.group(2) if a.group(2) is not None else a.group(3))))
                at = a.end()
            values.sort(key=lambda v: v[0])
            head = "".join([m.group(1), *(f' {k}="{v.translate(_IN_VALUE)}"' for k, v in values)])
            if text.startswith("/>", at):
                out.append(f"<{head}></{m.group(1)}>")
                at += 2
            elif text.startswith(">", at):
                out.append(f"<{head}>")
                names.append(m.group(1))
                at += 1
                continue
            else:
                raise _bad()
        if not names:
            break
    if _space.match(text, at).end() != len(text):
        raise _bad()
    return "".join(out).encode()

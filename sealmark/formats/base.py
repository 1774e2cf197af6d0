"""What all formats share: the rejection that canonicalisers raise, and UTF-8 and NFC."""

from __future__ import annotations

import unicodedata

#: Deepest nesting of JSON, XML, CBOR and DER values.
DEPTH = 1024
#: Most non-starters in a row that normalisation reorders.
RUN = 32


class Rejected(ValueError):
    """A value that its format does not admit; the reason is a short code."""


def utf8(raw: bytes, reason: str) -> str:
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError as e:
        raise Rejected(reason) from e


def nfc(text: str, reason: str = "invalid") -> str:
    """Canonical composition; a run of more than RUN non-starters is rejected."""
    if text.isascii():
        return text
    if len(text) > RUN // 4:  # shorter texts can't decompose to such a run
        run = 0
        for c in unicodedata.normalize("NFD", text):
            run = run + 1 if unicodedata.combining(c) else 0
            if run > RUN:
                raise Rejected(reason)
    return unicodedata.normalize("NFC", text)


def nfc_quick_check(raw: bytes) -> str:
    """yes, no or maybe, from each character and its predecessor's class; no for what is not UTF-8.

    A character that composition may combine with what stands before it makes a maybe; one that
    composition never yields, or a class below the one before, makes a no.
    """
    try:
        text = raw.decode("utf-8")
    except UnicodeDecodeError:
        return "no"
    if text.isascii():
        return "yes"
    answer, before = "yes", 0
    for c in text:
        ccc = unicodedata.combining(c)
        if ccc and ccc < before:
            return "no"
        if unicodedata.normalize("NFC", c) != c:
            return "no"
        if _may_combine(c):
            answer = "maybe"
        before = ccc
    return answer


_backward: set[str] = set()


def _may_combine(c: str) -> bool:
    """Whether some composition takes this character as its second part."""
    if not _backward:
        for i in range(0x110000):
            parts = unicodedata.decomposition(chr(i)).split()
            if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", chr(i)) == chr(i):
                _backward.add(chr(int(parts[1], 16)))
        _backward.update(map(chr, range(0x1161, 0x1176)))  # vowels and trailing consonants of Hangul
        _backward.update(map(chr, range(0x11A8, 0x11C3)))
    return c in _backward

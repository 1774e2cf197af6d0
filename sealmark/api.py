"""Addresses of single values, without Spark: the same names for every format.

`<format>_address(value)`, `<format>_address_with_hash(value, axis)`, `<format>_address_with_witness(value)`
and `<format>_address_with_witness_hash(value, axis)`; `compose_<operation>(..., axis)` and
`compose_<operation>_with_witness(..., axis)`. Axes are names or selector codes.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from .formats import FORMATS, Rejected
from .functions.hashes import DIGESTS
from .functions.labels import DEFAULT_AXIS, DIGEST_BYTES, UnknownHash, axis_name, width

__all__ = ["AxisMismatch", "Grounded", "InvalidInput", "UnknownHash", "address", "compose", "digest_of"]


class InvalidInput(ValueError):
    """A value or operand that is not admitted."""


class AxisMismatch(ValueError):
    """An operand's axis isn't the operation's."""


@dataclass(frozen=True)
class Grounded:
    """A label and what it takes to check it."""

    axis: str
    digest: bytes
    canonical_len: int

    def kappa_label(self) -> str:
        return f"{self.axis}:{self.digest.hex()}"

    def content_fingerprint(self) -> bytes:
        """The canonical form's digest."""
        return self.digest

    def verify(self) -> str:
        """The label, if the digest is of the axis's width."""
        label = self.kappa_label()
        if len(label) != width(self.axis):
            raise InvalidInput("replay-failed")
        return label


def _hashed(canonical: bytes, axis: str | int) -> Grounded:
    name = axis_name(axis)
    return Grounded(name, DIGESTS[name]([canonical])[0], len(canonical))


def address(value: bytes | str, format_: str, axis: str | int = DEFAULT_AXIS) -> Grounded:
    try:
        canonical = FORMATS[format_](value.encode() if isinstance(value, str) else value)
    except Rejected as e:
        raise InvalidInput(str(e)) from e
    return _hashed(canonical, axis)


def digest_of(label: str, axis: str | int) -> str:
    """The hex digest of an operand on an axis."""
    name = axis_name(axis)
    found = re.fullmatch(r"([a-z0-9-]+):([0-9a-f]+)", label)
    if found is None or found[1] not in DIGEST_BYTES or len(found[2]) != 2 * DIGEST_BYTES[found[1]]:
        raise InvalidInput("malformed operand")
    if found[1] != name:
        raise AxisMismatch(f"expected {name}, got {found[1]}")
    return found[2]


def compose(operation: str, axis: str | int, *labels: str) -> Grounded:
    name = axis_name(axis)
    digests = [digest_of(x, name) for x in labels]
    if len(labels) != (2 if operation == "g2" else 1):
        raise InvalidInput("number of operands")
    raw, text = digests[0], labels[0]
    if operation == "g2":
        form = "".join(sorted(labels))
    elif operation == "f4":
        form = f"{name}:{min(raw, raw.translate(str.maketrans('0123456789abcdef', 'fedcba9876543210')))}"
    elif operation == "e6":
        form = chr(6 if int(raw[:2], 16) % 9 == 8 else 5) + text
    elif operation == "e7":
        quarter = len(raw) // 4
        form = f"{name}:{''.join(sorted(raw[k : k + quarter] for k in range(0, len(raw), quarter)))}"
    elif operation == "e8":
        form = text
    else:
        raise InvalidInput(f"unknown operation {operation!r}")
    return _hashed(form.encode(), name)


def _add(name: str, doc: str, f) -> None:
    f.__name__ = f.__qualname__ = name
    f.__doc__ = doc
    globals()[name] = f
    __all__.append(name)


for _f in FORMATS:
    _add(f"{_f}_address", f"The label of a value in {_f} on the default axis.", lambda value, _f=_f: address(value, _f).kappa_label())
    _add(f"{_f}_address_with_hash", f"The label of a value in {_f} on an axis.", lambda value, axis, _f=_f: address(value, _f, axis).kappa_label())
    _add(f"{_f}_address_with_witness", f"The witness of a value in {_f} on the default axis.", lambda value, _f=_f: address(value, _f))
    _add(f"{_f}_address_with_witness_hash", f"The witness of a value in {_f} on an axis.", lambda value, axis, _f=_f: address(value, _f, axis))
for _o in ("g2", "f4", "e6", "e7", "e8"):
    _add(f"compose_{_o}", f"The label of {_o} of labels.", lambda *labels, axis=DEFAULT_AXIS, _o=_o: compose(_o, axis, *labels).kappa_label())
    _add(f"compose_{_o}_with_witness", f"The witness of {_o} of labels.", lambda *labels, axis=DEFAULT_AXIS, _o=_o: compose(_o, axis, *labels))

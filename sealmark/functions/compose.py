"""Composition of labels: five operations whose canonical forms are text expressions in the JVM.

Operands are labels on the operation's axis; the result is the label of the canonical form on it.
`status` columns tell `ok`, `malformed_operand` or `axis_mismatch`; labels of bad operands are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import DEFAULT_AXIS, DIGEST_BYTES, as_column, axis_name, digest_hex, is_operand, label, sigma_axis

OPERATIONS = ("g2", "f4", "e6", "e7", "e8")


def operand_status(operand: Column | str, axis: str | int = DEFAULT_AXIS) -> Column:
    c = as_column(operand)
    return F.when(~F.coalesce(is_operand(c), F.lit(False)), "malformed_operand").when(sigma_axis(c) != axis_name(axis), "axis_mismatch").otherwise("ok")


def compose_status(axis: str | int, *operands: Column | str) -> Column:
    """The first failure among the operands, in their order."""
    out = F.lit("ok")
    for c in reversed(operands):
        s = operand_status(c, axis)
        out = F.when(s != "ok", s).otherwise(out)
    return out


def canonical(operation: str, axis: str | int, a: Column | str, b: Column | str | None = None) -> Column:
    """The canonical text that an operation hashes; for good operands only."""
    name = axis_name(axis)
    c = as_column(a)
    hex_ = digest_hex(c)
    if operation == "g2":
        other = as_column(b)
        return F.concat(F.least(c, other), F.greatest(c, other))
    if operation == "f4":
        flipped = F.translate(hex_, "0123456789abcdef", "fedcba9876543210")
        return F.concat(F.lit(name + ":"), F.least(hex_, flipped))
    if operation == "e6":
        byte = F.conv(F.substring(hex_, 1, 2), 16, 10).cast("int")
        return F.concat(F.char(F.when(byte % 9 == 8, 6).otherwise(5).cast("bigint")), c)
    if operation == "e7":
        quarter = DIGEST_BYTES[name] // 2
        parts = F.array(*(F.substring(hex_, 1 + k * quarter, quarter) for k in range(4)))
        return F.concat(F.lit(name + ":"), F.array_join(F.array_sort(parts), ""))
    if operation == "e8":
        return c
    raise ValueError(f"unknown operation {operation!r}")


def _composed(operation: str, axis: str | int, *operands: Column | str) -> Column:
    good = compose_status(axis, *operands) == "ok"
    return label(F.when(good, canonical(operation, axis, *operands)), axis)


def compose_g2(a: Column | str, b: Column | str, axis: str | int = DEFAULT_AXIS) -> Column:
    """The product of two labels, whatever their order."""
    return _composed("g2", axis, a, b)


def compose_f4(a: Column | str, axis: str | int = DEFAULT_AXIS) -> Column:
    """The quotient: a digest and its complement give the same label."""
    return _composed("f4", axis, a)


def compose_e6(a: Column | str, axis: str | int = DEFAULT_AXIS) -> Column:
    """The filtration: a degree of 5 or 6 by the first digest byte stands before the label."""
    return _composed("e6", axis, a)


def compose_e7(a: Column | str, axis: str | int = DEFAULT_AXIS) -> Column:
    """The augmentation: the least arrangement of the digest's four quarters."""
    return _composed("e7", axis, a)


def compose_e8(a: Column | str, axis: str | int = DEFAULT_AXIS) -> Column:
    """The embedding: the label of the label."""
    return _composed("e8", axis, a)

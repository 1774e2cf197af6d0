"""Labels: `<axis>:<lowercase hex digest>`, as Spark expressions.

An axis is a hash. Labels are ASCII text of a fixed width per axis, so text equality, order and hashing are
those of labels, and labels serve as keys of joins and groups directly.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hashes import DIGESTS

#: Digest bytes by axis, and the selector code of each.
DIGEST_BYTES = {"sha256": 32, "blake3": 32, "sha3-256": 32, "keccak256": 32, "sha512": 64}
SELECTORS = {0: "sha256", 1: "blake3", 2: "sha3-256", 3: "keccak256", 4: "sha512"}
DEFAULT_AXIS = "blake3"
AXES = tuple(DIGEST_BYTES)


class UnknownHash(ValueError):
    """An axis or selector that isn't known."""


def axis_name(axis: str | int) -> str:
    name = SELECTORS.get(axis, axis) if isinstance(axis, int) else axis
    if name not in DIGEST_BYTES:
        raise UnknownHash(f"unknown hash {axis!r}")
    return name


def width(axis: str | int) -> int:
    """Characters of a label."""
    name = axis_name(axis)
    return len(name) + 1 + 2 * DIGEST_BYTES[name]


def as_column(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _digest_udf(axis: str):
    many = DIGESTS[axis]

    @F.arrow_udf(T.BinaryType())  # of arrays, as Spark starts a Python worker a task for each function of iterators
    def digest(b: pa.Array) -> pa.Array:
        values = b.to_pylist()
        there = [k for k, v in enumerate(values) if v is not None]
        out: list = [None] * len(values)
        for k, d in zip(there, many([values[k] for k in there]), strict=True):
            out[k] = d
        return pa.array(out, pa.binary())

    return digest


def digest(value: Column | str, axis: str | int = DEFAULT_AXIS) -> Column:
    """The binary digest of a binary or string column; null for null. SHA-2 stays in the JVM."""
    name = axis_name(axis)
    raw = as_column(value).cast("binary")
    if name in ("sha256", "sha512"):
        return F.unhex(F.sha2(raw, 256 if name == "sha256" else 512))
    return _digest_udf(name)(raw)


def hex_digest(value: Column | str, axis: str | int = DEFAULT_AXIS) -> Column:
    name = axis_name(axis)
    if name in ("sha256", "sha512"):
        return F.sha2(as_column(value).cast("binary"), 256 if name == "sha256" else 512)
    return F.lower(F.hex(digest(value, name)))


def label(value: Column | str, axis: str | int = DEFAULT_AXIS) -> Column:
    """The label of a column's bytes as they are (canonicalise first)."""
    name = axis_name(axis)
    return F.concat(F.lit(name + ":"), hex_digest(value, name))


def label_of_digest(digest_: Column | str, axis: str | int) -> Column:
    return F.concat(F.lit(axis_name(axis) + ":"), F.lower(F.hex(as_column(digest_))))


def label_width(axis: Column | str) -> Column:
    """Characters of a label by a column of axis names; null for others."""
    c = as_column(axis)
    out = F.lit(None).cast("int")
    for name in AXES:
        out = F.when(c == name, width(name)).otherwise(out)
    return out


def sigma_axis(label_: Column | str) -> Column:
    """The text before the first colon; null without one."""
    c = as_column(label_)
    return F.when(F.instr(c, ":") > 0, F.substring_index(c, ":", 1))


def digest_hex(label_: Column | str) -> Column:
    """The text after the first colon; null without one."""
    c = as_column(label_)
    return F.when(F.instr(c, ":") > 0, F.substr(c, F.instr(c, ":") + 1))


def is_label(value: Column | str, axis: str | int = DEFAULT_AXIS) -> Column:
    """Whether a value is ASCII of the axis's width; nothing else is looked at."""
    c = as_column(value)
    return (F.octet_length(c) == width(axis)) & c.rlike(r"\A[\x00-\x7F]*\z")


def is_operand(value: Column | str) -> Column:
    """Whether a value is a whole label of a known axis: its width, lowercase hex."""
    c = as_column(value)
    out = F.lit(False)
    for name in AXES:
        out = out | c.rlike(rf"\A{name}:[0-9a-f]{{{2 * DIGEST_BYTES[name]}}}\z")
    return out


def operand_digest(value: Column | str) -> Column:
    """The raw digest of a well-formed label, else null."""
    c = as_column(value)
    return F.when(is_operand(c), F.unhex(digest_hex(c)))


def label_iri(axis: Column | str, base: str) -> Column:
    """The type identifier of an axis's labels under a base that the caller names."""
    return F.concat(F.lit(base.rstrip("/") + "/AddressLabel/"), as_column(axis))


def composition_iri(operation: str, axis: Column | str, base: str) -> Column:
    names = {"g2": "g2-product", "f4": "f4-quotient", "e6": "e6-filtration", "e7": "e7-augmentation", "e8": "e8-embedding"}
    return F.concat(F.lit(f"{base.rstrip('/')}/composition/{names[operation]}/"), as_column(axis))

"""Predicates on digests: thresholds and proximity, and their combinations, as boolean expressions.

Digests are hex text (`digest_hex` of a label). Conjunction is `&`, the single predicate itself, and the
empty one is true.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import as_column


def at_most(hex_: Column | str, target: str) -> Column:
    """Whether a digest is at most the target, both as numbers of the same width with the high byte first."""
    return as_column(hex_) <= F.lit(target.lower())


def storage_admitted(hex_: Column | str) -> Column:
    """At most 7f ff ... ff: the first digit is below 8."""
    return F.substring(as_column(hex_), 1, 1) < "8"


def close_to(hex_: Column | str, reference: Column | str, k: int) -> Column:
    """Whether the last k bits of two digests of the same width agree; a reference that is a str is hex text itself."""
    c, other = as_column(hex_), F.lit(reference.lower()) if isinstance(reference, str) else reference
    digits, bits = divmod(k, 4)
    same = F.right(c, F.lit(digits)) == F.right(other, F.lit(digits))
    if bits:
        a, b = (F.conv(F.substring(x, -digits - 1, 1), 16, 10).cast("int") for x in (c, other))
        same = same & (a.bitwiseXOR(b) % (1 << bits) == 0)
    return same


def signed_admitted(hex_: Column | str) -> Column:
    """Close to zero in one bit: the last digit is even."""
    return F.substring(as_column(hex_), -1, 1).isin(*"02468ace")


def bandwidth_bits(accept_probability: float) -> float:
    return -math.log2(accept_probability)


def all_of(*predicates: Column) -> Column:
    out = F.lit(True)
    for p in predicates:
        out = out & p
    return out

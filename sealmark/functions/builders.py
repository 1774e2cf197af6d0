"""Values written in a format, as Spark expressions: code modules, DER and ring elements."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .labels import as_column


def _raw(c: Column | str) -> Column:
    return as_column(c).cast("string")


def atom(text: Column | str) -> Column:
    """An atom with its length in bytes in front."""
    c = _raw(text)
    return F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)


def module(name: Column | str, *items: Column) -> Column:
    """(3:mod name item ...); items are canonical already."""
    return F.concat(F.lit("(3:mod "), F.concat_ws(" ", atom(name), *items), F.lit(")"))


def function(name: Column | str, parameters: Column, result: Column | str, body: Column) -> Column:
    """(3:fun name (parameter ...) result body); parameters is an array of texts, body is canonical already."""
    listed = F.concat(F.lit("("), F.array_join(F.transform(parameters, atom), " "), F.lit(")"))
    return F.concat(F.lit("(3:fun "), F.concat_ws(" ", atom(name), listed, atom(result), body), F.lit(")"))


# --- DER ------------------------------------------------------------------------------------------------


def _hex_of(n: Column, digits: int) -> Column:
    return F.lpad(F.conv(n.cast("string"), 10, 16), digits, "0")


def der_length(n: Column) -> Column:
    """Hex of the length octets of n, for n below 2^32."""
    size = F.when(n < 1 << 8, 1).when(n < 1 << 16, 2).when(n < 1 << 24, 3).otherwise(4)
    long = F.concat(_hex_of(F.lit(128) + size, 2), F.lpad(F.conv(n.cast("string"), 10, 16), size * 2, F.lit("0")))
    return F.when(n < 128, _hex_of(n, 2)).otherwise(long)


def der_value(tag: int, content: Column) -> Column:
    """tag, length and content as binary."""
    return F.unhex(F.concat(F.lit(f"{tag:02X}"), der_length(F.octet_length(content).cast("bigint")), F.hex(content)))


def der_integer(n: Column | str) -> Column:
    """A 64-bit integer in the fewest bytes of two's complement."""
    c = as_column(n).cast("bigint")
    whole = F.lpad(F.hex(c), 16, "0")
    positive = F.when(c < 0, F.bitwise_not(c)).otherwise(c)
    size = F.lit(8)
    for k in range(7, 0, -1):
        size = F.when(positive < (1 << 8 * k - 1), k).otherwise(size)
    return der_value(0x02, F.unhex(F.substr(whole, F.lit(17) - size * 2)))


def der_boolean(b: Column | str) -> Column:
    return F.when(as_column(b), F.unhex(F.lit("0101FF"))).otherwise(F.unhex(F.lit("010100")))


def der_null() -> Column:
    return F.unhex(F.lit("0500"))


def der_octets(content: Column | str) -> Column:
    return der_value(0x04, as_column(content).cast("binary"))


def der_utf8(text: Column | str) -> Column:
    return der_value(0x0C, as_column(text).cast("binary"))


def der_bit_string(bits: Column | str, unused: Column | int = 0) -> Column:
    """Bits behind the number of unused ones at their end, which must be zero; null for what no bit string is."""
    c, n = as_column(bits).cast("binary"), F.lit(unused) if isinstance(unused, int) else unused
    last = F.conv(F.hex(F.substring(c, -1, 1)), 16, 10).cast("int")
    zero = F.when(F.octet_length(c) == 0, n == 0).otherwise(last % F.pow(F.lit(2), n).cast("int") == 0)
    content = F.unhex(F.concat(_hex_of(n, 2), F.hex(c)))
    return F.when((n >= 0) & (n <= 7) & zero, der_value(0x03, content))


def _base128(n: Column) -> Column:
    """Hex of a number in groups of seven bits, the high one first, all but the last with the top bit."""
    groups = []
    for k in range(8, -1, -1):
        group = F.shiftright(n, 7 * k).bitwiseAND(F.lit(127))
        groups.append(F.when(n >= 1 << 7 * k, _hex_of(group + 128, 2)).otherwise("") if k else _hex_of(group, 2))
    return F.concat(*groups)


def der_object_identifier(arcs: Column | str) -> Column:
    """An array of numbers; null if it has fewer than two, a negative one, or a root that doesn't admit the second."""
    c = as_column(arcs).cast("array<bigint>")
    root, second = F.try_element_at(c, F.lit(1)), F.try_element_at(c, F.lit(2))
    good = (F.size(c) >= 2) & (root <= 2) & F.forall(c, lambda n: n >= 0) & ((root == 2) | (second < 40))
    numbers = F.concat(F.array(root * 40 + second), F.slice(c, F.lit(3), F.greatest(F.size(c), F.lit(0))))
    return F.when(good, der_value(0x06, F.unhex(F.array_join(F.transform(numbers, _base128), ""))))


def der_printable(text: Column | str) -> Column:
    """Letters, digits and a few marks; null for text with others."""
    c = _raw(text)
    return F.when(c.rlike(r"\A[A-Za-z0-9 '()+,\-./:=?]*\z"), der_value(0x13, c.cast("binary")))


def der_ia5(text: Column | str) -> Column:
    """ASCII; null for other text."""
    c = _raw(text)
    return F.when(c.rlike(r"\A[\x00-\x7F]*\z"), der_value(0x16, c.cast("binary")))


def der_sequence(*children: Column) -> Column:
    return der_value(0x30, F.concat(*children))


def der_set(*children: Column) -> Column:
    """Children sorted by their bytes; hex text sorts as the bytes do."""
    return der_value(0x31, F.unhex(F.array_join(F.array_sort(F.array(*(F.hex(c) for c in children))), "")))


# --- ring -----------------------------------------------------------------------------------------------


def ring_element(k: int, coefficient: Column | str) -> Column:
    """Level k, then the coefficient's low k + 1 bytes, the low one first."""
    whole = F.lpad(F.hex(as_column(coefficient).cast("bigint")), 16, "0")
    parts = [F.substring(whole, 15 - 2 * i, 2) for i in range(k + 1)]
    return F.unhex(F.concat(F.lit(f"{k:02X}"), *parts))


def ring_valid(raw: Column | str) -> Column:
    c = as_column(raw)
    level = F.conv(F.hex(F.substring(c, 1, 1)), 16, 10).cast("int")
    return F.coalesce((level <= 3) & (F.octet_length(c) == level + 2), F.lit(False))


def ring_level(raw: Column | str) -> Column:
    """The level of a valid element, else null."""
    return F.when(ring_valid(raw), F.conv(F.hex(F.substring(as_column(raw), 1, 1)), 16, 10).cast("int"))

"""Unicode operators on columns: UTF-8 validity, composition and its quick check."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..formats.base import Rejected, nfc, nfc_quick_check, utf8
from .labels import as_column


def utf8_valid(value: Column | str) -> Column:
    """Whether bytes are UTF-8, in the JVM; null for null."""
    return F.is_valid_utf8(as_column(value).cast("string"))


def _each(rule: Callable[[bytes], str]) -> Callable[[Column | str], Column]:
    @F.arrow_udf(T.StringType())
    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            try:
                out.append(None if v is None else rule(v))
            except Rejected:
                out.append(None)
        return pa.array(out, pa.string())

    return lambda c: run(as_column(c).cast("binary"))


def to_nfc(value: Column | str) -> Column:
    """Text in canonical composition; null for what is no UTF-8 or has too many marks in a row."""
    return _each(lambda v: nfc(utf8(v, "invalid")))(value)


def quick_check(value: Column | str) -> Column:
    """yes, no or maybe."""
    return _each(nfc_quick_check)(value)

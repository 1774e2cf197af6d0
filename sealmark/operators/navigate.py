"""Looking into JSON values: kinds, members, items and scalars, by the rules of the canonical form."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..formats import Rejected, json
from ..functions.labels import as_column


def _each(rule: Callable[[bytes], object], type_: T.DataType, arrow: pa.DataType) -> Callable[[Column | str], Column]:
    @F.arrow_udf(type_)
    def run(values: pa.Array) -> pa.Array:
        out = []
        for v in values.to_pylist():
            try:
                out.append(None if v is None else rule(v))
            except Rejected:
                out.append(None)
        return pa.array(out, arrow)

    return lambda c: run(as_column(c).cast("binary"))


def json_kind(value: Column | str) -> Column:
    """null, false, true, number, string, array or object; null for what is rejected."""
    return _each(json.kind, T.StringType(), pa.string())(value)


def json_get(value: Column | str, name: str) -> Column:
    """An object's member as canonical text."""
    return _each(lambda v: json.get(v, name), T.StringType(), pa.string())(value)


def json_scalar(value: Column | str) -> Column:
    """A string's text, or a number or boolean as text."""
    return _each(json.scalar, T.StringType(), pa.string())(value)


def json_items(value: Column | str) -> Column:
    """An array's items as canonical texts."""
    return _each(json.items, T.ArrayType(T.StringType()), pa.list_(pa.string()))(value)


def json_members(value: Column | str) -> Column:
    """An object's members as an array of (name, value) in the order of the text; explode it for rows."""
    pair = T.StructType([T.StructField("name", T.StringType()), T.StructField("value", T.StringType())])
    arrow = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    return _each(lambda v: [{"name": k, "value": x} for k, x in json.members(v)], T.ArrayType(pair), arrow)(value)


def json_tagged(value: Column | str) -> Column:
    """The value in tagged bytes."""
    return _each(json.tagged, T.BinaryType(), pa.binary())(value)

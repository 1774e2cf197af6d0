"""Addresses of values: canonicalise a column in a format, hash it on an axis, keep what was found.

One Arrow UDF per call does both, a batch at a time, and is marked as not to be evaluated twice. A value
that its format rejects has a null label and the rejection's code; in strict mode it fails the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..formats import FORMATS, SKELETONS, Rejected
from ..functions.hashes import DIGESTS, joined
from ..functions.labels import AXES, DEFAULT_AXIS, DIGEST_BYTES, as_column, axis_name, label

CANONICAL = T.StructType([T.StructField("canonical", T.BinaryType()), T.StructField("violation", T.StringType())])
OUTCOME = T.StructType(
    [
        T.StructField("label", T.StringType()),
        T.StructField("axis", T.StringType()),
        T.StructField("digest", T.BinaryType()),
        T.StructField("canonical_len", T.LongType()),
        T.StructField("status", T.StringType()),
        T.StructField("violation", T.StringType()),
    ]
)


def _all(values: list[bytes | None], format_: str) -> tuple[list[bytes | None], list[str | None]]:
    rule = SKELETONS.get(format_) or FORMATS[format_]
    canonical: list[bytes | None] = []
    violation: list[str | None] = []
    for v in values:
        out = why = None
        if v is not None:
            try:
                out = rule(v)
            except Rejected as e:
                why = str(e)
        canonical.append(out)
        violation.append(why)
    if format_ in SKELETONS:  # the digests of all values at once
        there = [k for k, parts in enumerate(canonical) if parts is not None]
        for k, made in zip(there, joined([canonical[k] for k in there]), strict=True):
            canonical[k] = made
    return canonical, violation


def known_format(name: str) -> str:
    if name not in FORMATS:
        raise ValueError(f"unknown format {name!r}; one of {', '.join(FORMATS)}")
    return name


def canonicalize(value: Column | str, format_: str) -> Column:
    """struct<canonical, violation> of a binary or string column; both null for null."""
    name = known_format(format_)

    @F.arrow_udf(CANONICAL)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            canonical, violation = _all(b.to_pylist(), name)
            yield pa.StructArray.from_arrays([pa.array(canonical, pa.binary()), pa.array(violation, pa.string())], ["canonical", "violation"])

    return run.asNondeterministic()(as_column(value).cast("binary"))


def address(value: Column | str, format_: str, axis: str | int = DEFAULT_AXIS) -> Column:
    """struct<label, axis, digest, canonical_len, status, violation>; status is ok, invalid or null."""
    name, hash_ = known_format(format_), axis_name(axis)

    @F.arrow_udf(OUTCOME)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            canonical, violation = _all(b.to_pylist(), name)
            n = len(canonical)
            there = [k for k in range(n) if canonical[k] is not None]
            digest: list[bytes | None] = [None] * n
            for k, d in zip(there, DIGESTS[hash_]([canonical[k] for k in there]), strict=True):
                digest[k] = d
            yield pa.StructArray.from_arrays(
                [
                    pa.array([None if d is None else f"{hash_}:{d.hex()}" for d in digest], pa.string()),
                    pa.array([hash_] * n, pa.string()),
                    pa.array(digest, pa.binary()),
                    pa.array([None if c is None else len(c) for c in canonical], pa.int64()),
                    pa.array(["ok" if c is not None else "invalid" if v else "null" for c, v in zip(canonical, violation, strict=True)], pa.string()),
                    pa.array(violation, pa.string()),
                ],
                OUTCOME.fieldNames(),
            )

    return run.asNondeterministic()(as_column(value).cast("binary"))


def address_label(value: Column | str, format_: str, axis: str | int = DEFAULT_AXIS) -> Column:
    """The label alone; null for what is rejected."""
    return address(value, format_, axis)["label"]


def strict(outcome: Column) -> Column:
    """The label of an outcome; a rejected value fails the query."""
    return F.when(outcome["status"] == "invalid", F.raise_error(F.concat(F.lit("invalid-input: "), outcome["violation"]))).otherwise(outcome["label"])


def with_labels(df: DataFrame, value: str, format_: str, axes: tuple[str | int, ...] = AXES, prefix: str = "label_") -> DataFrame:
    """df and a label on each axis, of a value that is canonicalised once; also `violation`."""
    names = [axis_name(a) for a in axes]
    once = df.withColumn("_canonical", canonicalize(value, format_))
    labels = {prefix + n.replace("-", "_"): label(F.col("_canonical.canonical"), n) for n in names}
    return once.withColumns(labels | {"violation": F.col("_canonical.violation")}).drop("_canonical")


def _udf_of(format_: str):
    @F.arrow_udf(T.StringType())
    def run(values: pa.Array, axes: pa.Array) -> pa.Array:
        raw = [v.encode() if isinstance(v, str) else v for v in values.to_pylist()]
        names = axes.to_pylist()
        canonical, _ = _all(raw, format_)
        out: list[str | None] = [None] * len(raw)
        for axis in set(names) - {None}:
            known = axis_name(axis)
            at = [k for k, (c, a) in enumerate(zip(canonical, names, strict=True)) if a == axis and c is not None]
            for k, d in zip(at, DIGESTS[known]([canonical[k] for k in at]), strict=True):
                out[k] = f"{known}:{d.hex()}"
        return pa.array(out, pa.string())

    return run


def register(spark: SparkSession) -> list[str]:
    """SQL functions: for every format `<format>_address(value)` and `<format>_address_with_hash(value, axis)`,
    `<format>_canonicalize(value)`, and the compositions `compose_<operation>` and `compose_<operation>_<axis>`.
    Returns their names.
    """
    names = []
    for format_ in FORMATS:
        both = _udf_of(format_)
        spark.udf.register(f"{format_}_address_with_hash", both)
        spark.sql(f"create or replace temporary function {format_}_address(v binary) returns string return {format_}_address_with_hash(v, '{DEFAULT_AXIS}')")

        def canonical(values: pa.Array, rule: str = format_) -> pa.Array:
            raw = [v.encode() if isinstance(v, str) else v for v in values.to_pylist()]
            return pa.array(_all(raw, rule)[0], pa.binary())

        spark.udf.register(f"{format_}_canonicalize", F.arrow_udf(_typed(canonical), T.BinaryType()))
        names += [f"{format_}_address_with_hash", f"{format_}_address", f"{format_}_canonicalize"]
    for axis in AXES:  # what SQL has no function for
        if axis not in ("sha256", "sha512"):
            spark.udf.register(f"_{_word(axis)}_hex", _hex_udf(axis))
    for name, form in SQL_FORMS.items():
        for axis in (None, *AXES):
            names.append(_register_composition(spark, name, form, axis))
    return names


#: What each composition hashes of operands a and b, of the axis {axis} with digests of {n} hex digits.
SQL_FORMS = {
    "g2": "concat(least(a, b), greatest(a, b))",
    "f4": "concat('{axis}:', least(substring_index(a, ':', -1), translate(substring_index(a, ':', -1), '0123456789abcdef', 'fedcba9876543210')))",
    "e6": "concat(char(if(cast(conv(substring(substring_index(a, ':', -1), 1, 2), 16, 10) as int) % 9 = 8, 6, 5)), a)",
    "e7": "concat('{axis}:', array_join(array_sort(transform(sequence(0, 3), k -> substring(substring_index(a, ':', -1), 1 + k * {n} div 4, {n} div 4))), ''))",
    "e8": "a",
}


def _word(axis: str) -> str:
    return axis.replace("-", "_")


def _register_composition(spark: SparkSession, name: str, form: str, axis: str | None) -> str:
    """`compose_<operation>_<axis>`, or on the default axis `compose_<operation>`; null for a bad operand."""
    at = axis or DEFAULT_AXIS
    n = 2 * DIGEST_BYTES[at]
    hash_ = f"sha2({{0}}, {at[3:]})" if at in ("sha256", "sha512") else f"_{_word(at)}_hex(cast({{0}} as binary))"
    operands = ("a", "b") if name == "g2" else ("a",)
    good = " and ".join(f"regexp_like({x}, '^{at}:[0-9a-f]{{{n}}}$')" for x in operands)
    label_ = f"concat('{at}:', {hash_.format(form.format(axis=at, n=n))})"
    function = f"compose_{name}" + (f"_{_word(axis)}" if axis else "")
    spark.sql(f"create or replace temporary function {function}({', '.join(f'{x} string' for x in operands)}) returns string return case when {good} then {label_} end")
    return function


def _hex_udf(axis: str):
    def run(values: pa.Array) -> pa.Array:
        raw = values.to_pylist()
        there = [k for k, v in enumerate(raw) if v is not None]
        out: list[str | None] = [None] * len(raw)
        for k, d in zip(there, DIGESTS[axis]([raw[k] for k in there]), strict=True):
            out[k] = d.hex()
        return pa.array(out, pa.string())

    return F.arrow_udf(_typed(run), T.StringType())


def _typed(f):
    def run(values: pa.Array) -> pa.Array:
        return f(values)

    return run



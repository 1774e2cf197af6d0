"""The registry of queries and their SQL, and what the queries share."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


#: Tables whose rows Python canonicalises; the others are small or stay in the JVM.
SPREAD = ("orders", "events", "documents", "embeddings", "pages", "customer")


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; one that the scan would give to fewer tasks than there are cores (a file of one row group) is dealt out."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if name in SPREAD and df.rdd.getNumPartitions() < cores else df


def text_of(raw) -> Column:
    return raw.cast("string")


def json_text(name, value) -> Column:
    """An object of one member; value is text that is JSON already."""
    return F.concat(F.lit('{"' + name + '":'), value, F.lit("}"))


def quoted(c) -> Column:
    """A JSON string of text without control characters other than line feeds and tabs."""
    out = F.col(c) if isinstance(c, str) else c
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.concat(F.lit('"'), out, F.lit('"'))


Q_SQL = r"""'"' || replace(replace(replace(replace(replace({0}, '\', '\\'), '"', '\"'), chr(10), '\n'), chr(13), '\r'), chr(9), '\t') || '"'"""


def made(build: Callable[..., bytes], *keys: str | Column) -> Column:
    """A binary column that a Python function makes of a row's values, for formats that no expression writes."""

    @F.arrow_udf(T.BinaryType())
    def run(rows: pa.Array) -> pa.Array:
        return pa.array([build(*row.values()) for row in rows.to_pylist()], pa.binary())

    return run.asNondeterministic()(F.struct(*keys))


def cases(df: DataFrame, forms: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """(keep, variant, raw): a row of df once for each form."""
    spread = F.explode(F.array(*(F.struct(F.lit(n).alias("variant"), f.cast("binary").alias("raw")) for n, f in forms.items())))
    return df.select(*keep, spread.alias("_x")).select(*keep, "_x.variant", "_x.raw")

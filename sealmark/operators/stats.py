"""Distributions of digests: counts by byte and by hex position, chi-square, avalanche, invariance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import digest_hex


def byte0_histogram(df: DataFrame, label: str) -> DataFrame:
    """(byte0, n) of the digests' first bytes."""
    return df.groupBy(F.conv(F.substring(digest_hex(label), 1, 2), 16, 10).cast("int").alias("byte0")).agg(F.count("*").alias("n"))


def hex_histogram(df: DataFrame, label: str) -> DataFrame:
    """(position, digit, n) over all hex positions; positions from 0."""
    spread = df.select(F.posexplode(F.split(digest_hex(label), "")).alias("position", "digit"))
    return spread.filter("digit <> ''").groupBy("position", "digit").agg(F.count("*").alias("n"))


def chi_square(histogram: DataFrame, bins: int) -> DataFrame:
    """One row: chi-square of the counts n against equal shares of `bins` bins, empty ones included."""
    total = histogram.agg(F.sum("n").alias("total"), F.count("*").alias("used"), F.sum((F.col("n") * F.col("n")).cast("double")).alias("squares"))
    expected = F.col("total") / bins
    return total.select("total", (F.col("squares") / expected - F.col("total")).alias("chi2"))


def hamming(a: Column, b: Column) -> Column:
    """Bits in which two hex texts of 64 digits differ."""
    out = F.lit(0)
    for k in range(8):
        x, y = (F.conv(F.substring(c, 1 + 8 * k, 8), 16, 10).cast("bigint") for c in (a, b))
        out = out + F.bit_count(x.bitwiseXOR(y))
    return out


def avalanche(df: DataFrame, left: str, right: str, least: int = 100) -> DataFrame:
    """One row: pairs of labels, and those that differ in `least` bits or more."""
    bits = hamming(digest_hex(left), digest_hex(right))
    return df.agg(F.count("*").alias("n"), F.sum(F.when(bits >= least, 1).otherwise(0)).alias("n_far"))

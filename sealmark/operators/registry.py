"""What labels are for: equal values found, looked up and bound together by their labels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compose import compose_g2
from ..functions.labels import DEFAULT_AXIS


def dedupe(df: DataFrame, label: str, key: str) -> DataFrame:
    """(label, keeper, n): each label's least key and how many rows have it. Partial counts come before the shuffle."""
    return df.groupBy(label).agg(F.min(key).alias("keeper"), F.count("*").alias("n"))


def distinct_values(df: DataFrame, label: str) -> DataFrame:
    """One row of df for each label."""
    return df.dropDuplicates([label])


def lookup(df: DataFrame, registry: DataFrame, label: str) -> DataFrame:
    """df's rows with the registry's columns of the same label."""
    return df.join(registry, label)


def missing(df: DataFrame, registry: DataFrame, label: str) -> DataFrame:
    """df's rows whose label the registry doesn't have: unknown or tampered values."""
    return df.join(registry.select(label).distinct(), label, "left_anti")


def bind(a: DataFrame, b: DataFrame, on: str, label: str, axis: str | int = DEFAULT_AXIS) -> DataFrame:
    """(on, bound): the product label of the two sides' labels of the same key.

    Both sides are sorted: Spark takes the size of labels for that of the compressed columns they are made of, and
    would send millions of them to every task.
    """
    left, right = a.select(on, F.col(label).alias("_a")), b.select(on, F.col(label).alias("_b")).hint("merge")
    return left.join(right, on).select(on, compose_g2("_a", "_b", axis).alias("bound"))


def collisions(df: DataFrame, value: str, label: str) -> DataFrame:
    """Labels that different values share; empty unless the hash is broken or values are equal in canonical form."""
    return df.groupBy(label).agg(F.countDistinct(value).alias("n_values")).filter("n_values > 1")


def label_counts(df: DataFrame, label: str) -> DataFrame:
    """One row: rows, and different labels."""
    return df.agg(F.count(label).alias("n"), F.countDistinct(label).alias("n_distinct"))


def partitioned(df: DataFrame, label: str) -> DataFrame:
    """df with the label's axis and first digest byte, for writers that partition by them."""
    return df.withColumns({"axis": F.substring_index(label, ":", 1), "byte0": F.substring(F.substring_index(label, ":", -1), 1, 2)})


def same(a: Column, b: Column) -> Column:
    """Whether two labels are there and equal."""
    return F.coalesce(a == b, F.lit(False))

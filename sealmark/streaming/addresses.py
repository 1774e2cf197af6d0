"""Addresses of streams: the map is stateless; removing repeats within a watermark is an extension."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.labels import DEFAULT_AXIS
from ..operators.address import address


def with_address(stream: DataFrame, value: str, format_: str, axis: str | int = DEFAULT_AXIS, name: str = "address") -> DataFrame:
    """A stream or table with the outcome of each row's value."""
    return stream.withColumn(name, address(value, format_, axis))


def first_seen(stream: DataFrame, label: str, time: str, delay: str) -> DataFrame:
    """The first row of each label; a label may come again once the watermark has passed it."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([label])

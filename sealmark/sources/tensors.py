"""Model files as tables: a row per tensor or key, layouts by window sums, and files made of vectors."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..formats import Rejected, gguf, onnx, safetensors
from ..functions.hashes import blake3_many, joined

TENSORS = "path string, name string, dtype string, shape array<decimal(20,0)>, begin decimal(20,0), bytes decimal(20,0), digest binary, violation string"


def _layout(df: DataFrame, file: str, name: str, size: Column) -> DataFrame:
    before = W.partitionBy(file).orderBy(name).rowsBetween(W.unboundedPreceding, -1)
    return df.select(file, name, F.coalesce(F.sum(size).over(before), F.lit(0)).cast("bigint").alias("canonical_offset"))


def gguf_layout(df: DataFrame, file: str, name: str, size: str, alignment: int = gguf.DEFAULT_ALIGNMENT) -> DataFrame:
    """(file, name, canonical_offset): tensors in order of their names, each aligned."""
    return _layout(df, file, name, F.ceil(F.col(size) / alignment) * alignment)


def safetensors_layout(df: DataFrame, file: str, name: str, size: str) -> DataFrame:
    """(file, name, canonical_offset): tensors in order of their names, without gaps."""
    return _layout(df, file, name, F.col(size))


def covers(df: DataFrame, file: str, begin: str, end: str, length: str) -> DataFrame:
    """(file, ok): whether each file's ranges, sorted, leave no gap from 0 to its length."""
    w = W.partitionBy(file).orderBy(begin, end)
    row = df.withColumn("_expected", F.coalesce(F.lag(end).over(w), F.lit(0)))
    return row.groupBy(file).agg((F.min((F.col(begin) == F.col("_expected")).cast("int")) == 1).alias("_tight"), F.max(end).alias("_end"), F.max(length).alias("_length")).select(file, (F.col("_tight") & (F.col("_end") == F.col("_length"))).alias("ok"))


def _gguf_rows(raw: bytes) -> list[tuple]:
    f = gguf.read(raw)
    for t in f.tensors:
        if f.data_start + t.offset + t.size > len(raw):
            raise Rejected("gguf_truncated")
    parts = [raw[f.data_start + t.offset : f.data_start + t.offset + t.size] for t in f.tensors]
    return [(t.name.decode("utf-8", "replace"), str(t.type_id), t.dims, t.offset, t.size, d) for t, d in zip(f.tensors, blake3_many(parts), strict=True)]


def _safetensors_rows(raw: bytes) -> list[tuple]:
    tensors, _, start = safetensors.read(raw)
    digests = blake3_many([raw[start + t.begin : start + t.end] for t in tensors])
    return [(t.name, t.dtype, t.shape, t.begin, t.end - t.begin, d) for t, d in zip(tensors, digests, strict=True)]


def _onnx_rows(raw: bytes) -> list[tuple]:
    graph = onnx.Message(onnx.Message(raw).bytes(7))
    out, parts = [], []
    for t in map(onnx.Message, graph.all_bytes(5)):
        kind = t.varint(2) or 0
        out.append((t.bytes(8).decode("utf-8", "replace"), str(kind), tuple(t.varints(1)), 0, len(t.bytes(9))))
        parts.append([onnx.tensor_data(t, kind)])
    return [(*row, d) for row, d in zip(out, joined(parts), strict=True)]


READERS = {"gguf": _gguf_rows, "safetensors": _safetensors_rows, "onnx": _onnx_rows}


def tensors(files: DataFrame, format_: str, path: str = "path", content: str = "content") -> DataFrame:
    """A row for each tensor of each file (binary content, as read by the binaryFile source).

    Offsets and sizes are unsigned 64-bit and so decimals. A file that is rejected has one row with the
    reason.
    """
    reader = READERS[format_]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from decimal import Decimal

        number = pa.decimal128(20, 0)
        for b in batches:
            for where, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if raw is None:
                    continue
                try:
                    rows, why = reader(raw), None
                except Rejected as e:
                    rows, why = [(None, None, None, None, None, None)], str(e)
                name, dtype, shape, begin, size, digest = zip(*rows, strict=True) if rows else ((),) * 6
                exact = lambda xs: pa.array([None if x is None else Decimal(x) for x in xs], number)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([where] * len(name), pa.string()),
                        pa.array(name, pa.string()),
                        pa.array(dtype, pa.string()),
                        pa.array([None if s is None else [Decimal(x) for x in s] for s in shape], pa.list_(number)),
                        exact(begin),
                        exact(size),
                        pa.array(digest, pa.binary()),
                        pa.array([why] * len(name), pa.string()),
                    ],
                    ["path", "name", "dtype", "shape", "begin", "bytes", "digest", "violation"],
                )

    return files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, TENSORS)


def gguf_keys(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, name, type_id, bytes) of each metadata key of each GGUF file; rejected files have no rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for where, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(where, k.name.decode("utf-8", "replace"), k.type_id, k.end - k.start) for k in gguf.read(raw or b"").keys]
                except Rejected:
                    continue
            if rows:
                columns = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int32(), pa.int64()), strict=True)], ["path", "name", "type_id", "bytes"])

    return files.select(F.col(path).alias("path"), F.col(content).cast("binary").alias("content")).mapInArrow(run, "path string, name string, type_id int, bytes bigint")


def read_models(spark, path: str, format_: str) -> DataFrame:
    """(path, content) of the model files under a path, by their ending."""
    return spark.read.format("binaryFile").option("pathGlobFilter", f"*.{format_}").option("recursiveFileLookup", "true").load(path).select("path", "content")


# --- files made of vectors, for queries and tests -------------------------------------------------------


def _two_files(vector: list[float], format_: str) -> tuple[bytes, bytes]:
    """A file with the vector's halves as tensors, and one with the same in another order."""
    half = len(vector) // 2
    a, b = (struct.pack(f"<{len(x)}f", *x) for x in (vector[:half], vector[half:]))
    if format_ == "gguf":
        keys = [("general.name", gguf.STRING, struct.pack("<Q", 1) + b"v"), ("n", 4, struct.pack("<I", len(vector)))]
        parts = [("a", (half,), 0, a), ("b", (len(vector) - half,), 0, b)]
        return gguf.build(keys, parts), gguf.build(keys[::-1], parts[::-1])
    if format_ == "safetensors":
        entry = '"{}":{{"dtype":"F32","shape":[{}],"data_offsets":[{},{}]}}'
        one = ",".join((entry.format("a", half, 0, len(a)), entry.format("b", len(vector) - half, len(a), len(a) + len(b))))
        other = ",".join((entry.format("b", len(vector) - half, 0, len(b)), entry.format("a", half, len(b), len(a) + len(b))))
        return safetensors.build("{" + one + "}", a + b), safetensors.build("{" + other + "} ", b + a)
    put = onnx.message
    nodes = [put((1, "x"), (2, "y"), (3, "n1"), (4, "Relu")), put((1, "y"), (1, "a"), (2, "z"), (3, "n2"), (4, "Add"))]
    weights = [put((1, half), (2, 1), (8, "a"), (9, a)), put((1, len(vector) - half), (2, 1), (8, "b"), (9, b))]

    def model(nodes: list[bytes], weights: list[bytes]) -> bytes:
        graph = put(*((1, n) for n in nodes), (2, "g"), *((5, w) for w in weights))
        return put((1, 9), (7, graph), (8, put((2, 17))))

    return model(nodes, weights), model(nodes[::-1], weights[::-1])


def files_of_vectors(df: DataFrame, format_: str, vector: str = "embedding") -> DataFrame:
    """(one, other): two files of the same content for each vector that isn't null."""
    pair = T.StructType([T.StructField("one", T.BinaryType()), T.StructField("other", T.BinaryType())])

    @F.arrow_udf(pair)
    def run(values: pa.Array) -> pa.Array:
        made = [_two_files(v, format_) for v in values.to_pylist()]
        return pa.StructArray.from_arrays([pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.binary())], ["one", "other"])

    return df.filter(F.col(vector).isNotNull()).select(run.asNondeterministic()(vector).alias("f")).select("f.one", "f.other")

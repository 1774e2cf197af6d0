"""Near-duplicate documents by DartMinHash over weighted sets of word shingles: a shingle weighs as often as it occurs.

Darts are thrown at each element's region, weight by rank: a Poisson process of rate one over the
rank axis for every unit of weight, made by hashes of the element alone, so that two documents see the
same darts over the part of the region that they share. Only darts up to a rank that a text of its
total weight needs are made, about k ln k + 2k for k coordinates, however large the text; a
coordinate keeps its earliest dart. Two signatures agree in a coordinate with a probability of the
weighted Jaccard similarity, the sum of lesser weights over the sum of greater ones. Bands of coordinates are
joined, and documents that share one are verified by that similarity itself, on 32-bit hashes: a shingle's
second, third and further occurrences are elements of their own, so that it is a similarity of plain sets.

Texts that are equal are grouped first; only one of each takes part in the rest. A null text or id
is in no group: its class is its own id. Texts without words are near only to equal texts.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .components import similar_groups
from .words import Texts, distinct_by_text, mix

U = np.uint64
WIDTH, THRESHOLD, BANDS, ROWS = 5, 0.8, 25, 6


def _uniform(x: np.ndarray) -> np.ndarray:
    """In (0, 1], from the upper 53 bits."""
    return ((mix(x) >> U(11)).astype(np.float64) + 1.0) * 2.0**-53


def _throw(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, k: int, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values and ranks, (n, k), of the earliest dart in each coordinate up to each set's reach."""
    # each element's weight is cut into slabs of one unit; a dart has a place within its slab
    units = np.ceil(weight).astype(np.int64)
    slab_of = np.repeat(np.arange(len(element)), units)
    nth = np.arange(len(slab_of)) - np.repeat(np.cumsum(units) - units, units)
    slab = mix(element[slab_of] + mix(nth.astype(U) + U(0x51ED270B)))
    room = weight[slab_of] - nth  # of this slab's unit, how much the set covers
    owner = doc[slab_of]
    best, value = np.full(n * k, np.inf), np.zeros(n * k, U)
    rank = np.zeros(len(slab))
    alive = np.arange(len(slab))
    turn = 0
    while len(alive):
        turn += 1
        s = slab[alive] + U(turn * 0x9E3779B97F4A7C15 % 2**64)
        step = rank[alive] - np.log(_uniform(s))
        inside = step <= reach[owner[alive]]
        alive, s, step = alive[inside], s[inside], step[inside]
        rank[alive] = step
        at = mix(s ^ U(0xA5A5A5A5A5A5A5A5))
        hit = _uniform(at) <= room[alive]
        cell, dart, when = owner[alive][hit] * k + (at[hit] % U(k)).astype(np.int64), at[hit], step[hit]
        order = np.lexsort((dart, when, cell))
        first = np.ones(len(order), bool)
        first[1:] = cell[order][1:] != cell[order][:-1]
        top = order[first]
        top = top[when[top] < best[cell[top]]]
        best[cell[top]], value[cell[top]] = when[top], dart[top]
    return value.reshape(n, k), best.reshape(n, k)


def dart_signatures(element: np.ndarray, doc: np.ndarray, weight: np.ndarray, n: int, k: int) -> np.ndarray:
    """(n, k) signatures of n weighted sets, uint64; element and weight by set, sets ascending in doc.

    Weights are positive reals. Sets without elements get zeros. A set with a coordinate that no dart
    reached throws again, twice as far.
    """
    out = np.zeros((n, k), U)
    total = np.bincount(doc, weights=weight, minlength=n) if len(doc) else np.zeros(n)
    which = np.flatnonzero(total > 0)
    reach = np.zeros(n)
    reach[which] = (k * math.log(k) + 2 * k) / total[which]
    while len(which):
        back = np.full(n, -1)
        back[which] = np.arange(len(which))
        mine = back[doc] >= 0
        value, rank = _throw(element[mine], back[doc[mine]], weight[mine], len(which), k, reach[which])
        out[which] = value
        reach[which] *= 2
        which = which[np.isinf(rank).any(axis=1)]
    return out


def band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    """(n, bands): a hash of each run of `rows` coordinates and its place."""
    n, k = signatures.shape
    parts = signatures[:, : k // rows * rows].reshape(n, k // rows, rows)
    total = np.zeros(parts.shape[:2], U)
    for r in range(rows):
        total = mix(total * U(3) + parts[:, :, r])
    return mix(total + np.arange(1, parts.shape[1] + 1, dtype=U)[None, :])


def occurrences(element: np.ndarray, doc: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An element for each occurrence: the first as it is, the others with their number mixed in."""
    nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    each = np.repeat(element, count)
    more = nth > 0
    each[more] = mix(each[more] + mix(nth[more].astype(U)))
    return each, np.repeat(doc, count)


def sets32(element: np.ndarray, doc: np.ndarray, n: int) -> list[bytes]:
    """Each text's elements as ascending unsigned 32-bit integers."""
    values, doc, _ = distinct_by_text((element >> U(32)).astype(np.uint32), doc)
    at = np.searchsorted(doc, np.arange(n + 1))
    return [values[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]


def _rows(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")


def signatures(df: DataFrame, weighted: bool = True, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, key, bands): a digest of the text and its band keys, for (doc_id, text).

    weighted: a shingle weighs as often as it occurs; else one.
    """

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = common.texts_of(b.column(1))
            for low, high in common.steps(column):
                part = column.slice(low, high - low)
                t = Texts(part)
                element, doc, count = distinct_by_text(*t.shingles(WIDTH))
                keys = band_keys(dart_signatures(element, doc, count.astype(float) if weighted else np.ones(len(element)), t.n, bands * rows), rows)
                some = t.n_words > 0
                at = np.zeros(t.n + 1, np.int32)
                np.cumsum(some * keys.shape[1], out=at[1:])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).slice(low, high - low),
                        pa.array([hashlib.md5(x.as_buffer(), usedforsecurity=False).digest() for x in part], pa.binary()),
                        pa.ListArray.from_arrays(pa.array(at), pa.array(keys[some].reshape(-1).view(np.int64))),
                    ],
                    ["doc_id", "key", "bands"],
                )

    return _rows(df).mapInArrow(run, "doc_id bigint, key binary, bands array<bigint>")


def shingle_sets(df: DataFrame, nodes: DataFrame, weighted: bool = True) -> DataFrame:
    """(node, set): the shingles of the texts of df (doc_id, text) whose id is in nodes (node).

    They are made from the texts once it is known whose are needed: those of all texts would take as much room as the texts.
    """

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = common.texts_of(b.column(1))
            for low, high in common.steps(column):
                t = Texts(column.slice(low, high - low))
                element, doc, count = distinct_by_text(*t.shingles(WIDTH))
                sets = sets32(*(occurrences(element, doc, count) if weighted else (element, doc)), t.n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), pa.array(sets, pa.binary())], ["node", "set"])

    return _rows(df).withColumnRenamed("doc_id", "node").join(nodes, "node", "left_semi").mapInArrow(run, "node bigint, set binary")


def classes(df: DataFrame, threshold: float = THRESHOLD, weighted: bool = True) -> DataFrame:
    """(doc_id, class_id) for every row of df (doc_id, text).

    class_id is the least doc_id of those that links of `threshold` or more connect, the row's own for
    a document without any. Links inside a class that its other links already imply are not looked for.
    """
    sig = common.table(signatures(df, weighted), "signatures")
    keys = sig.groupBy("key").agg(F.min("doc_id").alias("node"))
    nodes = common.table(keys, "texts")
    own = sig.select("doc_id", "key", "bands").join(nodes.select("node", F.col("key").alias("_key")), [F.col("key") == F.col("_key"), F.col("doc_id") == F.col("node")], "left_semi")
    bands = own.select(F.col("doc_id").alias("node"), F.explode("bands").alias("band")).distinct()
    comps, _ = similar_groups(bands, lambda some: shingle_sets(df, some, weighted), threshold)
    named = nodes.join(comps, "node", "left").select("key", F.coalesce("comp", "node").alias("class_id"))
    whole = sig.select("doc_id", "key").join(common.table(named, "classes"), "key").select("doc_id", "class_id")
    rest = df.filter("doc_id is null or text is null").select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("doc_id").cast("bigint").alias("class_id"))
    return whole.union(rest)


def keep_one(df: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """df's rows of one document of each class, the one whose doc_id is least; rows with a null text or id stay.

    Repeated rows of that document stay repeated: they have one id.
    """
    gone = classes(df, threshold).filter("doc_id <> class_id").select("doc_id").distinct()
    left = df.join(common.table(gone, "copies"), "doc_id", "left_anti").select(*df.columns)
    return left

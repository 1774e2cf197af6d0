"""Quality rules: word, symbol and repetition counts of a text, and cross-document line frequency.

A line is normalised to its words (A-Z lowered) joined by one space. Per host, a line's frequency is
the number of distinct documents with it. Documents are told apart by all their words in order (A-Z lowered,
a 64-bit hash), so copies of one document count once and every other document counts, however much it
shares; edited copies are documents of their own. Lines above the limit (`line_share` of the host's
distinct documents, and more than `line_least`) are removed, and a
document that keeps less than `keep_share` of its words is depleted and rejected.

Null and empty texts have no words and fail; a null host is a host of its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .words import Texts, mix

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_STEP = np.uint64(0xD6E8FEB86659FD93)
_STEP_INVERSE = pow(0xD6E8FEB86659FD93, -1, 1 << 64)
U = np.uint64


def _sum_by(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Sums of values between consecutive edges."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[edges[1:]] - total[edges[:-1]]


def repeat_words(t: Texts) -> np.ndarray:
    """Per text, the words that stand in a window of three words found twice or more in it."""
    h = t.word_hash
    n = len(h)
    marked = np.zeros(n, bool)
    if n >= 3:
        inside = np.flatnonzero(t.doc[2:] == t.doc[:-2])
        key = mix(h[inside] * U(3) + mix(h[inside + 1]) * U(5) + mix(mix(h[inside + 2])) * U(7) + mix(t.doc[inside].astype(U) + U(1)))
        order = np.argsort(key)
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        at = inside[order[twice]]
        for k in range(3):
            marked[at + k] = True
    return _sum_by(marked, t.word_at)


def measure(column: pa.Array) -> dict[str, np.ndarray]:
    """The counts of each text, and its lines: hashes, words and the texts' edges among them."""
    t = Texts(column)
    out = {"n_words": t.n_words}
    width = t.chars[t.ends] - t.chars[t.starts]
    out["word_chars"] = _sum_by(width, t.word_at)
    out["n_symbols"] = _sum_by(_SYMBOL[t.bytes], t.offsets)
    starts, ends, doc = t.lines()
    first, last = np.searchsorted(t.starts, starts), np.searchsorted(t.starts, ends)
    used = last > first
    starts, ends, doc, first, last = starts[used], ends[used], doc[used], first[used], last[used]
    raw = t.slice_hash(starts, ends)
    n_lines = np.bincount(doc, minlength=t.n)
    different = np.unique(mix(raw + mix(doc.astype(U) + U(1))), return_index=True)[1]
    out["n_dup_lines"] = n_lines - np.bincount(doc[different], minlength=t.n)
    out["n_repeat_words"] = repeat_words(t)

    low = Texts(column, lower=True).word_hash
    n = len(low)
    up = np.cumprod(np.full(n + 1, _STEP, U)) if n else np.ones(1, U)
    down = np.cumprod(np.full(n + 1, U(_STEP_INVERSE), U)) if n else np.ones(1, U)
    sums = np.zeros(n + 1, U)
    np.cumsum(low * up[:n], out=sums[1:])
    out["line"] = mix((sums[last] - sums[first]) * down[first] + (last - first).astype(U))
    out["line_words"] = last - first
    out["line_at"] = np.searchsorted(doc, np.arange(t.n + 1))
    edge = t.word_at[:-1]
    out["own"] = mix((sums[t.word_at[1:]] - sums[edge]) * down[edge] + t.n_words.astype(U))
    return out


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def counts(df: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), host: str = "source") -> DataFrame:
    """keep, host, the five counts, a hash of all words, and the lines as arrays of hashes and word counts."""
    frame = df.select(*(F.col(c) for c in keep), F.col(host).cast("string").alias("_host"), text)
    fields = {f.name: f for f in frame.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in keep), "_host string", *(f"{c} bigint" for c in _COUNTS), "_own bigint, _lines array<bigint>, _line_words array<int>"])

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = common.texts_of(b.column(len(keep) + 1))
            for low, high in common.steps(column):
                m = measure(column.slice(low, high - low))
                at = pa.array(m["line_at"], pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        *(b.column(i).slice(low, high - low) for i in range(len(keep) + 1)),
                        *(pa.array(m[c], pa.int64()) for c in _COUNTS),
                        pa.array(m["own"].view(np.int64)),
                        pa.ListArray.from_arrays(at, pa.array(m["line"].view(np.int64))),
                        pa.ListArray.from_arrays(at, pa.array(m["line_words"], pa.int32())),
                    ],
                    [*keep, "_host", *_COUNTS, "_own", "_lines", "_line_words"],
                )

    return frame.mapInArrow(run, schema)


def rate(
    df: DataFrame,
    text: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    host: str = "source",
    line_share: float = 0.03,
    line_least: int = 20,
    keep_share: float = 0.5,
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """keep's columns, the counts, base_failed, n_removed (words in removed lines) and kept.

    One pass over the texts; lines travel as (host, hash, hash of the document) and are pre-aggregated before each
    shuffle, so a line or a host that holds a third of the rows is spread over its documents.
    """
    base = common.table(counts(df, text, keep, host).withColumn("_row", F.monotonically_increasing_id()), "quality")
    hosts = base.select("_host", "_own").distinct().groupBy("_host").agg(F.count("*").alias("_docs"))
    lines = base.select("_host", "_own", F.explode(F.array_distinct("_lines")).alias("_line"))
    often = lines.distinct().groupBy("_host", "_line").agg(F.count("*").alias("_n")).filter(F.col("_n") > line_least)
    often = often.join(hosts, often["_host"].eqNullSafe(hosts["_host"])).filter(F.col("_n") > line_share * F.col("_docs")).select(F.coalesce(often["_host"], F.lit("")).alias("_h"), often["_host"].isNull().alias("_null"), F.col("_line").alias("_l"))
    often = common.maybe_broadcast(common.table(often, "frequent-lines"), broadcast_rows)
    held = base.select("_row", F.coalesce("_host", F.lit("")).alias("_h"), F.col("_host").isNull().alias("_null"), F.explode(F.arrays_zip("_lines", "_line_words")).alias("_x"))
    held = held.select("_row", "_h", "_null", F.col("_x._lines").alias("_l"), F.col("_x._line_words").alias("_w"))
    gone = held.join(often, ["_h", "_null", "_l"]).groupBy("_row").agg(F.sum("_w").alias("n_removed"))
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    removed = F.coalesce("n_removed", F.lit(0))
    return base.join(gone, "_row", "left").select(
        *keep, *_COUNTS, failed.alias("base_failed"), (~failed & (F.col("n_words") - removed >= keep_share * F.col("n_words"))).alias("kept"), removed.cast("bigint").alias("n_removed")
    )

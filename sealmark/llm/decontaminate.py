"""Benchmark decontamination with DataFrame operations only.

Items and documents are sets of runs of five words (case ignored). An item is contained in a document
if at least `threshold` of its runs are. Search: items are partitioned by size (powers of two), and
each partition has its own number k of MinHash values per item: its k runs with the least hashes. An
item of q runs may miss (1 - threshold) q of them at most, so k = floor((1 - threshold) U) + 1, with U
the partition's largest size, makes sure that every containing document has one of the k: the search
loses nothing. Every run of every document is looked up among these values; a hit makes a candidate.
Candidates are then verified on the runs' words themselves.

An item of fewer than five words is one run of all its words, found where they stand in a row. Items
without words are found nowhere; null texts count as empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

WIDTH = 5
_GAP = "[\\x20\\x09-\\x0D]+"
_TRIM = " \t\n\x0b\x0c\r"


def word_array(text: str | Column) -> Column:
    """The words of a text in lower case, as an array; null for a text without words."""
    bare = F.btrim(F.lower(text), F.lit(_TRIM))
    return F.when(bare != "", F.split(bare, _GAP))


def runs(df: DataFrame, *keep: str, width: int = WIDTH) -> DataFrame:
    """One row for each run of `width` words: keep's columns, its words w0.. and their hash."""
    words = df.select(*keep, word_array("text").alias("_w"))  # no filter on words: it would split each text once more
    n = F.greatest(F.size("_w") - (width - 1), F.lit(0))
    parts = F.arrays_zip(*(F.slice("_w", k + 1, n).alias(f"w{k}") for k in range(width)))
    rows = words.select(*keep, F.inline(parts))
    return rows.select(*keep, *(F.col(f"w{k}") for k in range(width)), F.xxhash64(*(f"w{k}" for k in range(width))).alias("run"))


def short_items(docs: DataFrame, items: DataFrame, broadcast_rows: int) -> DataFrame | None:
    """contained()'s rows for the items of fewer than WIDTH words; None if there are none."""
    sized = items.withColumn("_n", F.size(word_array("text")))
    found = None
    for n in sorted(r["_n"] for r in sized.filter(F.col("_n").between(1, WIDTH - 1)).select("_n").distinct().collect()):  # WIDTH - 1 at most
        few = common.maybe_broadcast(common.table(runs(sized.filter(F.col("_n") == n), "item_id", width=n).distinct(), "short-items"), broadcast_rows)
        hits = runs(docs, "doc_id", width=n).join(few, [f"w{k}" for k in range(n)] + ["run"]).select("doc_id", "item_id").distinct()
        found = hits if found is None else found.union(hits)
    one = F.lit(1).cast("bigint")
    return None if found is None else found.select("doc_id", "item_id", one.alias("n_item"), one.alias("n_shared"), F.lit(1.0).alias("containment"))


def sketches(item_runs: DataFrame, threshold: float) -> DataFrame:
    """(item_id, run) of each item's least k run hashes; item_runs has (item_id, run), distinct."""
    sized = item_runs.groupBy("item_id").agg(F.sort_array(F.collect_list("run")).alias("_all"))
    partition = F.floor(F.log2(F.size("_all"))).alias("partition")
    largest = F.pow(F.lit(2), F.col("partition") + 1) - 1
    k = (F.floor((1 - threshold) * largest + F.lit(1e-9)) + 1).cast("int")
    return sized.select("item_id", "_all", partition).select("item_id", "partition", F.explode(F.slice("_all", F.lit(1), k)).alias("run"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = 0.8, broadcast_rows: int = 2_000_000) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every item that a document contains.

    docs has doc_id and text, items has item_id and text. The runs' hashes of the items are broadcast
    if they are proven to be few, else both sides are shuffled by the run. Repeated rows of a document
    count once; rows with a null id are not looked at.
    """
    docs = docs.select("doc_id", "text").filter(F.col("doc_id").isNotNull())
    items = items.select("item_id", "text").filter(F.col("item_id").isNotNull())
    words = [f"w{k}" for k in range(WIDTH)]
    item_runs = common.table(runs(items, "item_id").distinct(), "item-runs")
    sketch = common.maybe_broadcast(common.table(sketches(item_runs.select("item_id", "run").distinct(), threshold), "item-sketches"), broadcast_rows)
    found = runs(docs, "doc_id").select("doc_id", "run").join(sketch.select("item_id", "run"), "run").select("doc_id", "item_id").distinct()
    found = common.table(found, "candidates")

    some = common.maybe_broadcast(found.select("doc_id").distinct(), broadcast_rows)
    seen = runs(docs.join(some, "doc_id", "left_semi"), "doc_id")
    known = common.maybe_broadcast(item_runs, broadcast_rows)
    shared = seen.join(known, [*words, "run"]).select("doc_id", "item_id", *words).distinct()
    shared = shared.groupBy("doc_id", "item_id").agg(F.count("*").alias("n_shared"))
    sizes = common.maybe_broadcast(item_runs.groupBy("item_id").agg(F.count("*").alias("n_item")), broadcast_rows)
    both = shared.join(found, ["doc_id", "item_id"], "left_semi").join(sizes, "item_id")
    whole = both.filter(F.col("n_shared") >= threshold * F.col("n_item") - F.lit(1e-9)).select("doc_id", "item_id", "n_item", "n_shared", (F.col("n_shared") / F.col("n_item")).alias("containment"))
    short = short_items(docs, items, broadcast_rows)
    return whole if short is None else whole.union(short)


def clean(docs: DataFrame, items: DataFrame, threshold: float = 0.8, broadcast_rows: int = 2_000_000) -> DataFrame:
    """docs without those that contain an item."""
    bad = common.table(contained(docs, items, threshold, broadcast_rows).select("doc_id").distinct(), "contaminated")
    return docs.join(common.maybe_broadcast(bad, broadcast_rows), "doc_id", "left_anti").select(*docs.columns)

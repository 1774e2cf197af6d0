"""Passages that repeat across documents: repeated runs of words, whole, and paragraphs that MinHash finds alike.

Equal texts come first: all but the document of the least id are removed whole, and only that one takes
part in the rest.

Exact repeats may stand anywhere in a line. Among every SPREAD consecutive places of a text the one whose two
words have the least hash begins a seed, a run of SEED words; the stretches from a text's beginning through
its first seed and from its last seed to the end are seeds too. So a passage of SEED + SPREAD - 1 = 20 words
or more brings the same seeds into every document that has it, overlapping ones, and at either end SPREAD - 1
words or fewer that no seed of it covers. Where documents with a seed go on differently (another seed before or
after it, or at another distance), a passage may end: there the runs of SEED words that begin up to SPREAD - 1
places further out are compared too, in one document for each way to go on. A passage that two documents
share, and neither shares its ends with others, is thus covered to its last word; where a passage ends within
what several other documents share, up to SPREAD - 1 words of it may be left out in some of those.

Near repeats: a text is cut at the places whose two words have the least hash among RADIUS places to either
side, and each paragraph between two cuts (more than RADIUS words) is signed by MinHash over its runs of five words: BANDS bands of ROWS
values (0.8 similar paragraphs share one with a probability of 0.986). Collisions are verified by exact
Jaccard similarity, and verified links make clusters by connected components. Cuts seldom fall on the ends of
what is alike, so a paragraph's span reaches from the first to the last word within it that a repeated run
covers: it joins runs across edited words, and takes in no words around them.

A cluster (a run, alike paragraphs or equal texts) that lies in two documents or more repeats: in the document of
the least id it stays, and all others are to be removed. What overlaps in a document and shares its fate is one
span; spans of fewer than LENGTH words are not reported.

No step gathers a cluster or a document's seeds in one task but the last, which orders a document's own spans
after its seeds have been merged by slots of the text. Shuffle files of steps that are over are freed early.

Null texts, null ids and texts of fewer than SEED words have no passages, but equal texts of LENGTH words or
more are found. Repeats within one document only don't count.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from . import common
from .components import similar_groups
from .words import Texts, distinct_by_text, mix

U = np.uint64
LENGTH, SEED, SPREAD = 16, 12, 9
RADIUS, WIDTH, BANDS, ROWS = 50, 5, 6, 3
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U)) | U(1)


def _least(h: np.ndarray, doc: np.ndarray, spread: int) -> tuple[np.ndarray, np.ndarray]:
    """For each place, the place of the least hash, the first of equals, among `spread` from it on in its text; whether there are so many."""
    n = len(h)
    start = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
    end = np.append(start[1:], n)
    # least of windows that begin at each place, by doubling; windows may not leave their text
    size, best = 1, np.arange(n)
    last = np.repeat(end, end - start)  # one past the text's last place

    def better(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(h[b] < h[a], b, a)

    while size * 2 <= spread:
        best = better(best, best[np.minimum(np.arange(n) + size, last - 1)])
        size *= 2
    best = better(best, best[np.minimum(np.arange(n) + spread - size, last - 1)])
    return best, np.arange(n) + spread <= last


def least_places(h: np.ndarray, doc: np.ndarray, spread: int) -> np.ndarray:
    """The places that have the least hash, the first of equals, among some `spread` consecutive ones of a text.

    A text with fewer places has its least one.
    """
    if not len(h):
        return np.empty(0, np.int64)
    best, whole = _least(h, doc, spread)
    whole[np.concatenate([[True], doc[1:] != doc[:-1]])] = True
    return np.unique(best[whole])


def cut_places(h: np.ndarray, doc: np.ndarray, radius: int) -> np.ndarray:
    """The places that have the least hash, the first of equals, among `radius` on either side; all of them in their text."""
    if not len(h):
        return np.empty(0, np.int64)
    best, whole = _least(h, doc, 2 * radius + 1)
    return np.flatnonzero(whole & (best == np.arange(len(h)) + radius)) + radius


def _pairs(t: Texts) -> np.ndarray:
    """A hash of each word and the next."""
    h = t.word_hash
    return mix(h + mix(np.append(h[1:], U(0)))) if len(h) else h


def runs(t: Texts, places: np.ndarray, words: np.ndarray | None = None) -> dict[str, np.ndarray]:
    """Runs of SEED words, or of as many as `words` says, that begin at some words: the text, first word, number of words, start and end in code points, a hash."""
    size = np.full(len(places), SEED) if words is None else words
    whole = size.astype(U)
    for j in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > j) if words is not None else slice(None)
        whole[on] = mix(whole[on] * U(3) + t.word_hash[places[on] + j])
    doc = t.doc[places]
    first = t.chars[t.offsets[doc]] if len(places) else places
    return {"doc": doc, "place": places - t.word_at[doc], "words": size, "start": t.chars[t.starts[places]] - first, "end": t.chars[t.ends[places + size - 1]] - first, "hash": whole}


def _fits(t: Texts) -> np.ndarray:
    """The words that begin a run of SEED words of their text."""
    return np.flatnonzero(np.arange(len(t.doc)) + SEED <= t.word_at[t.doc + 1])


def paragraphs(column: pa.Array) -> dict[str, np.ndarray]:
    """Seeds of some texts, as runs(), with 31 bits of what stands before and after each (the next seed and its distance,
    or the words up to the text's edge), and whether it is the first of its kind in its text."""
    t = Texts(column, lower=True)
    fits = _fits(t)
    chosen = fits[least_places(_pairs(t)[fits], t.doc[fits], SPREAD)]
    out = runs(t, chosen)
    n = len(chosen)
    if not n:
        return out | {"before": np.empty(0, np.int32), "after": np.empty(0, np.int32), "first": np.empty(0, np.int32)}
    begins = np.flatnonzero(np.concatenate([[True], out["doc"][1:] != out["doc"][:-1]]))
    stops = np.append(begins[1:], n) - 1
    head = runs(t, t.word_at[out["doc"][begins]], out["place"][begins] + SEED)
    tail = runs(t, chosen[stops], t.word_at[out["doc"][stops] + 1] - chosen[stops])
    near = np.flatnonzero(out["doc"][1:] == out["doc"][:-1])
    far = (chosen[near + 1] - chosen[near]).astype(U)
    before, after = np.zeros(n, U), np.zeros(n, U)
    before[near + 1], after[near] = mix(out["hash"][near] + far), mix(out["hash"][near + 1] + far)
    before[begins], after[stops] = mix(head["hash"]), mix(tail["hash"])
    out["before"], out["after"] = ((x >> U(33)).astype(np.int32) for x in (before, after))
    for edge, longer in ((head, head["words"] > SEED), (tail, tail["words"] > SEED)):  # no ends are looked for at these
        k = int(longer.sum())
        out = {c: np.concatenate([out[c], edge[c][longer] if c in edge else np.full(k, -1, np.int32)]) for c in out}
    order = np.lexsort((out["hash"], out["doc"]))
    first = np.concatenate([[True], (out["doc"][order][1:] != out["doc"][order][:-1]) | (out["hash"][order][1:] != out["hash"][order][:-1])])
    out["first"] = np.empty(len(order), np.int32)
    out["first"][order] = first
    return out


def ends(column: pa.Array, doc: np.ndarray, place: np.ndarray, side: np.ndarray) -> dict[str, np.ndarray]:
    """The runs, as runs(), up to SPREAD - 1 places before (side < 0) or after (side > 0) some words of some texts."""
    t = Texts(column, lower=True)
    inside = place < t.n_words[doc]
    at = (t.word_at[doc] + place)[inside, None] + side[inside, None] * np.arange(1, SPREAD)
    mine = np.repeat(doc[inside], SPREAD - 1)
    at = at.reshape(-1)
    return runs(t, np.unique(at[(at >= t.word_at[mine]) & (at + SEED <= t.word_at[mine + 1])]))


def blocks(column: pa.Array) -> dict[str, np.ndarray]:
    """Paragraphs of LENGTH words or more: as runs(), also the number of words, BANDS values, shingle hashes and their edges."""
    t = Texts(column, lower=True)
    n = len(t.doc)
    begins = np.unique(np.concatenate([t.word_at[:-1][t.n_words > 0], cut_places(_pairs(t), t.doc, RADIUS)])).astype(np.int64)
    stops = np.append(begins[1:], n)
    long = stops - begins >= LENGTH
    begins, stops = begins[long], stops[long]
    doc = t.doc[begins]
    k = len(begins)
    if not k:
        none = np.empty(0, np.int64)
        return {"doc": none, "place": none, "words": none, "start": none, "end": none, "hash": none.astype(U), "bands": np.empty((0, BANDS), U), "sets": np.empty(0, np.uint32), "edges": np.zeros(1, np.int64)}
    shingles = np.zeros(n - WIDTH + 1, U)
    for j in range(WIDTH):
        shingles = mix(shingles * U(3) + t.word_hash[j : n - WIDTH + 1 + j])
    size = stops - begins - WIDTH + 1
    edges = np.append(0, np.cumsum(size))
    block = np.repeat(np.arange(k), size)
    values = shingles[np.arange(edges[-1]) - edges[block] + begins[block]]
    low = [np.minimum.reduceat(values * f + (f >> U(7)), edges[:-1]) for f in _FACTORS]
    bands = []
    for b in range(BANDS):
        made = np.full(k, U(b + 1))
        for row in low[b * ROWS : (b + 1) * ROWS]:
            made = mix(made * U(3) + row)
        bands.append(made)
    # equal paragraphs have equal shingles in equal order
    chain = np.add.reduceat(mix(values + mix((np.arange(edges[-1]) - edges[block]).astype(U))), edges[:-1])
    first = t.chars[t.offsets[doc]]
    sets, own, _ = distinct_by_text((values >> U(32)).astype(np.uint32), block)
    per = np.bincount(own, minlength=k)
    return {
        "doc": doc, "place": begins - t.word_at[doc], "words": stops - begins, "start": t.chars[t.starts[begins]] - first, "end": t.chars[t.ends[stops - 1]] - first,
        "hash": mix(chain + size.astype(U)), "bands": np.stack(bands, axis=1), "sets": sets, "edges": np.append(0, np.cumsum(per)),
    }


def _named(df: DataFrame) -> DataFrame:
    return df.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").filter("doc_id is not null and text is not null")


_SPAN = "doc_id bigint, place int, words int, start int, end int, node bigint"
_NAMES = ["doc_id", "place", "words", "start", "end", "node"]


def _spans(ids: pa.Array, p: dict[str, np.ndarray]) -> list[pa.Array]:
    return [ids.take(pa.array(p["doc"])), *(pa.array(p[c], pa.int32()) for c in ("place", "words", "start", "end")), pa.array(p["hash"].view(np.int64))]


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Some rows at a time, with their texts."""
    for b in batches:
        column = common.texts_of(b.column(1))
        for low, high in common.steps(column):
            yield b.slice(low, high - low), column.slice(low, high - low)


def equal_texts(df: DataFrame) -> DataFrame:
    """(doc_id, key, words, start, end, keeper, n_docs) of every document whose text several have; a table."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, column in _parts(batches):
            t = Texts(column)
            some = t.n_words > 0
            at = t.word_at[:-1][some]
            first = t.chars[t.offsets[:-1][some]]
            start, end, words = np.zeros(t.n, np.int32), np.zeros(t.n, np.int32), t.n_words.astype(np.int32)
            start[some], end[some] = t.chars[t.starts[at]] - first, t.chars[t.ends[at + t.n_words[some] - 1]] - first
            keys = [hashlib.md5(x.as_buffer(), usedforsecurity=False).digest() for x in column]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(keys, pa.binary()), pa.array(words), pa.array(start), pa.array(end)], ["doc_id", "key", "words", "start", "end"])

    each = common.table(_named(df).mapInArrow(run, "doc_id bigint, key binary, words int, start int, end int"), "keys")
    several = each.groupBy("key").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("_last"), F.countDistinct("doc_id").alias("n_docs")).filter("keeper < _last").drop("_last")
    return common.table(each.join(common.table(several, "equal-keys"), "key"), "equal-texts")


def seeds(df: DataFrame) -> DataFrame:
    """A row for each seed of df (doc_id, text)."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, column in _parts(batches):
            p = paragraphs(column)
            yield pa.RecordBatch.from_arrays([*_spans(b.column(0), p), *(pa.array(p[c]) for c in ("before", "after", "first"))], [*_NAMES, "before", "after", "first"])

    return df.mapInArrow(run, f"{_SPAN}, before int, after int, first int")


def units(df: DataFrame, sets: bool) -> DataFrame:
    """A row for each paragraph of df (doc_id, text), with its bands or with its set."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, column in _parts(batches):
            p = blocks(column)
            n = len(p["doc"])
            if sets:
                raw, at = p["sets"].tobytes(), (p["edges"] * 4).tolist()
                more = pa.array([raw[at[k] : at[k + 1]] for k in range(n)], pa.binary())
            else:
                more = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * BANDS, pa.int32()), pa.array(p["bands"].reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([*_spans(b.column(0), p), more], [*_NAMES, "more"])

    return df.mapInArrow(run, f"{_SPAN}, more {'binary' if sets else 'array<bigint>'}")


def around(df: DataFrame, at: DataFrame) -> DataFrame:
    """A row for each run near the ends `at` (doc_id, place, side) of df (doc_id, text)."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, column in _parts(batches):
            # a place is written as twice itself, and one more for what comes after it
            lists = b.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            doc = np.repeat(np.arange(len(column)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays(_spans(b.column(0), ends(column, doc, flat >> 1, (flat & 1) * 2 - 1)), _NAMES)

    lists = at.select("doc_id", (F.col("place") * 2 + F.when(F.col("side") > 0, 1).otherwise(0)).alias("at")).groupBy("doc_id").agg(F.collect_list("at").alias("at"))
    return df.join(lists, "doc_id").select("doc_id", "text", "at").mapInArrow(run, _SPAN)


def exact(texts: DataFrame, broadcast_rows: int) -> DataFrame:
    """The runs that lie in two documents or more: _NAMES, n_docs, and whether the document is not the least that has it."""
    rows = seeds(texts)
    twice = rows.groupBy("node").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("_last"), F.sum("first").cast("int").alias("n_docs")).filter("keeper < _last").drop("_last")
    twice = common.table(twice, "repeated-seeds")  # grows with the corpus, and is joined alike at every size
    again = rows.join(twice, "node").withColumn("removed", F.col("doc_id") != F.col("keeper"))  # the seeds come from the texts again
    again = common.table(again.drop("keeper", "first"), "seeds")
    common.sweep(texts.sparkSession)

    inner = again.filter("before <> -1 or after <> -1")
    sides = inner.groupBy("node").agg(*(f(c).alias(f"{k}_{c}") for c in ("before", "after") for k, f in (("lo", F.min), ("hi", F.max))))
    at = None
    for c, side in (("before", -1), ("after", 1)):
        open_ = common.maybe_broadcast(common.table(sides.filter(f"lo_{c} < hi_{c}").select("node"), "open-seeds"), broadcast_rows)
        ways = inner.select("node", c, "doc_id", "place").join(open_, "node").groupBy("node", c).agg(F.min(F.struct("doc_id", "place")).alias("m"))
        found = ways.select("m.doc_id", "m.place", F.lit(side).alias("side"))
        at = found if at is None else at.union(found)
    at = common.table(at.distinct(), "ends")
    near = common.table(around(texts, at), "runs-at-ends")
    both = near.groupBy("node").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("_last"), F.lit(2).alias("n_docs")).filter("keeper < _last").drop("_last")
    both = common.maybe_broadcast(common.table(both, "repeated-runs"), broadcast_rows)
    near = near.join(both, "node").withColumn("removed", F.col("doc_id") != F.col("keeper"))
    names = [*_NAMES, "n_docs", "removed"]
    return again.select(*names).union(near.select(*names))


def merged(spans: DataFrame) -> DataFrame:
    """Spans of one text that overlap and share their fate as one: doc_id, removed, place, words, start, end, node, n_docs."""
    mine = W.partitionBy("doc_id", "removed").orderBy("place", "stop", "node")
    reach = F.max("stop").over(mine.rowsBetween(W.unboundedPreceding, -1))
    isle = spans.withColumn("stop", F.col("place") + F.col("words")).withColumn("_new", F.when(reach >= F.col("place"), 0).otherwise(1)).withColumn("_isle", F.sum("_new").over(mine))
    return isle.groupBy("doc_id", "removed", "_isle").agg(
        F.min("place").alias("place"), (F.max("stop") - F.min("place")).alias("words"), F.min("start").alias("start"), F.max("end").alias("end"), F.min("node").alias("node"), F.max("n_docs").alias("n_docs")
    ).drop("_isle")


def alike(texts: DataFrame, threshold: float, broadcast_rows: int) -> DataFrame:
    """The paragraphs that are similar to another one; node is the least of their cluster."""
    rows = common.table(units(texts, sets=False), "paragraphs")
    # bands that different paragraphs share, by the least and the greatest of them
    spread = rows.select("node", F.explode("more").alias("band"))
    short = F.col("node").bitwiseAND(F.lit(0x7FFFFFFF)).cast("int")  # the low half tells nodes of a band apart well enough, in half the room
    often = spread.groupBy("band").agg(F.min(short).alias("lo"), F.max(short).alias("hi")).filter("lo < hi").select("band")
    often = common.maybe_broadcast(common.table(often, "shared-bands"), broadcast_rows)
    bands = common.table(spread.join(often, "band").distinct(), "bands")
    # a paragraph's set comes from the text again, from one of its places: all sets would take more room than the texts
    nodes = common.maybe_broadcast(common.table(bands.select("node").distinct(), "colliding"), broadcast_rows)
    one = rows.select("node", "doc_id", "place").join(nodes, "node").groupBy("node").agg(F.min(F.struct("doc_id", "place")).alias("m"))
    one = common.maybe_broadcast(common.table(one.select("node", "m.doc_id", "m.place"), "set-places"), broadcast_rows)
    sets = common.table(units(texts, sets=True).join(one, ["node", "doc_id", "place"], "left_semi").select("node", F.col("more").alias("set")), "sets")
    common.sweep(texts.sparkSession)
    comps, _ = similar_groups(bands, sets, threshold)
    return rows.join(comps, "node").drop("node").withColumnRenamed("comp", "node").select(*_NAMES)


def joined(paras: DataFrame, same: DataFrame, width: int = 64) -> DataFrame:
    """paras, each from where the first of the spans `same` lies in it to where the last does; those that have none fall away."""
    stop = F.col("place") + F.col("words")
    slot = lambda c: F.floor(c / width).cast("int")
    slots = lambda: F.explode(F.sequence(slot(F.col("place")), slot(stop - 1))).alias("slot")
    p = paras.select("doc_id", F.col("node").alias("n"), F.col("place").alias("p"), stop.alias("q"), F.col("start").alias("s"), F.col("end").alias("e"), slots())
    x = same.select("doc_id", "place", stop.alias("stop"), "start", "end", slots())
    found = x.join(p, ["doc_id", "slot"]).filter("place < q and stop > p").groupBy("doc_id", "n", "p")
    hull = found.agg(F.min(F.greatest("place", "p")).alias("place"), F.max(F.least("stop", "q")).alias("stop"), F.min(F.greatest("start", "s")).alias("start"), F.max(F.least("end", "e")).alias("end"))
    return hull.select("doc_id", "place", (F.col("stop") - F.col("place")).alias("words"), "start", "end", F.col("n").alias("node"))


def repeats(df: DataFrame, threshold: float = 0.8, broadcast_rows: int = 1_000_000) -> DataFrame:
    """(doc_id, start, end, cluster_id, n_docs, removed) of every repeated passage of df (doc_id, text).

    start and end are code points, end exclusive; n_docs the most documents that a cluster of the span lies in,
    equal texts counted once unless the span is a whole text that several have.
    """
    equal = equal_texts(df)
    copies = equal.filter("doc_id <> keeper").select("doc_id", "key").distinct()
    texts = _named(df)
    if not copies.isEmpty():
        few = common.maybe_broadcast(copies.withColumnRenamed("doc_id", "_id"), broadcast_rows)
        texts = texts.join(few, (F.col("doc_id") == F.col("_id")) & (F.unhex(F.md5("text")) == F.col("key")), "left_anti")
        if not common.small_enough(copies, broadcast_rows):
            texts = common.table(texts, "different-texts")
    same = common.table(merged(exact(texts, broadcast_rows)), "repeated-passages")
    common.sweep(df.sparkSession)
    near = common.table(joined(alike(texts, threshold, broadcast_rows), same), "alike-passages")
    clusters = near.select("node", "doc_id").distinct().groupBy("node").agg(F.count("*").cast("int").alias("n_docs"), F.min("doc_id").alias("keeper")).filter("n_docs > 1")
    near = near.join(common.maybe_broadcast(common.table(clusters, "clusters"), broadcast_rows), "node").filter("doc_id <> keeper").withColumn("removed", F.lit(True))  # the runs tell what stays
    names = ["doc_id", "removed", "place", "words", "start", "end", "node", "n_docs"]
    found = merged(same.select(*names).union(near.select(*names))).select(*names)
    hashed = F.xxhash64("key")
    whole = equal.distinct().select("doc_id", (F.col("doc_id") != F.col("keeper")).alias("removed"), F.lit(0).alias("place"), "words", "start", "end", hashed.alias("node"), F.col("n_docs").cast("int").alias("n_docs"))
    return found.union(whole).filter(F.col("words") >= LENGTH).select("doc_id", F.col("start").cast("bigint").alias("start"), F.col("end").cast("bigint").alias("end"), F.col("node").alias("cluster_id"), F.col("n_docs").cast("bigint").alias("n_docs"), "removed")

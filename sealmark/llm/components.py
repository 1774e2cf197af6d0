"""Connected components of links between 64-bit ids, and groups of similar sets found by bands.

Nothing here gathers a group, a component or all links in one task: every step is a join or a
partially aggregated group-by on keys, and each round's result is a table in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common

#: Parts, by hash, that the last pairs are dealt into.
PARTS = 32


def joined_up(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids in links a, b, and the least id of the component of each."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    up = np.arange(len(ids))
    while True:
        low = np.minimum(up[x], up[y])
        if (up[x] == up[y]).all():
            return ids, ids[up]
        np.minimum.at(up, up[x], low)
        np.minimum.at(up, up[y], low)
        while (up[up] != up).any():
            up = up[up]


def components(links: DataFrame, one_task: int = 500_000) -> DataFrame:
    """(node, comp) for every id in links (a, b); comp is the least id of the component.

    Up to `one_task` links, by a count, one task joins them up. More go by contraction: each node hooks to
    its neighbour with the most links (ties by a hash that changes with the round), or to itself; then links
    are rewritten to the nodes hooked to. That order has no cycles. A star is gone after one round; in general each round removes a fixed share of the nodes.
    """
    spark = links.sparkSession
    edges = common.table(links.filter("a <> b").select("a", "b").distinct(), "links")
    if common.small_enough(edges, one_task):

        @common.lean
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
            if parts:
                node, comp = joined_up(*map(np.concatenate, zip(*parts, strict=True)))
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(comp)], ["node", "comp"])

        return common.table(edges.coalesce(1).mapInArrow(run, "node bigint, comp bigint"), "components")
    names: DataFrame | None = None
    turn = 0
    while not edges.isEmpty():
        turn += 1
        both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = F.struct(F.col("n"), F.xxhash64("a", F.lit(turn)).alias("h"), F.col("a").alias("id"))
        ranked = both.groupBy("a").agg(F.count("*").alias("n")).select("a", rank.alias("r"))
        best = both.join(ranked.select(F.col("a").alias("b"), "r"), "b").groupBy("a").agg(F.max("r").alias("m"))
        hook = ranked.join(best, "a").select(F.col("a").alias("node"), F.greatest("r", "m")["id"].alias("to"))
        hook = common.table(hook, "hooks")
        ha, hb = hook.toDF("a", "ta"), hook.toDF("b", "tb")
        next_edges = edges.join(ha, "a").join(hb, "b").filter("ta <> tb")
        next_edges = next_edges.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).distinct()
        next_edges = common.table(next_edges, "links")
        if names is None:
            names = hook.select("node", F.col("to").alias("comp"))
        else:
            moved = names.join(hook.select(F.col("node").alias("comp"), "to"), "comp", "left")
            names = common.table(moved.select("node", F.coalesce("to", "comp").alias("comp")), "names")
        edges = next_edges
    if names is None:
        return spark.createDataFrame([], "node bigint, comp bigint")
    least = names.groupBy("comp").agg(F.min("node").alias("least"))
    return common.table(names.join(least, "comp").select("node", F.col("least").alias("comp")), "components")


def jaccard(a: bytes, b: bytes) -> float:
    """Of two sets, written as ascending unsigned 32-bit integers."""
    x, y = np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32)
    if not len(x) or not len(y):
        return 0.0
    both = np.concatenate([x, y])
    both.sort(kind="stable")
    n = int(np.count_nonzero(both[1:] == both[:-1]))
    return n / (len(x) + len(y) - n)


def similar(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Those of pairs (a, b) whose sets (node, set) have a Jaccard similarity of threshold at least."""
    left, right = sets.toDF("a", "sa"), sets.toDF("b", "sb")

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = pa.array([jaccard(p.as_buffer(), q.as_buffer()) >= threshold - 1e-9 for p, q in zip(x.column(2), x.column(3), strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([x.column(0), x.column(1)], ["a", "b"]).filter(ok)

    return pairs.join(left, "a").join(right, "b").select("a", "b", "sa", "sb").mapInArrow(run, "a bigint, b bigint")


def elements(nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """(node, x): a row for each element of the nodes' sets."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = [np.frombuffer(x.as_buffer(), np.uint32) for x in b.column(1)]
            size = [len(x) for x in parts]
            if sum(size):
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), size)), pa.array(np.concatenate(parts).view(np.int32))], ["node", "x"])

    return sets.join(nodes, "node", "left_semi").select("node", "set").mapInArrow(run, "node bigint, x int")


def rare_pairs(rows: DataFrame, sets: DataFrame, threshold: float, rare: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs (a, b) of different components, nodes that need no other pairs, sizes), by a prefix filter.

    sizes has (node, n, shareable): a set's elements, and how many of them another set has.

    rows has (node, band, comp). Sets of n and k elements with a similarity of t share t / (1 + t) (n + k)
    elements or more; so, with k the least size in a node's bands, a set of n that shares q may miss
    n - q, and similar sets have a common element among their first n - q + 1, whatever the order.
    Ordered by how many sets have them, these are often few enough: a node is done if all of its first
    elements are in `rare` sets at most, since then few other sets can be similar and they are found by
    these elements.
    """
    n = (F.octet_length("set") / 4).cast("bigint").alias("n")
    nodes = rows.select("node").distinct()
    sized = sets.join(nodes, "node", "left_semi").select("node", n)
    least = rows.join(sized, "node").groupBy("band").agg(F.min("n").alias("k"))
    need = met(rows, least, "least-sizes").groupBy("node", "comp").agg(F.min("k").alias("k")).join(sized, "node")
    shared = F.ceil(F.lit(threshold / (1 + threshold)) * (F.col("n") + F.greatest(F.col("k"), F.ceil(threshold * F.col("n") - 1e-9))) - 1e-9)
    need = common.table(need.select("node", "comp", "n", (F.col("n") - shared + 1).alias("p")), "prefixes")

    held = common.table(elements(nodes, sets), "elements")
    counts = held.groupBy("x").agg(F.count("*").alias("k"), F.min("node").alias("only")).filter(F.col("k") <= rare)
    counts = common.table(counts, "rare-elements")
    alone = counts.filter("k = 1").groupBy(F.col("only").alias("node")).agg(F.count("*").alias("u"))
    some = held.join(counts.filter("k > 1").select("x", "k"), "x")
    place = F.row_number().over(W.partitionBy("node").orderBy("k", "x"))
    placed = some.withColumn("r", place).join(need, "node").join(alone, "node", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    first = common.table(placed.filter("u + r <= p").select("node", "x", "comp"), "first-elements")
    several = some.groupBy("node").agg(F.count("*").alias("s"))
    done = need.join(alone, "node", "left").join(several, "node", "left").filter(F.coalesce("u", F.lit(0)) + F.coalesce("s", F.lit(0)) >= F.col("p")).select("node")
    done = common.table(done, "done")
    marked = first.join(done.withColumn("hard", F.lit(True)), "node", "left")
    a, b = (marked.select("x", F.col("node").alias(k), F.col("comp").alias("c" + k), F.col("hard").alias("h" + k)) for k in "ab")
    pairs = a.join(b.withColumnRenamed("x", "y"), (F.col("x") == F.col("y")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & (F.col("ha").isNotNull() | F.col("hb").isNotNull()))
    sizes = need.join(alone, "node", "left").select("node", "n", (F.col("n") - F.coalesce("u", F.lit(0))).alias("shareable"))
    return pairs.select("a", "b"), done, sizes


def met(rows: DataFrame, keyed: DataFrame, name: str, most: int = 300_000) -> DataFrame:
    """rows (node, band, ..) with what keyed has for their band, one row each.

    keyed is sent to all tasks if it is small. Else it comes from a table of its own, not from an aggregate of the
    same exchange, so that a hot band's rows are split over tasks (adaptive skew joins).
    """
    return rows.join(common.maybe_broadcast(common.table(keyed, name), most), "band")


def similar_groups(bands: DataFrame, sets: DataFrame | Callable[[DataFrame], DataFrame], threshold: float, stars: int = 3, pairs_per_row: int = 4, rare: int = 16, broadcast_rows: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """((node, comp) of nodes with a link, the links found) for nodes that share a band.

    bands has (node, band), one row for each; sets has (node, set), or gives it for the (node) that it is called
    with, those that share a band with another. Two nodes are linked if they share
    a band and their sets are similar. Pairs within a band are not all written out. A band's leader is
    its member that collides most. First each node is compared with one leader, the one of its bands'
    leaders that collides most. A band whose members are in one component then needs nothing more:
    further links could not change the components. In the other bands, nodes with enough rare elements
    are compared with those that share these (rare_pairs) and are done. Of the others, members are
    compared with leaders of other components, and a leader that all were compared with leaves; once
    few pairs are left (or after `stars` rounds) those pairs between different components are whose sets
    have enough elements that any other set has: a thirty-second of them first, then an eighth, then the rest.
    Shuffle files and tables of steps that are over are freed between the steps.
    """
    spark = bands.sparkSession
    sizes = bands.groupBy("band").agg(F.count("*").alias("size")).filter("size > 1")
    shared = common.table(met(bands, sizes, "band-sizes"), "shared-bands")
    weight = shared.groupBy("node").agg(F.sum("size").alias("w"))
    rows = common.table(shared.select("node", "band").join(weight, "node"), "band-rows")
    common.drop_table(shared)
    common.sweep(spark)
    colliding = common.maybe_broadcast(rows.select("node").distinct(), broadcast_rows)
    sets = sets(colliding) if callable(sets) else sets.join(colliding, "node")
    sets = common.table(sets.groupBy("node").agg(F.min("set").alias("set")), "sets")
    common.sweep(spark)

    def checked(pairs: DataFrame, tried: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = common.table(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        return common.table(similar(pairs, sets, threshold), "similar"), pairs if tried is None else tried.union(pairs)

    def several(left: DataFrame) -> DataFrame:
        many = left.groupBy("band").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("band")
        return met(left, many, "many").select("node", "band", "w", "comp")

    def mixed(left: DataFrame, comps: DataFrame) -> DataFrame:
        """The rows of bands with different components, with each member's component."""
        left = left.select("node", "band", "w").join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
        return common.table(several(left), "mixed-bands")

    leader = rows.groupBy("band").agg(F.max(F.struct("w", "node")).alias("l"))
    pick = met(rows, leader, "leaders").filter(F.col("node") != F.col("l.node")).groupBy("node").agg(F.max("l")["node"].alias("to"))
    links, tried = checked(pick.select(F.col("node").alias("a"), F.col("to").alias("b")), None)
    common.sweep(spark)
    comps = components(links)
    rows = mixed(rows, comps)
    common.sweep(spark)
    if rows.isEmpty():
        return comps, links
    pairs, done, sizes = rare_pairs(rows, sets, threshold, rare)
    new, tried = checked(pairs, tried)
    links = links.union(new)
    rows = common.table(several(rows.join(done, "node", "left_anti")), "mixed-bands")
    common.sweep(spark)
    for _ in range(stars):
        per = rows.groupBy("band", "comp").agg(F.count("*").alias("n")).groupBy("band").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("same"))
        left, size = per.agg(F.sum(F.expr("n * n - same")) / 2, F.sum("n")).first()
        if not size or left <= pairs_per_row * size:
            break
        leader = rows.groupBy("band").agg(F.max(F.struct("w", "node", "comp")).alias("l"))
        led = met(rows, leader, "leaders").select("node", "band", "w", "comp", F.col("l.node").alias("to"), F.col("l.comp").alias("to_comp"))
        new, tried = checked(led.filter("comp <> to_comp").select(F.col("node").alias("a"), F.col("to").alias("b")), tried)
        links = links.union(new)
        rows = mixed(led.filter("node <> to"), components(links))
    # a few of the pairs first: what they link leaves fewer pairs of different components to the next part
    for low, high in ((0, 1), (1, 4), (4, PARTS)):
        if rows.isEmpty():
            break
        # a pair is made in the first band that it shares, once, and only if what both may share is enough
        own = rows.groupBy("node").agg(F.collect_set("band").alias("all"))
        full = common.table(rows.select("band", "node", "comp").join(own, "node").join(sizes, "node"), "last-bands")
        a, b = (full.select(F.col("band").alias("band" + k), F.col("node").alias(k), F.col("comp").alias("c" + k), F.col("all").alias("all" + k), F.col("n").alias("n" + k), F.col("shareable").alias("s" + k)) for k in "ab")
        first = F.array_min(F.array_intersect("alla", "allb")) == F.col("banda")
        enough = F.least("sa", "sb") >= threshold / (1 + threshold) * (F.col("na") + F.col("nb")) - 1e-9
        part = F.pmod(F.xxhash64("a", "b"), F.lit(PARTS)).between(low, high - 1)
        pairs = a.join(b, (F.col("banda") == F.col("bandb")) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb")) & part & enough & first)
        new, tried = checked(pairs.select("a", "b"), tried)
        links = links.union(new)
        common.sweep(spark)
        if high < PARTS:
            rows = mixed(rows, components(links))
    return components(links), links

"""Language-model scores: a log-bilinear model over words, trained by noise-contrastive estimation.

Tokens are words (A-Z lowered), then one end per text. Counts of all training tokens are exact, by the
word's 64-bit hash. The base score is the add-half unigram model.

The model: the most frequent words (HEADS at most, seen LEAST times or more) and the end are units with
vectors of their own. Each word also has a class by its last letters, and the words of a class that are no
heads share a unit, its tail. With the units a and b of the two tokens before,

    P(token | a, b) = P(class | a, b) P(unit | class, b) P(token | unit).

The first two factors are log-bilinear: the sum of the context vectors, each scaled by its place, times the
target's vector, plus a bias, normalised over all classes, or over the units of the class, by batched matrix
products. The third shares a tail among its words by their counts less a discount, and what the discounts leave
is the probability of a word that training has not seen (one share for all of those). All are normalised.

Training covers all training texts, ROUNDS times at every size. These are written as unit numbers, dealt into shards
by a hash of the text and its id, and trained on in ROUNDS synchronised rounds: in a round each shard begins
with the same vectors and goes through its tokens in steps of stochastic gradients, classes against NOISE classes drawn
from their frequencies and units against UNIT_NOISE units of other tokens of the class; each vector then becomes the
average of the shards, weighted by how often they changed it. Only the number of shards grows with the input. Order,
random numbers and sums depend on the shards only, so the result does not depend on partitions.

Scoring: words above 1/HOT of all tokens (so HOT at most) are sent to every task with their counts. The other
words of a text leave as hashes, once for each text, meet their counts by hash, and come back as sums for each text;
no text is shuffled. Null and empty texts have only the end. Without training texts every class is as likely as another.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .lang_id import fold
from .words import Texts, mix

U = np.uint64
#: Classes by word ending, and the end's.
CLASSES = 128
END_CLASS = CLASSES - 1
HEADS, LEAST = 20_000, 3
HOT = 1_000_000
DIM, UNIT_DIM, NOISE, UNIT_NOISE, STEP = 16, 8, 24, 4, 8192
ROUNDS, SHARD_TOKENS, BUFFER = 5, 1_000_000, 1 << 18
#: Blocks of vectors that are averaged apart, and shards whose sums one task adds.
BLOCKS, FAN = 16, 32
LOG10 = float(np.log(10))


def classes_of(t: Texts) -> np.ndarray:
    """The class of each word, by its last bytes without closing punctuation."""
    ends = t.ends.copy()
    mark = np.zeros(256, bool)
    mark[[ord(c) for c in ".,;:!?\"')]}#*%&$|"]] = True
    for _ in range(3):
        ends -= (ends - t.starts > 1) & mark[t.bytes[ends - 1]]
    closed = ends < t.ends
    h = t.slice_hash(np.maximum(t.starts, ends - 3), ends)
    return ((mix(h + closed.astype(U)) >> U(20)) % U(END_CLASS)).astype(np.int64)


class Words:
    """Tokens of some texts: hashes and classes of the words, text by text."""

    def __init__(self, column: pa.Array):
        self.texts = t = Texts(column, lower=True)
        self.hash = t.word_hash.view(np.int64)
        self.kind = classes_of(t) if len(self.hash) else np.empty(0, np.int64)

    @functools.cached_property
    def order(self) -> np.ndarray:
        return np.argsort(self.hash)

    def found(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The words whose hash is one of the ascending keys, and the places of these keys; looked up in order, which stays in cache."""
        h = self.hash[self.order]
        at = np.searchsorted(keys, h)
        known = np.flatnonzero(keys[np.minimum(at, len(keys) - 1)] == h) if len(keys) else np.empty(0, np.int64)
        return self.order[known], at[known]


@dataclass
class Vocabulary:
    """Units: those of a class stand together, its tail first, then its heads; the end is the last."""

    heads: np.ndarray  # hashes, ascending
    head_unit: np.ndarray
    start: np.ndarray  # first unit of each class, and the number of units
    unit_class: np.ndarray
    count: np.ndarray  # training tokens of each unit, one half more
    end: int = field(init=False)

    def __post_init__(self):
        self.end = len(self.unit_class) - 1

    @staticmethod
    def of(h: np.ndarray, c: np.ndarray, kind: np.ndarray, tails: np.ndarray, ends: int) -> Vocabulary:
        """Of heads (hash, count, class), the tails' tokens by class, and the number of ends."""
        order = np.lexsort((h, -c, kind))
        h, c, kind = h[order], c[order], kind[order]
        per = np.bincount(kind, minlength=CLASSES)
        start = np.append(0, np.cumsum(per + 1))
        unit = start[kind] + 1 + np.arange(len(h)) - np.searchsorted(kind, kind)
        unit_class = np.repeat(np.arange(CLASSES), per + 1)
        count = np.zeros(len(unit_class))
        count[start[:-1]] = tails
        count[unit] = c
        count[start[END_CLASS]] = ends
        by = np.argsort(h)
        return Vocabulary(h[by], unit[by], start, unit_class, count + 0.5)

    def units(self, w: Words) -> tuple[np.ndarray, np.ndarray]:
        """The units of all tokens with the ends, and the places of the words among them."""
        t = w.texts
        unit = self.start[w.kind]
        known, at = w.found(self.heads)
        unit[known] = self.head_unit[at]
        out = np.full(int((t.n_words + 1).sum()), self.end)
        where = np.arange(len(unit)) + t.doc
        out[where] = unit
        return out, where

    def before(self, units: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The unit two places before each token, and the one before; ends stand before a text."""
        one = np.concatenate([[self.end], units[:-1]])
        two = np.concatenate([[self.end, self.end], units[:-2]])[: len(units)]
        two[one == self.end] = self.end
        return two, one


def start_vectors(v: Vocabulary) -> dict[str, np.ndarray]:
    """context, target and bias of classes, then of units; place scales the two contexts."""
    n = len(v.unit_class)
    r = np.random.default_rng(11)
    by_class = np.add.reduceat(v.count, v.start[:-1])
    p = {
        "context": r.normal(0, 0.3, (n, DIM)), "unit_context": r.normal(0, 0.3, (n, UNIT_DIM)), "unit_target": np.zeros((n, UNIT_DIM)), "unit_bias": np.log(v.count / by_class[v.unit_class])[:, None],
        "target": np.zeros((CLASSES, DIM)), "bias": np.log(by_class / by_class.sum())[:, None], "place": np.ones((2, DIM)),
    }
    return {k: x.astype(np.float32) for k, x in p.items()}


def _below(x: np.ndarray) -> None:
    """x becomes -sigmoid(-x)."""
    with np.errstate(over="ignore"):  # -1 / inf is right
        np.exp(x, out=x)
    x += 1
    np.divide(-1, x, out=x)


def _among(n: int, *index: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """Those below n that occur, ascending, and the places of all indices among them."""
    seen = np.zeros(n, bool)
    for x in index:
        seen[x] = True
    held = np.flatnonzero(seen)
    place = np.empty(n, np.int64)
    place[held] = np.arange(len(held))
    return held, [place.take(x) for x in index]


def _sums(index: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """The sums of the rows by index (below n); numbers are added in pairs, as complex ones."""
    out = np.zeros((n, rows.shape[1]), np.float32)
    for total, x in zip(out.view(np.complex64).T, rows.view(np.complex64).T, strict=True):
        np.add.at(total, index, x)
    return out


def _dots(x: np.ndarray) -> np.ndarray:
    """The sums along the last axis, which is short, by a matrix product."""
    return x @ np.ones(x.shape[-1], np.float32)


def _wide(x: np.ndarray, columns: int) -> np.ndarray:
    """So many columns of x, as an array of its own: numpy is slow to spread numbers over short rows."""
    return np.repeat(x, columns).reshape(-1, columns)


class Trainer:
    """Vectors in training, with the sums of squares of each row's gradients (AdaGrad by rows) and the number of changes.

    A step gathers the rows that it needs once, and works on these few: rows move as a whole, and what is multiplied
    and added up are whole blocks of them.
    """

    def __init__(self, v: Vocabulary, p: dict[str, np.ndarray], square: dict[str, np.ndarray], seed: tuple[int, int], rate: float = 0.1):
        self.v, self.rate = v, rate
        self.p = {k: x.copy() for k, x in p.items()}
        self.square = {k: x.copy() for k, x in square.items()}
        self.changes = {k: np.zeros(len(x), np.float32) for k, x in p.items()}
        self.rng = np.random.default_rng(seed)
        by_class = np.add.reduceat(v.count, v.start[:-1])
        self.class_sum = np.cumsum(by_class)
        self.class_known = (np.log(by_class / by_class.sum()) + np.log(NOISE)).astype(np.float32)
        self.unit_known = (np.log(v.count / by_class[v.unit_class]) + np.log(UNIT_NOISE)).astype(np.float32)
        self.several = np.diff(v.start)[v.unit_class] > 1

    def _move(self, part: str, at: np.ndarray, n: np.ndarray, g: np.ndarray, old: np.ndarray | None = None) -> None:
        """Moves the vectors at different places, old if these are at hand, by the gradients g, which n tokens gave."""
        square = self.square[part].take(at) + _dots(g * g) / np.float32(g.shape[1])
        self.square[part][at] = square
        rate = self.rate / (np.float32(1e-3) + np.sqrt(square))
        by = _wide(rate, g.shape[1])
        by *= g
        by += self.p[part].take(at, axis=0) if old is None else old
        self.p[part][at] = by
        self.changes[part][at] += n

    def step(self, two: np.ndarray, one: np.ndarray, unit: np.ndarray) -> None:
        """One step of noise-contrastive estimation for tokens by class, in random order within it; noise classes are drawn once for them, noise units for each."""
        p, v = self.p, self.v
        size = np.bincount(v.unit_class.take(unit), minlength=CLASSES)
        first = np.cumsum(size) - size
        held, (one, two) = _among(len(v.unit_class), one, two)
        times = np.bincount(one, minlength=len(held)), np.bincount(two, minlength=len(held))
        context = p["context"].take(held, axis=0, mode="clip")
        place = [np.repeat(x[None], len(held), axis=0) for x in p["place"]]
        hidden = (context * place[0]).take(one, axis=0, mode="clip")
        hidden += (context * place[1]).take(two, axis=0, mode="clip")
        drawn = np.minimum(np.searchsorted(self.class_sum, self.rng.random(NOISE) * self.class_sum[-1], "right"), CLASSES - 1)
        own, other = np.repeat(p["target"], size, axis=0), p["target"][drawn]
        level = p["bias"][:, 0] - self.class_known
        up = _dots(hidden * own) + np.repeat(level, size)
        np.negative(up, out=up)
        _below(up)
        up += 1  # 1 - sigmoid
        down = hidden @ -other.T
        together = math.gcd(len(down), 64)  # rows, so that loops are long
        down.reshape(-1, together * NOISE)[:] -= np.tile(level[drawn], together)
        _below(down)
        wide = _wide(up, DIM)
        own *= wide
        own += down @ other
        wide *= hidden
        d_hidden, kinds = own, np.flatnonzero(size)
        g, g_bias = np.zeros((CLASSES, DIM), np.float32), np.zeros((CLASSES, 1), np.float32)
        g[kinds] = np.add.reduceat(wide.view(np.complex64), first[kinds], axis=0).view(np.float32)
        g_bias[kinds, 0] = np.add.reduceat(up, first[kinds])
        np.add.at(g, drawn, down.T @ hidden)
        np.add.at(g_bias[:, 0], drawn, np.ones(len(down), np.float32) @ down)
        all_times = size + np.bincount(drawn, minlength=CLASSES)
        at = np.flatnonzero(all_times)
        self._move("target", at, all_times[at], g[at])
        self._move("bias", at, all_times[at], g_bias[at])
        near, far = (_sums(x, d_hidden, len(held)) for x in (one, two))
        self._move("place", np.arange(2), 1, np.stack([np.ones(len(held), np.float32) @ (context * x) for x in (near, far)]))
        near *= place[0]
        far *= place[1]
        near += far
        self._move("context", held, times[0] + times[1], near, context)

        some = self.several.take(unit)
        if not some.all():
            some = np.flatnonzero(some)
            one, unit = one.take(some), unit.take(some)
            size = size * (np.diff(v.start) > 1)
            first = np.cumsum(size) - size
        if not len(unit):
            return
        # Units of other tokens of the class in this step come as often as in training. Those of a class stand together, in
        # random order: each takes the one so many places on, round the class, so that sums are gathered by the way back.
        # The token's own unit is the one no places on.
        held_units, (place,) = _among(len(v.unit_class), unit)
        n, here = len(unit), np.arange(len(unit))
        nth, room = here - np.repeat(first, size), np.repeat(size, size)
        far = np.zeros((1 + UNIT_NOISE, CLASSES), np.int64)
        far[1:] = self.rng.random((UNIT_NOISE, CLASSES)) * size
        far = np.repeat(far, size, axis=1)
        on, back = here + far, here - far
        on -= room * (far >= room - nth)
        back += room * (far > nth)
        back += np.arange(1 + UNIT_NOISE)[:, None] * n
        context, target = p["unit_context"].take(held, axis=0, mode="clip"), p["unit_target"].take(held_units, axis=0, mode="clip")
        x, t = context.take(one, axis=0, mode="clip"), target.take(place.take(on), axis=0, mode="clip")
        level = (self.unit_known - p["unit_bias"][:, 0]).take(held_units).take(place, mode="clip")
        e = level.take(on, mode="clip") - _dots((t * x).reshape(-1, UNIT_DIM)).reshape(on.shape)
        _below(e)
        e[0] += 1
        wide = _wide(e, UNIT_DIM).reshape(t.shape)
        t *= wide
        wide *= x
        g = wide.reshape(-1, UNIT_DIM).take(back, axis=0, mode="clip").sum(axis=0)
        times = (1 + UNIT_NOISE) * np.bincount(place, minlength=len(held_units))
        self._move("unit_target", held_units, times, _sums(place, g, len(held_units)), target)
        g_bias = np.bincount(place, e.take(back, mode="clip").sum(axis=0), len(held_units))
        self._move("unit_bias", held_units, times, g_bias.astype(np.float32)[:, None])
        self._move("unit_context", held, np.bincount(one, minlength=len(held)), _sums(one, t.sum(axis=0), len(held)), context)

    def learn(self, units: np.ndarray) -> None:
        """Goes through some texts' units, each text closed by its end, in random order."""
        two, one = self.v.before(units)
        tokens = self.rng.permutation(self.v.unit_class.take(units) << 48 | two << 32 | one << 16 | units)  # units are 16-bit integers
        for low in range(0, len(tokens), STEP):
            x = tokens[low : low + STEP]
            x = x.take(np.argsort((x >> 48).astype(np.uint8), kind="stable"))  # by radix
            self.step(x >> 32 & 0xFFFF, x >> 16 & 0xFFFF, x & 0xFFFF)


def no_squares(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    return {k: np.zeros(len(x), np.float32) for k, x in p.items()}


def class_parts(p: dict[str, np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For the unit one and two places before: (units, CLASSES) factors of the classes' weights, and the logarithms left out of each row."""
    out = []
    for k, bias in ((0, p["bias"][:, 0]), (1, np.float32(0))):
        s = (p["context"] * p["place"][k]) @ p["target"].T + bias
        most = s.max(axis=1)
        s -= most[:, None]
        out.append((np.exp(s, out=s), most))
    return out


def class_scores(p: dict[str, np.ndarray], two: np.ndarray, one: np.ndarray, kind: np.ndarray, parts: list[tuple[np.ndarray, np.ndarray]] | None = None) -> np.ndarray:
    """log P(class | two units before). A class's weight is a product of a factor for each, so only these need exponentials, once for all tokens."""
    (near, most_near), (far, most_far) = parts or class_parts(p)
    out = np.empty(len(kind), np.float32)
    context = [np.ascontiguousarray(p["context"] * x) for x in p["place"]]
    for low in range(0, len(kind), 512):  # what fits into a cache
        a, b, c = (x[low : low + 512] for x in (one, two, kind))
        hidden = context[0].take(a, axis=0) + context[1].take(b, axis=0)
        own = np.einsum("ij,ij->i", hidden, p["target"].take(c, axis=0)) + p["bias"][c, 0]
        whole = np.einsum("ij,ij->i", near.take(a, axis=0), far.take(b, axis=0))
        few = np.flatnonzero(whole < 1e-25)  # the factors are nowhere large at once: what is lost below the least float may count
        whole[few] = 1
        norm = np.log(whole) + most_near[a] + most_far[b]
        if len(few):
            s = hidden[few] @ p["target"].T + p["bias"][:, 0]
            most = s.max(axis=1)
            norm[few] = most + np.log(np.exp(s - most[:, None]).sum(axis=1))
        out[low : low + 512] = own - norm
    return out


def unit_norms(v: Vocabulary, p: dict[str, np.ndarray]) -> np.ndarray:
    """(units, CLASSES): the logarithm of the sum over a class's units, for each unit before, by matrix products."""
    n = len(v.unit_class)
    out = np.empty((n, CLASSES), np.float32)
    target, bias = np.ascontiguousarray(p["unit_target"].T), p["unit_bias"][:, 0]
    for low in range(0, n, 512):
        s = p["unit_context"][low : low + 512] @ target
        s += bias
        np.clip(s, -60, 60, out=s)
        np.exp(s, out=s)
        out[low : low + 512] = np.log(np.add.reduceat(s, v.start[:-1], axis=1))
    return out


def unit_scores(v: Vocabulary, p: dict[str, np.ndarray], norms: np.ndarray, one: np.ndarray, unit: np.ndarray) -> np.ndarray:
    """log P(unit | class, unit before)."""
    s = np.einsum("ij,ij->i", p["unit_context"][one], p["unit_target"][unit]) + p["unit_bias"][unit, 0]
    return np.clip(s, -60, 60) - norms[one, v.unit_class[unit]]


# --- training over a cluster ----------------------------------------------------------------------------


def _packed(v: Vocabulary, p: dict[str, np.ndarray], square: dict[str, np.ndarray], weight: dict[str, np.ndarray] | None) -> np.ndarray:
    """Each row of each part of the model: its weight, its weighted sum of squares and its weighted vector."""
    cells = []
    for k, x in p.items():
        w = np.ones(len(x), np.float32) if weight is None else weight[k]
        cells.append(np.concatenate([w[:, None], (square[k] * w)[:, None], x * w[:, None]], axis=1).reshape(-1))
    return np.concatenate(cells).astype(np.float32)


def _unpacked(flat: np.ndarray, p: dict[str, np.ndarray], square: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The averages of packed sums; rows that nothing has changed stay."""
    new_p, new_square, at = {}, {}, 0
    for k, x in p.items():
        rows = flat[at : at + len(x) * (x.shape[1] + 2)].reshape(len(x), -1)
        at += rows.size
        seen = rows[:, 0] > 0
        w = np.where(seen, rows[:, 0], 1)
        new_p[k] = np.where(seen[:, None], rows[:, 2:] / w[:, None], x).astype(np.float32)
        new_square[k] = np.where(seen, rows[:, 1] / w, square[k]).astype(np.float32)
    return new_p, new_square


def _added(table: pa.Table) -> np.ndarray:
    """The sum of the rows' payloads, in the order of the shards."""
    table = table.sort_by("shard")
    total = None
    for x in table["payload"]:
        one = np.frombuffer(x.as_buffer(), np.float32)
        total = one.astype(float) if total is None else total + one
    return total.astype(np.float32)


def encoded(docs: DataFrame, v: Vocabulary, shards: int) -> DataFrame:
    """(shard, key, units) of each row of docs (doc_id, text): unit numbers as packed 16-bit integers."""
    sent = docs.sparkSession.sparkContext.broadcast(v)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for b in batches:
            column = common.texts_of(b.column(1))
            for low, high in common.steps(column):
                w = Words(column.slice(low, high - low))
                units, _ = v.units(w)
                raw, at = units.astype(np.uint16).tobytes(), (np.append(0, np.cumsum(w.texts.n_words + 1)) * 2).tolist()
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), pa.array([raw[i:j] for i, j in zip(at[:-1], at[1:], strict=True)], pa.binary())], ["key", "units"])

    keyed = docs.select(F.xxhash64("doc_id", "text").alias("key"), "text")
    return keyed.mapInArrow(run, "key bigint, units binary").select(F.pmod("key", F.lit(shards)).cast("int").alias("shard"), "key", "units")


def train(docs: DataFrame, v: Vocabulary, tokens: int) -> dict[str, np.ndarray]:
    """The model of docs' texts (doc_id, text), which have so many tokens."""
    spark = docs.sparkSession
    p = start_vectors(v)
    square = no_squares(p)
    if not tokens:
        return p
    shards = -(-tokens // SHARD_TOKENS)
    held = common.table(encoded(docs, v, shards), "units")
    for turn in range(ROUNDS):
        sent = spark.sparkContext.broadcast((v, p, square))

        @common.lean
        def run(batches: Iterator[pa.RecordBatch], sent=sent, turn=turn) -> Iterator[pa.RecordBatch]:
            common.hoard()
            v, p, square = sent.value
            shard, trainer, waiting, size = None, None, [], 0

            def finish() -> pa.RecordBatch:
                trainer.learn(np.concatenate(waiting))
                cells = np.array_split(_packed(v, trainer.p, trainer.square, trainer.changes), BLOCKS)
                return pa.RecordBatch.from_arrays([pa.array([shard] * BLOCKS, pa.int32()), pa.array(range(BLOCKS), pa.int32()), pa.array([x.tobytes() for x in cells], pa.binary())], ["shard", "block", "payload"])

            for b in batches:
                for s, units in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                    if s != shard:
                        if shard is not None:
                            yield finish()
                        shard, trainer, waiting, size = s, Trainer(v, p, square, (turn, s)), [], 0
                    elif size >= BUFFER:
                        trainer.learn(np.concatenate(waiting))
                        waiting, size = [], 0
                    waiting.append(np.frombuffer(units.as_buffer(), np.uint16).astype(np.int64))
                    size += len(waiting[-1])
            if shard is not None:
                yield finish()

        n = shards
        sums = held.repartition(n, "shard").sortWithinPartitions("shard", "key").select("shard", "units").mapInArrow(run, "shard int, block int, payload binary")

        def add(key: tuple, table: pa.Table) -> pa.Table:
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "block": pa.array([key[1].as_py()], pa.int32()), "payload": pa.array([_added(table).tobytes()], pa.binary())})

        while True:
            n = -(-n // FAN)
            sums = sums.groupBy(F.floor(F.col("shard") / FAN).cast("int").alias("up"), "block").applyInArrow(add, "shard int, block int, payload binary")
            if n == 1:
                break
        rows = sums.orderBy("block").collect()  # the model's own size
        p, square = _unpacked(np.concatenate([np.frombuffer(r["payload"], np.float32) for r in rows]), p, square)
        sent.unpersist()
        common.sweep(spark)
    return p


# --- counts and scores ----------------------------------------------------------------------------------


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A place of each different key, and how often each occurs."""
    order = np.argsort(key)
    key = key[order]
    at = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.empty(0, np.int64)
    return order[at], np.diff(np.append(at, len(key)))


def word_counts(docs: DataFrame) -> DataFrame:
    """(h, kind, c) of all words of docs' texts; tasks count some MB at a time before the shuffle."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            column = common.texts_of(b.column(0))
            for start, stop in common.steps(column, 1 << 23):
                some = column.slice(start, stop - start)
                parts = [Words(some.slice(low, high - low)) for low, high in common.steps(some)]
                h, kind = np.concatenate([w.hash for w in parts]), np.concatenate([w.kind for w in parts])
                found = pa.array(h).dictionary_encode()
                at = found.indices.to_numpy()
                kinds = np.empty(len(found.dictionary), np.int32)
                kinds[at] = kind  # equal words are of one class
                yield pa.RecordBatch.from_arrays([found.dictionary, pa.array(kinds), pa.array(np.bincount(at, minlength=len(kinds)), pa.int64())], ["h", "kind", "n"])

    return docs.select("text").mapInArrow(run, "h bigint, kind int, n bigint").groupBy("h").agg(F.sum("n").alias("c"), F.first("kind").alias("kind"))


@dataclass
class Shares:
    """What the words of each class's tail share: log10 of a word's probability given the tail, by its count."""

    discount: np.ndarray
    whole: np.ndarray
    unseen: np.ndarray  # log10

    @staticmethod
    def of(tokens: np.ndarray, words: np.ndarray, once: np.ndarray, twice: np.ndarray) -> Shares:
        discount = np.clip((once + 0.5) / (once + 2 * twice + 1), 0.1, 0.9)
        whole = tokens + 0.5
        return Shares(discount, whole, np.log10((discount * words + 0.5) / whole))

    def seen(self, count: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return np.log10((count - self.discount[kind]) / self.whole[kind])


def _by_hash(h: np.ndarray, *more: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(h)
    return h[order], *(x[order] for x in more)


def score(df: DataFrame, held: int = 1, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each row of df (doc_id, text)."""
    spark = df.sparkSession
    rest = fold("doc_id", folds)
    docs = df.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(rest == held, F.lit(False)).alias("held_out"), F.coalesce(rest != held, F.lit(False)).alias("learn"))
    learn = docs.filter("learn").select("doc_id", "text")
    n_learn = learn.count()
    counts = common.table(word_counts(learn), "word-counts")
    top = counts.filter(F.col("c") >= LEAST).orderBy(F.desc("c"), "h").limit(HEADS).toArrow()
    head = [top[c].to_numpy() for c in ("h", "c", "kind")]
    last = (LEAST, 2**63 - 1) if len(head[0]) < HEADS else (int(head[1][-1]), int(head[0][-1]))
    is_tail = (F.col("c") < last[0]) | ((F.col("c") == last[0]) & (F.col("h") > last[1]))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    per = counts.withColumn("tail", is_tail).groupBy("tail", "kind").agg(F.sum("c").alias("n"), F.count("*").alias("v"), one(F.col("c") == 1).alias("n1"), one(F.col("c") == 2).alias("n2")).collect()
    words, distinct = sum(r["n"] for r in per), sum(r["v"] for r in per) + (n_learn > 0)
    total = words + n_learn
    tails = np.zeros((4, CLASSES))
    for r in per:
        if r["tail"]:
            tails[:, r["kind"]] = r["n"], r["v"], r["n1"], r["n2"]
    v = Vocabulary.of(head[0], head[1], head[2].astype(np.int64), tails[0], n_learn)
    shares = Shares.of(*tails)
    model = train(learn, v, int(total))
    hot = counts.filter((F.col("c") >= max(1, total / HOT)) & is_tail).select("h", "c").toArrow()  # HOT rows at most
    hot_h, hot_c = _by_hash(np.concatenate([head[0], hot["h"].to_numpy()]), np.concatenate([head[1], hot["c"].to_numpy()]))
    whole = float(np.log10(total + 0.5 * (distinct + 1)))
    sent = spark.sparkContext.broadcast((v, model, class_parts(model), unit_norms(v, model), shares, hot_h, hot_c))
    kind = docs.schema["doc_id"].dataType.simpleString()

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, model, parts, norms, shares, hot_h, hot_c = sent.value
        tail_unit = np.zeros(len(v.unit_class), bool)
        tail_unit[v.start[:-1]] = True
        for b in batches:
            column = common.texts_of(b.column(1))
            for low, high in common.steps(column):
                w = Words(column.slice(low, high - low))
                t = w.texts
                n = np.full(len(w.hash), -1)
                known, at = w.found(hot_h)
                n[known] = hot_c[at]
                units, where = v.units(w)
                two, one = v.before(units)
                own = (class_scores(model, two, one, v.unit_class[units], parts) + unit_scores(v, model, norms, one, units)).astype(float) / LOG10
                known = np.flatnonzero((n >= 0) & tail_unit[units[where]])
                own[where[known]] += shares.seen(n[known], w.kind[known])
                base = np.where(n >= 0, np.log10(np.maximum(n, 0) + 0.5) - whole, 0)
                # words without a count leave once for each text, with their number
                open_ = np.flatnonzero(n < 0)
                at, times = _distinct(mix(w.hash[open_].view(U) + mix(t.doc[open_].astype(U))))
                at, times = _by_hash(open_[at], times)
                edge = pa.array(np.searchsorted(t.doc[at], np.arange(t.n + 1)), pa.int32())
                lists = [pa.ListArray.from_arrays(edge, x) for x in (pa.array(w.hash[at]), pa.array(times, pa.int32()), pa.array(w.kind[at], pa.int32()))]
                owner = np.repeat(np.arange(t.n), t.n_words + 1)
                end = np.log10(n_learn + 0.5) - whole
                numbers = [
                    pa.array(t.n_words + 1, pa.int64()),
                    pa.array(np.bincount(t.doc, n > 0, t.n).astype(np.int64) + int(n_learn > 0)),
                    pa.array(np.bincount(t.doc, base, t.n) + end),
                    pa.array(np.bincount(owner, own, t.n)),
                ]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(low, high - low), *(b.column(k).slice(low, high - low) for k in (2, 3)), *numbers, *lists], ["doc_id", "held_out", "row", "n_tokens", "n_known", "base", "score", "hs", "ms", "ks"])

    schema = f"doc_id {kind}, held_out boolean, row bigint, n_tokens bigint, n_known bigint, base double, score double, hs array<bigint>, ms array<int>, ks array<int>"
    texts = docs.withColumn("row", F.monotonically_increasing_id()).select("doc_id", "text", "held_out", "row")
    part = common.table(texts.mapInArrow(run, schema), "partial-scores")
    open_words = part.select("row", F.explode(F.arrays_zip("hs", "ms", "ks")).alias("x")).select("row", F.col("x.hs").alias("h"), F.col("x.ms").alias("m"), F.col("x.ks").alias("k"))
    by_kind = [(k, float(shares.discount[k]), float(shares.whole[k]), float(shares.unseen[k])) for k in range(CLASSES)]
    by_kind = F.broadcast(spark.createDataFrame(by_kind, "k int, discount double, whole double, unseen double"))
    c = F.coalesce("c", F.lit(0))
    given = F.when(c > 0, F.log10((c - F.col("discount")) / F.col("whole"))).otherwise(F.col("unseen"))
    met = open_words.join(counts.select("h", "c"), "h", "left").join(by_kind, "k")
    more = met.groupBy("row").agg(F.sum(F.when(c > 0, F.col("m")).otherwise(0)).alias("a"), F.sum(F.col("m") * (F.log10(c + 0.5) - whole)).alias("b"), F.sum(F.col("m") * given).alias("s"))
    add = lambda column, other, zero: F.col(column) + F.coalesce(other, F.lit(zero))
    return part.drop("hs", "ms", "ks").join(more, "row", "left").select(
        "doc_id",
        "held_out",
        "n_tokens",
        add("n_known", "a", 0).cast("bigint").alias("n_known"),
        F.lit(int(total)).cast("bigint").alias("train_tokens"),
        add("base", "b", 0.0).alias("base_score"),
        add("score", "s", 0.0).alias("score"),
    )

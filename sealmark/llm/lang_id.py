"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are runs of one to three characters (lower case; what is no letter counts as one blank, and
runs of several blanks are left out), hashed to 2^16 slots. Document frequencies come from all
training documents. The weights are fitted by follow-the-regularised-leader with elastic-net penalties
on a bounded sample of labelled documents, the same share of each language where there are enough;
a fifth of the sample, not used for the weights, sets the temperature of the probabilities.

A text that is null or has no letter is `und` with score 0, and so is every text if nothing was learned.
Training rows are those with a language and a text. Texts of any length are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

SLOTS = 1 << 16
_BLANK = 32
_SEEDS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Whether each code point is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def slots(texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    """For each length of run: the slots of all texts' runs, and the texts' edges among them. Then who has a letter."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in low], out=at[1:])
    is_letter = letters()[codes]
    c = np.where(is_letter, codes, np.uint32(_BLANK))
    seen = np.zeros(len(c) + 1, np.int64)
    np.cumsum(is_letter, out=seen[1:])
    some = seen[at[1:]] > seen[at[:-1]]
    last = np.zeros(len(c), bool)  # the last character of a text begins no longer run
    last[at[1:][at[1:] > at[:-1]] - 1] = True
    found, edges = [], []
    for n in (1, 2, 3):
        if len(c) < n:
            found.append(np.empty(0, np.uint16))
            edges.append(np.zeros(len(at), np.int64))
            continue
        size = len(c) - n + 1
        use = is_letter[:size].copy()
        within = np.ones(size, bool)
        h = c[:size] * _SEEDS[n - 1]
        for k in range(1, n):
            h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D) + c[k : size + k] * _SEEDS[k - 1]
            use |= is_letter[k : size + k]
            within &= ~last[k - 1 : size + k - 1]
        if n == 3:
            use &= is_letter[1 : size + 1] | (is_letter[:size] & is_letter[2 : size + 2])
        h = (h ^ (h >> np.uint32(13))) * np.uint32(0x297A2D39)
        place = np.flatnonzero(use & within)
        found.append((h[place] >> np.uint32(16)).astype(np.uint16))
        edges.append(np.searchsorted(place, at))
    return found, edges, some


def fold(doc_id: Column | str, n: int = 3) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")), F.lit(n))


def _text_batches(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for b in batches:
        column = common.texts_of(b.column(at))
        for low, high in common.steps(column):
            yield b.slice(low, high - low), column.slice(low, high - low).to_pylist()


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """How many of the texts (one column) have each slot, and how many there are."""

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, mark, n = np.zeros(SLOTS, np.int64), np.zeros(SLOTS, bool), 0
        for _, part in _text_batches(batches, 0):
            found, edges, _ = slots(part)
            for k in range(len(part)):
                for f, e in zip(found, edges, strict=True):
                    mark[f[e[k] : e[k + 1]]] = True
                df += mark
                mark[:] = False
            n += len(part)
        if n:
            used = np.flatnonzero(df)
            yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1).astype(np.int32)), pa.array(np.append(df[used], n))], ["slot", "n"])

    out, total = np.zeros(SLOTS), 0
    for r in texts.mapInArrow(run, "slot int, n bigint").groupBy("slot").agg(F.sum("n").alias("n")).collect():  # a row for each slot at most
        if r["slot"] < 0:
            total = r["n"]
        else:
            out[r["slot"]] = r["n"]
    return out, total


def _sparse(found: list[np.ndarray], edges: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's slots and their share of its runs, summed over the lengths."""
    parts = [f[e[k] : e[k + 1]] for f, e in zip(found, edges, strict=True)]
    weight = np.concatenate([np.full(len(p), 1.0 / len(p)) for p in parts if len(p)] or [np.empty(0)])
    index, back = np.unique(np.concatenate(parts), return_inverse=True)
    return index.astype(np.int64), np.bincount(back, weights=weight, minlength=len(index))


def fit_ftrl(rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, classes: int, alpha: float, beta: float, l1: float, l2: float, epochs: int) -> np.ndarray:
    """(SLOTS, classes) weights of follow-the-regularised-leader, proximal, with per-coordinate rates."""
    z, n = np.zeros((SLOTS, classes)), np.zeros((SLOTS, classes))

    def weights(at) -> np.ndarray:
        zz = z[at]
        return np.where(np.abs(zz) <= l1, 0.0, -(zz - np.sign(zz) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    order = np.random.default_rng(7)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            index, x = rows[r]
            w = weights(index)
            s = x @ w
            p = np.exp(s - s.max())
            p /= p.sum()
            p[label[r]] -= 1.0
            g = x[:, None] * p[None, :]
            before = n[index]
            after = before + g * g
            z[index] += g - (np.sqrt(after) - np.sqrt(before)) / alpha * w
            n[index] = after
    return weights(slice(None))


def temperature(scores: np.ndarray, label: np.ndarray) -> float:
    """The divisor of the scores that makes the labels likeliest, between 1/20 and 20.

    Each label counts as one of the others once in n + 2 times, else separable scores would be
    sharpened without end.
    """
    if not len(label):
        return 1.0

    def loss(log_t: float) -> float:
        s = scores / np.exp(log_t)
        s = s - s.max(axis=1, keepdims=True)
        right = s[np.arange(len(label)), label]
        other = (s.sum(axis=1) - right) / max(1, s.shape[1] - 1)
        doubt = 1.0 / (len(label) + 2)
        return float(np.mean(np.log(np.exp(s).sum(axis=1)) - (1 - doubt) * right - doubt * other))

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(60):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


class LanguageModel:
    def __init__(self, languages: list[str], table: np.ndarray):
        self.languages, self.table = languages, table.astype(np.float32)

    def scores(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) calibrated scores, and which texts have a letter."""
        found, edges, some = slots(texts)
        out = np.zeros((len(texts), len(self.languages)))
        for f, e in zip(found, edges, strict=True):
            n = np.diff(e)
            has = n > 0
            if has.any():
                out[has] += np.add.reduceat(self.table[f], e[:-1][has], axis=0, dtype=np.float64) / n[has, None]
        return out, some


def fit(df: DataFrame, text: str = "text", lang: str = "lang", by: str = "doc_id", fit_rows: int = 4000, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.002, l2: float = 0.001, epochs: int = 3, scale: float = 10.0) -> LanguageModel:
    """A model from df's labelled texts. fit_rows bounds the sample that the weights are fitted on."""
    rows = df.select(F.col(text).alias("text"), F.col(lang).alias("lang"), F.col(by).alias("by")).filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(fit_rows).collect()}
    languages = sorted(counts)
    if not languages:
        return LanguageModel([], np.zeros((SLOTS, 0)))
    df_, total = document_frequencies(rows.select("text"))
    idf = np.log((1 + total) / (1 + df_)) + 0.05
    share = fit_rows / len(languages)
    draw = F.pmod(F.xxhash64("by", F.lit("fit")), F.lit(1_000_000))
    rate = F.create_map(*(F.lit(x) for c in languages for x in (c, min(1.0, share / counts[c]))))[F.col("lang")]
    sample = rows.filter(draw < rate * 1_000_000).select("lang", "text", (F.pmod(F.xxhash64("by", F.lit("hold")), F.lit(5)) == 0).alias("hold")).limit(2 * fit_rows)

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, part in _text_batches(batches, 1):
            found, edges, _ = slots(part)
            both = [_sparse(found, edges, k) for k in range(len(part))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([x.astype(np.int32) for x, _ in both], pa.list_(pa.int32())), pa.array([y.astype(np.float32) for _, y in both], pa.list_(pa.float32()))], ["lang", "hold", "i", "x"])

    got = sample.mapInArrow(run, "lang string, hold boolean, i array<int>, x array<float>").toArrow()
    place = {c: k for k, c in enumerate(languages)}
    label = np.array([place[c] for c in got["lang"].to_pylist()], int)
    hold = np.array(got["hold"].to_pylist(), bool)
    sparse = []
    for i, x in zip(got["i"], got["x"], strict=True):
        index = i.values.to_numpy().astype(np.int64)
        sparse.append((index, x.values.to_numpy().astype(float) * idf[index] * scale))
    # the order in which rows arrive must not matter
    key = sorted(range(len(sparse)), key=lambda r: (label[r], len(sparse[r][0]), float(sparse[r][1].sum()), sparse[r][0].tobytes()))
    train = [r for r in key if not hold[r]] or key
    weights = fit_ftrl([sparse[r] for r in train], label[train], len(languages), alpha, beta, l1, l2, epochs)
    kept = [r for r in key if hold[r]]
    t = temperature(np.array([sparse[r][1] @ weights[sparse[r][0]] for r in kept]).reshape(len(kept), len(languages)), label[kept])
    return LanguageModel(languages, weights * (idf * scale / t)[:, None])


def predict(df: DataFrame, model: LanguageModel, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep's columns, lang_pred and score, the probability of the predicted language."""
    frame = df.select(*keep, text)
    fields = {f.name: f for f in frame.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in keep), "lang_pred string, score double"])
    sent = df.sparkSession.sparkContext.broadcast((model.languages, model.table))  # 2^16 rows, a column for each language

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = LanguageModel(*sent.value)
        for b, part in _text_batches(batches, len(keep)):
            if m.languages:
                s, some = m.scores(part)
                s -= s.max(axis=1, keepdims=True)
                p = np.exp(s)
                p /= p.sum(axis=1, keepdims=True)
                best = p.argmax(axis=1)
                names = [m.languages[k] if ok else "und" for k, ok in zip(best, some, strict=True)]
                score = np.where(some, p[np.arange(len(part)), best], 0.0)
            else:
                names, score = ["und"] * len(part), np.zeros(len(part))
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(names, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return frame.mapInArrow(run, schema)

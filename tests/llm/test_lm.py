import collections
import math
import os
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from helpers import docs, edge_rows, prose

from sealmark.llm import common
from sealmark.llm import lm_score as L

LOW = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW)), "\0end"]


def test_base_equals_brute_force(spark):
    r = random.Random(3)
    rows = [*edge_rows(), *((k, prose(r, r.randint(0, 120)).title()) for k in range(100, 220))]
    got = L.score(docs(spark, rows)).collect()
    counts = collections.Counter()
    for k, t in ((x[0], x[1]) for x in rows):
        if k is not None and zlib.crc32(str(k).encode()) % 5 != 1:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    want = sorted((str(k), k is not None and zlib.crc32(str(k).encode()) % 5 == 1, len(w := tokens(t)), sum(counts[x] > 0 for x in w), n, round(sum(math.log10((counts[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w), 6)) for k, t in ((x[0], x[1]) for x in rows))
    have = sorted((str(x["doc_id"]), x["held_out"], x["n_tokens"], x["n_known"], x["train_tokens"], round(x["base_score"], 6)) for x in got)
    assert len(have) == len(want)
    for a, b in zip(have, want):
        assert a[:5] == b[:5] and a[5] == pytest.approx(b[5], rel=1e-7)
    assert all(math.isfinite(x["score"]) and x["score"] < 0 for x in got)


def test_no_training_rows(spark):
    rows = L.score(docs(spark, [(None, "a b"), (None, None)])).collect()
    assert len(rows) == 2 and all(x["train_tokens"] == 0 and math.isfinite(x["score"]) for x in rows)
    assert L.score(docs(spark, []).limit(0)).collect() == []


def some_vocabulary(n_heads=60):
    r = np.random.default_rng(4)
    kind = r.integers(0, L.END_CLASS, n_heads)
    kind[:20] = 5
    return L.Vocabulary.of(np.sort(r.integers(0, 2**62, n_heads)), r.integers(3, 50, n_heads), kind, r.integers(0, 9, L.CLASSES).astype(float), 7)


def some_vectors(v):
    r = np.random.default_rng(5)
    return {k: (x + r.normal(0, 0.5, x.shape)).astype(np.float32) for k, x in L.start_vectors(v).items()}


def test_all_factors_are_normalised():
    v = some_vocabulary()
    p = some_vectors(v)
    norms = L.unit_norms(v, p)
    n = len(v.unit_class)
    for two, one in ((v.end, v.end), (3, 17), (n - 5, 0)):
        every = np.arange(L.CLASSES)
        at = lambda x, k: np.full(k, x)
        assert np.exp(L.class_scores(p, at(two, L.CLASSES), at(one, L.CLASSES), every)).sum() == pytest.approx(1, abs=1e-4)
        units = np.exp(L.unit_scores(v, p, norms, at(one, n), np.arange(n)))
        assert np.allclose(np.add.reduceat(units, v.start[:-1]), 1, atol=1e-4)
    counts = np.array([1, 1, 1, 2, 2, 5])
    s = L.Shares.of(*(np.array([float(x)]) for x in (counts.sum(), len(counts), 3, 2)))
    assert (10 ** s.seen(counts, np.zeros(6, int))).sum() + 10 ** s.unseen[0] == pytest.approx(1)


def test_start_is_the_unigram():
    v = some_vocabulary()
    p = L.start_vectors(v)
    unit = np.arange(len(v.unit_class))
    one = np.full(len(unit), v.end)
    got = L.class_scores(p, one, one, v.unit_class) + L.unit_scores(v, p, L.unit_norms(v, p), one, unit)
    assert np.allclose(np.exp(got), v.count / v.count.sum(), atol=1e-4)


def test_training_learns_contexts():
    """A unit that is always followed by the next one, by its class and within its class."""
    r = np.random.default_rng(0)
    v = some_vocabulary()
    heads = np.sort(v.head_unit)
    first = r.integers(0, len(heads), 20000)
    units = np.stack([heads[first], heads[(first + 1) % len(heads)]], axis=1).reshape(-1)
    p, square = L.start_vectors(v), None

    def held(p):
        two, one = v.before(units)
        norms = L.unit_norms(v, p)
        at = np.arange(1, len(units), 2)
        return L.class_scores(p, two, one, v.unit_class[units])[at].mean(), L.unit_scores(v, p, norms, one, units)[at].mean()

    before = held(p)
    square = L.no_squares(p)
    for k in range(12):
        t = L.Trainer(v, p, square, (k, 0))
        t.learn(units)
        p, square = L._unpacked(L._packed(v, t.p, t.square, t.changes), p, square)
    after = held(p)
    assert after[0] > 0.4 * before[0] and after[1] > 0.5 * before[1]


def plain_step(t, two, one, unit, rate=0.1):
    """A step token by token in Python, for tokens by class: the vectors after it, and how often each was changed."""
    v, p, rng = t.v, {k: x.astype(float) for k, x in t.p.items()}, t.rng
    kind, sigmoid = v.unit_class[unit], lambda x: 1 / (1 + math.exp(-x))
    g, n = {k: np.zeros(x.shape) for k, x in p.items()}, {k: np.zeros(len(x)) for k, x in p.items()}

    def add(part, at, x):
        g[part][at] += x
        n[part][at] += 1

    drawn = np.searchsorted(t.class_sum, rng.random(L.NOISE) * t.class_sum[-1], "right")
    rows = {int(k): np.flatnonzero(kind == k) for k in set(kind[t.several[unit]].tolist())}
    size = np.array([len(rows.get(k, ())) for k in range(L.CLASSES)])
    turns = [(rng.random((L.UNIT_NOISE, L.CLASSES)) * size).astype(int)] if rows else []
    for i, (a, b, u) in enumerate(zip(two, one, unit)):
        hidden, d = p["context"][b] * p["place"][0] + p["context"][a] * p["place"][1], np.zeros(L.DIM)
        for real, c in [(1, kind[i]), *((0, c) for c in drawn)]:
            e = real - sigmoid(hidden @ p["target"][c] + p["bias"][c, 0] - t.class_known[c])
            d += e * p["target"][c]
            g["target"][c] += e * hidden
            g["bias"][c] += e
        add("context", b, d * p["place"][0])
        add("context", a, d * p["place"][1])
        g["place"] += d * np.stack([p["context"][b], p["context"][a]])
        if t.several[u]:
            mine = rows[int(kind[i])]
            others = [unit[mine[(np.searchsorted(mine, i) + w[kind[i]]) % len(mine)]] for w in turns[0]]
            x, d = p["unit_context"][b], np.zeros(L.UNIT_DIM)
            for real, c in [(1, u), *((0, c) for c in others)]:
                e = real - sigmoid(x @ p["unit_target"][c] + p["unit_bias"][c, 0] - t.unit_known[c])
                d += e * p["unit_target"][c]
                add("unit_target", c, e * x)
                add("unit_bias", c, e)
            add("unit_context", b, d)
    n["target"] = n["bias"] = np.bincount(kind, minlength=L.CLASSES) + np.bincount(drawn, minlength=L.CLASSES)
    n["place"] += 1
    return {k: p[k] + rate / (1e-3 + np.sqrt(t.square[k] + (g[k] ** 2).mean(axis=1)))[:, None] * g[k] for k in p}, n


def test_a_step_equals_one_token_by_token():
    v = some_vocabulary()
    for units in (np.random.default_rng(6).integers(0, v.end + 1, 300), np.full(3, v.end)):
        t, other = (L.Trainer(v, some_vectors(v), {k: x + 0.5 for k, x in L.no_squares(some_vectors(v)).items()}, (3, 1)) for _ in range(2))
        two, one = v.before(units)
        order = np.argsort(v.unit_class[units], kind="stable")
        want, n = plain_step(other, two[order], one[order], units[order])
        t.step(two[order], one[order], units[order])
        for k in want:
            assert np.allclose(t.p[k], want[k], atol=2e-4), k
            assert np.array_equal(t.changes[k], n[k]), k


def test_a_step_adds_rows_in_pairs_of_numbers(monkeypatch):
    """Fewer sums by index than there are numbers to a token's vectors."""
    v = some_vocabulary()
    units = np.random.default_rng(6).integers(0, v.end + 1, 3000)
    two, one = v.before(units)
    order = np.argsort(v.unit_class[units], kind="stable")
    t, calls, real = L.Trainer(v, some_vectors(v), L.no_squares(some_vectors(v)), (3, 1)), [], np.bincount

    class Add:
        def __getattr__(self, name):
            return getattr(add, name)

        def __call__(self, *a, **k):
            return add(*a, **k)

        def at(self, *a):
            calls.append(a)
            return add.at(*a)

    add = np.add
    monkeypatch.setattr(np, "bincount", lambda *a, **k: calls.append(a) or real(*a, **k))
    monkeypatch.setattr(np, "add", Add())
    t.step(two[order], one[order], units[order])
    monkeypatch.undo()
    assert len(calls) < 2 * L.DIM + 2 * L.UNIT_DIM


def test_texts_that_are_only_counted_are_not_sorted():
    w = L.Words(common.texts_of(pa.array(["a b c b", "", "d a", None])))
    assert "order" not in vars(w)
    known, at = w.found(np.sort(w.hash[[1, 4]]))
    assert sorted(known.tolist()) == [1, 3, 4] and (np.sort(w.hash[[1, 4]])[at] == w.hash[known]).all()


def test_scores_take_no_exponentials_for_each_token(monkeypatch):
    """Not even of weights of which one factor or the other is all but nothing."""
    v = some_vocabulary()
    r = np.random.default_rng(2)
    two, one, unit = r.integers(0, v.end + 1, (3, 4000))
    for scale in (1, 40):
        p = some_vectors(v)
        p["context"] *= scale
        parts, made, real = L.class_parts(p), [], np.exp
        monkeypatch.setattr(np, "exp", lambda x, *a, **k: made.append(np.size(x)) or real(x, *a, **k))
        got = L.class_scores(p, two, one, v.unit_class[unit], parts)
        monkeypatch.undo()
        s = (p["context"][one] * p["place"][0] + p["context"][two] * p["place"][1]).astype(float) @ p["target"].T.astype(float) + p["bias"][:, 0]
        want = s[np.arange(len(s)), v.unit_class[unit]] - s.max(axis=1) - np.log(np.exp(s - s.max(axis=1, keepdims=True)).sum(axis=1))
        assert np.allclose(got, want, rtol=1e-4, atol=1e-3)
        assert bool(made) == (scale > 1)


def test_rows_that_nothing_changes_stay():
    v = some_vocabulary()
    p = some_vectors(v)
    t = L.Trainer(v, p, L.no_squares(p), (0, 0))
    t.learn(np.array([v.end] * 3))
    q, _ = L._unpacked(L._packed(v, t.p, t.square, t.changes), p, t.square)
    assert np.array_equal(q["unit_target"], p["unit_target"]) and not np.array_equal(q["context"][v.end], p["context"][v.end])


def test_contexts_begin_anew_with_each_text():
    w = L.Words(common.texts_of(pa.array(["a b c", "", "d", None])))
    v = L.Vocabulary.of(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.int64), np.zeros(L.CLASSES), 1)
    units, where = v.units(w)
    assert len(units) == 8 and (units[[3, 4, 6, 7]] == v.end).all() and where.tolist() == [0, 1, 2, 5]
    two, one = v.before(units)
    assert all(two[k] == one[k] == v.end for k in (0, 4, 5, 7))
    assert (two[1], one[1]) == (v.end, units[0]) and (two[2], one[2]) == (units[0], units[1]) and (two[6], one[6]) == (v.end, units[5])


def corpus(r, n):
    """Texts in which each word leads to one of four others."""
    words = sorted({f"{a}{b}{c}" for a in "bdfgk" for b in ("ano", "eli", "uru", "isto") for c in ("", "ra", "mes", "ti")})
    after = {w: r.sample(words, 4) for w in words}
    out = []
    for k in range(n):
        w = r.choice(words)
        text = []
        for _ in range(60):
            text.append(w)
            w = r.choice(after[w]) if r.random() < 0.9 else r.choice(words)
        out.append((k, " ".join(text) + (f" once{k}" if k % 3 else "")))
    return out


def bigram(train, held):
    """log10 per token of an interpolated bigram model (Witten and Bell) on the base's unigrams."""
    one, two = collections.Counter(), collections.defaultdict(collections.Counter)
    for t in train:
        a = "\0end"
        for x in tokens(t):
            one[x] += 1
            two[a][x] += 1
            a = x
    n, v, total, count = sum(one.values()), len(one), 0.0, 0
    for t in held:
        a = "\0end"
        for x in tokens(t):
            p = (one[x] + 0.5) / (n + 0.5 * (v + 1))
            if b := two.get(a):
                s = sum(b.values())
                p = (b[x] + len(b) * p) / (s + len(b))
            total, count, a = total + math.log10(p), count + 1, x
    return total / count


def test_order_matters_and_partitions_do_not(spark, monkeypatch):
    monkeypatch.setattr(L, "SHARD_TOKENS", 9000)
    r = random.Random(8)
    rows = corpus(r, 700)
    is_held = lambda k: zlib.crc32(str(k).encode()) % 5 == 1
    mixed = [(k, " ".join(r.sample(t.split(), len(t.split()))) if is_held(k) else t) for k, t in rows]
    got = {}
    for name, some, parts in (("as it is", rows, 1), ("dealt", rows, 7), ("mixed", mixed, 3)):
        got[name] = {x["doc_id"]: x for x in L.score(docs(spark, some).repartition(parts)).collect()}
    mean = lambda g, c: sum(x[c] for x in g.values() if x["held_out"]) / sum(x["n_tokens"] for x in g.values() if x["held_out"])
    a, b = got["as it is"], got["dealt"]
    assert all(a[k]["score"] == pytest.approx(b[k]["score"], rel=1e-5) and a[k]["n_known"] == b[k]["n_known"] for k in a)
    assert mean(a, "score") > mean(a, "base_score") + 0.2
    assert mean(got["mixed"], "score") < mean(a, "score") - 0.2


@pytest.mark.parametrize("shard_tokens", [200, 1000, 1_000_000])
def test_each_token_is_trained_on_alike_at_every_size(spark, monkeypatch, shard_tokens):
    """In each round, whether there is one shard or many; each token changes two contexts."""
    monkeypatch.setattr(L, "SHARD_TOKENS", shard_tokens)
    rows = corpus(random.Random(2), 150)
    w = L.Words(common.texts_of(pa.array([t for _, t in rows])))
    n = int((w.texts.n_words + 1).sum())
    v, changes, real = some_vocabulary(), [], L._unpacked

    def unpacked(flat, p, square):
        x = p["context"]
        changes.append(float(flat[: len(x) * (x.shape[1] + 2)].reshape(len(x), -1)[:, 0].sum()))
        return real(flat, p, square)

    monkeypatch.setattr(L, "_unpacked", unpacked)
    L.train(docs(spark, rows), v, n)
    assert changes == [2 * n] * L.ROUNDS


SF = "/root/testdata/sf0.01/documents.parquet"


@pytest.mark.skipif(not os.path.exists(SF), reason="no test data")
def test_better_than_a_bigram(spark):
    rows = spark.read.parquet(SF).select("doc_id", "text")
    text = {x["doc_id"]: x["text"] for x in rows.collect()}
    scores = [x for x in L.score(rows).collect() if x["held_out"]]
    ours = sum(x["score"] for x in scores) / sum(x["n_tokens"] for x in scores)
    held = {x["doc_id"] for x in scores}
    assert ours > bigram([t for k, t in text.items() if k not in held], [text[k] for k in held]) + 0.05

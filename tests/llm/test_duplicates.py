import collections
import random

import numpy as np
import pyarrow as pa

from helpers import docs, edge_rows, prose

from sealmark.llm import common
from sealmark.llm import near_dedup as N
from sealmark.llm import passage_dedup as P
from sealmark.llm.components import components, jaccard, similar_groups
from sealmark.llm.words import Texts


def edited(r, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[r.randrange(len(w))] = f"new{r.random()}"
    return " ".join(w)


def shingles(text):
    """Shingles with how often each occurs."""
    w = (text or "").split()
    return collections.Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else collections.Counter([tuple(w)] if w else [])


def roots(n, links):
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return [find(k) for k in range(n)]


def test_components(spark):
    r = random.Random(5)
    links = [(a, b) for a, b in ((r.randrange(300), r.randrange(300)) for _ in range(160))] + [(k, k + 1) for k in range(400, 460)] + [(500, k) for k in range(501, 560)]
    want = roots(600, links)
    for one_task in (500_000, 0):  # in one task, and by contraction
        got = {x["node"]: x["comp"] for x in components(spark.createDataFrame(links, "a bigint, b bigint"), one_task).collect()}
        assert got == {k: want[k] for k in {x for p in links if p[0] != p[1] for x in p}}
        assert components(spark.createDataFrame([], "a bigint, b bigint"), one_task).collect() == []


def test_signatures_estimate_similarity():
    r = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.9):
        both, own = int(400 * share), int(400 * (1 - share) / 2)
        a = np.sort(r.integers(0, 2**63, both + own).astype(np.uint64))
        b = np.sort(np.concatenate([a[r.permutation(len(a))[:both]], r.integers(0, 2**63, own).astype(np.uint64)]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        s = N.dart_signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), np.ones(len(a) + len(b)), 2, 600)
        assert abs((s[0] == s[1]).mean() - true) < 0.1


def test_signatures_of_weighted_sets():
    e = np.arange(50, dtype=np.uint64)
    w1, w2 = np.full(50, 2.5), np.full(50, 1.0)
    s = N.dart_signatures(np.concatenate([e, e]), np.repeat([0, 1], 50), np.concatenate([w1, w2]), 2, 2000)
    assert abs((s[0] == s[1]).mean() - 0.4) < 0.06
    big = np.arange(20_000, dtype=np.uint64)  # any size: all coordinates are filled
    assert (N.dart_signatures(np.concatenate([big, e[:1]]), np.repeat([0, 1], [20_000, 1]), np.ones(20_001), 2, 150) > 0).all()


def test_jaccard():
    a, b = (np.array(x, np.uint32).tobytes() for x in ([1, 2, 3, 2**32 - 1], [2, 3, 4]))
    assert jaccard(a, b) == 2 / 5 and jaccard(a, b"") == 0


def near_rows(r):
    rows = []
    for g in range(12):
        base = prose(r, 150)
        rows += [edited(r, base, r.choice((0, 0, 1, 2, 3, 6))) for _ in range(r.choice((2, 3, 25)))]
    for _ in range(6):  # the same shingles, but not as often: similar as sets, not as weighted sets
        line = prose(r, 30)
        rows += [" ".join([line] * n) for n in (2, 3, 8, 9)]
    rows += [prose(r, r.randint(5, 200)) for _ in range(60)]
    r.shuffle(rows)
    return list(enumerate(rows))


def test_classes_equal_brute_force(spark):
    r = random.Random(11)
    rows = near_rows(r)
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total()]
    got = {x["doc_id"]: x["class_id"] for x in N.classes(docs(spark, rows)).collect()}
    want = roots(len(rows), links)
    wrong = [k for k in range(len(rows)) if got[k] != want[k]]
    assert len(wrong) <= 0.01 * len(rows), wrong
    kept = {x["doc_id"] for x in N.keep_one(docs(spark, rows)).collect()}
    assert kept == {k for k in got if got[k] == k}


def test_only_texts_that_share_a_band_leave_their_shingles(spark, monkeypatch):
    r = random.Random(5)
    text = prose(r, 300)
    rows = [(1, text), (2, text + " more"), (2, text + " still more"), (3, text), *((k, prose(r, 200)) for k in range(10, 60))]
    made, real = [], common.table
    monkeypatch.setattr(common, "table", lambda df, name: made.append((name, real(df, name))) or made[-1][1])
    got = {(x["doc_id"], x["class_id"]) for x in N.classes(docs(spark, rows)).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), *((k, k) for k in range(10, 60))}
    held = {name: sorted(x["node"] for x in t.select("node").collect()) for name, t in made if "set" in t.columns and "node" in t.columns}
    assert held == {"sets": [1, 2]} and not any("set" in t.columns for name, t in made if name != "sets")


def test_many_members_few_pairs(spark):
    """A star of edits: members that reach only the middle."""
    r = random.Random(12)
    base = prose(r, 150)
    rows = list(enumerate([base, *(edited(r, base, r.randint(0, 12)) for _ in range(150))]))
    sets = [shingles(t) for _, t in rows]
    links = [(a, b) for a in range(len(rows)) for b in range(a) if (sets[a] & sets[b]).total() >= 0.8 * (sets[a] | sets[b]).total()]
    want = roots(len(rows), links)
    got = {x["doc_id"]: x["class_id"] for x in N.classes(docs(spark, rows)).collect()}
    assert sum(got[k] != want[k] for k in range(len(rows))) <= 2


def test_similar_groups_compares_what_is_left(spark):
    """Two chains in one band: no leader is similar to all, and every link is found."""
    sets = [np.arange(k * 2, k * 2 + 20, dtype=np.uint32) for k in range(12)] + [np.arange(1000 + k * 2, 1020 + k * 2, dtype=np.uint32) for k in range(12)]
    bands = spark.createDataFrame([(k, 7) for k in range(24)], "node bigint, band bigint")
    held = spark.createDataFrame([(k, s.tobytes()) for k, s in enumerate(sets)], "node bigint, set binary")
    comps, _ = similar_groups(bands, held, 0.8)
    assert {x["node"]: x["comp"] for x in comps.collect()} == {k: 0 if k < 12 else 12 for k in range(24)}


def test_similar_groups_frees_what_is_over(spark, monkeypatch):
    """Shuffle files between the steps, and the table of bands that more than one node has once its rows are written."""
    dropped, swept, drop, sweep = [], [], common.drop_table, common.sweep
    monkeypatch.setattr(common, "drop_table", lambda df: dropped.extend(df.inputFiles()) or drop(df))
    monkeypatch.setattr(common, "sweep", lambda spark: swept.append(1) or sweep(spark))
    sets = [np.arange(k * 2, k * 2 + 20, dtype=np.uint32).tobytes() for k in range(12)]
    comps, _ = similar_groups(spark.createDataFrame([(k, 7) for k in range(12)], "node bigint, band bigint"), spark.createDataFrame(list(enumerate(sets)), "node bigint, set binary"), 0.8)
    assert {x["comp"] for x in comps.collect()} == {0}
    assert any("shared-bands" in x for x in dropped) and len(swept) >= 4


def test_classes_have_no_partial_counts(spark):
    assert N.classes(docs(spark, [(k, "the same text stands here twice") for k in (1, 2)])).columns == ["doc_id", "class_id"]


def test_classes_edges(spark):
    rows = [*edge_rows(), (30, "same text here"), (31, "same text here"), (32, "")]
    got = collections.Counter((x["doc_id"], x["class_id"]) for x in N.classes(docs(spark, rows)).collect())
    assert sum(got.values()) == len(rows)
    assert got[(4, 4)] == 2 and got[(31, 30)] == 1 and got[(32, 2)] == 1 and got[(1, 1)] == 1 and got[(None, None)] == 2
    assert N.classes(docs(spark, []).limit(0)).collect() == []
    assert N.keep_one(docs(spark, rows)).count() == len(rows) - 2


def test_passages_share_a_paragraph_wherever_they_stand():
    r = random.Random(6)
    for _ in range(150):
        passage = prose(r, P.LENGTH + P.SPREAD)
        rows = [" ".join((prose(r, r.randint(0, 60)), passage, prose(r, r.randint(0, 60)))).strip() for _ in range(2)]
        p = P.paragraphs(common.texts_of(pa.array(rows)))
        assert set(p["hash"][p["doc"] == 0].tolist()) & set(p["hash"][p["doc"] == 1].tolist())


def test_least_places_is_brute_force():
    r = np.random.default_rng(2)
    for _ in range(60):
        doc = np.sort(r.integers(0, 4, 60))
        h = r.integers(0, 30, 60).astype(np.uint64)
        want = set()
        for d in range(4):
            at = np.flatnonzero(doc == d)
            for k in range(max(1, len(at) - 6)) if len(at) else ():
                window = at[k : k + 7]
                want.add(int(window[np.argmin(h[window])]))
        assert P.least_places(h, doc, 7).tolist() == sorted(want)


def test_repeats(spark):
    r = random.Random(8)
    passage = prose(r, 70)
    rows = [(k, " ".join((prose(r, 80), passage, prose(r, 80)))) for k in range(6)] + [(k, prose(r, 200)) for k in range(10, 40)] + [(50, passage + " " + prose(r, 300) + " " + passage)]
    rows += [(60, " ".join([prose(r, 100)] * 2))]
    out = P.repeats(docs(spark, rows)).collect()
    assert {x["doc_id"] for x in out} == {0, 1, 2, 3, 4, 5, 50}
    assert {x["doc_id"] for x in out if not x["removed"]} == {0}
    text = dict(rows)
    for x in out:
        inside = text[x["doc_id"]][x["start"] : x["end"]]
        assert inside in passage and len(inside.split()) >= P.LENGTH
    assert {x["n_docs"] for x in out} == {7}


def test_repeats_cover_whole_passages(spark):
    """Every word of a planted passage is reported, from 20 words on."""
    r = random.Random(31)
    sizes = [20, 21, 24, 30, 37, 45, 50, 60, 100, 300]
    passages = [prose(r, n) for n in sizes for _ in range(6)]
    rows, planted = [], []
    for k, p in enumerate(passages):
        for doc in (2 * k, 2 * k + 1):
            before = prose(r, r.randint(1, 60))
            rows.append((doc, f"{before} {p} {prose(r, r.randint(1, 60))}"))
            planted.append((doc, len(before) + 1, len(before) + 1 + len(p)))
    out = P.repeats(docs(spark, rows)).collect()
    for doc, start, end in planted:
        assert any(x["doc_id"] == doc and x["removed"] == (doc % 2 == 1) and x["start"] <= start and x["end"] >= end for x in out), (doc, end - start)


def test_ends_are_found_among_other_repeats(spark):
    """A passage that ends in the middle of what other documents share."""
    r = random.Random(32)
    w = prose(r, 120).split()
    whole, inner = " ".join(w), " ".join(w[37:63])
    rows = [(1, f"{prose(r, 20)} {whole} {prose(r, 20)}"), (2, f"{prose(r, 20)} {whole}"), (3, f"{prose(r, 33)} {inner} {prose(r, 20)}")]
    out = [x for x in P.repeats(docs(spark, rows)).collect() if x["doc_id"] == 3]
    start = rows[2][1].index(inner)
    assert len(out) == 1 and out[0]["removed"] and out[0]["start"] <= start and out[0]["end"] >= start + len(inner)


def test_blocks_of_near_copies(spark):
    """Paragraphs with a changed word collide in a band wherever the word stands, their first two included."""
    r = random.Random(33)
    same = total = 0
    for _ in range(200):
        w = prose(r, 70).split()
        texts = [" ".join(w)]
        w[r.randrange(len(w))] = "changed"
        p = P.blocks(common.texts_of(pa.array([*texts, " ".join(w)])))
        if p["words"].tolist() == [70, 70]:
            total += 1
            same += bool((p["bands"][0] == p["bands"][1]).any())
    assert total > 50 and same >= 0.97 * total


def test_near_copies_are_joined_across_edits(spark):
    """Near copies of whole texts are one span, however the edits split them into repeated runs."""
    r = random.Random(34)
    rows = []
    for k in range(40):
        w = prose(r, 240).split()
        rows.append((2 * k, " ".join(w)))
        w[60 + k] = "changed"
        rows.append((2 * k + 1, " ".join(w)))
    out = [x for x in P.repeats(docs(spark, rows)).collect() if x["removed"]]
    whole = {x["doc_id"] for x in out if x["start"] == 0 and x["end"] == len(dict(rows)[x["doc_id"]])}
    assert {x["doc_id"] for x in out} == {2 * k + 1 for k in range(40)} and len(whole) >= 32


def test_repeats_edges(spark):
    out = P.repeats(docs(spark, edge_rows())).collect()
    assert out == []  # row 4 comes twice, but is one document
    assert P.repeats(docs(spark, []).limit(0)).collect() == []


def test_words_of_null_and_space():
    assert Texts(common.texts_of(pa.array([None, " \n"]))).n_words.tolist() == [0, 0]

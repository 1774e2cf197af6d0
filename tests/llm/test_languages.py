import random

import numpy as np
import pytest

from helpers import docs, edge_rows

from sealmark.llm import lang_id as I

SOUNDS = {"aa": "ka lo mi re tan".split(), "bb": "sch ich ung ver zu".split(), "cc": "ção ñe ell ito osa".split(), "dd": "ou eau ier ette que".split()}


def text(r, lang, n):
    return " ".join("".join(r.choices(SOUNDS[lang], k=r.randint(1, 3))) for _ in range(n))


def labelled(r, n, first=0):
    return [(first + k, text(r, lang := r.choice(list(SOUNDS)), r.randint(3, 60)), lang) for k in range(n)]


def test_held_out_accuracy(spark):
    r = random.Random(1)
    rows = labelled(r, 400)
    model = I.fit(docs(spark, rows))
    assert model.languages == list(SOUNDS)
    test = labelled(r, 200, 1000)
    got = {x["doc_id"]: x for x in I.predict(docs(spark, test), model).collect()}
    assert sum(got[k]["lang_pred"] == lang for k, _, lang in test) >= 196
    assert all(0 <= x["score"] <= 1 for x in got.values())


def test_same_model_for_any_order(spark):
    rows = labelled(random.Random(2), 120)
    a, b = I.fit(docs(spark, rows)), I.fit(docs(spark, rows[::-1]).repartition(5))
    assert np.allclose(a.table, b.table)


def test_edges(spark):
    r = random.Random(3)
    rows = [*labelled(r, 80), (500, "no language", None), (501, None, "aa")]
    model = I.fit(docs(spark, rows))
    odd = [*edge_rows(), (60, "123 456 !!"), (61, None)]
    got = I.predict(docs(spark, odd), model).collect()
    assert len(got) == len(odd)
    for x in got:
        assert (x["lang_pred"] == "und") == (x["score"] == 0.0)
    assert {x["doc_id"] for x in got if x["lang_pred"] == "und"} == {None, 1, 2, 3, 60, 61}
    none = I.fit(docs(spark, []).limit(0))
    assert none.languages == [] and {x["lang_pred"] for x in I.predict(docs(spark, odd), none).collect()} == {"und"}
    assert I.predict(docs(spark, []).limit(0), model).collect() == []
    one = I.fit(docs(spark, [(1, "abc def", "aa")]))
    assert {x["lang_pred"] for x in I.predict(docs(spark, [(1, "xyz")]), one).collect()} == {"aa"}


def test_document_frequencies(spark):
    df = docs(spark, [(1, "abab"), (2, "ab"), (3, "zz")]).select("text")
    counts, total = I.document_frequencies(df)
    found, _, _ = I.slots(["ab"])
    assert total == 3 and all(counts[s] == 2 for f in found for s in f)


def test_temperature_softens_what_is_wrong():
    s = np.array([[5.0, 0.0]] * 50)
    assert I.temperature(s, np.array([0] * 30 + [1] * 20)) > I.temperature(s, np.zeros(50, int))
    assert I.temperature(s[:0], np.zeros(0, int)) == 1.0


@pytest.mark.parametrize("t", ["", "a", "ab", "a b", "..", "Ä1"])
def test_slots_stay_within_texts(t):
    alone, edges, some = I.slots([t])
    both, e2, _ = I.slots([t, "q", t])
    for a, b, e in zip(alone, both, e2):
        assert a.tolist() == b[e[0] : e[1]].tolist() == b[e[2] : e[3]].tolist()
    assert bool(some[0]) == any(c.isalpha() for c in t)

import random
import re

import numpy as np
import pyarrow as pa

from sealmark.llm import common
from sealmark.llm.words import Texts, distinct_by_text


def texts(r, n):
    return ["".join(r.choices("ab éA☃\n\t \x0b", k=r.randint(0, 40))) for _ in range(n)]


def test_words_lines_and_shingles():
    r = random.Random(1)
    rows = [*texts(r, 300), None, "", "one", "a b c d", "a b c d e"]
    column = common.texts_of(pa.array(rows))
    for low, high in common.steps(column, 500):
        t = Texts(column.slice(low, high - low))
        h = t.word_hash
        by = {}
        k = 0
        for row in rows[low:high]:
            for w in re.findall(r"[^\x20\x09-\x0D]+", row or ""):
                assert by.setdefault(w, h[k]) == h[k]
                k += 1
        assert k == len(h) and len(set(by.values())) == len(by)
        s, d = t.shingles(3)
        want = []
        for i, row in enumerate(rows[low:high]):
            w = re.findall(r"[^\x20\x09-\x0D]+", row or "")
            want += [i] * (max(1, len(w) - 2) if w else 0)
        assert d.tolist() == want
        starts, ends, doc = t.lines()
        found = [bytes(t.bytes[a:b]).decode() for a, b in zip(starts, ends)]
        assert found == [x for row in rows[low:high] for x in (row or "").split("\n") if x]


def test_steps_cover_all_rows():
    column = common.texts_of(pa.array(["x" * n for n in (0, 5, 1000, 3, 0, 0, 7)]))
    assert [k for a, b in common.steps(column, 10) for k in range(a, b)] == list(range(7))
    assert list(common.steps(common.texts_of(pa.array([], pa.string())))) == []


def test_shingles_are_equal_only_for_equal_words():
    t = Texts(common.texts_of(pa.array(["a b c d e f", "x a b c d e", "a b c", "a b c", "a c b"])))
    s, d = t.shingles(5)
    assert s[0] == s[3] and s[4] == s[5] != s[6] and len(s) == 7
    v, doc, n = distinct_by_text(np.array([3, 1, 3, 3], np.uint64), np.array([0, 0, 0, 1]))
    assert v.tolist() == [1, 3, 3] and doc.tolist() == [0, 0, 1] and n.tolist() == [1, 2, 1]

import collections
import random
import re

from helpers import docs, edge_rows, prose

from sealmark.llm import quality as Q


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = collections.Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    marked = {k + j for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(marked) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(marked), failed


def test_counts_equal_brute_force(spark):
    r = random.Random(5)
    rows = [*edge_rows(), *((k, "".join(r.choice(("a ", "b ", "c\n", "é☃ ", "#|", "\x0b", "x y z ", "\n\n"))for _ in range(r.randint(0, 200)))) for k in range(100, 400))]
    got = sorted((str(x["doc_id"]), *(x[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"))) for x in Q.rate(docs(spark, rows)).collect())
    assert got == sorted((str(k), *brute(t)) for k, t in ((x[0], x[1]) for x in rows))


def rows_with_boilerplate(r):
    common = [prose(r, 30) for _ in range(4)]
    own = lambda: f"distinctive{r.random()}"
    clean = [(k, "\n".join(prose(r, 25) + own() for _ in range(5)), "en", "h") for k in range(100)]
    mixed = [(200 + k, "\n".join([common[0], *(prose(r, 40) + own() for _ in range(3))]), "en", "h") for k in range(60)]
    empty = [(300 + k, "\n".join([*common[1:], prose(r, 45) + own()]), "en", "h") for k in range(90)]
    base = [prose(r, 25) for _ in range(6)]
    copies = [(400 + k, "\n".join(base), "en", "h") for k in range(150)]
    other = [(600 + k, "\n".join([*common[1:], prose(r, 12) + own()]), "en", None) for k in range(5)]
    return clean, mixed, empty, copies, other


def test_line_frequency(spark):
    clean, mixed, empty, copies, other = rows_with_boilerplate(random.Random(6))
    got = {x["doc_id"]: x for x in Q.rate(docs(spark, [*clean, *mixed, *empty, *copies, *other])).collect()}
    assert all(got[x[0]]["kept"] and got[x[0]]["n_removed"] == 0 for x in [*clean, *copies, *other])  # copies count once, and few documents are not many
    assert all(got[x[0]]["kept"] and got[x[0]]["n_removed"] == 30 for x in mixed)
    assert all(not got[x[0]]["kept"] and not got[x[0]]["base_failed"] and got[x[0]]["n_removed"] == 90 for x in empty)
    shuffled = {x["doc_id"]: x["kept"] for x in Q.rate(docs(spark, [*clean, *mixed, *empty, *copies, *other]), broadcast_rows=0).collect()}
    assert shuffled == {k: x["kept"] for k, x in got.items()}


def test_documents_of_one_template_all_count(spark):
    """However much of their text documents share, each counts; copies count once."""
    r = random.Random(7)
    for k in range(12):
        shared = [prose(r, 30) for _ in range(4)]
        rows = [(k, "\n".join([*shared, prose(r, 40)]), "en", "h") for k in range(100)]
        got = Q.rate(docs(spark, [*rows, *[(200 + k, rows[0][1].upper(), "en", "h") for k in range(40)]])).collect()
        assert {(x["n_removed"], x["kept"]) for x in got} == {(120, False)}
    few = [(k, "\n".join([*shared, prose(r, 40)]), "en", "h") for k in range(20)]
    got = Q.rate(docs(spark, [*few, *((100 + k, few[k % 20][1], "en", "h") for k in range(60))])).collect()
    assert {x["n_removed"] for x in got} == {0}


def test_edges(spark):
    assert Q.rate(docs(spark, []).limit(0)).collect() == []
    rows = [(1, "a b " * 40, "en", None), (1, "a b " * 40, "en", None)]
    got = Q.rate(docs(spark, rows)).collect()
    assert len(got) == 2 and all(x["base_failed"] and not x["kept"] for x in got)

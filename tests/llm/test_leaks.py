import random

from helpers import docs, edge_rows, prose

from sealmark.llm import decontaminate as D


def runs(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(len(w) - 4)}


def holds(item, text):
    """n_item and n_shared of an item that the text contains, else None."""
    q, w, x = runs(item), (item or "").lower().split(), (text or "").lower().split()
    if 0 < len(w) < 5:
        return (1, 1) if any(x[k : k + len(w)] == w for k in range(len(x))) else None
    both = q & runs(text)
    return (len(q), len(both)) if q and len(both) >= 0.8 * len(q) else None


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id bigint, text string")


def test_equals_brute_force(spark):
    r = random.Random(4)
    bench = [(k, prose(r, r.choice((5, 6, 9, 20, 40, 90)))) for k in range(40)] + [(90, "Too short item"), (91, None), (92, "one"), (93, " two\t words "), (94, "kalomi0 never there"), (95, " "), (None, "a b c d e f g"), (None, "a b")]
    rows = [(k, prose(r, 60)) for k in range(40)]
    for k in range(40, 160):
        w = r.choice(bench[:40])[1].split(" ")
        for _ in range(r.choice((0, 0, 1, 2, 3))):
            w[r.randrange(len(w))] = "zzz"
        cut = " ".join(w[: max(5, int(len(w) * r.choice((1, 1, 0.9, 0.8, 0.7))))])
        rows.append((k, f"{prose(r, r.randint(0, 900))}\n {cut.upper() if k % 2 else cut}\t{prose(r, 30)}"))
    rows += [(200, "one"), (201, "this is too\nshort ITEM of one"), (202, "two words and two words"), (203, "short item too a b"), (204, ""), (205, None)]
    want = {(k, i, *found) for i, t in bench if i is not None for k, x in rows if (found := holds(t, x))}
    assert {(200, 92, 1, 1), (201, 90, 1, 1), (202, 93, 1, 1)} <= want
    for limit in (2_000_000, 0):  # broadcast and shuffled
        got = {(x["doc_id"], x["item_id"], x["n_item"], x["n_shared"]) for x in D.contained(docs(spark, rows), items(spark, bench), broadcast_rows=limit).collect()}
        assert got == want
    left = {x["doc_id"] for x in D.clean(docs(spark, rows), items(spark, bench)).collect()}
    assert left == {k for k, _ in rows} - {k for k, *_ in want}


def test_edges(spark):
    bench = items(spark, [(1, "no id at all no id"), (2, "")])
    assert D.contained(docs(spark, edge_rows()), bench).collect() == []  # its only holder has no id
    assert D.contained(docs(spark, edge_rows()), bench.limit(0)).collect() == []
    assert D.contained(docs(spark, []).limit(0), bench).collect() == []
    assert D.clean(docs(spark, edge_rows()), bench).count() == len(edge_rows())


def test_no_python_on_the_path(spark):
    r = random.Random(1)
    plan = D.contained(docs(spark, [(1, prose(r, 50))]), items(spark, [(1, prose(r, 9))]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan

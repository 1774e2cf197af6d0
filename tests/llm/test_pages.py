import collections
import html

from pages_by_hand import PAGES
from pages_by_hand import page as by_hand

from sealmark.llm import html_extract as H

FIELD = H.default_field()


def test_held_out_pages():
    right = total = 0
    for page, article in H.labelled_pages(120, 77):
        found = H.blocks(page)
        for b, keep in zip(found, FIELD.decode(found)):
            total += 1
            right += keep == (b.text in article)
    assert right / total > 0.99


def wrapped(body):
    return f'<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p>";</script></head><body><nav><ul><li><a href="/a">A</a></li><li><a href="/b">B</a></li></ul></nav><!-- ad 0 --><div class="ad">Buy this now.</div>{body}<footer>&copy; m.example.net &middot; All of it.</footer></body></html>'


def test_article_alone():
    page = wrapped("<article><h1>Head &lt;1&gt;</h1><p><b>One\n  two.<br><p>Th<i>re</i>e,&nbsp;four &amp five.</p></article>")
    assert H.extract_text(page, FIELD) == "Head <1> One two. Three, four & five."


def test_parts_that_are_left_out():
    page = wrapped(
        '<div class="cookie-notice">We use cookies on this site, you know.</div><article><h1>The head of it</h1><p>First line of the article, with words.</p><p>Second line of the article, also with words.</p></article>'
        '<form class="newsletter"><p>Sign up here for our letters.</p><button>Go</button></form><aside><h3>Related</h3><p>Something else entirely, to be read.</p></aside>'
        '<section class="comments"><h3>Comments</h3><p>I liked it very much, thank you.</p></section>'
    )
    assert H.extract_text(page, FIELD) == "The head of it First line of the article, with words. Second line of the article, also with words."


def test_broken_pages():
    whole = wrapped("<article><h1>Head of this page</h1><p>Some words, and more of them here.</p></article>")
    for k in range(0, len(whole), 7):
        text = H.extract_text(whole[:k], FIELD)
        assert "<" not in text and "var t" not in text
    for page in ("", None, "<", "<p", "</", "<!--", "<script>", "a < b", '<a title="x>y', "<p>" * 3000, "x" * 300_000, "&#xD800; &bogus; &#0;"):
        assert isinstance(H.extract_text(page, FIELD), str)


def test_blocks_decode_once():
    (b,) = H.blocks("<p>&amp;lt; <b>x</b>  y</p>")
    assert b.text == "&lt; x y" == html.unescape("&amp;lt; x y")


def test_viterbi_is_the_best_labelling():
    import itertools

    page, _ = H.labelled_pages(30, 5)[7]
    found = H.blocks(page)[:9]
    e = FIELD.scores(found)

    def total(labels):
        return sum(x[y] for x, y in zip(e, labels)) + sum(FIELD.step[H.tie(a, b), p, q] for a, b, p, q in zip(found, found[1:], labels, labels[1:]))

    best = max(itertools.product((0, 1), repeat=len(found)), key=total)
    assert [int(x) for x in FIELD.decode(found)] == list(best)


def test_query_shape(spark):
    page = wrapped("<article><h1>Head of this page</h1><p>Some words, and more of them here.</p></article>")
    df = spark.createDataFrame([(1, "u", page, "x"), (1, "u", page, "x"), (2, None, None, "x"), (None, "v", "", "x")], "page_id bigint, url string, html string, text string")
    rows = H.extract(df).collect()
    assert len(rows) == 4 and sorted(r["n_chars"] for r in rows) == [0, 0, 52, 52] and all(len(r["text"]) == r["n_chars"] for r in rows)
    assert H.extract(df.limit(0)).collect() == []


def test_pages_that_the_generator_did_not_make():
    """Main text is found whole, and little of each other part comes with it."""
    field = H.default_field()
    size, taken = collections.Counter(), collections.Counter()
    for marked in PAGES:
        page, parts = by_hand(marked)
        text = H.extract_text(page, field)
        main = " ".join(t for kind, t in parts if kind == "article")
        for kind, t in parts:
            if kind == "article" or t not in main:
                size[kind] += len(t)
                taken[kind] += len(t) * (t in text)
    recall = taken["article"] / size["article"]
    precision = taken["article"] / sum(taken.values())
    assert 2 * precision * recall / (precision + recall) > 0.95
    leaked = {kind: round(taken[kind] / n, 2) for kind, n in size.items() if kind != "article"}
    assert set(leaked) == {"nav", "header", "notice", "ad", "aside", "form", "share", "footer", "comments"}
    assert all(x <= (0.25 if kind == "nav" else 0.05) for kind, x in leaked.items()), leaked

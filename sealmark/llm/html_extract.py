"""Main text of web pages: a linear-chain conditional random field over the DOM's leaf blocks.

A page is cut into leaf blocks, the text between two borders of block elements, with open elements as
HTML's rules for omitted and missing end tags leave them. Each block has features of its ancestors (tags,
words of class, id and role) and of its text (length, links, punctuation, place); neighbouring blocks are
tied by how much of their ancestry they share. The field's two labels are article and rest. Its weights are
fitted by stochastic gradient of the conditional likelihood (forward-backward) on pages that
`labelled_pages` lays out with known labels; pages are decoded by Viterbi.

Scripts, styles, templates, comments and the head are no text. Character references are decoded, white
space in a block is turned into one space, blocks are joined by one. Null and empty pages have no text.
A page that breaks off in a tag or an element is read as far as it goes. Nothing is capped.
"""

from __future__ import annotations

import functools
import html
import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import common

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^>\"'])*)(>|\Z)|</?[a-zA-Z/!?][^>]*(?:>|\Z)|</>", re.S)
_ATTRIBUTE = re.compile(r"""(?<![\w-])(class|id|role|hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed values of HTML: elements by how they are laid out.
RAW = frozenset("script style noscript template iframe noembed noframes textarea title svg math object audio video canvas head".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark meter nobr output progress q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
CLOSES_OWN = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("tr", "td", "th"), "tbody": ("thead", "tr", "td", "th"), "tfoot": ("tbody", "tr", "td", "th")}
BARRIER = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",))}
_TABLE = frozenset(("table",))
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTION = frozenset("article main section nav aside header footer form div ul ol table body".split())


class Block:
    __slots__ = ("text", "chain", "links", "path")

    def __init__(self, text: str, chain: tuple[str, ...], links: int, path: tuple[int, ...]):
        self.text, self.chain, self.links, self.path = text, chain, links, path


@functools.lru_cache(50_000)
def element_features(tag: str, attributes: str) -> str:
    """What the features of an element are made of: its tag, then words of its class, id and role."""
    words = [tag]
    for name, value in _ATTRIBUTE.findall(attributes):
        name = name.lower()
        if name in ("class", "id", "role"):
            words += [x.lower() for x in _PART.findall(html.unescape(value.strip("\"'")))]
        elif name == "hidden" or "none" in value and "display" in value.lower():
            words.append("hidden")
    return " ".join(dict.fromkeys(words))


def blocks(page: str) -> list[Block]:
    """The leaf blocks of a page in order, those without text left out."""
    out: list[Block] = []
    stack: list[str] = []  # tags of open block elements
    marks: list[str] = []  # their features
    ids: list[int] = []
    serial = 0
    in_link = 0
    parts: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if parts:
            text = " ".join("".join(parts).split())
            parts.clear()
            if text:
                out.append(Block(text, tuple(marks), min(linked, len(text)), tuple(ids)))
        linked = 0

    def close(k: int) -> None:
        del stack[k:], marks[k:], ids[k:]

    def add(raw: str) -> None:
        nonlocal linked
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked += len(text.strip())

    at, n = 0, len(page)
    while at < n:
        m = _TAG.search(page, at)
        if m is None:
            # a "<" that begins no whole tag: what can't be one is text
            add(page[at:])
            break
        if m.start() > at:
            add(page[at : m.start()])
        at = m.end()
        tag = m.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if m.group(4) != ">":
            break  # the page ends inside a tag
        if m.group(1):
            if tag == "a":
                in_link = max(0, in_link - 1)
            elif tag == "br":
                parts.append(" ")
            elif tag not in INLINE and tag not in VOID:
                flush()
                if tag in stack:
                    close(len(stack) - 1 - stack[::-1].index(tag))
            continue
        if tag in RAW:
            if not m.group(3).endswith("/") or tag in ("script", "style", "title", "textarea", "head"):
                if tag not in ("noscript", "svg", "math", "object", "textarea", "title"):
                    flush()
                if tag == "head":
                    at = _end_of_head(page, at)
                else:
                    e = re.compile(rf"</{tag}[\s>/]", re.I).search(page, at)
                    if e is None:
                        break
                    close_at = page.find(">", e.start())
                    at = n if close_at < 0 else close_at + 1
            continue
        if tag == "br":
            parts.append(" ")
        elif tag == "a":
            in_link = 1  # links don't nest
        elif tag in INLINE or tag in VOID and tag != "hr":
            pass
        else:
            flush()
            if tag in CLOSES_P and "p" in stack:
                close(len(stack) - 1 - stack[::-1].index("p"))
            own = CLOSES_OWN.get(tag)
            if own:
                stop = BARRIER.get(tag, _TABLE)
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k] in stop:
                        break
                    if stack[k] in own:
                        close(k)
            if tag in HEADING or tag in SECTION:
                in_link = in_link if tag in HEADING else 0
            if tag != "hr" and not m.group(3).endswith("/"):
                serial += 1
                stack.append(tag)
                marks.append(element_features(tag, m.group(3)))
                ids.append(serial)
    flush()
    return out


def _end_of_head(page: str, at: int) -> int:
    """Where the head that began before `at` ends: after its end tag, or before the first tag of a body."""
    while True:
        m = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<!--.*?(?:-->|\Z)", re.S).search(page, at)
        if m is None:
            return len(page)
        tag = (m.group(2) or "").lower()
        if m.group(1) and tag == "head":
            return m.end()
        if tag and not m.group(1):
            if tag in ("script", "style", "title", "noscript", "template"):
                e = re.compile(rf"</{tag}[\s>/]", re.I).search(page, m.end())
                if e is None:
                    return len(page)
                at = page.find(">", e.start()) + 1 or len(page)
                continue
            if tag not in ("meta", "link", "base"):
                return m.start()
        at = m.end()


# --- the field ----------------------------------------------------------------------------------------

_SHAPES = 5


def text_features(b: Block, k: int, n: int) -> list[str]:
    t = b.text
    words = t.count(" ") + 1
    share = b.links / len(t)
    out = ["#", f"words{min(8, words.bit_length())}", f"link{0 if share == 0 else 1 if share < 0.4 else 2 if share < 0.8 else 3}", f"comma{min(3, t.count(','))}"]
    out.append("stop" if t[-1] in ".!?\"'”»…:" else "nostop")
    if "©" in t or "(c)" in t[:20].lower():
        out.append("copyright")
    if k == 0:
        out.append("first")
    if k == n - 1:
        out.append("last")
    if "|" in t or "·" in t or "»" in t or "›" in t:
        out.append("bars")
    if share < 0.4 and words > 12:
        out.append("prose")
    return out


def chain_features(chain: tuple[str, ...]) -> list[str]:
    """Features of a block's ancestors: all tags and words, the innermost element, the innermost section."""
    out: dict[str, None] = {}
    section = "none"
    for element in chain:
        tag, *words = element.split(" ")
        out[f"in:{tag}"] = None
        for w in words:
            out[f"word:{w}"] = None
        if tag in SECTION and tag != "div":
            section = tag
    if chain:
        out[f"own:{chain[-1].split(' ')[0]}"] = None
    out[f"section:{section}"] = None
    if not any(e.split(" ")[0] in ("article", "main") for e in chain):
        out["outside"] = None
    return list(out)


def tie(a: Block, b: Block) -> int:
    """How much of their ancestry two neighbours share: same parent, same grandparent, a section, or less."""
    p, q = a.path, b.path
    if p == q:
        return 0
    if p[:-1] == q[:-1]:
        return 1
    if len(p) > 2 and len(q) > 2 and p[:3] == q[:3]:
        return 2
    return 3


class Field:
    """Weights: one for each feature and label, and one for each tie and pair of labels."""

    def __init__(self, index: dict[str, int], emit: np.ndarray, step: np.ndarray):
        self.index, self.emit, self.step = index, emit, step
        self._chains: dict[tuple[str, ...], tuple[float, float]] = {}

    def ids(self, b: Block, k: int, n: int) -> list[int]:
        get = self.index.get
        return [i for i in map(get, [*chain_features(b.chain), *text_features(b, k, n)]) if i is not None]

    def scores(self, found: list[Block]) -> list[tuple[float, float]]:
        out, n = [], len(found)
        get, emit = self.index.get, self.emit
        for k, b in enumerate(found):
            known = self._chains.get(b.chain)
            if known is None:
                if len(self._chains) > 100_000:
                    self._chains.clear()
                at = [i for i in map(get, chain_features(b.chain)) if i is not None]
                known = self._chains[b.chain] = tuple(emit[at].sum(axis=0)) if at else (0.0, 0.0)
            x, y = known
            for f in text_features(b, k, n):
                i = get(f)
                if i is not None:
                    x += emit[i, 0]
                    y += emit[i, 1]
            out.append((x, y))
        return out

    def decode(self, found: list[Block]) -> list[bool]:
        """The likeliest labels of all blocks together."""
        if not found:
            return []
        e = self.scores(found)
        step = self.step.tolist()
        x, y = e[0]
        back = []
        for k in range(1, len(found)):
            (s00, s01), (s10, s11) = step[tie(found[k - 1], found[k])]
            a, b, c, d = x + s00, y + s10, x + s01, y + s11
            back.append((b > a, d > c))
            x, y = max(a, b) + e[k][0], max(c, d) + e[k][1]
        label = y > x
        out = [label]
        for to0, to1 in reversed(back):
            label = to1 if label else to0
            out.append(label)
        return out[::-1]


def _gradient(field: Field, at: list[list[int]], ties: list[int], labels: list[int]) -> Iterator[tuple[str, object, np.ndarray]]:
    """Observed minus expected counts of one page, by forward-backward."""
    n = len(at)
    e = np.array([field.emit[a].sum(axis=0) for a in at])
    f, b = np.zeros((n, 2)), np.zeros((n, 2))
    f[0] = e[0]
    for k in range(1, n):
        f[k] = e[k] + np.logaddexp(f[k - 1, 0] + field.step[ties[k - 1], 0], f[k - 1, 1] + field.step[ties[k - 1], 1])
    for k in range(n - 2, -1, -1):
        s = field.step[ties[k]] + (e[k + 1] + b[k + 1])[None, :]
        b[k] = np.logaddexp(s[:, 0], s[:, 1])
    z = np.logaddexp(*f[-1])
    p = np.exp(f + b - z)
    for k in range(n):
        g = -p[k]
        g[labels[k]] += 1
        yield "emit", at[k], g
    for k in range(1, n):
        g = -np.exp(f[k - 1][:, None] + field.step[ties[k - 1]] + (e[k] + b[k])[None, :] - z)
        g[labels[k - 1], labels[k]] += 1
        yield "step", ties[k - 1], g


def fit(pages: list[tuple[str, set[str]]], epochs: int = 12, rate: float = 0.3, shrink: float = 1e-3) -> Field:
    """A field from labelled pages: (html, texts of the blocks that are article)."""
    data, index = [], {}
    for page, article in pages:
        found = blocks(page)
        names = [[*chain_features(b.chain), *text_features(b, k, len(found))] for k, b in enumerate(found)]
        data.append((found, names, [int(b.text in article) for b in found]))
        for x in names:
            for f in x:
                index.setdefault(f, len(index))
    field = Field(index, np.zeros((len(index), 2)), np.zeros((4, 2, 2)))
    square = {"emit": np.full(field.emit.shape, 1e-6), "step": np.full(field.step.shape, 1e-6)}
    rng = random.Random(5)
    ready = [([[index[f] for f in x] for x in names], [tie(a, b) for a, b in zip(found[:-1], found[1:], strict=True)], labels) for found, names, labels in data if found]
    for _ in range(epochs):
        rng.shuffle(ready)
        for at, ties, labels in ready:
            for what, where, g in list(_gradient(field, at, ties, labels)):
                w, s = getattr(field, what), square[what]
                g = g - shrink * w[where]
                s[where] += g * g
                w[where] += rate * g / np.sqrt(s[where])
    return field


# --- labelled pages -----------------------------------------------------------------------------------

# Names that pages give to their parts.
NAMES = {
    "article": "content article post entry story body text main page single hentry article-body post-content entry-content story-body main-content".split(),
    "nav": "nav menu navbar navigation main-nav top-menu breadcrumb breadcrumbs pagination pager tabs site-nav toc skip".split(),
    "header": "header masthead site-header top branding logo banner topbar page-header".split(),
    "footer": "footer site-footer bottom colophon copyright legal credits page-footer".split(),
    "aside": "sidebar aside widget rail related recommended popular trending more teaser secondary right-column side".split(),
    "ad": "ad ads advert advertisement sponsored promo promotion banner-ad ad-slot adsbygoogle sponsor commercial".split(),
    "notice": "notice cookie cookies consent gdpr alert message warning popup modal overlay paywall newsletter-notice cookie-banner banner-notice disclaimer".split(),
    "form": "form search login signup subscribe newsletter contact search-form poll register".split(),
    "comments": "comments comment comment-list commentlist respond discussion replies reply disqus reader-comments responses thread".split(),
    "share": "share social sharing tools actions meta byline tags author-box toolbar".split(),
}
_SYLLABLES = "ka lo mi re tan dor vel sin pra ust qui ben zor hal fet gim nop wex yad cul".split()


def labelled_pages(n: int = 500, seed: int = 3) -> list[tuple[str, set[str]]]:
    """Pages of many layouts with words of no language, and the texts of their article blocks."""
    r = random.Random(seed)
    serial = 0

    def words(low: int, high: int, closed: bool = True) -> str:
        nonlocal serial
        serial += 1  # makes each block's text its own
        out = ["".join(r.choices(_SYLLABLES, k=r.randint(1, 3))) for _ in range(r.randint(low, high))]
        for k in range(4, len(out), 7):
            out[k] += r.choice((",", ".", "", ""))
        return (" ".join([f"w{serial}", *out])).capitalize() + (r.choice((".", ".", "!", "?")) if closed else "")

    def named(kind: str, tag: str, inside: str) -> str:
        how = r.random()
        name = r.choice(NAMES[kind])
        if how < 0.25 and tag not in ("div", "section"):
            return f"<{tag}>{inside}</{tag}>"
        attribute = r.choice(("class", "class", "id"))
        more = r.choice(("", "", " box", " clearfix", f" {kind}-wrap"))
        return f'<{tag} {attribute}="{name}{more}">{inside}</{tag}>'

    def links(k: int) -> str:
        return "<ul>" + "".join(f'<li><a href="/{i}">{words(0, 3, False)}</a></li>' for i in range(k)) + "</ul>"

    def part(kind: str) -> str:
        if kind == "nav":
            return named("nav", r.choice(("nav", "nav", "div")), links(r.randint(2, 9)) if r.random() < 0.8 else " ".join(f'<a href="/{i}">{words(0, 2, False)}</a>' for i in range(r.randint(2, 6))))
        if kind == "header":
            return named("header", r.choice(("header", "div")), (f"<h1>{words(0, 4, False)}</h1>" if r.random() < 0.3 else f'<a href="/">{words(0, 3, False)}</a>') + (f"<p>{words(2, 8)}</p>" if r.random() < 0.5 else ""))
        if kind == "footer":
            body = r.choice((f"&copy; {words(1, 6, False)} &middot; {words(2, 9)}", f"<p>© {words(1, 8)}</p>" + links(r.randint(0, 4)), f"<p>{words(5, 40)}</p>", words(2, 14)))
            return named("footer", r.choice(("footer", "footer", "div")), body)
        if kind == "aside":
            return named("aside", r.choice(("aside", "div", "section")), f"<h3>{words(0, 3, False)}</h3>" + r.choice((links(r.randint(2, 6)), f"<p>{words(4, 40)}</p>", f"<p>{words(4, 20)}</p><p>{words(4, 20)}</p>")))
        if kind == "ad":
            body = words(2, 25)
            return named("ad", r.choice(("div", "div", "aside", "section")), r.choice((body, f"<p>{body}</p>", f'<a href="/x">{body}</a>')))
        if kind == "notice":
            body = words(3, 30)
            return named("notice", r.choice(("div", "div", "section", "aside")), r.choice((body, f"<p>{body}</p>", f"<p>{body}</p><button>{words(0, 1, False)}</button>")))
        if kind == "form":
            return named("form", r.choice(("form", "form", "form", "div")), f"<label>{words(0, 4, False)}</label><input name=q><button>{words(0, 1, False)}</button>" + (f"<p>{words(3, 25)}</p>" if r.random() < 0.5 else ""))
        if kind == "comments":
            body = "".join(r.choice(("<li>{}</li>", "<p>{}</p>", "<div class=comment><p>{}</p></div>", "<div><b>{}</b></div>")).format(words(2, 50)) for _ in range(r.randint(1, 5)))
            return named("comments", r.choice(("section", "div", "ol", "aside")), (f"<h3>{words(0, 2, False)}</h3>" if r.random() < 0.6 else "") + body)
        return named("share", r.choice(("div", "ul", "p")), " ".join(f'<a href="#">{words(0, 1, False)}</a>' for _ in range(r.randint(1, 4))) if r.random() < 0.6 else words(1, 6, False))

    out = []
    for _ in range(n):
        article: list[str] = []

        def own(low: int, high: int, closed: bool = True, into: list[str] = article) -> str:
            t = words(low, high, closed)
            into.append(t)
            return t

        body = f"<h1>{own(1, 12, r.random() < 0.5)}</h1>" if r.random() < 0.85 else ""
        inner: list[str] = []
        for _ in range(r.choice((1, 2, 3, 4, 6, 10, 18))):
            how = r.random()
            if how < 0.62:
                inner.append(f"<p>{own(1, 70)}</p>")
            elif how < 0.70:
                inner.append(f"<p><b>{own(2, 30)}<br>")
            elif how < 0.78:
                inner.append(f"<h{r.choice('2234')}>{own(0, 7, False)}</h2>")
            elif how < 0.84:
                inner.append("<ul>" + "".join(f"<li>{own(2, 14)}</li>" for _ in range(r.randint(1, 4))) + "</ul>")
            elif how < 0.88:
                inner.append(f"<blockquote><p>{own(4, 30)}</p></blockquote>")
            elif how < 0.91:
                inner.append("<table><tr>" + "".join(f"<td>{own(0, 5, False)}</td>" for _ in range(3)) + "</tr></table>")
            elif how < 0.94:
                inner.append(f"<figure><img src=x><figcaption>{own(3, 15)}</figcaption></figure>")
            else:
                inner.append(f"<div>{own(5, 50)}</div>")
        if r.random() < 0.35:
            inner.insert(r.randint(0, len(inner)), part(r.choice(("ad", "ad", "aside", "share", "notice", "form", "nav"))))
        if r.random() < 0.12:
            inner.append(part("comments"))
        body += "".join(inner)
        how = r.random()
        if how < 0.55:
            body = f"<article>{body}</article>"
        elif how < 0.70:
            body = f"<main>{body}</main>"
        elif how < 0.92:
            body = named("article", r.choice(("div", "div", "section")), body)
        before = [part(k) for k in ("notice", "header", "nav", "ad", "form") if r.random() < 0.5]
        after = [part(k) for k in ("share", "aside", "comments", "ad", "form", "notice", "nav", "footer") if r.random() < 0.45]
        r.shuffle(before)
        if r.random() < 0.3:
            body = f'<div class="{r.choice(("wrap", "container", "layout", "page", "row"))}">{body}{"".join(after)}</div>'
            after = [part("footer")] if r.random() < 0.7 else []
        page = f"<!DOCTYPE html><html><head><title>{words(1, 9, False)}</title><script>var a='</p>';</script></head><body>{''.join(before)}{body}{''.join(after)}</body></html>"
        if r.random() < 0.1:
            page = page[: -r.randint(1, 40)]
        out.append((page, set(article)))
    return out


@functools.lru_cache(1)
def default_field() -> Field:
    """The field fitted on labelled_pages()."""
    return fit(labelled_pages())


def extract_text(page: str | None, field: Field) -> str:
    if not page:
        return ""
    found = blocks(page)
    return " ".join(b.text for b, keep in zip(found, field.decode(found), strict=True) if keep)


def extract(df: DataFrame, field: Field | None = None, html_column: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep's columns, text and n_chars, its code points, for every row of df. No shuffle."""
    field = field or default_field()
    frame = df.select(*keep, html_column)
    fields = {f.name: f for f in frame.schema.fields}
    schema = ", ".join([*(f"`{c}` {fields[c].dataType.simpleString()}" for c in keep), "text string, n_chars bigint"])
    sent = df.sparkSession.sparkContext.broadcast((field.index, field.emit, field.step))  # a few hundred weights

    @common.lean
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Field(*sent.value)
        for b in batches:
            for low in range(0, b.num_rows, 256):
                part = b.slice(low, 256)
                texts = [extract_text(x.as_py(), own) for x in part.column(len(keep))]
                yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(len(keep))), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return frame.mapInArrow(run, schema)

"""Main text of web pages by a tree-structured graphical model over DOM nodes.

Every element that forms a block, or carries a class, id or role, is a node with the label content
or boilerplate.  The label of a node depends on its parent's label and its own tag (the
parent-child potentials); its class, id and role words, the length of its own text, the share of
that text in links and its place (in, around or beside the page's <article> or <main>) depend on its
label.  Sum-product message passing, up from the leaves and down from the root, gives the marginal
of every node; text is kept where its node's marginal of content reaches one half.

Training counts labelled pages.  The hand-labelled ones below make a first model.  A bounded sample
of the table (``sample`` pages, default 400, by hash) that mark their article (an <article> or
<main> element) are labelled by it: what lies beside the article, or in a nav, aside, form, header,
footer, menu or dialog, is boilerplate, what is around it is not, and inside it the first model
says.  Both are counted together for the model that extracts.  No list of names decides anything.
Counting runs on the executors.  Extraction is a map over all rows.

Text: scripts, styles, titles, form controls, comments and head give none; formulas, drawings' labels,
<xmp> and the fallback of <noscript>, <object> and media are text like any other; character references are decoded;
white space inside a block becomes one space; blocks follow in page order, two line feeds between
them.  Parsing is linear in the page, whatever its tags are.

Defined cases: a null or empty page, or one without text, gives ""; very long pages are parsed and
judged whole; text without markup is one block; unclosed and crossed tags are closed as HTML's rules
for paragraphs, lists and tables say, unknown tags are inline; a marginal of exactly one half is
content; rows are never dropped, so rows that repeat and null ids stay; an empty table gives no
rows, and trains on the hand-labelled pages alone; columns called ``text`` or ``n_chars``, in any
case, are replaced, others stay.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from html import escape, unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import others, table

SAMPLE = 400
#: How often a hand-labelled page counts.
HAND_WEIGHT = 5

# fixed values: element names by their role in HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea select".split())
#: Labels in drawings and notes of formulas: white space sets them apart.
LABEL = frozenset("text annotation".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table caption tbody td tfoot th thead tr ul".split()
)
ENDS_P = BLOCK - frozenset("html body caption tbody td tfoot th thead tr li dd dt legend".split()) | frozenset(["li", "dd", "dt"])
#: Elements that come in any number and length; how long one is says nothing of what encloses it.
TEXT = frozenset("p li h1 h2 h3 h4 h5 h6 dt dd td th tr pre blockquote".split())
#: What an opening tag closes, and where the search for it ends.
CLOSES = {
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "tbody": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "thead": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
    "tfoot": (frozenset(["thead", "tbody", "tfoot"]), frozenset(["table"])),
}
P_SCOPE = frozenset("td th table caption button".split())
_P = frozenset(["p"])
DRAWN = frozenset(["svg", "math"])

#: A comment, a declaration, or a tag; quotes count in the value of an attribute only.
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+')|=)*+)(?:>|\Z)""", re.S)
_NAMED = re.compile(r"""(?:^|\s)(class|id|role|itemprop|data-y)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")


class Page(NamedTuple):
    """Nodes (parents before children) and blocks of (node, text) pieces."""

    tags: list[str]
    parents: list[int]
    words: list[tuple[str, ...]]
    marks: list[str | None]
    blocks: list[list[tuple[int, str]]]
    own: list[int]
    linked: list[int]


class _Stack:
    """Open elements, with the places of each name and of all blocks, so that nothing is searched for."""

    def __init__(self) -> None:
        self.items: list[tuple[str, int]] = [("#root", 0)]
        self.places: defaultdict[str, list[int]] = defaultdict(list)
        self.blocks: list[int] = []

    def push(self, tag: str, node: int) -> None:
        self.places[tag].append(len(self.items))
        if tag in BLOCK:
            self.blocks.append(len(self.items))
        self.items.append((tag, node))

    def pop(self) -> str:
        tag, _ = self.items.pop()
        self.places[tag].pop()
        if tag in BLOCK:
            self.blocks.pop()
        return tag

    def top(self, names: Iterable[str]) -> int:
        """The innermost open element of some names, or 0."""
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=0)


def parse(html: str) -> Page:
    """One pass over the tags; elements that are no nodes lend their text to the node around them."""
    page = Page(["#root"], [-1], [()], [None], [], [0], [0])
    stack = _Stack()
    piece: list[tuple[int, str]] = []
    links = 0
    at, end = 0, len(html)
    never: set[str] = set()  # elements whose end does not come any more

    def say(text: str) -> None:
        if text:
            node = stack.items[-1][1]
            piece.append((node, text))
            n = len(text) - text.count(" ")
            page.own[node] += n
            if links:
                page.linked[node] += n

    def flush() -> None:
        nonlocal piece
        if piece:
            page.blocks.append(piece)
            piece = []

    def pop_to(k: int) -> None:
        nonlocal links
        while len(stack.items) > k:
            tag = stack.pop()
            links -= tag == "a"
            if tag in BLOCK:
                flush()

    def close(names: frozenset, stop: frozenset) -> None:
        k = stack.top(names)
        if k > stack.top(stop):
            pop_to(k)

    def find(name: str, pattern: str) -> re.Match | None:
        over = None if name in never else re.compile(pattern, re.I).search(html, at)
        if not over:
            never.add(name)
        return over

    while at < end:
        found = _TOKEN.search(html, at)
        if not found:
            say(html[at:])
            break
        say(html[at : found.start()])
        at = found.end()
        if not found[2]:
            continue
        tag = found[2].lower()
        if found[1]:
            k = stack.top((tag,))
            if k and (tag in BLOCK or k > (stack.blocks[-1] if stack.blocks else 0)):  # an inline end stays in its block
                pop_to(k)
            continue
        if tag in VOID:
            if tag in BLOCK:
                flush()
            elif tag == "br" and piece:
                piece.append((stack.items[-1][1], " "))
            continue
        attributes = found[3] or ""
        if tag in RAW or tag == "xmp":
            over = find(tag, rf"</{tag}(?=[\s/>])[^>]*>?")
            if tag == "xmp" and over:  # its markup is text
                piece.append((stack.items[-1][1], " "))
                say(escape(html[at : over.start()]))
                piece.append((stack.items[-1][1], " "))
            if over or tag in ("script", "style"):  # others that are not closed hide nothing
                at = over.end() if over else end
            continue
        if tag not in BLOCK and attributes.rstrip().endswith("/") and (tag in DRAWN or stack.top(DRAWN)):
            continue  # drawings and formulas have elements that close themselves
        if tag in LABEL:
            piece.append((stack.items[-1][1], " "))
        if tag in ENDS_P:
            close(_P, P_SCOPE)
        if tag in CLOSES:
            close(*CLOSES[tag])
        if tag == "head":
            over = find(tag, r"</head\s*>|<body\b")
            if over:
                at = over.end() if over[0].startswith("</") else over.start()
                continue
        if tag in BLOCK:
            flush()
        named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _NAMED.finditer(attributes)} if "=" in attributes else {}
        if tag in BLOCK or named:
            mark = named.pop("data-y", None)
            page.tags.append(tag)
            page.parents.append(stack.items[-1][1])
            page.words.append(tuple(sorted({w for v in named.values() for w in _WORD.findall(v.lower())})))
            page.marks.append(mark)
            page.own.append(0)
            page.linked.append(0)
            node = len(page.tags) - 1
        else:
            node = stack.items[-1][1]
        links += tag == "a"
        stack.push(tag, node)
    pop_to(1)
    flush()
    return page


MAIN = frozenset(["article", "main"])


def places(page: Page) -> list[str]:
    """Where each node lies: in, around or beside the page's articles; alone if it has none."""
    n = len(page.tags)
    if MAIN.isdisjoint(page.tags):
        return ["alone"] * n
    out = ["beside"] * n
    for i in range(1, n):
        if page.tags[i] in MAIN or out[page.parents[i]] == "in":
            out[i] = "in"
    for i in range(n - 1, 0, -1):
        k = page.parents[i]
        if out[i] != "beside" and out[k] == "beside":
            out[k] = "around"
    return out


def _traits(page: Page, i: int) -> tuple[str, str]:
    """Length of a node's own text and the share of it in links, coarsely."""
    n = page.own[i]
    length = "none" if not n else "short" if n < 25 else "line" if n < 100 else "long"
    share = page.linked[i] / n if n else 0
    if page.tags[i] in TEXT:
        length = "any"
    return f"len:{length}", f"link:{'none' if not share else 'some' if share < 0.5 else 'most'}"


def _evidence(page: Page, i: int, where: list[str]) -> list[str]:
    """Traits of a node; its place says more than its parent's label only where it differs from the parent's."""
    words, place = page.words[i], where[i]
    own = [f"place:{place}"] if place != where[page.parents[i]] else []
    return [*_traits(page, i), *(f"word:{w}" for w in words), *own]


def _kind(page: Page, i: int, where: list[str]) -> str:
    """The tag, apart for elements with names of their own and for those in an article."""
    return page.tags[i] + "." * bool(page.words[i]) + "@" * (where[i] == "in")


class Model(NamedTuple):
    edge: dict[tuple[str, int], float]  # (tag, parent's label): log odds of content
    trait: dict[str, float]  # log P(trait | content) - log P(trait | boilerplate)


def count(page: Page, labels: list[int], weight: int = 1) -> Counter:
    """What training needs of a labelled page."""
    found: Counter = Counter()
    where = places(page)
    for i in range(1, len(page.tags)):
        y, up = labels[i], labels[page.parents[i]]
        found["edge", _kind(page, i, where), up, y] += weight
        found["edge", "*", up, y] += weight
        for trait in _evidence(page, i, where):
            found["trait", trait, 0, y] += weight
    return found


def hand_labels(page: Page) -> list[int]:
    """Labels from data-y marks: a mark holds for the subtree, the root is content."""
    out = [1]
    for mark, parent in zip(page.marks[1:], page.parents[1:], strict=True):
        out.append(out[parent] if mark is None else int(mark))
    return out


#: Elements that HTML has for what is no main text (fixed values).
ASIDE = frozenset("nav aside form header footer dialog menu".split())


def self_labels(page: Page, first: Model) -> list[int] | None:
    """Labels of a page that marks its article, by ``first`` inside it; None if it does not."""
    where = places(page)
    if "in" not in where:
        return None
    guess, out = marginals(page, first), [1]
    for i in range(1, len(page.tags)):
        inside = out[page.parents[i]] == 1 and (page.tags[i] in MAIN or page.tags[i] not in ASIDE and guess[i] >= 0.5)
        out.append(int(where[i] == "around" or where[i] == "in" and (inside or page.tags[i] in MAIN)))
    return out


def estimate(counts: Counter) -> Model:
    """Potentials with additive smoothing; a tag's edges lean on those of all tags."""
    edge: dict[tuple[str, int], float] = {}
    tags = {k[1] for k in counts if k[0] == "edge"}
    for up in (0, 1):
        every = [counts["edge", "*", up, y] + 1 for y in (0, 1)]
        prior = every[1] / sum(every)
        for tag in tags:
            n = [counts["edge", tag, up, y] for y in (0, 1)]
            edge[tag, up] = math.log((n[1] + 2 * prior) / (n[0] + 2 * (1 - prior)))
    total = [1 + sum(v for k, v in counts.items() if k[0] == "edge" and k[1] == "*" and k[3] == y) for y in (0, 1)]
    trait = {}
    for name in {k[1] for k in counts if k[0] == "trait"}:
        n = [counts["trait", name, 0, y] for y in (0, 1)]
        trait[name] = math.log((n[1] + 1) / (total[1] + 2)) - math.log((n[0] + 1) / (total[0] + 2))
    return Model(edge, trait)


def marginals(page: Page, model: Model) -> list[float]:
    """P(content) of every node by sum-product, up and then down the tree."""
    n, where = len(page.tags), places(page)
    given = []  # P(content | parent's label), for both labels
    up0, up1 = [1.0] * n, [1.0] * n  # evidence below and at each node
    for i in range(n):
        tag = _kind(page, i, where)
        p = [1 / (1 + math.exp(-model.edge.get((tag, y), model.edge.get(("*", y), 0.0)))) for y in (0, 1)]
        given.append(p)
        if i:
            odds = max(-30.0, min(30.0, sum(model.trait.get(t, 0.0) for t in _evidence(page, i, where))))
            up1[i], up0[i] = 1 / (1 + math.exp(-odds)), 1 / (1 + math.exp(odds))
    to0, to1 = [1.0] * n, [1.0] * n  # message of each node to its parent
    for i in range(n - 1, 0, -1):
        s = up0[i] + up1[i]
        a, b = up0[i] / s, up1[i] / s
        up0[i], up1[i] = a, b
        q0, q1 = given[i]
        to0[i], to1[i] = (1 - q0) * a + q0 * b, (1 - q1) * a + q1 * b
        k = page.parents[i]
        x, y = up0[k] * to0[i], up1[k] * to1[i]
        up0[k], up1[k] = x / (x + y), y / (x + y)
    out = [1.0] * n  # the root is content
    for i in range(1, n):
        k = page.parents[i]
        p0, p1 = (1 - out[k]) / to0[i], out[k] / to1[i]  # the parent without this child's message
        q0, q1 = given[i]
        c = (p0 * q0 + p1 * q1) * up1[i]
        b = (p0 * (1 - q0) + p1 * (1 - q1)) * up0[i]
        out[i] = c / (c + b)
    return out


def extract_text(html: str | None, model: Model) -> str:
    if not html:
        return ""
    page = parse(html)
    keep = marginals(page, model)
    blocks = []
    for pieces in page.blocks:
        text = " ".join(unescape("".join(t for node, t in pieces if keep[node] >= 0.5)).split())
        if text:
            blocks.append(text)
    return "\n\n".join(blocks)


def _sentence(n: int) -> str:
    return "The words of a paragraph go on until its end, and then the next begins. " * n


#: Names that the labelled pages below give to elements that are no main text, and to parts of the text (fixed values).
BESIDE = (
    "ads", "adv", "advertisement", "advertising", "sponsor", "promo", "promotion", "navbar", "nav", "navigation", "menu", "menubar", "breadcrumbs", "sidebar", "widget", "widgets", "recommended", "trending", "masthead", "toolbar",
    "commentlist", "comment", "reply", "replies", "respond", "discussion", "feedback", "cookies", "cookie", "consent", "gdpr", "notices", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "login",
    "signin", "register", "form", "search", "searchbox", "sharing", "follow", "pagination", "pager", "copyright", "legal", "disclaimer", "footer", "header", "topbar", "bottom", "skip", "complementary", "contentinfo",
)
PARTS = ("intro", "lead", "note", "side note", "quote", "figure", "summary", "chapter", "part", "box", "example", "code", "tags", "text", "entry", "body", "story", "post")


def hand_labelled() -> list[str]:
    """Small pages of common make, with data-y marks: 0 boilerplate, 1 content; they hold for what is inside."""
    links = "".join(f'<li><a href="/{i}">Section {i}</a></li>' for i in range(5))
    paragraphs = "".join(f"<p>{_sentence(k)}</p>" for k in (2, 1, 3, 1, 2))
    boiler = [
        f'<nav data-y="0"><ul>{links}</ul></nav>',
        f'<div class="menu" data-y="0"><ul>{links}</ul></div>',
        f'<ul id="navigation" data-y="0">{links}</ul>',
        f'<header data-y="0"><h1>Name of the site</h1><p>What the site is about</p><ul>{links}</ul></header>',
        '<div id="header" data-y="0"><div class="logo">Site</div><p>What it is about, in a line or so.</p></div>',
        f'<footer data-y="0"><p>Copyright of the owner, all rights reserved.</p><ul>{links}</ul></footer>',
        '<footer data-y="0">Copyright of the owner.</footer>',
        '<div class="footer" data-y="0"><p>Imprint and privacy</p><p>Owner and address of the site.</p></div>',
        f'<aside data-y="0"><h3>Related</h3><p>{_sentence(1)}</p><ul>{links}</ul></aside>',
        f'<div class="sidebar" data-y="0"><h3>More</h3><p>{_sentence(1)}</p><ul>{links}</ul></div>',
        '<div class="ad" data-y="0">Buy what we sell, it is very good.</div>',
        f'<div class="advert sponsored" data-y="0"><p>{_sentence(1)}</p></div>',
        f'<div class="cookie notice" data-y="0"><p>{_sentence(1)}</p><p>Accept</p></div>',
        '<div role="alert" class="banner" data-y="0"><p>We use cookies on this site.</p></div>',
        '<form action="/s" data-y="0"><fieldset><legend>Search</legend><p>Your words</p><div>Send</div></fieldset></form>',
        '<form class="newsletter signup" data-y="0"><h3>Subscribe</h3><p>Get our letter every week.</p></form>',
        f'<section class="comments" data-y="0"><h2>Comments</h2><div class="comment"><p>{_sentence(2)}</p></div><div class="comment"><p>{_sentence(1)}</p></div></section>',
        f'<div id="comments" data-y="0"><h3>3 replies</h3><ol><li><p>{_sentence(1)}</p></li><li><p>{_sentence(3)}</p></li></ol></div>',
        f'<ul class="comments" data-y="0"><li>{_sentence(1)}</li><li>{_sentence(2)}</li></ul>',
        '<div class="share social" data-y="0"><a href="/1">Share</a> <a href="/2">Send</a></div>',
        f'<div class="related" data-y="0"><h4>Read on</h4><ul>{links}</ul></div>',
        '<div class="breadcrumb" data-y="0"><a href="/">Home</a> <a href="/a">News</a></div>',
    ]
    for k, name in enumerate(BESIDE):  # as a class or an id, of a few makes
        inner = (f"<p>{_sentence(1)}</p>", f"<ul>{links}</ul>", "Some words of it.", f"<h3>Title</h3><p>{_sentence(1)}</p><p>More</p>")[k % 4]
        boiler.append(f'<{("div", "section")[k % 2]} {("class", "id")[k // 2 % 2]}="{name}" data-y="0">{inner}</{("div", "section")[k % 2]}>')
    body = [
        f"<article><h1>What the page is about</h1>{paragraphs}<h2>A part of it</h2>{paragraphs}</article>",
        f"<main><h1>What the page is about</h1>{paragraphs}<ul><li>{_sentence(1)}</li><li>A short point</li></ul></main>",
        f'<div id="content"><h1>Title</h1><div class="text">{paragraphs}<blockquote><p>{_sentence(1)}</p></blockquote></div></div>',
        f'<main><article class="post"><h1>Title</h1><section><h2>Part</h2>{paragraphs}</section><table><tr><td>A cell</td><td>Another</td></tr></table></article></main>',
        f'<div class="article body"><h2>Title</h2>{paragraphs}<pre>some lines of code</pre><p>End.</p></div>',
        f"<h1>Title</h1>{paragraphs}<p>Short.</p>",
        f"<div><div><div><h1>Title</h1><div><div>{paragraphs}</div></div><div>A piece of text.</div></div></div></div>",
        f"<article><div><div><section><div><h2>Part</h2></div><div><div><div>{paragraphs}</div></div></div></section></div></div></article>",
    ]
    for k, name in enumerate(PARTS):
        part = (f"<p>{_sentence(1)}</p>", f"{_sentence(1)}", f"<h3>Part</h3><p>{_sentence(2)}</p>", "Short.")[k % 4]
        tag = ("div", "section", "blockquote")[k % 3]
        whole = f'<h1>Title</h1>{paragraphs}<{tag} {("class", "id")[k % 2]}="{name}">{part}</{tag}>{paragraphs}<div class="{PARTS[k - 1]}">{part}</div>'
        body += [f"<article>{whole}</article>", f'<div class="content">{whole}</div>']
    pages = []
    for k, content in enumerate(body):
        for i in range(k % 5 * 4, len(boiler), 20):
            some = boiler[i : i + 4]
            before, after = some[: 1 + k % 3], some[1 + k % 3 :]
            pages.append(f"<html><body>{''.join(before)}{content}{''.join(after)}</body></html>")
        inner = boiler[(3 * k) % len(boiler)] + boiler[(3 * k + 11) % len(boiler)]
        pages.append(f"<html><body>{content.replace('</p><p>', '</p>' + inner + '<p>', 1)}</body></html>")
    return pages


def hand_counts(pages: Iterable[str]) -> Counter:
    counts: Counter = Counter()
    for text in pages:
        page = parse(text)
        counts += count(page, hand_labels(page), HAND_WEIGHT)
    return counts


def measure(pages: Iterable[str], model: Model) -> tuple[float, float]:
    """Precision and recall of the characters that the model keeps of pages with data-y marks."""
    kept = right = wanted = 0
    for text in pages:
        page = parse(text)
        labels, keep = hand_labels(page), marginals(page, model)
        for i, n in enumerate(page.own):
            kept += n * (keep[i] >= 0.5)
            wanted += n * labels[i]
            right += n * (keep[i] >= 0.5) * labels[i]
    return right / max(kept, 1), right / max(wanted, 1)


def train(pages: DataFrame, html: str = "html", sample: int = SAMPLE) -> Model:
    """Count the hand-labelled pages, and those of a bounded sample of the table that mark their article."""
    rows = pages.select(F.xxhash64(html).alias("h"), F.col(html).alias("html")).where("html is not null")
    cut = rows.select("h").distinct().orderBy("h").limit(sample).agg(F.max("h")).first()[0]
    counts = hand_counts(hand_labelled())
    first = estimate(counts)
    if cut is not None:

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            found: Counter = Counter()
            for batch in batches:
                for text in batch.column(0).to_pylist():
                    page = parse(text)
                    if labels := self_labels(page, first):
                        found += count(page, labels)
            keys = list(found)
            columns = [[k[i] for k in keys] for i in range(4)]
            types = (pa.string(), pa.string(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([*(pa.array(c, t) for c, t in zip(columns, types, strict=True)), pa.array([found[k] for k in keys], pa.int64())], ["kind", "name", "up", "y", "n"])

        chosen = rows.where(F.col("h") <= cut).groupBy("h").agg(F.min("html").alias("html")).select("html")
        sums = chosen.mapInArrow(run, "kind string, name string, up int, y int, n long").groupBy("kind", "name", "up", "y").agg(F.sum("n").alias("n"))
        for r in sums.collect():  # as many as the sample's tags and words
            counts[r["kind"], r["name"], r["up"], r["y"]] += r["n"]
    return estimate(counts)


def extract(pages: DataFrame, model: Model, html: str = "html") -> DataFrame:
    """Add text and n_chars (code points) to every row."""
    sent = pages.sparkSession.sparkContext.broadcast(model)  # a number for each tag and word of the sample
    keep = others(pages.columns, "text", "n_chars")
    schema = T.StructType([pages.schema[c] for c in keep] + [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [extract_text(h, sent.value) for h in part.column(part.schema.get_field_index(html)).to_pylist()]
                cols = [part.column(part.schema.get_field_index(c)) for c in keep]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [*keep, "text", "n_chars"])

    return pages.mapInArrow(run, schema)


def op7_dom_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages, train(pages)).drop("html")


QUERIES = {"op7_dom_model": op7_dom_model}
ORACLES: dict[str, str] = {}

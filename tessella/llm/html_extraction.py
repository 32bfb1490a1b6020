"""Main text of web pages by a tree-structured graphical model.

A page is parsed into its tree of elements. Every element has a hidden label, content or not. A label depends on the parent's
label through a potential that is learned for each kind of element, and on the element's own observations (tag, words of
class, id and role, text length, link share, text marks). Sum-product messages pass from the leaves to the root and back, which
gives each element's exact marginal. Text belongs to the element that directly holds it, and is kept where that element is
more likely content than not.

The potentials are counts, smoothed, over labelled pages. Labelled pages come as (html, marked elements); `labelled_pages`
writes some from a grammar of common page layouts, so nothing has to be annotated or downloaded.

Defined results. A null or empty page, and one without content, gives the empty text. Broken markup is read as far as it
goes: unclosed elements end with their parent, stray end tags are ignored, an unclosed script, style or comment runs to the
end, an unclosed drawing is passed over. A quote in an attribute counts after its equals sign only. What stands in a script, style or another raw element isn't markup; the element ends at the next end tag of its name. Text
outside any element stands in a body of its own. Hidden elements are no content. Pages are read whole; repeated rows give equal texts; an empty table gives an empty
result; extra columns are not read.
"""

from __future__ import annotations

import html
import math
import random
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import table

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|$)|<([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*(?:\"|$)|=\s*'[^']*(?:'|$)|=)*)(?:>|$)|[^<]+|<", re.S)
NAMED = re.compile(r"""\b(class|id|role|style|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
PARTS = re.compile(r"[a-z]+")
SPACE = re.compile(r"\s+")

#: Elements without content of their own; elements whose content is not markup; elements inside a line of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg annotation annotation-xml xmp noembed noframes".split())
#: The end tags of the elements whose content is not markup.
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I) for tag in RAW}
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr math mfrac mi mn mo mroot mrow ms msqrt mstyle msub msubsup msup mtext munder munderover mover semantics".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of these kinds (as HTML's optional end tags do).
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Where the search for such an element stops.
SCOPE = frozenset("ul ol dl table body html article section div main nav aside header footer form select blockquote".split())


@dataclass
class Node:
    tag: str
    parent: int
    words: tuple[str, ...] = ()
    #: Pieces of direct text, each with its place in the page.
    texts: list[tuple[int, str]] = field(default_factory=list)
    linked: int = 0


def parse(page: str) -> tuple[list[Node], list[tuple[int, str | None]]]:
    """Block elements in page order (parents first; 0 is the root), and the page's flow: (element, text), with None where a
    block or line begins or ends. Inline elements add their text to the block they stand in."""
    nodes, flow = [Node("#root", -1)], []
    stack, links, tokens = [(0, "#root")], 0, TOKEN.finditer(page)
    while m := next(tokens, None):
        end, start = m[1], m[2]
        if start:
            tag = start.lower()
            if tag == "br":
                flow.append((stack[-1][0], None))
                continue
            if tag in RAW:
                if not m[0].endswith("/>"):
                    ended = RAW_END[tag].search(page, m.end())
                    if tag == "svg" and not ended:
                        continue  # markup that follows ends an unclosed drawing
                    tokens = TOKEN.finditer(page, ended.end() if ended else len(page))
                continue
            if tag in VOID:
                continue
            if tag in INLINE:
                links += tag == "a"
                stack.append((stack[-1][0], tag))
                continue
            # a block ends an open paragraph or heading line, with the inline elements in it
            for k in range(len(stack) - 1, 0, -1):
                own = stack[k][1]
                if own == "p" or own in CLOSES.get(tag, ()):
                    links -= sum(x[1] == "a" for x in stack[k:])
                    del stack[k:]
                    break
                if own in SCOPE:
                    break
            named = " ".join(f"{x[0]} " if x[0] in ("hidden",) else next(filter(None, x[1:]), "") for x in NAMED.findall(m[3])).lower() if m[3] else ""
            nodes.append(Node(tag, stack[-1][0], tuple(dict.fromkeys(PARTS.findall(named)))))
            stack.append((len(nodes) - 1, tag))
            flow.append((len(nodes) - 1, None))
        elif end:
            tag = end.lower()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][1] == tag:
                    links -= sum(x[1] == "a" for x in stack[k:])
                    if tag not in INLINE:
                        flow.append((stack[k - 1][0], None))
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][1] not in INLINE:
                    break
        elif m[0][0] != "<" or len(m[0]) == 1:
            if len(stack) == 1 and not m[0].isspace():  # text outside any element stands in a body of its own
                nodes.append(Node("body", 0))
                stack.append((len(nodes) - 1, "body"))
                flow.append((len(nodes) - 1, None))
            at = stack[-1][0]
            flow.append((at, m[0]))
            node = nodes[at]
            node.texts.append((len(flow), m[0]))
            if links > 0:
                node.linked += len(m[0].strip())
    return nodes, flow


def observations(node: Node, kids: int) -> list[str]:
    """What the model sees of an element."""
    text = " ".join(x for _, x in node.texts).strip() if node.texts else ""
    size = len(text)
    share = node.linked / size if size else 0.0
    seen = [
        f"tag={node.tag}", f"size={min(int(math.log2(size + 1)), 9) // 2 if size else -1}", f"links{':li' if node.tag == 'li' else ''}={int(share * 2.999) if size else -1}",
        f"stop={text[-1] in '.!?:' if size else '-'}", f"kids={min(kids, 3)}",
    ]
    if "&copy;" in text or "©" in text:
        seen.append("sign")
    return seen + [f"word={w}" for w in node.words]


@dataclass
class Model:
    """Log potentials: pair[kind][parent label][label], emit[observation] = (not content, content)."""

    pair: dict[str, list[list[float]]]
    emit: dict[str, tuple[float, float]]
    root: tuple[float, float] = (0.0, -3.0)

    def kind(self, tag: str) -> list[list[float]]:
        return self.pair.get(tag) or self.pair["*"]

    def marginals(self, nodes: list[Node]) -> list[float]:
        """The probability of content for each element: messages upward, then downward."""
        n = len(nodes)
        kids = [0] * n
        for x in nodes[1:]:
            kids[x.parent] += 1
        up: list[list[float]] = []
        for i, x in enumerate(nodes):
            a = b = 0.0
            if i:
                for o in observations(x, kids[i]):
                    e = self.emit.get(o)
                    if e:
                        a += e[0]
                        b += e[1]
            else:
                a, b = self.root
            up.append([a, b])
        sent: list[tuple[float, float]] = [(0.0, 0.0)] * n
        for i in range(n - 1, 0, -1):  # parents come first in the list, so children are done
            pair, (a, b), parent = self.kind(nodes[i].tag), up[i], up[nodes[i].parent]
            sent[i] = (joined(pair[0][0] + a, pair[0][1] + b), joined(pair[1][0] + a, pair[1][1] + b))
            parent[0] += sent[i][0]
            parent[1] += sent[i][1]
        down: list[tuple[float, float]] = [(0.0, 0.0)] * n
        out = []
        for i, x in enumerate(nodes):
            if i:
                pair, p = self.kind(x.tag), x.parent
                a = down[p][0] + up[p][0] - sent[i][0]
                b = down[p][1] + up[p][1] - sent[i][1]
                down[i] = (joined(a + pair[0][0], b + pair[1][0]), joined(a + pair[0][1], b + pair[1][1]))
            gap = down[i][0] + up[i][0] - down[i][1] - up[i][1]
            out.append(1 / (1 + math.exp(max(-700.0, min(700.0, gap)))))
        return out

    def extract(self, page: str | None, least: float = 0.5) -> str:
        """The page's content: character references decoded, white space folded, blocks joined by one space."""
        if not page:
            return ""
        nodes, flow = parse(page)
        likely = self.marginals(nodes)
        blocks, own = [], []
        for at, text in flow:
            if text is None:
                if own:
                    blocks.append("".join(own))
                    own = []
            elif likely[at] >= least:
                own.append(text)
        if own:
            blocks.append("".join(own))
        return " ".join(filter(None, (SPACE.sub(" ", html.unescape(b)).strip() for b in blocks)))


def joined(a: float, b: float) -> float:
    """log(exp(a) + exp(b))."""
    return a + math.log1p(math.exp(b - a)) if a > b else b + math.log1p(math.exp(a - b))


def train(pages: list[tuple[str, set[int]]], smoothing: float = 0.5) -> Model:
    """Potentials from pages with the numbers of their content elements (in parse order; 0, the root, where the content has no element
    of its own)."""
    pairs: dict[str, list[list[float]]] = defaultdict(lambda: [[smoothing, smoothing], [smoothing, smoothing]])
    seen, labels, roots = defaultdict(lambda: [0.0, 0.0]), [0.0, 0.0], [smoothing, smoothing]
    for page, content in pages:
        roots[0 in content] += 1
        nodes, _ = parse(page)
        kids = Counter(x.parent for x in nodes[1:])
        for i, x in enumerate(nodes[1:], 1):
            own, above = i in content, x.parent in content
            for kind in (x.tag, "*"):
                pairs[kind][above][own] += 1
            labels[own] += 1
            for o in observations(x, kids[i]):
                seen[o][own] += 1
    # what is seen of the text itself says much the same several times over, so each of these counts in part; items of lists are linked in
    # menus and in references alike, so their links are taken among items
    emit: dict[str, tuple[float, float]] = {}
    for o, cs in list(seen.items()):
        weight, among = 0.4 if o.startswith(("size", "links", "stop", "kids")) else 1.0, seen["tag=li"] if o.startswith("links:li") else labels
        emit[o] = tuple(weight * math.log((c + smoothing) / (n + 2 * smoothing)) for c, n in zip(cs, among, strict=True))
    pair = {k: [[math.log(c / sum(row)) for c in row] for row in rows] for k, rows in pairs.items()}
    return Model(pair, emit, (math.log(roots[0] / sum(roots)), math.log(roots[1] / sum(roots))))


def labelled_pages(count: int = 900, seed: int = 5) -> list[tuple[str, set[int]]]:
    """Pages written from a grammar of layouts, each with its content elements: an article (or main, section or div) with
    headings, paragraphs, lists, quotes and tables, or text and divs alone, among menus, headers, footers, sidebars, notices, adverts, forms and
    reader comments that stand before, after and inside it. On about half the pages the article has no element of its own."""
    rng = random.Random(seed)
    marked = "\x01"

    def words(low: int, high: int) -> str:
        return " ".join("".join(rng.choice("aeioustnrlm") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(low, high)))

    def prose(low: int, high: int) -> str:
        text = words(low, high).capitalize() + rng.choice(("." , ".", ".", ",", "", ".***", ".%%%"))
        return re.sub(r" (\w+) ", lambda m: f" <{t}>{m[1]}</{t}> " if rng.random() < 0.02 and (t := rng.choice(("a href='/x'", "b", "em", "strong", "code"))) and " " not in t else m[0], text)

    def links(tag: str, n: int) -> str:
        return "".join(f"<{tag}><a href='/{k}'>{words(1, 3)}</a></{tag}>" for k in range(n))

    def named(tag: str, *names: str) -> str:
        return f'<{tag} {rng.choice(("class", "id", "class"))}="{rng.choice(names)}">'

    def menu() -> str:
        body = f"<ul>{links('li', rng.randint(2, 9))}</ul>"
        return rng.choice((f"<nav>{body}</nav>", f"{named('nav', 'menu', 'nav', 'breadcrumb')}{body}</nav>", f"{named('div', 'menu', 'navbar', 'nav', 'breadcrumbs', 'topnav', 'toc', 'pagination')}{body}</div>"))

    def header() -> str:
        return rng.choice((f"<header><h1>{words(1, 4)}</h1><p>{prose(2, 9)}</p></header>", f"{named('div', 'header', 'site-header', 'masthead', 'banner', 'logo')}{words(1, 5)}</div>", f"<header>{menu()}<p>{prose(2, 8)}</p></header>"))

    def footer() -> str:
        body = rng.choice(("&copy; ", "", "&copy; ")) + f"{words(1, 4)} &middot; {prose(3, 14)}"
        return rng.choice((f"<footer>{body}</footer>", f"<footer><p>{body}</p></footer>", f"{named('div', 'footer', 'site-footer', 'copyright', 'legal')}<p>{body}</p></div>"))

    def advert() -> str:
        body = rng.choice((prose(4, 25), f"<p>{prose(4, 25)}</p>", f"<a href='/buy'>{prose(3, 9)}</a>"))
        return rng.choice(("<!-- ad -->", "")) + rng.choice((f"{named('div', 'ad', 'ads', 'advert', 'advertisement', 'sponsored', 'promo', 'ad-slot banner', 'sponsor')}{body}</div>", f"{named('aside', 'ad', 'promo', 'sponsored')}{body}</aside>"))

    def sidebar() -> str:
        body = f"<h{(h := rng.randint(2, 4))}>{words(1, 3)}</h{h}>" + rng.choice((f"<ul>{links('li', rng.randint(2, 6))}</ul>", f"<p>{prose(4, 30)}</p>", f"<p>{prose(4, 20)}</p><p>{prose(4, 20)}</p>"))
        return rng.choice((f"<aside>{body}</aside>", f"{named('div', 'sidebar', 'related', 'widget', 'recommended', 'side', 'share', 'social', 'popular', 'more', 'tags')}{body}</div>", f"{named('aside', 'sidebar', 'related')}{body}</aside>", f"{named('section', 'related', 'sidebar')}{body}</section>"))

    def notice() -> str:
        body = rng.choice((f"<p>{prose(4, 30)}</p>", prose(4, 30), f"<p>{prose(4, 20)}</p><button>{words(1, 2)}</button>"))
        tag = rng.choice(("div", "div", "section", "aside"))
        return f"{named(tag, 'cookie', 'cookie-banner', 'notice', 'consent', 'gdpr', 'alert', 'popup', 'modal', 'newsletter', 'subscribe', 'paywall', 'disclaimer')}{body}</{tag}>"

    def form() -> str:
        return f"<form action='/s'><label>{words(1, 4)}</label><input name='q'><p>{prose(2, 12)}</p><select><option>{words(1, 2)}<option>{words(1, 2)}</select><button>{words(1, 2)}</button></form>"

    def comments() -> str:
        tag, part = rng.choice(("section", "div", "ol", "div")), rng.choice(("div", "div", "div", "article", "li", "li", "p", "p"))
        inner = "".join(f"{named(part, 'comment', 'reply', 'comment-body')}" + (f"{words(1, 2)}" if part == "p" else f"<p>{prose(4, 50)}</p><p>{prose(4, 30)}</p>") + f"</{part}>" for _ in range(rng.randint(1, 4)))
        return f"{named(tag, 'comments', 'comment-list', 'discussion', 'responses', 'replies', 'disqus')}<h{(h := rng.randint(2, 4))}>{words(1, 3)}</h{h}>{inner}</{tag}>"

    def around() -> str:
        return rng.choice((menu, header, footer, advert, sidebar, notice, form, comments, advert, sidebar))()

    def block() -> str:
        """A paragraph that isn't a p."""
        inner = prose(4, 120 if rng.random() < 0.7 else 12)
        inner = f"<span>{inner}</span>" if rng.random() < 0.15 else inner
        return f"<div{rng.choice(('', '', '', ' class=\"para\"', ' class=\"text\"', ' class=\"paragraph\"'))}{marked}>{inner}</div>"

    def references() -> str:
        """A list of links that belongs to the article."""
        rows = "".join(f"<li{marked}>{rng.choice(('', '', words(1, 5) + ' '))}<a href='/{k}'>{words(1, 9)}</a>{rng.choice(('', '', '.', ', ' + words(1, 4)))}</li>" for k in range(rng.randint(1, 8)))
        return (f"<h2{marked}>{words(1, 3)}</h2>" if rng.random() < 0.4 else "") + f"<{(t := rng.choice(('ul', 'ol')))}{marked}>{rows}</{t}>"

    def concealed() -> str:
        how = rng.choice((" hidden", ' style="display:none"', ' style="display: none;"', ' aria-hidden="true"', ' class="hidden"', ' style="visibility:hidden"'))
        return f"<{(t := rng.choice(('p', 'div', 'section')))}{how}>{prose(3, 60)}</{t}>"

    def content(depth: int = 0) -> str:
        kind = rng.random()
        if kind < 0.55:
            return f"<p{marked}>{prose(1, 120 if rng.random() < 0.7 else 8)}" + rng.choice(("</p>", "</p>", "</p>", ""))
        if kind < 0.62:
            return block()
        if kind < 0.72:
            return f"<p{marked}><b>{prose(2, 12)}<br>"
        if kind < 0.80:
            return f"<h{(k := rng.randint(2, 4))}{marked}>{words(1, 8)}</h{k}>"
        if kind < 0.84:
            return f"<ul{marked}>" + "".join(f"<li{marked}>{prose(2, 25)}</li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        if kind < 0.86:
            return f"<dl{marked}>" + "".join(f"<dt{marked}>{words(1, 3)}</dt><dd{marked}>{prose(2, 25)}</dd>" for _ in range(rng.randint(1, 4))) + "</dl>"
        if kind < 0.89:
            return f"<blockquote{marked}><p{marked}>{prose(4, 40)}</p></blockquote>"
        if kind < 0.92:
            return f"<table{marked}><tr{marked}><td{marked}>{words(1, 4)}</td><td{marked}>{words(1, 4)}</td></tr></table>"
        if kind < 0.94:
            return f"<pre{marked}>{words(2, 30)}</pre>"
        if kind < 0.96:
            return f"<figure{marked}><img src='x'><figcaption{marked}>{prose(2, 12)}</figcaption></figure>"
        return f"<{(t := rng.choice(('div', 'section')))}{marked}>" + "".join(content(depth + 1) for _ in range(rng.randint(1, 4))) + f"</{t}>" if depth < 2 else f"<p{marked}>{prose(3, 40)}</p>"

    def article(bare: bool) -> str:
        """Paragraphs of several elements, of divs alone, text without any, or a single paragraph."""
        style = rng.random()
        inner = f"<h1{marked}>{words(2, 12)}</h1>" if style < 0.6 or rng.random() < 0.5 else ""
        if style < 0.6:
            parts = [content() for _ in range(rng.randint(1, 14))]
        elif style < 0.78:
            parts = [block() for _ in range(rng.randint(1, 10))]
        elif style < 0.9:
            parts = [f"{prose(5, 90)}{rng.choice(('<br><br>', '<br>', ' '))}" for _ in range(rng.randint(1, 6))]
        else:
            parts = [rng.choice((block(), f"<p{marked}>{prose(4, 60)}</p>", f"<p{marked}>{prose(4, 60)}"))]
        for part in parts:
            inner += part
            if rng.random() < 0.07:
                inner += rng.choice((advert, sidebar, notice, form, menu))()
            if rng.random() < 0.1:
                inner += concealed()
        if rng.random() < 0.4:
            inner += references()
        if rng.random() < 0.15:
            inner += comments()
        if bare:
            return inner
        opened = rng.choice(("<article", "<article", "<article", "<article", "<article", "<article", "<main", "<main", '<div class="content"', '<div id="content"', '<div id="main"', '<div class="post article"', '<section class="entry"', '<section class="post-body"', '<div class="article-body"', '<div id="story"', "<div", "<section"))
        return f"{opened}{marked}>{inner}</{opened[1:].split()[0]}>"

    def nested(body: str, at: str) -> str:
        """In elements that say nothing."""
        for _ in range(rng.randint(0, 3)):
            name = rng.choice(("", "", ' class="wrapper"', ' class="container"', ' class="row"', ' class="col"', ' class="inner"', ' id="page"', ' class="layout"'))
            body = f"<div{name}{at}>{body}</div>"
        return f"<table{at}><tr{at}><td{at}>{body}</td></tr></table>" if rng.random() < 0.05 else body

    pages = []
    for k in range(count):
        before, after = ("".join(around() for _ in range(rng.randint(0, 3))) for _ in range(2))
        bare = rng.random() < 0.45  # the article stands in the body itself
        at = marked if bare else ""
        body = before + article(bare) + after
        if rng.random() < 0.4:
            body = nested(body, at)
        if (alone := rng.random()) < 0.12:  # nothing around it, or no more than a piece of a page
            body = article(bare)
        else:
            body = f"{menu() if k % 3 else ''}{body}{footer() if k % 4 else ''}"
        if alone >= 0.06:
            body = f"<!DOCTYPE html><html{at}><head><title>{words(1, 5)}</title><style>p{{}}</style><script>var t='</p>';</script></head><body{at}>{body}" + rng.choice(("</body></html>", ""))
        elif not body.startswith("<"):
            body = f"<body{at}>{body}"  # as the parser does for text alone
        page, content_of = unmarked(body, marked)
        pages.append((page, content_of | ({0} if bare else set())))
    return pages


def unmarked(text: str, mark: str) -> tuple[str, set[int]]:
    """The page without the marks, and the numbers of the elements that had one."""
    nodes, _ = parse(re.sub(rf"(<[a-z0-9]+)([^<>]*){mark}>", r'\1\2 role="xmarkedx">', text))
    return text.replace(mark, ""), {i for i, x in enumerate(nodes) if "xmarkedx" in x.words}


@cache
def standard_model() -> Model:
    """Trained once in a process, on the pages that labelled_pages() writes."""
    return train(labelled_pages())



def extract(pages: DataFrame, model: Model | None = None, html_col: str = "html", out: str = "text") -> DataFrame:
    """pages with the column `out`, the content of html_col."""
    model = model or standard_model()

    @F.pandas_udf(T.StringType())
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([model.extract(x) for x in b], dtype=object)

    return pages.withColumn(out, of(F.coalesce(F.col(html_col), F.lit(""))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the main text of every page."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return extract(pages).select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))

"""Main text of web pages: site templates are found across pages and removed.

Every element's subtree is hashed (tag, class, id, text, subtrees). Spark counts
in how many distinct contents of a host each subtree stands; those in many are the
site's template and are deleted from each of its pages. What is left of the page
outside of menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles and reader comments is its text.

A page's content is that text before anything is deleted as template: an article
or page counts once, however often it is copied over a site, and keeps its text.
Only a small named box in the article goes when it stands on many pages that
differ elsewhere, even if their article is the same. Paragraphs, headings, cells and
rows of an article stay unless asked for, as articles may quote the same line. Class and
id names alone remove an element only if they are made of furniture words.

Defined results: null or empty html gives an empty text; a null url or one
without a host belongs to one host of its own; unclosed, stray and overlapping
tags are read as browsers read them, near enough; repeated rows count once and
get the same text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from bloomtide.llm.common import free_name

TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)")
#: One attribute, or what stands in its place, up to but not including an open quote.
ATTRIBUTE = re.compile(r"[\s/]*([^\s/>=][^\s/>=]*)(?:\s*=\s*([\"']|[^\s\"'>][^\s>]*)?)?|[\s/]*=")
TAG_END = re.compile(r"[\s/]*>")

# What HTML says about its elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp "
                   "small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
                     "h6 header hr main menu nav ol p pre section table ul".split())
SAME = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"},
         "option": {"select"}, "optgroup": {"select"}, "p": {"button", "td", "th", "li", "blockquote", "div", "section", "article", "main", "body"}}

# Elements, roles and class or id words that are not main text.
NEVER = frozenset("head script style noscript template iframe svg math object canvas nav footer aside form button select "
                  "textarea input dialog menu audio video".split())
ROLES = frozenset("navigation banner contentinfo complementary search alert dialog alertdialog menu menubar form".split())
WORDS = frozenset("ad ads advert advertisement advertising sponsor sponsored promo promotion sidebar menu nav navbar "
                  "navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice notices newsletter subscribe signup "
                  "popup modal overlay share sharing social related recommended comment comments disqus respond footer "
                  "header masthead banner toolbar widget pagination pager login search".split())
#: Words that say nothing by themselves: a name made of these and of furniture words is a name of furniture.
NEUTRAL = frozenset("article bar block box button buttons container content icon icons inner item items js link links list main "
                    "outer page panel post section site text title top bottom left right wrapper wrap".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 pre blockquote li dd dt td th figcaption".split())
ROOTS = ("html", "body", "article", "main")
#: Paragraphs, headings, cells and rows with fewer words recur by chance, so they are never template in an article.
LEAST_WORDS = 8


class Element:
    __slots__ = ("tag", "names", "role", "children", "parent")

    def __init__(self, tag: str, names: str, role: str, parent):
        self.tag, self.names, self.role, self.parent = tag, names, role, parent
        self.children: list = []


def tag_at(html: str, at: int) -> tuple[dict[str, str], bool, int]:
    """The attributes of a tag from behind its name on, whether it closes itself, and where it ends.

    As in browsers a quote counts behind an equals sign only, and then reaches up to the
    next one of its kind over anything between; one that is never closed ends with the tag.
    """
    given: dict[str, str] = {}
    while True:
        end = TAG_END.match(html, at)
        if end:
            return given, "/" in end[0], end.end()
        found = ATTRIBUTE.match(html, at)
        if not found or found.end() == at:
            return given, False, len(html)  # the page ends within the tag
        at, value = found.end(), found[2] or ""
        if value in ('"', "'"):
            close = html.find(value, at)
            if close < 0:
                close = html.find(">", at)
                close = len(html) if close < 0 else close
                value, at = html[at:close], close
            else:
                value, at = html[at:close], close + 1
        if found[1]:
            given.setdefault(found[1].lower(), unescape(value) if "&" in value else value)


def end_of_raw(html: str, tag: str, at: int) -> tuple[int, int]:
    """Where the text of a raw element ends, and where what follows its end tag begins."""
    close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(html, at)
    if not close:
        return len(html), len(html)
    end = html.find(">", close.end())
    return close.start(), len(html) if end < 0 else end + 1


def parse(html: str) -> Element:
    """A tree of elements and texts; end tags that are missing or do not match are put right."""
    root = here = Element("", "", "", None)
    at, end, text = 0, len(html), 0
    opened: Counter = Counter()  # tags between the root and here, so that no search goes up in vain

    def up(node: Element) -> Element:
        opened[node.tag] -= 1
        return node.parent

    while True:
        start = html.find("<", at)
        if start < 0:
            break
        found = TAG.match(html, start)
        if not found and html[start + 1:start + 2] not in ("!", "?"):
            at = start + 1  # a bare sign is text
            continue
        if start > text:
            here.children.append(unescape(html[text:start]))
        if not found:
            if html.startswith("<!--", start):
                close = html.find("-->", start + 4)
                at = end if close < 0 else close + 3
            elif html.startswith("<![CDATA[", start):
                close = html.find("]]>", start + 9)
                here.children.append(html[start + 9:end if close < 0 else close])
                at = end if close < 0 else close + 3
            else:
                close = html.find(">", start)
                at = end if close < 0 else close + 1
            text = at
            continue
        given, selfclosing, at = tag_at(html, found.end())
        text = at
        tag = found[2].lower()
        if found[1]:
            if opened[tag]:
                while here.tag != tag:
                    here = up(here)
                here = up(here)
            continue
        closed = {"p"} if tag in CLOSES_P else SAME.get(tag)
        if closed and any(opened[c] for c in closed):
            node, stop = here, HOLDS.get(tag if tag in SAME else "p", ())
            while node is not root and node.tag not in closed and node.tag not in stop:
                node = node.parent
            if node is not root and node.tag in closed:
                while here is not node:
                    here = up(here)
                while here is not root and here.tag in closed:
                    here = up(here)
        node = Element(tag, f"{given.get('class', '')} {given.get('id', '')}".strip().lower(), given.get("role", "").lower(), here)
        here.children.append(node)
        if tag in VOID or selfclosing and tag not in RAW and tag not in CLOSES_P:
            continue
        if tag in RAW:
            close, at = end_of_raw(html, tag, at)
            node.children.append(html[text:close])
            text = at
        else:
            here = node
            opened[tag] += 1
    if text < end:
        here.children.append(unescape(html[text:]))
    return root


def in_order(root: Element) -> list[Element]:
    """All elements, parents first."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return out


def subtree_hashes(root: Element) -> dict[int, int]:
    """By the element's identity the hash of all it holds, white space evened out; void elements have none."""
    out: dict[int, int] = {}
    for node in reversed(in_order(root)):
        parts = [node.tag, node.names]
        for child in node.children:
            parts.append(" ".join(child.split()) if isinstance(child, str) else str(out[id(child)]))
        out[id(node)] = xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - 2**63
    return out


def named_furniture(names: str) -> bool:
    """Whether one of the names is made of furniture words, with neutral ones at most beside them.

    ``share-buttons`` is; ``share-price-table`` and ``search-results-2020`` name content.
    """
    for name in names.split():
        parts = {w for w in re.split(r"[_-]+", name) if w}
        if not WORDS.isdisjoint(parts) and parts <= WORDS | NEUTRAL:
            return True
    return False


def unwanted(node: Element, in_article: bool) -> bool:
    """Whether an element is page furniture by its tag, role or names."""
    if node.tag in ROOTS and not (node.tag == "article" and in_article):
        return False
    if node.tag in NEVER or node.role in ROLES or node.tag == "header" and not in_article:
        return True
    return bool(node.names) and node.tag not in INLINE and named_furniture(node.names)


def main_roots(root: Element) -> list[Element]:
    """The outermost articles that are not furniture, else main elements, else the body, else all."""
    for wanted in (lambda n: n.tag == "article", lambda n: n.tag == "main" or n.role == "main", lambda n: n.tag == "body"):
        out, todo = [], [root]
        while todo:
            node = todo.pop()
            if node is not root and unwanted(node, False) and node.tag not in ROOTS or node.tag == "article" and named_furniture(node.names):
                continue
            if wanted(node):
                out.append(node)
            else:
                todo += [c for c in reversed(node.children) if not isinstance(c, str)]
        if out:
            return out
    return [root]


def text_below(starts: list[Element], gone: set[int] = frozenset()) -> str:
    """The blocks of the wanted text joined by one space, without the elements of the identities ``gone``."""
    pieces: list[str] = []
    for start in starts:
        article = start.tag in ("article", "main")
        todo: list = [start]
        while todo:
            node = todo.pop()
            if isinstance(node, str):
                pieces.append(node)
                continue
            if node is not start and (id(node) in gone or unwanted(node, article)):
                continue
            block = node.tag not in INLINE
            if block:
                pieces.append("\n")
                todo.append("\n")
            todo += reversed(node.children)
    return " ".join("".join(pieces).split())


def words_below(root: Element) -> dict[int, int]:
    """By the element's identity the number of words in it."""
    out: dict[int, int] = {}
    for node in reversed(in_order(root)):
        out[id(node)] = sum(len(c.split()) if isinstance(c, str) else out[id(c)] for c in node.children)
    return out


def can_be_template(starts: list[Element], paragraphs: bool = False) -> list[tuple[Element, bool]]:
    """The elements that go if they are template, parents first, and whether each stands in an article."""
    out = []
    for start in starts:
        article = start.tag in ("article", "main")
        words = words_below(start) if article and paragraphs else {}
        todo: list = list(reversed(start.children))
        while todo:
            node = todo.pop()
            if isinstance(node, str) or unwanted(node, article):
                continue
            if node.children and node.tag not in ROOTS and not (article and node.tag in INLINE):
                small = article and (node.tag in TEXT_TAGS or node.tag == "tr")
                if not small or words.get(id(node), 0) >= LEAST_WORDS:
                    out.append((node, article))
            todo += reversed(node.children)
    return out


def inline_only(node: Element) -> bool:
    """Whether an element and all in it are inline; the first other one ends the search."""
    todo = [node]
    while todo:
        one = todo.pop()
        if one.tag not in INLINE and one.tag not in VOID:
            return False
        todo += [c for c in one.children if not isinstance(c, str)]
    return True


def small_boxes(found: list[tuple[Element, bool]], text: str) -> set[int]:
    """Identities of named containers of bare text in an article, if they hold less than half of the text together."""
    bare: dict[int, bool] = {}  # elements with inline ones in them only; their own are asked first
    for node, _ in reversed(found):
        bare[id(node)] = all(isinstance(c, str) or inline_only(c) for c in node.children)
    boxes = [n for n, article in found if article and n.names and n.tag not in TEXT_TAGS and bare[id(n)]]
    return {id(n) for n in boxes} if 2 * sum(len(text_below([n])) for n in boxes) < len(text) else set()


def main_text(html: str, template: set[int], boxes: set[int] = frozenset(), paragraphs: bool = False) -> str:
    """The main text without template subtrees, and without small boxes that are among ``boxes``."""
    tree = parse(html)
    starts = main_roots(tree)
    text = text_below(starts)
    if not template and not boxes:
        return text
    hashes, found = subtree_hashes(tree), can_be_template(starts, paragraphs)
    small = small_boxes(found, text) if boxes else ()
    return text_below(starts, {id(n) for n, _ in found if hashes[id(n)] in template or id(n) in small and hashes[id(n)] in boxes})


def host_of(url: str = "url") -> Column:
    """The host in lower case, empty where there is none."""
    return F.coalesce(F.regexp_extract(F.lower(F.col(url)), r"^(?:[a-z][a-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit(""))


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


SUBTREES = pa.schema([("site", pa.int64()), ("row", pa.int64()), ("subtree", pa.int64()), ("box", pa.bool_()), ("content", pa.int64())])


def subtrees(pages: DataFrame, html: str, url: str, paragraphs: bool = False) -> DataFrame:
    """(site, row, subtree, box, content): each distinct subtree of each page that can be template, and where it stands.

    A site is a hashed host, the content the hashed main text, or for a small box
    the hashed page.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, page in enumerate(batch.column("html").to_pylist()):
                tree = parse(page)
                starts = main_roots(tree)
                text = text_below(starts)
                nodes = can_be_template(starts, paragraphs)
                hashes = subtree_hashes(tree) if nodes else {}
                small = small_boxes(nodes, text)
                content, whole = text_hash(text), text_hash(page)
                own = {(hashes[id(n)], False, content) for n, _ in nodes}
                own |= {(hashes[id(n)], True, whole) for n, _ in nodes if id(n) in small}
                at += [i] * len(own)
                found += own
            index = pa.array(at, pa.int64())
            subtree, box, content = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("site").take(index), batch.column("row").take(index), pa.array(subtree, pa.int64()),
                 pa.array(box, pa.bool_()), pa.array(content, pa.int64())], schema=SUBTREES)

    rows = pages.select(F.xxhash64(host_of(url)).alias("site"), F.xxhash64(F.col(url), F.col(html)).alias("row"),
                        F.coalesce(F.col(html), F.lit("")).alias("html"))
    return rows.mapInArrow(run, "site long, row long, subtree long, box boolean, content long")


def with_main_text(pages: DataFrame, html: str = "html", url: str = "url", name: str = "text", min_pages: int = 10,
                   paragraphs: bool = False) -> DataFrame:
    """Add (or replace) the main text of each page.

    A subtree is template when it stands in ``min_pages`` distinct contents of its
    host, whatever the host's size; a small box, also by distinct pages. ``paragraphs``:
    also paragraphs, headings, cells and rows of articles, from ``LEAST_WORDS`` words on;
    without it these are part of the article, even where many articles share one.
    """
    found = subtrees(pages, html, url, paragraphs)
    counts = found.select("site", "subtree", "box", "content").distinct().groupBy("site", "subtree", "box").agg(F.count("*").alias("n"))
    often = counts.filter(F.col("n") >= min_pages).select("site", "subtree", "box")
    hits = found.join(often, ["site", "subtree", "box"]).groupBy("row").agg(
        F.collect_set(F.when(~F.col("box"), F.col("subtree"))).alias("_template"),
        F.collect_set(F.when(F.col("box"), F.col("subtree"))).alias("_boxes"))
    row = F.xxhash64(F.col(url), F.col(html))

    @F.arrow_udf("string")
    def text_of_page(pages_: pa.Array, templates: pa.Array, boxes: pa.Array) -> pa.Array:
        return pa.array([main_text(h or "", set(t or ()), set(b or ()), paragraphs) for h, t, b in zip(
            pages_.to_pylist(), templates.to_pylist(), boxes.to_pylist(), strict=True)], pa.string())

    own, template, box = (free_name(pages, c) for c in ("_row", "_template", "_boxes"))
    joined = pages.withColumn(own, row).join(
        hits.select(F.col("row").alias(own), F.col("_template").alias(template), F.col("_boxes").alias(box)), own, "left")
    return joined.withColumn(name, text_of_page(F.col(html), F.col(template), F.col(box))).drop(own, template, box)

"""Main text of web pages by site template removal.

1. Each page is parsed once, row by row. Every element gets a hash of its subtree (name, class, texts and children in order).
2. Spark counts the subtrees per host: on how many different pages each occurs, combined before the shuffle by (host, hash). Copies of a whole
   page count once.
3. A subtree on at least MIN_PAGES pages and MIN_SHARE percent of the pages of its host is template: its texts go from every page.

What one page alone tells is settled while parsing. Names that never hold article text (scripts, forms, menus, page headers and footers, sidebars) and
class, id or role words of adverts, notices, comments and the like go, recurring or not: a menu made for one page does not recur. Where a page
has `article` or `main` elements, its text is what lies in them. In these, headings and paragraphs stay even if they recur, unless half of
their letters are links: passages quoted on many pages and copies of an article are content. Other elements there, and everything on pages
without such elements, are subject to the count; inline elements stay or go with their block. Only pages with such elements are joined with the templates; all
others are finished where they are parsed. A subtree recurs at least as often as one around it, so a block is judged by the innermost.

Defined cases: a null or empty page gives an empty text; a null or malformed address is host ''; each row is a page, also with a repeated
or null id; broken markup is closed as browsers do; a character reference without a meaning stays as it is; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..operators.joins import hot_of_counts, salted_join
from .common import slices, stored, text_of

MIN_PAGES, MIN_SHARE = 4, 1
#: Deeper elements stand beside each other in the one of this depth, as in browsers; no text is lost.
DEPTH = 512

# ---- fixed values of HTML ----------------------------------------------------------------------------------------
RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
          "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot",
          "th", "thead", "tr", "ul", "caption", "legend", "option", "search"}
CLOSES_P = BLOCKS - {"body", "html", "tbody", "td", "tfoot", "th", "thead", "tr", "caption", "option", "legend"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An element that a start tag of the same set ends, up to the nearest element that holds such sets.
SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
            "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
            "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"})}
HEAD_ONLY = {"base", "link", "meta", "title", "style", "script", "noscript", "template"}

# ---- what is no article, whatever recurs ---------------------------------------------------------------------------
NEVER = {"head", "script", "style", "noscript", "template", "title", "nav", "menu", "footer", "aside", "form", "button", "select", "option", "datalist", "textarea", "iframe", "svg", "canvas",
         "object", "audio", "video", "dialog", "search", "xmp", "noembed", "noframes"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
#: Whole words of class and id values.
MARKS = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "banner", "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "disqus",
         "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "pager", "pagination", "popup", "promo", "related", "respond", "share", "sharing",
         "sidebar", "social", "sponsor", "sponsored", "subscribe", "toolbar", "widget"}
_TAG = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|<[!?/][^>]*(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?(?=[\s/\"']|$)", re.I)
_WORD = re.compile(r"[a-z]+")


class Element:
    __slots__ = ("name", "up", "depth", "marked", "main", "names", "parts", "text_size", "link_size", "hash", "prose")

    def __init__(self, name: str, up: "Element | None", names: str = "", marked: bool = False, main: bool = False):
        self.name, self.up, self.names, self.marked, self.main = name, up, names, marked, main
        self.depth = up.depth + 1 if up else 0
        self.parts: list = []  # texts and elements in order
        self.text_size = self.link_size = 0
        self.prose, self.hash = False, 0


def _element(name: str, attributes: str, up: Element) -> Element:
    names, role, hidden = [], "", False
    if attributes:
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), (a or b or c).strip().lower()
            if key in ("class", "id"):
                names.append(value)
            elif key == "role":
                role = value
            else:
                hidden |= key == "hidden" or value == "true"
    inside = up.main
    here = " ".join(names)
    marked = up.marked or name in NEVER or hidden or role in ROLES or (name == "header" and not inside)
    if not marked and here and name not in ("html", "body"):
        words = {w for value in here.split() if not value.startswith(("has-", "no-", "with-")) for w in _WORD.findall(value)}
        marked = not MARKS.isdisjoint(words - {"header"} if inside else words) and not (inside and name in HEADINGS)
    return Element(name, up, here, marked, (inside or name in ("article", "main") or role == "main") and not marked)


def parse(html: str) -> Element:
    """The tree of a page. Start tags end what browsers let them end; an end tag without a start is dropped."""
    root = at = Element("#page", None)
    end, pos, seen = len(html), 0, set()
    while pos < end:
        tag = html.find("<", pos)
        if tag < 0:
            at.parts.append(html[pos:])
            break
        found = _TAG.match(html, tag)
        if found is None:  # a bare sign is text
            at.parts.append(html[pos:tag + 1])
            pos = tag + 1
            continue
        if tag > pos:
            at.parts.append(html[pos:tag])
        pos = found.end()
        name = found[1]
        if name:
            name = name.lower()
            if at.name == "head" and name not in HEAD_ONLY and name != "head":
                at = at.up
            if name in ("html", "body") and name in seen:
                continue
            if name in CLOSES_P and "p" in seen:
                at = _closed(at, {"p"}, {"button", "table", "td", "th", "caption", "object"})
            if name in HEADINGS and at.name in HEADINGS:
                at = at.up
            if name in SIBLINGS and not seen.isdisjoint(SIBLINGS[name][0]):
                at = _closed(at, *SIBLINGS[name])
            seen.add(name)  # a name that never began need not be looked for
            new = _element(name, found[2].strip(), at)
            at.parts.append(new)
            if name in RAW:
                close = re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I).search(html, pos)
                if name in ("textarea", "title"):
                    new.parts.append(html[pos:close.start() if close else end])
                pos = close.end() if close else end
            elif at.depth < DEPTH and name not in VOID and not found[2].rstrip().endswith("/") or at.depth < DEPTH and name in ("p", "div", "a", "b", "i", "span", "li"):
                at = new
        elif found[3]:
            name = found[3].lower()
            if name == "br":
                at.parts.append(Element("br", at, marked=at.marked, main=at.main))
            elif name in seen and name not in ("body", "html"):  # what follows these belongs to the page all the same
                for e in _above(at):
                    if e.name == name:
                        at = e.up
                        break
                    if e.name in ("table", "td", "th", "button") and name not in ("table", "tr", "tbody", "thead", "tfoot", "body", "div", "article", "main", "section", "form"):
                        break
    return root


def _above(at: Element) -> Iterator[Element]:
    while at.up is not None:
        yield at
        at = at.up


def _closed(at: Element, names: set, stop: set) -> Element:
    """The place after the outermost open element of `names` below `stop` is ended."""
    new = at
    for e in _above(at):
        if e.name in stop:
            break
        if e.name in names:
            new = e.up
    return new


def _finish(root: Element) -> list[Element]:
    """All elements, children first, with sizes and subtree hashes. Iterative: nesting may be deep."""
    order, todo = [], [root]
    while todo:
        e = todo.pop()
        order.append(e)
        todo.extend(p for p in e.parts if isinstance(p, Element))
    order.reverse()
    for e in order:
        sha = hashlib.blake2b(f"{e.name}\0{e.names}".encode("utf-8", "replace"), digest_size=8)
        for k, p in enumerate(e.parts):
            if isinstance(p, Element):
                e.text_size += p.text_size
                e.link_size += p.link_size
                e.prose |= p.prose
                sha.update(b"\x01" + p.hash.to_bytes(8, "little", signed=True))
            else:
                e.parts[k] = p = unescape(p) if "&" in p else p
                words = " ".join(p.split())
                e.text_size += len(words)
                sha.update(b"\x02" + words.encode("utf-8", "replace"))
        if e.name == "a":
            e.link_size = e.text_size
        e.prose |= e.name == "p" or e.name == "pre" or e.name == "blockquote" or e.name in HEADINGS
        e.hash = int.from_bytes(sha.digest(), "little", signed=True)
    return order


def blocks(root: Element) -> list[tuple[str, int | None]]:
    """The blocks of the main text in page order, each with the hash of the innermost subtree around it that the count may take away."""
    has_main = any(e.main for e in _finish(root))
    out: list[tuple[str, int | None]] = []
    run: list[str] = []
    under: list[int | None] = [None]

    def flush():
        if run:
            text = " ".join("".join(run).split())
            run.clear()
            if text:
                out.append((text, under[-1]))

    todo: list = [root]
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            run.append(p)
        elif isinstance(p, tuple):  # the end of an element
            if p[1]:
                flush()
            if p[0]:
                under.pop()
        elif p.name == "br":
            run.append(" ")
        elif not p.marked:
            block = p.name in BLOCKS
            if block:
                flush()
            if has_main and not p.main:
                todo.append((False, block))
                todo.extend(reversed([x for x in p.parts if isinstance(x, Element)]))
                continue
            linked = 2 * p.link_size > p.text_size
            open_ = block and p.text_size > 0 and not (has_main and p.prose and not linked)
            if open_:
                under.append(p.hash)
            todo.append((open_, block))
            todo.extend(reversed(p.parts))
        elif p.name in BLOCKS:
            flush()
    flush()
    return out


# ---- the operator --------------------------------------------------------------------------------------------------

def host_of(url: str):
    """The lower-cased host of an address, without user and port; '' where there is none."""
    return F.lower(F.coalesce(F.regexp_extract(F.col(url).cast("string"), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit("")))


def parsed(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id") -> DataFrame:
    """One row per page: page_id, url, host, uid, body (hash of the whole page), subtrees (hashes of the different elements with text), and blocks."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            body, subtrees, found = [], [], []
            for text in batch.column("html").to_pylist():
                root = parse(text)
                cells = blocks(root)
                elements, todo = set(), [root]
                while todo:
                    e = todo.pop()
                    if e.text_size:
                        elements.add(e.hash)
                        todo.extend(p for p in e.parts if isinstance(p, Element))
                elements.discard(root.hash)
                body.append(root.hash)
                subtrees.append(list(elements))
                found.append([{"text": t, "under": u} for t, u in cells])
            kind = pa.list_(pa.struct([("text", pa.string()), ("under", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("page_id", "url", "host")), pa.array(body, pa.int64()), pa.array(subtrees, pa.list_(pa.int64())), pa.array(found, kind)],
                names=["page_id", "url", "host", "body", "subtrees", "blocks"])

    rows = pages.select(F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), host_of(url).alias("host"), text_of(html).alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, host string, body long, subtrees array<long>, blocks array<struct<text: string, under: long>>")


def templates(pages: DataFrame, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """Of parsed pages (host, body, subtrees): host, subtree, pages, all_pages of the subtrees that recur."""
    # copies of a page count once; they have the same subtrees
    different = pages.groupBy("host", "body").agg(F.min("uid").alias("u"))
    sizes = different.groupBy("host").agg(F.count(F.lit(1)).alias("all_pages"))
    once = pages.select("uid", "host", "subtrees").join(different.select("u"), F.col("uid") == F.col("u"), "left_semi")
    counts = once.select("host", F.explode("subtrees").alias("subtree")).groupBy("host", "subtree").agg(F.count(F.lit(1)).alias("pages"))
    often = counts.where(F.col("pages") >= min_pages)
    return often.join(sizes, "host").where(F.col("pages") * 100 >= F.col("all_pages") * min_share)


def main_text(pages: DataFrame, html: str = "html", url: str = "url", page_id: str = "page_id", min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    rows = stored(parsed(pages, html, url, page_id).withColumn("uid", F.monotonically_increasing_id()), "html-parsed")
    found = stored(templates(rows, min_pages, min_share).select(F.col("host").alias("t_host"), F.col("subtree").alias("t_subtree")), "html-templates")
    subject = F.filter("blocks.under", lambda h: h.isNotNull())
    exposed = rows.select("uid", "host", F.explode(F.array_distinct(subject)).alias("subtree"))
    # a subtree of all pages of a large host is a hot key: the rows, not the templates, are salted
    keyed = stored(exposed.select("uid", F.struct("host", "subtree").alias("key")), "html-exposed")
    lookup = found.select(F.struct(F.col("t_host").alias("host"), F.col("t_subtree").alias("subtree")).alias("key"))
    hot = hot_of_counts(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key", "n")
    gone = salted_join(keyed, lookup, "key", hot=hot).groupBy("uid").agg(F.collect_set("key.subtree").alias("gone")).withColumnRenamed("uid", "u")
    touched = rows.where(F.size(subject) > 0).join(gone, F.col("uid") == F.col("u"), "left")
    stay = F.filter("blocks", lambda b: ~F.coalesce(F.array_contains("gone", b["under"]), F.lit(False)))
    texts = rows.where(F.size(subject) <= 0).select("page_id", "url", F.col("blocks.text").alias("texts")).unionByName(
        touched.select("page_id", "url", F.transform(stay, lambda b: b["text"]).alias("texts")))
    text = F.array_join("texts", "\n\n")
    return texts.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))

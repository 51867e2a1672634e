"""Main text of web pages by removal of site templates.

A page is cut into its element tree. Every block subtree with text is hashed twice: by content (tags, classes, text) and by
shape (tags and classes, text and the number of like siblings left out, so that a menu keeps its shape when its links
change). Spark counts per host on how many pages each hash occurs, with the characters and link characters under it
(partial sums by task first, so a host with a third of all pages is no hot key). Template, and deleted, is
- content outside articles on `share` of the host's pages;
- a paragraph or heading outside articles, or a container inside one, whose content is on `inside_share` of them; bare paragraphs, headings, lists and tables of an
  article are never template, since articles of a host may share passages;
- shape outside articles on `inside_share` of the pages, if half its text is links, or if it is a named element that stands
  once a page, holds no running text, and has few characters, a small part of the host's text;
- shape of a container inside an article on half the pages, if nearly all its text is links.
Each needs least_pages pages; most_pages pages are enough on a host of any size. Beside the counts goes what tags, roles and
class names call furniture, reader comments among it, which no count can find. On hosts without templates, those of few
pages, an article or main element bounds the text.

Edge cases: null html is empty and gives an empty text. Unclosed and stray tags close as browsers close them, in linear
time. A page without an article element or main element gives the text of its body. Repeated rows each get their row.
Pages without a host count as one host "". Other columns of pages may have any name and type.
"""

from __future__ import annotations

import html as entities
import re

import xxhash
from pyspark.sql import DataFrame, functions as F

from ..runtime import materialise
from .text import map_rows

#: A comment, a declaration, or a tag; quotes count after an equals sign only, and no part is tried twice.
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")

# HTML element groups.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "xmp"}
BLOCK = {"address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption"}
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "head"}
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = {"ul", "ol", "dl", "table", "select", "article", "section", "div", "body", "td", "th"}
FURNITURE = {"script", "style", "noscript", "template", "iframe", "head", "title", "nav", "header", "footer", "aside", "menu", "form", "button", "select", "textarea", "input", "dialog", "svg", "canvas", "object", "embed", "audio", "video"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "form", "toolbar"}
#: Words of class or id names that mark furniture (fixed values).
NAMES = {"nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "sidebar", "aside", "ad", "ads", "advert", "advertisement", "adverts", "banner", "promo", "sponsor", "sponsored", "cookie", "cookies", "consent", "gdpr", "notice", "popup", "modal", "newsletter", "subscribe", "signup", "comment", "comments", "disqus", "respond", "reply", "replies", "share", "sharing", "social", "related", "recommended", "widget", "toolbar", "pagination", "pager", "skip", "login", "search", "copyright", "legal", "disclaimer"}


class Node:
    __slots__ = ("tag", "attrs", "kids", "hash", "shape", "chars", "links", "runs", "cut")

    def __init__(self, tag: str, attrs: dict[str, str]):
        self.tag, self.attrs, self.kids, self.hash, self.shape, self.chars, self.links, self.runs, self.cut = tag, attrs, [], 0, 0, 0, 0, False, False


class Open:
    """The open elements, with the places of each tag and of the elements that bound others, so that no step searches the stack."""

    def __init__(self, root: Node):
        self.stack, self.at = [root], {}
        self.blocks, self.scopes, self.tables = [], [], []

    def groups(self, tag: str) -> list[list[int]]:
        out = [self.at.setdefault(tag, [])]
        if tag in BLOCK:
            out.append(self.blocks)
        if tag in SCOPE:
            out.append(self.scopes)
            if tag not in ("td", "th"):
                out.append(self.tables)
        return out

    def push(self, n: Node) -> None:
        for g in self.groups(n.tag):
            g.append(len(self.stack))
        self.stack.append(n)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            for g in self.groups(self.stack.pop().tag):
                g.pop()

    def last(self, tags) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def end(self, tag: str) -> None:
        """An end tag; a stray end of an inline element closes no block."""
        place = self.last((tag,))
        if place and (tag in BLOCK or not self.scopes or self.scopes[-1] <= place):
            self.close(place)

    def begin(self, tag: str) -> None:
        """What a start tag closes by itself."""
        if tag in CLOSES_P and self.blocks and self.stack[self.blocks[-1]].tag == "p":
            self.close(self.blocks[-1])
        if tag in SIBLINGS:
            place = self.last(SIBLINGS[tag])
            if place and (not self.tables or self.tables[-1] < place):
                self.close(place)


def attributes(raw: str) -> dict[str, str]:
    return {m[1].lower(): entities.unescape(m[2] or m[3] or m[4] or "") for m in ATTRIBUTE.finditer(raw)} if raw.strip(" /\n\t\r") else {}


def tree(html: str) -> Node:
    """Element tree of a page; text kids are decoded strings."""
    root = Node("#root", {})
    opened, at = Open(root), 0
    stack = opened.stack
    while True:
        m = TOKEN.search(html, at)
        if m is None:
            break
        if m.start() > at:
            stack[-1].kids.append(entities.unescape(html[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            if m[0].startswith("<![CDATA["):
                stack[-1].kids.append(m[0][9:].removesuffix("]]>"))
            continue
        if m[1]:
            opened.end(tag)
            continue
        opened.begin(tag)
        node = Node(tag, attributes(m[3]))
        stack[-1].kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            stop, after = (end.start(), end.end()) if end else (len(html), len(html))
            node.kids.append(html[at:stop])
            at = after
        elif tag not in VOID and not m[3].endswith("/"):
            opened.push(node)
    if at < len(html):
        stack[-1].kids.append(entities.unescape(html[at:]))
    return root


#: Names that mark furniture even around or on an article (fixed values); those of reader comments do so wherever they stand.
COMMENTS = {"comment", "comments", "disqus", "respond", "replies", "reply"}
SIDE = COMMENTS | {"related", "recommended", "teaser"}
#: Up to so many characters, or with half of them in links, a subtree holds no running text of its own.
FEW_CHARS = 300


def names_of(n: Node) -> set[str]:
    """Words of an element's class and id."""
    names = f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}"
    return set(re.split(r"[^a-z0-9]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", names).lower())) if names.strip() else set()


def tokens_of(n: Node) -> set[str]:
    """Whole class names and id of an element."""
    return set(f"{n.attrs.get('class', '')} {n.attrs.get('id', '')}".lower().split())


def cut_furniture(order: list[tuple[Node, bool]]) -> None:
    """Mark what the markup names as furniture. A wrapper of an article or main element is not furniture, unless it holds comments or links to other articles.

    Names are weak inside the main text: in an article a name counts only as a whole class name or id of a subtree without
    running text, in a main element only as a whole one, and a header in an article is the article's own. Reader comments go.
    """
    main: dict[int, bool] = {}
    within: dict[int, int] = {}
    for n, _ in reversed(order):  # parents come first
        at = 2 if n.tag == "article" else max(within.get(id(n), 0), n.tag == "main")
        for k in n.kids:
            if isinstance(k, Node):
                within[id(k)] = at
    for n, _ in order:  # kids come first
        names, at = names_of(n), within.get(id(n), 0)
        comments = not names.isdisjoint(COMMENTS)
        side, named = not names.isdisjoint(SIDE), not names.isdisjoint(NAMES)
        if at and not comments and (side or named):
            whole = tokens_of(n)
            weak = at == 2 and n.chars > FEW_CHARS and 2 * n.links < n.chars
            side, named = not weak and not whole.isdisjoint(SIDE), not weak and not whole.isdisjoint(NAMES)
        main[id(n)] = not side and (n.tag in ("article", "main") or any(main[id(k)] for k in n.kids if isinstance(k, Node)))
        hidden = "hidden" in n.attrs or n.attrs.get("aria-hidden") == "true"
        tagged = n.tag in FURNITURE and not (n.tag == "header" and at == 2) or n.attrs.get("role", "").lower() in ROLES
        n.cut = hidden or side and n.tag not in ("html", "body") or (tagged or n.tag not in ("html", "body") and named) and not main[id(n)]


def walk(root: Node) -> list[tuple[Node, bool]]:
    """Every element after its kids, with whether it stands inside an article; sets the hashes and text sizes of each subtree."""
    out, stack = [], [(root, False, False)]
    while stack:
        n, inside, seen = stack.pop()
        if seen:
            name = f"{n.tag} {n.attrs.get('class', '')} {n.attrs.get('id', '')}"
            h, shapes, n.runs = xxhash.xxh64(name.encode("utf-8", "surrogatepass")), set(), n.tag in RUNNING
            for k in n.kids:
                if isinstance(k, Node):
                    h.update(k.hash.to_bytes(8, "little"))
                    if k.tag != "br":
                        shapes.add(k.shape)
                    n.chars, n.links, n.runs = n.chars + k.chars, n.links + k.links, n.runs or k.runs
                elif n.tag not in UNSEEN and not k.isspace():
                    k = " ".join(k.split())
                    h.update(k.encode("utf-8", "surrogatepass"))
                    n.chars += len(k)
            if n.tag == "a":
                n.links = n.chars
            n.hash = h.intdigest()
            n.shape = xxhash.xxh64_intdigest(f"{NUMBER.sub('0', name)} {sorted(shapes)}".encode("utf-8", "surrogatepass"))
            out.append((n, inside))
            continue
        stack.append((n, inside, True))
        below = inside or n.tag in ("article", "main")
        stack += [(k, below, False) for k in reversed(n.kids) if isinstance(k, Node)]
    return out


NUMBER = re.compile(r"\d+")
UNSEEN = {"script", "style", "noscript", "template", "iframe", "title"}
#: Running text, lists and tables.
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "ul", "ol", "dl", "dd", "dt", "table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption", "figure", "figcaption"}
PROSE = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre"}
PAGE = {"#root", "html", "head", "body", "article", "main"}
#: Kinds of subtree hashes.
CONTENT, INNER_CONTENT, SHAPE, INNER_SHAPE = range(4)


def keys(n: Node, inside: bool) -> list[tuple[int, int]]:
    """(kind, hash) of a subtree that may be template; the hash tells the kinds apart."""
    if n.tag not in BLOCK or n.tag in PAGE or not n.chars or inside and n.tag in RUNNING:
        return []
    out = [(INNER_CONTENT if inside or n.tag in PROSE else CONTENT, n.hash)]
    if n.tag not in PROSE:
        out.append((INNER_SHAPE if inside else SHAPE, n.shape))
    return [(k, (x := (h ^ k * 0x9E3779B97F4A7C15) & (1 << 64) - 1) - (x >> 63 << 64)) for k, h in out]


def subtrees(html: str | None) -> tuple[list[dict], int]:
    """The hashes of a page that may be template, each with what stands under it, and the characters of the page."""
    order = walk(tree(html or ""))
    found: dict[int, dict] = {}
    for n, inside in order:
        for kind, h in keys(n, inside):
            bare = n.runs or n.tag in ("div", "section") and not (n.attrs.get("class") or n.attrs.get("id"))
            x = found.setdefault(h, {"h": h, "kind": kind, "chars": 0, "links": 0, "times": 0, "bare": False})
            x["chars"], x["links"], x["times"], x["bare"] = x["chars"] + n.chars, x["links"] + n.links, x["times"] + 1, x["bare"] or bare
    return list(found.values()), order[-1][0].chars


def main_text(html: str | None, template: set[int], names: bool = True) -> str:
    """Blocks of the main text, joined by two line ends. Where the templates would leave nothing, they are the text. names: whether markup names count beside the templates, and, where a host has none, an article or main element bounds the text."""
    root = tree(html or "")
    order = walk(root)
    if names:
        cut_furniture(order)
    else:
        for n, _ in order:
            n.cut = n.tag in UNSEEN
    for n, inside in order if template else ():
        n.cut |= any(h in template for _, h in keys(n, inside))
    held: dict[int, bool] = {}
    for n, _ in order:  # kids come first
        held[id(n)] = not n.cut and (n.tag in ("article", "main") or any(held[id(k)] for k in n.kids if isinstance(k, Node)))
    only = names and not template and held[id(root)]
    blocks: list[str] = []
    text: list[str] = []

    def flush():
        block = " ".join("".join(text).split())
        if block:
            blocks.append(block)
        text.clear()

    stack: list = [(root, False, False)]
    while stack:
        n, inside, end = stack.pop()
        if isinstance(n, str):
            if inside or not only:
                text.append(n)
            continue
        if n.tag in BLOCK:
            flush()
        if end or n.cut:
            continue
        if n.tag == "br":
            text.append(" ")
        now = inside or n.tag in ("article", "main")
        stack.append((n, inside, True))
        stack += [(k, now, False) for k in reversed(n.kids)]
    flush()
    return main_text(html, set(), names) if template and not blocks else "\n\n".join(blocks)


HOST = r"^[a-zA-Z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
#: Beyond a broadcast, pages meet their host's templates by host and salt, so that a large host is dealt over so many tasks.
SALTS = 64


def templates(pages: DataFrame, least_pages: int = 5, most_pages: int = 1000, share: float = 0.1, inside_share: float = 0.3, few: int = 150) -> DataFrame:
    """(host, template): the hashes of each host's template subtrees. pages: (url, html)."""
    x = pages.select(F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"), "html")
    seen = map_rows(x, ["html"], lambda: subtrees, "found array<struct<h: bigint, kind: int, chars: bigint, links: bigint, times: bigint, bare: boolean>>, chars bigint", keep=["host"])
    # one pass over the pages: the page itself is the row without a hash
    each = seen.select("host", "chars", F.inline(F.concat(F.array(F.struct(*[F.lit(None).cast(t).alias(c) for c, t in (("h", "bigint"), ("kind", "int"))], F.col("chars").alias("chars"), *[F.lit(0).cast("bigint").alias(c) for c in ("links", "times")], F.lit(False).alias("bare"))), "found")).alias("h", "kind", "c", "links", "times", "bare"))
    sums = each.groupBy("host", "h", "kind").agg(F.count("*").alias("n"), *[F.sum(c).alias(c) for c in ("c", "links", "times")], F.max("bare").alias("bare")).where(F.col("h").isNull() | (F.col("n") >= least_pages))
    sums = materialise(sums)
    hosts = sums.where("h is null").select("host", F.col("n").alias("pages"), F.col("c").alias("all"))
    need = lambda part: F.col("n") >= F.greatest(F.lit(least_pages), F.least(part * F.col("pages"), F.lit(most_pages)))
    once, linked = F.col("times") <= 1.5 * F.col("n"), lambda part: F.col("links") >= part * F.col("c")
    short = ~F.col("bare") & once & (F.col("c") <= few * F.col("n")) & (F.col("c") <= 0.1 * F.col("all"))
    is_ = F.when(F.col("kind") == CONTENT, need(share)).when(F.col("kind") == INNER_CONTENT, need(inside_share)).when(F.col("kind") == SHAPE, need(inside_share) & (linked(0.5) | short)).otherwise(need(0.5) & linked(0.8) & once)
    return sums.where("h is not null").join(hosts, "host").where(is_).groupBy("host").agg(F.collect_list("h").alias("template"))


def extract(pages: DataFrame, keep: list[str] | None = None, most_bytes: int = 16 << 20, names: bool = True, **how) -> DataFrame:
    """pages (url, html; the columns in keep) with text and n_chars. how: parameters of templates.

    Up to most_bytes of templates are broadcast and the pages stay where they are; beyond that pages and templates meet
    by a shuffle on host and salt.
    """
    known = materialise(templates(pages.select("url", "html"), **how))
    size = known.agg(F.sum(8 * F.size("template") + 64)).first()[0] or 0
    made = ("text", "n_chars")
    kept = [c for c in (pages.columns if keep is None else keep) if c not in made]
    x = pages.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("_row") if kept else F.lit(None).alias("_row"), F.coalesce(F.lower(F.regexp_extract("url", HOST, 1)), F.lit("")).alias("host"), "html")
    if size <= most_bytes:
        x = x.join(F.broadcast(known), "host", "left")
    else:
        salted = known.select("host", "template", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
        x = x.withColumn("salt", F.pmod(F.xxhash64("html"), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")

    def make():
        return lambda h, t: ((s := main_text(h, set(t or ()), names)), len(s))

    out = map_rows(x, ["html", "template"], make, "text string, n_chars bigint", keep=["_row"])
    return out.select(*([F.col("_row.*")] if kept else []), *made)

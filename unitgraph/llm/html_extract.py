"""Main text of web pages by consensus of each host's pages.

1. Every page's containers are scored: a text block gives its characters outside links
   to the container it stands in, half of them to the next one out. Blocks in menus,
   adverts and the like give nothing.
2. A container is known by its *generalised path*: tags and class names from the root
   down, with numbers and generated parts of names blanked. Pages vote for paths with
   the share that a path has in the page's score; Spark sums the votes by host.
3. Each page is read again and the text of its host's winning path is taken; if a page
   has no text there, that of the next path, at last that of the page's own best container.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize

#: Element names of HTML by what they do to the flow of text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title template iframe svg select option button".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINER = frozenset("article blockquote body center dd details div dl fieldset figure html li main ol section table tbody td tr ul".split())
BOILERPLATE_TAGS = frozenset("nav footer aside form head menu dialog".split())
#: Names that pages give to parts around an article.
BOILERPLATE_NAMES = frozenset(
    """ad ads adv advert adverts advertisement advertising banner bio breadcrumb breadcrumbs comment comments consent cookie cookies
    discussion discussions disqus footer form gdpr login masthead menu modal nav navbar navigation newsletter notice notices overlay pagination paging popup promo
    promotion related replies respond response responses rss search share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget widgets""".split()
)
BOILERPLATE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
ARTICLE_NAMES = frozenset("article body content entry main post story text".split())

#: Boilerplate that never holds an article, whatever its size.
CLOSED_TAGS = frozenset("nav footer head menu header".split())
CLOSED_NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising comment comments consent cookie cookies discussion discussions disqus gdpr promo promotion related replies respond response responses".split()
)
#: With a closed name, these make up the whole name of such a part: comment-list, ad-slot.
PART_NAMES = frozenset("area block box container count form inner item items link links list outer section slot thread title unit wrap wrapper".split())
#: Names of wrappers: with these in it, a name like content-sidebar-wrap is not that of a sidebar.
WRAPPER_NAMES = ARTICLE_NAMES | frozenset("container layout page wrap wrapper".split())

#: A name that begins or ends with one of these says what an element has or lacks, not what it is: has-comments, comments-open, ad-free.
MODIFIERS = frozenset("has no with without off none disabled enabled open closed free loaded ready allowed".split())
#: A name that begins with one of these says what an article is filed under: category-advertising, tag-cookies.
FILED = frozenset("category cat tag type format status topic term label".split())

LONGEST_PATH = 1000

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*>""", re.S)
_ATTR = re.compile(r"""(?<![\w:.-])(class|id|role|hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NAME_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_GENERATED = re.compile(r"[0-9]+|(?<=[-_])[0-9a-f]{6,}\b")
#: A start tag of a key ends an open element of its values.
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "tbody", "thead"}, "tfoot": {"tr", "td", "th", "tbody", "thead"}}
#: What ends an element whose end tag may be left out: any tag, or a tag that can't stand in a button.
_ENDS = {"option": r"</option\b[^>]*>|(?=</?[a-z])", "button": r"</button\b[^>]*>|(?=<(?:button|article|main|section|p|h[1-6]|ul|ol|table|form|body)\b)|(?=</(?:div|p|li|td|form|nav|header|article|main|section|body)\b)"}
_SCOPES = frozenset("ul ol dl table article section main div body html blockquote".split())


class Page:
    """A page's elements - path, first block and the one behind the last, bonus, parent - and its text blocks."""

    def __init__(self, html: str):
        self.paths: list[str] = ["html"]
        self.first: list[int] = [0]
        self.end: list[int] = [0]
        self.bonus: list[float] = [1.0]
        self.blocks: list[tuple[str, int, int, int]] = []  # text, container, innermost boilerplate element or -1, characters in links
        self.parent: list[int] = [-1]
        self.article: list[bool] = [False]  # whether an element is an article or inside one
        self.shut: dict[int, tuple[int, int]] = {}  # boilerplate element: the one around it or -1, and when it is opened: 0 never, 1 if all is shut, 2 if it holds the article, 3 if it holds the only one or all text
        self.articles: list[tuple[int, int]] = []  # article and main elements, innermost boilerplate
        self._read(html)
        self._reopen()

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, int]] = [("html", 0, -1)]  # tag, node (own or that of the container), innermost boilerplate
        count = Counter(["html"])  # of the tags on the stack
        text: list[str] = []
        linked, links = 0, 0
        at, n = 0, len(html)
        blocks = self.blocks

        def flush():
            nonlocal linked
            if text:
                joined = " ".join(unescape("".join(text)).split())
                if joined:
                    blocks.append((joined, stack[-1][1], stack[-1][2], min(linked, len(joined))))
                text.clear()
            linked = 0

        def close(depth: int):
            while len(stack) > depth:
                tag, node, _ = stack.pop()
                count[tag] -= 1
                if node != stack[-1][1]:
                    self.end[node] = len(blocks)

        search = _TOKEN.search
        last = html.rfind(">")  # no tag begins behind it
        endless: set[str] = set()  # elements that no end tag follows any more
        while at < n:
            m = search(html, at) if at < last else None
            if m is None:
                text.append(html[at:].partition("<!--")[0])
                break
            start = m.start()
            if start > at:
                text.append(html[at:start])
                if links:
                    linked += start - at
            at = m.end()
            tag = m[2] or m[5]
            if tag is None:
                continue
            tag = tag.lower()
            if m[1] or m[4]:
                if tag == "a":
                    links = max(0, links - 1)
                elif tag in BLOCK:
                    flush()
                    for depth in range(len(stack) - 1, 0, -1) if count[tag] else ():
                        if stack[depth][0] == tag:
                            close(depth)
                            break
                continue
            if tag in RAW:
                if not m[0].endswith("/>"):
                    stop = None if tag in endless else re.compile(_ENDS.get(tag) or rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                    if stop is None:
                        endless.add(tag)
                    at = stop.end() if stop else n if tag in ("script", "style") else at
                text.append(" ")
                continue
            if tag == "a":
                links = 1
                continue
            if tag not in BLOCK:
                if tag == "br":
                    text.append(" ")
                continue
            flush()
            links = 0
            if tag in ("html", "head", "body") and count[tag]:
                continue
            if stack[-1][0] == "p" or tag != "p" and any(t == "p" for t, _, _ in stack[-3:]):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] == "p":
                        close(depth)
                        break
            if tag == "body" and stack[-1][0] == "head":
                close(len(stack) - 1)
            closes = _CLOSES.get(tag, ())
            if any(count[t] for t in closes):
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth][0] in closes:
                        close(depth)
                    elif stack[depth][0] in _SCOPES:
                        break
            if tag == "hr":
                continue
            names: list[str] = []
            shut = tag in BOILERPLATE_TAGS
            closed = tag in CLOSED_TAGS
            classes: list[str] = []
            attrs = m[3] or m[6]
            if attrs and len(attrs) > 4:
                for key, *values in _ATTR.findall(attrs):
                    key, value = key.lower(), values[0] or values[1] or values[2]
                    if key == "role":
                        shut |= value.lower() in BOILERPLATE_ROLES
                        closed |= value.lower() in BOILERPLATE_ROLES - {"form", "dialog", "complementary"}
                    elif key == "style":
                        hidden = "display:none" in value.replace(" ", "").lower()
                        shut, closed = shut | hidden, closed | hidden
                    elif key == "hidden":
                        hidden = " hidden" in attrs.lower()
                        shut, closed = shut | hidden, closed | hidden
                    else:
                        for name in value.split():
                            parts = [x.lower() for x in _NAME_PARTS.findall(name)]
                            if not parts or parts[0] in FILED and len(parts) > 1 or parts[0] in MODIFIERS or parts[-1] in MODIFIERS:
                                continue
                            names += parts
                            # the whole name is that of a part that is never opened
                            closed |= not CLOSED_NAMES.isdisjoint(parts) and all(x in PART_NAMES or x in BOILERPLATE_NAMES for x in parts)
                        if key == "class":
                            classes += [_GENERATED.sub("#", c) for c in value.split()]
            if tag in ("body", "html", "main", "article"):
                shut = False
            elif names and not shut:
                # a block named header is a page's, unless it is named after an article or inside one
                shut = not BOILERPLATE_NAMES.isdisjoint(names) or "header" in names and ARTICLE_NAMES.isdisjoint(names) and not self._in_article(stack[-1][1])
            node, boiler = stack[-1][1], stack[-1][2]
            if tag == "header" and not self._in_article(stack[-1][1]):
                shut = True
            if tag in CONTAINER or shut:
                path = self.paths[node]
                if len(path) > LONGEST_PATH:  # a digest stands for a long way down: paths stay short and apart
                    path = "#" + hashlib.md5(path.encode("utf-8", "replace")).hexdigest()
                path += "/" + tag + "".join("." + c for c in sorted(set(classes)))
                self.parent.append(node)
                node = len(self.paths)
                self.paths.append(path)
                self.first.append(len(blocks))
                self.end.append(-1)
                named = tag in ("article", "main") or tag != "body" and not ARTICLE_NAMES.isdisjoint(names)
                self.bonus.append(1.5 if named else 1.0)
                self.article.append(named or self.article[self.parent[-1]])
                if tag in ("article", "main") and CLOSED_NAMES.isdisjoint(names):
                    self.articles.append((node, boiler))
                if shut:
                    wraps = tag in ("form", "aside", "dialog") and (BOILERPLATE_NAMES - {tag}).isdisjoint(names) or not WRAPPER_NAMES.isdisjoint(names)
                    self.shut[node] = boiler, 0 if closed else 3 if not CLOSED_NAMES.isdisjoint(names) else 1 + wraps
            stack.append((tag, node, node if shut else boiler))
            count[tag] += 1
        flush()
        close(1)
        self.end[0] = len(blocks)

    def _reopen(self) -> None:
        """Open boilerplate elements that hold the article: a form around the page, a wrapper named after its sidebar.

        They hold most of the text that isn't in menus and the like, or the page's only
        article or main elements. One named after comments, adverts and the like must hold
        nearly all text, or the only article. If all text is shut, everything not closed for good is opened.
        """
        if not self.shut:
            return

        def counted(kinds: tuple[int, ...]):
            """Whether a boilerplate element is in one of some kinds, and the characters outside links of the others that stand in an element."""
            closed = {-1: False}
            for node, (outer, kind) in self.shut.items():
                closed[node] = closed[outer] or kind in kinds and node not in opened
            sums = [0]
            for text, _, boiler, linked in self.blocks:
                sums.append(sums[-1] + (0 if closed[boiler] else len(text) - linked))
            return closed, sums, lambda node: sums[self.end[node]] - sums[self.first[node]]

        opened: set[int] = set()
        closed, sums, held = counted((0,))
        outside = any(boiler < 0 and held(node) for node, boiler in self.articles)
        holders: set[int] = set()
        for node, boiler in () if outside else self.articles:
            while boiler >= 0 and boiler not in holders and held(node):
                holders.add(boiler)
                boiler = self.shut[boiler][0]
        opened = {node for node, (_, kind) in self.shut.items() if kind == 3 and not closed[node] and not outside and (node in holders or sums[-1] and 10 * held(node) >= 9 * sums[-1])}
        closed, sums, held = counted((0, 3))
        inner = {-1: -1}
        for everything in (False, True):
            for node, (outer, kind) in self.shut.items():
                free = node in opened or not closed[node] and (everything or kind == 2 and (node in holders or 2 * held(node) > sums[-1]))
                inner[node] = inner[outer] if free else node
            if not sums[-1] or any(inner[boiler] < 0 and len(text) > linked for text, _, boiler, linked in self.blocks):
                break
        self.blocks = [(text, node, inner[boiler], linked) for text, node, boiler, linked in self.blocks]

    def _in_article(self, node: int) -> bool:
        return self.article[node]

    def scores(self) -> dict[int, float]:
        """Score of each container that has any."""
        found: dict[int, float] = {}
        for text, node, boiler, linked in self.blocks:
            weight = len(text) - linked
            if boiler >= 0 or weight <= 0:
                continue
            if weight < 25:
                weight *= 0.2
            for share in (1.0, 0.5):
                found[node] = found.get(node, 0.0) + share * weight * self.bonus[node]
                node = self.parent[node]
                if node < 0:
                    break
        return found

    def text(self, node: int) -> str:
        """Blocks of a container, without the boilerplate elements inside it."""
        inside = self.blocks[self.first[node] : self.end[node]]
        return "\n".join(b for b, _, boiler, _ in inside if boiler <= node)

    def _whole(self, nodes: list[int]) -> list[int]:
        """The article elements around containers; of containers side by side, which are parts of one text, their parent."""
        articles = {node for node, _ in self.articles}
        around: list[int] = [-1]
        for node in range(1, len(self.paths)):
            tag = self.paths[node].rpartition("/")[2].partition(".")[0]
            around.append(node if node in articles and tag == "article" else around[self.parent[node]])
        nodes = [node if around[node] < 0 else around[node] for node in nodes if self.text(node)]
        while True:
            found = sorted(set(nodes))
            count = Counter(self.parent[node] for node in found)
            nodes = [self.parent[node] if self.parent[node] >= 0 and count[self.parent[node]] > 1 else node for node in found]
            if nodes == found:
                return found

    def at_path(self, path: str) -> str:
        """Text of all containers at a path, in page order, each with what stands around it (:meth:`_whole`)."""
        parts, done = [], 0
        for node in self._whole([k for k, own in enumerate(self.paths) if own == path]):
            if self.first[node] >= done:
                parts.append(self.text(node))
                done = max(done, self.end[node])
        return "\n".join(p for p in parts if p)


def votes(html: str) -> list[tuple[str, float]]:
    """Generalised paths of a page and their shares of its score."""
    page = Page(html)
    by_path: dict[str, float] = {}
    for node, score in page.scores().items():
        by_path[page.paths[node]] = by_path.get(page.paths[node], 0.0) + score
    total = sum(by_path.values())
    return [(p, s / total) for p, s in by_path.items()] if total else []


def main_text(html: str | None, winners: list[str] | None = None) -> str:
    """Text at the first of the winning paths where this page has any; else at its own best container."""
    page = Page(html or "")
    for path in winners or ():
        if found := page.at_path(path):
            return found
    scores = page.scores()
    return page.at_path(page.paths[max(scores, key=lambda k: (scores[k], -k))]) if scores else ""


def host(url):
    """Lower-case host of a URL column; empty if there is none."""
    return F.coalesce(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1), F.lit(""))


def _each(df: DataFrame, schema: str, make) -> DataFrame:
    """mapInArrow with one list of output rows for each input row."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = to_arrow_schema(StructType.fromDDL(schema))

    def run(batches):
        for whole in batches:
            rows = max(1, whole.num_rows * (4 << 20) // max(1, whole.nbytes))
            for at in range(0, whole.num_rows, rows):
                out = [r for values in zip(*(c.to_pylist() for c in whole.slice(at, rows).columns)) for r in make(*values)]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(fields)], [f.name for f in fields])

    return df.mapInArrow(run, schema)


def winning_paths(pages: DataFrame, url_col: str = "url", html_col: str = "html", keep: int = 3) -> DataFrame:
    """``host, winners``: the ``keep`` paths with most votes of each host, most first (ties: the longer path, then by name)."""
    ballots = _each(pages.select(host(F.col(url_col)).alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html")), "host string, path string, share double", lambda h, html: [(h, p, s) for p, s in votes(html)])
    # whole numbers, so that the sum doesn't depend on the order
    counted = ballots.groupBy("host", "path").agg(F.sum(F.round(F.col("share") * 1_000_000).cast("bigint")).alias("votes"))
    order = Window.partitionBy("host").orderBy(F.desc("votes"), F.desc(F.length("path")), "path")
    best = counted.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep)
    listed = F.array_sort(F.collect_list(F.struct("place", "path")))
    return best.groupBy("host").agg(F.transform(listed, lambda x: x["path"]).alias("winners"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", keep: int = 3) -> DataFrame:
    """``page_id, url, text, n_chars`` for every row of ``pages``.

    Null html is an empty page, with empty text. Pages without a URL, or whose URL has
    no host, vote as one host. Repeated rows come back as often as they came. Blocks
    are joined by a line feed; white space inside one is a single space.
    """
    winners = materialize(winning_paths(pages, url_col, html_col, keep), "winning-paths")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).alias("html")).withColumn("host", host(F.col("url")))
    joined = rows.join(winners, "host", "left").select("id", "url", "html", "winners")
    kind = pages.schema[id_col].dataType.simpleString()
    texts = _each(joined, f"id {kind}, url string, text string", lambda i, url, html, won: [(i, url, main_text(html, won))])
    return texts.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text", F.char_length("text").cast("bigint").alias("n_chars"))

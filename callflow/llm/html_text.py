"""Main text of web pages by tree scoring.

A page becomes a tree of elements. Each text block passes points for its length
and commas to its parent, half of them to its grandparent and a third further
up; a container's points are discounted by its link density. The best container
and the siblings that score well beside it are kept; what is boilerplate by its
element, its name or its links is left out of them. A form or a name drops nothing
that holds the article or most of the page; inside an article only plain names
drop, and no element with the headline. Lists of sources stay, and what stands
under a heading of reader comments goes.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callflow.llm.shared import only

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^'\">]|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)>?|[^<]+|<", re.DOTALL)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"?|'([^']*)'?|([^\s>]+)))?")
#: Elements whose content is not markup, and void elements.
RAW = {"script", "style", "textarea", "title", "xmp", "noembed"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
#: A start tag of the key ends an open element of the values.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
#: Elements that such an implied end does not reach across.
BARRIERS = {"ul", "ol", "dl", "table", "article", "section", "main", "div", "body", "html", "blockquote", "form", "td", "th"}
DROPPED = {
    "head", "script", "style", "noscript", "template", "nav", "footer", "aside", "button", "select", "input", "textarea", "iframe", "object", "embed",
    "canvas", "svg", "math", "audio", "video", "dialog", "menu", "title",
}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "menu", "menubar", "toolbar"}
#: Words of a class or id that name boilerplate.
NAMES = re.compile(
    r"(?:^|[\s_-])(?:ads?|advert(?:s|isement|ising|orial)?|adsense|banner|sponsor(?:ed|s)?|promo(?:tion|s)?|cookies?|consent|gdpr|notices?|notification|alert|popup|modal|overlay|"
    r"sidebar|side|aside|rail|widgets?|menu|nav(?:bar|igation)?|breadcrumbs?|toc|pagination|pager|header|masthead|topbar|footer|bottom|copyright|legal|disclaimer|"
    r"comments?|commentlist|replies|reply|respond|discussion|disqus|reviews?|share|sharing|social|related|recommend(?:ed|ations)?|read-?more|more-?stories|trending|popular|"
    r"newsletter|subscribe|subscription|signup|sign-up|login|register|search|tags?|toolbar|skip-?link|hidden|sr-only)(?:$|[\s_-])",
    re.IGNORECASE,
)
#: Inside an article: class words that name boilerplate wherever they begin or end a class, and those that do only as the whole class.
ALWAYS = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsors", "sponsored", "promo", "promos", "cookie", "cookies", "consent", "popup",
    "modal", "overlay", "sidebar", "widget", "widgets", "menu", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "pagination", "pager", "comments", "commentlist",
    "respond", "disqus", "share", "sharing", "social", "related", "recommended", "recommendations", "trending", "newsletter", "subscribe", "subscription", "signup", "login",
    "register", "toolbar",
}
ALONE = {"notice", "notices", "notification", "alert", "banner", "disclaimer", "tags", "search", "footer", "legal", "copyright", "hidden", "sr-only", "skip-link", "toc", "comment", "replies", "reviews", "popular", "rail", "aside"}
#: What a list of links is introduced by when it belongs to the article, and the headings of reader comments.
SOURCES = re.compile(r"\b(?:sources?|references?|further reading|bibliography|literature|quellen|literatur|fuentes|referencias|bibliograf[ií]a|r[ée]f[ée]rences|bibliographie)\b", re.IGNORECASE)
REMARKS = re.compile(r"(?:\d[\d.,]*\s+|reader\s+|leave\s+a\s+)?(?:responses?|comments?|repl(?:y|ies)|kommentare?|commentaires?|comentarios?)(?:\s*\(?\d*\)?|\s+(?:to|on|zu|sur|sobre)\b.*)\W*", re.IGNORECASE)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.IGNORECASE)
#: Share of linked characters from which a list or box inside the article is a menu.
MENU_DENSITY = 0.8
#: Share of the best score from which an element that says it is the article is taken.
MARKED_SHARE = 0.25
#: Share of the page's points from which a form or an element with a boilerplate name is a wrapper of the page.
WRAPPER_SHARE = 0.75
BOXES = {"ul", "ol", "dl", "div", "section", "table", "tbody", "tr"}


class Tree:
    """Elements of one page in document order, with their blocks of text."""

    def __init__(self, html: str):
        self.tag, self.parent, self.dropped, self.main = ["#root"], [-1], [False], [False]
        self.doubtful, self.marks = [False], [""]  # dropped unless it holds the article or most of the page; what the element says it is
        self.blocks: list[tuple[int, str, int]] = []
        self._open, self._text, self._links, self._linked = [0], [], 0, 0
        self._places: dict[str, list[int]] = {}  # of the open elements of each tag among all open ones
        self._solid = [0]  # of those that are not inline
        skip = None
        for m in TOKEN.finditer(html):
            piece, name = m[0], m[2]
            if skip:
                if name and m[1] and name.lower() == skip:
                    skip = None
                    self._end(name.lower())
                continue
            if not name:
                if piece[0] != "<" or piece == "<":
                    self._add(piece)
                elif piece.startswith("<![CDATA["):
                    self._add(piece[9:].removesuffix("]]>"))
                continue
            name = name.lower()
            if m[1]:
                self._end(name)
                continue
            self._start(name, m[3])
            if name in RAW and not m[3].endswith("/"):
                skip = name
        self._flush()

    def _add(self, text: str) -> None:
        self._text.append(text)
        if self._links:
            self._linked += len(text.strip())

    def _owner(self) -> int:
        return self._open[self._solid[-1]]

    def _place(self, tags: Iterable[str]) -> int:
        """Of the innermost open element with one of the tags; 0 if there is none."""
        return max((places[-1] for t in tags if (places := self._places.get(t))), default=0)

    def _flush(self) -> None:
        if self._text:
            text = " ".join(unescape("".join(self._text)).split())
            if text:
                self.blocks.append((self._owner(), text, min(self._linked, len(text))))
        self._text, self._linked = [], 0

    def _pop(self, at: int) -> None:
        for i in self._open[at:]:
            tag = self.tag[i]
            self._places[tag].pop()
            self._links -= tag == "a"
            if tag not in INLINE:
                self._solid.pop()
        del self._open[at:]

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._text.append(" ")
            return
        if name not in INLINE:
            self._flush()
            ends = (*ENDS.get(name, ()), *(("p",) if name not in ("option", "td", "th", "tr") else ()))
            at = self._place(ends)
            if at and at >= self._place(BARRIERS):
                self._pop(at)
        given = {k.lower(): a or b or c for k, a, b, c in ATTRIBUTE.findall(attributes)} if attributes.strip(" /\n\t\r") else {}
        up = self._open[-1]
        named = f"{given.get('class', '')} {given.get('id', '')}"
        mark = name if name in ("article", "main") else given["role"] if given.get("role") in ("main", "article") else "main" if given.get("itemprop") == "articleBody" else ""
        inside = self.main[up] or bool(mark)
        drop = (
            self.dropped[up]
            or name in DROPPED
            or (name == "header" and not inside)
            or given.get("role") in ROLES
            or "hidden" in given
            or given.get("aria-hidden") == "true"
            or bool(HIDDEN.search(given.get("style", "")))
        )
        says = name not in ("html", "body", "article", "main") and (boilerplate(named) if self.main[up] else bool(NAMES.search(named)))
        doubtful = name == "form" or given.get("role") == "form" or says
        if name in VOID or attributes.endswith("/") and name in INLINE:
            return
        self.tag.append(name)
        self.parent.append(up)
        self.dropped.append(drop)
        self.main.append(inside)
        self.doubtful.append(doubtful)
        self.marks.append(mark)
        self._places.setdefault(name, []).append(len(self._open))
        if name not in INLINE:
            self._solid.append(len(self._open))
        self._open.append(len(self.tag) - 1)
        self._links += name == "a"

    def _end(self, name: str) -> None:
        if name not in INLINE:
            self._flush()
        at = self._place((name,))
        if at and (name not in INLINE or at > self._solid[-1]):  # an inline end tag does not reach out of its block
            self._pop(at)


def boilerplate(named: str) -> bool:
    """Whether class and id of an element inside the article name something that is not the article's."""
    for word in named.lower().split():
        parts = re.split(r"[_-]+", word)
        if word in ALONE or parts[0] in ALWAYS or parts[-1] in ALWAYS:
            return True
    return False


def remarks(tree: Tree) -> list[int]:
    """Elements under a heading that announces reader comments, the heading among them."""
    out = []
    for owner, text, _ in tree.blocks:
        if tree.tag[owner] in ("h2", "h3", "h4") and len(text) <= 80 and REMARKS.fullmatch(text):
            up = tree.parent[owner]
            around = tree.tag[up] in ("article", "main", "body", "html", "#root")
            out += [i for i in range(owner, len(tree.tag)) if tree.parent[i] == up] if around else [up]
    return out


def introduced(tree: Tree) -> set[int]:
    """Lists inside an article that come right after a block naming sources."""
    out, before = set(), ""
    around = [0] * len(tree.tag)
    for i in range(1, len(tree.tag)):
        around[i] = i if tree.tag[i] in ("ul", "ol", "dl") else around[tree.parent[i]]
    for owner, text, _ in tree.blocks:
        node = around[owner]
        if node and tree.main[node]:
            if node in out or SOURCES.search(before):
                out.add(node)
                continue
        before = text if len(text) <= 120 else ""
    return out


def sums(tree: Tree) -> tuple[list[int], list[int]]:
    """Characters and linked characters below each element."""
    chars, linked = [0] * len(tree.tag), [0] * len(tree.tag)
    for owner, text, links in tree.blocks:
        chars[owner] += len(text)
        linked[owner] += links
    for i in range(len(tree.tag) - 1, 0, -1):
        chars[tree.parent[i]] += chars[i]
        linked[tree.parent[i]] += linked[i]
    return chars, linked


def points_of(text: str, links: int) -> float:
    return (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))


def wrappers(tree: Tree) -> list[bool]:
    """Elements around a main element, an article that is not a mere comment or teaser, or most of the page."""
    below, around = [0.0] * len(tree.tag), [False] * len(tree.tag)
    for owner, text, links in tree.blocks:
        if not tree.dropped[owner]:
            below[owner] += points_of(text, links)
    for i in range(len(tree.tag) - 1, 0, -1):
        below[tree.parent[i]] += below[i]
    for i in range(len(tree.tag) - 1, 0, -1):
        mark = tree.marks[i] if below[i] else ""
        around[i] = around[i] or mark == "main" or (mark == "article" and below[i] >= MARKED_SHARE * below[0])
        around[tree.parent[i]] = around[tree.parent[i]] or around[i]
    # inside an article, another one is a teaser
    return [(a and not (i and tree.main[tree.parent[i]])) or b >= WRAPPER_SHARE * below[0] > 0 for i, (a, b) in enumerate(zip(around, below, strict=True))]


def main_blocks(html: str) -> list[str]:
    """The blocks of text of the main article, in page order."""
    tree = Tree(html)
    chars, linked = sums(tree)
    wrapper = wrappers(tree) if any(tree.doubtful) else []
    headed = [False] * len(tree.tag)
    for i in range(len(tree.tag) - 1, 0, -1):
        headed[tree.parent[i]] |= headed[i] or tree.tag[i] == "h1"
    sources = introduced(tree)
    for i in remarks(tree):
        tree.dropped[i] = True
    for i in range(1, len(tree.tag)):
        up = tree.parent[i]
        named = tree.doubtful[i] and not wrapper[i] and not (tree.main[up] and headed[i])
        menu = tree.tag[i] in BOXES and chars[i] and linked[i] >= MENU_DENSITY * chars[i] and i not in sources
        if tree.dropped[up] or named or menu:
            tree.dropped[i] = True
    points, given = [0.0] * len(tree.tag), Counter()
    for owner, text, links in tree.blocks:
        if not tree.dropped[owner]:
            given[owner if tree.tag[owner] in ("article", "main", "body", "div", "section", "#root") else tree.parent[owner]] += points_of(text, links)
    for node, got in given.items():  # blocks of one parent go up together
        level = 1
        while node >= 0:
            points[node] += got / level
            level += 1
            node = tree.parent[node]
    score = [p * (1 - linked[i] / chars[i]) if chars[i] else 0.0 for i, p in enumerate(points)]
    if not any(score):
        return []
    best = max(range(len(score)), key=lambda i: (score[i], -i))
    for kind in ("main", "article"):
        marked = [i for i, tag in enumerate(tree.tag) if tag == kind and not tree.dropped[i] and score[i] >= MARKED_SHARE * score[best]]
        best = max(marked, key=lambda i: (score[i], -i), default=best)
    kept = [False] * len(tree.tag)
    kept[best] = True
    if tree.tag[best] not in ("body", "html", "#root", "article", "main"):
        for i, up in enumerate(tree.parent):
            if up == tree.parent[best] and not tree.dropped[i]:
                short = tree.tag[i] in ("p", "pre", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "figure", "ul", "ol", "table")
                kept[i] = kept[i] or score[i] >= max(10.0, 0.2 * score[best]) or (short and chars[i] > 0 and linked[i] < 0.25 * chars[i])
    for i in range(1, len(tree.tag)):
        kept[i] = kept[i] or kept[tree.parent[i]]
    return [text for owner, text, _ in tree.blocks if kept[owner] and not tree.dropped[owner]]


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of every page.

    Null html, empty html and a page without a main text: empty text, 0. Null
    ids, null urls and repeated rows come back as they are. Equal scores: the
    container that opens first. Unclosed and stray tags are read leniently; a
    page of any length is read whole. Empty table: no rows. Other columns are
    ignored. No rows are shuffled.
    """

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blocks = [main_blocks(h) if h else [] for h in batch["html"].to_pylist()]
            texts = [" ".join(b) for b in blocks]
            yield pa.RecordBatch.from_arrays(
                [batch["page_id"], batch["url"], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64()), pa.array(map(len, blocks), pa.int64())],
                ["page_id", "url", "text", "n_chars", "n_blocks"],
            )

    page_id, url, html = only(pages, "page_id", "url", "html")
    read = pages.select(page_id.cast("long").alias("page_id"), url, F.coalesce(html, F.lit("")).alias("html"))
    return read.mapInArrow(extract, "page_id long, url string, text string, n_chars long, n_blocks long")

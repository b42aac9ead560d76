"""Main text of web pages by tag-path ratios (operator 6).

A page is read, in one pass, into blocks of text, each with its root-to-leaf tag path. Text length, punctuation and
link text are summed for each path and set against its number of blocks, smoothed along the order in which paths come
in the page, and fused with the best sibling under the same container. Element and class names only weigh a path's
score. Paths above a threshold are content; the article is the innermost element that holds most of their text, and
all its blocks are returned but those of paths that score as menus, adverts, comments and the like inside it.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Element names of HTML by their role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg canvas math textarea title head xmp noembed noframes".split())
BLOCK = frozenset(
    "html body address article aside blockquote center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
BOILERPLATE = frozenset("nav footer aside form menu dialog button select option datalist label fieldset legend input search".split())
#: An element of these closes an open one of the same group.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: And these bound the search for it.
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr"}, "th": {"tr"}, "option": {"select", "datalist"}}
#: Words of class, id and role that mark what is not the article.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsense|banner|sponsor(?:ed)?|promos?|promotions?|sidebar|side-bar|widgets?|comments?|commentlist|discussion|disqus|respond|repl(?:y|ies)|cookies?|consent|gdpr|notices?|popup|modal|overlay|newsletter|subscribe|signup|login|share|sharing|social|related|recommended|breadcrumbs?|menu|nav|navbar|navigation|footer|header|masthead|toolbar|pagination|pager|complementary|contentinfo|search|skip|hidden)(?:$|[\s_-])",
    re.I,
)
#: Elements to which those words are not applied.
NEVER_NAMED = frozenset(("html", "body", "article", "main"))
ARTICLE = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: How names weigh the text of a path: inside an article element, inside one with a name of boilerplate.
FOR, AGAINST = 10.0, 0.01

NAME = re.compile(r"(/?)([A-Za-z][^\s/>]*)")
#: The rest of a tag: quotes hold a value only after an equals sign.
REST = re.compile(r"(?:[^>=]++|=\s*+(?:\"[^\"]*\"|'[^']*')?)*+>")
ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
PUNCTUATION = re.compile(r"[.,;:!?。，；：！？]")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)


@dataclass(slots=True)
class _Element:
    name: str
    serial: int  # its own where it is a block element, else that of the one around it
    named: int  # how many of it and its ancestors have a name of boilerplate
    path: int


NONE = _Element("", 0, 0, 0)


@dataclass(slots=True)
class _Block:
    element: int  # the innermost block element
    path: int
    named: int
    inside: bool  # an article element
    heading: bool
    parts: list[str]
    links: int = 0
    text: str = ""


def _is_named(name: str, attributes: str, inside_article: bool, lists: bool) -> bool:
    """Whether an element's name or attributes speak of boilerplate; without `lists` only hidden ones count."""
    if lists and (name in BOILERPLATE or (name == "header" and not inside_article)):
        return True
    if not attributes or name in NEVER_NAMED:
        return False
    for key, *values in ATTRIBUTE.findall(attributes):
        key, value = key.lower(), next((v for v in values if v), "")
        if lists and key in ("class", "id", "role") and NAMED.search(value):
            return True
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDDEN.search(value)):
            return True
    return False


class Page:
    """The blocks of a page in order, its elements and its paths; read in time linear in its length."""

    def __init__(self, page: str, lists: bool = True):
        self.page, self.lists = page, lists
        self.blocks: list[_Block] = []
        self.parent = [0]  # of each block element, by serial; 0 is the page
        self.up = [0]  # the parent of each path
        self.paths: dict[tuple[int, str], int] = {}
        self.stack: list[_Element] = []
        self.where: dict[str, list[int]] = defaultdict(list)  # places of open elements by name; "" for all block elements
        self.missing: set[str] = set()  # elements known to have no end tag further on
        self.articles = self.headings = 0  # open elements of these kinds
        self.now = _Block(0, 0, 0, False, False, [])
        self._read()

    def _flush(self) -> None:
        now = self.now
        if now.parts and (text := " ".join(html.unescape("".join(now.parts)).split())):
            now.text = text
            self.blocks.append(now)
        top = self.stack[-1] if self.stack else NONE
        self.now = _Block(top.serial, top.path, top.named, self.articles > 0, self.headings > 0, [])

    def _say(self, text: str) -> None:
        if text:
            self.now.parts.append(text)
            if self.where["a"]:
                self.now.links += len(text.strip())

    def _pop(self, depth: int) -> bool:
        """Close all elements from a depth on; whether that ends the block."""
        ends = False
        for e in reversed(self.stack[depth:]):
            self.where[e.name].pop()
            if e.name in BLOCK:
                self.where[""].pop()
                self.articles -= e.name in ARTICLE
                self.headings -= e.name in HEADINGS
                ends = True
            ends |= e.named > 0
        del self.stack[depth:]
        return ends

    def _open(self, name: str, attributes: str) -> None:
        if name in BLOCK or name in CLOSES:
            low = max((self.where[n][-1] for n in SCOPE[name] if self.where[n]), default=-1) if name in SCOPE else -1
            above = [w[k] for n in ("p", *CLOSES.get(name, ())) if (w := self.where[n]) and (k := bisect_right(w, low)) < len(w)]
            if above:
                self._pop(min(above))
        top = self.stack[-1] if self.stack else NONE
        named = _is_named(name, attributes, self.articles > 0, self.lists)
        path, serial, block = top.path, top.serial, name in BLOCK
        if block or top is NONE:
            path = self.paths.setdefault((path, name), len(self.up))
            if path == len(self.up):
                self.up.append(top.path)
        if block:
            self.parent.append(serial)
            serial = len(self.parent) - 1
            self.where[""].append(len(self.stack))
            self.articles += name in ARTICLE
            self.headings += name in HEADINGS
        self.where[name].append(len(self.stack))
        self.stack.append(_Element(name, serial, top.named + named, path))
        if block or named:
            self._flush()

    def _close(self, name: str) -> None:
        if not (places := self.where[name]):
            return
        depth = places[-1]
        if name not in BLOCK and self.where[""] and self.where[""][-1] > depth:
            return
        if self._pop(depth):
            self._flush()

    def _after(self, name: str, at: int) -> int | None:
        """The place after the next end tag of an element, if there is one."""
        if name in self.missing:
            return None
        end = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.page, at)
        close = self.page.find(">", end.end()) if end else -1
        if close < 0:
            self.missing.add(name)
            return None
        return close + 1

    def _read(self) -> None:
        page, at, size = self.page, 0, len(self.page)
        while at < size:
            start = page.find("<", at)
            if start < 0:
                self._say(page[at:])
                break
            self._say(page[at:start])
            if page.startswith("<!--", start):
                end = page.find("-->", start + 4)
                at = end + 3 if end >= 0 else size
                continue
            m = NAME.match(page, start + 1)
            if m is None and not page.startswith(("<!", "<?", "</"), start):
                self._say("<")
                at = start + 1
                continue
            if m is None:
                end = page.find(">", start)
                at = end + 1 if end >= 0 else size
                continue
            rest = REST.match(page, m.end())
            if rest is None:  # the page ends inside the tag
                break
            at, name, attributes = rest.end(), m[2].lower(), page[m.end() : rest.end() - 1]
            if m[1]:
                self._close(name)
            elif name in RAW:
                if not attributes.rstrip().endswith("/"):
                    end = self._after(name, at)
                    if end is not None or name != "head":
                        at = size if end is None else end
            elif name in VOID:
                self.now.parts.append(" ")
                if name == "hr":
                    self._flush()
            else:
                self._open(name, attributes)
        self._flush()


def path_scores(page: Page, width: int = 1) -> dict[int, float]:
    """The smoothed, fused ratio of each path, weighed by names."""
    length, marks, links, weight, count = (defaultdict(float) for _ in range(5))
    for b in page.blocks:
        length[b.path] += len(b.text)
        marks[b.path] += len(PUNCTUATION.findall(b.text))
        links[b.path] += b.links
        weight[b.path] += _weight(b) * len(b.text)
        count[b.path] += 1
    order = list(length)
    raw = [max(0.0, length[p] - 2 * links[p]) / count[p] * (1 + marks[p] / count[p]) * weight[p] / length[p] for p in order]
    fused = {}
    for k, p in enumerate(order):
        near = raw[max(0, k - width) : k + width + 1]
        fused[p] = (raw[k] * sum(near) / len(near)) ** 0.5
    best: dict[int, float] = defaultdict(float)
    for p, v in fused.items():
        best[page.up[p]] = max(best[page.up[p]], v)
    return {p: (v + best[page.up[p]]) / 2 for p, v in fused.items()}


def _weight(b: _Block) -> float:
    return AGAINST if b.named else FOR if b.inside else 1.0


def main_text(page: str | None, threshold: float = 0.5, width: int = 1, lists: bool = True) -> str:
    """The article's text: its blocks in page order, white space folded, joined by newlines; '' where there is none.

    Without `lists`, names of elements and classes that speak of boilerplate say nothing. Where all text of a page has
    such a name, it must outweigh them as any path must: 10 / AGAINST characters at least.
    """
    read = Page(page or "", lists)
    if not read.blocks:
        return ""
    score = path_scores(read, width)
    cut = threshold * max(score.values())
    mass = [0.0] * len(read.parent)
    own: dict[int, float] = defaultdict(float)
    for b in read.blocks:
        if score[b.path] >= cut:
            own[b.element] += len(b.text) * score[b.path]
    if all(b.named for b in read.blocks) and sum(len(b.text) for b in read.blocks) < 10 / AGAINST:
        return ""
    for serial, m in own.items():
        mass[serial] += m
    for serial in range(len(mass) - 1, 0, -1):  # an element comes after its parent
        mass[read.parent[serial]] += mass[serial]
    # Down from the page into the element that holds most, while one does and it is not a single block of text.
    children: dict[int, list[int]] = defaultdict(list)
    holds = {read.parent[serial] for serial in range(1, len(mass))}
    for serial in range(1, len(mass)):
        children[read.parent[serial]].append(serial)
    at = 0
    while children[at]:
        best = max(children[at], key=lambda k: (mass[k], -k))
        if mass[best] <= 0.5 * mass[at] or best not in holds:
            break
        at = best
    inside = [False] * len(mass)
    inside[at] = True
    for serial in range(at + 1, len(mass)):
        inside[serial] = inside[read.parent[serial]]
    held = [b for b in read.blocks if inside[b.element]]
    level = min((b.named for b in held), default=0)  # names above the article say nothing inside it
    length, links = defaultdict(int), defaultdict(int)
    for b in held:
        length[b.path] += len(b.text)
        links[b.path] += b.links

    def stays(b: _Block) -> bool:
        if b.named > level:
            return False
        return b.heading or score[b.path] >= cut or links[b.path] <= 0.8 * length[b.path]

    return "\n".join(b.text for b in held if stays(b))


def extract(pages: DataFrame, threshold: float = 0.5, width: int = 1) -> DataFrame:
    """pages(page_id, url, html) -> page_id, url, text, n_chars (code points), a row for each input row.

    Null or empty html, and pages without text, give ''. Whole pages are read, however long; equal pages give
    equal texts; columns beside these three are not read.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py(), threshold, width) for h in batch.column(2)]
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, "page_id long, url string, text string, n_chars long")

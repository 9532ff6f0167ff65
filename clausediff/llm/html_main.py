"""Main text of web pages by tree scoring.

A page is read once into a tree of its block elements. Each paragraph gives points for its
length and its commas to its ancestors (in full to the parent, half to the next, less
further up), and a container's points are discounted by its share of linked text. The best
container and the siblings that read like it are kept; menus, notices, adverts, forms,
comments and the like are left out wherever they stand. Class names that also name other things
leave out an element only where the rest of the page has text enough without it. The limits
(25 and 80 characters, 0.2 of the best, link density 0.25) are those of a well-known public scoring
method. Pages are independent of each other, so Spark only deals them out; nothing is shuffled.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

# Fixed values of HTML: elements by what a reader of the page does with them.
SKIPPED_RAW = frozenset("script style noscript template iframe textarea title noembed noframes xmp".split())
SKIPPED = frozenset("nav header footer aside form button select svg math object canvas audio video dialog menu fieldset head datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var nobr".split()
)
ENDS_P = frozenset(
    "address article aside blockquote center details dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr main menu nav ol p pre section table ul summary".split()
)
SAME_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
STOPS = frozenset("ul ol dl table article section main div body html blockquote".split())
BASE = {"article": 30.0, "main": 20.0, "div": 5.0, "section": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "ul": -3.0, "ol": -3.0, "dl": -3.0, "li": -3.0, "body": -5.0, "html": -50.0}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol dl div section table".split())
NEVER_DROPPED = frozenset("article main body html".split())
#: Words of a class, id or role that name something other than the article, always or mostly.
UNWANTED = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored sponsors promo promoted promotion sidebar "
    "rail comments commentlist disqus respond replies cookie cookies consent gdpr notices popup modal overlay newsletter "
    "subscribe subscription signup paywall share sharing menu nav navbar navigation breadcrumb breadcrumbs pagination pager toc "
    "footer foot header masthead topbar recommended recommendations widget widgets hidden search toolbar complementary contentinfo".split()
)
DOUBTFUL = frozenset("side comment reply discussion notice alert social related more skip login form tags".split())
#: Of the doubtful ones, what readers write.
REMARKS = frozenset("comment reply discussion".split())
#: A doubtful container that has so many times the text of all others is no aside.
OUTWEIGHS = 4
#: Tags in a page whose quotes never close; later ones end at the next > whatever their quotes.
BROKEN_TAGS = 16
_TAG = re.compile(r"<(?:(!--)|(/?)([a-zA-Z][^\s/>]*)|[!?/])")
_COMMENT_END = re.compile(r"--!?>")
_QUOTE_OR_END = re.compile(r"""["'>]""")
_NAMES = re.compile(r"""(?:\s|^)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>?", re.I) for t in SKIPPED_RAW}
_STOPS_P = ENDS_P - {"p"}
_WALLS = frozenset(("article", "main", "body"))
_BEHIND_WALLS = frozenset("p li td th dt dd span".split())

FINE, DOUBT, REMARK, GONE = range(4)


def _named(attributes: str) -> int:
    """What an element's attributes say of it: FINE, DOUBT, REMARK or GONE."""
    found = FINE
    for m in _NAMES.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return GONE
        if name in ("class", "id", "role"):
            words = {p.lower() for p in _PART.findall(value)}
            if words & UNWANTED:
                return GONE
            found = max(found, REMARK if words & REMARKS else DOUBT if words & DOUBTFUL else FINE)
    return found


class _Page:
    """The block elements of one page in document order, and their text blocks. The parser never
    looks back and never searches the open elements: where each tag is open is kept in lists."""

    def __init__(self, html: str):
        self.tag, self.parent, self.gone, self.doubt = ["#"], [-1], [False], [-1]  # doubt: the nearest doubtful element, itself included
        self.remark: set[int] = set()
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters in links
        self.open = [0]
        self.open_at: dict[str, list[int]] = {}  # where in open each tag is
        self.stops = {kinds: [] for kinds in (_STOPS_P, STOPS, _WALLS)}
        self.seen: set[str] = set()
        self.words: list[str] = []
        self.linked, self.in_link = 0, 0
        self.read(html)
        self.close_block()
        if not self.seen & {"html", "body"}:
            self.tag[0] = "body"  # both tags may be left out

    def read(self, html: str) -> None:
        at, last, broken = 0, html.rfind(">"), 0
        look = 0
        while m := _TAG.search(html, look):
            if m[1]:
                e = _COMMENT_END.search(html, m.end())
                end, attributes = e.end() if e else len(html), ""
            elif m[3] and m.end() <= last:
                end = self.tag_end(html, m.end()) if broken < BROKEN_TAGS else -1
                if end < 0:
                    broken += 1
                    end = html.index(">", m.end()) + 1
                attributes = html[m.end() : end - 1]
            elif m[3] and not m[2]:
                look = m.end()  # a tag that never ends is text
                continue
            else:
                end = html.find(">", m.end()) + 1 or len(html)
            if m.start() > at:
                self.text(html[at : m.start()])
            at = end
            if m[3] and m.end() <= last:
                name = m[3].lower()
                if m[2]:
                    self.end(name)
                elif name in SKIPPED_RAW:
                    at = e.end() if (e := _RAW_END[name].search(html, at)) else len(html)
                else:
                    self.start(name, attributes)
            look = at
        if at < len(html):
            self.text(html[at:])

    @staticmethod
    def tag_end(html: str, at: int) -> int:
        """Behind the > that ends a tag, quoted ones apart; -1 if there is none."""
        while m := _QUOTE_OR_END.search(html, at):
            if m[0] == ">":
                return m.end()
            at = html.find(m[0], m.end()) + 1
            if not at:
                return -1
        return -1

    def text(self, raw: str) -> None:
        if self.gone[self.open[-1]]:
            return
        raw = unescape(raw) if "&" in raw else raw
        self.words.append(raw)
        if self.in_link:
            self.linked += len(raw.strip())

    def close_block(self) -> None:
        if self.words:
            if text := " ".join("".join(self.words).split()):
                self.blocks.append((self.open[-1], text, min(self.linked, len(text))))
            self.words = []
        self.linked = 0

    def start(self, name: str, attributes: str) -> None:
        if name in INLINE:
            self.in_link += name == "a"
            if name != "a" and attributes and not self.gone[self.open[-1]] and _named(attributes):
                self.push(name, GONE)
            return
        if name == "br":
            self.words.append(" ")
            return
        if name in VOID:
            if name == "hr":
                self.close_block()
            return
        if name in ("html", "body") and name in self.seen:
            return
        self.in_link = 0
        if name in ENDS_P:
            self.pop_to(("p",), _STOPS_P)
        if name in SAME_END:
            self.pop_to(SAME_END[name], STOPS)
        self.push(name, GONE if name in SKIPPED else _named(attributes) if attributes and name not in NEVER_DROPPED else FINE)

    def push(self, name: str, named: int) -> None:
        if name not in INLINE:
            self.close_block()
        up, me = self.open[-1], len(self.tag)
        self.tag.append(name)
        self.seen.add(name)
        self.parent.append(up)
        self.gone.append(self.gone[up] or named == GONE)
        self.doubt.append(me if named in (DOUBT, REMARK) else self.doubt[up])
        if named == REMARK:
            self.remark.add(me)
        self.open_at.setdefault(name, []).append(len(self.open))
        for kinds, places in self.stops.items():
            if name in kinds:
                places.append(len(self.open))
        self.open.append(me)

    def cut(self, k: int) -> None:
        """Closes the open elements from the k-th on."""
        for e in reversed(self.open[k:]):
            name = self.tag[e]
            self.open_at[name].pop()
            for kinds, places in self.stops.items():
                if name in kinds:
                    places.pop()
        del self.open[k:]

    def last(self, *names: str) -> int:
        return max((self.open_at[n][-1] for n in names if self.open_at.get(n)), default=-1)

    def pop_to(self, names: tuple[str, ...], stops: frozenset) -> None:
        k = self.last(*names)
        if k > 0 and k > max(self.stops[stops][-1:], default=-1):
            self.close_block()
            self.cut(k)

    def end(self, name: str) -> None:
        if name == "a":
            self.in_link = max(0, self.in_link - 1)
        if name in INLINE:
            if self.tag[self.open[-1]] == name:
                self.cut(len(self.open) - 1)
            return
        if name in VOID or name in ("body", "html"):
            return
        k = self.last(name)
        if k > 0 and not (name in _BEHIND_WALLS and k < max(self.stops[_WALLS][-1:], default=-1)):
            self.close_block()
            self.cut(k)

    def judge(self) -> None:
        """Elements of doubtful names go, but for one that holds the page's only text, or far more
        of it than all else does (readers' remarks: only the first)."""
        held: dict[int, float] = {}
        for least in (25, 0):
            for e, text, links in self.blocks:
                if not self.gone[e] and len(text) >= least and self.tag[e] not in HEADINGS:
                    held[self.doubt[e]] = held.get(self.doubt[e], 0.0) + len(text) - links
            if any(held.values()):
                break
        rest = held.pop(-1, 0.0)
        cleared: set[int] = set()
        if held:
            best = max(held, key=lambda e: (held[e], -e))
            chain, e = [], best
            while e >= 0:
                chain.append(e)
                e = self.doubt[self.parent[e]]
            if not rest or held[best] >= OUTWEIGHS * rest and not self.remark.intersection(chain):
                cleared.update(chain)
        for e in range(1, len(self.tag)):
            self.gone[e] = self.gone[e] or self.doubt[e] >= 0 and self.doubt[e] not in cleared
        self.blocks = [b for b in self.blocks if not self.gone[b[0]]]


def main_text(html: str | None) -> str:
    """The page's main text, a line for each block; '' for null or without text."""
    if not html:
        return ""
    page = _Page(html)
    page.judge()
    n = len(page.tag)
    size, linked, points = [0] * n, [0] * n, [BASE.get(t, 0.0) for t in page.tag]
    given = [False] * n
    for e, text, links in page.blocks:
        size[e] += len(text)
        linked[e] += links
        if len(text) >= 25 and page.tag[e] not in HEADINGS:
            worth = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - links / len(text))
            up = page.parent[e] if page.tag[e] in ("p", "pre", "li", "td", "dd", "blockquote", "h1") else e
            share = 1.0
            for step in range(5):
                if up < 0:
                    break
                points[up] += worth * share
                given[up] = True
                up, share = page.parent[up], 1 / (2 * (step + 1))
    for e in range(n - 1, 0, -1):
        size[page.parent[e]] += size[e]
        linked[page.parent[e]] += linked[e]
    dense = lambda e: linked[e] / size[e] if size[e] else 0.0
    final = [points[e] * (1 - dense(e)) for e in range(n)]
    good = [e for e in range(n) if given[e] and not page.gone[e]]
    if good:
        best = max(good, key=lambda e: (final[e], -e))
    else:
        best = next((e for t in ("article", "main", "body") for e in range(n) if page.tag[e] == t and not page.gone[e]), 0)
    least = max(10.0, 0.2 * final[best])
    keep = [False] * n
    for e in range(n):
        p = page.parent[e]
        if page.gone[e]:
            continue
        if e == best:
            keep[e] = True
        elif p >= 0 and keep[p]:
            keep[e] = not (page.tag[e] in LISTS and size[e] and dense(e) > 0.5)
        elif p == page.parent[best] and (p > 0 or page.tag[0] == "body" and p == 0):
            tag = page.tag[e]
            keep[e] = given[e] and final[e] >= least or tag in HEADINGS and dense(e) < 0.3 or tag == "p" and size[e] > 80 and dense(e) < 0.25
    return "\n".join(text for e, text, _ in page.blocks if keep[e])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html). A null html
    gives an empty text; repeated rows repeat. No text is cut or left out for its length."""

    def run(batches):
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], ["page_id", "url", "text", "n_chars"]
            )

    return pages.select("page_id", "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

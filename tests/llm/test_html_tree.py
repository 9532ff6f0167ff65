"""Main text of pages against a plain tree scorer over a DOM that html.parser builds; hard pages."""

import random
import time
from html.parser import HTMLParser

import pytest

VOID = {"br", "hr", "img"}
INLINE = {"a", "b", "span", "em"}
SKIPPED = {"nav", "header", "footer", "aside", "form", "script", "style"}
BASE = {"article": 30, "main": 20, "div": 5, "section": 5, "td": 3, "blockquote": 3, "ul": -3, "li": -3, "body": -5, "html": -50}
SURE, UNSURE, REMARKS = {"sidebar", "comments", "ad"}, {"side", "more", "related", "comment"}, {"comment"}


class Node:
    def __init__(self, tag, attrs, up):
        self.tag, self.up, self.children = tag, up, []
        words = set((dict(attrs).get("class") or "").split())
        drop = tag not in ("article", "main", "body", "html")
        self.gone = bool(up and up.gone) or tag in SKIPPED or drop and bool(words & SURE)
        self.unsure = drop and not (words & SURE) and bool(words & UNSURE)
        self.remark = bool(words & REMARKS)
        self.doubt = self if self.unsure else up.doubt if up else None


class Dom(HTMLParser):
    def __init__(self, html):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#", [], None)
        self.feed(html)
        self.close()

    def handle_starttag(self, tag, attrs):
        node = Node(tag, attrs, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag):
        self.at = self.at.up

    def handle_data(self, data):
        self.at.children.append(data)


def brute_text(html):
    root, blocks, nodes = Dom(html).root, [], []
    words, links = [], [0]

    def close(node):
        if text := " ".join("".join(words).split()):
            blocks.append((node, text, min(links[0], len(text))))
        words.clear()
        links[0] = 0

    def inline(node, linked):
        for c in node.children:
            if isinstance(c, str):
                words.append(c)
                links[0] += len(c.strip()) if linked else 0
            elif c.tag == "br":
                words.append(" ")
            elif not (c.gone or c.unsure):
                inline(c, linked or c.tag == "a")

    def block(node):
        nodes.append(node)
        for c in node.children:
            if isinstance(c, str):
                if not node.gone:
                    words.append(c)
            elif c.tag == "br":
                words.append(" ")
            elif c.tag == "hr":
                close(node)
            elif c.tag in INLINE:
                if not (node.gone or c.gone or c.unsure):
                    inline(c, c.tag == "a")
            else:
                close(node)
                block(c)
                close(c)
        close(node)

    block(root)
    blocks = [b for b in blocks if not b[0].gone]
    # doubtful elements
    held = {}
    for least in (25, 0):
        for node, text, linked in blocks:
            if len(text) >= least and node.tag not in ("h1", "h2"):
                held[node.doubt] = held.get(node.doubt, 0) + len(text) - linked
        if any(held.values()):
            break
    rest = held.pop(None, 0)
    cleared = set()
    if held:
        best = max(held, key=lambda n: (held[n], -nodes.index(n)))
        chain, n = [], best
        while n:
            chain.append(n)
            n = n.up.doubt
        if not rest or held[best] >= 4 * rest and not any(n.remark for n in chain):
            cleared = set(chain)
    gone = lambda n: n.gone or n.doubt is not None and n.doubt not in cleared
    blocks = [b for b in blocks if not gone(b[0])]
    # points
    points, given = {n: BASE.get(n.tag, 0) for n in nodes}, set()
    for node, text, linked in blocks:
        if len(text) >= 25 and node.tag not in ("h1", "h2"):
            worth = (1 + text.count(",") + min(len(text) / 100, 3)) * (1 - linked / len(text))
            up = node.up if node.tag in ("p", "td", "li", "blockquote") else node
            for share in (1, 1 / 2, 1 / 4, 1 / 6, 1 / 8):
                if up is not None:
                    points[up] += worth * share
                    given.add(up)
                    up = up.up

    def total(n, which):
        return sum(b[which] if which == 2 else len(b[1]) for b in blocks if n in lineage(b[0]))

    def lineage(n):
        while n is not None:
            yield n
            n = n.up

    dense = lambda n: total(n, 2) / total(n, 1) if total(n, 1) else 0
    final = {n: points[n] * (1 - dense(n)) for n in nodes}
    good = [n for n in nodes if n in given and not gone(n)]
    best = max(good, key=lambda n: (final[n], -nodes.index(n))) if good else next((n for t in ("article", "main", "body") for n in nodes if n.tag == t and not gone(n)), root)
    keep = set()
    for n in nodes:
        if gone(n):
            continue
        if n is best:
            keep.add(n)
        elif n.up in keep:
            if not (n.tag in ("ul", "div", "section", "table") and total(n, 1) and dense(n) > 0.5):
                keep.add(n)
        elif n.up is best.up and n.up is not None and n.up is not root:
            if n in given and final[n] >= max(10, 0.2 * final[best]) or n.tag in ("h1", "h2") and dense(n) < 0.3 or n.tag == "p" and total(n, 1) > 80 and dense(n) < 0.25:
                keep.add(n)
    return "\n".join(text for n, text, _ in blocks if n in keep)


def page(rng):
    def words(n):
        return " ".join(rng.choice(["word", "and,", "a", "longer", "text.", "x &amp; y", "\n"]) for _ in range(n))

    def attributes():
        return f' class="{rng.choice([*SURE, *UNSURE, "post", "lead text"])}"' if rng.random() < 0.25 else ""

    def text():
        out = ""
        for _ in range(rng.randrange(1, 4)):
            kind = rng.choice(["", "", "a", "b", "span"])
            body = words(rng.randrange(1, 25))
            out += f" <{kind}{attributes() if kind != 'a' else ' href=x'}>{body}</{kind}>" if kind else " " + body
        return out + rng.choice(["", "<br>more"])

    def element(depth):
        kind = rng.choice(["p", "p", "p", "h2", "ul", "div", "div", "section", "article", "nav", "aside", "blockquote"]) if depth < 4 else "p"
        if kind in ("p", "h2"):
            return f"<{kind}{attributes()}>{text()}</{kind}>"
        if kind == "ul":
            return f"<ul{attributes()}>" + "".join(f"<li{attributes()}>{text()}</li>" for _ in range(rng.randrange(4))) + "</ul>"
        return f"<{kind}{attributes()}>" + rng.choice(["", words(8)]) + "".join(element(depth + 1) for _ in range(rng.randrange(5))) + f"</{kind}>"

    return f"<html><body>{''.join(element(0) for _ in range(rng.randrange(1, 6)))}</body></html>"


def test_pages_against_a_dom():
    from clausediff.llm.html_main import main_text

    rng = random.Random(11)
    found = 0
    for _ in range(1500):
        html = page(rng)
        assert main_text(html) == brute_text(html), html
        found += bool(main_text(html))
    assert found > 1200


@pytest.mark.parametrize("name", "read-more more-text side tags social login notice skip form related-work comment-law".split())
def test_class_words_that_name_the_article(name):
    from clausediff.llm.html_main import main_text

    said = "This is a sentence, with words. " * 8
    assert main_text(f"<body><h1>T</h1><div class='{name}'><p>{said}</p></div><p>short</p></body>") == f"T\n{said.strip()}"
    # beside an article it goes, as before
    both = f"<body><div><p>{said}</p><p>{said}</p></div><div class='{name}'><p>Aside, and not of the article itself.</p></div></body>"
    assert main_text(both) == f"{said.strip()}\n{said.strip()}"


def test_remarks_longer_than_the_article():
    from clausediff.llm.html_main import main_text

    remarks = "".join(f"<div class='comment'><p>I think so, and so do we all here, number {i}.</p></div>" for i in range(200))
    assert main_text(f"<article><p>{'The article, at last. ' * 5}</p></article>{remarks}") == ("The article, at last. " * 5).strip()


@pytest.mark.parametrize("unit, rest", [("<div>", "</section>"), ('<a x="', ""), ("<x-y>", "<address></address>"), ("<p><div><x-y>", "</p><hr>"), ("<body>", ""), ("<a x='\">", ""), ("<td><table>", "</td>"), ("<!--", ""), ("<", "&"), ("<p class='", ""), ("<li class=more>", "x")])
def test_hard_pages(unit, rest):
    from clausediff.llm.html_main import main_text

    n = 400_000 // len(unit + rest)
    began = time.process_time()
    main_text(unit * n + rest * n)
    assert time.process_time() - began < 4  # a megabyte takes a second or so

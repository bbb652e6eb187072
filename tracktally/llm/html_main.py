"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements. What can't be article text is left out as the
tree is built: scripts, styles, menus, headers, footers, sidebars, notices, adverts, forms,
reader comments, hidden elements. Every paragraph gives points for its length and commas
to its ancestors, half to the next one up and ever less up to the root; a container's points
are discounted by the share of its text that is in links. The best container, or the article or
main element it stands in, is kept with those siblings that score well or are its headings.
Without either, the smallest container of the sections that score well, and of what stands
beside a single one, is kept with all of its blocks but those that are mostly links.

An element that only its class or id speaks against can also be a wrapper around the article
(``content-sidebar-wrap``), and so can a form, fieldset, aside or dialog. It is judged when the whole page is read, and stays if it holds
the main element, or what the page has of articles and first headings, or most of the points
outside links while no article stands beside it.

NULL, empty and text-free pages give the empty text. Blocks stand in page order, each with
white space turned into single blanks, joined by an empty line. A page is handled whole and
alone, in time near linear in its length. Of broken markup: an unclosed quote is part of its
word; a tag that the page does not finish, and all tags after it, end before the next ``<``;
elements of skipped content without an end tag lose only their start tag, but for scripts and styles,
which go on to the end of the page, as unclosed comments do.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from itertools import accumulate

from pyspark.sql import DataFrame

from tracktally.llm.common import add_columns, texts_of

#: Attributes: a quote opens a value only after ``=``, and only if it is closed somewhere.
ATTRIBUTES = r"""(?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>]*+))?+)*+[\s/]*+"""
TOKEN = re.compile(
    r"<(?:!--(?:-?>|.*?(?:--!?>|\Z))|!\[CDATA\[.*?(?:\]\]>|\Z)|(?:[!?]|/(?![a-zA-Z]))[^>]*+>"
    rf"|(/?)([a-zA-Z][^\s/>]*+)({ATTRIBUTES})>)",
    re.S,
)
#: From the first tag on that the page does not finish, a tag ends at any ``>`` or before the next ``<``.
BROKEN = re.compile(r"<(?:[!?]|/(?![a-zA-Z])|(/?)([a-zA-Z][^\s/<>]*+))([^<>]*+)>?+")
MARKUP = re.compile(r"<[a-zA-Z/!?]")
#: Elements whose content is text up to their own end tag.
RAW = {x: re.compile(rf"</{x}\s*>", re.I) for x in ("script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp")}
#: Those of them whose content goes with them where that end tag is missing.
CODE = frozenset(["script", "style"])
#: Those of them that ``/>`` ends at once.
SINGLE_TAGS = frozenset(["svg", "iframe"])
DROPPED = frozenset("head nav footer button select menu object audio video canvas map".split())
#: Elements that can also hold the main text, so they are judged when the whole page is read.
JUDGED = frozenset("form fieldset aside dialog".split())
BLOCKS = frozenset(
    "html body article section main div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table caption thead tbody tfoot tr td th"
    " blockquote pre figure figcaption hr address details summary header center hgroup search".split()
) | DROPPED | JUDGED
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Start tags that end an open element of the kinds named.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
CLOSE_STOPS = frozenset("ul ol dl table article section main div body".split()) | JUDGED
VOID = frozenset(["hr"])
NAMES = re.compile(
    r"""(?:^|[\s_-])(?:ad|ads|advert\w*|banner|cookies?|consent|notice|notices|alert|sidebar|side|menu|nav|navbar|navigation|"""
    r"""breadcrumbs?|comments?|disqus|respond|share|sharing|social|promo|sponsor(?:ed)?|popup|modal|newsletter|subscribe|signup|"""
    r"""related|recommended|footer|masthead|skip)(?=$|[\s_-])""",
    re.I,
)
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar".split())
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
#: Points that a container starts with.
START = {"article": 25.0, "main": 25.0, "section": 5.0, "div": 5.0, "pre": 3.0, "td": 3.0, "blockquote": 3.0, "th": -5.0, "ul": -3.0, "ol": -3.0, "li": -3.0}
KEPT_NAMES = frozenset(["article", "main", "body", "html"])
#: Reader comments can outweigh the article, so points don't speak for elements of these names.
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|disqus|respond)(?=$|[\s_-])", re.I)
#: Share of its text in links from which a block of a page without an article is left out.
LINKED = 0.5
#: Elements that are one piece of what they stand in.
SINGLE = HEADINGS | frozenset("p pre blockquote li dt dd tr td th caption figcaption".split())
#: Elements that are parts of one table or list.
PARTS = frozenset("li dt dd ul ol dl tr td th thead tbody tfoot table caption".split())


class Node:
    __slots__ = ("children", "dropped", "length", "linked", "named", "own", "parent", "score", "tag")

    def __init__(self, tag: str, parent: Node | None, dropped: bool):
        self.tag, self.parent, self.dropped = tag, parent, dropped
        self.children: list[Node | str] = []
        self.score = START.get(tag, 0.0)
        self.length = self.linked = 0
        self.own = 0.0  # points of its own blocks outside links
        self.named = ""  # class and id, or the kind, where they speak against it


def unwanted(tag: str, rest: str, article: bool) -> bool | str:
    """Whether an element is left out with all it holds; what else speaks against it.

    ``article``: it stands in an article or main element.
    """
    if tag in DROPPED:
        return True
    if tag == "header":  # an article's own header holds its title
        return not article
    kind = tag if tag in JUDGED else ""
    if not rest or rest == "/":
        return kind
    held = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)}
    if "hidden" in held or held.get("aria-hidden", "").lower() == "true":
        return True
    if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", held.get("style", ""), re.I):
        return True
    if held.get("role", "").lower() in ROLES:
        return True
    names = f"{held.get('class', '')} {held.get('id', '')}"
    return f"{kind} {names}" if tag not in KEPT_NAMES and NAMES.search(names) else kind


def parse(html: str) -> tuple[Node, list[Node]]:
    """The tree of block elements without the unwanted ones, and its nodes in page order."""
    root = Node("#root", None, False)
    node, nodes, pending, links, linked = root, [root], [], 0, 0
    held: list[tuple[Node, str]] = []  # every block with what it stands in
    at = 0

    def flush():
        """What was read since the last block boundary becomes one block of text."""
        nonlocal pending, linked
        if pending:
            text = "".join(pending)
            if "&" in text:
                text = unescape(text)
            if not node.dropped and (text := " ".join(text.split())):
                node.children.append(text)
                node.length += len(text)
                node.linked += min(linked, len(text))
                held.append((node, text))
                if node.tag not in HEADINGS:
                    node.own += worth_of(text) * (1.0 - min(1.0, linked / len(text)))
            pending = []
        linked = 0

    token, opened, endless = TOKEN, Counter(), set()
    while start := MARKUP.search(html, at):
        start = start.start()
        if not (m := token.match(html, start)):
            token = BROKEN
            m = token.match(html, start)
        if start > at and not node.dropped:
            pending.append(html[at:start])
            if links:
                linked += start - at
        at = m.end()
        if (tag := m[2]) is None:
            continue
        tag = tag.lower()
        if tag in RAW:
            if not m[1] and tag not in endless and not (tag in SINGLE_TAGS and m[3].endswith("/")):
                if end := RAW[tag].search(html, at):
                    at = end.end()
                elif tag in CODE:
                    at = len(html)
                else:
                    endless.add(tag)
        elif tag == "a":
            links = max(0, links - 1) if m[1] else 1
        elif tag in BLOCKS:
            flush()
            links = 0
            if m[1]:
                if opened[tag]:
                    while node.tag != tag:
                        opened[node.tag] -= 1
                        node = node.parent
                    opened[tag] -= 1
                    node = node.parent
                continue
            ends = CLOSES.get(tag, ())
            found = node
            if opened["p"] or any(opened[x] for x in ends):
                while found is not root and found.tag not in ends and found.tag != "p" and found.tag not in CLOSE_STOPS and not found.dropped:
                    found = found.parent
                if found is not root and (found.tag in ends or found.tag == "p"):
                    last = found.parent
                    if found.tag == "p" and last.tag in ends:
                        last = last.parent
                    while node is not last:
                        opened[node.tag] -= 1
                        node = node.parent
            if tag not in VOID:
                against = node.dropped or unwanted(tag, m[3], opened["article"] + opened["main"] > 0)
                child = Node(tag, node, against is True)
                if not child.dropped:
                    child.named = against or ""
                    node.children.append(child)
                    nodes.append(child)
                node = child
                opened[tag] += 1
        elif tag == "br":
            pending.append(" ")
    if at < len(html) and not node.dropped:
        pending.append(html[at:])
    flush()
    if any(n.named for n in nodes):
        judge(nodes)
        nodes = [n for n in nodes if not n.dropped]
        for one in nodes:
            one.children = [x for x in one.children if isinstance(x, str) or not x.dropped]
    points([(one, text) for one, text in held if not one.dropped], nodes)
    for one in reversed(nodes[1:]):  # children come after their parents
        one.parent.length += one.length
        one.parent.linked += one.linked
    return root, nodes


def judge(nodes: list[Node]) -> None:
    """Drop the elements that names or kinds speak against, but for wrappers of the main text.

    Nodes are in page order, so what one holds are the nodes that follow it up to an end, and
    all that a node stands in is judged before it.
    """
    n = len(nodes)
    place = {id(x): i for i, x in enumerate(nodes)}
    up = [0] + [place[id(x.parent)] for x in nodes[1:]]
    ends = list(range(1, n + 1))
    for i in range(n - 1, 0, -1):
        ends[up[i]] = max(ends[up[i]], ends[i])
    kinds = ("main", "article", "h1")
    sums = {k: list(accumulate((x.tag == k for x in nodes), initial=0)) for k in kinds}
    score = list(accumulate((x.own for x in nodes), initial=0.0))
    # of each kind: those a node stands in, and those of the places it is in without what is named there
    above = {k: [0] * n for k in kinds}
    area, plain = [0] * n, {k: [0] * n for k in kinds}
    for i in range(1, n):
        area[i] = i if nodes[i].named else area[up[i]]
        for k in kinds:
            above[k][i] = above[k][up[i]] + (nodes[up[i]].tag == k)
            plain[k][area[i]] += nodes[i].tag == k
    for i in range(1, n):  # also what the areas around hold
        if area[i] == i:
            for k in kinds:
                plain[k][i] += plain[k][area[up[i]]]
    for i in range(1, n):
        one, around = nodes[i], area[up[i]]
        one.dropped = one.dropped or nodes[up[i]].dropped
        if one.dropped or not one.named:
            continue
        inside = {k: sums[k][ends[i]] - sums[k][i] for k in kinds}
        if inside["main"]:
            continue
        beside = {k: sums[k][n] - inside[k] - above[k][i] for k in kinds}
        only = (inside["article"] or inside["h1"]) and not beside["article"] and not beside["h1"]
        most = 2 * (score[ends[i]] - score[i]) > score[n] and plain["article"][around] == above["article"][i]
        if one.tag in ("aside", "dialog"):  # often with headings of their own
            one.dropped = not (only and most)
        else:
            one.dropped = not (only or most and not READERS.search(one.named))


def worth_of(text: str) -> float:
    return 1.0 + text.count(",") + min(len(text) / 100.0, 3.0)


def points(held: list[tuple[Node, str]], nodes: list[Node]) -> None:
    """A block's points go to its container and, less and less, to all that this stands in.

    Half goes to the next one up, a third of that half to the one above, and from there on two
    thirds of what the one below got. One pass up the tree carries these shares together.
    """
    own: dict[int, float] = {}
    for node, text in held:
        if node.tag not in HEADINGS:
            to = node.parent if node.tag in ("p", "pre", "td", "blockquote", "li", "dd") and node.parent else node
            own[id(to)] = own.get(id(to), 0.0) + worth_of(text)
    near: dict[int, float] = {}
    far: dict[int, float] = {}
    for node in reversed(nodes):  # children come after their parents
        a, b, c = own.get(id(node), 0.0), near.get(id(node), 0.0), far.get(id(node), 0.0)
        if a or b or c:
            node.score += a + b + c
            if node.parent:
                up = id(node.parent)
                near[up] = near.get(up, 0.0) + a / 2
                far[up] = far.get(up, 0.0) + b / 3 + c * 2 / 3


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def blocks(node: Node, most: float = 1.0) -> list[str]:
    """Blocks in page order, without elements that stand in links by more than ``most``.

    A heading, paragraph or item is no such element by itself.
    """
    found, waiting = [], [node]
    while waiting:
        x = waiting.pop()
        if isinstance(x, str):
            found.append(x)
        elif x is node or x.tag in SINGLE or density(x) <= most:
            waiting.extend(reversed(x.children))
    return found


def container_of(nodes: list[Node], best: Node) -> Node:
    """The smallest node that holds all sections that score well, and what stands beside a single one."""
    holders = {}
    for n in nodes:
        if n.own:
            held = n.parent if n.tag in ("p", "pre", "blockquote") else n
            holders[id(held)] = (held, holders.get(id(held), (held, 0.0))[1] + n.own)
    enough = 0.2 * max((x for _, x in holders.values()), default=0.0)
    high = [h for h, x in holders.values() if x >= enough]
    count: dict[int, int] = {}
    for n in high:
        count[id(n)] = count.get(id(n), 0) + 1
    for n in reversed(nodes[1:]):
        if id(n) in count:
            count[id(n.parent)] = count.get(id(n.parent), 0) + count[id(n)]
    found = high[0] if high else best
    while found.parent and count.get(id(found), 0) < len(high):
        found = found.parent
    while found.parent and (len(high) < 2 or found.tag in PARTS):
        alone = found.parent.length == found.length or found.parent.tag in PARTS
        found = found.parent
        if not alone:
            break
    return found


def main_text(html: str) -> str:
    """The main text of one page."""
    root, nodes = parse(html)
    worth = {id(n): n.score * (1.0 - density(n)) for n in nodes if n.length}
    chosen = [n for n in nodes if n.length and n.tag not in HEADINGS and n.tag != "p"]
    if not chosen:
        return "\n\n".join(blocks(root))
    best = max(chosen, key=lambda n: worth[id(n)])  # the first of equals
    outer = best
    while outer and outer.tag != "article":
        outer = outer.parent
    if outer is None:
        outer = best
        while outer and outer.tag != "main":
            outer = outer.parent
    most = 1.0
    if outer is None:
        outer, most = container_of(nodes, best), LINKED
    best = outer
    if best.parent is None:
        return "\n\n".join(blocks(best, most))
    enough = max(10.0, worth.get(id(best), 0.0) * 0.2)
    kept: list[str] = []
    for x in best.parent.children:
        if x is best or isinstance(x, Node) and (
            x.tag in HEADINGS
            or worth.get(id(x), 0.0) >= enough
            or x.tag == "p" and density(x) < 0.25 and (x.length > 80 or any("." in b for b in blocks(x)))
        ):
            kept += blocks(x, most if x is best else 1.0)
    return "\n\n".join(kept)


def extract_main(pages: DataFrame, html: str = "html", text: str = "text") -> DataFrame:
    """Each row with ``text``; a column of that name is replaced, all others stay."""

    def make():
        return lambda column: [[main_text(t) for t in texts_of(column)]]

    return add_columns(pages, [html], f"`{text}` string", make)

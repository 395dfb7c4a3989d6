"""Main text of web pages by tree scoring.

A page becomes a tree of its block elements. Each paragraph passes points to its parent, and half of them to
each further ancestor in turn up to ``DEPTH``: one, one for each comma, and one for each hundred characters, all
times the share of its text outside links. The best container, discounted by its own link density, rises to the ancestor that
holds two thirds of the page's prose, and is kept with those blocks beside it and its ancestors that are prose outside links for the
most part. Menus, page headers and footers, scripts and styles are cut before.

Names in class or id, and forms, only raise a doubt, which the points settle: a block whose name is doubtful (search, legal, discussion, ...) is cut
unless it has three times the points of all the page outside blocks in doubt; one whose name is that of an advert, a notice, a sidebar or reader
comments is cut unless the page has nothing else but headings and the block is long. Names are read by their words, those in camel case too. What is in a block let through is settled again.

Cases: a null page counts as empty; an empty page, or one without text outside what is cut, gives an empty
text. Unclosed, crossed and cut-off tags are read as browsers do in the main: a paragraph ends at the next
block, an end tag closes what is open inside it, a tag that never ends is dropped. Repeated rows are treated
each by itself. Other columns pass through; ``n_chars`` and the result column replace columns of those names.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .store import bounded_batches, table

#: Elements that start a block of their own.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav noscript ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul head template".split())
#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements without an end.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that hold no article text.
CUT = frozenset("nav footer aside script style noscript template iframe textarea title head button select dialog menu svg canvas object video audio noembed noframes xmp math".split())
#: Roles of elements that hold no article text.
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar toolbar".split())
#: Words in class or id of blocks that are hardly ever the article.
SKIP = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|adsense|sponsor|sponsored|promo|promoted|promotion|cookie|cookies|consent|gdpr|notice|notices|notification|alert|"
    r"popup|modal|overlay|newsletter|subscribe|subscription|signup|sidebar|sidebars|side-bar|nav|navbar|navigation|menu|menus|breadcrumb|breadcrumbs|pagination|pager|"
    r"footer|masthead|topbar|toolbar|comment|comments|commentlist|comment-list|disqus|respond|replies|share|sharing|social|more-stories|"
    r"login|skip-link|hidden|sr-only|copyright|byline-ads)(?:$|[\s_-]|\d)",
    re.I,
)
#: Words in class or id of blocks that may be the article.
DOUBT = re.compile(r"(?:^|[\s_-])(?:banner|aside|widget|widgets|rail|foot|header|discussion|related|recommended|recommendations|search|searchbox|form|disclaimer|legal|tags)(?:$|[\s_-]|\d)", re.I)
#: How many times the points of the rest of the page let a doubtful block through, and how many points another block where there is no rest.
THROUGH = 3
LONG = 5
#: Elements that hold no text of an article by themselves.
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
#: Beginnings of names that tell what is beside a block, not what it is.
LAYOUT = re.compile(r"(?:has|with|no|without)[-_]", re.I)
#: Names of headers, which inside an article hold its title.
HEADER = re.compile(r"(?:^|[_-])header$", re.I)
#: Where a word of a name in camel case begins.
HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
#: Words that mark the article in spite of those above.
KEEP = re.compile(r"(?:^|[\s_-])(?:article|articlebody|article-body|content|main|post|story|entry|body|text)(?:$|[\s_-])", re.I)
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}
#: Elements whose points go to their parent.
LEAF = frozenset("p pre li h1 h2 h3 h4 h5 h6 td th dd dt blockquote figcaption".split())
DEPTH = 4

_TAG = re.compile(r"<!--.*?(?:-->|$)|<(/?)([A-Za-z][^\s/>]*)((?:(?>=\s*\"[^\"]*\"|=\s*'[^']*'|[^>]))*+)>|<[!?][^>]*(?:>|$)|</[^>]*(?:>|$)|<[A-Za-z][^>]*(?:>|$)", re.S)
_ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_SPACE = re.compile(r"\s+")


class Node:
    """A block; ``total`` and ``linked`` count the characters in it and of those the ones in links. ``doubt``: 1 by a doubtful name, 2 by a bad one."""

    __slots__ = ("tag", "up", "score", "total", "linked", "kids", "kept", "doubt", "points")

    def __init__(self, tag: str, up: Node | None, doubt: int = 0):
        self.tag, self.up, self.score, self.total, self.linked, self.kids, self.kept, self.doubt, self.points = tag, up, 0.0, 0, 0, [], False, doubt, 0.0

    def worth(self) -> float:
        return self.score * (1 - min(1.0, self.linked / self.total)) if self.total else 0.0


def _doubt(tag: str, attributes: str, inside_article: bool) -> int:
    """0 for a block to be scored, 1 for a doubtful one, 2 for one hardly ever the article, 3 for one to be cut."""
    if tag in CUT or (tag == "header" and not inside_article):
        return 3
    least = 1 if tag == "form" else 0
    if not attributes or attributes.isspace():
        return least
    a = {m[1].lower(): (m[2] or m[3] or m[4] or "") for m in _ATTR.finditer(attributes)}
    role = a.get("role", "").lower()
    if role in ROLES or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", a.get("style", ""), re.I):
        return least or 3 if role in ("form", "search") else 3
    if tag in ("body", "html", "article", "main"):
        return 0
    names = " ".join(n for n in f"{a.get('class', '')} {a.get('id', '')}".split() if not LAYOUT.match(n) and not (inside_article and HEADER.search(n)))
    names = HUMP.sub("-", names)
    if KEEP.fullmatch(a.get("class", "") or a.get("id", "")):
        return least
    return 2 if SKIP.search(names) else 1 if DOUBT.search(names) else least


def blocks(html: str) -> tuple[list[Node], list[tuple[Node, str, int]]]:
    """All blocks, parents first, and (block, text, characters in links) of the texts in order."""
    root = Node("#", None)
    nodes, opened = [root], Counter()
    at, cut, article, links = root, 0, 0, 0
    stack: list[tuple[str, Node, bool]] = []  # of open elements: name, block to go back to, whether it is cut
    out: list[tuple[Node, str, int]] = []
    piece: list[tuple[str, bool]] = []

    def flush():
        if piece:
            text = _SPACE.sub(" ", unescape("".join(t for t, _ in piece))).strip()
            if text:
                linked = sum(len(_SPACE.sub(" ", unescape(t)).strip()) for t, a in piece if a)
                out.append((at, text, linked))
            piece.clear()

    def pop():
        nonlocal at, cut, article, links
        tag, back, was_cut = stack.pop()
        opened[tag] -= 1
        if tag in BLOCK:
            flush()
            at = back
        cut -= was_cut
        article -= tag in ("article", "main")
        links -= tag == "a"

    place, size = 0, len(html)
    while place < size:
        m = _TAG.search(html, place)
        if not m:
            if not cut:
                piece.append((html[place:], links > 0))
            break
        if m.start() > place and not cut:
            piece.append((html[place : m.start()], links > 0))
        place, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if opened[tag]:
                while stack[-1][0] != tag:
                    pop()
                pop()
            continue
        if tag == "br":
            if not cut:
                piece.append((" ", False))
            continue
        if tag in VOID:
            if tag == "hr":
                flush()
            continue
        if tag in RAW:  # to its end, or to the end of the page
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, place)
            place = end.end() if end else size
            continue
        if tag in BLOCK:
            while opened["p"]:
                pop()
            for want in (w for w in CLOSES.get(tag, ()) if opened[w]):
                for s in reversed(stack):
                    if s[0] in SCOPE[tag] and s[0] != want:
                        break
                    if s[0] == want:
                        while stack[-1][0] != want:
                            pop()
                        pop()
                        break
            flush()
        elif tag == "a" and links:
            while opened["a"] and stack[-1][0] not in BLOCK:
                pop()
        doubt = 0 if cut else _doubt(tag, m[3] or "", article > 0)
        drop = cut > 0 or doubt == 3 or (doubt > 0 and tag not in BLOCK)
        stack.append((tag, at, drop))
        opened[tag] += 1
        if tag in BLOCK:
            child = Node(tag, at, 0 if drop else doubt)
            at.kids.append(child)
            nodes.append(child)
            at = child
        cut += drop
        article += tag in ("article", "main")
        links += tag == "a"
    flush()
    return nodes, out


def _points(text: str, in_links: int) -> float:
    return (1 + text.count(",") + len(text) / 100) * (1 - min(1.0, in_links / len(text)))


def _of_headings(found: list[tuple[Node, str, int]], held: list[Node], out: set[int]) -> float:
    """Points of the headings outside the blocks in doubt."""
    inside, total = {id(n) for n in held} | out, 0.0
    for node, text, in_links in found:
        if node.tag in HEADINGS:
            up = node
            while up is not None and id(up) not in inside:
                up = up.up
            total += _points(text, in_links) if up is None else 0.0
    return total


def _settled(nodes: list[Node], found: list[tuple[Node, str, int]]) -> list[tuple[Node, str, int]]:
    """The texts outside blocks in doubt, and in those of them that are let through."""
    if not any(n.doubt for n in nodes):
        return found
    for node, text, in_links in found:
        node.points += _points(text, in_links)
    for node in reversed(nodes[1:]):
        node.up.points += node.points
    sure, asked = 0.0, [nodes[0]]  # points outside doubt so far, and blocks to look into
    out: set[int] = set()
    while asked:
        held: list[Node] = []
        for top in asked:
            sure += top.points
            look = list(top.kids)
            while look:
                node = look.pop()
                if node.doubt:
                    held.append(node)
                    sure -= node.points
                else:
                    look += node.kids
        sure = max(0.0, sure)
        most = max((n for n in held if n.doubt == 1), key=lambda n: n.points, default=None)
        asked = [most] if most is not None and most.points > THROUGH * sure and most.points > 1e-9 else []
        if not asked and sure - _of_headings(found, held, out) < 1e-9:
            asked = [n for n in sorted(held, key=lambda n: -n.points) if n.points >= LONG][:1]
        out |= {id(n) for n in held if n not in asked}
    for node in nodes[1:]:
        if id(node.up) in out:
            out.add(id(node))
    return [x for x in found if id(x[0]) not in out]


def _prose(node: Node) -> bool:
    """Whether a block beside the article belongs to it: text, for the most part outside links."""
    if not node.total or node.linked * 2 >= node.total:
        return False
    return node.tag in LEAF or node.total >= 80


def main_text(html: str | None) -> str:
    nodes, found = blocks(html or "")
    found = _settled(nodes, found)
    if not found:
        return ""
    for node, text, in_links in found:
        points = _points(text, in_links)
        up = node.up if node.up is not None and node.tag in LEAF else node
        node.total, node.linked = node.total + len(text), node.linked + in_links
        for k in range(DEPTH):
            if up is None:
                break
            up.score += points / 2**k
            up = up.up
    for node in reversed(nodes[1:]):
        node.up.total, node.up.linked = node.up.total + node.total, node.up.linked + node.linked
    best = max((n for n in nodes if n.total and n.tag not in LEAF), key=Node.worth, default=nodes[0])
    top, up = best, best.up
    while up is not None:  # an article element around the best container is the article
        top, up = (up if up.tag in ("article", "main") else top), up.up
    if top.tag in ("article", "main"):
        top.kept = True
        for node in nodes[1:]:
            node.kept |= node.up.kept
        return "\n".join(text for node, text, _ in found if node.kept)
    prose = sum(len(text) - in_links for _, text, in_links in found)
    while top.up is not None and 3 * (top.total - top.linked) < 2 * prose:
        top = top.up
    path = [best]
    while path[-1].up is not None:
        path.append(path[-1].up)
    risen, known = path.index(top), {id(n) for n in path}
    for k, node in enumerate(path):
        node.kept = k <= risen or node.tag not in ("#", "html")  # its own text
        for kid in (x for x in node.kids if id(x) not in known):
            kid.kept = k == 0 or (_prose(kid) if k > risen else kid.tag in LEAF or kid.linked * 2 < kid.total)
    for node in nodes[1:]:
        if id(node) not in known and id(node.up) not in known:
            node.kept = node.up.kept
    return "\n".join(text for node, text, _ in found if node.kept)


def extract(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` with the main text and ``n_chars``, its code points."""
    rest = [f for f in pages.schema.fields if f.name.lower() not in {into.lower(), "n_chars"}]
    schema = T.StructType([*rest, T.StructField(into, T.StringType()), T.StructField("n_chars", T.LongType())])
    place, names = [f.name for f in rest].index(html), [f.name for f in schema.fields]

    def run(batches):
        for batch in bounded_batches(batches, column=place):
            texts = [main_text(x) for x in batch.column(place).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, type=pa.string()), pa.array([len(t) for t in texts], type=pa.int64())], names=names)

    return pages.select(*(F.col(f"`{f.name}`") for f in rest)).mapInArrow(run, schema)


def op3_tree_scored_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


QUERIES, ORACLE = {"op3_tree_scored_text": op3_tree_scored_text}, {}

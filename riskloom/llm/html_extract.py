"""Main-text extraction from web pages by composite text density.

Each page becomes a tree of its elements. A node's density is its characters per tag, adjusted by the
logarithm of its link share (composite text density); a block's density sum is that of the blocks right in
it and of its own lines, which count as one child.

1. The block of the largest sum under the body is the centre of the article; the least density on the path
   from the body to it is the threshold.
2. While a parent adds at least a quarter to the centre's text, little of it in links, the centre was a part
   of the article only, and the parent takes its place.
3. Text is taken from everything below the centre, from nodes off its path whose density reaches the
   threshold, from first-level headings before it and from headings of any level directly before it or before
   what it is in. If the body itself is the centre, its blocks of mostly links stay out.

Elements and roles only take away: scripts, menus, forms, hidden elements, reader comments and parts whose class, id or
role is a boilerplate name as a whole ("sponsored", "related-posts", but not "related-work") have no density and no
text. A doubtful name alone ("notice", "social") can't take the article away: where a page has no text elsewhere, the largest such part counts as
text, and so does prose inside the centre, of LEAST_PROSE characters with few links and the threshold's density.
Page headers and banners count as boilerplate outside the centre and as text inside it. A page is one
small pure function of its html, so pages are independent rows; work is linear in the length of the html.

Null, empty and text-free pages give an empty text; a page without markup is one block; unclosed and
stray tags are mended as browsers do for paragraphs, list items and table cells. Of nodes with equal sums
the outermost, then the first is the centre. Repeated rows are extracted row by row; other columns pass
through untouched, but for one named like the output, which it replaces. The whole html is read.
"""

from __future__ import annotations

import html as entities
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content, with raw content, that hold no article text, that break text into blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe object svg annotation annotation-xml textarea select canvas audio video title".split())
DROPPED = frozenset("nav footer aside form button dialog menu head".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Start tags that end an open element of the second set, up to one of the third.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table",)),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "option": (("option",), ("select",)),
}
CLOSE_P = BLOCK - frozenset("body html td th tr tbody thead tfoot li dd dt caption legend summary".split()) | frozenset(["ul", "ol", "dl", "table"])
HOLD_P = ("td", "th", "table", "button", "object")
#: Words that name boilerplate, alone or joined by - or _ to one another and to words of the next sets.
ROLES = frozenset("ad ads aside advert adverts advertisement advertising breadcrumb breadcrumbs comment comments cookie cookies consent disqus footer modal nav navbar navigation menu newsletter notice notices pagination pager popup promo promos promoted promotion related replies share sharing sidebar skip social sponsor sponsored sponsors subscribe subscription toolbar widget widgets".split())
#: Of these, the ones that an article may be named by.
DOUBTFUL = frozenset("aside notice notices related share sharing sidebar social toolbar widget widgets".split())
TOP_ROLES = frozenset("header masthead banner".split())
PARTS = frozenset("area bar block bottom box button buttons buttonset container content form global group inner item items left link links list main module outer page panel posts primary right row secondary section site slot sticky thread signup top unit user users reader readers wrap wrapper".split())
OF_ARTICLE = frozenset("article articles blog entry post news stories story".split())
TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*?)(?:>|$)|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)
#: A parent takes the centre's place if it adds this share of its text, at most MOST_LINKED of that in links.
LEAST_ADDED = 0.25
MOST_LINKED = 0.2
#: Characters from which named boilerplate inside the centre may be prose.
LEAST_PROSE = 300
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    """An element. kind: 0 text, 1 boilerplate outside the centre, 2 boilerplate by name, 3 boilerplate in any case."""

    __slots__ = ("tag", "parent", "children", "chars", "tags", "link_chars", "link_tags", "own", "density", "sum", "kind")

    def __init__(self, tag: str, parent: "Node | None", kind: int = 0):
        self.tag, self.parent, self.kind = tag, parent, kind
        self.children: list[Node | str] = []
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.own = (0, 0, 0, 0)  # the four counts of what isn't in an inner block
        self.density = self.sum = 0.0


def role_kind(name: str) -> int:
    """The kind of an element with this class, id or role: names count as a whole."""
    parts = [x for x in re.split(r"[-_\d]+", re.sub(r"([a-z])([A-Z])", r"\1-\2", name).lower()) if x]
    roles = [x for x in parts if x in ROLES]
    if roles and all(x in ROLES or x in TOP_ROLES or x in PARTS or x in OF_ARTICLE for x in parts):
        return 2 if DOUBTFUL.issuperset(roles) else 3
    if any(x in TOP_ROLES for x in parts) and all(x in TOP_ROLES or x in PARTS for x in parts):
        return 1
    return 0


def _kind(tag: str, attributes: str, in_article: bool) -> int:
    if tag in DROPPED:
        return 3
    kind = 1 if tag == "header" and not in_article else 0
    if attributes and tag not in ("body", "html", "main", "article"):
        for name, value in ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                return 3
            if name in ("class", "id", "role"):
                kind = max([kind, *map(role_kind, value.split())])
    return kind


class _Open:
    """The open elements, with the places of each tag among them, so that no search walks the whole depth."""

    def __init__(self, root: Node):
        self.stack = [root]
        self.at: dict[str, list[int]] = {}

    def push(self, node: Node) -> None:
        self.at.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def last(self, tags: tuple[str, ...]) -> int:
        return max((self.at[t][-1] for t in tags if self.at.get(t)), default=0)

    def first_after(self, tags: tuple[str, ...], place: int) -> int:
        """The outermost open element of these tags inside that at `place`; 0 if none."""
        found = [own[k] for t in tags if (own := self.at.get(t)) and (k := bisect_right(own, place)) < len(own)]
        return min(found, default=0)

    def close(self, place: int) -> None:
        while len(self.stack) > place:
            self.at[self.stack.pop().tag].pop()


def tree(page: str) -> Node:
    """The page's elements under one root. Comments, scripts, styles and other raw elements are left out."""
    root = Node("", None)
    opened = _Open(root)
    pos, n = 0, len(page)
    while pos < n:
        m = TOKEN.match(page, pos)
        pos = m.end()
        end, tag, attributes, text = m.groups()
        node = opened.stack[-1]
        if text is not None:
            node.children.append(text)
            continue
        if tag is None:
            continue
        tag = tag.lower()
        if end:
            place = opened.last((tag,))
            if place:
                opened.close(place)
            elif tag == "br" or tag == "p":
                node.children.append(Node(tag, node))
            continue
        if tag in RAW:
            if not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, pos)
                stop = page.find(">", close.start()) if close else -1
                pos = stop + 1 if stop >= 0 else n
            continue
        if tag in CLOSE_P and (place := opened.last(("p",))) > opened.last(HOLD_P):
            opened.close(place)
        if tag in ENDS and (place := opened.first_after(ENDS[tag][0], opened.last(ENDS[tag][1]))):
            opened.close(place)
        node = opened.stack[-1]
        child = Node(tag, node, _kind(tag, attributes, opened.last(("article", "main")) > 0))
        node.children.append(child)
        if tag not in VOID and (not attributes.endswith("/") or tag in BLOCK):  # "/" has no meaning on blocks
            opened.push(child)
    return root


def _walk(root: Node) -> list[Node]:
    """All nodes that may hold text, parents first."""
    out = [root]
    for node in out:
        out.extend(c for c in node.children if isinstance(c, Node) and c.kind < 3)
    return out


def density(chars: int, tags: int, link_chars: int, link_tags: int, share: float) -> float:
    """Characters per tag, times the logarithm of chars / link chars * tags / link tags to a base that grows with the text in links.

    share is that of link characters in the whole body; counts of nothing are one, and the base is e at least.
    """
    if not chars:
        return 0.0
    base = math.log(chars / max(chars - link_chars, 1) * link_chars + share * chars + math.e)
    ratio = chars / max(link_chars, 1) * max(tags, 1) / max(link_tags, 1)
    return chars / max(tags, 1) * max(math.log(ratio), 0.0) / max(math.log(base), 1.0)


def measure(root: Node) -> tuple[Node, list[Node]]:
    """(body or root, nodes): density and sum of every node are set; boilerplate adds to neither."""
    nodes = _walk(root)
    for node in reversed(nodes):
        chars = tags = link_chars = link_tags = 0
        for c in node.children:
            if isinstance(c, str):
                n = len("".join(entities.unescape(c).split()))
                node.chars += n
                chars += n
            elif not c.kind:
                node.chars += c.chars
                node.tags += c.tags + 1
                node.link_chars += c.link_chars
                node.link_tags += c.link_tags + (c.tag == "a")
                if c.tag not in BLOCK:
                    chars, tags, link_chars, link_tags = chars + c.own[0], tags + c.own[1] + 1, link_chars + c.own[2], link_tags + c.own[3] + (c.tag == "a")
        if node.tag == "a":
            node.link_chars, link_chars = node.chars, chars
        node.own = (chars, tags, link_chars, link_tags)
    body = next((x for x in nodes if x.tag == "body"), root)
    share = body.link_chars / max(body.chars, 1)
    for node in reversed(nodes):
        node.density = density(node.chars, node.tags, node.link_chars, node.link_tags, share)
        node.sum = sum(c.density if c.tag in BLOCK else c.sum for c in node.children if isinstance(c, Node) and not c.kind)
        if node.tag in BLOCK or node is root:
            node.sum += density(*node.own, share)
    return body, nodes


def centre_of(body: Node) -> tuple[Node, float]:
    """(centre, threshold): the node of the largest density sum, or what it is a part of, and the least density from the body to it."""
    centre = max((x for x in _live(body) if x is body or x.tag in BLOCK), key=lambda x: x.sum)
    if centre.sum <= 0:
        return body, body.density
    threshold, up = centre.density, centre
    while up is not body:
        up = up.parent
        threshold = min(threshold, up.density)
    while centre is not body:
        parent = centre.parent
        added, linked = parent.chars - centre.chars, parent.link_chars - centre.link_chars
        if (added < LEAST_ADDED * centre.chars or linked > MOST_LINKED * added) and parent.tag in (*BLOCK, ""):
            break
        centre = parent
    return centre, threshold


def pardon(body: Node, nodes: list[Node]) -> bool:
    """Whether only parts that a doubtful name marks hold text, beside headings and links; the largest then counts as text."""
    most = max((x for x in nodes if x.kind == 2), key=lambda x: x.chars, default=None)
    if most is None or most.link_chars > MOST_LINKED * most.chars:
        return False
    titles = sum(x.chars for x in _live(body) if x.tag in HEADINGS)
    if body.chars - body.link_chars - titles > 0:
        return False
    most.kind = 0
    return True


def _live(body: Node) -> list[Node]:
    """The nodes of the body outside boilerplate, parents first."""
    out = [body]
    for node in out:
        out.extend(c for c in node.children if isinstance(c, Node) and not c.kind)
    return out


def lead(centre: Node, body: Node) -> set[int]:
    """The headings directly before the centre, or before what it is in."""
    out, up = set(), centre
    while up is not body and up.parent is not None:
        before = []
        for c in up.parent.children:
            if c is up:
                break
            before.append(c)
        for c in reversed(before):
            if isinstance(c, Node) and c.tag in HEADINGS and not c.kind:
                out.add(id(c))
            elif isinstance(c, Node) or c.strip():
                break
        up = up.parent
    return out


def blocks(page: str | None) -> list[str]:
    """The article's blocks of text, in page order."""
    root = tree(page or "")
    body, nodes = measure(root)
    if pardon(body, nodes):
        for x in nodes:
            x.chars = x.tags = x.link_chars = x.link_tags = 0
        body, nodes = measure(root)
    centre, threshold = centre_of(body)
    leading = lead(centre, body)
    path, up = {id(centre)}, centre
    while up is not body:
        up = up.parent
        path.add(id(up))
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = " ".join(entities.unescape("".join(held)).split())
        held.clear()
        if text:
            out.append(text)

    before = True  # the centre is still to come
    todo: list[tuple[Node | str | None, bool, bool]] = [(body, False, False)]  # with: is it taken, is it inside the centre
    while todo:
        item, taken, within = todo.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if taken:
                held.append(item)
        elif not item.kind or (item.kind == 1 and within) or (item.kind == 2 and within and item.chars >= LEAST_PROSE and item.link_chars <= MOST_LINKED * item.chars and item.density >= threshold):
            if within and centre is body and item.tag in BLOCK and 2 * item.link_chars > item.chars:
                continue
            if item is centre:
                before, within = False, True
            own = taken or within or (id(item) not in path and item.density >= threshold > 0) or (before and (item.tag == "h1" or id(item) in leading))
            if item.tag in BLOCK:
                flush()
                todo.append((None, own, within))
            elif item.tag == "br" and own:
                held.append(" ")
            todo.extend((c, own, within) for c in reversed(item.children))
    flush()
    return out


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """pages and `out`, each page's main text, blocks joined by a blank line."""
    fields = [f for f in pages.schema.fields if f.name != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                texts = pa.array(["\n\n".join(blocks(p)) for p in part.column(html).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), texts], [*(f.name for f in fields), out])

    from pyspark.sql.types import StringType, StructField, StructType

    return pages.select(*[f"`{f.name}`" for f in fields]).mapInArrow(run, StructType([*fields, StructField(out, StringType())]))


def op6(pages: DataFrame) -> DataFrame:
    """Each page's main text and its length."""
    return extract(pages.select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))

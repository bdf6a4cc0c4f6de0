"""Main text of web pages by composite text density.

Each node of the page's tree has a density: characters per tag of its subtree, adjusted by how much of it is links compared
with the whole body. Text that lies beside blocks is a block of its own. A node's density sum adds the densities of its
children (without any, it is its own density), and the node with the largest sum holds the article, whatever element it is.
The least density on its path up to the body is the threshold: wherever a node elsewhere reaches it, the best subtree below
belongs to the text as well, and so do the headings right before a part of the text and short blocks without links between
two parts.

All of the body is measured but for scripts, styles and what is never shown. Menus, notices, forms and the like, known by
element, role and class, count in the densities; they can't be chosen themselves, and inside the choice they are left out.
Without an <article> or <main> on the page, a node that holds most of the page's text outside links is never taken for one.
A page takes time in proportion to its length, however it is nested.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br img".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
DROPPED = frozenset("head script style noscript template iframe object embed svg math canvas audio video map nav aside header footer form button select option textarea input label fieldset dialog menu title link meta".split())
#: Of these, those that may be wrapped around the text.
WRAPPERS = frozenset("nav aside header footer form fieldset dialog menu".split())
#: Of these, those that don't hold the article though an <article> is inside.
BESIDE = frozenset(["nav", "aside", "footer"])
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
# fixed values: words of class and id that name what is not the article
NOISE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adbox banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus disclaimer footer gdpr header login masthead menu modal nav navbar navigation newsletter notice popup promo promotion promoted recommended related replies reply respond search share sharing sidebar sidebox signup social sponsor sponsored subscribe subscription toolbar widget".split()
)
#: Words that name readers' texts, which can be longer than the article.
COMMENTS = frozenset("comment comments disqus replies reply respond".split())
#: Words that say where or what kind of box a noise word's node is: "sidebar-left", "comment-list".
PLACES = frozenset("area bar block body bottom box button buttons container content footer form group header inner item items left link links list main outer panel region right row section slot title top unit wrap wrapper".split())
#: Kinds of noise: no text of the page at all; cut unless most of the text is inside; cut unless hardly any text is outside.
NEVER, USUAL, READERS = 1, 2, 3
MOST = {USUAL: 0.5, READERS: 0.9}
#: What an opening tag closes first: (tags closed, tags that hold the search, opening tags).
SCOPES = (
    (frozenset(["p"]), frozenset("article body button div main section table td th li".split()), CLOSES_P),
    (frozenset(["li"]), frozenset(["ul", "ol", "menu"]), frozenset(["li"])),
    (frozenset(["dt", "dd"]), frozenset(["dl"]), frozenset(["dt", "dd"])),
    (frozenset(["tr", "td", "th"]), frozenset(["table"]), frozenset(["tr"])),
    (frozenset(["td", "th"]), frozenset(["tr", "table"]), frozenset(["td", "th"])),
    (frozenset(["option"]), frozenset(["select"]), frozenset(["option"])),
)
SCOPE_OF = {tag: i for i, (_, _, opening) in enumerate(SCOPES) for tag in opening}
SCOPED = frozenset().union(*(closed | stops for closed, stops, _ in SCOPES))
TAG = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
WORD = re.compile(r"[a-z]+")


class Node:
    __slots__ = ("tag", "parent", "children", "noise", "readers", "beside", "holds_main", "out", "scopes", "chars", "links", "tags", "link_tags", "inline", "density", "total")

    def __init__(self, tag: str, parent: Node | None, noise: int = 0):
        self.tag, self.parent, self.noise = tag, parent, noise
        self.readers = noise == READERS or parent is not None and parent.readers
        self.beside = tag in BESIDE or parent is not None and parent.beside
        self.children: list[Node | str] = []
        self.holds_main = tag in ("article", "main", "body") and not (tag == "article" and self.readers)
        self.out = False
        self.scopes = parent.scopes if parent is not None else (None,) * len(SCOPES)  # the nearest node that each scope could close
        if tag in SCOPED:
            self.scopes = tuple(self if tag in closed else None if tag in stops else near for (closed, stops, _), near in zip(SCOPES, self.scopes, strict=True))
        self.chars = self.links = self.tags = self.link_tags = 0
        self.inline = tag in INLINE
        self.density = self.total = 0.0


def named_noise(value: str) -> int:
    """The noise that a class or id names: by a whole token, or by a token of noise words and places."""
    kind = 0
    for token in value.split():
        words = WORD.findall(token)
        if words and words[0] in NOISE and all(x in NOISE or x in PLACES for x in words):
            if not COMMENTS.isdisjoint(words):
                return READERS
            kind = USUAL
    return kind


def noise_kind(tag: str, attributes: str) -> int:
    if tag in DROPPED and tag not in WRAPPERS:
        return NEVER
    kind = USUAL if tag in WRAPPERS else 0
    if not attributes or tag in ("html", "body"):
        return kind
    for name, one, two, three in ATTRIBUTE.findall(attributes):
        name, value = name.lower(), (one or two or three).lower()
        if name == "hidden" or name == "aria-hidden" and value == "true":
            return NEVER
        if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return NEVER
        if name == "role" and value in ROLES:
            kind = max(kind, USUAL)
        if name in ("class", "id"):
            kind = max(kind, named_noise(value))
    return kind


def parse(page: str) -> Node:
    """The tree of a page; broken markup closes where HTML would close it, or at the end."""
    root = node = Node("html", None)
    at, n, lower = 0, len(page), None
    open_names: Counter[str] = Counter()  # of the nodes from the root down to ``node``

    def leave(node: Node) -> Node:
        open_names[node.tag] -= 1
        return node.parent

    while at < n:
        found = TAG.search(page, at)
        if found is None:
            node.children.append(page[at:])
            break
        if found.start() > at:
            node.children.append(page[at : found.start()])
        at = found.end()
        tag = (found[2] or found[5] or "").lower()
        if not tag or tag == "html":
            continue
        if found[1] or found[4]:
            if open_names[tag]:
                while node.tag != tag:
                    node = leave(node)
                node = leave(node)
            continue
        scope = SCOPE_OF.get(tag)
        if scope is not None and (near := node.scopes[scope]) is not None:
            while node is not near:
                node = leave(node)
            while node.parent is not None and node.tag in SCOPES[scope][0]:
                node = leave(node)
        new = Node(tag, node, noise_kind(tag, found[3] or found[6] or ""))
        node.children.append(new)
        if new.holds_main:
            up = new.parent
            while up is not None and not up.holds_main:
                up.holds_main = True
                up = up.parent
        if tag in RAW:
            lower = lower or (page.lower() if len(page.lower()) == n else page.translate(LOWER))
            end = lower.find(f"</{tag}", at)
            if end < 0:
                break
            at = page.find(">", end) + 1 or n
        elif tag not in VOID:
            node = new
            open_names[tag] += 1
    return root


#: The tag of text that lies beside blocks.
RUN = "#run"
LOWER = {i: i + 32 for i in range(65, 91)}


def mark(root: Node) -> list[Node]:
    """Cuts what is never shown out of the tree and marks the noise; the nodes left, parents first."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        node.children = [x for x in node.children if isinstance(x, str) or x.noise != NEVER or x.holds_main and x.tag != "head"]
        order.append(node)
        stack.extend(x for x in reversed(node.children) if isinstance(x, Node))
    plain: dict[int, int] = {}  # characters outside links
    for node in reversed(order):
        plain[id(node)] = 0 if node.tag == "a" else sum(len("".join(x.split())) if isinstance(x, str) else plain[id(x)] for x in node.children)
    named = any(x.tag in ("article", "main") and x.holds_main and plain[id(x)] and not x.beside for x in order)
    for x in order:
        most = not named and x.noise in MOST and plain[id(x)] > MOST[x.noise] * plain[id(root)]
        stays = x.noise not in MOST or most or x.holds_main and x.tag not in BESIDE
        x.out = not stays or x.parent is not None and x.parent.out
    return order


def measure(root: Node) -> list[Node]:
    """Fills in the counts; the nodes, parents first."""
    order = mark(root)
    for node in reversed(order):
        for x in node.children:
            if isinstance(x, str):
                node.chars += len("".join(x.split()))
            else:
                node.chars, node.links = node.chars + x.chars, node.links + x.links
                node.tags += x.tags + (x.tag not in INLINE)
                node.link_tags += x.link_tags + (x.tag == "a")
        node.inline = node.inline and not node.tags
        if node.tags:
            node.children = with_runs(node)
        if node.tag == "a":
            node.links = node.chars
    return [x for node in order for x in (node, *(y for y in node.children if isinstance(y, Node) and y.tag == RUN))]


def with_runs(node: Node) -> list[Node | str]:
    """The children of a node that has blocks, text between them as nodes of their own."""
    children: list[Node | str] = []
    run = None
    for x in node.children:
        if isinstance(x, Node) and not x.inline:
            children.append(x)
            run = None
            continue
        if run is None:
            run = Node(RUN, node)
            run.out = node.out
            children.append(run)
        run.children.append(x)
        if isinstance(x, str):
            run.chars += len("".join(x.split()))
        else:
            run.chars, run.links, run.link_tags = run.chars + x.chars, run.links + x.links, run.link_tags + x.link_tags + (x.tag == "a")
    return children


def weigh(order: list[Node], body: Node) -> None:
    share = body.links / max(1, body.chars)
    for node in order:
        if not node.chars:
            continue
        plain, tags = node.chars - node.links, max(1, node.tags)
        inner = node.chars / max(1, plain) * node.links + share * node.chars + math.e
        ratio = node.chars / max(1, node.links) * tags / max(1, node.link_tags)
        node.density = node.chars / tags * max(0.0, math.log(max(ratio, 1.0)) / math.log(math.log(inner) + 1e-9 + (math.e - 1)))
    for node in order:
        parts = [x.density for x in node.children if isinstance(x, Node) and not x.inline]
        node.total = sum(parts) if parts else node.density


def chosen(order: list[Node], body: Node) -> list[Node]:
    """The nodes of the text, in page order: none that is marked as noise."""
    inside = {id(body)}
    nodes = [body]
    for node in order:
        if node is not body and not node.out and node.parent is not None and id(node.parent) in inside:
            inside.add(id(node))
            nodes.append(node)
    best = max((x for x in nodes if not x.inline), key=lambda x: x.total)
    if best.total <= 0:
        return [body]
    each = lambda x: x.chars / max(1, x.tags)
    limit, plain, up = best.density, each(best), best
    while up is not body:
        up = up.parent
        limit, plain = min(limit, up.density), min(plain, each(up))
    top: dict[int, Node] = {}
    for node in reversed(nodes):  # of each subtree, the node with the largest sum
        top[id(node)] = best if node is best else max([node, *(top[id(x)] for x in node.children if isinstance(x, Node) and not x.inline and not x.out)], key=lambda x: x.total)
    marked, stack, picked, between = {id(best)}, [body], [], []
    while stack:
        node = stack.pop()
        # without links a density grows with the node, so that a lone paragraph is held against characters per tag
        if id(node) not in marked and (node.density >= limit or not node.links and each(node) >= plain) and top[id(node)].total > 0:
            marked.add(id(top[id(node)]))
        blocks = [x for x in node.children if isinstance(x, Node) and not x.inline and not x.out]
        if id(node) in marked:
            picked += [*between, node]
            between = []
        elif node.tag in HEADINGS or picked and node.chars and not node.links and not blocks:
            between.append(node)
        elif blocks:
            stack.extend(reversed(blocks))
        elif node.chars:
            between = []
    return picked


def text_of(node: Node) -> list[str]:
    """The blocks below a node without the noise: white space turned into single spaces, empty ones left out."""
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        joined = " ".join(entities.unescape("".join(line)).split())
        line.clear()
        if joined:
            blocks.append(joined)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            line.append(x)
        elif x.out:
            if not x.inline:
                close()
        elif x.tag == "br":
            line.append(" ")
        elif x.tag in INLINE:
            stack.extend(reversed(x.children))
        else:
            close()
            stack.append(None)
            stack.extend(reversed(x.children))
    close()
    return blocks


def main_text(page: str) -> str:
    """The article of a page as plain text."""
    root = parse(page)
    order = measure(root)
    body = next((x for x in order if x.tag == "body"), root)
    weigh(order, body)
    return " ".join(block for node in chosen(order, body) for block in text_of(node))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per page.

    Null and empty pages, and pages without text outside the noise, give an empty text; null ids and urls stay null;
    repeated rows are extracted each by itself; an empty table gives no rows; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x.as_py()) if x.is_valid else "" for x in batch.column("html")]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(run, "page_id long, url string, text string, n_chars long")

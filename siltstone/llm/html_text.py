"""Main text of web pages by composite text density.

Every element of a page's tree gets a density: its characters per tag, corrected
by how many of both belong to links.  Formatting (bold, line breaks) is text of
the element around it and has no density.  The node whose children's densities
sum highest is looked for first; the least density on the path from the body to
it is the threshold.  In every subtree that reaches the threshold the node of
the highest sum is main content; a subtree that doesn't is only looked through.

Nodes that can't be article text (scripts, menus, footers, forms, adverts,
notices, comments) are taken out first: by tag, role or attribute, or by a class
name or id that as a whole names one.  A name takes nothing out that holds half
of the text in several blocks, or all of it.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.llm.common import in_arrow

# Fixed values of HTML and of page conventions.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe template xmp noembed noframes".split())
#: Elements whose text is none of the page's, and those that by their tag are none of an article.
MARKUP = frozenset("script style textarea title noscript iframe template xmp noembed noframes head button select svg canvas object".split())
ASIDES = frozenset("nav header footer aside form dialog menu".split())
BLOCKS = frozenset("address article aside blockquote body br caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
ENDS_P = BLOCKS - {"br", "caption", "td", "th", "tr", "tbody", "thead", "tfoot", "li", "dd", "dt", "option", "html", "body", "legend", "summary", "figcaption"}
SIBLING_END = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
FORMATTING = frozenset("a abbr b big cite code em font i mark q s small span strong sub sup tt u".split())
#: Parts of names: those of asides, those that say nothing, and whole names of content.
ASIDE_PART = re.compile(
    r"ads?|advert\w*|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notice|popup|modal|newsletter|subscribe|sidebar|widgets?|menu|nav|navbar|"
    r"navigation|breadcrumbs?|header|masthead|footer|comments?|disqus|replies|share|sharing|social|related|recommended|pagination|pager|login|signup|toolbar|skip"
)
#: Least density sum of other content, as a share of the best node's.
SHARE = 0.1
#: Of those the ones that name what readers wrote, which outweighs many an article.
READER_PART = re.compile(r"comments?|disqus|replies|respond")
PLAIN_PARTS = frozenset("area bar block bottom box buttons column container form group inner items left link links list main outer panel posts primary respond right row secondary section side site thread top wrap wrapper".split())
CONTENT_NAMES = frozenset("article body content entry hentry post story text".split())
INLINE = (FORMATTING - {"a"}) | {"br", "wbr"}
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search menu menubar dialog alert alertdialog".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>\"']+|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|$)", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_SPACE = re.compile(r"\s+")


class Node:
    __slots__ = ("tag", "kids", "parent", "aside", "named", "inline", "chars", "loose", "tags", "blocks", "link_chars", "link_tags", "density", "total", "depth")

    def __init__(self, tag: str, parent: Node | None, aside: bool = False, named: str = ""):
        self.depth = parent.depth + 1 if parent else 0
        self.tag, self.parent, self.aside, self.named, self.inline = tag, parent, aside, named, tag in INLINE
        self.kids: list[Node | str] = []


def _names_aside(value: str) -> str:
    """`reader` or `aside` if one of the names of a class or id attribute is an aside's as a whole and none is the content's; empty otherwise."""
    names = value.lower().split()
    if CONTENT_NAMES.intersection(names):
        return ""
    found = ""
    for name in names:
        parts = [x for x in re.split("[-_]+", name) if x]
        asides = [bool(ASIDE_PART.fullmatch(x)) for x in parts]
        if any(asides) and all(a or x in PLAIN_PARTS for a, x in zip(asides, parts, strict=True)):
            if any(READER_PART.fullmatch(x) for x in parts):
                return "reader"
            found = "aside"
    return found


def _is_aside(tag: str, attributes: str, names: bool) -> tuple[bool, str]:
    """Whether a tag is an aside for certain, and what its class or id names."""
    if tag in MARKUP or names and tag in ASIDES:
        return True, ""
    if not names or not attributes or tag in ("body", "html", "article", "main"):
        return False, ""
    named = ""
    for m in _ATTRIBUTE.finditer(attributes):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            named = max(named, _names_aside(value))
        if name == "hidden" or name == "role" and value.lower() in ASIDE_ROLES:
            return True, named
        if name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, named
    return False, named


def parse(page: str, names: bool = True) -> Node:
    """A tolerant tree: ends that HTML leaves out are supplied, stray end tags ignored.

    Open elements are stacked by name, and so are blocks, so that what a tag
    closes is known without a walk upward.  Without `names` nothing is marked an
    aside but what is markup.
    """
    root = Node("html", None)
    top, at, size = root, 0, len(page)
    open_: dict[str, list[Node]] = {}
    blocks: list[Node] = []

    def leave(node: Node) -> None:
        """Close everything from the top to `node`."""
        nonlocal top
        while top.depth >= node.depth:
            open_[top.tag].pop()
            if blocks and blocks[-1] is top:
                blocks.pop()
            top = top.parent

    def deepest(tags: tuple[str, ...] | frozenset[str] | set[str]) -> Node | None:
        return max((open_[t][-1] for t in tags if open_.get(t)), key=lambda n: n.depth, default=None)

    while at < size:
        m = _TOKEN.search(page, at)
        if not m:
            top.kids.append(page[at:])
            break
        if m.start() > at:
            top.kids.append(page[at : m.start()])
        at, tag = m.end(), (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            node = deepest((tag,))
            if node is not None and not (tag in FORMATTING and blocks and blocks[-1].depth > node.depth):  # an inline end tag doesn't close blocks
                leave(node)
            continue
        if tag in ("html", "body") and not m[3]:
            if tag == "body" and (top.aside or top.named):
                while top is not root:
                    leave(top)
            continue
        if tag in ("tr", "td", "th"):
            table = deepest(("table",) if tag == "tr" else ("table", "tr"))
            inner = [n for t in (("tr", "td", "th") if tag == "tr" else ("td", "th")) for n in _below(open_.get(t), table)]
            if inner:
                leave(min(inner, key=lambda n: n.depth) if tag == "tr" else max(inner, key=lambda n: n.depth))
        elif (tag in ENDS_P or tag in SIBLING_END) and blocks and blocks[-1].tag in SIBLING_END.get(tag, ("p",)):
            leave(blocks[-1])
        if tag == "body":
            while top is not root:
                leave(top)
        node = Node(tag, top, *_is_aside(tag, m[3], names))
        top.kids.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            if end is None and tag not in ("script", "style", "textarea", "title"):
                continue
            node.kids.append(page[at : end.start() if end else size])
            at = end.end() if end else size
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            top = node
            open_.setdefault(tag, []).append(node)
            if tag in BLOCKS or tag == "select":
                blocks.append(node)
    return root


def _below(stack: list[Node] | None, table: Node | None) -> list[Node]:
    """The first and the last open element of a stack that lie within a table (or anywhere, without one)."""
    if not stack or table is not None and stack[-1].depth < table.depth:
        return []
    first = bisect_right(stack, table.depth, key=lambda n: n.depth) if table is not None else 0
    return [stack[first], stack[-1]]


def _measure(root: Node) -> list[Node]:
    """Characters, loose ones (outside inner elements), tags, blocks with text, and those in links, bottom up; the nodes in page order, asides left out."""
    order, stack = [], [root]
    while stack:
        node = stack.pop()
        order.append(node)
        stack += [k for k in reversed(node.kids) if isinstance(k, Node) and not k.aside]
    for node in reversed(order):
        node.chars = node.loose = sum(len(k.strip()) for k in node.kids if isinstance(k, str))
        node.tags = node.blocks = node.link_chars = node.link_tags = 0
        for k in node.kids:
            if isinstance(k, Node) and not k.aside:
                node.chars += k.chars
                node.loose += k.loose * k.inline
                node.tags += k.tags + (not k.inline)
                node.blocks += k.blocks
                node.link_chars += k.link_chars
                node.link_tags += k.link_tags + (k.tag == "a")
        node.blocks += node.tag in BLOCKS and node.loose > 0
        if node.tag == "a":
            node.link_chars = node.chars
    return order


def density(root: Node) -> list[Node]:
    """Give every node its link-adjusted characters per tag, and the sum of its children's; formatting is seen through."""
    order = _measure(root)
    chars, links = max(root.chars, 1), root.link_chars
    for n in order:
        c, t, lc, lt = n.chars, max(n.tags, 1), n.link_chars, n.link_tags
        if not c or n.inline:
            n.density = 0.0
            continue
        base = math.log(c / max(c - lc, 1) * lc + links / chars * c + math.e)
        n.density = max(0.0, c / t * math.log(max(c / max(lc, 1) * (t / max(lt, 1)), 1.0000001)) / base)
    for n in reversed(order):
        n.total = sum(k.total if k.inline else k.density for k in n.kids if isinstance(k, Node) and not k.aside)
    return order


def _drop_named(root: Node) -> None:
    """Take out what a class name or id calls an aside, unless what is left is no article beside it.

    Readers' comments always go where anything else has text.  Any other named
    element stays where all that is left outside of named ones has less than two
    blocks with text, or a tenth of its text outside links.
    """
    order = _measure(root)
    own = {n: (n.chars - n.link_chars, n.named) for n in order if n.named}
    gone = list(own)
    if not gone:
        return
    for n in gone:
        n.aside = True
    _measure(root)
    left, blocks = root.chars - root.link_chars, root.blocks
    for kind in ("aside", "reader"):
        if kind == "reader" and root.chars:
            break
        for n, (chars, named) in own.items():
            if named == kind and (kind == "reader" or blocks < 2 or left < chars / 10):
                n.aside = False
        _measure(root)
    if not root.chars:  # all of it is within named elements
        for n in gone:
            n.aside = False


def _rank(node: Node) -> tuple[float, bool, float]:
    """Order of candidates: the largest sum; of equal ones what the page calls its article, then the densest."""
    return (-1.0, False, 0.0) if node.inline or node.tag == "a" else (node.total, node.tag in ("article", "main"), node.density)


def select(root: Node) -> list[Node]:
    """The content subtrees, in page order.

    The threshold is the least density on the path from the body to the node of
    the largest density sum.  Of every subtree below the body that reaches it,
    the node of the largest sum is content, or the one around it with as much
    text of its own; what lies beside that node is judged in the same way.
    """
    _drop_named(root)
    order = density(root)
    body = next((n for n in order if n.tag == "body"), root)
    inside = [n for n in order if n.chars]
    if not inside:
        return [body]
    best = max(inside, key=_rank)
    threshold = min([n.density for n in _ancestors(best) if not n.inline])
    top: dict[Node, Node] = {}  # the node of the largest sum in each subtree
    for n in reversed(order):
        top[n] = max((n, *(top[k] for k in n.kids if k in top)), key=_rank)
    around = body if any(n is body for n in _ancestors(best)) else root
    chosen: set[Node] = set()
    todo = [around] if around.loose >= max(threshold, 1) else [k for k in around.kids if k in top]
    path = set(_ancestors(best))
    while todo:
        n = todo.pop()
        if n.density < threshold or not n.chars:
            todo += [k for k in n.kids if k in top]
            continue
        pick = node = top[n]
        if n not in path and pick is not best and max(pick.total, pick.density) < SHARE * best.total:
            continue  # dense, as a line without a link is, but nothing beside the best
        while node is not n:
            node = node.parent
            if node.tag in BLOCKS and pick.tag not in BLOCKS or node.loose >= max(threshold, 1):
                pick = node
        chosen.add(pick)
        while pick is not n:
            todo += [k for k in pick.parent.kids if k in top and k is not pick]
            pick = pick.parent
    if not chosen:
        return [around]
    for n in order:  # a heading goes with the content after it
        kids = [k for k in n.kids if k in top and k.chars]
        for k, after in zip(kids[-2::-1], kids[:0:-1], strict=True):
            if k.tag in HEADINGS and (after in chosen or any(x in chosen for x in _first_blocks(after))):
                chosen.add(k)
    return [n for n in order if n in chosen and not any(x in chosen for x in _ancestors(n.parent))]


def _first_blocks(node: Node) -> Iterator[Node]:
    """The first subtree with text below a node, and the first below that."""
    while (node := next((k for k in node.kids if isinstance(k, Node) and not k.aside and k.chars), None)) is not None:
        yield node


def _ancestors(node: Node | None) -> Iterator[Node]:
    while node is not None:
        yield node
        node = node.parent


def text_of(node: Node) -> str:
    """Blocks in page order, white space in each made one space, joined by one space."""
    blocks: list[str] = []
    line: list[str] = []

    def close() -> None:
        if line and (got := _SPACE.sub(" ", html.unescape("".join(line))).strip()):
            blocks.append(got)
        line.clear()

    stack: list[Node | str | None] = [node]
    while stack:
        k = stack.pop()
        if k is None:
            close()
        elif isinstance(k, str):
            line.append(k)
        elif k is node or not k.aside:
            if k.tag in BLOCKS:
                close()
                stack.append(None)
            stack += reversed(k.kids)
    close()
    return " ".join(blocks)


def main_text(page: str | None) -> str:
    return " ".join(t for n in select(parse(page)) if (t := text_of(n))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of `pages` (page_id, url, html).

    Null and empty html, and pages without content, give an empty text.  Markup
    that is cut off, badly nested or has a quote left open is read as far as it
    goes.  Whole pages are read and nothing is capped; repeated rows repeat, an
    empty table gives an empty result, and other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    picked = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return in_arrow(picked, run, "page_id long, url string, text string, n_chars long")

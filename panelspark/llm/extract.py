"""Main text of web pages by tree scoring.

Paragraphs give points for their length and commas to their ancestors, halved at each
step; a container's points are discounted by the share of its text that is in links.
The best container and those of its siblings that score well are kept, without what is
marked as menu, form, advert, notice or comment, by its name or by its shape.

All sums run once over the nodes in page order or against it, so a page costs time in
proportion to its length, however deep it nests.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.llm.common import arrow_schema, record

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(/?)([A-Za-z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|(?=<)|\Z)",
    re.S,
)
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?", re.I)
_RAW = ("script", "style", "textarea", "template", "noscript", "iframe", "svg", "math", "object", "title", "xmp", "noembed", "noframes")
#: Of these, elements that '/>' ends.
_FOREIGN = frozenset(("iframe", "svg", "math", "object"))
_UNQUOTED_SLASH = re.compile(r"=\s*[^\s\"'][^\s]*/$")
_RAW_END = {t: re.compile(rf"</{t}\s*>", re.I) for t in _RAW}
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that are never part of the main text.
_DROPPED = frozenset("nav header footer aside form menu button select dialog fieldset head".split())
_NAMES = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|adv|advert|adverts|advertisement|advertising|sponsor|sponsored|promo|promotion|banner|cookie|cookies|consent|gdpr|notice|notices|alert"
    r"|popup|modal|overlay|sidebar|side|aside|menu|nav|navbar|navigation|breadcrumb|breadcrumbs|header|masthead|footer|foot|comment|comments|disqus|replies|reply|respond|responses"
    r"|share|sharing|social|related|recommended|newsletter|subscribe|signup|login|search|pagination|pager|toolbar|widget|skip|tags|toc)(?:$|[\s_-])",
    re.I,
)
#: Words that say nothing by themselves in a class or id; with a telling word they make a whole name.
_FILLERS = frozenset(
    "list lists box block blocks bar area section sections container wrapper wrap holder group row column col inner outer content links link items item button buttons icons icon"
    " bottom top left right main site page post posts primary secondary global sub mini form title heading count thread".split()
)
_PARTS = re.compile(r"[\s_-]+")
#: What a heading above reader comments says, and what the entries below it have.
_COMMENT_HEAD = re.compile(r"(?:\d+\s+|reader\s+|your\s+|all\s+|leave\s+a\s+|post\s+a\s+)*(?:comments?|responses?|repl(?:y|ies)|discussion|thoughts)(?:\s*\(\d+\)|\s+on\b.*)?:?", re.I)
_COMMENT_MARK = re.compile(
    r"^.{1,60}?\b(?:says|wrote|said|commented|replied|writes)\b\s*:|^.{0,80}\b\d+\s+(?:seconds?|minutes?|hours?|days?|weeks?|months?|years?)\s+ago\b|\breply\s*$", re.I | re.S
)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog toolbar".split())
_CLOSES_P = _BLOCKS - {"option", "optgroup", "html", "body"}
#: An open element that a start tag of the key closes, up to one of the stops.
_IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_SPACE = re.compile(r"\s+")
#: Share of the best container's points that a sibling needs.
SIBLING_SHARE = 0.2
#: Share of a container's text that may be in links if it is taken for its text alone.
LINK_SHARE = 0.2


class _Node:
    __slots__ = ("tag", "parent", "parts", "dropped", "named", "above", "held", "points", "size", "linked", "inside")

    def __init__(self, tag: str, parent: _Node | None, dropped: bool) -> None:
        self.tag, self.parent, self.dropped = tag, parent, dropped
        # named: its class or id tells what it is; above: the nearest such node; held: lies in an article
        self.named = self.inside = False
        self.above = parent and (parent if parent.named else parent.above)
        self.held = parent is not None and (parent.held or parent.tag in ("article", "main"))
        self.parts: list = []
        self.points = 0.0
        self.size = self.linked = 0


def _whole_name(value: str) -> bool:
    """Whether one of the names consists of telling words and fillers alone."""
    for name in value.split():
        parts = [p for p in _PARTS.split(name) if p and not p.isdigit()]
        telling = [bool(_NAMES.fullmatch(p)) for p in parts]
        if any(telling) and all(t or p in _FILLERS for t, p in zip(telling, parts, strict=True)):
            return True
    return False


def _unwanted(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is never main text, and whether a part or the whole of its name says so."""
    if tag in _DROPPED:
        return True, False, False
    named = whole = False
    for name, a, b, c in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), (a or b or c).lower()
        if name in ("class", "id"):
            if tag not in ("html", "body", "article", "main") and _NAMES.search(value):
                named, whole = True, whole or _whole_name(value)
        elif name == "role":
            if value in _ROLES:
                return True, False, False
        elif name == "hidden" or (name == "aria-hidden" and value == "true"):
            return True, False, False
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
            return True, False, False
    return False, named, whole


def parse(page: str) -> list[_Node]:
    """The nodes of a page in its order, the root first; tags that are left open or closed
    twice do no harm."""
    node = _Node("", None, False)
    nodes = [node]
    at, end = 0, len(page)
    match = _TOKEN.search
    while at < end:
        found = match(page, at)
        if found is None:
            node.parts.append(page[at:])
            break
        if found.start() > at:
            node.parts.append(page[at : found.start()])
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        if found.group(1):
            open_node = node
            while open_node.parent is not None and open_node.tag != tag:
                if tag not in _BLOCKS and open_node.tag in _BLOCKS:
                    break  # a stray inline end tag doesn't close blocks
                open_node = open_node.parent
            if open_node.parent is not None and open_node.tag == tag:
                node = open_node.parent
            continue
        attributes = found.group(3)
        if tag in _CLOSES_P:
            up = node
            while up.parent is not None and up.tag != "p" and up.tag not in _BLOCKS:
                up = up.parent
            if up.tag == "p":
                node = up.parent
        if tag in _IMPLIED:
            closed, stops = _IMPLIED[tag]
            up = node
            while up.parent is not None and up.tag not in stops:
                if up.tag in closed:
                    node = up.parent
                up = up.parent
        if tag in _FOREIGN and attributes.rstrip().endswith("/") and not _UNQUOTED_SLASH.search(attributes.rstrip()):
            continue
        if tag in _RAW:
            close = _RAW_END[tag].search(page, at)
            at = close.end() if close else end
            continue
        never, named, whole = _unwanted(tag, attributes)
        child = _Node(tag, node, node.dropped or never)
        # within an article only a whole name counts: its parts may be the article's subject
        child.named = whole if child.held else named
        nodes.append(child)
        node.parts.append(child)
        if tag not in _VOID and not attributes.rstrip().endswith("/"):
            node = child
    return nodes


def _blocks(root: _Node) -> list[tuple[_Node, str, int]]:
    """(block element, text, characters in links) of every run of inline content, in page order."""
    out: list[tuple[_Node, str, int]] = []
    pieces: list[str] = []
    linked, owner = 0, root

    def flush() -> None:
        nonlocal pieces, linked
        if pieces:
            text = _SPACE.sub(" ", html.unescape("".join(pieces))).strip()
            if text:
                out.append((owner, text, min(linked, len(text))))
        pieces, linked = [], 0

    # an explicit stack, as pages may nest deeper than Python's calls
    stack: list[tuple[_Node, int, _Node, bool]] = [(root, 0, root, False)]
    while stack:
        node, i, block, in_link = stack.pop()
        parts = node.parts
        while i < len(parts):
            part = parts[i]
            i += 1
            if isinstance(part, str):
                pieces.append(part)
                if in_link:
                    linked += len(part.strip())
                continue
            if part.tag == "br":
                pieces.append(" ")
            if part.dropped or part.tag in _VOID:
                if part.tag in _BLOCKS or part.dropped:
                    flush()
                continue
            stack.append((node, i, block, in_link))
            if part.tag in _BLOCKS:
                flush()
                owner = part
                stack.append((part, 0, part, in_link))
            else:
                stack.append((part, 0, block, in_link or part.tag == "a"))
            break
        else:
            if node.tag in _BLOCKS:
                flush()
                up = node.parent
                while up is not None and up.parent is not None and up.tag not in _BLOCKS:
                    up = up.parent
                owner = up or root
    flush()
    return out


def _points(text: str, linked: int) -> float:
    points = 1 + text.count(",") + text.count("،") + text.count("、") + min(len(text) / 100, 3)
    return points * (1 - linked / len(text))


def _drop_named(blocks: list[tuple[_Node, str, int]]) -> bool:
    """Drops the elements whose class or id names them, and tells whether there are any.

    A wrapper may bear such a name too: what holds over half of the page's points stays,
    unless what is left without it has a heading or article of its own and a tenth of the points.
    """
    inside: dict[_Node, float] = {}
    chains = []
    for node, text, linked in blocks:
        chain, article, up = [], node.held or node.tag in ("h1", "article", "main"), node if node.named else node.above
        while up is not None:
            chain.append(up)
            up = up.above
        points = _points(text, linked)
        chains.append((set(chain), points, article))
        for n in chain:
            inside[n] = inside.get(n, 0) + points
    half = sum(p for _, p, _ in chains) / 2
    spared: set[_Node] = set()
    # wrappers hold no less than what they wrap, so they come first
    for node in sorted((n for n in inside if inside[n] > half), key=lambda n: (-inside[n], _depth(n))):
        rest = [(p, article) for chain, p, article in chains if node not in chain and chain <= spared]
        outside = sum(p for p, _ in rest)
        if inside[node] > 9 * outside or not any(article for _, article in rest):
            spared.add(node)
    for node in inside:
        node.dropped = node not in spared
    return len(inside) > len(spared)


def _depth(node: _Node) -> int:
    depth = 0
    while node.parent is not None:
        node, depth = node.parent, depth + 1
    return depth


def _drop_comments(nodes: list[_Node], blocks: list[tuple[_Node, str, int]]) -> bool:
    """Drops reader comments that no name tells: what follows a heading that announces them,
    and lists whose every entry has a comment's marks; never over half of the page's points."""
    texts: dict[_Node, list[str]] = {}
    points: dict[_Node, float] = {}
    total = 0.0
    for node, text, linked in blocks:
        texts.setdefault(node, []).append(text)
        points[node] = points.get(node, 0.0) + _points(text, linked)
        total += _points(text, linked)
    sums = dict(points)
    for node in reversed(nodes):
        if node in sums and node.parent is not None:
            sums[node.parent] = sums.get(node.parent, 0.0) + sums[node]

    def told(node: _Node) -> str:
        """The text of an entry, by its parts in order."""
        out, stack = [], [node]
        while stack:
            part = stack.pop()
            out += texts.get(part, [])
            stack += [p for p in reversed(part.parts) if isinstance(p, _Node) and p in sums]
        return " ".join(out)

    gone = False
    for node in nodes:
        if node not in sums or node.dropped:
            continue
        children = [p for p in node.parts if isinstance(p, _Node) and not p.dropped]
        for i, child in enumerate(children):
            if child.tag in ("h2", "h3", "h4", "h5", "h6") and _COMMENT_HEAD.fullmatch(" ".join(texts.get(child, []))):
                rest = children[i:]
                if 2 * sum(sums.get(c, 0.0) for c in rest) < total:
                    for c in rest:
                        c.dropped = gone = True
                break
        entries = [c for c in children if c in sums and not c.dropped]
        if len(entries) >= 2 and len({c.tag for c in entries}) == 1 and entries[0].tag in ("li", "div", "article", "section", "dd") and 2 * sums[node] < total:
            if all(_COMMENT_MARK.search(told(c)) for c in entries):
                node.dropped = gone = True
    for node in nodes:
        if node.parent is not None and node.parent.dropped:
            node.dropped = True
    return gone


def main_blocks(page: str) -> list[str]:
    """The blocks of the main text in page order."""
    nodes = parse(page)
    root = nodes[0]
    blocks = _blocks(root)
    if _drop_named(blocks):
        blocks = _blocks(root)
    if _drop_comments(nodes, blocks):
        blocks = _blocks(root)
    if not blocks:
        return []
    touched: dict[_Node, None] = {}
    for node, text, linked in blocks:
        points = _points(text, linked)
        # a paragraph's own container gets all its points, each step up half as many
        up = node.parent if node.tag in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dd", "dt", "td", "blockquote") and node.parent else node
        up.size += len(text)
        up.linked += linked
        share = 1.0
        while up is not None and share > 0.01:
            touched[up] = None
            up.points += points * share
            share /= 2
            up = up.parent
    for node in reversed(nodes):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked

    def score(node: _Node) -> float:
        bonus = 1.5 if node.tag in ("article", "main") else 1.0
        return bonus * node.points * (1 - node.linked / max(1, node.size))

    best = max(touched, key=score)
    # lists, tables and quotations are parts of the container that holds them
    while best.parent is not None and best.tag in ("ul", "ol", "dl", "li", "table", "tbody", "tr", "td", "blockquote", "figure", "p", "pre"):
        best = best.parent
    # an article is one whole, however its text is split
    up = best
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    if up is not None and up.linked <= LINK_SHARE * up.size:
        best = up
    held = set()
    for node, _, _ in blocks:
        if node.tag in ("p", "pre", "blockquote") and node.parent is not None:
            held.add(node.parent)
    best.inside = True
    if best.parent is not None and best.tag not in ("article", "main", "body", "html"):
        least = SIBLING_SHARE * score(best)
        for part in best.parent.parts:
            if isinstance(part, _Node) and part is not best and not part.dropped:
                if part.size and (score(part) >= least or (part in held and part.linked <= LINK_SHARE * part.size)):
                    part.inside = True
                elif part.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote"):
                    part.inside = True
    for node in nodes:
        node.inside = node.inside or (node.parent is not None and node.parent.inside)
    return [text for node, text, linked in blocks if node.inside]


def main_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row; null or empty html has the empty text.

    Character references are decoded, white space inside a block is one space, blocks are
    joined by an empty line.  Pages are read one by one, whatever their length; repeated
    rows stay.
    """
    ddl = "page_id long, url string, text string, n_chars long"
    schema = arrow_schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, chars = [], 0
            for page, url, source in zip(*(batch.column(c) for c in ("page_id", "url", "html")), strict=True):
                text = "\n\n".join(main_blocks(source.as_py() or ""))
                rows.append((page.as_py(), url.as_py(), text, len(text)))
                chars += len(text)
                if chars > 4_000_000:
                    yield record(rows, schema)
                    rows, chars = [], 0
            if rows:
                yield record(rows, schema)

    return pages.select(F.col("page_id").cast("long"), "url", "html").mapInArrow(run, ddl)

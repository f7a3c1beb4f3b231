"""Main text of web pages by tree scoring (op 2).

Paragraphs give points for their length and commas to the elements around them; an element's sum is
discounted by the share of its text that stands in links. The best container, and those of its siblings
that look like parts of the same text, are kept, without what is marked as something else.
"""

from __future__ import annotations

import re
from collections import Counter
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.common import beside, prepare

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements that never hold main text.
DROPPED = frozenset(
    "head title script style noscript template svg math iframe object canvas audio video nav header footer aside form button select textarea input label fieldset dialog menu map".split()
)
#: Elements that make a block of their own.
BLOCKS = frozenset(
    "html body address article blockquote center dd details div dl dt figcaption figure h1 h2 h3 h4 h5 h6 hgroup hr li main ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: An open element of the first kind ends where one of the second kind starts.
CLOSED_BY = {
    "p": BLOCKS - {"html", "body"} | {"nav", "header", "footer", "aside", "form", "menu", "fieldset"},
    "li": frozenset({"li"}), "dt": frozenset({"dt", "dd"}), "dd": frozenset({"dt", "dd"}),
    "tr": frozenset({"tr", "tbody", "tfoot"}), "td": frozenset({"td", "th", "tr", "tbody", "tfoot"}), "th": frozenset({"td", "th", "tr", "tbody", "tfoot"}),
    "option": frozenset({"option", "optgroup"}),
    "head": frozenset({"body"}) | BLOCKS - {"html", "body"} | {"nav", "header", "footer", "aside", "form"},
}
#: A new element of these kinds isn't inside an open p beyond these.
SCOPES = frozenset("html body article section div main table td th blockquote ul ol li aside nav header footer form figure dl".split())
#: Words in class, id or role that tell what an element is for.
_WORDS = (
    r"ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|side-?bar|nav\w*|menu|breadcrumbs?|footer|masthead|comments?|comment-?list|respond|replies|disqus|cookies?|consent|gdpr|notice\w*|alert|pop-?up|modal|overlay|newsletter|"
    r"subscri\w+|sign-?up|share|sharing|social\w*|related|recommend\w*|widget|pagination|pager|toolbar|skip-?link|copyright|disclaimer|paywall|login|search|complementary|contentinfo|dialog"
)
#: Words beside them that don't change this: where it stands, and what shape it has.
_SHAPES = r"site|page|main|top|bottom|left|right|global|primary|secondary|user|reader|box|bar|links?|list|container|wrap(?:per)?|block|section|area|buttons?|icons?|items?|content|inner|unit|slot|form|posts?|articles?|stories|nav|menu|footer|header|panel|message|text|thread|media|notes?|info|copy|row|col(?:umn)?s?|outer|region|zone|strip|fixed|sticky|mobile|desktop|\d+"
#: An element whose whole name says that it is something other than the text is left out; where such a word is only a part of a name (social-history), short or link-dense ones are.
MARKED = re.compile(rf"(?:^|\s)(?:(?:{_SHAPES})[_-])*(?:{_WORDS})(?:[_-]+(?:{_WORDS}|{_SHAPES}))*(?:$|\s)", re.IGNORECASE)
HINTED = re.compile(rf"(?:^|[\s_-])(?:{_WORDS})(?:$|[\s_-])", re.IGNORECASE)
#: Characters under which an element with a hint is left out, and the share of its text in links from which on it is.
HINT_LENGTH, HINT_LINKS = 80, 0.3
SPACE = re.compile(r"\s+")
ENDED = re.compile(r"[.!?](?:\s|$)")
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SCORED = frozenset("p pre td blockquote li dd".split())


#: A tag that the page's end cut off.
CUT_TAG = re.compile(r"<[A-Za-z/!][^<>]*$")


class Node:
    __slots__ = ("tag", "parent", "children", "marked", "hinted", "points", "length", "linked", "links", "limit")

    def __init__(self, tag: str, parent: Node | None, marked: bool = False, hinted: bool = False):
        self.tag, self.parent, self.marked, self.hinted = tag, parent, marked, hinted
        self.children: list[Node | str] = []
        self.points, self.length, self.linked, self.links = 0.0, 0, 0, 0
        #: The nearest element, itself included, that a new one may close or can't close beyond.
        self.limit: Node | None = self if parent is None or tag in CLOSED_BY or tag in SCOPES else parent.limit


#: An end tag inside of one of these doesn't reach outside, but for the ends of a table's own parts.
CELLS = frozenset("td th table".split())
OUTSIDE = frozenset("table tr tbody body html".split())


class TreeBuilder(HTMLParser):
    """A tree of elements that forgives missing ends, as browsers do in the common cases. Time is linear at any depth.

    Steps up go from limit to limit, of which few stand between a place and the next scope. How many elements of each name
    are open, in all and since the innermost cell, is counted, so an end without a beginning costs nothing.
    """

    CDATA_CONTENT_ELEMENTS = ("script", "style")

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", None)
        self.open: Counter[str] = Counter()
        self.since_cell: list[Counter[str]] = [Counter()]

    def enter(self, node: Node) -> None:
        self.at = node
        self.open[node.tag] += 1
        if node.tag in CELLS:
            self.since_cell.append(Counter())
        else:
            self.since_cell[-1][node.tag] += 1

    def leave_to(self, node: Node) -> None:
        """Closes what is open up to node, which stays open."""
        while self.at is not node:
            self.open[self.at.tag] -= 1
            if self.at.tag in CELLS:
                self.since_cell.pop()
            else:
                self.since_cell[-1][self.at.tag] -= 1
            self.at = self.at.parent

    def handle_starttag(self, tag, attrs):
        if tag == "br":
            self.at.children.append(" ")
            return
        node = self.at.limit
        while node.parent is not None:
            if tag in CLOSED_BY.get(node.tag, ()):
                self.leave_to(node.parent)
            elif node.tag in SCOPES:
                break
            node = node.parent.limit
        marks = " ".join(v for k, v in attrs if v and k in ("class", "id", "role")) if attrs else ""
        hidden = any(k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and "display:none" in v.replace(" ", "").lower()) for k, v in attrs)
        child = Node(tag, self.at, hidden or bool(marks and MARKED.search(marks)), bool(marks and HINTED.search(marks)))
        self.at.children.append(child)
        if tag not in VOID:
            self.enter(child)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.at.tag == tag and tag not in VOID and tag in ("svg", "path", "use"):
            self.leave_to(self.at.parent)

    def handle_endtag(self, tag):
        inside = tag not in OUTSIDE and tag not in CELLS
        if not (self.since_cell[-1] if inside else self.open)[tag]:
            return
        node = self.at
        while node.tag != tag:
            if node.tag in CELLS and tag not in OUTSIDE:
                return
            node = node.parent
        self.leave_to(node.parent)

    def handle_data(self, data):
        self.at.children.append(data)


def build(html: str) -> Node:
    builder = TreeBuilder()
    builder.feed(CUT_TAG.sub("", html))
    builder.close()
    return builder.root


def skipped(node: Node) -> bool:
    return node.tag in DROPPED or (node.marked and node.tag not in ("html", "body", "article", "main"))


def measure(root: Node) -> None:
    """Text length, linked length and links of every kept element, without recursion: trees may be deep. What is only hinted at is settled by them."""
    stack: list[tuple[Node, bool]] = [(root, False)]
    while stack:
        node, seen = stack.pop()
        if not seen:
            stack.append((node, True))
            stack.extend((c, False) for c in node.children if isinstance(c, Node) and not skipped(c))
            continue
        for c in node.children:
            if isinstance(c, str):
                node.length += len(SPACE.sub(" ", c).strip())
            elif not skipped(c):
                node.length += c.length
                node.linked += c.length if c.tag == "a" else c.linked
                node.links += (c.tag == "a" and c.length > 0) + c.links
        if node.hinted and (node.length < HINT_LENGTH or density(node) >= HINT_LINKS):
            node.marked = True


def link_list(node: Node) -> bool:
    """A group of links rather than text."""
    return node.tag in ("ul", "ol", "dl", "div", "section", "table") and node.links >= 2 and density(node) > 0.5


def blocks(root: Node) -> list[str]:
    """The text of each block below root, in page order, white space made single."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = SPACE.sub(" ", "".join(line)).strip()
        line.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = [root]
    while stack:
        item = stack.pop()
        if item is None:
            end()
        elif isinstance(item, str):
            line.append(item)
        elif item is root or not (skipped(item) or link_list(item)):
            if item.tag in BLOCKS:
                end()
                stack.append(None)
            following = True
            for c in reversed(item.children):  # a heading over a group of links goes with it
                if isinstance(c, str) or not (c.tag in HEADINGS and not following):
                    stack.append(c)
                if isinstance(c, Node) and c.length and not skipped(c):
                    following = not link_list(c) and (following or c.tag not in HEADINGS)
    end()
    return out


def flow_text(node: Node) -> str:
    """A paragraph's own text: what is in it outside of other blocks."""
    parts: list[str] = []
    stack: list[Node | str] = list(reversed(node.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif item.tag not in BLOCKS and not skipped(item):
            stack.extend(reversed(item.children))
    return SPACE.sub(" ", "".join(parts)).strip()


def density(node: Node) -> float:
    return node.linked / node.length if node.length else 0.0


def pick(root: Node) -> list[Node]:
    """The best container with the siblings that belong to it, in page order."""
    scored: dict[int, Node] = {}
    order: list[Node] = []
    stack: list[Node] = [root]
    while stack:
        node = stack.pop()
        if skipped(node):
            continue
        order.append(node)
        stack.extend(c for c in reversed(node.children) if isinstance(c, Node))
    for node in order:
        own = node.tag in SCORED or (node.tag in ("div", "section", "article", "main", "body") and any(isinstance(c, str) and len(c.strip()) >= 25 for c in node.children))
        if not own:
            continue
        text = flow_text(node)
        if len(text) < 25:
            continue
        points = 1 + text.count(",") + text.count("、") + min(len(text) / 100, 3)
        above, share = node if node.tag not in SCORED else node.parent, 1.0
        for level in range(4):
            if above is None or above.tag == "#root":
                break
            if level:
                share = 0.5 if level == 1 else 0.5 / (level * 1.5)
            above.points += points * share
            scored[id(above)] = above
            above = above.parent
    if not scored:
        bodies = [n for n in order if n.tag in ("article", "main")] or [n for n in order if n.tag == "body"] or [root]
        return bodies[:1]
    bonus = {"article": 1.25, "main": 1.2, "td": 0.8, "li": 0.6, "ul": 0.6, "ol": 0.6, "body": 0.7, "html": 0.5}
    worth = {k: n.points * (1 - density(n)) * bonus.get(n.tag, 1.0) for k, n in scored.items()}
    best = max(order, key=lambda n: worth.get(id(n), 0.0))
    least = max(10.0, 0.2 * worth.get(id(best), 0.0))

    def belongs(c: Node) -> bool:
        if skipped(c) or link_list(c):
            return False
        text = flow_text(c) if c.tag == "p" else ""
        return worth.get(id(c), 0.0) >= least or (c.tag == "p" and ((len(text) > 80 and density(c) < 0.25) or (0 < len(text) <= 80 and density(c) == 0 and bool(ENDED.search(text)))))

    def with_siblings(node: Node) -> tuple[list[Node], bool]:
        """node and the siblings that belong to it, and whether no other has text. A heading belongs where what follows does."""
        kept, whole, following = [], True, True
        for c in reversed(node.parent.children):
            if isinstance(c, str):
                whole = whole and not c.strip()
                continue
            mine = c is node or (following if c.tag in HEADINGS else belongs(c)) and c.length > 0
            if mine:
                kept.append(c)
            if c.length and not skipped(c):
                whole, following = whole and mine, mine
        return kept[::-1], whole

    # an article that holds the best container and nothing that doesn't belong to it is the whole of it
    while best.parent is not None and best.tag not in ("article", "main", "body", "html", "#root") and best.parent.tag in ("article", "main"):
        kept, whole = with_siblings(best)
        if not whole:
            return kept
        best = best.parent
    if best.parent is None or best.tag in ("article", "main", "body", "html"):
        return [best]
    return with_siblings(best)[0]


def main_text(html: str | None) -> str:
    """The main text of one page; empty where there is none. Blocks are joined by one blank."""
    if not html:
        return ""
    root = build(html)
    measure(root)
    return " ".join(part for node in pick(root) for part in blocks(node))


def extract_pages(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page.

    Null, empty and unreadable html gives an empty text. Rows are independent: repeated rows and ties stay
    as they are, further columns are left out, an empty table gives no rows. Nothing is shuffled; one page is
    held at a time, with a tree of a size in proportion to the page.
    """
    prepare(pages.sparkSession)

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    out = beside(rows, ["page_id", "url"], "html", lambda batch: [(main_text(x),) for x in batch], "text string")
    return out.withColumn("n_chars", F.char_length("text").cast("long"))

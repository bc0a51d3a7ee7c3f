"""Main text of web pages by tree scoring.

The page becomes a tree (unclosed paragraphs and list items end where HTML says they do). Elements
that are not article text go: scripts, styles, forms, menus, page headers and footers, sidebars,
and what its class, id or role names as advert, notice, sharing, related links or reader comments.
A name alone takes no article, no element around one, and no container of most of the page's points
(on a page with an article, such a container counts only inside it).
Every remaining paragraph earns points for its length and commas and passes them to its ancestors,
less with each level; an element's points are discounted by the share of its text in links. The best
element, or the article it stands in, is the container; its siblings join if they earn a fair share.
Lists and tables of hardly anything but links inside the container go; within an article they stay if their links
are as long as titles, as references are. A paragraph whose name only begins with such a word stays if it reads as text.

Character references are decoded, white space inside a block becomes one blank, blocks are joined in
page order by one newline. The whole page is read and nothing is capped.

Defined cases: NULL, empty and text-free pages give an empty text; broken markup is read as far as
it makes sense; repeated rows agree, NULL ids and extra columns do no harm. The job is one scan.
"""

from __future__ import annotations

import html
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from clickfold.llm.common import small_batches

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTR = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WORD = re.compile(r"[a-z]+")

#: Fixed HTML facts: elements without an end, elements whose content is not markup, blocks.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption
figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre search section summary table
tbody td tfoot th thead tr ul""".split())
#: A start tag on the left ends an open element on the right, within the nearest of ``SCOPE``.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
        "option": {"option"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
SCOPE = frozenset("ul ol menu dl table select body html article section div td th".split())

#: Elements and roles that never hold article text, and names that say so.
DROPPED = frozenset("""head script style noscript template nav aside form button select input textarea iframe object embed svg
canvas footer dialog title xmp noembed noframes menu search""".split())
ROLES = frozenset("navigation banner complementary contentinfo dialog alertdialog alert search form menu menubar toolbar".split())
NEVER = frozenset("""ad ads advert adverts advertisement advertising sponsor sponsored promo promotion comment comments reply
replies respond disqus sidebar sidebars nav navbar navigation menu menus breadcrumb breadcrumbs cookie cookies consent gdpr
footer share sharing social related recommended newsletter subscribe signup login popup modal overlay pagination pager
toolbar skip hidden""".split())
#: Reader comments, which look like article text; names that hide or describe only as a whole; first parts of names
#: that describe what an element has or belongs to.
READERS = frozenset("comment comments reply replies respond disqus".split())
WHOLE = frozenset("skip hidden".split())
STATES = frozenset("has have with without no not is tag category cat type format status".split())
#: Least share of an element's text in links by which a list or table counts as a list of links.
ALL_LINKS = 0.9
#: Characters of a link that is a title rather than a word of a menu; of a paragraph that reads as text.
TITLE, SENTENCE = 25, 80
SELDOM = frozenset("header masthead banner notice notices alert widget widgets tags meta byline toc outbrain taboola rating".split())
TEXTUAL = frozenset("article content entry post story text body main".split())
#: What may stand in a page's head, and elements whose end tags alone reach beyond them.
IN_HEAD = frozenset("base link meta title style script noscript template noframes".split())
WALLS = frozenset("template object svg".split())
PARAGRAPHS = frozenset("p pre blockquote td dd li figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


class Node:
    __slots__ = ("tag", "parent", "children", "points", "own", "total", "size", "linked", "links", "unwanted", "named")

    def __init__(self, tag: str, parent: "Node | None"):
        self.tag, self.parent, self.children = tag, parent, []
        self.points = self.own = self.total = 0.0
        self.size = self.linked = self.links = self.named = 0
        self.unwanted = False


def _unwanted(tag: str, raw: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element goes in any case, and how its names speak against it (see ``_named``)."""
    if tag in DROPPED or (tag == "header" and not in_article):
        return True, 0
    if not raw or tag in ("html", "body"):
        return False, 0
    attrs = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTR.finditer(raw)}
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true":
        return True, 0
    if attrs.get("role", "").lower() in ROLES:
        return True, 0
    if "display:none" in attrs.get("style", "").lower().replace(" ", ""):
        return True, 0
    return False, _named(tag, f"{attrs.get('class', '')} {attrs.get('id', '')}".lower())


def _named(tag: str, names: str) -> int:
    """0: nothing against the element; 1: a part of a name, which a fair share of points outweighs;
    2: a name or the last part of one; 3: reader comments."""
    found, words = 0, set()
    for name in names.split():
        parts = _WORD.findall(name)
        if not parts or len(parts) > 1 and parts[0] in STATES:
            continue
        words.update(parts)
        if len(parts) > 1:
            parts = [x for x in parts if x not in WHOLE]
        if READERS.intersection(parts):
            found = 3
        elif parts and parts[-1] in NEVER:
            found = max(found, 2)
        elif NEVER.intersection(parts):
            found = max(found, 1)
    if tag in ("article", "main"):
        return 3 if found == 3 and tag == "article" and not words & TEXTUAL - {"body", "content", "text"} else 0
    if not found and words & SELDOM and not words & TEXTUAL:
        return 2
    return found


def parse(page: str) -> Node:
    """The tree of a page without elements that go in any case; text is kept as decoded strings."""
    root = at = Node("#", None)
    lower = None
    unwanted_inline = set()  # tags of unwanted elements that are no blocks
    pos, end = 0, len(page)
    articles = 0
    while pos < end:
        lt = page.find("<", pos)
        m = _TOKEN.match(page, lt) if lt >= 0 else None
        stop = lt if m is not None else end if lt < 0 else lt + 1
        if stop > pos:
            text = page[pos:stop]
            if at.tag == "head" and text.strip():
                at = at.parent
            at.children.append(html.unescape(text) if "&" in text else text)
        if m is None:
            pos = stop
            continue
        pos = m.end()
        tag = m[2]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1]:
            node = at
            while node.parent is not None and node.tag != tag:
                if node.tag in WALLS or tag not in BLOCK and tag not in unwanted_inline and node.tag in BLOCK:
                    node = root  # an inline end tag does not end a block
                    break
                node = node.parent
            if node.parent is not None:
                left = at
                while left is not node.parent:
                    articles -= left.tag in ("article", "main")
                    left = left.parent
                at = node.parent
            elif tag == "br":
                at.children.append(" ")
            continue
        empty = tag in VOID or m[3].endswith("/") and tag not in BLOCK
        if tag in RAW:  # its content is no markup: go to its end tag
            if lower is None:
                lower = page.lower()
            close = lower.find(f"</{tag}", pos)
            pos = end if close < 0 else page.find(">", close) + 1 or end
            continue
        if at.tag == "head" and tag not in IN_HEAD:
            at = at.parent
        if tag in BLOCK:  # an open paragraph ends before a block; list items end before the next
            node = at
            while node.parent is not None and node.tag not in BLOCK:
                node = node.parent
            if node.tag == "p" and node.parent is not None:
                at = node.parent
        while tag in ENDS:  # a new row ends the open cell and its row
            node = at
            while node.parent is not None and node.tag not in SCOPE - ENDS[tag] and node.tag not in ENDS[tag]:
                node = node.parent
            if node.tag not in ENDS[tag] or node.parent is None:
                break
            at = node.parent
        if empty:
            if tag == "br":
                at.children.append(" ")
            elif tag == "hr":
                at.children.append(Node("hr", at))
            continue
        node = Node(tag, at)
        node.unwanted, node.named = _unwanted(tag, m[3], articles > 0)
        if (node.unwanted or node.named) and tag not in BLOCK:
            unwanted_inline.add(tag)
        at.children.append(node)
        at = node
        articles += tag in ("article", "main")
    _drop(root)
    return root


def _drop(root: Node) -> None:
    """Take the unwanted elements out; a block leaves a break between its neighbours."""
    stack = [root]
    while stack:
        node = stack.pop()
        if any(isinstance(c, Node) and c.unwanted for c in node.children):
            node.children = [Node("hr", node) if isinstance(c, Node) and c.unwanted else c for c in node.children
                             if not (isinstance(c, Node) and c.unwanted and c.tag not in BLOCK)]
        stack += [c for c in node.children if isinstance(c, Node)]


def _in_order(root: Node) -> list[Node]:
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        out.append(node)
        stack += [c for c in reversed(node.children) if isinstance(c, Node)]
    return out


def _measure(nodes: list[Node]) -> None:
    """Text and link-text sizes of all subtrees, children before parents."""
    for node in nodes:
        node.points = node.own = node.total = 0.0
        node.size = node.linked = node.links = 0
    for node in reversed(nodes):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        node.size += own
        if node.tag == "a":
            node.linked, node.links = node.size, 1
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
            node.parent.links += node.links


def _text(node: Node) -> str:
    """All text below a node, inline and block alike."""
    parts, stack = [], [node]
    while stack:
        x = stack.pop()
        if isinstance(x, str):
            parts.append(x)
        else:
            stack += reversed(x.children)
    return " ".join("".join(parts).split())


def _link_share(node: Node) -> float:
    return node.linked / node.size if node.size else 0.0


def _score(nodes: list[Node]) -> None:
    for node in nodes:
        direct = any(isinstance(c, str) and c.strip() for c in node.children)
        if node.tag not in PARAGRAPHS and not (direct and node.tag in BLOCK and node.tag not in HEADINGS):
            continue
        if any(isinstance(c, Node) and c.tag in PARAGRAPHS for c in node.children) and not direct:
            continue
        text = _text(node)
        if not text:
            continue
        points = (min(1.0, len(text) / 25) + text.count(",") + text.count("，") + min(3.0, len(text) / 100)) * (1 - _link_share(node))
        node.own += points
        up, level = node.parent if node.tag in PARAGRAPHS else node, 0
        while up is not None and up.tag != "#":
            up.points += points / (1, 2, 6, 9, 12)[min(level, 4)]
            up, level = up.parent, level + 1


def _best(nodes: list[Node]) -> Node | None:
    return max((n for n in nodes if n.points > 0 and n.tag in BLOCK),
               key=lambda n: n.points * (1 - _link_share(n)), default=None)


def _judge_names(nodes: list[Node]) -> bool:
    """Mark what goes by its name; True if anything does."""
    page = nodes[0].total
    around: set[Node] = set()  # elements around an article or main
    inside: set[Node] = set()  # articles with text and all below them
    holds: set[Node] = set()  # containers: elements around paragraphs or headings
    for n in nodes:
        article = n.tag in ("article", "main") and not n.named
        if article and n.total > 0 or n.parent in inside:
            inside.add(n)
        for found, seen in ((article, around), (n.tag in PARAGRAPHS or n.tag in HEADINGS, holds)):
            up = n.parent if found else None
            while up is not None and up not in seen:
                seen.add(up)
                up = up.parent
    for n in nodes:
        if not n.named or n in around and n.named < 3:
            continue
        most = 1.0 if n.named == 3 else 0.5
        if n in holds and (n in inside or not inside) and page > 0 and (n.total >= most * page or n.named == 1 and n.total * (1 - _link_share(n)) >= 0.2 * page):
            continue
        if n.named == 1 and n.tag in PARAGRAPHS and (n in inside or not inside) and n.size >= SENTENCE and _link_share(n) < 0.25:
            continue
        n.unwanted = True
    return any(n.unwanted for n in nodes)


def _read(root: Node) -> list[Node]:
    """The elements of a tree in order, measured and scored."""
    nodes = _in_order(root)
    _measure(nodes)
    _score(nodes)
    for node in reversed(nodes):
        node.total += node.own
        if node.parent is not None:
            node.parent.total += node.total
    return nodes


def _container(nodes: list[Node]) -> list[Node]:
    """The best element, or its article, with the siblings that belong to it."""
    best = _best(nodes)
    if best is None:
        return []
    article = None
    up = best
    while up is not None:  # an article that is the smaller part of another stands for the whole
        if up.tag in ("article", "main") and (article is None or article.total < 0.5 * up.total):
            article = up
        up = up.parent
    if article is not None:
        while article.parent is not None and article.parent.tag not in ("#", "html", "body") and article.parent.total <= article.total:
            article = article.parent
        least = 0.2 * article.total * (1 - _link_share(article))
        return [x for x in article.parent.children if isinstance(x, Node)
                and (x is article or x.tag in BLOCK and x.total > 0 and x.total * (1 - _link_share(x)) >= least)]
    parent = best.parent
    if best.tag == "body" or parent is None:
        return [best]
    least = 0.2 * best.points * (1 - _link_share(best))
    kept = []
    for x in parent.children:
        if not isinstance(x, Node):
            continue
        fair = x.points * (1 - _link_share(x)) >= least
        if x is best or x.tag in HEADINGS or fair or x.tag in PARAGRAPHS and x.size and _link_share(x) < 0.25:
            kept.append(x)
    return kept


def _in_article(node: Node) -> bool:
    while node is not None and node.tag != "article":
        node = node.parent
    return node is not None


def _blocks(tops: list[Node]) -> list[str]:
    """Text blocks in page order; lists and tables that are mostly links are left out, but for references."""
    out: list[str] = []
    run: list[str] = []

    def close():
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    stack: list = list(reversed(tops))
    while stack:
        x = stack.pop()
        if x is None:
            close()
        elif isinstance(x, str):
            run.append(x)
        else:
            if x.tag in ("ul", "ol", "dl", "table", "div", "section") and _link_share(x) > ALL_LINKS and x not in tops and not (
                    x.linked >= TITLE * x.links and _in_article(x)):
                close()
                continue
            if x.tag in BLOCK:
                close()
                stack.append(None)
            stack += reversed(x.children)
    close()
    return out


def main_text(page: str | None) -> str:
    if not page:
        return ""
    root = parse(page)
    nodes = _read(root)
    if _judge_names(nodes):
        _drop(root)
        nodes = _read(root)
    return "\n".join(_blocks(_container(nodes) or nodes[:1]))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars) of every page."""
    schema = T.StructType([T.StructField(id_col, pages.schema[id_col].dataType), T.StructField(url_col, pages.schema[url_col].dataType),
                           T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def batches(it):
        for batch in it:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                                              pa.array([len(t) for t in texts], pa.int64())], [f.name for f in schema.fields])

    return small_batches(pages.select(id_col, url_col, html_col)).mapInArrow(batches, schema)

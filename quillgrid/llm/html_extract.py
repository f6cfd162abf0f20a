"""Main text of web pages by scoring the element tree.

A tolerant reader builds the tree. What can't be main text (scripts, menus,
forms, footers, adverts, notices, comments, by element, role or class) goes.
Paragraphs then give points, for themselves, their commas and their length, to
their parent in full and to further ancestors in shares; an element's score is
discounted by the share of its text that lies in links. The best container is
kept, or the whole article element around it, with the siblings that score
well, that are sections like it, or that stand between such ones; a closing
paragraph, however short, and the heading in front of it belong to it. Its
blocks, white space joined, are the text. A reader's comment is one whatever
element it stands in. A form goes, unless it is a frame around the page, with
most of its paragraphs inside; then only its controls go.

Defined results: the first of equally good containers wins; a page of any
length is read whole, in time proportional to it; null or empty html gives an empty text; a page without any
paragraph gives the blocks of its body; repeated rows get the same result each;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, tune

_TAGS = r"""<(/?)([A-Za-z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([A-Za-z][^\s/>]*)([^>]*)>"""
MARKUP = re.compile(rf"<!--(?:.*?-->|.*\Z)|<[!?][^>]*>?|{_TAGS}", re.DOTALL)
#: The same where a CDATA section is known to end.
SECTIONED = re.compile(rf"<!\[CDATA\[.*?\]\]>|{MARKUP.pattern}", re.DOTALL)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content isn't markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>|</{t}\Z", re.IGNORECASE) for t in RAW}
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
#: An element of the first kind ends an open one of the second, inside the third.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "thead": ({"tbody", "thead", "tfoot"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
    "body": ({"head"}, {"html"}),
}
#: Elements and roles that hold no main text.
NO_TEXT = frozenset("head script style noscript template iframe object embed svg math canvas audio video map form button select textarea input label fieldset datalist nav footer aside menu dialog title xmp noembed noframes search".split())
NO_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar tablist tooltip status".split())
#: Elements that may frame a page although they hold no text as a rule.
FRAMES = frozenset(["form"])
#: Words of class and id that tell a reader's comment.
COMMENT = frozenset("comment comments commentlist commentary disqus respond replies reply".split())
#: Words of class and id: never main text; no main text unless a GOOD word stands beside; signs of main text.
NEVER = frozenset("ad ads adbox adslot advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion cookie cookies consent gdpr comment comments commentlist commentary disqus respond replies reply footer popup modal newsletter subscribe subscription signup login paywall share sharing sharebar social breadcrumb breadcrumbs pagination pager navbar navigation nav menu notice notices alert alerts outbrain taboola hidden".split())
RATHER_NOT = frozenset("sidebar sidebars side rail aside widget widgets header masthead banner toolbar related recommended recommendations recommend topbar foot tags meta byline overlay skip".split())
GOOD = frozenset("article content main post entry story text body page".split())
#: Words that turn a longer name into something told about the page.
TOLD = frozenset("has with without no not open closed enabled disabled allowed".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
PARAGRAPHS = frozenset("p pre blockquote td li dd div section article main body h2 h3 h4 figcaption".split())


class Node:
    __slots__ = ("attributes", "block", "children", "dropped", "linked", "parent", "score", "size", "tag")

    def __init__(self, tag: str, parent: Node | None, attributes: str = "") -> None:
        self.tag, self.parent, self.attributes = tag, parent, attributes
        self.block: Node | None = parent if parent is None or parent.tag in BLOCK else parent.block  # the nearest block around it
        self.children: list[Node | str] = []
        self.dropped, self.size, self.linked, self.score = False, 0, 0, 0.0


def tree(source: str) -> tuple[Node, list[Node]]:
    """The root, and all elements in page order."""
    root = Node("#root", None)
    nodes, open_ = [root], [root]
    places: dict[str, list[int]] = {}  # where each tag is open, and where blocks are
    blocks: list[int] = []
    at, end, sectioned = 0, len(source), source.rfind("]]>")

    def text(raw: str) -> None:
        if raw:
            open_[-1].children.append(html.unescape(raw) if "&" in raw else raw)

    def cut(i: int) -> None:
        """The element that is open at i ends, and with it those inside."""
        for n in open_[i:]:
            places[n.tag].pop()
            if n.tag in BLOCK:
                blocks.pop()
        del open_[i:]

    def last(tags: set[str]) -> int:
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags: set[str], inside: set[str]) -> None:
        if (i := last(tags)) > last(inside):
            cut(i)

    while at < end:
        m = (SECTIONED if at <= sectioned else MARKUP).search(source, at)
        if m is None:
            text(source[at:])
            break
        text(source[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA[") and m[0].endswith("]]>"):
                text(html.escape(m[0][9:-3], quote=False))
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            i = last({tag})
            if i and (tag in BLOCK or not blocks or i > blocks[-1]):  # an inline end doesn't end blocks
                cut(i)
            continue
        if tag in BLOCK:
            close({"p"}, {"table", "td", "th", "button", "object"})
        if tag in ENDS:
            close(*ENDS[tag])
        node = Node(tag, open_[-1], m[3] or m[6] or "")
        open_[-1].children.append(node)
        nodes.append(node)
        if tag in RAW:
            stop = RAW_END[tag].search(source, at)
            at = stop.end() if stop else end
        elif tag not in VOID:
            places.setdefault(tag, []).append(len(open_))
            if tag in BLOCK:
                blocks.append(len(open_))
            open_.append(node)
    return root, nodes


def attributes(node: Node) -> dict[str, str]:
    return {k.lower(): html.unescape(a or b or c) for k, a, b, c in ATTRIBUTE.findall(node.attributes)}


def words_of(node: Node) -> tuple[dict[str, str], set[str], set[str]]:
    """Attributes, words that are a class or id of their own, and words of longer names. A name such as has-menu or comments-open says nothing about the element."""
    if not node.attributes:
        return {}, set(), set()
    a = attributes(node)
    alone, parts = set(), set()
    for name in f"{a.get('class', '')} {a.get('id', '')}".split():
        words = [w.lower() for w in WORD.findall(name)]
        if len(words) == 1:
            alone.update(words)
        elif not TOLD.intersection(words):
            parts.update(words)
    return a, alone, parts


def page_headers(nodes: list[Node]) -> set[int]:
    """Headers of the page, not of a post: they stand beside the page's parts or hold some of them."""
    parts = frozenset(("nav", "main", "article", "footer", "aside", "form"))
    holders, posts, found = set(), set(), set()
    for node in nodes[1:]:  # parents before children
        if node.tag in parts:
            holders.add(id(node.parent))
        if node.parent.tag in ("article", "main") or id(node.parent) in posts:
            posts.add(id(node))
    for node in nodes[1:]:
        if node.tag == "header" and id(node) not in posts and (node.parent.tag in ("body", "html", "#root") or id(node.parent) in holders or id(node) in holders):
            found.add(id(node))
    return found


def no_main_text(node: Node, holds_article: bool, frame: bool, header: bool = False, most: bool = False) -> bool:
    """Whether an element can't hold main text, by its name, role, class and id.

    A word of a longer name (nav-wrapper, market-share) doesn't count against
    an element that holds most of the page's paragraphs.
    """
    if node.tag in NO_TEXT and not frame:
        return True
    if node.tag in ("html", "body"):
        return False
    a, alone, parts = words_of(node)
    if a.get("role", "").lower() in NO_ROLE or "hidden" in a or a.get("aria-hidden", "").lower() == "true" or "display:none" in a.get("style", "").replace(" ", "").lower():
        return True
    words = alone | parts
    if words & COMMENT and not holds_article and not (node.tag in ("article", "main") and words & GOOD):
        return True
    if node.tag in ("article", "main") or holds_article or frame:
        return False
    if header:
        return True
    if most:
        words = alone
    return bool(words & NEVER) or bool(words & RATHER_NOT) and not (alone | parts) & GOOD


def text_size(node: Node) -> int:
    return sum(len(x.strip()) for x in node.children if isinstance(x, str))


def frames(nodes: list[Node]) -> set[int]:
    """Forms around an article, or around most of the page's paragraphs."""
    form: dict[int, int] = {}  # the nearest form around an element
    said: dict[int, int] = {}
    articles, total = set(), 0
    for node in nodes[1:]:  # parents before children
        around = id(node.parent) if node.parent.tag in FRAMES else form.get(id(node.parent))
        if around is not None:
            form[id(node)] = around
        if node.tag == "p":
            total += (size := text_size(node))
            if around is not None:
                said[around] = said.get(around, 0) + size
        elif node.tag in ("article", "main") and around is not None:
            articles.add(around)
    return articles | {i for i, n in said.items() if n > 200 and 2 * n > total}


def holders_of_most(nodes: list[Node]) -> set[int]:
    """Elements with over half of the text of the page's paragraphs, or of all its text where it has none."""
    said: dict[int, int] = {}
    paragraphs = any(n.tag == "p" for n in nodes)
    for node in reversed(nodes):  # children before parents
        own = text_size(node) if node.tag not in RAW and (not paragraphs or node.tag == "p") else 0
        size = said[id(node)] = said.get(id(node), 0) + own
        if node.parent is not None and size:
            said[id(node.parent)] = said.get(id(node.parent), 0) + size
    return {i for i, n in said.items() if n and 2 * n > said[id(nodes[0])]}


def weigh(nodes: list[Node]) -> None:
    """Drop what can't be main text, and give every other element its sizes and score."""
    holds = set()
    for node in nodes:
        if node.tag in ("article", "main") and not no_main_text(node, False, False):
            up = node.parent
            while up is not None and id(up) not in holds:
                holds.add(id(up))
                up = up.parent
    around, headers, most = frames(nodes), page_headers(nodes), holders_of_most(nodes)
    for node in nodes[1:]:
        i = id(node)
        node.dropped = node.parent.dropped or no_main_text(node, i in holds, i in around, i in headers, i in most)
    own: dict[int, list[str]] = {}
    for node in reversed(nodes):  # children before parents
        if node.dropped:
            continue
        node.size += sum(len(x.strip()) for x in node.children if isinstance(x, str))
        if node.tag == "a":
            node.linked = node.size
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.linked += node.linked
    for node in nodes:
        if node.dropped or not node.size or node.tag in BLOCK:
            continue
        if node.block is not None:  # the text of inline elements is that of the block around them
            own.setdefault(id(node.block), []).extend(x for x in node.children if isinstance(x, str))
    for node in nodes:
        if node.dropped or node.tag not in PARAGRAPHS:
            continue
        said = [x for x in node.children if isinstance(x, str)] + own.get(id(node), [])
        size = sum(len(x.strip()) for x in said)
        if not size:
            continue
        points = 1 + sum(x.count(",") + x.count("，") + x.count("、") for x in said) + min(size / 100, 3)
        points *= 1 - min(1.0, node.linked / max(1, node.size))
        up, share = (node if node.tag in ("div", "section", "article", "main", "body", "td") else node.parent), 1.0
        level = 0
        while up is not None and level < 5:
            up.score += points * share
            level += 1
            share = 0.5 if level == 1 else 1 / (level * 3)
            up = up.parent
    for node in nodes:
        if node.score:
            node.score *= 1 - node.linked / max(1, node.size)


def kept(nodes: list[Node]) -> list[Node]:
    """The best container, or the article around it, and the siblings that score well."""
    candidates = [n for n in nodes[1:] if not n.dropped and n.score > 0 and n.tag in BLOCK]
    if not candidates:
        return [n for n in nodes if n.tag == "body"][:1] or nodes[:1]
    best = max(candidates, key=lambda n: n.score)
    up = best
    while up is not None:
        if up.tag in ("article", "main"):
            best = up
            break
        up = up.parent
    if best.tag in ("body", "html", "#root") or best.parent is None:
        return [best]
    beside = [x for x in best.parent.children if isinstance(x, Node) and not x.dropped]
    enough, like = max(3.0, best.score * 0.2), words_of(best)[0].get("class")
    good = [i for i, x in enumerate(beside) if x is best or belongs(x, best, enough, like)]
    first, last = good[0], good[-1]
    fitting = [x for i, x in enumerate(beside) if i in good or first < i < last and x.tag != "article" and dense(x) < 0.25]
    return [*headings(fitting[0]), *fitting]


def dense(node: Node) -> float:
    return node.linked / max(1, node.size)


def belongs(node: Node, best: Node, enough: float, like: str | None) -> bool:
    """Whether a sibling of the best container is a part of it: by its score, as a paragraph, or as a section of the same kind."""
    if node.score * (1 - dense(node)) >= enough or node.tag in ("p", "pre", "blockquote") and dense(node) < 0.25:
        return True
    return node.tag == best.tag and node.tag in ("section", "div") and words_of(node)[0].get("class") == like and dense(node) < 0.25


def headings(node: Node) -> list[Node]:
    """The heading in front of a container, beside it or beside what holds it, unless it has one itself."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x.tag == "h1":
            return []
        todo += [c for c in x.children if isinstance(c, Node) and not c.dropped]
    up: Node | None = node
    while up is not None and up.parent is not None:
        before = []
        for x in up.parent.children:
            if x is up:
                break
            if isinstance(x, Node) and not x.dropped and x.tag in ("h1", "h2", "hgroup", "header") and x.size and dense(x) < 0.5:
                before.append(x)
        if before:
            top = [x for x in before if x.tag != "h2"]
            return top[-1:] or before[-1:]
        if up.tag == "body":
            break
        up = up.parent
    return []


def blocks(node: Node, out: list[str], line: list[str]) -> None:
    """Append the blocks of an element; line holds the pieces of the block that is open."""

    def flush() -> None:
        joined = " ".join("".join(line).split())
        if joined:
            out.append(joined)
        line.clear()

    todo: list[Node | str | None] = [node]
    while todo:
        x = todo.pop()
        if x is None:
            flush()
        elif isinstance(x, str):
            line.append(x)
        elif not x.dropped:
            if x.tag in BLOCK:
                flush()
                todo.append(None)
            elif x.tag == "br":
                line.append(" ")
            todo += reversed(x.children)


def main_text(source: str | None) -> str:
    """The main text of one page."""
    if not source:
        return ""
    _, nodes = tree(source)
    weigh(nodes)
    out: list[str] = []
    for node in kept(nodes):
        line: list[str] = []
        blocks(node, out, line)
        if joined := " ".join("".join(line).split()):
            out.append(joined)
    return "\n".join(out)


def _extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each row of pages."""
    tune(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_extracted, "page_id bigint, url string, text string, n_chars bigint")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

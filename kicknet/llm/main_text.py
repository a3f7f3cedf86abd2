"""Main text of web pages by tree scoring.

The page is read into a tree that tolerates missing end tags. Parts that are never
content (menus, forms, adverts, comments, ... by tag, role, whole class name or id) are
left out. A class or id alone does not take away an article or main element, what holds
the best of these, or what holds most of the page's points (three quarters, or half and
more than 10 points; outside that best element, three quarters and more than 10 points);
one with such a word in a longer name counts only if most of the text stands in links.
Threads of comments, often longer than the article, stay only if nothing else gives points. They are known by class,
id or item type (comments, user-comments, commentlist), a discussion by standing outside
of the article, and others by their form: siblings without headings, each with an author
and a date.
Each paragraph gives points, for being one, for its commas and its length, to its next 30
ancestors, fewer the farther up; an ancestor's points are discounted by the share of
its text that stands in links. The best container is kept with those siblings that look
like content; if it lies in an article or main element, the outermost of these is kept
whole and siblings are not looked at. Its blocks are the result: character
references decoded, white space within a block turned into one space, blocks joined by
a line feed, nothing dropped or cut.

Null and empty pages give an empty text; so do pages without text outside the parts left
out. Where nothing scores, the whole rest of the body counts. The time is linear in the
length of a page, also where tags do not end or are nested thousands of levels deep.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(script|style|noscript|template|textarea|iframe|svg|title|select)\b(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>.*?(?:</\1\s*+>|\Z)"
    r"|<(/?)([a-z][a-z0-9:-]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"(?<![a-z-])([a-z-]++)\s*+=\s*+(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORDS = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset "
    "figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol "
    "option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
#: Start tags that end an open element of the second kind.
ENDS = {
    **{t: ("p",) for t in BLOCKS - {"td", "th", "tr", "body", "html", "option", "legend", "caption"}},
    "li": ("p", "li"),
    "dt": ("p", "dt", "dd"),
    "dd": ("p", "dt", "dd"),
    "tr": ("tr", "td", "th"),
    "td": ("td", "th"),
    "th": ("td", "th"),
    "option": ("option",),
}
#: Elements that an implied end does not reach across.
FENCES = frozenset("ul ol table div article section main body td th blockquote".split())
NEVER = frozenset(
    "head nav footer aside form object canvas button input label menu dialog audio video "
    "fieldset search".split()
)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
#: Threads of comments.
THREADS = frozenset("comment comments disqus reply replies respond".split())
#: Other names of them, as one word.
_THREAD = re.compile(
    r"(?:user|reader|post|article|blog|fb)?comments?(?:list|area|box|thread|text|body|section|form|wrap|wrapper"
    r"|container|block|feed|stream|items?|content|author|meta|metadata)?"
)
#: Names of threads outside of an article; within, a section may be called so.
TALKS = frozenset("discussion discussions responses conversation conversations guestbook".split())
#: Words that say how something stands to its comments: has-comments, comments-open.
STATES = frozenset("has no with without and open opened closed enabled disabled allow allowed on off show hide".split())
#: Words of a class that name an author or a date.
AUTHORS = frozenset("author user username avatar commenter byline vcard nick nickname".split())
DATES = frozenset("date time timestamp datetime ago posted published".split())
#: Ancestors that a paragraph gives points to.
REACH = 30
#: Words of a class or id that mark parts which are not content.
MARKS = THREADS | frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead "
    "cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription share sharing social related recommended recommendations widget "
    "widgets pagination pager toolbar login signup signin search skip hidden".split()
)
#: Words that, put before or after a mark, leave it one: site-footer, comments-area.
PLAIN = frozenset(
    "site page main top bottom left right primary secondary area list box block bar container wrapper "
    "section links buttons posts articles form slot unit thread".split()
)
PARAGRAPHS = frozenset("p pre blockquote td dd figcaption".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that may stand in a head; any other, or text, ends an open one.
IN_HEAD = frozenset("base basefont bgsound link meta noframes noscript script style template title".split())


#: One bit for each tag that another start tag can end.
_BIT = {t: 1 << i for i, t in enumerate(sorted({t for tags in ENDS.values() for t in tags}))}
_CLOSES = {t: sum(_BIT[c] for c in tags) for t, tags in ENDS.items()}


class Node:
    __slots__ = (
        "tag", "parent", "items", "skip", "mark", "link", "points", "size", "linked", "held",
        "inside", "open", "own", "words", "chars", "commas", "signs",
    )

    def __init__(self, tag: str, parent: Node | None, skip: bool):
        self.tag, self.parent, self.skip = tag, parent, skip
        self.items: list[Node | str] = []
        self.link = tag == "a" or (parent is not None and parent.link)
        self.mark = ""  # "whole", "thread" or "part" by class or id
        self.inside = tag in ("article", "main") or (parent is not None and parent.inside)
        #: bits of what can be ended from here, up to the next fence
        self.open = _BIT.get(tag, 0) | (0 if parent is None or tag in FENCES else parent.open)
        #: size, words, characters and commas of the text directly in the node
        self.own: tuple[int, int, int, int] | None = None
        self.points = self.held = 0.0
        self.size = self.linked = self.words = self.chars = self.commas = self.signs = 0


def _left_out(tag: str, raw: str, inside: bool) -> bool:
    """Whether the tag, its role or its state say that it is not content."""
    if tag in NEVER or (tag == "header" and not inside):
        return True
    if not raw or tag in ("html", "body", "main"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), (a or b or c).lower()
        if name == "role" and value in ROLES:
            return True
        elif name == "aria-hidden" and value == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none", value):
            return True
    return bool(re.search(r"(?:^|\s)hidden(?:\s|/|$)", _ATTRIBUTE.sub("", raw)))


def _mark(tag: str, raw: str, inside: bool) -> str:
    """What its classes and id say of an element."""
    if not raw or tag in ("html", "body", "main", "article"):
        return ""
    found = ""
    for name, a, b, c in _ATTRIBUTE.findall(raw):
        if name.lower() in ("itemprop", "itemtype"):
            if (a or b or c).lower().rstrip("/").rsplit("/", 1)[-1] in ("comment", "usercomments"):
                return "thread"
        if name.lower() not in ("class", "id"):
            continue
        for value in (a or b or c).lower().split():
            words = _WORDS.findall(value)
            if not STATES.intersection(words) and any(
                w in ("disqus", "commenting") or _THREAD.fullmatch(w) or (w in TALKS and not inside) for w in words
            ):
                return "thread"
            marks = [w for w in words if w in MARKS and not (inside and w == "header")]
            if not marks:
                continue
            if all(w in marks or w in PLAIN for w in words):
                if THREADS.intersection(marks):
                    return "thread"
                found = "whole"
            else:
                found = found or "part"
    return found


def _after_head(node: Node, text: str | None = None) -> Node:
    """The node that holds what comes next: an open head is left, unless for white space."""
    return node.parent if node.tag == "head" and (text is None or text.strip()) else node


def _signs(tag: str, raw: str) -> int:
    """1 for an author, 2 for a date, 4 for a heading."""
    if tag == "time":
        return 2
    if tag in HEADINGS:
        return 4
    out = 0
    for name, a, b, c in _ATTRIBUTE.findall(raw) if raw else ():
        if name.lower() in ("class", "rel", "itemprop"):
            words = _WORDS.findall((a or b or c).lower())
            out |= bool(AUTHORS.intersection(words)) | 2 * bool(DATES.intersection(words))
    return out


def _tag_ends(page: str) -> tuple[list[int], list[int]]:
    """Places of `>` and quotes; for each, where a tag that is read up to it ends, or -1."""
    marks = [m.start() for m in re.finditer("[>\"']", page)]
    ends = [-1] * (len(marks) + 1)
    later = {}  # the next quote of each kind
    for i in range(len(marks) - 1, -1, -1):
        kind = page[marks[i]]
        if kind == ">":
            ends[i] = marks[i]
        else:
            ends[i] = ends[later[kind] + 1] if kind in later else -1
            later[kind] = i
    return marks, ends


def _tokens(page: str) -> Iterator[re.Match]:
    """Tags, comments and raw elements. What does not end is not read more than twice."""
    at, last, known = 0, page.rfind(">"), None
    while (at := page.find("<", at)) >= 0:
        special = page[at + 1 : at + 2] in ("!", "?")
        if special:
            ended = at < last or page.startswith(("<!--", "<![CDATA[", "<![cdata["), at)
        else:
            ended = at < last and (known is None or known[1][bisect_right(known[0], at)] >= 0)
        token = _TOKEN.match(page, at) if ended else None
        if token is not None:
            yield token
            at = token.end()
            continue
        if ended and known is None and not special and (page[at + 1 : at + 2] == "/" or page[at + 1 : at + 2].isalpha()):
            known = _tag_ends(page)
        at += 1


def read_tree(page: str) -> Node:
    root = node = Node("html", None, False)
    at, opened = 0, Counter()

    def left(to: Node) -> Node:
        """The node to go on with, once those below it are counted as ended."""
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.parent
        return node

    for token in _tokens(page):
        if token.start() > at:
            node = left(_after_head(node, page[at : token.start()]))
            node.items.append(page[at : token.start()])
        at = token.end()
        tag = token[3]
        if tag is None:
            continue
        tag = tag.lower()
        if token[2]:
            if opened[tag] > 0:
                up = node
                while up.tag != tag:
                    up = up.parent
                node = left(up.parent)
            continue
        if tag not in IN_HEAD:
            node = left(_after_head(node))
        closes, up = _CLOSES.get(tag, 0), node
        while up.open & closes:  # something up to the next fence ends here
            if _BIT.get(up.tag, 0) & closes:
                node = left(up.parent)
            up = up.parent
        if tag in ("html", "body") and node.parent is None and tag == "html":
            continue
        new = Node(tag, node, node.skip or _left_out(tag, token[4], node.inside))
        new.mark = _mark(tag, token[4], node.inside)
        new.signs = _signs(tag, token[4])
        node.items.append(new)
        if tag not in VOID and (tag in BLOCKS or not token[4].endswith("/")):
            node = new
            opened[tag] += 1
    if at < len(page):
        node = left(_after_head(node, page[at:]))
        node.items.append(page[at:])
    return root


def _measure(root: Node) -> list[Node]:
    """Sizes of text and of linked text below each node; the nodes, children first."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.skip:
            continue
        order.append(node)
        todo.extend(x for x in node.items if isinstance(x, Node))
    order.reverse()
    for node in order:
        if node.own is None:
            texts = [x for x in node.items if isinstance(x, str)]
            words = [w for x in texts for w in unescape(x).split()]
            node.own = (
                sum(len(x.strip()) for x in texts), len(words), sum(map(len, words)), sum(w.count(",") for w in words)
            )
        node.size, node.words, node.chars, node.commas = node.own
        node.linked = node.size * node.link
        for x in node.items:
            if isinstance(x, Node) and not x.skip:
                node.size += x.size
                node.linked += x.linked
                node.words += x.words
                node.chars += x.chars
                node.commas += x.commas
    return order


def _own_points(node: Node) -> float:
    """What a paragraph gives; 0 for other elements."""
    if not node.size or 2 * node.linked > node.size:
        return 0.0
    if node.tag not in PARAGRAPHS and not (node.tag in ("div", "section", "article") and node.own[0]):
        return 0.0
    # the length of the words with a space between them
    return 1 + node.commas + min((node.chars + max(node.words - 1, 0)) / 100, 3)


def _mark_threads(order: list[Node]) -> None:
    """Marks what holds two and more siblings with an author and a date, but no heading."""
    for node in order:
        alike: Counter = Counter()
        said = 0
        for x in node.items:
            if isinstance(x, Node) and not x.skip:
                if x.signs == 3 and x.size:
                    alike[x.tag] += 1
                    said += x.size
                node.signs |= x.signs
        if (
            not node.mark
            and node.tag in ("div", "section", "ol", "ul", "dl")
            and max(alike.values(), default=0) > 1
            and 5 * said >= 4 * node.size
        ):
            node.mark = "thread"


def _decide(order: list[Node]) -> bool:
    """Leaves out marked parts that are not the content; whether there are any."""
    _mark_threads(order)
    if not any(node.mark for node in order):
        return False
    threads: set[Node] = set()
    for node in reversed(order):  # parents first
        if node.mark == "thread" or node.parent in threads:
            threads.add(node)
    counted = [node for node in order if node not in threads]
    if not any(_own_points(node) for node in counted):
        counted = order
    total = 0.0
    for node in counted:
        node.held += (own := _own_points(node))
        total += own
        if node.parent is not None:
            node.parent.held += node.held
    up = best = max((n for n in counted if n.tag in ("article", "main") and n.held), key=lambda n: n.held, default=None)
    kept: set[Node] = set()
    while up is not None:
        kept.add(up)
        up = up.parent
    within = {best} - {None}
    out = False
    for node in reversed(order):
        if node.parent in within:
            within.add(node)
        nearly_all, long = 4 * node.held > 3 * total, node.held > 10
        if best is None or node in within:
            most = 2 * node.held > total and (long or nearly_all)
        else:
            most = nearly_all and long
        if node.parent is not None and node.parent.skip:
            node.skip = True
        elif node.mark and node not in kept and not most:
            node.skip = node.mark != "part" or 2 * node.linked > node.size
        out |= node.skip
    return out


def _score(order: list[Node]) -> Node | None:
    for node in order:
        points = _own_points(node)
        if not points:
            continue
        up = node.parent if node.tag in PARAGRAPHS else node
        far = 0
        while up is not None and far < REACH:
            up.points += points / (1, 2)[far] if far < 2 else points / (3 * far)
            up, far = up.parent, far + 1
    best, most = None, 0.0
    for node in order:
        if node.points:
            points = node.points * (1 - node.linked / max(node.size, 1))
            node.points = points
            if points > most:
                best, most = node, points
    return best


def _kept(root: Node) -> list[Node]:
    order = _measure(root)
    if _decide(order):
        order = _measure(root)
    best = _score(order)
    if best is None:
        return [root]
    top, up = best, best
    while up is not None:
        if up.tag in ("article", "main"):
            top = up
        up = up.parent
    if top.tag in ("article", "main") or top.parent is None:
        return [top]
    kept = []
    least = max(2.0, 0.2 * best.points)
    for x in top.parent.items:
        if x is top:
            kept.append(x)
        elif isinstance(x, Node) and not x.skip and x.size:
            density = x.linked / x.size
            if x.points >= least and density < 0.5:
                kept.append(x)
            elif x.tag in ("h1", "h2", "p", "pre", "blockquote") and density < 0.25:
                kept.append(x)
    return kept


def blocks(nodes: list[Node]) -> list[str]:
    """Texts of the blocks below the nodes, in page order."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join(unescape("".join(run)).split()) if len(run) == 1 else " ".join("".join(map(unescape, run)).split())
        if text:
            out.append(text)
        run.clear()

    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        x = todo.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            run.append(x)
        elif not x.skip:
            if x.tag in BLOCKS:
                end()
                todo.append(None)
            elif x.tag == "br":
                run.append(" ")
            todo.extend(reversed(x.items))
    end()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks(_kept(read_tree(page)))) if page else ""


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 512):
            batch = whole.slice(at, 512)
            html = batch.column(batch.num_columns - 1).to_pylist()
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([main_text(h) for h in html], pa.string())],
                [*batch.schema.names[:-1], "text"],
            )


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The rows with `text` in place of the page; a column named text is replaced."""
    rest = [c for c in pages.columns if c not in (html_col, "text")]
    rows = pages.select(*rest, F.col(html_col).cast("string").alias("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(_extract, schema)

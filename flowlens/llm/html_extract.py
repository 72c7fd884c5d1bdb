"""Main text of web pages by wrapper induction over same-host pages.

One page of each host is its pivot.  Every page's DOM tree is aligned with the
pivot of its host by simple tree matching, so that equal places of different
pages share a number.  Places whose text hardly varies over the host's pages
belong to the template, places of links belong to menus, and the others are
slots.  From the root, the wrapper follows the element that holds most of the
slots' text as long as one does: that element is the main slot, and what
stands beside it (menus, notices, adverts, footers) goes, whatever it is
called.  Hosts of few pages share the wrapper of their parent domain, or of
the pages elsewhere that are built of the same elements.  Within the main
slot, places of the template, places of links, runs of comments, and what the
markup itself names go as well.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import sys
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, batch, columns, stage

#: Pages of a host that must show a place before it can be called template.
MIN_PAGES = 8
#: Distinct texts per page up to which a place is called template.
VARIETY = 0.1
#: Share of the slots' text that an element must hold to be followed.
DOMINANT = 0.7
#: Share of the main slot's text that a part beside its heading must have.
BESIDE = 0.15
#: Share of a place's text in links from which it is a menu or a list of links.
LINKED = 0.8
#: Characters of a comment's author or date line at most.
BYLINE = 80

#: Deeper elements are put beside each other; their text keeps its place.
DEEPEST = 2000
sys.setrecursionlimit(max(sys.getrecursionlimit(), 6 * DEEPEST))

# HTML elements by their role.
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp", "noframes", "noembed"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir",
          "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
          "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option",
          "p", "pre", "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul"}
_CLOSES_P = _BLOCK - {"br", "option", "optgroup", "td", "th", "tr", "tbody", "thead", "tfoot", "caption", "title", "head",
                      "html", "body", "select", "legend"}
_DROP = {"head", "script", "style", "noscript", "template", "iframe", "svg", "canvas", "nav", "footer", "aside", "form",
         "select", "textarea", "input", "button", "label", "menu", "dialog", "title"}
#: Dropped only beside the part that the page marks as its article or main part.
_WIDGETS = {"object", "audio", "video"}
#: Never dropped for a name within that part.
_HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
_PROSE = {*_HEADINGS, "math"}
# A class token or id tells what an element is if it is made of
# these words only and holds one of the first list.
_TELLING = {"ad", "ads", "advert", "adverts", "advertisement", "advertisements", "advertising", "sponsor", "sponsored",
            "promo", "promos", "promotion", "nav", "navbar", "navigation", "menu", "menubar", "breadcrumb", "breadcrumbs",
            "pagination", "pager", "sidebar", "aside", "footer", "comment", "comments", "commentlist", "reply", "replies",
            "respond", "disqus", "cookie", "cookies", "consent", "notice", "notices", "alert", "newsletter", "subscribe",
            "popup", "modal", "overlay", "related", "share", "sharing", "masthead"}
_NEUTRAL = {"site", "page", "main", "global", "primary", "secondary", "top", "bottom", "left", "right", "post", "posts", "user",
            "users", "reader", "readers", "google", "wp", "js", "box", "slot", "unit", "banner", "wrap", "wrapper", "container",
            "area", "section", "block", "bar", "list", "link", "links", "inner", "panel", "widget", "thread", "form", "signup",
            "bottom", "articles", "stories", "buttons", "social", "tools", "message", "content", "text", "body", "item", "author"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "menu", "menubar", "dialog", "alert", "alertdialog", "form"}

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_ATTRIBUTE = re.compile(r"(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)


@lru_cache(maxsize=4096)
def _tells(names: str) -> bool:
    for token in names.split():
        words = [w for w in re.split(r"[-_0-9]+|(?<=[a-z])(?=[A-Z])", token) if w]
        if any(w.lower() in _TELLING for w in words) and all(w.lower() in _TELLING or w.lower() in _NEUTRAL for w in words):
            return True
    return False


class Node:
    __slots__ = ("tag", "name", "drop", "by_class", "by_id", "children", "slot")

    def __init__(self, tag: str, attributes: str = ""):
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if "=" in attributes \
            or "hidden" in attributes else {}
        named = f"{found.get('class', '')} {found.get('id', '')}".strip()
        self.tag, self.name = tag, f"{tag} {re.sub(r'[0-9]+', '0', named)}"
        self.drop = (tag in _DROP or found.get("role", "").lower() in _ROLES or "hidden" in found
                     or found.get("aria-hidden", "").lower() == "true"
                     or "display:none" in found.get("style", "").replace(" ", "").lower())
        outer = tag in ("html", "body", "article", "main")
        self.by_class, self.by_id = (not outer and k in found and _tells(found[k]) for k in ("class", "id"))
        self.children: list = []
        self.slot = -1


def parse(page: str) -> Node:
    """The DOM tree: elements are nodes, text is decoded strings.  Unclosed
    elements end with what holds them; markup is never an error."""
    root = Node("#")
    stack = [root]
    at = 0

    def text(s: str) -> None:
        if s:
            stack[-1].children.append(entities.unescape(s))

    while at < len(page):
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at:m.start()])
        at = m.end()
        if m[1] is not None:
            stack[-1].children.append(m[1])
            continue
        tag = (m[3] or m[6] or "").lower()
        if not tag:
            continue
        if m[2] or m[5]:                                         # an end tag
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
            continue
        _close_implied(stack, tag)
        node = Node(tag, m[4] or m[7] or "")
        stack[-1].children.append(node)
        if tag in _RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
            node.children.append(page[at:end.start() if end else len(page)])
            at = end.end() if end else len(page)
        elif tag not in _VOID and len(stack) < DEEPEST:
            stack.append(node)
    return root


_SAME = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
         "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
         "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}


def _close_implied(stack: list[Node], tag: str) -> None:
    if tag in _CLOSES_P:
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag == "p":
                del stack[k:]
                break
            if stack[k].tag in ("div", "article", "section", "td", "th", "li", "body", "blockquote", "button", "table"):
                break
    if tag in _SAME:
        ends, within = _SAME[tag]
        for k in range(len(stack) - 1, 0, -1):
            if stack[k].tag in within:
                break
            if stack[k].tag in ends:
                del stack[k:]
                break


_REPEATED = {"p", "li", "dt", "dd", "tr", "td", "th", "option", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6"}


def _elements(node: Node) -> list[list[Node]]:
    """The child elements that hold blocks.  Neighbours of one name, if they
    are of a kind that comes in lists, are one run: its length does not matter
    for the alignment.  Bare containers each stand for themselves."""
    out: list[list[Node]] = []
    for c in node.children:
        if isinstance(c, Node) and c.tag in _BLOCK and c.tag not in ("br", "hr") and c.tag not in _RAW:
            if out and out[-1][0].name == c.name and (c.tag in _REPEATED or c.name != f"{c.tag} "):
                out[-1].append(c)
            else:
                out.append([c])
    return out


def number(pivot: Node) -> int:
    """Numbers the places of a pivot in document order; runs share one."""
    count = 0
    todo = [[pivot]]
    while todo:
        run = todo.pop()
        for n in run:
            n.slot = count
        count += 1
        todo.extend(reversed(_elements(run[0])))
    return count


def _match(a: Node, b: Node, memo: dict) -> int:
    """Size of the largest simple tree matching of two trees whose roots have
    one name: order and parents are kept."""
    key = (id(a), id(b))
    if key not in memo:
        x, y = _elements(a), _elements(b)
        best = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                both = _match(p[0], q[0], memo) if p[0].name == q[0].name else 0
                best[i + 1][j + 1] = max(best[i][j + 1], best[i + 1][j], best[i][j] + both)
        memo[key] = (1 + best[-1][-1], best)
    return memo[key][0]


def align(page: Node, pivot: Node) -> None:
    """Gives the page's nodes the numbers of the pivot's that simple tree
    matching pairs them with; the others keep -1."""
    memo: dict = {}
    _match(page, pivot, memo)
    todo = [([page], [pivot])]
    while todo:
        run, to = todo.pop()
        for n in run:
            n.slot = to[0].slot
        # Each node of a run is aligned by itself; the first was matched above.
        for n in run:
            _match(n, to[0], memo)
            x, y = _elements(n), _elements(to[0])
            best = memo[id(n), id(to[0])][1]
            i, j = len(x), len(y)
            while i and j:
                if best[i][j] == best[i - 1][j]:
                    i -= 1
                elif best[i][j] == best[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    todo.append((x[i], y[j]))


def _own_text(node: Node, linked: list[int] | None = None, inside: bool = False) -> str:
    """The text of a node outside the block elements within it; ``linked``
    gathers the characters that stand in links."""
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
            if inside and linked is not None:
                linked.append(len(" ".join(c.split())))
        elif c.tag not in _BLOCK and c.tag not in _RAW:
            out.append(_own_text(c, linked, inside or c.tag == "a"))
        else:
            out.append(" ")
    return "".join(out)


def slots(root: Node) -> list[tuple[int, str, int, int]]:
    """``(place, hash of its text, characters, those in links)`` of each
    numbered place with text outside what the markup excludes; a run is one
    place."""
    found: dict[int, tuple[list[str], list[int]]] = {}
    todo = [root]
    while todo:
        n = todo.pop()
        if n.drop:
            continue
        linked: list[int] = []
        own = " ".join(_own_text(n, linked).split())
        if own and n.slot >= 0:
            texts, links = found.setdefault(n.slot, ([], []))
            texts.append(own)
            links.append(sum(linked))
        todo.extend(c for c in reversed(n.children) if isinstance(c, Node) and c.tag in _BLOCK)
    return [(k, hashlib.blake2b("\n".join(t).encode(), digest_size=8).hexdigest(), sum(map(len, t)), sum(n))
            for k, (t, n) in found.items()]


@dataclass(frozen=True)
class Wrapper:
    """What a group of pages has in common: the place of the main slot, and
    the places that go."""
    main: int = 0
    gone: frozenset = frozenset()


#: Elements that may be followed to the main slot, and that may go as a part.
_CONTAINERS = {"#", "html", "body", "div", "section", "main", "article", "center", "table", "tbody", "tr", "td", "blockquote",
               "header", "footer", "nav", "aside", "ul", "ol", "dl", "details", "figure", "address", "fieldset", "form"}
_FOLLOWED = _CONTAINERS - {"ul", "ol", "dl", "blockquote", "figure", "address", "footer", "nav", "aside"}


def induce(pivot: Node, stats: dict[int, tuple[int, int, int, int]], total: int, min_pages: int = MIN_PAGES,
           variety: float = VARIETY) -> Wrapper:
    """The wrapper of a numbered pivot, given ``(pages, distinct texts,
    characters, characters in links)`` by place over ``total`` pages."""
    most = max((t / p for p, t, _, _ in stats.values()), default=0)
    fixed = {k for k, (p, t, _, _) in stats.items() if p >= min_pages and t <= max(1, p * variety) and t / p <= most / 4}
    mass, link, inner = {}, {}, {}

    def weigh(run: list[Node]) -> None:
        n = run[0]
        parts = _elements(n)
        inner[n.slot] = parts
        _, _, chars, linked = stats.get(n.slot, (0, 0, 0, 0))
        own = 0 if n.slot in fixed or linked > LINKED * chars else chars - linked
        link[n.slot] = [linked, chars]
        for part in parts:
            weigh(part)
            own += mass[part[0].slot]
            link[n.slot] = [a + b for a, b in zip(link[n.slot], link[part[0].slot])]
        mass[n.slot] = own

    weigh([pivot])
    path = [pivot]
    while True:
        best = max(inner[path[-1].slot], key=lambda r: mass[r[0].slot], default=None)
        if best is None or len(best) > 1 or best[0].tag not in _FOLLOWED or not mass[path[-1].slot] \
                or mass[best[0].slot] < DOMINANT * mass[path[-1].slot]:
            break
        path.append(best[0])
    # The heading of the main slot may stand beside it.
    gone = set(fixed)
    if len(path) > 1 and not any(r[0].tag in _HEADINGS for r in inner[path[-1].slot]):
        if any(r[0].tag in ("h1", "h2") and mass[r[0].slot] for r in inner[path[-2].slot]):
            held = path.pop()
            gone |= {r[0].slot for r in inner[path[-1].slot] if r[0] is not held and r[0].tag in _CONTAINERS
                     and mass[r[0].slot] < BESIDE * mass[held.slot]}
    todo = [r for r in inner[path[-1].slot]] if total >= min_pages else []
    while todo:
        run = todo.pop()
        linked, chars = link[run[0].slot]
        if run[0].tag in _CONTAINERS and chars and linked > LINKED * chars:
            gone.add(run[0].slot)
        else:
            todo.extend(inner[run[0].slot])
    # A heading of the main slot may be the same on all pages.
    headings = {r[0].slot for parts in inner.values() for r in parts if r[0].tag in _HEADINGS}
    return Wrapper(path[-1].slot, frozenset(gone - headings - {n.slot for n in path}))


def _length(node: Node) -> int:
    return sum(len(c) if isinstance(c, str) else _length(c) for c in node.children)


def _mark_comments(main: Node) -> None:
    """Drops a part of the main slot that is a run of comments: two or more
    elements built alike, without headings, each of a short line (who, when)
    and a text; a third of the main slot's text at least stands elsewhere."""
    whole, todo = _length(main), [c for c in main.children if isinstance(c, Node)]
    while todo:
        n = todo.pop()
        if n.drop or n.tag not in _CONTAINERS or n.tag in ("table", "tbody", "tr", "td"):
            continue
        kids = [c for c in n.children if isinstance(c, Node) and not c.drop]
        shapes = {tuple(g.tag for g in k.children if isinstance(g, Node)) for k in kids}
        if (len(kids) > 1 and len(shapes) == 1 and len(next(iter(shapes))) > 1 and not _HEADINGS & set(next(iter(shapes)))
                and all(k.tag in _CONTAINERS or k.tag == "li" for k in kids) and 3 * _length(n) < 2 * whole):
            firsts = [[_length(g) for g in k.children if isinstance(g, Node)] for k in kids]
            if all(f[0] <= BYLINE and f[-1] > f[0] for f in firsts):
                n.drop = True
                continue
        todo.extend(c for c in n.children if isinstance(c, Node))


def _write(node: Node, gone: frozenset, out: list[str]) -> None:
    if node.drop or (node.slot in gone and node.slot >= 0):
        return
    block = node.tag in _BLOCK
    if block:
        out.append(" ")
    for c in node.children:
        if isinstance(c, str):
            out.append(c)
        else:
            _write(c, gone, out)
    if block:
        out.append(" ")


def _mark_drops(root: Node) -> None:
    """What is dropped for its name or place.  Within an article or main part,
    class names count except for headings, paragraphs and formulas, and ids do
    not, being slugs of headings there.  Beside such a part, controls and
    embedded objects go as well.  A ``header`` is the page's unless an article
    or main part holds it."""
    nodes, marked, at = [(root, False)], False, 0
    while at < len(nodes):
        n, held = nodes[at]
        at += 1
        part = n.tag in ("article", "main")
        marked = marked or part
        nodes.extend((c, held or part) for c in n.children if isinstance(c, Node))
    for n, held in nodes:
        free = held or not marked
        n.drop = (n.drop or ((n.by_class or n.by_id and not held) and not (free and n.tag in _PROSE))
                  or (n.tag in _WIDGETS and not free) or (n.tag == "header" and not held))


def _mains(root: Node, place: int) -> list[Node]:
    """The nodes at a place, in page order."""
    found, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.slot == place:
            found.append(n)
        else:
            todo.extend(c for c in reversed(n.children) if isinstance(c, Node))
    return found


def extract(page: str, pivot: str | None = None, wrapper: Wrapper | None = None) -> str:
    """The main text: blocks in page order, white space made single.  Without
    a pivot the markup alone decides.  A page that lacks the main slot is its
    own pivot."""
    root = parse(page)
    _mark_drops(root)
    out: list[str] = []
    if pivot is None or wrapper is None:
        _write(root, frozenset(), out)
        return " ".join("".join(out).split())
    align(root, _pivot(pivot))
    mains = _mains(root, wrapper.main)
    if not any(_text_of(n, wrapper.gone) for n in mains):
        number(root)
        wrapper = induce(root, {k: (1, 1, c, a) for k, _, c, a in slots(root)}, 1)
        mains = _mains(root, wrapper.main)
    for n in mains:
        _mark_comments(n)
        _write(n, wrapper.gone, out)
        out.append(" ")
    return " ".join("".join(out).split())


def _text_of(node: Node, gone: frozenset) -> bool:
    out: list[str] = []
    _write(node, gone, out)
    return bool("".join(out).strip())


@lru_cache(maxsize=256)
def _pivot(page: str) -> Node:
    root = parse(page)
    number(root)
    return root


_SLOT = pa.schema([("group", pa.string()), ("place", pa.int32()), ("h", pa.string()), ("n", pa.int64()), ("linked", pa.int64())])
_TEXT = pa.schema([("id", pa.int64()), ("url", pa.string()), ("text", pa.string())])
_MADE = pa.schema([("group", pa.string()), ("pivot", pa.string()), ("main", pa.int32()), ("gone", pa.list_(pa.int32()))])


def _list_slots(batches):
    for groups, pages, pivots in columns(batches, 64):
        rows = []
        for group, page, pivot in zip(groups, pages, pivots):
            root = parse(page or "")
            _mark_drops(root)
            align(root, _pivot(pivot or ""))
            rows.extend((group, *slot) for slot in slots(root))
        if rows:
            yield batch(_SLOT, *zip(*rows))


def _induce_all(min_pages, variety):
    def run(batches):
        for groups, pivots, totals, stats in columns(batches, 64):
            made = [induce(_pivot(p or ""), {r["place"]: (r["pages"], r["texts"], r["chars"], r["links"]) for r in s or ()}, n,
                           min_pages, variety) for p, n, s in zip(pivots, totals, stats)]
            yield batch(_MADE, groups, pivots, [w.main for w in made], [sorted(w.gone) for w in made])
    return run


def _extract_all(batches):
    for ids, urls, pages, pivots, mains, gones in columns(batches, 64):
        yield batch(_TEXT, ids, urls, [extract(p or "", v, None if m is None else Wrapper(m, frozenset(g or ())))
                                       for p, v, m, g in zip(pages, pivots, mains, gones)])


def _grouped(rows: DataFrame, min_pages: int) -> DataFrame:
    """``group`` of each page: its host if that has ``min_pages`` pages, else
    its parent domain if that has, else all pages left that are built of the
    same elements."""
    parent = F.regexp_extract("host", r"([^.:]+\.[^.:]+)(?::[0-9]*)?$", 1)
    rows = rows.withColumn("parent", F.when(parent == "", F.col("host")).otherwise(parent))
    hosts = rows.where("html <> ''").groupBy("host", "parent").agg(F.count("*").alias("n_host"))
    parents = hosts.groupBy("parent").agg(F.sum("n_host").alias("n_parent"))
    sized = stage(hosts.join(parents, "parent").select("host", "n_host", "n_parent"), "hosts")
    built = F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all("html", F.lit(r"<([a-zA-Z][a-zA-Z0-9]*)"), 1), F.lower)))
    group = (F.when(F.col("n_host") >= min_pages, F.concat(F.lit("host "), "host"))
             .when(F.col("n_parent") >= min_pages, F.concat(F.lit("parent "), "parent"))
             .otherwise(F.concat(F.lit("built "), F.hex(F.xxhash64(built)))))
    total = sized.agg(F.sum(F.length("host") + 64)).first()[0] or 0
    return rows.join(F.broadcast(sized) if total <= BROADCAST_BYTES // 2 else sized, "host", "left").withColumn("group", group)


def _with_wrappers(df: DataFrame, small: DataFrame, size: str) -> DataFrame:
    """Joins a row for each group on, by broadcast only if its measured bytes
    are few."""
    total = small.agg(F.sum(F.length(size) + 64)).first()[0] or 0
    return df.join(F.broadcast(small) if total <= BROADCAST_BYTES // 2 else small, "group", "left")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              min_pages: int = MIN_PAGES, variety: float = VARIETY) -> DataFrame:
    """``(id, url, text)`` per row.

    A place is template if at least ``min_pages`` of its group's pages have
    text there and these texts are few: at most one distinct text in
    ``1 / variety`` pages, and fewer by far than the most varied place has, so
    that a host that only repeats whole pages keeps its articles.  The group
    is the host, or for hosts of fewer than ``min_pages`` pages the parent
    domain or the pages built of the same elements.  Null and empty pages have
    an empty text.  URLs without a host share one host, the empty one.  Null
    ids are kept; repeated rows count as pages of their own; extra columns are
    ignored; an empty table gives an empty one.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"),
                        F.col(html_col).cast("string").alias("html"))
    rows = rows.withColumn("host", F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"://([^/?#]*)", 1)))
    rows = _grouped(rows, min_pages)
    pivots = stage(rows.where("html <> ''").groupBy("group").agg(
        F.min_by("html", F.struct(F.xxhash64("id", "url"), F.length("html"))).alias("pivot"), F.count("*").alias("total")), "pivots")
    found = _with_wrappers(rows.select("group", "html"), pivots, "pivot").where("pivot is not null").select(
        "group", "html", "pivot").mapInArrow(_list_slots, "group string, place int, h string, n long, linked long")
    stats = found.groupBy("group", "place").agg(
        F.count("*").alias("pages"), F.approx_count_distinct("h", 0.02).alias("texts"), F.sum("n").alias("chars"),
        F.sum("linked").alias("links"))
    listed = stats.groupBy("group").agg(F.collect_list(F.struct("place", "pages", "texts", "chars", "links")).alias("stats"))
    wrappers = stage(pivots.join(listed, "group", "left").select("group", "pivot", "total", "stats").mapInArrow(
        _induce_all(min_pages, variety), "group string, pivot string, main int, gone array<int>"), "wrappers")
    return _with_wrappers(rows, wrappers, "pivot").select("id", "url", "html", "pivot", "main", "gone").mapInArrow(
        _extract_all, "id long, url string, text string")

"""Main text of web pages by wrappers: union-free regular expressions inferred from the token streams of each host.

A page's tokens (tags with their class and id, text) nest into a tree; inline tags are no tokens of their own. Runs of like siblings fold into repeated groups as the tree is
built, and texts become slots. Pages of one host are aligned level by level: like tokens pair up, others become optional, slots are joined. The result is one wrapper per host, whose
slots know on how many pages they stand, how much of their text is links, and whether it is the same on every page.

The wrapper then decides about its slots. Out are slots below elements that are no article by their kind or label (menus, headers, footers, sidebars, notices, adverts, forms, scripts,
styles, comments), and slots whose text is the same on at least half of a host's pages, three at least, unless the host's main slot is such, as on hosts of copies (a text that is the same but stands in a repeated group among others is not told apart from them). If article or
main elements hold a good part of what is left, they are the text; else the deepest container that holds most of it is, with main headings, without lists of links.
Each page is extracted by the decisions of the slots that its own tree aligns with; where that gives nothing, by those of its labels alone.

Equal trees are counted together before they are shuffled, and wrappers are merged first by (host, part of the trees), then by host, so a host with a third of all pages costs no task
more than its distinct trees. Pages are joined with their wrapper by host; Spark broadcasts the wrappers under its size limit and splits hot hosts otherwise.

Edge cases: null and empty html give an empty text; a null url or one without a host counts as the host ''; unclosed, misplaced and unknown tags, stray '<' and unclosed comments are read as browsers do or as text;
elements more than ``DEPTH`` deep still end blocks but open no level; very long pages are taken whole; repeated rows are repeated; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import html as html_module
import json
import math
import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, shuffle_partitions, table

DEPTH = 60
#: Size of the alignment table beyond which it is held in part and found again; the alignment is the same.
CELLS = 250_000

# Kinds of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label map mark meter nobr output picture progress q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
NEVER = frozenset("head nav footer aside form script style noscript template svg math button select datalist dialog menu object audio video canvas iframe textarea".split())
ALWAYS_FOLDED = frozenset("p li tr td th dt dd h1 h2 h3 h4 h5 h6 option article blockquote pre figure".split())
#: What is text or a list of it, and no container of an article.
CONTENT = frozenset("p h1 h2 h3 h4 h5 h6 pre figure blockquote dl dt dd ul ol".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends the nearest open one of the first list that is not outside one of the second.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}), "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tbody": ({"thead", "tbody", "tfoot", "caption"}, {"table"}), "thead": ({"caption"}, {"table"}), "tfoot": ({"thead", "tbody"}, {"table"}),
}
#: Words of a class, id or role that name what is no article.
LABELS = frozenset(
    """ad ads adv advert adverts advertisement advertisements advertising sponsor sponsored sponsors promo promos promotion banner banners nav navbar navigation menu menus breadcrumb breadcrumbs crumbs sidebar sidebars
    aside complementary footer foot masthead comment comments commentlist disqus respond reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup share
    sharing sharebar social related recommended recommendations widget widgets login search searchbox pagination pager paging skip skiplink toolbar copyright legal disclaimer contentinfo hidden""".split()
)
HEADS = frozenset("header head topbar".split())
#: Labels that hold however much text they are on; others of the list count for nothing on an element with most of a host's text, such as "content with-sidebar".
ANYWAY = frozenset("comment comments commentlist disqus respond reply replies hidden".split())

TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<[!?][^>]*(?:>|\Z)"""
    r"""|<(?P<raw>script|style|textarea|title|iframe|noembed|noframes|xmp)(?=[\s/>])[^>]*>.*?(?:</(?P=raw)[^>]*>|\Z)"""
    r"""|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*"|'[^']*')*+)>"""
    r"""|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)""",
    re.S | re.I,
)
ATTR = re.compile(r"""(?<![\w-])(class|id|role|itemprop|hidden|aria-hidden|style)(?![\w-])(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")

# A node is [key, mark, kids or None, slot]; key is '#' for text, tag, labels and flags otherwise, and '(...)' for a repeated group of several; mark is '', '?', '+' or '*'.
KEY, MARK, KIDS, SLOT = range(4)


def _labelled(attrs: str) -> tuple[str, str]:
    """(labels for the key, flag): flag is '!' for what is no article, '^' for a head, '@' for the main part."""
    labels, flag = [], ""
    for name, a, b, c in ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name == "hidden" or name == "aria-hidden" and value.lower() == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
            flag = "!"
        elif name in ("class", "id", "role"):
            labels.append(re.sub(r"\d+", "0", value.strip()))
            words = {w.lower() for w in WORD.findall(value)}
            if words & LABELS:
                flag = "!"
            elif words & HEADS:
                flag = flag or "^"
            elif name == "role" and "main" in words:
                flag = flag or "@"
        elif name == "itemprop" and value.lower() == "articlebody":
            flag = flag or "@"
    return " ".join(labels), flag


def _marks(a: str, b: str) -> str:
    many, optional = "+" in a + b or "*" in a + b, "?" in a + b or "*" in a + b
    return "*" if many and optional else "+" if many else "?" if optional else ""


def _optional(node: list) -> list:
    return [node[KEY], _marks(node[MARK], "?"), *node[2:]]


def _steps(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of equal keys, increasing on both sides: a longest common subsequence; equal keys are taken at once, else the place in ``a`` is passed over where both ways are as long."""
    if len(a) * len(b) > CELLS:
        return _long_steps(a, b)
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below, x = best[i], best[i + 1], a[i]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if x == b[j] else max(below[j], row[j + 1])
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _long_steps(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """The same pairs with one row of the table in a stretch of rows held, from which the rest is found again as the way is walked; memory grows with len(b) times the root of len(a)."""
    number: dict[str, int] = {}
    x, y = (np.array([number.setdefault(k, len(number)) for k in keys], dtype=np.int64) for keys in (a, b))

    def above(below: np.ndarray, key: int) -> np.ndarray:
        row = below.copy()
        np.maximum(row[:-1], below[1:] + (y == key), out=row[:-1])
        return np.maximum.accumulate(row[::-1])[::-1]

    stretch = max(1, math.isqrt(len(a)))
    held = {len(a): np.zeros(len(b) + 1, dtype=np.int32)}
    row = held[len(a)]
    for i in range(len(a) - 1, -1, -1):
        row = above(row, x[i])
        if i % stretch == 0:
            held[i] = row
    out, i, j, rows = [], 0, 0, {}
    while i < len(a) and j < len(b):
        if i not in rows or i + 1 not in rows:
            end = min(i - i % stretch + stretch, len(a))
            rows = {end: held[end]}
            for k in range(end - 1, i - 1, -1):
                rows[k] = above(rows[k + 1], x[k])
        if x[i] == y[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def _with_groups(kids: list, other: list) -> list:
    """``kids`` where a run like a group of ``other`` is that group, once."""
    for group in other:
        if group[KEY][0] == "(" and all(k[KEY] != group[KEY] for k in kids):
            keys, n = [k[KEY] for k in group[KIDS]], len(group[KIDS])
            for i in range(len(kids) - n + 1):
                if [k[KEY] for k in kids[i : i + n]] == keys:
                    kids = [*kids[:i], [group[KEY], "", kids[i : i + n], None], *kids[i + n :]]
                    break
    return kids


def aligned(a: list, b: list, join) -> list:
    """The kids of two like elements as one list; ``join`` makes one slot of two."""
    ka, kb = [k[KEY] for k in a], [k[KEY] for k in b]
    if ka == kb:
        return [merged(x, y, join) for x, y in zip(a, b)]
    a, b = _with_groups(a, b), _with_groups(b, a)
    out, i, j = [], 0, 0
    for x, y in [*_steps([k[KEY] for k in a], [k[KEY] for k in b]), (len(a), len(b))]:
        out += [_optional(k) for k in a[i:x]] + [_optional(k) for k in b[j:y]]
        if x < len(a):
            out.append(merged(a[x], b[y], join))
        i, j = x + 1, y + 1
    return out


def merged(x: list, y: list, join) -> list:
    mark = _marks(x[MARK], y[MARK])
    if x[KIDS] is None:
        return [x[KEY], mark, None, join(x[SLOT], y[SLOT])]
    return [x[KEY], mark, aligned(x[KIDS], y[KIDS], join), None]


def _tag(key: str) -> str:
    return key.split(" ", 1)[0]


def _like(x: list, y: list) -> bool:
    """Whether two neighbours of one key are turns of a repeated element: always for rows, items and labelled elements; containers without a label by what they hold."""
    if " " in x[KEY] or x[KEY][0] in "#(" or x[KEY] in ALWAYS_FOLDED:
        return True
    a, b = {k[KEY] for k in x[KIDS]}, {k[KEY] for k in y[KIDS]}
    return a | b != {"#"} and 2 * len(a & b) >= len(a | b) > 0


def _fold(kids: list, join) -> None:
    """Folds the end of ``kids``, to which one node has been added, into repeated nodes and groups."""
    if len(kids) < 2:
        return
    node, before = kids[-1], kids[-2]
    if before[KEY] == node[KEY]:
        if _like(before, node):
            both = merged(before, node, join)
            both[MARK] = _marks(both[MARK], "+")
            kids[-2:] = [both]
        elif len(kids) >= 5 and all(k[KEY] == node[KEY] for k in kids[-5:]):
            both = kids[-5]
            for k in kids[-4:]:
                both = merged(both, k, join)
            both[MARK] = _marks(both[MARK], "+")
            kids[-5:] = [both]
        return
    for at in range(len(kids) - 2, max(-1, len(kids) - 6), -1):
        group = kids[at]
        if group[KEY][0] == "(":
            late, own = kids[at + 1 :], group[KIDS]
            if len(late) == 1 and late[0][KEY] == own[-1][KEY]:
                own[-1] = merged(own[-1], late[0], join)
                own[-1][MARK] = _marks(own[-1][MARK], "+")
                del kids[at + 1 :]
            elif [k[KEY] for k in late] == [k[KEY] for k in own]:
                group[KIDS] = [merged(x, y, join) for x, y in zip(own, late)]
                del kids[at + 1 :]
            return
    for n in range(2, min(4, len(kids) // 2) + 1):
        first, second = kids[-2 * n : -n], kids[-n:]
        if [k[KEY] for k in first] == [k[KEY] for k in second] and all(k[KEY][0] != "(" for k in first) and all(map(_like, first, second)):
            kids[-2 * n :] = [["(" + "|".join(k[KEY] for k in first) + ")", "+", [merged(x, y, join) for x, y in zip(first, second)], None]]
            return


class Page:
    """A page's folded tree, and its texts in page order with the slot and the number of characters that are links."""

    def __init__(self, source: str):
        self.texts: list[tuple[int, str, int]] = []
        self._up: list[int] = []
        self._stack: list[tuple[str, str, list]] = [("", "", [])]  # tag, key, kids
        self._buffer: list[str] = []
        self._links, self._link, self._mute = 0, False, ""
        self._deep: dict[str, int] = {}
        at = 0
        for m in TOKEN.finditer(source):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            tag = m["tag"] or m["tag2"]
            if tag:
                if m["end"] or m["end2"]:
                    self._close(tag.lower())
                else:
                    self._open(tag.lower(), m["attrs"] or m["attrs2"] or "")
        if at < len(source):
            self._text(source[at:])
        self._flush()
        while len(self._stack) > 1:
            self._pop()
        self.kids = self._stack[0][2]
        order: dict[int, int] = {}
        parts: list[str] = []
        self._walk(self.kids, order, parts)
        self.shape, self.n_slots = "".join(parts), len(order)
        self.texts = [(order[self._root(s)], t, links) for s, t, links in self.texts]

    def _root(self, slot: int) -> int:
        while self._up[slot] != slot:
            slot = self._up[slot]
        return slot

    def _join(self, x: int, y: int) -> int:
        x, y = self._root(x), self._root(y)
        self._up[y] = x
        return x

    def _walk(self, kids: list, order: dict[int, int], parts: list[str]) -> None:
        for k in kids:
            parts.append(k[KEY] + k[MARK])
            if k[KIDS] is None:
                order.setdefault(self._root(k[SLOT]), len(order))
            else:
                parts.append("{")
                self._walk(k[KIDS], order, parts)
                parts.append("}")
            parts.append(";")

    def _text(self, raw: str) -> None:
        if not self._mute:
            text = html_module.unescape(raw) if "&" in raw else raw
            self._buffer.append(text)
            if self._link:
                self._links += len(text.strip())

    def _flush(self) -> None:
        if self._buffer:
            text = " ".join("".join(self._buffer).split())
            if text:
                self._up.append(len(self._up))
                self.texts.append((len(self._up) - 1, text, min(self._links, len(text))))
                kids = self._stack[-1][2]
                kids.append(["#", "", None, len(self._up) - 1])
                _fold(kids, self._join)
            self._buffer = []
        self._links, self._link, self._mute = 0, False, ""

    def _pop(self) -> None:
        _, key, kids = self._stack.pop()
        above = self._stack[-1][2]
        above.append([key, "", kids, None])
        _fold(above, self._join)

    def _pop_to(self, tags, fences) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in tags:
                self._flush()
                while len(self._stack) > i:
                    self._pop()
                return
            if self._stack[i][0] in fences:
                return

    def _open(self, tag: str, attrs: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self._link = True
            elif attrs and not self._mute and _labelled(attrs)[1] == "!":
                self._mute = tag
            return
        if tag in ("br", "wbr"):
            self._buffer.append(" " if tag == "br" else "")
            return
        if tag in VOID and tag != "hr":
            return
        self._flush()
        if tag in ("hr", "html", "body"):
            if tag == "body":
                self._pop_to({"head"}, ())
            return
        top = self._stack[-1][0]
        if top == "head" and tag not in NEVER:
            self._pop()
        elif top == "p" or top in HEADINGS and tag in HEADINGS:
            self._pop()
        if tag in ENDS:
            self._pop_to(*ENDS[tag])
        if len(self._stack) > DEPTH:
            self._deep[tag] = self._deep.get(tag, 0) + 1
            return
        labels, flag = _labelled(attrs) if attrs else ("", "")
        if tag in NEVER:
            flag = "!"
        elif tag in ("article", "main"):
            flag = flag or "@"
        elif tag == "header":
            flag = flag or "^"
        self._stack.append((tag, f"{tag} {flag}{labels}" if labels or flag else tag, []))

    def _close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self._link = False
            if tag == self._mute:
                self._mute = ""
            return
        if tag in VOID or tag in ("html", "body"):
            return
        if tag == "p" or self._deep.get(tag):
            self._flush()
        if self._deep.get(tag):
            self._deep[tag] -= 1
            return
        self._pop_to({tag}, () if tag in ("table", "tr", "tbody", "thead", "tfoot") else ("td", "th", "caption"))


def _joined_stats(x: list, y: list) -> list:
    """Slots of different pages: pages, characters, characters of links, checksum of the text or -1 where it varies."""
    return [x[0] + y[0], x[1] + y[1], x[2] + y[2], x[3] if x[3] == y[3] else -1]


def _slots(kids: list) -> Iterator[list]:
    for k in kids:
        if k[KIDS] is None:
            yield k
        else:
            yield from _slots(k[KIDS])


def page_stats(page: Page) -> list[list]:
    """Of each slot of a page: one page, its characters, those of links, checksum of its text."""
    out = [[1, 0, 0, 0] for _ in range(page.n_slots)]
    for slot, text, links in page.texts:
        s = out[slot]
        s[1] += len(text)
        s[2] += links
        s[3] = crc32(text.encode("utf-8", "replace"), s[3])
    return out


def _plain(page: Page) -> list:
    """The page's tree with slots numbered in order."""
    numbers: dict[int, int] = {}

    def copy(kids: list) -> list:
        return [[k[KEY], k[MARK], None, numbers.setdefault(page._root(k[SLOT]), len(numbers))] if k[KIDS] is None else [k[KEY], k[MARK], copy(k[KIDS]), None] for k in kids]

    return copy(page.kids)


def _filled(kids: list, stats: list) -> list:
    return [[k[KEY], k[MARK], None, stats[k[SLOT]]] if k[KIDS] is None else [k[KEY], k[MARK], _filled(k[KIDS], stats), None] for k in kids]


def _mass(kids: list) -> int:
    return sum(max(0, k[SLOT][1] - k[SLOT][2]) for k in _slots(kids) if k[SLOT][4])


def _choose(kids: list, out: list, inside: bool = False) -> None:
    """Gathers the nodes of article and main elements, outermost first; main gives way to articles in it that hold half of it."""
    for k in kids:
        if k[KIDS] is None:
            continue
        key = k[KEY]
        if " @" in key and not key.startswith("("):
            inner: list = []
            if _tag(key) != "article":
                _choose(k[KIDS], inner)
            out += inner if inner and 2 * sum(_mass(x[KIDS]) for x in inner) >= _mass(k[KIDS]) else [k]
        else:
            _choose(k[KIDS], out)


def decisions(kids: list, pages: int) -> list:
    """The wrapper (kids whose slots are statistics) with a verdict for each slot: 2 for the text, 1 for no text though its labels would allow it, 0 for none."""

    raw = lambda kids: sum(k[SLOT][1] - k[SLOT][2] for k in _slots(kids))
    most = 0.6 * raw(kids)

    def labelled(kids: list, out: bool, article: bool, heading: bool) -> list:
        made = []
        for k in kids:
            if k[KIDS] is None:
                made.append([k[KEY], k[MARK], None, [*k[SLOT][:4], not out, heading]])
            else:
                tag, _, rest = k[KEY].partition(" ")
                group = k[KEY][0] == "("
                gone = not group and (rest[:1] == "!" or rest[:1] == "^" and not article)
                if gone and tag not in NEVER and not ANYWAY & {w.lower() for w in WORD.findall(rest)} and raw(k[KIDS]) > most > 0:
                    gone = False
                gone = gone or out
                made.append([k[KEY], k[MARK], labelled(k[KIDS], gone, article or not group and rest[:1] == "@", heading if group else tag == "h1"), None])
        return made

    kids = labelled(kids, False, False, False)
    slots = list(_slots(kids))
    allowed = [k for k in slots if k[SLOT][4]]
    same = lambda s: s[3] != -1 and s[0] >= 3 and 2 * s[0] >= pages
    if allowed and not same(max((k[SLOT] for k in allowed), key=lambda s: s[1] - s[2])):
        for k in allowed:
            k[SLOT][4] = not same(k[SLOT])
    total, chosen = _mass(kids), []
    _choose(kids, chosen)
    good = {id(k) for c in chosen for k in _slots(c[KIDS])}
    if not chosen or 3 * sum(_mass(c[KIDS]) for c in chosen) < total:
        place = kids
        while True:
            inner = [k for k in place if k[KIDS] is not None and 10 * _mass(k[KIDS]) >= 7 * _mass(place) > 0]
            if not inner or inner[0][KEY][0] == "(" or "+" in inner[0][MARK] or "*" in inner[0][MARK] or _tag(inner[0][KEY]) in CONTENT:
                break
            place = inner[0][KIDS]
        good = {id(k) for k in _slots(place) if 10 * k[SLOT][2] <= 7 * k[SLOT][1]} | {id(k) for k in slots if k[SLOT][5]}
    may = {id(k) for k in allowed}
    verdict = {id(k): 2 if k[SLOT][4] and id(k) in good else 1 if id(k) in may else 0 for k in slots}
    told = lambda kids: [[k[KEY], k[MARK], None, verdict[id(k)]] if k[KIDS] is None else [k[KEY], k[MARK], told(k[KIDS]), None] for k in kids]
    return told(kids)


def verdicts_of(wrapper: list, kids: list, n_slots: int) -> list[int]:
    """The wrapper's verdict for each slot of a page's tree; -1 where the tree has a slot that the wrapper doesn't."""
    out = [-1] * n_slots

    def walk(own: list, page: list) -> None:
        page = _with_groups(page, own)
        for i, j in _steps([k[KEY] for k in own], [k[KEY] for k in page]):
            if page[j][KIDS] is None:
                out[page[j][SLOT]] = own[i][SLOT]
            else:
                walk(own[i][KIDS], page[j][KIDS])

    walk(wrapper, kids)
    return out


_HOST = r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)"


def _pages(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), F.lower(F.coalesce(F.regexp_extract("url", _HOST, 1), F.lit(""))).alias("host"))


def _merge_rows(rows: Iterator[tuple], finish) -> Iterator[tuple]:
    """(host, pages, result of ``finish``) of rows (host, pages, tree as JSON) sorted by host: trees of one host are merged as they come."""
    host, pages, kids = None, 0, None
    for h, n, tree in rows:
        tree = json.loads(tree)
        if h != host:
            if kids is not None:
                yield host, pages, json.dumps(finish(kids, pages))
            host, pages, kids = h, n, tree
        else:
            pages, kids = pages + n, aligned(kids, tree, _joined_stats)
    if kids is not None:
        yield host, pages, json.dumps(finish(kids, pages))


def infer_wrappers(pages: DataFrame, parts: int = 16, most: int = 20_000) -> DataFrame:
    """(host, wrapper): the wrapper of every host of ``pages`` (page_id, url, html), with its verdicts."""

    def trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[tuple[str, str], list] = {}

        def rows() -> pa.RecordBatch:
            items = [(host, crc32(shape.encode("utf-8", "replace")) % parts, shape, n, json.dumps(_filled(kids, stats))) for (host, shape), (n, kids, stats) in met.items()]
            met.clear()
            return pa.record_batch([pa.array([r[i] for r in items], t) for i, t in enumerate((pa.string(), pa.int32(), pa.string(), pa.int64(), pa.string()))], names=["host", "part", "shape", "n", "tree"])

        for batch in batches:
            for host, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                page = Page(text.as_py())
                stats = page_stats(page)
                known = met.get((host, page.shape))
                if known is None:
                    met[host, page.shape] = [1, _plain(page), stats]
                else:
                    known[0] += 1
                    known[2] = [_joined_stats(x, y) for x, y in zip(known[2], stats)]
            if len(met) > most:
                yield rows()
        yield rows()

    def merge(finish):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            rows = (row for batch in batches for row in zip(*[c.to_pylist() for c in batch.columns]))
            for host, n, tree in _merge_rows(rows, finish):
                yield pa.record_batch([pa.array([host]), pa.array([n]), pa.array([tree])], names=["host", "n", "tree"])

        return run

    # A host's trees of one part are rows of one task under a name of their own, so that they end together.
    few = max(shuffle_partitions(pages.sparkSession), 2)
    told = _pages(pages).select("host", "html").mapInArrow(trees, "host string, part int, shape string, n long, tree string")
    named = told.select(F.concat_ws("\n", "part", "host").alias("host"), "n", "tree", "shape").repartition(few, "host").sortWithinPartitions("host", "shape", "n").select("host", "n", "tree")
    partly = named.mapInArrow(merge(lambda kids, n: kids), "host string, n long, tree string")
    whole = partly.select(F.substring_index("host", "\n", -1).alias("host"), "n", "tree", F.substring_index("host", "\n", 1).cast("int").alias("part"))
    dealt = whole.repartition(few, "host").sortWithinPartitions("host", "part").select("host", "n", "tree")
    return dealt.mapInArrow(merge(decisions), "host string, n long, tree string").select("host", F.col("tree").alias("wrapper"))


def extract_text(pages: DataFrame, wrappers: DataFrame, most: int = 20_000) -> DataFrame:
    """(page_id, url, text, n_chars) of ``pages`` (page_id, url, html) by ``wrappers`` (host, wrapper)."""
    kind = pages.schema["page_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, list] = {}
        found: dict[tuple[str, str], list[int]] = {}
        for batch in batches:
            texts = []
            for source, wrapper in zip(batch.column(2), batch.column(3).to_pylist()):
                page = Page(source.as_py())
                verdict = found.get((wrapper, page.shape))
                if verdict is None:
                    if len(found) > most:
                        found.clear()
                        known.clear()
                    if wrapper not in known:
                        known[wrapper] = json.loads(wrapper or "[]")
                    verdict = found[wrapper, page.shape] = verdicts_of(known[wrapper], _plain(page), page.n_slots)
                blocks = [t for s, t, _ in page.texts if verdict[s] == 2] or [t for s, t, _ in page.texts if verdict[s] == 1]
                texts.append("\n".join(blocks))
            yield pa.record_batch([batch.column(0), batch.column(1), pa.array([t.encode("utf-8", "replace").decode() for t in texts], pa.string())], names=["page_id", "url", "text"])

    met = _pages(pages).join(wrappers, "host", "left").select("page_id", "url", "html", "wrapper")
    found = met.mapInArrow(run, f"page_id {kind.simpleString()}, url string, text string")
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return extract_text(pages, cut(infer_wrappers(pages)))

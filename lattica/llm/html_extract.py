"""Main text of web pages by wrapper induction.

Pages are parsed to trees; runs of like siblings fold to one node, so a tree's size follows the
template and not the article's length. The trees of a host are merged one into another by simple
tree matching. A wrapper keeps the tree and, for each node, on how many pages it is, its commonest
texts as hashes with counts (a summary of fixed size that never counts too high), and the characters
of its text, and of its links, over all pages. Partial wrappers are made per task and merged per
host, so no task ever holds a host's pages. Of a few pages (those of the smallest hashes) a wrapper
keeps a sketch of 3-word shingles and the number of equal pages. Sampled pages that overlap by COPY
are copies of one another.

Every run of siblings of a page is aligned. A wrapper lets go of nodes by their share of pages only,
as in lossy counting: each node also keeps on how many pages, at most, it stood before it was known,
and goes once both numbers are a RARE-th of the pages or less. So a node on more pages than that
stays wherever it stands, and its count is off by a RARE-th of the pages at most. Words with digits,
and ids of three words or more, which name one page or one heading, are no part of a node's label.

The wrapper says where the content of a host is: from the root down, the one child with most of the
text that varies and is no link, as long as it holds blocks and no headline is left outside. What
stands beside that way is template, whatever it says: menus, adverts and footers whose words differ
from page to page lie outside. Inside, an element's text is constant if it is the same on four in five
of the pages that have its node; members of a run of like siblings are told apart by their texts, all
of which are counted, however long the run, and let go as nodes are: by their share of pages only.
Constant text is template, but for headings and labels (LABELS) whose section goes on with text that
varies, and for words within a line that varies. Lists of links that are on most pages stay, as they
may be the article's own, unless constant text leads to them that is template: a heading or a line
with nothing but links behind it. Names and kinds of elements are a
second opinion: what they call no article text is no way to the content, and goes from it. On hosts
without a wrapper of use they decide alone, with the main element of the page.

A wrapper is of use from ``min_pages`` pages on that are no copies of one another, if no page and
its copies are more than half of those sampled: then what only copies share never is on most pages
of the sample.

A name (words of class, id and role) never decides alone. An element of such a name is dropped if
half of its text or more is in links (inline ones by a name of such words alone), or if the name
says nothing else (``ad``, ``cookie-banner``, not ``article-header``) and the element is short and
without a heading, or has a place on most pages of the host's wrapper. Never dropped by name are
headings, what holds the page's article, main or h1, and what is longer than SMALL and half of the
page's text or more.

Every page gives a row, repeated ones each. Null and empty pages give an empty text; a null or odd url has the empty
host. White space inside a block is one space; blocks join by a line end in page order. Elements
nested beyond DEPTH keep their text and blocks, but no deeper tree. Other columns are ignored,
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import html as html_lib
import json
import re
import zlib
from collections import deque

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table, written

MIN_PAGES, SHARD = 3, 64
#: Pages of a host, and shingles of each, that tell how many of its pages are no copies; the overlap of copies.
SAMPLE, SHINGLES, COPY = 10, 32, 0.8
#: Sources of tags that a task remembers with what they say, and the characters of the longest.
TAGS, TAG = 4096, 256
#: Wrapper nodes on at most one in RARE pages are let go, every RARE pages.
RARE = 64
#: Cells of one alignment table; longer lists of siblings are halved first.
CELLS = 1 << 22
#: Wrappers of up to this many bytes in all are sent to every task; beyond, pages meet them by a join.
SENT_BYTES = 32 << 20
#: Pages of a host that share one copy of its wrapper then, and hosts with more that are sent to every task.
SHARED, MANY = 2000, 100_000

#: Texts that a wrapper's node counts, and the share of the varying text that makes the way to the content.
TEXTS, MOST = 4, 0.6
#: Characters of pages after which a task hands its wrappers on: until RARE pages are known, all texts of their runs' members are kept.
HELD = 32 << 20
#: Elements nested deeper are kept as siblings, so that a page of any depth has a tree of this one.
DEPTH = 150

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noscript template iframe".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("td th tr tbody thead tfoot caption html body legend summary dd dt li".split()) | frozenset(["dl", "table"])
#: Elements that show no text.
SILENT = frozenset("head script style noscript template iframe object svg canvas math title meta link audio video map textarea select option input".split())
#: Elements whose kind says that they are no article text.
DROPPED = frozenset("nav footer aside form button label dialog menu".split())
MAIN = frozenset(["article", "main"])
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that name what follows them.
LABELS = HEADINGS | frozenset("dt th caption figcaption legend summary".split())
#: Characters of a short element.
SMALL = 400
#: Words of class, id and role that name what is no article text.
NOISE = frozenset("ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner cookie cookies consent gdpr notice notices alert popup modal overlay nav navbar navigation menu breadcrumb breadcrumbs header masthead topbar footer sidebar aside widget related recommended recommendations share sharing social newsletter subscribe subscription comment comments disqus reply replies respond login signup search pagination pager toolbar contentinfo complementary form skip".split())
#: End tags that HTML lets authors leave out: what a tag closes, and where to stop looking for it.
CLOSES = {
    "li": (("li",), ("ul", "ol", "menu", "dir")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr", "td", "th"), ("table", "tbody", "thead", "tfoot")),
    "td": (("td", "th"), ("table", "tbody", "thead", "tfoot", "tr")),
    "th": (("td", "th"), ("table", "tbody", "thead", "tfoot", "tr")),
    "option": (("option",), ("select",)),
}

_NAME = re.compile(r"/?([a-zA-Z][^\s/>]*)")
#: Text, then a tag whose quotes are all closed.
_PIECE = re.compile(r"""([^<]*+)(</?[a-zA-Z][^\s/>]*+(?:[^>"']++|"[^"]*+"|'[^']*+')*+>)""")
_STOP = re.compile("[>\"']")
_ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)\b(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_BLANK = re.compile(b" ")
_SPLIT_NAME = re.compile(r"[^a-z0-9]+|(?<=[a-z])(?=[A-Z])")


class Node:
    __slots__ = ("name", "label", "silent", "noise", "named", "children", "parent", "depth", "own")

    def __init__(self, label: str, silent: bool = False, noise: bool = False, parent: Node | None = None, named: int = 0, name: str = ""):
        self.name, self.label, self.parent = name or label.split(".", 1)[0], label, parent
        self.silent, self.noise, self.named = silent, noise, named  # named: 1 for a word of NOISE, 2 for a name of such words alone
        self.depth = parent.depth + 1 if parent else 0
        self.children: list = []  # nodes and strings, in order
        self.own: list[str] | None = None  # see _own


class Tag:
    """What the source of a tag says, wherever it stands."""

    __slots__ = ("name", "ends", "label", "silent", "noise", "named", "opens", "raw", "closes_p", "closes")

    def __init__(self, source: str):
        m = _NAME.match(source, 1)
        attrs = source[m.end() : -1]
        self.name, self.ends = m[1].lower(), source[1] == "/"
        named, label, hidden = 0, set(), False
        for key, value in _ATTR.findall(attrs) if not self.ends and attrs.strip(" /") else ():
            key, value = key.lower(), value.strip("\"'")
            if key in ("class", "id", "role"):
                own = [w.lower() for w in _SPLIT_NAME.split(value) if w]
                for part in value.split():
                    of = [w.lower() for w in _SPLIT_NAME.split(part) if w.isalpha()]
                    if not NOISE.isdisjoint(of):
                        named = max(named, 2 if NOISE.issuperset(of) else 1)
                if key != "id" or len(own) < 3:
                    label.update(w for w in own if w.isalpha())
            elif key == "hidden" or key == "aria-hidden" and value == "true" or key == "style" and "display:none" in value.replace(" ", ""):
                hidden = True
        self.label = f"{self.name}.{'.'.join(sorted(label))}" if label else self.name
        self.silent, self.noise = hidden or self.name in SILENT, self.name in DROPPED
        self.named = 0 if self.name in ("html", "body") or self.name in HEADINGS else named
        self.raw = self.name in RAW and not self.ends
        self.opens = self.raw or self.name not in VOID and not attrs.rstrip().endswith("/")
        self.closes_p, self.closes = self.name in CLOSES_P, CLOSES.get(self.name)


def tokens(page: str, known: dict[str, Tag] | None = None):
    """(text, tag) of a page, in order: a tag or None, and the text before it. Every character is looked at a few times only."""
    pos, n = 0, len(page)
    known = {} if known is None else known
    endless: dict[int, int | None] = {}
    closable = page.rfind(">")
    while pos < n:
        if pos <= closable and not endless and (m := _PIECE.match(page, pos)):
            text, source = m.groups()
            tag = known.get(source)
            if tag is None:
                tag = Tag(source)
                if len(source) <= TAG:
                    if len(known) >= TAGS:
                        known.clear()
                    known[source] = tag
            pos = m.end()
            yield text, tag
            if tag.raw:
                text, pos = _raw(page, pos, tag.name)
                yield text, None
            continue
        at = page.find("<", pos)
        if at < 0:
            at = n
        if at > pos:
            yield page[pos:at], None
        if at == n:
            return
        if page.startswith("<!--", at):
            end = page.find("-->", at + 4)
            pos = n if end < 0 else end + 3
            continue
        if page.startswith("<![CDATA[", at):
            end = page.find("]]>", at + 9)
            yield html_lib.escape(page[at + 9 : n if end < 0 else end]), None
            pos = n if end < 0 else end + 3
            continue
        if page[at + 1 : at + 2] in ("!", "?"):
            end = page.find(">", at)
            pos = n if end < 0 else end + 1
            continue
        m = _NAME.match(page, at + 1)
        end = _end(page, m.end(), endless) if m and at < closable else -1
        if end < 0:
            yield "<", None
            pos = at + 1
            continue
        pos = end + 1
        tag = Tag(page[at:pos])
        yield "", tag
        if tag.raw:
            text, pos = _raw(page, pos, tag.name)
            yield text, None


def _raw(page: str, pos: int, name: str) -> tuple[str, int]:
    """The text of an element that ends at its own end tag only, and where that is."""
    m = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
    end = m.start() if m else len(page)
    return page[pos:end], end


def _end(page: str, pos: int, endless: dict[int, int | None]) -> int:
    """Where a tag ends, quoted values passed over; a quote that nothing closes is a character. ``endless`` keeps the quotes from which no end was found."""
    first, seen = -1, []
    found: int | None = None  # nothing follows the quoted values
    while m := _STOP.search(page, pos):
        at = m.start()
        if m[0] == ">":
            return at
        if first < 0:
            first = at
        if at in endless:
            found = endless[at]
            break
        seen.append(at)
        pos = page.find(m[0], m.end()) + 1
        if not pos:
            found = page.find(">", m.end())
            if found >= 0:
                return found
            break
    endless.update(dict.fromkeys(seen, found))
    return page.find(">", first) if found is None and first >= 0 else -1


def parse(page: str, known: dict[str, Tag] | None = None) -> Node:
    """The tree of a page, with the end tags that HTML lets authors leave out; ``known`` keeps what tags say from page to page."""
    root = Node("#")
    at, open_ = root, {}  # elements that are open, by name

    def close(x: Node) -> Node:
        """The parent of x, all from ``at`` up to x closed."""
        y = at
        while True:
            open_[y.name] -= 1
            if y is x:
                return x.parent
            y = y.parent

    for text, tag in tokens(page, known):
        if text:
            at.children.append(text)
        if tag is None:
            continue
        name = tag.name
        if tag.ends:
            if not open_.get(name):
                continue
            x = at
            while x.name != name and (name in BLOCK or x.name not in BLOCK):  # an inline end tag does not close blocks around it
                x = x.parent
            if x.name == name:
                at = close(x)
            continue
        if tag.closes_p and open_.get("p"):
            x = at
            while x.name not in BLOCK and x is not root:
                x = x.parent
            if x.name == "p":
                at = close(x)
        if tag.closes and any(open_.get(c) for c in tag.closes[0]):
            same, stop = tag.closes
            x, top = at, None
            while x is not root and x.name not in stop:
                if x.name in same:
                    top = x
                x = x.parent
            if top is not None:
                at = close(top)
        parent = at
        while parent.depth >= DEPTH:
            parent = parent.parent
        new = Node(tag.label, tag.silent, tag.noise, parent, tag.named, name)
        parent.children.append(new)
        while at is not parent:
            open_[at.name] -= 1
            at = at.parent
        if tag.opens:
            open_[name] = open_.get(name, 0) + 1
            at = new
    return root


def _hash(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=7).digest(), "big")


def fold(node: Node, linked: bool = False, runs: dict | None = None) -> list:
    """The folded tree: runs of like siblings are one node, its text that of all the run; ``runs`` gets the runs below each node, by id().

    [label, [[text hash, pages]], pages, children, pages that may be missed, characters, of which in links, {text of a member: [pages, pages that may be missed]}].
    With ``runs`` the texts of members are left out: only wrappers count them.
    """
    return _folded([node], linked, runs)


def _own(x: Node) -> list[str]:
    """The pieces of text that stand in an element itself."""
    if x.own is None:
        x.own = [t for c in x.children if isinstance(c, str) and (t := " ".join(c.split()))]
    return x.own


def _short(texts: list[str]) -> str:
    """A short key for the texts of an element: their checksum and length."""
    raw = "\n".join(texts).encode("utf-8", "replace")
    return f"{zlib.crc32(raw):x}.{len(raw)}"


def _folded(run: list[Node], linked: bool, runs: dict | None) -> list:
    linked = linked or run[0].name == "a"
    each = [ts for x in run if (ts := _own(x))]
    below = runs_of(run)
    n = whole = 0
    members: dict = {}
    if each:
        own = each[0] if len(each) == 1 else [t for ts in each for t in ts]
        n, whole = sum(map(len, own)), _hash("\n".join(own))
        members = {_short(ts): [1, 0] for ts in each} if runs is None else {}
    node = [run[0].label, [[whole, 1]], 1, [_folded(r, linked, runs) for r in below], 0, n, n if linked else 0, members]
    if runs is not None:
        runs[id(node)] = below
    return node


class _Shapes:
    """Numbers of trees that are equal in labels, their sizes, and the matches of two."""

    def __init__(self, root: list | None = None):
        self.numbers, self.kept, self.of_node, self.size, self.keys, self.aligned = {}, {}, {}, [], [], {}
        self.root, self.held = root, 0  # held: children and pairs that keys and matches hold
        if root is not None:
            self.of(root)
            self.kept, self.of_node, self.most = self.of_node, {}, 2 * self.held + 64

    def next_page(self) -> _Shapes:
        """The same shapes without the nodes of the last page; what pages left goes when it is more than the wrapper's own."""
        if self.held > self.most:
            self.__init__(self.root)
        self.of_node = {}
        return self

    def of(self, node: list) -> int:
        at = id(node)
        got = self.of_node.get(at)
        if got is None and (got := self.kept.get(at)) is None:
            key = (node[0], *[self.of(c) for c in node[3]])
            got = self.numbers.setdefault(key, len(self.size))
            if got == len(self.size):
                self.size.append(1 + sum(self.size[c] for c in key[1:]))
                self.keys.append(key)
                self.held += len(key)
            self.of_node[at] = got
        return got

    def match(self, x: int, y: int) -> int:
        if x == y:
            return self.size[x]
        a, b = self.keys[x], self.keys[y]
        if a[0] != b[0]:
            return 0
        if len(a) == 1 or len(b) == 1:
            return 1
        return 1 + self.below(x, y)[0]

    def below(self, x: int, y: int) -> tuple[int, list]:
        """The size of the largest match of the children of two trees, and the aligned pairs of indices."""
        got = self.aligned.get((x, y))
        if got is None:
            got = self.aligned[x, y] = self.siblings(self.keys[x][1:], self.keys[y][1:])
            self.held += 1 + len(got[1])
        return got

    def siblings(self, x: tuple, y: tuple) -> tuple[int, list]:
        # a tree matches none better than its equal, so equal ends are part of a largest match
        n, head, tail = min(len(x), len(y)), 0, 0
        while head < n and x[head] == y[head]:
            head += 1
        while tail < n - head and x[-1 - tail] == y[-1 - tail]:
            tail += 1
        pairs = [(i, i) for i in range(head)]
        x_, y_ = x[head : len(x) - tail], y[head : len(y) - tail]
        if x_ and y_:
            kx, ix = np.unique(x_, return_inverse=True)
            ky, iy = np.unique(y_, return_inverse=True)
            worth = np.array([[self.match(int(p), int(q)) for q in ky] for p in kx], "i8")
            pairs += [(head + i, head + j) for i, j in _aligned(ix, iy, worth)]
        pairs += [(len(x) - t, len(y) - t) for t in range(tail, 0, -1)]
        return sum(self.match(x[i], y[j]) for i, j in pairs), pairs


def match(a: list, b: list, shapes: _Shapes | None = None) -> tuple[int, list]:
    """Simple tree matching of two lists of siblings: the size of the largest match, and the aligned pairs of indices."""
    if not a or not b:
        return 0, []
    shapes = shapes or _Shapes()
    return shapes.siblings(tuple(shapes.of(c) for c in a), tuple(shapes.of(c) for c in b))


def _rows(ix: np.ndarray, iy: np.ndarray, worth: np.ndarray, keep: bool) -> np.ndarray:
    """The table of best matches of prefixes, or its last row alone."""
    last = np.zeros(len(iy) + 1, "i8")
    rows = [last]
    for i in ix:
        new = np.zeros_like(last)
        np.maximum.accumulate(np.maximum(last[1:], last[:-1] + worth[i][iy]), out=new[1:])
        last = new
        if keep:
            rows.append(last)
    return np.array(rows) if keep else last


def _aligned(ix: np.ndarray, iy: np.ndarray, worth: np.ndarray) -> list:
    """Pairs of indices of a common subsequence of the largest worth."""
    if len(ix) > 1 and len(ix) * len(iy) > CELLS:
        mid = len(ix) // 2
        j = int(np.argmax(_rows(ix[:mid], iy, worth, False) + _rows(ix[mid:][::-1], iy[::-1], worth, False)[::-1]))
        return _aligned(ix[:mid], iy[:j], worth) + [(mid + p, j + q) for p, q in _aligned(ix[mid:], iy[j:], worth)]
    w = _rows(ix, iy, worth, True)
    i, j, pairs = len(ix), len(iy), []
    while i and j:
        if w[i, j] == w[i - 1, j]:
            i -= 1
        elif w[i, j] == w[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


def _older(nodes: list, missed: int) -> list:
    """Nodes that one of two wrappers lacks: it may have let them go before."""
    return [[*n[:3], _older(n[3], missed), n[4] + missed, *n[5:7], _late(n[7], missed)] for n in nodes] if missed else nodes


def _late(members: dict, missed: int) -> dict:
    """Texts of members that one of two wrappers lacks."""
    return {h: [c, m + missed] for h, (c, m) in members.items()} if missed else members


def _counted(x: list, y: list) -> list:
    """The texts of two nodes, with counts that are too low by a (TEXTS + 1)-th of the pages at most."""
    n = {h: c for h, c in x}
    for h, c in y:
        n[h] = n.get(h, 0) + c
    if len(n) == 1:
        return [[h, c] for h, c in n.items()]
    most = sorted(n.items(), key=lambda i: (-i[1], i[0]))
    less = most[TEXTS][1] if len(most) > TEXTS else 0
    return [[h, c - less] for h, c in most[:TEXTS] if c > less]


def _members(x: dict, y: dict, missed: tuple[int, int]) -> dict:
    """The texts of members of two nodes' runs, every one with its count."""
    if not y and not missed[1]:
        return x
    out = dict(_late(x, missed[1]))
    for h, (c, m) in y.items():
        had = x.get(h)
        out[h] = [had[0] + c, had[1] + m] if had else [c, m + missed[0]]
    return out


def merge(a: list, b: list, missed: tuple[int, int] = (0, 0), shapes: _Shapes | None = None) -> list:
    """The wrapper of two aligned trees: texts, pages and characters add up, nodes of one tree alone stay."""
    shapes = shapes or _Shapes()
    pairs = shapes.below(shapes.of(a), shapes.of(b))[1] if a[3] and b[3] else []
    children, i, j = [], 0, 0
    for p, q in [*pairs, (len(a[3]), len(b[3]))]:
        children += _older(a[3][i:p], missed[1]) + _older(b[3][j:q], missed[0])
        if p < len(a[3]):
            children.append(merge(a[3][p], b[3][q], missed, shapes))
        i, j = p + 1, q + 1
    return [a[0], _counted(a[1], b[1]), a[2] + b[2], children, a[4] + b[4], a[5] + b[5], a[6] + b[6], _members(a[7], b[7], missed)]


def _common(node: list, most: int) -> list:
    """A wrapper without the nodes, and the texts of members, that are on ``most`` pages or less."""
    return [*node[:3], [_common(c, most) for c in node[3] if c[2] + c[4] > most], *node[4:7], {h: [c, m] for h, (c, m) in node[7].items() if c + m > most}]


def _settled(node: list) -> list:
    """A wrapper of all pages: of the texts of members only those that are constant."""
    return [*node[:3], [_settled(c) for c in node[3]], *node[4:7], {h: node[7][h] for h in _constant_members(node)}]


def merged(x: dict, y: dict) -> dict:
    tree, missed = merge(x["tree"], y["tree"], (x["missed"], y["missed"])), x["missed"] + y["missed"]
    rare = tree[2] // RARE
    if rare > max(x["tree"][2], y["tree"][2]) // RARE:
        tree, missed = _common(tree, rare), rare
    pages = {h: [h, n, sketch] for h, n, sketch in x["pages"]}
    for h, n, sketch in y["pages"]:
        pages[h] = [h, n + pages[h][1] if h in pages else n, sketch]
    return {"tree": tree, "missed": missed, "pages": [pages[h] for h in sorted(pages)[:SAMPLE]]}


def sketch_of(tree: Node) -> list[int]:
    """The smallest hashes of 3-word shingles of a page, without what its kind drops."""
    out, todo = [], [tree]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out += x.split()
        elif not x.silent and not x.noise:
            todo += x.children[::-1]
    raw = " ".join(out).encode("utf-8", "replace")
    if len(out) <= 3:
        return [zlib.crc32(raw)]
    ends = [*(m.start() for m in _BLANK.finditer(raw)), len(raw)]
    return sorted({zlib.crc32(raw[lo:hi]) for lo, hi in zip([0, *(e + 1 for e in ends)], ends[2:], strict=False)})[:SHINGLES]


def wrapper_of(page: str, tree: Node, held: dict | None = None) -> dict:
    """The wrapper of one page; its sketch is left out if the wrapper ``held`` would not keep it."""
    h = _hash(page)
    kept = held is None or len(held["pages"]) < SAMPLE or h <= held["pages"][-1][0]
    return {"tree": fold(tree), "missed": 0, "pages": [[h, 1, sketch_of(tree)]] if kept else []}


def usable(wrapper: dict, min_pages: int) -> bool:
    """Whether so many sampled pages are no copies of one another, and no page and its copies more than half."""
    groups: list[tuple[set, list[int]]] = []
    for _, n, sketch in wrapper["pages"]:
        own = set(sketch)
        for first, size in groups:
            least = sorted(own | first)[:SHINGLES]
            if sum(x in own and x in first for x in least) >= COPY * len(least):
                size[0] += n
                break
        else:
            groups.append((own, [n]))
    sizes = [size[0] for _, size in groups]
    return len(sizes) >= min(min_pages, SAMPLE) and max(sizes, default=0) * 2 <= sum(sizes)


def constant(node: list, h: int | None = None) -> bool:
    """Whether a text, or text h, of a wrapper's node is on four in five of the pages that have the node, MIN_PAGES at least."""
    return any(c >= MIN_PAGES and c * 5 >= 4 * (node[2] + node[4]) and t and (h is None or t == h) for t, c in node[1])


def _constant_members(node: list) -> set[str]:
    return {t for t, (c, _) in node[7].items() if c >= MIN_PAGES and c * 5 >= 4 * (node[2] + node[4])}


def constant_members(root: list) -> dict[int, set[str]]:
    """Of each node of a wrapper that has any, by id(): the texts of members that are on four in five of its pages."""
    out, todo = {}, [root]
    while todo:
        node = todo.pop()
        if some := _constant_members(node):
            out[id(node)] = some
        todo += node[3]
    return out


def survey(root: list) -> dict[int, tuple[int, int, bool]]:
    """Of each node of a wrapper, by id(): characters that vary and are no links, all characters in links, and whether there is a headline that varies."""
    out: dict[int, tuple[int, int, bool]] = {}

    def look(node: list) -> tuple[int, int, bool]:
        own = 0 if constant(node) else node[5] - node[6]
        below = [look(c) for c in node[3]]
        head = node[0].split(".", 1)[0] == "h1" and not constant(node) or any(h for _, _, h in below)
        out[id(node)] = own + sum(n for n, _, _ in below), node[6] + sum(k for _, k, _ in below), head
        return out[id(node)]

    look(root)
    return out


def _no_content(node: list) -> bool:
    """Whether kind or name of a wrapper's node say nothing but that it is no article text."""
    name, *words = node[0].split(".")
    return name in DROPPED or bool(words) and NOISE.issuperset(words)


def region(root: list) -> list[list]:
    """The way from the root of a wrapper to the node that holds the content of its host, or to the body if nothing below does."""
    known, way, total = survey(root), [root], root[2]
    while True:
        some = [c for c in way[-1][3] if not _no_content(c)]
        open_ = [c for c in some if (c[2] + c[4]) * 2 > total]
        best = max(open_, key=lambda c: known[id(c)][0], default=None)
        if best is None or known[id(best)][0] < MOST * sum(known[id(c)][0] for c in some):
            return way
        if not any(c[0].split(".", 1)[0] in BLOCK for c in best[3]) or any(known[id(c)][2] for c in open_ if c is not best):
            return way
        way.append(best)


def _varying(tops: list[Node], fixed) -> dict[int, int]:
    """Of each element, by id(): the characters of its text that are not constant and in no link, without what its kind drops."""
    out: dict[int, int] = {}

    def look(x: Node, linked: bool) -> int:
        linked = linked or x.name == "a"
        n = 0 if linked or id(x) in fixed else sum(map(len, _own(x)))
        out[id(x)] = n + sum(look(c, linked) for c in x.children if not isinstance(c, str) and not c.silent and not c.noise)
        return out[id(x)]

    for x in tops:
        look(x, False)
    return out


def _behind(x: Node) -> list:
    """What follows an element beside it, text that shows none left out."""
    beside = x.parent.children
    at = next(i for i, c in enumerate(beside) if c is x)
    return [c for c in beside[at + 1 :] if (c.strip() if isinstance(c, str) else not c.silent)]


def _template(tops: list[Node], fixed: dict[int, Node]) -> set[int]:
    """The elements of constant text that are template: not headings and labels of text that varies, nor words within a line that does."""
    vary = _varying(tops, fixed)

    def names_text(x: Node) -> bool:
        """Whether text that varies follows before the next heading of its rank or a higher one; from an element that a heading fills, what follows that."""
        rank = x.name if x.name in HEADINGS else "h7"
        at = x
        while at.parent is not None:
            rest = _behind(at)
            for c in rest:
                if isinstance(c, str):
                    if id(at.parent) not in fixed:
                        return True
                    continue
                if c.name in HEADINGS and c.name <= rank or x.name not in HEADINGS and c.name == x.name and x.name != "th":
                    return False
                if vary.get(id(c), 0) > 0:
                    return True
            if rest:
                return x.name == "th" and at.name in ("th", "tr", "thead") and _names_rows(at)
            at = at.parent
        return False

    def _names_rows(at: Node) -> bool:
        """Whether the table of a row of labels has cells that vary."""
        while at is not None and at.name != "table":
            at = at.parent
        return at is not None and vary.get(id(at), 0) > 0

    def stays(x: Node) -> bool:
        if x.name in LABELS:
            return names_text(x)
        if x.name in BLOCK or x.parent is None:
            return False
        line = x.parent
        while line.parent is not None and line.name not in BLOCK:
            line = line.parent
        if line.name in LABELS and vary.get(id(line), 0) == 0:
            return names_text(line)
        # words of a line: that of an element which holds blocks is no line
        return not any(not isinstance(c, str) and c.name in BLOCK for c in line.children) and vary.get(id(line), 0) > 0

    return {i for i, x in fixed.items() if not stays(x)}


def _led(fixed: dict[int, Node], template: set[int]):
    """Whether the next thing before an element, or before what it fills, is constant text that is template."""

    def led(x: Node) -> bool:
        at = x
        while at.parent is not None:
            beside = at.parent.children
            k = next(i for i, c in enumerate(beside) if c is at)
            before = [c for c in beside[:k] if (c.strip() if isinstance(c, str) else not c.silent)]
            if before:
                last = before[-1]
                while not isinstance(last, str) and id(last) not in fixed and (inner := [c for c in last.children if (c.strip() if isinstance(c, str) else not c.silent)]) and len(inner) == 1 and not isinstance(inner[0], str):
                    last = inner[0]
                return not isinstance(last, str) and id(last) in template
            if id(at.parent) in template and any(isinstance(c, str) and c.strip() for c in at.parent.children):
                return True
            at = at.parent
        return False

    return led


def extract(tree: Node, wrapper: dict | None, min_pages: int = MIN_PAGES) -> str:
    """The article text of a page."""
    template: set[int] = set()  # elements whose own text is template
    links: set[int] = set()  # elements that are menus
    usual: set[int] = set()  # elements that most pages have
    mains: list[Node] = []
    if wrapper and "usable" not in wrapper:
        wrapper["usable"] = usable(wrapper, min_pages)
        wrapper["region"] = region(wrapper["tree"])
        wrapper["known"] = survey(wrapper["tree"])
        wrapper["members"] = constant_members(wrapper["tree"])
        wrapper["shapes"] = _Shapes(wrapper["tree"])
    if wrapper and wrapper["usable"]:
        total, way, known, members = wrapper["tree"][2], wrapper["region"], wrapper["known"], wrapper["members"]
        above = {id(w) for w in way}
        fixed: dict[int, Node] = {}  # elements whose own text is constant
        listed: list[list[Node]] = []  # runs that are made of links
        runs: dict[int, list[list[Node]]] = {}
        shapes = wrapper["shapes"].next_page()

        def align(own: list, run: list[Node], w: list, inside: bool) -> None:
            if w is way[-1]:
                inside = True
                if run[0].name not in ("#", "html", "body"):
                    mains.extend(run)
            if w[2] + w[4] >= min_pages and (w[2] + w[4]) * 2 > total:  # on most pages
                usual.update(id(x) for x in run)
                if inside and constant(w, own[1][0][0]):
                    fixed.update((id(x), x) for x in run if _own(x))
                elif inside and (some := members.get(id(w))):
                    fixed.update((id(x), x) for x in run if (ts := _own(x)) and _short(ts) in some)
                vary, linked, head = known[id(w)]
                if inside and run[0].name in BLOCK and linked and vary * 5 < linked and not head and id(w) not in above:
                    listed.append(run)
            if own[3] and w[3]:
                below = runs[id(own)]
                for i, j in shapes.below(shapes.of(own), shapes.of(w))[1]:
                    align(own[3][i], below[i], w[3][j], inside)

        folded = fold(tree, runs=runs)
        align(folded, [tree], wrapper["tree"], False)
        if fixed:
            template.update(_template(mains or [tree], fixed))
        led = _led(fixed, template)
        links.update(id(x) for run in listed for x in run if not mains or led(x) or any(id(c) in template for c in x.children if not isinstance(c, str) and c.name == "a"))
    sized: dict[int, tuple[int, int, bool, bool]] = {}

    def size(x: Node) -> tuple[int, int, bool, bool]:
        """Characters, those in links, and whether there is a heading or an article, main or h1 in the element; without what its kind drops."""
        if id(x) not in sized:
            n, linked = sum(map(len, _own(x))), 0
            head, held = x.name in HEADINGS, x.name in MAIN or x.name == "h1"
            for c in x.children:
                if not isinstance(c, str) and not c.silent and not c.noise:
                    m, k, h, e = size(c)
                    n, linked, head, held = n + m, linked + k, head or h, held or e
            sized[id(x)] = n, n if x.name == "a" else linked, head, held
        return sized[id(x)]

    def drops(x: Node) -> bool:
        if x.silent or x.noise or id(x) in links:
            return True
        if not x.named:
            return False
        n, linked, head, held = size(x)
        if held or n > SMALL and n * 2 >= size(tree)[0]:
            return False
        if n and linked * 2 >= n and (x.named == 2 or x.name in BLOCK):  # an inline link in a sentence is all link
            return True
        return x.named == 2 and (n <= SMALL and not head or id(x) in usual)

    def find(strict: bool) -> list[Node]:
        out, todo = [], deque([tree])
        while todo:
            x = todo.popleft()
            if x.silent or x.noise and (strict or x.name != "form") or strict and x.named == 2:
                continue
            if x.name in MAIN:
                out.append(x)
            else:
                todo += [c for c in x.children if not isinstance(c, str)]
        return out

    # an article inside a sidebar is the page's only if there is no other
    mains = mains or find(True) or find(False)
    blocks: list[list[str]] = [[]]

    def walk(x: Node) -> None:
        if drops(x) or x.label == "header" and not within_main:
            return
        block = x.name in BLOCK
        if block:
            blocks.append([])
        for c in x.children:
            if isinstance(c, str):
                if id(x) not in template:
                    blocks[-1].append(c)
            else:
                walk(c)
        if block:
            blocks.append([])
        elif x.name == "br":
            blocks[-1].append(" ")

    within_main = bool(mains)
    for m in mains or [tree]:
        walk(m)
        blocks.append([])
    out = (" ".join(html_lib.unescape("".join(b)).split()) for b in blocks if b)
    return "\n".join(x for x in out if x)


def runs_of(nodes: list[Node]) -> list[list[Node]]:
    """Runs of like siblings among the children of a run of nodes, without those that show no text."""
    runs: list[list[Node]] = []
    last = None
    for x in nodes:
        for c in x.children:
            if isinstance(c, str) or c.silent:
                continue
            if c.label == last:
                runs[-1].append(c)
            else:
                runs.append([c])
                last = c.label
    return runs


def _host(df: DataFrame, id_col: str, url_col: str, html_col: str) -> DataFrame:
    host = F.lower(F.coalesce(F.regexp_extract(F.col(f"`{url_col}`"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1), F.lit("")))
    return df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").alias("url"), host.alias("host"), F.coalesce(F.col(f"`{html_col}`"), F.lit("")).alias("html"))


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper, n): one JSON wrapper for each host of pages (host, html), and the number of its pages."""

    def partial(batches):
        held: dict[str, dict] = {}
        tags: dict[str, Tag] = {}
        seen = 0
        text = lambda x: json.dumps(x, separators=(",", ":"))
        rows = lambda: pd.DataFrame({"host": list(held), "part": [x["pages"][0][0] % SHARD for x in held.values()], "wrapper": [text(x) for x in held.values()]})
        for pdf in batches:
            for host, page in zip(pdf["host"], pdf["html"], strict=True):
                own = wrapper_of(page, parse(page, tags), held.get(host))
                held[host] = merged(held[host], own) if host in held else own
                seen += len(page)
                if len(held) >= 2000 or seen >= HELD:  # memory stays bounded; what is let go is merged later
                    yield rows()
                    held, seen = {}, 0
        if held:
            yield rows()

    def joined(pdf: pd.DataFrame, last: bool) -> pd.DataFrame:
        out = None
        for x in sorted(pdf["wrapper"]):
            out = merged(out, json.loads(x)) if out else json.loads(x)
        n = out["tree"][2]
        if last:
            out["tree"] = _settled(out["tree"])
        return pd.DataFrame({"host": pdf["host"].iloc[:1], "wrapper": [json.dumps(out, separators=(",", ":"))], "n": [n]})

    parts = pages.select("host", "html").mapInPandas(partial, "host string, part int, wrapper string")
    some = parts.groupBy("host", "part").applyInPandas(lambda pdf: joined(pdf, False), "host string, wrapper string, n long")
    return some.groupBy("host").applyInPandas(lambda pdf: joined(pdf, True), "host string, wrapper string, n long")


def extract_pages(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_pages: int = MIN_PAGES) -> DataFrame:
    """A row for each page: id, url, text, n_chars."""
    spark = pages.sparkSession
    keyed = _host(pages, id_col, url_col, html_col)
    wrappers = written(induce(keyed), "wrappers")
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    kind = pages.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, url string, text string, n_chars long"

    def texts(pdf: pd.DataFrame, wrapper, tags: dict[str, Tag]) -> pd.DataFrame:
        out = [extract(parse(x, tags), w, min_pages) if x else "" for x, w in zip(pdf["html"], wrapper, strict=True)]
        return pd.DataFrame({"id": pdf["id"], "url": pdf["url"], "text": out, "n_chars": [len(x) for x in out]})

    if size <= SENT_BYTES:
        sent = spark.sparkContext.broadcast({r["host"]: r["wrapper"] for r in wrappers.toLocalIterator()})

        def run(batches):
            known, tags = {}, {}
            for pdf in batches:
                for h in set(pdf["host"]) - known.keys():
                    known[h] = json.loads(sent.value[h]) if h in sent.value else None
                yield texts(pdf, [known[h] for h in pdf["host"]], tags)

        out = keyed.mapInPandas(run, schema)
    else:
        # a large host's pages spread over shards, its wrapper goes to each of them
        shards = F.least(F.lit(SHARD), F.ceil(F.col("n") / SHARED)).cast("int")
        large = wrappers.where(F.col("n") > SHARED).select("host", shards.alias("shards"))
        if large.count() <= MANY:
            large = F.broadcast(large)
        dealt = keyed.join(large, "host", "left").withColumn("part", F.pmod(F.xxhash64("html"), F.coalesce("shards", F.lit(1)).cast("long"))).drop("shards")
        copies = wrappers.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), shards.cast("long") - 1))).drop("n")

        def run(batches):
            last, known, tags = None, None, {}
            for pdf in batches:
                found = []
                for w in pdf["wrapper"]:
                    if w != last:
                        last, known = w, json.loads(w) if w else None
                    found.append(known)
                yield texts(pdf, found, tags)

        out = dealt.join(copies, ["host", "part"], "left").drop("part").mapInPandas(run, schema)
    return out.withColumnRenamed("id", id_col)


def op4_html_extraction(spark, sf_dir):
    return extract_pages(table(spark, sf_dir, "pages"))

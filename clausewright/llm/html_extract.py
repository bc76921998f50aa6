"""HTML extraction by wrapper induction.

Pages of one host are aligned by simple tree matching (Yang, 1991), and what the aligned
pages have in common decides where each page's content stands:

1. ``skeletons`` reads every page once: the tree of its block elements as a short text, the
   shape, in which a row of like siblings is one node, and, for every node and place in a
   row, a checksum and the length of its text, links apart. Equal pages of a host count once.
2. The commonest shape of a host is its reference. Every other shape is matched with it, in
   any task and any order; a node takes the key of the reference node that it matches, or
   one made of its parent's key and its name.
3. Per host and key, checksums and lengths add up as grouped sums, combined before the
   shuffle. A place whose text was the same in ``PAGES`` pages or more, and in at least half
   of the host's pages, is template. The varying text outside links is mass.
4. The content region is found by descending from the root into the slot with two thirds
   of all mass or more, until no single slot has it or it is a text of its own. A node with a varying
   heading of its own is not descended below, and the descent ends where it would leave more
   than a tenth of all mass behind. Slots beside the way down join the region where they hold
   ``LONG`` characters or more of varying text a page, more of it outside links than in them,
   unless they are set apart (``apart``); right below the body they need a twentieth of its
   mass as well.
5. Every page is matched with its host's reference and gives the text of its region, without
   template, and without slots that half of the pages have and that hold nearly only links.

Names of elements serve the matching and no element is content or template by its name or
class as such; only what HTML itself keeps apart within an article (``LEFT``), and slots in
the region whose class names one of ``MARKS``, stay out of it. Where the region is the whole
body, slots that every page fills with little text stay out as well.

Hosts with fewer than ``PAGES`` different pages are matched with the commonest shape of all
pages, and decided by the sums over all pages. A page without a node that matches the region
is decided by its own lengths. ``template`` says which it was: host, all or page. A page
whose whole region would be template keeps its text: it is a copy and no template.

Text is decoded, white space within a block becomes one space, and blocks are joined by
line breaks. A line break element counts as white space.

Defined results: null and empty html give an empty text; a page whose url has no host is
aligned with its like; repeated rows give repeated rows; unclosed elements end with what
holds them, and a tag that never ends takes the rest of the page, as in a browser; depth and
length have no bound, and reading takes time in proportion to length; an empty table gives
an empty table; other columns are ignored. Every match is the largest, whatever the size of
the trees: rows of children whose numbers multiply to more than ``PAIRS``, or their nodes to more
than ``WORK``, are aligned as arrays, with the same match. The time of a match grows with the pairs
of nodes of one depth, where the trees differ. Results depend on neither
order nor partitioning.
"""

from __future__ import annotations

import html
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .spark_io import written
from .url_filter import host

PAGES = 8
#: Above the first two, matches are computed with arrays, and scores of subtrees above the third are kept; no result depends on them.
PAIRS = 40_000
WORK = 2_000_000
LARGE = 1000
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
#: Elements that hold no text of the page.
DROP = frozenset("button canvas embed head iframe input label map noscript object option script select style svg template textarea title".split())
#: Elements that HTML keeps apart from the article that holds them.
LEFT = frozenset("aside dialog fieldset footer form menu nav".split())
#: Names in class, id or role of slots within an article that are not part of it. A name counts if all its words are among these or among PARTS: `comments-list` does, `share-of-market` does not.
MARKS = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus newsletter notice notices popup promo promotion related share sharing sidebar social sponsor sponsored subscribe widget".split())
PARTS = frozenset("area bar block body bottom box buttons container content count footer form group header item items label left links list main panel posts right section slot text title top wrap wrapper".split())
#: Names of slots that stand around an article; they count only beside the region.
FRAME = frozenset("copyright discussion header imprint legal masthead menu nav navbar navigation replies responses topbar".split())
#: Characters of varying text a page that make a slot beside the region part of it.
LONG = 80
WIDE = frozenset(("#", "html", "body"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_SELF_CLOSING = frozenset("li dd dt td th tr option".split())
_TAG = re.compile(r"<!--(?:.*?-->|.*\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)([^>=]*+(?:=\s*+(?:\"[^\"]*+(?:\"|\Z)|'[^']*+(?:'|\Z)|)[^>=]*+)*+)(?:>|\Z)", re.DOTALL)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_END = {t: re.compile(f"</{t}(?=[\\s/>]|\\Z)", re.IGNORECASE) for t in RAW}


class Page:
    """The block elements of a page in the order of their start tags; each has its text items and children in order."""

    __slots__ = ("tag", "marks", "out", "parent", "items", "links", "marked")

    def __init__(self):
        self.tag, self.marks, self.out, self.parent, self.items, self.links = [], [], [], [], [], []
        self.marked: set[int] = set()

    def add(self, tag: str, marks: tuple, out: bool, parent: int) -> int:
        i = len(self.tag)
        self.tag.append(tag)
        self.marks.append(marks)
        self.out.append(out or (parent >= 0 and self.out[parent]))
        self.parent.append(parent)
        self.items.append([])
        self.links.append(0)
        if parent >= 0:
            self.items[parent].append(i)
        return i

    def own(self, i: int) -> str:
        return " ".join("".join([x for x in self.items[i] if x.__class__ is str]).split())


def marked(names: str) -> bool:
    """Whether one of the names of an attribute is that of a slot that is not part of an article."""
    parts = (set(re.findall(r"[a-z]+", name)) for name in names.split())
    return any(not MARKS.isdisjoint(p) and p <= MARKS | PARTS for p in parts)


def apart(tag: str, words: Iterable[str]) -> bool:
    """Whether a slot beside the region is no part of the text, by its tag or the words of its names."""
    parts = set(words)
    return tag in LEFT or tag == "header" or (not parts.isdisjoint(FRAME | MARKS | {"footer"}) and parts <= FRAME | MARKS | PARTS)


def attributes(attrs: str) -> tuple[tuple, bool, bool]:
    """(words of class, id and role; whether the element is hidden; whether one of its names is marked)."""
    words, hidden, mark = set(), False, False
    for name, a, b, c in _ATTR.findall(attrs):
        name, value = name.lower(), a or b or c
        if name in ("class", "id", "role"):
            words.update(re.findall(r"[a-z]+", value.lower()))
            mark = mark or marked(value.lower())
        elif name == "hidden" or (name == "aria-hidden" and "true" in value) or (name == "style" and "display:none" in value.replace(" ", "").lower()):
            hidden = True
    return tuple(sorted(words)), hidden, mark


def parse(page: str) -> Page:
    """The block tree; text items are strings, still encoded. Every character is read a bounded number of times."""
    doc = Page()
    at, link = 0, False
    # the open elements: [node, nearest block at or below in the stack], and for each tag its places in the stack
    stack, places = [(doc.add("#", (), False, -1), 0)], {}

    def close(down_to: int) -> None:
        while len(stack) > down_to:
            places[doc.tag[stack.pop()[0]]].pop()

    def put(text: str) -> None:
        i = stack[-1][0]
        if not doc.out[i]:
            doc.items[i].append(text)
            if link:
                doc.links[i] += len(text)

    while (m := _TAG.search(page, at)) is not None:
        if m.start() > at:
            put(page[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "a":
                link = False
            elif own := places.get(tag):
                if tag in BLOCK or stack[-1][1] < own[-1]:  # an inline end tag closes nothing outside its block
                    close(own[-1])
                    link = False
            continue
        if tag in RAW:
            end = _END[tag].search(page, at)
            at = end.start() if end else len(page)
            continue
        if tag in ("br", "wbr"):
            put(" " if tag == "br" else "")
            continue
        attrs = m[3]
        if tag == "a":
            link = not attrs.endswith("/")
        words, hidden, mark = attributes(attrs) if attrs and not attrs.isspace() and any(x in attrs.lower() for x in ("class", "id", "role", "style")) else ((), False, False)
        block = tag in BLOCK
        if not (block or tag in DROP or hidden or (tag != "a" and mark)) or (tag in VOID and not block):
            continue
        if block:
            near = doc.tag[stack[stack[-1][1]][0]]
            if near == "p" or (near == tag and tag in _SELF_CLOSING):
                close(stack[-1][1])
            link = False
        node = doc.add(tag, words, hidden or tag in DROP, stack[-1][0])
        if mark:
            doc.marked.add(node)
        if tag in VOID or attrs.endswith("/"):
            continue
        places.setdefault(tag, []).append(len(stack))
        stack.append((node, len(stack) if block else stack[-1][1]))
    if at < len(page):
        put(page[at:])
    return doc


class Shape:
    """A tree of names, read from its text; ``kind`` tells equal subtrees, over all trees read with one ``known``."""

    __slots__ = ("name", "tag", "kids", "size", "kind")

    def __init__(self, text: str, known: dict):
        self.name, self.kids, parent = [], [], []
        stack: list[int] = []
        for word, mark in re.findall(r"([^(),]*)([(),]|\Z)", text):
            if word:
                i = len(self.name)
                self.name.append(word)
                self.kids.append([])
                parent.append(stack[-1] if stack else -1)
                if stack:
                    self.kids[stack[-1]].append(i)
            if mark == "(":
                stack.append(i)
            elif mark == ")":
                stack.pop()
        self.tag = [n.split(".", 1)[0].rstrip("*") for n in self.name]
        self.size, self.kind = [1] * len(self.name), [0] * len(self.name)
        for i in range(len(self.name) - 1, -1, -1):
            for k in self.kids[i]:
                self.size[i] += self.size[k]
            key = (self.name[i], *(self.kind[k] for k in self.kids[i]))
            self.kind[i] = known.setdefault(key, len(known))


def collapse(doc: Page) -> tuple[str, list[list[int]]]:
    """(shape, for every node of it the elements that it stands for).

    A row of siblings of one name without block children is one node, however long; a row of
    two or more larger siblings of one kind is one starred node; elements outside the text are left out.
    """
    n = len(doc.tag)
    kids: list[list[int]] = [[] for _ in range(n)]
    for i in range(1, n):
        if not doc.out[i]:
            kids[doc.parent[i]].append(i)
    name = [re.sub(r"[^a-z0-9#.]", "_", ".".join((t, *w))) for t, w in zip(doc.tag, doc.marks, strict=True)]
    kind, known = [0] * n, {}
    rows: list[list[list[int]]] = [[] for _ in range(n)]
    for i in range(n - 1, -1, -1):
        if doc.out[i]:
            continue
        for k in kids[i]:
            if rows[i] and kind[rows[i][-1][0]] == kind[k]:
                rows[i][-1].append(k)
            else:
                rows[i].append([k])
        key = (name[i], *((kind[r[0]], len(r) > 1 and bool(rows[r[0]])) for r in rows[i]))
        kind[i] = known.setdefault(key, len(known))
    out, nodes = [], []
    todo: list = [[0]]
    while todo:
        row = todo.pop()
        if row.__class__ is str:
            out.append(row)
            continue
        i = row[0]
        nodes.append(row)
        if len(row) > 1 and rows[i]:
            out.append(name[i] + "*")
        elif rows[i]:
            out.append(name[i] + "(")
            todo.append(")")
            for k, r in enumerate(reversed(rows[i])):
                if k:
                    todo.append(",")
                todo.append(r)
        else:
            out.append(name[i])
    return "".join(out), nodes


def texts(doc: Page, nodes: list[list[int]]) -> Iterator[tuple[int, int, int, int, int]]:
    """(node, place in its row, checksum, characters outside links, characters in links) of every text."""
    ends = None
    for k, row in enumerate(nodes):
        for place, i in enumerate(row):
            if len(row) > 1 and any(x.__class__ is int for x in doc.items[i]):  # the whole text of one of like siblings
                if ends is None:
                    ends = list(range(1, len(doc.tag) + 1))
                    for j in range(len(doc.tag) - 1, 0, -1):
                        ends[doc.parent[j]] = max(ends[doc.parent[j]], ends[j])
                text = " ".join(x for x in map(doc.own, range(i, ends[i])) if x)
                links = sum(doc.links[i : ends[i]])
            else:
                text, links = doc.own(i), doc.links[i]
            if text:
                links = min(links, len(text))
                yield k, place, zlib.crc32(text.encode("utf-8", "surrogatepass")), len(text) - links, links


class Levels:
    """The forest of the nodes ``top`` of ``y`` level by level, to be matched with one node of ``x`` after the other.

    A score counts ``unit`` for a pair of nodes and one more where their names are equal.
    """

    def __init__(self, x: Shape, y: Shape, top: list[int], unit: int, saved: dict):
        """``saved``: for large nodes of ``x``, their scores with a level, and the places of its nodes; for all forests of one match."""
        self.x, self.y, self.unit, self.most, self.saved = x, y, unit, (unit + 1) * unit, saved
        self.tags, self.names = {}, {}  # numbers of the words of ``y``
        self.nodes, self.levels, self.held = [top], [], {}

    def level(self, depth: int) -> tuple:
        while len(self.levels) <= depth:
            y, top = self.y, self.nodes[-1]
            tags = np.array([self.tags.setdefault(y.tag[j], len(self.tags)) for j in top])
            names = np.array([self.names.setdefault(y.name[j], len(self.names)) for j in top])
            n = np.array([len(y.kids[j]) for j in top])
            ends, filled = np.cumsum(n), np.flatnonzero(n)
            self.levels.append((tags, set(tags.tolist()), names, filled, ends[filled] - 1, (ends - n)[filled], np.repeat(np.arange(len(top)) * self.most, n), {j: p for p, j in enumerate(top)}))
            self.nodes.append([m for j in top for m in y.kids[j]])
        return self.levels[depth]

    def scores(self, node: int) -> np.ndarray:
        """The score of ``node`` of ``x`` with every node of the first level."""
        if (known := self.held.get(self.x.kind[node])) is not None:
            return known
        if node in self.saved:
            (place, scores), top = self.saved[node], self.nodes[0]
            at, end = place.get(top[0], -1), place.get(top[-1], -1) + 1
            if at >= 0 and end - at == len(top):  # a level's nodes stand in order, so these are all of them
                return scores[at:end]
            del self.saved[node]  # of another forest
        x, done = self.x, None
        # the open nodes: [node, number of its kids that are done, best scores of those with the kids of each node of the level up to the one at hand]
        stack: list[list] = [[node, 0, None]]
        while stack:
            i, n, best = top = stack[-1]
            tags, there, names, filled, last, first, apart_by, place = self.level(len(stack) - 1)
            tag = self.tags.get(x.tag[i])
            if n and done is not None:
                moved = np.empty_like(best)
                moved[1:], moved[first] = best[:-1], 0
                moved += done
                np.maximum(moved, best, out=moved)
                moved += apart_by  # so that each node's kids are above those of the nodes before
                np.maximum.accumulate(moved, out=moved)
                moved -= apart_by
                top[2] = best = moved
            if tag in there and len(filled) and n < len(x.kids[i]):
                if n == 0:
                    top[2] = np.zeros(len(apart_by), np.int64)
                top[1] += 1
                stack.append([x.kids[i][n], 0, None])
                continue
            if tag in there:
                done = np.full(len(tags), self.unit, np.int64)
                done[names == self.names.get(x.name[i], -1)] += 1
                if best is not None:
                    done[filled] += best[last]
                done[tags != tag] = 0
                if x.size[i] > LARGE:
                    self.saved.setdefault(i, (place, done))
            else:
                done = None
            stack.pop()
        out = np.zeros(len(self.nodes[0]), np.int64) if done is None else done
        if len(self.held) < 64:
            self.held[x.kind[node]] = out
        return out

    def align(self, row: list[int]) -> tuple[int, list[tuple[int, int]]]:
        """The largest order-keeping match of ``row`` with the first level: its score and its pairs of places, last first.

        Every ``step``-th line of the table of best scores is kept; the lines between are computed again on the way back.
        """

        def line(best: np.ndarray, node: int) -> np.ndarray:
            new = best.copy()
            np.maximum(new[1:], best[:-1] + self.scores(node)[: len(best) - 1], out=new[1:])
            return np.maximum.accumulate(new, out=new)

        best = np.zeros(len(self.nodes[0]) + 1, np.int64)
        step, kept = isqrt(len(row)) + 1, []
        for p, node in enumerate(row):
            if p % step == 0:
                kept.append(best)
            best = line(best, node)
        total, pairs, q = int(best[-1]), [], len(best) - 1
        for start in range(len(kept) - 1, -1, -1):
            lines = [kept.pop()[: q + 1]]
            for node in row[start * step : (start + 1) * step]:
                lines.append(line(lines[-1], node))
            p = len(lines) - 1
            while p and q:
                if lines[p][q] == lines[p - 1][q]:
                    p -= 1
                elif lines[p][q] == lines[p][q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    pairs.append((start * step + p, q))
        return total, pairs


def matching(x: Shape, y: Shape) -> tuple[int, dict[int, int]]:
    """Simple tree matching: the number of nodes in the largest order-keeping match of two trees, and the match.

    Nodes match by tag. Among matches of one size, those with more equal names win: a pair
    counts one more than there can be pairs, and one more where the names are equal.
    """
    unit = min(len(x.name), len(y.name)) + 1
    score: dict[tuple[int, int], int] = {}
    saved: dict[int, tuple[dict, np.ndarray]] = {}

    def base(i: int, j: int) -> int:
        return unit + (x.name[i] == y.name[j])

    def middle(i: int, j: int) -> tuple[list[int], list[int], int, int]:
        """The children without those at either end that are equal."""
        a, b = x.kids[i], y.kids[j]
        lo, hi = 0, 0
        while lo < min(len(a), len(b)) and x.kind[a[lo]] == y.kind[b[lo]]:
            lo += 1
        while hi < min(len(a), len(b)) - lo and x.kind[a[-1 - hi]] == y.kind[b[-1 - hi]]:
            hi += 1
        return a[lo : len(a) - hi], b[lo : len(b) - hi], lo, hi

    def value(i: int, j: int) -> int | None:
        if x.tag[i] != y.tag[j]:
            return 0
        if x.kind[i] == y.kind[j]:
            return (unit + 1) * x.size[i]
        if not x.kids[i] or not y.kids[j]:
            return base(i, j)
        return score.get((x.kind[i], y.kind[j]))

    def large(a: list[int], b: list[int]) -> bool:
        return len(a) * len(b) > PAIRS or sum(x.size[k] for k in a) * sum(y.size[m] for m in b) > WORK

    def rows(i: int, j: int) -> tuple[int, list[tuple[int, int]]]:
        a, b, lo, hi = middle(i, j)
        ends = [(p, p) for p in range(lo)] + [(len(x.kids[i]) - 1 - p, len(y.kids[j]) - 1 - p) for p in range(hi)]
        total = sum((unit + 1) * x.size[x.kids[i][p]] for p, _ in ends)
        if not a or not b:
            return total, ends
        if large(a, b):
            best, pairs = Levels(x, y, b, unit, saved).align(a)
            return total + best, ends + [(lo + p, lo + q) for p, q in pairs]
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for p, k in enumerate(a):
            for q, m in enumerate(b):
                best[p + 1][q + 1] = max(best[p][q + 1], best[p + 1][q], best[p][q] + value(k, m))
        pairs, p, q = [], len(a), len(b)
        while p and q:
            if best[p][q] == best[p - 1][q]:
                p -= 1
            elif best[p][q] == best[p][q - 1]:
                q -= 1
            else:
                p, q = p - 1, q - 1
                pairs.append((p, q))
        return total + best[-1][-1], ends + [(lo + p, lo + q) for p, q in pairs]

    def fill(i: int, j: int) -> None:
        """The scores that ``rows`` of the two nodes needs."""
        todo = [(i, j)]
        while todo:
            i, j = todo[-1]
            if value(i, j) is None:
                a, b, _, _ = middle(i, j)
                if not large(a, b) and (need := [(k, m) for k in a for m in b if value(k, m) is None]):
                    todo += need
                    continue
                score[x.kind[i], y.kind[j]] = base(i, j) + rows(i, j)[0]
            todo.pop()

    if x.tag[0] != y.tag[0]:
        return 0, {}
    found, todo = {}, [(0, 0)]
    while todo:
        i, j = todo.pop()
        found[i] = j
        if x.kind[i] == y.kind[j]:
            todo += zip(x.kids[i], y.kids[j], strict=True)
        elif x.kids[i] and y.kids[j]:
            if not large(*middle(i, j)[:2]):
                fill(i, j)
            todo += [(x.kids[i][p], y.kids[j][q]) for p, q in rows(i, j)[1] if x.tag[x.kids[i][p]] == y.tag[y.kids[j][q]]]
    return len(found), found


def keys(x: Shape, y: Shape) -> tuple[list[int], list[int]]:
    """For every node of ``x``: its key, and the node of the reference ``y`` that it matches or stands below.

    The key is the matching node's number, or below zero a hash of the parent's key, the name and its number among such siblings.
    """
    found = matching(x, y)[1]
    key, anchor = [0] * len(x.name), [0] * len(x.name)
    for i in range(len(x.name)):
        if i in found:
            key[i] = anchor[i] = found[i]
        elif i == 0:
            key[i] = -1
        seen: dict[str, int] = {}
        for k in x.kids[i]:
            if k not in found:
                c = seen[x.name[k]] = seen.get(x.name[k], 0) + 1
                word = f"{key[i]}/{x.name[k]}/{c}".encode()
                key[k], anchor[k] = -1 - ((zlib.crc32(word) << 31) | (zlib.crc32(word[::-1]) >> 1)), anchor[i]
    return key, anchor


class Wrapper:
    """What the aligned pages of a site say: its reference, the content region, constant texts and menus."""

    def __init__(self, shape: str, pages: int, rows: list, known: dict):
        """``rows``: (anchor, key or None, pages, characters outside links and in links that vary, [[place, checksum] of constant texts])."""
        self.shape = y = Shape(shape, known)
        self.constant = {(key, place): crc for _, key, _, _, _, same in rows for place, crc in same or () if key is not None}
        own, links, seen = ([0] * len(y.name) for _ in range(3))
        for anchor, key, n, chars, link, _ in rows:
            own[anchor] += chars
            links[anchor] += link
            if key == anchor:
                seen[anchor] = n
        mass, link_mass, reach = own[:], links[:], seen[:]
        for i in range(len(y.name) - 1, -1, -1):
            for k in y.kids[i]:
                mass[i] += mass[k]
                link_mass[i] += link_mass[k]
                reach[i] = max(reach[i], reach[k])
        at, lost = 0, 0
        self.path, self.beside = set(), set()
        while y.kids[at]:
            best = max(y.kids[at], key=lambda k: (mass[k], -k))
            if not y.kids[best] or 3 * mass[best] < 2 * mass[0] or not mass[best] or own[at] > mass[best]:
                break
            if any(y.tag[k] in HEADINGS and mass[k] for k in y.kids[at]):
                break
            others = [k for k in y.kids[at] if k != best and mass[k] >= link_mass[k] and mass[k] and not apart(y.tag[k], y.name[k].rstrip("*").split(".")[1:])]
            beside = {k for k in others if mass[k] >= LONG * max(1, reach[k]) and (y.tag[at] not in WIDE or 20 * mass[k] >= mass[at])}
            lost += sum(mass[k] for k in others if k not in beside)
            if 10 * lost > mass[0]:
                break
            self.path.add(at)
            self.beside |= beside
            at = best
        self.region = at
        wide, self.left = y.tag[at] in WIDE, set()
        for i in range(len(y.name)):
            if pages >= PAGES and 2 * reach[i] >= pages and link_mass[i] > 4 * mass[i]:
                self.left.add(i)
        if wide and pages >= PAGES:
            self.left.update(k for k in y.kids[at] if y.tag[k] not in HEADINGS and 10 * reach[k] >= 9 * pages and 20 * mass[k] < mass[at])
        self.left.discard(at)


class Wrappers:
    """The wrappers and matches that a task has met; all are forgotten when they pass ``most``."""

    def __init__(self, most: int = 5000):
        self.most, self.known, self.shapes, self.matches, self.wrappers = most, {}, {}, {}, {}

    def trim(self) -> None:
        if max(len(self.shapes), len(self.matches), len(self.wrappers)) > self.most or len(self.known) > 100 * self.most:
            self.__init__(self.most)

    def shape(self, text: str) -> Shape:
        if text not in self.shapes:
            self.shapes[text] = Shape(text, self.known)
        return self.shapes[text]

    def keys(self, shape: str, reference: str) -> tuple[list[int], list[int]]:
        if (shape, reference) not in self.matches:
            self.matches[shape, reference] = keys(self.shape(shape), self.shape(reference))
        return self.matches[shape, reference]

    def wrapper(self, template: str) -> tuple[str, Wrapper]:
        """From JSON: [reference, pages, rows]."""
        if template not in self.wrappers:
            x = json.loads(template)
            rows = [(r["anchor"], r.get("key"), r["n"], r["chars"], r["links"], [(c["place"], c["crc"]) for c in r.get("same") or ()]) for r in x["rows"]]
            self.wrappers[template] = (x["shape"], Wrapper(x["shape"], x["pages"], rows, self.known))
        return self.wrappers[template]


def main_text(page: str, template: str | None = None, memory: Wrappers | None = None, site: str = "host") -> tuple[str, str]:
    """(the text of the page's region, what decided it: ``site`` or page)."""
    memory = memory or Wrappers()
    memory.trim()
    doc = parse(page)
    shape, nodes = collapse(doc)
    wrapper = None
    if template is not None:
        reference, wrapper = memory.wrapper(template)
        key = memory.keys(shape, reference)[0]
    if wrapper is None or wrapper.region not in key:
        sums: dict[int, list[int]] = {}
        for k, _, _, chars, links in texts(doc, nodes):
            s = sums.setdefault(k, [0, 0])
            s[0] += chars
            s[1] += links
        wrapper, site = Wrapper(shape, 1, [(k, k, 1, *s, None) for k, s in sums.items()], memory.known), "page"
        key = list(range(len(nodes)))
    top = nodes[key.index(wrapper.region)]
    more = _beside(doc, nodes, key, wrapper)
    left: set[int] = set()
    same: set[int] = set()
    for k, row in enumerate(nodes):
        if key[k] in wrapper.left:
            left.update(row)
    if wrapper.constant:
        for k, place, crc, _, _ in texts(doc, nodes):
            if wrapper.constant.get((key[k], place)) == crc:
                same.add(nodes[k][place])
    starred = {i for row in nodes if len(row) > 1 for i in row}
    if more and same and not _blocks(doc, top, left, same, starred):
        same = set()
    every = sorted([*top, *more])
    return _blocks(doc, every, left, same, starred) or _blocks(doc, every, left, set(), starred), site


def _beside(doc: Page, nodes: list[list[int]], key: list[int], wrapper: Wrapper) -> list[int]:
    """The elements beside the region that are part of the text: slots that the site's pages fill, and slots of this page alone by its own lengths."""
    way = {i for k, row in enumerate(nodes) if key[k] in wrapper.path for i in row}
    rows = [(k, row) for k, row in enumerate(nodes) if doc.parent[row[0]] in way and key[k] not in wrapper.path and key[k] != wrapper.region]
    rows = [(k, row) for k, row in rows if (key[k] in wrapper.beside or key[k] < 0) and not apart(doc.tag[row[0]], doc.marks[row[0]]) and row[0] not in doc.marked]
    if not rows:
        return []
    alone = {k for k, _ in rows if key[k] < 0}
    if alone:
        upper = [-1] * len(doc.tag)  # the row beside the region, or the region, that an element is below
        top = {i: -2 for i in nodes[key.index(wrapper.region)]} | {i: k for k, row in rows for i in row}
        chars, links = {}, {}
        for i in range(len(doc.tag)):
            upper[i] = top.get(i, upper[doc.parent[i]] if i else -1)
            chars[upper[i]] = chars.get(upper[i], 0) + len(doc.own(i))
            links[upper[i]] = links.get(upper[i], 0) + doc.links[i]
        plain = lambda k: chars.get(k, 0) - min(links.get(k, 0), chars.get(k, 0))
        least = lambda k, row: 20 * plain(k) >= plain(-2) or doc.tag[doc.parent[row[0]]] not in WIDE
        rows = [(k, row) for k, row in rows if k not in alone or (plain(k) >= LONG and 2 * plain(k) >= chars[k] and least(k, row))]
    return [i for _, row in rows for i in row]


def _blocks(doc: Page, top: list[int], left: set[int], same: set[int], starred: set[int]) -> str:
    blocks: list[str] = []
    held: list[str] = []

    def close() -> None:
        text = " ".join("".join(held).split())
        if text:
            blocks.append(text)
        held.clear()

    for t in top:
        todo: list = [t]
        while todo:
            x = todo.pop()
            if x.__class__ is str:
                held.append(html.unescape(x))  # each by itself: a tag or comment ends a reference
            elif x is None:
                close()
            elif not (doc.out[x] or x in left or (x != t and (doc.tag[x] in LEFT or x in doc.marked)) or (x in same and x in starred)):
                block = doc.tag[x] in BLOCK
                if block:
                    close()
                    todo.append(None)
                todo += [y for y in reversed(doc.items[x]) if x not in same or y.__class__ is int]
        close()
    return "\n".join(blocks)


def skeletons(pages: DataFrame) -> DataFrame:
    """(host, page, shape, node, place, crc, chars, links) from (host, page, html): one row per page, with arrays over its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shapes, rows, upto = [], [], [0]
            for page in b.column("html").to_pylist():
                doc = parse(page)
                shape, nodes = collapse(doc)
                shapes.append(shape)
                rows += texts(doc, nodes)
                upto.append(len(rows))
            flat = np.array(rows, np.int64).reshape(-1, 5).T
            at = pa.array(upto, pa.int32())
            lists = [pa.ListArray.from_arrays(at, pa.array(x, kind)) for x, kind in zip(flat, (pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32()), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("host"), b.column("page"), pa.array(shapes, pa.string()), *lists], ["host", "page", "shape", "node", "place", "crc", "chars", "links"])

    return pages.mapInArrow(run, "host string, page long, shape string, node array<int>, place array<int>, crc array<long>, chars array<int>, links array<int>")


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums per site, anchor, key and place over the skeletons of a task, a bounded number at a time."""
    memory = Wrappers()
    held: dict[tuple, list[int]] = {}

    def rows() -> pa.RecordBatch:
        site, anchor, key, place = zip(*held, strict=True)
        sums = np.array(list(held.values()), np.int64).T
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32()]
        out = pa.RecordBatch.from_arrays([*(pa.array(x, k) for x, k in zip((site, anchor, key, place), kinds, strict=True)), *map(pa.array, sums)], ["site", "anchor", "key", "place", "n", "low", "high", "chars", "links"])
        held.clear()
        return out

    for b in batches:
        for site, reference, shape, *lists in zip(*(b.column(c).to_pylist() for c in ("site", "reference", "shape", "node", "place", "crc", "chars", "links")), strict=True):
            memory.trim()
            key, anchor = memory.keys(shape, reference)
            for node, place, crc, chars, links in zip(*lists, strict=True):
                k = (site, anchor[node], key[node], place)
                if (s := held.get(k)) is None:
                    held[k] = [1, crc, crc, chars, links]
                else:
                    s[0] += 1
                    s[1] = min(s[1], crc)
                    s[2] = max(s[2], crc)
                    s[3] += chars
                    s[4] += links
            if len(held) > 200_000:
                yield rows()
    if held:
        yield rows()


def templates(pages: DataFrame) -> DataFrame:
    """(site, template) from (host, html): one row for every host of ``PAGES`` different pages, ``h:`` and the host, and ``*`` for all pages where other hosts exist."""
    some = pages.where("html <> ''").select("host", F.xxhash64("html").alias("page"), "html")
    every = written(skeletons(some).dropDuplicates(["host", "page"]))
    best = F.max_by("shape", F.struct("c", "shape")).alias("reference")
    shapes = every.groupBy("host", "shape").agg(F.count("*").alias("c"))
    # written, so that its size is known where it is joined
    hosts = written(shapes.groupBy("host").agg(best, F.sum("c").alias("pages")))
    large = hosts.where(F.col("pages") >= PAGES).select("host", F.concat(F.lit("h:"), "host").alias("site"), "reference", "pages")
    columns = ["site", "reference", "shape", "node", "place", "crc", "chars", "links"]
    rows = every.join(large.select("host", "site", "reference"), "host").select(columns)
    sites = large.drop("host")
    if hosts.where(F.col("pages") < PAGES).take(1):
        once = every.dropDuplicates(["page"])
        whole = once.groupBy("shape").agg(F.count("*").alias("c")).agg(best, F.sum("c").alias("pages")).select(F.lit("*").alias("site"), "reference", "pages")
        rows = rows.unionByName(once.crossJoin(F.broadcast(whole.select("site", "reference"))).select(columns))
        sites = sites.unionByName(whole)
    placed = rows.mapInArrow(_aligned, "site string, anchor int, key long, place int, n long, low long, high long, chars long, links long")
    places = placed.groupBy("site", "anchor", "key", "place").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("chars").alias("chars"), F.sum("links").alias("links"))
    known = places.join(sites.select("site", "pages"), "site")
    same = (F.col("low") == F.col("high")) & (F.col("n") >= PAGES) & (2 * F.col("n") >= F.col("pages"))
    varies = lambda c: F.sum(F.when(same, F.lit(0)).otherwise(F.col(c))).alias(c)
    fixed = F.array_sort(F.collect_list(F.when(same, F.struct("place", F.col("low").alias("crc"))))).alias("same")
    by_key = known.groupBy("site", "pages", "anchor", "key").agg(F.max("n").alias("n"), varies("chars"), varies("links"), fixed)
    # a key that neither the reference nor half of the pages have is never template: its text counts for the node above it
    common = by_key.withColumn("key", F.when((F.col("key") >= 0) | (2 * F.col("n") >= F.col("pages")), F.col("key")))
    few = common.groupBy("site", "anchor", "key").agg(F.max("n").alias("n"), F.sum("chars").alias("chars"), F.sum("links").alias("links"), F.flatten(F.collect_list(F.when(F.col("key").isNotNull() & (F.size("same") > 0), F.col("same")))).alias("same"))
    listed = few.groupBy("site").agg(F.array_sort(F.collect_list(F.struct("anchor", "key", "n", "chars", "links", "same"))).alias("rows"))
    return sites.join(listed, "site").select("site", F.to_json(F.struct(F.col("reference").alias("shape"), "pages", "rows")).alias("template"))


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text, n_chars, template) for every row of ``pages``."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(html_col, F.lit("")).alias("html"), host(F.col(url_col)).alias("host"))
    # a written table, so that its size is known: a small one is broadcast, a large one is joined by host, where hot hosts are split
    known = written(templates(rows.select("host", "html")))
    whole = known.where("site = '*'").select(F.col("template").alias("of_all"))
    own = known.select("site", F.col("template").alias("of_host"))
    joined = rows.join(own, F.concat(F.lit("h:"), "host") == F.col("site"), "left").join(F.broadcast(whole), how="left")
    decided = joined.select("id", "url", "html", F.coalesce("of_host", "of_all").alias("wrapper"), F.when(F.col("of_host").isNotNull(), "host").otherwise("all").alias("by"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Wrappers()
        for b in batches:
            found = [main_text(page, t, memory, by) for page, t, by in zip(*(b.column(c).to_pylist() for c in ("html", "wrapper", "by")), strict=True)]
            text = [t for t, _ in found]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("url"), pa.array(text, pa.string()), pa.array(list(map(len, text)), pa.int64()), pa.array([by for _, by in found], pa.string())], ["id", "url", "text", "n_chars", "template"])

    kind = pages.schema[id_col].dataType.simpleString()
    return decided.mapInArrow(run, f"id {kind}, url string, text string, n_chars long, template string").withColumnRenamed("id", id_col).withColumnRenamed("url", url_col)

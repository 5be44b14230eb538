"""Main text of web pages by wrapper induction.

Pages of one host are dealt into blocks of bounded size, so a host of any size spreads over tasks. In a block
every page's tree is aligned with reference trees by simple tree matching; references are added until every
place that several pages have is in two of them, so each layout has its own. A text that stays the same over at least
half of the pages that have its place and are not copies of each other belongs to the template; a text that varies fills a slot and is content. Places that by their tag or role hold menus, headers, footers,
sidebars, forms, scripts or styles never hold content, since their texts may vary too (menus with another entry
on each page). Words of a class or id that name such places, notices, adverts or reader comments are evidence
only: a named place goes unless it holds most of the text that varies on its page. Inside an article element, if
the page has one, only its own text is content, and none of it goes because other pages repeat it alone: there it takes
both, a word that names another place and a text that alignment finds constant. Without alignment only words that never
name the subject of a text count, or places without a passage.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Container, Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from askloom.llm.frames import table, whole_groups

BLOCK_PAGES = 48
# A place that several pages have stands in this many references.
REFERENCES = 2
# A text is template if it stays the same over this share of at least so many different pages.
CONSTANT_SHARE = 0.5
LEAST_PAGES = 3
# Aligned pages that share more than this part of their article's text are copies and prove nothing.
COPY_SHARE = 0.5
# Within a run of varying paragraphs, a text is template only if it stays the same on so many of the pages; headings never are.
RUN_SHARE = 0.9
# Sums and weights of this many pairs of children are held while they are aligned, and weights of this many pairs of unlike
# subtrees from page to page; what is beyond is worked out again when it is wanted.
MOST_CELLS = 4_000_000
MOST_KNOWN = 1_000_000
BROADCAST_HOSTS = 100_000

TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:"[^"]*"|'[^']*'|[^"'>])*)(?:>|\Z)""", re.S)
ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""")
TOKENS = re.compile(r"[a-z]+|[0-9]+")
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
WHITE = re.compile(r"\s+")

# Fixed values of the HTML standard: elements without content, with raw text, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section "
    "summary table tbody td tfoot th thead tr ul".split()
)
CLOSE_P = BLOCKS - frozenset("body html caption legend option optgroup tbody td tfoot th thead tr".split())
# An opening tag ends an open element of these, up to the given borders.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
# Places that never hold content.
OUT_TAGS = frozenset(
    "head title nav footer aside form script style noscript template iframe svg math canvas object audio video button "
    "select textarea input label menu dialog datalist xmp noembed noframes".split()
)
OUT_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar".split())
OUT_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner menu nav navbar "
    "navigation breadcrumb breadcrumbs sidebar aside cookie cookies consent gdpr notice notification alert popup modal "
    "overlay newsletter subscribe subscription signup login share sharing social related recommended comment comments "
    "disqus respond reply replies discussion footer masthead widget toolbar pagination pager skip".split()
)
# Words that name no subject of a text: they hold for an id inside an article and for an article element itself, and
# what they name goes unless hardly anything else varies on the page.
FIRM_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored comment comments disqus respond".split()
)
COMMENT_WORDS = frozenset("comment comments respond".split())
# Words that name subjects of texts as well: inside an article they need more evidence.
SUBJECT_WORDS = frozenset(
    "navigation menu banner notice notification alert social related reply replies discussion widget promotion subscription".split()
)
# A named place is content if it holds more than this part of the varying text of its page.
MOST = 0.5
MOST_FIRM = 0.9
# After these words a class tells what a place has or lacks, not what it is ("content-with-sidebar", "layout--sidebar").
MODIFIERS = frozenset("has have with without no not is hide hidden show".split())
# Ids of other elements are anchors, often made from a heading.
ID_TAGS = frozenset("div section ul ol dl table article".split())
ARTICLE_ROLES = frozenset("main article".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Elements of which a text holds any number, so that one more is not a place of the layout.
RUN_TAGS = HEADINGS | frozenset("p li dt dd tr td th blockquote pre figcaption".split())
# Elements that hold passages, and those that no class makes another place unless their text is constant.
PASSAGES = frozenset("p blockquote pre td dd figcaption".split())
PROSE = (RUN_TAGS - {"li"}) | frozenset("figure table dl".split())
# Evidence that a named place inside an article needs to go beside its name.
CONSTANT, NO_PASSAGE = 1, 2


class Node:
    """An element: its kind (tag and class), children (nodes and texts), whether content may stand in it (``out``), and
    the part of the page's varying text it must hold to be content if its class or id names another place (``named``), and
    what else must hold for it to go (``tip``: nothing, a constant text, or that or no passage).

    ``path`` is a hash of the kinds from the root, ``above`` the id of the parent; ``shape`` and ``size`` come from ``Shapes``.
    """

    __slots__ = ("tag", "kind", "children", "out", "article", "firm", "named", "tip", "block", "path", "above", "shape", "size")

    def __init__(self, tag: str, kind: str, out: bool = False, article: bool = False, firm: bool = True, named: float = 0.0):
        self.tag, self.kind, self.out, self.article, self.firm, self.named = tag, kind, out, article, firm, named
        self.tip = 0
        self.children: list[Node | str] = []
        self.block = tag in BLOCKS or tag == "#"  # it starts a block or holds one that does
        self.path = self.above = self.shape = self.size = 0

    def elements(self) -> list[Node]:
        """Child elements to align: not the marks inside a text, nor what is in places that never hold content."""
        return [] if self.out else [c for c in self.children if not isinstance(c, str) and c.block]


def _words(marks: str) -> set[str]:
    """Words of a class or id, each name cut where it starts to tell what the place has or lacks."""
    words: set[str] = set()
    for name in marks.split():
        for word in TOKENS.findall(HUMP.sub("-", name.split("--")[0]).lower()):
            if word in MODIFIERS:
                break
            words.add(word)
    return words


def _element(tag: str, attributes: str, inside: bool) -> Node:
    if "=" not in attributes:
        return Node(tag, tag, tag in OUT_TAGS or (tag == "header" and not inside), tag in ("article", "main"))
    found = {a.lower(): unescape(b or c or d) for a, b, c, d in ATTRIBUTE.findall(attributes)}
    classes = _words(found.get("class", ""))
    ids = _words(found.get("id", "")) if tag in ID_TAGS else set()
    if inside:
        ids &= FIRM_WORDS
    words = classes | ids
    role = found.get("role", "").lower()
    hidden = found.get("aria-hidden", "").lower() == "true"
    firm = tag in OUT_TAGS or role in OUT_ROLES or hidden
    out = firm or (tag == "header" and not inside)
    firm_words = FIRM_WORDS - COMMENT_WORDS if inside and (tag in PROSE or tag not in BLOCKS) else FIRM_WORDS
    named = MOST_FIRM if words & firm_words else MOST if words & OUT_WORDS or (not inside and "header" in words) else 0.0
    article = tag in ("article", "main") or role in ARTICLE_ROLES or found.get("itemprop", "").lower() == "articlebody"
    if article or tag in ("body", "html"):
        out = False
        named = MOST_FIRM if article and tag != "main" and words & FIRM_WORDS else 0.0
    node = Node(tag, f"{tag}.{found.get('class', '')}", out, article and not named, firm, named)
    if inside and named == MOST:
        if tag in PROSE or words & COMMENT_WORDS or any(not w.isdigit() for w in words - OUT_WORDS):
            node.tip = CONSTANT
        elif words & SUBJECT_WORDS:
            node.tip = NO_PASSAGE
    return node


def parse(html: str) -> Node:
    """The tree of a page, with the closings that authors leave out."""
    root = Node("#", "#")
    stack, at = [root], 0
    inside = 0  # open article elements
    while at < len(html):
        m = TAG.search(html, at)
        text = html[at : m.start() if m else len(html)]
        if text:
            stack[-1].children.append(unescape(text))
        if not m:
            break
        at = m.end()
        closing, name, attributes = m.groups()
        if name is None:
            continue
        name = name.lower()
        if closing:
            if name in VOID:
                continue
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == name:
                    inside -= sum(n.article for n in stack[k:])
                    del stack[k:]
                    break
                if name not in BLOCKS and stack[k].tag in BLOCKS:
                    break  # an inline end tag does not close a block
            continue
        if name in CLOSE_P:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in BLOCKS:
                    break
        if name in ENDS:
            these, borders = ENDS[name]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in borders:
                    break
                if stack[k].tag in these:
                    del stack[k:]
                    break
        node = _element(name, attributes, inside > 0)
        if node.article:  # what holds an article is a layout, whatever its class says
            for holder in stack:
                holder.out &= holder.firm
                holder.named *= holder.named == MOST_FIRM
        node.path, node.above = hash((stack[-1].path, node.kind)), id(stack[-1])
        if node.block:
            for holder in reversed(stack):
                if holder.block:
                    break
                holder.block = True
        stack[-1].children.append(node)
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = end.end() if end else len(html)  # what it holds is never content
        elif name not in VOID and not attributes.rstrip().endswith("/"):
            stack.append(node)
            inside += node.article
    return root


class Block:
    """A stretch of text between block borders, known by the element it stands in.

    ``parts`` are its texts, each with the named elements around it.
    """

    __slots__ = ("owner", "text", "inside", "parts")

    def __init__(self, owner: Node, text: str, inside: bool, parts: list[tuple[str, tuple[Node, ...]]]):
        self.owner, self.text, self.inside, self.parts = owner, text, inside, parts

    @property
    def plain(self) -> bool:
        return any(not named and not text.isspace() for text, named in self.parts)


def _joined(parts: list[tuple[str, tuple[Node, ...]]]) -> str:
    return WHITE.sub(" ", "".join(text for text, _ in parts)).strip()


def blocks(root: Node) -> tuple[list[Block], bool]:
    """All blocks that may be content, in page order, white space made one blank; and whether there is an article element."""
    found: list[Block] = []
    parts: list[tuple[str, tuple[Node, ...]]] = []
    article = False

    def flush(owner: Node, inside: bool) -> None:
        nonlocal parts
        text = _joined(parts)
        if text:
            found.append(Block(owner, text, inside, parts))
        parts = []

    stack = [(root, iter(root.children), False, root, ())]
    while stack:
        node, rest, inside, owner, named = stack[-1]
        child = next(rest, None)
        if child is None:
            stack.pop()
            if node is owner:
                flush(owner, inside)
        elif isinstance(child, str):
            parts.append((child, named))
        elif child.tag == "br":
            parts.append((" ", named))
        elif child.tag in BLOCKS or not child.out:
            if child.tag in BLOCKS:
                flush(owner, inside)
            if not child.out:
                around = (*named, child) if child.named else named
                # an article element among comments or adverts is not the one of the page
                begins = child.article and not any(n.named == MOST_FIRM for n in around)
                article |= begins
                stack.append((child, iter(child.children), inside or begins, child if child.tag in BLOCKS else owner, around))
    return found, article


def _size(own: list[Block], template: set[int]) -> int:
    """Characters that vary."""
    return sum(len(b.text) for b in own if id(b.owner) not in template)


def _unnamed(own: list[Block], template: set[int], total: float, same: Container[int]) -> list[tuple[Block, str]]:
    """Blocks and their texts without what stands in named elements that hold too little of ``total`` varying characters.

    Named elements of one kind are weighed together. One that needs more evidence than its name goes only if all its text is
    the same on other pages (``same``), or, where that is enough, if it has no passage.
    """
    held: Counter = Counter()
    varies: set[int] = set()  # elements in want of evidence that hold a text of their page alone, or a passage
    passage: set[int] = set()
    for b in own:
        for n in {n for _, named in b.parts for n in named if n.tip}:
            if id(b.owner) not in same:
                varies.add(id(n))
            if n.block and b.owner.tag in PASSAGES:
                passage.add(id(n))
        if id(b.owner) in template:
            continue
        for text, named in b.parts:
            for kind in {n.kind for n in named}:
                held[kind] += len(text.strip())

    def stays(n: Node) -> bool:
        if held[n.kind] > n.named * total:
            return True
        return bool(n.tip) and id(n) in varies and (n.tip == CONSTANT or id(n) in passage)

    texts = []
    for b in own:
        kept = [(t, named) for t, named in b.parts if all(map(stays, named))]
        texts.append((b, b.text if len(kept) == len(b.parts) else _joined(kept)))
    return [(b, t) for b, t in texts if t]


def content(own: list[Block], template: set[int], article: bool, same: Container[int] = ()) -> list[tuple[Block, str]]:
    """Blocks and texts of a page that are content: not template, and in no named element but one that holds most of what varies.

    ``same`` are the elements whose text other pages repeat, of which ``template`` leaves out those inside running text.

    If the page has an article element (``article``) with content, only that counts, and there headings and passages
    that other pages repeat are content too; beside an article without any, no named element is content.
    """
    inside = [b for b in own if b.inside]
    plain = any(b.plain for b in inside)
    kept = _unnamed(inside, template, _size(inside if plain else own, template), same)
    if kept or plain:
        return kept
    varying = [b for b in own if id(b.owner) not in template]
    return _unnamed(varying, template, float("inf") if article else _size(varying, template), same)


class Shapes:
    """Numbers of equal subtrees (kinds only) and the weights of the best matching of unlike ones."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.weights: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def number(self, root: Node) -> None:
        order = [root]
        for node in order:
            order.extend(node.elements())
        for node in reversed(order):
            below = node.elements()
            key = (node.kind, *[c.shape for c in below])
            node.shape = self.numbers.setdefault(key, len(self.numbers) + 1)
            node.size = 1 + sum(c.size for c in below)

    def weight(self, a: Node, b: Node) -> int:
        """Elements that two subtrees have in common, as far as known."""
        if a.kind != b.kind:
            return 0
        if a.shape == b.shape:
            return a.size
        return self.weights.get((a.shape, b.shape), min(a.size, b.size))

    def learn(self, a: Node, b: Node) -> None:
        """Weights of all pairs of unlike subtrees below two elements, from the leaves up."""
        if len(self.weights) > MOST_KNOWN:
            self.weights.clear()
            self.pairs.clear()
        stack = [(a, b, None)]
        while stack:
            x, y, below = stack.pop()
            if below is None:
                if x.kind != y.kind or x.shape == y.shape or (x.shape, y.shape) in self.weights:
                    continue
                below = _unlike(x, y)
            inner = next(below, None)
            if inner:
                stack += [(x, y, below), (*inner, None)]
                continue
            p, q, pairs = self.align(x, y)
            key = (x.shape, y.shape)
            self.weights[key], self.pairs[key] = 1 + sum(self.weight(p[i], q[j]) for i, j in pairs), pairs

    def align(self, x: Node, y: Node) -> tuple[list[Node], list[Node], list[tuple[int, int]]]:
        """Children of two elements and the pairs of them, in order, that have most elements in common."""
        p, q, lo, hi = _inner(x, y)
        if (x.shape, y.shape) in self.pairs:
            return p, q, self.pairs[x.shape, y.shape]
        n, m = len(p) - lo - hi, len(q) - lo - hi
        found = [(i, i) for i in range(lo)]
        if n and m:
            qs = {c.shape: c for c in q[lo : lo + m]}
            at = {shape: k for k, shape in enumerate(qs)}
            columns = np.array([at[c.shape] for c in q[lo : lo + m]])
            rows: dict[int, np.ndarray] = {}

            def common(i: int) -> np.ndarray:
                c = p[lo + i]
                if c.shape not in rows:
                    if len(rows) * len(qs) > MOST_CELLS:
                        rows.clear()
                    rows[c.shape] = np.array([self.weight(c, d) for d in qs.values()], dtype=np.int64)
                return rows[c.shape][columns]

            found += [(lo + i, lo + j) for i, j in _heaviest(n, m, common, lambda i, j: self.weight(p[lo + i], q[lo + j]))]
        return p, q, found + [(len(p) - k, len(q) - k) for k in range(hi, 0, -1)]


def _heaviest(n: int, m: int, common: Callable[[int], np.ndarray], weight: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """Pairs, in order, of ``n`` and ``m`` things with the largest sum of weights; ``common`` gives a row of these, ``weight`` one.

    Of a large table of best sums only some rows are held; those between are made again on the way back.
    """
    step = 1 if n * m <= MOST_CELLS else math.isqrt(n)
    best = {n: np.zeros(m + 1, dtype=np.int64)}

    def above(i: int, below: np.ndarray) -> np.ndarray:
        row = np.zeros(m + 1, dtype=np.int64)
        row[:-1] = np.maximum.accumulate(np.maximum(below[:-1], common(i) + below[1:])[::-1])[::-1]
        return row

    def row_at(i: int) -> np.ndarray:
        if i not in best:
            for k in [k for k in best if k < i - 1]:
                del best[k]
            for k in range(min(n, (i // step + 1) * step) - 1, i - 1, -1):
                best[k] = above(k, best[k + 1])
        return best[i]

    row = best[n]
    for i in range(n - 1, -1, -1):
        row = above(i, row)
        if i % step == 0:
            best[i] = row
    found: list[tuple[int, int]] = []
    i = j = 0
    while i < n and j < m:
        here, after, both = row_at(i)[j], row_at(i + 1), weight(i, j)
        if both and here == both + after[j + 1]:
            found.append((i, j))
            i, j = i + 1, j + 1
        elif here == after[j]:
            i += 1
        else:
            j += 1
    return found


def _unlike(x: Node, y: Node) -> Iterator[tuple[Node, Node]]:
    """Pairs of one kind among the distinct subtrees below two elements that are not paired as equal."""
    p, q, lo, hi = _inner(x, y)
    kinds: dict[str, dict[int, Node]] = {}
    for d in q[lo : len(q) - hi]:
        kinds.setdefault(d.kind, {})[d.shape] = d
    for c in {c.shape: c for c in p[lo : len(p) - hi]}.values():
        for d in kinds.get(c.kind, {}).values():
            if c.shape != d.shape:
                yield c, d


def _inner(x: Node, y: Node) -> tuple[list[Node], list[Node], int, int]:
    """Children of two elements, and how many at the start and end are equal subtrees; pairing those is never worse."""
    p, q = x.elements(), y.elements()
    most, lo, hi = min(len(p), len(q)), 0, 0
    while lo < most and p[lo].shape == q[lo].shape:
        lo += 1
    while hi < most - lo and p[-1 - hi].shape == q[-1 - hi].shape:
        hi += 1
    return p, q, lo, hi


def match(a: Node, b: Node, pairs: dict[int, Node], shapes: Shapes | None = None) -> int:
    """Simple tree matching of two trees of one kind; ``pairs`` gets the partner in ``b`` of each element of ``a``.

    Children are paired in order such that the matched subtrees have most elements in common.
    ``shapes`` has numbered both trees, if given.
    """
    if shapes is None:
        shapes = Shapes()
        shapes.number(a)
        shapes.number(b)
    shapes.learn(a, b)
    count, work = 0, [(a, b)]
    while work:
        x, y = work.pop()
        pairs[id(x)] = y
        count += 1
        p, q, found = shapes.align(x, y)
        work.extend((p[i], q[j]) for i, j in found)
    return count


def _texts(found: list[Block]) -> dict[int, str]:
    out: dict[int, str] = {}
    for b in found:
        out[id(b.owner)] = out.get(id(b.owner), "") + "\n" + b.text
    return out


def references(found: list[list[Block]], distinct: list[int]) -> list[int]:
    """Pages that together hold ``REFERENCES`` times each place that at least ``LEAST_PAGES`` pages have.

    A place is a path of kinds, and whether it is the first, second or a later one of its page.
    """
    places: dict[int, set[tuple[int, int]]] = {}
    for i in distinct:
        seen: Counter = Counter()
        places[i] = set()
        for path in {id(b.owner): b.owner.path for b in found[i]}.values():
            places[i].add((path, min(seen[path], 2)))
            seen[path] += 1
    pages = Counter(place for own in places.values() for place in own)
    missing = {place: REFERENCES for place, n in pages.items() if n >= LEAST_PAGES}
    chosen: list[int] = []
    while missing:
        best = max((i for i in distinct if i not in chosen), key=lambda i: len(places[i] & missing.keys()))  # the first of equals
        chosen.append(best)
        for place in places[best] & missing.keys():
            missing[place] -= 1
            if not missing[place]:
                del missing[place]
    return chosen


def _runs(tree: Node) -> dict[int, int]:
    """Parent of each element that is one of several such, of which a text holds any number."""
    found: dict[int, int] = {}
    work = [tree]
    while work:
        node = work.pop()
        below = node.elements()
        several = Counter(c.kind for c in below if c.tag in RUN_TAGS)
        found.update((id(c), id(node)) for c in below if several[c.kind] > 1)
        work.extend(below)
    return found


def _template(own: list[Block], shares: dict[int, float]) -> set[int]:
    """Elements whose text is template, by the share of pages on which it is the same."""
    ends: dict[int, tuple[int, int]] = {}
    for k, b in enumerate(own):
        if id(b.owner) not in shares:
            first, _ = ends.get(b.owner.above, (k, k))
            ends[b.owner.above] = first, k
    kept = set()
    for k, b in enumerate(own):
        first, last = ends.get(b.owner.above, (k, k))
        if first < k < last and b.owner.tag in RUN_TAGS and (b.owner.tag in HEADINGS or shares.get(id(b.owner), 0.0) < RUN_SHARE):
            kept.add(id(b.owner))
    for first, _ in ends.values():  # headings right above what varies are its title
        k = first - 1
        while k >= 0 and own[k].owner.tag in HEADINGS and own[k].owner.above == own[first].owner.above:
            kept.add(id(own[k].owner))
            k -= 1
    return shares.keys() - kept


def main_texts(pages: list[str]) -> list[str]:
    """Main texts of pages of one host, told from their template by comparing them."""
    trees = [parse(p) for p in pages]
    found, articles = map(list, zip(*map(blocks, trees)))
    texts = [_texts(f) for f in found]
    likely = [{id(b) for b, _ in content(own, set(), article)} for own, article in zip(found, articles)]
    shares: list[dict[int, float]] = [{} for _ in pages]
    distinct = list({p: i for i, p in reversed(list(enumerate(pages)))}.values())[::-1]
    chosen = references(found, distinct)
    shapes = Shapes()
    for i in distinct:
        shapes.number(trees[i])
    for r in chosen:
        same_at: Counter = Counter()
        have: Counter = Counter()
        rows = []
        run = _runs(trees[r])
        for i in distinct:
            if i == r:
                continue
            pairs: dict[int, Node] = {}
            match(trees[i], trees[r], pairs, shapes)
            equal, shared, total = [], 0, 0
            for b in found[i]:
                mine = id(b.owner)
                other = pairs.get(mine)
                alike = other is not None and texts[r].get(id(other)) == texts[i][mine]
                size = len(b.text) if id(b) in likely[i] else 0  # a sidebar that is the same makes no copy
                total += size
                if alike:
                    shared += size
                    equal.append((mine, id(other)))
            if shared <= COPY_SHARE * total:
                rows.append((i, dict(equal)))
                same_at.update({o for _, o in equal})
                paired = {id(y) for y in pairs.values()}
                filled = {id(pairs[m]) for m in texts[i] if m in pairs}
                have.update(o for o in texts[r] if (run[o] in paired if o in run else o in filled))
        share = {o: c / have[o] for o, c in same_at.items() if c + 1 >= LEAST_PAGES and c >= CONSTANT_SHARE * have[o]}
        for i, equal in [*rows, (r, {o: o for o in share})]:
            for mine, other in equal.items():
                if other in share:
                    shares[i][mine] = max(shares[i].get(mine, 0.0), share[other])
    first_of = {pages[i]: i for i in distinct}
    out = []
    for p in pages:
        own, article, same = found[first_of[p]], articles[first_of[p]], shares[first_of[p]]
        out.append("\n\n".join(t for _, t in content(own, _template(own, same), article, same)))
    return out


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in whole_groups(batches, ["host", "block"]):
        hosts, parts = rows.column("host").to_pylist(), rows.column("block").to_pylist()
        html = [h or "" for h in rows.column("html").to_pylist()]
        texts: list[str] = []
        first = 0
        for k in range(1, len(html) + 1):
            if k == len(html) or (hosts[k], parts[k]) != (hosts[first], parts[first]):
                texts += main_texts(html[first:k])
                first = k
        yield pa.RecordBatch.from_arrays(
            [rows.column("page_id").combine_chunks(), rows.column("url").combine_chunks(), pa.array(texts, pa.string())],
            names=["page_id", "url", "text"],
        )


def host_of(url):
    """Lower-case host of an address; empty where there is none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))


def main_text(pages: DataFrame, block_pages: int = BLOCK_PAGES) -> DataFrame:
    """``page_id, url, text`` per row of ``pages`` (``page_id, url, html``).

    ``text`` holds the blocks of the article in page order, two line feeds between; null, empty and tagless pages
    without text give an empty string. Repeated rows are all returned, and copies of a page never count
    as evidence of a template. Rows without an address form a host of their own. Other columns are
    ignored; an empty table gives no rows.
    """
    named = pages.select("page_id", "url", "html", host_of(F.col("url")).alias("host"))
    count = named.groupBy("host").agg(F.ceil(F.count("*") / block_pages).cast("int").alias("blocks"))
    if count.count() <= BROADCAST_HOSTS:  # counted before it is broadcast
        count = F.broadcast(count)
    dealt = named.join(count, "host").withColumn(
        "block", F.pmod(F.xxhash64("page_id", "url"), F.col("blocks")).cast("int")
    )
    dealt = dealt.select("host", "block", "page_id", "url", "html")
    ordered = dealt.repartition("host", "block").sortWithinPartitions("host", "block", "page_id", "url", "html")
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pages.select("page_id", "url").schema)
    return ordered.mapInArrow(_extract, f"{schema}, text string")


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("bigint"))

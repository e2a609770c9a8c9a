"""Main text of web pages by wrapper induction.

Pages of one host are dealt to blocks of bounded size, and a wrapper is induced in each block. Every page becomes a tree of its
block elements with a leaf for each run of text; what its markup names as no part of an article (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, comments) is left out of the tree. Class names and ids rule only if all of their parts
speak of such things; others are evidence at most.

The wrapper is the tree, among some of different sizes, for which most pages tell something. It is aligned with each other tree by
simple tree matching, the mapping of most nodes that keeps parents and order. Pages that agree with it in nearly all of their text
are copies of it and tell nothing, and equal pages tell it once. A leaf that stands with the same text in TEMPLATE_SHARE of the
pages that tell is template, so that an error page or one without the usual frame takes nothing from the others; leaves that vary
are slots, whose texts are content. With fewer than min_pages telling pages nothing is taken for template, since on so few
constant text may as well be content. Where a page marks its article, only slots inside it count.

Children are aligned exactly, however many there are, by the exact matchings of what is below them. Memory is bounded; time grows with
the product of the numbers of children that are not equal at the ends, row by row in numpy.

Rows that agree in id, url and html are merged in the tasks before the shuffle and read as one after it, so that a page that is
repeated a million times costs its block no memory. Texts are shuffled once, and a host of any size is cut into as many blocks as
its different pages need.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayline.llm.storage import stored

BLOCK_PAGES = 96
DEEPEST = 48
#: Outside of articles, slots that are lists of links: this share of their characters, and more than one link or a list's entry.
LINK_SHARE = 0.6
#: A page is a copy of the wrapper if it has this share of its text, a leaf counting LEAF_CHARS at most.
COPY_SHARE = 0.9
LEAF_CHARS = 200
#: Share of the telling pages in which template stands.
TEMPLATE_SHARE = 0.8
MIN_PAGES = 4
#: Trees that are tried as the wrapper, each against some others.
WRAPPERS = 4
TRIALS = 8
#: How an alignment is computed, not what it finds: cells up to which numbers stand in lists, cells whose sums are held at a time,
#: and scores that are remembered.
SHORT = 1 << 10
HELD_CELLS = 1 << 20
KNOWN_SCORES = 1 << 17
#: Scores by the digests of both nodes.
Known = dict[tuple[int, int], float]

TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:\"[^\"]*\"[^>\"']*|'[^']*'[^>\"']*)*)>|!--(.*?)(?:--!?>|\Z)|[!?][^>]*>)", re.S)
#: For a tag with a quote that never ends: up to the next bracket.
OPEN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*)([^>]*)>")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|\d+")

# Fixed values of HTML: elements without end, of raw text, of blocks, and those that an end tag may be left out of.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "noembed", "noframes", "xmp"}
BLOCKS = {
    *("address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "dir", "div"),
    *("dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header"),
    *("hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "optgroup", "option", "p", "pre", "search"),
    *("section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul"),
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "tr": ({"tr"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
    "thead": ({"thead", "tbody", "tfoot"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
}
P_BARRIERS = {"button", "td", "th", "table", "caption", "object", "html", "template"}

# Elements, roles, and parts of class names and ids that are no part of an article.
LEFT_OUT = {
    *("aside", "button", "canvas", "datalist", "dialog", "footer", "form", "head", "iframe", "map", "math", "menu", "nav"),
    *("noscript", "object", "script", "search", "select", "style", "svg", "template", "textarea", "title"),
}
ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}
NAMES = {
    *("ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "breadcrumb", "breadcrumbs", "comment"),
    *("comments", "consent", "cookie", "cookies", "copyright", "disclaimer", "disqus", "footer", "login", "masthead", "menu"),
    *("modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices", "pager", "pagination", "popup", "promo"),
    *("promotion", "recommended", "related", "replies", "reply", "respond", "share", "sharing", "sidebar", "signup", "social"),
    *("sponsor", "sponsored", "subscribe", "toolbar", "widget"),
}
#: Words that say where or how something stands, but not what it is.
GENERIC = {
    *("area", "bar", "block", "bottom", "box", "button", "buttons", "col", "column", "container", "content", "first", "form"),
    *("group", "header", "inner", "item", "items", "last", "left", "link", "links", "list", "main", "middle", "outer", "page"),
    *("panel", "post", "primary", "reader", "right", "row", "secondary", "section", "site", "small", "top", "user", "wrap"),
    *("wrapper",),
}
WHOLE = {"html", "body", "main"}


class Node:
    """An element (text is None) or a leaf of text. inside: below the page's article; linked: characters that are links; links: their
    number, and one more for an entry of a list. Once the tree is whole, digest and size are those of the subtree."""

    __slots__ = ("label", "children", "text", "inside", "linked", "links", "digest", "size")

    def __init__(self, label: str, text: str | None = None, inside: bool = False, linked: int = 0, links: int = 0):
        self.label, self.text, self.inside, self.linked, self.links = label, text, inside, linked, links
        self.children: list[Node] = []
        self.digest, self.size = 0, 1


def _furniture(token: str) -> bool:
    """Whether a class name or id speaks of page furniture in all of its parts: cookie-notice does, share-price does not."""
    parts = [x.lower() for x in NAME_PART.findall(token)]
    return any(x in NAMES for x in parts) and all(x in NAMES or x in GENERIC or x.isdigit() for x in parts)


def _left_out(name: str, attributes: dict[str, str]) -> bool:
    if name in LEFT_OUT or "hidden" in attributes or attributes.get("role", "").lower() in ROLES:
        return True
    if name in WHOLE:
        return False
    named = attributes.get("class", "") + " " + attributes.get("id", "")
    return any(map(_furniture, named.split()))


class _Builder:
    """Open elements, innermost last: name, node of its text, whether it is left out (or "header", where headings stay), whether it
    is inside an article, whether it is a link."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open: list[tuple[str, Node, bool | str, bool, bool]] = [("", self.root, False, False, False)]
        self.run: list[str] = []
        self.linked = self.links = 0

    def text(self, found: str) -> None:
        _, _, out, _, link = self.open[-1]
        if not out:
            self.run.append(found)
            if link:
                self.linked += len("".join(found.split()))
                self.links += 1

    def flush(self) -> None:
        if self.run:
            text = " ".join(unescape("".join(self.run)).split())
            if text:
                _, node, _, inside, _ = self.open[-1]
                entry = node.label.startswith(("li.", "dd.", "dt.", "td."))
                node.children.append(Node("#text", text, inside, self.linked, self.links + entry))
            self.run, self.linked, self.links = [], 0, 0

    def close(self, names: set[str], barriers: set[str]) -> None:
        """Closes the innermost open element of these names that no barrier hides, and what is open in it."""
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i][0] in names:
                if any(x[0] in BLOCKS for x in self.open[i:]):
                    self.flush()
                del self.open[i:]
                return
            if self.open[i][0] in barriers:
                return

    def start(self, name: str, attributes: dict[str, str]) -> None:
        if name in BLOCKS:
            self.close({"p"}, P_BARRIERS)
            self.flush()
        if name in CLOSED_BY:
            self.close(*CLOSED_BY[name])
        if name in VOID:
            if name == "br":
                self.text(" ")
            return
        _, node, out, inside, link = self.open[-1]
        if out == "header" and name in HEADINGS:
            out = False
        elif not out and (name == "header" or "header" in NAME_PART.findall(attributes.get("class", "").lower())):
            out = "header" if inside else name not in WHOLE
        elif not out or (name in ("article", "main") and self._only_form()):
            out = _left_out(name, attributes)
        inside = inside or (name in ("article", "main") or attributes.get("role", "").lower() == "main") and not out
        if name in BLOCKS and not out and len(self.open) < DEEPEST:
            child = Node(f"{name}.{attributes.get('class', '')}", inside=inside)
            node.children.append(child)
            node = child
        self.open.append((name, node, out, inside, link or name == "a"))

    def _only_form(self) -> bool:
        """Whether a form around all is what leaves the place out."""
        return next((x[0] for x in self.open if x[2]), "") == "form"

    def end(self, name: str) -> None:
        if any(x[0] == name for x in self.open):
            self.close({name}, set())
        elif name in BLOCKS:
            self.flush()


def parse(html: str) -> Node:
    """The page's tree. Tags that never end and brackets that begin no tag are text, unclosed elements end with their parent."""
    builder, at = _Builder(), 0
    while True:
        begin = html.find("<", at)
        if begin < 0:
            break
        tag = TAG.match(html, begin) or OPEN_TAG.match(html, begin)
        if tag is None:
            builder.text(html[at : begin + 1])
            at = begin + 1
            continue
        if begin > at:
            builder.text(html[at:begin])
        at = tag.end()
        name = tag[2].lower() if tag[2] else ""
        if not name:
            continue
        if tag[1]:
            builder.end(name)
            continue
        attributes = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(tag[3])} if tag[3].strip() else {}
        builder.start(name, attributes)
        if name in RAW:
            over = re.compile(rf"</{re.escape(name)}[\s/>]", re.I).search(html, at)
            at = over.start() if over else len(html)
    builder.text(html[at:])
    builder.flush()
    _finish(builder.root)
    return builder.root


def _finish(node: Node) -> None:
    for child in node.children:
        _finish(child)
    node.size = 1 + sum(c.size for c in node.children)
    below = b"".join([c.digest.to_bytes(8, "little") for c in node.children])
    node.digest = xxhash.xxh64_intdigest(f"{node.label}\0{node.text}\0".encode("utf-8", "surrogatepass") + below)


def leaves(node: Node) -> list[Node]:
    """Leaves in page order."""
    found, waiting = [], [node]
    while waiting:
        one = waiting.pop()
        if one.text is not None:
            found.append(one)
        waiting += reversed(one.children)
    return found


def _equal_pairs(one: Node, other: Node) -> list[tuple[Node, Node]]:
    return list(zip(leaves(one), leaves(other), strict=True))


def _score(one: Node, other: Node, known: Known | None = None) -> float:
    """Nodes that two of the same label have in common, by the best alignments of all that is below them."""
    if one.digest == other.digest:
        return 1.01 * one.size
    if one.text is not None:
        return 1.0
    if one.size == 2 and other.size == 2:  # an element around one text each
        return 1.0 + (one.children[0].label == other.children[0].label)
    known = {} if known is None else known
    key = one.digest, other.digest
    found = known.get(key)
    if found is None:
        head, tail = _equal_ends(one.children, other.children)
        equal = [*one.children[:head], *one.children[len(one.children) - tail :]]
        mine, theirs = one.children[head : len(one.children) - tail], other.children[head : len(other.children) - tail]
        found = 1.0 + sum(1.01 * c.size for c in equal)
        if mine and theirs:
            scores = _scores(mine, theirs, known)
            row = _first_row(mine, theirs)
            for i in range(len(mine)):
                row = _next_row(row, scores(i))
            found += float(row[-1])
        if len(known) >= KNOWN_SCORES:
            known.clear()
        known[key] = found
    return found


def _kinds(mine: list[Node], theirs: list[Node]) -> tuple[list[int], list[int]]:
    """Numbers of the nodes, alike for nodes that differ at most in texts that stand on one side only: no score tells them apart."""
    shared = {x.digest for c in mine for x in leaves(c)} & {x.digest for c in theirs for x in leaves(c)}
    numbers: dict[object, int] = {}

    def kind(node: Node) -> int:
        if node.text is not None:
            return numbers.setdefault(node.digest if node.digest in shared else "", len(numbers))
        return numbers.setdefault((node.label, tuple(map(kind, node.children))), len(numbers))

    return list(map(kind, mine)), list(map(kind, theirs))


def _scores(mine: list[Node], theirs: list[Node], known: Known) -> Callable[[int], Sequence[float] | np.ndarray]:
    """Gives the scores of one of mine with each of theirs, 0 where labels differ. In long lists each kind of pair is compared once."""
    if len(mine) * len(theirs) <= SHORT:
        return lambda i: [_score(mine[i], x, known) if x.label == mine[i].label else 0.0 for x in theirs]
    own, other = _kinds(mine, theirs)
    different, place = np.unique(other, return_inverse=True)
    some = dict(zip(other, theirs, strict=True))
    examples = [some[k] for k in different.tolist()]
    held: dict[int, np.ndarray] = {}

    def scores(i: int) -> np.ndarray:
        if own[i] not in held:
            if len(held) * len(examples) > HELD_CELLS:
                held.clear()
            label = mine[i].label
            held[own[i]] = np.array([_score(mine[i], x, known) if x.label == label else 0.0 for x in examples])
        return held[own[i]][place]

    return scores


def _first_row(mine: list[Node], theirs: list[Node]) -> list[float] | np.ndarray:
    return [0.0] * (len(theirs) + 1) if len(mine) * len(theirs) <= SHORT else np.zeros(len(theirs) + 1)


def _next_row(above: list[float] | np.ndarray, scores: Sequence[float] | np.ndarray) -> list[float] | np.ndarray:
    """Best sums of one more of mine with the first of theirs, for each number of them that the row above has. Lists and arrays hold
    the same numbers."""
    if isinstance(above, np.ndarray):
        row = above.copy()
        np.maximum(row[1:], above[:-1] + scores[: len(above) - 1], out=row[1:])
        return np.maximum.accumulate(row)
    best = above[0]
    row = [best]
    for up, corner, score in zip(above[1:], above, scores, strict=False):
        if up > best:
            best = up
        if corner + score > best:
            best = corner + score
        row.append(best)
    return row


def _aligned(mine: list[Node], theirs: list[Node], known: Known | None = None) -> list[tuple[Node, Node]]:
    """Pairs of children, in order, whose scores sum to the most. Rows of best sums are held for HELD_CELLS cells at a time: of more
    rows the lower half is followed back first, from the row in the middle."""
    if not mine or not theirs:
        return []
    scores = _scores(mine, theirs, {} if known is None else known)
    pairs: list[tuple[Node, Node]] = []

    def follow(first: int, past: int, above: list[float] | np.ndarray, j: int) -> int:
        """Adds the pairs of mine from first on, given the row above them and the number of theirs that are left; what then is."""
        if (past - first) * (j + 1) > HELD_CELLS and past - first > 1:
            middle, row = (first + past) // 2, above[: j + 1]
            for i in range(first, middle):
                row = _next_row(row, scores(i))
            j = follow(middle, past, row, j)
            return follow(first, middle, above, j)
        rows = [above[: j + 1]]
        for i in range(first, past):
            rows.append(_next_row(rows[-1], scores(i)))
        i = past - first
        while i and j:
            here = rows[i][j]
            if here == rows[i - 1][j]:
                i -= 1
            elif here == rows[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((mine[first + i], theirs[j]))
        return j

    follow(0, len(mine), _first_row(mine, theirs), len(theirs))
    return pairs[::-1]


def _equal_ends(mine: list[Node], theirs: list[Node]) -> tuple[int, int]:
    """Number of children that are equal at the beginning, and of others at the end. No alignment is better than one that keeps them."""
    fewer = min(len(mine), len(theirs))
    head = tail = 0
    while head < fewer and mine[head].digest == theirs[head].digest:
        head += 1
    while tail < fewer - head and mine[-1 - tail].digest == theirs[-1 - tail].digest:
        tail += 1
    return head, tail


def _children_pairs(mine: list[Node], theirs: list[Node], known: Known) -> list[tuple[Node, Node]]:
    """Alignment of two lists of children: what is equal at both ends, then what lies between."""
    if len(mine) == 1 and len(theirs) == 1:
        return [(mine[0], theirs[0])] if mine[0].label == theirs[0].label else []
    head, tail = _equal_ends(mine, theirs)
    pairs = list(zip(mine[:head], theirs[:head], strict=True))
    pairs += _aligned(mine[head : len(mine) - tail], theirs[head : len(theirs) - tail], known)
    return pairs + (list(zip(mine[-tail:], theirs[-tail:], strict=True)) if tail else [])


def match(one: Node, other: Node) -> tuple[float, list[tuple[Node, Node]]]:
    """Simple tree matching of two nodes of the same label: number of matched nodes, and the matched leaves. Nodes of
    equal subtrees count a little more, so that of equally large matchings one that keeps them is found."""
    score, pairs, waiting = 0.0, [], [(one, other)]
    known: Known = {}
    while waiting:
        a, b = waiting.pop()
        if a.digest == b.digest:
            score += 1.01 * a.size
            pairs += _equal_pairs(a, b)
            continue
        score += 1.0
        if a.text is not None:
            pairs.append((a, b))
        else:
            waiting += _children_pairs(a.children, b.children, known)
    return score, pairs


def _told(wrapper: Node, tree: Node) -> tuple[list[tuple[Node, Node]], list[Node], bool]:
    """Matched leaves of a tree, those of the wrapper with the same text, and whether the tree is a copy of the wrapper."""
    pairs = match(wrapper, tree)[1]
    equal = [a for a, b in pairs if a.text == b.text]
    weight = lambda found: sum(min(len(x.text or ""), LEAF_CHARS) for x in found)
    whole = max(weight(leaves(wrapper)), weight(leaves(tree)))
    return pairs, equal, weight(equal) >= COPY_SHARE * whole


def induce(trees: list[Node], min_pages: int = MIN_PAGES) -> list[set[int]]:
    """For each tree the ids (as of `id`) of its leaves that are template."""
    first = {t.digest: t for t in trees if t.size > 1 and leaves(t)}
    different = sorted(first.values(), key=lambda t: (t.size, t.digest))
    if len(different) < min_pages:
        return [set() for _ in trees]
    # Some trees of different sizes, but for the least and the largest, which are the odd ones if there are any.
    spread = lambda n: [different[i] for i in sorted({(2 * i + 1) * len(different) // (2 * n) for i in range(n)})]

    def told(wrapper: Node, some: list[Node]) -> dict[int, tuple[list[tuple[Node, Node]], list[Node], bool]]:
        return {t.digest: _told(wrapper, t) for t in some if t is not wrapper}

    def use(wrapper: Node) -> tuple[int, float]:
        """Pages that tell something, then leaves that they have in common."""
        tried = [(pairs, copy) for pairs, _, copy in told(wrapper, spread(TRIALS)).values()]
        return sum(not copy for _, copy in tried), sum(len(p) for p, copy in tried if not copy) / len(leaves(wrapper))

    wrapper = max(spread(WRAPPERS), key=use)
    found = told(wrapper, different)
    telling = [equal for _, equal, copy in found.values() if not copy]
    evidence = len(telling) + 1
    if evidence < min_pages:
        return [set() for _ in trees]
    same = Counter(id(a) for equal in telling for a in equal)
    template = {x for x, n in same.items() if n + 1 >= TEMPLATE_SHARE * evidence}
    out = []
    for tree in trees:
        if tree.digest == wrapper.digest:
            pairs = _equal_pairs(wrapper, tree)
        elif tree.digest not in found:
            pairs = []
        else:
            # Equal trees share an alignment, not their leaves.
            mine = dict(zip(map(id, leaves(first[tree.digest])), leaves(tree), strict=True))
            pairs = [(a, mine[id(b)]) for a, b in found[tree.digest][0]]
        out.append({id(b) for a, b in pairs if id(a) in template and a.text == b.text})
    return out


def content(tree: Node, template: set[int]) -> str:
    """Texts of the slots: those inside the page's article if it marks one, else all that aren't lists of links."""
    found = [x for x in leaves(tree) if id(x) not in template]
    if any(x.inside for x in found):
        return "\n\n".join(x.text or "" for x in found if x.inside)
    plain = [x for x in found if x.links < 2 or x.linked <= LINK_SHARE * len((x.text or "").replace(" ", ""))]
    return "\n\n".join(x.text or "" for x in plain)


def extract(
    pages: DataFrame,
    *,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    block_pages: int = BLOCK_PAGES,
    min_pages: int = MIN_PAGES,
) -> DataFrame:
    """Main text of every whole page: id_col, url_col and text, a row per row of pages.

    White space inside a block is one blank, blocks are joined by two line breaks. A null or empty page has an empty text, pages
    without a host in their url (or a null url) are taken for one host; repeated rows and null ids are kept, other columns are
    left out, an empty table gives an empty one.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url_col), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1))
    rows = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"), host.alias("host")
    ).withColumn("mark", F.xxhash64("id", "url", "html"))
    # A row per host; as a stored table its size is known to Spark, which broadcasts it only below its threshold.
    different = rows.select("host", "mark").distinct()
    blocks = stored(different.groupBy("host").agg(F.ceil(F.count("*") / block_pages).cast("int").alias("blocks")), "hosts")
    dealt = rows.join(blocks, "host").withColumn("block", F.pmod("mark", F.col("blocks")).cast("int"))
    dealt = dealt.select("host", "block", "id", "url", "html", F.lit(1).cast("long").alias("rows"))
    merged = dealt.mapInArrow(_merged, dealt.schema)

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, int] = {}
        for batch in batches:
            columns = (batch.column(c).to_pylist() for c in ("id", "url", "html", "rows"))
            for ident, url, html, n in zip(*columns, strict=True):
                held[ident, url, html] = held.get((ident, url, html), 0) + n
        # In an order of their own, so that a lost task's second run sees them alike.
        pages_ = sorted(held, key=lambda p: (str(p[0]), p[1] or "", p[2]))
        trees = [parse(html) for _, _, html in pages_]
        texts = [content(t, out) for t, out in zip(trees, induce(trees, min_pages), strict=True)]
        ids, urls = ([p[i] for p in pages_] for i in (0, 1))
        kinds = [batch.schema.field(c).type for c in ("id", "url")]
        counts = [held[p] for p in pages_]
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, kinds[0]), pa.array(urls, kinds[1]), pa.array(texts, pa.string()), pa.array(counts, pa.int64())],
            names=["id", "url", "text", "rows"],
        )

    schema = rows.select("id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("rows")).schema
    done = merged.groupBy("host", "block").applyInArrow(extracted, schema)
    each = done.select("id", "url", "text", F.explode(F.sequence(F.lit(1).cast("long"), "rows")))
    return each.select(F.col("id").alias(id_col), F.col("url").alias(url_col), "text")


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows that agree in all but their number as one, batch by batch."""
    for batch in batches:
        keys = ["host", "block", "id", "url", "html"]
        table = pa.Table.from_batches([batch]).group_by(keys).aggregate([("rows", "sum")])
        yield from table.select([*keys, "rows_sum"]).rename_columns([*keys, "rows"]).combine_chunks().to_batches()

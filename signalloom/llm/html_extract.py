"""Main text of web pages by wrapper induction.

Wrapper. The pages of a host are aligned by simple tree matching: two trees match when their roots do, and their children
are paired by the order-preserving alignment that keeps most nodes. Nodes are blocks (what is inside a line counts as its
text). Neighbours with equal keys form runs: runs are aligned first, then the members of two runs one by one. Members without
inner blocks are all worth one node, so that any order-preserving pairing is a best one; members with equal content are
paired first, the others by place. Each task merges its pages into one partial wrapper per host, and partial wrappers are
merged in two steps, so a hot host is spread.

Template and slots. A node of the wrapper keeps a summary of the contents it was seen with that loses none held by more than
a ninth of its pages. A second pass aligns every page with the finished wrapper and counts these exactly, and the running
text and link text of each node. A content is template when it stands at its node on more than half of the pages that have
the parent (lower end of the 95 % Wilson interval, so a host with few pages must be nearly unanimous). All else is a slot.

Content. The content region of a host is found on the wrapper: from the root down into the slot that holds most of the
varying running text of all pages; menus (mostly link text) and template hold none. A page's own declarations refine it: an
article that it declares inside or around the region is taken instead. Regions that HTML or their names declare to be
navigation, header, footer, sidebar, notice, advert, form, script, style or comments are left out everywhere. Pages without a
wrapper (fewer than MIN_PAGES different pages of the host) are judged by their own declarations and text mass.

Text. Character references are decoded, white space inside a block becomes one space, blocks are joined by a newline.

Cases: null or empty html gives empty text; text without any tag is content; pages with equal main text count once for what is
template; a null url is a host of its own; repeated rows are answered each; equal weights in an alignment are decided for the
earlier pair; very long pages: two child lists of more than PAIRS pairs are aligned as exactly as short ones, by rows instead of a
table of all pairs, and elements deeper than 200 become siblings, which changes no text; an empty table gives
an empty result; columns besides page_id, url and html are ignored.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from signalloom.llm.common import bounded_batches, materialise
from signalloom.llm.dom import BLOCKS, RAW, Node, parse

MIN_PAGES = 5
TEMPLATE_SHARE = 0.5
Z = 1.96
SUMMARY = 8
CANDIDATE_SHARE = 0.4
#: Child lists of more pairs are aligned by `long_alignment`; contents that more pairs of runs share are part of a run's form there.
PAIRS = 10_000
FEW_PAIRS = 1024
HELD_WORTHS = 4_000_000
SALTS = 64
HELD_NODES = 500_000
BROADCAST_BYTES = 32 << 20
REGION_SHARE = 0.6
#: Blocks that hold text themselves: a region is never narrowed down to one of them.
TEXT_BLOCKS = frozenset("p li td th tr dt dd h1 h2 h3 h4 h5 h6 pre ul ol dl table tbody blockquote figure".split())
HEADINGS = frozenset("h1 h2 h3".split())
#: Names by which regions declare themselves.
OUTSIDE_TAGS = frozenset("nav header footer aside form button select dialog menu input label iframe object audio video canvas map".split()) | RAW
OUTSIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
OUTSIDE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar sidebars aside menu menus nav navbar navigation
    breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices alert popup modal overlay newsletter subscribe subscription signup
    login share sharing social related recommended recommendations widget widgets comment comments commentlist disqus respond reply replies toolbar
    pagination pager skip tracking hidden sr offscreen""".split()
)
#: Of an article or a paragraph only these say that it is none of the main text.
ARTICLE_OUTSIDE_WORDS = frozenset("comment comments reply replies ad ads advert advertisement cookie cookies notice sponsored promo related".split())
#: Words of layout classes such as "content-with-sidebar", which name what stands beside the element's text.
LAYOUT_WORDS = frozenset("with has no".split())
HIDING = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
WORDS = re.compile(r"[a-z]+")


def names_of(node: Node) -> list[str]:
    attrs = node.attrs
    if not attrs or not ("class" in attrs or "id" in attrs):
        return []
    return name_words(f"{attrs.get('class', '')} {attrs.get('id', '')}")


@lru_cache(4096)
def name_words(names: str) -> list[str]:
    """Their words; the pages of a host repeat the same names again and again. Callers leave the list as it is."""
    return WORDS.findall(CAMEL.sub(" ", names).lower())


def is_outside(node: Node) -> bool:
    """Whether the element declares itself to hold no main text."""
    if node.tag in OUTSIDE_TAGS:
        return True
    attrs = node.attrs
    if not attrs:
        return False
    if "hidden" in attrs or attrs.get("role", "").lower() in OUTSIDE_ROLES or attrs.get("aria-hidden", "").lower() == "true":
        return True
    if "style" in attrs and HIDING.search(attrs["style"]):
        return True
    words = names_of(node)
    if not words or node.tag in ("html", "body", "main") or not LAYOUT_WORDS.isdisjoint(words):
        return False
    return not (ARTICLE_OUTSIDE_WORDS if node.tag in ("article", "p") else OUTSIDE_WORDS).isdisjoint(words)


def is_article(node: Node) -> bool:
    return node.tag in ("article", "main") or node.attrs.get("role", "").lower() in ("main", "article") or node.attrs.get("itemprop") == "articleBody"


class Wrapper:
    """A node of a wrapper, or of one page's tree (pages = 1).

    `pages`: how many pages have it; `seen`: contents (digests) with counts, at most SUMMARY of them once merged; `text`, `links`:
    characters of running and of link text; `children` in order; `node`: the element, on a page's own tree; `content`: whether
    this is the host's content region; `index`: its number in page order."""

    __slots__ = ("key", "pages", "seen", "text", "links", "children", "node", "content", "index")

    def __init__(self, key: str, pages: int, seen: dict[int, int], children: list[Wrapper], text: int = 0, links: int = 0, node: Node | None = None):
        self.key, self.pages, self.seen, self.children, self.text, self.links, self.node = key, pages, seen, children, text, links, node
        self.content, self.index = False, 0

    def size(self) -> int:
        return 1 + sum(c.size() for c in self.children)

    def numbered(self) -> list[Wrapper]:
        """All nodes in page order, each given its place in the list."""
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            x.index = len(out)
            out.append(x)
            stack.extend(reversed(x.children))
        return out

    def pack(self) -> bytes:
        def plain(w):
            return (w.key, w.pages, w.seen, w.text, w.links, w.content, [plain(c) for c in w.children])

        return zlib.compress(pickle.dumps(plain(self)), 1)

    @staticmethod
    def unpack(packed: bytes) -> Wrapper:
        def build(x):
            w = Wrapper(x[0], x[1], x[2], [build(c) for c in x[6]], x[3], x[4])
            w.content = x[5]
            return w

        return build(pickle.loads(zlib.decompress(packed)))


def key_of(node: Node) -> str:
    """Tag and class words: what nodes must share to be aligned."""
    if not node.attrs:
        return node.tag
    names = sorted(set(names_of(node)))
    return f"{node.tag}.{'.'.join(names)}" if names else node.tag


def tree_of(page: Node) -> Wrapper:
    """The tree of a page's blocks. Elements inside a line (no blocks, and none below) belong to the text of their block."""

    def visit(node: Node, in_link: bool) -> tuple[int, int, int, list[Wrapper], bool]:
        digest, text, links, children = 0, 0, 0, []
        blocky = node.tag in BLOCKS or node.parent is None
        if node.tag not in RAW:
            for x in node.items:
                if isinstance(x, str):
                    words = " ".join(x.split())
                    if not words:  # adds nothing to the digest
                        continue
                    digest = zlib.crc32(words.encode(), digest)
                    if in_link:
                        links += len(words)
                    else:
                        text += len(words)
                else:
                    d, t, k, inner, is_block = visit(x, in_link or x.tag == "a")
                    digest = zlib.crc32(d.to_bytes(4, "little"), digest)
                    text, links = text + t, links + k
                    if is_block:
                        children.append(Wrapper(key_of(x), 1, {d: 1}, inner, t, k, x))
        return digest, text, links, children, blocky or bool(children)

    digest, text, links, children, _ = visit(page, False)
    return Wrapper(key_of(page), 1, {digest: 1}, children, text, links, page)


def runs_of(nodes: list[Wrapper]) -> list[tuple[int, int]]:
    """(first, end) of each run of equal keys."""
    out, at = [], 0
    for i in range(1, len(nodes) + 1):
        if i == len(nodes) or nodes[i].key != nodes[at].key:
            out.append((at, i))
            at = i
    return out


def run_worth(one: list[Wrapper], two: list[Wrapper]) -> int:
    """What the members of two runs have in common; 0 when their keys differ. Nothing that is found on the way is kept."""
    return Matching()._members(one, two, (0, len(one)), (0, len(two)))[0] if one[0].key == two[0].key else 0


def long_alignment(left: list[list[Wrapper]], right: list[list[Wrapper]]) -> list[tuple[int, int]]:
    """The alignment that `best_alignment` finds, for lists of runs too long for a table of all pairs: exact, all pairs are weighed.

    Contents that few pairs of runs share are looked up and such pairs are weighed one by one. The worth of all other pairs depends on
    the forms of both runs only (keys, children, and the contents that many share), so it is found once for two forms. Rows of
    the table are made by NumPy; every so many are kept, and the rows between are made again on the way back."""

    def places(runs: list[list[Wrapper]]) -> dict[int, set[int]]:
        where: dict[int, set[int]] = {}
        for i, run in enumerate(runs):
            stack = list(run)
            while stack:
                w = stack.pop()
                for digest in w.seen:
                    where.setdefault(digest, set()).add(i)
                stack.extend(w.children)
        return where

    in_left, in_right = places(left), places(right)
    shared = in_left.keys() & in_right.keys()
    common = {d for d in shared if len(in_left[d]) * len(in_right[d]) > FEW_PAIRS}
    near: dict[int, dict[int, int]] = {}
    for i, j in {(i, j) for d in shared - common for i in in_left[d] for j in in_right[d]}:
        near.setdefault(i, {})[j] = run_worth(left[i], right[j])

    def form(w: Wrapper):
        return w.key, frozenset(w.seen.keys() & common), tuple(form(c) for c in w.children)

    def bare(w: Wrapper) -> Wrapper:
        return Wrapper(w.key, w.pages, {d: n for d, n in w.seen.items() if d in common}, [bare(c) for c in w.children])

    def forms(runs: list[list[Wrapper]]) -> tuple[np.ndarray, list[list[Wrapper]]]:
        known, first, of = {}, [], []
        for run in runs:
            at = known.setdefault(tuple(form(w) for w in run), len(first))
            if at == len(first):
                first.append([bare(w) for w in run])
            of.append(at)
        return np.asarray(of), first

    (of_left, left_forms), (of_right, right_forms) = forms(left), forms(right)
    worths: dict[int, np.ndarray] = {}

    def below(row: np.ndarray, i: int) -> np.ndarray:
        kind = int(of_left[i])
        if kind not in worths:
            if len(worths) * len(right_forms) > HELD_WORTHS:
                worths.clear()
            worths[kind] = np.asarray([run_worth(left_forms[kind], y) for y in right_forms], dtype=np.int64)
        own = worths[kind][of_right]
        for j, worth in near.get(i, {}).items():
            own[j] = worth
        out = np.zeros(len(right) + 1, dtype=np.int64)
        np.maximum.accumulate(np.maximum(row[1:], row[:-1] + own), out=out[1:])
        return out

    step = math.isqrt(len(left)) + 1
    kept, row = [], np.zeros(len(right) + 1, dtype=np.int64)
    for i in range(len(left)):
        if i % step == 0:
            kept.append(row)
        row = below(row, i)
    pairs, j = [], len(right)
    for start in reversed(range(0, len(left), step)):
        rows = [kept.pop()]
        for i in range(start, min(start + step, len(left))):
            rows.append(below(rows[-1], i))
        i = len(rows) - 1
        while i and j:
            if rows[i][j] == rows[i - 1][j]:
                i -= 1
            elif rows[i][j] == rows[i][j - 1]:
                j -= 1
            else:
                pairs.append((start + i - 1, j - 1))
                i, j = i - 1, j - 1
    return pairs[::-1]


def best_alignment(n: int, m: int, weight: Callable[[int, int], int]) -> list[tuple[int, int]]:
    """The order-preserving pairs of n left and m right places with the largest sum of weights (0: they do not match)."""
    worth = [[weight(i, j) for j in range(m)] for i in range(n)]
    best = [[0] * (m + 1) for _ in range(n + 1)]
    for i in range(n):
        row, up, own = best[i + 1], best[i], worth[i]
        for j in range(m):
            row[j + 1] = max(up[j + 1], row[j], up[j] + own[j])
    pairs, i, j = [], n, m
    while i and j:
        if best[i][j] == best[i - 1][j]:
            i -= 1
        elif best[i][j] == best[i][j - 1]:
            j -= 1
        else:
            pairs.append((i - 1, j - 1))
            i, j = i - 1, j - 1
    return pairs[::-1]


class Matching:
    """Simple tree matching of two trees; what was found for a pair of nodes is kept."""

    def __init__(self):
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def worth(self, a: Wrapper, b: Wrapper) -> int:
        """Nodes that the trees have in common, and one more for equal content; 0 when their roots differ."""
        if a.key != b.key:
            return 0
        same = 1 if a.seen and not a.seen.keys().isdisjoint(b.seen) else 0
        return 1 + same + (self.children(a, b)[0] if a.children and b.children else 0)

    def children(self, a: Wrapper, b: Wrapper) -> tuple[int, list[tuple[int, int]]]:
        """The worth and the pairs of the best alignment of the children."""
        at = (id(a), id(b))
        if at not in self.known:
            self.known[at] = self._children(a.children, b.children)
        return self.known[at]

    def _children(self, left: list[Wrapper], right: list[Wrapper]) -> tuple[int, list[tuple[int, int]]]:
        if not left or not right:
            return 0, []
        a, b = runs_of(left), runs_of(right)
        members: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

        def weight(i: int, j: int) -> int:
            if left[a[i][0]].key != right[b[j][0]].key:
                return 0
            if (i, j) not in members:
                members[i, j] = self._members(left, right, a[i], b[j])
            return members[i, j][0]

        if [left[i].key for i, _ in a] == [right[j].key for j, _ in b]:
            matched = [(i, i) for i in range(len(a)) if weight(i, i)]
        else:
            runs = [left[x:y] for x, y in a], [right[x:y] for x, y in b]
            matched = long_alignment(*runs) if len(a) * len(b) > PAIRS else best_alignment(len(a), len(b), weight)
            matched = [(i, j) for i, j in matched if weight(i, j)]
        return sum(members[x][0] for x in matched), [p for x in matched for p in members[x][1]]

    def _members(self, left: list[Wrapper], right: list[Wrapper], one: tuple[int, int], two: tuple[int, int]) -> tuple[int, list[tuple[int, int]]]:
        """The alignment of the members of two runs of one key."""
        (a, b), (c, d) = one, two
        if b - a == 1 and d - c == 1:
            return self.worth(left[a], right[c]), [(a, c)]
        if not any(left[i].children for i in range(a, b)) or not any(right[j].children for j in range(c, d)):
            known = {digest for j in range(c, d) for digest in right[j].seen}
            where: dict[int, list[int]] = {}
            for i in range(a, b):
                if left[i].seen:
                    for digest in known & left[i].seen.keys():
                        where.setdefault(digest, []).append(i)
            pairs, x, y, equal = [], a, c, 0
            for j in range(c, d) if where else ():
                # equal contents meet first; so many places must be left that the others can still be paired
                found = next((i for digest in right[j].seen for i in where.get(digest, ()) if i >= x), None)
                if found is not None:
                    n = min(found - x, j - y)
                    pairs += [(x + k, y + k) for k in range(n)] + [(found, j)]
                    x, y, equal = found + 1, j + 1, equal + 1
            n = min(b - x, d - y)
            pairs += [(x + k, y + k) for k in range(n)]
            return len(pairs) + equal, pairs
        if (b - a) * (d - c) > PAIRS:
            pairs = long_alignment([[x] for x in left[a:b]], [[y] for y in right[c:d]])
        else:
            pairs = best_alignment(b - a, d - c, lambda i, j: self.worth(left[a + i], right[c + j]))
        return sum(self.worth(left[a + i], right[c + j]) for i, j in pairs), [(a + i, c + j) for i, j in pairs]


def summary(seen: dict[int, int]) -> dict[int, int]:
    """At most SUMMARY counts: the next one is taken off all, so no content held by more than 1 / (SUMMARY + 1) is lost."""
    if len(seen) <= SUMMARY:
        return seen
    less = sorted(seen.values(), reverse=True)[SUMMARY]
    return {d: n - less for d, n in seen.items() if n > less}


def merge(a: Wrapper, b: Wrapper, matching: Matching | None = None) -> Wrapper:
    """The wrapper of the pages of both; unmatched nodes keep their place."""
    matching = matching or Matching()
    seen = dict(a.seen)
    for digest, n in b.seen.items():
        seen[digest] = seen.get(digest, 0) + n
    children, i, j = [], 0, 0
    pairs = matching.children(a, b)[1] if a.children and b.children else []
    for x, y in [*pairs, (len(a.children), len(b.children))]:
        children += a.children[i:x] + b.children[j:y]
        if x < len(a.children):
            children.append(merge(a.children[x], b.children[y], matching))
        i, j = x + 1, y + 1
    return Wrapper(a.key, a.pages + b.pages, summary(seen), children, a.text + b.text, a.links + b.links)


def aligned(wrapper: Wrapper, page: Wrapper) -> Iterator[tuple[Wrapper, Wrapper]]:
    """The pairs of nodes of a wrapper and a page's tree that match, from the root down."""
    matching, stack = Matching(), [(wrapper, page)]
    while stack:
        w, x = stack.pop()
        yield w, x
        stack.extend((w.children[i], x.children[j]) for i, j in matching.children(w, x)[1])


def wilson_low(hits: int, pages: int) -> float:
    """Lower end of the 95 % interval of a share."""
    share, z = hits / pages, Z * Z / pages
    return (share + z / 2 - Z * (share * (1 - share) / pages + z / 4 / pages) ** 0.5) / (1 + z)


def decide(wrapper: Wrapper, pages: list[int], text: list[int], links: list[int], hits: dict[tuple[int, int], int]) -> Wrapper:
    """Given the exact counts of every node: `seen` becomes its template contents, and the content region is marked."""
    nodes = wrapper.numbered()
    parent = {c.index: w.index for w in nodes for c in w.children}
    mass = [0.0] * len(nodes)
    for w in reversed(nodes):
        around = pages[parent.get(w.index, 0)]
        w.seen = {d: n for d in w.seen if (n := hits.get((w.index, d), 0)) >= MIN_PAGES and wilson_low(n, around) > TEMPLATE_SHARE}
        i = w.index
        own = text[i] - sum(text[c.index] for c in w.children)
        constant = sum(w.seen.values()) / pages[i] if pages[i] else 0.0
        outside = is_outside(Node(w.key.split(".")[0], {"class": " ".join(w.key.split(".")[1:])}, None))
        mass[i] = 0.0 if outside or links[i] > text[i] else (own + sum(mass[c.index] for c in w.children)) * (1 - constant)
        w.pages, w.text, w.links = pages[i], text[i], links[i]
    if wrapper.pages >= MIN_PAGES and mass[0] > 0:
        here = wrapper
        while True:
            best = max(here.children, key=lambda c: mass[c.index], default=None)
            if best is None or mass[best.index] < REGION_SHARE * mass[here.index] or best.key.split(".")[0] in TEXT_BLOCKS:
                break
            if any(c.key.split(".")[0] in HEADINGS and mass[c.index] > 0 for c in here.children):
                break  # the heading beside the text block belongs to it
            here = best
        here.content = True
    return wrapper


def host_of(url):
    """Host of a url column, lower case; a null or odd url is the host ''."""
    return F.lower(F.coalesce(F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", 1), F.lit("")))


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, digest, tree) of each page: a checksum of the main text that it declares itself, and its own tree."""
    from xxhash import xxh64_intdigest

    for batch in batches:
        hosts, digests, trees = [], [], []
        for host, html in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if html:
                page = parse(html)
                hosts.append(host)
                digests.append(xxh64_intdigest(region_text(page, set()).encode()) - (1 << 63))
                trees.append(tree_of(page).pack())
        yield pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(digests, pa.int64()), pa.array(trees, pa.binary())], names=["host", "digest", "tree"])


def _by_host(hosts: list, packed: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(hosts, pa.string()), pa.array(packed, pa.binary())], names=["host", "wrapper"])


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One wrapper per host and task; when many nodes are held, what there is goes out and is merged later."""
    held: dict[str, Wrapper] = {}
    nodes = 0
    for batch in batches:
        for host, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            page = Wrapper.unpack(packed)
            if host in held:
                held[host] = merge(held[host], page)
            else:
                held[host] = page
                nodes += page.size()
        if nodes > HELD_NODES or len(held) > 2000:
            yield _by_host(list(held), [w.pack() for w in held.values()])
            held, nodes = {}, 0
    yield _by_host(list(held), [w.pack() for w in held.values()])


def _merged(group: pa.Table, last: bool = False) -> pa.Table:
    total = None
    for packed in sorted(group["wrapper"].to_pylist()):
        w = Wrapper.unpack(packed)
        total = w if total is None else merge(total, w)
    if last:
        keep_candidates(total, total.pages)
    return pa.Table.from_batches([_by_host([group["host"][0].as_py()], [total.pack()])])


def keep_candidates(wrapper: Wrapper, around: int) -> None:
    """Leave only contents that may stand on CANDIDATE_SHARE of the parent's pages: a count falls short of the true one by no
    more than an equal part of what was taken off."""
    stack = [(wrapper, around)]
    while stack:
        w, pages = stack.pop()
        short = (w.pages - sum(w.seen.values())) / (SUMMARY + 1)
        w.seen = {d: n for d, n in w.seen.items() if n + short >= CANDIDATE_SHARE * pages}
        stack.extend((c, w.pages) for c in w.children)


class Tally:
    """Exact counts of one wrapper's nodes over pages."""

    def __init__(self, packed: bytes):
        self.wrapper = Wrapper.unpack(packed)
        n = len(self.wrapper.numbered())
        self.pages, self.text, self.links, self.hits = [0] * n, [0] * n, [0] * n, {}

    def add(self, page: Wrapper) -> None:
        for w, x in aligned(self.wrapper, page):
            i = w.index
            self.pages[i] += 1
            self.text[i] += x.text
            self.links[i] += x.links
            digest = next(iter(x.seen))
            if digest in w.seen:
                self.hits[i, digest] = self.hits.get((i, digest), 0) + 1

    def pack(self) -> bytes:
        return zlib.compress(pickle.dumps((self.pages, self.text, self.links, self.hits)), 1)


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, wrapper, counts): the counts of each host's pages in this task."""
    held: dict[str, tuple[bytes, Tally]] = {}

    def flush() -> pa.RecordBatch:
        rows = [(h, w, t.pack()) for h, (w, t) in held.items()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], names=["host", "wrapper", "counts"])

    for batch in batches:
        for i, (host, tree) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            if host not in held:
                wrapper = batch.column(2)[i].as_py()
                held[host] = (wrapper, Tally(wrapper))
            held[host][1].add(Wrapper.unpack(tree))
        if len(held) > 500:
            yield flush()
    yield flush()


def _summed(last: bool):
    def run(group: pa.Table) -> pa.Table:
        host, packed = group["host"][0].as_py(), group["wrapper"][0].as_py()
        total = Tally(packed)
        for counts in group["counts"].to_pylist():
            pages, text, links, hits = pickle.loads(zlib.decompress(counts))
            total.pages, total.text, total.links = ([a + b for a, b in zip(x, y, strict=True)] for x, y in ((total.pages, pages), (total.text, text), (total.links, links)))
            for k, n in hits.items():
                total.hits[k] = total.hits.get(k, 0) + n
        if last:
            packed = decide(total.wrapper, total.pages, total.text, total.links, total.hits).pack()
            return pa.table({"host": pa.array([host], pa.string()), "wrapper": pa.array([packed], pa.binary())})
        return pa.table({"host": pa.array([host], pa.string()), "wrapper": pa.array([packed], pa.binary()), "counts": pa.array([total.pack()], pa.binary())})

    return run


def with_wrappers(rows: DataFrame, wrappers: DataFrame) -> DataFrame:
    """Rows with their host's wrapper: a broadcast when all wrappers are small, else a join whose hot hosts are salted."""
    size = wrappers.agg(F.sum(F.length("wrapper") + F.length("host"))).first()[0] or 0
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(wrappers), "host", "left")
    salted = wrappers.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("__salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int")).join(salted, ["host", "__salt"], "left").drop("__salt")


def induce(pages: DataFrame) -> DataFrame:
    """(host, wrapper): one packed wrapper per host over all its pages, its template contents and content region decided.
    Pages with equal main text count once, or an article that is posted again and again would pass for template."""
    trees = pages.select("host", "html").mapInArrow(_trees, "host string, digest long, tree binary")
    # a page's tree is short but costs time: the number of tasks is set, so that it is not taken from the bytes
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    single = trees.repartition(tasks, "host", "digest").dropDuplicates(["host", "digest"])
    single = materialise(single.select("host", "tree"), "trees")
    partial = single.mapInArrow(_partial, "host string, wrapper binary")
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("wrapper"), F.lit(SALTS)))
    step = salted.groupBy("host", "salt").applyInArrow(lambda t: _merged(t), "host string, wrapper binary")
    merged = materialise(step.groupBy("host").applyInArrow(lambda t: _merged(t, True), "host string, wrapper binary"), "merged")
    counted = with_wrappers(single, merged).select("host", "tree", "wrapper").mapInArrow(_tally, "host string, wrapper binary, counts binary")
    salted = counted.withColumn("salt", F.pmod(F.xxhash64("counts"), F.lit(SALTS)))
    first, last = _summed(False), _summed(True)
    step = salted.groupBy("host", "salt").applyInArrow(lambda t: first(t), "host string, wrapper binary, counts binary")
    return step.groupBy("host").applyInArrow(lambda t: last(t), "host string, wrapper binary")


def judged(page: Node, wrapper: Wrapper | None) -> tuple[set[int], Node | None]:
    """ids of the page's elements whose content is template, and the element that is the host's content region."""
    dropped: set[int] = set()
    region = None
    if wrapper is not None:
        for w, x in aligned(wrapper, tree_of(page)):
            if w.seen and next(iter(x.seen)) in w.seen:
                dropped.add(id(x.node))
            if w.content and x.node is not page:
                region = x.node
    return dropped, region


def text_length(node: Node, dropped: set[int]) -> tuple[int, int]:
    """Characters of running text and of link text below a node, without outside regions."""
    text = links = 0
    stack: list = [(node, False)]
    while stack:
        x, in_link = stack.pop()
        if isinstance(x, str):
            n = len(x.strip())
            text += 0 if in_link else n
            links += n if in_link else 0
        elif id(x) not in dropped and not is_outside(x):
            stack.extend((y, in_link or x.tag == "a") for y in x.items)
    return text, links


def related(one: Node, other: Node) -> bool:
    """Whether one of the elements lies in the other."""
    for below, above in ((one, other), (other, one)):
        node: Node | None = below
        while node is not None:
            if node is above:
                return True
            node = node.parent
    return False


def choose_regions(page: Node, dropped: set[int], region: Node | None = None) -> list[Node]:
    """The nodes whose text is the page's main text; `region` is the host's content region on this page."""
    articles: list[Node] = []
    stack = [page]
    while stack:
        node = stack.pop()
        if id(node) in dropped or is_outside(node):
            continue
        if is_article(node) and text_length(node, dropped)[0]:
            inner = [n for n in _within(node, dropped) if n.tag == "article" and n is not node] if node.tag == "main" or node.tag != "article" else []
            articles.append(node) if not inner else stack.extend(reversed(node.children()))
            continue
        stack.extend(reversed(node.children()))
    if region is not None and id(region) not in dropped:
        return [n for n in articles if related(n, region)] or [region]
    if articles:
        return articles
    # no declared article: descend while one child holds most of the running text
    here = page
    while True:
        total = text_length(here, dropped)[0]
        inner = [(text_length(c, dropped), c) for c in here.children() if id(c) not in dropped and not is_outside(c) and c.tag in BLOCKS and c.tag not in ("p", "li", "td", "tr")]
        inner = [(t[0], c) for t, c in inner if t[0] > 2 * t[1]]
        best = max(inner, key=lambda x: x[0], default=None)
        if best is None or best[0] < 0.6 * total or best[1].tag in ("h1", "h2", "h3", "h4", "h5", "h6", "pre", "ul", "ol", "table", "blockquote"):
            return [here]
        if any(c.tag in ("h1", "h2", "h3") and id(c) not in dropped and text_length(c, dropped)[0] for c in here.children()):
            return [here]  # the heading beside the text block belongs to it
        here = best[1]


def _within(node: Node, dropped: set[int]) -> Iterator[Node]:
    stack = [node]
    while stack:
        x = stack.pop()
        if x is not node and (id(x) in dropped or is_outside(x)):
            continue
        yield x
        stack.extend(x.children())


def blocks_of(node: Node, dropped: set[int]) -> list[str]:
    """The text of each block below the node, white space collapsed, empty ones left out."""
    out: list[str] = []
    piece: list[str] = []

    def end() -> None:
        text = " ".join("".join(piece).split())
        piece.clear()
        if text:
            out.append(text)

    stack: list = [node]
    while stack:
        x = stack.pop()
        if x is None:
            end()
        elif isinstance(x, str):
            piece.append(x)
        elif x is not node and (id(x) in dropped or is_outside(x)):
            if x.tag in BLOCKS:
                end()
        elif x.tag == "br":
            piece.append(" ")
        elif x.tag in BLOCKS or x is node:
            end()
            stack.append(None)
            stack.extend(reversed(x.items))
        else:
            stack.extend(reversed(x.items))
    end()
    return out


def region_text(page: Node, dropped: set[int], region: Node | None = None) -> str:
    return "\n".join(b for part in choose_regions(page, dropped, region) for b in blocks_of(part, dropped))


def extract(html: str | None, wrapper: Wrapper | None = None) -> str:
    """Main text of one page, given the wrapper of its host."""
    if not html:
        return ""
    page = parse(html)
    dropped, region = judged(page, wrapper)
    text = region_text(page, dropped, region)
    if not text and dropped:  # every page of the host holds the same: its template is its content
        text = region_text(page, set())
    return text


RESULT = "page_id long, url string, text string, n_chars long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[bytes | None, Wrapper | None] = {None: None}
    for batch in batches:
        texts = []
        for html, packed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            if packed not in known:
                if len(known) > 500:
                    known = {None: None}
                known[packed] = Wrapper.unpack(packed)
            texts.append(extract(html, known[packed]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def main_texts(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    rows = rows.withColumn("host", host_of(F.col("url")))
    bounded_batches(pages.sparkSession)
    wrappers = materialise(induce(rows), "wrappers")
    return with_wrappers(rows, wrappers).select("page_id", "url", "html", "wrapper").mapInArrow(_extract, RESULT)

"""Problem 2: the main body of pages whose text is mixed with the furniture of their site.

Wrapper induction.  A page's text is read as an ordered tree: page, blocks (runs of non-blank lines), lines, and
segments (sentences and menu items) as leaves, labelled by a hash of their masked wording.  Pages of one host are
aligned by simple tree matching (``match``): blocks against blocks, leaves against leaves, order kept.  Nodes that
stay constant over a host's pages become template (the site's own name is masked, so a template learnt on one host
serves for pages on others).  What is left varies: a slot behind a constant head or prefix (lists of
links, pointers, bylines, topic lines) is furniture too, all other varying nodes are content.

Every page is aligned with its next ``NEIGHBOURS`` pages of the host in the order of a min-hash of its labels, which
puts pages with a common template side by side; the number of alignments is linear in the pages.  A host with more
than a share of all pages is split by salts, so a task holds neither a host nor a group of copies in memory.  That
gives a lower bound of the pages a node is matched on, and the pages that hold it are an upper one.  Nodes that the two
leave open are settled by aligning the pages that hold them, each with all others until it is matched (``_settle``).
"""

from __future__ import annotations

import gc
import re
from array import array
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.llm.canonical import transducer
from corvina.llm.pages import site
from corvina.llm.residue import bad_title
from corvina.session import sent_if_small, ship, stage

#: A weaker node, which is no page's title, is one if it was matched on so many pages and such a share of the host's.
WEAK_PAGES, WEAK_SHARE = 8, 0.02

#: A row of more entries than this behind a constant head is a list of links only if they are titles of other pages: all
#: different, and no word in more than such a share of them.  Fewer entries say too little about themselves.
FEW_ENTRIES, COMMON_WORD = 10, 0.6

#: Pages a page is aligned with before it is known which nodes need more.
NEIGHBOURS = 3

#: A node is a host's template if alignments matched it on so many pages and such a share of the host's pages.  As the
#: site's name is masked, a template of one host is taken for one wherever it stands.
LEAST_PAGES, LEAST_SHARE = 3, 0.05

#: A short line that is no page's title, or a prefix of pointers, is a template everywhere if it stands on such a share
#: of all pages and on so many of them.
COMMON_SHARE, COMMON_PAGES = 0.0004, 4

#: A whole line that ends like a sentence is one if it stands on as many pages of different content (see ``_closing``)
#: and on such a share of its pages beside a template node.  Sentences of articles stand there now and then.
BESIDE_SHARE = 0.8

#: Hosts with more than 1 / HOT_PARTS of all pages are split into salts of about that size.
HOT_PARTS = 4096

_ENDS = ".!?。！？…:;"
_CLOSERS = "\"'”’»」』)）】 "
_SEGMENTS = re.compile(r"[|·・•/▸›»<>]+|  +|[.!?]+ |[。！？]+")
_CRUMB = re.compile(r"\s+[»>/›▸|]\s+|\s*[»›▸]\s*")
_CHOICES = re.compile(r"[.!?。！？]\s*[^|.!?。！？]{1,40}\|")  # a sentence with choices behind it: a notice, not a title
_MARK = re.compile("[»>/›▸|]")
_TRAIL = re.compile(r"\s+[»>/›▸]\s+|\s*[»›▸]\s*")
_POINTER = re.compile(r"^([^:»>\d()]{2,30}?)\s*(?::|»|>|›|▸)\s*(\S.{3,110})$")
_DIGITS = re.compile(r"[0-9]+")
_SINGLE = re.compile(r"\S \S")
_WORDY = re.compile(r"[^\W\d_]{3}|[぀-ヿ㐀-鿿가-힣]|[^\x00-\x7f]{2}")
_PAIR = re.compile(r"([A-Z][a-z]+ [A-Z][a-z]+)")
_DASHED = re.compile(r"^[–—*=-]+ (.*\S) [–—*=-]+$")
_LETTER = re.compile(r"[^\W\d_]")
_CJK = re.compile(r"[぀-ヿ㐀-鿿가-힣]")
_BULLET = re.compile(r"^(?:[-*+•◦▪‣–—]|\(?\d{1,3}[.)]|[a-z]\))\s+")
_NUMBERED = re.compile(r"^\d{1,2}\. ")
_VALUE = re.compile(r"^\S{1,14} \([^)]+\)$|[€£$¥%★]|\d\D+\d\D+\d|\d:\d|^#|\S  \S")
_URL = re.compile(r"(?:https?://|www\.)\S+")


def label(text: str) -> int:
    """A signed 64-bit label."""
    value = xxhash.xxh3_64_intdigest(text)
    return value - (1 << 64) if value >= 1 << 63 else value


def ends_sentence(line: str) -> bool:
    """Whether a line ends like a sentence."""
    bare = line.rstrip(_CLOSERS)
    return bool(bare) and (bare[-1] in ".!?。！？…" or bare[-1] > "\U0001f000" and len(bare) > 24)


def is_heading(line: str) -> bool:
    """Whether a line could be the title of a page: short, with letters, not ending like a sentence, no list item, cell or address."""
    return 4 <= len(line) <= 110 and not ends_sentence(line) and line[-1] not in ",;、，" and _LETTER.search(line) is not None and "|" not in line and "\t" not in line and not _URL.search(line)


def words(text: str) -> int:
    """Words of a text; three characters of a script without spaces count as one."""
    cjk = len(_CJK.findall(text))
    return cjk // 3 + len(text.split()) if cjk else len(text.split())


class Line:
    """A line of a page: its wording in one consistent form, what kind of node it is, and the labels of its segments.

    ``prefix`` is the label of a constant prefix before a varying title, if the line may be read so; ``inner`` tells
    that the line before it is long and doesn't end a sentence, so that this one may be wrapped prose.
    """

    __slots__ = ("text", "masked", "kind", "labels", "block", "prefix", "inner")

    def __init__(self, text: str, masked: str, kind: str, labels: list[int], block: int, prefix: int | None = None, inner: bool = False) -> None:
        self.text, self.masked, self.kind, self.labels, self.block, self.prefix, self.inner = text, masked, kind, labels, block, prefix, inner

    @property
    def whole(self) -> int | None:
        """The label of a long line as a whole, which its sentences don't share."""
        if self.kind != "long":
            return None
        return label("W" + self.masked) if len(self.text) <= 180 else self.labels[0]


def parse(text: str, title: str | None, host: str | None) -> list[Line]:
    """The lines of a page.  Kinds: blank, title, crumb, pager, short (no sentence) and long."""
    apply = transducer().apply
    name = re.sub(r"[^\w]+", " ", (host or "").rsplit(".", 1)[0]).strip()
    own = " ".join(apply(title).split()).lower() if title else None
    out, block, blank, open_, seen = [], 0, True, False, 0
    for raw in apply(text).split("\n"):
        line = raw.strip()
        if not line:
            if not blank:
                block += 1
            blank, open_ = True, False
            out.append(Line("", "", "blank", [], block))
            continue
        blank, seen = False, seen + 1
        low = line.lower()
        masked = _DIGITS.sub("0", low)
        if "  " in masked and not _SINGLE.search(masked):
            masked = " ".join(masked.split())  # spaced out, not a row of items
        if len(name) > 3 and name[:4] in masked:
            masked = re.sub(r"\s*".join(map(re.escape, name.split())).replace(r"\s*", r"\s+"), "@", masked)
        kind, labels, prefix = "long", None, None
        flat = " ".join(low.split()) if "  " in low else low
        if own and flat == own:
            kind, labels = "title", []
        elif _LETTER.search(line) is None:
            kind = "pager" if len(line) <= 60 and any(c in line for c in "«»<>…[]") and _DIGITS.search(line) else "short"
            labels = []
        elif len(line) <= 24 and len(line.split()) >= 3 and max(map(len, line.split())) <= 2 and not _CJK.search(line) and not _DIGITS.search(line):
            kind, labels = "pager", []  # a row of icons
        elif len(line) <= 180:
            heading = not ends_sentence(line) and not ("|" in line and _CHOICES.search(line))
            if heading:
                kind = "short"
                marked = _MARK.search(flat) is not None
                crumbs = [c for c in _CRUMB.split(flat) if c] if marked else ()
                if len(crumbs) >= 2 and own and crumbs[-1] == own:
                    kind, labels = "crumb", []
                elif marked and seen <= 4 and 3 <= len(trail := [c for c in _TRAIL.split(flat) if c]) <= 5 and max(map(len, trail[:-1])) <= 24 and (title is None or bad_title(title)):
                    kind, labels = "crumb", []  # the trail's end isn't in the title
                elif "|" not in line and not _URL.search(line):
                    m = _POINTER.match(masked)
                    if m and words(m[2]) >= 3 and not m[2][0].isdigit():
                        prefix = label("P" + m[1].strip())
        if labels is None:
            # A long line is one node: its sentences don't come singly.
            labels = segments(masked) if len(line) <= 180 else [label("L" + masked)]
        # A long line that doesn't end a sentence goes on in the next one: wrapped prose.
        inner, open_ = open_, len(line) >= 50 and kind in ("short", "long") and not ends_sentence(line)
        out.append(Line(line, masked, kind, labels, block, prefix, inner))
    return out


def segments(masked: str) -> list[int]:
    """Labels of the sentences and items of a masked line; those without a word carry none."""
    return [label("L" + s) for s in (p.strip(" .!?–—-") for p in _SEGMENTS.split(masked)) if s and _WORDY.search(s)]


def is_tail(line: Line) -> bool:
    """Whether a line is the end of a sentence begun on the line before: wrapped prose, whatever its frequency."""
    return line.inner and line.kind == "long" and (line.text[0].islower() or len(line.text) <= 24) and "@" not in line.masked


#: Occurrences of a leaf are listed as pairs up to so many; if one recurs more often in both pages, their best matching
#: is found without a list (``_common`` for leaves, ``_heaviest`` for blocks), which has the same weight.
EACH_WITH_EACH = 64


def _recurs(mine: dict[int, list[int]], theirs: dict[int, list[int]]) -> bool:
    return any(len(places) * len(theirs[x]) > EACH_WITH_EACH for x, places in mine.items() if x in theirs)


def _common(p: Sequence[int], q: Sequence[int]) -> list[int]:
    """A longest common subsequence; a row of its table is one integer with a bit per place of ``q``."""
    at: dict[int, int] = {}
    for j, x in enumerate(q):
        at[x] = at.get(x, 0) | 1 << j
    every = (1 << len(q)) - 1
    rows = [every]  # a bit is clear where the length grows
    for x in p:
        row = rows[-1]
        hit = row & at.get(x, 0)
        rows.append((row + hit | row - hit) & every)
    out, j = [], len(q) - 1
    for i in range(len(p) - 1, -1, -1):
        while j >= 0 and rows[i + 1] >> j & 1:
            j -= 1
        if j < 0:
            break
        if rows[i] >> j & 1:  # it grows at this place with p[i] only
            out.append(p[i])
            j -= 1
    return out[::-1]


#: Cells of a table of weights that is kept whole; a larger one is halved.
MOST_CELLS = 4_000_000


def _heaviest(weights: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> list[tuple[int, int]]:
    """The (row, column) kinds of the heaviest chain of two sequences of kinds, whose pairs weigh ``weights``."""

    def best(rows: np.ndarray, columns: np.ndarray, kept: list | None = None) -> np.ndarray:
        row = np.zeros(len(columns) + 1, dtype=np.int64)
        for kind in rows:
            if kept is not None:
                kept.append(row)
            new = np.zeros_like(row)
            np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights[kind, columns]), out=new[1:])
            row = new
        return row

    if len(rows) > 1 and len(rows) * len(columns) > MOST_CELLS:
        half = len(rows) // 2
        split = int(np.argmax(best(rows[:half], columns) + best(rows[half:][::-1], columns[::-1])[::-1]))
        return _heaviest(weights, rows[:half], columns[:split]) + _heaviest(weights, rows[half:], columns[split:])
    kept: list[np.ndarray] = []
    kept.append(best(rows, columns, kept))
    out, j = [], len(columns)
    for i in range(len(rows), 0, -1):
        while j and kept[i][j] == kept[i][j - 1]:
            j -= 1
        if j and kept[i][j] != kept[i - 1][j]:
            out.append((int(rows[i - 1]), int(columns[j - 1])))
            j -= 1
    return out[::-1]


def _chain(pairs: dict[tuple[int, int], int], width: int) -> list[tuple[int, int]]:
    """The heaviest chain of (i, j) pairs in which both numbers rise; ``width`` is above every j.

    A tree of prefix maxima over j keeps it at the number of pairs times a logarithm, whatever the sizes.
    """
    ordered = sorted(pairs)
    if all(i < k and j < m for (i, j), (k, m) in zip(ordered, ordered[1:])):
        return ordered  # one chain already, as for most pages of a template
    best: list[tuple[int, tuple | None]] = [(0, None)] * (width + 1)
    top: tuple[int, tuple | None] = (0, None)
    rows: dict[int, list[int]] = {}
    for i, j in ordered:
        rows.setdefault(i, []).append(j)
    for i in rows:
        new = []
        for j in rows[i]:
            before = (0, None)
            k = j
            while k:
                if best[k][0] > before[0]:
                    before = best[k]
                k &= k - 1
            new.append((j, (before[0] + pairs[i, j], ((i, j), before[1]))))
        for j, state in new:
            if state[0] > top[0]:
                top = state
            k = j + 1
            while k <= width:
                if state[0] > best[k][0]:
                    best[k] = state
                k += k & -k
    out, link = [], top[1]
    while link is not None:
        out.append(link[0])
        link = link[1]
    return out


def _places(nodes: Sequence[int]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for i, x in enumerate(nodes):
        out.setdefault(x, []).append(i)
    return out


def match(a: Sequence[Sequence[int]], b: Sequence[Sequence[int]]) -> set[int]:
    """Labels of the leaves matched by simple tree matching of two trees of blocks of leaves.

    The recursion is the usual one: the weight of two nodes is one (if their labels agree) plus that of the best
    order-preserving matching of their children.  Only nodes that can add weight are looked at: leaves that occur on
    both sides, and blocks that share some, so pages of any length are matched in order.
    """
    shared = {x for block in a for x in block} & {x for block in b for x in block}
    if not shared:
        return shared
    a = [p for p in ([x for x in block if x in shared] for block in a) if p]
    b = [p for p in ([x for x in block if x in shared] for block in b) if p]
    if len(a) == 1 and len(b) == 1:
        return set(_leaves(a[0], b[0])[1])
    mine, theirs = ({}, {})
    for places, blocks in ((mine, a), (theirs, b)):
        for i, block in enumerate(blocks):
            for x in dict.fromkeys(block):
                places.setdefault(x, []).append(i)
    if _recurs(mine, theirs):
        return _blocks(a, b)
    inner: dict[tuple[int, int], list[int]] = {}
    weights: dict[tuple[int, int], int] = {}
    for x in shared:
        for i in mine[x]:
            for j in theirs[x]:
                if (i, j) not in weights:
                    weights[i, j], inner[i, j] = _leaves(a[i], b[j])
    return {x for pair in _chain(weights, len(b)) for x in inner[pair]}


def _leaves(p: list[int], q: list[int]) -> tuple[int, list[int]]:
    """Weight and matched labels of two blocks."""
    if len(p) == 1 or len(q) == 1:
        one, many = (p[0], q) if len(p) == 1 else (q[0], p)
        return (2, [one]) if one in many else (0, [])
    if p == q:
        return len(p) + 1, p
    mine, theirs = _places(p), _places(q)
    if _recurs(mine, theirs):
        out = _common(p, q)
    else:
        pairs = {(i, j): 1 for x, places in mine.items() if x in theirs for i in places for j in theirs[x]}
        out = [p[i] for i, _ in _chain(pairs, len(q))]
    return len(out) + 1, out


def _blocks(a: list[list[int]], b: list[list[int]]) -> set[int]:
    """What ``match`` returns, for pages in which a leaf recurs in many blocks: blocks of one wording are weighed once."""
    mine, theirs = {}, {}
    rows = np.array([mine.setdefault(tuple(x), len(mine)) for x in a])
    columns = np.array([theirs.setdefault(tuple(x), len(theirs)) for x in b])
    holders: dict[int, list[int]] = {}
    for block, j in theirs.items():
        for x in set(block):
            holders.setdefault(x, []).append(j)
    kinds = list(theirs)
    weights = np.zeros((len(mine), len(theirs)), dtype=np.int64)
    for block, i in mine.items():
        for j in {j for x in set(block) for j in holders.get(x, ())}:
            weights[i, j] = _leaves(list(block), list(kinds[j]))[0]
    own = list(mine)
    return {x for i, j in set(_heaviest(weights, rows, columns)) for x in _leaves(list(own[i]), list(kinds[j]))[1]}


_TREE = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("url", T.StringType()),
        T.StructField("least", T.LongType()),
        T.StructField("leaves", T.ArrayType(T.LongType())),
        T.StructField("blocks", T.ArrayType(T.IntegerType())),
        T.StructField("short", T.ArrayType(T.LongType())),
        T.StructField("title", T.LongType()),
        T.StructField("prose", T.ArrayType(T.LongType())),
        T.StructField("ended", T.ArrayType(T.LongType())),
        T.StructField("before", T.ArrayType(T.LongType())),
        T.StructField("after", T.ArrayType(T.LongType())),
    ]
)
_TREE_NAMES = _TREE.fieldNames()


@contextmanager
def few_collections() -> Iterator[None]:
    """Let the garbage collector run seldom: pages are read into many small objects without cycles, which need none."""
    before = gc.get_threshold()
    gc.set_threshold(200_000, 20, 100)
    try:
        yield
    finally:
        gc.set_threshold(*before)


def _trees(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    with few_collections():
        yield from _read_trees(batches)


def _read_trees(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    schema = pa.schema([("host", pa.string()), ("url", pa.string()), ("least", pa.int64()), ("leaves", pa.list_(pa.int64())), ("blocks", pa.list_(pa.int32())), ("short", pa.list_(pa.int64())), ("title", pa.int64()), ("prose", pa.list_(pa.int64())), ("ended", pa.list_(pa.int64())), ("before", pa.list_(pa.int64())), ("after", pa.list_(pa.int64()))])
    for batch in batches:
        columns: list[list] = [[] for _ in _TREE_NAMES]
        for host, url, title, text in zip(*(c.to_pylist() for c in batch.columns)):
            leaves, blocks, short, prose = [], [], set(), set()
            own = label("L" + " ".join(_DIGITS.sub("0", transducer().apply(title).lower()).split()).strip(" .!?")) if title else None
            ended: dict[int, list[int]] = {}  # long lines that don't name their site: the nodes before and behind
            before, open_ = 0, None
            for line in parse(text, title, host):
                if line.kind != "blank":
                    first, last = _ends_of(line)
                    if open_ is not None:
                        open_[1] = first
                    open_ = None
                    if line.kind == "long" and not is_tail(line) and not _plain(line) and (whole := line.whole) not in ended:
                        open_ = ended[whole] = [before, 0]
                    before = last
                if is_tail(line):
                    continue
                nodes = line.labels if line.prefix is None else [line.prefix, *line.labels]
                leaves += nodes
                blocks += [line.block] * len(nodes)
                if line.prefix is not None and not line.inner:
                    short.add(line.prefix)
                if _plain(line):
                    short.update(line.labels)
                elif line.kind == "long" and len(line.masked) > 20:
                    m = _POINTER.match(line.masked[:100])
                    if m:
                        prose.add(label("P" + m[1].strip()))
            # Rare leaves vary from page to page; the least of the mixed labels is the same for pages that share most.
            least = min(((x * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF for x in leaves), default=0) >> 1
            for column, value in zip(columns, (host, url, least, leaves, blocks, list(short), own, list(prose), list(ended), [x[0] for x in ended.values()], [x[1] for x in ended.values()])):
                column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _ends_of(line: Line) -> tuple[int, int]:
    """Labels of a line's first and last node: ``FIXED`` for crumbs and pagers, 0 for titles and lines without a word."""
    if line.kind in ("crumb", "pager"):
        return FIXED, FIXED
    if line.prefix is not None:
        return line.prefix, line.prefix
    return (line.labels[0], line.labels[-1]) if line.labels else (0, 0)


#: Stands for a node that is furniture on any page.
FIXED = 1


def _plain(line: Line) -> bool:
    """Whether a line could be furniture by its frequency alone: a short one, or an exclamation; no list item, cell or value."""
    masked = line.masked
    if "@" in masked and len(masked) <= 200:
        return True  # it names its own site
    dashed = _DASHED.match(masked)
    if dashed:
        masked = dashed[1]
    if line.kind != "short" and not (masked.endswith("!") and len(masked) <= 60):
        return False
    return len(masked) <= 160 and not _BULLET.match(masked) and "0" not in masked and ":" not in masked and "|" not in masked and "\t" not in masked and masked.count(",") < 2


def trees(search: DataFrame) -> DataFrame:
    """One labelled tree per page of (url, title, text); null and hostless URLs and null texts have none."""
    ship(search.sparkSession)
    pages = search.select(site(F.col("url")).alias("host"), "url", "title", "text").where("host IS NOT NULL AND text IS NOT NULL")
    return pages.mapInArrow(_trees, _TREE)


def _blocks_of(leaves: Iterable[int], numbers: Iterable[int]) -> list[list[int]]:
    out: list[list[int]] = []
    last = None
    for leaf, number in zip(leaves, numbers):
        if number != last:
            out.append([])
            last = number
        out[-1].append(leaf)
    return out


_SUPPORT = "host string, label long, pages long, matched long, titles long, prose long, short boolean"


def _align(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Counts per (host, label) from pages sorted by host and min-hash; each page meets its next NEIGHBOURS pages."""
    counts: dict[tuple[str, int], list] = {}
    window: list[tuple] = []  # (host, salt, blocks of leaves, matched labels, leaves, short, title, prose)

    def close(page: tuple) -> None:
        host, _, _, matched, leaves, short, title, prose = page
        for x in matched | set(short):
            row = counts.setdefault((host, x), [0, 0, 0, 0, False])
            row[0] += 1
            row[1] += x in matched
        for x in short:
            counts[host, x][4] = True
        if title is not None:
            counts.setdefault((host, title), [0, 0, 0, 0, False])[2] += 1
        for x in prose:
            counts.setdefault((host, x), [0, 0, 0, 0, False])[3] += 1

    def flush() -> pa.RecordBatch:
        keys, values = list(counts), list(counts.values())
        counts.clear()
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64())]
        columns += [pa.array([v[i] for v in values], pa.int64()) for i in range(4)] + [pa.array([v[4] for v in values], pa.bool_())]
        return pa.RecordBatch.from_arrays(columns, ["host", "label", "pages", "matched", "titles", "prose", "short"])

    for batch in batches:
        for host, salt, leaves, numbers, short, title, prose in zip(*(c.to_pylist() for c in batch.columns)):
            while window and (window[0][:2] != (host, salt) or len(window) > NEIGHBOURS):
                close(window.pop(0))
            page = (host, salt, _blocks_of(leaves, numbers), set(), leaves, short, title, prose)
            if any(other[4] == leaves for other in window):
                if title is not None:
                    counts.setdefault((host, title), [0, 0, 0, 0, False])[2] += 1
                continue  # a copy of a page already there says nothing about what is constant
            for other in window:
                found = match(other[2], page[2])
                other[3].update(found)
                page[3].update(found)
            window.append(page)
        if len(counts) > 200_000:
            yield flush()
    for page in window:
        close(page)
    yield flush()


_SETTLED = "host string, label long, pages long, matched long"


def _settle(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    """Counts per (host, label) from the different pages that hold the label, sorted by both.

    A page is matched if its alignment with any other page matches the label.  No pair of pages is left out but those of
    which both are matched already.  A label matched on ``enough`` pages is settled.
    """
    group: tuple | None = None
    rows: list[tuple] = []
    alone, done = [], []  # pages not matched yet, and matched: (leaves, blocks, short)
    shorts = 0

    def flush() -> pa.RecordBatch:
        columns = [pa.array([r[i] for r in rows], pa.string() if i == 0 else pa.int64()) for i in range(4)]
        rows.clear()
        return pa.RecordBatch.from_arrays(columns, ["host", "label", "pages", "matched"])

    def close() -> None:
        if group is not None:
            rows.append((*group, len(done) + shorts, len(done)))

    for batch in batches:
        for host, x, leaves, numbers, short, enough in zip(*(c.to_pylist() for c in batch.columns)):
            if (host, x) != group:
                close()
                group, alone, done, shorts = (host, x), [], [], 0
            if len(done) >= enough:
                continue
            page, tree = (array("q", leaves), array("i", numbers), short), _blocks_of(leaves, numbers)
            meets = [x in match(_blocks_of(*other[:2]), tree) for other in alone]
            found = any(meets) or any(x in match(_blocks_of(*other[:2]), tree) for other in reversed(done))
            done += [other for other, met in zip(alone, meets) if met]
            alone = [other for other, met in zip(alone, meets) if not met]
            (done if found else alone).append(page)
            shorts = sum(other[2] for other in alone)  # short pages that aren't matched
        if len(rows) > 100_000:
            yield flush()
    close()
    yield flush()


def _closing(pages: DataFrame, first: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """(label) of whole lines that end like a sentence and are template by their place in the corpus.

    Such a line must stand on ``least`` pages of different content and mostly beside template nodes (``first``).  A
    page's content is told by the least label of its sentences that stand on fewer pages than that: a sentence of a text
    that was copied so often has no such company, or always the same.
    """
    spark = pages.sparkSession
    often = pages.select(F.explode("ended").alias("label")).groupBy("label").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    # Bounded: no more than the mean number of sentences of a page divided by COMMON_SHARE.
    sent = spark.sparkContext.broadcast(np.array([row.label for row in often.select("label").collect()], dtype=np.int64))

    def look(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        frequent = set(sent.value.tolist())
        for batch in batches:
            out: list[tuple] = []
            for ended, before, after in zip(*(c.to_pylist() for c in batch.columns)):
                mine = [i for i, x in enumerate(ended) if x in frequent]
                if not mine:
                    continue
                rest = min((x for x in ended if x not in frequent), default=None)
                out += [(ended[i], before[i], after[i], rest) for i in mine]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(4)], ["label", "before", "after", "rest"])

    places = pages.select("ended", "before", "after").mapInArrow(look, "label long, before long, after long, rest long")
    side = lambda name: first.select(F.col("label").alias(name), F.lit(True).alias("at_" + name))
    places = places.join(side("before"), "before", "left").join(side("after"), "after", "left")
    beside = F.col("at_before").isNotNull() | F.col("at_after").isNotNull() | (F.col("before") == FIXED) | (F.col("after") == FIXED)
    found = places.groupBy("label").agg(F.count("*").alias("n"), F.count_if(beside).alias("beside"), F.count_distinct("rest").alias("contents"))
    found = found.where((F.col("contents") >= least) & (F.col("beside") >= F.col("n") * BESIDE_SHARE))
    return found.join(titles, "label", "left_anti").select("label")


def template(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(label) of the template nodes, from trees and the documents table (which gives the size of each host)."""
    spark = documents.sparkSession
    ship(spark)
    sizes = documents.groupBy(site(F.col("url")).alias("host")).agg(F.count("*").alias("host_pages")).where("host IS NOT NULL")
    total = documents.count()
    # At most HOT_PARTS hosts can have more than that share of all pages.
    hot = sizes.where(F.col("host_pages") * HOT_PARTS > total).select("host", F.ceil(F.col("host_pages") * HOT_PARTS / F.lit(max(total, 1)) / 64).alias("salts"))
    # Copies of a page stand side by side, so that each is left out of the alignments.
    copy = F.xxhash64("leaves").alias("copy")
    salted = pages.withColumn("copy", copy).join(F.broadcast(hot), "host", "left").withColumn("salt", F.pmod("copy", F.coalesce("salts", F.lit(1).cast("long"))))
    ordered = salted.repartition("host", "salt").sortWithinPartitions("host", "salt", "least", "copy", "url")
    counts = ordered.select("host", "salt", "leaves", "blocks", "short", "title", "prose").mapInArrow(_align, _SUPPORT)
    sums = [F.sum(c).alias(c) for c in ("pages", "matched", "titles", "prose")] + [F.max("short").alias("short")]
    # Copies of a page took no part in the alignment, so they don't count among the pages of their host either.
    different = pages.select("host", copy).distinct().groupBy("host").agg(F.count("*").alias("host_pages"))
    # A node is matched on as many pages as hold it at most.
    held = pages.select("host", F.explode(F.array_distinct("leaves")).alias("label")).groupBy("host", "label").agg(F.count("*").alias("held")).where("held > 1")
    nodes = counts.groupBy("host", "label").agg(*sums).join(held, ["host", "label"], "full").na.fill(0).na.fill(False)
    nodes = stage(nodes.join(different, "host").withColumn("held", F.greatest("held", "pages")), "support")
    least = max(COMMON_PAGES, COMMON_SHARE * total)
    world = stage(_judged(nodes, sums, least).where("template OR titles > 0 OR open"), "nodes")
    first = world.where("template").select("label").unionByName(_open(pages, nodes, world.where("open"), sums, least))
    closing = _closing(pages, first, world.where("titles > 0").select("label"), least)
    return first.unionByName(closing).distinct()


def _enough(least: int, share: float) -> Column:
    return F.greatest(F.lit(least), F.ceil(F.col("host_pages") * share))


def _judged(nodes: DataFrame, sums: list[Column], least: float) -> DataFrame:
    """(label, titles, template, common, open): whether a label is template by the pages it was matched on so far; whether
    it would be by the pages that hold it (``open``), and then by its frequency everywhere (``common``)."""
    over = lambda count, pages, share: F.max((F.col(count) >= pages) & (F.col(count) >= F.col("host_pages") * share))
    world = nodes.groupBy("label").agg(
        over("matched", LEAST_PAGES, LEAST_SHARE).alias("here"), over("matched", WEAK_PAGES, WEAK_SHARE).alias("weak"),
        over("held", LEAST_PAGES, LEAST_SHARE).alias("here_most"), over("held", WEAK_PAGES, WEAK_SHARE).alias("weak_most"), F.sum("held").alias("held"), *sums,
    )
    common = lambda pages: F.col("short") & (F.col("titles") == 0) & (F.col(pages) >= least) & (F.col("prose") * 4 <= F.col(pages))
    template = F.col("here") | (F.col("weak") & (F.col("titles") == 0)) | common("pages")
    most = F.col("here_most") | (F.col("weak_most") & (F.col("titles") == 0)) | common("held")
    return world.select("label", "titles", template.alias("template"), common("held").alias("common"), (most & ~template).alias("open"))


def _open(pages: DataFrame, nodes: DataFrame, undecided: DataFrame, sums: list[Column], least: float) -> DataFrame:
    """(label) of those ``undecided`` that are template once all pages that hold them are aligned."""
    undecided = sent_if_small(undecided.select("label", "titles", "common"), "undecided", MOST_SENT)
    mine = stage(nodes.join(undecided.withColumnRenamed("titles", "named"), "label"), "open")
    # Where a label can't reach what makes it template, its pages count only for its frequency everywhere.
    weak = (F.col("named") == 0) & (F.col("held") >= WEAK_PAGES) & (F.col("held") >= F.col("host_pages") * WEAK_SHARE)
    here = (F.col("held") >= LEAST_PAGES) & (F.col("held") >= F.col("host_pages") * LEAST_SHARE)
    enough = F.least(_enough(LEAST_PAGES, LEAST_SHARE), F.when(F.col("named") == 0, _enough(WEAK_PAGES, WEAK_SHARE)))
    asked = sent_if_small(mine.where((F.col("held") > 1) & (F.col("common") | here | weak)).select("host", "label", enough.alias("enough")), "asked", MOST_SENT)
    named = pages.withColumn("copy", F.xxhash64("leaves"))
    holders = named.select("host", "copy", F.explode(F.array_distinct("leaves")).alias("label")).join(asked, ["host", "label"]).distinct()
    holders = sent_if_small(holders, "holders", MOST_SENT)
    one = named.join(holders.select("host", "copy").distinct(), ["host", "copy"], "left_semi").groupBy("host", "copy").agg(F.min(F.struct("url", "leaves", "blocks", "short")).alias("page"))
    rows = one.join(holders, ["host", "copy"]).select("host", "label", "copy", "page.leaves", "page.blocks", F.expr("array_contains(page.short, label)").alias("short"), "enough")
    rows = rows.repartition("host", "label").sortWithinPartitions("host", "label", "copy").select("host", "label", "leaves", "blocks", "short", "enough")
    settled = rows.mapInArrow(_settle, _SETTLED).select("host", "label", F.col("pages").alias("all_pages"), F.col("matched").alias("all_matched"))
    whole = mine.drop("common").join(settled, ["host", "label"], "left")
    whole = whole.withColumns({"pages": F.greatest("pages", "all_pages"), "matched": F.greatest("matched", "all_matched")})
    return _judged(whole, sums, least).where("template").select("label")


#: Up to so many template labels (8 bytes each) are sent to the workers; beyond that they are joined to the pages.
MOST_SENT = 200_000


def with_template(pages: DataFrame, documents: DataFrame) -> tuple[DataFrame, Broadcast | None]:
    """(url, host, title, text) pages with what ``classify`` needs of the template.

    Either a broadcast of all template labels, if their number (counted, not guessed) is within ``MOST_SENT``, or a
    column ``template`` with those of the labels ``classify`` asks for on the page, joined by shuffle.
    """
    forest = stage(trees(pages), "trees")
    nodes = stage(template(forest, documents), "template")
    held = site(F.col("url")).alias("host")
    if nodes.count() <= MOST_SENT:
        labels = np.sort(np.array([row.label for row in nodes.collect()], dtype=np.int64))
        return pages.select("url", held, "title", "text"), pages.sparkSession.sparkContext.broadcast(labels)
    rows = pages.select("url", held, "title", "text")
    found = rows.mapInArrow(_asked, "url string, label long").join(nodes, "label")
    found = found.groupBy("url").agg(F.collect_set("label").alias("template"))
    return rows.join(found, "url", "left"), None


def _asked(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
    for batch in batches:
        urls, labels = [], []
        for url, host, title, text in zip(*(c.to_pylist() for c in batch.columns)):
            own = asked(parse(text, title, host)) if text is not None else ()
            urls += [url] * len(own)
            labels += own
        yield pa.RecordBatch.from_arrays([pa.array(urls, pa.string()), pa.array(labels, pa.int64())], ["url", "label"])


def other_site(line: Line) -> list[int]:
    """Labels of a line with another site's name masked, as on a page that was copied from it."""
    name = _PAIR.search(line.text)
    return segments(line.masked.replace(name[1].lower(), "@")) if name else []


def asked(lines: Sequence[Line]) -> set[int]:
    """Every label that ``classify`` may look up for the lines of a page."""
    out: set[int] = set()
    for line in lines:
        if line.labels:
            out.update(line.labels)
            out.update(x for x in (line.whole, line.prefix) if x is not None)
            if len(line.text) <= 180 and not line.inner:
                out.update(other_site(line))
    return out


def classify(lines: Sequence[Line], constant: set[int]) -> list[bool]:
    """For each line, whether it is furniture.  Blank lines are neither and come out False."""
    out = [False] * len(lines)
    fixed = [False] * len(lines)  # constant nodes
    for i, line in enumerate(lines):
        if line.kind in ("crumb", "pager"):
            out[i] = True
        elif line.labels and not (is_tail(line) and not out[i - 1]) and not ("|" in line.text and i + 1 < len(lines) and _heads(line.text, lines[i + 1].text)):
            fixed[i] = out[i] = sum(x in constant for x in line.labels) * 2 > len(line.labels) or line.whole in constant
            if not out[i] and len(line.text) <= 180:
                if line.prefix in constant and (not line.inner or out[i - 1]):
                    out[i] = True
                elif not line.inner:
                    other = other_site(line)
                    fixed[i] = out[i] = bool(other) and sum(x in constant for x in other) * 2 > len(other)
    # The slot behind a constant line: two or more lines that could be titles, up to the page's own title.
    i = 0
    while i < len(lines):
        if fixed[i] and lines[i].kind in ("short", "long"):
            j = i + 1
            # An entry that is constant itself doesn't end the list.
            while j < len(lines) and (not out[j] or j > i + 1) and lines[j].kind == "short" and _item(lines[j].text):
                j += 1
            run = j - i - 1
            if run >= 2 and _titles([lines[k] for k in range(i + 1, j) if not out[k]]) or run == 1 and _NUMBERED.match(lines[i + 1].text):
                for k in range(i + 1, j):
                    out[k] = True
            i = max(j, i + 1)
        else:
            i += 1
    return out


def _heads(line: str, below: str) -> bool:
    """Whether a line without numbers is the head of a table, with a row of as many cells and numbers below."""
    return line.count("|") == below.count("|") and not _DIGITS.search(line) and _DIGITS.search(below) is not None


def _titles(entries: Sequence[Line]) -> bool:
    """Whether entries could be titles of different pages, however many they are."""
    if len(entries) <= FEW_ENTRIES:
        return True
    forms = [_NUMBERED.sub("", x.text).lower() for x in entries]
    if len(set(forms)) < len(forms):
        return False
    held = Counter(w for form in forms for w in {x for x in form.split() if len(x) > 3})
    return max(held.values(), default=0) <= COMMON_WORD * len(forms)


def _item(line: str) -> bool:
    """Whether a line could be an entry in a list of links."""
    bare = _NUMBERED.sub("", line)
    return is_heading(bare) and 3 <= words(bare) <= 12 and len(bare) <= 80 and not _BULLET.match(bare) and bare.count(",") < 2 and not _VALUE.search(bare)

"""One pass over pages that yields what problems 2, 4, 5, 7 and 10 need of their main bodies."""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from corvina.llm import bodies, residue
from corvina.llm.layout import classify, few_collections, parse, with_template
from corvina.session import ship

#: Kinds of units that are stuffed matter.
STUFFED = (bodies.LINKS, bodies.PRODUCTS, bodies.KEYWORDS, bodies.ROWS)

#: Labelling functions on the statistics of a body (``votes``).  Each votes for prose (P), against it (N), for a list (L),
#: a table (T), unreadable matter (J), or not at all (0).
VOTES = 8

_PAGE = "url string, furniture array<int>, residue boolean, body_chars long, stuffed double, votes string"
_PAGE_SCHEMA = pa.schema([("url", pa.string()), ("furniture", pa.list_(pa.int32())), ("residue", pa.bool_()), ("body_chars", pa.int64()), ("stuffed", pa.float64()), ("votes", pa.string())])


#: Rows that a list of frequent words may have; it is read to the driver, so a larger table is refused.
MOST_WORDS = 100_000


def listed_words(words: DataFrame) -> list:
    """The rows (lang, word) of the list of frequent words, a small fixed table; raises beyond ``MOST_WORDS`` rows."""
    rows = words.select("lang", "word").distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"the list of common words has more than {MOST_WORDS} rows")
    return rows


def common_words(words: DataFrame) -> frozenset[str]:
    """The frequent words of all languages, in lower case."""
    return frozenset(row.word.lower() for row in listed_words(words) if row.word)


def _vote(value: float, low: float, high: float, under: str, over: str) -> str:
    return over if value >= high else under if value <= low else "0"


# The type each kind of unit belongs to.
_TYPE = {bodies.PROSE: "P", bodies.HEADING: "P", bodies.LIST: "L", bodies.TABLE: "T", bodies.JUNK: "J", bodies.LINKS: "L", bodies.PRODUCTS: "L", bodies.KEYWORDS: "L", bodies.ROWS: "L"}


def vote(page: Page, common: frozenset[str]) -> str:
    """The labelling functions' votes on a body.

    In order: the type that holds most characters by the look of the units, share of characters in units that end in
    punctuation, share of common words, symbol ratio, digit ratio, mean length of units, share of words that are the
    body's most frequent ones, mean word length.  Thresholds on words don't apply to scripts without spaces.
    """
    parts, kinds = page.units, page.kinds
    total = sum([len(u.text) for u in parts])
    if not total:
        return "0" * VOTES
    text = "\n".join([u.text for u in parts])
    words = sum([len(u.words) for u in parts])
    east = not text.isascii() and bodies._EAST.search(text) is not None
    held = dict.fromkeys("PLTJ", 0.0)
    for kind, share in enumerate(kinds):
        held[_TYPE[kind]] += share
    most = max(held, key=held.get)
    look = "P" if held["P"] > 0.5 else most if most != "P" else max("LTJ", key=held.get)
    ends = _vote(sum([len(u.text) for u in parts if u.ended]) / total, 0.35, 0.6, "N", "P")
    often = length = "0"
    if not east and words >= 5:
        often = _vote(sum([u.common for u in parts]) / words, 0.08, 0.18, "N", "P")
        mean = sum([len(w) * n for w, n in page.counts.items()]) / words
        length = "J" if mean >= 10 else "N" if mean >= 6.5 or mean < 3 else "P"
    symbols = _vote(len(bodies._SYMBOL.findall(text)) / total, 0.05, 0.12, "P", "J")
    digits = _vote(sum(map(text.count, "0123456789")) / total, 0.05, 0.15, "P", "T")
    long = _vote(total / len(parts), 14 if east else 25, 30 if east else 55, "L", "P")
    top = "0"
    if words >= 20:
        most_ = heapq.nlargest(4, [n for w, n in page.counts.items() if n > 1 and len(w) > 1 and w not in common and not "ぁ" <= w[0] <= "ゖ"])
        top = _vote(sum(most_) / words, 0.2, 0.3, "P", "L")
    return look + ends + often + symbols + digits + long + top + length


class Page:
    """A page read: its furniture, whether it is residue (its body replaced, or a placeholder left in), and its main body in units."""

    __slots__ = ("furniture", "residue", "replaced", "units", "kinds", "forms", "counts")

    def __init__(self, text: str, title: str | None, host: str | None, template: set[int], common: frozenset[str]) -> None:
        lines = parse(text, title, host)
        self.forms = [x.text for x in lines]
        gone = classify(lines, template)
        for i, line in enumerate(lines):
            # A short notice that some features need scripts is furniture beside other content.
            if gone[i] and line.kind in ("short", "long") and residue.is_machine_text(line.text):
                gone[i] = False  # frequent though it is, it stands in the place of content
            elif not gone[i] and line.kind != "blank" and residue.is_notice(line.text) and not line.inner:
                gone[i] = True
        kept = bodies.paragraphs(lines, gone)
        if not kept:  # nothing beside notices: they are the body
            kept = [x.text for x in lines if residue.is_notice(x.text)]
        self.furniture = [i + 1 for i, g in enumerate(gone) if g]
        cut = list(map(bodies.pieces, kept))
        self.replaced = residue.replaced([piece for part in cut for piece in part])
        self.residue = self.replaced or residue.placeholders("\n".join(self.forms))
        self.units = bodies.units(kept, cut)
        self.counts = bodies.describe(self.units, common)
        self.kinds = bodies.shares(self.units)


def read_pages(pages: DataFrame, documents: DataFrame, words: DataFrame, each, schema: str) -> DataFrame:
    """``each`` applied to batches of pages of (url, title, text) read as ``Page``; rows with a null text are left out.

    ``each`` gets an iterator of (url, Page, text) and yields record batches of ``schema``.
    """
    ship(pages.sparkSession)
    rows, sent = with_template(pages.where("text IS NOT NULL"), documents)
    common = common_words(words)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterable[pa.RecordBatch]:
        everywhere = set(sent.value.tolist()) if sent is not None else None

        def read():
            for batch in batches:
                columns = [c.to_pylist() for c in batch.columns]
                for url, host, title, text, *own in zip(*columns):
                    template = everywhere if everywhere is not None else set(own[0] or ())
                    yield url, Page(text, title, host, template, common), text

        with few_collections():
            yield from each(read())

    return rows.mapInArrow(run, schema)


def analyse(pages: DataFrame, documents: DataFrame, words: DataFrame) -> DataFrame:
    """(url, furniture, residue, body_chars, stuffed, votes) of every page with a text.

    ``furniture`` holds the numbers (from 1) of the lines outside the main body, ``stuffed`` the share of the body's
    characters in lists of links, products and keywords, ``votes`` one character per labelling function.
    """

    def each(read) -> Iterable[pa.RecordBatch]:
        rows: list[tuple] = []
        for url, page, _ in read:
            size = sum(len(u.text) for u in page.units)
            rows.append((url, page.furniture, page.residue, size, sum(page.kinds[k] for k in STUFFED), vote(page, _COMMON.value)))
            if len(rows) >= 2000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    _COMMON = pages.sparkSession.sparkContext.broadcast(common_words(words))
    return read_pages(pages, documents, words, each, _PAGE)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_PAGE_SCHEMA)], schema=_PAGE_SCHEMA)

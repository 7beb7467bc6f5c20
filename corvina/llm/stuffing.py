"""Problem 4: pages made of stuffed keywords, lists of links or product and tag listings.

The neighbouring words of every body are counted over the corpus; addresses, article numbers and other numbers count as
one word each.  Two scores of a body follow from those counts.  ``coherence`` is the mean pointwise mutual information
of its neighbours, each divided by its largest possible value, so that the bounds mean the same in a corpus of any size:
running text lies between ``LOW`` and ``HIGH``, word salad and lists of links below, invented compounds that occur in
one page only above.  ``excess`` is the mean, over all neighbours, of how much more often those that recur in the body
stand there than in the corpus (a logarithm): collocations repeated far more than a text needs lie above ``EXCESS``.

Lists and tables that inform a reader are incoherent too.  So a page flagged by its scores passes a check: units that
are no sentences, tables, bulleted lists or unreadable matter, or sentences full of the body's own keywords
(``suspect``), must hold most of its characters.  Both conditions must hold; the check is looked at first because it
needs the page alone, and so only a few pages' neighbours are shuffled.

Corpus counts are summed per batch of pages before they are shuffled.  Words are 32-bit hashes, so a pair of
neighbours is one 64-bit key.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvina.llm import bodies
from corvina.llm.analysis import STUFFED, Page, common_words, read_pages
from corvina.session import stage

#: Mean normalized mutual information between which neighbours hang together as in running text.
LOW, HIGH = 0.48, 0.78

#: Times a pair of neighbours occurs in a body to be recurring, and the excess from which collocations are stuffed.
RECURS, EXCESS = 3, 1.5

#: A word is a keyword of a sentence's body from such a share of the words, and the sentence suspect from such a share of keywords.
KEYWORD, SUSPECT = 0.05, 0.15

_ROWS = "url string, pair long, n long, size long"
_SCHEMA = pa.schema([("url", pa.string()), ("pair", pa.int64()), ("n", pa.int64()), ("size", pa.int64())])


class _Ids(dict):
    """Hashes of words; those seen are kept, up to a bound."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = value = xxhash.xxh32_intdigest(word)
        return value


def _pairs(units: list[list[str]], known: _Ids) -> np.ndarray:
    """Keys of the neighbouring pairs within each unit: the left word's hash in the upper half, the right one's in the lower."""
    ids = np.array([known[w] for unit in units for w in unit], dtype=np.int64)
    if len(ids) < 2:
        return ids[:0]
    with np.errstate(over="ignore"):
        pairs = (ids[:-1] << 32) | ids[1:]
    ends = np.cumsum([len(unit) for unit in units])[:-1] - 1
    return np.delete(pairs, ends[(ends >= 0) & (ends < len(pairs))])


def suspect(page: Page, common: frozenset[str]) -> float:
    """Share of a body's characters in units that may be stuffed."""
    total = sum(len(u.text) for u in page.units)
    if not total:
        return 0.0
    words = bodies.keywords(page.counts, KEYWORD, common)
    held = 0
    for unit in page.units:
        if unit.kind in STUFFED or unit.kind == bodies.PROSE and len(unit.words) >= 2 and sum([w in words for w in unit.words]) >= SUSPECT * len(unit.words):
            held += len(unit.text)
    return held / total


def _counted(read, common: frozenset[str]) -> Iterable[pa.RecordBatch]:
    """Rows (null, pair, n) summed over many pages, and (url, pair, n, all pairs) of each page that is mostly suspect.

    A page without neighbours has no rows.
    """
    known = _Ids()
    corpus: list[np.ndarray] = []
    held: list[tuple[str | None, np.ndarray, np.ndarray, int]] = []
    size = 0

    def flush() -> pa.RecordBatch:
        if corpus:
            keys, n = np.unique(np.concatenate(corpus), return_counts=True)
            held.append((None, keys, n, 0))
        lengths = [len(h[1]) for h in held]
        columns = [
            pa.array([h[0] for h, k in zip(held, lengths) for _ in range(k)], pa.string()),
            pa.array(np.concatenate([h[1] for h in held]) if held else [], pa.int64()),
            pa.array(np.concatenate([h[2] for h in held]) if held else [], pa.int64()),
            pa.array(np.repeat([h[3] for h in held], lengths) if held else [], pa.int64()),
        ]
        corpus.clear()
        held.clear()
        return pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)

    for url, page, _ in read:
        own = _pairs([unit.marked for unit in page.units if unit.marked], known)
        if not len(own):
            continue
        corpus.append(own)
        size += len(own)
        if not page.replaced and suspect(page, common) > 0.5:  # filler repeats its words too
            keys, n = np.unique(own, return_counts=True)
            held.append((url, keys, n, len(own)))
        if size > 2_000_000:
            yield flush()
            size = 0
    yield flush()


def information(counts: DataFrame) -> DataFrame:
    """(pair, information, rate) from (pair, n), one row per pair: normalized mutual information (-1 to 1) and share of all pairs."""
    left, right = F.shiftright("pair", 32), F.col("pair").bitwiseAND(F.lit(0xFFFFFFFF))
    counts = counts.withColumns({"left": left, "right": right})
    total = counts.agg(F.sum("n").alias("total"))
    lefts = counts.groupBy("left").agg(F.sum("n").alias("left_n"))
    rights = counts.groupBy("right").agg(F.sum("n").alias("right_n"))
    joined = counts.join(lefts, "left").join(rights, "right").crossJoin(F.broadcast(total))  # one row
    mutual = F.log(F.col("n") * F.col("total") / (F.col("left_n").cast("double") * F.col("right_n")))
    rate = F.col("n") / F.col("total")
    # A corpus of one pair only has no information; its largest value is 0.
    return joined.select("pair", F.coalesce(F.try_divide(mutual, -F.log(rate)), F.lit(0.0)).alias("information"), rate.alias("rate"))


def scores(pages: DataFrame, documents: DataFrame, words: DataFrame) -> DataFrame:
    """(url, pairs, coherence, excess) of every page that is mostly suspect."""
    sent = pages.sparkSession.sparkContext.broadcast(common_words(words))
    rows = stage(read_pages(pages, documents, words, lambda read: _counted(read, sent.value), _ROWS), "pairs")
    counts = stage(rows.where("url IS NULL").groupBy("pair").agg(F.sum("n").alias("n")), "counts")
    own = rows.where("url IS NOT NULL")
    lift = F.when(F.col("n") >= RECURS, F.col("n") * F.log(F.col("n") / F.col("size") / F.col("rate"))).otherwise(0.0)
    return own.join(information(counts), "pair").groupBy("url").agg(
        F.sum("n").alias("pairs"),
        (F.sum(F.col("n") * F.col("information")) / F.sum("n")).alias("coherence"),
        (F.sum(lift) / F.sum("n")).alias("excess"),
    )


def stuffed_pages(pages: DataFrame, documents: DataFrame, words: DataFrame) -> DataFrame:
    """(url) of the pages made for search engines."""
    flagged = (F.col("coherence") < LOW) | (F.col("coherence") > HIGH) | (F.col("excess") >= EXCESS)
    return scores(pages, documents, words).where(flagged).select("url")

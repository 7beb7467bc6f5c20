"""Full-text search: postings, evaluation of query trees, BM25, the combined score, filters, facets and suggestions.

Documents are ``(url, title, text)``.  ``postings`` is the gold table (``index.build`` writes it sorted by token); a query
reads the rows of its own tokens only.  Positions of a document's query tokens come together by one aggregation on the
url, and the whole tree is evaluated on those arrays with built-in expressions.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corvina.functions import text as tx
from corvina.functions.urls import host
from corvina.operators import querylang as ql
from corvina.session import stage

K1, B = 1.2, 0.75

#: Least inverse document frequency of a phrase.
LEAST_IDF = 1e-6

#: Most links into a document that count, and most links out of a source that counts.
MOST_INBOUND, MOST_OUTBOUND = 8, 50

COLUMNS = ("title", "text")


def occurrences(documents: DataFrame) -> DataFrame:
    """(token, url, field, pos, length): every token where it stands, and how long its document is.  Null titles and texts have no tokens."""
    held = documents.select("url", *[tx.tokens(F.col(c)).alias(c) for c in COLUMNS])
    length = reduce(Column.__add__, [F.size(c) for c in COLUMNS])
    rows = held.select("url", length.alias("length"), F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("tokens")) for c in COLUMNS])).alias("f"))
    return rows.select("url", "length", "f.field", F.posexplode("f.tokens").alias("pos", "token")).select("token", "url", "field", "pos", "length")


def postings(documents: DataFrame) -> DataFrame:
    """(token, url, field, positions, length): the occurrences of each token in each field together."""
    grouped = occurrences(documents).groupBy("token", "url", "field").agg(F.sort_array(F.collect_list("pos")).alias("positions"), F.max("length").alias("length"))
    return grouped.select("token", "url", "field", "positions", "length")


def term_statistics(documents: DataFrame) -> DataFrame:
    """(token, df, cf): documents and occurrences of every token, summed before they are shuffled."""
    held = documents.select(reduce(F.concat, [tx.tokens(F.col(c)) for c in COLUMNS]).alias("tokens"))
    once = F.transform(F.array_distinct("tokens"), lambda t: F.struct(t.alias("token"), F.lit(1).alias("df"), F.lit(0).alias("cf")))
    each = F.transform("tokens", lambda t: F.struct(t.alias("token"), F.lit(0).alias("df"), F.lit(1).alias("cf")))
    rows = held.select(F.explode(F.concat(once, each)).alias("x")).select("x.*")
    return rows.groupBy("token").agg(F.sum("df").alias("df"), F.sum("cf").alias("cf"))


def document_lengths(documents: DataFrame) -> DataFrame:
    """(url, length): tokens of title and text."""
    return documents.select("url", reduce(Column.__add__, [tx.token_count(F.col(c)) for c in COLUMNS]).alias("length"))


def corpus_stats(lengths: DataFrame) -> DataFrame:
    """One row (n, avgdl)."""
    return lengths.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"))


def _slot(token: str, prefix: bool, field: str) -> str:
    return f"{field}:{token}{'*' if prefix else ''}"


def _positions(token: str, prefix: bool, field: str) -> Column:
    return F.coalesce(F.element_at(F.col("slots"), F.lit(_slot(token, prefix, field))), F.array().cast("array<int>"))


def _follows(other: Column, i: int):
    return lambda p: F.array_contains(other, p + F.lit(i))


def _within(p: Column, size: int, distance: int):
    return lambda q: (q >= p) & (q - (p + size) <= distance)


def _starts(phrase: ql.Phrase, field: str) -> Column:
    """Positions in a field at which a phrase starts."""
    if phrase.columns and field not in phrase.columns:
        return F.array().cast("array<int>")
    last = len(phrase.tokens) - 1
    arrays = [_positions(t, phrase.prefix and i == last, field) for i, t in enumerate(phrase.tokens)]
    starts = arrays[0]
    for i, other in enumerate(arrays[1:], 1):
        starts = F.filter(starts, _follows(other, i))
    return F.filter(starts, lambda p: p == 0) if phrase.initial else starts


def _matches(tree: object) -> Column:
    """Whether a document, given its slots, matches a tree."""
    if isinstance(tree, ql.Nothing):
        return F.lit(False)
    if isinstance(tree, ql.Phrase):
        return reduce(Column.__or__, [F.size(_starts(tree, f)) > 0 for f in COLUMNS])
    if isinstance(tree, ql.Near):
        return reduce(Column.__or__, [_near(tree, f) for f in COLUMNS])
    left, right = _matches(tree.left), _matches(tree.right)
    return left & right if isinstance(tree, ql.And) else left | right if isinstance(tree, ql.Or) else left & ~right


def _near(tree: ql.Near, field: str) -> Column:
    """Whether all phrases stand within the distance in a field: at most that many tokens between the end of the first and the start of the last.

    Windows are anchored at every start of every phrase, which covers the first of any matching set.
    """
    starts = [_starts(p, field) for p in tree.phrases]
    sizes = [len(p.tokens) for p in tree.phrases]

    def anchored(a: int) -> Column:
        def holds(p: Column) -> Column:
            rest = [F.exists(s, _within(p, sizes[a], tree.distance)) for b, s in enumerate(starts) if b != a]
            return reduce(Column.__and__, rest) if rest else F.lit(True)

        return F.exists(starts[a], holds)

    return reduce(Column.__or__, [anchored(a) for a in range(len(starts))])


#: Folders of a stored index, by the first character of the token.
LEADS = 64


def lead(token: Column) -> Column:
    """The folder of a token."""
    return F.pmod(F.ascii(token), F.lit(LEADS))


def _wanted_rows(posts: DataFrame, tree: object) -> tuple[DataFrame, list[tuple[str, bool]]]:
    """The postings of a query's tokens: comparisons that prune folders and row groups of a stored index."""
    wanted = sorted(ql.terms(tree))
    exact = [t for t, prefix in wanted if not prefix]
    conditions = ([F.col("token").isin(*exact)] if exact else []) + [F.col("token").startswith(t) for t, prefix in wanted if prefix]
    rows = posts.where(reduce(Column.__or__, conditions) if conditions else F.lit(False))
    if "lead" in posts.columns and wanted:
        rows = rows.where(F.col("lead").isin(*sorted({ord(t[0]) % LEADS for t, _ in wanted})))
    return rows, wanted


def _slots(posts: DataFrame, tree: object) -> DataFrame:
    """(url, length, slots): for each document with any token of the query, a map from field and token to positions."""
    rows, wanted = _wanted_rows(posts, tree)
    names = F.array_compact(
        F.array(*[F.when(F.col("token").startswith(t) if prefix else F.col("token") == t, F.concat("field", F.lit(f":{t}{'*' if prefix else ''}"))) for t, prefix in wanted])
    ) if wanted else F.array().cast("array<string>")
    slots = rows.select("url", "length", F.explode(names).alias("slot"), "positions").groupBy("url", "slot").agg(F.max("length").alias("length"), F.sort_array(F.flatten(F.collect_list("positions"))).alias("positions"))
    return slots.groupBy("url").agg(F.max("length").alias("length"), F.map_from_entries(F.collect_list(F.struct("slot", "positions"))).alias("slots"))


def _measures(tree: object, weights: Sequence[float]) -> list[Column]:
    """Whether a document given its slots matches, and per phrase its weighted frequency and whether it occurs at all."""
    counts = [[F.size(_starts(p, f)) for f in COLUMNS] for p in ql.phrases(tree)]
    return [
        _matches(tree).alias("is_match"),
        *[sum((w * c for w, c in zip(weights, cs)), F.lit(0.0)).alias(f"f{i}") for i, cs in enumerate(counts)],
        *[reduce(Column.__or__, [c > 0 for c in cs]).alias(f"h{i}") for i, cs in enumerate(counts)],
    ]


def _scored(matching: DataFrame, statistics: DataFrame, phrases: int) -> DataFrame:
    """(url, bm25) of ``matching`` (url, length, f0, ...) by one row of statistics (n, avgdl, n0, ...)."""
    rows = matching.crossJoin(F.broadcast(statistics))  # one row
    terms = []
    for i in range(phrases):
        idf = F.ln((F.col("n") - F.col(f"n{i}") + 0.5) / (F.col(f"n{i}") + 0.5))
        idf = F.when(idf <= 0, LEAST_IDF).otherwise(idf)
        f = F.col(f"f{i}")
        terms.append(idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("length") / F.col("avgdl"))))
    return rows.select("url", F.round(sum(terms, F.lit(0.0)), 9).alias("bm25"))


def hits(posts: DataFrame, statistics: DataFrame, query: str | object, weights: Sequence[float] = (8.0, 1.0)) -> DataFrame:
    """(url, bm25) of the documents that match a query, from postings and the one row of ``corpus_stats``; higher is better.

    The frequency of a phrase is the weighted sum of its occurrences in title and text; a repeated term counts as often
    as it is written.  Document frequencies, the number of documents and the mean length cover the whole corpus.
    """
    tree = ql.parse(query) if isinstance(query, str) else query
    phrases = len(ql.phrases(tree))
    measured = _slots(posts, tree).select("url", "length", *_measures(tree, weights))
    found = measured.agg(*[F.count(F.when(F.col(f"h{i}"), 1)).alias(f"n{i}") for i in range(phrases)], F.lit(1).alias("one"))
    return _scored(measured.where("is_match"), statistics.crossJoin(found), phrases)  # one row each


def hits_by_scan(documents: DataFrame, query: str | object, weights: Sequence[float] = (8.0, 1.0)) -> DataFrame:
    """As ``hits``, from (url, title, text) without an index: the texts are read and tokenized once.

    What is left of each document (a flag, a length, a few numbers) is staged; statistics and scores come from that.
    """
    tree = ql.parse(query) if isinstance(query, str) else query
    phrases = len(ql.phrases(tree))
    wanted = sorted(ql.terms(tree))

    def positions(column: str, token: str, prefix: bool) -> Column:
        here = F.transform(F.col(column), lambda x, i: F.when(x.startswith(token) if prefix else x == token, i))
        return F.filter(here, lambda p: p.isNotNull())

    arrays = documents.select("url", *[tx.tokens(F.col(c)).alias(f"{c}_tokens") for c in COLUMNS])
    pairs = [x for c in COLUMNS for t, prefix in wanted for x in (F.lit(_slot(t, prefix, c)), positions(f"{c}_tokens", t, prefix))]
    slots = F.create_map(*pairs) if pairs else F.create_map().cast("map<string, array<int>>")
    length = reduce(Column.__add__, [F.size(f"{c}_tokens") for c in COLUMNS]).cast("long")
    based = arrays.select("url", length.alias("length"), slots.alias("slots"))
    measured = stage(based.select("url", "length", *_measures(tree, weights)), "measured")
    found = [F.count(F.when(F.col(f"h{i}"), 1)).alias(f"n{i}") for i in range(phrases)]
    statistics = measured.agg(F.count("*").alias("n"), F.avg("length").alias("avgdl"), *found)
    return _scored(measured.where("is_match"), statistics, phrases)


def authority(links: DataFrame, documents: DataFrame) -> DataFrame:
    """(url, inbound): distinct links into each document from documents of quality at least 0 with at most MOST_OUTBOUND links out, self-links left out, MOST_INBOUND at most.

    Links are joined to their sources, none of which has many that count, and then summed per target with map-side
    combining; only those sums, one row per target, meet the documents, so a target that a tenth of all links point to
    is one row there.
    """
    edges = links.where(F.col("source_url").isNotNull() & F.col("target_url").isNotNull()).select("source_url", "target_url").distinct()
    out = edges.groupBy("source_url").agg(F.count("*").alias("outbound")).where(F.col("outbound") <= MOST_OUTBOUND)
    sources = documents.where("quality_score >= 0").select(F.col("url").alias("source_url")).join(out.select("source_url"), "source_url", "left_semi")
    kept = edges.where("source_url <> target_url").join(sources, "source_url", "left_semi")
    counted = kept.groupBy(F.col("target_url").alias("url")).agg(F.least(F.count("*"), F.lit(MOST_INBOUND)).alias("inbound"))
    return counted.join(documents.select("url"), "url", "left_semi")


@dataclass(frozen=True)
class Filters:
    """Options of a search; what is None doesn't restrict."""

    domain: str | None = None
    since: str | None = None
    until: str | None = None
    language: str | None = None
    document_type: str | None = None

    def apply(self, documents: DataFrame) -> DataFrame:
        """Documents that pass; plain comparisons that reach the Parquet scan.  ``until`` is inclusive; a domain means its https pages, without subdomains."""
        if self.domain is not None:
            root = f"https://{self.domain}"
            documents = documents.where((F.col("url") == root) | F.col("url").startswith(root + "/"))
        if self.since is not None:
            documents = documents.where(F.col("indexed_at") >= f"{self.since}T00:00:00.000Z")
        if self.until is not None:
            day = (pd.Timestamp(self.until) + pd.Timedelta(days=1)).strftime("%Y-%m-%d")
            documents = documents.where(F.col("indexed_at") < f"{day}T00:00:00.000Z")
        if self.language is not None:
            documents = documents.where(F.col("language") == self.language)
        if self.document_type is not None:
            documents = documents.where(F.col("document_type") == self.document_type)
        return documents


def ranked(found: DataFrame, documents: DataFrame, inbound: DataFrame, query: str, now: str, filters: Filters = Filters()) -> DataFrame:
    """(url, title, indexed_at, score) of hits: 0.5 + BM25 + URL match + freshness + authority + quality.

    ``now`` is a date; a document of the last 7 (30) days, whole days counted, gets 0.25 (0.1).
    """
    words = ql.tokenize(query)
    term = next((w for w in words), "")
    kept = filters.apply(documents).select("url", "title", "indexed_at", "quality_score")
    day = F.to_date(F.substring("indexed_at", 1, 10))
    fresh = F.when(day >= F.date_sub(F.lit(now).cast("date"), 7), 0.25).when(day >= F.date_sub(F.lit(now).cast("date"), 30), 0.1).otherwise(0.0)
    url_match = F.when(F.instr(F.lower("url"), term) > 0, 2.0).otherwise(0.0) if term else F.lit(2.0)
    score = 0.5 + F.col("bm25") + url_match + fresh + F.coalesce("inbound", F.lit(0)) * 0.08 + F.coalesce("quality_score", F.lit(0.0))
    return found.join(kept, "url").join(inbound, "url", "left").select("url", "title", "indexed_at", F.round(score, 6).alias("score"))


def page(rows: DataFrame, order: Sequence[Column], number: int = 1, size: int = 20) -> DataFrame:
    """One page of ordered rows; the number is kept within 1 to 100."""
    number = min(100, max(1, number))
    ordered = rows.orderBy(*order)
    return (ordered.offset((number - 1) * size) if number > 1 else ordered).limit(size)


def by_relevance() -> list[Column]:
    return [F.desc("score"), F.desc("indexed_at"), F.asc("url")]


def by_date() -> list[Column]:
    return [F.desc("indexed_at"), F.asc("url")]


def domain_facet(rows: DataFrame, most: int = 8) -> DataFrame:
    """(domain, hits): the most frequent hosts of matching pages."""
    return rows.groupBy(host(F.col("url")).alias("domain")).agg(F.count("*").alias("hits")).orderBy(F.desc("hits"), F.asc("domain")).limit(most)


def date_facet(rows: DataFrame, most: int = 8) -> DataFrame:
    """(day, hits): the newest days of matching pages."""
    return rows.groupBy(F.substring("indexed_at", 1, 10).alias("day")).agg(F.count("*").alias("hits")).orderBy(F.desc("day")).limit(most)


def token_table(documents: DataFrame) -> DataFrame:
    """(url, tokens): search tokens of title and text with n-grams of Hangul, kana and Han words, each once."""
    return documents.select("url", F.array_union(tx.search_tokens(F.col("title")), tx.search_tokens(F.col("text"))).alias("tokens"))


def ngram_postings(documents: DataFrame) -> DataFrame:
    """(token, url) of every search token: what the fallback reads."""
    return token_table(documents).select(F.explode("tokens").alias("token"), "url")


def with_fallback(primary: DataFrame, grams: DataFrame, query: str) -> DataFrame:
    """``primary`` (url, bm25); only if it is empty and the query has Hangul, kana or Han, the documents holding all its n-grams, with a score of 0.

    Only the rows (token, url) of the query's own n-grams are read.  Whether ``primary`` is empty is decided inside the
    plan, by a single flag.
    """
    wanted = ql.fallback_tokens(query, tx.KOREAN_SUFFIXES)
    if not wanted:
        return primary
    none = primary.limit(1).agg((F.count("*") == 0).alias("is_empty"))
    rows = grams.where(F.col("token").isin(*wanted))
    if "lead" in grams.columns:
        rows = rows.where(F.col("lead").isin(*sorted({ord(t[0]) % LEADS for t in wanted})))
    held = rows.groupBy("url").agg(F.count_distinct("token").alias("n")).where(F.col("n") == len(wanted))
    other = held.crossJoin(F.broadcast(none)).where("is_empty").select("url", F.lit(0.0).alias("bm25"))
    return primary.unionByName(other)


def hit_counts(primary: DataFrame, grams: DataFrame, query: str) -> DataFrame:
    """One row (hits, is_fallback): how many documents a search shows, by the fallback where nothing else is found."""
    rows = with_fallback(primary.select("url", "bm25"), grams, query)
    counts = rows.agg(F.count("*").alias("hits"))
    return counts.crossJoin(primary.limit(1).agg((F.count("*") == 0).alias("is_fallback")))  # one row each


def title_preview(rows: DataFrame, most: int = 180) -> DataFrame:
    """``rows`` with ``preview``: the title cut to ``most`` characters, for hits by n-grams, whose texts hold no term to mark."""
    return rows.withColumn("preview", F.substring(F.coalesce("title", F.lit("")), 1, most))


def suggestions(documents: DataFrame, prefix: str, most: int = 8) -> DataFrame:
    """(suggestion): titles that begin with a prefix, newest first, each followed by its host; titles once whatever their case."""
    clean = "".join(c for c in prefix if c not in '"*^():').strip()
    if len(clean) < 2:
        return documents.limit(0).select(F.col("title").alias("suggestion"))
    pattern = clean.replace("\\", "\\\\").replace("%", "\\%").replace("_", "\\_") + "%"
    top = documents.where(F.col("title").ilike(pattern)).select("title", "url", "indexed_at").orderBy(F.desc("indexed_at"), "title", "url").limit(most)
    numbered = top.agg(F.sort_array(F.collect_list(F.struct(F.col("indexed_at"), "title", "url")), False).alias("rows")).select(F.posexplode("rows").alias("i", "row"))
    both = numbered.select("i", F.posexplode(F.array("row.title", host(F.col("row.url")))).alias("j", "suggestion"))
    first = both.groupBy(F.lower("suggestion").alias("k")).agg(F.min(F.struct("i", "j", "suggestion")).alias("first"))
    return first.orderBy("first.i", "first.j").limit(most).select("first.suggestion")


@F.pandas_udf(T.StringType())
def _snippet(texts: pd.Series, terms: pd.Series, size: pd.Series, opening: pd.Series, closing: pd.Series) -> pd.Series:
    import re

    word = re.compile(r"[^\W_]+")

    def one(text: str | None, wanted: Sequence[str], most: int, before: str, behind: str) -> str | None:
        if text is None:
            return None
        spans = [(m.start(), m.end(), ql.fold(m.group())) for m in word.finditer(text)]
        marks = [s[2] in wanted for s in spans]
        best, best_score = 0, -1.0
        for start in range(0, max(1, len(spans) - most + 1)):
            window = spans[start : start + most]
            distinct = len({s[2] for s in window} & set(wanted))
            opens = start == 0 or re.search(r"[.!?]\s*$", text[spans[start - 1][1] : spans[start][0]]) is not None
            score = distinct * 10 + sum(marks[start : start + most]) + 0.5 * opens
            if score > best_score:
                best, best_score = start, score
        window = spans[best : best + most]
        if not window:
            return text
        out, at = [], window[0][0]
        for k, (a, b, _) in enumerate(window, best):
            out.append(text[at:a])
            out.append(f"{before}{text[a:b]}{behind}" if marks[k] else text[a:b])
            at = b
        return ("..." if best else "") + "".join(out) + ("..." if best + most < len(spans) else text[at:])

    return pd.Series([one(t, list(w), int(n), a, b) for t, w, n, a, b in zip(texts, terms, size, opening, closing)], dtype=object)


def snippets(top: DataFrame, documents: DataFrame, query: str, size: int = 22, marks: tuple[str, str] = ("<mark>", "</mark>")) -> DataFrame:
    """``top`` (a page of rows with a url) with ``snippet``: the window of the text that covers most distinct terms, marked.

    Texts are joined to the page only, never to all hits.
    """
    terms = F.array(*[F.lit(t) for t, _ in sorted(ql.terms(ql.parse(query)))])
    return top.join(documents.select("url", "text"), "url").withColumn("snippet", _snippet("text", terms, F.lit(size), F.lit(marks[0]), F.lit(marks[1]))).drop("text")


def narrowed(rows: DataFrame, domain: str = "", since: str = "", until: str = "") -> DataFrame:
    """Rows (url, indexed_at, ...) whose host holds ``domain`` anywhere and whose day lies between two days, both included.

    Empty strings don't restrict.  A row without a readable address passes only where no domain is asked for.
    """
    if domain.strip():
        rows = rows.where(F.contains(F.coalesce(host(F.col("url")), F.lit("")), F.lit(domain.strip().lower())))
    day = F.substring("indexed_at", 1, 10)
    if since:
        rows = rows.where(day >= since)
    return rows.where(day <= until) if until else rows


#: Hits of a kind that a local search shows at most, and words of its snippets.
MOST_LOCAL, LOCAL_SNIPPET = 50, 18


def local_hits(rows: DataFrame, query: str) -> DataFrame:
    """(key, score, at) of (url, title, text, at) rows that match a query, title and text weighing the same.

    Where none does and the query has Hangul, the rows that hold all its two-character n-grams, with a score of 0.
    """
    documents = rows.select("url", "title", "text")
    found = hits_by_scan(documents, query, (1.0, 1.0))
    if any("\uac00" <= c <= "\ud7a3" for c in query):
        wanted = sorted({word[i : i + 2] for word in ql.tokenize(query) for i in range(max(1, len(word) - 1))})
        none = found.limit(1).agg((F.count("*") == 0).alias("is_empty"))
        grams = F.array_union(tx.bigrams(F.col("title")), tx.bigrams(F.col("text")))
        held = documents.where(F.size(F.array_intersect(grams, F.array(*[F.lit(g) for g in wanted]))) == len(wanted)) if wanted else documents.limit(0)
        found = found.unionByName(held.crossJoin(F.broadcast(none)).where("is_empty").select("url", F.lit(0.0).alias("bm25")))  # one row
    return found.join(rows.select("url", "at"), "url").select(F.col("url").alias("key"), F.col("bm25").alias("score"), "at")


def page_of_kinds(unified: DataFrame, number: int = 1, size: int = 20) -> DataFrame:
    """A page of unified hits (kind, key, rank), documents before notes; at most ``MOST_LOCAL`` of a kind, so one task orders them."""
    number, size = max(1, number), min(MOST_LOCAL, max(1, size))
    ordered = unified.orderBy("kind", "rank")
    return (ordered.offset((number - 1) * size) if number > 1 else ordered).limit(size)

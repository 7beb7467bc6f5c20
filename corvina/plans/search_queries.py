"""Queries on the index and the full-text side, with the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions import text as tx
from corvina.functions import urls as ur
from corvina.operators import index, search, workspace
from corvina.operators.search import Filters, by_date, by_relevance, page
from corvina.session import drop_at_exit, sent_if_small, shared_folder, spread, table

#: The day all freshness is measured against.
NOW = "2031-03-20"


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """(url, title, text), a page that is stored twice once; only the rows of such pages are shuffled."""
    rows = spread(table(spark, d, "document_search").select("url", "title", "text"), "url")
    several = sent_if_small(rows.where("url IS NOT NULL").groupBy("url").agg(F.count("*").alias("n")).where("n > 1").select("url"), "urls")
    twice = rows.join(several, "url", "left_semi").groupBy("url").agg(F.max(F.struct("text", "title")).alias("r")).select("url", "r.title", "r.text")
    return rows.where("url IS NOT NULL").join(several, "url", "left_anti").unionByName(twice)


_BUILT: dict[tuple[str, str], index.Stored] = {}


def stored(spark: SparkSession, d: str) -> index.Stored:
    """The index of a directory's tables: built by the first search of an application, read by all others."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _BUILT:
        documents = table(spark, d, "documents").select("url", "quality_score")
        path = f"{shared_folder(spark)}/corvina-index-{uuid.uuid4().hex}"
        _BUILT[key] = index.build(corpus(spark, d), table(spark, d, "document_links"), documents, path)
        drop_at_exit(spark, path)
    return _BUILT[key]


def _hits(spark: SparkSession, d: str, query: str, weights: tuple[float, float] = (8.0, 1.0)) -> DataFrame:
    held = stored(spark, d)
    return search.hits(held.postings, held.statistics, query, weights)


def scanned_search(spark: SparkSession, d: str) -> DataFrame:
    """A query over the texts instead of the index: what the index is checked against."""
    return search.hits_by_scan(corpus(spark, d), '"side by side" OR orchard').select("url", F.round("bm25", 6).alias("bm25"))


def indexed_search(spark: SparkSession, d: str) -> DataFrame:
    """The same query over the stored postings."""
    return _hits(spark, d, '"side by side" OR orchard').select("url")


def _ranked(spark: SparkSession, d: str, query: str, filters: Filters = Filters()) -> DataFrame:
    documents = table(spark, d, "documents")
    return search.ranked(_hits(spark, d, query), documents, stored(spark, d).authority, query, NOW, filters)


def ranked_search(spark: SparkSession, d: str) -> DataFrame:
    """The flagship: the first page of a two-term query by the combined score."""
    return page(_ranked(spark, d, "orchard bridge"), by_relevance())


def bm25_and_search(spark: SparkSession, d: str) -> DataFrame:
    """All documents with both terms, title weighted 8, by BM25."""
    return _hits(spark, d, "orchard bridge").select("url", F.round("bm25", 6).alias("bm25"))


def bm25_unweighted(spark: SparkSession, d: str) -> DataFrame:
    """All documents with either term, fields weighted alike."""
    return _hits(spark, d, "furnace OR quarry", (1.0, 1.0)).select("url", F.round("bm25", 6).alias("bm25"))


def boolean_or_not(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a tree with OR and NOT."""
    return _hits(spark, d, "harbour OR furnace NOT bridge").select("url")


def phrase_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a phrase."""
    return _hits(spark, d, '"side by side"').select("url", F.round("bm25", 6).alias("bm25"))


def near_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents with two terms at most three tokens apart."""
    return _hits(spark, d, "NEAR(report carpenters, 3)").select("url")


def initial_token(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose title or text begins with a term."""
    return _hits(spark, d, "^nobody").select("url")


def prefix_and_column(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a prefix in the title."""
    return _hits(spark, d, "title:librar*").select("url")


def search_newest_page2(spark: SparkSession, d: str) -> DataFrame:
    """The second page of a query, newest first."""
    return page(_ranked(spark, d, "library"), by_date(), 2).select("url", "indexed_at")


def search_filtered(spark: SparkSession, d: str) -> DataFrame:
    """All hits within a range of days, of a language and a type."""
    return _ranked(spark, d, "library", Filters(since="2031-02-05", until="2031-02-20", language="en", document_type="html")).select("url", "score")


def search_domain(spark: SparkSession, d: str) -> DataFrame:
    """All hits on the https pages of a domain."""
    return _ranked(spark, d, "library", Filters(domain="wynfada-wiki.example")).select("url", "score")


def search_count(spark: SparkSession, d: str) -> DataFrame:
    """How many documents match."""
    return _hits(spark, d, "library").agg(F.count("*").alias("hits"))


def facet_domains(spark: SparkSession, d: str) -> DataFrame:
    """The most frequent hosts among the hits."""
    return search.domain_facet(_hits(spark, d, "library"))


def facet_dates(spark: SparkSession, d: str) -> DataFrame:
    """The newest days among the hits."""
    rows = _hits(spark, d, "library").join(table(spark, d, "documents").select("url", "indexed_at"), "url")
    return search.date_facet(rows)


#: A Korean word with an ending it has nowhere in the corpus.
_ENDING = "도서관처럼"


def fallback_search(spark: SparkSession, d: str) -> DataFrame:
    """A Korean term that only occurs with other endings: found by the n-grams of its stem."""
    return search.with_fallback(_hits(spark, d, _ENDING), stored(spark, d).grams, _ENDING).select("url")


def fallback_count(spark: SparkSession, d: str) -> DataFrame:
    """How many documents that search shows, and that they come from the fallback."""
    return search.hit_counts(_hits(spark, d, _ENDING), stored(spark, d).grams, _ENDING)


def fallback_preview(spark: SparkSession, d: str) -> DataFrame:
    """Titles in place of snippets for hits by n-grams."""
    found = search.with_fallback(_hits(spark, d, _ENDING), stored(spark, d).grams, _ENDING)
    return search.title_preview(found.join(table(spark, d, "documents").select("url", "title"), "url")).select("url", "preview")


def _local(spark: SparkSession, d: str, query: str) -> DataFrame:
    """Hits among pages and among notes, here the titles of all documents."""
    docs = corpus(spark, d).join(table(spark, d, "documents").select("url", F.col("indexed_at").alias("at")), "url")
    notes = table(spark, d, "documents").select(F.col("doc_id").cast("string").alias("url"), "title", F.lit(None).cast("string").alias("text"), F.col("indexed_at").alias("at"))
    return workspace.unified(search.local_hits(docs, query), search.local_hits(notes, query), search.MOST_LOCAL)


def local_search_page3(spark: SparkSession, d: str) -> DataFrame:
    """The third page of a search over pages and notes together."""
    return search.page_of_kinds(_local(spark, d, "library"), 3)


def local_search_korean(spark: SparkSession, d: str) -> DataFrame:
    """A Korean query without hits: what holds all its two-character n-grams."""
    return _local(spark, d, "서관").select("kind", "key")


def narrowed_results(spark: SparkSession, d: str) -> DataFrame:
    """Documents of some days on hosts whose name holds a word."""
    return search.narrowed(table(spark, d, "documents").select("url", "indexed_at"), "wiki", "2031-02-01", "2031-02-28")


def suggestions_prefix(spark: SparkSession, d: str) -> DataFrame:
    """Completions of what a reader typed."""
    return search.suggestions(table(spark, d, "documents"), "notes on a")


def snippet_top20(spark: SparkSession, d: str) -> DataFrame:
    """Snippets of the first page of hits."""
    return search.snippets(page(_ranked(spark, d, "orchard bridge"), by_relevance()), corpus(spark, d), "orchard bridge")


def term_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Documents and occurrences of every token of the index."""
    return search.term_statistics(corpus(spark, d))


def token_index(spark: SparkSession, d: str) -> DataFrame:
    """Number of search tokens, with n-grams, per page."""
    return search.token_table(corpus(spark, d)).select("url", F.size("tokens").alias("search_tokens"))


def content_hash_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """The first document of every text."""
    return index.first_of_copies(table(spark, d, "documents"))


def duplicate_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose text an earlier one has."""
    return index.duplicates(table(spark, d, "documents"))


def capped_authority(spark: SparkSession, d: str) -> DataFrame:
    """Counted links into every document."""
    return search.authority(table(spark, d, "document_links"), table(spark, d, "documents"))


def out_degree(spark: SparkSession, d: str) -> DataFrame:
    """Distinct links out of every page."""
    return index.out_degree(table(spark, d, "document_links"))


def quality_scores(spark: SparkSession, d: str) -> DataFrame:
    """Content quality of every document, computed afresh."""
    out = index.out_degree(table(spark, d, "document_links")).withColumnRenamed("source_url", "url")
    docs = table(spark, d, "documents").select("doc_id", "url", "title", "text").join(out, "url", "left")
    return docs.select("doc_id", tx.quality_score(F.col("title"), F.col("text"), F.col("outbound")).alias("quality"))


def detect_script(spark: SparkSession, d: str) -> DataFrame:
    """Language of every document by script."""
    return table(spark, d, "documents").select("doc_id", tx.script_language(F.col("text")).alias("script_language"))


def canonical_urls(spark: SparkSession, d: str) -> DataFrame:
    """Canonical form and host of every document's URL."""
    return table(spark, d, "documents").select("doc_id", ur.canonicalize(F.col("url")).alias("canonical"), ur.host(F.col("url")).alias("host"))


def public_targets(spark: SparkSession, d: str) -> DataFrame:
    """Link targets by host, with whether they are public."""
    rows = table(spark, d, "document_links").where("target_url IS NOT NULL").select(ur.host(F.col("target_url")).alias("host"), ur.is_public_url(F.col("target_url")).alias("is_public"))
    return rows.groupBy("host", "is_public").agg(F.count("*").alias("links"))


def page_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Metadata and text statistics of every document."""
    return table(spark, d, "documents").select("doc_id", tx.word_count(F.col("text")).cast("long").alias("words"), F.length("text").cast("long").alias("characters"), F.sha2("text", 256).alias("sha256"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        ranked_search, indexed_search, scanned_search, bm25_and_search, bm25_unweighted, boolean_or_not, phrase_search, near_search, initial_token, prefix_and_column, search_newest_page2, search_filtered, search_domain,
        search_count, facet_domains, facet_dates, fallback_search, fallback_count, fallback_preview, local_search_page3, local_search_korean, narrowed_results, suggestions_prefix, snippet_top20, term_statistics, token_index, content_hash_dedupe, duplicate_pages, capped_authority,
        out_degree, quality_scores, detect_script, canonical_urls, public_targets, page_statistics,
    )
}

_TOKENS = rf"regexp_extract_all(regexp_replace(translate(lower({{0}}), '{tx.MARKED}', '{tx.PLAIN}'), '[\x{{{{0300}}}}-\x{{{{036F}}}}]', '', 'g'), '[\p{{{{L}}}}\p{{{{N}}}}\p{{{{Co}}}}]+')"
_CORPUS = rf"""
    docs AS (SELECT url, max(struct_pack(text := text, title := title)) AS r FROM document_search GROUP BY url),
    toks AS (SELECT url, coalesce({_TOKENS.format("r.title")}, []) AS a, coalesce({_TOKENS.format("r.text")}, []) AS b FROM docs),
    st AS (SELECT count(*) AS n, avg(len(a) + len(b)) AS avgdl FROM toks)"""


def _tf(term: str, wa: int = 8, wb: int = 1) -> str:
    return f"({wa}.0 * len(list_filter(a, lambda x: x = '{term}')) + {wb}.0 * len(list_filter(b, lambda x: x = '{term}')))"


def _bm25(*terms: str, wa: int = 8, wb: int = 1) -> str:
    """CTEs ending in scored(url, matched, bm25) for single-token phrases."""
    tf = ", ".join(f"{_tf(t, wa, wb)} AS f{i}" for i, t in enumerate(terms))
    df = ", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(len(terms)))
    idf = lambda i: f"(CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - n{i} + 0.5) / (n{i} + 0.5)) END)"
    score = " + ".join(f"{idf(i)} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * dl / avgdl))" for i in range(len(terms)))
    matched = " + ".join(f"CAST(f{i} > 0 AS INTEGER)" for i in range(len(terms)))
    return f"WITH {_CORPUS}, tf AS (SELECT url, len(a) + len(b) AS dl, {tf} FROM toks), df AS (SELECT {df} FROM tf), scored AS (SELECT url, {matched} AS matched, round({score}, 9) AS bm25 FROM tf, df, st)"


_AUTHORITY = """
    edges AS (SELECT DISTINCT source_url, target_url FROM document_links WHERE source_url IS NOT NULL AND target_url IS NOT NULL),
    good AS (SELECT e.source_url FROM edges e JOIN documents s ON s.url = e.source_url WHERE s.quality_score >= 0 GROUP BY e.source_url HAVING count(*) <= 50),
    auth AS (SELECT e.target_url AS url, least(count(*), 8) AS inbound FROM edges e JOIN good g ON g.source_url = e.source_url
             JOIN documents t ON t.url = e.target_url WHERE e.source_url <> e.target_url GROUP BY e.target_url)"""


def _combined(terms: tuple[str, ...], first: str, where: str = "") -> str:
    return f"""{_bm25(*terms)}, {_AUTHORITY},
    ranked AS (SELECT d.url, d.title, d.indexed_at, round(0.5 + bm25 + CASE WHEN instr(lower(d.url), '{first}') > 0 THEN 2.0 ELSE 0.0 END
      + CASE WHEN CAST(substr(indexed_at, 1, 10) AS DATE) >= DATE '{NOW}' - 7 THEN 0.25 WHEN CAST(substr(indexed_at, 1, 10) AS DATE) >= DATE '{NOW}' - 30 THEN 0.1 ELSE 0.0 END
      + coalesce(inbound, 0) * 0.08 + coalesce(quality_score, 0.0), 6) AS score
      FROM scored s JOIN documents d ON d.url = s.url LEFT JOIN auth ON auth.url = d.url WHERE matched = {len(terms)} {where})"""


_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?(\[[^\]]*\]|[^/?#:@]*)', 1))"

_SEARCH_WORDS = rf"""WITH {_CORPUS},
    w AS (SELECT url, a, b, list_distinct(list_concat(a, b)) AS words FROM toks),
    s AS (SELECT url, list_transform(words, lambda x: struct_pack(x := x, s := CASE WHEN regexp_full_match(x, '[\x{{AC00}}-\x{{D7A3}}]+') THEN regexp_replace(x, '^(.{{2,}}?)(?:{"|".join(tx.KOREAN_SUFFIXES)})$', '\1') WHEN regexp_matches(x, '[\x{{3040}}-\x{{30FF}}\x{{3400}}-\x{{9FFF}}\x{{F900}}-\x{{FAFF}}]') THEN x END)) AS words FROM w)"""
_FALLBACK = _SEARCH_WORDS + ", hit AS (SELECT url FROM s WHERE NOT list_contains(list_transform(words, lambda w: w.x), '도서관처럼')" + "".join(f" AND len(list_filter(words, lambda w: w.x = '{g}' OR contains(w.s, '{g}'))) > 0" for g in ("도", "도서", "서", "서관", "관")) + ")"

_NOTES = _CORPUS.replace("SELECT url, max(struct_pack(text := text, title := title)) AS r FROM document_search GROUP BY url", "SELECT CAST(doc_id AS VARCHAR) AS url, struct_pack(text := CAST(NULL AS VARCHAR), title := title) AS r FROM documents")


def _top(kind: str, bm25: str, at: str) -> str:
    return f"SELECT '{kind}' AS kind, url AS key, CAST(row_number() OVER (ORDER BY bm25 DESC, moment DESC, url) AS INTEGER) AS rank FROM ({bm25} SELECT url, bm25, moment FROM scored JOIN ({at}) USING (url) WHERE matched = 1 ORDER BY bm25 DESC, moment DESC, url LIMIT 50)"


_GRAMS = " AND ".join(f"len(list_filter(w, lambda x: contains(x, '{g}'))) > 0" for g in ("서관",))

ORACLE: dict[str, str] = {
    "local_search_page3": "SELECT * FROM (" + _top("document", _bm25("library", wa=1), "SELECT url, indexed_at AS moment FROM documents") + " UNION ALL " + _top("note", _bm25("library", wa=1).replace(_CORPUS, _NOTES), "SELECT CAST(doc_id AS VARCHAR) AS url, indexed_at AS moment FROM documents") + ") ORDER BY kind, rank LIMIT 20 OFFSET 40",
    "local_search_korean": f"WITH {_CORPUS}, d AS (SELECT url, list_concat(a, b) AS w FROM toks), n AS (SELECT CAST(doc_id AS VARCHAR) AS key, {_TOKENS.format('title')} AS w FROM documents) SELECT 'document' AS kind, url AS key FROM d JOIN documents USING (url) WHERE {_GRAMS} UNION ALL SELECT 'note', key FROM n WHERE {_GRAMS}",
    "narrowed_results": f"SELECT url, indexed_at FROM documents WHERE contains({_HOST}, 'wiki') AND substr(indexed_at, 1, 10) BETWEEN '2031-02-01' AND '2031-02-28'",
    "fallback_search": _FALLBACK + " SELECT url FROM hit",
    "fallback_count": _FALLBACK + " SELECT count(*) AS hits, true AS is_fallback FROM hit",
    "fallback_preview": _FALLBACK + " SELECT url, substr(coalesce(title, ''), 1, 180) AS preview FROM hit JOIN documents USING (url)",
    "token_index": _SEARCH_WORDS + """, g AS (SELECT url, unnest(words) AS w FROM s), t AS (SELECT url, w.x AS token FROM g UNION SELECT url, w.s FROM g WHERE w.s IS NOT NULL
        UNION SELECT url, unnest(list_transform(range(1, length(w.s) + 1), lambda i: substr(w.s, i, 1))) FROM g WHERE w.s IS NOT NULL
        UNION SELECT url, unnest(list_transform(range(1, length(w.s)), lambda i: substr(w.s, i, 2))) FROM g WHERE length(w.s) > 1)
        SELECT d.url, CAST(count(t.token) AS INTEGER) AS search_tokens FROM docs d LEFT JOIN t ON t.url = d.url GROUP BY d.url""",
    "scanned_search": f"""WITH {_CORPUS}, tf AS (SELECT url, len(a) + len(b) AS dl, {_tf('orchard')} AS g,
          8.0 * len(list_filter(range(1, len(a) - 1), lambda i: a[i] = 'side' AND a[i + 1] = 'by' AND a[i + 2] = 'side'))
          + len(list_filter(range(1, len(b) - 1), lambda i: b[i] = 'side' AND b[i + 1] = 'by' AND b[i + 2] = 'side')) AS f FROM toks),
        df AS (SELECT count(*) FILTER (f > 0) AS m, count(*) FILTER (g > 0) AS k FROM tf),
        i AS (SELECT greatest(ln((n - m + 0.5) / (m + 0.5)), 0) AS fi, greatest(ln((n - k + 0.5) / (k + 0.5)), 0) AS gi, avgdl FROM df, st)
        SELECT url, round(round((CASE WHEN fi = 0 THEN 1e-6 ELSE fi END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)) + (CASE WHEN gi = 0 THEN 1e-6 ELSE gi END) * g * 2.2 / (g + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9), 6) AS bm25
        FROM tf, i WHERE f > 0 OR g > 0""",
    "ranked_search": _combined(("orchard", "bridge"), "orchard") + " SELECT url, title, indexed_at, score FROM ranked ORDER BY score DESC, indexed_at DESC, url LIMIT 20",
    "indexed_search": f"WITH {_CORPUS} SELECT url FROM toks WHERE list_contains(list_concat(a, b), 'orchard') OR len(list_filter(range(1, len(a) - 1), lambda i: a[i] = 'side' AND a[i + 1] = 'by' AND a[i + 2] = 'side')) > 0 OR len(list_filter(range(1, len(b) - 1), lambda i: b[i] = 'side' AND b[i + 1] = 'by' AND b[i + 2] = 'side')) > 0",
    "bm25_and_search": _bm25("orchard", "bridge") + " SELECT url, round(bm25, 6) AS bm25 FROM scored WHERE matched = 2",
    "bm25_unweighted": _bm25("furnace", "quarry", wa=1) + " SELECT url, round(bm25, 6) AS bm25 FROM scored WHERE matched >= 1",
    "boolean_or_not": f"WITH {_CORPUS} SELECT url FROM toks WHERE list_contains(list_concat(a, b), 'harbour') OR (list_contains(list_concat(a, b), 'furnace') AND NOT list_contains(list_concat(a, b), 'bridge'))",
    "phrase_search": f"""WITH {_CORPUS}, tf AS (SELECT url, len(a) + len(b) AS dl,
          8.0 * len(list_filter(range(1, len(a) - 1), lambda i: a[i] = 'side' AND a[i + 1] = 'by' AND a[i + 2] = 'side'))
          + len(list_filter(range(1, len(b) - 1), lambda i: b[i] = 'side' AND b[i + 1] = 'by' AND b[i + 2] = 'side')) AS f FROM toks),
        df AS (SELECT count(*) FILTER (f > 0) AS m FROM tf)
        SELECT url, round(round((CASE WHEN ln((n - m + 0.5) / (m + 0.5)) <= 0 THEN 1e-6 ELSE ln((n - m + 0.5) / (m + 0.5)) END) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * dl / avgdl)), 9), 6) AS bm25
        FROM tf, df, st WHERE f > 0""",
    "near_search": f"""WITH {_CORPUS}, p AS (SELECT url, list_filter(range(1, len(x) + 1), lambda i: x[i] = 'report') AS r, list_filter(range(1, len(x) + 1), lambda i: x[i] = 'carpenters') AS c
          FROM (SELECT url, a AS x FROM toks UNION ALL SELECT url, b FROM toks))
        SELECT DISTINCT url FROM (SELECT url, unnest(r) AS i, c FROM p) WHERE len(list_filter(c, lambda j: abs(j - i) <= 4)) > 0""",
    "initial_token": f"WITH {_CORPUS} SELECT url FROM toks WHERE a[1] = 'nobody' OR b[1] = 'nobody'",
    "prefix_and_column": f"WITH {_CORPUS} SELECT url FROM toks WHERE len(list_filter(a, lambda x: starts_with(x, 'librar'))) > 0",
    "search_newest_page2": _combined(("library",), "library") + " SELECT url, indexed_at FROM ranked ORDER BY indexed_at DESC, url LIMIT 20 OFFSET 20",
    "search_filtered": _combined(("library",), "library", "AND indexed_at >= '2031-02-05T00:00:00.000Z' AND indexed_at < '2031-02-21T00:00:00.000Z' AND language = 'en' AND document_type = 'html'") + " SELECT url, score FROM ranked",
    "search_domain": _combined(("library",), "library", "AND (d.url = 'https://wynfada-wiki.example' OR starts_with(d.url, 'https://wynfada-wiki.example/'))") + " SELECT url, score FROM ranked",
    "search_count": _bm25("library") + " SELECT count(*) AS hits FROM scored WHERE matched = 1",
    "facet_domains": _bm25("library") + f" SELECT {_HOST} AS domain, count(*) AS hits FROM scored WHERE matched = 1 GROUP BY 1 ORDER BY hits DESC, domain LIMIT 8",
    "facet_dates": _bm25("library") + " SELECT substr(indexed_at, 1, 10) AS day, count(*) AS hits FROM scored JOIN documents USING (url) WHERE matched = 1 GROUP BY 1 ORDER BY day DESC LIMIT 8",
    "term_statistics": f"WITH {_CORPUS}, t AS (SELECT url, unnest(list_concat(a, b)) AS token FROM toks) SELECT token, count(DISTINCT url) AS df, count(*) AS cf FROM t GROUP BY token",
    "content_hash_dedupe": "SELECT text_hash, (min(struct_pack(i := indexed_at, u := url))).u AS url, count(*) AS copies FROM documents WHERE text_hash IS NOT NULL GROUP BY text_hash",
    "duplicate_pages": "WITH f AS (SELECT text_hash, (min(struct_pack(i := indexed_at, u := url))).u AS duplicate_of FROM documents WHERE text_hash IS NOT NULL GROUP BY text_hash) SELECT d.url, duplicate_of FROM documents d JOIN f USING (text_hash) WHERE d.url <> duplicate_of",
    "capped_authority": f"WITH {_AUTHORITY} SELECT url, inbound FROM auth",
    "out_degree": "SELECT source_url, count(DISTINCT target_url) AS outbound FROM document_links WHERE source_url IS NOT NULL AND target_url IS NOT NULL GROUP BY source_url",
    "quality_scores": r"""
        WITH o AS (SELECT source_url AS url, count(DISTINCT target_url) AS n FROM document_links WHERE target_url IS NOT NULL GROUP BY 1),
        d AS (SELECT doc_id, length(trim(coalesce(text, ''), ' ')) AS size, length(trim(coalesce(title, ''), ' ')) AS t, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w, coalesce(n, 0) AS n FROM documents LEFT JOIN o USING (url))
        SELECT doc_id, round(CAST(greatest(-0.5, least(0.3, CASE WHEN size < 80 THEN -0.3 WHEN size >= 300 THEN 0.2 ELSE 0.05 END + CASE WHEN t * 4 > size THEN -0.15 ELSE 0.0 END
          + CASE WHEN len(w) >= 12 AND len(list_distinct(w)) < len(w) * 0.25 THEN -0.25 ELSE 0.0 END + CASE WHEN n > 50 THEN -0.25 ELSE 0.0 END)) AS DOUBLE), 6) AS quality FROM d""",
    "detect_script": r"""
        WITH c AS (SELECT doc_id, len(regexp_extract_all(substr(text, 1, 20000), '[가-힣]')) AS ko, len(regexp_extract_all(substr(text, 1, 20000), '[\x{3041}-\x{309F}\x{30A0}-\x{30FF}]')) AS ja,
          len(regexp_extract_all(substr(text, 1, 20000), '[\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{F900}-\x{FAFF}]')) AS zh, len(regexp_extract_all(substr(text, 1, 20000), '[A-Za-z]')) AS en FROM documents),
        m AS (SELECT *, greatest(ko, ja, zh, en) AS most FROM c)
        SELECT doc_id, CASE WHEN most IS NULL OR most < 3 THEN 'other' WHEN ko = most THEN 'ko' WHEN ja = most THEN 'ja' WHEN zh = most THEN 'zh' ELSE 'en' END AS script_language FROM m""",
    "canonical_urls": rf"""
        WITH p AS (SELECT doc_id, url, lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.\-]*):', 1)) AS s, {_HOST} AS host,
          regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?[^/?#:@]*:([0-9]+)', 1) AS port,
          regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1) AS path, regexp_extract(regexp_replace(url, '#.*$', ''), '\?(.*)$', 1) AS q FROM documents),
        k AS (SELECT *, array_to_string(list_filter(string_split(q, '&'), lambda x: x <> '' AND NOT regexp_matches(lower(split_part(x, '=', 1)), '^(utm_(source|medium|campaign|term|content|id)|fbclid|gclid|dclid|msclkid|mc_.*)$')), '&') AS kept FROM p)
        SELECT doc_id, s || '://' || host || CASE WHEN port = '' OR (s = 'https' AND port = '443') OR (s = 'http' AND port = '80') THEN '' ELSE ':' || port END
          || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN kept = '' THEN '' ELSE '?' || kept END AS canonical, host FROM k""",
    "public_targets": rf"""
        WITH h AS (SELECT target_url AS url FROM document_links WHERE target_url IS NOT NULL)
        SELECT {_HOST} AS host, regexp_matches(url, '^(?i)https?://[^/?#@]+(/|\?|#|$)') AND {_HOST} <> 'localhost' AND NOT regexp_matches({_HOST}, '\.(localhost|local|internal)$') AND NOT regexp_matches({_HOST}, '^[0-9]+(\.[0-9]+){{3}}$') AS is_public, count(*) AS links FROM h GROUP BY 1, 2""",
    "page_statistics": "SELECT doc_id, CAST(CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 0 ELSE length(trim(text, ' ')) - length(replace(trim(text, ' '), ' ', '')) + 1 END AS BIGINT) AS words, length(text) AS characters, sha256(text) AS sha256 FROM documents",
    "suggestions_prefix": rf"""
        WITH top AS (SELECT title, url, indexed_at FROM documents WHERE title ILIKE 'notes on a%' ORDER BY indexed_at DESC, title, url LIMIT 8),
        n AS (SELECT *, row_number() OVER (ORDER BY indexed_at DESC, title DESC, url DESC) AS i FROM top),
        b AS (SELECT i, 0 AS j, title AS s FROM n UNION ALL SELECT i, 1, {_HOST} FROM n),
        f AS (SELECT lower(s) AS k, min(struct_pack(i := i, j := j, s := s)) AS m FROM b GROUP BY 1)
        SELECT m.s AS suggestion FROM f ORDER BY m.i, m.j LIMIT 8""",
}

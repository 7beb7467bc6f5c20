"""The queries of the llm subpackage and the SQL that checks those which SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.llm import analysis, bpe, canonical, language, packing, prose, residue, site_lines, stuffing
from corvina.llm.pages import texts_by_url
from corvina.session import ship, stage, table


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of documents whose titles or texts look the same and are stored differently."""
    ship(spark)
    documents = table(spark, d, "documents")
    ids = documents.select("doc_id", "url")
    titles = canonical.look_alike_pairs(canonical.look_keys(documents, "doc_id", "title"), "doc_id")
    texts = canonical.look_keys(texts_by_url(table(spark, d, "document_search")), "url", "text")
    texts = canonical.look_alike_pairs(texts.join(ids, "url"), "doc_id")
    named = lambda df, field: df.select(F.lit(field).alias("field"), F.col("id_a").alias("doc_id_a"), F.col("id_b").alias("doc_id_b"))
    return named(titles, "title").unionByName(named(texts, "text"))


def p1_look_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every title with the class of those that look the same, by the least id that has it, and in how many ways that class is stored."""
    ship(spark)
    classes = canonical.look_classes(canonical.look_keys(table(spark, d, "documents"), "doc_id", "title"), "doc_id")
    first = classes.groupBy("look").agg(F.min("id").alias("class_id"))
    return classes.join(first, "look").select(F.col("id").alias("doc_id"), "class_id", "spellings", "members")


def p1_canonical_titles(spark: SparkSession, d: str) -> DataFrame:
    """Every title in the consistent form."""
    ship(spark)
    return table(spark, d, "documents").select("doc_id", canonical.canonical_column(F.col("title")).alias("title"))


def p1_canonical_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text in the consistent form."""
    ship(spark)
    return texts_by_url(table(spark, d, "document_search")).select("url", canonical.canonical_column(F.col("text")).alias("text"))


def _ids(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "url")


def _analysed(spark: SparkSession, d: str) -> DataFrame:
    """Every page analysed, with the posterior of prose; staged, as its counts and its rows are both read."""
    search = texts_by_url(table(spark, d, "document_search"))
    pages = stage(analysis.analyse(search, table(spark, d, "documents"), table(spark, d, "common_words")), "pages")
    return prose.posteriors(pages)


#: Bodies that are no natural prose by their posterior.
NO_PROSE = "coalesce(prose < 0.5, false)"


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Lines outside the main body, of pages that are neither residue nor without prose."""
    pages = _analysed(spark, d).where(f"NOT residue AND NOT {NO_PROSE}")
    lines = pages.select("url", F.explode(F.col("furniture").cast("array<bigint>")).alias("line_no"))
    return lines.join(_ids(spark, d), "url").select("doc_id", "line_no").distinct()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose main body is mostly stuffed keywords, lists of links or product and tag listings."""
    search = texts_by_url(table(spark, d, "document_search"))
    pages = stuffing.stuffed_pages(search, table(spark, d, "documents"), table(spark, d, "common_words"))
    return pages.join(_ids(spark, d), "url").select("doc_id").distinct()


def _languages(spark: SparkSession, d: str) -> DataFrame:
    search = texts_by_url(table(spark, d, "document_search"))
    pages = language.languages(search, table(spark, d, "documents"), table(spark, d, "common_words"))
    return prose.posteriors(stage(pages, "languages"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a missing or wrong language label, and lines in another language than the rest of their text."""
    labels = table(spark, d, "documents").select("doc_id", "url", "language")
    pages = _languages(spark, d).where(f"lang IS NOT NULL AND NOT residue AND NOT {NO_PROSE}").join(labels, "url")
    wrong = F.coalesce(F.lower(F.substring(F.trim("language"), 1, 2)) != F.col("lang"), F.lit(True))
    documents = pages.where(wrong).select("doc_id", F.lit(0).cast("long").alias("line_no"), "lang")
    lines = pages.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.line_no", "s.lang")
    return documents.unionByName(lines).distinct()


def p5_languages(spark: SparkSession, d: str) -> DataFrame:
    """Every document with its language and confidence (line_no 0), and every segment in another language."""
    pages = _languages(spark, d).join(_ids(spark, d), "url")
    whole = pages.select("doc_id", F.lit(0).cast("long").alias("line_no"), "lang", "confidence")
    return whole.unionByName(pages.select("doc_id", F.explode("segments").alias("s")).select("doc_id", "s.line_no", "s.lang", "s.confidence"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Texts and titles that hold what a site's machinery left or said in place of content."""
    ship(spark)
    search = texts_by_url(table(spark, d, "document_search"))
    pages = analysis.analyse(search, table(spark, d, "documents"), table(spark, d, "common_words"))
    texts = pages.where("residue").join(_ids(spark, d), "url").select("doc_id", F.lit("text").alias("field"))
    bad = F.pandas_udf(lambda titles: titles.map(residue.bad_title).astype(bool), "boolean")
    titles = table(spark, d, "documents").select("doc_id", "title").where(bad("title")).select("doc_id", F.lit("title").alias("field"))
    return texts.unionByName(titles).distinct()


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents whose main body is mostly not natural prose."""
    pages = _analysed(spark, d).where(f"NOT residue AND {NO_PROSE}")
    return pages.join(_ids(spark, d), "url").select("doc_id").distinct()


def p10_text_types(spark: SparkSession, d: str) -> DataFrame:
    """The text type of every document whose text isn't residue, with the posterior of each type; nulls for an empty body."""
    pages = _analysed(spark, d).where("NOT residue")
    return pages.join(_ids(spark, d), "url").select("doc_id", "text_type", *[F.round(c, 6).alias(c) for c in prose.TYPES.values()])


def p10_statistics(spark: SparkSession, d: str) -> DataFrame:
    """Word count, mean word length, symbol ratio, lines ending in punctuation and common words of every text."""
    return prose.text_statistics(table(spark, d, "documents"), table(spark, d, "common_words"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every occurrence of a line repeated within its site."""
    documents = table(spark, d, "documents")
    found = site_lines.repeated_lines(documents, table(spark, d, "document_search"))
    return found.join(documents.select("doc_id", "url"), "url").select("doc_id", "line_no").distinct()


def p3_clean_texts(spark: SparkSession, d: str) -> DataFrame:
    """Every text without the lines repeated within its site."""
    return site_lines.without_repeated(table(spark, d, "documents"), table(spark, d, "document_search"))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    """Token ids of every text by byte_bpe_50k, without special tokens."""
    return bpe.token_ids(table(spark, d, "documents"))


def p9_containers(spark: SparkSession, d: str) -> DataFrame:
    """Every document assigned to containers of each capacity."""
    return packing.containers(table(spark, d, "documents"), table(spark, d, "pack_capacities"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (p1_found, p1_look_classes, p1_canonical_titles, p1_canonical_texts, p2_found, p4_found, p5_found, p5_languages, p7_found, p10_found, p10_text_types, p10_statistics, p3_found, p3_clean_texts, p8_ids, p9_containers)
}

_SITE = r"regexp_extract(lower(url), '^[a-z][a-z0-9+.\-]*://(?:[^/?#@]*@)?(?:www\.)?([^/?#:@]+)', 1)"
_KEY = r"trim(regexp_replace(regexp_replace(lower(line), '[0-9]+', '', 'g'), '[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+', ' ', 'g'))"

ORACLE: dict[str, str] = {
    "p3_found": rf"""
        WITH texts AS (SELECT url, max(text) AS text FROM document_search WHERE url IS NOT NULL GROUP BY url),
        sizes AS (SELECT {_SITE} AS host, count(*) AS n FROM documents GROUP BY 1),
        lines AS (SELECT url, {_SITE} AS host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM texts),
        keyed AS (SELECT url, host, line_no, {_KEY} AS k FROM lines),
        counted AS (SELECT host, k, count(DISTINCT url) AS docs FROM keyed WHERE regexp_matches(k, '\p{{L}}') GROUP BY host, k),
        hit AS (SELECT c.host, k FROM counted c JOIN sizes s ON c.host = s.host WHERE c.host <> '' AND docs >= 3 AND docs >= 0.1 * n)
        SELECT DISTINCT d.doc_id AS doc_id, CAST(l.line_no AS BIGINT) AS line_no
        FROM keyed l JOIN hit h ON l.host = h.host AND l.k = h.k JOIN documents d ON d.url = l.url
    """,
}

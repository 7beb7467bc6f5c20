"""Queries of operators whose inputs (HTML, robots files, headers, notes) the tables don't hold: small constant inputs, expected values as SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions import crawl as cr
from corvina.functions import text as tx
from corvina.functions import urls as ur
from corvina.operators import admin, frontier, index, search, workspace
from corvina.session import shared_folder, table
from corvina.sources import events, snapshots
from corvina.sources.pages import extract, sitemap_entries, sitemap_levels, within_cap

_PAGE = (
    '<html><head><title>Tea &amp; Rain</title><link rel="canonical" href="/tea?utm_source=x"><meta name="robots" content="noindex"></head><body><style>b{}</style><h2>On <i>tea</i></h2>'
    '<p>Warm&nbsp;cups &lt;here&gt;</p><a href="/a">a</a><a href="https://b.test/c?gclid=1#top">b</a><a href="mailto:x@y.test">m</a><a href="/a">a</a></body></html>'
)
_ROBOTS = "User-agent: *\nDisallow: /private\nAllow: /private/open\n\nUser-agent: otherbot\nDisallow: /\nSitemap: https://h.test/map.xml\n"


def extract_pages(spark: SparkSession, d: str) -> DataFrame:
    """Title, text, links, headings and directives of pages."""
    pages = spark.createDataFrame([("https://h.test/x/", _PAGE, None), ("https://e.test/", None, "none")], "url string, html string, x_robots_tag string")
    return extract(pages).select("url", "title", "text", F.concat_ws(" ", "links").alias("links"), F.concat_ws("|", "headings").alias("headings"), "canonical_url", "noindex", "nofollow")


def body_caps(spark: SparkSession, d: str) -> DataFrame:
    """Bodies within and beyond a cap of bytes."""
    kept, rejected = within_cap(spark.createDataFrame([("é" * 3,), ("abcde",), (None,)], "body string"), "body", 5)
    return kept.select("body", F.lit(True).alias("kept")).unionByName(rejected.select("body", F.lit(False).alias("kept")))


def robots_longest_match(spark: SparkSession, d: str) -> DataFrame:
    """Which paths a robots file allows."""
    rules = frontier.robots_rules(spark.createDataFrame([("o", _ROBOTS)], "origin string, text string"), "corvina/1.0")
    paths = spark.createDataFrame([("o", p, p) for p in ("/", "/private/x", "/private/open/y")], "origin string, url string, path string")
    return frontier.robots_allowed(paths, rules)


def robots_crawl_delay(spark: SparkSession, d: str) -> DataFrame:
    """How long robots files ask us to wait."""
    files = [("a", "User-agent: *\nCrawl-delay: 2\n"), ("b", "User-agent: *\nCrawl-delay: 9\n\nUser-agent: corvina\nCrawl-delay: 0.5\nDisallow: /x\n"), ("c", "User-agent: *\nCrawl-delay: 900\n"), ("d", "User-agent: *\nCrawl-delay: soon\n"), ("e", None)]
    return frontier.robots_delays(spark.createDataFrame(files, "origin string, text string"), "corvina/1.0")


def sitemaps(spark: SparkSession, d: str) -> DataFrame:
    """Pages named by sitemaps reached through an index, and the sitemaps a robots file names."""
    maps = spark.createDataFrame(
        [("https://h.test/map.xml", "<sitemapindex><loc>https://h.test/1.xml</loc></sitemapindex>"), ("https://h.test/1.xml", "<urlset><loc>https://h.test/p?utm_id=1</loc><loc>https://h.test/p</loc><loc>http://10.0.0.1/</loc></urlset>")],
        "url string, xml string",
    )
    roots = spark.createDataFrame([(_ROBOTS,)], "text string").select(F.explode(cr.robots_sitemaps(F.col("text"))).alias("url"))
    return sitemap_levels(maps, roots).select("url").unionByName(sitemap_entries(maps).where("is_index").select("url"))


def public_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Which addresses are on the public Internet."""
    rows = spark.createDataFrame([(a,) for a in ("8.8.8.8", "172.20.0.4", "100.64.0.1", "198.18.0.1", "203.0.113.1", "::ffff:127.0.0.1", "2606:4700:4700::1111")], "address string")
    return rows.select("address", ur.is_public_address(F.col("address")).alias("is_public"))


def retry_headers(spark: SparkSession, d: str) -> DataFrame:
    """Retry-After values as waiting times."""
    rows = spark.createDataFrame([("2",), ("999999",), ("invalid",), ("Thu, 01 Jan 1970 00:00:09 GMT",)], "value string")
    return rows.select("value", cr.retry_after_ms(F.col("value"), F.lit(4000)).alias("wait_ms"))


def content_types(spark: SparkSession, d: str) -> DataFrame:
    """Content types let in by a policy."""
    rows = spark.createDataFrame([("text/html; charset=utf-8",), ("TEXT/HTML",), ("application/pdf",)], "content_type string")
    return rows.select("content_type", cr.content_type_allowed(F.col("content_type"), F.array(F.lit("text/html"))).alias("is_allowed"))


def token_ngrams(spark: SparkSession, d: str) -> DataFrame:
    """Search tokens and two-character n-grams of words."""
    rows = spark.createDataFrame([("검색을",), ("Café a",), ("図書館",)], "word string")
    return rows.select("word", F.concat_ws(" ", F.sort_array(tx.search_tokens(F.col("word")))).alias("search_tokens"), F.concat_ws(" ", tx.bigrams(F.col("word"))).alias("bigrams"))


def nfkc_fold_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Compatibility folding of tokens."""
    rows = spark.createDataFrame([("ＡＢ１",), ("ﬁle",), ("École",), ("검색",), ("abc",)], "token string")
    return rows.select("token", tx.search_token(F.col("token")).alias("folded"))


def web_addresses(spark: SparkSession, d: str) -> DataFrame:
    """What a reader typed: an address or a search."""
    rows = spark.createDataFrame([("example.org/x",), ("two words",), ("https://a.test",), ("localhost:8080",)], "entry string")
    return rows.select("entry", ur.is_web_address(F.col("entry")).alias("is_address"))


def resolve_links(spark: SparkSession, d: str) -> DataFrame:
    """Relative references made absolute."""
    rows = spark.createDataFrame([("https://h.test/a/b", "../c"), ("https://h.test/a/b", "?q=1"), ("https://h.test/a/b", "//o.test/x")], "base string, reference string")
    return rows.select("reference", ur.resolve(F.col("base"), F.col("reference")).alias("url"))


def note_tags_attach(spark: SparkSession, d: str) -> DataFrame:
    """Notes taken from the readers' labels, with their labels as tags."""
    labels = table(spark, d, "doc_labels")
    notes = labels.select(F.col("doc_id").alias("id")).distinct()
    return workspace.with_tags(notes, labels.select(F.col("doc_id").alias("note_id"), F.col("lang_label").alias("tag")).where("tag IS NOT NULL")).select("id", F.concat_ws(" ", "tags").alias("tags"))


def import_antijoin(spark: SparkSession, d: str) -> DataFrame:
    """Notes of an import that aren't there yet."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("title").alias("quote"), F.col("language").alias("body"), F.col("source").alias("source_url"))
    return workspace.import_notes(docs.where("id % 2 = 0"), docs).select("quote", "body", "source_url")


def unified_search(spark: SparkSession, d: str) -> DataFrame:
    """Documents, then blocked domains taken as notes, best first."""
    docs = table(spark, d, "documents").select(F.col("url").alias("key"), F.col("quality_score").alias("score"), F.col("indexed_at").alias("at")).where("score IS NOT NULL")
    notes = table(spark, d, "domain_blocks").select(F.col("domain").alias("key"), F.length("reason").cast("double").alias("score"), F.col("updated_at").alias("at"))
    return workspace.unified(docs, notes, 20)


def visible_subgraph(spark: SparkSession, d: str) -> DataFrame:
    """Edges between the newest documents."""
    return workspace.visible_edges(workspace.graph(table(spark, d, "documents"), table(spark, d, "document_links"), 1000, 12), most=45)


def snapshot_verify(spark: SparkSession, d: str) -> DataFrame:
    """A snapshot of two tables held against its manifest after rows were added to one of them."""
    tables = {n: table(spark, d, n) for n in ("documents", "domain_blocks")}
    folder = shared_folder(spark) + "/corvina-snapshots"
    snapshots.write(tables, folder, "verify")
    tables["domain_blocks"].write.mode("append").parquet(f"{folder}/verify/domain_blocks")
    return snapshots.verify(spark, folder, "verify")


_SECRET = "a secret of the operator"


def signed_events(spark: SparkSession, d: str) -> DataFrame:
    """Signed lifecycle events of all failed jobs."""
    jobs = table(spark, d, "crawl_jobs").where("status = 'failed'")
    return events.signed(events.payloads(jobs, "job.failed", "2031-03-20T00:00:00.000Z"), _SECRET).select("id", "payload", "signature")


def index_batch_upsert(spark: SparkSession, d: str) -> DataFrame:
    """Documents after the later half of the corpus was indexed on top of the earlier half."""
    docs = table(spark, d, "documents").select("url", "canonical_url", "title", "text_hash", "indexed_at").where("text_hash IS NOT NULL")
    edges = table(spark, d, "document_links").where("target_url IS NOT NULL").groupBy(F.col("source_url").alias("url")).agg(F.sort_array(F.collect_set("target_url")).alias("outbound_links"))
    middle = "2031-02-15T00:00:00.000Z"
    old = index.first_of_copies(docs.where(F.col("indexed_at") < middle)).select("url").join(docs, "url").drop("canonical_url")
    batch = docs.where(F.col("indexed_at") >= middle).withColumn("canonical_url", F.lit(None).cast("string")).join(edges, "url", "left")
    documents, _ = index.index_batch(old, table(spark, d, "document_links"), batch)
    return documents.select("url", "text_hash")


def capped_links(spark: SparkSession, d: str) -> DataFrame:
    """At most three links of every page."""
    return index.first_links(table(spark, d, "document_links"), 3)


def delete_domain(spark: SparkSession, d: str) -> DataFrame:
    """Rows left after the https pages of a domain were deleted."""
    documents, links = admin.delete_domain(table(spark, d, "documents"), table(spark, d, "document_links"), "wynfada-wiki.example")
    return documents.agg(F.count("*").alias("documents")).crossJoin(links.agg(F.count("*").alias("links")))


def query_terms(spark: SparkSession, d: str) -> DataFrame:
    """Documents by a tree of columns, phrases and exclusions over the index."""
    docs = table(spark, d, "document_search").groupBy("url").agg(F.max(F.struct("text", "title")).alias("r")).select("url", "r.title", "r.text")
    return search.hits(search.postings(docs), search.corpus_stats(search.document_lengths(docs)), '(title:orchard OR "reliable bridge") NOT kiln').select("url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        extract_pages, body_caps, robots_crawl_delay, robots_longest_match, sitemaps, public_addresses, retry_headers, content_types, token_ngrams, nfkc_fold_tokens, web_addresses, resolve_links, note_tags_attach, import_antijoin,
        unified_search, visible_subgraph, snapshot_verify, signed_events, index_batch_upsert, capped_links, delete_domain, query_terms,
    )
}


def _pad(secret: str, byte: int) -> str:
    """The key block of an HMAC, in hex: the secret filled to 64 bytes, each combined with ``byte``."""
    return bytes(b ^ byte for b in secret.encode().ljust(64, bytes(1))).hex()


ORACLE: dict[str, str] = {
    "robots_crawl_delay": "SELECT * FROM (VALUES ('a', CAST(2000 AS BIGINT)), ('b', 500), ('c', 30000)) v(origin, delay_ms)",
    "extract_pages": "SELECT * FROM (VALUES ('https://h.test/x/', 'Tea & Rain', 'Tea & Rain On tea Warm cups <here> a b m a', 'https://h.test/a https://b.test/c', 'On tea', 'https://h.test/tea', true, false), ('https://e.test/', 'e.test', '', '', '', NULL, true, true)) t(url, title, text, links, headings, canonical_url, noindex, nofollow)",
    "body_caps": "SELECT body, coalesce(octet_length(encode(body)), 0) <= 5 AS kept FROM (VALUES ('ééé'), ('abcde'), (NULL)) t(body)",
    "robots_longest_match": "SELECT * FROM (VALUES ('/', true), ('/private/x', false), ('/private/open/y', true)) t(url, allowed)",
    "sitemaps": "SELECT * FROM (VALUES ('https://h.test/p'), ('https://h.test/1.xml')) t(url)",
    "public_addresses": "SELECT * FROM (VALUES ('8.8.8.8', true), ('172.20.0.4', false), ('100.64.0.1', false), ('198.18.0.1', false), ('203.0.113.1', false), ('::ffff:127.0.0.1', false), ('2606:4700:4700::1111', true)) t(address, is_public)",
    "retry_headers": "SELECT value, CAST(wait_ms AS BIGINT) AS wait_ms FROM (VALUES ('2', 2000), ('999999', 120000), ('invalid', NULL), ('Thu, 01 Jan 1970 00:00:09 GMT', 5000)) t(value, wait_ms)",
    "content_types": "SELECT content_type, lower(trim(split_part(content_type, ';', 1))) = 'text/html' AS is_allowed FROM (VALUES ('text/html; charset=utf-8'), ('TEXT/HTML'), ('application/pdf')) t(content_type)",
    "token_ngrams": "SELECT * FROM (VALUES ('검색을', '검 검색 검색을 색', '검색 색을'), ('Café a', 'a cafe', 'ca af fe a'), ('図書館', '図 図書 図書館 書 書館 館', '図書 書館')) t(word, search_tokens, bigrams)",
    "nfkc_fold_tokens": "SELECT * FROM (VALUES ('ＡＢ１', 'ab1'), ('ﬁle', 'file'), ('École', 'ecole'), ('검색', '검색'), ('abc', 'abc')) t(token, folded)",
    "web_addresses": "SELECT * FROM (VALUES ('example.org/x', true), ('two words', false), ('https://a.test', true), ('localhost:8080', true)) t(entry, is_address)",
    "resolve_links": "SELECT * FROM (VALUES ('../c', 'https://h.test/c'), ('?q=1', 'https://h.test/a/b?q=1'), ('//o.test/x', 'https://o.test/x')) t(reference, url)",
    "note_tags_attach": "SELECT doc_id AS id, coalesce(string_agg(DISTINCT lower(trim(lang_label)), ' ' ORDER BY lower(trim(lang_label))), '') AS tags FROM doc_labels GROUP BY doc_id",
    "import_antijoin": """SELECT DISTINCT title AS quote, language AS body, source AS source_url FROM documents n
        WHERE NOT EXISTS (SELECT 1 FROM documents o WHERE o.doc_id % 2 = 0 AND coalesce(o.title, '') = coalesce(n.title, '') AND coalesce(o.language, '') = coalesce(n.language, '') AND coalesce(o.source, '') = coalesce(n.source, ''))""",
    "unified_search": """WITH a AS (SELECT 'document' AS kind, url AS key, row_number() OVER (ORDER BY quality_score DESC, indexed_at DESC, url) AS rank FROM documents WHERE quality_score IS NOT NULL),
        b AS (SELECT 'note' AS kind, domain AS key, row_number() OVER (ORDER BY length(reason) DESC, updated_at DESC, domain) AS rank FROM domain_blocks)
        SELECT kind, key, CAST(rank AS INTEGER) AS rank FROM (SELECT * FROM a UNION ALL SELECT * FROM b) WHERE rank <= 20""",
    "visible_subgraph": """WITH n AS (SELECT url FROM documents ORDER BY indexed_at DESC, url LIMIT 1000), e AS (SELECT DISTINCT source_url, target_url FROM document_links JOIN n ON url = source_url WHERE target_url <> source_url),
        k AS (SELECT * FROM e QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY target_url) <= 12) SELECT source_url, target_url FROM k WHERE target_url IN (SELECT url FROM n) ORDER BY 1, 2 LIMIT 45""",
    "snapshot_verify": "SELECT 'documents' AS table_name, count(*) AS row_count, count(*) AS found, true AS is_valid FROM documents UNION ALL SELECT 'domain_blocks', count(*), 2 * count(*), count(*) = 0 FROM domain_blocks",
    "signed_events": f"""WITH p AS (SELECT id, '{{"event":"job.failed","occurredAt":"2031-03-20T00:00:00.000Z","jobId":' || to_json(id) || ',"status":"failed"' || coalesce(',"indexed":' || indexed, '') || coalesce(',"skipped":' || skipped, '') || coalesce(',"failed":' || failed, '')
          || CASE WHEN error <> '' THEN ',"error":' || to_json(substr(trim(regexp_replace(error, '\\s+', ' ', 'g')), 1, 500)) ELSE '' END || '}}' AS payload FROM crawl_jobs WHERE status = 'failed')
        SELECT id, payload, sha256(unhex('{_pad(_SECRET, 0x5C)}') || unhex(sha256(unhex('{_pad(_SECRET, 0x36)}') || encode(payload)))) AS signature FROM p""",
    "index_batch_upsert": """SELECT url, text_hash FROM documents WHERE text_hash IS NOT NULL QUALIFY row_number() OVER (PARTITION BY text_hash ORDER BY indexed_at, url) = 1""",
    "capped_links": "SELECT source_url, target_url FROM (SELECT DISTINCT * FROM document_links WHERE target_url IS NOT NULL AND source_url <> target_url) QUALIFY row_number() OVER (PARTITION BY source_url ORDER BY target_url) <= 3",
    "delete_domain": """WITH g AS (SELECT url FROM documents WHERE url = 'https://wynfada-wiki.example' OR starts_with(url, 'https://wynfada-wiki.example/'))
        SELECT (SELECT count(*) FROM documents) - (SELECT count(*) FROM g) AS documents, (SELECT count(*) FROM document_links l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.url = source_url) AND NOT EXISTS (SELECT 1 FROM g WHERE g.url = target_url)) AS links""",
    "query_terms": r"""WITH docs AS (SELECT url, max(struct_pack(text := text, title := title)) AS r FROM document_search GROUP BY url),
        t AS (SELECT url, coalesce(regexp_extract_all(lower(r.title), '[\p{L}\p{N}]+'), []) AS a, coalesce(regexp_extract_all(lower(r.text), '[\p{L}\p{N}]+'), []) AS b FROM docs)
        SELECT url FROM t WHERE (list_contains(a, 'orchard') OR len(list_filter(range(1, len(a)), lambda i: a[i] = 'reliable' AND a[i + 1] = 'bridge')) > 0 OR len(list_filter(range(1, len(b)), lambda i: b[i] = 'reliable' AND b[i + 1] = 'bridge')) > 0)
          AND NOT list_contains(list_concat(a, b), 'kiln')""",
}

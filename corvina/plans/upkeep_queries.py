"""Queries that keep documents, jobs and frontier over time, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.operators import frontier, upkeep
from corvina.plans.crawl_queries import NOW_MS, RECRAWL_MS
from corvina.session import table

#: The moment results are dated with.
AT = "2031-03-20T00:00:00.000Z"


def _frontier(spark: SparkSession, d: str) -> DataFrame:
    return frontier.current(table(spark, d, "frontier"))


def documents_page3(spark: SparkSession, d: str) -> DataFrame:
    """The third page of all documents, newest first, with its envelope."""
    return upkeep.paged(table(spark, d, "documents").select("url", "title", "indexed_at"), [F.desc("indexed_at"), F.asc("url")], 3)


def documents_of_domain(spark: SparkSession, d: str) -> DataFrame:
    """The first page of a domain's documents."""
    rows = upkeep.of_domain(table(spark, d, "documents").select("url", "indexed_at"), "wynfada-wiki.example")
    return upkeep.paged(rows, [F.desc("indexed_at"), F.asc("url")])


def jobs_page(spark: SparkSession, d: str) -> DataFrame:
    """The first page of complete jobs, newest first."""
    rows = table(spark, d, "crawl_jobs").where("status = 'complete'").select("id", "seed_url", "created_at")
    return upkeep.paged(rows, [F.desc("created_at"), F.desc("id")], size=10)


def blocks_list(spark: SparkSession, d: str) -> DataFrame:
    """Blocked domains, newest first."""
    return upkeep.paged(table(spark, d, "domain_blocks").select("domain", "reason", "created_at"), [F.desc("created_at"), F.asc("domain")], 2)


def document_inspection(spark: SparkSession, d: str) -> DataFrame:
    """Statistics of every document with the number of jobs that found it and the first of them."""
    rows = upkeep.inspected(table(spark, d, "documents"), _frontier(spark, d), table(spark, d, "crawl_jobs"))
    return rows.select("url", "title_length", "text_length", "words", F.size("jobs").alias("jobs"), F.try_element_at("jobs", F.lit(1))["id"].alias("first_job"))


def enqueue_links(spark: SparkSession, d: str) -> DataFrame:
    """Links of fetched pages that enter the frontiers of their jobs."""
    held = _frontier(spark, d)
    found = held.where("state = 'fetched'").select("job_id", F.col("url").alias("source_url"), "depth").join(table(spark, d, "document_links"), "source_url")
    candidates = found.select("job_id", F.col("target_url").alias("url"), (F.col("depth") + 1).alias("depth"))
    return upkeep.enqueued(held, candidates, table(spark, d, "crawl_jobs"), table(spark, d, "domain_blocks"))


def polite_schedule(spark: SparkSession, d: str) -> DataFrame:
    """When every queued entry may be asked for; hosts that answered 429 get five seconds between requests."""
    held = _frontier(spark, d)
    slow = held.where("failure_type = 'http_429'").select("host").where("host IS NOT NULL").distinct().withColumn("delay_ms", F.lit(5_000))
    return upkeep.polite_times(held, slow, NOW_MS)


def deferred_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries by host and state after those in work on hosts that answered 429 were put back for a minute."""
    held = _frontier(spark, d)
    slow = held.where("failure_type = 'http_429'").select("host").where("host IS NOT NULL").distinct().withColumn("until_ms", F.lit(NOW_MS + 60_000))
    return upkeep.deferred(held, slow).groupBy("host", "state").agg(F.count("*").alias("entries"), F.count("lease_owner").alias("leases"), F.max("available_at").alias("latest"))


def marked_entries(spark: SparkSession, d: str) -> DataFrame:
    """Entries by state and failure after every one in work was fetched, or failed where its job has failures."""
    held, jobs = _frontier(spark, d), table(spark, d, "crawl_jobs")
    work = held.where("state = 'processing'").join(jobs.select(F.col("id").alias("job_id"), "failed"), "job_id")
    results = work.select("job_id", "url", F.col("lease_owner").alias("worker"), F.when(F.col("failed") > 0, "HTTP 503").alias("error"))
    return upkeep.marked(held, results, AT).groupBy("state", "failure_type").agg(F.count("*").alias("entries"), F.count("lease_owner").alias("leases"))


def restarted_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs and their entries after every finished job was started over."""
    jobs = table(spark, d, "crawl_jobs")
    entries, after = upkeep.again(_frontier(spark, d), jobs, jobs.select("id"))
    counts = entries.groupBy(F.col("job_id").alias("id")).agg(F.count(F.when(F.col("state") == "queued", 1)).alias("queued"), F.sum("attempts").alias("attempts"))
    return after.select("id", "status", "indexed", "skipped", "failed", "error").join(counts, "id", "left")


def retried_jobs(spark: SparkSession, d: str) -> DataFrame:
    """Jobs and their entries after the failed entries of every finished job were queued again."""
    jobs = table(spark, d, "crawl_jobs")
    entries, after = upkeep.again(_frontier(spark, d), jobs, jobs.select("id"), failed_only=True)
    counts = entries.groupBy(F.col("job_id").alias("id")).agg(F.count(F.when(F.col("state") == "queued", 1)).alias("queued"), F.count(F.when(F.col("state") == "failed", 1)).alias("failed_entries"))
    return after.select("id", "status", "failed").join(counts, "id", "left")


def recrawl_schedule(spark: SparkSession, d: str) -> DataFrame:
    """When the jobs whose recrawl is due are due again."""
    return upkeep.rescheduled(table(spark, d, "crawl_jobs"), RECRAWL_MS)


def touched_documents(spark: SparkSession, d: str) -> DataFrame:
    """Documents by the time of indexing after those with an etag answered that they are unchanged."""
    documents = table(spark, d, "documents").select("url", "etag", "indexed_at")
    after = upkeep.touched(documents, documents.where("etag IS NOT NULL"), AT)
    return after.groupBy("indexed_at").agg(F.count("*").alias("documents"))


def restore_drill(spark: SparkSession, d: str) -> DataFrame:
    """What a restored copy of the tables is compared by."""
    return upkeep.drill({n: table(spark, d, n) for n in ("documents", "document_links", "frontier", "crawl_jobs", "domain_blocks")})


def job_progress(spark: SparkSession, d: str) -> DataFrame:
    """How far every job is."""
    return upkeep.job_progress(table(spark, d, "crawl_jobs"))


def tags_first_seen(spark: SparkSession, d: str) -> DataFrame:
    """Event types of every user as tags, in the order first seen."""
    tags = table(spark, d, "events").select(F.col("user_id").alias("note_id"), F.col("event_id").alias("pos"), F.col("event_type").alias("tag"))
    return upkeep.tags_in_order(tags, 3).select("note_id", F.concat_ws(",", "tags").alias("tags"))


def notes_after_changes(spark: SparkSession, d: str) -> DataFrame:
    """Notes made of documents after a log of changes made of events."""
    documents = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("title").alias("quote"), F.lit("").alias("body"), F.col("url").alias("source_url"))
    action = F.create_map(*[F.lit(x) for x in ("signup", "create", "purchase", "update", "error", "delete", "view", "update", "click", "update")])[F.col("event_type")]
    changes = table(spark, d, "events").select(F.col("event_id").alias("seq"), action.alias("action"), F.col("user_id").cast("long").alias("id"), F.lit(None).cast("string").alias("quote"), F.concat(F.lit("b"), "event_id").alias("body"), F.lit(None).cast("string").alias("source_url"))
    return upkeep.changed_notes(documents, changes).select("id", "quote", "body", "source_url")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        documents_page3, documents_of_domain, jobs_page, blocks_list, document_inspection, enqueue_links, polite_schedule, deferred_entries, marked_entries, restarted_jobs, retried_jobs, recrawl_schedule,
        touched_documents, restore_drill, job_progress, tags_first_seen, notes_after_changes,
    )
}

_CUR = "cur AS (SELECT * FROM frontier QUALIFY row_number() OVER (PARTITION BY job_id, url ORDER BY discovered_at DESC, available_at DESC, attempts DESC, state DESC) = 1)"
_SLOW = "slow AS (SELECT DISTINCT host FROM cur WHERE failure_type = 'http_429' AND host IS NOT NULL)"
_DONE = "status IN ('complete', 'cancelled', 'failed')"
_PAGES = "CAST(greatest(1, ceil(total / {0}.0)) AS INTEGER) AS total_pages"
_DOMAIN = "(url = 'https://wynfada-wiki.example' OR starts_with(url, 'https://wynfada-wiki.example/'))"
_UHOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1))"
_GLOB = r"regexp_matches(url, '(?i)^' || replace(regexp_replace(p, '([.+^${}()|\[\]\\?])', '\\\1', 'g'), '*', '.*') || '$')"

ORACLE: dict[str, str] = {
    "documents_page3": f"SELECT url, title, indexed_at, total, 3 AS page, {_PAGES.format(20)} FROM (SELECT *, count(*) OVER () AS total FROM documents) ORDER BY indexed_at DESC, url LIMIT 20 OFFSET 40",
    "documents_of_domain": f"SELECT url, indexed_at, total, 1 AS page, {_PAGES.format(20)} FROM (SELECT *, count(*) OVER () AS total FROM documents WHERE {_DOMAIN}) ORDER BY indexed_at DESC, url LIMIT 20",
    "jobs_page": f"SELECT id, seed_url, created_at, total, 1 AS page, {_PAGES.format(10)} FROM (SELECT *, count(*) OVER () AS total FROM crawl_jobs WHERE status = 'complete') ORDER BY created_at DESC, id DESC LIMIT 10",
    "blocks_list": f"SELECT domain, reason, created_at, total, 2 AS page, {_PAGES.format(20)} FROM (SELECT *, count(*) OVER () AS total FROM domain_blocks) ORDER BY created_at DESC, domain LIMIT 20 OFFSET 20",
    "document_inspection": f"""WITH {_CUR}, f AS (SELECT url, count(DISTINCT (job_id, status, state, depth)) AS jobs, min(job_id) AS first_job FROM cur JOIN crawl_jobs j ON j.id = job_id GROUP BY url)
        SELECT d.url, length(title) AS title_length, length(text) AS text_length, CASE WHEN trim(coalesce(text, ''), ' ') = '' THEN 0 ELSE length(trim(text, ' ')) - length(replace(trim(text, ' '), ' ', '')) + 1 END AS words,
          CAST(coalesce(jobs, 0) AS INTEGER) AS jobs, first_job FROM documents d LEFT JOIN f ON f.url = d.url""",
    "enqueue_links": f"""WITH {_CUR}, c AS (SELECT f.job_id, l.target_url AS url, min(f.depth) + 1 AS depth FROM cur f JOIN document_links l ON l.source_url = f.url WHERE f.state = 'fetched' AND l.target_url IS NOT NULL GROUP BY 1, 2),
        n AS (SELECT * FROM c WHERE NOT EXISTS (SELECT 1 FROM cur WHERE cur.job_id = c.job_id AND cur.url = c.url)),
        a AS (SELECT n.*, j.max_pages, j.crawl_policy AS y FROM n JOIN crawl_jobs j ON j.id = n.job_id WHERE {_UHOST} NOT IN (SELECT lower(domain) FROM domain_blocks)),
        b AS (SELECT * FROM a WHERE NOT (y.max_depth IS NOT NULL AND depth > y.max_depth) AND len(list_filter(coalesce(y.exclude_patterns, []), lambda p: {_GLOB})) = 0
          AND (len(coalesce(y.include_patterns, [])) = 0 OR len(list_filter(y.include_patterns, lambda p: {_GLOB})) > 0)),
        h AS (SELECT job_id, count(*) AS held FROM cur GROUP BY job_id)
        SELECT b.job_id, url, depth FROM b LEFT JOIN h ON h.job_id = b.job_id QUALIFY row_number() OVER (PARTITION BY b.job_id ORDER BY url) <= max_pages - coalesce(held, 0)""",
    "polite_schedule": f"""WITH {_CUR}, {_SLOW} SELECT job_id, url, CAST(greatest({NOW_MS} + (row_number() OVER (PARTITION BY c.host ORDER BY discovered_at, job_id, url) - 1) * CASE WHEN s.host IS NULL THEN 1000 ELSE 5000 END, coalesce(available_at, 0)) AS BIGINT) AS start_ms
        FROM cur c LEFT JOIN slow s ON s.host = c.host WHERE state = 'queued' AND c.host IS NOT NULL""",
    "deferred_entries": f"""WITH {_CUR}, {_SLOW}, a AS (SELECT c.host, CASE WHEN p THEN 'queued' ELSE state END AS state, CASE WHEN p THEN NULL ELSE lease_owner END AS o, CASE WHEN p THEN {NOW_MS + 60_000} ELSE available_at END AS t
          FROM (SELECT cur.*, cur.state = 'processing' AND cur.host IN (SELECT host FROM slow) AND cur.host IS NOT NULL AS p FROM cur) c)
        SELECT host, state, count(*) AS entries, count(o) AS leases, max(t) AS latest FROM a GROUP BY 1, 2""",
    "marked_entries": f"""WITH {_CUR}, a AS (SELECT CASE WHEN state <> 'processing' OR j.id IS NULL THEN state WHEN j.failed > 0 THEN 'failed' ELSE 'fetched' END AS state, CASE WHEN state <> 'processing' OR j.id IS NULL THEN failure_type WHEN j.failed > 0 THEN 'http_5xx' END AS failure_type,
          CASE WHEN state <> 'processing' OR j.id IS NULL THEN lease_owner END AS o FROM cur LEFT JOIN crawl_jobs j ON j.id = job_id) SELECT state, failure_type, count(*) AS entries, count(o) AS leases FROM a GROUP BY 1, 2""",
    "restarted_jobs": f"""WITH {_CUR}, e AS (SELECT job_id, count(*) FILTER (state = 'queued' OR {_DONE}) AS queued, CAST(sum(CASE WHEN {_DONE} THEN 0 ELSE attempts END) AS BIGINT) AS attempts FROM cur LEFT JOIN crawl_jobs j ON j.id = job_id GROUP BY job_id)
        SELECT id, CASE WHEN {_DONE} THEN 'queued' ELSE status END AS status, CASE WHEN {_DONE} THEN 0 ELSE indexed END AS indexed, CASE WHEN {_DONE} THEN 0 ELSE skipped END AS skipped, CASE WHEN {_DONE} THEN 0 ELSE failed END AS failed,
          CASE WHEN {_DONE} THEN NULL ELSE error END AS error, queued, attempts FROM crawl_jobs LEFT JOIN e ON e.job_id = id""",
    "retried_jobs": f"""WITH {_CUR}, e AS (SELECT job_id, count(*) FILTER (state = 'queued') AS q, count(*) FILTER (state = 'failed') AS f FROM cur GROUP BY job_id), j AS (SELECT *, {_DONE} AND coalesce(f, 0) > 0 AS hit FROM crawl_jobs LEFT JOIN e ON e.job_id = id)
        SELECT id, CASE WHEN hit THEN 'queued' ELSE status END AS status, CASE WHEN hit THEN greatest(failed - f, 0) ELSE failed END AS failed, CASE WHEN hit THEN q + f ELSE q END AS queued, CASE WHEN hit THEN 0 ELSE f END AS failed_entries FROM j""",
    "recrawl_schedule": f"SELECT id, {RECRAWL_MS} + recrawl_minutes * 60000 AS next_recrawl_at FROM crawl_jobs WHERE status = 'complete' AND next_recrawl_at <= {RECRAWL_MS} AND recrawl_minutes > 0",
    "touched_documents": f"SELECT CASE WHEN etag IS NULL THEN indexed_at ELSE '{AT}' END AS indexed_at, count(*) AS documents FROM documents GROUP BY 1",
    "restore_drill": " UNION ALL ".join(
        f"SELECT '{n}' AS table_name, count(*) AS row_count, count(DISTINCT {k}) AS keys, min(CAST({k} AS VARCHAR)) AS first_key, max(CAST({k} AS VARCHAR)) AS last_key FROM {n}"
        for n, k in (("documents", "doc_id"), ("document_links", "source_url"), ("frontier", "job_id"), ("crawl_jobs", "id"), ("domain_blocks", "domain"))
    ),
    "job_progress": "SELECT id, coalesce(indexed, 0) + coalesce(skipped, 0) + coalesce(failed, 0) AS done, round(least(1.0, coalesce(CAST(done AS DOUBLE) / nullif(max_pages, 0), 0.0)), 6) AS share FROM crawl_jobs",
    "tags_first_seen": "WITH f AS (SELECT user_id AS note_id, lower(trim(event_type)) AS tag, min(event_id) AS pos FROM events GROUP BY 1, 2 HAVING tag <> '') SELECT note_id, array_to_string(list(tag ORDER BY pos)[1:3], ',') AS tags FROM f GROUP BY 1",
    "notes_after_changes": """WITH c AS (SELECT event_id AS seq, CAST(user_id AS BIGINT) AS id, CASE event_type WHEN 'signup' THEN 'create' WHEN 'error' THEN 'delete' ELSE 'update' END AS action, 'b' || event_id AS body FROM events),
        g AS (SELECT id, max(seq) FILTER (action = 'delete') AS gone, max(seq) FILTER (action = 'create') AS born FROM c GROUP BY id),
        v AS (SELECT c.id, arg_max(body, seq) AS body FROM c JOIN g USING (id) WHERE action <> 'delete' AND seq > coalesce(gone, -1) GROUP BY c.id)
        SELECT coalesce(d.doc_id, g.id) AS id, CASE WHEN gone IS NULL THEN title END AS quote, coalesce(v.body, CASE WHEN gone IS NULL AND d.doc_id IS NOT NULL THEN '' END) AS body, CASE WHEN gone IS NULL THEN url END AS source_url
        FROM documents d FULL JOIN g ON g.id = d.doc_id LEFT JOIN v ON v.id = coalesce(d.doc_id, g.id) WHERE coalesce(born > coalesce(gone, -1), false) OR (d.doc_id IS NOT NULL AND gone IS NULL)""",
}

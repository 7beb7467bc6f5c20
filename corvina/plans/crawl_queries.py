"""Queries on crawling, operations and the personal side, with the SQL that checks them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvina.functions import crawl as cr
from corvina.operators import admin, frontier, workspace
from corvina.session import table

#: The moment leases, retries and recrawls are measured against (epoch milliseconds, within the tables' times), and the cutoff of retention.
NOW_MS = 1_928_600_000_000
CUTOFF = "2031-02-10T00:00:00.000Z"

#: The moment recrawls are measured against: thirty days later, when some are due.
RECRAWL_MS = NOW_MS + 30 * 86_400_000


def _frontier(spark: SparkSession, d: str) -> DataFrame:
    return frontier.current(table(spark, d, "frontier"))


def job_status_summary(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by status, zero-filled."""
    return admin.job_summary(table(spark, d, "crawl_jobs"))


def frontier_summary(spark: SparkSession, d: str) -> DataFrame:
    """The nine figures of every job's frontier."""
    return frontier.summary(_frontier(spark, d), ["job_id"], NOW_MS)


def frontier_current(spark: SparkSession, d: str) -> DataFrame:
    """The last state of every entry."""
    return _frontier(spark, d).select("job_id", "url", "state", "attempts", "available_at", "discovered_at")


def frontier_budget(spark: SparkSession, d: str) -> DataFrame:
    """Entries within their job's budget."""
    return frontier.within_budget(_frontier(spark, d).select("job_id", "url", "discovered_at"), table(spark, d, "crawl_jobs")).select("job_id", "url")


def next_entries(spark: SparkSession, d: str) -> DataFrame:
    """What every job would fetch next."""
    return frontier.next_entries(_frontier(spark, d), NOW_MS)


def lease_claims(spark: SparkSession, d: str) -> DataFrame:
    """The frontier by state and owner after one worker claimed for every job."""
    after = frontier.claim(_frontier(spark, d), "worker-new", 30_000, NOW_MS)
    return after.groupBy("state", F.coalesce(F.col("lease_owner") == "worker-new", F.lit(False)).alias("is_new")).agg(F.count("*").alias("entries"), F.sum("attempts").alias("attempts"))


def retry_backoff(spark: SparkSession, d: str) -> DataFrame:
    """What becomes of every entry with an error."""
    return frontier.retry_plan(_frontier(spark, d), NOW_MS)


def failure_classes(spark: SparkSession, d: str) -> DataFrame:
    """Errors by class, with what was recorded."""
    rows = table(spark, d, "frontier").where("last_error IS NOT NULL").select(cr.failure_type(F.col("last_error")).alias("failure"), "failure_type")
    return rows.groupBy("failure", "failure_type").agg(F.count("*").alias("entries"))


def policy_gate(spark: SparkSession, d: str) -> DataFrame:
    """Why each entry of the frontier would be skipped."""
    return frontier.allowed_entries(_frontier(spark, d), table(spark, d, "crawl_jobs"), table(spark, d, "domain_blocks"))


def jobs_due(spark: SparkSession, d: str) -> DataFrame:
    """Jobs whose recrawl is due."""
    return frontier.due_jobs(table(spark, d, "crawl_jobs"), RECRAWL_MS).select("id", "next_recrawl_at")


def crash_recovery(spark: SparkSession, d: str) -> DataFrame:
    """Frontier by state after a crash."""
    entries, _ = frontier.recover(_frontier(spark, d), table(spark, d, "crawl_jobs"))
    return entries.groupBy("state").agg(F.count("*").alias("entries"), F.count("lease_owner").alias("leases"))


def job_lifecycle_fold(spark: SparkSession, d: str) -> DataFrame:
    """Status of a job per user after the user's events, read as actions, in order."""
    action = F.create_map(*[F.lit(x) for x in ("signup", "start", "purchase", "finish", "error", "fail", "view", "pause", "click", "resume")])[F.col("event_type")]
    return frontier.fold_statuses(table(spark, d, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), action.alias("action")))


def rate_limit_fixed_window(spark: SparkSession, d: str) -> DataFrame:
    """Requests let through per client at three per hour, windows anchored at the first request."""
    requests = table(spark, d, "events").select(F.col("user_id").cast("string").alias("client"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_id").alias("request_id"))
    return frontier.rate_limit(requests, 3, 3_600_000).groupBy("client").agg(F.count("*").alias("requests"), F.count(F.when(F.col("allowed"), 1)).alias("allowed"))


def ops_metrics(spark: SparkSession, d: str) -> DataFrame:
    """Counts over all tables in one row."""
    return admin.metrics(table(spark, d, "documents"), table(spark, d, "crawl_jobs"), _frontier(spark, d))


def documents_by_language(spark: SparkSession, d: str) -> DataFrame:
    """Documents by stored language."""
    return admin.counted(table(spark, d, "documents"), "language")


def documents_by_type(spark: SparkSession, d: str) -> DataFrame:
    """Documents by type."""
    return admin.counted(table(spark, d, "documents"), "document_type")


def skip_reasons(spark: SparkSession, d: str) -> DataFrame:
    """Skipped pages by reason over all jobs."""
    return admin.skip_histogram(table(spark, d, "crawl_jobs"))


def retention_preview(spark: SparkSession, d: str) -> DataFrame:
    """What a sweep would delete."""
    return admin.retention_preview(table(spark, d, "documents"), table(spark, d, "crawl_jobs"), _frontier(spark, d), CUTOFF)


def retention_sweep(spark: SparkSession, d: str) -> DataFrame:
    """Links that are left after a sweep."""
    after = admin.sweep(table(spark, d, "documents"), table(spark, d, "document_links"), table(spark, d, "crawl_jobs"), _frontier(spark, d), CUTOFF)
    return after["links"].groupBy("source_url").agg(F.count("*").alias("links"))


def domain_block_cascade(spark: SparkSession, d: str) -> DataFrame:
    """Rows left in every table after blocking two hosts."""
    blocks = spark.createDataFrame([("wynfada-wiki.example",), ("mirul-board.example",)], "domain string")
    after = admin.block_domains(table(spark, d, "documents"), table(spark, d, "document_links"), table(spark, d, "crawl_jobs"), _frontier(spark, d), blocks)
    counts = [after[n].agg(F.lit(n).alias("table_name"), F.count("*").alias("left_rows")) for n in ("documents", "links", "frontier")]
    jobs = after["jobs"].where("status = 'cancelled'").agg(F.lit("cancelled_jobs").alias("table_name"), F.count("*").alias("left_rows"))
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(jobs)


def diagnostics_latest(spark: SparkSession, d: str) -> DataFrame:
    """The last diagnostic of every page of a job."""
    from corvina.operators.index import latest

    return latest(table(spark, d, "crawl_page_diagnostics"), ["job_id", "url"], F.col("updated_at"), F.col("indexed")).select("job_id", "url", "canonical_outcome", "indexed", "updated_at")


def toggle_collection(spark: SparkSession, d: str) -> DataFrame:
    """What is left switched on after a log of toggles."""
    events = table(spark, d, "events").select(F.concat_ws(":", "user_id", "event_type").alias("item"), F.col("event_id").alias("ts"))
    return workspace.toggled(events, "item").select("item", "ts")


def move_to_front(spark: SparkSession, d: str) -> DataFrame:
    """Each user's last three kinds of events."""
    events = table(spark, d, "events").select("user_id", "event_type", F.col("event_id").alias("ts"))
    return workspace.moved_to_front(events, "user_id", "event_type", 3)


def merge_remote_first(spark: SparkSession, d: str) -> DataFrame:
    """Two lists merged, the remote one first."""
    rows = table(spark, d, "documents").where("source IS NOT NULL").select(F.col("source").alias("item"), F.col("doc_id").alias("pos"), "document_type")
    remote, local = rows.where("document_type = 'pdf'").drop("document_type"), rows.drop("document_type")
    return workspace.merged([remote, local], "item", 250).select("item", "pos")


def graph_payload(spark: SparkSession, d: str) -> DataFrame:
    """The newest documents with their first links."""
    return workspace.graph(table(spark, d, "documents"), table(spark, d, "document_links")).select("url", "title", F.concat_ws(" ", "targets").alias("targets"))


def link_levels(spark: SparkSession, d: str) -> DataFrame:
    """Pages by distance from the first indexed document, three steps far."""
    documents = table(spark, d, "documents")
    seed = documents.agg(F.min_by("url", F.struct("indexed_at", "url")).alias("url"))
    return frontier.crawl_levels(table(spark, d, "document_links"), seed, 3).groupBy("depth").agg(F.count("*").alias("pages"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        job_status_summary, frontier_summary, frontier_current, frontier_budget, next_entries, lease_claims, retry_backoff, failure_classes, policy_gate, jobs_due, crash_recovery, job_lifecycle_fold,
        rate_limit_fixed_window, ops_metrics, documents_by_language, documents_by_type, skip_reasons, retention_preview, retention_sweep, domain_block_cascade, diagnostics_latest, toggle_collection,
        move_to_front, merge_remote_first, graph_payload, link_levels,
    )
}

_CUR = "cur AS (SELECT * FROM frontier QUALIFY row_number() OVER (PARTITION BY job_id, url ORDER BY discovered_at DESC, available_at DESC, attempts DESC, state DESC) = 1)"
_FREE = f"((state = 'queued' AND available_at <= {NOW_MS}) OR (state = 'processing' AND lease_expires_at <= {NOW_MS}))"
_STATUSES = ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in frontier.STATUSES)
_STATES = ", ".join(f"count(*) FILTER (state = '{s}') AS {s}" for s in frontier.STATES)
_FAILURE = "failure_type"  # as the crawler stored it: what the classes are held against
_UHOST = r"lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:@]*)', 1))"
_GLOB = r"regexp_matches(url, '(?i)^' || replace(regexp_replace(p, '([.+^${}()|\[\]\\?])', '\\\1', 'g'), '*', '.*') || '$')"

_ACTION = "CASE event_type WHEN 'signup' THEN 'start' WHEN 'purchase' THEN 'finish' WHEN 'error' THEN 'fail' WHEN 'view' THEN 'pause' WHEN 'click' THEN 'resume' END"

ORACLE: dict[str, str] = {
    "job_lifecycle_fold": f"""WITH a AS (SELECT user_id AS job_id, list({_ACTION} ORDER BY event_id) AS acts FROM events GROUP BY user_id)
        SELECT job_id, list_reduce(list_prepend('queued', acts), lambda s, x: CASE WHEN x = 'pause' AND s IN ('queued', 'running') THEN 'paused' WHEN x = 'resume' AND s = 'paused' THEN 'queued'
          WHEN x = 'start' AND s = 'queued' THEN 'running' WHEN x = 'finish' AND s = 'running' THEN 'complete' WHEN x = 'fail' AND s = 'running' THEN 'failed' ELSE s END) AS status FROM a""",
    "rate_limit_fixed_window": """WITH e AS (SELECT CAST(user_id AS VARCHAR) AS client, epoch_ms(CAST(ts AS TIMESTAMP)) AS t, event_id FROM events),
        l AS (SELECT client, count(*) AS requests, list({'t': t, 'began': CAST(NULL AS BIGINT), 'used': 0, 'ok': 0} ORDER BY t, event_id) AS rows FROM e GROUP BY client),
        r AS (SELECT client, requests, list_reduce(list_prepend({'t': CAST(0 AS BIGINT), 'began': CAST(NULL AS BIGINT), 'used': 0, 'ok': 0}, rows), lambda s, x: CASE WHEN s.began IS NULL OR x.t - s.began >= 3600000
          THEN {'t': x.t, 'began': x.t, 'used': 1, 'ok': s.ok + 1} ELSE {'t': x.t, 'began': s.began, 'used': s.used + 1, 'ok': s.ok + CAST(s.used < 3 AS INTEGER)} END) AS s FROM l)
        SELECT client, requests, CAST(s.ok AS BIGINT) AS allowed FROM r""",
    "job_status_summary": f"SELECT {_STATUSES}, count(*) AS total FROM crawl_jobs",
    "frontier_summary": f"""WITH {_CUR} SELECT job_id, count(*) AS total, {_STATES}, count(*) FILTER (attempts > 0) AS attempted, CAST(coalesce(sum(attempts), 0) AS BIGINT) AS attempts_made,
        CAST(coalesce(sum(CASE WHEN attempts > 1 THEN attempts - 1 END), 0) AS BIGINT) AS retries, count(*) FILTER (state = 'queued' AND attempts > 0) AS retrying,
        min(available_at) FILTER (state = 'queued' AND attempts > 0) AS next_retry_at, count(*) FILTER (state = 'processing' AND lease_expires_at IS NOT NULL) AS leases,
        min(lease_expires_at) FILTER (state = 'processing') AS next_lease_expiry, count(*) FILTER (state = 'processing' AND lease_expires_at <= {NOW_MS}) AS expired_leases FROM cur GROUP BY job_id""",
    "frontier_current": f"WITH {_CUR} SELECT job_id, url, state, attempts, available_at, discovered_at FROM cur",
    "frontier_budget": f"WITH {_CUR} SELECT job_id, url FROM cur JOIN crawl_jobs j ON j.id = job_id QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY discovered_at, url) <= max_pages",
    "next_entries": f"WITH {_CUR} SELECT job_id, (min(struct_pack(d := discovered_at, u := url))).u AS url FROM cur WHERE {_FREE} GROUP BY job_id",
    "lease_claims": f"""WITH {_CUR}, nx AS (SELECT job_id, (min(struct_pack(d := discovered_at, u := url))).u AS url FROM cur WHERE {_FREE} GROUP BY job_id),
        aft AS (SELECT CASE WHEN nx.url IS NOT NULL THEN 'processing' WHEN state = 'processing' AND lease_expires_at <= {NOW_MS} THEN 'queued' ELSE state END AS state, nx.url IS NOT NULL AS is_new,
                attempts + CASE WHEN nx.url IS NOT NULL THEN 1 ELSE 0 END AS attempts FROM cur LEFT JOIN nx ON nx.job_id = cur.job_id AND nx.url = cur.url)
        SELECT state, is_new, count(*) AS entries, CAST(sum(attempts) AS BIGINT) AS attempts FROM aft GROUP BY 1, 2""",
    "retry_backoff": f"""WITH {_CUR}, f AS (SELECT job_id, url, attempts, {_FAILURE} AS failure FROM cur WHERE last_error IS NOT NULL)
        SELECT job_id, url, failure, CASE WHEN failure <> 'unknown' AND attempts < 3 THEN 'queued' ELSE 'failed' END AS next_state,
          CASE WHEN failure <> 'unknown' AND attempts < 3 THEN CAST({NOW_MS} + least(1000 * pow(2, greatest(attempts, 1) - 1), 120000) AS BIGINT) END AS next_at FROM f""",
    "failure_classes": f"SELECT {_FAILURE} AS failure, failure_type, count(*) AS entries FROM frontier WHERE last_error IS NOT NULL GROUP BY 1, 2",
    "policy_gate": f"""WITH {_CUR}, x AS (SELECT cur.job_id, url, depth, j.crawl_policy AS p, b.domain FROM cur JOIN crawl_jobs j ON j.id = cur.job_id LEFT JOIN (SELECT DISTINCT lower(domain) AS domain FROM domain_blocks) b ON b.domain = {_UHOST.format('cur.url')})
        SELECT job_id, url, CASE WHEN domain IS NOT NULL THEN 'domain_blocked' WHEN p.max_depth IS NOT NULL AND depth > p.max_depth THEN 'depth'
          WHEN len(list_filter(coalesce(p.exclude_patterns, []), lambda p: {_GLOB})) > 0 THEN 'exclude_pattern'
          WHEN len(coalesce(p.include_patterns, [])) > 0 AND len(list_filter(p.include_patterns, lambda p: {_GLOB})) = 0 THEN 'include_pattern' END AS reason FROM x""",
    "jobs_due": f"SELECT id, next_recrawl_at FROM crawl_jobs WHERE status = 'complete' AND next_recrawl_at <= {RECRAWL_MS}",
    "crash_recovery": f"""WITH {_CUR}, a AS (SELECT CASE WHEN j.status = 'running' AND state = 'processing' THEN 'queued' ELSE state END AS state, CASE WHEN j.status = 'running' AND state = 'processing' THEN NULL ELSE lease_owner END AS o
        FROM cur LEFT JOIN crawl_jobs j ON j.id = job_id) SELECT state, count(*) AS entries, count(o) AS leases FROM a GROUP BY state""",
    "ops_metrics": f"""WITH {_CUR} SELECT (SELECT count(*) FROM documents) AS documents, (SELECT round(avg(quality_score), 6) FROM documents) AS mean_quality, (SELECT count(*) FROM crawl_jobs) AS jobs,
        {", ".join(f"(SELECT count(*) FROM crawl_jobs WHERE status = '{s}') AS jobs_{s}" for s in frontier.STATUSES)}, (SELECT count(*) FROM cur) AS entries,
        {", ".join(f"(SELECT count(*) FROM cur WHERE state = '{s}') AS entries_{s}" for s in frontier.STATES)}, (SELECT count(*) FROM cur WHERE state = 'queued' AND attempts > 0) AS retrying""",
    "documents_by_language": "SELECT coalesce(language, 'unknown') AS value, count(*) AS documents FROM documents GROUP BY 1",
    "documents_by_type": "SELECT coalesce(document_type, 'unknown') AS value, count(*) AS documents FROM documents GROUP BY 1",
    "skip_reasons": "WITH e AS (SELECT unnest(map_entries(skip_reasons)) AS e FROM crawl_jobs) SELECT e.key AS reason, CAST(sum(e.value) AS BIGINT) AS pages FROM e GROUP BY 1",
    "retention_preview": f"""WITH {_CUR}, o AS (SELECT id FROM crawl_jobs WHERE status IN ('complete', 'failed', 'cancelled') AND updated_at < '{CUTOFF}')
        SELECT (SELECT count(*) FROM o) AS jobs, (SELECT count(*) FROM cur WHERE job_id IN (SELECT id FROM o)) AS entries, (SELECT count(*) FROM documents WHERE indexed_at < '{CUTOFF}') AS documents""",
    "retention_sweep": f"""WITH g AS (SELECT url FROM documents WHERE indexed_at < '{CUTOFF}') SELECT source_url, count(*) AS links FROM document_links l
        WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.url = l.source_url) AND NOT EXISTS (SELECT 1 FROM g WHERE g.url = l.target_url) GROUP BY source_url""",
    "domain_block_cascade": f"""WITH {_CUR}, b AS (SELECT unnest(['wynfada-wiki.example', 'mirul-board.example']) AS s), g AS (SELECT url FROM documents WHERE {_UHOST.format('url')} IN (SELECT s FROM b))
        SELECT 'documents' AS table_name, (SELECT count(*) FROM documents) - (SELECT count(*) FROM g) AS left_rows
        UNION ALL SELECT 'links', count(*) FROM document_links l WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.url = l.source_url) AND NOT EXISTS (SELECT 1 FROM g WHERE g.url = l.target_url)
        UNION ALL SELECT 'frontier', count(*) FROM cur WHERE host IS NULL OR lower(host) NOT IN (SELECT s FROM b)
        UNION ALL SELECT 'cancelled_jobs', count(*) FROM crawl_jobs WHERE status = 'cancelled' OR (status IN ('queued', 'running', 'paused') AND {_UHOST.format('seed_url')} IN (SELECT s FROM b))""",
    "diagnostics_latest": "SELECT job_id, url, canonical_outcome, indexed, updated_at FROM crawl_page_diagnostics QUALIFY row_number() OVER (PARTITION BY job_id, url ORDER BY updated_at DESC, indexed DESC) = 1",
    "toggle_collection": "SELECT user_id || ':' || event_type AS item, max(event_id) AS ts FROM events GROUP BY 1 HAVING count(*) % 2 = 1",
    "move_to_front": "SELECT user_id, event_type, max(event_id) AS ts FROM events GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY max(event_id) DESC, event_type) <= 3",
    "merge_remote_first": """WITH s AS (SELECT 0 AS o, source, doc_id FROM documents WHERE document_type = 'pdf' UNION ALL SELECT 1, source, doc_id FROM documents),
        f AS (SELECT source AS item, min(struct_pack(o := o, pos := doc_id)) AS m FROM s WHERE source IS NOT NULL GROUP BY 1) SELECT item, m.pos AS pos FROM f ORDER BY m.o, m.pos LIMIT 250""",
    "graph_payload": """WITH n AS (SELECT url, title FROM documents ORDER BY indexed_at DESC, url LIMIT 100),
        e AS (SELECT DISTINCT source_url, target_url FROM document_links WHERE target_url IS NOT NULL AND target_url <> source_url),
        t AS (SELECT source_url, list(target_url ORDER BY target_url)[1:12] AS ts FROM e GROUP BY 1) SELECT url, title, coalesce(array_to_string(ts, ' '), '') AS targets FROM n LEFT JOIN t ON source_url = url""",
    "link_levels": """WITH RECURSIVE e AS (SELECT DISTINCT source_url, target_url FROM document_links WHERE target_url IS NOT NULL),
        w(url, depth) AS (SELECT (min(struct_pack(i := indexed_at, u := url))).u, 0 FROM documents UNION SELECT target_url, depth + 1 FROM w JOIN e ON source_url = url WHERE depth < 3)
        SELECT depth, count(*) AS pages FROM (SELECT url, min(depth) AS depth FROM w GROUP BY url) GROUP BY depth""",
}

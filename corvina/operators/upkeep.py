"""Keeping documents, jobs and frontier over time: pages of lists, inspection, admission, politeness, restarts, notes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import crawl as cr
from corvina.functions import text as tx
from corvina.functions.urls import host
from corvina.operators.frontier import allowed_entries

#: Rows of a page of a list, and the last page that is served.
PAGE_SIZE, LAST_PAGE = 20, 100


def paged(rows: DataFrame, order: Sequence[Column], number: int = 1, size: int = PAGE_SIZE) -> DataFrame:
    """One page of ``rows`` with its envelope: ``page``, ``total`` and ``total_pages`` (at least one).

    A page is the top of an order, so no full sort is written; the total is one aggregate.  Numbers outside 1 to
    ``LAST_PAGE`` are moved to the nearest one.
    """
    number = min(LAST_PAGE, max(1, number))
    total = rows.agg(F.count("*").alias("total"))
    ordered = rows.orderBy(*order)
    part = (ordered.offset((number - 1) * size) if number > 1 else ordered).limit(size)
    return part.crossJoin(F.broadcast(total)).withColumns({"page": F.lit(number), "total_pages": F.greatest(F.lit(1), F.ceil(F.col("total") / size)).cast("int")})  # one row


def of_domain(documents: DataFrame, domain: str | None) -> DataFrame:
    """Documents on the https pages of a domain, without subdomains; all for None."""
    root = f"https://{domain}"
    return documents if domain is None else documents.where((F.col("url") == root) | F.col("url").startswith(root + "/"))


def inspected(documents: DataFrame, frontier: DataFrame, jobs: DataFrame) -> DataFrame:
    """(url, title_length, text_length, words, jobs): statistics of documents with the jobs (id, status, state, depth) that found them, by id."""
    held = frontier.join(jobs.select(F.col("id").alias("job_id"), "status"), "job_id").join(documents.select("url"), "url", "left_semi")
    found = held.groupBy("url").agg(F.sort_array(F.collect_set(F.struct(F.col("job_id").alias("id"), "status", "state", "depth"))).alias("jobs"))
    numbers = documents.select("url", F.length("title").alias("title_length"), F.length("text").alias("text_length"), tx.word_count(F.col("text")).alias("words"))
    return numbers.join(found, "url", "left").withColumn("jobs", F.coalesce("jobs", F.array()))


def enqueued(frontier: DataFrame, candidates: DataFrame, jobs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(job_id, url, depth) of the candidates (job_id, url, depth) that enter the frontier; known ones are ignored.

    A candidate found several times has its least depth.  It must belong to a job, be let in by its policy and not be
    blocked.  A job takes them in the order of their addresses while its frontier holds fewer than ``max_pages``; ranks
    are taken in salted parts of a job first, so that only what may still fit meets in one place.
    """
    fresh = candidates.where("url IS NOT NULL").groupBy("job_id", "url").agg(F.min("depth").alias("depth"))
    fresh = fresh.join(frontier.select("job_id", "url"), ["job_id", "url"], "left_anti")
    let_in = allowed_entries(fresh, jobs, blocks).where("reason IS NULL").select("job_id", "url")
    fresh = fresh.join(let_in, ["job_id", "url"])
    held = frontier.groupBy("job_id").agg(F.count("*").alias("held"))
    room = jobs.select(F.col("id").alias("job_id"), "max_pages").join(held, "job_id", "left").select("job_id", (F.col("max_pages") - F.coalesce("held", F.lit(0))).alias("room"))
    limited = fresh.join(room.where("room > 0"), "job_id")
    part = Window.partitionBy("job_id", F.pmod(F.xxhash64("url"), F.lit(32))).orderBy("url")
    whole = Window.partitionBy("job_id").orderBy("url")
    partial = limited.withColumn("n", F.row_number().over(part)).where("n <= room")
    return partial.withColumn("n", F.row_number().over(whole)).where("n <= room").select("job_id", "url", "depth")


def polite_times(frontier: DataFrame, delays: DataFrame, now_ms: int, least_ms: int = 1_000) -> DataFrame:
    """(job_id, url, start_ms) of queued entries: requests to a host follow each other by its delay (host, delay_ms), ``least_ms`` at least.

    A host's entries are taken in order of discovery (then job and address).  They are numbered within the hours of
    discovery and the hours are added up, so a host with a tenth of all entries is never one task's work.
    """
    queued = frontier.where((F.col("state") == "queued") & F.col("host").isNotNull()).select("job_id", "url", "host", "discovered_at", "available_at").withColumn("hour", F.substring("discovered_at", 1, 13))
    inside = Window.partitionBy("host", "hour").orderBy("discovered_at", "job_id", "url")
    before = Window.partitionBy("host").orderBy("hour").rowsBetween(Window.unboundedPreceding, -1)
    hours = queued.groupBy("host", "hour").agg(F.count("*").alias("n")).withColumn("offset", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    numbered = queued.withColumn("n", F.row_number().over(inside) - 1).join(hours, ["host", "hour"])
    delay = F.greatest(F.coalesce("delay_ms", F.lit(0)), F.lit(least_ms))
    slot = F.lit(now_ms) + (F.col("n") + F.col("offset")) * delay
    return numbered.join(delays, "host", "left").select("job_id", "url", F.greatest(slot, F.coalesce("available_at", F.lit(0))).cast("long").alias("start_ms"))


_LEASE = ("lease_owner", "lease_expires_at", "heartbeat_at")


def _cleared(frontier: DataFrame, hit: Column, names: Sequence[str]) -> dict[str, Column]:
    return {n: F.when(~hit, F.col(n)) for n in names if n in frontier.columns}


def deferred(frontier: DataFrame, until: DataFrame) -> DataFrame:
    """The frontier after the entries in work on hosts (host, until_ms) are put back: queued until then, without a lease."""
    joined = frontier.join(until, "host", "left")
    hit = F.coalesce((F.col("state") == "processing") & F.col("until_ms").isNotNull(), F.lit(False))
    changed = {"state": F.when(hit, "queued").otherwise(F.col("state")), "available_at": F.when(hit, F.col("until_ms")).otherwise(F.col("available_at"))}
    return joined.withColumns(changed | _cleared(frontier, hit, _LEASE)).select(*frontier.columns)


def marked(frontier: DataFrame, results: DataFrame, at: str) -> DataFrame:
    """The frontier after results (job_id, url, worker, error): fetched without an error, else failed; only from the owner of the lease.

    An error is cut to 500 characters and classed.  A worker of null needs no lease.
    """
    named = results.select("job_id", "url", F.col("worker").alias("by_worker"), F.col("error").alias("new_error"), F.lit(True).alias("has_result"))
    joined = frontier.join(named.dropDuplicates(["job_id", "url"]), ["job_id", "url"], "left")
    mine = F.col("by_worker").isNull() | (F.col("by_worker") == F.col("lease_owner"))
    hit = F.coalesce(F.col("has_result") & mine, F.lit(False))
    failed = hit & F.col("new_error").isNotNull()
    message = tx.bounded(F.col("new_error"), 500, "the request failed")
    changed = {
        "state": F.when(failed, "failed").when(hit, "fetched").otherwise(F.col("state")),
        "last_error": F.when(failed, message).when(~hit, F.col("last_error")),
        "failure_type": F.when(failed, cr.failure_type(message)).when(~hit, F.col("failure_type")),
        "last_failed_at": F.when(failed, F.lit(at)).when(~hit, F.col("last_failed_at")),
    }
    return joined.withColumns({n: c for n, c in changed.items() if n in frontier.columns} | _cleared(frontier, hit, _LEASE)).select(*frontier.columns)


FINISHED = ("complete", "cancelled", "failed")


def again(frontier: DataFrame, jobs: DataFrame, ids: DataFrame, *, failed_only: bool = False) -> tuple[DataFrame, DataFrame]:
    """Frontier and jobs after finished jobs (id) are started over: all entries, or the failed ones only.

    Their entries are queued with no attempts, errors and leases.  Jobs are queued; a restart sets their counters to
    zero and forgets the reasons of skips, a retry takes the entries it queues off the failures and needs at least one.
    """
    wanted = jobs.where(F.col("status").isin(*FINISHED)).join(ids.select("id").distinct(), "id", "left_semi").select("id")
    if failed_only:
        broken = frontier.where("state = 'failed'").groupBy(F.col("job_id").alias("id")).agg(F.count("*").alias("again"))
        wanted = wanted.join(broken, "id")
    else:
        wanted = wanted.withColumn("again", F.lit(0))
    joined = frontier.join(wanted.select(F.col("id").alias("job_id"), F.lit(True).alias("hit_")), "job_id", "left")
    hit = F.coalesce(F.col("hit_"), F.lit(False))
    if failed_only:
        hit = hit & (F.col("state") == "failed")
    changed = {"state": F.when(hit, "queued").otherwise(F.col("state")), "attempts": F.when(hit, 0).otherwise(F.col("attempts")), "available_at": F.when(hit, 0).otherwise(F.col("available_at"))}
    entries = joined.withColumns(changed | _cleared(frontier, hit, ("last_error", "failure_type", "last_failed_at", *_LEASE))).select(*frontier.columns)
    marked_ = jobs.join(wanted, "id", "left")
    over = F.col("again").isNotNull()
    reset = {"status": F.when(over, "queued").otherwise(F.col("status")), "error": F.when(~over, F.col("error"))}
    if failed_only:
        reset["failed"] = F.when(over, F.greatest(F.col("failed") - F.col("again"), F.lit(0))).otherwise(F.col("failed"))
    else:
        reset |= {c: F.when(over, 0).otherwise(F.col(c)) for c in ("indexed", "skipped", "failed")}
        if "skip_reasons" in jobs.columns:
            reset["skip_reasons"] = F.when(over, F.create_map().cast(jobs.schema["skip_reasons"].dataType)).otherwise(F.col("skip_reasons"))
    return entries, marked_.withColumns({n: c for n, c in reset.items() if n in jobs.columns}).select(*jobs.columns)


def rescheduled(jobs: DataFrame, now_ms: int) -> DataFrame:
    """(id, next_recrawl_at) of the complete jobs whose recrawl is due: when they are due again, by their own interval."""
    due = jobs.where((F.col("status") == "complete") & (F.col("next_recrawl_at") <= now_ms) & (F.col("recrawl_minutes") > 0))
    return due.select("id", (F.lit(now_ms) + F.col("recrawl_minutes") * 60_000).alias("next_recrawl_at"))


def touched(documents: DataFrame, unchanged: DataFrame, at: str) -> DataFrame:
    """Documents after answers that they are unchanged (url): only the time of indexing moves."""
    hit = documents.join(unchanged.select("url", F.lit(True).alias("hit_")).distinct(), "url", "left")
    return hit.withColumn("indexed_at", F.when(F.col("hit_"), F.lit(at)).otherwise(F.col("indexed_at"))).select(*documents.columns)


def deleted(documents: DataFrame, urls: DataFrame) -> DataFrame:
    """Documents without those of given addresses."""
    return documents.join(urls.select("url").distinct(), "url", "left_anti")


def drill(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, row_count, keys, first_key, last_key): what a restored copy is compared by; ``keys`` counts distinct values of the first column."""
    parts = []
    for name, df in tables.items():
        key = F.col(df.columns[0]).cast("string")
        parts.append(df.agg(F.lit(name).alias("table_name"), F.count("*").alias("row_count"), F.count_distinct(key).alias("keys"), F.min(key).alias("first_key"), F.max(key).alias("last_key")))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def schema_version(migrations: DataFrame) -> DataFrame:
    """One row (version): the greatest applied version (version), 0 without any."""
    return migrations.agg(F.coalesce(F.max("version"), F.lit(0)).alias("version"))


def changed_notes(notes: DataFrame, changes: DataFrame) -> DataFrame:
    """Notes after a log of changes (seq, action, id, quote, body, source_url): create, update, delete, in order of ``seq``.

    The last change of a note decides; an update keeps what it leaves null; updates and deletions of unknown notes do
    nothing.  A note created again after its deletion is new.
    """
    text = ("quote", "body", "source_url")
    last = changes.groupBy("id").agg(
        F.max_by("action", "seq").alias("action"),
        F.max(F.when(F.col("action") == "delete", F.col("seq"))).alias("deleted"),
        F.max(F.when(F.col("action") == "create", F.col("seq"))).alias("created"),
        F.array_sort(F.collect_list(F.struct("seq", "action", *text))).alias("log"),
    )
    joined = notes.select("id", *text, F.lit(True).alias("known")).join(last, "id", "full_outer")
    gone = F.coalesce("deleted", F.lit(-1))
    alive = F.coalesce(F.col("created") > gone, F.lit(False)) | (F.coalesce("known", F.lit(False)) & F.col("deleted").isNull())

    def value(name: str) -> Column:
        own = F.filter("log", lambda x: (x["seq"] > gone) & (x["action"] != "delete") & x[name].isNotNull())
        return F.coalesce(F.try_element_at(F.transform(own, lambda x: x[name]), F.lit(-1)), F.when(F.col("deleted").isNull(), F.col(name)))

    return joined.withColumn("log", F.coalesce("log", F.array())).where(alive).select("id", *[value(n).alias(n) for n in text])


def tags_in_order(tags: DataFrame, most: int = 12) -> DataFrame:
    """(note_id, tags) from (note_id, pos, tag): lower case, trimmed, each once in the order first seen, at most ``most``."""
    clean = tags.select("note_id", "pos", F.lower(F.trim("tag")).alias("tag")).where("tag <> ''")
    first = clean.groupBy("note_id", "tag").agg(F.min("pos").alias("pos"))
    return first.groupBy("note_id").agg(F.slice(F.transform(F.array_sort(F.collect_list(F.struct("pos", "tag"))), lambda x: x["tag"]), 1, most).alias("tags"))


#: Nodes and notes a graph shows at most.
MOST_NODES, MOST_NOTES = 22, 10


def note_graph(nodes: DataFrame, notes: DataFrame, most_nodes: int = MOST_NODES, most_notes: int = MOST_NOTES) -> DataFrame:
    """(kind, key, target): the pages (url) a graph shows and the newest notes (id, source_url, created_at) with an edge to the page they were taken from.

    A note's target is null if its page isn't shown.
    """
    pages = nodes.select("url").distinct().orderBy("url").limit(most_nodes)
    shown = notes.orderBy(F.desc("created_at"), "id").limit(most_notes)
    edges = shown.join(F.broadcast(pages.select(F.col("url").alias("source_url"), F.col("url").alias("target"))), "source_url", "left")
    return pages.select(F.lit("page").alias("kind"), F.col("url").alias("key"), F.lit(None).cast("string").alias("target")).unionByName(edges.select(F.lit("note").alias("kind"), F.col("id").cast("string").alias("key"), "target"))


def job_progress(jobs: DataFrame) -> DataFrame:
    """(id, done, share): pages a job is done with and their share of its budget, at most 1."""
    done = F.coalesce("indexed", F.lit(0)) + F.coalesce("skipped", F.lit(0)) + F.coalesce("failed", F.lit(0))
    return jobs.select("id", done.alias("done"), F.round(F.least(F.lit(1.0), F.coalesce(F.try_divide(done, F.col("max_pages")), F.lit(0.0))), 6).alias("share"))

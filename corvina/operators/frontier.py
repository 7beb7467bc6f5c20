"""Crawl bookkeeping in batch: current state, budgets, eligibility, leases, retries, summaries, robots rules."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvina.functions import crawl as cr
from corvina.functions.urls import host
from corvina.operators.index import latest
from corvina.session import stage

STATES = ("queued", "processing", "fetched", "failed")
STATUSES = ("queued", "running", "paused", "complete", "failed", "cancelled")

MOST_ATTEMPTS = 3


def current(frontier: DataFrame) -> DataFrame:
    """One row per (job_id, url): the one discovered, then available, then tried last."""
    return latest(frontier, ["job_id", "url"], F.col("discovered_at"), F.col("available_at"), F.col("attempts"), F.col("state"))


def within_budget(entries: DataFrame, jobs: DataFrame) -> DataFrame:
    """Entries that fit their job's max_pages, in order of discovery and url; jobs that are unknown have none.

    Ranks are first taken in salted parts of a job, so that only entries that may still fit meet in one place.
    """
    limited = entries.join(jobs.select(F.col("id").alias("job_id"), "max_pages"), "job_id")
    part = Window.partitionBy("job_id", F.pmod(F.xxhash64("url"), F.lit(32))).orderBy("discovered_at", "url")
    whole = Window.partitionBy("job_id").orderBy("discovered_at", "url")
    partial = limited.withColumn("n", F.row_number().over(part)).where("n <= max_pages")
    return partial.withColumn("n", F.row_number().over(whole)).where("n <= max_pages").drop("n", "max_pages")


def next_entries(frontier: DataFrame, now_ms: int) -> DataFrame:
    """(job_id, url): for every job the earliest queued entry that is available; expired leases count as queued."""
    free = (F.col("state") == "queued") & (F.col("available_at") <= now_ms)
    stale = (F.col("state") == "processing") & (F.col("lease_expires_at") <= now_ms)
    first = F.min(F.struct("discovered_at", "url"))
    return frontier.where(free | stale).groupBy("job_id").agg(first.alias("first")).select("job_id", F.col("first.url").alias("url"))


def claim(frontier: DataFrame, worker: str, lease_ms: int, now_ms: int) -> DataFrame:
    """The frontier after ``worker`` claimed the next entry of every job."""
    taken = next_entries(frontier, now_ms).withColumn("taken", F.lit(True))
    joined = frontier.join(taken, ["job_id", "url"], "left")
    stale = F.coalesce((F.col("state") == "processing") & (F.col("lease_expires_at") <= now_ms), F.lit(False))
    mine = F.coalesce("taken", F.lit(False))
    return joined.withColumns(
        {
            "state": F.when(mine, "processing").when(stale, "queued").otherwise(F.col("state")),
            "attempts": F.col("attempts") + mine.cast("long"),
            "lease_owner": F.when(mine, worker).when(~stale, F.col("lease_owner")),
            "lease_expires_at": F.when(mine, F.lit(now_ms + lease_ms)).when(~stale, F.col("lease_expires_at")),
        }
    ).drop("taken")


def renew(frontier: DataFrame, job_id: str, url: str, worker: str, lease_ms: int, now_ms: int) -> DataFrame:
    """The frontier after a heartbeat, which counts only from the owner of a lease that hasn't run out."""
    held = (F.col("job_id") == job_id) & (F.col("url") == url) & (F.col("state") == "processing") & (F.col("lease_owner") == worker) & (F.col("lease_expires_at") > now_ms)
    return frontier.withColumn("lease_expires_at", F.when(F.coalesce(held, F.lit(False)), F.lit(now_ms + lease_ms)).otherwise(F.col("lease_expires_at")))


def retry_plan(frontier: DataFrame, now_ms: int, most: int = MOST_ATTEMPTS) -> DataFrame:
    """(job_id, url, failure, next_state, next_at) of entries with an error: another attempt after the back-off, or failed."""
    failure = cr.failure_type(F.col("last_error"))
    again = cr.retryable(failure) & (F.col("attempts") < most)
    return frontier.where("last_error IS NOT NULL").select(
        "job_id",
        "url",
        failure.alias("failure"),
        F.when(again, "queued").otherwise("failed").alias("next_state"),
        F.when(again, F.lit(now_ms) + cr.backoff_ms(F.col("attempts"), F.lit(None))).alias("next_at"),
    )


def summary(frontier: DataFrame, keys: list[str], now_ms: int) -> DataFrame:
    """Per key: entries by state, zero-filled, attempts, retries, and when the next retry and the next lease are due."""
    waiting = (F.col("state") == "queued") & (F.col("attempts") > 0)
    leased = (F.col("state") == "processing") & F.col("lease_expires_at").isNotNull()
    return frontier.groupBy(*keys).agg(
        F.count("*").alias("total"),
        *cr.zero_filled(F.col("state"), STATES),
        F.count(F.when(F.col("attempts") > 0, 1)).alias("attempted"),
        F.coalesce(F.sum("attempts"), F.lit(0)).alias("attempts_made"),
        F.coalesce(F.sum(F.when(F.col("attempts") > 1, F.col("attempts") - 1)), F.lit(0)).alias("retries"),
        F.count(F.when(waiting, 1)).alias("retrying"),
        F.min(F.when(waiting, F.col("available_at"))).alias("next_retry_at"),
        F.count(F.when(leased, 1)).alias("leases"),
        F.min(F.when(leased, F.col("lease_expires_at"))).alias("next_lease_expiry"),
        F.count(F.when(leased & (F.col("lease_expires_at") <= now_ms), 1)).alias("expired_leases"),
    )


def recover(frontier: DataFrame, jobs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Frontier and jobs after a crash: entries in work of running jobs are queued again, running jobs are queued."""
    running = jobs.where("status = 'running'").select(F.col("id").alias("job_id"), F.lit(True).alias("was_running"))
    joined = frontier.join(running, "job_id", "left")
    back = F.coalesce(F.col("was_running") & (F.col("state") == "processing"), F.lit(False))
    entries = joined.withColumns({"state": F.when(back, "queued").otherwise(F.col("state")), "lease_owner": F.when(~back, F.col("lease_owner")), "lease_expires_at": F.when(~back, F.col("lease_expires_at"))}).drop("was_running")
    return entries, jobs.withColumn("status", F.when(F.col("status") == "running", "queued").otherwise(F.col("status")))


def next_status(status: Column, action: Column) -> Column:
    """Status of a job after an action; an action that isn't allowed changes nothing."""
    final = status.isin("complete", "failed", "cancelled")
    return (
        F.when((action == "cancel") & ~status.isin("complete", "failed"), "cancelled")
        .when((action == "pause") & status.isin("queued", "running"), "paused")
        .when((action == "resume") & (status == "paused"), "queued")
        .when((action == "restart") & final, "queued")
        .when((action == "retry") & final, "queued")
        .when((action == "start") & (status == "queued"), "running")
        .when((action == "finish") & (status == "running"), "complete")
        .when((action == "fail") & (status == "running"), "failed")
        .otherwise(status)
    )


#: Actions of a job that are folded in one piece.
LOG_CHUNK = 10_000


def fold_statuses(events: DataFrame, start: str = "queued", chunk: int = LOG_CHUNK) -> DataFrame:
    """(job_id, status) from (job_id, seq, action) events: a fold over each job's actions in order.

    What a run of actions does is a map from status to status, and maps compose.  So a job's log is cut by ``seq`` into
    chunks, each is folded for every status it may start with, and only those maps, one per chunk, meet in one place: a
    job with most of all events is spread over the cluster.
    """
    statuses = F.array(*[F.lit(s) for s in STATUSES])
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("seq", "action"))), lambda e: e["action"])
    pieces = events.groupBy("job_id", F.floor(F.col("seq") / chunk).alias("piece")).agg(ordered.alias("actions"))
    maps = pieces.select("job_id", "piece", F.transform(statuses, lambda s: F.aggregate(F.col("actions"), s, next_status)).alias("ends"))
    after = lambda s, ends: F.get(ends, F.array_position(statuses, s).cast("int") - 1)
    whole = maps.groupBy("job_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ends"))), lambda m: m["ends"]).alias("maps"))
    return whole.select("job_id", F.aggregate("maps", F.lit(start), after).alias("status"))


def due_jobs(jobs: DataFrame, now_ms: int) -> DataFrame:
    """Complete jobs whose recrawl is due."""
    return jobs.where((F.col("status") == "complete") & F.col("next_recrawl_at").isNotNull() & (F.col("next_recrawl_at") <= now_ms))


def allowed_entries(frontier: DataFrame, jobs: DataFrame, blocks: DataFrame) -> DataFrame:
    """(job_id, url, reason) of every entry of a known job: why it would be skipped (domain_blocked, depth, patterns), or null."""
    policy = jobs.select(F.col("id").alias("job_id"), F.col("crawl_policy.max_depth").alias("max_depth"), F.col("crawl_policy.include_patterns").alias("include"), F.col("crawl_policy.exclude_patterns").alias("exclude"))
    blocked = blocks.select(F.lower("domain").alias("site")).distinct().withColumn("blocked", F.lit(True))
    joined = frontier.join(policy, "job_id").withColumn("site", host(F.col("url"))).join(blocked, "site", "left")
    reason = F.when(F.coalesce("blocked", F.lit(False)), "domain_blocked").otherwise(cr.skip_reason(F.col("url"), F.col("depth"), F.col("max_depth"), F.col("include"), F.col("exclude")))
    return joined.select("job_id", "url", reason.alias("reason"))


def _robots_lines(robots: DataFrame, agent: str) -> DataFrame:
    """(origin, n, key, value) of the lines that concern ``agent``, from (origin, text).

    Groups whose agent is a prefix of ours apply, or else the ``*`` groups.
    """
    lines = robots.select("origin", F.posexplode(F.split("text", r"\r?\n")).alias("n", "raw"))
    lines = lines.select("origin", "n", F.trim(F.regexp_replace("raw", "#.*$", "")).alias("line")).where("line <> ''")
    lines = lines.select("origin", "n", F.lower(F.regexp_extract("line", r"^([A-Za-z\-]+)\s*:", 1)).alias("key"), F.trim(F.regexp_extract("line", r"^[A-Za-z\-]+\s*:(.*)$", 1)).alias("value"))
    order = Window.partitionBy("origin").orderBy("n")
    starts = (F.col("key") == "user-agent") & (F.coalesce(F.lag("key").over(order), F.lit("")) != "user-agent")
    lines = lines.withColumn("starts", starts.cast("int")).withColumn("block", F.sum("starts").over(order))
    agents = lines.where("key = 'user-agent'").select("origin", "block", F.lower("value").alias("agent"))
    own = agents.where((F.col("agent") != "*") & F.lit(agent.lower()).startswith(F.col("agent"))).select("origin", "block").distinct()
    other = agents.where("agent = '*'").select("origin", "block").distinct().join(own.select("origin").distinct(), "origin", "left_anti")
    return lines.join(own.unionByName(other), ["origin", "block"]).select("origin", "n", "key", "value")


def robots_rules(robots: DataFrame, agent: str) -> DataFrame:
    """(origin, path, allow, length) of the rules for ``agent``, from (origin, text); rules of all groups that apply are taken together."""
    rules = _robots_lines(robots, agent).where(F.col("key").isin("allow", "disallow") & (F.col("value") != ""))
    return rules.select("origin", F.col("value").alias("path"), (F.col("key") == "allow").alias("allow"), F.length("value").alias("length"))


#: The longest delay a robots file can ask for.
MOST_CRAWL_DELAY_MS = 30_000


def robots_delays(robots: DataFrame, agent: str) -> DataFrame:
    """(origin, delay_ms) of the first delay asked for in a group that applies to ``agent``, 0 to ``MOST_CRAWL_DELAY_MS``; origins without one have no row."""
    asked = _robots_lines(robots, agent).where("key = 'crawl-delay'").select("origin", "n", F.col("value").try_cast("double").alias("seconds")).where("seconds IS NOT NULL AND NOT isnan(seconds)")
    first = asked.groupBy("origin").agg(F.min_by("seconds", "n").alias("seconds"))
    return first.select("origin", F.least(F.greatest(F.col("seconds") * 1000, F.lit(0.0)), F.lit(float(MOST_CRAWL_DELAY_MS))).cast("long").alias("delay_ms"))


def robots_allowed(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """(url, allowed) for (origin, url, path): the longest matching rule decides, Allow before Disallow; without one a page is allowed."""
    pattern = F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(rules["path"], r"([.+^${}()|\[\]\\?])", r"\\$1"), r"\*", ".*"))
    hit = urls.join(rules, urls["origin"] == rules["origin"], "left").select(urls["url"], F.when(F.regexp_like(urls["path"], pattern), F.struct("length", "allow")).alias("rule"))
    return hit.groupBy("url").agg(F.coalesce(F.max("rule")["allow"], F.lit(True)).alias("allowed"))


def rate_limit(requests: DataFrame, limit: int = 120, window_ms: int = 60_000) -> DataFrame:
    """(client, ts_ms, request_id, allowed, retry_after_s): fixed windows anchored at a client's first request of each window.

    A client's requests are handled in order, one client at a time and batch by batch, so the work of a busy client is
    streamed, not held.
    """
    schema = "client string, ts_ms long, request_id long, allowed boolean, retry_after_s long"

    def run(frames):
        client, start, used = None, 0, 0
        for frame in frames:
            allowed, wait = [], []
            for c, t in zip(frame["client"], frame["ts_ms"]):
                if c != client or t - start >= window_ms:
                    client, start, used = c, t, 0
                used += 1
                allowed.append(used <= limit)
                wait.append(0 if used <= limit else -((t - start - window_ms) // 1000))
            yield pd.DataFrame({"client": frame["client"], "ts_ms": frame["ts_ms"], "request_id": frame["request_id"], "allowed": allowed, "retry_after_s": wait})

    ordered = requests.select("client", "ts_ms", "request_id").repartition("client").sortWithinPartitions("client", "ts_ms", "request_id")
    return ordered.mapInPandas(run, schema)


def crawl_levels(edges: DataFrame, seeds: DataFrame, most_depth: int) -> DataFrame:
    """(url, depth) of pages reached from ``seeds`` (url) by following links, breadth first, at most ``most_depth`` steps.

    One join per level on the new pages only; the number of levels is a parameter of the crawl.  Every level is staged,
    so a level is computed once and the plan doesn't grow with the depth; it ends early when a level is empty.
    """
    edges = stage(edges.where("source_url IS NOT NULL AND target_url IS NOT NULL").select("source_url", "target_url").distinct(), "edges")
    seen = new = stage(seeds.select("url").distinct().withColumn("depth", F.lit(0)), "level")
    for depth in range(1, most_depth + 1):
        step = edges.join(new.select(F.col("url").alias("source_url")), "source_url", "left_semi").select(F.col("target_url").alias("url")).distinct()
        new = stage(step.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)), "level")
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen

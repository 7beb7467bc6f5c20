import time
import uuid

import pandas as pd

from corvina.operators import admin, frontier, upkeep, workspace
from corvina.sources import events, snapshots
from corvina.streaming import processors
from tests.conftest import rows

ENTRY = "job_id string, url string, state string, attempts bigint, available_at bigint, discovered_at string, lease_owner string, lease_expires_at bigint, last_error string, host string"


def entry(job="j", url="u", state="queued", attempts=0, available=0, at="1", owner=None, expires=None, error=None, host="h.test"):
    return (job, url, state, attempts, available, at, owner, expires, error, host)


def test_leases(spark):
    start = spark.createDataFrame([entry()], ENTRY)
    one = frontier.claim(start, "w1", 1000, 10_000)
    assert rows(one, "state", "attempts", "lease_owner", "lease_expires_at") == [("processing", 1, "w1", 11_000)]
    two = frontier.renew(one, "j", "u", "w1", 1000, 10_500)
    assert rows(two, "lease_expires_at") == [(11_500,)]
    assert rows(frontier.claim(two, "w2", 1000, 11_499), "lease_owner") == [("w1",)]
    assert rows(frontier.claim(two, "w2", 1000, 11_500), "lease_owner", "attempts") == [("w2", 2)]
    assert rows(frontier.renew(two, "j", "u", "w2", 1000, 10_600), "lease_expires_at") == [(11_500,)]


def test_summary_is_zero_filled(spark):
    df = spark.createDataFrame([entry(url="a", attempts=2, available=5), entry(url="b", state="processing", attempts=1, expires=7), entry(url="c", state="failed", attempts=3)], ENTRY)
    r = frontier.summary(df, ["job_id"], 7).collect()[0]
    assert (r.total, r.queued, r.processing, r.fetched, r.failed) == (3, 1, 1, 0, 1)
    assert (r.attempted, r.attempts_made, r.retries, r.retrying, r.next_retry_at, r.leases, r.next_lease_expiry, r.expired_leases) == (3, 6, 3, 1, 5, 1, 7, 1)


def test_budget_ties_and_unknown_jobs(spark):
    df = spark.createDataFrame([entry(url=u, at=a) for u, a in (("b", "1"), ("a", "1"), ("c", "0"), ("d", "2"))] + [entry(job="none")], ENTRY)
    jobs = spark.createDataFrame([("j", 2)], "id string, max_pages bigint")
    assert rows(frontier.within_budget(df, jobs), "url") == [("a",), ("c",)]


def test_retry_plan(spark):
    df = spark.createDataFrame([entry(url="a", attempts=1, error="HTTP 503"), entry(url="b", attempts=3, error="HTTP 503"), entry(url="c", attempts=1, error="odd"), entry(url="d")], ENTRY)
    assert rows(frontier.retry_plan(df, 100), "url", "next_state", "next_at") == [("a", "queued", 1100), ("b", "failed", None), ("c", "failed", None)]


def test_lifecycle(spark):
    log = [("j", i, a) for i, a in enumerate(["start", "pause", "pause", "finish", "resume", "start", "finish", "cancel", "restart"])]
    assert rows(frontier.fold_statuses(spark.createDataFrame(log, "job_id string, seq int, action string"))) == [("j", "queued")]
    assert rows(frontier.fold_statuses(spark.createDataFrame(log[:8], "job_id string, seq int, action string"))) == [("j", "complete")]
    for chunk in (1, 2, 3, 100):
        assert rows(frontier.fold_statuses(spark.createDataFrame(log, "job_id string, seq int, action string"), chunk=chunk)) == [("j", "queued")]
        assert rows(frontier.fold_statuses(spark.createDataFrame(log[:8] + [("k", 5, None), ("k", 7, "cancel")], "job_id string, seq int, action string"), chunk=chunk)) == [("j", "complete"), ("k", "cancelled")]


def test_robots(spark):
    text = "User-agent: other\nDisallow: /\n\nUser-agent: *\nUser-agent: corvina\nDisallow: /private # no\nAllow: /private/open\nDisallow: /*.pdf\n"
    rules = frontier.robots_rules(spark.createDataFrame([("o", text)], "origin string, text string"), "corvina-bot/1.0")
    urls = spark.createDataFrame([("o", p, p) for p in ("/", "/private", "/private/open/x", "/a.pdf")] + [("p", "/q", "/q")], "origin string, url string, path string")
    assert rows(frontier.robots_allowed(urls, rules)) == [("/", True), ("/a.pdf", False), ("/private", False), ("/private/open/x", True), ("/q", True)]


def test_rate_limit(spark):
    trace = [("a", 0), ("a", 10), ("a", 20), ("b", 20), ("a", 1000)]
    df = spark.createDataFrame([(c, t, i) for i, (c, t) in enumerate(trace)], "client string, ts_ms long, request_id long")
    assert rows(frontier.rate_limit(df, 2, 1000), "request_id", "allowed", "retry_after_s") == [(0, True, 0), (1, True, 0), (2, False, 1), (3, True, 0), (4, True, 0)]
    assert frontier.rate_limit(df.limit(0), 2, 1000).count() == 0


def test_levels(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", None), ("c", "d")], "source_url string, target_url string")
    assert rows(frontier.crawl_levels(edges, spark.createDataFrame([("a",)], "url string"), 2)) == [("a", 0), ("b", 1), ("c", 2)]


def test_collections(spark):
    log = spark.createDataFrame([("x", 1), ("y", 2), ("x", 3), ("z", 4)], "k string, ts int")
    assert [r.k for r in workspace.toggled(log, "k").collect()] == ["z", "y"]
    visits = spark.createDataFrame([("o", "x", 1), ("o", "y", 2), ("o", "x", 3), ("o", "z", 0)], "o string, k string, ts int")
    assert rows(workspace.moved_to_front(visits, "o", "k", 2), "k") == [("x",), ("y",)]
    remote, local = spark.createDataFrame([("b", 0, "r")], "k string, pos int, v string"), spark.createDataFrame([("a", 0, "l"), ("b", 1, "l")], "k string, pos int, v string")
    assert [(r.k, r.v) for r in workspace.merged([remote, local], "k", 10).collect()] == [("b", "r"), ("a", "l")]


def test_notes(spark):
    schema = "id bigint, quote string, body string, source_url string"
    old = spark.createDataFrame([(1, "q", None, "u")], schema)
    new = spark.createDataFrame([(2, "q", None, "u"), (3, "q2", "b", "u"), (4, "q2", "b", "u")], schema)
    assert workspace.import_notes(old, new).count() == 1
    tagged = workspace.with_tags(new, spark.createDataFrame([(2, " B "), (2, "a"), (2, "b"), (3, "")], "note_id bigint, tag string"))
    assert rows(tagged, "id", "tags") == [(2, ["a", "b"]), (3, []), (4, [])]
    hit = spark.createDataFrame([("d1", 1.0, "1"), ("d2", 2.0, "1")], "key string, score double, at string")
    assert [(r.kind, r.key) for r in workspace.unified(hit, hit, 1).collect()] == [("document", "d2"), ("note", "d2")]


def test_block_cascade(spark):
    docs = spark.createDataFrame([("https://bad.test/1",), ("https://ok.test/1",)], "url string")
    links = spark.createDataFrame([("https://ok.test/1", "https://bad.test/1"), ("https://ok.test/1", "https://ok.test/2")], "source_url string, target_url string")
    jobs = spark.createDataFrame([("a", "https://bad.test/", "running"), ("b", "https://bad.test/", "complete"), ("c", None, "queued")], "id string, seed_url string, status string")
    after = admin.block_domains(docs, links, jobs, spark.createDataFrame([entry(host="BAD.test"), entry(host=None)], ENTRY), spark.createDataFrame([("Bad.test",), ("bad.test",)], "domain string"))
    assert after["documents"].count() == 1 and after["links"].count() == 1 and after["frontier"].count() == 1
    assert rows(after["jobs"], "id", "status") == [("a", "cancelled"), ("b", "complete"), ("c", "queued")]


def test_snapshots(spark, tmp_path):
    tables = {"documents": spark.createDataFrame([("u", 1), ("v", 2)], "url string, n int")}
    snapshots.write(tables, str(tmp_path), "s1")
    time.sleep(1.1)
    snapshots.write(tables, str(tmp_path), "s2")
    assert rows(snapshots.verify(spark, str(tmp_path), "s1"), "table_name", "is_valid") == [("documents", True)]
    assert snapshots.differences(tables["documents"], spark.read.parquet(f"{tmp_path}/s1/documents")).count() == 0
    assert snapshots.names(spark, str(tmp_path)) == ["s2", "s1"] and snapshots.prune(spark, str(tmp_path), 1) == ["s1"]


def test_signed_events(spark):
    jobs = spark.createDataFrame([("a", "failed", 1, 2, 3, "x" * 900)], "id string, status string, indexed long, skipped long, failed long, error string")
    r = events.signed(events.payloads(jobs, "job.failed", "2031"), "key").collect()[0]
    assert len(r.signature) == 64 and '"jobId":"a"' in r.payload and "x" * 501 not in r.payload


def stream(spark, tmp_path, schema, batches, transform):
    """Outputs of a stream fed with one file per batch."""
    source, name = tmp_path / "in", "out_" + uuid.uuid4().hex[:8]
    source.mkdir()
    for i, batch in enumerate(batches):
        pd.DataFrame(batch).to_json(source / f"{i}.json", orient="records", lines=True)
        time.sleep(0.02)
    read = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(source))
    query = transform(read).writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    assert query.awaitTermination(90)
    return spark.table(name)


def test_stream_rate_limit(spark, tmp_path):
    batches = [[{"client": "a", "ts_ms": t, "request_id": t} for t in (0, 10)], [{"client": "a", "ts_ms": t, "request_id": t} for t in (20, 1000)]]
    out = stream(spark, tmp_path, "client string, ts_ms long, request_id long", batches, lambda s: processors.limited(s, 2, 1000, evict=False))
    assert rows(out, "ts_ms", "allowed", "retry_after_s") == [(0, True, 0), (10, True, 0), (1000, True, 0), (20, False, 1)]


def test_stream_leases(spark, tmp_path):
    event = lambda t, w, a: {"job_id": "j", "url": "u", "ts_ms": t, "worker": w, "action": a}
    batches = [[event(10_000, "w1", "claim"), event(10_500, "w1", "heartbeat")], [event(11_499, "w2", "claim"), event(11_500, "w2", "claim"), event(11_600, "w1", "done")]]
    out = stream(spark, tmp_path, "job_id string, url string, ts_ms long, worker string, action string", batches, lambda s: processors.leased(s, 1000))
    assert rows(out, "ts_ms", "granted", "attempts") == [(10_000, True, 1), (10_500, True, 1), (11_499, False, 1), (11_500, True, 2), (11_600, False, 2)]


def test_stream_index(spark, tmp_path):
    held = {"d": spark.createDataFrame([], "url string, text_hash string, indexed_at string"), "l": spark.createDataFrame([], "source_url string, target_url string")}

    def save(documents, links):
        held["d"], held["l"] = documents, links

    handle = processors.keep_index(lambda: (held["d"], held["l"]), save)
    schema = "url string, canonical_url string, text_hash string, indexed_at string, outbound_links array<string>"
    for i, batch in enumerate([[("a", None, "h", "1", ["b"])], [("b", None, "h", "2", []), ("c", None, "k", "2", ["a"])]]):
        handle(spark.createDataFrame(batch, schema), i)
    assert rows(held["d"], "url") == [("a",), ("c",)]
    assert rows(held["l"], "source_url", "target_url") == [("c", "a")]  # b turned out to be a copy of a: links to it are gone


def test_rows_of_a_key_are_ordered_over_all_chunks():
    frames = [pd.DataFrame({"ts_ms": [5, 1], "worker": ["a", "b"]}), pd.DataFrame({"ts_ms": [3], "worker": ["c"]})]
    assert [f["ts_ms"].tolist() for f in processors._in_order(iter(frames), ["ts_ms", "worker"])] == [[1, 3, 5]]
    assert list(processors._in_order(iter([]), ["ts_ms"])) == []


FULL = "job_id string, url string, state string, attempts bigint, host string, depth bigint, available_at bigint, discovered_at string, last_error string, failure_type string, last_failed_at string, lease_owner string, lease_expires_at bigint, heartbeat_at string"


def test_admission_ignores_known_blocked_and_surplus(spark):
    held = spark.createDataFrame([("j", "https://h.test/a", "fetched", 1, "h.test", 0, 0, "1", None, None, None, None, None, None)], FULL)
    jobs = spark.createDataFrame([("j", 3, (5, None, [], ["*skip*"], []))], "id string, max_pages bigint, crawl_policy struct<max_depth:int,request_interval_ms:int,include_patterns:array<string>,exclude_patterns:array<string>,allowed_content_types:array<string>>")
    blocks = spark.createDataFrame([("bad.test",)], "domain string")
    wanted = [("j", u, d) for u, d in (("https://h.test/a", 1), ("https://h.test/c", 2), ("https://h.test/b", 3), ("https://h.test/b", 1), ("https://bad.test/", 1), ("https://h.test/skip", 1), ("https://h.test/d", 1), ("https://h.test/deep", 9), (None, 1))] + [("k", "https://h.test/z", 1)]
    got = upkeep.enqueued(held, spark.createDataFrame(wanted, "job_id string, url string, depth bigint"), jobs, blocks)
    assert rows(got) == [("j", "https://h.test/b", 1), ("j", "https://h.test/c", 2)]
    assert rows(upkeep.enqueued(held.limit(0), held.select("job_id", "url", "depth").limit(0), jobs, blocks)) == []


def test_polite_times_keep_their_distance(spark):
    data = [("j", f"u{i}", "queued", 0, "h.test", 0, 0, f"2031-01-0{1 + i % 3}T0{i % 2}:00", None, None, None, None, None, None) for i in range(20)] + [("j", "w", "queued", 0, None, 0, 0, "1", None, None, None, None, None, None)]
    delays = spark.createDataFrame([("h.test", 1500)], "host string, delay_ms bigint")
    times = sorted(r.start_ms for r in upkeep.polite_times(spark.createDataFrame(data, FULL), delays, 1000).collect())
    assert times == [1000 + 1500 * i for i in range(20)]


def test_marks_need_the_lease(spark):
    base = ("processing", 1, "h.test", 0, 0, "1", None, None, None)
    held = spark.createDataFrame([("j", u, *base, "w1", 9, "8") for u in "abc"], FULL)
    results = spark.createDataFrame([("j", "a", "w1", None), ("j", "b", "w2", None), ("j", "c", None, "HTTP  503")], "job_id string, url string, worker string, error string")
    got = rows(upkeep.marked(held, results, "now"), "url", "state", "last_error", "failure_type", "lease_owner")
    assert got == [("a", "fetched", None, None, None), ("b", "processing", None, None, "w1"), ("c", "failed", "HTTP 503", "http_5xx", None)]


def test_notes_follow_their_log(spark):
    notes = spark.createDataFrame([(1, "q", "b", "s"), (2, "q2", "b2", "s2"), (4, "q4", "b4", None)], "id long, quote string, body string, source_url string")
    log = [(1, "update", 1, None, "new", None), (2, "delete", 2, None, None, None), (3, "update", 2, "x", None, None), (4, "create", 3, "q3", "b3", None), (5, "delete", 3, None, None, None), (6, "create", 3, "again", None, "s3"), (7, "update", 9, "no", None, None)]
    changes = spark.createDataFrame(log, "seq long, action string, id long, quote string, body string, source_url string")
    assert rows(upkeep.changed_notes(notes, changes)) == [(1, "q", "new", "s"), (3, "again", None, "s3"), (4, "q4", "b4", None)]
    tags = spark.createDataFrame([(1, 3, "B"), (1, 1, " a "), (1, 2, "b"), (1, 4, ""), (1, 5, None)], "note_id long, pos int, tag string")
    assert rows(upkeep.tags_in_order(tags)) == [(1, ["a", "b"])]
    pages, taken = spark.createDataFrame([("s",), ("s3",)], "url string"), notes.withColumn("created_at", notes.id.cast("string"))
    assert rows(upkeep.note_graph(pages, taken, most_notes=2)) == [("note", "2", None), ("note", "4", None), ("page", "s", None), ("page", "s3", None)]


def test_pages_of_lists(spark):
    df = spark.range(45).toDF("id")
    last = upkeep.paged(df, [df.id.desc()], 3).collect()
    assert [r.id for r in last] == [4, 3, 2, 1, 0] and {(r.page, r.total, r.total_pages) for r in last} == {(3, 45, 3)}
    assert upkeep.paged(df, [df.id], 0).first().page == 1 and upkeep.paged(df.limit(0), [df.id]).count() == 0
    assert rows(upkeep.schema_version(spark.createDataFrame([], "version int"))) == [(0,)]

import pytest
from pyspark.sql import functions as F

from corvina.functions import crawl as cr
from corvina.functions import text as tx
from corvina.functions import urls as ur
from corvina.sources import options
from corvina.sources.pages import extract, sitemap_entries, sitemap_levels, sitemap_roots, within_cap


def value(spark, column):
    return spark.range(1).select(column.alias("v")).collect()[0].v


@pytest.mark.parametrize(
    ("url", "expected"),
    [
        ("https://user:pass@h.test/path#part", "https://h.test/path"), ("https://h.test?utm_source=n&ref=home&fbclid=x", "https://h.test/?ref=home"), ("HTTPS://H.Test:443/A?b=1", "https://h.test/A?b=1"),
        ("http://h.test:8080/", "http://h.test:8080/"), ("https://h.test/?MC_eid=3", "https://h.test/"),
    ],
)
def test_canonicalize(spark, url, expected):
    assert value(spark, ur.canonicalize(F.lit(url))) == expected


@pytest.mark.parametrize(("address", "public"), [("8.8.8.8", True), ("172.20.0.4", False), ("100.64.0.1", False), ("198.18.0.1", False), ("203.0.113.1", False), ("::ffff:127.0.0.1", False), ("2606:4700:4700::1111", True), ("999.1.1.1", False), ("fe80::1", False)])
def test_public_addresses(spark, address, public):
    assert value(spark, ur.is_public_address(F.lit(address))) is public


def test_public_urls_and_scope(spark):
    for url, public in (("https://h.test/", True), ("ftp://h.test/", False), ("https://localhost/", False), ("https://u@h.test/", False), ("http://[::1]/", False), ("http://10.0.0.1/", False)):
        assert value(spark, ur.is_public_url(F.lit(url))) is public
    assert value(spark, ur.canonical_outcome(F.lit("https://x.test/"), F.array(F.lit("h.test")))) == "rejected"
    assert value(spark, ur.canonical_outcome(F.lit(None).cast("string"), F.array(F.lit("h.test")))) == "none"
    assert value(spark, ur.resolve(F.lit("https://h.test/a/b"), F.lit("../c"))) == "https://h.test/c"
    assert value(spark, ur.is_web_address(F.lit("example.org/x"))) and not value(spark, ur.is_web_address(F.lit("two words")))


def test_tokens_and_ngrams(spark):
    assert value(spark, tx.tokens(F.lit("Café—ÉCOLE a_b"))) == ["cafe", "ecole", "a", "b"]
    assert value(spark, tx.tokens(F.lit(None).cast("string"))) == []
    assert value(spark, tx.bigrams(F.lit("검색어 검색 a"))) == ["검색", "색어", "검색", "a"]
    assert value(spark, tx.korean_stem(F.lit("검색을"))) == "검색"
    assert value(spark, tx.korean_stem(F.lit("나는"))) == "나는"
    assert set(value(spark, tx.search_tokens(F.lit("검색을")))) == {"검색을", "검색", "검", "색"}
    assert value(spark, tx.search_token(F.lit("ＡＢ１"))) == "ab1"
    assert value(spark, tx.search_token(F.lit("ﬁle"))) == "file"


@pytest.mark.parametrize(
    ("title", "text", "links", "expected"),
    [("abcd", "abcde", 0, -0.45), ("t" * 10, " ".join((["alpha", "beta", "gamma"] * 8))[:159], 0, -0.20), ("t", " ".join(f"w{i:02}" for i in range(100))[:389], 0, 0.20), ("t" * 23, " ".join(["token"] * 30)[:179], 60, -0.45)],
)
def test_quality(spark, title, text, links, expected):
    assert value(spark, tx.quality_score(F.lit(title), F.lit(text), F.lit(links))) == pytest.approx(expected)


def test_small_scalars(spark):
    assert value(spark, tx.word_count(F.lit(" atlas quality guide "))) == 3
    assert value(spark, tx.script_language(F.lit("검색 ab"))) == "other" and value(spark, tx.script_language(F.lit("검색어 abc"))) == "ko"
    assert value(spark, tx.byte_size(F.lit(1500))) == "1.5 KB"
    assert [value(spark, cr.retry_after_ms(F.lit(x), F.lit(0))) for x in ("2", "999999", "invalid")] == [2000, 120000, None]
    assert value(spark, cr.retry_after_ms(F.lit("Thu, 01 Jan 1970 00:00:09 GMT"), F.lit(4000))) == 5000
    assert [value(spark, cr.backoff_ms(F.lit(a), F.lit(r))) for a, r in ((1, None), (2, 5000), (99, None))] == [1000, 5000, 120000]
    kinds = [value(spark, cr.failure_type(F.lit(m))) for m in ("HTTP 429", "HTTP 503", "getaddrinfo ENOTFOUND x", "ECONNRESET", "other")]
    assert kinds == ["http_429", "http_5xx", "dns", "connection", "unknown"]
    assert value(spark, cr.content_type_allowed(F.lit("Text/HTML; charset=x"), F.array(F.lit("text/html"))))


def test_policy(spark):
    none = F.array().cast("array<string>")
    reason = lambda depth, include, exclude: value(spark, cr.skip_reason(F.lit("https://h.test/a?p=1"), F.lit(depth), F.lit(2), include, exclude))
    assert reason(3, none, none) == "depth"
    assert reason(1, none, F.array(F.lit("*?P=*"))) == "exclude_pattern"
    assert reason(1, F.array(F.lit("*/b*")), none) == "include_pattern"
    assert reason(1, F.array(F.lit("https://h.test/*")), none) is None


PAGE = """<html><head><title> A &amp;amp; B </title><link rel="canonical" href="/c?utm_source=x"><meta name="robots" content="NoIndex, follow"></head>
<body><script>var x = 1;</script><h1>Head <b>one</b></h1><p>Some&nbsp;text</p><a href="/l1">x</a> <a href='l2#f'>y</a><a href="mailto:a@b.test">m</a><a href="/l1">again</a><a href="http://127.0.0.1/">p</a></body></html>"""


def test_extract(spark):
    rows = spark.createDataFrame([("https://h.test/dir/page", PAGE, None), ("https://h.test/e", None, "bot: none")], "url string, html string, x_robots_tag string")
    full, empty = extract(rows).orderBy("url").collect()
    assert full.title == "A &amp; B" and full.headings == ["Head one"]
    assert full.text.startswith("A &amp; B Head one Some text") and "var x" not in full.text
    assert full.links == ["https://h.test/l1", "https://h.test/dir/l2"]
    assert full.canonical_url == "https://h.test/c" and full.noindex and not full.nofollow
    assert empty.title == "h.test" and empty.text == "" and empty.noindex and empty.nofollow


def test_links_are_resolved_and_counted_after_the_filter(spark):
    local = "".join(f'<a href="http://10.0.0.1/{i}">x</a>' for i in range(3500))
    html = '<a href="../c">c</a><a href="./d?x=1">d</a><a href="?q">q</a><a href="//e.test/f">f</a>' + local + "".join(f'<a href="/p{i}">p</a>' for i in range(400))
    row = extract(spark.createDataFrame([("https://h.test/a/b/x", html, None)], "url string, html string, x_robots_tag string")).first()
    assert row.links[:4] == ["https://h.test/a/c", "https://h.test/a/b/d?x=1", "https://h.test/a/b/x?q", "https://e.test/f"] and len(row.links) == 300


def test_sitemaps_four_levels_deep(spark):
    index_ = lambda *urls: "<sitemapindex>" + "".join(f"<loc>https://h.test/{u}</loc>" for u in urls) + "</sitemapindex>"
    pages_ = lambda *urls: "<urlset>" + "".join(f"<loc>{u}</loc>" for u in urls) + "</urlset>"
    maps = spark.createDataFrame(
        [("https://h.test/0.xml", index_("1.xml", "0.xml")), ("https://h.test/1.xml", index_("2.xml")), ("https://h.test/2.xml", index_("3.xml")), ("https://h.test/3.xml", pages_("https://h.test/deep", "https://o.test/x")), ("https://h.test/sitemap.xml", pages_("https://h.test/top"))],
        "url string, xml string",
    )
    seeds = spark.createDataFrame([("https://h.test",)], "origin string")
    robots = spark.createDataFrame([("https://h.test", "Sitemap: /0.xml"), ("https://z.test", "Sitemap: /z.xml")], "origin string, text string")
    roots = sitemap_roots(seeds, robots)
    assert sorted(r.url for r in roots.collect()) == ["https://h.test/0.xml", "https://h.test/sitemap.xml"]
    found = lambda **o: sorted(r.url for r in sitemap_levels(maps, roots, **o).collect())
    assert found() == ["https://h.test/deep", "https://h.test/top", "https://o.test/x"] and found(hosts=["h.test"]) == ["https://h.test/deep", "https://h.test/top"]
    assert found(most_depth=2) == ["https://h.test/top"] and found(most_documents=1) == []


@pytest.mark.parametrize(("word", "stem"), [("도서관이다", "도서관"), ("도서관으로", "도서관"), ("나이", "나이"), ("나는", "나는"), ("사람이", "사람"), ("abc", "abc")])
def test_korean_stems(spark, word, stem):
    assert value(spark, tx.korean_stem(F.lit(word))) == stem


def test_characters_of_scripts(spark):
    assert value(spark, tx.script_language(F.lit("ゟヿ・"))) == "ja" and value(spark, tx.script_language(F.lit("豈更車"))) == "zh"
    assert value(spark, ur.is_public_address(F.lit("::10.0.0.1"))) is False and value(spark, ur.is_public_address(F.lit("::8.8.8.8"))) is True


@pytest.mark.parametrize(
    ("message", "kind"),
    [("HTTP 429", "http_429"), ("HTTP 503", "http_5xx"), ("was HTTP 503 before", "unknown"), ("getaddrinfo ENOTFOUND h.test", "dns"), ("connect ECONNREFUSED: connection timed out", "connection"), ("The operation was aborted due to timeout", "timeout"), ("no connection today", "unknown"), ("socket hang up", "connection"), (None, None)],
)
def test_failure_types(spark, message, kind):
    assert value(spark, cr.failure_type(F.lit(message).cast("string"))) == kind


def test_sitemaps_and_caps(spark):
    xml = "<urlset><url><loc> https://h.test/a </loc></url><url><loc>https://h.test/a</loc></url><url><loc>http://10.0.0.1/</loc></url></urlset>"
    found = sitemap_entries(spark.createDataFrame([("https://h.test/s.xml", xml)], "url string, xml string"))
    assert [(r.url, r.is_index) for r in found.collect()] == [("https://h.test/a", False)]
    kept, rejected = within_cap(spark.createDataFrame([("é" * 3,), (None,), ("a" * 5,)], "html string"), "html", 5)
    assert kept.count() == 2 and rejected.count() == 1
    robots = "User-agent: *\nSitemap: https://h.test/1.xml # c\nsitemap:https://h.test/1.xml\n#Sitemap: https://h.test/2.xml"
    assert value(spark, cr.robots_sitemaps(F.lit(robots))) == ["https://h.test/1.xml"]


def test_options():
    assert options.search_filters(domain="H.test", since="2031-02-03", until="2031-02-03").domain == "h.test"
    for bad in ({"domain": "a b"}, {"since": "2031-02-30"}, {"since": "2031-02-04", "until": "2031-02-03"}, {"language": "xx"}):
        with pytest.raises(options.InvalidOption):
            options.search_filters(**bad)
    assert options.crawl_limits(0, 1) == options.CrawlLimits(1, 15) and options.crawl_limits() == options.CrawlLimits(100, None)
    with pytest.raises(options.InvalidOption):
        options.crawl_policy({"max_depth": 21})
    assert options.retention("2031-02-03").dry_run and not options.retention("2031-02-03", True, False).dry_run


def test_operations_are_validated():
    full = {"webhook_url": "https://h.test/x", "webhook_secret": "s" * 16, "webhook_events": "crawl.failed, crawl.failed", "backup_minutes": "15", "user_agent": "me/1"}
    got = options.operations(full)
    assert got.webhook_events == ("crawl.failed",) and (got.backup_minutes, got.backups_kept, got.user_agent) == (15, 7, "me/1")
    assert options.operations({"webhook_url": " ", "backups_kept": "3"}) == options.Operations()
    for wrong in ({"webhook_url": "http://h.test"}, {"webhook_url": "https://u@h.test/"}, {"webhook_secret": "short"}, {"webhook_events": "crawl.done"}, {"webhook_events": ","}, {"backup_minutes": "14"}, {"backups_kept": "0"}, {"user_agent": "a\nb"}, {"webhook_secret": ""}):
        with pytest.raises(options.InvalidOption):
            options.operations(full | wrong)
    assert options.admin_token({"admin_token": " t "}) == "t"
    with pytest.raises(options.InvalidOption):
        options.admin_token({})


def test_sessions_keep_what_can_be_read():
    tab = {"title": "t", "url": "u"}
    assert options.session_of({"tabs": [tab, {"title": 1, "url": "u"}, None, *[tab] * 30], "active_url": 3, "recently_closed": "x"}) == options.Session((("t", "u"),) * 20, "", ())
    assert options.session_of(None) == options.Session()

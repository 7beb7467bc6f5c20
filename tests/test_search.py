import pytest

from pyspark.sql import functions as F

from corvina.operators import index, search, workspace
from corvina.operators import querylang as ql
from tests.conftest import rows

CORPUS = [
    ("d1", "Comet article", "A general guide"), ("d2", "Reference", "comet appears in body comet"), ("d3", "Archive", "nothing here at all really long body text"), ("d4", "Guide Comet comet", "b c d"),
    ("d5", "x", "y z"), ("d6", "q", "comet local search"), ("d7", "q", "local comet search"), ("d8", "r", "one two three"), ("d9", "s", "four five"), ("d10", "q r", "s t"),
]


@pytest.fixture(scope="module")
def indexed(spark):
    docs = spark.createDataFrame(CORPUS, "url string, title string, text string")
    return search.postings(docs).cache(), search.corpus_stats(search.document_lengths(docs)).cache()


def found(indexed, query, weights=(8.0, 1.0)):
    return {r.url: r.bm25 for r in search.hits(*indexed, query, weights).collect()}


@pytest.mark.parametrize(
    ("query", "weights", "expected"),
    [
        ("guide", (8.0, 1.0), {"d4": 2.285246429, "d1": 1.203265229}),
        ("guide", (1.0, 1.0), {"d1": 1.203265229, "d4": 1.110229258}),
        ("local comet", (8.0, 1.0), {"d6": 1.313321049, "d7": 1.313321049}),
        ("local NOT zzz", (8.0, 1.0), {"d6": 1.313319975, "d7": 1.313319975}),
        ("local OR reference", (8.0, 1.0), {"d2": 3.446848780, "d6": 1.313319975, "d7": 1.313319975}),
        ("local local", (8.0, 1.0), {"d6": 2.626639951, "d7": 2.626639951}),
    ],
)
def test_scores(indexed, query, weights, expected):
    assert found(indexed, query, weights) == pytest.approx(expected, abs=2e-9)


@pytest.mark.parametrize("query", ["guide", "local comet", "local OR reference", "comet NOT local", '"local search"', "^comet", "NEAR(comet search, 0)", "title:comet*", '""'])
def test_scan_equals_index(spark, indexed, query):
    docs = spark.createDataFrame(CORPUS, "url string, title string, text string")
    assert {r.url: r.bm25 for r in search.hits_by_scan(docs, query).collect()} == pytest.approx(found(indexed, query))


@pytest.mark.parametrize(
    ("query", "urls"),
    [
        ("comet NOT local", "d1 d2 d4"), ("y OR comet AND local", "d5 d6 d7"), ("y OR comet local NOT search", "d5"), ('"local search"', "d6"), ("comet + local", "d6"), ("^comet", "d1 d2 d6"),
        ("NEAR(comet search, 0)", "d7"), ("comet*", "d1 d2 d4 d6 d7"), ("title:comet", "d1 d4"), ("comet or local", ""), ('""', ""), ("COMET", "d1 d2 d4 d6 d7"),
    ],
)
def test_membership(indexed, query, urls):
    assert sorted(found(indexed, query)) == sorted(urls.split())


@pytest.mark.parametrize("query", ["NOT comet", "hello-world", "a.b", "it's", "a,b", "AND", "()", "(a", "a OR"])
def test_malformed(query):
    with pytest.raises(ql.SearchSyntaxError):
        ql.parse(query)


@pytest.mark.parametrize("query", ["", None, "a" * 301, "a\x01b", "a*", "title:a", 'a "b', "(a", "a)", "(" * 9 + "a" + ")" * 9, " ".join("abcdefghijklmnopqrstuvwxyzabcdefg")])
def test_public_rules(query):
    with pytest.raises(ql.SearchSyntaxError):
        ql.validate(query)


def test_precedence(spark):
    docs = spark.createDataFrame([(t, None, t) for t in ("a", "a b", "a c", "a b c", "c")], "url string, title string, text string")
    built = search.postings(docs), search.corpus_stats(search.document_lengths(docs))
    for query, expected in (("a NOT b AND c", {"a c"}), ("a AND c NOT b", {"a c"}), ("a NOT b c", {"a", "a b", "a c"}), ("c AND a NOT b OR b", {"a b", "a c", "a b c"})):
        assert set(found(built, query)) == expected


def test_authority_counts_good_links_only(spark):
    docs = spark.createDataFrame([("t", 0.2), *[(f"s{i}", 0.2) for i in range(12)], ("bad", -0.3), ("hub", 0.2)], "url string, quality_score double")
    edges = [(f"s{i}", "t") for i in range(12)] + [("s0", "t"), ("bad", "s1"), ("s1", "s1"), ("s2", None), ("s3", "outside")] + [("hub", f"x{i}") for i in range(51)] + [("hub", "s2")]
    assert rows(search.authority(spark.createDataFrame(edges, "source_url string, target_url string"), docs)) == [("t", 8)]


def test_filters_and_paging(spark):
    docs = spark.createDataFrame([(f"https://h.test/{i:02}", f"2031-02-{i % 28 + 1:02}T00:00:00.000Z", "en") for i in range(45)] + [("http://h.test/x", "2031-02-01T00:00:00.000Z", "en"), ("https://h.test.evil/", "2031-02-01T00:00:00.000Z", None)], "url string, indexed_at string, language string")
    assert search.Filters(domain="h.test").apply(docs).count() == 45
    assert search.Filters(since="2031-02-03", until="2031-02-03").apply(docs).count() == 2
    assert search.page(docs, search.by_date(), 3).count() == 7
    assert search.page(docs, search.by_date(), 0).collect()[0].indexed_at == "2031-02-28T00:00:00.000Z"


def test_fallback_only_without_hits(spark):
    docs = spark.createDataFrame([("k", "제목", "검색은 빠르다"), ("e", "x", "search")], "url string, title string, text string")
    built, table = (search.postings(docs), search.corpus_stats(search.document_lengths(docs))), search.ngram_postings(docs)
    assert rows(search.with_fallback(search.hits(*built, "검색을"), table, "검색을")) == [("k", 0.0)]
    assert rows(search.with_fallback(search.hits(*built, "검색은"), table, "검색은"), "url") == [("k",)]
    assert rows(search.with_fallback(search.hits(*built, "absent"), table, "absent")) == []


def test_snippet_marks_the_best_window(spark):
    docs = spark.createDataFrame([("u", "w " * 60 + "needle here. " + "z " * 60), ("n", None)], "url string, text string")
    top = spark.createDataFrame([("u",), ("n",)], "url string")
    by = {r.url: r.snippet for r in search.snippets(top, docs, "needle here", 6).collect()}
    assert "<mark>needle</mark> <mark>here</mark>" in by["u"] and by["u"].startswith("...") and by["n"] is None


def test_suggestions_interleave_and_dedupe(spark):
    docs = spark.createDataFrame([("https://a.test/1", "Notes on x", "3"), ("https://a.test/2", "notes on X", "2"), ("https://b.test/", "Notes 100%", "1"), ("https://b.test/n", None, "1")], "url string, title string, indexed_at string")
    assert [r.suggestion for r in search.suggestions(docs, "notes").collect()] == ["Notes on x", "a.test", "Notes 100%", "b.test"]
    assert search.suggestions(docs, "n").count() == 0 and search.suggestions(docs, "100%").count() == 0


def test_index_batch_suppresses_copies(spark):
    docs = spark.createDataFrame([("a", "A", "ta", "h1", "1"), ("b", "B", "tb", "h2", "1")], "url string, title string, text string, text_hash string, indexed_at string")
    links = spark.createDataFrame([("b", "a"), ("a", "b")], "source_url string, target_url string")
    batch = spark.createDataFrame(
        [("b", None, "B", "ta", "h1", "2", ["a"]), ("c", None, "C", "tc", "h3", "2", ["a", "a", "c", "b"]), ("d", None, "D", "tc", "h3", "3", []), ("e2", "a", "A2", "ta2", "h4", "2", ["c"])],
        "url string, canonical_url string, title string, text string, text_hash string, indexed_at string, outbound_links array<string>",
    )
    new_docs, new_links = index.index_batch(docs, links, batch)
    assert rows(new_docs, "url", "title") == [("a", "A2"), ("c", "C")]
    assert rows(new_links, "source_url", "target_url") == [("a", "c"), ("c", "a"), ("c", "b")]


def test_first_of_copies_and_upsert(spark):
    docs = spark.createDataFrame([("u2", "h", "1"), ("u1", "h", "1"), ("u3", "h", "0"), ("u4", None, "0")], "url string, text_hash string, indexed_at string")
    assert rows(index.first_of_copies(docs)) == [("h", "u3", 3)]
    assert rows(index.duplicates(docs)) == [("u1", "u3"), ("u2", "u3")]
    change = spark.createDataFrame([("u2", "n", "9"), ("u9", "n", "9")], "url string, text_hash string, indexed_at string")
    assert rows(index.upsert(docs, change, ["url"]), "url", "text_hash") == [("u1", "h"), ("u2", "n"), ("u3", "h"), ("u4", None), ("u9", "n")]


def test_stored_index_answers_as_the_postings_do(spark, tmp_path):
    docs = spark.createDataFrame(CORPUS, "url string, title string, text string")
    links = spark.createDataFrame([(CORPUS[0][0], CORPUS[1][0])], "source_url string, target_url string")
    held = index.build(docs, links, docs.select("url", F.lit(0.1).alias("quality_score")), str(tmp_path / "i"), file_tokens=5)
    assert rows(held.postings.groupBy("token", "url", "field").agg(F.sort_array(F.flatten(F.collect_list("positions"))).alias("p"))) == rows(search.postings(docs), "token", "url", "field", "positions")
    assert rows(held.grams, "token", "url") == rows(search.ngram_postings(docs), "token", "url") and rows(held.authority) == [(CORPUS[1][0], 1)]
    word = rows(held.postings, "token")[0][0]
    for query in (word, f"{word[:1]}*", f'"{word}"', f"{word} OR absent"):
        scanned = rows(search.hits_by_scan(docs, query))
        assert rows(search.hits(held.postings, held.statistics, query)) == scanned and scanned
    plan = search.hits(held.postings, held.statistics, word)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lead" in plan or "PartitionFilters: [(lead" in plan or "lead" in plan.split("PartitionFilters")[1][:60]
    assert "In(token" in plan or "EqualTo(token" in plan
    empty = index.build(docs.limit(0), links, docs.select("url", F.lit(0.1).alias("quality_score")), str(tmp_path / "e"))
    assert rows(search.hits(empty.postings, empty.statistics, word)) == []


def test_postings_of_long_and_empty_texts(spark):
    text = "b a b " + "x " * 5000 + "a"
    docs = spark.createDataFrame([("u", None, text), ("v", "", None), ("w", "a", "A b")], "url string, title string, text string")
    got = {(r.token, r.url, r.field): (r.positions, r.length) for r in search.postings(docs).collect()}
    assert got[("b", "u", "text")] == ([0, 2], 5004) and got[("a", "u", "text")] == ([1, 5003], 5004) and len(got[("x", "u", "text")][0]) == 5000
    assert got[("a", "w", "title")] == ([0], 3) and not any(k[1] == "v" for k in got)
    assert rows(search.term_statistics(docs)) == [("a", 2, 4), ("b", 2, 3), ("x", 1, 5000)]


def test_fallback_counts_and_previews(spark):
    docs = spark.createDataFrame([("k", "검색의 역사", "좋은 검색을 하자"), ("m", "한국", "검토")], "url string, title string, text string")
    primary, grams = search.hits_by_scan(docs, "검색처럼"), search.ngram_postings(docs)
    assert rows(search.hit_counts(primary, grams, "검색처럼")) == [(1, True)]
    found = search.hits_by_scan(docs, "역사")
    assert rows(search.hit_counts(found, grams, "역사")) == [(1, False)]
    assert rows(search.title_preview(docs.select("url", "title"), 2), "url", "preview") == [("k", "검색"), ("m", "한국")]


def test_local_search_over_pages_and_notes(spark):
    schema = "url string, title string, text string, at string"
    pages = spark.createDataFrame([(f"p{i}", "mill" if i == 3 else "t", "the mill", f"{i:02}") for i in range(60)] + [("k", "도서관", "책", "99")], schema)
    notes = spark.createDataFrame([("1", "a mill", None, "1"), ("2", None, None, None)], schema)
    both = workspace.unified(search.local_hits(pages, "mill"), search.local_hits(notes, "mill"), search.MOST_LOCAL)
    assert both.count() == 51 and [(r.kind, r["rank"]) for r in search.page_of_kinds(both, 3).collect()] == [("document", i) for i in range(41, 51)] + [("note", 1)]
    assert rows(search.local_hits(pages, "서관")) == [("k", 0.0, "99")] and rows(search.local_hits(pages, "absent")) == [] and rows(search.local_hits(pages.limit(0), "서관")) == []


def test_narrowed_results(spark):
    df = spark.createDataFrame([("https://A.wiki.test/1", "2031-01-01T05"), ("https://b.test/2", "2031-01-02T05"), ("nothing", "2031-01-03T05"), (None, None)], "url string, indexed_at string")
    assert rows(search.narrowed(df, " Wiki ")) == [("https://A.wiki.test/1", "2031-01-01T05")]
    assert [r[0] for r in rows(search.narrowed(df, "", "2031-01-02", "2031-01-03"))] == ["https://b.test/2", "nothing"] and search.narrowed(df).count() == 4
    assert rows(search.snippets(df.limit(1).select("url"), df.select("url", F.lit("see the mill").alias("text")), "mill", 18, ("<b>", "</b>")), "snippet") == [("see the <b>mill</b>",)]

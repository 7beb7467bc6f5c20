"""Every query of the subpackage on empty tables and on odd rows: nulls, blanks, repeated rows, very long texts, extra columns."""

import pytest
from pyspark.sql import functions as F

from corvina.llm.queries import QUERIES
from tests.conftest import rows

DOCUMENTS = "doc_id bigint, url string, title string, text string, language string, lang string, source string, line_no bigint, host string, label bigint"
SEARCH = "url string, title string, text string, template array<bigint>, doc_id bigint"
LONG = "The keeper of the {} went down to the river and nobody said a word of it. "


def write(spark, folder, documents):
    docs = spark.createDataFrame([(i, u, t, x, g, h, None, 1, "z", 2) for i, u, t, x, g, h in documents], DOCUMENTS)
    docs.write.parquet(f"{folder}/documents.parquet")
    search = docs.select("url", "title", "text", F.lit(None).cast("array<bigint>").alias("template"), "doc_id")
    search.unionByName(search.limit(2)).unionByName(spark.createDataFrame([(None, None, None, None, None), ("https://not.indexed.test/", "x", "y", None, 5)], SEARCH)).write.parquet(f"{folder}/document_search.parquet")
    empty = not documents
    words = [(lang, i, w) for lang, ws in (("en", "the of and to a was it"), ("de", "der die das und ist")) for i, w in enumerate(ws.split())]
    spark.createDataFrame([] if empty else [*words, (None, None, None)], "lang string, rank_no bigint, word string").write.parquet(f"{folder}/common_words.parquet")
    spark.createDataFrame([] if empty else [(1, "byte_bpe_50k", 16), (2, "byte_bpe_50k", None)], "capacity_id bigint, tokenizer string, capacity_tokens bigint").write.parquet(f"{folder}/pack_capacities.parquet")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    base = tmp_path_factory.mktemp("tables")
    write(spark, base / "empty", [])
    odd = [
        (1, "https://a.test/1", "Tea", "Tea", "en", "en"), (2, "https://WWW.a.test:443/2", None, None, None, None), (3, None, "No address", "A text without an address.", "en", "en"), (4, "https://a.test/4", " ", "", "und", None),
        (5, "https://a.test/5", "Теa", " \n\t\n", "", "de"), (6, "https://a.test/6", "Long", "".join(LONG.format(f"house{i}") for i in range(1500)), "de", "en"),
        (7, "https://a.test/7", "One line", "x" * 30_000, "en", "en"), (8, "https://a.test/8", "{{title}}", "Hello {{first_name}}", "en", "en"), (9, "not a url", "t", "Der alte Mann und das Meer ist ein Buch.", "DE-x", "de"),
        (10, "https://a.test/10", "Copy", "Tea", "en", "en"), (11, "https://a.test/11", "🙂", "🙂​́ \x00 \x1f", None, "zz"),
    ]
    write(spark, base / "odd", odd)
    return base


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, folders, name):
    allowed = 2 if name == "p1_canonical_texts" else 0
    assert QUERIES[name](spark, str(folders / "empty")).count() <= allowed


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_odd_rows(spark, folders, name):
    found = QUERIES[name](spark, str(folders / "odd"))
    got = rows(found)
    assert len(got) == len(set(map(str, got)))
    if name == "p7_found":
        assert (8, "text") in got and (8, "title") in got and (2, "text") not in got
    if name == "p1_found":
        assert got == [("title", 1, 5)]
    if name == "p8_ids":
        assert len(got) == 11 and (2, []) in got and (4, []) in got
    if name == "p9_containers":
        assert {r[2] for r in rows(found, "capacity_id", "container_id", "doc_id")} == set(range(1, 12))
    if name == "p10_statistics":
        assert len(got) == 11
    if name == "p5_found":
        assert not {2, 4, 5} & {r[0] for r in got} and (6, 0, "en") in got

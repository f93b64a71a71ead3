"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns for every operator."""

import time

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strandwise.llm import (
    fingerprints,
    html_text,
    language_id,
    mixing,
    near_dedup,
    packing,
    quality_classifier,
    quality_rules,
    suffix_tree_lm,
    url_filters,
)

CLASH = "size long, _src string, _key string, score double, key string, rank long, _block int, quality int, host string, n long"
LONG = "the word goes on and on " * 12_000
PROSE = "It was the best of times and the worst of times, for this is what they say of it.\n" * 1 + " ".join(
    f"the place{i} and of thing{i} is in it" for i in range(12)
)


def documents(spark, rows):
    rows = [(*r, 7, "s", "k", 0.5, "y", 3, 1, 0, "h", 9) for r in rows]
    return spark.createDataFrame(rows, f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}")


@pytest.fixture
def docs(spark):
    return documents(spark, [
        (1, PROSE, "en", "a", 9), (2, PROSE, "en", "a", 9), (2, PROSE, "en", "a", 9), (3, None, None, None, None),
        (4, "", "en", "b", 0), (5, " \n\t ", "fr", "b", 4), (None, "no id here", "en", None, 3), (6, LONG, "en", "a", 1),
        (7, "x" * 200_000, "en", "c", 1), (8, "été à la mer avec le chat", "fr", "c", 5), (9, "\ud83d\ude00 !! ## 42", None, "c", 2),
    ])


@pytest.fixture
def labels(spark):
    rows = [(1, 1, 0), (4, 0, 0), (5, None, None), (8, 1, 0), (8, 0, 0), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture
def pages(spark):
    rows = [
        (1, "https://a.example.net/en/x?q#f", "<article><p>One two.</p></article>", "h", 0.1), (2, None, None, "h", 0.1),
        (None, "no scheme", "", "h", 0.1), (3, "http://", "<p>" + "a b " * 50_000, "h", 0.1), (3, "http://", "<p>" + "a b " * 50_000, "h", 0.1),
        (4, "x://EXAMPLE.com", "<script>if (a < b) {}", "h", 0.1), (5, "x://..//", "<<<>>><p", "h", 0.1),
    ]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, score double")


OVER_DOCS = {
    "near": lambda d, p: near_dedup.near_duplicates(d),
    "fingerprints": lambda d, p: fingerprints.fingerprints(d),
    "language": lambda d, p: language_id.identify(d),
    "rules": lambda d, p: quality_rules.judge(d),
    "lm": lambda d, p: suffix_tree_lm.score(d),
    "classifier": lambda d, p: quality_classifier.classify(d, p),
    "mixing": lambda d, p: mixing.shares(d),
}
KEEPERS = {
    "near": lambda d, p: near_dedup.keep(d),
    "rules": lambda d, p: quality_rules.keep(d),
    "classifier": lambda d, p: quality_classifier.keep(d, p),
    "mix": lambda d, p: mixing.mix(d),
}


@pytest.mark.parametrize("name", OVER_DOCS)
def test_one_row_per_document(docs, labels, name):
    found = OVER_DOCS[name](docs, labels)
    assert sorted(map(str, (r[0] for r in found.select("doc_id").collect()))) == sorted(map(str, (r[0] for r in docs.select("doc_id").collect())))
    texts = {c: k for c, k in found.dtypes if k in ("double", "boolean")}
    assert found.where(" or ".join(f"{c} is null" for c in texts) or "false").count() == 0


@pytest.mark.parametrize("name", KEEPERS)
def test_keepers_return_the_columns(docs, labels, name):
    found = KEEPERS[name](docs, labels)
    assert found.columns == docs.columns
    ids = {str(r[0]) for r in docs.collect()}
    assert {str(r[0]) for r in found.collect()} <= ids


@pytest.mark.parametrize("name", OVER_DOCS)
def test_empty_tables(docs, labels, name):
    assert OVER_DOCS[name](docs.where("false"), labels.where("false")).count() == 0


@pytest.mark.parametrize("name", KEEPERS)
def test_empty_tables_of_keepers(docs, labels, name):
    assert KEEPERS[name](docs.where("false"), labels.where("false")).count() == 0


def test_packing_edges(docs):
    found = packing.pack(docs).collect()
    assert {str(r["doc_id"]) for r in found} == {str(r[0]) for r in docs.collect()}
    assert [r["length"] for r in found if r["doc_id"] in (3, 4)] == [1, 1]
    assert packing.pack(docs.where("false")).count() == 0


def test_pages_edges(spark, pages):
    text = {(r["page_id"], r["url"]): r["text"] for r in html_text.extract(pages).collect()}
    assert text[1, "https://a.example.net/en/x?q#f"] == "One two." and text[2, None] == "" and text[4, "x://EXAMPLE.com"] == ""
    assert html_text.extract(pages).count() == 7 and html_text.extract(pages.where("false")).count() == 0
    rules = url_filters.rule_table(spark, [("block", "example.net", "/"), ("allow", "example.net", "/en/"), ("block", "com", ""), ("block", "com", "")])
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filters.judge(pages, rules).collect()}
    assert got[1] == ("a.example.net", "/en/x", "example.net/en/", "allow") and got[2] == ("", "", None, "allow")
    assert got[4] == ("example.com", "", "com", "block")
    assert url_filters.judge(pages.where("false"), rules).count() == 0
    assert url_filters.judge(pages, rules.where("false")).where("verdict <> 'allow'").count() == 0


def test_without_labels_nothing_is_rejected(docs, labels):
    found = quality_classifier.classify(docs, labels.where("false"))
    assert {r["score"] for r in found.collect()} == {0.5}
    assert quality_classifier.keep(docs, labels.where("false")).count() == docs.count()


def test_pipeline_stages_keep_columns(spark, docs, labels, tmp_path):
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    plain = docs.drop(*[c.split()[0] for c in CLASH.split(", ")])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, plain, str(tmp_path))
        assert found.columns == plain.columns
    assert corpus_pipeline.STAGES[-1][1](spark, plain.where(F.lit(False)), str(tmp_path)).count() == 0


@pytest.mark.parametrize("html, expected", [
    ("<p class=don't>Text", ["Text"]),
    ("a<!-->b</p><p>c", ["ab", "c"]),
    ("a<!-- x --!>b", ["ab"]),
    ("<p title='x>y'>T</p>", ["T"]),
    ('<p title="open>Text</p><p>more', ["Text", "more"]),
    ("<b><p>x</b>y</p>z", ["xy", "z"]),
])
def test_malformed_tags_lose_no_text(html, expected):
    assert [b.text for b in html_text.blocks(html)] == expected


def test_deep_pages_take_time_in_proportion():
    n = 100_000
    for html in ("<div>" * n + "</b>" * n, "<b>" + "<div>" * n + "</b>" * n, "<blockquote>" * n, "<b>" * n + "x<div></div>" * n):
        begun = time.process_time()
        html_text.blocks(html + "<p>end")
        assert time.process_time() - begun < 30


def test_classifier_collects_one_row_for_a_repeated_id(spark):
    rows = [(7 if i < 400 else i, f"text number {i} of a few plain words") for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in (7, *range(400, 500))], "doc_id long, quality int")
    sizes = []
    whole = quality_classifier.fit
    quality_classifier.fit = lambda p, u: sizes.append(len(p) + len(u)) or whole(p, u)
    try:
        quality_classifier.learn(docs, labels)
    finally:
        quality_classifier.fit = whole
    assert sizes[0] <= docs.select("doc_id").distinct().count()


def test_mix_splits_rows_without_ids(spark):
    rows = [(None, " ".join(f"a{i}_{k}" for k in range(5)), "a") for i in range(300)] + [(i, "one two", "b") for i in range(100)]
    found = mixing.shares(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for size in (5, 2):
        mine = [r for r in found if r["size"] == size]
        assert abs(sum(r["taken"] for r in mine) - mine[0]["target"]) <= size

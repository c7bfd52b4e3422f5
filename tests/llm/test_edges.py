"""Each operator on null, empty and very long texts, repeated rows, empty tables and clashing column names."""

import pytest
from pyspark.sql import functions as F

from ballot.llm import decontam, html_extract, line_dedup, packing, pii, quality_pu, quality_rules, secrets, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 9973} is number {i}." + ("\n" if i % 7 == 0 else "") for i in range(60_000))
ROWS = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "one two three", "en", "a", 13), (3, "one two three", "en", "a", 13), (None, "no id here, really none", None, "b", 3), (5, LONG, "en", "a", len(LONG)), (6, "  \n\t\n ", "en", "a", 6), (7, LONG, "en", "b", len(LONG))]
CLASHES = ["key", "id", "fp", "u", "v", "row", "curve", "ids", "doc", "mask", "words", "word", "known", "score", "predicted", "held_out", "n_lines", "n_dropped", "spans", "n_words", "kept", "base_failed", "bucket", "least", "root", "item", "coverage", "p", "stats", "label", "start", "length", "n_hex"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 0), (3, 1, 0), (5, 1, None), (None, 1, 1), (6, 0, 0), (99, 0, 1)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def bench(spark):
    return spark.createDataFrame([(1, None), (2, ""), (3, "too short"), (4, "word5 is number 5 word6 is number 6"), (None, "word8 is number 8 word9 is number 9")], "item_id long, text string")


OPERATORS = {
    "lines": lambda d, lab, b: line_dedup.line_dedup(d),
    "lines joined": lambda d, lab, b: line_dedup.line_dedup(d, documents=2, least=3, broadcast_bytes=-1),
    "simhash": lambda d, lab, b: simhash.simhash_classes(d),
    "keep first": lambda d, lab, b: simhash.keep_first(d),
    "quality": lambda d, lab, b: quality_pu.quality_scores(d, lab),
    "secrets": lambda d, lab, b: secrets.secret_spans(d),
    "toxicity": lambda d, lab, b: toxicity.toxicity_scores(d, lab),
    "toxicity without labels": lambda d, lab, b: toxicity.toxicity_scores(d),
    "pii": lambda d, lab, b: pii.pii_spans(d),
    "rules": lambda d, lab, b: quality_rules.quality_rules(d, lab),
    "contamination": lambda d, lab, b: decontam.contamination(d, b),
    "decontaminated": lambda d, lab, b: decontam.decontaminated(d, b),
    "packing": lambda d, lab, b: packing.pack(d),
}
#: Rows out of ROWS, where it isn't all of them; contamination and packing are checked apart.
KEPT = {"keep first": 4, "decontaminated": 6}


@pytest.mark.parametrize("name", OPERATORS)
def test_edges(docs, labels, bench, name):
    run = OPERATORS[name]
    got = run(docs, labels, bench).collect()
    if name == "contamination":
        assert sorted((r.doc_id, r.item_id or 0) for r in got) == [(5, 0), (5, 4), (7, 0), (7, 4)]
    elif name == "packing":
        assert sum(r.length for r in got) == sum({(r.doc_id, r.start, r.sequence_id, r.offset): r.length for r in got}.values())
        assert {r.doc_id for r in got} == {1, 2, 3, 5, 6, 7, None}
    else:
        assert len(got) == KEPT.get(name, len(ROWS))


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_tables_and_clashing_names(docs, labels, bench, name):
    run = OPERATORS[name]
    assert run(docs.limit(0), labels.limit(0), bench.limit(0)).count() == 0
    few = docs.filter("doc_id < 5 OR doc_id IS NULL")
    wide = few.select("*", *[F.lit("x").alias(c) for c in CLASHES])
    a, b = run(few, labels, bench).collect(), run(wide, labels, bench).collect()
    assert len(a) == len(b)
    if a and name != "packing":
        same = [c for c in a[0].asDict() if c not in ("lang", "source", "n_chars")]
        assert sorted(str([r[c] for c in same]) for r in a) == sorted(str([r[c] for c in same]) for r in b)


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>" + "long text here. " * 60_000 + "</p>"), (3, "u", "plain"), (None, "u", "<div"), (5, "u", "</p></div><p>x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("n_chars", F.lit(0))
    got = html_extract.main_text(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert all(r.n_chars == len(r.text) for r in got.collect()) and got.count() == 6
    assert {r.page_id: r.text for r in got.collect()}[1] == ""
    assert html_extract.main_text(pages.limit(0)).count() == 0


def test_texts_without_words(docs, labels):
    found = {(r.doc_id, r.text): r for r in quality_rules.quality_rules(docs, labels).collect()}
    assert found[1, None].n_words == found[2, ""].n_words == 0 and not found[1, None].kept
    same = {r.fingerprint for r in simhash.simhash_classes(docs.filter("doc_id IN (1, 2, 6)")).collect()}
    assert same == {"0" * 16}
    lines = {r.doc_id: r for r in line_dedup.line_dedup(docs.filter("doc_id IN (1, 2, 6)")).collect()}
    assert [(lines[i].n_lines, lines[i].text) for i in (1, 2, 6)] == [(1, ""), (1, ""), (3, "  \n\t\n ")]


DOTTED = {
    "lines": lambda d, lab: line_dedup.line_dedup(d, "doc.id"),
    "lines joined": lambda d, lab: line_dedup.line_dedup(d, "doc.id", documents=2, least=3, broadcast_bytes=-1),
    "simhash": lambda d, lab: simhash.simhash_classes(d, "doc.id"),
    "keep first": lambda d, lab: simhash.keep_first(d, "doc.id"),
    "quality": lambda d, lab: quality_pu.quality_scores(d, lab, "doc.id"),
    "secrets": lambda d, lab: secrets.secret_spans(d),
    "toxicity": lambda d, lab: toxicity.toxicity_scores(d, lab, "doc.id"),
    "pii": lambda d, lab: pii.pii_spans(d),
    "rules": lambda d, lab: quality_rules.quality_rules(d, lab, "doc.id"),
    "decontaminated": lambda d, lab: decontam.decontaminated(d, d.selectExpr("n_chars AS item_id", "'word8 is number 8 word9 is number 9' AS text")),
    "packing": lambda d, lab: packing.pack(d, "doc.id"),
}


@pytest.mark.parametrize("name", DOTTED)
def test_dots_in_column_names(docs, labels, name):
    few = docs.filter("doc_id < 5 OR doc_id IS NULL").withColumnRenamed("doc_id", "doc.id").withColumn("text.raw", F.lit("x"))
    got = DOTTED[name](few, labels.withColumnRenamed("doc_id", "doc.id"))
    assert "doc.id" in got.columns and {r["doc.id"] for r in got.collect()} <= {1, 2, 3, None}
    assert got.count() > 0

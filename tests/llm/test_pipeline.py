import zlib

import corpus_pipeline
from ballot.llm.common import table

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = {r.doc_id for r in docs.select("doc_id").collect()}
        assert got <= ids and got
        ids = got
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    assert {r.doc_id for r in corpus_pipeline.run(spark, SF).collect()} == ids


def test_empty_and_null_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "x", "en", "a", 1), (2, "", "en", "a", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    for frame in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, frame, SF)
            assert out.count() <= 6, name


def test_held_out_rows_train_nothing(spark):
    from ballot.llm.common import held_out

    rows = spark.range(500).withColumnRenamed("id", "doc_id")
    got = {r.doc_id for r in rows.filter(held_out("doc_id")).collect()}
    assert got == {i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0}


def test_runs_share_nothing(spark):
    a = corpus_pipeline.run(spark, SF)
    b = corpus_pipeline.run(spark, SF)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_clashing_columns_come_back_as_they_were(spark):
    from pyspark.sql import functions as F

    names = ["score", "predicted", "Held_Out", "n_lines", "n_dropped", "__note", "own", "__text", "key", "id", "fp", "row", "__gone", "h1", "h2"]
    docs = table(spark, SF, "documents").filter("doc_id < 60")
    wide = docs.select("*", *[F.concat(F.lit(n + " of "), F.col("doc_id").cast("string")).alias(n) for n in names])
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SF)
        assert out.columns == wide.columns, name
        rows = out.collect()
        assert rows and all(r[n] == f"{n} of {r.doc_id}" for r in rows for n in names), name
        assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in stage(spark, docs, SF).collect())


def test_repeated_tied_and_long_rows(spark):
    text = " ".join(f"some words of number {i} in a row." for i in range(40_000))
    rows = [(1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, text, None, None, None), (None, text, "en", "b", 2), (None, "short", "en", "b", 2), (None, "short", "en", "b", 2), (7, "", "en", "b", 0), (8, None, "en", "b", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {name: stage(spark, docs, SF).collect() for name, stage in corpus_pipeline.STAGES}
    assert len(got["line_dedup"]) == len(rows) and len(got["decontamination"]) == len(rows)
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in got["near_duplicates"]) == [(0, 5), (1, len(text)), (7, 0)]
    assert sum(r.length for r in got["packing"]) == sum({(r.doc_id, r.doc_tokens): r.doc_tokens * sum(x.doc_id == r.doc_id and x.doc_tokens == r.doc_tokens and x.start == 0 for x in got["packing"]) for r in got["packing"]}.values())

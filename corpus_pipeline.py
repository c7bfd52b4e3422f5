"""A pipeline over `documents`: quality, repeated lines, near-duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept, and returns a DataFrame
that is written as Parquet before the next one starts; all but the last return the columns of documents
as they were but for the text, whatever the columns are called: operators see columns named like their own
under other names.

Defined results, alike in every stage: an empty table gives an empty result; null ids, repeated ids and
repeated rows are rows of their own; columns other than id, text and n_chars, null or not, pass through.
What a stage does with null and empty and with very long texts, and with ties, its docstring says.

Tables that a stage writes on its way go to its scratch in the shared folder. `run` gives every stage a
scratch of its own and clears it, and the stage's input, once the stage's result is written; what the last
stage reads stays, since its result is computed by whoever asks for it. Runs share nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ballot.llm.common import Scratch, aside, spread, table
from ballot.llm.decontam import decontaminated
from ballot.llm.line_dedup import line_dedup
from ballot.llm.packing import pack
from ballot.llm.quality_pu import quality_scores
from ballot.llm.simhash import keep_first


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that the positive-unlabelled classifier accepts.

    A null text scores as an empty one; long texts are scored whole; equal texts get equal verdicts; without
    a positive label every score is 0.5 and all rows stay.
    """
    apart, restored = aside(docs, ["score", "predicted", "held_out"])
    return restored(quality_scores(apart, table(spark, sf_dir, "labels")).filter("predicted = 1"))


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents less repeated lines; n_chars follows the text.

    A null text becomes the empty text; long texts are taken whole, line by line; of the documents that hold
    a repeated line those of the largest id keep it, all of them if several have that id.
    """
    apart, restored = aside(docs, ["n_lines", "n_dropped"])
    out = line_dedup(apart, scratch=scratch)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return restored(out)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """One document of each class of near-duplicates.

    Null and empty texts are equal to each other; long texts are taken whole; the smallest id stays, of equal
    ids one row, and a row without id only where its class has no id.
    """
    return keep_first(docs, scratch=scratch)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Documents that hold no benchmark item.

    Null and empty texts hold none; long texts are searched whole; any one of equal items will do.
    """
    return decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str, scratch: Scratch | None = None) -> DataFrame:
    """Pieces of token sequences along the curve.

    A null or empty text is its closing id alone; long texts are cut into pieces; documents of equal keys
    stay in the order they were read in.
    """
    return pack(docs, scratch=scratch)


STAGES: list[tuple[str, Callable[..., DataFrame]]] = [
    ("quality", quality),
    ("line_dedup", lines),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark),
    ("packing", packing),
]

#: A trained classifier, fingerprints and tokens: SQL can't express these stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's result over documents."""
    docs = spread(table(spark, sf_dir, "documents"))
    before: Scratch | None = None
    for k, (_, stage) in enumerate(STAGES):
        own = Scratch(spark)
        docs = stage(spark, docs, sf_dir, own)
        if k < len(STAGES) - 1:
            after = Scratch(spark)
            docs = after.table(docs)
            own.clear()
            if before is not None:
                before.clear()
            before = after
    return docs

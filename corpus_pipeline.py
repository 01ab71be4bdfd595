"""A corpus pipeline of five stages: quality, line dedup, near-dedup, mixing and packing.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes
as Parquet below the shared folder and reads again as the next one's ``docs``. All but the last return the columns of
documents, with the values that came in: columns that happen to be named like something a stage makes are set aside
meanwhile. An empty table goes through all stages as an empty table; a text of any length is worked on whole; rows that
repeat are rows like others until near-dedup keeps one of them.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from netweave.llm.line_dedup import dedup_lines
from netweave.llm.minhash import drop_near_duplicates
from netweave.llm.mixing import expand_mix, mix_sources
from netweave.llm.packing import pack_documents
from netweave.llm.quality import fit_quality, score_quality
from netweave.plans.session import materialise, tables


def _apart(docs: DataFrame, made: tuple[str, ...], stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What ``stage`` makes of ``docs``, whose columns that are named like one it makes stand under other names meanwhile."""
    aside = {c: f"__aside_{i}" for i, c in enumerate(docs.columns) if c.lower() in made}
    apart = docs.withColumnsRenamed(aside)
    return stage(apart).select(*apart.columns).toDF(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier (operator 5) predicts to be of label 1; the others go.

    A null text is judged as an empty one, by what the model gives a text without features; rows of one text are judged
    alike. Null ids are judged like others. A score of exactly one half stays.
    """
    model = fit_quality(docs, tables(spark, sf_dir, "labels"))
    return _apart(docs, ("held_out", "score", "predicted"), lambda d: score_quality(d, model).where("predicted = 1"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks of lines that an earlier one has (operator 8).

    A document that lost all of its lines goes; one that had none, of null or empty text, stays as it is. ``n_chars``
    follows a text that was cut. Earlier is a smaller id, null last; ties are ordered by a hash of id and text, and of
    rows that are one and the same all but one go if they are as long as a block.
    """

    def cut(d: DataFrame) -> DataFrame:
        left = dedup_lines(d).where("n_removed = 0 or n_removed < n_lines")
        if "n_chars" in d.columns:
            left = left.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(d.schema["n_chars"].dataType))
        return left

    return _apart(docs, ("n_lines", "n_removed"), cut)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates (operator 1), one with the smallest id, null last.

    Texts without words, null or empty, are like nothing and all stay.
    """
    return drop_near_duplicates(docs).select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often, and the last of each source as far, as the mix takes them (operator 6).

    A null source is a source; texts without words, null or empty, hold nothing to take and go. ``n_chars`` follows a
    text that was cut behind its last word. Ties in id are ordered by size and text, so reruns agree.
    """
    return _apart(docs, ("size", "source_size", "target", "taken"), lambda d: expand_mix(mix_sources(d)))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 ids (operator 2), a row for each piece of a document; a null text is its end id alone."""
    return pack_documents(docs)


STAGES = [("quality", quality), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack)]

#: The classifier, the alignment and the signatures have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from ``documents`` on; the last stage's rows."""
    docs = tables(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

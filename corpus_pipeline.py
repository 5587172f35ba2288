"""The corpus pipeline: quality, near-duplicates, repeated passages, personal data, packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opalspan.llm import bm25_packing, mil_quality, pii_disclosure, shingle_sets, simhash, suffix_dedup
from opalspan.llm.common import written

#: Bytes of a passage that goes where it repeats: fewer than 50 words of ordinary text have.
PASSAGE = suffix_dedup.PASSAGE


def _recounted(docs: DataFrame, names: list[str]) -> DataFrame:
    """The columns of documents, n_chars counted again where it is one of them."""
    out = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in names else docs
    return out.select(*[F.col(f"`{c}`") for c in names])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the attention classifier predicts to be good; the model is fitted on labelled ones of docs.

    Every row is judged by its whole text: null and empty texts as one empty passage, repeated rows alike, a null doc_id
    like any other. Ties do not arise: a score at the cut stays. Labels with nulls are left out; without labels of both
    kinds every score is 0.5 and all rows stay. Columns stay as they are, whatever their names; no rows give no rows.
    """
    model = mil_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return mil_quality.score(docs, model).where("predicted = 1").select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more.

    The smallest doc_id of a group stays, equal rows once. Texts without words (null, empty) are one group; a text of
    fewer words than a shingle is one shingle. Rows with a null doc_id stay, as nothing can name them. Columns stay as
    they are, whatever their names; no rows give no rows. Candidates come from SimHash fingerprints by the pigeonring
    first, then from MinHash bands for what lies further apart; the sets decide (see the README).
    """
    return simhash.one_of_each(docs, shingle_sets.near_duplicates(docs))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the bytes of strings of PASSAGE bytes that start in two places.

    They go wherever they stand, judged on the input: in another document, elsewhere in the same one, and in repeated
    rows, which so lose all that is long enough. A null text becomes empty; a character that is cut through goes whole.
    Every row stays, with its columns, whatever their names, and n_chars counted again; no rows give no rows.
    """
    return _recounted(suffix_dedup.remove_repeats(docs, PASSAGE), docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data masked and the terms that reveal it generalised or removed.

    A null text becomes empty. Equal texts, repeated rows too, are treated alike and are one text of evidence; of spans
    that overlap the first stays. Every row stays, with its columns, whatever their names, and n_chars counted again; no
    rows give no rows.
    """
    return _recounted(pii_disclosure.sanitise(docs), docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in windows of ids.

    A null or empty text is its end id alone; repeated rows and null doc_ids are documents of their own; of equal scores
    the earlier in a task goes first; other columns are left out; no rows give no rows.
    """
    import public_tokenizers

    return bm25_packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("personal_data", personal_data),
    ("packing", packing),
]

#: Classifier, fingerprints, repeated strings, and tokenisers are not expressible in SQL; tests compare the stages
#: with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

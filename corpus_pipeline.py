"""A training-data pipeline over `documents`: five stages, each one operator.

Language ID drops what it rejects, near-dedup keeps one document of each class,
substring dedup cuts repeated passages, decontamination drops documents that
overlap a benchmark, and BPE turns what is left into token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegate.llm import bpe, decontamination, language_id, near_dedup, substring_dedup
from tidegate.llm.common import stage, table, unstage
from tidegate.llm.queries import vocabulary_path


def _apart(docs: DataFrame, names: tuple[str, ...]) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with columns that have an operator's names renamed, and how they get their names back."""
    taken = {c: f"own_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(taken), {v: k for k, v in taken.items()}


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is accepted; the models learn from the labels of two thirds of them."""
    trained = language_id.train(docs, ~language_id.held_out())
    apart, back = _apart(docs, ("lang_pred", "score", "accepted"))
    return language_id.identify(apart, trained).where("accepted").select(*apart.columns).withColumnsRenamed(back)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of least doc_id of each class; rows with a null doc_id stay."""
    classes = near_dedup.near_duplicate_classes(docs)
    gone = classes.where("doc_id <> class_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated passages; one that had nothing else goes, one that lost none stays as it was."""
    docs, back = _apart(docs, ("n_words", "n_removed", "kept_text", "repeats"))
    carry = tuple(docs.columns)
    cut = substring_dedup.remove_repeats(docs, carry=carry)
    lost = F.col("n_removed") > 0
    changed = {"text": F.when(lost, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in carry:
        changed["n_chars"] = F.when(lost, F.length("kept_text").cast(dict(docs.dtypes)["n_chars"])).otherwise(F.col("n_chars"))
    return cut.where((F.col("n_removed") < F.col("n_words")) | (F.col("n_words") == 0)).withColumns(changed).select(*docs.columns).withColumnsRenamed(back)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap no benchmark item."""
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document."""
    coded = bpe.encode_texts(docs, vocabulary_path(), carry=("doc_id", "lang", "source", "n_chars"), decode=False)
    return coded.select("doc_id", "lang", "source", "n_chars", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language_id", language),
    ("near_dedup", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", decontaminated),
    ("bpe", tokens),
]

#: Most stages cannot be put in SQL; the tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, function) in enumerate(STAGES[:-1]):
        done = stage(function(spark, docs, sf_dir), name)
        if i:
            unstage(docs)  # nothing reads it any more
        docs = done
    return STAGES[-1][1](spark, docs, sf_dir)

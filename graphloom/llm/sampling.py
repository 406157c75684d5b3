"""Bounded, deterministic samples of labelled documents for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import text_of


def bounded(rows: DataFrame, id_col: str, bound: int, seed: int) -> DataFrame:
    """The `bound` rows whose ids have the smallest hashes; fewer if there are fewer."""
    return rows.orderBy(F.xxhash64(F.lit(seed), F.col(id_col)), F.col(id_col)).limit(bound)


def labelled(labels: DataFrame, id_col: str, label_col: str, training: Column, bound: int, seed: int) -> DataFrame:
    """(id_col, label int) of at most `bound` ids in the training folds.

    Rows with a null id or label are left out; of several labels of one id the smallest counts.
    """
    rows = labels.where(training & F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
    return bounded(rows.groupBy(id_col).agg(F.min(F.col(label_col).cast("int")).alias("label")), id_col, bound, seed)


def texts_of(docs: DataFrame, chosen: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """chosen, which is bounded and so broadcast, with the column text: one row for each of its rows that docs has.

    Of several texts of one id the one with the smallest hash counts; a null text is an empty one.
    """
    found = docs.select(F.col(f"`{id_col}`").alias(id_col), text_of(f"`{text_col}`").alias("text")).join(F.broadcast(chosen), id_col)
    return found.groupBy(*chosen.columns).agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))

"""Labelled rows for the classifiers: all, or a bounded sample."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.llm.textkit import small_batches, training_row

#: Labelled rows per class that a sample holds: those whose ids have the smallest hashes, so that the choice does not
#: depend on partitions. All labelled rows count where a class has no more.
PER_CLASS = 6_000
MODULUS, HELD = 5, 0


def known(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> DataFrame:
    """(id, label) of all rows with label 0 or 1 and an id that is not held out."""
    return labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label")).filter(F.col("label").isin(0, 1) & F.col("id").isNotNull() & training_row(F.col("id"), MODULUS, HELD))


def sample(docs: DataFrame, labels: DataFrame, label_col: str, per_class: int = PER_CLASS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text, label) of at most ``per_class`` rows with label 1 and as many with label 0, without the rows held out.

    The chosen labels are bounded by the parameter, so they are broadcast to the documents. Null ids, labels and texts are no
    examples; a repeated row is an example each time.
    """
    small_batches(docs.sparkSession)
    examples = known(labels, label_col, id_col)
    parts = [examples.filter(F.col("label") == y).orderBy(F.xxhash64("id"), "id").limit(per_class) for y in (0, 1)]
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    return texts.join(F.broadcast(parts[0].union(parts[1])), "id")


def share(labels: DataFrame, label_col: str, id_col: str = "doc_id") -> float:
    """The share of label 1 among all labelled rows that are not held out; 0.5 where there are none."""
    known = labels.filter(F.col(label_col).isin(0, 1) & training_row(F.col(id_col), MODULUS, HELD))
    found = known.agg(F.avg(F.col(label_col).cast("double"))).head()[0]
    return 0.5 if found is None else found

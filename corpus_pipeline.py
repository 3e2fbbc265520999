"""A corpus pipeline over ``documents``: every stage works on all that the stage before has kept, and its decisions take effect.

All stages but the last return the columns of ``documents`` (doc_id, text, lang, source, n_chars); the last one returns
doc_id, lang, source, n_tokens and the token ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm import bpe, chosen_path, decontaminate, language_id, suffix_dedup
from plumbline.llm.queries import table, tokenizer_path
from plumbline.llm.textkit import shared_folder

#: Benchmark items with a window in a document from which the document counts as contaminated.
ITEMS = 1
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a confident language, or whose text is no text, go. Of rows with equal ids all go if one goes."""
    judged = language_id.identify(docs, declared=F.col("lang"), host=F.col("source"))
    return docs.join(judged.filter("NOT accepted AND doc_id IS NOT NULL").select("doc_id").distinct(), "doc_id", "left_anti").select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document with the smallest id stays (once, if its row is repeated); rows with a null id stay."""
    classes = chosen_path.join(docs)
    kept = classes.filter("doc_id = class_id").select("doc_id").distinct()
    known = docs.filter("doc_id IS NOT NULL").join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return known.select(COLUMNS).union(docs.filter("doc_id IS NULL").select(COLUMNS))


def repeated_strings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Bytes of strings that a smaller document has are cut out; a character that is cut through goes as a whole. Texts of which nothing is left go."""
    cut = suffix_dedup.dedup(docs.withColumn("had_text", F.col("text").isNotNull()), texts=True, keep=("lang", "source", "n_chars", "had_text"))
    text = F.when(F.col("had_text"), F.col("kept_text"))
    length = F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("n_chars"))
    return cut.filter("n_removed = 0 OR kept_text <> ''").select("doc_id", text.alias("text"), "lang", "source", length.alias("n_chars"))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a window of any benchmark item (``WINDOW`` words in a row, or a whole shorter item) go."""
    found = decontaminate.find(docs, table(spark, sf_dir, "benchmark"))
    return docs.join(found.filter((F.size("items") >= ITEMS) & F.col("doc_id").isNotNull()).select("doc_id").distinct(), "doc_id", "left_anti").select(COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of each text."""
    path = tokenizer_path(spark)
    return bpe.encode(docs, path, keep=("lang", "source")).select("doc_id", "lang", "source", F.size("ids").cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeated_strings", repeated_strings),
    ("benchmark_free", benchmark_free),
    ("tokens", tokens),
]

#: The stages can't be expressed in SQL; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(path := shared_folder(spark, f"pipeline-{name}"))
        docs = spark.read.parquet(path)
    return docs


"""A corpus from raw documents to pieces: quality, near copies, repeated passages, benchmark passages, encoding.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's documents. All but the last keep the columns of ``documents``; others, whatever their names, are dropped at once.

Null ids are ids like others. Null texts, empty ones and those without words are kept by every stage (the classifier scores
them as it does short texts) and become no pieces. Rows that are equal in id and text are one document from the second
stage on; rows with equal ids and different texts stay apart. Of near copies the least id stays, of equal ids the least text
hash. A text of any length is taken whole. An empty table passes every stage empty.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyforge.llm import decontaminate, jaccard_join, quality, sentencepiece_codec, substring_dedup
from tallyforge.llm.queries import table, tokenizer
from tallyforge.llm.store import Scratch

WORD = r"[^\x20\x09-\x0D]"
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that the classifier takes to be of label 0."""
    return quality.accepted(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of linked documents, that of the least id; a document without words stays."""
    return jaccard_join.deduplicated(docs.select(*COLUMNS))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand at more than one place out of the texts, at all places, as op6 does; a document of nothing else goes.

    Near copies are gone by now, so what repeats stands in unlike documents. (``keep_first`` of the operator would leave one place.)
    """
    had = F.coalesce(F.col("text").rlike(WORD), F.lit(False))
    cut = substring_dedup.dedup(docs.select(*COLUMNS, had.alias("__had"))).where(~F.col("__had") | F.col("text").rlike(WORD))
    return cut.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold an item of the benchmark of at least five words: shorter ones are common turns of phrase."""
    return decontaminate.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), free_ends=True, min_words=5)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the piece ids and their number, and whether they decode to the text."""
    model = tokenizer("piece_bpe_32k.model")
    encoded = sentencepiece_codec.decode(sentencepiece_codec.encode(docs.select(*COLUMNS), model), model)
    same = F.col("decoded") == F.replace(F.coalesce("text", F.lit("")), F.lit(sentencepiece_codec.MARK), F.lit(" "))
    return encoded.select("doc_id", "lang", "source", "piece_ids", F.size("piece_ids").cast("bigint").alias("n_pieces"), same.alias("same"))


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("quality_classifier", quality_classifier),
    ("ngram_jaccard_join", near_copies),
    ("substring_dedup", repeated_passages),
    ("benchmark_decontamination", benchmark_passages),
    ("sentencepiece", encoding),
]

#: The classifier's score has no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs

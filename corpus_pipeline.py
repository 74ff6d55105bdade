"""The corpus pipeline: documents to packed training sequences, in five stages.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's
docs. The first four return the columns of documents, with the identified language as lang; the last returns the packed
pieces, whose sequences hold one language each.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellgrid.llm import decontaminate, language_id, minhash_dedup, packing, substring_dedup
from cellgrid.llm.common import pick, remove, shared_folder, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rows(docs: DataFrame) -> DataFrame:
    """The columns of documents, whatever others there are."""
    rows = pick(docs, *COLUMNS)
    return rows.withColumns({"doc_id": F.col("doc_id").cast("long"), "n_chars": F.col("n_chars").cast("long")})


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sets `lang` to the language that the text is in, by which the last stage packs; a label only teaches, and decides
    where a text is ambiguous. Drops the documents that have no language: no text, none with a letter, or, unlabelled, one
    that is further from every language than the labelled rows, which it learns from."""
    docs = _rows(docs)
    model = language_id.fit(docs.select(F.col("doc_id").alias("id"), "text", "lang"), bounded=True)
    return language_id.keep_identified(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of every group of near copies (five-word shingles, similarity 0.8)."""
    return minhash_dedup.keep_one(_rows(docs), words=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts stretches of 13 words or more that an earlier document has; texts without one stay as they are."""
    return substring_dedup.cut_repeats(_rows(docs))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    items = pick(table(spark, sf_dir, "benchmark"), "item_id", "text").withColumnRenamed("item_id", "item")
    return decontaminate.keep_clean(_rows(docs), items)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all that is left into sequences of at most 2048 tokens, each of one identified language, so that a training
    run can weigh languages and no text follows one in another language; a row for each piece."""
    texts = pick(_rows(docs), "doc_id", "text", "lang").withColumnRenamed("doc_id", "id")
    return packing.pack(texts, public_tokenizers.path("word_bpe_49k.json"), 2048, 0, by="lang").withColumnRenamed("id", "doc_id")


STAGES = [
    ("language ID", identify_language),
    ("near-duplicates", drop_near_duplicates),
    ("substring dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL can express neither the classifier nor the tokenizer; the tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again; only the last one's files stay."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            remove(spark, f"{folder}/{k - 1}")
    return docs

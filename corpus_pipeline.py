"""Corpus pipeline: language, near duplicates, benchmark passages, personal data, packing.

Each stage takes (spark, docs, sf_dir), works on all rows of docs and returns a DataFrame; all but the
last return the columns of documents. Docs may be empty and may have further columns of any name, which
all stages but the last pass on. Repeated rows are judged each by itself, except where near duplicates
are one class. Of long texts the whole counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trafficwarden.llm import decontaminate, language, neardup, packing, pii
from trafficwarden.llm.common import materialise, spare


def by_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't rejected; lang becomes the predicted one.

    A null or empty text, or one without a letter, is rejected. A null lang teaches nothing.
    """
    name = spare(docs, "_language")
    found = language.identify(docs, language.fit(docs), found=name).filter(~F.col(f"{name}.rejected"))
    return found.withColumn("lang", F.col(f"{name}.lang")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates: that of the smallest doc_id (null ids first), ties to the first row.

    Texts without words (null is empty) are a class where the texts are equal.
    """
    class_id, keep = spare(docs, "_class_id"), spare(docs, "_keep")
    return neardup.near_duplicates(docs, class_id=class_id, keep=keep).filter(keep).select(*docs.columns)


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; those of a null or empty text stay."""
    name = spare(docs, "_found")
    found = decontaminate.find_benchmark(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), found=name)
    return found.filter(F.size(f"{name}.hits") == 0).select(*docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind in brackets; n_chars follows a changed text. A null text stays null."""
    name = spare(docs, "_private")
    found = pii.find_private(docs, pii.fit(docs), found=name)
    changed = F.size(f"{name}.spans") > 0
    length = F.length(f"{name}.redacted").cast(docs.schema["n_chars"].dataType)
    found = found.withColumn("n_chars", F.when(changed, length).otherwise(F.col("n_chars")))
    return found.withColumn("text", F.col(f"{name}.redacted")).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 1024 ids; a null or empty text is its end id alone."""
    return packing.crc32(packing.pack(docs))


STAGES = [
    ("language", by_language),
    ("near_duplicates", near_duplicates),
    ("decontamination", benchmark_free),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: Not expressible in SQL; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialise(docs, name)
    return docs

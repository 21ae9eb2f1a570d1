"""Training-corpus pipeline over the documents table.

Five stages, each a function of (spark, docs, sf_dir) that returns a
DataFrame.  A stage is written as Parquet and read again before the next; all
but the last return the columns of documents.

Null and empty texts have no words, so the first stage drops them; alone, the
second would keep one of them and the others all.  Rows with a null id are nobody's copy and stay.  Rows that
share an id go or stay together in the second stage.  Other columns pass
through unchanged; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafweave.llm import decontaminate, packing, pii, quality_rules, similar, tokens, workdir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail a rule or are distributed unlike their language."""
    return quality_rules.passing(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of five-word Jaccard similarity 0.8 or more: that with the smallest id."""
    return similar.representatives(docs)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, or one nearly like it."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; n_chars follows the text."""
    out = pii.redact(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all token sequences into sequences of 2,048."""
    return packing.pack(workdir.cut(packing.pieces(docs, tokens.default_vocabulary())))


STAGES = [("quality_rules", quality), ("near_duplicates", near_duplicates), ("decontamination", benchmark), ("personal_data", personal_data), ("packing", pack)]

#: Fingerprints, edit distances and subword ids aren't expressible in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, one after the other."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = workdir.new_folder(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs

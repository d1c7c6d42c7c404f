"""Cleaning a corpus of documents in five stages, each written and read again as the next one's documents.

1. quality: documents that the classifier rejects go.
2. lines: near-repeated lines go; only a verified copy of one earlier document (0.8 as in stage 3) is left whole, and stage 3
   drops it. What stage 3 would drop now has no first lines of others', so no line goes with a document that is dropped.
3. near duplicates: of each component of documents whose 5-word shingle sets are 0.8 similar, the least doc_id stays.
4. secrets: live-looking credentials are masked.
5. packing: the documents are tokenised and packed into sequences; the last stage returns the pieces.

All but the last return the columns of documents, any others included, whatever their names. Null texts count as empty; they
and empty ones pass stages 2 to 4 as they are. Texts of any length are read whole. Rows that are equal in doc_id and text are
one document: they stay or go together. A null doc_id is linked with nothing, so such rows pass stage 3. Ties go to the least
doc_id. An empty table gives an empty one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from statrill.llm import line_dedup, ngram_join, packing, quality, secrets
from statrill.llm.common import kept_until_exit, passing, ready, shared_folder, table

WORDS, PERCENT = 5, 80
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a classifier of the labels' trusted positives scores at its threshold or above; empty texts are scored
    like any, and repeated rows alike."""
    return quality.accepted(docs, table(spark, sf_dir, "labels"))


def fresh_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that are near one of an earlier document, or above in their own; a document of which every line
    goes has an empty text, null texts stay null."""
    ready(spark)
    return line_dedup.deduplicated(docs, whole=PERCENT / 100, words=WORDS)


def no_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each component of similar documents; texts without words and null doc_ids are linked with nothing.
    All rows of a doc_id that goes, go."""
    ready(spark)
    keep = ngram_join.jaccard_components(docs, WORDS, PERCENT).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(keep, "doc_id", "left_anti").select(*docs.columns)


def no_live_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with what looks like a live credential masked; no row goes."""
    ready(spark)
    return secrets.redacted(docs)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, with their ids and where they stand; null and empty texts are their end mark alone."""
    import public_tokenizers

    ready(spark)
    return packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), keep_ids=True)


STAGES = [("quality", good_quality), ("lines", fresh_lines), ("near duplicates", no_near_duplicates), ("secrets", no_live_secrets), ("packing", packed_sequences)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, from the documents of a folder of tables; every stage's rows are written to the shared folder, and what
    it wrote on the way goes when they are."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for i, (_, stage) in enumerate(STAGES):
        with passing(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(kept_until_exit(spark, f"{folder}/{i}"))
    return docs

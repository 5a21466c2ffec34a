"""Prepares a corpus of documents: a chain of stages, each written as Parquet and read again as the next one's documents.

1. quality: documents that the quality classifier rejects (a score under 0.7) go.
2. language: documents whose language can't be told (no letters, or a posterior under 0.5) go.
3. near_duplicates: of each group of near copies (a similarity of 0.8 of their five-word shingles) the document with the least id stays.
   Candidates are the groups of op3's fingerprints, and sets that share min-hashes; the similarity of each is checked.
4. decontamination: documents with a passage of a benchmark item go.
5. packing: what is left is tokenised and packed into sequences of 4096 tokens: a row for each piece, with its ids.

All stages but the last return the columns of the documents as they are, whatever their names. Null texts count as empty. Rows with a null
doc_id are never near copies of others. An empty table passes every stage.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperclause.llm import decontam, langid, near_copies, packing, quality
from hyperclause.llm._common import column, fixed, remainder, shared_folder, table, unused


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality.train(docs, table(spark, sf_dir, "labels"), "quality", folds=4, held=2)
    (score,) = unused(docs.columns, "score")
    return _kept(docs, quality.score(docs, model, docs.columns, name=score), column(score) >= 0.7)


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.train(docs, remainder(F.col("doc_id"), 4) != 2)
    found, score = unused(docs.columns, "lang_pred", "score")
    return _kept(docs, langid.predict(docs, model, docs.columns, to=(found, score)), (column(found) != langid.UNDETERMINED) & (column(score) >= 0.5))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays: of the rows with the least id one of the least set of shingles. Where an id has one row, the id
    says which row that is; where it has several, its set does too."""
    found = near_copies.near_copies(docs, rows=True)
    own = found.where("doc_id = component_id").groupBy("root", "doc_id", "set").agg(F.count(F.lit(1)).alias("alike"))
    first = own.groupBy("root").agg(F.min(F.struct("doc_id", "set", "alike")).alias("one")).select("one.*")
    stays = fixed(first.join(found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows")), "doc_id"))
    left = docs.join(stays.where("rows = 1").select("doc_id"), "doc_id", "left_semi").unionByName(docs.where("doc_id is null"))
    several = stays.where("rows > 1")
    if not several.isEmpty():
        key, set_, alike = unused(docs.columns, "key", "set", "alike")
        marked = near_copies.with_set(docs.join(several.select("doc_id"), "doc_id", "left_semi"), set_)
        kept = several.select(F.col("doc_id").alias(key), F.col("set").alias(set_), F.col("alike").alias(alike))
        rows = marked.join(kept, (marked["doc_id"] == kept[key]) & (marked[set_] == kept[set_])).select(*[marked[f"`{c.replace('`', '``')}`"] for c in marked.columns], kept[alike])
        left = left.unionByName(rows.where(column(alike) == 1).unionByName(rows.where(column(alike) > 1).dropDuplicates(["doc_id", set_])).drop(set_, alike))
    return left.select(*map(column, docs.columns))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontam.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2, capacity=4096)


def _kept(docs: DataFrame, scored: DataFrame, condition) -> DataFrame:
    return scored.where(condition).select(*map(column, docs.columns))


STAGES = [
    ("quality", quality_stage),
    ("language", language_stage),
    ("near_duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: No SQL expresses these stages; tests hold them against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written to the shared folder and read again. What a stage has written goes as
    soon as the next one is written, so that the last one's rows alone stay there."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
        if k:
            before = path(f"{folder}/{k - 1}-{STAGES[k - 1][0]}")
            before.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(before, True)
    return docs

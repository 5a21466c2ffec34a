"""Job: labelled example sets for training a classifier, without leaks between them.

    python -m jobs.labelled_sets --documents /data/documents.parquet --labels /data/labels.parquet --output /data/sets

Documents that have a label of the task are cut into train, valid and test sets. Texts that are alike but for case (A-Z) and white
space form a group, and a group lies in one set as a whole, as molecules of one scaffold do. A group whose rows disagree in their
label is set apart (`conflict`). Training rows carry a weight, one over the number of training rows of their label.

Output, replaced as a whole by each run, so that a run that broke off is mended by the next:
* examples/split=S/y=Y: doc_id, text, lang, source, copies (rows of the group), first (whether the row has the group's least id), weight.
* report: split, y, rows, groups, weight.

Labels other than 0 and 1, and rows without an id, are passed over; of several labels of a document the largest counts. Documents
without a text (null, or nothing but white space) are not examples. Repeated rows of a document are examples each. Only labelled
documents are shuffled; a group of many copies is counted before it is, and split when it is joined."""

from __future__ import annotations

import logging

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperclause.operators import metrics

log = logging.getLogger("labelled_sets")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def labelled(documents: DataFrame, labels: DataFrame, task: str) -> DataFrame:
    """doc_id, text, lang, source, y and grp of the documents that have a label and a text."""
    value = F.col(f"`{task}`").cast("string").try_cast("double").try_cast("int")
    y = labels.select("doc_id", value.alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("y").alias("y"))
    plain = F.trim(F.regexp_replace(F.translate("text", UPPER, LOWER), "[\\x20\\x09-\\x0D]+", " "))
    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), *[F.col(c).cast("string").alias(c) for c in ("text", "lang", "source")])
    return rows.where(plain != "").join(y, "doc_id").withColumn("grp", F.sha2(plain, 256))


def grouped(examples: DataFrame) -> DataFrame:
    """grp, copies, least (id) and label (null if the rows disagree) of every group."""
    groups = examples.groupBy("grp").agg(F.count(F.lit(1)).alias("copies"), F.min("y").alias("low"), F.max("y").alias("high"), F.min("doc_id").alias("least"))
    return groups.select("grp", "copies", "least", F.when(F.col("low") == F.col("high"), F.col("low")).alias("label"))


def placed(groups: DataFrame, seed: int, train: float, valid: float) -> DataFrame:
    """The groups with split and weight."""
    agreed = groups.where("label is not null")
    split = agreed.join(metrics.group_split(agreed, "grp", seed, train, valid, rows="copies"), "grp")
    weighed = metrics.inverse_frequency(split.where("split = 'train'"), "label", rows="copies")
    others = split.where("split <> 'train'").unionByName(groups.where("label is null").withColumn("split", F.lit("conflict")))
    return weighed.unionByName(others.withColumn("weight", F.lit(None).cast("double")))


def run(spark: SparkSession, documents: str, labels: str, output: str, task: str = "quality", train: float = 0.8, valid: float = 0.1, seed: int = 42) -> dict[str, int]:
    """Runs the job; how many rows of what were read and written."""
    docs, known = spark.read.parquet(documents), spark.read.parquet(labels)
    counts = {"documents": docs.count(), "labels": known.count()}
    log.info("read %d documents of %s and %d labels of %s", counts["documents"], documents, counts["labels"], labels)
    examples = labelled(docs, known, task)
    groups = grouped(examples).persist()  # read for the sizes, the places and the weights
    rows = examples.join(placed(groups, seed, train, valid).drop("label"), "grp").withColumn("first", F.col("doc_id") == F.col("least"))
    rows.select("doc_id", "text", "lang", "source", "copies", "first", "weight", "split", "y").write.mode("overwrite").partitionBy("split", "y").parquet(f"{output}/examples")
    groups.unpersist()
    written = read(spark, output)
    report = written.groupBy("split", "y").agg(F.count(F.lit(1)).alias("rows"), F.count_if("first").alias("groups"), F.max("weight").alias("weight"))
    report.coalesce(1).write.mode("overwrite").parquet(f"{output}/report")
    for r in spark.read.parquet(f"{output}/report").orderBy("split", "y").collect():  # a row for each set and label
        log.info("wrote %d rows of %d groups with label %d to the set %s", r["rows"], r["groups"], r["y"], r["split"])
        counts[f"{r['split']}/{r['y']}"] = r["rows"]
    return counts


def read(spark: SparkSession, output: str) -> DataFrame:
    """What a run has written; a table without rows if there were no examples."""
    return spark.read.schema("doc_id long, text string, lang string, source string, copies long, first boolean, weight double, split string, y int").parquet(f"{output}/examples")


if __name__ == "__main__":
    from jobs._command import main

    main(run, __file__, __doc__)

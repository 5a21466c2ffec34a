"""Job: screens documents for alerts as they come, and reports how alerts go with sources and labels.

    python -m jobs.alert_screen --documents /data/documents.parquet --labels /data/labels.parquet --output /data/screen

A file stream takes the files of `documents` that no run has taken before, all there are, a bounded number at a time. Each batch is
written to a place of its own (batch=N), which a batch that is run again replaces, so each document is screened and counted once
however often a run breaks off. Then the reports are made anew from all hits and the labels as they are now. A run over nothing
new leaves everything as it was.

Output:
* hits/batch=N/tier=T: doc_id, source, lang, alert. A row for every alert that is found in a document's text.
* seen/batch=N: source, documents. How many documents were screened.
* report/kind=source: alert, tier, part (the source), documents with the alert, total (documents screened), share.
* report/kind=label: the same, where part is a label as name=value and total is the number of documents with the alert.
* checkpoint: what the stream has taken.

* rules: the rules that the hits are of; a run with others is an error, as they want another folder.

A rule is a name, a tier and a pattern: a regular expression for texts, or, with "structure": true, a substructure for texts that are
molecules (SMILES; other texts hold none). Documents with a null text have no hits. A document that comes again in another file counts once in `documents` of the reports, and again in `seen`. A null source is the
part `null`."""

from __future__ import annotations

import json
import logging

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperclause.operators import chemistry, explain, patterns

log = logging.getLogger("alert_screen")
HITS = "doc_id long, source string, lang string, alert string, batch long, tier string"
SEEN = "source string, documents long, batch long"
REPORT = "alert string, tier string, part string, documents long, total long, share double, kind string"
LABELS = ["quality", "toxic"]


def checked(rules: list[dict]) -> dict[str, dict]:
    """The rules by name; names must differ, and patterns must not be empty."""
    named = {r["name"]: r for r in rules}
    if not named or len(named) < len(rules) or not all(r["pattern"] and r["tier"] for r in rules):
        raise ValueError("no rules, rules of one name, or without a pattern or a tier")
    for r in rules:
        if r.get("structure"):
            patterns.condition(r["pattern"])  # a ValueError for what is no pattern
    return named


def same_rules(spark: SparkSession, output: str, rules: dict[str, dict]) -> None:
    """Keeps the rules beside the hits; ValueError if those there are others."""
    text = json.dumps(rules, sort_keys=True)
    try:
        there = [r[0] for r in spark.read.text(f"{output}/rules").collect()]  # one line
    except AnalysisException:  # no such folder yet
        there = []
    if there and there != [text]:
        raise ValueError(f"{output} has hits of other rules")
    if not there:
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{output}/rules")


def screened(documents: DataFrame, rules: dict[str, dict]) -> DataFrame:
    """doc_id, source, lang, alert and tier of every alert found."""
    kept, found = ["source", "lang"], []
    texts, structures = ({n: r["pattern"] for n, r in rules.items() if bool(r.get("structure")) == kind} for kind in (False, True))
    if texts:
        found.append(explain.alerts_in(documents, "doc_id", "text", texts, keep=kept))
    if structures:
        found.append(patterns.alerts(chemistry.molecules(documents, "doc_id", "text", keep=kept), structures, keep=kept))
    found = found[0] if len(found) == 1 else found[0].unionByName(found[1])
    tiers = F.create_map(*[F.lit(x) for n, r in rules.items() for x in (n, r["tier"])])
    return found.select(F.col("item").cast("long").alias("doc_id"), "source", "lang", "alert", tiers[F.col("alert")].alias("tier"))


def reports(hits: DataFrame, seen: DataFrame, labels: DataFrame) -> DataFrame:
    """alert, tier, part, documents, total, share and kind."""
    once = hits.where("doc_id is not null").dropDuplicates(["doc_id", "alert", "source"])
    total = seen.groupBy("source").agg(F.sum("documents").alias("total"))
    sources = once.groupBy("alert", "tier", "source").agg(F.count(F.lit(1)).alias("documents"))
    sources = sources.join(total, sources["source"].eqNullSafe(total["source"])).select("alert", "tier", F.coalesce(sources["source"], F.lit("null")).alias("part"), "documents", "total", F.lit("source").alias("kind"))
    known = labels.where("doc_id is not null").select(F.col("doc_id").alias("item"), F.explode(F.array(*[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in LABELS])).alias("clause")).where("clause is not null").distinct()
    items = once.select(F.col("doc_id").alias("item"), "alert").distinct()
    tiers = hits.groupBy("alert").agg(F.first("tier").alias("tier"))  # a row for each rule
    together = explain.alert_coverage(items, known, share=0.0, first=None).join(F.broadcast(tiers), "alert")
    both = sources.unionByName(together.select("alert", "tier", F.col("clause").alias("part"), F.col("together").alias("documents"), F.col("support").alias("total"), F.lit("label").alias("kind")))
    return both.select("alert", "tier", "part", "documents", "total", F.round(F.col("documents") / F.col("total"), 9).alias("share"), "kind")


def run(spark: SparkSession, documents: str, labels: str, output: str, rules: list[dict], files_per_batch: int = 1000) -> dict[str, int]:
    """Takes what is new, and makes the reports anew; how many documents and hits this run has added, and rows of the reports."""
    named, counts = checked(rules), {"documents": 0, "hits": 0}
    same_rules(spark, output, named)
    schema = spark.read.parquet(documents).schema

    def take(batch: DataFrame, n: int) -> None:
        screened(batch, named).write.mode("overwrite").partitionBy("tier").parquet(f"{output}/hits/batch={n}")
        batch.groupBy("source").agg(F.count(F.lit(1)).alias("documents")).coalesce(1).write.mode("overwrite").parquet(f"{output}/seen/batch={n}")
        added = stored(batch.sparkSession, output, "seen", SEEN).where(F.col("batch") == n).agg(F.sum("documents")).first()[0] or 0
        hits = stored(batch.sparkSession, output, "hits", HITS).where(F.col("batch") == n).count()
        log.info("batch %d: read %d documents of %s, wrote %d hits", n, added, documents, hits)
        counts["documents"], counts["hits"] = counts["documents"] + added, counts["hits"] + hits

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(one(documents))
    query = stream.select("doc_id", "text", "source", "lang").writeStream.foreachBatch(take).option("checkpointLocation", f"{output}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    made = reports(stored(spark, output, "hits", HITS), stored(spark, output, "seen", SEEN), spark.read.parquet(labels))
    made.coalesce(1).write.mode("overwrite").partitionBy("kind").parquet(f"{output}/report")
    counts["report"] = stored(spark, output, "report", REPORT).count()
    log.info("wrote %d documents' %d hits and %d rows of reports to %s", counts["documents"], counts["hits"], counts["report"], output)
    return counts


def one(path: str) -> str:
    """The path as a pattern that only it matches: a stream then takes a single file as well as a folder."""
    path = path.rstrip("/")
    return f"{path[:-1]}[{path[-1]}]"


def stored(spark: SparkSession, output: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("basePath", f"{output}/{name}").parquet(f"{output}/{name}")


def read(spark: SparkSession, output: str) -> DataFrame:
    """The whole output: hits (kind hit, part the source, doc_id) and reports (no doc_id)."""
    hits = stored(spark, output, "hits", HITS).select("doc_id", "alert", "tier", F.col("source").alias("part"), F.lit("hit").alias("kind"))
    return hits.unionByName(stored(spark, output, "report", REPORT), allowMissingColumns=True)


if __name__ == "__main__":
    from jobs._command import main

    main(run, __file__, __doc__)

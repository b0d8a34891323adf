"""What became of an applied batch: its queue, decisions and results brought together by id; and an index of reports by batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The three documents of a batch's folder, and the names in them.
DOCUMENTS = ("apply-summary.json", "cleanup-queue.json", "decisions.json")
OUTCOMES = {"applied_ids": "applied", "manual": "manual", "noop": "noop", "failures": "failed"}
VERDICTS = ("approve", "reject", "defer")


def read_archive(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """entries (batch, generated_at, id, vault, target, signal, verb), decisions (batch, id, decision) and outcomes (batch, id,
    outcome) of all batch folders below root. A document that is missing or isn't JSON has no rows."""
    read = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.json").text(root, wholetext=True)
    parts = F.split(F.col("_metadata.file_path"), "/")
    files = read.select(F.element_at(parts, -2).alias("folder"), F.element_at(parts, -1).alias("name"), F.try_parse_json("value").alias("v"))
    of = lambda name: files.where((F.col("name") == name) & F.col("v").isNotNull())
    entry = "array<struct<id: string, vault: string, target_file: string, signal: string, proposed_action: string, diff: struct<verb: string>>>"
    queue = of(DOCUMENTS[1]).select(F.coalesce(F.try_variant_get("v", "$.batch_id", "string"), "folder").alias("batch"), "folder", F.try_variant_get("v", "$.generated_at", "string").alias("generated_at"), F.explode(F.try_variant_get("v", "$.entries", entry)).alias("e"))
    batches = of(DOCUMENTS[1]).select("folder", F.coalesce(F.try_variant_get("v", "$.batch_id", "string"), "folder").alias("batch"))
    named = lambda df: df.join(batches, "folder", "left").withColumn("batch", F.coalesce("batch", "folder")).drop("folder")
    entries = queue.select("batch", "generated_at", "e.id", "e.vault", F.concat_ws("/", "e.vault", "e.target_file").alias("target"), F.coalesce("e.signal", F.lit("unknown")).alias("signal"), F.coalesce("e.diff.verb", "e.proposed_action", F.lit("change")).alias("verb"))
    told = of(DOCUMENTS[2]).select("folder", F.explode(F.try_variant_get("v", "$", "map<string, string>")).alias("id", "decision"))
    ids = "array<string>"
    # Ids, or objects with one, whose text is JSON.
    listed = lambda n: F.coalesce(F.transform(F.try_variant_get("v", f"$.{n}", ids), lambda x: F.coalesce(F.get_json_object(x, "$.id"), x)), F.array().cast(ids))
    told_as = lambda ids_, outcome: F.transform(ids_, lambda i: F.struct(i.alias("id"), F.lit(outcome).alias("outcome")))
    each = F.concat(*(told_as(listed(n), outcome) for n, outcome in OUTCOMES.items()))
    results = of(DOCUMENTS[0]).select("folder", F.explode(each).alias("o")).select("folder", "o.id", "o.outcome")
    return entries, named(told).select("batch", "id", "decision"), named(results).select("batch", "id", "outcome")


def outcomes_of(entries: DataFrame, decisions: DataFrame, results: DataFrame) -> DataFrame:
    """batch, id, signal, decision, outcome, fault: a row for each id that any of the three knows.

    An id that is decided or carried out several times has the least of its values here, and that as its fault. Faults, the
    first that holds: not queued, decided twice, carried out twice, unknown decision, applied without approval, approved without
    outcome. What isn't decided is `undecided`, what has no outcome `none`.
    """
    key = ["batch", "id"]
    once = lambda df, c: df.groupBy(*key).agg(F.min(c).alias(c), F.count("*").alias(f"{c}_n"))
    queued = entries.groupBy(*key).agg(F.min("signal").alias("signal"), F.lit(True).alias("queued"))
    met = queued.join(once(decisions, "decision"), key, "full_outer").join(once(results, "outcome"), key, "full_outer")
    decision, outcome = F.coalesce("decision", F.lit("undecided")), F.coalesce("outcome", F.lit("none"))
    fault = (
        F.when(F.col("queued").isNull(), "not queued")
        .when(F.col("decision_n") > 1, "decided twice")
        .when(F.col("outcome_n") > 1, "carried out twice")
        .when(F.col("decision").isNotNull() & ~F.col("decision").isin(*VERDICTS), "unknown decision")
        .when((outcome == "applied") & (decision != "approve"), "applied without approval")
        .when((decision == "approve") & (outcome == "none"), "approved without outcome")
    )
    return met.select(*key, "signal", decision.alias("decision"), outcome.alias("outcome"), fault.alias("fault"))


def batch_counts(outcomes: DataFrame) -> DataFrame:
    """batch, reviewed, a count for each decision and outcome, and faults."""
    count = lambda c, v: F.count_if(F.col(c) == v).alias(v)
    return outcomes.groupBy("batch").agg(F.count("*").alias("reviewed"), *(count("decision", v) for v in (*VERDICTS, "undecided")), *(count("outcome", v) for v in OUTCOMES.values()), F.count("fault").alias("faults"))


def index_line(batch: Column, day: Column, said: Column) -> Column:
    return F.concat(F.lit("- "), F.coalesce(day, F.lit("undated")), F.lit(" [["), batch, F.lit("]] "), said)


def indexed(index: DataFrame, lines: DataFrame) -> DataFrame:
    """batch, day, line: an index with the lines of some batches put in; those of a batch that it had before are replaced.

    So a rerun adds no second line, and two batches of one day have one each. Of several lines of a batch in one call the
    greatest counts. Order is by day, then batch, the newest first (undated ones last), and isn't stored.
    """
    new = lines.groupBy("batch").agg(F.max(F.struct("day", "line")).alias("m")).select("batch", "m.day", "m.line")
    return index.join(new.select("batch"), "batch", "left_anti").select("batch", "day", "line").unionByName(new)

"""Transcript segments: offsets of chunks, merged text, subtitle cues, logs read as gaps and islands."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def shifted(segments: DataFrame, by: list[str], chunk: str, duration: str) -> DataFrame:
    """segments with offset: the sum of the durations of the chunks before (a chunk's duration stands on each of its rows)."""
    chunks = segments.groupBy(*by, chunk).agg(F.max(duration).alias("__d"))
    before = Window.partitionBy(*by).orderBy(chunk).rowsBetween(Window.unboundedPreceding, -1)
    offsets = chunks.select(*by, chunk, F.coalesce(F.sum("__d").over(before), F.lit(0.0)).alias("offset"))
    return segments.join(offsets, [*by, chunk])


def merged(segments: DataFrame, by: list[str], order: list[str], text: str, language: str) -> DataFrame:
    """by, text (in order, joined by a space), language (the first that isn't null), n."""
    rows = F.array_sort(F.collect_list(F.struct(*order, text)))
    first = F.min_by(F.when(F.col(language).isNotNull(), F.col(language)), F.when(F.col(language).isNotNull(), F.struct(*order)))
    return segments.groupBy(*by).agg(F.array_join(F.transform(rows, lambda r: T.strip(r[text])), " ").alias("text"), first.alias("language"), F.count("*").alias("n"))


def cues(segments: DataFrame, by: list[str], order: list[str], start: str, end: str, text: str, kind: str = "srt") -> DataFrame:
    """by, body: numbered SRT cues, or WebVTT."""
    n = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    sep = "," if kind == "srt" else "."
    span = F.concat(T.cue_time(F.col(start), sep), F.lit(" --> "), T.cue_time(F.col(end), sep))
    rows = segments.select(*by, n.alias("n"), span.alias("span"), T.strip(F.col(text)).alias("t"))
    block = lambda r: F.concat(F.concat(r["n"].cast("string"), F.lit("\n")) if kind == "srt" else F.lit(""), r["span"], F.lit("\n"), r["t"])
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", "span", "t"))), block), "\n\n")
    return rows.groupBy(*by).agg(joined.alias("body") if kind == "srt" else F.concat(F.lit("WEBVTT\n\n"), joined).alias("body"))


def islands(lines: DataFrame, by: list[str], order: str, line: str, head: str) -> DataFrame:
    """by, event, first_line, text: lines from one header line to the next; what stands before the first header is left out."""
    upto = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marked = lines.withColumn("event", F.sum(F.col(line).rlike(head).cast("int")).over(upto).cast("long")).where("event > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, line))), lambda r: r[line]), "\n")
    return marked.groupBy(*by, "event").agg(F.min(order).alias("first_line"), text.alias("text"))


def cost(minutes: str, model: str, rates: dict[str, float]):
    """Minutes times the model's rate; null for an unknown model."""
    table = F.create_map(*(F.lit(x) for kv in rates.items() for x in kv))
    return F.round(F.col(minutes) * F.try_element_at(table, F.col(model)), 6)

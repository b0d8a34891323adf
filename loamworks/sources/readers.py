"""Readers of files as tables: text, Markdown, lenient JSON lines, CSV, transcripts, pages, logs.

Each lists and reads through Spark, so paths may lie in any store that Spark reads.
"""

from __future__ import annotations

import datetime
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import pages as P
from . import discovery

KINDS = ("speech", "writing", "chat", "notes")
FIELDS = ("text", "content", "body", "message")


def whole(spark: SparkSession, path: str | list[str], suffix: str, since: datetime.datetime | None = None) -> DataFrame:
    """source_path, text of each file below path with a suffix (whole text, any depth); no dot files, no readme.

    path: a folder, or files. since: only files changed then or later are opened.
    """
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").text(path, wholetext=True)
    df = discovery.changed_since(df, since) if since else df
    name = F.lower(F.element_at(F.split("source_path", "/"), -1))
    out = df.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("text"))
    return out.where(~name.startswith(".") & ~name.rlike(r"^readme\b"))


def kind_of(path: Column, explicit: Column | None = None, kinds: Sequence[str] = KINDS) -> Column:
    """The kind stated, else that of a folder in the path, else that between dots in the file name, else unknown."""
    parts = F.split(F.lower(path), "/")
    folder = F.array_min(F.array_intersect(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, kinds))))
    dotted = F.regexp_extract(F.element_at(parts, -1), rf"\.({'|'.join(kinds)})\.", 1)
    stated = F.lit(None).cast("string") if explicit is None else F.when(F.lower(explicit).isin(*kinds), F.lower(explicit))
    return F.coalesce(stated, folder, F.when(dotted != "", dotted), F.lit("unknown"))


def records(df: DataFrame, explicit: Column | None = None) -> DataFrame:
    """id, source_path, text, kind of the rows whose text isn't blank."""
    rows = df.where(T.strip(F.col("text")) != "")
    return rows.select(T.stable_id(F.col("source_path"), F.col("text")).alias("id"), "source_path", "text", kind_of(F.col("source_path"), explicit).alias("kind"))


def text_files(spark: SparkSession, path: str) -> DataFrame:
    return records(whole(spark, path, ".txt"))


def markdown_files(spark: SparkSession, path: str) -> DataFrame:
    """Records of Markdown files; front matter states a kind and isn't text."""
    df = whole(spark, path, ".md").withColumn("__fm", P.front_matter(F.col("text"))).withColumn("text", P.body(F.col("text")))
    return records(df, F.try_element_at("__fm", F.lit("kind")))


def field(name: str) -> Column:
    """A string at the top of a parsed object v, or null."""
    return F.try_variant_get("v", f"$.{name}", "string")


def json_lines(spark: SparkSession, path: str) -> DataFrame:
    """source_path, row_id, kind, text, created_at of lenient JSON lines: what isn't a JSON object is skipped.

    asr_text, formatted_text and edited_text make a row each (speech, writing, writing) with one row_id; without any of
    them the first of text, content, body and message that isn't blank makes one.
    """
    lines = whole(spark, path, ".jsonl").select("source_path", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    parsed = lines.where(T.strip(F.col("line")).startswith("{")).withColumn("v", F.try_parse_json("line")).where("v IS NOT NULL")
    row_id = T.first_non_blank(field("transcript_id"), field("id"), F.concat_ws(":", "source_path", (F.col("pos") + 1).cast("string")))
    when = T.first_non_blank(field("created_at"), field("timestamp"), field("date"))
    triple = F.filter(
        F.array(*(F.struct(F.lit(k).alias("kind"), field(f).alias("text")) for f, k in (("asr_text", "speech"), ("formatted_text", "writing"), ("edited_text", "writing")))),
        lambda r: F.coalesce(T.strip(r["text"]) != "", F.lit(False)),
    )
    stated = F.when(F.lower(field("kind")).isin(*KINDS), F.lower(field("kind"))).otherwise("unknown")
    single = F.array(F.struct(stated.alias("kind"), T.first_non_blank(*map(field, FIELDS)).alias("text")))
    rows = parsed.select("source_path", row_id.alias("row_id"), when.alias("created_at"), F.explode(F.when(F.size(triple) > 0, triple).otherwise(single)).alias("r"))
    return rows.select("source_path", "row_id", "r.kind", "r.text", "created_at").where("text IS NOT NULL")


def csv_files(spark: SparkSession, path: str) -> DataFrame:
    """source_path, text, kind of CSV files with a header; quoted fields may have line breaks."""
    df = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(path, header=True, multiLine=True, escape='"')
    have = {c.lower(): F.col(f"`{c}`") for c in df.columns}
    texts = [have[f] for f in FIELDS if f in have] or [F.lit(None).cast("string")]
    out = df.select(F.col("_metadata.file_path").alias("source_path"), T.first_non_blank(*texts).alias("text"), have.get("kind", F.lit(None).cast("string")).alias("__kind"))
    return records(out, F.col("__kind"))


def transcript_events(spark: SparkSession, path: str | list[str], since: datetime.datetime | None = None) -> DataFrame:
    """source_chat, event_no (physical line, from 1), role, text, toggle of transcripts in three dialects.

    Roles come from payload.type, else message.role, role or type; only users and assistants count. Meta, summary and
    notification events are dropped; text is a string or the text blocks of an array, joined by line breaks, without
    reminder and command wrappers. toggle: a user line that turns recording off or on. Files in a folder `subagents` are left out; what else is no
    person's conversation, and what changed, is told by sources.discovery, whose paths this reads.
    """
    lines = whole(spark, path, ".jsonl", since).where(~F.contains("source_path", F.lit(discovery.ASIDE))).select(F.col("source_path").alias("source_chat"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    ev = lines.withColumn("v", F.try_parse_json("line")).where("v IS NOT NULL")
    get = lambda p, t="string": F.try_variant_get("v", p, t)
    flag = lambda p: F.coalesce(get(p, "boolean"), F.lit(False))
    dropped = flag("$.isMeta") | flag("$.isCompactSummary") | (F.coalesce(get("$.origin.kind"), F.lit("")) == "task-notification")
    payload = F.when(get("$.payload.type") == "user_message", "user").when(get("$.payload.type") == "agent_message", "assistant")
    role = F.coalesce(payload, get("$.message.role"), get("$.role"), get("$.type"))
    blocks = "array<struct<type:string,text:string>>"
    listed = lambda p: F.array_join(F.filter(F.transform(F.filter(get(p, blocks), lambda b: b["type"].isin("text", "input_text", "output_text")), lambda b: T.strip(b["text"])), lambda t: t != ""), "\n")
    # A string doesn't cast to an array and the other way round gives JSON, so arrays are tried first.
    content = lambda p: F.coalesce(listed(p), get(p))
    text = F.when(payload.isNotNull(), get("$.payload.message")).otherwise(F.coalesce(content("$.message.content"), content("$.content")))
    clean = T.strip(F.regexp_replace(text, r"(?is)<(system-reminder|command-[a-z]+|local-command-[a-z]+|task-notification)>.*?</\1>", ""))
    rows = ev.where(~dropped).select("source_chat", (F.col("pos") + 1).cast("long").alias("event_no"), role.alias("role"), F.when(role == "user", clean).otherwise(T.strip(text)).alias("text"))
    toggle = F.when(F.col("role") == "user", F.when(F.lower("text").rlike(r"^/?(ignore|pause) (this )?chat"), "off").when(F.lower("text").rlike(r"^/?(unignore|resume) (this )?chat"), "on"))
    return rows.where(F.col("role").isin("user", "assistant") & (F.col("text") != "")).withColumn("toggle", toggle)


def recorded(events: DataFrame) -> DataFrame:
    """Events of the chats whose last toggle isn't off."""
    last = events.groupBy("source_chat").agg(F.max_by("toggle", F.when(F.col("toggle").isNotNull(), F.col("event_no"))).alias("last")).where("last = 'off'")
    return events.join(last, "source_chat", "left_anti").drop("toggle")


def page_table(df: DataFrame) -> DataFrame:
    """page, title, headings, overview, status, links of Markdown pages (page, text)."""
    t = F.col("text")
    return df.select("page", P.title(t).alias("title"), P.headings(t).alias("headings"), P.overview(t).alias("overview"), F.coalesce(F.try_element_at(P.front_matter(t), F.lit("status")), F.lit("")).alias("status"), P.wikilinks(t).alias("links"))


def marked_blocks(df: DataFrame, key: str, text: str, names: Sequence[str]) -> DataFrame:
    """key, block_no, heading, one column for each **Name:** value, quote: the ### blocks of a review file."""
    blocks = df.select(key, F.posexplode(F.split(text, r"(?m)^(?=### )")).alias("block_no", "b")).where(F.col("b").startswith("### "))
    value = lambda n: T.strip(F.regexp_extract("b", rf"(?m)^\*\*{n}:\*\*\s*(.*)$", 1))
    quote = F.array_join(F.regexp_extract_all("b", F.lit(r"(?m)^> ?(.*)$"), F.lit(1)), "\n")
    return blocks.select(key, F.col("block_no").cast("long").alias("block_no"), T.strip(F.regexp_extract("b", "^### (.*)", 1)).alias("heading"), *(value(n).alias(column_name(n)) for n in names), quote.alias("quote"))


def inbox_blocks(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, block_no, at (a time), body: the entries of inbox files, each under a heading `## YYYY-MM-DD HH:MM`.

    What stands before the first such heading, or under one whose time doesn't exist, is no entry; other headings belong to
    the entry they are in.
    """
    blocks = df.select(key, F.posexplode(F.split(text, r"(?m)^(?=## \d{4}-\d{2}-\d{2} \d{2}:\d{2}\s*$)")).alias("block_no", "b"))
    head = F.regexp_extract("b", r"^## (\d{4}-\d{2}-\d{2} \d{2}:\d{2})", 1)
    rows = blocks.select(key, F.col("block_no").cast("long").alias("block_no"), F.try_to_timestamp(head, F.lit("yyyy-MM-dd HH:mm")).alias("at"), T.strip(F.regexp_replace("b", r"^##[^\n]*", "")).alias("body"))
    return rows.where("at IS NOT NULL")


def column_name(name: str) -> str:
    return name.lower().replace(" ", "_")


def log_facts(df: DataFrame, key: str, text: str, patterns: Mapping[str, str]) -> DataFrame:
    """key, the last match of each pattern's first group, and the first and last ISO time of a log."""
    t = F.col(text)
    last = lambda p: F.try_element_at(F.regexp_extract_all(t, F.lit(p), F.lit(1)), F.lit(-1))
    stamps = F.regexp_extract_all(t, F.lit(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d+)?"), F.lit(0))
    times = F.array_compact(F.transform(stamps, lambda s: F.try_to_timestamp(s)))
    return df.select(key, *(last(p).alias(n) for n, p in patterns.items()), F.array_min(times).alias("first_at"), F.array_max(times).alias("last_at"))

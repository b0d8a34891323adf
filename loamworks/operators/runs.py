"""What a run leaves: ledgers, states, metrics, health, reports, backups. Tables in, tables (or texts as columns) out."""

from __future__ import annotations

import tomllib
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Fixed shapes of the ledger's and the state files' lines, as far as they are read.
LEDGER = "results array<struct<attempt_logs array<string>>>"
STATE = "run_id string, status string, updated_at string, mode string, source string"
#: The parts of a path by which a transcript's source is known.
SOURCES = (("/.codex/sessions/", "codex"), ("/.claude/projects/", "claude"))
#: Markers older than so many days are stale.
STALE_DAYS = 14


def parsed(lines: DataFrame, schema: str, line: str = "line") -> DataFrame:
    """lines with v, the JSON object that a line holds (null where it holds none)."""
    return lines.withColumn("v", F.when(F.ltrim(line).startswith("{"), F.from_json(F.col(line), schema)))


def attempt_logs(lines: DataFrame, by: list[str], order: str) -> DataFrame:
    """by, name, first: the log names that an attempt ledger's lines record, once each, where they first stand. Names with a
    path, and lines that are no JSON object, are left out."""
    each = parsed(lines, LEDGER).select(*by, order, F.posexplode("v.results").alias("r", "result")).select(*by, order, "r", F.posexplode("result.attempt_logs").alias("n", "name"))
    return each.where("name IS NOT NULL AND name <> '' AND NOT contains(name, '/')").groupBy(*by, "name").agg(F.min(F.struct(order, "r", "n")).alias("first"))


def run_states(lines: DataFrame, order: str) -> DataFrame:
    """The newest state of each run id (of equally new ones that read last)."""
    rows = parsed(lines, STATE).where("v.run_id IS NOT NULL AND v.run_id <> ''")
    newest = rows.groupBy("v.run_id").agg(F.max_by("v", F.struct(F.coalesce("v.updated_at", F.lit("")), order)).alias("v"))
    return newest.select("v.*")


def latest_metric(lines: DataFrame, by: list[str], order: str, schema: str) -> DataFrame:
    """by and the last line that is a JSON object, as a struct v."""
    return parsed(lines, schema).where("v IS NOT NULL").groupBy(*by).agg(F.max_by("v", order).alias("v"))


def counters(line: Column, prefix: str) -> Column:
    """The counters k=v of a line with this prefix, as a map; values that aren't digits only are left out, of a repeated key
    the last one counts."""
    pairs = F.filter(F.split(F.substr(line, F.lit(len(prefix) + 2)), " "), lambda p: p.rlike(r"^[^=]+=\d+$"))
    entries = F.transform(pairs, lambda p: F.struct(F.substring_index(p, "=", 1).alias("k"), F.substring_index(p, "=", -1).cast("long").alias("v")))
    last = F.filter(entries, lambda e, i: ~F.exists(F.slice(entries, i + 2, F.size(entries)), lambda f: f["k"] == e["k"]))
    return F.when(F.startswith(line, F.lit(prefix + " ")), F.map_from_entries(last))


def source_kind(path: Column) -> Column:
    """codex, claude or other, by a transcript's path; backward slashes count as forward ones."""
    forward, out = F.replace(path, F.lit("\\"), F.lit("/")), F.lit("other")
    for part, name in reversed(SOURCES):
        out = F.when(F.contains(forward, F.lit(part)), name).otherwise(out)
    return out


def array_totals(files: DataFrame, by: list[str], body: str = "body") -> DataFrame:
    """by, total, invalid: the lengths of the JSON arrays that files hold, and how many files hold none."""
    size = F.when(F.ltrim(body).startswith("["), F.json_array_length(body))
    return files.groupBy(*by).agg(F.coalesce(F.sum(size), F.lit(0)).cast("long").alias("total"), F.count_if(size.isNull()).alias("invalid"))


def nested_or_flat(df: DataFrame, nested: str, field: str) -> Column:
    """A field of a record: the nested struct's if there is one, else the record's own."""
    return F.when(F.col(nested).isNotNull(), F.col(f"{nested}.{field}")).otherwise(F.col(field) if field in df.columns else F.lit(None))


def marker_info(value: Column, today: Column) -> Column:
    """present, valid, age_days of a marker: seconds since 1970 or an ISO date."""
    text = T.strip(value)
    day = F.when(text.rlike(r"^\d+$"), F.to_date(F.timestamp_seconds(text.try_cast("long")))).when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    return F.struct(value.isNotNull().alias("present"), day.isNotNull().alias("valid"), F.datediff(today, day).cast("long").alias("age_days"))


def marker_alert(name: Column, info: Column) -> Column:
    missing, invalid = ~info["present"], ~info["valid"]
    return F.when(missing, F.concat(F.lit("no cursor kept for "), name)).when(invalid, F.concat(F.lit("unreadable cursor for "), name)).when(info["age_days"] > STALE_DAYS, F.concat(F.lit("cursor for "), name, F.lit(" is old, in days: "), info["age_days"].cast("string")))


def assembled(parts: Mapping[str, DataFrame]) -> DataFrame:
    """One document of many one-row aggregates: a struct for each, cross-joined (a row each, whatever the input's size)."""
    out = None
    for name, part in parts.items():
        row = part.limit(1).select(F.struct(*part.columns).alias(name))
        out = row if out is None else out.crossJoin(F.broadcast(row))
    return out


def health(pending: DataFrame, sides: DataFrame, decisions: DataFrame, states: DataFrame, key: str) -> DataFrame:
    """One row: counts of the queue and the runs, orphans both ways, the latest run, and alerts."""
    ids = pending.select(key).distinct().withColumn("p", F.lit(1)).join(sides.select(key).distinct().withColumn("s", F.lit(1)), key, "full_outer")
    queue = ids.agg(F.count("p").alias("pending_entries"), F.count("s").alias("sidecars"), F.count_if(F.col("s").isNull()).alias("orphan_pending"), F.count_if(F.col("p").isNull()).alias("orphan_sidecars"))
    of = lambda *names: F.count_if(F.col("status").isin(*names))
    runs = states.agg(F.count("*").alias("known"), of("failed").alias("failed"), of("running", "ready-to-advance").alias("unfinished"), F.max_by("run_id", F.struct("updated_at", "run_id")).alias("latest"))
    out = assembled({"queue": queue, "runs": runs, "review": decisions.agg(F.count_distinct(key).alias("decisions"))})
    said = lambda c, text: F.when(c > 0, F.concat(c.cast("string"), F.lit(text)))
    q, r = F.col("queue"), F.col("runs")
    alerts = F.array_compact(F.array(said(q["orphan_pending"], " waiting without details"), said(q["orphan_sidecars"], " details without an entry"), said(r["failed"], " failed and kept"), said(r["unfinished"], " begun but not done")))
    return out.select("queue.*", F.col("runs.known").alias("known_runs"), F.col("runs.failed").alias("failed_runs"), F.col("runs.unfinished").alias("unfinished_runs"), F.col("runs.latest").alias("latest_run"), "review.decisions", alerts.alias("alerts"))


def stage_updates(events: DataFrame, run: str, stage: str, order: list[str]) -> DataFrame:
    """The newest update of each run's stage; a failed validation keeps the counts of the update before it.

    Columns of events besides these: status, n (a count, null where the update has none), validation_failed.
    """
    newest = F.struct(*order)
    return events.groupBy(run, stage).agg(F.max_by("status", newest).alias("status"), F.max_by("n", F.when(F.col("n").isNotNull(), newest)).alias("n"), F.max_by("validation_failed", newest).alias("validation_failed"))


#: Which status may follow which; a stage begins as pending.
FOLLOWS = {"pending": ("running", "skipped"), "running": ("done", "failed"), "failed": ("running",), "done": (), "skipped": ()}


def stage_history(updates: DataFrame, run: str, stage: str, seq: str, status: str = "status") -> DataFrame:
    """run, stage, status, accepted, rejected (seq, status, reason): each stage's updates in order, through FOLLOWS.

    An update that repeats the present status, that may not follow it, or that has an unknown or no status changes nothing and is
    listed. A stage's updates are one row of an array, folded in the JVM.
    """
    listed = updates.groupBy(run, stage).agg(F.array_sort(F.collect_list(F.struct(F.col(seq).alias("seq"), F.col(status).alias("status")))).alias("u"))
    follows = F.create_map(*(x for k, v in FOLLOWS.items() for x in (F.lit(k), F.array(*map(F.lit, v)).cast("array<string>"))))
    kind = listed.schema["u"].dataType.elementType["seq"].dataType.simpleString()
    start = F.struct(F.lit("pending").alias("status"), F.lit(0).cast("long").alias("accepted"), F.array().cast(f"array<struct<seq: {kind}, status: string, reason: string>>").alias("rejected"))

    def step(s: Column, u: Column) -> Column:
        legal = F.coalesce(F.array_contains(follows[s["status"]], u["status"]), F.lit(False))
        reason = F.when(~F.coalesce(u["status"].isin(*FOLLOWS), F.lit(False)), "unknown status").when(u["status"] == s["status"], "repeated").otherwise(F.concat(F.lit("after "), s["status"]))
        return F.struct(
            F.when(legal, u["status"]).otherwise(s["status"]).alias("status"), (s["accepted"] + F.when(legal, 1).otherwise(0)).cast("long").alias("accepted"),
            F.when(legal, s["rejected"]).otherwise(F.concat(s["rejected"], F.array(F.struct(u["seq"].alias("seq"), u["status"].alias("status"), reason.alias("reason"))))).alias("rejected"),
        )

    return listed.select(run, stage, F.aggregate("u", start, step).alias("s")).select(run, stage, "s.*")


def findings_order(df: DataFrame, confidence: str, order: list[str], by: list[str]) -> DataFrame:
    """df with rank in each group: high confidence first, then medium, then low, then as given."""
    at = F.when(F.col(confidence) == "high", 0).when(F.col(confidence) == "medium", 1).otherwise(2)
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(at, *order)).cast("long"))


def stale_pages(df: DataFrame, day: Column, required: tuple[str, ...], days: int = 180, least: int = 100) -> DataFrame:
    """df (status, updated, links, frontmatter map, body) with signals: what is wrong with a page, in order."""
    missing = F.array_except(F.array(*map(F.lit, required)), F.map_keys("frontmatter"))
    stale = (F.col("status") == "active") & (F.datediff(day, F.col("updated")) > days)
    rules = (("stale", stale), ("superseded_without_link", (F.col("status") == "superseded") & (F.col("links") == 0)), ("missing_fields", F.size(missing) > 0), ("empty", F.length(T.strip(F.col("body"))) < least))
    return df.withColumns({"signals": F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in rules))), "missing": missing})


def batch_name(id: Column) -> Column:
    """date, slug and label of a batch id such as 2024-05-01-first-pass."""
    date = F.nullif(F.regexp_extract(id, r"^(\d{4}-\d{2}-\d{2})", 1), F.lit(""))
    rest = T.strip(F.regexp_replace(F.regexp_replace(id, r"^\d{4}-\d{2}-\d{2}-?", ""), "[^A-Za-z0-9]+", " "))
    slug = F.lower(F.replace(rest, F.lit(" "), F.lit("-")))
    return F.struct(date.alias("date"), F.when(slug == "", "batch").otherwise(slug).alias("slug"), F.concat_ws(" ", date, F.initcap(rest)).alias("label"))


def plan_day(now: Column, zone: str, cutoff: int = 16) -> Column:
    """The day that a plan is for in a time zone (now is UTC): today before the cutoff hour, else tomorrow."""
    local = F.from_utc_timestamp(now, zone)
    return F.when(F.hour(local) < cutoff, F.to_date(local)).otherwise(F.date_add(F.to_date(local), 1))


def unit_header(path: Column, day: Column) -> Column:
    """The line that names a member of a bundle."""
    return F.format_string("===== unit: %s (%s) =====", path, day)


def report(entries: DataFrame, decided: DataFrame, by: str, key: str, order: list[str]) -> DataFrame:
    """by, report: a text of counts by signal and by decision, and the entries' titles under their decision."""
    joined = entries.join(decided, key, "left").withColumn("decision", F.coalesce("decision", F.lit("undecided")))
    count = lambda c: joined.groupBy(by, c).agg(F.count("*").alias("n")).groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(c, "n"))), lambda x: F.concat(F.lit("- "), x[c], F.lit(": "), x["n"].cast("string"))), "\n").alias(f"{c}s"))
    line = F.concat(F.lit("- ["), F.col("decision"), F.lit("] "), F.col("title"))
    lists = joined.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("decision", *order, line.alias("line")))), lambda x: x["line"]), "\n").alias("entries"), F.count("*").alias("n"))
    out = lists.join(count("signal"), by).join(count("decision"), by)
    return out.select(by, F.concat_ws("\n\n", F.concat(F.lit("# "), F.col(by).cast("string"), F.lit(": "), F.col("n").cast("string")), "signals", "decisions", "entries").alias("report"))


def handoff(df: DataFrame, group: str, order: str, author: str, text: str, title: Column) -> DataFrame:
    """group, document: a session's turns as one text under its title, secrets masked."""
    turn = F.concat(F.lit("## "), F.col(author), F.lit("\n"), T.redacted(F.col(text)))
    turns = df.groupBy(group, title.alias("title")).agg(F.transform(F.sort_array(F.collect_list(F.struct(order, turn.alias("t")))), lambda x: x["t"]).alias("t"))
    return turns.select(group, F.concat(F.lit("# "), "title", F.lit("\n\n"), F.array_join("t", "\n\n")).alias("document"))


def run_memory(runs: DataFrame, by: str, order: str, line: Column) -> DataFrame:
    """by, memory: one line for each run, in order."""
    return runs.groupBy(by).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, line.alias("l")))), lambda x: x["l"]), "\n").alias("memory"))


def session_ids(paths: DataFrame, path: str = "path", depth: int = 6) -> DataFrame:
    """paths with id: the UUID in a transcript's file name; files deeper than `depth` folders, or without one, are left out."""
    found = F.regexp_extract(F.element_at(F.split(path, "/"), -1), r"([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.jsonl$", 1)
    return paths.withColumn("id", found).where((F.col("id") != "") & (F.size(F.split(path, "/")) - 1 <= depth))


def cached_lookup(cache: DataFrame, wanted: DataFrame, key: str, rebuild) -> DataFrame:
    """wanted with the cache's columns; only if an id isn't there, the cache is built anew (once) by rebuild()."""
    if wanted.join(cache, key, "left_anti").isEmpty():
        return wanted.join(cache, key, "left")
    return wanted.join(rebuild(), key, "left")


def vault_config(spark: SparkSession, text: str) -> DataFrame:
    """vault, root, description, review_only, include, exclude of a TOML text: a row for each vault that has a root."""
    schema = "vault string, root string, description string, review_only boolean, include array<string>, exclude array<string>"
    paths = lambda v: [x.strip("/") for x in v if isinstance(x, str) and x.strip("/")] if isinstance(v, list) else []
    vaults = tomllib.loads(text).get("vaults")
    rows = [(str(n), v["root"], str(v.get("description") or ""), v.get("review_only") is True, paths(v.get("route_include")), paths(v.get("route_exclude"))) for n, v in (vaults.items() if isinstance(vaults, dict) else ()) if isinstance(v, dict) and isinstance(v.get("root"), str)]
    return spark.createDataFrame(rows, schema)


def backed_up(spark: SparkSession, path: str, copy: str) -> int:
    """Copies a table's rows to a new folder (never over one that is there) and returns how many; restored() is the way back."""
    spark.read.parquet(path).write.mode("error").parquet(copy)
    return spark.read.parquet(copy).count()


def late_rows(events: DataFrame, at: str, cursor: Column) -> DataFrame:
    """events with taken: whether a row's time is at or past the cursor. An older row is late and never taken; one whose time
    was renewed is taken whole."""
    return events.withColumn("taken", F.coalesce(F.col(at) >= cursor, F.lit(False)))

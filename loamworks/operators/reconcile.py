"""Decisions about routed facts: packed batches, the context of a page, derived fields, provenance, review cards."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources import generations
from . import contracts, gates, pages, retrieval
from .contracts import MODES
from .routing import blank

#: The review card's verb of each action.
VERBS = {"new": "APPEND", "duplicate": "DUPLICATE", "supersede": "SUPERSEDE", "contradict": "CONTRADICT"}
#: Candidate columns and the names that a decision carries them under.
CARRIED = {"type": "candidate_type", **{c: c for c in ("memory_tier", "source_role", "source_date", "source_chat", "source_event", "evidence", "historical_review", "historical_age_days", "quality_review_sample", "quality_review_bucket", "fact_class", "policy_review_only", "policy_reasons", "person_review_only", "detected_names", "review_kind")}}


def mapped(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in table.items() for x in kv))[c]


def batch_faults(items: DataFrame, flat: DataFrame, batch: str, key: str) -> DataFrame:
    """batch, fault of packed batches: groups and the flat list must have the same ids in the same order, no id twice, and each
    row the batch's target. items: batch, group, pos, id, vault, page, target_vault, target_page; flat: batch, pos, id."""
    order = lambda df, by: df.groupBy(batch).agg(F.transform(F.sort_array(F.collect_list(F.struct(*by, key))), lambda x: x[key]).alias("ids"))
    grouped, listed = order(items, ["group", "pos"]), order(flat, ["pos"]).withColumnRenamed("ids", "flat_ids")
    wrong = items.groupBy(batch).agg(F.max((F.col("vault") != F.col("target_vault")) | (F.col("page") != F.col("target_page"))).alias("off_target"), F.max(blank(F.col(key))).alias("no_id"))
    both = grouped.join(listed, batch, "full_outer").join(wrong, batch, "left")
    fault = F.when(F.col("ids").isNull() | F.col("flat_ids").isNull(), "missing candidates").when(F.col("no_id"), "missing id").when(F.col("ids") != F.col("flat_ids"), "groups and list differ")
    fault = fault.when(F.size(F.array_distinct("ids")) < F.size("ids"), "repeated id").when(F.col("off_target"), "target differs")
    return both.select(batch, fault.alias("fault"))


def canonical_decisions(decisions: DataFrame, candidates: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """decisions (key, action, old_content, content) with mode, section, confidence, needs_review and content derived: only the
    action and the line to replace are taken as given. candidates: key, candidate_content, confidence; sections: key, section
    (of packed batches). Unknown actions stay as they are, with null derived columns."""
    joined = decisions.join(candidates, key, "left").join(sections, key, "left")
    action, known = F.col("action"), F.col("action").isin(*MODES)
    review = contracts.expected_review(action, F.col("confidence"))
    fact, old = F.col("candidate_content"), F.col("old_content")
    bullet = F.concat(F.lit("- "), F.regexp_replace(fact, "^- ", ""))
    replaced = F.when(F.startswith(old, F.lit("- ")), bullet).when(~F.startswith(old, F.lit("|")), fact).otherwise(F.col("content"))
    content = F.when(action == "duplicate", "").when(action == "new", fact).when(known & fact.isNotNull(), replaced).otherwise(F.col("content"))
    dropped = F.when(~action.isin("duplicate", "new"), old)
    return joined.select(key, "action", mapped(action, MODES).alias("mode"), "section", F.when(known, F.col("confidence")).alias("confidence"), review.alias("needs_review"), content.alias("content"), dropped.alias("old_content"))


def page_contexts(lines: DataFrame, wanted: DataFrame, facts: DataFrame, cap: int, preamble: int = 20, most: int = 120, matches: int = 12) -> DataFrame:
    """page, lines, used, sha256: for each page what a decision may look at, whole lines within cap characters, and the page's digest.

    First the lines before the first heading, then those of the wanted sections (from their heading), then the other lines
    that share most words with the page's facts. lines: page, pos, line; wanted: page, section; facts: page, fact, content.
    """
    heading = F.when(F.startswith("line", F.lit("## ")), T.strip(F.substr(F.col("line"), F.lit(4))))
    placed = lines.withColumn("section", F.last(heading, ignorenulls=True).over(Window.partitionBy("page").orderBy("pos")))
    chosen = placed.join(wanted.select("page", "section", F.lit(True).alias("chosen")).distinct(), ["page", "section"], "left")
    kind = F.when(F.col("section").isNull(), 0).when(F.col("chosen"), 1).otherwise(2)
    terms = lambda df, keep, c: df.select(*keep, F.explode(F.array_distinct(T.index_tokens(F.col(c), 2))).alias("term"))
    rows = chosen.withColumn("kind", kind)
    others = rows.where((F.col("kind") == 2) & ~blank(F.col("line")) & ~F.startswith("line", F.lit("#")))
    overlap = terms(others, ["page", "pos"], "line").join(terms(facts, ["page"], "content").distinct(), ["page", "term"]).groupBy("page", "pos").agg(F.count("*").alias("n"))
    best = retrieval.top_k(overlap, "page", [F.desc("n"), F.asc("pos")], matches)
    matched = rows.join(best, ["page", "pos"]).select("page", "pos", "line", "kind", F.col("rank").alias("at"))
    within = F.row_number().over(Window.partitionBy("page", "kind").orderBy("pos"))
    first = rows.where("kind < 2").withColumn("at", within.cast("long")).where(F.col("at") <= F.when(F.col("kind") == 0, preamble).otherwise(most)).select("page", "pos", "line", "kind", "at")
    ordered = first.unionByName(matched).withColumn("order", F.struct("kind", "at"))
    kept = retrieval.within_budget(ordered, "page", "order", "line", cap)
    text = lines.groupBy("page").agg(F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "line"))), lambda x: x["line"]), "\n"), 256).alias("sha256"))
    budget = kept.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("order", "line"))), lambda x: x["line"]).alias("lines"), F.max("used").alias("used"))
    return text.join(budget, "page", "left").select("page", F.coalesce("lines", F.array().cast("array<string>")).alias("lines"), F.coalesce("used", F.lit(0)).cast("long").alias("used"), "sha256")


def enriched(decisions: DataFrame, candidates: DataFrame, key: str, run: dict[str, str]) -> DataFrame:
    """decisions with the candidate's provenance under its names there, and the run's constants. A decision without a candidate
    keeps nulls; columns that candidates lack are left out."""
    held = {c: n for c, n in CARRIED.items() if c in candidates.columns}
    carried = candidates.select(F.col(key).alias("__key"), *(F.col(c).alias(n) for c, n in held.items()))
    return decisions.join(carried, F.col(key) == F.col("__key"), "left").drop("__key").withColumns({k: F.lit(v) for k, v in run.items()})


def fact_events(decisions: DataFrame) -> DataFrame:
    """content, old_content, target, action, review_status, queue_bucket, confidence: a row for each applied decision."""
    queued = F.col("needs_review")
    bucket = F.when(F.col("confidence") == "low", "brainstormed").when(F.col("confidence") == "medium", "uncertain").otherwise("destructive")
    return decisions.select("content", F.coalesce("old_content", F.lit("")).alias("old_content"), F.concat_ws("/", "vault", "page").alias("target"), "action", F.when(queued, "queued").otherwise("applied").alias("review_status"), F.when(queued, bucket).otherwise("").alias("queue_bucket"), "confidence")


def sidecars(decisions: DataFrame, roots: DataFrame, key: str) -> DataFrame:
    """decisions with vault_root, title and target_display, as they are kept beside a queued entry. roots: vault, root."""
    joined = decisions.join(roots.select("vault", F.col("root").alias("vault_root")), "vault", "left")
    return joined.withColumns({"title": F.col("content"), "target_display": F.concat(F.col("vault"), F.lit("/"), F.col("page"), F.lit("#"), F.coalesce("section", F.lit("")))})


def fallback_class(kind: Column, tier: Column) -> Column:
    """The class that a fact's type alone tells (of facts from before classes were kept); of other current ones active_state."""
    return gates.marked_class(T.key_name(F.coalesce(kind, F.lit(""))), gates.LEGACY_MARKS, tier)


def review_cards(pending: DataFrame, sides: DataFrame, decided: DataFrame, key: str) -> DataFrame:
    """One card for each pending entry: where it goes, what changes, on which evidence, and whether it is decided.

    pending: key, title, target, evidence, confidence, bucket, captured; sides (may lack an entry): key, vault, page, section,
    action, content, old_content, source_evidence, rationale, candidate_type, memory_tier, fact_class, run_id; decided: key, decision.
    """
    joined = pending.join(sides.withColumn("__side", F.lit(True)), key, "left").join(decided, key, "left")
    c, blank_to = F.col, lambda *cs: F.coalesce(T.first_non_blank(*cs), F.lit(""))
    action = F.coalesce("action", F.lit("new"))
    change = action.isin("supersede", "contradict") & ~blank(c("old_content"))
    content = F.coalesce("content", "title")
    diff = F.struct(mapped(action, VERBS).alias("verb"), F.when(change, c("old_content")).alias("before"), F.when(change, content).alias("after"), F.when(~change, content).alias("add_line"), blank_to(c("rationale"), c("evidence")).alias("note"))
    evidence = blank_to(c("source_evidence"))
    target = F.coalesce("target", F.lit(""))
    from_target = F.when(F.contains(target, F.lit("#")), F.regexp_extract(target, "^(.*)#", 1)).otherwise(target)
    section = F.when(F.contains(target, F.lit("#")), F.element_at(F.split(target, "#"), -1)).otherwise("")
    return joined.select(
        key, F.coalesce("confidence", F.lit("medium")).alias("confidence"), F.coalesce("bucket", F.lit("uncertain")).alias("signal"), F.coalesce("vault", F.lit("")).alias("vault"), F.coalesce(c("page"), from_target).alias("target_file"), F.coalesce(c("section"), section).alias("target_section"),
        action.alias("proposed_action"), diff.alias("diff"), evidence.alias("source_evidence"), (evidence != "").alias("source_evidence_available"), F.substring(F.coalesce("captured", F.lit("")), 1, 10).alias("first_seen"), c("decision").isNotNull().alias("decided"), "decision",
        blank_to(c("fact_class"), fallback_class(c("candidate_type"), c("memory_tier"))).alias("fact_class"), F.when(blank(c("run_id")), "legacy").otherwise("run").alias("review_cohort"),
    )


def packed_sections(items: DataFrame, key: str, section: Column, fallback: Column) -> DataFrame:
    """key, section of a packed batch's rows: the route's, or the batch target's where a row has no route."""
    return items.select(key, F.coalesce(section, fallback).alias("section"))


def exact_lines(lines: Column, wanted: Column) -> Column:
    """How often a line stands among a page's lines, as it is."""
    return F.size(F.filter(lines, lambda line: line == wanted)).cast("long")


def previewed(manifest: DataFrame, pages: DataFrame) -> DataFrame:
    """manifest (page, action, line) with hits, and valid: whether the line stands there exactly once. pages: page, lines."""
    joined = manifest.join(pages, "page", "left")
    hits = F.coalesce(exact_lines(F.col("lines"), F.col("line")), F.lit(0))
    return joined.select(*manifest.columns, F.greatest(hits, F.lit(0)).cast("long").alias("hits"), (hits == 1).alias("valid"))


def accepted(previews: DataFrame, manifest: str) -> DataFrame:
    """manifest, n, faults: a manifest counts as a whole, so it is accepted only if none of its rows has a fault."""
    counts = previews.groupBy(manifest).agg(F.count("*").alias("n"), F.count_if(~F.col("valid")).alias("faults"))
    return counts.withColumn("accepted", F.col("faults") == 0)


def valid_undo(log: DataFrame, fields: Sequence[str]) -> DataFrame:
    """The undo log's events with reason: an unknown action or a missing field. One faulty event bars its run's replay."""
    known = F.col("action").isin("append", "remove", "replace", "index_append")
    return contracts.judged(log, [(~known, "unknown action"), *((blank(F.col(f).cast("string")), f"missing {f}") for f in fields), ((F.col("action") == "replace") & F.col("old_content").isNull(), "replace without old_content")])


CLEANUPS = ("remove", "move", "rewrite")


def judged_cleanup(manifest: DataFrame, pages: DataFrame, bullet: str = "- ") -> DataFrame:
    """The rows of a cleanup manifest with reason: the first rule that each breaks.

    manifest: index, action, confidence, page, section, content, new_content (of a rewrite), target_page and target_section (of
    a move), depends_on (indices that must come before); pages: page, lines. A row is about the line `bullet` and content.
    """
    c = F.col
    line, new = F.concat(F.lit(bullet), "content"), F.concat(F.lit(bullet), "new_content")
    several = lambda x: x.rlike(r"[\n\r]")
    at = lambda lines, x: F.coalesce(exact_lines(c(lines), x), F.lit(0))
    earlier = manifest.select(F.col("index").alias("__needed")).distinct()
    needs = manifest.select("index", F.explode("depends_on").alias("__needed"))
    unmet = needs.join(earlier, "__needed", "left_anti").union(needs.where("__needed >= index").select("__needed", "index")).select("index").distinct()
    repeats = lambda keys, name: manifest.groupBy(*keys).agg(F.count("*").alias(name))
    rows = manifest.join(repeats(["page", "content"], "__same"), ["page", "content"], "left").join(repeats(["index"], "__indices"), "index", "left")
    rows = rows.join(unmet.withColumn("__unmet", F.lit(True)), "index", "left")
    # A target's lines go no further than this join: many rows may have one target.
    rows = rows.join(pages.select(F.col("page").alias("target_page"), F.col("lines").alias("__to")), "target_page", "left")
    rows = rows.withColumns({"__target": c("__to").isNotNull(), "__held": at("__to", line) > 0}).drop("__to")
    rows = rows.join(pages.select("page", F.col("lines").alias("__from")), "page", "left")
    moves, rewrites = c("action") == "move", c("action") == "rewrite"
    checks = [
        (c("confidence") != "high", "not of high confidence"),
        (blank(c("page")) | blank(c("section")) | blank(c("content")) | several(c("content")), "no page, section or single line"),
        (~gates.safe_path(c("page")), "unsafe page"),
        (c("__from").isNull(), "no such page"),
        (at("__from", line) != 1, "the line is not there exactly once"),
        (F.coalesce(c("__same"), F.lit(1)) > 1, "the line is in the manifest twice"),
        (~c("action").isin(*CLEANUPS), "unknown action"),
        (F.when(rewrites, blank(c("new_content")) | several(c("new_content"))).otherwise(False), "no single line to write"),
        (F.when(rewrites & (c("new_content") != c("content")), at("__from", new) > 0).otherwise(False), "the new line is there already"),
        (F.when(moves, blank(c("target_page")) | blank(c("target_section")) | ~gates.safe_path(c("target_page")) | ~c("__target")).otherwise(False), "no such target"),
        (F.when(moves, c("__held")).otherwise(False), "the target has the line already"),
        (F.coalesce(c("__indices"), F.lit(2)) > 1, "index is not unique"),
        (F.coalesce(c("__unmet"), F.lit(False)), "comes before what it depends on"),
    ]
    return contracts.judged(rows, checks).select(*manifest.columns, "reason")


def cleanup_edits(manifest: DataFrame, bullet: str = "- ") -> DataFrame:
    """page and pages.EDIT: what a manifest's rows do, in order; a move appends to its target, then removes from its source."""
    c, text = F.col, lambda x: F.lit(x).cast("string")
    line = F.concat(F.lit(bullet), "content")
    edit = lambda seq, page, action, section, content, old: F.struct(page.alias("page"), (c("index") * 2 + seq).cast("bigint").alias("seq"), F.lit(action).alias("action"), section.alias("section"), content.alias("content"), old.alias("old_content"), text(None).alias("previous_line"), text(None).alias("next_line"))
    at_source = F.when(c("action") == "rewrite", edit(1, c("page"), "replace", c("section"), F.concat(F.lit(bullet), "new_content"), line)).otherwise(edit(1, c("page"), "remove", c("section"), line, text(None)))
    moved = F.when(c("action") == "move", edit(0, c("target_page"), "append", c("target_section"), line, text(None)))
    return manifest.select(F.explode(F.array_compact(F.array(moved, at_source))).alias("e")).select("e.*")


def apply_cleanup(spark: SparkSession, base: str, manifest: DataFrame, run: str, bullet: str = "- ") -> int:
    """Applies a whole manifest to the latest generation of a table of pages (page, lines) and commits the next one; its number.

    If a row breaks a rule, or an edit doesn't fit when its turn comes, ValueError says so and nothing is committed; nor is
    anything if the write fails, or if another writer was first (FileExistsError). roll_back() takes a commit back.
    """
    now = generations.latest(spark, base)
    table = generations.read(spark, base)
    faults = judged_cleanup(manifest, table, bullet).where("reason IS NOT NULL").orderBy("index").limit(5).collect()
    if faults or manifest.isEmpty():
        raise ValueError("manifest rejected: " + ("; ".join(f"{r['index']}: {r.reason}" for r in faults) or "no rows"))
    edited = pages.edited_strictly(table, cleanup_edits(manifest, bullet))
    stopped = edited.where("fault IS NOT NULL").limit(5).collect()
    if stopped:
        raise ValueError("manifest rejected: " + "; ".join(f"{r.page}, edit {r.seq}: {r.fault}" for r in stopped))
    counts = {r.action: r["count"] for r in manifest.groupBy("action").count().collect()}
    return generations.commit(spark, edited.select("page", "lines"), base, now, {"run": run, "actions": counts})

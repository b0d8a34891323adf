"""Contracts at stage borders: the first broken rule is a row's reason; rows go on or into quarantine."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

CONFIDENCES = ("high", "medium", "low")
TIERS = ("stable", "current", "audit", "drop")
ROLES = ("user", "user_confirmation", "assistant_context")
#: The mode of each action.
MODES = {"new": "append", "duplicate": "none", "supersede": "replace", "contradict": "replace"}

Check = tuple[Column, str]


def judged(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """df with reason: that of the first check whose condition isn't surely false (null counts as broken); else null."""
    reason = F.lit(None).cast("string")
    for broken, name in reversed(checks):
        reason = F.when(F.coalesce(broken, F.lit(True)), F.lit(name)).otherwise(reason)
    return df.withColumn("reason", reason)


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows without a reason, without that column; and rows with one."""
    return df.where("reason IS NULL").drop("reason"), df.where("reason IS NOT NULL")


def one_line(c: Column, most: int) -> Column:
    """Whether a stripped text breaks 'one line, at most so long'."""
    return T.strip(c).rlike(r"[\n\r]") | (F.length(T.strip(c)) > most)


def candidate_checks(most: int = 320) -> list[Check]:
    """Rules of a candidate fact, in order."""
    c = F.col
    return [
        (c("content").isNull() | (T.strip(c("content")) == ""), "empty content"),
        (one_line(c("content"), most), "content too long or of several lines"),
        (T.strip(c("content")).startswith("- "), "content has a bullet"),
        (c("evidence").isNull() | (T.strip(c("evidence")) == ""), "empty evidence"),
        (one_line(c("evidence"), 160), "evidence too long or of several lines"),
        (c("source_chat").isNull() | (T.strip(c("source_chat")) == ""), "empty source_chat"),
        (~c("confidence").isin(*CONFIDENCES), "invalid confidence"),
        (~c("memory_tier").isin(*TIERS), "invalid memory_tier"),
        (~c("source_role").isin(*ROLES), "invalid source_role"),
        ((c("source_role") != "user") & (c("confidence") == "high"), "high confidence without the user"),
        (c("source_event") < 1, "source_event is not positive"),
        (F.try_to_date(c("source_date"), "yyyy-MM-dd").isNull(), "source_date is no date"),
    ]


def with_evidence(candidates: DataFrame, events: DataFrame) -> DataFrame:
    """Candidates judged against their events (chat, event_no, role, text): the event is there, its role fits, and it
    contains the evidence, white space aside. Candidates that had a reason before keep it."""
    at = events.select(F.col("chat").alias("source_chat"), F.col("event_no").alias("source_event"), F.col("role").alias("event_role"), F.col("text").alias("event_text"))
    joined = candidates.join(at, ["source_chat", "source_event"], "left")
    squeezed = lambda c: T.strip(F.regexp_replace(c, r"\s+", " "))
    role = F.when(F.col("source_role") == "assistant_context", "assistant").otherwise("user")
    late = (
        F.when(F.col("event_text").isNull(), "no such event")
        .when(F.col("event_role") != role, "role differs from the event's")
        .when(~F.contains(squeezed(F.col("event_text")), squeezed(F.col("evidence"))), "evidence is not in the event")
    )
    return joined.withColumn("reason", F.coalesce("reason", late)).drop("event_role", "event_text")


def expected_review(action: Column, confidence: Column) -> Column:
    """Whether a decision must be reviewed: all but duplicates and sure new facts (an unknown action: null)."""
    return F.when(action.isin(*MODES), ~((action == "duplicate") | ((action == "new") & F.coalesce(confidence == "high", F.lit(False)))))


def decision_checks() -> list[Check]:
    """Rules of a decision, in order: what follows from the action and the candidate must say so, and an edit fits the page.

    Columns: action, mode, vault, page, section and what they must be (target_vault, target_page, target_section), confidence
    and the candidate's (candidate_confidence), needs_review, rationale, content, old_content (null where there is none), and
    lines, those of the page that may be replaced.
    """
    c = F.col
    mode = F.create_map(*(F.lit(x) for kv in MODES.items() for x in kv))[c("action")]
    replaces, old, new = c("mode") == "replace", c("old_content"), c("content")
    blank = lambda x: x.isNull() | (T.strip(x) == "")
    where = lambda rule: F.when(replaces, rule).otherwise(False)
    starts = lambda x, mark: F.startswith(x, F.lit(mark))
    return [
        (~c("action").isin(*MODES), "invalid action"),
        (c("mode") != mode, "mode does not fit the action"),
        (~(c("vault").eqNullSafe(c("target_vault")) & c("page").eqNullSafe(c("target_page"))), "other target than the batch"),
        (~c("section").eqNullSafe(c("target_section")), "other section than routed"),
        (~c("confidence").isin(*CONFIDENCES), "invalid confidence"),
        (~c("confidence").eqNullSafe(c("candidate_confidence")), "confidence is not the candidate's"),
        (c("needs_review") != expected_review(c("action"), c("confidence")), "needs_review does not follow"),
        (blank(c("rationale")), "no rationale"),
        (where(blank(old)), "nothing to replace is named"),
        (~replaces & old.isNotNull(), "old_content without a replacement"),
        (F.when(c("action") == "duplicate", ~new.eqNullSafe(F.lit(""))).otherwise(blank(new)), "content does not fit the action"),
        (new.rlike(r"[\n\r]"), "content of several lines"),
        ((c("action") == "new") & starts(new, "- "), "new content has a bullet"),
        (where(old.rlike(r"[\n\r]")), "old_content of several lines"),
        (where(F.size(F.filter("lines", lambda line: line == old)) != 1), "old_content is not one line of the page"),
        (where(starts(old, "#")), "a heading may not be replaced"),
        (where(starts(old, "- ") & ~starts(new, "- ")), "the bullet is lost"),
        (where(starts(old, "|") & ~(starts(new, "|") & F.endswith(F.rtrim(new), F.lit("|")))), "the table row is lost"),
    ]


def canonical_pages(routes: DataFrame, pages: DataFrame) -> DataFrame:
    """routes (vault, page) with canonical: the page of that path, else below wiki/, else the only one of that file name."""
    p = pages.select(F.col("vault").alias("v"), F.col("page").alias("p")).distinct()
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    unique = p.groupBy("v", base(F.col("p")).alias("name")).agg(F.count("*").alias("n"), F.min("p").alias("only")).where("n = 1")
    out = routes.join(p.withColumnsRenamed({"v": "v1", "p": "p1"}), (F.col("vault") == F.col("v1")) & (F.col("page") == F.col("p1")), "left")
    out = out.join(p.withColumnsRenamed({"v": "v2", "p": "p2"}), (F.col("vault") == F.col("v2")) & (F.concat(F.lit("wiki/"), "page") == F.col("p2")), "left")
    out = out.join(unique, (F.col("vault") == F.col("v")) & (base(F.col("page")) == F.col("name")), "left")
    return out.select(*(routes[c] for c in routes.columns), F.coalesce("p1", "p2", "only").alias("canonical"))


def completeness(expected: DataFrame, got: DataFrame, key: str) -> DataFrame:
    """key, problem: ids that are missing, that nobody asked for, or that came more than once."""
    n = got.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key, F.lit(True).alias("wanted")).distinct().join(n, key, "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("wanted").isNull(), "extra").when(F.col("n") > 1, "duplicate")
    return both.select(key, problem.alias("problem")).where("problem IS NOT NULL")


def overlaid(first: DataFrame, second: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """first with the columns of second where that has the key (a retry's answers), and recovered: whether it had."""
    new = second.select(key, F.lit(True).alias("__new"), *(F.col(c).alias(f"__{c}") for c in columns))
    joined = first.join(new, key, "left")
    return joined.select(*(F.when(F.col("__new"), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if c in columns else F.col(c) for c in first.columns), F.coalesce("__new", F.lit(False)).alias("recovered"))

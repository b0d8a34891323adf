"""Gates between stages: tiers, policies, age, sampling, density, names, paths."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

#: Actions and confidences to review buckets.
BUCKETS = {"supersede": "destructive", "contradict": "destructive", "low": "brainstormed", "medium": "uncertain"}


def tier(c: Column) -> Column:
    """routable, audit or dropped; an unknown tier stops the job."""
    known = F.when(c.isin("stable", "current"), "routable").when(c == "audit", "audit").when(c == "drop", "dropped")
    return F.coalesce(known, F.raise_error(F.concat(F.lit("unknown tier: "), F.coalesce(c, F.lit("null")))).cast("string"))


def age_gate(df: DataFrame, day: str, tier_col: str, confidence: str, on: Column, days: int) -> DataFrame:
    """df with age_days, historical_review and confidence: current facts as old as `days` are reviewed and never surer than medium."""
    out = df.withColumn("age_days", F.datediff(on, F.col(day)).cast("long"))
    old = (F.col(tier_col) == "current") & (F.col("age_days") >= days)
    return out.withColumns({"historical_review": F.coalesce(old, F.lit(False)), confidence: F.when(old & (F.col(confidence) == "high"), "medium").otherwise(F.col(confidence))})


def fact_class(c: Column, markers: Mapping[str, Sequence[str]], other: str = "other") -> Column:
    """The first class of which a text has a marker word."""
    out = F.lit(other)
    for name, words in reversed(markers.items()):
        out = F.when(F.lower(c).rlike(r"(?<![\p{L}])(" + "|".join(words) + r")(?![\p{L}])"), name).otherwise(out)
    return out


#: The classes of facts and the marks that tell them, in order; and those that a type from before has besides.
CLASS_MARKS = {
    "relationship": ("relationship", "person", "people", "mentor", "contact", "networking"),
    "health": ("health", "medical", "symptom", "acne", "skin", "medication", "condition"),
    "fitness": ("fitness", "workout", "exercise", "running", "nutrition", "body_composition"),
    "schedule": ("schedule", "calendar", "appointment", "meeting_time", "deadline"),
    "preference": ("preference", "preferred", "communication_style", "workflow_preference", "tool_choice"),
    "identity": ("identity", "bio", "background", "education", "credential", "experience", "skill", "role"),
    "learning": ("learning", "study", "course", "exam_prep", "knowledge"),
    "project_constraint": ("project_constraint", "architecture_constraint", "security_constraint", "product_constraint"),
    "project_decision": ("project_decision", "architecture_decision", "product_decision", "technical_decision"),
    "goal": ("goal", "priority", "aspiration", "career_direction", "objective"),
    "audit_telemetry": ("test_receipt", "commit_hash", "file_churn", "debug_state", "git_state"),
    "active_state": ("active_work", "project_status", "current_state", "blocker", "task_request", "next_action"),
}
LEGACY_MARKS = CLASS_MARKS | {"active_state": (*CLASS_MARKS["active_state"], "active_project", "project_state", "project_blocker", "project_issue", "project_context", "work_context")}
#: What tells that a fact is about one run of some work and may not be written unseen. Names are fixed values, patterns are not.
EXECUTION_PATTERNS = {
    "pull_request_state": r"(?i)\b(pr|pull request) ?#?\d+\b|\b(not yet|un)merged\b|\bblocked (from|by) merg|\bmerge[- ]blocked\b",
    "branch_state": r"(?i)\b(branch|worktree)\b.*\b(current|dedicated|isolated|feat/|fix/|chore/)|\b(feat|fix|chore)/[\w.-]+",
    "commit_state": r"(?i)\bcommit [0-9a-f]{7,40}\b|\b[0-9a-f]{7,40} commit\b",
    "test_receipt": r"(?i)\b(suite|tests?)\b.{0,48}\b(pass(ed)?|fail(ed)?|green|red|exit code|\d+ ?/ ?\d+)\b",
    "temporary_implementation": r"(?i)\b(actively|currently) (building|debugging|implementing|testing)\b|\blocal development server\b",
    "handoff_state": r"(?i)\b(do not|no) (merge|push|open (a )?pr)\b|\btask-by-task implementation\b",
}


def marked_class(text: Column, marks: Mapping[str, Sequence[str]], tier: Column) -> Column:
    """The first class of which a lower-case text has a mark anywhere; else active_state for current facts, and other."""
    out = F.when(tier == "current", "active_state").otherwise("other")
    for name, words in reversed(marks.items()):
        out = F.when(text.rlike("|".join(words)), name).otherwise(out)
    return out


def with_policy(facts: DataFrame, kind: str, content: str, tier: str, patterns: Mapping[str, str] = EXECUTION_PATTERNS) -> DataFrame:
    """facts with fact_class, policy_reasons (all that hold, in order; none: an empty array) and policy_review_only.

    The class is told by type and content together, the reasons by content, and by the class where that is telemetry. A null
    type or content is empty. No fact is dropped.
    """
    text = F.coalesce(F.col(content), F.lit(""))
    fact_class = marked_class(F.concat_ws(" ", T.key_name(F.coalesce(F.col(kind), F.lit(""))), F.lower(text)), CLASS_MARKS, F.col(tier))
    held = facts.withColumn("fact_class", fact_class)
    why = reasons(**{name: text.rlike(p) for name, p in patterns.items()}, audit_telemetry=F.col("fact_class") == "audit_telemetry")
    return held.withColumn("policy_reasons", why).withColumn("policy_review_only", F.size("policy_reasons") > 0)


def reasons(**conditions: Column) -> Column:
    """The names of the conditions that hold, in order."""
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in conditions.items()), F.lit(None).cast("string")))


def density(df: DataFrame, page: list[str], section: list[str], order: list[str], eligible: Column, page_limit: int, section_limit: int) -> DataFrame:
    """df with density_reasons: rows past a page's or a section's limit, counted in order over the eligible rows."""
    rank = lambda by: F.when(eligible, F.row_number().over(Window.partitionBy(*by, eligible).orderBy(*order)))
    over = lambda by, limit: F.coalesce(rank(by) > limit, F.lit(False))
    return df.withColumn("density_reasons", reasons(run_page_limit=over(page, page_limit), run_section_limit=over(section, section_limit)))


def sampled(df: DataFrame, key: str, percent: int) -> DataFrame:
    """df with bucket (of 100, by a hash of the key) and sampled: the share to look at, the same in every run."""
    bucket = T.hash_bucket(F.col(key).cast("string"))
    return df.withColumns({"bucket": bucket, "sampled": bucket < percent})


def review_bucket(action: Column, confidence: Column) -> Column:
    return F.when(action.isin("supersede", "contradict"), "destructive").when(confidence == "low", "brainstormed").when(confidence == "medium", "uncertain").otherwise("routine")


def enforced(df: DataFrame, policies: DataFrame, vault: str) -> DataFrame:
    """df with needs_review set where its vault is for review only, or a flag of its own asks for it, but for duplicates."""
    joined = df.join(F.broadcast(policies.select(F.col(vault).alias("__v"), "review_only")), F.col(vault) == F.col("__v"), "left")
    forced = (F.coalesce("review_only", F.lit(False)) | F.col("policy_review_only") | F.col("person_review_only")) & (F.col("action") != "duplicate")
    return joined.withColumn("needs_review", F.col("needs_review") | forced).drop("__v", "review_only")


def path_allowed(path: Column, include: Sequence[str], exclude: Sequence[str]) -> Column:
    """Whether a path is under an included prefix (if there are any) and under no excluded one; prefixes end at a slash."""
    under = lambda ps: F.exists(F.array(*map(F.lit, ps)), lambda p: (path == p) | path.startswith(F.concat(p, F.lit("/"))))
    inside = under(include) if include else F.lit(True)
    return inside & ~under(exclude) if exclude else inside


#: Directories and words of file names that mark what isn't a page of record; and states of a page.
ASIDE, CLOSED = ("archive", "archived", "raw", "log", "logs", "draft", "drafts"), ("archived", "completed", "superseded")


def exclusion_reason(path: Column, status: Column) -> Column:
    """Why a page is no destination: a directory, a word of its name, or its status; null if it is one."""
    parts = F.split(path, "/")
    dirs = F.transform(F.slice(parts, 1, F.size(parts) - 1), lambda p: F.lower(F.regexp_replace(p, r"^[ ._-]+|[ ._-]+$", "")))
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]*$", "")
    words = F.regexp_extract_all(F.lower(stem), F.lit("[a-z0-9]+"), F.lit(0))
    aside = F.array(*map(F.lit, ASIDE))
    hit = lambda a: F.array_min(F.array_intersect(a, aside))
    state = F.lower(T.strip(status))
    return F.when(hit(dirs).isNotNull(), F.concat(F.lit("directory: "), hit(dirs))).when(hit(words).isNotNull(), F.concat(F.lit("page type: "), hit(words))).when(state.isin(*CLOSED), F.concat(F.lit("status: "), state))


def content_page(path: Column, excluded: Sequence[str] = ("README.md", "index.md")) -> Column:
    parts = F.split(path, "/")
    return F.lower(path).endswith(".md") & ~F.element_at(parts, -1).isin(*excluded) & ~F.array_contains(parts, "Attachments") & ~F.exists(parts, lambda p: p.startswith("."))


def safe_path(path: Column) -> Column:
    """Relative, without a parent segment or an empty one."""
    return ~path.startswith("/") & ~F.exists(F.split(path, "/"), lambda p: p.isin("..", "."))


#: First words that tell an action or the setting of a sentence, not a name; a caller may give others.
NO_NAMES = (
    "a", "an", "the", "this", "that", "these", "those", "his", "its", "our", "their", "your", "after", "as", "at", "before", "by", "during", "for", "from",
    "in", "on", "to", "when", "while", "with", "without", "next", "added", "began", "built", "configured", "created", "implemented", "made", "met", "moved", "started", "used",
)


def person_span(c: Column, stop: Sequence[str], starters: Sequence[str] = NO_NAMES) -> Column:
    """A Title Case span of two or three words that begins a fact (marks before it aside), if it may be a person's name.

    It isn't if its first word ends with -ing or is a starter, or if that word or the span is on the stop list (any case).
    Names in the middle of a fact don't count.
    """
    span = F.regexp_extract(c, r"^[^\p{L}\p{N}_]*([A-Z][a-z]+(?:\s+[A-Z][a-z]+){1,2})(?![\p{L}\p{N}_])", 1)
    first = F.lower(F.regexp_extract(span, r"^\S+", 0))
    words = {w.lower() for w in (*stop, *starters)}
    return F.when((span != "") & ~first.endswith("ing") & ~first.isin(*words) & ~span_key(span).isin(*(w.lower() for w in stop), ""), span)


def span_key(span: Column) -> Column:
    return F.lower(F.regexp_replace(span, r"\s+", " "))


def roster_match(facts: DataFrame, key: str, text: str, names: DataFrame, most_words: int = 3) -> DataFrame:
    """key, name, vault: the longest name that starts a fact (marks before it aside) and is no possessive there; of equal ones
    the first vault's.

    A name has at most most_words words, so it is one of a fact's first runs of words: a join on equal names.
    """
    starts = facts.select(key, F.lower(text).alias("t")).select(key, F.explode(F.array(*(F.regexp_extract("t", rf"^[^\p{{L}}\p{{N}}_]*((?:\S+\s+){{{n}}}[\w-]+)(?!['’\w-])", 1) for n in range(most_words)))).alias("name")).where("name <> ''").distinct()
    found = starts.join(names.select(F.lower("name").alias("name"), "vault"), "name")
    best = Window.partitionBy(key).orderBy(F.desc(F.length("name")), "name", "vault")
    return found.withColumn("r", F.row_number().over(best)).where("r = 1").drop("r")


def batches(df: DataFrame, order: list[str], size: int, by: list[str]) -> DataFrame:
    """df with position and batch_no (from 1) of `size` rows each, in order, for each group."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")
    return df.withColumn("position", at).withColumn("batch_no", (F.floor((F.col("position") - 1) / size) + 1).cast("long"))


def numbered(df: DataFrame, group: list[str], value: str, order: str, prefix: str = "p") -> DataFrame:
    """df with id: p001, p002 … by a value's first appearance in its group."""
    first = F.min(order).over(Window.partitionBy(*group, value))
    rank = F.dense_rank().over(Window.partitionBy(*group).orderBy("__first", value))
    return df.withColumn("__first", first).withColumn("id", F.concat(F.lit(prefix), F.lpad(rank.cast("string"), 3, "0"))).drop("__first")

"""Pages as arrays of lines: parsing, edits and their undoing, all as expressions on one row."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from .shared import written

#: Rows of an Arrow batch that are held as Python objects at once.
SLICE_ROWS = 256


def front_matter(text: Column) -> Column:
    """The key: value lines between a leading --- and the next one, as a map of lower-case keys (the last of equal ones)."""
    block = F.regexp_extract(text, r"^---\n([\s\S]*?)\n---(?:\n|$)", 1)
    lines = F.filter(F.split(block, "\n"), lambda x: F.contains(x, F.lit(":")))
    entry = lambda x: F.struct(F.lower(T.strip(F.substring_index(x, ":", 1))).alias("key"), T.strip(F.substring(x, F.instr(x, ":") + 1, 1 << 20)).alias("value"))
    pairs = F.transform(lines, entry)
    # Only the last entry of each key is kept, whatever the session's policy for repeated keys.
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def body(text: Column) -> Column:
    return F.regexp_replace(text, r"^---\n[\s\S]*?\n---(?:\n|$)", "")


def outside_fences(text: Column) -> Column:
    """A page's body without its fenced code."""
    return F.regexp_replace(body(text), r"(?m)^(```|~~~)[\s\S]*?(^\1[^\n]*$|\z)", "")


def title(text: Column) -> Column:
    return T.strip(F.regexp_extract(outside_fences(text), r"(?m)^#\s+(.+)$", 1))


def headings(text: Column, most: int = 20) -> Column:
    return F.slice(F.transform(F.regexp_extract_all(outside_fences(text), F.lit(r"(?m)^##\s+(.+)$"), F.lit(1)), T.strip), 1, most)


def overview(text: Column, most: int = 96) -> Column:
    """The first words of the prose before the first second-level heading."""
    before = F.regexp_replace(F.regexp_replace(outside_fences(text), r"(?m)^##\s[\s\S]*\z", ""), r"(?m)^#.*$", "")
    return F.array_join(F.slice(F.array_remove(F.split(T.strip(before), r"\s+"), ""), 1, most), " ")


def wikilinks(text: Column) -> Column:
    """The pages that a text links to, without display names and anchors."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"\[\[([^\]|#]+)"), F.lit(1)), T.strip))


def _section(lines: Column, section: Column) -> tuple[Column, Column]:
    """Where a section's heading stands, and where the next heading or the end is (both from 1)."""
    start = F.array_position(lines, F.concat(F.lit("## "), section))
    after = F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda i: (i > start) & F.element_at(lines, i).rlike("^#{1,2} "))
    return start, F.coalesce(F.array_min(after), F.size(lines) + 1)


def appended(lines: Column, section: Column, line: Column) -> Column:
    """The lines with one more at the end of a section, which is made if it isn't there; nothing changes if the section has it."""
    start, end = _section(lines, section)
    # Blank lines at the section's end stay behind the new line.
    inside = F.slice(lines, F.greatest(start, F.lit(1)), F.greatest(end - start, F.lit(0)))
    trailing = F.aggregate(F.reverse(inside), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), lambda a, x: F.struct(F.when(a["on"] & (T.strip(x) == ""), a["n"] + 1).otherwise(a["n"]).alias("n"), (a["on"] & (T.strip(x) == "")).alias("on")), lambda a: a["n"])
    at = start + F.size(inside) - trailing
    new = F.concat(F.slice(lines, 1, at - 1), F.array(line), F.slice(lines, at, F.size(lines)))
    made = F.concat(lines, F.array(F.lit(""), F.concat(F.lit("## "), section), line))
    return F.when(start == 0, made).when(F.array_contains(inside, line), lines).otherwise(new)


def replaced(lines: Column, old: Column, new: Column) -> Column:
    """The lines with one line for another, if that stands there exactly once."""
    once = F.size(F.filter(lines, lambda x: x == old)) == 1
    return F.when(once, F.transform(lines, lambda x: F.when(x == old, new).otherwise(x))).otherwise(lines)


def removed(lines: Column, line: Column) -> Column:
    once = F.size(F.filter(lines, lambda x: x == line)) == 1
    return F.when(once, F.filter(lines, lambda x: x != line)).otherwise(lines)


def freshened(lines: Column, day: Column) -> Column:
    """The lines with `updated:` in the leading front matter set to a day, or added there; without front matter as they are."""
    end = F.array_min(F.filter(F.sequence(F.lit(1), F.greatest(F.size(lines), F.lit(1))), lambda i: (i > 1) & (F.element_at(lines, i) == "---")))
    has = F.element_at(lines, F.lit(1)) == "---"
    stamp = F.concat(F.lit("updated: "), day)
    head = F.slice(lines, 1, end - 1)
    stamped = F.when(F.exists(head, lambda x: x.startswith("updated:")), F.transform(head, lambda x: F.when(x.startswith("updated:"), stamp).otherwise(x))).otherwise(F.concat(head, F.array(stamp)))
    return F.when(has & end.isNotNull(), F.concat(stamped, F.slice(lines, end, F.size(lines)))).otherwise(lines)


def applied(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """pages (page, lines) after their edits (page, seq, action, section, content, old_content), in order of seq.

    A page's edits are one array on its row and are folded over its lines, so a page and its edits are one task's row.
    """
    listed = edits.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("seq", "action", "section", "content", "old_content"))).alias("edits"))

    def step(lines: Column, e: Column) -> Column:
        return (
            F.when(e["action"] == "append", appended(lines, e["section"], e["content"]))
            .when(e["action"] == "replace", replaced(lines, e["old_content"], e["content"]))
            .when(e["action"] == "remove", removed(lines, e["content"]))
            .otherwise(lines)
        )

    return pages.join(listed, "page", "left").select("page", F.when(F.col("edits").isNull(), F.col("lines")).otherwise(F.aggregate(F.coalesce("edits", F.array().cast(listed.schema["edits"].dataType)), F.col("lines"), step)).alias("lines"))


def undone(pages: DataFrame, log: DataFrame) -> DataFrame:
    """pages with logged edits taken back, the last first: an appended line goes, a replaced one and a removed one return
    (that at the end of its section)."""
    back = log.select(
        "page", (-F.col("seq")).alias("seq"),
        F.create_map(*(F.lit(x) for x in ("append", "remove", "replace", "replace", "remove", "append")))[F.col("action")].alias("action"),
        "section",
        F.when(F.col("action") == "replace", F.col("old_content")).otherwise(F.col("content")).alias("content"),
        F.when(F.col("action") == "replace", F.col("content")).alias("old_content"),
    )
    return applied(pages, back)


#: An edit of a page. `insert` puts content back where it was: before next_line, else behind previous_line, else behind the heading.
EDIT = "seq bigint, action string, section string, content string, old_content string, previous_line string, next_line string"


BLANK, HEADING = " \t\n\x0b\f\r", ("# ", "## ")


def _fault(times: Counter, e: dict) -> str | None:
    """Why an edit doesn't fit the page as it is; None if it does. times: how often each line stands there."""
    action, content, old = e["action"], e["content"], e["old_content"]
    if action not in ("append", "remove", "replace", "insert"):
        return "unknown action"
    if content is None or (action == "replace" and old is None) or (action in ("append", "insert") and e["section"] is None):
        return "incomplete edit"
    if action in ("remove", "replace") and (n := times[old if action == "replace" else content]) != 1:
        return "line stands more than once" if n else "line is gone"
    if (action in ("append", "insert") or (action == "replace" and content != old)) and times[content]:
        return "line is there already"
    if action == "insert" and times[_anchor(times, e)[0]] != 1:
        return "no place to return to"
    return None


def _anchor(times: Counter, e: dict) -> tuple[str, bool]:
    """The line that an insertion is put at, and whether behind it."""
    if e["next_line"] and times[e["next_line"]]:
        return e["next_line"], False
    return e["previous_line"] if e["previous_line"] and times[e["previous_line"]] else "## " + e["section"], True


def _append(lines: list[str], section: str, new: list[str]) -> None:
    """Puts lines at the end of a section that is there, before the blank ones at its end."""
    start = lines.index("## " + section)
    at = next((i for i in range(start + 1, len(lines)) if (lines[i] or "").startswith(HEADING)), len(lines))
    while lines[at - 1] is not None and not lines[at - 1].strip(BLANK):
        at -= 1
    lines[at:at] = new


def fold_edits(lines: list[str], edits: list[dict]) -> tuple[list[str], str | None, int | None]:
    """lines after the edits, and the fault and seq of the first that doesn't fit, where it stops.

    Appends to one section that follow each other go there at once, so a page that gets very many takes time in proportion.
    """
    lines, times, held = list(lines), Counter(lines), []
    for k, e in enumerate(edits):
        fault, section, content = _fault(times, e), e["section"], e["content"]
        if held and (fault or e["action"] != "append" or section != edits[k - 1]["section"]):
            _append(lines, edits[k - 1]["section"], held)
            held = []
        if fault:
            return lines, fault, e["seq"]
        if e["action"] == "append":
            if not times["## " + section]:
                lines += ["", "## " + section]
                times.update(lines[-2:])
            held.append(content)
            times[content] += 1
            # A blank line, or a heading, moves the place where the next one goes.
            if not content.strip(BLANK) or content.startswith(HEADING) or k + 1 == len(edits):
                _append(lines, section, held)
                held = []
        elif e["action"] == "insert":
            anchor, behind = _anchor(times, e)
            lines.insert(lines.index(anchor) + behind, content)
            times[content] += 1
        else:
            old = e["old_content"] if e["action"] == "replace" else content
            at = lines.index(old)
            times[old] -= 1
            lines[at : at + 1] = [content] if e["action"] == "replace" else []
            times[content] += e["action"] == "replace"
    return lines, None, None


def edited_strictly(pages: DataFrame, edits: DataFrame) -> DataFrame:
    """page, lines, fault, seq: pages (page, lines) after their edits (page and EDIT) in order, each of which must fit.

    At the first edit that doesn't, a page stops, with the edit's seq and the fault. Edits of pages that aren't there come as
    rows with null lines. What the pages' faults mean for the others is decided by whole(). A page and its edits are one task's row.
    """
    fields = [f.split()[0] for f in EDIT.split(", ")]
    listed = edits.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("edits"))
    met = pages.select("page", "lines").join(listed, "page", "full_outer").select("page", "lines", "edits")

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for lines, todo in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            out.append((lines, None, None) if todo is None else (None, "no such page", todo[0]["seq"]) if lines is None else fold_edits(lines, todo))
        lines, faults, seqs = zip(*out)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(lines, pa.list_(pa.string())), pa.array(faults, pa.string()), pa.array(seqs, pa.int64())], ["page", "lines", "fault", "seq"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield each(batch.slice(at, SLICE_ROWS))

    return met.mapInArrow(run, f"page {met.schema['page'].dataType.simpleString()}, lines array<string>, fault string, seq bigint")


def whole(pages: DataFrame, edited: DataFrame) -> DataFrame:
    """pages after edited_strictly(), if no page has a fault; else all of them as they were. A single verdict for all pages,
    found at once: the edits are made once and written, and nothing is made again by what reads the result."""
    edited = written(edited)
    fits = edited.where("fault IS NOT NULL").isEmpty()
    return (edited if fits else pages).select("page", "lines")


def reversed_edits(log: DataFrame) -> DataFrame:
    """The edits that take a log's edits back, the last first: what was appended is removed, what was removed inserted where
    it was, what was replaced replaced again."""
    turned = F.create_map(*(F.lit(x) for x in ("append", "remove", "replace", "replace", "remove", "insert")))[F.col("action")]
    swap = F.col("action") == "replace"
    return log.select(
        "page", (-F.col("seq")).alias("seq"), F.coalesce(turned, F.concat(F.lit("undo of "), F.col("action"))).alias("action"), "section",
        F.when(swap, F.col("old_content")).otherwise(F.col("content")).alias("content"), F.when(swap, F.col("content")).alias("old_content"), "previous_line", "next_line",
    )


def replayed_back(pages: DataFrame, log: DataFrame) -> DataFrame:
    """pages as they were before a run's log of edits; if one of its events no longer fits, all pages stay as they are."""
    return whole(pages, edited_strictly(pages, reversed_edits(log)))

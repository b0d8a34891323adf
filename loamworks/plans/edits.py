"""Queries over documents as pages: whole manifests applied, and taken back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pages, reconcile
from ..operators.shared import written
from .registry import query, table

c = F.col
INBOXES = 7


def times(lines, line):
    """How often a line stands among lines. Not by a lambda: what it holds would be made again for each of the lines."""
    return F.size(lines) - F.size(F.array_remove(lines, line))


def cleanup(spark, sf_dir):
    """Documents and inboxes as pages, and a manifest: each document's first line, if it stands there once, and is no other
    document's, is removed, moved to an inbox or rewritten."""
    docs = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), c("doc_id").cast("string")).alias("page"), F.split("text", "\n").alias("lines"), "doc_id")
    boxes = spark.range(INBOXES).select(F.concat(F.lit("in"), c("id").cast("string")).alias("page"), F.array(F.lit("# Inbox"), F.lit("## In")).alias("lines"))
    first = docs.withColumn("content", F.element_at("lines", 1)).where((F.trim("content") != "") & (times(c("lines"), c("content")) == 1) & ~F.contains("content", F.lit("\r")))
    own = first.groupBy("content").agg(F.count("*").alias("n")).where("n = 1").select("content")
    text, k = lambda x: F.lit(x).cast("string"), c("doc_id") % 3
    manifest = first.join(own, "content").select(
        c("doc_id").alias("index"), F.when(k == 0, "remove").when(k == 1, "move").otherwise("rewrite").alias("action"), F.lit("high").alias("confidence"), "page", F.lit("Top").alias("section"), "content",
        F.when(k == 2, F.concat(F.lit("rewritten "), c("doc_id").cast("string"))).alias("new_content"), F.when(k == 1, F.concat(F.lit("in"), (c("doc_id") % INBOXES).cast("string"))).alias("target_page"),
        F.when(k == 1, "In").alias("target_section"), F.array().cast("array<bigint>").alias("depends_on"),
    )
    return docs.select("page", "lines").union(boxes), written(manifest)


_PAGES = f"""d AS (SELECT 'd' || doc_id AS page, string_split(text, chr(10)) AS lines, doc_id, string_split(text, chr(10))[1] AS content FROM documents WHERE text IS NOT NULL),
f AS (SELECT * FROM d WHERE trim(content) <> '' AND len(list_filter(lines, lambda x: x = content)) = 1 AND NOT contains(content, chr(13))), m AS (SELECT * FROM f WHERE content IN (SELECT content FROM f GROUP BY content HAVING count(*) = 1)),
b AS (SELECT 'in' || i AS page, ['# Inbox', '## In'] || coalesce((SELECT list(content ORDER BY doc_id) FROM m WHERE doc_id % 3 = 1 AND doc_id % {INBOXES} = i), []) AS lines FROM range({INBOXES}) t(i)),
a AS (SELECT d.page, CASE WHEN m.page IS NULL THEN d.lines WHEN d.doc_id % 3 = 2 THEN ['rewritten ' || d.doc_id] || d.lines[2:] ELSE d.lines[2:] END AS lines FROM d LEFT JOIN m USING (page) UNION ALL SELECT * FROM b)"""


@query(f"WITH {_PAGES} SELECT page, len(lines)::BIGINT AS n, sha256(array_to_string(lines, chr(10))) AS sha256 FROM a")
def cleanup_applied(spark, sf_dir):
    """The pages after the whole manifest."""
    table_, manifest = cleanup(spark, sf_dir)
    judged = reconcile.judged_cleanup(manifest, table_, bullet="")
    edited = pages.edited_strictly(table_, reconcile.cleanup_edits(judged.where("reason IS NULL").drop("reason"), bullet=""))
    return pages.whole(table_, edited).select("page", F.size("lines").cast("long").alias("n"), F.sha2(F.array_join("lines", "\n"), 256).alias("sha256"))


@query("""WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS lines, text FROM documents WHERE text IS NOT NULL), m AS (SELECT *, lines[(doc_id % len(lines)) + 1] AS line, doc_id % len(lines) AS pos FROM d),
n AS (SELECT *, CASE WHEN pos > 0 THEN lines[pos] END AS one, lines[pos + 2] AS other FROM m),
e AS (SELECT *, len(list_filter(lines, lambda x: x = line)) = 1 AND trim(line) <> '' AND (len(list_filter(lines, lambda x: x = one AND one <> '')) = 1 OR len(list_filter(lines, lambda x: x = other AND other <> '')) = 1) AS edited FROM n)
SELECT doc_id, CASE WHEN edited THEN sha256(array_to_string(list_slice(lines, 1, pos) || list_slice(lines, pos + 2, len(lines)), chr(10))) ELSE sha256(text) END AS removed, sha256(text) AS back FROM e""")
def undo_replayed(spark, sf_dir):
    """A line of each page removed, and the run's log replayed backwards: each returns to its place among its neighbours."""
    d = table(spark, sf_dir, "documents").where("text IS NOT NULL").select(c("doc_id").alias("page"), F.split("text", "\n").alias("lines"))
    at = (c("page") % F.size("lines")).cast("int")
    near = lambda n: F.when((at + n >= 0) & (at + n < F.size("lines")), F.get("lines", at + n))
    # An empty neighbour, or one that stands there more than once, can't be the place to return to.
    once = lambda x: F.when((times(c("lines"), x) == 1) & (x != ""), x)
    log = d.select("page", F.lit(1).cast("bigint").alias("seq"), F.lit("remove").alias("action"), F.lit("Top").alias("section"), F.get("lines", at).alias("content"), F.lit(None).cast("string").alias("old_content"), once(near(-1)).alias("previous_line"), once(near(1)).alias("next_line"), "lines")
    log = log.where((F.trim("content") != "") & (times(c("lines"), c("content")) == 1))
    log = log.where(c("previous_line").isNotNull() | c("next_line").isNotNull()).drop("lines")
    after = pages.whole(d, pages.edited_strictly(d, log))
    back = pages.replayed_back(after, log)
    sha = lambda df, name: df.select(c("page").alias("doc_id"), F.sha2(F.array_join("lines", "\n"), 256).alias(name))
    return sha(after, "removed").join(sha(back, "back"), "doc_id")

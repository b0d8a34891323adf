"""Which transcripts are there and which changed: listings of file metadata, exclusions, cursors on file times, session ids.

Listings never open a file, and cursors are filters on the files' times, so old files are neither listed into a plan's scan
nor read. Only the heads of files that are left are looked at for marks of what isn't a person's conversation.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A folder that holds no person's words, and what says so among a file's first lines.
ASIDE = "/subagents/"
HEAD_LINES, HEAD_MARK = 20, r'"thread_source"\s*:\s*"subagent"'
LISTED = "source string, path string, modified timestamp, bytes bigint"
#: How old files may be where nothing says when a source was last read, and where there are none at all.
FALLBACK_DAYS, OLDEST_DAYS = 7, 5 * 365


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def listing(spark: SparkSession, roots: Mapping[str, str], suffix: str = ".jsonl", since: Mapping[str, datetime.datetime] | None = None) -> DataFrame:
    """source, path, modified, bytes of the files below each source's root, at any depth, from its time in `since` on.

    Only metadata is read. A root that isn't there has no files; what lies in a folder `subagents` is left out.
    """
    out = spark.createDataFrame([], LISTED)
    for source, root in roots.items():
        if not exists(spark, root):
            continue
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*{suffix}").load(root)
        if since and source in since:
            files = files.where(F.col("modificationTime") >= F.lit(since[source]))
        files = files.where(~F.contains("path", F.lit(ASIDE)))
        out = out.union(files.select(F.lit(source), "path", "modificationTime", "length"))
    return out


def marked_heads(spark: SparkSession, paths: list[str], mark: str = HEAD_MARK, lines: int = HEAD_LINES) -> DataFrame:
    """path of the files that have the mark in one of their first lines. Lines are ranked by where their split begins and the
    order they are read in; only a flag of each is kept, and of each file only the first ones leave a task."""
    if not paths:
        return spark.createDataFrame([], "path string")
    read = spark.read.text(paths).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("at"), F.col("value").rlike(mark).alias("hit"))
    first = read.withColumn("line", F.row_number().over(Window.partitionBy("path").orderBy("split", "at"))).where(F.col("line") <= lines)
    return first.where("hit").select("path").distinct()


def window_start(markers: Mapping[str, str | None], source: str, now: datetime.datetime, days: int = FALLBACK_DAYS) -> datetime.datetime:
    """A source's marker (ISO day or epoch seconds, white space aside) as a time in UTC; anything else is so many days before now."""
    text = "".join((markers.get(source) or "").split())
    try:
        if text.isascii() and text.isdigit():
            return datetime.datetime.fromtimestamp(int(text), datetime.UTC)
        if len(text) == 10:
            return datetime.datetime.fromisoformat(text).replace(tzinfo=datetime.UTC)
    except (ValueError, OverflowError, OSError):
        pass
    return now - datetime.timedelta(days=days)


def discovered(spark: SparkSession, roots: Mapping[str, str], markers: Mapping[str, str | None], now: datetime.datetime, since: datetime.datetime | str | None = None, headed: tuple[str, ...] = (), days: int = 7) -> DataFrame:
    """source, path, modified, bytes, batch_no, window_start, window_end: the transcripts that changed, in weekly batches.

    since: None (each source from its marker on), a time for all sources, or "all". Files changed at or after now wait for the
    next run. headed: sources whose transcripts say in their first lines that no person speaks in them. Batches begin with the
    earliest source's start ("all": with the oldest file), and the last one ends now.
    """
    if since is None:
        starts = {s: window_start(markers, s, now) for s in roots}
    elif since == "all":
        oldest = listing(spark, roots).agg(F.min("modified")).first()[0]
        start = oldest.astimezone(datetime.UTC) if oldest else now - datetime.timedelta(days=OLDEST_DAYS)
        starts = dict.fromkeys(roots, start)
    else:
        starts = dict.fromkeys(roots, since)
    files = listing(spark, roots, since=starts).where(F.col("modified") < F.lit(now))
    for source in headed:
        # The driver holds paths of one source's changed files, as a scan of them needs.
        paths = [r.path for r in files.where(F.col("source") == source).select("path").collect()]
        files = files.join(marked_heads(spark, paths), "path", "left_anti").select(*files.columns)
    from ..streaming import incremental  # it uses exists() of this module

    return incremental.in_windows(files, "modified", F.lit(min(starts.values(), default=now)), days, F.lit(now))


def changed_since(df: DataFrame, at: datetime.datetime) -> DataFrame:
    """A file scan limited to files changed at that time or later: a filter on metadata, so others aren't opened."""
    return df.where(F.col("_metadata.file_modification_time") >= F.lit(at))


def depth_below(path: Column, root: str) -> Column:
    """How many folders lie between a root and a file."""
    bare = re.sub("^[A-Za-z0-9+.-]+:/*", "/", root).rstrip("/") + "/"
    return F.size(F.split(F.regexp_replace(path, f"^.*?{re.escape(bare)}", ""), "/")) - 1


def session_files(spark: SparkSession, roots: list[str], depth: int = 6) -> DataFrame:
    """id, path, modified of the session transcripts below several roots (settings folders), the latest of an id that has several.

    A session's file is named by its UUID; roots that aren't there are passed over, files deeper than `depth` left out.
    """
    found = spark.createDataFrame([], "id string, path string, modified timestamp")
    for root in dict.fromkeys(roots):
        files = listing(spark, {"": root}).where(depth_below(F.col("path"), root) <= depth)
        uuid = F.lower(F.regexp_extract("path", r"(?i)/([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})\.jsonl$", 1))
        found = found.union(files.select(uuid, "path", "modified"))
    latest = F.max_by(F.struct("path", "modified"), F.struct("modified", "path")).alias("f")
    return found.where("id <> ''").groupBy("id").agg(latest).select("id", "f.*")

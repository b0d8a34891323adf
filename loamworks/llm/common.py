"""What the corpus operators share: text columns, shared tables, Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that the contracts name: space and U+0009 to U+000D.
SPACE = r"[\x20\x09-\x0D]"
NOT_SPACE = r"[^\x20\x09-\x0D]"
#: A key is hot if it has more than so many rows and more than one of so many parts of all rows: fewer than HOT_PARTS keys can be.
HOT_ROWS, HOT_PARTS = 256, 1024
#: Rows of an Arrow batch that are held as Python objects at once.
SLICE_ROWS = 256


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator reads, under names of its own; a null text is empty.

    Whatever else the input has, also under the names of an operator's results, can't clash with them.
    """
    return df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))


def shared_dir(spark: SparkSession) -> str:
    """A new folder below the one that all executors share (spark.checkpoint.dir).

    Only where that setting is absent and all runs in one process (local tests), a folder of this machine is set; on a
    cluster without a shared folder this raises ValueError.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        base = current.get() if current.isDefined() else None
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = tempfile.mkdtemp(prefix="spark-loam-", dir="/tmp")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/loam-{uuid.uuid4().hex}"


def stored(df: DataFrame, at: str | None = None, codec: str | None = None) -> DataFrame:
    """df written to the shared folder and read again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = at or shared_dir(spark)
    df.write.mode("overwrite").parquet(path, compression=codec)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Delete the files of a table made by stored(), once nothing reads it any more."""
    for name in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(rows: DataFrame, key: str, hot_rows: int = HOT_ROWS, hot_parts: int = HOT_PARTS) -> DataFrame | None:
    """key, __parts: the keys with more rows than the limit, and how many parts bring each below it, to be broadcast (none: None).

    Fewer than hot_parts keys can have so many rows, so that few come to the driver.
    """
    limit = max(hot_rows, rows.count() // hot_parts)
    hot = rows.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") > limit)
    hot = hot.select(key, F.ceil(F.col("count") / limit).cast("int").alias("__parts"))
    known = hot.collect()
    return F.broadcast(rows.sparkSession.createDataFrame(known, hot.schema)) if known else None


def spread_join(rows: DataFrame, table: DataFrame, key: str, counted: DataFrame | None = None, hot_rows: int = HOT_ROWS, hot_parts: int = HOT_PARTS) -> DataFrame:
    """rows joined with table on key (inner), a hot key's rows dealt over many tasks.

    The keys of counted are counted first: a stored table with some of rows' columns and all of its rows (None: rows itself);
    table has one row for each key. The rows of a hot key take one of as many numbers as bring each below the limit, by a
    hash of counted's columns, and the key's row of table is repeated for each number. Only hot keys are broadcast. Null keys meet nothing.
    """
    counted = rows if counted is None else counted
    parts = hot_keys(counted, key, hot_rows, hot_parts)
    if parts is None:
        return rows.join(table, key)
    dealt = rows.join(parts, key, "left").withColumn("__part", F.coalesce(F.pmod(F.xxhash64(*(F.col(f"`{c}`") for c in counted.columns)), "__parts"), F.lit(0)).cast("int"))
    repeated = table.join(parts, key, "left").withColumn("__part", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1)))
    return dealt.drop("__parts").join(repeated.drop("__parts"), [key, "__part"]).drop("__part")


#: Rows of an Arrow batch where nothing else is set; with texts of some kilobytes, batches of ten thousand take hundreds of megabytes.
BATCH_ROWS, BATCH_SETTING = 1000, "spark.sql.execution.arrow.maxRecordsPerBatch"


def bounded_batches(spark: SparkSession) -> None:
    """Arrow batches of BATCH_ROWS rows in this session, if it has no setting of its own."""
    if spark.conf.get(BATCH_SETTING, None) is None:
        spark.conf.set(BATCH_SETTING, str(BATCH_ROWS))


def by_slices(each: Callable[[pa.RecordBatch], pa.RecordBatch], rows: int = SLICE_ROWS):
    """A function for mapInArrow: each() gets a few rows at a time, so that few texts are Python objects at once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                yield each(batch.slice(at, rows))

    return run

"""Tables of generations: each commit is a new folder, and a log of numbered files says which folder counts.

A log file is made only where none of its number is (all of it or nothing), so readers see the old generation or the new one,
and of two writers that began from the same generation one fails. Nothing that a reader may hold is ever written over.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsc.hadoopConfiguration())


def publish(spark: SparkSession, path: str, content: str) -> None:
    """A small file with this content; FileExistsError if there is one. It appears whole: written beside, then moved there."""
    at, fs = _path(spark, path)
    beside, _ = _path(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(beside, False)
    out.write(bytearray(content.encode()))
    out.close()
    done = False
    try:
        if not fs.exists(at):
            spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark._jsc.hadoopConfiguration()).rename(beside, at, spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 0))
            done = True
    except Exception as e:  # the file system's own "already exists"
        if "AlreadyExists" not in str(e):
            raise
    finally:
        if not done:
            fs.delete(beside, False)
    if not done:
        raise FileExistsError(path)


def _log(spark: SparkSession, base: str) -> dict[int, str]:
    folder, fs = _path(spark, f"{base}/_log")
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return {int(n.removesuffix(".json")): f"{base}/_log/{n}" for n in names if n.endswith(".json")}


def latest(spark: SparkSession, base: str) -> int | None:
    """The number of the generation that counts; None before the first."""
    return max(_log(spark, base), default=None)


def entry(spark: SparkSession, base: str, generation: int | None = None) -> dict:
    """A generation's log entry: folder, and what its writer said of it. By default the latest one's."""
    log = _log(spark, base)
    number = max(log, default=None) if generation is None else generation
    if number not in log:
        raise FileNotFoundError(f"{base}: no generation {number}")
    return json.loads(spark.read.text(log[number], wholetext=True).first()[0])


def read(spark: SparkSession, base: str, generation: int | None = None) -> DataFrame:
    """The rows of a generation, by default of the latest one."""
    return spark.read.parquet(f"{base}/{entry(spark, base, generation)['folder']}")


def commit(spark: SparkSession, df: DataFrame, base: str, after: int | None, note: dict | None = None) -> int:
    """Writes df as the generation that follows `after` (None: the first) and returns its number.

    If the write fails, or another writer was first (FileExistsError), the latest generation stays what it was.
    """
    number, folder = 1 if after is None else after + 1, f"rows-{uuid.uuid4().hex}"
    at, fs = _path(spark, f"{base}/{folder}")
    try:
        df.write.parquet(f"{base}/{folder}")
        publish(spark, f"{base}/_log/{number:08d}.json", json.dumps({"folder": folder, **(note or {})}))
    except Exception:
        fs.delete(at, True)
        raise
    return number


def roll_back(spark: SparkSession, base: str, to: int) -> int:
    """A new generation that has the rows of an older one (no row is copied); its number."""
    now, old = latest(spark, base), entry(spark, base, to)
    publish(spark, f"{base}/_log/{now + 1:08d}.json", json.dumps({"folder": old["folder"], "rolled_back_to": to}))
    return now + 1


def digest(df: DataFrame) -> str:
    """Of a table's rows, in any order and however they lie in files: equal tables have equal ones (128 bits and the count)."""
    row = F.struct(*(F.col(f"`{c}`") for c in sorted(df.columns)))
    sums = df.select(F.xxhash64(F.lit(1), row).alias("a"), F.xxhash64(F.lit(2), row).alias("b"))
    r = sums.agg(F.count("*").alias("n"), *(F.coalesce(F.sum(F.col(c).cast("decimal(38,0)")), F.lit(0)).alias(c) for c in "ab")).first()
    return f"{r.n:x}-{int(r.a) % (1 << 64):016x}{int(r.b) % (1 << 64):016x}"


def back_up(spark: SparkSession, df: DataFrame, base: str, run: str) -> str:
    """Copies a table under its digest, once for equal ones, and leaves a receipt for the run; the digest.

    A run has one receipt: a second backup under its name is refused (FileExistsError), before anything is copied.
    """
    receipt, fs = _path(spark, f"{base}/receipts/{run}.json")
    if fs.exists(receipt):
        raise FileExistsError(f"{base}: run {run} has a backup")
    name = digest(df)
    if not fs.exists(_path(spark, f"{base}/content/{name}/_SUCCESS")[0]):
        beside = f"{base}/content/.{name}.{uuid.uuid4().hex}"
        df.write.parquet(beside)
        fs.delete(_path(spark, f"{base}/content/{name}")[0], True)
        if not fs.rename(_path(spark, beside)[0], _path(spark, f"{base}/content/{name}")[0]):
            raise OSError(f"{base}: backup {name} can't be put in place")
    publish(spark, f"{base}/receipts/{run}.json", json.dumps({"run": run, "digest": name}))
    return name


def restored(spark: SparkSession, base: str, run: str) -> DataFrame:
    """The rows that a run backed up, checked against their digest; not after the run's log was retired."""
    if _path(spark, f"{base}/retired/{run}.json")[1].exists(_path(spark, f"{base}/retired/{run}.json")[0]):
        raise FileNotFoundError(f"{base}: run {run} is retired")
    name = json.loads(spark.read.text(f"{base}/receipts/{run}.json", wholetext=True).first()[0])["digest"]
    df = spark.read.parquet(f"{base}/content/{name}")
    if digest(df) != name:
        raise OSError(f"{base}: backup {name} has changed")
    return df


def retire(spark: SparkSession, base: str, run: str) -> None:
    """Marks a run's backup as used up: it can't be restored again, nor retired twice (FileExistsError)."""
    json.loads(spark.read.text(f"{base}/receipts/{run}.json", wholetext=True).first()[0])
    publish(spark, f"{base}/retired/{run}.json", json.dumps({"run": run}))

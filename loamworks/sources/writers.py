"""Writers: documents as JSON and Markdown, units as text files, tables swapped in once they are whole."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def json_document(df: DataFrame, path: str) -> None:
    """A table of a few rows as JSON lines with sorted keys, in one file."""
    df.select(F.to_json(F.struct(*sorted(df.columns))).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def markdown_table(df: DataFrame, title: str, order: list[str]) -> DataFrame:
    """One row, text: a heading and a line for each row of a small table, in order."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns)), F.lit(" |"))
    head = f"# {title}\n\n| {' | '.join(df.columns)} |\n|{'---|' * len(df.columns)}\n"
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(*(F.col(c) for c in order), cells.alias("__line")))), lambda r: r["__line"]), "\n")
    return df.agg(F.concat(F.lit(head), rows).alias("text"))


def unit_files(units: DataFrame, by: str, text: str, path: str) -> None:
    """A folder of text files for each unit; a unit's rows are written by one task."""
    units.select(by, text).repartition(by).write.mode("overwrite").partitionBy(by).text(path)


def swapped(spark: SparkSession, df: DataFrame, path: str) -> None:
    """Write a table beside its place and move it there when it is whole, so that it may be made from what it replaces."""
    fs_path = spark._jvm.org.apache.hadoop.fs.Path
    fs = fs_path(path).getFileSystem(spark._jsc.hadoopConfiguration())
    mark = uuid.uuid4().hex
    df.write.parquet(f"{path}.{mark}.new")
    if fs.exists(fs_path(path)):
        fs.rename(fs_path(path), fs_path(f"{path}.{mark}.old"))
    fs.rename(fs_path(f"{path}.{mark}.new"), fs_path(path))
    fs.delete(fs_path(f"{path}.{mark}.old"), True)

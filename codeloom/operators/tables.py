"""Writes to tables as functions from frames to frames, and their storage.

A frame's rows are immutable, so an insert, a patch or a delete gives the
table's next rows; `replace` stores them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.operators.resolve import first_by


class NoFieldsToUpdate(ValueError):
    """An update that names no field."""


def insert(table: DataFrame, rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """table with the rows whose key it has not; of rows with one key the first by order."""
    new = first_by(rows, key, [F.col(order)]).join(table.select(*key), key, "left_anti")
    return table.unionByName(new.select(*table.columns))


def patch(table: DataFrame, patches: DataFrame, key: str, order: str) -> DataFrame:
    """table with the patches' fields where they aren't null; a later patch wins, field by field."""
    fields = [c for c in patches.columns if c not in (key, order)]
    if not fields:
        raise NoFieldsToUpdate("no fields to update")
    newest = patches.groupBy(key).agg(*(F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order))).alias(f"_{c}") for c in fields))
    merged = table.join(newest, key, "left")
    return merged.select(*(F.coalesce(f"_{c}", c).alias(c) if c in fields else F.col(c) for c in table.columns))


def delete(table: DataFrame, keys: DataFrame, key: str | list[str]) -> DataFrame:
    return table.join(keys, key, "left_anti")


def cascade(root: DataFrame, gone: DataFrame, key: str, children: dict[str, tuple[DataFrame, str]]) -> dict[str, DataFrame]:
    """The root table and its children, by name with their parent's column, without what hangs on the gone keys."""
    left = {"root": root.join(gone, key, "left_anti")}
    for name, (child, column) in children.items():
        left[name] = child.join(gone.select(F.col(key).alias(column)), column, "left_anti")
    return left


def migrate(table: DataFrame, columns: dict[str, str]) -> DataFrame:
    """table with the columns that it lacks, as nulls."""
    return table.withColumns({c: F.lit(None).cast(t) for c, t in columns.items() if c not in table.columns})


def verify(tables: dict[str, DataFrame], wanted: dict[str, list[str]]) -> list[str]:
    """What is missing: tables, and columns of those that are there."""
    missing = [t for t in wanted if t not in tables]
    return missing + [f"{t}.{c}" for t, cs in wanted.items() if t in tables for c in cs if c not in tables[t].columns]


def replace(table: DataFrame, path: str, partition_by: list[str] | None = None) -> DataFrame:
    """Stores a table's rows: written beside it first, then put in its place, so a failure leaves the old rows."""
    spark = table.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    target, staged, old = (jvm.org.apache.hadoop.fs.Path(path + x) for x in ("", ".staged", ".old"))
    fs = target.getFileSystem(conf)
    writer = table.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(staged.toString())
    fs.delete(old, True)
    if fs.exists(target):
        fs.rename(target, old)
    fs.rename(staged, target)
    fs.delete(old, True)
    return spark.read.parquet(path)


def markdown(insights: DataFrame, most: int = 50) -> DataFrame:
    """kind and report of insights (kind, severity, entity): a heading, at most so many entities, and how many more there are."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy("kind").orderBy("entity"))
    ranked = insights.withColumn("place", place)
    kept = F.sort_array(F.collect_list(F.when(F.col("place") <= most, F.struct("place", F.concat(F.lit("- "), F.col("entity")).alias("line")))))
    by = ranked.groupBy("kind").agg(F.max("severity").alias("severity"), F.count("*").alias("n"), F.transform(kept, lambda s: s["line"]).alias("lines"))
    more = F.when(F.col("n") > most, F.concat(F.lit("\n+"), (F.col("n") - most).cast("string"), F.lit(" more"))).otherwise("")
    return by.select("kind", F.concat(F.lit("## "), "kind", F.lit(" ("), "severity", F.lit(")\n"), F.array_join("lines", "\n"), more).alias("report"))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)

"""analyze: source files of a folder in, modules, metrics, findings and the analyzers' status out as Parquet."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from codeloom.operators import pipeline
from codeloom.sources import files


def main(given: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="codeloom")
    commands = parser.add_subparsers(required=True)
    analyze = commands.add_parser("analyze", help="analyze the source files below a folder")
    analyze.add_argument("dir", help="folder or store that Spark can read")
    analyze.add_argument("-o", "--output", default="codeloom-out", help="folder to write to")
    analyze.add_argument("--no-reset", action="store_true", help="append to what is there")
    analyze.add_argument("--analyzers", default="", help="names with commas; all unless given")
    analyze.add_argument("--disable", default="", help="names with commas")
    options = parser.parse_args(given)

    spark = spark or SparkSession.builder.appName("codeloom").getOrCreate()
    modules = files.source_files(spark, options.dir).selectExpr("relative_path as doc_id", "relative_path", "text")
    chosen = lambda text: tuple(x.strip() for x in text.split(",") if x.strip())
    buckets, status = pipeline.run_buckets(spark, modules, disabled=chosen(options.disable), allowed=chosen(options.analyzers))
    mode = "append" if options.no_reset else "overwrite"
    for name, frame in {"modules": modules.drop("doc_id"), "status": status, **buckets}.items():
        frame.write.mode(mode).parquet(f"{options.output.rstrip('/')}/{name}.parquet")


if __name__ == "__main__":
    main()

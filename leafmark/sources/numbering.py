"""Line numbers of text files that are read in splits: no file is ever one row, or in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.operators.tables import join_checked, written


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """doc_id (the file), line (from 1, in the order of the file) and value of every line of the files at `path`.

    A first pass counts the lines of each split; its place in the file gives the lines before it. A second pass adds
    each line's place in its split, and no line is shuffled: the splits are joined, a narrow row each. Ids grow by one
    along a split, so a second pass over other splits can't go unseen: it is an error. Lines end with a line feed; the
    last line end of a file begins no further line.
    """
    block, file = F.col("_metadata.file_block_start"), F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    lines = spark.read.option("lineSep", "\n").text(path).select(file.alias("doc_id"), block.alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    counts = lines.groupBy("doc_id", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("doc_id").orderBy("block")) - F.col("n")
    splits = written(counts.withColumn("before", before), "splits")
    placed = join_checked(lines, splits, ["doc_id", "block"], "left")
    at = F.col("id") - F.col("first")
    same = F.coalesce((at >= 0) & (at < F.col("n")), F.lit(False))
    return placed.select("doc_id", F.when(same, F.col("before") + at + 1).otherwise(F.raise_error(F.concat(F.lit("splits have changed between two passes over "), "doc_id"))).cast("long").alias("line"), "value")

"""Word dumps that arrive in a folder become Markdown as they come.

A dump file holds a whole document, and Spark's file source gives a file to exactly one micro-batch. So heights and
levels, which need all of a document, are known within the batch, and no state is kept between batches.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leafmark import api
from leafmark.operators.analysis import render_markdown
from leafmark.sources.layout import WORD


NEEDED = ("page", "text", "x", "y", "w", "h")


def stream_lines(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Every line of dumps as they arrive: doc_id (the file), idx (the line, from 0), line, and the word's columns, null
    where they aren't such. A dump bounds the memory of a row."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", files_per_batch).load(path)
    lines = raw.select(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B"))).alias("doc_id"), F.posexplode(F.split("value", "\n")).alias("idx", "line"))
    return lines.where(r"line rlike '\\S'").withColumn("w", F.from_json("line", WORD, {"mode": "PERMISSIVE"})).select("doc_id", "idx", "line", "w.*")


def stream_words(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """The words of stream_lines(): doc_id, idx, page, text, x, y, w, h, confidence."""
    return stream_lines(spark, path, files_per_batch).where(" and ".join(f"{c} is not null" for c in NEEDED)).drop("line")


def start(spark: SparkSession, path: str, out: str, checkpoint: str, options: api.Options | None = None, quarantine: str | None = None, **trigger) -> StreamingQuery:
    """Writes doc_id, markdown of each document below `out`, in a folder a batch, so that a batch run again replaces its own.

    quarantine: a folder that gets, likewise a batch at a time, the lines that aren't words (doc_id, idx, line, lacks:
    the columns missing) below lines/ and each document's number of words and of such lines (doc_id, words, bad) below
    counts/; blank lines don't count. A document of bad lines alone is counted, but has no Markdown.
    """
    sound = F.lit(True)
    for c in NEEDED:
        sound = sound & F.col(c).isNotNull()

    def write(batch: DataFrame, number: int) -> None:
        if quarantine:
            batch = batch.persist()  # read for the lines, the counts and the words
            lacks = F.array_compact(F.array(*[F.when(F.col(c).isNull(), c) for c in NEEDED]))
            batch.where(~sound).select("doc_id", "idx", "line", lacks.alias("lacks")).write.mode("overwrite").parquet(f"{quarantine}/lines/batch={number}")
            batch.groupBy("doc_id").agg(F.count_if(sound).alias("words"), F.count_if(~sound).alias("bad")).write.mode("overwrite").parquet(f"{quarantine}/counts/batch={number}")
        render_markdown(api.analyze_words(batch.where(sound).drop("line"), options)).write.mode("overwrite").parquet(f"{out}/batch={number}")
        if quarantine:
            batch.unpersist()

    return stream_lines(spark, path).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

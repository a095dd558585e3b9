"""Tables that are written once and read several times, in the folder that all executors share, and joins with small tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast after it has been counted.
BROADCAST_ROWS = 500_000
#: Bytes of text whose words are a task's: a word in a sort takes some twenty times its text.
TASK_BYTES = 4_000_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, one of our own in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="leafmark-shared-")
    spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext.getCheckpointDir() or at


def shared_path(spark: SparkSession, what: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder: a lost executor costs no recomputation of what lies before, and each use
    reads only the columns it needs."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with `small` (a few narrow columns, already written): broadcast if it has at most `rows` rows, else shuffled."""
    few = small.limit(rows + 1).count() <= rows
    return big.join(F.broadcast(small) if few else small, on, how)


def by_text(rows: DataFrame, docs: DataFrame, *keys: str) -> DataFrame:
    """The rows by keys, into as many partitions as the texts of docs ask for: they aren't merged by their own size, which
    their words multiply, so a task's memory doesn't grow with the table."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return rows.repartition(max(docs.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_BYTES)), *keys)


def of_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    """The rows of pages (doc_id, page; already written): looked up in a table of the pages, so the rows aren't sorted for it."""
    few = pages.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    return rows.join(F.broadcast(pages) if few else pages.hint("shuffle_hash"), ["doc_id", "page"], "left_semi")

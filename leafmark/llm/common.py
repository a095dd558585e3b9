"""What the operators share: cutting lineage, size-checked broadcasts, streamed groups, block pairs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join may be broadcast after it has been counted.
BROADCAST_ROWS = 500_000


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, one of our own in local mode, else an error."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at
    known = spark.sparkContext.getCheckpointDir()
    if known:
        return known
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    at = "file://" + tempfile.mkdtemp(prefix="leafmark-shared-")
    spark.sparkContext.setCheckpointDir(at)
    return spark.sparkContext.getCheckpointDir() or at


def shared_path(spark: SparkSession, what: str) -> str:
    """A path of its own below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """The same rows read back from the shared folder, so that a lost executor costs no recomputation of what lies before."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def join_checked(big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", rows: int = BROADCAST_ROWS) -> DataFrame:
    """Join with `small` (a few narrow columns, already cut): broadcast if it has at most `rows` rows, else shuffled."""
    few = small.limit(rows + 1).count() <= rows
    return big.join(F.broadcast(small) if few else small, on, how)


def unused(columns: list[str], name: str) -> str:
    """A column name like `name` that none of `columns` has, whatever the case of letters."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def join_salted(big: DataFrame, keyed: DataFrame, on: list[str], n: str = "n", how: str = "inner") -> DataFrame:
    """Shuffled join of `big` with `keyed` (one row a key, already cut; column `n`: rows of `big` with it, or more).

    A key of more than 1,000 rows, and more than a 100,000th of all, is dealt to as many tasks as it has such shares;
    so the hot keys are at most 100,000, and only these are broadcast. Columns but `n` come along.
    """
    share = max(1000, int(keyed.agg(F.sum(n)).first()[0] or 0) // 100_000)
    hot = cut(keyed.where(F.col(n) > share).select(*on, F.ceil(F.col(n) / F.lit(share)).cast("int").alias("shares_")))
    if hot.isEmpty():
        return big.join(keyed.drop(n), on, how)
    salted = big.join(F.broadcast(hot), on, "left").withColumn("salt_", F.coalesce(F.pmod(F.xxhash64(*big.columns), F.col("shares_")).cast("int"), F.lit(0)))
    shares = F.greatest(F.lit(1), F.ceil(F.when(F.col(n) > share, F.col(n)).otherwise(F.lit(0)) / F.lit(share))).cast("int")
    return salted.join(keyed.withColumn("salt_", F.explode(F.sequence(F.lit(0), shares - 1))).drop(n), [*on, "salt_"], how).drop("shares_", "salt_")


def written(df: DataFrame, what: str) -> DataFrame:
    """The rows as a table in the shared folder, of which each later use reads only the columns it needs."""
    path = shared_path(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def whole_groups(batches: Iterable[pd.DataFrame], keys: list[str]) -> Iterator[pd.DataFrame]:
    """Frames that hold whole groups only, from batches of a partition sorted by `keys`; keeps one group at most."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        last = (batch[keys] == batch[keys].iloc[-1]).all(axis=1).to_numpy()
        begin = len(batch) - int(last[::-1].argmin()) if not last.all() else 0
        if begin == 0 and rest and (rest[-1][keys].iloc[-1] == batch[keys].iloc[-1]).all():
            rest.append(batch)
            continue
        done = pd.concat([*rest, batch.iloc[:begin]], ignore_index=True) if rest or begin else batch.iloc[:0]
        rest = [batch.iloc[begin:]]
        if len(done):
            yield done
    if rest:
        yield pd.concat(rest, ignore_index=True)


def group_bounds(frame: pd.DataFrame, keys: list[str]) -> list[tuple[int, int]]:
    """Begin and end of every run of equal keys."""
    change = (frame[keys] != frame[keys].shift()).any(axis=1).to_numpy().nonzero()[0].tolist()
    return list(zip(change, [*change[1:], len(frame)], strict=True))


def in_block_pairs(df: DataFrame, group: str, member: str, size: str, block: int) -> DataFrame:
    """Deal groups of any size to tasks of bounded size: adds `blk`, `bi`, `bj`.

    A group of n rows has ceil(n / block) blocks; every unordered pair of blocks, a block with itself included, is
    one unit of work, so each pair of members meets in exactly one unit: (bi, bj) with bi <= bj being their blocks.
    """
    n = F.ceil(F.col(size) / F.lit(block)).cast("int")
    blk = F.pmod(F.xxhash64(F.lit(77), F.col(member)), n).cast("int")
    return (
        df.withColumn("nb", n)
        .withColumn("blk", blk)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
        .withColumn("bi", F.least("blk", "other"))
        .withColumn("bj", F.greatest("blk", "other"))
        .drop("other", "nb")
    )

"""Mixing sources to target weights by cube-method balanced sampling.

A document of a source with target t and total size s is to be taken t / s times on average: the whole part for sure,
the fraction by a balanced sample. The cube method moves the vector of fractions through the null space of the
balance constraints (documents taken, words taken) until all but a few are 0 or 1. Here it runs in blocks of bounded
size; what a block leaves open goes to the next level, until a source has one
block, which ends in a small landing problem.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm.common import cut, group_bounds, join_checked, unused, whole_groups

WEIGHTS = (5.0, 2.0, 1.0)
#: Units of a source that are left to the landing, besides the two the flight leaves.
LANDING = 10
UNIT = "rank int, doc_id long, size long, n long, whole int, pi double"


def token_count(text):
    """Runs of characters other than ASCII white space (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, size) rows -> rank, source, source_size, target: one row for each source, in code point order, null last.

    Water-filling: targets are in proportion to the weights but stop at `most` times their source's size; what is cut
    off goes to the others by weight. With sources ordered by the level at which they stop, the level is found by
    running sums, in one pass. share must be at most `most`. A source of size 0 has target 0.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = per.withColumn("rank", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1)
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    w = ranked.withColumn("weight", F.element_at(cycle, (F.col("rank") % len(weights) + 1).cast("int"))).withColumn("stop", F.lit(most) * F.col("source_size") / F.col("weight"))
    before = Window.orderBy("stop", "rank").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    levels = (
        w.withColumn("filled", F.coalesce(F.sum("source_size").over(before), F.lit(0)) * F.lit(most))
        .withColumn("left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("all", F.sum("source_size").over(everything) * F.lit(share))
        .withColumn("level", (F.col("all") - F.col("filled")) / F.col("left"))
        .withColumn("level", F.min(F.when(F.col("level") <= F.col("stop"), F.struct("stop", "rank", "level"))).over(everything)["level"])
    )
    return levels.select(
        "rank", "source", "source_size",
        F.when(F.col("source_size") == 0, F.lit(0.0)).otherwise(F.least(F.lit(most) * F.col("source_size"), F.coalesce("level", F.lit(float("inf"))) * F.col("weight"))).cast("double").alias("target"),
    )


def flight(size: np.ndarray, n: np.ndarray, pi: np.ndarray, draw: np.ndarray, land: bool) -> np.ndarray:
    """Fractions after the flight phase; at most two of them stay open, and with `land` none.

    With `land`, LANDING units spread over all sizes sit the flight out; they and the two it leaves are the landing
    problem, of which every choice is tried.

    Three open units at a time move along the one direction that keeps both sums, of n * pi (documents) and of
    size * pi (words), until one is 0 or 1; of the two points so reached one is drawn so that expectations hold.
    """
    pi = pi.copy()
    open_: list[int] = []
    aside: list[int] = []
    if land:
        by_size = np.argsort(size, kind="stable")
        aside = sorted(set(by_size[np.linspace(0, len(pi) - 1, min(LANDING, len(pi))).astype(int)].tolist())) if len(pi) else []
    held = set(aside)
    for i in range(len(pi)):
        if i in held:
            continue
        if pi[i] <= 1e-9 or pi[i] >= 1 - 1e-9:
            pi[i] = round(pi[i])
            continue
        open_.append(i)
        while len(open_) == 3:
            a, b, c = open_
            u = (n[b] * size[c] - n[c] * size[b], n[c] * size[a] - n[a] * size[c], n[a] * size[b] - n[b] * size[a])
            if not any(u):
                u = (n[b], -n[a], 0.0)
            _move(pi, open_, u, draw[i])
            open_ = [k for k in open_ if 0 < pi[k] < 1]
    if land:
        last = np.array([*open_, *aside], dtype=np.int64)
        last = last[(pi[last] > 0) & (pi[last] < 1)]
        pi[last] = _land(size[last], n[last], pi[last])
    return pi


def _land(size: np.ndarray, n: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """The choice of 0 and 1 for a few units that comes nearest to their expected words, then to their documents."""
    if not len(pi):
        return pi
    choices = (np.arange(1 << len(pi))[:, None] >> np.arange(len(pi)) & 1).astype(np.float64)
    words, docs = np.abs((choices - pi) @ size), np.abs((choices - pi) @ n)
    return choices[np.lexsort((docs, np.round(words + 0.5 * docs, 6)))[0]]


def _move(pi: np.ndarray, units: list[int], u: tuple, draw: float) -> None:
    up = min((1 - pi[k]) / x if x > 0 else -pi[k] / x for k, x in zip(units, u, strict=True) if x)
    down = min(pi[k] / x if x > 0 else (pi[k] - 1) / x for k, x in zip(units, u, strict=True) if x)
    step = up if draw * (up + down) < down else -down
    for k, x in zip(units, u, strict=True):
        v = pi[k] + step * x
        pi[k] = 0.0 if v < 1e-9 else 1.0 if v > 1 - 1e-9 else v


def _fly(level: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in whole_groups(batches, ["rank", "blk"]):
            for a, b in group_bounds(frame, ["rank", "blk"]):
                g = frame.iloc[a:b]
                n, size = g["n"].to_numpy(np.float64), g["size"].to_numpy(np.float64)
                rng = np.random.default_rng([seed, level, int(g["rank"].iloc[0]) + 1, int(g["blk"].iloc[0])])
                pi = flight(size * n, n, g["pi"].to_numpy(np.float64), rng.random(b - a), bool(g["one"].iloc[0]))
                yield pd.DataFrame({"rank": g["rank"], "doc_id": g["doc_id"].astype("Int64"), "size": g["size"], "n": g["n"], "whole": g["whole"], "pi": pi})

    return run


def mix_plan(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block: int = 4096, seed: int = 7) -> DataFrame:
    """(doc_id, source, size) rows -> distinct (doc_id, source, size) with source_size, target, copies: how often each is taken.

    Rows alike in all three share one decision, each being taken `copies` times; so do rows with null doc_ids. Copies
    are the whole or next higher number of target / source_size, so never above `most`. Each level deals the open units of
    a source to blocks of about `block`; each block is one task's group and leaves two open at most. Draws depend on
    seed, level, source and block alone, and units are ordered by a hash of their values: reruns agree.
    A source of size 0 has copies 0. An empty table gives an empty plan.
    """
    sized = sized.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.coalesce(F.col("size"), F.lit(0)).cast("long").alias("size"))
    units = cut(sized.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = cut(source_targets(units.select("source", (F.col("size") * F.col("n")).alias("size")), weights, share, most))
    named = targets.select(F.coalesce("source", F.lit("")).alias("s"), F.col("source").isNull().alias("no_source"), "rank", "source_size", "target")
    times = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    ready = join_checked(
        units.withColumn("s", F.coalesce("source", F.lit(""))).withColumn("no_source", F.col("source").isNull()), named, ["s", "no_source"]
    ).withColumn("times", times)
    work = ready.select("rank", "doc_id", "size", "n", F.floor(F.col("times") + 1e-12).cast("int").alias("whole"), F.greatest(F.lit(0.0), F.col("times") - F.floor(F.col("times") + 1e-12)).alias("pi"))
    settled: list[DataFrame] = []
    level = 0
    while True:
        shifting = (F.col("pi") > 1e-9) & (F.col("pi") < 1 - 1e-9)
        still = work.where(shifting)
        count = cut(still.groupBy("rank").agg(F.count(F.lit(1)).alias("open")))
        settled.append(work.where(~shifting))
        largest = count.agg(F.max("open")).first()[0]
        if largest is None:
            break
        blocks = F.ceil(F.col("open") / F.lit(block)).cast("int")
        dealt = (
            join_checked(still, count, ["rank"])
            .withColumn("one", F.col("open") <= block)
            .withColumn("mark", F.xxhash64(F.lit(seed), F.lit(level), "doc_id", "size"))
            .withColumn("blk", F.pmod("mark", blocks).cast("int"))
        )
        work = cut(
            dealt.repartition("rank", "blk").sortWithinPartitions("rank", "blk", F.xxhash64(F.lit(seed + 1), "mark"), "doc_id", "size")
            .mapInPandas(_fly(level, seed), UNIT)
        )
        level += 1
    flown = settled[0]
    for part in settled[1:]:
        flown = flown.unionByName(part)
    back = join_checked(flown, targets, ["rank"])
    return back.select("doc_id", "source", "size", "n", "source_size", "target", (F.col("whole") + F.round("pi").cast("int")).cast("long").alias("copies"))


def mix_documents(docs: DataFrame, **how) -> DataFrame:
    """Every document row with `copies`, `taken` (size * copies), `size`, `source_size` and `target`; other columns stay.

    docs has doc_id, text and source; null texts have size 0. See mix_plan() for ties, nulls and repeated rows. Columns
    of docs that are named like the new ones are replaced.
    """
    own = docs.drop("size", "source_size", "target", "copies", "taken")
    sized = own.withColumn("size", token_count(F.col("text").cast("string")))
    doc, source, size = (unused([*sized.columns, "source_size", "target", "copies", "taken"], f"plan_{c}") for c in ("doc_id", "source", "size"))
    plan = mix_plan(sized.select("doc_id", "source", "size"), **how).select(F.col("doc_id").alias(doc), F.col("source").alias(source), F.col("size").alias(size), "source_size", "target", "copies")
    same = sized["doc_id"].cast("long").eqNullSafe(plan[doc]) & sized["source"].cast("string").eqNullSafe(plan[source]) & (sized["size"] == plan[size])
    return sized.join(plan, same).drop(doc, source, size).withColumn("taken", F.col("size") * F.col("copies"))

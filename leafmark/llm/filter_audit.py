"""Filter interaction audit: what each filter of a chain removes, for every order of the filters, from packed bitsets.

Each batch of a partition is laid out part by part, each part from a byte of its own on; a bitset is a NumPy byte
array over that layout: one of the rows (the padding between parts is not set), one for each filter and each label. A
part's bitset is its stretch of the bytes, so parts cost no bytes of their own. What is left after a set of filters is
the AND-NOT of their bitsets, whatever their order, so there are 2^n sets and n * 2^(n-1) pairs of a set and the next
filter, not n! orders; bits are counted by byte and summed by part, batch counts are summed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm.common import cut, join_salted, written

#: The filters of the audit in their natural order, by letter.
LETTERS = "ABCDE"
COUNTS = ("alive", "removed", "fails", "only", "good", "toxic")


def failures(text: Column) -> dict[str, Column]:
    """The conditions of filters A to D on a text that isn't null; E needs all texts."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    n, capitals = F.size(words), F.char_length(text) - F.char_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return {
        "A": n < 200,
        "B": F.size(F.array_distinct(words)).cast("long") * 100 < n.cast("long") * 50,
        "C": capitals.cast("long") * 100 > F.char_length(text).cast("long") * 2,
        "D": text.rlike("[#$%&*|]"),
    }


def marked(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, the failures A to E, good and toxic of every row of docs (doc_id, text, source).

    Texts are read once; from then on a row has a 256-bit digest for its text. Copies are counted before they are
    joined, and a text of many copies is dealt to several tasks.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = written(held.select("doc_id", "part", *[c.alias(k) for k, c in failures(F.col("text")).items()], F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("digest")), "filters")
    copies = cut(rows.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    known = join_salted(rows, copies, ["digest"], how="left").withColumn("E", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)))
    said = lambda c: F.coalesce(F.max(F.col(c) == 1), F.lit(False))
    labelled = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(said("quality").alias("good"), said("toxic").alias("toxic"))
    return known.join(labelled, "doc_id", "left").select("part", *LETTERS, *[F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")])


def _bitsets(n_filters: int):
    """Counts of every part of a batch for each set of filters (bits of `chain`) and next filter `f`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if not len(batch):
                continue
            parts, code = np.unique(batch["part"].to_numpy(object).astype(str), return_inverse=True)
            order = np.argsort(code, kind="stable")
            size = np.bincount(code)
            start = np.concatenate([[0], np.cumsum(-(-size // 8))])  # in bytes
            at = np.empty(len(batch), dtype=np.int64)
            at[order] = np.arange(len(batch)) - np.repeat(np.cumsum(size) - size - start[:-1] * 8, size)

            def packed(flags: np.ndarray, at=at, start=start) -> np.ndarray:
                bits = np.zeros(start[-1] * 8, dtype=bool)
                bits[at] = flags
                return np.packbits(bits)

            row = packed(np.ones(len(batch), dtype=bool))
            fails = [packed(batch[f"f{i}"].to_numpy(bool)) for i in range(n_filters)]
            good, toxic = packed(batch["good"].to_numpy(bool)), packed(batch["toxic"].to_numpy(bool))
            count = lambda bits, start=start: np.add.reduceat(np.bitwise_count(bits).astype(np.int64), start[:-1])
            total = [count(b) for b in fails]
            only = [count(b & ~np.bitwise_or.reduce([o for j, o in enumerate(fails) if j != i] + [row & ~row])) for i, b in enumerate(fails)]
            out = []
            for chain in range(1 << n_filters):
                left = row.copy()
                for i in range(n_filters):
                    if chain >> i & 1:
                        left &= ~fails[i]
                alive = count(left)
                for i in range(n_filters):
                    if not chain >> i & 1:
                        gone = left & fails[i]
                        out.append(pd.DataFrame({"part": parts, "chain": chain, "f": i, "alive": alive, "removed": count(gone), "fails": total[i], "only": only[i], "good": count(gone & good), "toxic": count(gone & toxic)}))
            yield pd.concat(out, ignore_index=True)

    return run


def interaction_counts(rows: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, chain, f and COUNTS: of the part's rows that pass all filters of the set `chain` (a bit a filter), those that filter f removes.

    rows: part, a boolean column for each of `letters`, good and toxic; none of them null.
    """
    named = rows.select("part", *[F.col(c).alias(f"f{i}") for i, c in enumerate(letters)], "good", "toxic")
    schema = "part string, chain int, f int, " + ", ".join(f"{c} long" for c in COUNTS)
    return named.mapInPandas(_bitsets(len(letters)), schema).groupBy("part", "chain", "f").agg(*[F.sum(c).alias(c) for c in COUNTS])


def filter_audit(docs: DataFrame, labels: DataFrame, letters: str = LETTERS) -> DataFrame:
    """part, filter_order, step and the counts of documents kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley.

    One row for each part (source; null: empty string), each order of the filters and each step of it. redundant are
    those that fail the step's filter but were removed before; shapley is what the filter removes, summed over all
    orders. Null texts are empty ones. Rows with one doc_id are documents of their own with the same labels; a document
    is good or toxic if any of its labels says so. A row without a doc_id is no copy of another and none is a copy of it.
    An empty table gives no rows; extra columns are ignored.
    """
    n = len(letters)
    weight = F.element_at(F.array(*[F.lit(factorial(k) * factorial(n - 1 - k)) for k in range(n)]), F.bit_count("chain") + 1)
    counts = interaction_counts(marked(docs, labels), letters).withColumn("shapley", F.sum(F.col("removed") * weight).over(Window.partitionBy("part", "f")))
    steps = [("".join(letters[i] for i in p), k + 1, sum(1 << i for i in p[:k]), p[k]) for p in permutations(range(n)) for k in range(n)]
    every = docs.sparkSession.createDataFrame(steps, "filter_order string, step int, chain int, f int")
    return counts.join(F.broadcast(every), ["chain", "f"]).select(  # n! * n rows, whatever the data
        "part", "filter_order", "step", (F.col("alive") - F.col("removed")).alias("kept"), "removed", (F.col("fails") - F.col("removed")).alias("redundant"), F.col("only").alias("unique_fails"),
        F.col("good").alias("good_lost"), F.col("toxic").alias("toxic_lost"), "shapley",
    )

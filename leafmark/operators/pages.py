"""Operators on the words and lines of a page."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.text import LOW_CONFIDENCE, WORDLIKE, word_list

PAGE = ("doc_id", "page")
SPLIT, GUTTER_INK, MIN_WORDS, MIN_SHARE, GUTTER = 0.5, 0.03, 10, 0.2, 0.02
PITCH, PARA_GAP, TALL = 0.012, 1.6, 2.0
PROSE_SHARE = 0.6


def low_confidence(words: DataFrame, cap: int = 12) -> DataFrame:
    """doc_id, page, measured, low and sample: the `cap` least confident words, ties in source order."""
    low = F.col("confidence") < LOW_CONFIDENCE
    counts = words.where("confidence is not null").groupBy(*PAGE).agg(F.count(F.lit(1)).alias("measured"), F.count_if(low).alias("low"))
    rank = F.row_number().over(Window.partitionBy(*PAGE).orderBy("confidence", "idx"))
    best = words.where(low).withColumn("r", rank).where(F.col("r") <= cap).groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("s"))
    return counts.join(best, list(PAGE), "left").select(*PAGE, "measured", "low", F.coalesce(F.array_join(F.transform("s", lambda x: x["text"]), "|"), F.lit("")).alias("sample"))


def prose_share(docs: DataFrame) -> DataFrame:
    """doc_id, n, prose (words with three letters in a row) and retry: some words, but less than 0.6 of them prose."""
    words = word_list(F.col("text"))
    n = docs.select("doc_id", F.size(words).cast("long").alias("n"), F.size(F.filter(words, lambda w: w.rlike(WORDLIKE))).cast("long").alias("prose"))
    return n.withColumn("retry", F.when(F.col("n") > 0, F.col("prose") / F.col("n") < PROSE_SHARE).otherwise(False))


def with_page_marks(words: DataFrame, split: float = SPLIT) -> DataFrame:
    """The words with median_h, tall and two_column of their page: one shuffle by page, no other.

    median_h is the upper median of heights; tall words have twice as much. Of the others, two columns need enough on
    either side of `split` beyond the gutter, and hardly any across it.
    """
    page = Window.partitionBy(*PAGE)
    whole = page.orderBy("h").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = words.withColumn("_r", F.row_number().over(page.orderBy("h"))).withColumn("_n", F.count(F.lit(1)).over(whole))
    marked = ranked.withColumn("median_h", F.max(F.when(F.col("_r") == F.floor(F.col("_n") / 2) + 1, F.col("h"))).over(whole)).withColumn("tall", F.col("h") >= TALL * F.col("median_h"))
    body, middle, right = ~F.col("tall"), F.col("x") + F.col("w") / 2, F.col("x") + F.col("w")
    of = lambda c: F.count_if(body & c).over(whole)
    n = F.greatest(F.lit(1), F.count_if(body).over(whole))
    least = F.greatest(F.lit(float(MIN_WORDS)), n * MIN_SHARE)
    two = (of(middle < split - GUTTER) >= least) & (of(middle > split + GUTTER) >= least) & (of((F.col("x") < split) & (right > split)) <= n * GUTTER_INK)
    return marked.withColumn("two_column", two).drop("_r", "_n")


def page_statistics(words: DataFrame, split: float = SPLIT) -> DataFrame:
    """doc_id, page, median_h, tall and body (words of either kind) and two_column of every page with words."""
    boxed = words.select(*PAGE, "x", "w", "h").dropna()
    tall = F.count_if("tall")
    return with_page_marks(boxed, split).groupBy(*PAGE).agg(
        F.first("median_h").alias("median_h"), tall.alias("tall"), (F.count(F.lit(1)) - tall).alias("body"), F.first("two_column").alias("two_column")
    )

"""Ranked lexical search by TPUT (three-phase uniform threshold) over postings, exact in its scores and its ranks.

A list is a term's postings: the documents that hold it, each with what the term adds to a score once. The lists of the
terms asked for are one written table (term, document, occurrences, words of the document), which three jobs read:

1. heads: the k best entries of every list. What they add up to is a lower bound of a document's score; the k-th best
   bound of an item is its threshold.
2. uniform threshold: of every list of an item, the entries of at least threshold / terms. A document with none of them
   scores less than the threshold. Sums of these give better lower bounds, and with what the other lists can add at
   most, upper bounds; a document whose upper bound is below the k-th best lower bound is out.
3. lookups: the exact scores of the candidates left, from all lists.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm.common import cut, join_checked, written

# Terms are the words of wordhash: maximal runs of ASCII letters and digits and of non-ASCII characters, A-Z lowered.
from leafmark.llm.wordhash import normalise

#: The list of the empty term has every document that has terms, with their number: it tells N and L.
ALL = ""


#: Postings that a task hands on at once.
AT_ONCE = 50_000


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each term of a text, and one for ALL; texts are taken one at a time out of the batch."""
    for batch in batches:
        at: list[int] = []
        term: list[str] = []
        tf: list[int] = []
        n: list[int] = []
        for i in range(batch.num_rows):
            words = normalise(batch["text"][i].as_py() or "").split()
            if words:
                counts = Counter(words)
                at += [i] * (len(counts) + 1)
                term.append(ALL)
                term += [w.decode() for w in counts]
                tf.append(len(words))
                tf += counts.values()
                n += [len(words)] * (len(counts) + 1)
            if len(at) > AT_ONCE or (i == batch.num_rows - 1 and at):
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([batch["row"].take(rows), batch["doc_id"].take(rows), pa.array(term), pa.array(tf, pa.int64()), pa.array(n, pa.int64())], names=["row", "doc_id", "term", "tf", "n"])
                at, term, tf, n = [], [], [], []


def term_counts(texts: DataFrame) -> DataFrame:
    """row, doc_id, term, tf and n (the text's terms) of texts (row, doc_id, text), whole; see ALL."""
    return texts.mapInArrow(_counted, "row long, doc_id long, term string, tf long, n long")


def _best(rows: DataFrame, by: list, of: str, k: int) -> DataFrame:
    """The first k rows of each `of`; map tasks send no more than k of each on."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(of).orderBy(*by))).where(F.col("rank") <= k)


def search(docs: DataFrame, items: DataFrame, k: int = 20) -> DataFrame:
    """item_id, rank, doc_id and score: the k best documents (doc_id, text) of every item (item_id, text), by whole texts.

    Terms are maximal runs of ASCII letters, digits and non-ASCII characters, A-Z lowered. With N documents that have
    terms, L terms in all, n of a document, df documents with a term and tf of it in one, a term's weight is
    floor(1000 * ln((2N + 2) / (2 df + 1))), m = 100 - 25 + (25 n N) div L, and it adds weight * ((10^9 tf) div
    (1000 tf + 12 m)) for each time the item has it. Scores of 0 don't count; ties go to the smaller doc_id.

    Every row is a document, or an item, of its own, also if its id is repeated or null; null ids come last among ties.
    Null texts and texts without terms neither match nor ask. Empty tables give no rows; extra columns are ignored. The
    terms asked for select the postings by a join, broadcast only if they are few; tasks hold k entries of a list.
    """
    named = lambda df, key: df.select(F.monotonically_increasing_id().alias("row"), F.col(key).cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    asked = written(term_counts(named(items, "item_id")).where(F.col("term") != ALL).select(F.col("row").alias("q"), F.col("doc_id").alias("item_id"), "term", F.col("tf").alias("times")), "asked")
    vocabulary = asked.select("term").distinct()
    vocabulary = cut(vocabulary.unionByName(docs.sparkSession.createDataFrame([(ALL,)], "term string")).withColumn("t", F.monotonically_increasing_id()))
    lists = written(join_checked(term_counts(named(docs, "doc_id")), vocabulary, ["term"]).select("t", "row", "doc_id", "tf", "n"), "postings")
    of_all = vocabulary.where(F.col("term") == ALL).first()["t"]
    total = lists.where(F.col("t") == of_all).agg(F.count(F.lit(1)).alias("N"), F.coalesce(F.sum("n"), F.lit(1)).alias("L")).first()
    lists = lists.where(F.col("t") != of_all)
    weight = F.floor(F.lit(1000.0) * F.ln((F.lit(2.0) * total["N"] + 2) / (F.lit(2.0) * F.col("df") + 1)))
    weights = cut(lists.groupBy("t").agg(F.count(F.lit(1)).alias("df")).select("t", weight.alias("w")).where("w > 0"))
    m = F.lit(75).cast("long") + F.expr(f"(25L * n * {total['N']}L) div {total['L']}L")
    adds = F.col("w") * F.expr("(1000000000L * tf) div (1000L * tf + 12L * m)")
    entries = join_checked(lists, weights, ["t"]).withColumn("m", m).select("t", "row", "doc_id", adds.alias("adds")).where("adds > 0")

    heads = cut(_best(entries, [F.desc("adds"), F.asc_nulls_last("doc_id"), "row"], "t", k).select("t", "row", "adds", "rank"))
    terms = asked.join(vocabulary, "term").join(weights.select("t"), "t").join(heads.where("rank = 1").select("t", F.col("adds").alias("top")), "t").select("q", "t", "times", "top")
    terms = cut(terms.withColumn("terms", F.count(F.lit(1)).over(Window.partitionBy("q"))))
    kth = lambda sums: _best(sums, [F.desc("sum")], "q", k).where(F.col("rank") == k)
    first = heads.join(terms, "t").groupBy("q", "row").agg(F.sum(F.col("adds") * F.col("times")).alias("sum"))
    bound = terms.join(kth(first).select("q", F.col("sum").alias("bound")), "q", "left").withColumn("bound", F.coalesce("bound", F.lit(0)))
    # an entry left unread adds less than bound / terms, and no more than its list's first
    unread = F.least(F.col("times") * F.col("top"), F.greatest(F.lit(0), F.expr("(bound - 1) div terms")))
    bound = cut(bound.withColumn("unread", unread).withColumn("all_unread", F.sum("unread").over(Window.partitionBy("q"))))

    read = join_checked(entries, bound, ["t"]).where(F.col("adds") * F.col("times") * F.col("terms") >= F.col("bound"))
    seen = cut(read.groupBy("q", "row").agg(F.sum(F.col("adds") * F.col("times")).alias("sum"), (F.max("all_unread") - F.sum("unread")).alias("more")))
    better = cut(kth(seen).select("q", F.col("sum").alias("least")))
    candidates = cut(join_checked(seen, better, ["q"], "left").where(F.col("least").isNull() | (F.col("sum") + F.col("more") >= F.col("least"))).select("q", "row"))

    wanted = cut(candidates.select("row").distinct())
    near = join_checked(entries, wanted, ["row"])
    asks = join_checked(candidates, terms.select("q", "t", "times"), ["q"])
    scores = near.join(asks, ["t", "row"]).groupBy("q", "row").agg(F.sum(F.col("adds") * F.col("times")).alias("score"), F.first("doc_id").alias("doc_id"))
    ranked = _best(scores, [F.desc("score"), F.asc_nulls_last("doc_id"), "row"], "q", k)
    return ranked.join(asked.select("q", "item_id").distinct(), "q").select("item_id", "rank", "doc_id", "score")

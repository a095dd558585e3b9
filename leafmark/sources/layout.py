"""A deterministic page layout for plain documents, and Markdown documents from turns: stand-ins for words of real pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leafmark.functions.text import MARKER, word_list
from leafmark.operators.tables import by_text
from leafmark.sources.numbering import numbered_lines

#: A word dump, one JSON object a line; confidence may be missing.
WORD = T.StructType([
    T.StructField("page", T.IntegerType()), T.StructField("text", T.StringType()),
    *[T.StructField(c, T.DoubleType()) for c in ("x", "y", "w", "h", "confidence")],
])


def read_word_dump(spark, path: str) -> DataFrame:
    """Words of JSONL dumps: doc_id (the file), idx (the line's number, from 1), the word's columns and `bad`, true of
    malformed lines; blank lines are left out but counted."""
    read = numbered_lines(spark, path).where(F.trim("value") != "").withColumn("w", F.from_json("value", WORD, {"mode": "PERMISSIVE"}))
    return read.select("doc_id", F.col("line").alias("idx"), "w.*", (F.col("w").isNull() | F.col("w.page").isNull() | F.col("w.text").isNull()).alias("bad"))


def read_audit_dump(spark, path: str) -> DataFrame:
    """Every line of JSONL dumps: doc_id (the file), idx (its number, from 1), the word's columns, and error, null for a sound line.

    A line must be a JSON object; blank lines count, but for what follows the last line end.
    """
    read = numbered_lines(spark, path).withColumn("value", F.trim(F.regexp_replace("value", "\r$", ""))).withColumn("w", F.from_json("value", WORD, {"mode": "PERMISSIVE"}))
    number = F.concat(F.lit("line "), F.col("line").cast("string"))
    sound = F.startswith("value", F.lit("{")) & F.try_parse_json("value").isNotNull()
    stated = F.coalesce((F.col("w.page") > 0) & F.col("w.text").rlike(r"\S"), F.lit(False))
    error = F.when(~sound, F.concat(number, F.lit(" is not valid JSON"))).when(~stated, F.concat(number, F.lit(" must contain a positive integer page and non-empty text")))
    return read.select("doc_id", F.col("line").alias("idx"), "w.*", error.alias("error"))


PAGE_WORDS = 360  # of the grid


def laid_out(docs: DataFrame) -> DataFrame:
    """Words of documents on a grid: doc_id, page, idx, col, row, text, x, y, w, h, confidence.

    One column of 12 words a line; two columns of six where doc_id is a multiple of 3; 30 lines a column. The first
    row of every fifth document is tall. Documents are cut into pages, and these dealt out, a row each, so the words of a
    page are made where they are needed together, and neither windows nor joins by page move words. Rows without a
    doc_id are left out.
    """
    held = docs.where("doc_id is not null").select("doc_id", word_list(F.col("text")).alias("ws"))
    nth = F.sequence(F.lit(0), F.floor((F.size("ws") - 1) / PAGE_WORDS).cast("int"))
    cut = F.when(F.size("ws") > 0, F.transform(nth, lambda i: F.array_join(F.slice("ws", i * PAGE_WORDS + 1, F.lit(PAGE_WORDS)), " ")))  # no word has a blank
    pages = held.select("doc_id", F.posexplode(cut).alias("nth", "said")).select("doc_id", (F.col("nth") + 1).alias("page"), "said")
    words = by_text(pages, docs, "doc_id", "page").select("doc_id", "page", F.posexplode(F.split("said", " ")).alias("at", "text"))
    two = F.col("doc_id") % 3 == 0
    per = F.when(two, 6).otherwise(12)
    line = F.floor(F.col("at") / per).cast("int")  # of the page
    place = (
        words.withColumn("p", (F.col("page") - 1) * PAGE_WORDS + F.col("at")).withColumn("ln", line).withColumn("k", (F.col("at") % per).cast("int"))
        .withColumn("col", F.when(two, F.floor(F.col("ln") / 30)).otherwise(F.lit(0)).cast("int"))
        .withColumn("row", (F.col("ln") % 30).cast("int"))
    )
    thousandth = lambda n: n.cast("double") / F.lit(1000.0)
    return place.select(
        "doc_id", "page", F.col("p").alias("idx"), "col", "row", "text",
        thousandth(50 + 500 * F.col("col") + 62 * F.col("k")).alias("x"), thousandth(900 - 25 * F.col("row")).alias("y"),
        F.lit(0.052).alias("w"), F.when((F.col("row") == 0) & (F.col("doc_id") % 5 == 0), F.lit(0.05)).otherwise(F.lit(0.017)).alias("h"),
        ((F.col("p") * 37 + F.col("doc_id") * 11) % 101).cast("double").alias("confidence"),
    )


def marked_documents(conversations: DataFrame) -> DataFrame:
    """One Markdown document for each conversation: a page marker and the text of every turn, in order."""
    page = F.concat(F.lit("### p"), F.col("turn").cast("string"), F.lit("\n"), F.coalesce("text", F.lit("")))
    parts = conversations.groupBy(F.col("conv_id").alias("doc_id")).agg(F.array_sort(F.collect_list(F.struct("turn", page.alias("t")))).alias("parts"))
    return parts.select("doc_id", F.array_join(F.transform("parts", lambda x: x["t"]), "\n").alias("md"))


def bodies(marked: DataFrame) -> DataFrame:
    """(doc_id, md) -> doc_id, page, body: the lines after each page marker. Text before the first is left out; bodies of a
    page that is marked again are joined in order. A document is split as an array and cut at its markers, in linear time."""
    def cut(lines):
        at = lambda x: F.coalesce(F.nullif(F.regexp_extract(x, MARKER, 1), F.lit("")), F.regexp_extract(x, MARKER, 2)).cast("int")
        marks = F.filter(F.transform(lines, lambda x, i: F.struct(i.alias("i"), F.when(x.rlike(MARKER), at(x)).alias("page"))), lambda m: m["page"].isNotNull())
        body = lambda ms: F.transform(ms, lambda m, k: F.struct(m["page"].alias("page"), F.array_join(F.slice(lines, m["i"] + 2, F.coalesce(F.get(ms, k + 1)["i"], F.size(lines)) - m["i"] - 1), "\n").alias("body")))
        return F.element_at(F.transform(F.array(marks), body), 1)

    pages = F.element_at(F.transform(F.array(F.split("md", "\n")), cut), 1)
    each = marked.select("doc_id", F.posexplode(pages).alias("nth", "b")).select("doc_id", "nth", "b.page", "b.body")
    return each.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "body"))), lambda x: x["body"]), "\n").alias("body"))

"""Operators on whole documents: reports, rendering, routing and the word audit."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.text import half_up, tokens
from leafmark.operators.tables import by_text

# Fixed value: how a line of prose may end.
TERMINAL = r"[.!?:;\"”'’)\]…0-9]$"


def page_stats(pages: DataFrame) -> DataFrame:
    """Counts of each page body: headings, junk headings, floats, paragraphs, reviews, and lines that end without punctuation."""
    body = F.col("body")
    lines = F.filter(F.split(body, "\n"), lambda x: (F.trim(x) != "") & ~x.rlike(r"^\s*[#>|*-]"))
    dangling = F.filter(lines, lambda x: ~F.rtrim(x).rlike(TERMINAL))
    count = lambda p: F.regexp_count(body, F.lit(p)).cast("long")
    return pages.select(
        "doc_id", "page", F.char_length("body").cast("long").alias("chars"), count(r"(?m)^#{1,6}\s*(.+)$").alias("headings"),
        F.size(F.filter(F.split(body, "\n"), lambda x: x.rlike("^#{1,6}") & ~x.rlike("[A-Za-z]{3}"))).cast("long").alias("junk_headings"),
        count(r"(?m)^> \[floats\]").alias("floats"), count(r"(?m)^[^#>\-\s].*$").alias("paragraphs"), count(r"(?m)^> \[review: ").alias("review_blocks"),
        count(r"(?m)^> (?!\[floats\]|\[review:)").alias("callouts"),
        F.size(F.filter(dangling, lambda x: F.char_length(x) >= 60)).cast("long").alias("dangling_long"),
        F.size(F.filter(dangling, lambda x: F.char_length(x) < 60)).cast("long").alias("dangling_short"),
    )


def document_report(stats: DataFrame) -> DataFrame:
    sums = ("chars", "headings", "junk_headings", "floats", "paragraphs", "review_blocks", "callouts", "dangling_long", "dangling_short")
    per = stats.groupBy("doc_id").agg(F.count(F.lit(1)).alias("pages"), *[F.sum(c).cast("long").alias(c) for c in sums])
    rate = half_up(F.col("chars") / F.col("pages")).cast("long")
    return per.withColumn("chars_per_page", rate).withColumn("sparse", F.col("chars_per_page") < 200)


def routes(pages: DataFrame, ocr: bool | None = None) -> DataFrame:
    """Adds path: ocr for pages with an image and fewer than 20 text characters, else text; ocr: for all pages, or (False) for none."""
    scanned = F.coalesce(F.col("has_image") & (F.col("text_chars") < 20), F.lit(False)) if ocr is None else F.lit(ocr)
    return pages.withColumn("path", F.when(scanned, "ocr").otherwise("text"))


def ocr_ranges(routed: DataFrame) -> DataFrame:
    """Runs of following OCR pages: source, first, last, n."""
    w = Window.partitionBy("source").orderBy("page")
    runs = routed.where("path = 'ocr'").withColumn("island", F.col("page") - F.row_number().over(w))
    return runs.groupBy("source", "island").agg(F.min("page").alias("first"), F.max("page").alias("last"), F.count(F.lit(1)).alias("n")).drop("island")


def _beside(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, shared, n and n_next: tokens in common with the document of the next id, and those of either.

    A document's tokens go, as one row, to itself and to the document before; there they are counted, without a further shuffle.
    """
    sides = F.explode(F.array(F.struct(F.col("doc_id"), F.lit(1).alias("own")), F.struct((F.col("doc_id") - 1).alias("doc_id"), F.lit(0).alias("own")))).alias("s")
    said = F.array_join(tokens(F.col("text")), " ").alias("said")  # no token has a blank
    sided = docs.where("doc_id is not null").select("doc_id", said).where("said <> ''").select("said", sides).select("s.doc_id", "s.own", "said")
    each = by_text(sided, docs, "doc_id").select("doc_id", "own", F.explode(F.split("said", " ")).alias("token"))
    counts = each.groupBy("doc_id", "token").agg(F.sum("own").alias("a"), F.count(F.lit(1)).alias("n")).withColumn("b", F.col("n") - F.col("a"))
    return counts.groupBy("doc_id").agg(F.sum(F.least("a", "b")).alias("shared"), F.sum("a").alias("n"), F.sum("b").alias("n_next"))


def shared_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, shared: how many tokens a document and the one with the next id have in common, by occurrence; none, no row."""
    return _beside(docs).where("shared > 0").select("doc_id", "shared")


def overlap_shares(docs: DataFrame) -> DataFrame:
    """(doc_id, text) -> doc_id, shared, overlap and only_next: of a document's tokens the share that the one with the next
    id has too, and of the next one's tokens the share that isn't among them; documents without a common token have no row."""
    return _beside(docs).where("shared > 0").select("doc_id", "shared", (F.col("shared") / F.col("n")).alias("overlap"), ((F.col("n_next") - F.col("shared")) / F.col("n_next")).alias("only_next"))


def ocr_heading_levels(sizes: DataFrame, scale: float = 2.0, step: float = 0.8) -> DataFrame:
    """(doc_id, size, body_height), sizes distinct -> doc_id, size, level of sizes over `scale` body heights.

    From the largest down, a size below `step` of its level's largest opens the next level: 4, 5, then 6 for all. A
    document has as many sizes as height buckets, so they are folded as one array.
    """
    tall = sizes.where(F.col("size") > F.col("body_height") * scale).groupBy("doc_id").agg(F.sort_array(F.collect_set("size"), asc=False).alias("s"))
    kind = "array<struct<size:double,level:int,top:double>>"

    def put(done, size):
        last = F.element_at(done, -1)
        fresh = (F.size(done) == 0) | (size < last["top"] * step)
        level = F.when(F.size(done) == 0, 4).when(fresh, F.least(F.lit(6), last["level"] + 1)).otherwise(last["level"])
        return F.concat(done, F.array(F.struct(size.alias("size"), level.alias("level"), F.when(fresh, size).otherwise(last["top"]).alias("top"))).cast(kind))

    folded = tall.select("doc_id", F.explode(F.aggregate("s", F.array().cast(kind), lambda done, x: F.when(F.size(done) == 0, F.array(F.struct(x.alias("size"), F.lit(4).alias("level"), x.alias("top"))).cast(kind)).otherwise(put(done, x)))).alias("f"))
    return folded.select("doc_id", "f.size", "f.level")

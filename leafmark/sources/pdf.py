"""PDF sources: binary files through a parser, a rasteriser and an OCR engine that the caller plugs in.

None of the three is part of the library. A parser takes a file's bytes and yields a dictionary a page: page, width,
height, runs (text, a..f of the transform to the viewport with y down, width), and ops (name, w, h) of images painted.
"""

from __future__ import annotations

import os
import re
import time
from collections.abc import Callable, Iterable, Iterator
from contextlib import AbstractContextManager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from leafmark.errors import LeafmarkError
from leafmark.functions.text import WORDLIKE, fold_typographic, half_up
from leafmark.operators.pages import PAGE, PROSE_SHARE

RUN = "struct<text:string,a:double,b:double,c:double,d:double,e:double,f:double,width:double>"
OP = "struct<name:string,w:int,h:int>"
PARSED = f"doc_id string, page int, width double, height double, runs array<{RUN}>, ops array<{OP}>, error string"
WORDS = "doc_id string, page int, idx int, text string, x double, y double, w double, h double, confidence double, ms double, note string"
# The operators that paint images, and from what size on an image is large.
IMAGE_OPS = (
    "paintImageMaskXObject", "paintImageMaskXObjectGroup", "paintImageMaskXObjectRepeat", "paintImageXObject", "paintImageXObjectRepeat", "paintInlineImageXObject",
    "paintInlineImageXObjectGroup", "paintSolidColorImageMask",
)
LARGE_PIXELS, LARGE_MIN_CHARS = 200, 80


def read_pdfs(spark: SparkSession, path: str, parse: Callable[[bytes], Iterable[dict]]) -> DataFrame:
    """Parsed pages of the files below `path`, one task's unit being a file; a file that can't be parsed has one row with error PDF_OPEN."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in PARSED.replace(RUN, "").replace(OP, "").split(", ")]
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows = [{"doc_id": name, "error": None, **p} for p in parse(content)]
                except Exception as e:  # noqa: BLE001 a broken file is a row, not the end of the job
                    rows = [{"doc_id": name, "error": f"PDF_OPEN: {e}"}]
                if rows:
                    table = pd.DataFrame(rows).reindex(columns=names).astype(object)
                    yield table.where(table.notna(), None)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(pages, PARSED)


def page_counts(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is null").groupBy("doc_id").agg(F.max("page").alias("n_pages"))


def runs_of(parsed: DataFrame) -> DataFrame:
    """doc_id, page, idx, text, x, y, w, h, page_width, page_height and the box bx, by, bw, bh of runs that aren't blank.

    x and y are the baseline's origin, h the height to a tenth of a point, the box that of the turned run's corners.
    """
    r = parsed.where("error is null").select("doc_id", "page", "width", "height", F.posexplode("runs").alias("idx", "r")).select("doc_id", "page", "idx", F.col("width").alias("page_width"), F.col("height").alias("page_height"), "r.text", "r.a", "r.b", "r.c", "r.d", "r.e", "r.f", F.abs("r.width").alias("w"))
    base = F.sqrt(F.col("a") * F.col("a") + F.col("b") * F.col("b"))
    h = half_up(F.sqrt(F.col("c") * F.col("c") + F.col("d") * F.col("d")) * 10) / 10
    along_x, along_y = F.when(base > 0, F.col("a") / base * F.col("w")).otherwise(F.col("w")), F.when(base > 0, F.col("b") / base * F.col("w")).otherwise(F.lit(0.0))
    xs = [F.col("e"), F.col("e") + along_x, F.col("e") + along_x + F.col("c"), F.col("e") + F.col("c")]
    ys = [F.col("f"), F.col("f") + along_y, F.col("f") + along_y + F.col("d"), F.col("f") + F.col("d")]
    kept = r.where(r"text rlike '(?U)\\S'")
    return kept.select(
        "doc_id", "page", "idx", "text", F.col("e").alias("x"), F.col("f").alias("y"), "w", h.alias("h"), "page_width", "page_height",
        F.least(*xs).alias("bx"), F.least(*ys).alias("by"), (F.greatest(*xs) - F.least(*xs)).alias("bw"), (F.greatest(*ys) - F.least(*ys)).alias("bh"),
    )


def image_signals(parsed: DataFrame) -> DataFrame:
    """doc_id, page, text_chars (blank runs counted), has_image, large_image."""
    chars = F.aggregate("runs", F.lit(0), lambda n, r: n + F.coalesce(F.char_length(r["text"]), F.lit(0)))
    large = F.exists("ops", lambda o: (o["name"] == "paintImageXObject") & F.coalesce((o["w"] >= LARGE_PIXELS) & (o["h"] >= LARGE_PIXELS), F.lit(True)))
    n = parsed.where("error is null").withColumn("text_chars", chars)
    yes = lambda c: F.coalesce(c, F.lit(False))
    return n.select("doc_id", "page", "text_chars", yes(F.exists("ops", lambda o: o["name"].isin(*IMAGE_OPS))).alias("has_image"), (yes(large) & (F.col("text_chars") > LARGE_MIN_CHARS)).alias("large_image"))


def page_fractions(runs: DataFrame) -> DataFrame:
    """The runs as words: boxes in fractions of the page, y up; 0 where a page has no size."""
    part = lambda n, of: F.when(F.col(of) > 0, n / F.col(of)).otherwise(F.lit(0.0))
    up = F.col("page_height") - F.col("by") - F.col("bh")
    return runs.select("doc_id", "page", "idx", "text", part(F.col("bx"), "page_width").alias("x"), part(up, "page_height").alias("y"), part(F.col("bw"), "page_width").alias("w"), part(F.col("bh"), "page_height").alias("h"))


def normalised_words(recognised: DataFrame) -> DataFrame:
    """Nested engine output (doc_id, page, width, height, blocks>paragraphs>lines>words) as words of page fractions, y up."""
    nested = F.flatten(F.flatten(F.flatten(F.transform("blocks", lambda b: F.transform(b["paragraphs"], lambda p: F.transform(p["lines"], lambda v: v["words"]))))))
    w = recognised.select("doc_id", "page", "width", "height", F.posexplode(nested).alias("idx", "w"))
    box = lambda c: F.col(f"w.bbox.{c}")
    return w.select(
        "doc_id", "page", "idx", fold_typographic(F.col("w.text")).alias("text"), (box("x0") / F.col("width")).alias("x"), ((F.col("height") - box("y1")) / F.col("height")).alias("y"),
        ((box("x1") - box("x0")) / F.col("width")).alias("w"), ((box("y1") - box("y0")) / F.col("height")).alias("h"), F.col("w.confidence").cast("double").alias("confidence"),
    )


def _page_words(engine: Callable[[str, int, bool], list[dict]], doc: str, page: int) -> pd.DataFrame:
    """A page's words by the engine, as rows of WORDS; see recognise()."""
    began, note = time.monotonic(), None
    words = engine(doc, int(page), False)
    share = sum(bool(re.search(WORDLIKE, w["text"])) for w in words) / len(words) if words else 1.0
    if share < PROSE_SHARE:
        again = engine(doc, int(page), True)
        if len(again) > len(words):
            note = f"p{page}: chart-like page (prose fraction {share:.2f}), recognised again as sparse text, {len(words)} -> {len(again)} words"
            words = again
    ms = (time.monotonic() - began) * 1000
    rows = [{**w, "idx": i} for i, w in enumerate(words)] or [{"idx": None, "text": None}]
    return pd.DataFrame(rows).assign(doc_id=doc, page=page, ms=ms, note=note).reindex(columns=[c.split()[0] for c in WORDS.split(", ")])


def recognise(pages: DataFrame, engine: Callable[[str, int, bool], list[dict]]) -> DataFrame:
    """Words of pages (doc_id, page) from engine(doc_id, page, sparse), which gives text, x, y, w, h and confidence.

    A page with words of which less than 0.6 have three letters in a row is recognised again with sparse set; the second
    result is taken only if it has more words. A page without words has one row with null text. Pages are independent.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, page in zip(batch["doc_id"], batch["page"], strict=True):
                yield _page_words(engine, doc, page)

    return pages.select(F.col("doc_id").cast("string").alias("doc_id"), "page").mapInPandas(run, WORDS)


def page_ranges(pages: DataFrame, most: int = 32) -> DataFrame:
    """doc_id, first, last: following pages (doc_id, page, distinct) as ranges of at most `most` pages."""
    order = Window.partitionBy("doc_id").orderBy("page")
    numbered = pages.select(F.col("doc_id").cast("string").alias("doc_id"), "page").distinct().withColumn("n", F.row_number().over(order))
    nth = F.row_number().over(Window.partitionBy("doc_id", "island").orderBy("page")) - 1
    dealt = numbered.withColumn("island", F.col("page") - F.col("n")).withColumn("part", F.floor(nth / most))
    return dealt.groupBy("doc_id", "island", "part").agg(F.min("page").alias("first"), F.max("page").alias("last")).select("doc_id", "first", "last")


def recognise_ranges(pages: DataFrame, open_engine: Callable[[], AbstractContextManager[Callable[[str, int, bool], list[dict]]]], most: int = 32) -> DataFrame:
    """The words of recognise(), range by range: an engine is opened once for each range of page_ranges(), and closed when
    the range is done or has failed.

    Ranges are dealt to tasks, so a long document is recognised by many; a task that is run again opens its engines anew.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for doc, first, last in zip(batch["doc_id"], batch["first"], batch["last"], strict=True):
                with open_engine() as engine:
                    for page in range(int(first), int(last) + 1):
                        yield _page_words(engine, doc, page)

    return page_ranges(pages, most).repartition("doc_id", "first").mapInPandas(run, WORDS)


def check_pages(pages: DataFrame) -> None:
    """Raises PAGE_RANGE if a page (doc_id, page, n_pages) isn't in its document."""
    outside = pages.where("page < 1 or page > n_pages").select(*PAGE, "n_pages").limit(1).collect()
    if outside:
        raise LeafmarkError("PAGE_RANGE", f"page {outside[0].page} of {outside[0].doc_id}, which has {outside[0].n_pages}")


def _drawn(rasterise: Callable[[str, int, float], tuple[bytes, int, int]], dpi: float, batches: Iterator[pd.DataFrame]) -> Iterator[dict]:
    for batch in batches:
        for doc, page in zip(batch["doc_id"], batch["page"], strict=True):
            png, width, height = rasterise(doc, int(page), dpi)
            if width < 1 or height < 1:
                raise LeafmarkError("PAGE_RENDER", f"page {page} of {doc} has no size")
            yield {"doc_id": doc, "page": page, "png": png, "width": width, "height": height}


def render_pages(pages: DataFrame, rasterise: Callable[[str, int, float], tuple[bytes, int, int]], dpi: float = 288.0) -> DataFrame:
    """doc_id, page, png, width, height; a page that isn't in its document (n_pages) raises PAGE_RANGE before any is drawn."""
    check_pages(pages)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for one in _drawn(rasterise, dpi, batches):
            yield pd.DataFrame([one])

    return pages.select(F.col("doc_id").cast("string").alias("doc_id"), "page").mapInPandas(run, "doc_id string, page int, png binary, width int, height int")


def write_pages(pages: DataFrame, rasterise: Callable[[str, int, float], tuple[bytes, int, int]], out: str, dpi: float = 288.0) -> DataFrame:
    """Draws the pages (doc_id, page, n_pages) to files STEM-pN.png in the folder `out`, which all executors share: doc_id, page, path.

    STEM is the last part of doc_id without its ending, blanks as hyphens; two documents of one stem raise PAGE_RENDER,
    a page outside of its document PAGE_RANGE, both before any is drawn. Pictures stay in the task that draws them; one
    that runs again writes the same names.
    """
    name = F.element_at(F.split(F.col("doc_id").cast("string"), "/"), -1)
    stemmed = pages.withColumn("stem", F.replace(F.regexp_replace(name, r"(.)\.[^.]*$", "$1"), F.lit(" "), F.lit("-")))
    check_pages(stemmed)
    twice = stemmed.groupBy("stem").agg(F.countDistinct("doc_id").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise LeafmarkError("PAGE_RENDER", f"{twice[0].n} documents are called {twice[0].stem}")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        system, folder = fs.FileSystem.from_uri(out if "://" in out else os.path.abspath(out))
        system.create_dir(folder)
        for batch in batches:
            for stem, one in zip(batch["stem"], _drawn(rasterise, dpi, iter([batch])), strict=True):
                path = f"{folder.rstrip('/')}/{stem}-p{one['page']}.png"
                with system.open_output_stream(path) as f:
                    f.write(one["png"])
                yield pd.DataFrame([{"doc_id": one["doc_id"], "page": one["page"], "path": path}])

    return stemmed.select(F.col("doc_id").cast("string").alias("doc_id"), "page", "stem").mapInPandas(run, "doc_id string, page int, path string")

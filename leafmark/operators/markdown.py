"""Text-layer lines to blocks: each line has a class letter, and a grammar over the letters of a page finds its units."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.operators.hyphens import joined, tightened, with_joins
from leafmark.operators.pages import PAGE

# Bullets, a bare value, a label, the end of a sentence.
BULLETS = r"^(?:[•◦▪▫●○·‣⁃]\s*)+"
VALUE = r"^[0-9][\d.,]*%?$"
LABEL = "[:：]$"
SENTENCE_END = "[.!?:]$"
HEADING_SCALE, HEADING_SIZES, PARAGRAPH_JUMP, INDENT, CALLOUT_CHARS = 1.35, 6, 2.2, 18.0, 150

# Class letters: g bullets alone; B, b bullet with a label, with other text; H, V, h a heading line that is a label, a
# value, other, and I, W, i where it goes on with the heading before; L, v, t the same of body lines.
#: A unit: bullets with the line they stand for (and a label's value), a bullet item, a heading, a label with its value, a body line.
GRAMMAR = "g+(?:[BHIL][vVW]|[^g]|$)|B[vVW]|[Bb]|[hHViIW][iIW]*|L[vVW]|[Lvt]"
VALUED = "^(?:g+[BHIL]|B|L)[vVW]$"


def body_heights(histogram: DataFrame) -> DataFrame:
    """doc_id, body: the height with the most characters, the first met of several, of (doc_id, size, chars, at)."""
    return histogram.groupBy("doc_id").agg(F.max_by("size", F.struct("chars", -F.col("at.page"), -F.col("at.ix"))).alias("body"))


def heading_levels(lines: DataFrame, markers: bool | DataFrame = False, histogram: DataFrame | None = None) -> DataFrame:
    """doc_id, size, level: the six largest heights over 1.35 body heights; below page markers they start at level 4.

    markers: of all documents or none, or the documents (doc_id) that have them. histogram: (doc_id, size, chars, at),
    at being a struct(page, ix) of the first place, where not that of the lines.
    """
    if histogram is None:
        histogram = lines.groupBy("doc_id", F.col("h").alias("size")).agg(F.sum(F.char_length("text")).alias("chars"), F.min(F.struct("page", "ix")).alias("at"))
    tall = histogram.join(body_heights(histogram), "doc_id").where(F.col("size") > F.col("body") * HEADING_SCALE)
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.desc("size")))
    ranked = tall.withColumn("rank", rank).where(F.col("rank") <= HEADING_SIZES)
    if isinstance(markers, DataFrame):
        ranked = ranked.join(markers.select("doc_id", F.lit(3).alias("below")).distinct(), "doc_id", "left")
    else:
        ranked = ranked.withColumn("below", F.lit(3 if markers else 0))
    return ranked.select("doc_id", "size", F.least(F.lit(6), F.col("rank") + F.coalesce("below", F.lit(0))).cast("int").alias("level"))


def classified(lines: DataFrame, levels: DataFrame, values: bool = True) -> DataFrame:
    """Adds level, bare (text without bullets), broken (a column or a jump after the line before) and letter; without
    values, a bare value is a line like any other."""
    known = lines.join(levels.withColumnRenamed("size", "h"), ["doc_id", "h"], "left")
    order = Window.partitionBy(*PAGE).orderBy("ix")
    lag = lambda c: F.lag(c).over(order)
    bulleted = F.col("text").rlike(BULLETS)
    jump = F.col("y") - lag("y")
    near = (lag("col") == F.col("col")) & (jump < F.col("h") * PARAGRAPH_JUMP)
    head = F.col("level").isNotNull() & ~bulleted
    goes_on = head & (lag("h") == F.col("h")) & near & ~lag("text").rlike(BULLETS)
    bare = F.trim(F.regexp_replace("text", BULLETS, ""))
    label, value = bare.rlike(LABEL), F.col("text").rlike(VALUE) if values else F.lit(False)
    pick = lambda a, b, c: F.when(label, a).when(value, b).otherwise(c)
    letter = F.when(bulleted & (bare == ""), "g").when(bulleted, F.when(label, "B").otherwise("b")).when(goes_on, pick("I", "W", "i")).when(head, pick("H", "V", "h")).otherwise(pick("L", "v", "t"))
    broken = (lag("col") != F.col("col")) | (jump > F.col("h") * PARAGRAPH_JUMP)
    return known.select("*", bare.alias("bare"), F.coalesce(broken, F.lit(False)).alias("broken"), F.coalesce(letter, F.lit("t")).alias("letter"))


def units(marked: DataFrame) -> DataFrame:
    """Lines with unit (its number on the page), kind (its letters) and block (body lines of a paragraph share one).

    A page's letters are one string, matched at once; lines get their unit from the lengths of the matches. So a page's
    lines, which bound the memory of a row, are grouped where the window before left them, without a further shuffle.
    """
    line = F.struct("ix", "col", "text", "bare", "x", "h", "level", "broken", "letter", "words")
    page = marked.groupBy(*PAGE).agg(F.array_sort(F.collect_list(line)).alias("ls"), F.min("x").alias("base"))
    letters = F.array_join(F.transform("ls", lambda v: v["letter"]), "")
    found = F.regexp_extract_all(letters, F.lit(GRAMMAR), F.lit(0))
    dealt = F.flatten(F.transform(found, lambda u, k: F.array_repeat(F.struct(k.alias("unit"), u.alias("kind")), F.char_length(u))))
    each = page.select(*PAGE, "base", F.explode(F.arrays_zip(F.col("ls").alias("l"), dealt.alias("u"))).alias("z")).select(*PAGE, "base", "z.l.*", "z.u.*")
    order = Window.partitionBy(*PAGE).orderBy("ix")
    lag = lambda c: F.lag(c).over(order)
    body = F.col("kind").rlike("^[Lvt]$")
    opens = lag("unit").isNull() | F.when(body, ~lag("kind").rlike("^[Lvt]$") | F.col("broken") | lag("text").rlike(SENTENCE_END)).otherwise(lag("unit") != F.col("unit"))
    return each.withColumn("opens", opens).withColumn("block", F.sum(F.col("opens").cast("int")).over(order).cast("int") - 1).withColumn("body", body)


def text_blocks(lines: DataFrame, levels: DataFrame, dictionary: DataFrame | None = None, values: bool = True) -> DataFrame:
    """Blocks of text-layer lines (doc_id, page, ix, col, text, x, y, h, words): doc_id, page, block, type, level, text,
    tight, words, n_lines, and the counters list_items, joined_pairs, reflowed, callouts, closed_hyphens.

    Headings and paragraphs join their lines, with hyphens closed where the dictionary (word) has the word; a heading of
    more than 150 characters is a callout. Items are tight and indented by their distance from the page's least x. A
    label takes the bare value of the next line, unless values is false. A page without lines has no blocks.
    """
    each = units(classified(lines, levels, values))
    order = Window.partitionBy(*PAGE).orderBy("ix")
    first = F.max(F.when(F.col("opens"), F.col("ix"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    keys = [*PAGE, "block"]
    numbered = with_joins(each.withColumn("i", F.col("ix") - first), keys, dictionary)
    part = F.struct("i", "text", "join", "bare", "x", "words")
    grouped = numbered.groupBy(*keys).agg(
        F.array_sort(F.collect_list(part)).alias("ps"), F.first("kind").alias("kind"), F.first("body").alias("body"), F.min("base").alias("base"), F.min("level").alias("level"),
        F.count_if(F.col("body") & ~F.col("text").rlike(SENTENCE_END)).alias("reflowed"), F.count_if(F.col("join") == "close").alias("closed"), F.count(F.lit(1)).alias("n_lines"),
    )
    valued = F.col("kind").rlike(VALUED)
    label = F.element_at(F.col("ps"), F.size("ps") - F.when(valued, 1).otherwise(0))["bare"]
    depth = F.greatest(F.lit(0), F.floor((F.col("ps")[0]["x"] - F.col("base")) / INDENT + 0.5)).cast("int")
    bullet, pair = F.col("kind").rlike("^[gBb]"), F.col("kind").rlike("^L[vVW]$")
    item = F.concat(F.when(bullet, F.repeat(F.lit("  "), depth)).otherwise(""), F.lit("- "), label, F.when(valued, F.concat(F.lit(" "), F.element_at("ps", -1)["text"])).otherwise(""))
    merged = tightened(joined(F.col("ps")))
    listed, headed = bullet | pair, F.col("kind").rlike("^[hHViIW]")
    callout = headed & (F.char_length("merged") > CALLOUT_CHARS)
    one = lambda c: c.cast("long")
    return grouped.withColumn("merged", merged).select(
        *keys, F.when(headed & ~callout, "heading").otherwise("paragraph").alias("type"), F.when(headed & ~callout, F.col("level")).alias("level"),
        F.when(listed, item).when(callout, F.concat(F.lit("> "), "merged")).otherwise(F.col("merged")).alias("text"), listed.alias("tight"), F.flatten("ps.words").alias("words"), "n_lines",
        one(bullet).alias("list_items"), one(valued).alias("joined_pairs"), F.when(F.col("body"), F.col("reflowed")).otherwise(F.lit(0)).alias("reflowed"), one(callout).alias("callouts"),
        F.when(F.col("body"), F.col("closed")).otherwise(F.lit(0)).alias("closed_hyphens"),
    )


def builder_counts(blocks: DataFrame) -> DataFrame:
    """The builder's counters of each document."""
    total = lambda c: F.sum(c).cast("long").alias(c)
    plain = (F.col("type") == "paragraph") & ~F.col("tight") & (F.col("callouts") == 0)
    return blocks.groupBy("doc_id").agg(
        F.count_if(F.col("type") == "heading").alias("headings"), F.count_if(plain).alias("paragraphs"),
        *[total(c) for c in ("list_items", "joined_pairs", "reflowed", "callouts", "closed_hyphens")],
    )

"""Text functions of the layout operators, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Typographic quotes and the en dash, and what they fold to. The em dash stays.
FOLD_FROM = "ʼ’‘“”–"
FOLD_TO = "'''\"\"-"
MARKER = r"^(?:### p(\d+)|<!-- p(\d+) -->)\r?$"
WORDLIKE = r"[A-Za-z]{3}"
REVIEW_SHARE = 0.4
QUOTE_CHARS = 150
LOW_CONFIDENCE = 60


def fold_typographic(c: Column) -> Column:
    """One replacement after the other: translate() makes a string of every character."""
    for a, b in zip(FOLD_FROM, FOLD_TO, strict=True):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def half_up(c: Column) -> Column:
    """Round with halves towards plus infinity."""
    return F.floor(c + F.lit(0.5))


def bucket(h: Column) -> Column:
    """Heights in steps of 1/500."""
    return half_up(h * 500.0) / 500.0


def tokens(c: Column) -> Column:
    """Lower-case letter and digit runs, folded first."""
    return F.transform(F.regexp_extract_all(fold_typographic(c), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"), F.lit(0)), F.lower)


def word_list(c: Column) -> Column:
    return F.filter(F.split(c, "[ \t\n\r\f]+"), lambda w: w != "")


def is_unstructured(c: Column) -> Column:
    """Less than REVIEW_SHARE of the words have three letters in a row; false for no words."""
    words = word_list(c)
    like = F.size(F.filter(words, lambda w: w.rlike(WORDLIKE)))
    return F.when(F.size(words) > 0, like / F.size(words) < REVIEW_SHARE).otherwise(False)


def valid_record() -> Column:
    """An audit record: a positive page, text that isn't blank, and all or none of a finite box of no negative size."""
    box = [F.col(c) for c in ("x", "y", "w", "h")]
    given = sum((c.isNotNull().cast("int") for c in box), F.lit(0))
    finite = [c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")) for c in box]
    whole = finite[0] & finite[1] & finite[2] & finite[3] & (F.col("w") >= 0) & (F.col("h") >= 0)
    return F.coalesce((F.col("page") > 0) & F.col("text").rlike(r"\S") & ((given == 0) | whole), F.lit(False))

"""Grouping of words and runs into lines: page statistics are Spark aggregates, the grouping goes over all pages of a batch at once."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.functions.text import FOLD_FROM, FOLD_TO, WORDLIKE
from leafmark.operators import pages as pg

# Fixed values of the row grouping and of the float test; those that a caller may change are in Tuning.
LINE_HEIGHT_SHARE, COLUMN_LEAST_WIDTH, COLUMN_ROW_HEIGHT, ISOLATION, RESCUE_OVERLAP = 0.2, 0.2, 1.6, 2.2, 0.5
RUN_MIN_TOL, RUN_TOL_SHARE, RUN_SPACE = 2.0, 0.5, 0.12
RUN_SIDE, RUN_STRADDLE = 0.25, 0.15


@dataclass(frozen=True)
class Tuning:
    """What a caller may change; lengths are fractions of the page.

    float_words, float_width, float_margin: a float has at most so many words, is narrower, and begins further from its
    column's start. para_gap: of the line pitch. heading_scale: of the body height. column_width: of rows that tell the
    columns. split: where two columns part. line_y_tol, line_height_ratio: words of a line are as near, and as alike in height.
    """

    float_words: int = 3
    float_width: float = 0.15
    float_margin: float = 0.008
    para_gap: float = pg.PARA_GAP
    heading_scale: float = 2.0
    column_width: float = 0.55
    split: float = pg.SPLIT
    line_y_tol: float = 0.006
    line_height_ratio: float = 2.4

    def __post_init__(self):
        for name in ("float_words", "float_width", "float_margin", "line_y_tol"):
            if not 0 <= getattr(self, name) < float("inf"):
                raise ValueError(f"{name} must not be negative")
        for name in ("para_gap", "heading_scale", "column_width", "split", "line_height_ratio"):
            if not 0 < getattr(self, name) < float("inf"):
                raise ValueError(f"{name} must be positive")


OCR_LINE = "doc_id long, page int, ix int, col int, text string, x double, width double, mid_y double, h double, n_words long, is_float boolean, is_tall boolean, pitch double, median_h double, two_column boolean, words array<int>"
TEXT_LINE = "doc_id long, page int, ix int, col int, text string, x double, y double, h double, n_words long, words array<int>"
_FOLD = str.maketrans(FOLD_FROM, FOLD_TO)


def _typed(schema: str, given: DataFrame) -> str:
    """The schema with doc_id as the input has it."""
    return schema.replace("doc_id long", f"doc_id {given.schema['doc_id'].dataType.simpleString()}")


def row_numbers(part: np.ndarray, y: np.ndarray, h: np.ndarray, band: np.ndarray, tuning: Tuning) -> np.ndarray:
    """The row of every word, numbered as rows open; words come part by part, in each from the top, then from the left.

    A word joins the first open row of its part and band whose middle is within the tolerance and whose height isn't too
    different; it widens that row's box, so the outcome depends on the order. Middles only fall within a part, so a row
    that the tallest word left could not reach any more is closed. Of words with one level and height in a row, the
    second leaves the box as it is, so those after it go where it went.
    """
    found, opened, n, now = np.zeros(len(y), dtype=np.int64), [], -1, None
    if not len(y):
        return found
    starts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
    tallest = np.repeat(np.maximum.reduceat(h, starts), np.diff([*starts.tolist(), len(y)]))  # of the part
    near, ratio = tuning.line_y_tol, tuning.line_height_ratio
    same = np.concatenate([[False], (part[1:] == part[:-1]) & (band[1:] == band[:-1]) & (y[1:] == y[:-1]) & (h[1:] == h[:-1])])
    asked = np.flatnonzero(~same | ~np.concatenate([[False], same[:-1]]))
    for i, p, a, t, s, most_h in zip(asked.tolist(), *(v[asked].tolist() for v in (part, y, h, band, tallest)), strict=True):
        mid = a + t / 2
        if p != now:
            now, opened = p, []
        reached = False
        for row in opened:  # low, high, band, number
            low, high = row[0], row[1]
            tall = high - low
            apart = (high + low) / 2 - mid
            if apart > max(near, (tall if tall > most_h else most_h) * LINE_HEIGHT_SHARE):
                reached = True
                continue
            most, least = (tall, t) if tall > t else (t, tall)
            if row[2] == s and abs(apart) <= max(near, most * LINE_HEIGHT_SHARE) and most < least * ratio:
                row[0], row[1] = min(low, a), max(high, a + t)
                found[i] = row[3]
                break
        else:
            n += 1
            if reached:
                opened = [r for r in opened if (r[0] + r[1]) / 2 - mid <= max(near, max(r[1] - r[0], most_h) * LINE_HEIGHT_SHARE)]
            opened.append([a, a + t, s, n])
            found[i] = n
    return found[asked[np.searchsorted(asked, np.arange(len(y)), side="right") - 1]]


def _upper_medians(of: np.ndarray, values: np.ndarray, n: int, default: float) -> np.ndarray:
    """The upper median of the values of each of n groups."""
    order = np.lexsort((values, of))
    count = np.bincount(of, minlength=n)
    at = np.cumsum(count) - count + count // 2
    out = np.full(n, default)
    out[count > 0] = values[order][at[count > 0]]
    return out


def _pitches(page: np.ndarray, col: np.ndarray, mid_y: np.ndarray, n: int) -> np.ndarray:
    """The line pitch of each of n pages, from lines in reading order."""
    gap = mid_y[:-1] - mid_y[1:]
    use = (page[1:] == page[:-1]) & (col[1:] == col[:-1]) & (gap > 0.0005)
    return _upper_medians(page[1:][use], gap[use], n, pg.PITCH)


def _ranges(page: np.ndarray, x: np.ndarray, right: np.ndarray, tall: np.ndarray, band: np.ndarray, two: np.ndarray, median_h: np.ndarray, n: int, tuning: Tuning) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The x ranges of each page's columns (how many, their starts and ends, by place), from wide rows of body height.

    A column with fewer than two such rows has none; a page with one range has it at place 0, whichever column it is of.
    """
    wide = (right - x >= COLUMN_LEAST_WIDTH) & (tall <= median_h * COLUMN_ROW_HEIGHT) & (~two | (right - x <= tuning.column_width))
    lows, highs, counts = np.full((2, n), np.inf), np.full((2, n), -np.inf), np.zeros((2, n), dtype=np.int64)
    side = np.where(two, band, 0)
    np.minimum.at(lows, (side[wide], page[wide]), x[wide])
    np.maximum.at(highs, (side[wide], page[wide]), right[wide])
    np.add.at(counts, (side[wide], page[wide]), 1)
    has = counts > 1
    only = ~has[0] & has[1]
    lows[0, only], highs[0, only] = lows[1, only], highs[1, only]
    return has.sum(axis=0), lows, highs


def _columns(page: np.ndarray, x: np.ndarray, right: np.ndarray, count: np.ndarray, lows: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """The column that a row overlaps more, else the one with the nearer centre."""
    with np.errstate(invalid="ignore"):
        left, other = (np.clip(np.minimum(right, highs[k, page]) - np.maximum(x, lows[k, page]), 0, None) for k in (0, 1))
        far = [np.abs((x + right) / 2 - (lows[k, page] + highs[k, page]) / 2) for k in (0, 1)]
        return (np.where(left != other, left < other, far[0] > far[1]) & (count[page] == 2)).astype(np.int64)


def _floats(page: np.ndarray, text: list[str], col: np.ndarray, x: np.ndarray, width: np.ndarray, mid_y: np.ndarray, h: np.ndarray, ranges: tuple, tall_from: np.ndarray, tuning: Tuning) -> np.ndarray:
    """Short lines off their column's start that are narrow or lone display junk, unless they hang under a kept line.

    Lines in reading order, page by page; a line kept here may keep the next, so those in question are settled in order.
    """
    count, lows, _ = ranges
    is_float = np.zeros(len(text), dtype=bool)
    start = lows[np.minimum(col, 1), page]
    asked = np.flatnonzero((col < count[page]) & (np.abs(x - start) > tuning.float_margin))
    asked = asked[[sum(map(bool, text[i].split(" "))) <= tuning.float_words for i in asked.tolist()]] if len(asked) else asked
    if not len(asked):
        return is_float
    reach = _pitches(page, col, mid_y, len(count)) * tuning.para_gap
    begin = np.searchsorted(page, np.arange(len(count) + 1))
    for i in asked.tolist():
        a, z = begin[page[i]], begin[page[i] + 1]
        c, my, hh = col[a:z], mid_y[a:z], h[a:z]
        same = c == col[i]
        odd = width[i] < tuning.float_width
        if not odd and h[i] >= tall_from[i] and not re.search(WORDLIKE, text[i]):
            close = np.abs(my - mid_y[i]) < np.maximum(hh, h[i]) * ISOLATION
            close[i - a] = False
            odd = not (same & close & (hh >= tall_from[i])).any()
        if odd:
            k = i - a
            gap = my[:k] - mid_y[i]
            over = np.minimum(x[a:i] + width[a:i], x[i] + width[i]) - np.maximum(x[a:i], x[i])
            is_float[i] = not (same[:k] & (gap > 0) & (gap <= reach[page[i]]) & (over >= width[i] * RESCUE_OVERLAP) & ~is_float[a:i]).any()
    return is_float


def _runs_of(keys: np.ndarray) -> np.ndarray:
    """Where runs of equal keys begin."""
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)


def _lists(values: np.ndarray, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), pa.array(values.astype(np.int32)))


def _joined(said: list[str], size: np.ndarray, sep: str = " ") -> list[str]:
    out, at = [], 0
    for k in size.tolist():
        out.append(sep.join(said[at : at + k]))
        at += k
    return out


def page_marks(page: np.ndarray, x: np.ndarray, w: np.ndarray, h: np.ndarray, n: int, split: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """median_h, tall and two_column of every word's page, as pages.with_page_marks has them."""
    median_h = _upper_medians(page, h, n, 0.0)[page]
    tall = (h >= pg.TALL * median_h) | np.isnan(h)  # Spark has it above all numbers, here and below
    of = lambda c: np.bincount(page[~tall & c], minlength=n)
    body = np.maximum(1, of(True))
    least = np.maximum(float(pg.MIN_WORDS), body * pg.MIN_SHARE)
    middle = x + w / 2
    two = (of(middle < split - pg.GUTTER) >= least) & (of(~(middle <= split + pg.GUTTER)) >= least) & (of((x < split) & ~(x + w <= split)) <= body * pg.GUTTER_INK)
    return median_h, tall, two[page]


def page_lines(batch: pa.Table, page: np.ndarray, tuning: Tuning = Tuning()) -> dict[str, object]:
    """The lines of whole pages, in reading order, from their words; `page` numbers each word's page from 0."""
    n = int(page[-1]) + 1
    idx, x, y, w, h = (batch[c].to_numpy() for c in ("idx", "x", "y", "w", "h"))
    median_h, tall, two = page_marks(page, x, w, h, n, tuning.split)
    said = np.array(batch["text"].to_pylist(), dtype=object)
    first_of = _runs_of(page)
    at_idx = np.lexsort((idx, page))
    place = np.empty(len(page), dtype=np.int64)  # of a word on its page, by idx
    place[at_idx] = np.arange(len(page)) - np.repeat(first_of, np.diff([*first_of.tolist(), len(page)]))
    band = np.where(tall | ~two | (x + w / 2 < tuning.split), 0, 1)
    part = page * 2 + ~tall  # of each page, tall words make the first rows
    order = np.lexsort((place, x, -(y + h / 2), part))
    page, x, y, w, h, tall, two, median_h, band, said, place = (v[order] for v in (page, x, y, w, h, tall, two, median_h, band, said, place))
    row = row_numbers(part[order], y, h, band, tuning)

    by_row = np.argsort(row, kind="stable")  # in a row as they were entered
    begin = _runs_of(row[by_row])
    size = np.diff([*begin.tolist(), len(row)])
    rx, ry = np.minimum.reduceat(x[by_row], begin), np.minimum.reduceat(y[by_row], begin)
    right, top = np.maximum.reduceat((x + w)[by_row], begin), np.maximum.reduceat((y + h)[by_row], begin)
    letters = pc.utf8_length(batch["text"]).to_numpy()[order]
    longest = np.lexsort((np.arange(len(row)), -letters, row))[begin]  # of several the one entered first
    one = by_row[begin]
    height, r_page, r_band, r_tall, r_two, r_median = h[longest], page[one], band[one], tall[one], two[one], median_h[one]
    ranges = _ranges(r_page, rx, right, top - ry, r_band, r_two, r_median, n, tuning)
    col, mid_y = _columns(r_page, rx, right, *ranges), (ry + top) / 2

    down = np.lexsort((-mid_y, col, r_page))
    new_place = np.empty(len(down), dtype=np.int64)
    new_place[down] = np.arange(len(down))
    in_x = np.lexsort((np.arange(len(row)), x, new_place[row]))
    page, col, mid_y, lx, width, height, is_tall, two, median_h, size = r_page[down], col[down], mid_y[down], rx[down], (right - rx)[down], height[down], r_tall[down], r_two[down], r_median[down], size[down]
    text = _joined(said[in_x].tolist(), size)
    is_float = _floats(page, text, col, lx, width, mid_y, height, ranges, pg.TALL * median_h, tuning)
    pitch = _pitches(page[~is_float], col[~is_float], mid_y[~is_float], n)
    begin = _runs_of(page)
    return {
        "page_at": page, "ix": np.arange(len(page)) - np.repeat(begin, np.diff([*begin.tolist(), len(page)])), "col": col, "text": text, "x": lx, "width": width, "mid_y": mid_y, "h": height, "n_words": size,
        "is_float": is_float, "is_tall": is_tall, "pitch": pitch[page], "median_h": median_h, "two_column": two, "words": _lists(place[in_x], size),
    }


def _changes(keys: pa.Array) -> np.ndarray:
    """Whether each key differs from the one before, from the second on; without Python objects."""
    return pc.not_equal(keys.slice(1), keys.slice(0, max(0, len(keys) - 1))).to_numpy(zero_copy_only=False).astype(bool)


def by_page(rows: DataFrame, schema: str, lines: Callable[[pa.Table, np.ndarray], dict], order: tuple[str, ...] = ()) -> DataFrame:
    """lines() of whole pages, all those of a batch at a time; a task holds a batch and one page. Rows come by page, then in `order`.

    A page's rows must be in one partition already, as they are after a window over pages.
    """
    ordered = rows.sortWithinPartitions(*pg.PAGE, *order)
    out = _typed(schema, rows)
    names = [c.split()[0] for c in schema.replace("array<", "").split(", ")]

    def made(rest: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(rest).combine_chunks()
        doc, number = (table[c].chunk(0) for c in pg.PAGE)
        page = np.cumsum(np.concatenate([[False], _changes(doc) | _changes(number)]))
        got = lines(table, page)
        at = pa.array(_runs_of(page)[got.pop("page_at")])
        got = {"doc_id": doc.take(at), "page": number.take(at).cast(pa.int32())} | got
        kinds = {"ix": pa.int32(), "col": pa.int32(), "n_words": pa.int64(), "text": pa.string()}  # those whose type their values don't tell
        return pa.RecordBatch.from_arrays([v if isinstance(v, pa.Array) else pa.array(v, kinds.get(k)) for k, v in ((k, got[k]) for k in names)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for b in batches:
            if not b.num_rows:
                continue
            last = np.flatnonzero(_changes(b["doc_id"]) | _changes(b["page"]))
            begin = int(last[-1]) + 1 if len(last) else 0
            same = bool(rest) and all(rest[-1][c][-1] == b[c][0] for c in pg.PAGE)
            if begin == 0 and (same or not rest):  # a page of more than a batch
                rest.append(b)
                continue
            whole = [*rest, b.slice(0, begin)]
            rest = [b.slice(begin)]
            yield made(whole)
        if rest:
            yield made(rest)

    return ordered.mapInArrow(run, out)


def ocr_lines(words: DataFrame, tuning: Tuning = Tuning()) -> DataFrame:
    """Lines, floats and line pitch of recognised words. Words without text or box are left out; a page of none has no row.

    A window by page brings pages together, which moves nothing if they are; medians, tall words, columns and the grouping
    into rows, which depends on order, are settled over the pages of a batch.
    """
    whole = words.select("doc_id", F.col("page").cast("int").alias("page"), "idx", "text", *[F.col(c).cast("double").alias(c) for c in ("x", "y", "w", "h")]).dropna(subset=["doc_id", "page", "text", "x", "y", "w", "h"])
    together = whole.withColumn("nth", F.row_number().over(Window.partitionBy(*pg.PAGE).orderBy("idx")))
    return by_page(together, OCR_LINE, lambda batch, page: page_lines(batch, page, tuning))


def run_lines(batch: pa.Table, page: np.ndarray) -> dict[str, object]:
    """The lines of whole pages from their runs, which come from the top, then from the left; in points with y down."""
    x, y, w, h, place = (batch[c].to_numpy() for c in ("x", "y", "w", "h", "place"))
    col, said = batch["col"].to_numpy(), np.array(batch["text"].to_pylist(), dtype=object)
    line, level, levels, of, now, before = -1, 0.0, [], [], -1, -1
    for p, a, t, c in zip(page.tolist(), y.tolist(), h.tolist(), col.tolist(), strict=True):
        if p == now and c == before and abs(level - a) < max(RUN_MIN_TOL, t * RUN_TOL_SHARE):
            level = (level + a) / 2
            levels[line] = level
        else:
            line, level, now, before = line + 1, a, p, c
            levels.append(a)
        of.append(line)
    row = np.array(of)
    in_x = np.lexsort((np.arange(len(row)), x, row))
    row, x, w, h, place, said = row[in_x], x[in_x], w[in_x], h[in_x], place[in_x], said[in_x].tolist()
    begin = _runs_of(row)
    size = np.diff([*begin.tolist(), len(row)])
    apart = np.concatenate([[False], x[1:] - (x + w)[:-1] > h[:-1] * RUN_SPACE])
    apart[begin] = False
    spaced = [" " + s if a and not s[:1].isspace() and not said[i - 1][-1:].isspace() else s for i, (s, a) in enumerate(zip(said, apart.tolist(), strict=True))]
    text = [" ".join(t.translate(_FOLD).split()) for t in _joined(spaced, size, "")]
    height = h[begin]
    for k in np.flatnonzero(np.minimum.reduceat(h, begin) != np.maximum.reduceat(h, begin)).tolist():  # the height of most characters, the first of several
        chars: dict[float, int] = {}
        for i in range(begin[k], begin[k] + size[k]):
            chars[h[i]] = chars.get(h[i], 0) + len(said[i])
        height[k] = max(chars, key=chars.get)
    first, level = in_x[begin], np.array(levels)
    down = np.lexsort((np.arange(len(begin)), level, col[first], page[first]))
    keep = down[[text[k] != "" for k in down.tolist()]]
    at = page[first][keep]
    start = _runs_of(at)
    pieces = np.concatenate([np.arange(begin[k], begin[k] + size[k]) for k in keep.tolist()]) if len(keep) else np.zeros(0, dtype=np.int64)
    return {
        "page_at": at, "ix": np.arange(len(keep)) - np.repeat(start, np.diff([*start.tolist(), len(keep)])), "col": col[first][keep], "text": [text[k] for k in keep.tolist()], "x": x[begin][keep], "y": level[keep],
        "h": height[keep], "n_words": size[keep], "words": _lists(place[pieces], size[keep]),
    }


def text_lines(runs: DataFrame) -> DataFrame:
    """Lines of text-layer runs; blank runs are left out. A page has two columns if more than a quarter of its runs ends
    before its middle, more than a quarter begins beyond it, and less than 0.15 straddle it."""
    need = runs.select("doc_id", "page", "idx", "text", "x", "y", "w", "h", "page_width").where(r"text rlike '\\S'").dropna()
    page, mid, right = Window.partitionBy(*pg.PAGE), F.col("page_width") / 2, F.col("x") + F.col("w")
    share = lambda c: F.avg(c.cast("int")).over(page)
    two = (share(right < mid) > RUN_SIDE) & (share(F.col("x") > mid) > RUN_SIDE) & (share((F.col("x") < mid) & (right > mid)) < RUN_STRADDLE)
    placed = need.withColumn("page", F.col("page").cast("int")).withColumn("place", F.row_number().over(page.orderBy("idx")) - 1).withColumn("two", two)
    dealt = placed.select("doc_id", "page", "place", "text", "x", "y", "w", "h", ((F.col("x") > mid) & F.col("two")).cast("int").alias("col"))
    return by_page(dealt, TEXT_LINE, run_lines, ("y", "x", "place"))

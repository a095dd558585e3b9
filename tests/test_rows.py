"""Lines, columns and floats of constructed pages, and the grouping of a batch against a plain loop over each page."""

import random

import numpy as np
import pytest

from leafmark.operators import pages, rows

WORD = "doc_id int, page int, idx int, text string, x double, y double, w double, h double"


def _words(spark, words):
    return spark.createDataFrame([(1, 1, i, t, float(x), float(y), float(w), float(h)) for i, (t, x, y, w, h) in enumerate(words)], WORD)


def _lines(spark, words):
    return rows.ocr_lines(_words(spark, words)).orderBy("doc_id", "page", "ix").toPandas()


def _body(lines, x=0.07, top=0.8, words=8):
    return [(f"word{r}x{k}", x + 0.1 * k, top - 0.025 * r, 0.09, 0.017) for r in range(lines) for k in range(words)]


def test_narrow_line_off_the_column_floats_and_hanging_line_stays(spark):
    got = _lines(spark, [*_body(4), ("12", 0.5, 0.3, 0.02, 0.017), ("last", 0.4, 0.7, 0.05, 0.017)])
    assert got[got.is_float].text.tolist() == ["12"]
    assert "last" in got[~got.is_float].text.tolist()
    assert abs(got.pitch.iloc[0] - 0.025) < 1e-9


def test_lone_display_junk_floats_and_display_words_stay(spark):
    for text, floats in (("1/3", True), ("Open", False)):
        got = _lines(spark, [*_body(4, top=0.5), (text, 0.4, 0.8, 0.18, 0.068)])
        assert got[got.text == text].is_float.tolist() == [floats]


def test_two_columns_are_read_one_after_the_other(spark):
    left, right = _body(6, 0.05, words=4), _body(6, 0.55, words=4)
    got = _lines(spark, [w for pair in zip(left, right, strict=True) for w in pair])
    assert got.col.tolist() == [0] * 6 + [1] * 6 and got.n_words.eq(4).all()


def test_words_of_one_place_stay_as_they_were_entered(spark):
    got = _lines(spark, [("low", 0.1, 0.5, 0.05, 0.017), ("high", 0.1, 0.502, 0.05, 0.017), ("next", 0.2, 0.5, 0.05, 0.017)])
    assert got.text.tolist() == ["high low next"] and list(got.words[0]) == [1, 0, 2]


RUN = WORD + ", page_width double"


def test_runs_right_to_left_become_one_line(spark):
    runs = spark.createDataFrame([(1, 1, i, t, float(x), 100.0, float(w), 12.0, 612.0) for i, (t, x, w) in enumerate([("Right", 200, 24), ("Middle", 100, 36), ("Left", 50, 20)])], RUN)
    got = rows.text_lines(runs).first()
    assert got.text == "Left Middle Right" and got.words == [2, 1, 0]


def test_height_of_most_characters_and_blanks_between_runs(spark):
    runs = [("ab", 50.0, 10.0, 24.0), ("long text", 62.0, 50.0, 12.0), (" spaced", 120.0, 30.0, 12.0), ("glued", 150.0, 20.0, 12.0)]
    got = rows.text_lines(spark.createDataFrame([(1, 1, i, t, x, 100.0, w, h, 612.0) for i, (t, x, w, h) in enumerate(runs)], RUN)).first()
    assert (got.text, got.h) == ("ablong text spacedglued", 12.0)


def _page(r, n):
    """Words on and off lines, tall ones among them, some at one place."""
    h = lambda: r.choice([0.017] * 8 + [0.02, 0.012, 0.05, 0.068, 0.034])
    y = lambda: round(0.9 - 0.025 * r.randint(0, 25) + r.choice([0, 0, 0, 0.003, 0.006, -0.004, 0.01]), 4)
    return [(r.choice(["a", "word", "12", "1/3", "longer words"]), round(r.random() * 0.9, 2), y(), r.choice([0.05, 0.09, 0.02, 0.3]), h()) for _ in range(n)]


def _plain_rows(words):
    """Members of the rows of one page: every word against all rows that are open."""
    heights = sorted(w[4] for w in words)
    median = heights[len(heights) // 2]
    body = [w for w in words if w[4] < 2 * median]
    sides = [sum(w[1] + w[3] / 2 < 0.48 for w in body), sum(w[1] + w[3] / 2 > 0.52 for w in body)]
    two = min(sides) >= max(10, len(body) * 0.2) and sum(w[1] < 0.5 < w[1] + w[3] for w in body) <= len(body) * 0.03
    out = []
    for tall in (True, False):
        opened = []
        part = [(i, w) for i, w in enumerate(words) if (w[4] >= 2 * median) == tall]
        for i, (_, x, y, w, h) in sorted(part, key=lambda p: (-(p[1][2] + p[1][4] / 2), p[1][1], p[0])):
            band = int(two and not tall and x + w / 2 >= 0.5)
            for row in opened:
                most, least = max(row[1] - row[0], h), min(row[1] - row[0], h)
                if row[2] == band and abs((row[0] + row[1]) / 2 - (y + h / 2)) <= max(0.006, most * 0.2) and most < least * 2.4:
                    row[0], row[1] = min(row[0], y), max(row[1], y + h)
                    row[3].append(i)
                    break
            else:
                opened.append([y, y + h, band, [i]])
        out += [sorted(row[3], key=lambda i: words[i][1]) for row in opened]
    return sorted(out), median, two


def test_batches_of_pages_are_grouped_like_single_pages(spark):
    r = random.Random(7)
    made = {(d, p): _page(r, r.choice([1, 2, 7, 40, 150])) for d in range(40) for p in (1, 2)}
    made[(3, 1)] = _page(r, 12000)  # more than a batch
    frame = spark.createDataFrame([(d, p, i, *w) for (d, p), ws in made.items() for i, w in enumerate(ws)], WORD)
    got = rows.ocr_lines(frame).toPandas()
    stats = {(s.doc_id, s.page): s for s in pages.page_statistics(frame).collect()}
    for key, ws in made.items():
        want, median, two = _plain_rows(ws)
        page = got[(got.doc_id == key[0]) & (got.page == key[1])].sort_values("ix")
        assert sorted(list(w) for w in page.words) == want
        assert page.text.tolist() == [" ".join(ws[i][0] for i in m) for m in page.words] and page.ix.tolist() == list(range(len(want)))
        assert (page.median_h == median).all() and (page.two_column == two).all() and (stats[key].median_h, stats[key].two_column) == (median, two)
        assert stats[key].tall + stats[key].body == len(ws)


@pytest.mark.parametrize("n", [1, 2, 5, 6])
def test_medians_are_the_upper_ones(n):
    assert rows._upper_medians(np.zeros(n, dtype=int), np.arange(n, dtype=float), 1, 0.0).tolist() == [float(n // 2)]


def test_no_words_and_no_boxes(spark):
    empty = _words(spark, [])
    assert rows.ocr_lines(empty).count() == 0 and pages.page_statistics(empty).count() == 0
    some = _words(spark, _body(1)).selectExpr("doc_id", "page", "idx", "if(idx = 0, null, text) as text", "if(idx = 1, null, x) as x", "y", "w", "h")
    assert rows.ocr_lines(some).first().n_words == 6


def test_marks_of_a_page_are_those_of_its_statistics(spark):
    """Words of a batch get the medians, tall words and columns that Spark's statistics give; lines are made with one window and no more."""
    import random

    import numpy as np

    from leafmark.operators import pages, rows

    r = random.Random(4)
    boxes = [(p, r.choice((r.uniform(0.05, 0.43), r.uniform(0.55, 0.9))) if p % 3 else r.uniform(0, 0.9), 0.05, r.choice((0.017, 0.017, 0.02, 0.034, 0.05, float("nan")))) for p in range(12) for _ in range(1 if p == 5 else 60)]
    words = spark.createDataFrame([(1, p, i, "w", x, 0.5, w, h) for i, (p, x, w, h) in enumerate(boxes)], "doc_id long, page int, idx int, text string, x double, y double, w double, h double")
    want = [(m.median_h, m.tall, m.two_column) for m in pages.with_page_marks(words).orderBy("idx").collect()]
    p, x, w, h = (np.array(c) for c in zip(*boxes, strict=True))
    got = list(zip(*(c.tolist() for c in rows.page_marks(p, x, w, h, 12, 0.5)), strict=True))
    assert repr(got) == repr(want) and {t for _, _, t in want} == {True, False}
    assert rows.ocr_lines(words)._jdf.queryExecution().optimizedPlan().toString().count("Window [") == 1

"""Every layout query with SQL gives the same rows as that SQL."""

import os
import re
import unicodedata

import duckdb
import pytest

from leafmark.operators import analysis, audit, emit, rows, tables
from leafmark.plans import layout_queries as Q
from leafmark.sources import layout

SF = "/root/testdata/sf0.001"


def _rows(frame):
    frame = frame[sorted(frame.columns)]
    return sorted(tuple("null" if v != v or v is None else repr(float(v)) if isinstance(v, (int, float)) or hasattr(v, "dtype") else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_same_as_sql(spark, name):
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    want, got = con.execute(Q.ORACLE[name]).fetchdf(), Q.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert _rows(want) == _rows(got)


def test_entry_imports(spark):
    import __spark_entry__ as e

    assert set(Q.QUERIES) <= set(e.queries())
    assert e.entry(spark).count() > 0


def _of_documents(spark, tmp_path, name, texts):
    """Whether a query and its SQL agree on documents of these texts."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(texts)))
    con.execute(f"COPY documents TO '{tmp_path}/documents.parquet'")
    want, got = con.execute(Q.ORACLE[name]).fetchdf(), Q.QUERIES[name](spark, str(tmp_path)).toPandas()
    return _rows(want) == _rows(got)


def test_bare_value_after_a_label(spark, tmp_path):
    """A line that ends in a colon, and a last line of a version number only; in one column and in two."""
    texts = [" ".join([*(f"word{i}" for i in range(12 * 6)), "4.0."]), " ".join([*(f"word{i}" for i in range(6 * 6)), "2.0."])]
    assert _of_documents(spark, tmp_path, "text_blocks", [texts[1], texts[0], texts[0], texts[1]])


def test_words_are_dealt_by_their_text(spark, monkeypatch):
    """Partitions grow with the text, and neither windows nor joins by page shuffle its words."""
    monkeypatch.setattr(tables, "TASK_BYTES", 4000, raising=False)
    words = layout.laid_out(spark.range(40).selectExpr("id AS doc_id", "repeat('word ', 800) AS text"))
    assert words.rdd.getNumPartitions() == 40
    body = words.groupBy("doc_id", "page").agg({"text": "max"}).withColumnRenamed("max(text)", "body")
    for made in (audit.leftovers(words, body), audit.source_pairs(audit.runs_with_tokens(words))):
        assert "ENSURE_REQUIREMENTS" not in made._jdf.queryExecution().executedPlan().toString()


def test_composing_parts_no_tokens():
    """The composed form of any text has its tokens at the same places."""
    kind = lambda c: "t" if unicodedata.category(c)[0] in "LN" else "m" if unicodedata.category(c)[0] == "M" else "o"
    shape = lambda s: re.sub("t[tm]*|o+m*|m+", lambda m: m[0][0], "".join(map(kind, s)))
    for c in map(chr, (*range(0xD800), *range(0xE000, 0x110000))):
        parts = unicodedata.normalize("NFD", c)
        if parts != c:
            assert shape(c) == shape(parts) == shape(unicodedata.normalize("NFC", parts)), hex(ord(c))


def test_shared_tokens_of_odd_documents(spark, tmp_path):
    """Repeated, missing and empty neighbours, null texts, and ids with a gap."""
    assert _of_documents(spark, tmp_path, "word_overlap", ["a b b É", "b b b c é", "", None, "a", "a a", "-", "a a"])
    assert _of_documents(spark, tmp_path, "overlap_shares", ["a b b É", "b b b c é", "", None, "a", "a a", "-", "a a"])


def test_lines_are_dealt_once_for_blocks(spark, tmp_path):
    """Heading levels come to the lines by document, so that a page's lines are shuffled once however many levels there are."""
    lines = tables.written(rows.ocr_lines(layout.laid_out(spark.range(40).selectExpr("id AS doc_id", "repeat('word ', 800) AS text"))), "lines")
    blocks = emit.recognised_blocks(lines, emit.recognised_levels(lines).hint("merge")).where("type <> 'float'")
    plan = blocks._jdf.queryExecution().executedPlan().toString()
    assert not any("Exchange" in x and "hashpartitioning" in x and "page#" in x.split("hashpartitioning")[1].split(",")[1] for x in plan.splitlines())


def test_audited_pages_are_tokenised_once(spark):
    """The words' tokens, the body's and its gaps are looked for once each, and not again to tell pages that differ."""
    words = layout.laid_out(spark.range(40).selectExpr("id AS doc_id", "repeat('word ', 800) AS text"))
    body = words.groupBy("doc_id", "page").agg({"text": "max"}).withColumnRenamed("max(text)", "body")
    plan = audit.leftovers(words, body)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_extract_all") == 3


def test_literal_matches_of_odd_pages(spark):
    """Composed and decomposed letters are one token, and the later of repeated tokens are left, on either side."""
    words = spark.createDataFrame([(1, 1, 0, "e\u0301 a a"), (1, 1, 1, "b a é"), (1, 2, 0, "-"), (2, 1, 0, "a b"), (None, 1, 0, "x")], "doc_id long, page int, idx int, text string")
    bodies = spark.createDataFrame([(1, 1, "É <b> a a-\nz z"), (1, 2, "q"), (2, 2, "a"), (None, 1, "x")], "doc_id long, page int, body string")
    got = sorted(tuple(r) for r in audit.leftovers(words, bodies).where("doc_id is not null").collect())
    assert got == [(1, 1, "o", 4, "z", ""), (1, 1, "o", 5, "z", ""), (1, 1, "s", 4, "a", ""), (1, 1, "s", 5, "é", ""), (1, 2, "o", 0, "q", ""), (2, 1, "s", 0, "a", ""), (2, 1, "s", 1, "b", "")]


def test_repairs_shuffle_pages_not_tokens(spark):
    """What is left of a page, and its pairs, are a row each where they are shuffled or joined; words stay where they are."""
    words = layout.laid_out(spark.range(40).selectExpr("id AS doc_id", "repeat('ab- cd word ', 800) AS text")).where("text <> 'word' or idx % 5 = 0")
    body = words.groupBy("doc_id", "page").agg({"text": "max"}).selectExpr("doc_id", "page", "'abcd abcd more' AS body")
    plan = audit.missing_words(words, body)._jdf.queryExecution().optimizedPlan().toString()
    joins = [x for x in plan.splitlines() if "Join" in x]
    assert len(joins) == 2 and not any("token" in x or "first" in x or "second" in x for x in joins)


def test_listed_words_are_not_copied(spark):
    """Words get their types one by one as they are read; no array of a page's words is cast."""
    words = layout.laid_out(spark.range(4).selectExpr("id AS doc_id", "repeat('word ', 800) AS text"))
    blocks = emit.recognised_blocks(tables.written(rows.ocr_lines(words), "lines"), spark.createDataFrame([], "doc_id long, size double, level int"))
    pages = analysis.page_rows(words, blocks, words.select("doc_id", "page").distinct().selectExpr("*", "'ocr' AS path"))
    assert "as array<struct" not in pages._jdf.queryExecution().optimizedPlan().toString()
    assert pages.schema.simpleString() == f"struct<doc_id:bigint,page:int,path:string,words:array<{analysis.WORD}>,blocks:array<{analysis.BLOCK}>>"

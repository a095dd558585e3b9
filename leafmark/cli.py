"""python -m leafmark extract WORDS.jsonl|FILE.pdf|FOLDER [OUT] | render FILE.pdf N[-M] | audit WORDS.jsonl OUT.md.

A folder of dumps, or with --plugin of PDFs, has a file for each of its documents, in the folder OUT or in itself.

Every failure ends with code 19. PDFs need --plugin: a module with parse(bytes), rasterise(path, page, dpi) for render,
and, where pages are to be recognised, engine(path, page, sparse, dpi) or open_engine(dpi), a context manager that gives
engine(path, page, sparse) for a range of pages; see sources.pdf for what they give.
"""

from __future__ import annotations

import argparse
import importlib
import json
import os
import re
import sys
from dataclasses import fields
from functools import partial
from pathlib import Path

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark import __version__, api
from leafmark.errors import LeafmarkError, coded
from leafmark.operators import analysis
from leafmark.operators.rows import Tuning
from leafmark.sources import pdf
from leafmark.sources.layout import read_audit_dump, read_word_dump
from leafmark.sources.sinks import stem, write_documents

FAILED = 19
SUFFIX = {"md": "md", "txt": "txt", "raw": "json"}


class _Parser(argparse.ArgumentParser):
    def error(self, message):
        self.print_usage(sys.stderr)
        self.exit(FAILED, f"{message}\n")


def page_range(spec: str) -> tuple[int, int]:
    found = re.fullmatch(r"(\d+)(?:-(\d+))?", spec)
    first = int(found[1]) if found else 0
    last = int(found[2] or first) if found else 0
    if first < 1 or last < first:
        raise argparse.ArgumentTypeError("pages are N or N-M, N >= 1, M >= N")
    return first, last


def positive(text: str) -> float:
    value = float(text)
    if not 0 < value < float("inf"):
        raise argparse.ArgumentTypeError("a positive number is needed")
    return value


def count(text: str) -> int:
    return int(float(text))


def parser() -> argparse.ArgumentParser:
    top = _Parser(prog="leafmark")
    top.add_argument("--version", action="version", version=__version__)
    sub = top.add_subparsers(dest="command", required=True)
    ex = sub.add_parser("extract")
    ex.add_argument("words")
    ex.add_argument("out", nargs="?")
    ex.add_argument("--format", choices=tuple(SUFFIX), default="md")
    ex.add_argument("--pages", type=page_range)
    ex.add_argument("--dictionary", help="a word a line; else $LEAFMARK_DICTIONARY")
    for knob in fields(Tuning):
        kind = count if knob.type == "int" else positive if knob.default > 0.1 else float
        ex.add_argument("--" + knob.name.replace("_", "-"), type=kind, default=knob.default)
    ex.add_argument("--stdout", action="store_true")
    ex.add_argument("--debug-words", metavar="FILE", help="write the words of the pages asked for, one JSON object a line")
    ex.add_argument("--json", action="store_true", help="print the report")
    ex.add_argument("--page-markers", action="store_true", help="of PDFs whose pages all have text")
    which = ex.add_mutually_exclusive_group()
    which.add_argument("--ocr", action="store_const", const=True, help="recognise all pages of a PDF")
    which.add_argument("--no-ocr", dest="ocr", action="store_const", const=False, help="recognise none")
    re_ = sub.add_parser("render")
    re_.add_argument("pdf")
    re_.add_argument("pages", type=page_range)
    re_.add_argument("--out", "-o", default=".")
    for command in (ex, re_):
        command.add_argument("--dpi", "-d", type=positive, default=288.0)
        command.add_argument("--plugin", help="module that parses, draws and recognises PDFs")
    au = sub.add_parser("audit")
    au.add_argument("words")
    au.add_argument("markdown")
    return top


def words_of(spark: SparkSession, path: str):
    """The dump's words in order, and how many lines weren't such."""
    dump = read_word_dump(spark, path)
    return dump.where("not bad").drop("bad"), dump.where("bad").count()


def plugin(args):
    """The module of --plugin, which tasks get by value."""
    if not args.plugin:
        raise LeafmarkError("PDF_OPEN", "PDFs need --plugin")
    module = importlib.import_module(args.plugin)
    cloudpickle.register_pickle_by_value(module)
    return module


def parsed_pdf(spark: SparkSession, path: str, module) -> DataFrame:
    parsed = pdf.read_pdfs(spark, path, module.parse).persist()
    wrong = parsed.where("error is not null").limit(1).collect()
    if wrong:
        raise LeafmarkError("PDF_OPEN", wrong[0].error)
    return parsed


def no_engine(doc: str, page: int, sparse: bool) -> list[dict]:
    raise LeafmarkError("PDF_OPEN", f"page {page} of {doc} needs recognition, but the plug-in has no engine")


def analyzed_file(spark: SparkSession, args) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame | None]:
    """Pages, words read, warnings and what the report has besides, of a dump or a PDF."""
    dictionary = args.dictionary or os.environ.get("LEAFMARK_DICTIONARY")
    if not dictionary:
        print("no dictionary: words broken at a line's end keep their hyphen", file=sys.stderr)
    known = spark.read.text(dictionary).select(F.lower(F.trim("value")).alias("word")).where("word <> ''") if dictionary else None
    tuning = Tuning(**{knob.name: getattr(args, knob.name) for knob in fields(Tuning)})
    o = api.Options(args.pages, args.page_markers, known, args.ocr, tuning)
    if not (args.words.lower().endswith(".pdf") or (os.path.isdir(args.words) and args.plugin)):
        words, skipped = words_of(spark, args.words)
        if skipped:
            print(f"skipped {skipped} lines that aren't words", file=sys.stderr)
        pages = api.analyze_words(words, o).persist()
        return pages, words, api.warnings(pages), None
    module = plugin(args)
    parsed = parsed_pdf(spark, args.words, module)
    engine = partial(module.engine, dpi=args.dpi) if hasattr(module, "engine") else no_engine
    opened = partial(module.open_engine, dpi=args.dpi) if hasattr(module, "open_engine") else None
    pages, words = api.analyze_parsed(parsed, engine, o, opened)
    pages = pages.persist()  # read by the notices, the report and the rendering
    info = pdf.image_signals(parsed)
    return pages, words, api.warnings(pages, info, args.ocr is True), api.builder_report(pages, pdf.runs_of(parsed), info, o)


def render(spark: SparkSession, args) -> int:
    module = plugin(args)
    n = pdf.page_counts(parsed_pdf(spark, args.pdf, module))
    if n.isEmpty():
        raise LeafmarkError("PDF_OPEN", f"{args.pdf} has no pages")
    first, last = args.pages
    pages = n.select("doc_id", "n_pages", F.explode(F.sequence(F.lit(first), F.lit(last))).alias("page"))
    for row in sorted(pdf.write_pages(pages, module.rasterise, args.out, args.dpi).collect(), key=lambda r: r.page):  # sorted here, lest pages are drawn twice
        print(row.path)
    return 0


def summary(name: str, r: dict) -> str:
    """A line on one document: those of recognised pages alone have one form, the others another."""
    rate = f"~{r['chars_per_page']} chars/page"
    if r["path"] == "ocr":
        return f"{name:32} OCR path heads={r['headings']}(junk {r['junk_headings']}) paras={r['paragraphs']} callouts={r['callouts']} floats={r['floats']} dangling={r['dangling_long']} (long) {rate}"
    sparse = "  implausibly sparse: pages may be images; try --ocr" if r["sparse"] else ""
    return f"{name:32} body={r['body_height']}pt heads={r['headings']}(junk {r['junk_headings']}) lists={r['list_items']} paras={r['paragraphs']} callouts={r['callouts']} pairs={r['joined_pairs']} {rate}{sparse}"


def contents(pages: DataFrame, report: DataFrame, args) -> DataFrame:
    """doc_id, content of every document in the format asked for."""
    made = analysis.to_json(pages, report) if args.format == "raw" else analysis.render_markdown(pages, args.page_markers) if args.format == "md" else analysis.render_text(pages)
    return made.toDF("doc_id", "content")


def extract(spark: SparkSession, args) -> int:
    pages, words, notes, besides = analyzed_file(spark, args)
    many = os.path.isdir(args.words)
    for w in notes.orderBy("doc_id", "page").toLocalIterator():
        print(f"{os.path.basename(w.doc_id)}: {w.warning}" if many else w.warning, file=sys.stderr)
    if args.debug_words:
        with open(args.debug_words, "w", encoding="utf-8") as out:
            for w in analysis.word_dump(pages).toLocalIterator():
                out.write(w.line + "\n")
    report = api.report(pages, words, args.page_markers)
    if besides is not None:
        report = report.join(besides, "doc_id", "left")
    report = report.persist()
    if not report.limit(1).collect():
        raise LeafmarkError("WORDS_INPUT", "no words")
    made, suffix = contents(pages, report, args), SUFFIX[args.format]
    if many and not args.stdout:
        written = write_documents(made, args.out or args.words, suffix, args.format == "raw").select("doc_id", F.col("path").alias("out"))
        report = report.join(written, "doc_id")
    elif args.stdout:
        for row in made.orderBy("doc_id").toLocalIterator():
            sys.stdout.write(json.dumps(json.loads(row.content), indent=1, ensure_ascii=False) if args.format == "raw" else row.content)
        report = report.withColumn("out", F.concat(stem(F.col("doc_id")), F.lit(f".{suffix}")))
    else:
        content, dest = made.first().content, args.out or f"{re.sub(r'[.](pdf|jsonl)$', '', args.words, flags=re.I)}.{suffix}"
        Path(dest).write_text(json.dumps(json.loads(content), indent=1, ensure_ascii=False) if args.format == "raw" else content, encoding="utf-8")
        report = report.withColumn("out", F.lit(dest))
    for row in report.orderBy("doc_id").toLocalIterator():
        r = row.asDict()
        source = r.pop("doc_id") if many else args.words
        if args.json:
            print(json.dumps({"source": source, "out": r.pop("out"), **r}, indent=1))
        else:
            print(summary(Path(r["out"]).name, r), file=sys.stderr)
    return 0


def audit(spark: SparkSession, args) -> int:
    words = read_audit_dump(spark, args.words)
    wrong = words.where("error is not null").orderBy("idx").select("error").limit(101).collect()
    if wrong:
        more = "; and more" if len(wrong) > 100 else ""
        raise LeafmarkError("AUDIT_INPUT", "audit evidence is invalid: " + "; ".join(r.error for r in wrong[:100]) + more)
    words = words.drop("error").withColumn("doc_id", F.lit(1))
    marked = spark.createDataFrame([(1, Path(args.markdown).read_text(encoding="utf-8"))], "doc_id int, md string")
    lines, totals = api.audit(words, marked)
    for row in lines.orderBy("page").toLocalIterator():
        print(row.line)
    t = totals.first()
    print(f"parsed={t.parsed} non-json-skipped=0 pages={t.pages} words={t.words} strict_deficits={t.strict_deficits} MISSING={t.missing}")
    return FAILED if t.missing else 0


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    spark = SparkSession.builder.appName("leafmark").getOrCreate()
    try:
        with coded("WORDS_INPUT", "ANALYSIS_INPUT"):
            return {"extract": extract, "render": render, "audit": audit}[args.command](spark, args)
    except LeafmarkError as e:
        print(f"{e.code}: {e}", file=sys.stderr)
    except Exception as e:  # a missing file, an unreadable dictionary, an empty dump: one exit code for all
        print(f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", file=sys.stderr)
    return FAILED

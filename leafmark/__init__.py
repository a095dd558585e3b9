"""Leafmark: document layout analytics on Spark."""

from leafmark.api import Options, analyze_auto, analyze_parsed, analyze_runs, analyze_words, audit, builder_report, mixed, page_report, report, warnings
from leafmark.errors import LeafmarkError
from leafmark.operators.analysis import render_markdown, render_text, to_json, to_markdown, to_text, word_dump
from leafmark.operators.rows import Tuning
from leafmark.sources.layout import read_word_dump
from leafmark.sources.pdf import read_pdfs, render_pages, write_pages

__version__ = "0.2.0"
__all__ = [
    "LeafmarkError", "Options", "Tuning", "analyze_auto", "analyze_parsed", "analyze_runs", "analyze_words", "audit", "builder_report", "mixed", "page_report", "read_pdfs",
    "read_word_dump", "render_markdown", "render_pages", "render_text", "report", "to_json", "to_markdown", "to_text", "warnings", "word_dump", "write_pages",
]

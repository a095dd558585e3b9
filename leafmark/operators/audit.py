"""The word audit: every recognised word must be on its page of the Markdown, literally or through a hyphen's repair."""

from __future__ import annotations

import unicodedata
from collections import defaultdict, deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.errors import LeafmarkError
from leafmark.functions.text import fold_typographic, valid_record
from leafmark.operators.pages import PAGE
from leafmark.operators.tables import written

# Hyphens, and the text between two tokens that a hyphen joins on one line or over a line's end.
HYPHEN_END = r"[\p{Pd}−]\s*\z"
HYPHEN_ONLY = r"^[\p{Pd}−]\s*\z"
INLINE_GAP = r"^[\p{Pd}−][ \t]*\z"
LINE_GAP = r"^[\p{Pd}−][ \t]*\r?\n[ \t]*\z"
TOKEN = r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"
TOKEN_AND_GAP = rf"({TOKEN})([^\p{{L}}\p{{N}}]*)"
SAMPLE = 12
#: Pages whose tokens a task holds at once.
PAGES_AT_ONCE = 256

# What isn't text in Markdown, and what stands for it; in this order.
STRIPPED = (
    (r"(?s)<!--.*?-->", " "), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"!\[[^\]]*\]\[[^\]]*\]", " "), (r"(?i)<img\b[^>]*>", " "), (r"(?i)<a\b[^>]*>", " "), (r"(?i)</a>", " "),
    (r"(?m)^\s*\[[^\]]+\]:[^\n]*$", " "), (r"(?m)^>\s*\[(?:review:[^\]]*|floats)\]\s*", ""), (r"\[([^\]]*)\]\([^)]*\)", "$1"), (r"\[([^\]]*)\]\[[^\]]*\]", "$1"),
)


def markdown_text(md: Column) -> Column:
    text = md
    for pattern, stands in STRIPPED:
        text = F.regexp_replace(text, pattern, stands)
    return F.when(F.contains(md, F.lit("<")) | F.contains(md, F.lit("[")), text).otherwise(md)  # each pattern has one of the two


def source_pairs(runs: DataFrame) -> DataFrame:
    """doc_id, page, rank, first, second, hyphen: tokens that a repair may join, in the order of attempts.

    Inside a run a hyphen stands between them. Of following runs, the first ends in a hyphen, or a run of a hyphen alone
    is between them, or two runs of one token each touch. runs: doc_id, page, idx, text, x, y, w, h, n, gaps, at (as of
    runs_with_tokens).
    """
    order = Window.partitionBy(*PAGE).orderBy("idx")
    lead = lambda c, n=1: F.lead(c, n).over(order)
    last = F.col("at") + F.col("n") - 1
    ends, lone = F.col("text").rlike(HYPHEN_END), F.col("text").rlike(HYPHEN_ONLY)
    known = runs.withColumn("last", last).withColumn("ends", ends).withColumn("lone", lone)
    tall = F.greatest("h", lead("h"))
    touch = (tall > 0) & (F.abs(F.col("y") - lead("y")) <= tall * 0.25) & (F.abs(lead("x") - (F.col("x") + F.col("w"))) <= tall * 0.15)
    single = (F.col("n") == 1) & (lead("n") == 1) & ~F.col("ends") & ~lead("lone") & ~F.col("text").rlike(r"\s$") & ~lead("text").rlike(r"^\s")
    pair = lambda cond, kind, second, hyphen: F.when(F.coalesce(cond, F.lit(False)), F.struct(F.lit(1).alias("part"), F.col("idx").alias("run"), F.lit(kind).alias("kind"), F.col("last").alias("first"), second.alias("second"), F.lit(hyphen).alias("hyphen")))
    between = F.array_compact(F.array(
        pair((F.col("n") > 0) & F.col("ends") & (lead("n") > 0), 0, lead("at"), True),
        pair(single & touch, 1, lead("at"), False),
        pair((F.col("n") > 0) & lead("lone") & (lead("n", 2) > 0), 2, lead("at", 2), True),
    ))
    held = F.filter(F.transform(F.col("gaps"), lambda g, k: F.struct(F.lit(0).alias("part"), F.col("idx").alias("run"), k.alias("kind"), (F.col("at") + k).alias("first"), (F.col("at") + k + 1).alias("second"), g.rlike(INLINE_GAP).alias("hyphen"))), lambda p: p["hyphen"] & (p["second"] <= F.col("last")))
    kind = "array<struct<part:int,run:long,kind:int,first:long,second:long,hyphen:boolean>>"
    each = known.select(*PAGE, between.cast(kind).alias("b"), F.coalesce(held.cast(kind), F.array().cast(kind)).alias("i")).select(*PAGE, F.explode(F.concat("i", "b")).alias("p"))
    return each.select(*PAGE, F.struct("p.part", "p.run", "p.kind").alias("rank"), "p.first", "p.second", "p.hyphen")


MISSING = "doc_id long, page int, at long, token string"


def _repaired(source: dict[int, str], output: dict[int, tuple[str, str]], pairs: list[tuple[int, int, bool]]) -> list[tuple[int, str]]:
    """The tokens of one page still missing after repairs.

    Pairs, in turn, take the first output that spells their joined form: two tokens around a hyphen, else one token; then
    single source tokens take two tokens around a line's end. An output serves once.
    """
    whole, split = defaultdict(deque), {"inline": defaultdict(deque), "line": defaultdict(deque)}
    for at, (token, gap) in output.items():
        whole[token].append((at,))
        if gap in split and at + 1 in output:
            split[gap][token + output[at + 1][0]].append((at, at + 1))

    def take(form: str, *tables) -> bool:
        for places in (t[form] for t in tables if form in t):
            while places:
                first = places.popleft()  # what isn't free now won't be again
                if all(at in output for at in first):
                    for at in first:
                        del output[at]
                    return True
        return False

    for first, second, hyphen in pairs:
        if first in source and second in source:
            tables = (split["inline"], split["line"], whole) if hyphen else (whole,)
            if take(source[first] + source[second], *tables):
                del source[first], source[second]
    return [(at, token) for at, token in source.items() if not take(token, split["line"])]


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """_repaired() of pages, a row each: source (at, token), output (at, token, gap) and pairs (rank first), all in order."""
    for batch in (whole.slice(a, PAGES_AT_ONCE) for whole in batches for a in range(0, whole.num_rows, PAGES_AT_ONCE)):
        lost: list[tuple[int, int, str]] = []
        held = {c: (batch[c].offsets.to_numpy() - batch[c].offsets[0].as_py(), [f.to_pylist() for f in batch[c].flatten().flatten()]) for c in ("source", "output", "pairs")}
        of = lambda c, i: zip(*(f[held[c][0][i] : held[c][0][i + 1]] for f in held[c][1]), strict=True)  # noqa: E731, B023
        for i in range(batch.num_rows):
            output = {at: (token, gap) for at, token, gap in of("output", i)}
            lost += [(i, at, token) for at, token in (_repaired(dict(of("source", i)), output, [p[3:] for p in of("pairs", i)]) if output else of("source", i))]
        page = pa.array([x[0] for x in lost], pa.int64())
        yield pa.RecordBatch.from_arrays([batch["doc_id"].take(page), batch["page"].take(page), pa.array([x[1] for x in lost], pa.int64()), pa.array([x[2] for x in lost], pa.string())], names=[c.split()[0] for c in MISSING.split(", ")])


def runs_with_tokens(words: DataFrame) -> DataFrame:
    """The words with n (their tokens), gaps (what follows each of several; else null) and at (the page's number of the first).

    Texts are taken as they are: composing them (NFC) neither makes nor parts tokens, it only respells them.
    """
    folded = F.lower(fold_typographic(F.col("text")))
    n = F.regexp_count(folded, F.lit(TOKEN))
    gaps = F.when(F.col("n") > 1, F.regexp_extract_all(folded, F.lit(TOKEN_AND_GAP), F.lit(2)))
    return words.withColumn("n", n).withColumn("at", (F.sum("n").over(Window.partitionBy(*PAGE).orderBy("idx")) - F.col("n")).cast("long")).withColumn("gaps", gaps)


def source_pages(words: DataFrame) -> DataFrame:
    """doc_id, page, parsed (words) and said: the page's words in order, a line each, so no token goes over two words."""
    of_page = words.groupBy(*PAGE).agg(F.count(F.lit(1)).alias("parsed"), F.array_sort(F.collect_list(F.struct("idx", "text"))).alias("ws"))
    return of_page.select(*PAGE, "parsed", F.array_join("ws.text", "\n").alias("said"))


def absent_pages(words: DataFrame, bodies: DataFrame) -> DataFrame:
    """doc_id, page of pages with words that the Markdown doesn't mark."""
    return words.select(*PAGE).distinct().join(bodies.select(*PAGE), list(PAGE), "left_anti")


LEFT = "doc_id long, page int, side string, at long, token string, gap string"


def _numbered(tokens: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Composed (NFC) tokens as numbers, and what these stand for."""
    coded = tokens.dictionary_encode()
    number = coded.indices.to_numpy()
    composed = pa.array([t if t.isascii() else unicodedata.normalize("NFC", t) for t in coded.dictionary.to_pylist()], pa.string()).dictionary_encode()
    return composed.indices.to_numpy().astype(np.int64)[number], composed.dictionary


def _literal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What of a page's tokens (said) and its body's (shown, with gaps) has no counterpart: the k-th of a token takes the k-th."""
    for batch in (whole.slice(a, PAGES_AT_ONCE) for whole in batches for a in range(0, whole.num_rows, PAGES_AT_ONCE)):
        sides = [batch[c].flatten() for c in ("said", "shown")]
        size = np.concatenate([np.diff(batch[c].offsets.to_numpy()) for c in ("said", "shown")])
        number, spelled = _numbered(pa.concat_arrays(sides))
        page = np.repeat(np.tile(np.arange(batch.num_rows), 2), size)
        at = np.arange(len(page)) - np.repeat(np.cumsum(size) - size, size)
        output = np.arange(len(page)) >= len(sides[0])
        key = page * max(1, len(spelled)) + number
        order = np.argsort(key, kind="stable")  # of a page's token the sources, then the outputs
        begin = np.flatnonzero(np.diff(key[order], prepend=-1))
        n = np.diff(begin, append=len(order))
        outputs = np.add.reduceat(output[order], begin, dtype=np.int64) if len(begin) else n
        kth = np.arange(len(order)) - np.repeat(begin, n)
        shown, both = output[order], np.repeat(np.minimum(n - outputs, outputs), n)
        rows = np.sort(order[np.where(shown, kth - np.repeat(n - outputs, n), kth) >= both])
        rows = rows[np.argsort(page[rows], kind="stable")]
        of_page, out = pa.array(page[rows]), output[rows]
        gap = np.full(len(rows), "", dtype=object)
        gap[out] = batch["gaps"].flatten().take(pa.array(rows[out] - len(sides[0]))).to_pylist()
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"].take(of_page), batch["page"].take(of_page), pa.array(np.where(out, "o", "s").tolist(), pa.string()), pa.array(at[rows]), spelled.take(pa.array(number[rows])), pa.array(gap, pa.string())],
            names=[c.split()[0] for c in LEFT.split(", ")],
        )


def leftovers(words: DataFrame, bodies: DataFrame) -> DataFrame:
    """doc_id, page, side (s source, o output), at, token, gap: what is left of both sides once the k-th literal occurrence
    of a token in the words has taken the k-th in the page's body.

    Pages are tokenised whole, once, and both sides joined by page, a row each; tokens are counted off over many pages at
    a time, which takes no further shuffle, and a task holds some pages.
    """
    # a left join keeps the pages where they are; bodies of pages without words aren't asked for. Texts are shuffled, tokens aren't
    pages = source_pages(words.select(*PAGE, "idx", "text")).join(bodies.select(*PAGE, markdown_text(F.col("body")).alias("body")), list(PAGE), "left")
    folded = lambda c: F.lower(fold_typographic(c))
    both = pages.select("doc_id", F.col("page").cast("int").alias("page"), folded(F.col("said")).alias("said"), folded(F.coalesce("body", F.lit(""))).alias("body"))
    found = lambda c, pattern, part: F.regexp_extract_all(c, F.lit(pattern), F.lit(part))
    both = both.select(*PAGE, found("said", TOKEN, 0).alias("said"), found("body", TOKEN_AND_GAP, 1).alias("shown"), found("body", TOKEN_AND_GAP, 2).alias("gaps"))
    rows = both.mapInArrow(_literal, LEFT.replace("doc_id long", f"doc_id {both.schema['doc_id'].dataType.simpleString()}"))
    gap = F.when(F.col("gap").rlike(INLINE_GAP), "inline").when(F.col("gap").rlike(LINE_GAP), "line").otherwise("")
    return rows.withColumn("gap", gap)


def page_pairs(words: DataFrame, left: DataFrame) -> DataFrame:
    """doc_id, page, pairs: those of source_pairs(), in turn, of pages with something left of both sides (left as of
    leftovers()). Only such pages are tokenised again, and a page's pairs are one row where its words are."""
    side = lambda s: F.bool_or(F.col("side") == s)
    both = left.groupBy(*PAGE).agg(side("s").alias("s"), side("o").alias("o")).where("s and o").select(*PAGE)
    pairs = source_pairs(runs_with_tokens(_boxed(words).join(both, list(PAGE), "left_semi")))
    return pairs.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("rank.part", "rank.run", "rank.kind", "first", "second", "hyphen"))).alias("pairs"))


def missing_words(words: DataFrame, bodies: DataFrame, left: DataFrame | None = None) -> DataFrame:
    """doc_id, page, at, token of words (doc_id, page, idx, text and, where known, x, y, w, h) that their page's body lacks.

    Literal occurrences are settled by leftovers(), which is written once. If bodies have anything left, what is left of
    a page goes, as one row, to the repairs, which depend on order, with the pairs of the page: words, pairs and tokens
    aren't shuffled one by one. A page bounds the memory of a row. Words of pages without a body are missing. left: the
    written table of leftovers(), if there is one already.
    """
    left = written(leftovers(words, bodies), "leftovers") if left is None else left
    if left.where("side = 'o'").isEmpty():  # nothing unused that a repair could take
        return left.select(*PAGE, "at", "token")
    of = lambda s, *c: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.struct(*c))))
    pages = left.groupBy(*PAGE).agg(of("s", "at", "token").alias("source"), of("o", "at", "token", "gap").alias("output")).where(F.size("source") > 0)
    kind = "array<struct<part:int,run:long,kind:int,first:long,second:long,hyphen:boolean>>"
    rows = pages.join(page_pairs(words, left), list(PAGE), "left").withColumn("pairs", F.coalesce(F.col("pairs").cast(kind), F.array().cast(kind)))
    return rows.mapInArrow(_repairs, MISSING.replace("doc_id long", f"doc_id {left.schema['doc_id'].dataType.simpleString()}"))


def _boxed(words: DataFrame) -> DataFrame:
    """The words with all columns of a box; unknown ones are null."""
    return words.select("doc_id", "page", "idx", "text", *[(F.col(c) if c in words.columns else F.lit(None)).cast("double").alias(c) for c in ("x", "y", "w", "h")])


def strict_deficits(left: DataFrame) -> DataFrame:
    """doc_id, strict_deficits: words without a literal occurrence, before repairs; left as of leftovers()."""
    return left.where("side = 's'").groupBy("doc_id").agg(F.count(F.lit(1)).alias("strict_deficits"))


def quoted_list(items: Column) -> Column:
    """['a', 'b'], with backslashes and single quotes escaped."""
    escaped = F.transform(items, lambda s: F.concat(F.lit("'"), F.replace(F.replace(s, F.lit("\\"), F.lit("\\\\")), F.lit("'"), F.lit("\\'")), F.lit("'")))
    return F.concat(F.lit("["), F.array_join(escaped, ", "), F.lit("]"))


def audit_lines(missing: DataFrame) -> DataFrame:
    """doc_id, page, n_missing, line: the page's report with at most twelve of its missing words."""
    per = missing.groupBy(*PAGE).agg(F.array_sort(F.collect_list(F.struct("at", "token"))).alias("m"))
    shown = quoted_list(F.slice(F.col("m.token"), 1, SAMPLE))
    n = F.size("m").cast("long")
    return per.select(*PAGE, n.alias("n_missing"), F.concat(F.lit("p"), F.col("page").cast("string"), F.lit(": MISSING "), n.cast("string"), F.lit(": "), shown).alias("line"))


def token_counts(words: DataFrame) -> DataFrame:
    """doc_id, page, parsed (words) and words (tokens) of every page with words."""
    return source_pages(words.select(*PAGE, "idx", "text")).select(*PAGE, "parsed", F.regexp_count(fold_typographic(F.col("said")), F.lit(TOKEN_AND_GAP)).cast("long").alias("words"))


def audit_totals(words: DataFrame, left: DataFrame, missing: DataFrame) -> DataFrame:
    """doc_id, parsed, pages, words, strict_deficits, missing of every document with words; left as of leftovers()."""
    counts = token_counts(words).groupBy("doc_id").agg(F.sum("parsed").alias("parsed"), F.count(F.lit(1)).alias("pages"), F.sum("words").alias("words"))
    lost = missing.groupBy("doc_id").agg(F.count(F.lit(1)).alias("missing"))
    out = counts.join(strict_deficits(left), "doc_id", "left").join(lost, "doc_id", "left")
    return out.fillna(0, ["strict_deficits", "missing"])


def check_evidence(words: DataFrame, bodies: DataFrame) -> None:
    """Raises AUDIT_INPUT for invalid records, evidence without tokens, and pages that the Markdown doesn't mark."""
    boxed = _boxed(words)
    some = F.coalesce(fold_typographic(F.col("text")).rlike(TOKEN_AND_GAP), F.lit(False))
    seen = boxed.agg(F.count(F.lit(1)).alias("n"), F.count_if(~valid_record()).alias("bad"), F.count_if(some).alias("tokens")).first()
    errors = []  # fixed messages
    if not seen["n"]:
        errors.append("word dump contains no JSON records")
    if seen["bad"]:
        errors.append(f"{seen['bad']} records lack a positive integer page or non-empty text, or have a broken box")
    if not seen["tokens"]:
        errors.append("word dump contains no lexical tokens")
    absent = absent_pages(words, bodies).orderBy(*PAGE).limit(SAMPLE).collect()
    if absent and not errors:
        errors.append(f"Markdown has no provenance marker for {', '.join(f'p{r.page}' for r in absent)}")
    if errors:
        raise LeafmarkError("AUDIT_INPUT", "audit evidence is invalid: " + "; ".join(errors))

"""Blocks, hyphens, the audit, the analysis' JSON, streaming and the command line on constructed documents."""

import json

import pytest

from leafmark import api, cli
from leafmark.errors import LeafmarkError, coded
from leafmark.operators import analysis, audit, markdown
from leafmark.operators.hyphens import joined, with_joins
from leafmark.sources import pdf

LINE = "doc_id int, page int, ix int, col int, text string, x double, y double, h double, words array<int>"
DUMP = "doc_id int, page int, idx int, text string, x double, y double, w double, h double, confidence double"


def _blocks(spark, *lines, dictionary=("creative",)):
    """lines: (text, x, y, h) of one page."""
    rows = [(1, 1, i, 0, t, float(x), float(y), float(h), [i]) for i, (t, x, y, h) in enumerate(lines)]
    rows += [(1, 9, 0, 0, "plain words of the body, many of them. " * 40, 72.0, 0.0, 12.0, [0])]
    frame = spark.createDataFrame(rows, LINE)
    words = spark.createDataFrame([(w,) for w in dictionary], "word string")
    got = markdown.text_blocks(frame, markdown.heading_levels(frame), words).where("page = 1").orderBy("block").collect()
    return [(b.type, b.text) for b in got]


def test_text_builder(spark):
    got = _blocks(
        spark, ("A wide", 72, 0, 24), ("title", 72, 30, 24), ("A creat-", 72, 80, 12), ("ive well-", 72, 94, 12), ("known mind , ends.", 72, 108, 12),
        ("• ▪ first", 72, 122, 12), ("•", 90, 136, 12), ("▪", 90, 150, 12), ("Share:", 90, 164, 12), ("12,5%", 90, 178, 12), ("Total:", 72, 192, 12), ("40", 72, 206, 12),
        ("an open", 72, 220, 12), ("far below", 72, 300, 12), ("•", 72, 314, 12),
    )
    assert got == [
        ("heading", "A wide title"), ("paragraph", "A creative well-known mind, ends."), ("paragraph", "- first"), ("paragraph", "  - Share: 12,5%"), ("paragraph", "- Total: 40"),
        ("paragraph", "an open"), ("paragraph", "far below"), ("paragraph", "- "),
    ]


def test_long_display_run_is_a_callout(spark):
    assert _blocks(spark, *[("long display words here " * 2, 72, 30 * i, 24) for i in range(5)])[0][1].startswith("> long display")


def test_chained_hyphens(spark):
    rows = [(1, i, t) for i, t in enumerate(["see co-", "oper-", "a-", "tion now"])]
    words = spark.createDataFrame([("cooper",), ("cooperation",)], "word string")
    from pyspark.sql import functions as F

    lines = with_joins(spark.createDataFrame(rows, "k int, i int, text string"), ["k"], words)
    got = lines.groupBy("k").agg(joined(F.array_sort(F.collect_list(F.struct("i", "text", "join")))).alias("t")).first().t
    # co- + oper closes; cooper- + a isn't a word, so its hyphen stays, and cooper-ation isn't one either.
    assert got == "see cooper-a-tion now"


def _audit(spark, words, body):
    w = spark.createDataFrame([(1, 1, i, t, float(x), 0.5, 0.1, 0.02, None) for i, (t, x) in enumerate(words)], DUMP)
    b = spark.createDataFrame([(1, 1, body)], "doc_id int, page int, body string")
    return [r.token for r in audit.missing_words(w, b).orderBy("at").collect()]


@pytest.mark.parametrize(
    ("words", "body", "lost"),
    [
        ([("alpha", 0.1), ("beta", 0.3)], "alpha beta", []),
        ([("alpha", 0.1), ("beta", 0.3)], "alpha", ["beta"]),
        ([("creat-", 0.1), ("ive", 0.3)], "creative", []),
        ([("well-known", 0.1)], "wellknown", []),
        ([("foot", 0.1), ("ball", 0.2)], "football", []),
        ([("foot", 0.1), ("ball", 0.4)], "football", ["foot", "ball"]),
        ([("creative", 0.1)], "creat-\nive", []),
        ([("a", 0.1), ("-", 0.3), ("b", 0.5)], "ab", []),
        ([("été", 0.1)], "été [x](hidden)", []),
        ([("hidden", 0.1)], "[x](hidden)", ["hidden"]),
    ],
)
def test_audit_repairs(spark, words, body, lost):
    assert _audit(spark, words, body) == lost


def test_audit_lines_and_evidence(spark):
    missing = spark.createDataFrame([(1, 3, i, f"it's{i}") for i in range(13)], "doc_id int, page int, at long, token string")
    line = audit.audit_lines(missing).first()
    assert line.n_missing == 13 and line.line.startswith("p3: MISSING 13: ['it\\'s0', ") and "s12" not in line.line
    words = spark.createDataFrame([(1, 2, 0, "x", None, None, None, None, None)], DUMP)
    with pytest.raises(LeafmarkError, match="no provenance marker for p2"):
        api.audit(words, spark.createDataFrame([(1, "### p1\nx")], "doc_id int, md string"))


def _dump(pages=2):
    body = [(p, f"word{r}", round(0.07 + 0.1 * k, 3), round(0.8 - 0.025 * r, 3), 0.09, 0.017, 90.0) for p in range(1, pages + 1) for r in range(5) for k in range(8)]
    return [*body, (1, "Heading", 0.07, 0.9, 0.2, 0.05, 90.0)]


def test_analysis_round_trip(spark):
    words = spark.createDataFrame([(7, p, i, *rest) for i, (p, *rest) in enumerate(_dump())], DUMP)
    pages = api.analyze_words(words, api.Options((1, 3)))
    md = analysis.render_markdown(pages).first().markdown
    assert md.startswith("\n### p1\n\n#### Heading\n\nword0") and md.endswith("\n### p3\n\n")
    assert [w.warning for w in api.warnings(pages).collect()] == ["p3: no recognized words, page emitted with no OCR text"]
    report = api.report(pages, words).first()
    assert (report.path, report.pages, report.headings, report.low_confidence_words) == ("ocr", 3, 1, 0)
    text = analysis.to_json(pages, api.report(pages)).first().json
    back = analysis.validated(analysis.from_json(spark.createDataFrame([(7, text)], "doc_id int, json string")))
    assert analysis.render_markdown(back).first().markdown == md
    bad = json.loads(text)
    bad["pages"][0]["blocks"][0]["level"] = 9
    malformed = spark.createDataFrame([(7, text), (8, json.dumps(bad))], "doc_id int, json string")
    for rendered in (analysis.to_markdown(malformed), analysis.to_text(malformed)):
        with pytest.raises(LeafmarkError, match="analysis of 8: bad block level") as e, coded("ANALYSIS_INPUT"):
            rendered.collect()
        assert e.value.code == "ANALYSIS_INPUT" and rendered._jdf.queryExecution().optimizedPlan().toString().count("LogicalRDD") == 1
    assert [r.doc_id for r in analysis.invalid(analysis.from_json(malformed)).collect()] == [8]
    assert analysis.to_markdown(malformed.where("doc_id = 7")).first().markdown == md


def test_options_and_words_are_checked(spark):
    with pytest.raises(LeafmarkError):
        api.Options((2, 1))
    with pytest.raises(LeafmarkError, match="lack"):
        api.check_words(spark.createDataFrame([(1,)], "doc_id int"))
    sound = (1, 1, 0, "word", 0.1, 0.1, 0.1, 0.1, None)
    for bad in ((1, None, 0, "word", 0.1, 0.1, 0.1, 0.1, 90.0), (1, 1, 0, "word", 0.1, 0.1, 0.1, 0.1, float("inf")), (1, 1, 0, "word", 0.1, 0.1, None, 0.1, 90.0)):
        with pytest.raises(LeafmarkError, match="malformed word entry: .*word") as e:
            api.analyze_words(spark.createDataFrame([sound, bad], DUMP))
        assert e.value.code == "WORDS_INPUT"
    assert api.analyze_words(spark.createDataFrame([sound], DUMP)).count() == 1


def test_pdf_sources(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"x")
    (tmp_path / "b.pdf").write_bytes(b"broken")

    def parse(content):
        if content == b"broken":
            raise ValueError("not a PDF")
        run = {"text": "Hi", "a": 12.0, "b": 0.0, "c": 0.0, "d": -12.04, "e": 72.0, "f": 92.0, "width": 20.0}
        return [{"page": 1, "width": 612.0, "height": 792.0, "runs": [run, {**run, "text": " "}], "ops": [{"name": "paintImageXObject", "w": 300, "h": 300}]}]

    parsed = pdf.read_pdfs(spark, str(tmp_path), parse).persist()
    assert parsed.where("error is not null").count() == 1
    run = pdf.runs_of(parsed).collect()
    assert [(r.text, r.h, r.bx, round(r.by, 2), r.bw, round(r.bh, 2)) for r in run] == [("Hi", 12.0, 72.0, 79.96, 20.0, 12.04)]
    signal = pdf.image_signals(parsed).first()
    assert (signal.text_chars, signal.has_image, signal.large_image) == (3, True, False)
    pages = api.analyze_runs(pdf.runs_of(parsed))
    assert analysis.render_markdown(pages, page_markers=True).first().markdown == "### p1\n\nHi\n"


def test_engine_tries_sparse_once_more(spark):
    def engine(doc, page, sparse):
        one = {"text": "12", "x": 0.1, "y": 0.1, "w": 0.1, "h": 0.1, "confidence": 50.0}
        return [one] * (3 if sparse else 2) if page == 1 else []

    got = pdf.recognise(spark.createDataFrame([("d", 1), ("d", 2)], "doc_id string, page int"), engine).collect()
    assert [r.page for r in got].count(1) == 3 and [r.text for r in got if r.page == 2] == [None]


def test_streamed_dumps(spark, tmp_path):
    from leafmark.streaming import dumps

    (tmp_path / "in").mkdir()
    names = ("page", "text", "x", "y", "w", "h", "confidence")
    (tmp_path / "in/d.jsonl").write_text("\n".join(json.dumps(dict(zip(names, w, strict=True))) for w in _dump()))
    dumps.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(120)
    assert "#### Heading" in spark.read.parquet(str(tmp_path / "out")).first().markdown


def test_command_line(spark, tmp_path, capsys):
    names = ("page", "text", "x", "y", "w", "h", "confidence")
    dump = tmp_path / "d.jsonl"
    dump.write_text("\n".join(json.dumps(dict(zip(names, w, strict=True))) for w in _dump()) + "\n")
    assert cli.main(["extract", str(dump)]) == 0
    assert cli.main(["audit", str(dump), str(tmp_path / "d.md")]) == 0
    assert "MISSING=0" in capsys.readouterr().out
    (tmp_path / "d.md").write_text("### p1\n\n### p2\n\nword0")
    assert cli.main(["audit", str(dump), str(tmp_path / "d.md")]) == 19
    with pytest.raises(SystemExit) as e:
        cli.main(["extract", str(dump), "--pages", "3-1"])
    assert e.value.code == 19


def test_audit_dump_is_read_strictly(spark, tmp_path):
    from leafmark.sources.layout import read_audit_dump

    path = tmp_path / "dump.jsonl"
    path.write_text('{"page": 1, "text": "a"}\n\n[1]\n{"page": 0, "text": "b"}\n{"page": 2, "text": " "}\n {"page": 3, "text": "c", "x": 0.5}\n{"page": 4\n')
    got = [(r.idx, r.page, r.error) for r in read_audit_dump(spark, str(path)).orderBy("idx").collect()]
    lacks = "must contain a positive integer page and non-empty text"
    assert [g[2] for g in got] == [None, "line 2 is not valid JSON", "line 3 is not valid JSON", f"line 4 {lacks}", f"line 5 {lacks}", None, "line 7 is not valid JSON"]
    (tmp_path / "out.md").write_text("### p1\n\na\n")
    assert cli.main(["audit", str(path), str(tmp_path / "out.md")]) == 19
    assert cli.main(["audit", str(tmp_path / "none.jsonl"), str(tmp_path / "out.md")]) == 19
    (tmp_path / "empty.jsonl").write_text("")
    assert cli.main(["extract", str(tmp_path / "empty.jsonl"), "--stdout"]) == 19


def test_tuning_changes_the_layout(spark, tmp_path):
    from leafmark import LeafmarkError as exported
    from leafmark import Options, Tuning, analyze_words, page_report, word_dump

    assert exported is LeafmarkError
    rows = [(1, 1, i, f"word{i}", 0.05 + 0.06 * (i % 10), 0.9 - 0.03 * (i // 10), 0.05, 0.017, 50.0 + i) for i in range(60)]
    rows += [(1, 1, 90, "aside", 0.8, 0.5, 0.05, 0.017, 10.0)]
    words = spark.createDataFrame(rows, DUMP)
    types = lambda o: [b.type for p in analyze_words(words, o).collect() for b in p.blocks]
    assert types(Options()) == ["paragraph", "float"] and types(Options(tuning=Tuning(float_words=0))) == ["paragraph", "paragraph"]
    assert len(types(Options(tuning=Tuning(para_gap=0.5)))) == 7
    with pytest.raises(ValueError):
        Tuning(split=0.0)
    pages = analyze_words(words)
    report = page_report(pages, words).first()
    assert (report.path, report.measured, report.low, report.sample.split("|")[:2], report.floats) == ("ocr", 61, 11, ["aside", "word0"], 1)
    assert json.loads(word_dump(pages).first().line) == {"page": 1, "text": "word0", "x": 0.05, "y": 0.9, "w": 0.05, "h": 0.017, "confidence": 50.0}


def test_automatic_pages(spark):
    from leafmark import Options, analyze_auto

    info = spark.createDataFrame([(1, 1, 500, True), (1, 2, 3, True), (1, 3, 0, False), (1, 4, None, None)], "doc_id int, page int, text_chars int, has_image boolean")
    runs = spark.createDataFrame([(1, p, 0, f"text of page {p}", 72.0, 100.0, 90.0, 12.0, 612.0) for p in (1, 2)], "doc_id int, page int, idx int, text string, x double, y double, w double, h double, page_width double")
    words = spark.createDataFrame([(1, 2, 0, "seen", 0.1, 0.9, 0.05, 0.02, 90.0), (1, 1, 0, "unused", 0.1, 0.9, 0.05, 0.02, 90.0)], DUMP)
    got = lambda o=None: sorted((p.page, p.path, [b.text for b in p.blocks]) for p in analyze_auto(info, runs, words, o).collect())
    assert got() == [(1, "text", ["text of page 1"]), (2, "ocr", ["seen"]), (3, "text", []), (4, "text", [])]
    assert got(Options(pages=(2, 9)))[0] == (2, "ocr", ["seen"]) and len(got(Options(pages=(8, 9)))) == 1
    assert {p[1] for p in got(Options(ocr=False))} == {"text"} and got(Options(ocr=True))[0] == (1, "ocr", ["unused"])


def test_automatic_pages_are_routed_once(spark, tmp_path):
    """The table of pages is read for the routing only, and words aren't sorted to find those of routed pages, however many these are."""
    from leafmark import analyze_auto
    from leafmark.operators import tables

    info_path = str(tmp_path / "signals_of_pages")
    spark.createDataFrame([(1, 1, 500, True), (1, 1, 500, True), (1, 2, 3, True)], "doc_id long, page int, text_chars int, has_image boolean").write.parquet(info_path)
    runs = spark.createDataFrame([(1, p, 0, f"text of page {p}", 72.0, 100.0, 90.0, 12.0, 612.0) for p in (1, 2)], "doc_id long, page int, idx int, text string, x double, y double, w double, h double, page_width double")
    words = spark.createDataFrame([(1, p, 0, "seen", 0.1, 0.9, 0.05, 0.02, 90.0) for p in (1, 2)], DUMP)
    pages = analyze_auto(spark.read.parquet(info_path), runs, words)
    assert "signals_of_pages" not in pages._jdf.queryExecution().toString()
    assert sorted((p.page, p.path, [b.text for b in p.blocks]) for p in pages.collect()) == [(1, "text", ["text of page 1"]), (2, "ocr", ["seen"])]
    many = spark.range(tables.BROADCAST_ROWS + 1).select("id", "id").toDF("doc_id", "page")
    for keys in (many, many.limit(2)):
        found = tables.of_pages(words, keys)
        assert "SortMergeJoin" not in found._jdf.queryExecution().executedPlan().toString() and found.count() == 1


PLUGIN = """
def parse(content):
    if content != b"a PDF":
        raise ValueError("not a PDF")
    def run(text, y, size):
        return {"text": text, "a": size, "b": 0.0, "c": 0.0, "d": -size, "e": 72.0, "f": y, "width": 200.0}
    pages = [[run("Large heading", 60.0, 24.0), run("A long body line that goes on as prose", 120.0, 10.0), run("and ends here.", 134.0, 10.0), run("\u2022 one item", 190.0, 10.0)], [], [run("Last page of text.", 100.0, 10.0)]]
    ops = [[], [{"name": "paintImageXObject", "w": 900, "h": 900}], []]
    return [{"page": i + 1, "width": 612.0, "height": 792.0, "runs": r, "ops": o} for i, (r, o) in enumerate(zip(pages, ops))]

def rasterise(path, page, dpi):
    return b"PNG %d %d" % (page, dpi), 10, 0 if dpi == 1 else 10

def engine(path, page, sparse, dpi):
    return [{"text": "recognised", "x": 0.1, "y": 0.8, "w": 0.2, "h": 0.02, "confidence": 40.0}]
"""


def test_command_line_on_pdfs(spark, tmp_path, capsys, monkeypatch):
    (tmp_path / "leafmark_test_plugin.py").write_text(PLUGIN)
    monkeypatch.syspath_prepend(str(tmp_path))
    file, out = tmp_path / "My file.pdf", tmp_path / "My file.md"
    file.write_bytes(b"a PDF")
    use = ["--plugin", "leafmark_test_plugin"]
    assert cli.main(["extract", str(file), "--json", *use]) == 0
    seen = capsys.readouterr()
    got = json.loads(seen.out)
    assert (got["path"], got["pages"], got["body_height"], got["heading_sizes"], got["list_items"], got["low_confidence_words"]) == ("mixed", 3, 10.0, [24.0], 1, 1)
    assert "p2: sparse text layer with image content" in seen.err
    md = out.read_text()
    assert md.startswith("\n### p1\n\n#### Large heading\n\n") and "### p2\n\nrecognised\n" in md and "Last page" in md
    assert cli.main(["extract", str(file), "--no-ocr", "--json", *use]) == 0
    seen = capsys.readouterr()
    assert "p2: no extractable text; page has image content" in seen.err and out.read_text().startswith("# Large heading\n") and json.loads(seen.out)["chars"] == len(out.read_text())
    assert cli.main(["extract", str(file), "--ocr", "--pages", "2-3", *use]) == 0 and out.read_text().count("recognised") == 2
    assert cli.main(["render", str(file), "1-2", "-d", "100", "-o", str(tmp_path / "png"), *use]) == 0
    assert sorted((p.name, p.read_bytes()) for p in (tmp_path / "png").iterdir()) == [("My-file-p1.png", b"PNG 1 100"), ("My-file-p2.png", b"PNG 2 100")]
    capsys.readouterr()
    for bad in (["render", str(file), "3-4", "-o", str(tmp_path / "none"), *use], ["render", str(file), "1", "-d", "1", *use], ["render", str(file), "1"], ["extract", str(file)]):
        assert cli.main(bad) == 19
    assert "PAGE_RANGE" in capsys.readouterr().err and not (tmp_path / "none").exists()
    (tmp_path / "broken.pdf").write_bytes(b"broken")
    assert cli.main(["extract", str(tmp_path / "broken.pdf"), *use]) == 19 and "PDF_OPEN" in capsys.readouterr().err


def test_sets_of_pages(spark):
    from leafmark import LeafmarkError, Options, analyze_auto, analyze_words, warnings

    info = spark.createDataFrame([(1, p, 500, p == 3, p == 3) for p in (1, 2, 3)], "doc_id int, page int, text_chars int, has_image boolean, large_image boolean")
    runs = spark.createDataFrame([(1, p, 0, f"text of page {p}", 72.0, 100.0, 90.0, 12.0, 612.0) for p in (1, 2, 3)], "doc_id int, page int, idx int, text string, x double, y double, w double, h double, page_width double")
    words = spark.createDataFrame([(1, p, 0, "seen", 0.1, 0.9, 0.05, 0.02, 90.0) for p in (1, 2, 4)], DUMP)
    o = Options(pages=frozenset({1, 3, 9}))
    pages = analyze_auto(info, runs, words, o)
    assert sorted((p.page, len(p.blocks)) for p in pages.collect()) == [(1, 1), (3, 1)]
    assert [w.page for w in warnings(pages, info).collect()] == [3]
    assert sorted((p.page, len(p.blocks)) for p in analyze_words(words, o).collect()) == [(1, 1), (3, 0)]
    for wrong in (frozenset(), frozenset({0})):
        with pytest.raises(LeafmarkError):
            Options(pages=wrong)


def test_lines_of_several_splits_have_the_file_s_numbers(spark, tmp_path):
    from leafmark.sources.layout import read_audit_dump, read_word_dump
    from leafmark.sources.numbering import numbered_lines

    made = {"a.jsonl": 5000, "b.jsonl": 1, "c.jsonl": 700}
    for name, n in made.items():
        (tmp_path / name).write_text("".join("\n" if i % 97 == 5 else '{"page": \n' if i % 97 == 6 else json.dumps({"page": 1, "text": f"{name}{i}", "x": 0.1, "y": 0.1, "w": 0.1, "h": 0.1}) + "\n" for i in range(n)))
    (tmp_path / "d.jsonl").write_text("")
    known = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert numbered_lines(spark, str(tmp_path)).rdd.getNumPartitions() > 20
        got = numbered_lines(spark, str(tmp_path)).collect()
        words = read_word_dump(spark, str(tmp_path)).collect()
        strict = read_audit_dump(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", known)
    for name, n in made.items():
        lines = (tmp_path / name).read_text().split("\n")[:-1]
        assert sorted((r.line, r.value) for r in got if r.doc_id.endswith(name)) == list(enumerate(lines, 1))
        sound = [(i, f"{name}{i - 1}") for i in range(1, n + 1) if (i - 1) % 97 not in (5, 6)]
        assert sorted((r.idx, r.text) for r in words if r.doc_id.endswith(name) and not r.bad) == sound
        assert sorted((r.idx, r.text) for r in strict if r.doc_id.endswith(name) and r.error is None) == sound
    assert sum(r.bad for r in words) == sum(len([i for i in range(n) if i % 97 == 6]) for n in made.values())
    assert [r.error for r in strict if r.error][:1] and all(" is not valid JSON" in r.error for r in strict if r.error)


def test_repairs_of_many_pages_at_once(spark):
    """Each page is settled by itself: what one repairs doesn't serve another, and pages where nothing can be repaired stay out."""
    words, bodies, want = [], [], {}
    for d in range(300):
        cases = [(["creat-", "ive"], "creative", []), (["creat-", "ive", "creat-", "ive"], "creative", ["creat", "ive"]), (["alone"], "other", ["alone"]), (["whole"], "who-\nle whole", []), (["split"], "sp-\nlit", [])]
        said, body, lost = cases[d % len(cases)]
        words += [(d, 1, i, t, 0.1 + 0.2 * i, 0.5, 0.1, 0.02, None) for i, t in enumerate(said)]
        bodies.append((d, 1, body))
        want[d] = lost
    bodies.append((999, 1, "words of no source"))
    got = {d: [] for d in want}
    for r in audit.missing_words(spark.createDataFrame(words, DUMP), spark.createDataFrame(bodies, "doc_id int, page int, body string")).orderBy("doc_id", "at").collect():
        got[r.doc_id].append(r.token)
    assert got == want


def _jsonl(rows):
    names = ("page", "text", "x", "y", "w", "h", "confidence")
    return [json.dumps(dict(zip(names, w, strict=True))) for w in rows]


def test_extract_over_a_folder_writes_all_documents(spark, tmp_path, capsys):
    folder, out = tmp_path / "in", tmp_path / "out"
    folder.mkdir()
    for name, pages in (("one", 1), ("two words", 2), ("three", 3)):
        (folder / f"{name}.jsonl").write_text("\n".join(_jsonl(_dump(pages))) + "\n")
    for kind, suffix in (("md", "md"), ("txt", "txt"), ("raw", "json")):
        assert cli.main(["extract", str(folder), str(out), "--format", kind]) == 0
        seen = capsys.readouterr().err
        assert [line.split()[0] for line in seen.splitlines() if "OCR path" in line] == [f"one.{suffix}", f"three.{suffix}", "two"]
    assert sorted(p.name for p in out.iterdir()) == sorted(f"{n}.{s}" for n in ("one", "two words", "three") for s in ("md", "txt", "json"))
    for name, pages in (("one", 1), ("two words", 2), ("three", 3)):
        assert (out / f"{name}.md").read_text().count("### p") == pages and len(json.loads((out / f"{name}.json").read_text())["pages"]) == pages
        assert cli.main(["extract", str(folder / f"{name}.jsonl"), str(tmp_path / "single.md")]) == 0
        assert (out / f"{name}.md").read_text() == (tmp_path / "single.md").read_text()
    capsys.readouterr()
    assert cli.main(["extract", str(folder), "--json"]) == 0
    assert capsys.readouterr().out.count('"source"') == 3 and (folder / "three.md").exists()


def test_two_documents_of_one_name_are_refused(spark, tmp_path):
    from leafmark.sources.sinks import write_documents

    docs = spark.createDataFrame([("/a/x.pdf", "1"), ("/b/x.jsonl", "2")], "doc_id string, content string")
    with pytest.raises(LeafmarkError, match="called x"):
        write_documents(docs, str(tmp_path / "out"), "md")
    assert not (tmp_path / "out").exists()
    assert write_documents(docs.limit(0), str(tmp_path / "out"), "md").count() == 0


def test_stream_keeps_what_is_no_word(spark, tmp_path):
    from leafmark.streaming import dumps

    (tmp_path / "in").mkdir()
    sound = _jsonl(_dump(1))
    (tmp_path / "in/a.jsonl").write_text("\n".join([*sound, "{", "", '{"page": 1, "text": "no box"}', *sound]))
    (tmp_path / "in/b.jsonl").write_text("nothing\n")
    dumps.start(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"), quarantine=str(tmp_path / "bad")).awaitTermination(120)
    counts = {r.doc_id.rsplit("/", 1)[1]: (r.words, r.bad) for r in spark.read.parquet(str(tmp_path / "bad/counts")).collect()}
    assert counts == {"a.jsonl": (2 * len(sound), 2), "b.jsonl": (0, 1)}
    bad = spark.read.parquet(str(tmp_path / "bad/lines")).orderBy("doc_id", "idx").collect()
    assert [(r.idx, r.lacks) for r in bad] == [(len(sound), ["page", "text", "x", "y", "w", "h"]), (len(sound) + 2, ["x", "y", "w", "h"]), (0, ["page", "text", "x", "y", "w", "h"])]
    assert [r.doc_id.rsplit("/", 1)[1] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["a.jsonl"]


def test_pdf_data_source_parses_what_is_asked_for(spark, tmp_path):
    from leafmark.sources import pdf_source

    folder, log = tmp_path / "in", tmp_path / "log"
    folder.mkdir()
    log.mkdir()
    for name, n in (("a", 200), ("b", 3), ("c", 1)):
        (folder / f"{name}.pdf").write_bytes(b"%d" % n)
    (folder / "broken.pdf").write_bytes(b"no PDF")
    (folder / "note.txt").write_bytes(b"5")
    where = str(log)

    def parse(content, first, last):
        import uuid

        for p in range(first, min(int(content), last or int(content)) + 1):
            open(f"{where}/{p}-{uuid.uuid4().hex}", "w").close()
            run = {"text": f"page {p}", "a": 12.0, "b": 0.0, "c": 0.0, "d": -12.0, "e": 72.0, "f": 92.0, "width": 20.0}
            yield {"page": p, "width": 612.0, "height": 792.0, "runs": [run], "ops": [{"name": "paintImageXObject"}]}

    pdf_source.register(spark, parse)
    read = spark.read.format(pdf_source.NAME).option("pages_per_task", 8).load(str(folder))

    def parsed():
        seen = sorted(int(p.name.split("-")[0]) for p in log.iterdir())
        for p in log.iterdir():
            p.unlink()
        return seen

    rows = read.select("doc_id", "page", "error").collect()
    assert len(rows) == 205 and len(parsed()) == 204 and [r.doc_id.rsplit("/", 1)[1] for r in rows if r.error] == ["broken.pdf"]
    asked = read.where("page between 2 and 20")
    assert asked.rdd.getNumPartitions() == 12 and sorted(r.page for r in asked.collect()) == sorted([*range(2, 21), 2, 3]) and parsed() == sorted([*range(2, 21), 2, 3])
    assert [r.page for r in read.where("page in (3, 150) and doc_id like '%/a.pdf'").orderBy("page").collect()] == [3, 150]
    assert max(parsed()) <= 150 + 8
    only = read.where(f"doc_id = '{folder}/c.pdf'")
    assert [(r.page, r.runs[0].text, r.ops[0].w) for r in only.collect()] == [(1, "page 1", None)] and parsed() == [1]
    assert read.where("page = 999").count() == 0 and read.where("page = 1 and page = 2").count() == 0
    parsed()
    assert pdf.runs_of(read.where("page = 2")).count() == 2 and pdf.image_signals(read.where("page = 1")).count() == 3


def test_an_engine_is_opened_for_each_range(spark, tmp_path):
    where = str(tmp_path)

    class Opened:
        def __enter__(self):
            import uuid

            self.name = uuid.uuid4().hex
            open(f"{where}/open-{self.name}", "w").close()
            return lambda doc, page, sparse: (_ for _ in ()).throw(ValueError("page 13")) if page == 13 else [{"text": f"{doc} {page}", "x": 0.1, "y": 0.1, "w": 0.1, "h": 0.1, "confidence": 50.0}]

        def __exit__(self, *_):
            open(f"{where}/closed-{self.name}", "w").close()

    count = lambda what: len([p for p in tmp_path.iterdir() if p.name.startswith(what)])
    asked = [("d", p) for p in (1, 2, 3, 5, 6, 9, 9)] + [("e", p) for p in range(20, 120)]
    pages = spark.createDataFrame(asked, "doc_id string, page int")
    ranges = sorted((r.doc_id, r.first, r.last) for r in pdf.page_ranges(pages, 32).collect())
    assert ranges == [("d", 1, 3), ("d", 5, 6), ("d", 9, 9), ("e", 20, 51), ("e", 52, 83), ("e", 84, 115), ("e", 116, 119)]
    got = pdf.recognise_ranges(pages, Opened).collect()
    assert sorted((r.doc_id, r.page) for r in got) == sorted(set(asked)) and count("open") == count("closed") == len(ranges)
    with pytest.raises(Exception, match="page 13"):
        pdf.recognise_ranges(spark.createDataFrame([("f", p) for p in (12, 13, 14)], "doc_id string, page int"), Opened).collect()
    assert count("open") == count("closed") == len(ranges) + 1


def test_engine_output_and_text_boxes_are_fractions_of_the_page(spark):
    kind = "doc_id string, page int, width int, height int, blocks array<struct<paragraphs:array<struct<lines:array<struct<words:array<struct<text:string,confidence:int,bbox:struct<x0:int,y0:int,x1:int,y1:int>>>>>>>>>"
    word = lambda t, *box: (t, 90, box)
    blocks = [([([([word("It’s", 10, 20, 30, 40), word("b", 40, 20, 50, 40)],)],), ([([word("c", 0, 0, 100, 200)],)],)],), ([],)]
    got = pdf.normalised_words(spark.createDataFrame([("d", 1, 100, 200, blocks)], kind)).orderBy("idx").collect()
    assert [(r.idx, r.text, r.x, r.y, r.w, r.h, r.confidence) for r in got] == [(0, "It's", 0.1, 0.8, 0.2, 0.1, 90.0), (1, "b", 0.4, 0.8, 0.1, 0.1, 90.0), (2, "c", 0.0, 0.0, 1.0, 1.0, 90.0)]
    run = {"text": "Hi", "a": 12.0, "b": 0.0, "c": 0.0, "d": -10.0, "e": 50.0, "f": 100.0, "width": 25.0}
    parsed = spark.createDataFrame([("d", 1, 100.0, 200.0, [run], [], None), ("d", 2, 0.0, 0.0, [run], [], None)], pdf.PARSED)
    pages = api.analyze_runs(pdf.runs_of(parsed)).orderBy("page").collect()
    assert [tuple(p.words[0].box) for p in pages] == [(0.5, 0.5, 0.25, 0.05), (0.0, 0.0, 0.0, 0.0)]

"""Ranked search, the filter audit and HTML extraction against brute force and on odd rows."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import pytest

from leafmark.llm import filter_audit, html_text, lexical

DOC = "doc_id long, text string, source string, row string, term string, q string, n string"


def _terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def _brute(docs, items, k):
    """The rule as stated, over all pairs."""
    bags = [(d, _terms(t)) for d, t in docs]
    held = [(d, b) for d, b in bags if b]
    n_docs, length = len(held), sum(len(b) for _, b in held)
    df = Counter(w for _, b in held for w in set(b))
    out = []
    for item, text in items:
        found = []
        for d, b in held:
            tf, m = Counter(b), 100 - 25 + (25 * len(b) * n_docs) // length
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((1000000000 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in _terms(text) if tf[w])
            if score > 0:
                found.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(found)[:k])]
    return sorted(out, key=str)


def _search(spark, docs, items, k):
    left = spark.createDataFrame([(d, t, "a", "b", "c", "d", "e") for d, t in docs], DOC).repartition(5)
    asked = spark.createDataFrame([(d, t, "a", "b", "c", "d", "e") for d, t in items], DOC).withColumnRenamed("doc_id", "item_id")
    return sorted([(r.item_id, r.rank, r.doc_id, r.score) for r in lexical.search(left, asked, k).collect()], key=str)


def test_search_is_exact_with_ties_copies_and_odd_rows(spark):
    r = random.Random(2)
    words = [f"w{int(r.paretovariate(0.7))}" for _ in range(4000)]
    docs = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 5, 40, 300])))) for i in range(300)]
    docs += [(i, docs[3][1]) for i in range(300, 360)]  # copies: ties
    docs += [(7, docs[8][1]), (7, docs[8][1]), (None, docs[9][1]), (400, None), (401, ""), (402, "?! ..."), (403, "Rare RARE rare"), (404, "é日本 rare"), (405, "w1 " * 20000)]
    items = [(i, " ".join(r.choice(words) for _ in range(r.choice([1, 3, 12, 40])))) for i in range(25)]
    items += [(30, docs[3][1]), (31, "rare Rare"), (32, "é日本"), (33, None), (34, ""), (35, "unknownword"), (36, "w1 w1 w1"), (None, "rare w2"), (31, "rare w3"), (37, docs[8][1])]
    for k in (1, 7, 20):
        assert _search(spark, docs, items, k) == _brute(docs, items, k)


def test_search_of_empty_tables(spark):
    some = [(1, "a b")]
    assert _search(spark, [], some, 3) == [] and _search(spark, some, [], 3) == [] and _search(spark, [(1, None)], some, 3) == []
    assert _search(spark, some, [(5, "b")], 3) == _brute(some, [(5, "b")], 3)


def _audit(docs, labels):
    def fails(i, doc, text):
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        return {
            "A": len(words) < 200, "B": 100 * len(set(words)) < 50 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 2 * len(text), "D": bool(re.search("[#$%&*|]", text)),
            "E": doc is not None and any(o is not None and o < doc and (t or "") == text for o, t, _ in docs),
        }

    good, toxic = ({d for d, *v in labels if v[k] == 1 and d is not None} for k in (0, 1))
    rows = [(s or "", d, fails(i, d, t or "")) for i, (d, t, s) in enumerate(docs)]
    out, shapley = {}, Counter()
    for order in map("".join, permutations("ABCDE")):
        for part in {p for p, _, _ in rows}:
            left = [(d, f) for p, d, f in rows if p == part]
            for step, letter in enumerate(order, 1):
                gone = [(d, f) for d, f in left if f[letter]]
                shapley[part, letter] += len(gone)
                every = sum(f[letter] for p, _, f in rows if p == part)
                alone = sum(f[letter] and sum(f.values()) == 1 for p, _, f in rows if p == part)
                out[part, order, step] = (len(left) - len(gone), len(gone), every - len(gone), alone, sum(d in good for d, _ in gone), sum(d in toxic for d, _ in gone))
                left = [(d, f) for d, f in left if not f[letter]]
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def _ran(spark, docs, labels):
    left = spark.createDataFrame([(d, t, s, "a", "b", "c") for d, t, s in docs], "doc_id long, text string, source string, part string, A string, good string")
    got = filter_audit.filter_audit(left.repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    return {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley) for r in got}


def test_audit_of_filters(spark):
    r = random.Random(6)
    text = lambda: " ".join(r.choice(["word", "Word", "a", "B", "100%", "x|y", "é", "other", f"u{r.randint(0, 999)}"]) for _ in range(r.choice([0, 3, 60, 250])))
    docs = [(i, text(), r.choice(["s1", "s2", None, "", "s3"])) for i in range(120)]
    docs += [(200 + i, docs[i % 4][1], "s1") for i in range(40)] + [(5, docs[5][1], "s2"), (5, docs[5][1], "s2"), (None, docs[6][1], "s3"), (None, None, None), (300, None, "s4"), (301, "", "s4"), (302, " \x1f " * 300, "s4")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 250, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    assert _ran(spark, docs, labels) == _audit(docs, labels)
    assert _ran(spark, [], labels) == {} and _ran(spark, docs[:3], []) == _audit(docs[:3], [])


def test_bitsets_of_many_parts(spark):
    """More parts than bytes, and parts of eight rows and one more: padding is no row."""
    docs = [(i, "#" if i % 3 else "word", f"p{i % 53 if i % 2 else i}") for i in range(900)]
    got = _ran(spark, docs, [(0, 1, 1)])
    first = {p: v for (p, o, s), v in got.items() if o == "DABCE" and s == 1}
    want = Counter(s for _, _, s in docs)
    assert {p: v[0] + v[1] for p, v in first.items()} == want and {p: v[1] for p, v in first.items()} == {p: sum(t == "#" for _, t, s in docs if s == p) for p in want}


LONG = "This is a sentence of the article, with commas, and with enough words to be taken for prose by any reader."
PAGES = [
    ("<html><body><article><h1>A &amp; B</h1><p>One<br>two\n  three.</p><p>Four&nbsp;&lt;five&gt; &#x41;&#66;</p></article></body></html>", ["A & B", "One two three.", "Four <five> AB"]),
    ("<p><b>Open<br><p>next <i>and</i> <b>last", ["Open", "next and last"]),
    (
        f"<body><div id=header><a href=/>Home</a> Site name, with commas, in it</div><ul class=nav><li><a href=a>A</a><li><a href=b>B</a></ul><div class='content'><h2>Title</h2><p>{LONG}</p><p>{LONG} 2</p><p>Short.</p>"
        f"<div class='ad-slot'>Buy, buy, buy</div><ul><li>first item</li><li>second <a href=x>item</a></li></ul><blockquote><p>Quoted.</p></blockquote></div><div class=sidebar><p>{LONG}</p></div><div id=comments><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div><div class='footer'>Imprint</div></body>",
        ["Title", LONG, LONG + " 2", "Short.", "first item", "second item", "Quoted."],
    ),
    (
        f"<main><article><header><h1>Head</h1></header><section><h2>S1</h2><p>{LONG}</p></section><section><h2>S2</h2><p>x.</p></section><section><p>{LONG} 3</p><aside>Side, side</aside><form><label>Mail</label><input><button>Send</button></form></section><footer>tags</footer></article>"
        f"<section class='comments'><article class='comment'><p>{LONG} no {LONG}</p></article><article class='comment'><p>{LONG} no</p></article></section></main>",
        ["Head", "S1", LONG, "S2", "x.", LONG + " 3"],
    ),
    (f"<script>var a='<p>no</p>';</script><style>p{{}}</style><!-- <p>no, no</p> --><noscript><p>no</p></noscript><div><p>{LONG}</p></div><script>document.write('</div>')", [LONG]),
    (f"<div class='cookie-notice'><p>{LONG}</p></div><div role=dialog><p>{LONG}</p></div><div hidden><p>{LONG}</p></div><article><p>Yes, this.</p></article>", ["Yes, this."]),
    (f"<table><tr><td><ul><li><a href=1>one</a></li><li><a href=2>two</a></li><li><a href=3>three</a></li></ul></td><td><p>{LONG}</p><p>{LONG} b</p></td></tr></table>", [LONG, LONG + " b"]),
    (f"<body class='has-sidebar no-comments'><form action=/><div><h1>T</h1><article><p>{LONG}</p></article></div></form></body>", ["T", LONG]),
    (f"<article><p>{LONG}</p><p>See <a href=1>this</a>.</p><p><a href=2>Source</a></p><figure><img src=i><figcaption>A picture</figcaption></figure><div class='share-buttons'><a>Share</a></div><table><tr><th>k<th>v<tr><td>1<td>2</table><pre>  code\n here </pre></article>", [LONG, "See this.", "Source", "A picture", "k v", "1 2", "code here"]),
    ("<article><p>AT&T &amp;amp; 1 < 2 &copy; &unknown; &#0; a<b</p></article>", None),
    ("", []), (None, []), ("just words, no markup", ["just words, no markup"]), ("<nav><a href=1>a</a></nav><footer>f</footer>", []), ("<div", []), ("<!-- open", []), ("<article></article>", []),
]


@pytest.mark.parametrize("k", range(len(PAGES)))
def test_main_text(k):
    html, want = PAGES[k]
    if want is not None:
        assert html_text.main_text(html) == "\n\n".join(want)


def test_references_and_signs():
    assert html_text.main_text(PAGES[9][0]).startswith("AT&T &amp; 1 < 2 © &unknown; � a")


def test_long_and_deep_pages_take_linear_time():
    import time

    for make in (lambda n: "<article>" + "<p>word, word</p>" * n + "</article>", lambda n: "<div>" * n + "deep, text" + "</div>" * n, lambda n: "<b>" * n + "<p>x" * n, lambda n: '<a title="' * n, lambda n: "<li>" * n, lambda n: "</div>" * n + "<span>" * n, lambda n: "<table><tr><td>" * n):
        began = time.monotonic()
        html_text.main_text(make(20_000))
        assert time.monotonic() - began < 20, make(1)
    assert html_text.main_text("<article>" + "<p>word, word</p>" * 20_000 + "</article>").count("\n\n") == 19_999


def test_extracted_rows(spark):
    rows = [(1, "u", "<p>a, b</p>", "x", 5), (1, "u", "<p>a, b</p>", "x", 5), (None, None, None, None, None), (2, "v", "<p>" + "é" * 70_000, "x", 5)]
    got = html_text.extract_text(spark.createDataFrame(rows, "page_id long, url string, html string, Text string, n_chars int")).collect()
    assert sorted((r.page_id or 0, r.url or "", len(r.text), r.n_chars) for r in got) == [(0, "", 0, 0), (1, "u", 4, 4), (1, "u", 4, 4), (2, "v", 70_000, 70_000)]
    assert html_text.extract_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0

"""The operators against brute force, round trips and odd rows."""

import hashlib
import io
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafmark.llm import chat, decontaminate, jaccard_join, langid, license_scan, linededup, mix, secrets, topk, warc

DOC = "doc_id long, text string, lang string, source string, n_chars long, size string, comp string"
WORDS = [f"w{i}ord" for i in range(400)]


def prose(seed, n=60):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in all columns, empty and long texts, repeated rows, near copies, and extra columns with clashing names."""
    near = prose(1).split()
    near[30] = "changed"
    rows = [
        (1, prose(1), "en", "a", 1), (2, " ".join(near), "en", "a", 1), (3, prose(1), None, "b", None), (3, prose(1), None, "b", None), (4, None, "en", None, 0), (5, "", None, "a", 0),
        (6, prose(2, 20000), "en", "c", 1), (None, prose(3), "en", "a", 1), (7, "12 34 !!", "en", "b", 8), (8, "word", "en", "b", 4), (9, "日本語のとても長い文章です。" * 5, "ja", "b", 4),
    ]
    return spark.createDataFrame([(*r, "x", "y") for r in rows], DOC)


def test_jaccard_classes_on_odd_rows(odd):
    got = {r.doc_id: (r.class_id, r.n_links, r.n_copies) for r in jaccard_join.jaccard_classes(odd).collect()}
    assert got[1] == (1, 2, 2) and got[2] == (1, 2, 1) and got[3] == (1, 2, 2)
    assert got[4] == (4, 0, 1) and got[5] == (5, 0, 1) and got[8] == (8, 0, 1) and None not in got
    assert [r.doc_id for r in jaccard_join.keep_one_of_each(odd).where("doc_id in (1, 2, 3)").collect()] == [1]
    assert jaccard_join.jaccard_classes(odd.limit(0)).count() == 0


def test_jaccard_recall_and_counts(spark):
    docs = []
    for g in range(40):
        base = prose(g, 120).split()
        for k in range(3):
            t = list(base)
            t[(k * 37) % 120] = f"other{g}{k}"
            docs.append((g * 10 + k, " ".join(t)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(116)} for i, t in docs}
    links = {i: sum(len(sets[i] & s) / len(sets[i] | s) >= 0.8 for j, s in sets.items() if j != i) for i in sets}
    got = {r.doc_id: r.n_links for r in jaccard_join.jaccard_classes(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == links and sum(links.values()) > 200


def test_warc_round_trip_and_salvage(spark):
    pages = spark.createDataFrame([(1, "http://a", "x" * 500), (2, "http://b", "x" * 500), (3, None, None), (4, "u\nv", "é<p>"), (None, None, "z")], "page_id long, url string, html string")
    rows = warc.read_archives(warc.write_archives(pages)).where("kind = 'record'").collect()
    by = {r.record_id: r for r in rows}
    assert len(rows) == 5 and by["<urn:leafmark:page:1>"].record_type == "revisit" and by["<urn:leafmark:page:1>"].refers_to == "<urn:leafmark:page:2>"
    assert bytes(by["<urn:leafmark:page:4>"].payload).decode() == "é<p>" and by["<urn:leafmark:page:3>"].payload_bytes == 0
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0
    raw = [warc.make_record(i, "http://x", bytes([65 + i]) * 300, warc.digest32(bytes([65 + i]) * 300), None) for i in range(4)]
    members = []
    for x in raw:
        z = zlib.compressobj(6, zlib.DEFLATED, 31)
        members.append(z.compress(x) + z.flush())
    broken = members[0] + members[1][:40] + b"\x00junk" + members[2] + raw[3].replace(b"DDD", b"EEE", 1) + members[3] + b"tail"
    out = list(warc.salvage(io.BytesIO(broken)))
    assert [x[0] for x in out] == ["record", "gap", "record", "gap", "record", "gap"], out
    assert out[0][1] == 0 and out[-1][2] == len(broken) and all(a[2] == b[1] for a, b in zip(out, out[1:], strict=False))


def test_topk_is_exact_with_ties(spark):
    r = np.random.default_rng(1)
    x = r.integers(-3, 4, (700, 6)).astype(float)
    x[5] = x[6]
    df = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)] + [(900, None), (901, [1.0, None]), (902, [float("nan")])], "vec_id long, v array<double>")
    got = [(q.query_id, q.rank, q.vec_id, q.score) for q in topk.exact_topk(df, F.col("vec_id") % 20 == 0, 20, block=256).orderBy("query_id", "rank").collect()]
    want = []
    for i in range(0, 700, 20):
        s = x @ x[i]
        want += [(i, k + 1, int(j), int(s[j])) for k, j in enumerate([j for j in np.lexsort((np.arange(700), -s)) if j != i][:20])]
    assert got == want
    assert topk.exact_topk(df.limit(0), F.lit(True)).count() == 0


def test_mix_meets_targets_and_repeats(spark, odd):
    docs = spark.createDataFrame([(i, f"s{i % 5}" if i % 7 else None, (i * 37) % 500) for i in range(3000)], "doc_id long, source string, size long")
    plan = mix.mix_plan(docs, block=128)
    a, b = ({(r.doc_id, r.source): r.copies for r in plan.collect()} for _ in range(2))
    again = {(r.doc_id, r.source): r.copies for r in mix.mix_plan(docs, block=128).collect()}
    assert a == b == again and len(a) == 3000 and max(a.values()) <= 2
    for r in plan.groupBy("source").agg(F.first("target").alias("t"), F.sum(F.col("size") * F.col("copies")).alias("k"), F.first("source_size").alias("s")).collect():
        assert abs(r.k - r.t) <= 0.01 * r.t and r.t <= 2 * r.s + 1e-6
    out = mix.mix_documents(odd)
    assert out.count() == odd.count() and {"comp", "taken", "copies"} <= set(out.columns)
    assert mix.mix_documents(odd.limit(0)).count() == 0


def test_line_dedup_keeps_one(spark, odd):
    line = prose(5, 40)
    near = line.replace(line.split()[7], "zzzzz", 1)
    docs = spark.createDataFrame([(1, f"{line}\nfirst only\n\n{line}"), (2, f"{near}\nsecond only"), (3, near), (4, None), (5, "")], "doc_id long, text string")
    got = {r.doc_id: list(r.dropped) for r in linededup.line_report(docs).collect()}
    assert got == {1: [3], 2: [0], 3: [0], 4: [], 5: []}
    assert {r.doc_id: r.text for r in linededup.dedup_lines(docs).collect()} == {1: f"{line}\nfirst only\n", 2: "second only", 4: None, 5: ""}
    assert linededup.dedup_lines(odd).columns == odd.columns and linededup.line_report(odd.limit(0)).count() == 0


def similar_pairs(lines, threshold=0.8):
    sets = [{x[i : i + 5] for i in range(len(x) - 4)} or {x} for x in lines]
    return [(i, j) for i in range(len(lines)) for j in range(i) if len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]) - 1e-9]


def kept_by_brute_force(lines):
    root = list(range(len(lines)))
    for i, j in similar_pairs(lines):
        a, b = root[i], root[j]
        root = [min(a, b) if r in (a, b) else r for r in root]
    return {i for i, r in enumerate(root) if i == r}


def kept_lines(spark, lines):
    """Each line a document of its own, so that of similar lines the first stays."""
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    return {r.doc_id for r in linededup.line_report(docs).collect() if not r.n_dropped}


def test_line_dedup_leaves_no_shuffles_of_texts(spark):
    """Its tables are written, and the shuffles that made them are freed at once; texts that share bands aren't shuffled again for each use."""
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffled():
        files = disk.getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle_"))

    docs = spark.createDataFrame([(i, "\n".join(prose(100 * (i // 2) + k, 40 + i % 2) for k in range(20))) for i in range(400)], "doc_id long, text string")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    before = shuffled()
    gone = linededup.dropped_lines(docs)
    assert shuffled() - before < 0.5 * size
    assert {r.doc_id for r in gone.collect()} == set(range(1, 400, 2))
    assert spark.conf.get(linededup.FREED) == "false"


def test_sketches_rule_out_long_lines_that_are_nearly_similar(spark):
    """At 0.73 to 0.78, some 470 characters: bits of a sketch differ in more than a ninth of the shingles of both, as sets do."""
    base, rows = prose(77, 110).split(), []
    for i in range(60):
        gone = random.Random(i).sample(range(110), 6)
        rows.append((i, " ".join(f"x{i}y{k}" if k in gone else w for k, w in enumerate(base))))
    lines = [t for _, t in rows]
    sets = [{t[i : i + 5] for i in range(len(t) - 4)} for t in lines]
    got = linededup.sketches(spark.createDataFrame(rows, "uid long, line string")).orderBy("uid").collect()
    words = [[v & (2**64 - 1) for k, v in r.asDict().items() if k.startswith("x")] for r in got]
    assert [r["size"] for r in got] == list(map(len, sets))
    apart = {(i, j): sum((a ^ b).bit_count() for a, b in zip(words[i], words[j], strict=True)) for i in range(60) for j in range(i)}
    assert all(n <= len(sets[i] ^ sets[j]) for (i, j), n in apart.items())
    asked = [p for p in apart if 0.73 <= len(sets[p[0]] & sets[p[1]]) / len(sets[p[0]] | sets[p[1]]) <= 0.78]
    passed = sum(apart[i, j] <= (len(sets[i]) + len(sets[j])) / 9 for i, j in asked)
    assert len(asked) > 100 and passed < 0.5 * len(asked), (len(asked), passed)


def test_line_dedup_compares_all_pairs_of_a_band(spark):
    r = random.Random(9)
    opening = "the quarterly statement of the regional committee for public transport and local roads notes the following figure and"
    word = lambda: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6))
    families = [f"{opening} {' '.join(word() for _ in range(2))} " for _ in range(150)]
    lines = [f + word() for f in families for _ in range(2)]
    assert len(kept_by_brute_force(lines)) == 150 and kept_lines(spark, lines) == kept_by_brute_force(lines)


def test_line_dedup_without_spaces_or_long_words(spark):
    r = random.Random(11)
    letters = lambda n: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))
    lines = []
    for _ in range(30):
        path, cells, short = letters(70), ",".join(str(r.randrange(10**5)) for _ in range(20)), " ".join(letters(3) for _ in range(24))
        lines += [f"https://example.org/{path}/1", f"https://example.org/{path}/2", f"id,{cells},1", f"id,{cells},2", short, f"{short[:-3]}xyz"]
    kept = kept_by_brute_force(lines)
    assert len(kept) == 90 and kept_lines(spark, lines) == kept


def test_decontamination_against_brute_force(spark, odd):
    items = [(i, prose(100 + i, 14)) for i in range(20)] + [(50, "only three words"), (51, None), (52, "")]
    texts = [(i, f"{prose(i)} {prose(100 + i % 20, 14).upper()}, {'only -- three: WORDS' if i % 3 == 0 else ''} é {prose(i + 7)}") for i in range(30)]
    docs, bench = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    cut_words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate({c: c + 32 for c in range(65, 91)}))
    want = {}
    for d, t in texts:
        w, hit, found = cut_words(t), set(), set()
        for i, x in items:
            v = cut_words(x or "")
            n = min(10, len(v))
            for a in range(len(v) - n + 1) if n else []:
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == v[a : a + n]:
                        hit |= set(range(b, b + n))
                        found.add(str(i))
        want[d] = (len(w), len(hit), sorted(found))
    for size in (64 << 20, 500):
        got = decontaminate.find_contamination(docs, bench, shard_bytes=size).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in got} == want
    assert texts[1][1][got[0].spans[0].start :] is not None
    assert decontaminate.find_contamination(odd, bench.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_of_letters_with_blank_bytes(spark):
    items = [(1, "voilà Ångström Россия хорошо"), (2, "а был Рим и хлеб à la carte Å jusque là où tu es"), (3, "один\u00a0два three"), (4, "日本語 腠 全")]
    rows = [(i, f"before {x}, after") for i, x in items] + [(9, "nothing of these")]
    found = decontaminate.find_contamination(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {r.doc_id: (r.n_hit, list(r["items"])) for r in found} == {1: (4, ["1"]), 2: (14, ["2"]), 3: (2, ["3"]), 4: (3, ["4"]), 9: (0, [])}


def test_secrets_base_and_added(spark, odd):
    r = random.Random(4)
    key = "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789") for _ in range(64))
    rows = [(1, f"é password='abcdefghijkl' token=short key {key} end"), (2, None), (3, "AKIAABCDEFGHIJKLMN0 deadbeefdeadbeef0 Secret : AbcdefghijklM"), (4, "averylongcompoundwordthatgoesonandonandonforeverandever")]
    got = {x.doc_id: x for x in secrets.secret_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    at = rows[0][1].index(key)
    assert got[1].n_assign == 1 and f"random:{at}:{at + 64}" in got[1].spans and got[4].spans == ""
    assert (got[3].n_access, got[3].n_hex, got[3].n_assign) == (1, 1, 1) and got[2].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.secret_report(odd).count() == odd.count()


def test_language_and_license_on_odd_rows(spark, odd):
    docs = spark.createDataFrame([(i, ("the cat and the dog were here with them " if i % 2 else "der hund und die katze waren nicht hier ") * 3, "en" if i % 2 else "de") for i in range(200)], "doc_id long, text string, lang string")
    rows = langid.learn_and_predict(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and all(r.lang_pred == r.lang for r in rows)
    got = {r.doc_id: r.lang_pred for r in langid.learn_and_predict(odd).collect()}
    assert got[4] == got[5] == got[7] == "und" and langid.learn_and_predict(odd.limit(0)).count() == 0
    lic = spark.createDataFrame([(1, f"{prose(1)}\nReleased under the MIT License.\nmore"), (2, "He took the licence to the office."), (3, None)], "doc_id long, text string")
    found = {r.doc_id: (r.licences, r.spans) for r in license_scan.license_report(lic).collect()}
    start = len(prose(1)) + 1
    assert found == {1: ("MIT", f"{start}:{start + 31}:MIT"), 2: ("", ""), 3: ("", "")}


def test_license_texts_that_are_wrapped_or_within_a_line(spark):
    wrap = lambda texts, lead="", gap="\n\n": gap.join(textwrap.fill(x, 72, initial_indent=lead, subsequent_indent=lead) for x in texts)
    t = license_scan.TEMPLATES
    texts = {
        1: ("GPL", f"Copyright 2020\n\n{wrap(t['GPL'][:3])}\n\n{prose(1)}"), 2: ("MIT", wrap(t["MIT"][:2])), 3: ("BSD", wrap(t["BSD"][:4], gap="\n")),
        4: ("Apache-2.0", "/*\n" + wrap(t["Apache-2.0"][:2], " * ", "\n *\n") + "\n */"), 5: ("Apache-2.0,MIT", f"{prose(2, 400)} {t['MIT'][0]} {prose(3, 400)} {t['Apache-2.0'][1]}"),
        6: ("", f"{prose(4)}\nof the work, and the use of the software\n{prose(5)}"), 7: ("MIT", "SPDX-License-Identifier: MIT"),
    }
    got = {r.doc_id: r for r in license_scan.license_report(spark.createDataFrame([(i, x) for i, (_, x) in texts.items()], "doc_id long, text string")).collect()}
    assert {i: r.licences for i, r in got.items()} == {i: k for i, (k, _) in texts.items()}
    x = texts[2][1]
    assert got[2].spans == f"0:{x.index('conditions:') + 10}:MIT,{x.index('The above')}:{len(x) - 1}:MIT"


def test_chat_round_trip(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "<\\|a", "<\\\\|x|>", "a\\n<|", ""]
    rows = [(1, i, "assistant" if i % 2 else "us\\er\n<|", t) for i, t in enumerate(hard)] + [(2, 0, "user", None), (None, 1, "assistant", "x"), (3, None, None, "q")]
    ex = chat.prefix_target_examples(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    last = max((e for e in ex if e.conv_id == 1), key=lambda e: e.example)
    assert chat.parse(last.text) == [(r[2], r[3]) for r in rows[:5]]
    assert [chat.unescape(e.text[e.loss_start : e.loss_end]) for e in ex if e.conv_id == 1 and e.trainable] == [hard[1], hard[3]]
    assert {e.conv_id for e in ex} == {1, 2, 3, None}

"""Benchmark decontamination: one Aho-Corasick automaton over the windows of test items, each text scanned once.

Words are those of `wordhash`: ASCII letters (A-Z lowered), digits and non-ASCII characters. A window is `window`
consecutive words of an item; an item of fewer words, but not none, is one window. A text word inside any occurrence
of a window is hit.
"""

from __future__ import annotations

import hashlib
import pickle
import uuid
from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.wordhash import normalise

#: What this worker has built last.
_BUILT: dict = {}
SCHEMA = "row_key string, doc_id long, n_words long, ranges array<struct<a:long,b:long>>, items array<string>, spans array<struct<start:long,end:long>>"


def item_windows(text: str | None, window: int) -> tuple[list[str], int]:
    """The windows of an item as padded strings, and the words in each."""
    words = [w.decode("latin-1") for w in normalise(text or "").split()]  # split as bytes: \x85 and \xa0 are blanks in Latin-1
    n = min(window, len(words))
    return [f" {' '.join(words[i : i + n])} " for i in range(len(words) - n + 1)] if n else [], n


def build(items: list[tuple[object, str | None]], window: int) -> ahocorasick.Automaton:
    """Automaton from window to (words, ids of the items that have it)."""
    found: dict[str, tuple[int, list[str]]] = {}
    for item, text in items:
        windows, n = item_windows(text, window)
        for w in windows:
            ids = found.setdefault(w, (n, []))[1]
            if str(item) not in ids:
                ids.append(str(item))
    automaton = ahocorasick.Automaton()
    for w, value in found.items():
        automaton.add_word(w, value)
    if found:
        automaton.make_automaton()
    return automaton


def scan(text: str | None, automaton: ahocorasick.Automaton) -> tuple[int, list[tuple[int, int]], list[str], list[tuple[int, int]]]:
    """Words of the text, merged ranges of hit words, items found, and the ranges as code points of the text."""
    data = normalise(text or "")
    words = data.split()
    if not words or not len(automaton):
        return len(words), [], [], []
    flat = f" {b' '.join(words).decode('latin-1')} "
    ranges: list[list[int]] = []
    ids: set[str] = set()
    at = seen = 0
    for end, (n, items) in automaton.iter(flat):
        seen += flat.count(" ", at, end + 1)  # spaces up to the match's last: the words before that space
        at = end + 1
        last = seen - 1
        ids.update(items)
        begin = last - n
        while ranges and begin <= ranges[-1][1]:
            begin = min(begin, ranges.pop()[0])
        ranges.append([begin, last])
    return len(words), [(a, b) for a, b in ranges], sorted(ids), _spans(text or "", data, ranges) if ranges else []


def _spans(text: str, data: bytes, ranges: list[list[int]]) -> list[tuple[int, int]]:
    """Code points of the original text from its first hit word's start to its last one's end, for every range."""
    import numpy as np

    b = np.frombuffer(data, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=np.int8)
    inside[1:-1] = b != 32
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    point = np.cumsum((b & 0xC0) != 0x80)  # code points up to and including this byte
    begin, end = edge[::2], edge[1::2]
    return [(int(point[begin[a]]) - 1, int(point[end[z - 1] - 1])) for a, z in ranges]


def _union(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_contamination(docs: DataFrame, benchmark: DataFrame, window: int = 10, shard_bytes: int = 1 << 19) -> DataFrame:
    """Every document with `n_words`, `n_hit`, `items` (found item ids as sorted strings) and `spans` (code points of hit passages).

    docs has doc_id and text; benchmark has item_id and text; other columns are left out. Texts are scanned whole, one
    document at a time. The texts of a shard of the benchmark are broadcast, and each worker builds its automaton once;
    it takes some 440 times the bytes of the texts in memory, so a shard has about `shard_bytes` of them (the default:
    220 MB a worker). A larger benchmark has more shards, each scanning the documents once, and the hits are united by
    document, so nothing is dropped and a worker holds one shard's automaton at a time.

    Null or empty texts have no words and no hits; a null item text has no window; an item of fewer words than
    `window` is one window; repeated items are found together; repeated rows and doc_ids stay rows of their own; a
    null doc_id stays null; an empty benchmark hits nothing; extra columns are ignored.
    """
    spark = docs.sparkSession
    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    size = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, -(-size // shard_bytes))
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    if shards == 1:
        return _digest(need.mapInPandas(_scanner(spark, items.collect(), window), SCHEMA))
    keyed = need.withColumn("doc_id", F.col("doc_id"))
    parts = None
    for k in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).collect()
        part = keyed.mapInPandas(_scanner(spark, rows, window), SCHEMA)
        parts = part if parts is None else parts.unionByName(part)
    united = parts.groupBy("row_key", "doc_id", "n_words").agg(
        (F.count(F.lit(1)) / F.lit(shards)).cast("int").alias("times"),
        F.flatten(F.collect_list("ranges")).alias("ranges"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("spans")))).alias("spans"),
    )

    def unite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            f["ranges"] = [[{"a": a, "b": b} for a, b in _union([(x["a"], x["b"]) for x in r])] for r in f["ranges"]]
            f["spans"] = [[{"start": a, "end": b} for a, b in _union([(x["start"], x["end"]) for x in s])] for s in f["spans"]]
            f = f.loc[f.index.repeat(f["times"])]
            yield f.drop(columns=["times"])

    return _digest(united.mapInPandas(unite, SCHEMA))


def _scanner(spark, rows: list, window: int):
    """The scan of one shard. The items are broadcast; a worker keeps the automaton of the last shard it has built."""
    sent = spark.sparkContext.broadcast(pickle.dumps([(r["item_id"], r["text"]) for r in rows]))
    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        if _BUILT.get("key") != key:
            _BUILT.clear()
            _BUILT.update(key=key, automaton=build(pickle.loads(sent.value), window))
        automaton = _BUILT["automaton"]
        for f in batches:
            out = [scan(t if isinstance(t, str) else None, automaton) for t in f["text"]]
            yield pd.DataFrame({
                "row_key": [hashlib.blake2b((t or "").encode("utf-8", "surrogatepass"), digest_size=16).hexdigest() if o[0] else "" for t, o in zip(f["text"], out, strict=True)],
                "doc_id": f["doc_id"].astype("Int64"),
                "n_words": [o[0] for o in out],
                "ranges": [[{"a": a, "b": b} for a, b in o[1]] for o in out],
                "items": [o[2] for o in out],
                "spans": [[{"start": a, "end": b} for a, b in o[3]] for o in out],
            })

    return run


def _digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words",
        F.aggregate("ranges", F.lit(0).cast("long"), lambda acc, r: acc + r["b"] - r["a"]).alias("n_hit"),
        "items", "spans",
    )

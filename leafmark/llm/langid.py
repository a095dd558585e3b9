"""Language identification by character n-grams in bit-sliced Bloom filters: one look-up tells all languages of an n-gram.

A slot holds one bit for each language (64 languages a plane). An n-gram is in the languages whose bit is set in all
of its `hashes` slots. A text's count for a language is the number of its n-grams that are in it, less what false
positives of that language's slice would give; the language with most decides.
"""

from __future__ import annotations

import pickle
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm.common import cut, unused
from leafmark.llm.wordhash import mix

SIZES = (2, 3, 4)
_LIMIT = 1 << 17


def held_out(doc_id):
    """crc32 of the doc_id as text, modulo 4, is 2 (null: not)."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def _pieces(text: str) -> Iterator[str]:
    """The text in pieces of bounded length, cut at white space where there is some."""
    at = 0
    while at < len(text):
        to = len(text) if len(text) - at <= _LIMIT else at + _LIMIT
        if to < len(text) and (cut_at := text.rfind(" ", at, to)) > at:
            to = cut_at
        yield text[at:to]
        at = to


_KIND = np.zeros(0x110000, dtype=np.uint32)


def _folded(text: str) -> np.ndarray:
    """Code points, lower case; all that aren't letters or marks are one space. Tables are filled on first use."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    got = _KIND[points]
    if not got.all():
        for c in np.unique(points[got == 0]).tolist():
            low = chr(c).lower()
            _KIND[c] = ord(low[0]) if low[0].isalpha() or unicodedata.category(chr(c))[0] == "M" else 32
        got = _KIND[points]
    return got


def ngrams(text: str, sizes: tuple[int, ...] = SIZES) -> np.ndarray:
    """64-bit hashes of all n-grams of letters, with word edges as spaces; n-grams with an inner space are left out."""
    out = []
    for piece in _pieces(text):
        c = _folded(piece)
        keep = np.ones(len(c), dtype=bool)
        keep[1:] = (c[1:] != 32) | (c[:-1] != 32)
        c = np.concatenate(([32], c[keep], [32])).astype(np.uint64)
        space = c == 32
        for n in sizes:
            m = len(c) - n + 1
            if m <= 0:
                continue
            h = np.full(m, np.uint64(n), dtype=np.uint64)
            fine = np.ones(m, dtype=bool)
            for k in range(n):
                h = (h << np.uint64(13)) ^ (h >> np.uint64(51)) ^ (c[k : k + m] * np.uint64(0x9E3779B97F4A7C15))
                if 0 < k < n - 1:
                    fine &= ~space[k : k + m]
            if n == 2:
                fine = ~(space[:m] & space[1 : 1 + m])
            out.append(h[fine])
    return mix(np.concatenate(out)) if out else np.zeros(0, dtype=np.uint64)


def has_letters(text: str) -> bool:
    """Whether a letter is in the text; marks alone are none."""
    return any(map(str.isalpha, text))


class Filters:
    """The bit-sliced filters of a list of languages."""

    def __init__(self, langs: list[str], slots: int = 1 << 18, hashes: int = 3):
        self.langs, self.slots, self.hashes = langs, slots, hashes
        self.bits = np.zeros((-(-len(langs) // 64) or 1, slots), dtype=np.uint64)

    def _slot(self, grams: np.ndarray, k: int) -> np.ndarray:
        return ((grams * np.uint64(0xD6E8FEB86659FD93 + 2 * k * 0x632BE59BD9B4E019 & ((1 << 64) - 1) | 1)) >> np.uint64(32)).astype(np.int64) % self.slots

    def add(self, lang: int, grams: np.ndarray) -> None:
        for k in range(self.hashes):
            np.bitwise_or.at(self.bits[lang // 64], self._slot(grams, k), np.uint64(1 << (lang % 64)))

    def seal(self) -> None:
        fill = [float(np.mean((self.bits[i // 64] >> np.uint64(i % 64)) & np.uint64(1))) for i in range(len(self.langs))]
        self.false = np.array([f**self.hashes for f in fill])

    def counts(self, grams: np.ndarray) -> np.ndarray:
        """How many of the n-grams are in each language, false positives taken off."""
        found = np.zeros(len(self.langs))
        slots = [self._slot(grams, k) for k in range(self.hashes)]
        for plane, bits in enumerate(self.bits):
            masks = bits[slots[0]]
            for s in slots[1:]:
                masks = masks & bits[s]
            for i in range(plane * 64, min(len(self.langs), plane * 64 + 64)):
                found[i] = np.count_nonzero(masks & np.uint64(1 << (i % 64)))
        return np.clip((found - len(grams) * self.false) / np.maximum(1e-9, 1 - self.false), 0, None)

    def decide(self, text: str | None) -> tuple[str, float, float]:
        """Language, score (its share of the evidence) and cover (the share of n-grams that it knows)."""
        if text is None or not self.langs:
            return "und", 0.0, 0.0
        grams = ngrams(text)
        if not len(grams) or not has_letters(text):
            return "und", 0.0, 0.0
        c = self.counts(grams)
        best = int(c.argmax())
        if c[best] <= 0:
            return self.langs[0], 0.0, 0.0
        others = float(np.delete(c, best).max()) if len(c) > 1 else 0.0
        return self.langs[best], float(c[best] / (c[best] + others)), min(1.0, float(c[best]) / len(grams))


def train(labelled: DataFrame, per_language: int = 1500, characters: int = 20000, top: int = 6000, slots: int = 1 << 18, hashes: int = 3) -> Filters:
    """Filters from (doc_id, text, lang) rows.

    The sample is bounded: of each language about `per_language` documents, those whose hash is least, and of a longer
    text the first `characters`. Of each language the `top` n-grams of each size by documents that have them are put
    in; the counting is a distributed aggregation, and the driver gets `top` rows for each language and size.
    N-grams of a single document count too. Rows without text, lang or letters teach nothing; a table without any gives filters that know no language.
    """
    rows = labelled.where("text is not null and lang is not null")
    share = cut(rows.groupBy("lang").agg(F.count(F.lit(1)).alias("of")))
    langs = [r["lang"] for r in share.orderBy("lang").collect()]
    filters = Filters(langs, slots, hashes)
    # 1e9 hash values; a language keeps those below its share.
    picked = rows.join(F.broadcast(share), "lang").where(F.pmod(F.xxhash64(F.lit(11), "doc_id"), F.lit(1_000_000_000)) < F.lit(1e9) * per_language / F.col("of")).select("lang", F.substring("text", 1, characters).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple[str, int], list[np.ndarray]] = {}

        def done() -> pd.DataFrame:
            parts = []
            for (lang, n), sets in seen.items():
                gram, docs = np.unique(np.concatenate(sets), return_counts=True)
                parts.append(pd.DataFrame({"lang": lang, "n": n, "gram": gram.view(np.int64), "docs": docs}))
            seen.clear()
            return pd.concat(parts) if parts else pd.DataFrame({"lang": [], "n": [], "gram": [], "docs": []})

        for f in batches:
            for lang, text in zip(f["lang"], f["text"], strict=True):
                for n in SIZES:
                    seen.setdefault((lang, n), []).append(np.unique(ngrams(text, (n,))))
            yield done()

    tally = picked.mapInPandas(count, "lang string, n int, gram long, docs long").groupBy("lang", "n", "gram").agg(F.sum("docs").alias("docs"))
    best = Window.partitionBy("lang", "n").orderBy(F.desc("docs"), "gram")
    kept = tally.withColumn("r", F.row_number().over(best)).where(F.col("r") <= top).select("lang", "gram")
    at = {x: i for i, x in enumerate(langs)}
    table = kept.toPandas()
    for lang, part in table.groupby("lang"):
        filters.add(at[lang], part["gram"].to_numpy(np.int64).view(np.uint64))
    filters.seal()
    return filters


def _guess(docs: DataFrame, filters: Filters, name: str) -> DataFrame:
    """docs with a column `name`: struct(lang_pred, score, cover)."""
    sent = docs.sparkSession.sparkContext.broadcast(zlib.compress(pickle.dumps(filters), 1))

    @F.pandas_udf("struct<lang_pred:string,score:double,cover:double>")
    def guess(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = pickle.loads(zlib.decompress(sent.value))
        for s in texts:
            yield pd.DataFrame([model.decide(t if isinstance(t, str) else None) for t in s], columns=["lang_pred", "score", "cover"])

    return docs.withColumn(name, guess(F.col("text").cast("string")))


def predict(docs: DataFrame, filters: Filters) -> DataFrame:
    """Every row's doc_id with lang_pred, score and cover, over its whole text.

    `und` with score 0 is for null texts and texts without letters, or if no language was learned. Ties go to the
    language that sorts first; so does a text with letters of which no n-gram is known, with score 0. Repeated rows and null ids stay; an empty table gives no rows; other columns are left out.
    """
    return _guess(docs.select("doc_id", "text"), filters, "guess").select("doc_id", "guess.lang_pred", "guess.score", "guess.cover")


def learn_and_predict(docs: DataFrame, **how) -> DataFrame:
    """held_out, lang_pred, score and cover of every document, learned from the others' lang; docs has doc_id, text, lang."""
    filters = train(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out("doc_id")), **how)
    return predict(docs, filters).withColumn("held_out", held_out("doc_id"))


def reject_unknown(docs: DataFrame, cover: float = 0.2, **how) -> DataFrame:
    """The documents whose language is known: not `und`, and at least `cover` of the n-grams in the language decided for.

    All columns stay as they are, whatever their names. Null texts go; null ids and repeated rows are judged like any other.
    """
    filters = train(docs.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where(~held_out("doc_id")), **how)
    name = unused(docs.columns, "guess_")
    found = F.col(name)
    return _guess(docs, filters, name).where((found["lang_pred"] != "und") & (found["cover"] >= cover)).select(*docs.columns)

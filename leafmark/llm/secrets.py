"""Secret scans in DataFrame operations only: three patterns, and a randomness test battery for other tokens.

Places are code points, end exclusive. They come from splitting the text at the pattern: a match starts where the
pieces and matches before it end.

The battery takes runs of 20 characters or more of the base64 alphabets, infers the encoding, and tests whether the
token could be uniform over that alphabet: a chi-squared test of the letter counts, a runs test on halves of the
alphabet, and a serial correlation test of neighbours. A token that any of them rejects is no secret. For the rest,
p is the chance that text-like characters (letters as uneven as words have them) look as even over that length. Within
each encoding and length band a Benjamini-Hochberg step-up holds the false-discovery rate; its counts are a histogram
of p over all tokens of the corpus, of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leafmark.llm.common import cut, join_salted

# Fixed patterns, as the base kinds are defined; in hex and access the length is part of the pattern, since their runs are maximal.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
TOKEN = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")

_UPPER, _LOWER, _DIGIT = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789"
#: Encoding: pattern that a token must match, its alphabet in order, and the collision rate of text written in it.
ENCODINGS = (
    ("digits", "^[0-9]+$", _DIGIT, 0.2),
    ("hex", "^(?:[0-9a-f]+|[0-9A-F]+)$", _DIGIT + "abcdef", 0.12),
    ("base32", "^[A-Z2-7]+$", _UPPER + "234567", 0.066),
    ("alnum", "^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGIT, 0.066),
    ("base64", "^[A-Za-z0-9+/_-]+$", _UPPER + _LOWER + _DIGIT + "+/", 0.066),
)
BINS = 200
#: Matches of a text that are placed together, at least.
AT_ONCE = 64
MATCH = "array<struct<start:int,k:int,stop:int,token:string>>"


def _places(text: Column, pattern: str, k: int, least: int = 0, group: int = 0) -> Column:
    """start, kind, stop and matched text of every match, those with a shorter group than `least` left out."""
    pat = F.lit(pattern)
    matches = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, pat, F.lit(0)).alias("m"), F.regexp_extract_all(text, pat, F.lit(group)).alias("g"))
    none = F.array().cast(MATCH)
    length = lambda x: F.char_length(x["gap"]) + F.coalesce(F.char_length(x["m"]), F.lit(0))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["gap"])
        stop = start + F.coalesce(F.char_length(x["m"]), F.lit(0))
        one = F.array(F.struct(start.alias("start"), F.lit(k).alias("k"), stop.alias("stop"), x["m"].alias("token"))).cast(MATCH)
        fits = x["m"].isNotNull() & (F.char_length(x["g"]) >= least)
        return F.struct(stop.alias("at"), F.when(fits, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    # in blocks of about the root of their number, since an array that grows by one, or is sliced, is copied each time: first where each block begins, then its matches
    def blocks(ms: Column) -> Column:
        size = F.greatest(F.lit(AT_ONCE), F.ceil(F.sqrt(F.size(ms)))).cast("int")
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(ms) - 1) / size).cast("int")), lambda b: F.slice(ms, b * size + 1, size))

    def within(bs: Column) -> Column:
        lengths = F.transform(bs, lambda b: F.aggregate(b, F.lit(0), lambda acc, x: acc + length(x)))
        begins = F.aggregate(lengths, F.array(F.lit(0)), lambda acc, n: F.concat(acc, F.array(F.element_at(acc, -1) + n)))
        return F.flatten(F.zip_with(bs, F.slice(begins, F.lit(1), F.size(bs)), lambda b, at: F.aggregate(b, F.struct(at.alias("at"), none.alias("out")), step)["out"]))

    return F.when(text.rlike(pattern), F.element_at(F.transform(F.array(matches), lambda ms: within(blocks(ms))), 1)).otherwise(none)


def _phi(z: Column) -> Column:
    """The normal distribution function, by a logistic approximation that is within 0.0002."""
    return F.lit(1.0) / (F.lit(1.0) + F.exp(F.greatest(F.lit(-700.0), F.least(F.lit(700.0), -(F.lit(1.5976) * z + F.lit(0.070566) * z * z * z)))))


def _add_square(token: Column):
    return lambda acc, c: acc + F.pow((F.char_length(token) - F.char_length(F.replace(token, c, F.lit("")))).cast("double"), F.lit(2.0))


def _code(alphabet: str):
    return lambda c: F.call_function("instr", F.lit(alphabet), c).cast("double")


def battery(token: Column, n: Column) -> Column:
    """struct(encoding, p): p is 1 where one of the tests rejects randomness."""
    found = F.lit(None).cast("struct<encoding:int,p:double>")
    for i, (name, shape, alphabet, collide) in reversed(list(enumerate(ENCODINGS))):
        size = len(alphabet)
        plain = F.translate(token, "-_", "+/") if name == "base64" else F.lower(token) if name == "hex" else token
        chars = F.split(plain, "")
        chars = F.filter(chars, lambda c: c != "")
        squares = F.aggregate(F.array_distinct(chars), F.lit(0.0), _add_square(plain))
        chi = F.lit(float(size)) * squares / n - n
        df = size - 1.0
        z_chi = (chi - df) / F.sqrt(F.lit(2.0 * df) * (n - 1) / n)
        halves = F.translate(plain, alphabet, "0" * (size // 2) + "1" * (size - size // 2))
        ones = F.char_length(F.replace(halves, F.lit("0"), F.lit(""))).cast("double")
        runs = F.char_length(F.regexp_replace(halves, r"0+|1+", "r")).cast("double")
        mean_runs = 2.0 * ones * (n - ones) / n + 1.0
        z_runs = F.when((ones == 0) | (ones == n), F.lit(9.0)).otherwise((runs - mean_runs) / F.sqrt(F.greatest(F.lit(1e-9), (mean_runs - 1) * (mean_runs - 2) / (n - 1))))
        codes = F.transform(chars, _code(alphabet))
        sums = F.aggregate(
            codes, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"), F.lit(0.0).alias("x"), F.lit(None).cast("double").alias("last")),
            lambda acc, c: F.struct((acc["s"] + c).alias("s"), (acc["q"] + c * c).alias("q"), (acc["x"] + F.coalesce(acc["last"] * c, F.lit(0.0))).alias("x"), c.alias("last")),
            lambda acc: F.struct(acc["s"].alias("s"), acc["q"].alias("q"), acc["x"].alias("x")),
        )
        mean = sums["s"] / n
        spread = sums["q"] - n * mean * mean
        serial = F.when(spread > 1e-9, (sums["x"] - (n - 1) * mean * mean) / spread).otherwise(F.lit(1.0))
        z_serial = (serial + 1.0 / n) * F.sqrt(n)
        extra = (n - 1) * (size * collide - 1)
        p_text = _phi((chi - df - extra) / F.sqrt(F.lit(2.0 * df) + 4.0 * extra))
        rejects = (z_chi > 3.5) | (F.abs(z_runs) > 3.5) | (F.abs(z_serial) > 3.5) | F.lit(name == "digits")
        one = F.struct(F.lit(i).alias("encoding"), F.when(rejects, F.lit(1.0)).otherwise(p_text).alias("p"))
        found = F.when(token.rlike(shape), one).otherwise(found)
    return found


def scan_secrets(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """doc_id, base and added of every row: arrays of struct(start, k, stop), k being the place of the kind in KINDS.

    base are the matches of assign, access and hex; added are tokens that pass the battery and overlap no base match.
    Null and empty texts have none; whole texts are scanned; null ids and repeated rows stay rows of their own (equal
    tokens count once when p's are ranked); an empty table gives no rows; extra columns are ignored.
    Texts aren't shuffled. Of a text with many matches the work grows as their number does. The histogram holds BINS counts for each encoding and length band.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    found = docs.select(
        "doc_id", _places(text, ASSIGN, 0, 12, 2).alias("assign"), _places(text, ACCESS, 1).alias("access"), _places(text, HEX, 2).alias("hex"), _places(text, TOKEN, 3).alias("token"),
    )
    three = F.array_sort(F.concat("assign", "access", "hex"))
    bare = F.transform(three, lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["stop"].alias("stop")))
    found = cut(found.select("doc_id", bare.alias("base"), "token"))
    tested = found.where(F.size("token") > 0).select(F.explode("token").alias("t")).select(F.col("t.token").alias("token")).distinct()
    n = F.char_length("token").cast("double")
    band = F.least(F.lit(9), F.floor(F.log2(n / 20.0) * 2)).cast("int")
    # -log2 p in steps of a quarter; p of a bin is its upper end, so ranks are on the safe side.
    marked = tested.select("token", battery(F.col("token"), n).alias("b"), band.alias("band")).select(
        "token", F.concat_ws("/", "b.encoding", "band").alias("stratum"), F.least(F.lit(BINS - 1), F.floor(-F.log2(F.greatest(F.lit(1e-30), "b.p")) * 4)).cast("int").alias("bin")
    )
    marked = cut(marked)
    counts = marked.groupBy("stratum", "bin").agg(F.count(F.lit(1)).alias("n"))
    by: dict[str, dict[int, int]] = {}
    for r in counts.collect():
        by.setdefault(r["stratum"], {})[r["bin"]] = r["n"]
    least: dict[str, int] = {}
    for stratum, bins in by.items():
        total, upto, best = sum(bins.values()), 0, None
        for b in sorted(bins, reverse=True):
            upto += bins[b]
            if b > 0 and 2.0 ** (-b / 4) <= rate * upto / total:
                best = b
        if best is not None:
            least[stratum] = best
    passed = F.lit(False)
    for stratum, b in sorted(least.items()):
        passed = passed | ((F.col("stratum") == stratum) & (F.col("bin") >= b))
    secret = cut(marked.where(passed).select("token"))
    return _with_added(found, secret)


def _with_added(found: DataFrame, secret: DataFrame) -> DataFrame:
    """Tokens that are in `secret` become added matches of their rows, if they overlap no base match; rows are told apart
    by a 128-bit name of their id and matches.

    Spans are compared in the order of their starts, by windows over a row's spans: of the base matches that start no
    later the one that ends last, and of those that start later the first. So the work grows as a text's matches do.
    """
    span = lambda x: F.struct(x["start"].alias("start"), x["k"].alias("k"), x["stop"].alias("stop"))
    bare = F.transform("base", span)
    key = F.struct(F.xxhash64("doc_id", bare, "token").alias("a"), F.xxhash64(F.lit(1), "doc_id", bare, "token").alias("b"))
    keyed = found.withColumn("key", key)
    some = keyed.where(F.size("token") > 0)
    each = some.select("key", F.explode("token").alias("t")).select("key", F.col("t.start").alias("start"), F.col("t.stop").alias("stop"), F.col("t.token").alias("token")).distinct()
    few = secret.limit(200_001).count() <= 200_000
    met = each.join(F.broadcast(secret), "token") if few else join_salted(each, cut(each.groupBy("token").agg(F.count(F.lit(1)).alias("n")).join(secret, "token")), ["token"])
    met = cut(met.select("key", "start", "stop"))
    base = some.join(met.select("key").distinct(), "key", "left_semi").select("key", F.explode("base").alias("x")).select("key", "x.start", "x.stop").distinct()
    spans = met.withColumn("new", F.lit(True)).unionByName(base.withColumn("new", F.lit(False)))
    of_row, old = Window.partitionBy("key"), ~F.col("new")
    upto = F.max(F.when(old, F.col("stop"))).over(of_row.orderBy("start").rangeBetween(Window.unboundedPreceding, Window.currentRow))
    after = F.min(F.when(old, F.col("start"))).over(of_row.orderBy(F.desc("start")).rangeBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("upto", upto).withColumn("after", after)
    free = marked.where("new").where(F.coalesce(F.col("upto") <= F.col("start"), F.lit(True)) & F.coalesce(F.col("after") >= F.col("stop"), F.lit(True)))
    hit = free.groupBy("key").agg(F.array_sort(F.collect_set(F.struct("start", F.lit(3).alias("k"), "stop"))).alias("added"))
    joined = keyed.join(hit, "key", "left")
    return joined.select("doc_id", "base", F.coalesce("added", F.array().cast("array<struct<start:int,k:int,stop:int>>")).alias("added"))


def span_text(matches: Column) -> Column:
    """kind:start:end of every match, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(matches, lambda x: F.concat_ws(":", F.element_at(names, x["k"] + 1), x["start"], x["stop"])), ",")


def secret_report(docs: DataFrame, rate: float = 0.05) -> DataFrame:
    """Counts of the base kinds, the digest of the base spans and all spans of every row; see scan_secrets() for odd rows."""
    found = scan_secrets(docs, rate)
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(span_text(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        span_text(F.array_sort(F.concat("base", "added"))).alias("spans"),
    )

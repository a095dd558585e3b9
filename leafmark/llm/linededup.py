"""Fuzzy line dedup by MinHash: one line of each component of similar lines stays.

A line is compared as it stands, without the blanks at its ends. Equal lines are collapsed first, by a 128-bit name.
Similarity is the Jaccard coefficient of the sets of all 5-character shingles; a line of fewer characters is its own
only shingle. Signatures are of all shingles of 5 bytes of UTF-8, of which similar lines share at least as many: the
hashes of a line are sorted, and each of `MARKS` fixed points takes the next hash after it, around the end. Two lines
have a point's hash in common with the probability of their similarity. Band k is made of five neighbouring points, so
that two lines at a similarity of 0.8 share one of the `BANDS` bands with probability 0.96, at 0.85 with 0.99; short
lines share one more often.

Lines of a band are compared with its first line, on their whole sets. Where these links leave a band in more than one
component, all its pairs of different components are compared too. Of these, pairs go without their sets being made
if their sizes or sketches rule them out for certain: a bit of a sketch is the parity of the number of shingles that
fall on it, so that sketches differ in no more bits than sets do in shingles. Large bands are dealt to tasks by pairs
of blocks, of bounded size. Components are found by distributed union-find.

All of it is DataFrame operations and SQL functions; nothing runs in Python on the executors. What is used more than
once is written as Parquet, and the shuffles that made it are freed then and not when the driver's heap is next collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import in_block_pairs, join_checked, join_salted, unused, written
from leafmark.llm.components import connected_components

SHINGLE, BANDS, ROWS = 5, 8, 5
#: Points among the hashes, in ascending order and equally far apart; band k has ROWS of them from ROWS * k on. That they are neighbours
#: makes bands independent: in a line of fewer shingles than points, some points of a band take the same hash, but seldom those of two bands.
MARKS = [-(1 << 63) + i * ((1 << 64) // (BANDS * ROWS)) for i in range(BANDS * ROWS)]
#: Words of 64 bits in a sketch: with half of them, 2.6 times as many pairs of lines of 300 to 500 shingles at some 0.77 weren't ruled out, in a simulation.
SKETCH = 16
BLANKS = (" ", "\t", "\r", "\u000b", "\f")
#: Names of lines, 8 bytes each, and dropped positions, with four a document for the rest of its row, up to which they are broadcast: some 32 MB.
BROADCAST_NAMES = BROADCAST_POSITIONS = 4_000_000
#: Lines in a block, or thousands of characters if that is more.
BLOCK = 1000
#: Frees the shuffles of an execution at its end, where that writes a table.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stored(df: DataFrame, what: str = "cut") -> DataFrame:
    """The rows as a written table; the shuffles that made them are freed."""
    conf = df.sparkSession.conf
    before = conf.get(FREED, "false")
    conf.set(FREED, "true")
    try:
        return written(df, what)
    finally:
        conf.set(FREED, before)


def trimmed(line: Column) -> Column:
    """The line without blanks at its ends; looked at closely only where there are some."""
    odd = F.lit(False)
    for b in BLANKS:
        odd = odd | F.startswith(line, F.lit(b)) | F.endswith(line, F.lit(b))
    return F.when(odd, F.btrim(line, F.lit("".join(BLANKS)))).otherwise(line)


def lines_of(docs: DataFrame) -> DataFrame:
    """doc_id, pos (from 0), line and its two names of every line that isn't blank."""
    split = docs.where("doc_id is not null and text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    named = split.select("doc_id", "pos", trimmed(F.col("line")).alias("line")).where("line <> ''")
    return named.select("doc_id", "pos", "line", F.xxhash64("line").alias("lid"), F.xxhash64(F.lit(1), "line").alias("lid2"))


def _padded(line: Column) -> Column:
    return F.when(F.char_length(line) < SHINGLE, F.rpad(line, SHINGLE, "\U0010ffff")).otherwise(line)


def _hashes(binary: Column, width: int) -> Column:
    """One hash for every SHINGLE consecutive units of `width` bytes. The inner function has the bytes as its variable: a column would be copied for each of them."""
    hashed = lambda v: F.transform(F.sequence(F.lit(1), F.octet_length(v) - (SHINGLE * width - 1), F.lit(width)), lambda i: F.xxhash64(F.substring(v, i, F.lit(SHINGLE * width))))
    return F.transform(F.array(binary), hashed)[0]


def shingles(line: Column) -> Column:
    """The hashes of all shingles of a line, with repeats."""
    return _hashes(F.encode(_padded(line), "UTF-32"), 4)


def signed_lines(lines: DataFrame) -> DataFrame:
    """uid, lid, lid2, n (places), first_doc, bands of every different line, as a written table.

    The one exchange of texts collapses equal lines, by hash and not by sorting, since the line is one of the keys; they
    are signed where it ends. A point's hash is found by its rank: so many points lie before it, the rest are hashes.
    The test of n, always true, is there for its lambda: in whole-stage code all bands would be one method, too long to be compiled.
    """
    own = ["lid", "lid2", "n", "first_doc"]
    unique = lines.groupBy("lid", "lid2", "line").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))
    hashed = unique.select(*own, F.sort_array(_hashes(_padded(F.col("line")).cast("binary"), 1)).alias("s"))
    marked = hashed.select(*own, "s", F.sort_array(F.concat("s", F.array(*map(F.lit, MARKS)))).alias("both"))
    at = [F.col("s")[F.pmod(F.array_position("both", F.lit(m)).cast("int") - (k + 1), F.size("s"))] for k, m in enumerate(MARKS)]
    bands = F.array(*[F.xxhash64(F.lit(b), *at[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)])
    signed = marked.select(*own, F.when(F.exists(F.array("n"), lambda n: n > 0), bands).alias("bands"))
    return stored(signed.withColumn("uid", F.monotonically_increasing_id()), "lines")


def band_members(signed: DataFrame) -> DataFrame:
    """(band, uid, pair): the lines of every band that has more than one. Bands are counted before; bands of the same two lines are one."""
    keyed = signed.select("uid", F.explode("bands").alias("band"))
    shared = stored(keyed.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.min("uid").alias("low"), F.max("uid").alias("high")).where("n > 1"))
    pairs = shared.where("n = 2").select("low", "high").distinct().select(F.xxhash64("low", "high").alias("band"), F.explode(F.array("low", "high")).alias("uid"), F.lit(True).alias("pair"))
    large = shared.where("n > 2").select("band", "n")
    few = large.limit(BROADCAST_NAMES + 1).count() <= BROADCAST_NAMES
    held = keyed.join(F.broadcast(large.select("band")), ["band"]) if few else join_salted(keyed, large, ["band"])
    return stored(pairs.unionByName(held.select("band", "uid", F.lit(False).alias("pair"))))


def similar(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of those pairs (a, b; different, a may have any number of b; already written) whose lines are similar, by their whole sets.

    Lines look for their pairs, and only those go by a, unless the pairs are too many to be sent to all tasks.
    """
    few = pairs.limit(BROADCAST_NAMES // 4 + 1).count() <= BROADCAST_NAMES // 4
    sent = F.broadcast if few else (lambda df: df)
    degree = stored(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("n")))
    hubs = texts.select(F.col("uid").alias("a"), F.col("line").alias("a_line")).join(sent(degree), ["a"])
    both = texts.select(F.col("uid").alias("b"), F.col("line").alias("b_line")).join(sent(pairs), ["b"]).select("a", "b", "b_line")
    both = join_salted(both, hubs if few else stored(hubs), ["a"]).select("a", "b", shingles(F.col("a_line")).alias("p"), shingles(F.col("b_line")).alias("q"))
    common = both.select("a", "b", F.size(F.array_intersect("p", "q")).alias("common"), F.size(F.array_union("p", "q")).alias("union"))
    return stored(common.where(F.col("common") >= F.lit(threshold) * F.col("union") - 1e-9).select("a", "b"))


def sketches(texts: DataFrame) -> DataFrame:
    """uid, size (of the set of shingles) and the words x0, x1, ... of a sketch of every text."""
    each = texts.select("uid", F.array_distinct(shingles(F.col("line"))).alias("h")).select("uid", F.explode("h").alias("h"))
    word, bit = F.col("h").bitwiseAND(SKETCH - 1), F.expr("shiftleft(1L, cast(shiftright(h, 32) & 63 as int))")
    words = [F.coalesce(F.bit_xor(F.when(word == k, bit)), F.lit(0)).cast("long").alias(f"x{k}") for k in range(SKETCH)]
    return each.groupBy("uid").agg(F.count(F.lit(1)).alias("size"), *words)


def torn_pairs(members: DataFrame, comps: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """(a, b) of a band, of different components (lines without links are their own), that sizes and sketches don't rule out."""
    placed = members.where("not pair").join(comps.select(F.col("node.uid").alias("uid"), F.col("comp.uid").alias("comp")), ["uid"], "left")
    placed = stored(placed.select("band", "uid", F.coalesce("comp", "uid").alias("comp")))
    torn = placed.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    torn = stored(torn.select("band", "size", F.col("size").alias("n")))
    held = stored(join_salted(placed, torn, ["band"]))
    asked = stored(held.select("uid").distinct())
    known = stored(sketches(join_checked(texts, asked, ["uid"], "left_semi", BROADCAST_NAMES)).withColumnRenamed("size", "shingles"))
    dealt = in_block_pairs(held.join(known, ["uid"]), "band", "uid", "size", BLOCK).drop("size")
    unit = ["band", "bi", "bj"]
    a, b = (dealt.select(*unit, *[F.col(c).alias(f"{x}_{c}") for c in dealt.columns if c not in unit]) for x in "ab")
    differ = sum((F.bit_count(F.col(f"a_x{k}").bitwiseXOR(F.col(f"b_x{k}"))) for k in range(SKETCH)), F.lit(0))
    total = F.col("a_shingles") + F.col("b_shingles")
    near = F.least("a_shingles", "b_shingles") >= F.lit(threshold) * F.greatest("a_shingles", "b_shingles") - 1e-9
    near = near & (differ <= F.lit((1 - threshold) / (1 + threshold)) * total + 1e-9)
    other = (F.col("a_uid") < F.col("b_uid")) & (F.col("a_comp") != F.col("b_comp")) & ((F.col("bi") == F.col("bj")) | (F.col("a_blk") != F.col("b_blk")))
    return a.join(b, unit).where(other & near).select(F.col("a_uid").alias("a"), F.col("b_uid").alias("b")).distinct()


def similar_lines(signed: DataFrame, lines: DataFrame, threshold: float) -> DataFrame:
    """(node, comp) of lines that are linked to others, nodes being struct(first_doc, uid), the least of which names the component."""
    members = band_members(signed)
    asked = stored(join_checked(signed.select("uid", "lid", "lid2", "first_doc"), members.select("uid").distinct(), ["uid"], "left_semi", BROADCAST_NAMES))
    few = asked.limit(BROADCAST_NAMES // 4 + 1).count() <= BROADCAST_NAMES // 4
    own = lines.select("lid", "lid2", "line")
    own = own.join(F.broadcast(asked), ["lid", "lid2"]) if few else own.distinct().join(asked, ["lid", "lid2"])
    texts = stored(own.select("uid", "first_doc", "line").distinct(), "texts")
    first = stored(members.groupBy("band").agg(F.min("uid").alias("a"), F.count(F.lit(1)).alias("n")))
    stars = join_salted(members.select("band", F.col("uid").alias("b")), first, ["band"]).where("a <> b").select("a", "b").distinct()
    nodes = asked.select("uid", F.struct("first_doc", "uid").alias("node"))

    def linked(pairs: DataFrame) -> DataFrame:
        ends = similar(stored(pairs), texts, threshold)
        for x in "ab":
            ends = ends.join(nodes.select(F.col("uid").alias(x), F.col("node").alias(f"{x}_node")), [x])
        return ends.select(F.col("a_node").alias("a"), F.col("b_node").alias("b"))

    comps = connected_components(linked(stars))
    more = stored(linked(torn_pairs(members, comps, texts, threshold)))
    if more.isEmpty():
        return comps
    tree = comps.where("node <> comp").select(F.col("node").alias("a"), F.col("comp").alias("b"))
    return connected_components(tree.unionByName(more))


def dropped_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id and dropped (sorted positions, from 0) of documents that lose lines.

    Of a component (equal lines and lines linked by similarity) the line stays that the least doc_id has, at its first
    place there; of several such lines of one document an arbitrary one. Blank lines, null texts and rows with a null
    doc_id lose nothing. Rows with one doc_id are one document: they keep the same lines. Empty tables give no rows.
    A line of any length is compared whole. Texts are shuffled once, to collapse equal lines; those of lines with
    links once more, and all of them only if more lines than BROADCAST_NAMES / 4 share a band with others.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    lines = lines_of(docs)
    signed = signed_lines(lines)
    comps = similar_lines(signed, lines, threshold).select("node.uid", "comp")
    placed = signed.select("uid", "lid", "lid2", "n", "first_doc").join(comps, "uid", "left").where("n > 1 or comp is not null")
    home = F.when(F.col("comp").isNull(), F.col("first_doc")).when(F.col("comp.uid") == F.col("uid"), F.col("first_doc"))
    doomed = stored(placed.select("lid", "lid2", "n", home.alias("keep_doc")))
    hit = join_salted(lines.select("lid", "lid2", "doc_id", "pos"), doomed, ["lid", "lid2"])
    kept_first = F.min(F.when(F.col("keep_doc") == F.col("doc_id"), F.col("pos")))
    by_line = hit.groupBy("doc_id", "lid", "lid2").agg(F.collect_set("pos").alias("ps"), kept_first.alias("keep"))
    gone = by_line.select("doc_id", F.when(F.col("keep").isNull(), F.col("ps")).otherwise(F.array_remove("ps", F.col("keep"))).alias("ps")).where(F.size("ps") > 0)
    return gone.groupBy("doc_id").agg(F.array_sort(F.flatten(F.collect_list("ps"))).alias("dropped"))


def _few(gone: DataFrame, dropped: str) -> bool:
    return (gone.agg(F.sum(F.size(dropped) + 4)).first()[0] or 0) <= BROADCAST_POSITIONS


def line_report(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """doc_id, n_lines, n_dropped and dropped of every row; null texts have no lines; see dropped_lines() for odd rows."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.size(F.split(F.col("text").cast("string"), "\n")), F.lit(0)).alias("n_lines"))
    own = own.withColumn("n_lines", F.greatest(F.lit(0), F.col("n_lines")))
    gone = stored(dropped_lines(docs, threshold))
    none = F.array().cast("array<int>")
    return own.join(F.broadcast(gone) if _few(gone, "dropped") else gone, ["doc_id"], "left").select("doc_id", "n_lines", F.coalesce(F.size(F.coalesce("dropped", none)), F.lit(0)).alias("n_dropped"), F.coalesce("dropped", none).alias("dropped"))


def dedup_lines(docs: DataFrame, threshold: float = 0.8) -> DataFrame:
    """The documents without dropped lines, n_chars counted anew where there is such a column.

    Documents of which nothing but blank lines is left, having lost lines, go; all others stay, with all their columns,
    whatever these are called. See dropped_lines() for nulls, ties, repeated rows and empty tables.
    """
    at, drop = unused(docs.columns, "gone_id_"), unused(docs.columns, "gone_")
    gone = stored(dropped_lines(docs, threshold).select(F.col("doc_id").alias(at), F.col("dropped").alias(drop)))
    joined = docs.join(F.broadcast(gone) if _few(gone, drop) else gone, docs["doc_id"].cast("long") == F.col(at), "left")
    rest = F.array_join(F.filter(F.split(F.col("text").cast("string"), "\n"), lambda x, i: ~F.array_contains(drop, i)), "\n")
    out = joined.withColumn("text", F.when(F.col(drop).isNull(), F.col("text")).otherwise(rest))
    out = out.where(F.col(drop).isNull() | (F.btrim("text", F.lit("".join(BLANKS) + "\n")) != ""))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(drop).isNull(), F.col("n_chars")).otherwise(F.char_length("text").cast(docs.schema["n_chars"].dataType)))
    return out.select(*docs.columns)

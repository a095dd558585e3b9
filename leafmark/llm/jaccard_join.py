"""Similarity self-join of documents on word n-grams: a chosen-path join in the manner of CPSJoin.

Each distinct shingle set gets a MinHash sketch of T values. A run is a tree: a node holds sets; a hash of the node's
path chooses which of the T positions to split on, each with probability 1 / (threshold * T), and a set goes to one
child for each chosen position, the child being named by the path, the position and the set's value there. So sets
that share sampled tokens stay together, and a pair at the threshold is expected to share one child of each node it
shares. Nodes that are small enough are leaves; the others split on, to a largest depth. A pair survives a run down
to depth k as a critical branching process does; runs_needed() gives the runs that reach the target recall.

Leaves are brute-forced on 4-bit sketches for candidate links; the components of those are brute-forced on the full
shingle sets, so that every link has its exact Jaccard value and a count needs no list of pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leafmark.llm.common import cut, group_bounds, in_block_pairs, join_checked, join_salted, whole_groups
from leafmark.llm.components import connected_components
from leafmark.llm.wordhash import mix, normalise, shingle_set

T = 128
#: above: the size of the node's parent, 0 if unknown.
NODE = "node long, rep long, above long"
_SEEDS = mix(np.arange(1, T + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)
_ADDS = mix(_SEEDS + np.uint64(7))
_POSITION = mix(np.arange(1, T + 1, dtype=np.uint64) * np.uint64(0x8EBC6AF09C88C6E3))


def survival(depth: int) -> float:
    """The chance that a pair at the threshold shares a node at `depth` of one run."""
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return q


def runs_needed(recall: float, depth: int) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(depth)))


def sketch(shingles: np.ndarray) -> np.ndarray:
    """T MinHash values of 32 bits."""
    best = np.full(T, np.iinfo(np.uint64).max, dtype=np.uint64)
    for a in range(0, len(shingles), 4096):
        part = shingles[a : a + 4096, None] * _SEEDS
        part += _ADDS
        np.minimum(best, part.min(axis=0), out=best)
    return (mix(best) >> np.uint64(32)).astype(np.uint32)


def _features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in batches:
        ids, prints, sizes, sketches = [], [], [], []
        for doc, text in zip(f["doc_id"].tolist(), f["text"].tolist(), strict=True):
            s = shingle_set(normalise(text)) if isinstance(text, str) else np.zeros(0, dtype=np.uint64)
            ids.append(doc)
            sizes.append(len(s))
            prints.append(xxhash.xxh3_128_digest(s.tobytes()))
            sketches.append(sketch(s).tobytes() if len(s) else b"")
        yield pd.DataFrame({"doc_id": ids, "fp": prints, "n": sizes, "sketch": sketches})


def _children(path: np.ndarray, values: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """For rows with a path and a sketch each: the row of every child, and its path."""
    limit = np.uint64(int(2**64 / (threshold * T)))
    rows, paths = [], []
    for a in range(0, len(path), 2048):
        p = path[a : a + 2048, None]
        r, i = np.nonzero(mix(p ^ _POSITION[None, :]) < limit)
        rows.append(r + a)
        paths.append(mix((p[r, 0] ^ _POSITION[i]) * np.uint64(0xE7037ED1A0B428DB) + values[r + a, i].astype(np.uint64)))
    return (np.concatenate(rows), np.concatenate(paths)) if rows else (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64))


def _matrix(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), dtype=np.uint32).reshape(len(column), T)


def _first_levels(runs: int, levels: int, threshold: float, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            if not len(f):
                continue
            values = _matrix(f["sketch"])
            rep = f["rep"].to_numpy(np.int64)
            for r in range(runs):  # a run's frame at a time
                at = np.arange(len(f))
                path = np.full(len(f), mix(np.array([seed * 1000 + r + 1], dtype=np.uint64))[0], dtype=np.uint64)
                for _ in range(levels):
                    row, path = _children(path, values[at], threshold)
                    at = at[row]
                yield pd.DataFrame({"node": path.view(np.int64), "rep": rep[at], "above": 0}).drop_duplicates()

    return run


def _next_level(threshold: float):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in batches:
            row, path = _children(f["node"].to_numpy(np.int64).view(np.uint64), _matrix(f["sketch"]), threshold)
            yield pd.DataFrame({"node": path.view(np.int64), "rep": f["rep"].to_numpy(np.int64)[row], "above": f["size"].to_numpy(np.int64)[row]}).drop_duplicates()

    return run


def _small(values: np.ndarray) -> bytes:
    return bytes(((values[0::2] & 15) | ((values[1::2] & 15) << 4)).astype(np.uint8))


def _leaf_links(least: float):
    """Whole units (node, bi, bj) -> links of a forest that joins members whose 4-bit sketches agree enough."""
    need = math.ceil(T * (least + (1 - least) / 16))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(batches, ["node", "bi", "bj"]):
            packed = np.frombuffer(b"".join(f["small"]), dtype=np.uint8).reshape(len(f), T // 2)
            bits = np.concatenate((packed & 15, packed >> 4), axis=1)
            rep = f["rep"].to_numpy(np.int64)
            a, b = [], []
            for i, j in group_bounds(f, ["node", "bi", "bj"]):
                m, ids = bits[i:j], rep[i:j]
                left = np.arange(1, len(ids))
                queue, done = [0], 0
                while len(left):
                    if done == len(queue):
                        queue.append(int(left[0]))
                        left = left[1:]
                        continue
                    k = queue[done]
                    done += 1
                    near = (m[left] == m[k]).sum(axis=1) >= need
                    hit = left[near]
                    if len(hit):
                        a.append(ids[hit])
                        b.append(np.full(len(hit), ids[k]))
                        queue += hit.tolist()
                        left = left[~near]
            if a:
                yield pd.DataFrame({"a": np.concatenate(a), "b": np.concatenate(b)}).drop_duplicates()

    return run


def _sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shingle set of each named set's text; a batch's repeated rows count once."""
    for f in batches:
        f = f.drop_duplicates(["rep", "text"])
        sets = [shingle_set(normalise(t)).tobytes() for t in f["text"]]
        same = [xxhash.xxh3_128_digest(s) == p for s, p in zip(sets, f["fp"], strict=True)]
        yield f.assign(shingles=sets)[same][["comp", "rep", "first", "copies", "members", "shingles"]]


def _exact(threshold: float):
    """Whole units (comp, bi, bj) of shingle sets -> for each member its links met here (in documents) and a root of a link forest."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in whole_groups(batches, ["comp", "bi", "bj"]):
            for i, j in group_bounds(f, ["comp", "bi", "bj"]):
                yield _unit(f.iloc[i:j])

    def _unit(g: pd.DataFrame) -> pd.DataFrame:
        g = g.drop_duplicates("rep")  # rows of one document that came in several batches
        rep, copies, blk = g["rep"].to_numpy(np.int64), g["copies"].to_numpy(np.int64), g["blk"].to_numpy()
        cross = int(g["bi"].iloc[0]) != int(g["bj"].iloc[0])
        flat = np.frombuffer(b"".join(g["shingles"]), dtype=np.uint64)
        sizes = np.array([len(s) // 8 for s in g["shingles"]])
        begin = np.concatenate(([0], np.cumsum(sizes)))
        vocabulary, ids = np.unique(flat, return_inverse=True)
        mark = np.zeros(len(vocabulary), dtype=np.int32)
        links = np.zeros(len(g), dtype=np.int64)
        root = np.arange(len(g))

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for k in range(len(g) - 1):
            own = ids[begin[k] : begin[k + 1]]
            mark[own] = 1
            both = np.add.reduceat(mark[ids[begin[k + 1] :]], begin[k + 1 : -1] - begin[k + 1])
            mark[own] = 0
            near = both >= threshold * (sizes[k] + sizes[k + 1 :] - both) - 1e-9
            if cross:
                near &= blk[k + 1 :] != blk[k]
            hit = np.flatnonzero(near) + k + 1
            if len(hit):
                links[k] += copies[hit].sum()
                links[hit] += copies[k]
                r = find(k)
                for h in hit.tolist():
                    o = find(h)
                    if o != r:
                        low, high = (r, o) if rep[r] < rep[o] else (o, r)
                        root[high] = low
                        r = low
        at, first = [find(k) for k in range(len(g))], g["first"].to_numpy(np.int64)
        return pd.DataFrame({"rep": rep, "first": first, "links": links, "root": rep[at], "root_first": first[at]})

    return run


def jaccard_classes(docs: DataFrame, threshold: float = 0.8, recall: float = 0.99, levels: int = 3, depth: int = 6, leaf: int = 64, dense: float = 0.7, block: int = 2048, seed: int = 1) -> DataFrame:
    """doc_id, class_id, n_links, n_copies of every document with an id: its class of near duplicates on 5-word shingles.

    Two documents are linked if the Jaccard similarity of their shingle sets is at least `threshold`; classes are the
    components of links and are named by their least doc_id; n_links counts linked documents, copies included; n_copies
    counts documents with the very same set (itself included). Words are those of `wordhash`; a text of one to four
    words is one shingle; null texts and texts without words have no set, are linked to nothing and are their own
    class. Rows with one doc_id and one set are one document; one doc_id with different texts gives a row for each.
    Rows with a null doc_id are left out. Empty tables give no rows; extra columns are ignored.

    Documents with equal sets are one set with a count, whatever their number. The first `levels` of the trees need no
    exchange and are always split; nodes of more than `leaf` sets split on to `depth`, but not if they kept `dense` of
    their parent's sets, which a sampled token can't tell apart. What is still large then is dealt in pairs of blocks, as is a large component, so a task holds at
    most two blocks of `block` sets (of verified sets: of 2,048 shingles each on average, fewer if they are longer). A pair is a candidate if its 4-bit sketches put it above threshold - 0.14 (four
    standard deviations); pairs are met with probability `recall` at the threshold at least, more above it and in
    shallower leaves, and all pairs of a component are verified on whole sets.
    """
    need = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")
    features = cut(need.mapInPandas(_features, "doc_id long, fp binary, n int, sketch binary"))
    units = features.select("doc_id", "fp", "n").distinct()
    filled = units.where("n > 0").groupBy("fp", "n").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("copies"))
    filled = cut(filled.withColumn("rep", F.monotonically_increasing_id()))  # the name of a set
    sets = cut(
        features.select(F.col("doc_id").alias("first"), "fp", "sketch").join(filled.select("first", "fp", "rep"), ["first", "fp"]).dropDuplicates(["rep"]).select("rep", "sketch")
    )

    runs = runs_needed(recall, depth)
    nodes = sets.select("rep", "sketch").mapInPandas(_first_levels(runs, levels, threshold, seed), NODE)
    leaves: list[DataFrame] = []
    for level in range(levels, depth + 1):
        counted = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        held = cut(join_salted(nodes, cut(counted.withColumn("n", F.col("size"))), ["node"]))
        if level == depth:
            leaves.append(held)
            break
        ends = (F.col("size") <= leaf) | (F.col("size") >= dense * F.col("above")) & (F.col("above") > 0)
        leaves.append(held.where(ends))
        wide = held.where(~ends).select("node", "rep", "size")
        if wide.isEmpty():
            break
        nodes = wide.join(sets.select("rep", "sketch"), "rep").select("node", "rep", "size", "sketch").mapInPandas(_next_level(threshold), NODE)
    met = leaves[0]
    for more in leaves[1:]:
        met = met.unionByName(more)

    @F.pandas_udf("binary")
    def small(s: pd.Series) -> pd.Series:
        return s.map(lambda b: _small(np.frombuffer(b, dtype=np.uint32)))

    tiny = sets.select("rep", small("sketch").alias("small"))
    dealt = in_block_pairs(met.join(tiny, "rep"), "node", "rep", "size", block)
    links = (
        dealt.select("node", "bi", "bj", "rep", "small").repartition("node", "bi", "bj").sortWithinPartitions("node", "bi", "bj", "rep")
        .mapInPandas(_leaf_links(threshold - 0.14), "a long, b long")
    )
    comps = connected_components(links).withColumnRenamed("node", "rep")
    known = cut(comps.join(filled, "rep"))
    # what a component counts for in dealing: its sets, or as many as have its shingles at 2,048 each
    sizes = cut(known.groupBy("comp").agg(F.count(F.lit(1)).alias("of"), F.sum("n").alias("shingles")).select("comp", F.col("of").alias("n"), F.greatest("of", F.ceil(F.col("shingles") / 2048)).cast("long").alias("members")))
    members = cut(join_salted(known.select(F.col("first").alias("doc_id"), "rep", "fp", "copies", "comp"), sizes, ["comp"]))

    texts = join_checked(need, members, ["doc_id"]).select("comp", "rep", F.col("doc_id").alias("first"), "fp", "copies", "members", "text").mapInPandas(_sets, "comp long, rep long, first long, copies long, members long, shingles binary")
    checked = cut(
        in_block_pairs(texts, "comp", "rep", "members", block).repartition("comp", "bi", "bj").sortWithinPartitions("comp", "bi", "bj", "rep")
        .drop("members").mapInPandas(_exact(threshold), "rep long, first long, links long, root long, root_first long")
    )
    near = checked.groupBy("rep").agg(F.sum("links").alias("links"))
    named = lambda first, rep: F.struct(F.col(first).alias("first"), F.col(rep).alias("rep"))
    classes = connected_components(checked.select(named("first", "rep").alias("a"), named("root_first", "root").alias("b")))
    known = filled.join(near, "rep", "left").join(classes.select(F.col("node.rep").alias("rep"), F.col("comp.first").alias("class_id")), "rep", "left").select(
        "fp", "copies", F.coalesce("class_id", "first").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links")
    )
    return units.join(known, "fp", "left").select(
        "doc_id",
        F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(F.col("n") == 0, F.lit(0)).otherwise(F.col("links") + F.col("copies") - 1).cast("long").alias("n_links"),
        F.when(F.col("n") == 0, F.lit(1)).otherwise(F.col("copies")).cast("long").alias("n_copies"),
    )


def keep_one_of_each(docs: DataFrame, **how) -> DataFrame:
    """The documents without all but the least doc_id of each class; rows without a doc_id stay."""
    gone = cut(jaccard_classes(docs, **how).where("class_id <> doc_id").select("doc_id").distinct())
    return join_checked(docs, gone, ["doc_id"], "left_anti").select(*docs.columns)

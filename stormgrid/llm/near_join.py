"""Jaccard join on word n-grams: MinHash prefixes of a fixed length for candidates, exact verification in blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_SEP, NULL_ID, bloom, bloom_has, components, join_hot, maybe_in, mixed, powers, slices, window_hashes, word_hashes, written

#: Words of a shingle, least similarity, trees of the forest, hashes of a full path, recall to reach at the threshold, documents of a block.
SHINGLE, THRESHOLD, TREES, DEEPEST, RECALL, BLOCK = 5, 0.8, 40, 16, 0.999, 256


def depth_for(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL, deepest: int = DEEPEST) -> int:
    """How long a common prefix must be: from the full path, shortened until two documents at the threshold meet in some tree with the wanted probability."""
    for depth in range(deepest, 0, -1):
        if 1 - (1 - threshold**depth) ** trees >= recall:
            return depth
    return 1


def shingles(texts: pa.Array, n: int = SHINGLE) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, sorted. Words are lower-cased runs of letters and digits; fewer than n words make one shingle, none make none."""
    h, first = word_hashes(texts, ALNUM_SEP, True)
    w = window_hashes(h, n)
    out = []
    for a, b in zip(first[:-1], first[1:], strict=True):
        if b - a >= n:
            out.append(np.unique(w[a : b - n + 1]))
        else:
            out.append(mixed(np.array([int((h[a:b] * powers(n)[: b - a]).sum()) ^ int(b - a)], np.uint64)) if b > a else np.zeros(0, np.uint64))
    return out


def forest_nodes(own: np.ndarray, trees: int, depth: int, seeds: np.ndarray) -> np.ndarray:
    """For each tree the node at that depth on the document's path: a hash of the first `depth` min-hashes of the tree."""
    low = np.empty(trees * depth, np.uint64)
    for at in range(0, len(low), 32):  # few hash functions at once bound the memory of very long texts
        s = seeds[at : at + 32]
        low[at : at + 32] = (((own[:, None] ^ s[0:, 0]) * s[:, 1]) >> np.uint64(20)).min(0) if len(own) <= 4096 else np.minimum.reduce([(((own[k : k + 4096, None] ^ s[:, 0]) * s[:, 1]) >> np.uint64(20)).min(0) for k in range(0, len(own), 4096)])
    return mixed((low.reshape(trees, depth) * powers(depth + 1)[1:]).sum(1) + np.arange(trees, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _seeds(n: int) -> np.ndarray:
    s = np.random.default_rng(6).integers(1, 1 << 63, (n, 2), dtype=np.uint64)
    s[:, 1] |= np.uint64(1)
    return s


def _paths(rows: DataFrame, trees: int, depth: int, n: int, skip=None) -> DataFrame:
    """id, node of each tree, of each row with words. Rows that the filter `skip` passes are left out."""
    seeds = _seeds(trees * depth)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = batches if skip is None else (b.filter(pa.array(~bloom_has(skip.value, b.column("id").to_numpy()))) for b in batches)
        for s in slices(kept):
            own = shingles(s.column("text"), n)
            full = [k for k, x in enumerate(own) if len(x)]
            nodes = np.array([forest_nodes(own[k], trees, depth, seeds) for k in full], np.uint64).reshape(-1)
            yield pa.record_batch([pa.array(np.repeat(s.column("id").to_numpy()[full], trees)), pa.array(nodes.view(np.int64))], ["id", "node"])

    return rows.mapInArrow(run, "id long, node long")


def _linked(left: list[np.ndarray], right: list[np.ndarray], threshold: float, same: bool) -> np.ndarray:
    """Which pairs reach the threshold: a left x right matrix, from counts of common shingles."""
    if not left or not right:  # a block that the hash left empty
        return np.zeros((len(left), len(right)), bool)
    size_l, size_r = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    value, number = np.unique(np.concatenate(right), return_inverse=True)
    of = np.repeat(np.arange(len(right)), size_r)
    order = np.argsort(number, kind="stable")
    post, begin = of[order], np.concatenate(([0], np.cumsum(np.bincount(number, minlength=len(value)))))
    out = np.zeros((len(left), len(right)), bool)
    for i, x in enumerate(left):
        at = np.searchsorted(value, x)
        at = at[(at < len(value)) & (value[np.minimum(at, len(value) - 1)] == x)] if len(value) else at[:0]
        n = begin[at + 1] - begin[at]
        if not n.sum():
            continue
        places = np.repeat(begin[at] - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum())
        both = np.bincount(post[places], minlength=len(right))
        out[i] = both >= threshold * (size_l[i] + size_r - both) - 1e-9
        if same:
            out[i, i] = False
    return out


def _verified(rows: DataFrame, threshold: float) -> DataFrame:
    """(id, links, low): of each document in each pair of blocks, how many it is linked to there and the smallest document that these links join it to, over any number of steps.

    rows: id, shingles (bytes), a pair of blocks (comp, p, q), block. All pairs
    of two blocks are compared in one task; blocks hold at most a few hundred
    documents, and only counts and one edge per document leave it.
    """

    def run(g: pd.DataFrame) -> pd.DataFrame:
        p, q = g["p"].iloc[0], g["q"].iloc[0]
        a, b = g[g["block"] == p].sort_values("id"), g[g["block"] == q].sort_values("id")
        x, y = ([np.frombuffer(v, np.uint64) for v in part["shingles"]] for part in (a, b))
        ids_a, ids_b = a["id"].to_numpy(), b["id"].to_numpy()
        hit = _linked(x, y, threshold, p == q)
        low_a, low_b = _lowest(hit, ids_a, ids_b)
        out = [_summed(hit, ids_a, low_a)]
        if p != q:
            out.append(_summed(hit.T, ids_b, low_b))
        return pd.concat(out)

    return rows.groupBy("comp", "p", "q").applyInPandas(run, "id long, links long, low long")


def _lowest(hit: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each row's and each column's component, if the rows and columns of every hit are joined. A row and a column of one id are one document."""
    low_l, low_r = left.copy(), right.copy()
    while True:
        new_l = np.minimum(low_l, np.where(hit, low_r, NULL_ID).min(1, initial=NULL_ID))
        new_r = np.minimum(low_r, np.where(hit, new_l[:, None], NULL_ID).min(0, initial=NULL_ID))
        if (new_l == low_l).all() and (new_r == low_r).all():
            return low_l, low_r
        low_l, low_r = new_l, new_r


def _summed(hit: np.ndarray, own: np.ndarray, low: np.ndarray) -> pd.DataFrame:
    n = hit.sum(1)
    got = n > 0
    return pd.DataFrame({"id": own[got], "links": n[got], "low": low[got]})


def near_links(docs: DataFrame, key: str = "doc_id", text: str = "text", threshold: float = THRESHOLD, n: int = SHINGLE, trees: int = TREES, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, class_id, copy_of, n_copies, n_links.

    - copy_of: the smallest doc_id with the same text, n_copies the documents with it;
    - n_links: how many different other texts have a Jaccard similarity of at
      least `threshold` with this one, on sets of n-word shingles;
    - class_id: the smallest doc_id of all documents joined to this one by links and copies.

    Copies are reduced to one representative first. Representatives meet where
    their paths in a tree share a prefix of one fixed length, the longest that by
    the formula of depth_for reaches the recall at the threshold: this is banded
    MinHash, and no prefix is shortened by what it matches. Candidate
    components are cut into blocks, and each pair of blocks is verified exactly
    in a task of its own: a group of near copies is neither collected in one
    task nor written as pairs. A component of m texts costs m / block copies of
    its shingles.

    Null ids count as the largest id; null and empty texts, and texts without a
    word, have no links and are copies of one another if equal; repeated rows
    are copies; other columns are ignored.
    """
    depth = depth_for(threshold, trees, recall)
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    keyed = written(rows.select("id", F.unhex(F.md5("text")).alias("digest")), "digests")
    classes = written(keyed.groupBy("digest").agg(F.min("id").alias("rep"), F.count("*").alias("n_copies")), "copies")
    members = written(join_hot(keyed, classes, "digest", "n_copies").select("id", "rep", "n_copies"), "members")

    copies = members.where("id <> rep").select("id").distinct()
    others = bloom(copies, "id", 1 << 25)
    unsure = maybe_in(rows, "id", others).join(copies, "id", "left_anti")  # not copies, though the filter passes them
    nodes = written(_paths(rows, trees, depth, n, others).unionByName(_paths(unsure, trees, depth, n)), "nodes")
    tops = nodes.groupBy("node").agg(F.min("id").alias("top"), F.max("id").alias("last")).where("top < last").select("node", "top")
    edges = nodes.join(tops, "node").where("id <> top").select(F.col("id").alias("a"), F.col("top").alias("b"))
    comp = written(components(edges).withColumnRenamed("component", "comp"), "candidates")

    size = comp.groupBy("comp").agg(F.count("*").alias("m"))
    placed = comp.join(size, "comp").select("id", "comp", F.ceil(F.col("m") / block).cast("int").alias("blocks"), F.pmod(F.xxhash64("id"), F.ceil(F.col("m") / block)).cast("int").alias("block"))
    wanted = bloom(comp, "id", 1 << 25)
    held = _shingled(rows, wanted, n).join(placed, "id").dropDuplicates(["id"])
    pairs = held.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select("id", "shingles", "comp", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    found = written(_verified(pairs, threshold), "links")

    links = found.groupBy("id").agg(F.sum("links").alias("n_links"))
    joined = components(found.select(F.col("id").alias("a"), F.col("low").alias("b")))
    by = members.join(links, members["rep"] == links["id"], "left").drop(links["id"]).join(joined.withColumnRenamed("id", "rep"), "rep", "left")
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    by = by.select("id", "rep", "n_copies", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "rep").alias("class"))
    return by.select(back("id").alias("doc_id"), back("class").alias("class_id"), back("rep").alias("copy_of"), "n_copies", "n_links")


def _shingled(rows: DataFrame, wanted, n: int) -> DataFrame:
    """id and sorted shingle hashes, as bytes, of rows that the filter passes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            b = b.filter(pa.array(bloom_has(wanted.value, b.column("id").to_numpy())))
            for s in slices([b]):
                yield pa.record_batch([s.column("id"), pa.array([x.tobytes() for x in shingles(s.column("text"), n)], pa.binary())], ["id", "shingles"])

    return rows.mapInArrow(run, "id long, shingles binary")


def one_per_class(docs: DataFrame, **options) -> DataFrame:
    """Of each class of near copies, the row with the smallest id (of repeated rows with that id, one), with its columns; other rows stay as they are.

    Texts are not shuffled for rows that a Bloom filter finds outside all classes.
    """
    got = written(near_links(docs.select("doc_id", "text"), **options), "classes")
    gone = got.where("doc_id <> class_id").select("doc_id").distinct()
    again = got.where("n_copies > 1 and doc_id = copy_of").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    asked = bloom(gone.unionByName(again), "doc_id", 1 << 25)
    some = maybe_in(docs, "doc_id", asked).join(gone, "doc_id", "left_anti").select(*docs.columns)
    once = some.join(again, "doc_id", "left_anti").unionByName(some.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]))
    return maybe_in(docs, "doc_id", asked, negate=True).unionByName(once.select(*docs.columns))

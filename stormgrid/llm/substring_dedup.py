"""Removal of word passages that an earlier document has: difference-cover anchors, then extension to full windows."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NULL_ID, SPACE_SEP, bloom, buffers, join_hot, maybe_in, slices, span_hashes, window_hashes, word_hashes, word_spans, written

#: Words of a window.
WINDOW = 50
#: A perfect difference set: every number is a difference of two of these modulo the period.
PERIOD, COVER = 31, (0, 1, 3, 8, 12, 18)
#: Any two equal windows share an anchor of so many words that begins at cover positions in both.
ANCHOR = WINDOW - PERIOD + 1


def _anchors(rows: DataFrame, window: int, anchor: int) -> DataFrame:
    """id, place, hash of the anchors at cover positions, of texts with a window at least."""
    cover = np.isin(np.arange(PERIOD), COVER)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            h, first = word_hashes(s.column("text"), SPACE_SEP, False)
            w = window_hashes(h, anchor)
            size = np.diff(first)
            doc = np.repeat(np.arange(len(size)), size)[: len(w)]
            place = np.arange(len(w)) - first[doc]
            at = np.flatnonzero(cover[place % PERIOD] & (place + anchor <= size[doc]) & (size[doc] >= window))
            yield pa.record_batch([pa.array(s.column("id").to_numpy()[doc[at]]), pa.array(place[at].astype(np.int32)), pa.array(w[at].view(np.int64))], ["id", "place", "hash"])

    return rows.mapInArrow(run, "id long, place int, hash long")


def _near_anchors(n: int, places: list[int]) -> np.ndarray:
    """Which of n windows hold one of the anchors."""
    mark = np.zeros(n + 1, np.int64)
    p = np.array(places, np.int64)
    np.add.at(mark, np.minimum(np.maximum(p - PERIOD + 1, 0), n), 1)
    np.add.at(mark, np.minimum(p + 1, n), -1)
    return np.flatnonzero(np.cumsum(mark[:-1]))


def _windows(rows: DataFrame, window: int) -> DataFrame:
    """id, hash of the windows that hold one of the row's shared anchors (column `places`)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            h, first = word_hashes(s.column("text"), SPACE_SEP, False)
            w = window_hashes(h, window)
            ids, out = s.column("id").to_numpy(), []
            for k, shared in enumerate(s.column("places").to_pylist()):
                n = int(first[k + 1] - first[k]) - window + 1
                if n > 0:
                    found = np.unique(w[first[k] + _near_anchors(n, shared)])
                    out.append((ids[k], len(found), found))
            if out:
                yield pa.record_batch([pa.array(np.repeat([x[0] for x in out], [x[1] for x in out]).astype(np.int64)), pa.array(np.concatenate([x[2] for x in out]).view(np.int64))], ["id", "hash"])

    return rows.mapInArrow(run, "id long, hash long")


def _digests(rows: DataFrame, window: int) -> DataFrame:
    """doc_id, n_words, n_removed, kept text, from id, text, hashes of the windows that go (null: none) and whether all goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            raw, at = buffers(s.column("text"))
            starts, stops, first = word_spans(raw, at, SPACE_SEP)
            data = raw.tobytes()
            flagged = s.column("hashes").to_pylist()
            w = window_hashes(span_hashes(raw, starts, stops), window) if any(flagged) else None
            n_, gone_, sha_ = [], [], []
            for k, (hashes, whole) in enumerate(zip(flagged, s.column("whole").to_pylist(), strict=True)):
                n = int(first[k + 1] - first[k])
                keep = None
                if whole and n >= window:
                    keep = np.zeros(0, np.int64)
                elif hashes and n >= window:
                    mark = np.zeros(n + 1, np.int64)
                    p = np.flatnonzero(np.isin(w[first[k] : first[k] + n - window + 1], np.array(hashes, np.int64).view(np.uint64)))
                    np.add.at(mark, p, 1)
                    np.add.at(mark, p + window, -1)
                    keep = np.flatnonzero(np.cumsum(mark[:-1]) == 0) + first[k]
                text = b" ".join(data[at[k] : at[k + 1]].split()) if keep is None else b" ".join(data[a:b] for a, b in zip(starts[keep].tolist(), stops[keep].tolist(), strict=True))
                n_.append(n)
                gone_.append(0 if keep is None else n - len(keep))
                sha_.append(hashlib.sha256(text).hexdigest())
            yield pa.record_batch([s.column("id"), pa.array(n_, pa.int64()), pa.array(gone_, pa.int64()), pa.array(sha_)], ["id", "n_words", "n_removed", "kept_sha256"])

    return rows.mapInArrow(run, "id long, n_words long, n_removed long, kept_sha256 string").select(F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def substring_dedup(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document.

    A word goes if some window of `window` words that covers it also starts in a
    document with a smaller id; windows are those of the input. Anchors of
    window - 30 words are hashed only at positions whose remainder modulo 31 is
    in a difference cover: whatever their positions, two equal windows have an
    anchor in common. Anchors that two documents share lead to the windows
    around them, whose hashes settle who has a window first. Hashes have 64 bits.

    A document whose whole text a smaller id has too needs no windows: all its
    words go. A passage that very many documents share has its hash broadcast, so
    that its places stay spread over the tasks (join_hot).

    Null ids count as the largest id; null and empty texts have no words; rows
    that share an id, repeated or with different texts, do not remove one
    another's words; other columns are ignored.
    """
    if window < PERIOD:
        raise ValueError(f"a window needs {PERIOD} words at least")
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    anchors = written(_anchors(rows, window, window - PERIOD + 1), "anchors")
    low_high = (F.min("id").alias("low"), F.max("id").alias("high"), F.count("*").alias("n"))
    shared = written(anchors.groupBy("hash").agg(*low_high).where("low < high").select("hash", "n"), "shared")
    places = join_hot(anchors, shared, "hash", "n").groupBy("id").agg(F.collect_set("place").alias("places"))

    keyed = written(rows.where(F.length("text") > 0).select("id", F.unhex(F.md5("text")).alias("digest")), "digests")
    firsts = written(keyed.groupBy("digest").agg(*low_high).where("low < high"), "copies")
    whole = written(join_hot(keyed, firsts, "digest", "n").where("id > low").select("id", "digest").distinct(), "whole")
    several = keyed.groupBy("id").agg(F.min("digest").alias("a"), F.max("digest").alias("b")).where("a < b").select("id")
    done = whole.select("id").distinct().join(several, "id", "left_anti")  # no windows are needed of these

    places = written(places.join(done, "id", "left_anti"), "places")
    some = bloom(places, "id", 1 << 25)
    windows = written(_windows(maybe_in(rows, "id", some).join(places, "id"), window), "windows")
    first = written(windows.groupBy("hash").agg(*low_high).where("low < high").select("hash", "low", "n"), "firsts")
    flagged = join_hot(windows, first, "hash", "n").where("id > low").groupBy("id").agg(F.collect_set("hash").alias("hashes"))
    flagged = written(flagged, "flagged")

    touched = bloom(flagged.select("id").unionByName(whole.select("id")), "id", 1 << 25)
    digest = F.unhex(F.md5("text"))
    near = maybe_in(rows, "id", touched).withColumn("digest", digest)
    near = near.join(whole.withColumn("whole", F.lit(True)), ["id", "digest"], "left").join(flagged, "id", "left").select("id", "text", "hashes", F.coalesce("whole", F.lit(False)).alias("whole"))
    rest = maybe_in(rows, "id", touched, negate=True).select("id", "text", F.lit(None).cast("array<long>").alias("hashes"), F.lit(False).alias("whole"))
    return _digests(near, window).unionByName(_digests(rest, window))

"""Shared helpers: tables in the shared folder, word hashing on Arrow buffers, Bloom prefilters, components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at once inside a task; bounds a Python worker's memory.
SLICE_BYTES = 1 << 20

#: Row id given to rows whose id is null: they count as the last ones.
NULL_ID = (1 << 63) - 1


def documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    """The named table of a data folder. Arrow batches of the session get 2,000 rows at most, so that long texts do not fill Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """A name like this one that no column of df has, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def shared_dir(spark: SparkSession) -> str:
    """Folder that all executors see: spark.checkpoint.dir, or a temporary one where that is unset (tests on one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors see")
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="stormgrid-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def written(df: DataFrame, label: str, compression: str = "snappy") -> DataFrame:
    """df as a Parquet table in the shared folder, read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def join_hot(left: DataFrame, right: DataFrame, key: str, weight: str, most: int = 1000, total: int | None = None) -> DataFrame:
    """Inner join on `key`, where right has one row per key, and in `weight` the number of left's rows with it.

    Keys with over 1 / most of all weight, of which there are `most` at most, are
    broadcast: left's rows with such a key stay where they are, however many.
    The others are joined by shuffle. Both sides should be written tables. total:
    all weight, or a bound from below that is known already.
    """
    total = (right.agg(F.sum(weight)).first()[0] or 0) if total is None else total
    is_hot = F.col(weight) * F.lit(most) > F.lit(total)
    hot, other = F.broadcast(right.where(is_hot)), right.where(~is_hot)
    return left.join(hot, key).unionByName(left.join(hot.select(key), key, "left_anti").join(other, key))


# ---------------------------------------------------------------- words

#: Separators of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after A-Z were lower-cased: every other ASCII byte.
ALNUM_SEP = np.array([b < 128 and not (48 <= b <= 57 or 97 <= b <= 122) for b in range(256)])
#: Separators of `[^\x20\x09-\x0D]+`.
SPACE_SEP = np.array([b == 32 or 9 <= b <= 13 for b in range(256)])

_rng = np.random.default_rng(20240117)
_MIX = _rng.integers(1, 1 << 63, 256, dtype=np.uint64)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_FINAL = np.uint64(0xD6E8FEB86659FD93)


def powers(n: int, base: np.uint64 = _BASE) -> np.ndarray:
    """base^0 .. base^(n-1) modulo 2^64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mixed(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64-bit values."""
    h = (h ^ (h >> np.uint64(32))) * _FINAL
    return h ^ (h >> np.uint64(29))


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts behind one another, and where each begins. Null texts are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    at = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64) if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None and at[-1] > at[0] else np.zeros(0, np.uint8)
    return raw, at - at[0]


def word_spans(raw: np.ndarray, at: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and for each text the number of the first word (one more entry at the end)."""
    inside = ~sep[raw]
    before, after = np.zeros(len(raw), bool), np.zeros(len(raw), bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[at[:-1][at[:-1] < len(raw)]] = False
    ends = at[1:][at[1:] > 0] - 1
    after[ends] = False
    starts, stops = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, stops, np.searchsorted(starts, at)


def word_hashes(texts: pa.Array, sep: np.ndarray, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word of all texts, and for each text the number of its first word (one more entry at the end)."""
    raw, at = buffers(pc.utf8_lower(texts.fill_null("")) if lower else texts)
    starts, stops, first = word_spans(raw, at, sep)
    return span_hashes(raw, starts, stops), first


def span_hashes(raw: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    size = stops - starts
    begin = np.concatenate(([0], np.cumsum(size)[:-1]))
    place = np.arange(size.sum()) - np.repeat(begin, size)
    value = _MIX[raw[np.repeat(starts, size) + place]] * powers(int(size.max()))[place]
    return mixed(np.add.reduceat(value, begin) + size.astype(np.uint64))


def window_hashes(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of each n consecutive words, at each place where n words follow in the array."""
    if len(h) < n:
        return np.zeros(0, np.uint64)
    up = powers(len(h) + 1)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(h * up[:-1])))
    back = powers(len(h) + 1, np.uint64(pow(int(_BASE), -1, 1 << 64)))
    return mixed((total[n:] - total[:-n]) * back[: len(h) - n + 1])


def give_back() -> None:
    """Returns freed memory to the system. Spark keeps workers for later tasks, and what one keeps adds to what the others of its executor need."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc
    if trim:
        trim(0)


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with at most that many bytes of text, or single rows. Memory goes back after the last one."""
    yield from _slices(batches, text, most)
    give_back()


def _slices(batches: Iterator[pa.RecordBatch], text: str, most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(batch.schema.names.index(text))), 0).to_numpy(zero_copy_only=False).cumsum()
        at = 0
        while at < batch.num_rows:
            upto = int(np.searchsorted(size, (size[at - 1] if at else 0) + most, side="right"))
            yield batch.slice(at, max(upto, at + 1) - at)
            at = max(upto, at + 1)


# ---------------------------------------------------------------- Bloom prefilter

_PROBES = 3


def bloom_places(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """Bit places of 64-bit keys."""
    h = keys.astype(np.int64).view(np.uint64)
    return [(mixed(h * powers(_PROBES + 1)[k + 1]) & np.uint64(bits - 1)).astype(np.int64) for k in range(_PROBES)]


def bloom(df: DataFrame, key: str, bits: int = 1 << 24):
    """A broadcast Bloom filter of a long column, of a fixed size whatever the input: bits / 8 bytes.

    A prefilter only: it passes every key of df and some others, and the join that
    follows decides. The tasks OR 64-bit words, so the driver gets bits / 64 rows at most.
    """

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = np.unique(np.concatenate(bloom_places(b.column(0).to_numpy(zero_copy_only=False), bits)))
            word, one = got >> 6, np.left_shift(np.uint64(1), (got & 63).astype(np.uint64))
            at = np.flatnonzero(np.diff(word, prepend=-1))
            if len(at):
                yield pa.record_batch([pa.array(word[at]), pa.array(np.bitwise_or.reduceat(one, at).view(np.int64))], ["word", "mask"])

    rows = df.select(F.col(key).cast("long").alias("k")).where("k is not null").mapInArrow(words, "word long, mask long").groupBy("word").agg(F.bit_or("mask").alias("mask")).toArrow()
    out = np.zeros(bits // 64, np.int64)
    out[rows["word"].to_numpy()] = rows["mask"].to_numpy()
    return df.sparkSession.sparkContext.broadcast(out)


def bloom_has(filter_words: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Which keys may be in the filter."""
    hit = np.ones(len(keys), bool)
    for p in bloom_places(keys, len(filter_words) * 64):
        hit &= (filter_words[p >> 6] >> (p & 63)) & 1 == 1
    return hit


def maybe_in(df: DataFrame, key: str, filter_, negate: bool = False) -> DataFrame:
    """Rows of df whose key the filter passes (negate: does not pass), without a shuffle."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = df_names.index(key)
        for b in batches:
            hit = bloom_has(filter_.value, b.column(at).fill_null(NULL_ID).to_numpy())
            yield b.filter(pa.array(~hit if negate else hit))
        give_back()

    df_names = df.columns
    return df.mapInArrow(keep, df.schema)


# ---------------------------------------------------------------- components


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """Connected components of edges (a long, b long): one row (id, component) per node, the component being its smallest id.

    Alternating large-star and small-star steps over a deduplicated edge table;
    each round is written to the shared folder, and only a row count and a
    checksum come to the driver. Nodes without an edge do not appear.
    """
    now = written(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    seen, n = None, now.count()
    for _ in range(rounds):
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n")
        # large star: each larger neighbour is tied to the smallest neighbour; a star's middle has many
        large = join_hot(both.where("b > a"), low, "a", "n", total=2 * n).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: each smaller-or-equal neighbour is tied to the smallest one
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        now = written(small, "edges")
        state = now.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first()
        if tuple(state) == seen:
            break
        seen, n = tuple(state), state[0]
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.groupBy("a").agg(F.min("b").alias("component")).select(F.col("a").alias("id"), "component").unionByName(now.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())

"""Packing of documents into sequences: Martello-Toth reduction, then best fit, over the histogram of piece lengths."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import slices, written

#: Tokens of a sequence, the id behind each document, and hash parts within a length, for ranks.
CAPACITY, END_ID, PARTS = 1024, 2, 256
#: The vocabulary's added token and its id: fixed values of byte_bpe_50k.json.
ADDED, ADDED_ID = "<|endoftext|>", 50256

Pattern = tuple[tuple[int, ...], int]  # lengths in one sequence, and how many such sequences


def reduced(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Martello-Toth reduction in bulk. Takes out of `count` (pieces by length) the sets that dominate every other set with their largest piece.

    For each length, largest first, with r the room beside it:
    - nothing fits beside it: it stands alone;
    - the largest that fits is k. If k = r, or no two pieces fit together in r,
      then {length, k} dominates;
    - at most two fit in r: if any two that fit sum to k at most, {length, k}
      dominates; if k and the largest b beside k fit and the smaller one of any
      two that fit is at most b, {length, k, b} does.
    """
    out: list[Pattern] = []

    def largest(upto: int, used: dict[int, int]) -> int:
        """The largest length up to `upto` of which pieces are left beside those used; 0: none."""
        have = np.flatnonzero(count[1 : max(upto, 0) + 1]) + 1
        for k in have[::-1]:
            if count[k] > used.get(int(k), 0):
                return int(k)
        return 0

    def smallest(n: int, used: dict[int, int]) -> int:
        """The sum of the n smallest pieces left; more than the capacity if there are fewer."""
        total = 0
        for k in np.flatnonzero(count):
            take = min(n, int(count[k]) - used.get(int(k), 0))
            total, n = total + int(k) * max(take, 0), n - max(take, 0)
            if not n or total > capacity:
                break
        return total if not n else capacity + 1

    def widest_two(room: int, used: dict[int, int]) -> tuple[int, int]:
        """Of two pieces that fit in the room together: the largest sum, and the largest smaller one."""
        best, low = 0, 0
        for a in map(int, np.flatnonzero(count[1 : room // 2 + 1]) + 1):
            if count[a] > used.get(a, 0):
                b = largest(room - a, used | {a: used.get(a, 0) + 1})
                if b >= a:
                    best, low = max(best, a + b), a
        return best, low

    for length in range(capacity, 0, -1):
        while count[length]:
            room, one = capacity - length, {length: 1}
            k = largest(room, one)
            if not k:
                out.append(((length,), n := int(count[length])))
                count[length] -= n
                continue
            pair = k == room or smallest(2, one) > room
            if not pair and smallest(3, one) <= room:
                break
            best, low = (0, 0) if pair else widest_two(room, one)
            if pair or best <= k:
                n = 1 if not pair or count[k] <= 2 else int(count[length]) // 2 if k == length else int(min(count[length], count[k]))
                n = max(n, 1)
                out.append(((length, k), n))
                count[length] -= n
                count[k] -= n
                continue
            two = {length: 1}
            two[k] = two.get(k, 0) + 1
            b = largest(room - k, two)
            if not b or low > b:
                break
            out.append(((length, k, b), 1))
            for x in (length, k, b):
                count[x] -= 1
    return out


def best_fit(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Best fit, longest first, in bulk: a piece goes to the open sequence with the least room that holds it, else to a new one."""
    rooms: dict[int, list[Pattern]] = {}
    done: list[Pattern] = []

    def put(lengths: tuple[int, ...], n: int) -> None:
        room = capacity - sum(lengths)
        (rooms.setdefault(room, []) if room else done).append((lengths, n))

    for length in range(capacity, 0, -1):
        left = int(count[length])
        while left:
            room = min((r for r in rooms if r >= length), default=capacity)
            each = room // length
            have = rooms[room].pop() if room in rooms else ((), left)
            if room in rooms and not rooms[room]:
                del rooms[room]
            n = min(have[1], left // each)
            if n:
                put(have[0] + (length,) * each, n)
                left -= n * each
            rest = have[1] - n
            if left and rest and left < each:
                put(have[0] + (length,) * left, 1)
                left, rest = 0, rest - 1
            if rest and have[0]:
                put(have[0], rest)
    return done + [p for same in rooms.values() for p in same]


def patterns(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Sequences for a histogram of lengths: the reduction, then best fit of the rest."""
    count = count.astype(np.int64).copy()
    return reduced(count, capacity) + best_fit(count, capacity)


def lower_bound(count: np.ndarray, capacity: int) -> int:
    """No packing has fewer sequences: pieces over half the capacity, the total, and Martello and Toth's mixtures of both."""
    size = np.arange(len(count))
    best = -(-int((count * size).sum()) // capacity)
    for a in range(capacity // 2 + 1):
        big = int(count[capacity - a + 1 :].sum())
        half = count[capacity // 2 + 1 : capacity - a + 1]
        spare = len(half) and int(half.sum()) * capacity - int((half * size[capacity // 2 + 1 : capacity - a + 1]).sum())
        small = int((count[a : capacity // 2 + 1] * size[a : capacity // 2 + 1]).sum())
        best = max(best, big + int(half.sum()) + max(0, -(-(small - spare) // capacity)))
    return best


def _encoder(ranks_file: str, pattern: str):
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("bytes", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def encode(text: str) -> list[int]:
        """The added token's string stands for its id, as in the named tokenizer; the texts between are encoded one by one."""
        first, *others = text.split(ADDED)
        ids = plain(first)
        for other in others:
            ids.append(ADDED_ID)
            ids += plain(other)
        return ids

    return encode


def pieces(docs: DataFrame, encoder=None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, row: each document's ids cut into pieces.

    encoder: a function without arguments that makes text -> list of ids in a
    task. The default reads byte_bpe_50k's vocabulary as ranks and puts the id
    of the added token where its string stands in a text: a test compares its ids
    with those of byte_bpe_50k.json, which takes four times as long.
    A document up to the capacity is one piece; a longer one is cut so that only
    its first piece may be shorter. Null texts are empty: one piece, the end id.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if encoder is None:
            import public_tokenizers

            encode = _encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
        else:
            encode = encoder()
        for s in slices(batches):
            ids_, n_, start_, size_, crc_ = [], [], [], [], []
            for d, t in zip(s.column("doc_id").to_pylist(), s.column("text").to_pylist(), strict=True):
                ids = np.array([*(encode(t) if t else ()), END_ID], "<u4")
                at, stop = 0, len(ids) % capacity or min(capacity, len(ids))
                k = 0
                while at < len(ids):
                    ids_.append(d)
                    n_.append(k)
                    start_.append(at)
                    size_.append(stop - at)
                    crc_.append(zlib.crc32(ids[at:stop].tobytes()))
                    at, stop, k = stop, stop + capacity, k + 1
            yield pa.record_batch([pa.array(ids_, pa.int64()), pa.array(n_, pa.int32()), *(pa.array(x, pa.int64()) for x in (start_, size_, crc_))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, encoder=None, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, parts: int = PARTS) -> DataFrame:
    """Every piece of every document with its sequence and place: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    Pieces of one length are alike to a packing, so it needs their number only:
    the driver gets at most `capacity` counts, makes sequence patterns of the
    whole corpus from them, and a piece finds its sequence by its rank among the
    pieces of its length. Ranks are counted within hash parts of a length and
    offset by a table of at most capacity x parts rows; no task holds a length's
    pieces whole.

    Full pieces fill sequences alone. Null and empty texts are the end id alone;
    repeated rows are packed one by one; other columns are ignored; an empty
    table gives no rows.
    """
    rows = written(pieces(docs, encoder, key, text, capacity).withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(parts)).cast("int")), "pieces")
    counted = written(rows.groupBy("length", "part").agg(F.count("*").alias("n")), "lengths")
    count = np.zeros(capacity + 1, np.int64)
    for r in counted.groupBy("length").agg(F.sum("n").alias("n")).collect():
        count[r["length"]] = r["n"]
    before = counted.select("length", "part", (F.sum("n").over(Window.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    rank = F.row_number().over(Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = rows.withColumn("at", rank.cast("long")).join(F.broadcast(before), ["length", "part"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("at") - 1).alias("rank"))

    # for each length: ranks from `low` on are in sequences from `first` on, at `offset`
    used, at, table = np.zeros(capacity + 1, np.int64), 0, []
    for lengths, n in patterns(count, capacity):
        offset = 0
        for x in lengths:
            table.append((x, int(used[x]), at, offset))
            used[x] += n
            offset += x
        at += n
    table.sort()
    length, low, first, offset = (np.array(c, np.int64) for c in (zip(*table, strict=True) if table else ([], [], [], [])))
    step = np.int64(1) << 48

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = length * step + low
        for b in batches:
            rank_ = b.column("rank").to_numpy()
            k = np.searchsorted(keys, b.column("length").to_numpy() * step + rank_, side="right") - 1
            yield pa.record_batch([*(b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first[k] + rank_ - low[k]), pa.array(offset[k])], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")

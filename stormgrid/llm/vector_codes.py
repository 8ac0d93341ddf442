"""Vector codes: one codebook for each part of the vectors, trained by Elkan's Lloyd rounds on whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_hot, written

#: Parts of a vector, entries of a part's codebook (256 at most: a byte each), rounds of training, and what components are multiplied by.
PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole numbers beyond this count as this, so that squared distances of vectors of up to 4,096 components fit a long.
LARGEST = 1 << 24
#: Lower bounds are kept in so many steps of a row's largest one, rounded down.
LEVELS = 31
#: Whole numbers that one block of distances takes.
BLOCK = 1 << 21
#: Share by which bounds are widened for the rounding of doubles.
SLACK = 1e-12

STATE = "vec_id long, label long, x array<int>, code binary, upper binary, lower binary, step double"
DONE = "vec_id long, label long, code binary, error long"


def _up(v: np.ndarray) -> np.ndarray:
    return v * (1 + SLACK)


def _down(v: np.ndarray) -> np.ndarray:
    return v * (1 - SLACK)


def squares(x: np.ndarray, entries: np.ndarray) -> np.ndarray:
    """Squared distances of rows from their entries, exactly: the last axis is summed."""
    d = x - entries
    return (d * d).sum(-1)


def first_assignment(x: np.ndarray, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of one part's rows (n, d): the nearest entry, the lower of equals; its squared distance; an upper bound of its distance; a lower bound for every entry."""
    all_ = squares(x[:, None], entries[None])
    code = all_.argmin(1)
    own = all_[np.arange(len(x)), code]
    return code, own, _up(np.sqrt(own)), _down(np.sqrt(all_))


def next_assignment(x: np.ndarray, entries: np.ndarray, moved: np.ndarray, code: np.ndarray, upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The same after the entries have moved, from the last code and bounds, and how many distances to other entries were worked out.

    Bounds are shifted by the movement. An entry is passed over only if its lower
    bound, or half its distance from the row's entry, is strictly above the upper
    bound: equal ones stay, and whole-number distances decide them.
    """
    rows = np.arange(len(x))
    upper = _up(upper + moved[code])
    lower = np.maximum(_down(lower) - _up(moved), 0.0)
    half = _down(np.sqrt(squares(entries[:, None], entries[None]))) / 2
    left = (lower <= upper[:, None]) & (half[code] <= upper[:, None])
    own = squares(x, entries[code])  # makes the upper bound tight
    upper = _up(np.sqrt(own))
    left &= (lower <= upper[:, None]) & (half[code] <= upper[:, None])
    left[rows, code] = False
    i, k = np.nonzero(left)
    known = np.full(left.shape, np.iinfo(np.int64).max)
    known[rows, code] = own
    known[i, k] = squares(x[i], entries[k])
    lower[i, k] = _down(np.sqrt(known[i, k]))
    lower[rows, code] = _down(np.sqrt(own))
    code = known.argmin(1)
    own = known[rows, code]
    return code, own, _up(np.sqrt(own)), lower, len(i)


def _packed(lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower bounds (n, parts, entries) as bytes, and each row's step."""
    step = np.maximum(lower.reshape(len(lower), -1).max(1, initial=0.0) / LEVELS, 1e-9)
    return np.minimum(np.floor(_down(lower / step[:, None, None])), LEVELS).astype(np.uint8), step


def _assigned(rows: DataFrame, books: np.ndarray, moved: np.ndarray | None, last: bool) -> DataFrame:
    """rows with their codes and bounds, or codes and errors at last. books: (parts, entries, d); moved: (parts, entries), None for the first time."""
    parts, entries, d = books.shape
    most = max(1, BLOCK // (entries * d))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, most):
                b = whole.slice(at, most)
                n = b.num_rows
                x = b.column("x").flatten().to_numpy().astype(np.int64).reshape(n, parts, d)
                code, error = np.empty((n, parts), np.uint8), np.zeros(n, np.int64)
                upper, lower = np.empty((n, parts)), np.empty((n, parts, entries))
                if moved is not None:
                    old = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(n, parts)
                    up = np.frombuffer(b"".join(b.column("upper").to_pylist()), np.float32).reshape(n, parts).astype(float)
                    low = np.frombuffer(b"".join(b.column("lower").to_pylist()), np.uint8).reshape(n, parts, entries) * b.column("step").to_numpy()[:, None, None]
                for p in range(parts):
                    if moved is None:
                        code[:, p], own, upper[:, p], lower[:, p] = first_assignment(x[:, p], books[p])
                    else:
                        code[:, p], own, upper[:, p], lower[:, p], _ = next_assignment(x[:, p], books[p], moved[p], old[:, p], up[:, p], _down(low[:, p]))
                    error += own
                held = [b.column("vec_id"), b.column("label")]
                codes = pa.array([r.tobytes() for r in code], pa.binary())
                if last:
                    yield pa.record_batch([*held, codes, pa.array(error)], ["vec_id", "label", "code", "error"])
                    continue
                bytes_, step = _packed(lower)
                highs = np.nextafter(upper.astype(np.float32), np.float32(np.inf))
                yield pa.record_batch([*held, b.column("x"), codes, pa.array([r.tobytes() for r in highs], pa.binary()), pa.array([r.tobytes() for r in bytes_], pa.binary()), pa.array(step)], ["vec_id", "label", "x", "code", "upper", "lower", "step"])

    return rows.mapInArrow(run, DONE if last else STATE)


def _means(state: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks with every entry at the floor of its parts' mean; entries without a part stay. A row per number of the codebooks leaves each task."""
    parts, entries, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((parts, entries, d + 1), np.int64)
        for b in batches:
            if b.num_rows:
                x = b.column("x").flatten().to_numpy().astype(np.int64).reshape(b.num_rows, parts, d)
                code = np.frombuffer(b"".join(b.column("code").to_pylist()), np.uint8).reshape(-1, parts)
                for p in range(parts):
                    np.add.at(total[p], code[:, p], np.concatenate((x[:, p], np.ones((b.num_rows, 1), np.int64)), 1))
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at), pa.array(total.ravel()[at])], ["at", "total"])

    got = state.select("x", "code").mapInArrow(run, "at long, total long").groupBy("at").agg(F.sum("total").alias("total")).toArrow()
    total = np.zeros(parts * entries * (d + 1), np.int64)
    total[got["at"].to_numpy()] = got["total"].to_numpy()
    total = total.reshape(parts, entries, d + 1)
    n = total[..., d:]
    return np.where(n > 0, total[..., :d] // np.maximum(n, 1), books)


def vector_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> DataFrame:
    """One row per kept vector: vec_id, code, error, label_error, codebooks_sha256.

    Components become floor(scale * x). Every part's codebook begins with that
    part of the vectors with the smallest ids; each round ties every part to its
    nearest entry, the lower of equals, and moves entries to the floor of their
    parts' mean. The first assignment works out all distances; it and each later
    one write, beside the codes, an upper bound per part and a lower bound per
    part and entry to the shared folder, and the next one reads these, shifted by
    how far the entries moved, to pass over entries that cannot be the nearest.

    - code: entries' numbers in the order of the parts, two hex digits each;
    - error: squared distances from the entries, summed over parts;
    - label_error: errors summed over rows with the same label, nulls together;
    - codebooks_sha256: of the last codebooks' numbers by part, entry and place.

    Vectors that are null or hold a null, NaN or infinite component go. Shorter
    vectors than the longest count as followed by zeros, as do all if the length is
    no multiple of `parts`; whole numbers beyond +-2^24 count as that. Null ids
    come last, equal ids in the order of their vectors; repeated rows each have
    their row, and their place among the first entries. Of fewer vectors than
    `entries`, each makes an entry; an empty table gives no rows. Other columns
    are ignored.
    """
    x = F.col("v")
    rows = df.select(F.col(key).cast("long").alias("vec_id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<double>").alias("v"))
    rows = rows.where(x.isNotNull() & ~F.exists(x, lambda c: F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(True))))
    known = rows.agg(F.max(F.size(x)), F.count("*")).first()
    size = max(1, -(-(known[0] or 0) // parts)) * parts
    whole = F.transform(x, lambda c: F.floor(F.greatest(F.least(c * scale, F.lit(float(LARGEST))), F.lit(-float(LARGEST)))).cast("int"))
    rows = rows.select("vec_id", "label", F.concat(whole, F.array_repeat(F.lit(0), F.lit(size) - F.size(x))).alias("x"))

    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "x").limit(min(entries, 256)).select("x").collect()
    books = np.array([r["x"] for r in first], np.int64).reshape(len(first), parts, size // parts).transpose(1, 0, 2) if first else np.zeros((parts, 1, size // parts), np.int64)
    state, moved = rows, None
    for _ in range(rounds):
        state = written(_assigned(state, books, moved, False), "bounds", compression="zstd")
        new = _means(state, books)
        moved, books = np.sqrt(squares(new, books)), new
    done = written(_assigned(state, books, moved, True), "codes")

    name = F.when(F.col("label").isNull(), "-").otherwise(F.col("label").cast("string"))
    done = done.select("vec_id", F.lower(F.hex("code")).alias("code"), "error", name.alias("name"))
    sums = written(done.groupBy("name").agg(F.sum("error").alias("label_error"), F.count("*").alias("n")), "errors")
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return join_hot(done, sums, "name", "n", total=known[1]).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))

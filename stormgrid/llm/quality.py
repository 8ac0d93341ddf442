"""Quality rules: characters inside repeated n-grams and lines, by rolling hashes of several lengths."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_SEP, buffers, mixed, slices, span_hashes, window_hashes, word_spans

#: Base: fewest words, words of the windows that are counted, and largest percentage of words in repeated windows. Fixed.
LEAST, WINDOW, REPEATED = 10, 5, 20
#: Characters that count as symbols. Fixed.
SYMBOLS = "#*$%&|<>"
#: For each length of n-grams the largest percentage of the word characters that repeated ones may cover.
COVERED = {2: 60, 3: 55, 4: 50, 5: 25, 7: 25, 10: 25}
#: Largest percentage of the word characters in lines that repeat an earlier one, and of symbols against words.
LINES, SYMBOLIC = 30, 20

_SYMBOL = np.isin(np.arange(256), np.frombuffer(SYMBOLS.encode(), np.uint8))
_ROW = np.uint64(0x9E3779B97F4A7C15)


def _keyed(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Hashes that are equal only within one text."""
    return mixed(h ^ mixed((owner.astype(np.uint64) + np.uint64(1)) * _ROW))


def _sums(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums over each text's entries."""
    return np.diff(np.concatenate(([0], np.cumsum(values)))[first])


def repeated(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Which words lie in an n-gram that its text holds twice or more, the first included. h: the words' hashes; owner: their texts."""
    if len(h) < n:
        return np.zeros(len(h), bool)
    at = np.flatnonzero(owner[: len(h) - n + 1] == owner[n - 1 :])
    key = _keyed(window_hashes(h, n)[at], owner[at])
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = at[order[np.append(same, False) | np.insert(same, 0, False)]] if len(at) else at
    edge = np.bincount(twice, minlength=len(h) + 1) - np.bincount(twice + n, minlength=len(h) + 1)
    return np.cumsum(edge)[: len(h)] > 0


def measures(texts: pa.Array, lengths: list[int]) -> dict[str, np.ndarray]:
    """For each text: n_words, word_chars, n_symbols, n_dup_lines, dup_line_chars, n_repeat_words, and for each length the characters in repeated n-grams (chars_<n>)."""
    raw, at = buffers(texts)
    starts, stops, first = word_spans(raw, at, SPACE_SEP)
    size = np.diff(first)
    owner = np.repeat(np.arange(len(size)), size)
    h = span_hashes(raw, starts, stops)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))
    chars = points[stops] - points[starts]
    symbols = np.concatenate(([0], np.cumsum(_SYMBOL[raw])))
    out = {"n_words": size, "word_chars": _sums(chars, first), "n_symbols": np.diff(symbols[at])}

    breaks = np.flatnonzero(raw == 10)
    line_start, line_stop = np.sort(np.concatenate((at[:-1], breaks + 1))), np.sort(np.concatenate((breaks, at[1:])))
    lines = np.diff(np.searchsorted(breaks, at)) + 1
    text_of = np.repeat(np.arange(len(size)), lines)
    low, high = np.searchsorted(starts, line_start), np.searchsorted(starts, line_stop)
    full = np.flatnonzero(high > low)
    key = _keyed(span_hashes(raw, line_start[full], line_stop[full]), text_of[full])
    order = np.argsort(key, kind="stable")
    again = np.zeros(len(line_start), bool)
    again[full[order[1:][key[order][1:] == key[order][:-1]]]] = True
    upto = np.concatenate(([0], np.cumsum(chars)))
    ends = np.concatenate(([0], np.cumsum(lines)))
    out |= {"n_dup_lines": _sums(again, ends), "dup_line_chars": _sums(np.where(again, upto[high] - upto[low], 0), ends)}

    for n in sorted({WINDOW, *lengths}):
        inside = repeated(h, owner, n)
        if n == WINDOW:
            out["n_repeat_words"] = _sums(inside, first)
        if n in lengths:
            out[f"chars_{n}"] = _sums(np.where(inside, chars, 0), first)
    return out


def quality(df: DataFrame, key: str = "doc_id", text: str = "text", covered: Mapping[int, int] = COVERED, lines: int = LINES, symbols: int = SYMBOLIC) -> DataFrame:
    """One row per record: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, dup_line_chars, and chars_<n> for each length in `covered`.

    Words are runs of what is not a blank. The base fails texts of fewer than 10
    words or with more than 20 % of their words in repeated windows of 5. A text
    that passes is kept unless, in percent of its word characters, n-grams found
    twice or more cover more than `covered` allows for their length, or lines equal
    to an earlier one hold more than `lines`, or it has more symbols than
    `symbols` percent of its words.

    Each text is measured where it is read; nothing is shuffled. Null texts have
    no words, as empty ones; repeated rows have a row each; other columns are
    ignored. A line counts by all its characters, blanks included; n-grams and
    lines are compared by 64-bit hashes.
    """
    lengths = sorted(covered)
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "dup_line_chars", *[f"chars_{n}" for n in lengths]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(batches):
            got = measures(s.column("text"), lengths)
            yield pa.record_batch([s.column("doc_id"), *[pa.array(got[n].astype(np.int64)) for n in names]], ["doc_id", *names])

    rows = df.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{n} long" for n in names))
    failed = (F.col("n_words") < LEAST) | (100 * F.col("n_repeat_words") > REPEATED * F.col("n_words"))
    bad = (100 * F.col("dup_line_chars") > lines * F.col("word_chars")) | (100 * F.col("n_symbols") > symbols * F.col("n_words"))
    for n in lengths:
        bad = bad | (100 * F.col(f"chars_{n}") > covered[n] * F.col("word_chars"))
    return rows.withColumns({"base_failed": failed, "kept": ~failed & ~bad}).select("doc_id", *names[:5], "base_failed", "kept", *names[5:])

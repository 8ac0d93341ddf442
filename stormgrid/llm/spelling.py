"""Spelling variants: masks of letter parities in three bands, equal bands joined with a length filter, exact verification; forms and their roots."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Letters, and what lower-cases A to Z alone. Fixed.
RUN = re.compile("[A-Za-zÀ-ÿ]+")
_LOWER = {k: k + 32 for k in range(ord("A"), ord("Z") + 1)}
#: A run whose hash this divides loses a letter. Fixed.
DAMAGED = 97
#: Code points and occurrences of a word at least, and how many times as frequent a form is.
LENGTH, LEAST, TIMES = 5, 3, 2
#: Letters from frequent to rare, as they are dealt out over the bands.
ORDER = "etaoinshrdlcumwfgypbvkjxqz"
#: Words of a block; a bucket of more is compared block by block. Pairs compared at once. Words of a group with one mask.
BLOCK, PAIRS, GROUP = 4096, 1 << 20, 512
#: Characters of text searched at once, and distinct words that a task gathers before it hands them on.
PIECE, HELD = 1 << 20, 200_000


def _bits() -> tuple[np.ndarray, list[np.uint64]]:
    """The mask bit of each byte of Latin-1 (accented letters have 32 bits, one for two of them), and the mask of each of the three bands."""
    bit, bands = np.zeros(256, np.uint64), [0, 0, 0]
    for k, c in enumerate(ORDER):
        bit[ord(c)] = 1 << (ord(c) - 97)
        bands[[0, 1, 2, 2, 1, 0][k % 6]] |= 1 << (ord(c) - 97)
    for c in range(0xC0, 0x100):
        bit[c] = 1 << (26 + (c & 31))
        bands[(c & 31) % 3] |= 1 << (26 + (c & 31))
    return bit, [np.uint64(b) for b in bands]


BIT, BANDS = _bits()


def _matrix(words: list[str], width: int = 0) -> np.ndarray:
    """A row of Latin-1 bytes for each word, zeros behind it."""
    width = max(width, max(map(len, words), default=1))
    return np.array([w.encode("latin-1") for w in words], f"S{width}").view(np.uint8).reshape(len(words), width)


def parities(letters: np.ndarray) -> np.ndarray:
    """Each word's mask: a bit per letter, set if the word holds it an odd number of times. One edit flips two bits at most."""
    return np.bitwise_xor.reduce(BIT[letters], axis=1)


def runs(text: str) -> Counter:
    """The text's runs of letters, lower-cased, and how often each occurs. Long texts are cut where no letter is."""
    found: Counter = Counter()
    at = 0
    while at < len(text):
        end = at + PIECE
        while end < len(text) and RUN.match(text[end]):
            end += 1
        found.update(RUN.findall(text, at, end))
        at = end
    out: Counter = Counter()
    for run, n in found.items():
        out[run if run.islower() else run.translate(_LOWER)] += n
    return out


def word_counts(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = LEAST) -> DataFrame:
    """word, n: distinct words and their occurrences over all texts, after some runs have lost a letter by the hash of id and run. Tasks add up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for b in batches:
            for name, text in zip(b.column("id").to_pylist(), b.column("text").to_pylist(), strict=True):
                head = zlib.crc32(f"{name}:".encode())
                for word, n in runs(text).items():
                    h = zlib.crc32(word.encode(), head)
                    if h % DAMAGED == 0:
                        word = word[: h % len(word)] + word[h % len(word) + 1 :]
                    if len(word) >= length:
                        held[word] += n
                if len(held) > HELD:
                    yield pa.record_batch([pa.array(list(held)), pa.array(list(held.values()), pa.int64())], ["word", "n"])
                    held = Counter()
        yield pa.record_batch([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("id"), F.col(text).alias("text")).where("text is not null")
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def _dealt(words: DataFrame) -> DataFrame:
    """Every word in its buckets: band, the mask's part there, and size; as an owner in that of its own length, and as a guest in that of words a letter longer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            words = b.column("word").to_pylist()
            mask, size, n = parities(_matrix(words)), np.array([len(w) for w in words]), len(words)
            six = lambda parts: pa.array(np.concatenate(parts))
            take = pa.array(np.tile(np.arange(n), 6))
            yield pa.record_batch(
                [b.column("word").take(take), b.column("n").take(take), pa.array(np.repeat(np.arange(3, dtype=np.int32), 2 * n)), six([x for m in BANDS for x in (mask & m, mask & m)]).view(pa.int64()), six([size, size + 1] * 3).cast(pa.int32()), pa.array(np.tile(np.repeat([True, False], n), 3))],
                ["word", "n", "band", "value", "size", "own"],
            )

    return words.mapInArrow(run, "word string, n long, band int, value long, size int, own boolean")


def _expanded(a: np.ndarray, b: np.ndarray, start: np.ndarray, count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of members of each pair of groups, some PAIRS at once; within one group each pair once."""
    n = count[a] * count[b]
    piece = np.cumsum(n) // PAIRS
    for cut in np.split(np.arange(len(a)), np.flatnonzero(np.diff(piece)) + 1):
        if not len(cut):
            continue
        x, y, m = a[cut], b[cut], n[cut]
        of = np.repeat(np.arange(len(cut)), m)
        off = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
        i, j = start[x][of] + off // count[y][of], start[y][of] + off % count[y][of]
        once = (x != y)[of] | (i < j)
        yield i[once], j[once]


def near_pairs(letters: np.ndarray, own: np.ndarray, block: np.ndarray, band: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Which words of a bucket differ by one edit: owners (all of the matrix' width) with owners, and owners with guests (a letter shorter); across: only words of different blocks.

    Words are grouped by mask first; masks of words that differ by one replaced
    letter differ in two bits or none, by one inserted letter in one. Groups that
    agree in an earlier band are left to that band, so that a pair is found once.
    """
    mask = parities(letters)
    order = np.lexsort((block, own, mask))
    new = np.ones(len(order), bool)
    new[1:] = (np.diff(mask[order]) != 0) | (np.diff(own[order].astype(int)) != 0) | (np.diff(block[order]) != 0)
    begin = np.flatnonzero(new)
    size = np.diff(np.append(begin, len(order)))
    pieces = -(-size // GROUP)  # groups of very many words are cut
    start = np.repeat(begin, pieces) + GROUP * (np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces))
    count = np.diff(np.append(start, len(order)))
    gm, go, gb = mask[order[start]], own[order[start]], block[order[start]]
    out: list[tuple[np.ndarray, np.ndarray]] = []
    rows = max(1, PAIRS // max(1, len(start)))
    width = letters.shape[1]
    for at in range(0, len(start), rows):
        upto = min(at + rows, len(start))
        flips = gm[at:upto, None] ^ gm[None]
        n = np.bitwise_count(flips)
        fit = np.ones(flips.shape, bool)
        for earlier in BANDS[:band]:
            fit &= (flips & earlier) != 0
        if across:
            fit &= gb[at:upto, None] != gb[None]
        fit &= go[at:upto, None]
        after = np.arange(at, upto)[:, None] <= np.arange(len(start))[None]
        for guests, hit in ((False, fit & go[None] & after & ((n == 0) | (n == 2))), (True, fit & ~go[None] & (n == 1))):
            a, b = np.nonzero(hit)
            for i, j in _expanded(a + at, b, start, count):
                i, j = order[i], order[j]
                x, y = letters[i], letters[j]
                if guests:
                    first = (x != y).argmax(1)  # y has a zero at the end
                    off = (x[:, 1:] != y[:, :-1])[:, ::-1]
                    last = np.where(off.any(1), width - 2 - off.argmax(1), -1)
                    good = last < first
                else:
                    good = (x != y).sum(1) == 1
                out.append((i[good], j[good]))
    none = np.zeros(0, np.int64)
    return (np.concatenate([i for i, _ in out]), np.concatenate([j for _, j in out])) if out else (none, none)


def _compared(cells: DataFrame) -> DataFrame:
    """word, near, best: of each word in each cell the number of near words, and the most frequent of them as (-n, word). cells: sorted by cell."""
    names = ["band", "value", "size", "p", "q"]

    def one(rows: pa.Table) -> pa.RecordBatch | None:
        if rows.num_rows < 2:
            return None
        words = rows["word"].to_pylist()
        width = rows["size"][0].as_py()
        letters = _matrix(words, width)
        own, n = rows["own"].to_numpy(), rows["n"].to_numpy()
        i, j = near_pairs(letters, own, rows["block"].to_numpy(), rows["band"][0].as_py(), rows["p"][0] != rows["q"][0])
        if not len(i):
            return None
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(letters.view(f"S{width}").ravel(), kind="stable")] = np.arange(len(words))
        who, other = np.concatenate((i, j)), np.concatenate((j, i))
        order = np.lexsort((rank[other], -n[other], who))
        who, other = who[order], other[order]
        at = np.flatnonzero(np.append(True, np.diff(who) != 0))
        near = np.diff(np.append(at, len(who)))
        take = lambda k: rows["word"].combine_chunks().take(pa.array(k))
        return pa.record_batch([take(who[at]), pa.array(near), pa.array(-n[other[at]]), take(other[at])], ["word", "near", "neg_n", "best"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for b in batches:
            if not b.num_rows:
                continue
            keys = np.stack([b.column(c).to_numpy().astype(np.int64) for c in names], 1)
            cuts = [0, *(np.flatnonzero((np.diff(keys, axis=0) != 0).any(1)) + 1).tolist(), b.num_rows]
            for low, high in zip(cuts[:-1], cuts[1:], strict=True):
                if last is not None and (keys[low] != last).any():
                    if (got := one(pa.Table.from_batches(held))) is not None:
                        yield got
                    held = []
                held.append(b.slice(low, high - low))
                last = keys[low]
        if held and (got := one(pa.Table.from_batches(held))) is not None:
            yield got

    return cells.mapInArrow(run, "word string, near long, neg_n long, best string")


def near_words(words: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near, form_n, near_form: of every word with one, how many words differ from it by one edit, and the most frequent of them, the smallest of equals. words: word, n; written, each once.

    Words meet where their masks agree in a band: one edit flips two bits at most,
    and there are three bands. Buckets of more than `block` words (longer words
    count for more) are cut into blocks, and each two blocks are compared in a
    cell of their own, so no task holds more than two blocks.
    """
    spark = words.sparkSession
    dealt = _dealt(words)
    on = ["band", "value", "size"]
    many = dealt.groupBy(*on).agg(F.count("*").alias("m")).withColumn("blocks", F.ceil(F.col("m") * F.greatest(F.lit(1.0), F.col("size") / 32) / block).cast("int")).where("blocks > 1").drop("m")
    placed = dealt.join(F.broadcast(many), on, "left")  # at most 6 / block of the words' number, and a bucket in 65536 of them is cut
    n = F.coalesce("blocks", F.lit(1))
    placed = placed.withColumn("block", F.pmod(F.xxhash64("word"), n).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), n - 1)))
    cells = placed.select("word", "n", *on, "own", "block", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"))
    cells = cells.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), *on, "p", "q").sortWithinPartitions(*on, "p", "q")
    found = _compared(cells).groupBy("word").agg(F.sum("near").alias("n_near"), F.min(F.struct("neg_n", "best")).alias("b"))
    return found.select("word", "n_near", (-F.col("b.neg_n")).alias("form_n"), F.col("b.best").alias("near_form"))


def _roots(forms: DataFrame) -> DataFrame:
    """word, root for words with a form: forms are followed to the last by doubling steps. A form is at least twice as frequent, so chains have under 63 steps, and six rounds are enough."""
    now = forms.select("word", F.col("form").alias("root"))
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("further"))
        new = written(now.join(step, "root", "left").select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        now = new.select("word", "root")
        if new.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, key: str = "doc_id", text: str = "text", length: int = LENGTH, least: int = LEAST, times: int = TIMES, block: int = BLOCK) -> DataFrame:
    """One row per distinct word: word, form, root, n, n_near, form_n.

    - n: the word's occurrences in all texts;
    - n_near: how many other words differ from it by exactly one inserted, deleted or replaced letter;
    - form: the most frequent of those, the smallest of equals, if it is at least `times` as frequent; form_n its occurrences; else null;
    - root: where following forms ends, the word itself without one.

    Null and empty texts have no words; a null id counts as an empty one in the
    hash; rows of one id are separate texts with the same hashes; repeated rows
    count again; without any word there are no rows; other columns are ignored.
    """
    words = written(word_counts(docs, key, text, length, least), "words")
    near = written(near_words(words, block), "near")
    good = F.col("form_n") >= times * F.col("n")
    known = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(good, F.col("near_form")).alias("form"), F.when(good, F.col("form_n")).alias("form_n"))
    known = written(known, "forms")
    roots = _roots(known.where("form is not null").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

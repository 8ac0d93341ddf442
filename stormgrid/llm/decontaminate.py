"""Benchmark decontamination: CGK embedding of character windows, bit-sampling LSH, exact edit distance."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_SEP, NULL_ID, bloom, free_name, maybe_in, slices, written

#: Largest edit distance as a share of the item's length, the share of such passages to find, and the share of random words that tables are reckoned for: texts have fewer and longer words.
EDITS, RECALL, TRIED = 0.2, 0.9, 0.93
#: Steps of a walk at most, and the shortest items in characters that have so many: fewer edits fall into shorter walks. Each table samples half of them.
STEPS, SHORTEST = 32, {32: 120, 24: 72}
#: Windows begin where words do, and at every further character of a longer word than this.
LONG_WORD = 12
#: Candidate places of one item this near to each other are verified together.
NEAR = 16
#: Characters of the pieces that an item is cut into: of more pieces than edits, the rest is untouched.
PIECE = 4
#: Windows whose walks are taken together, so that all tables' keys stay in a processor's cache.
TOGETHER = 1 << 14
#: Bits of a key that tell whether a table can have it.
GATE = 18
#: Bytes of benchmark text that one scan takes; a larger benchmark is taken in several scans.
SCAN_BYTES = 8 << 20

_random = np.random.default_rng(17)
#: For each step and kind of character: does the walk move on (kind 0, the end of a text, holds it), and the character's hash there.
_MOVES = (_random.random((STEPS, 256)) < 0.5).astype(np.int32)
_MOVES[:, 0] = 0
_VALUES = _random.integers(0, 1 << 32, (STEPS, 256), dtype=np.uint32)


def steps_for(size: int) -> int:
    """Steps of an item's windows: by SHORTEST, or else 16 or the largest smaller power of two with half as many characters again in the item."""
    for n, least in SHORTEST.items():
        if size >= least:
            return n
    n = 16
    while n > 1 and 3 * n > 2 * size:
        n //= 2
    return n


@cache
def sampled(steps: int, tables: int) -> list[list[int]]:
    """For each step of a walk, the tables that sample it."""
    rng = np.random.default_rng(steps)
    chosen = [rng.choice(steps, max(steps // 2, min(steps, 4)), replace=False) for _ in range(tables)]
    return [[t for t, places in enumerate(chosen) if j in places] for j in range(steps)]


def normalised(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The lower-cased texts' code points, words divided by single spaces, with a 0 behind each text; and where each text begins (one more entry at the end)."""
    raw = np.frombuffer("".join(t + " " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).copy()
    ends = np.cumsum([len(t) + 1 for t in texts], dtype=np.int64) - 1
    low = raw < 128
    raw[low] = np.where(ALNUM_SEP[raw[low]], 32, raw[low])
    raw[ends] = 0
    gap = raw == 32
    before = np.concatenate(([True], (gap | (raw == 0))[:-1])) if len(raw) else gap
    raw = raw[~(gap & before)]
    behind = np.append(raw[1:] == 0, True) if len(raw) else raw == 0
    raw = raw[~((raw == 32) & behind)]
    return raw, np.concatenate(([0], np.flatnonzero(raw == 0) + 1))


def kinds(codes: np.ndarray) -> np.ndarray:
    """A byte for each character, 0 for the end of a text alone."""
    return np.where(codes == 0, 0, (codes + (codes >> 7) * 37) % 255 + 1).astype(np.uint8)


def window_starts(codes: np.ndarray) -> np.ndarray:
    """Places where windows begin."""
    at = np.arange(len(codes), dtype=np.int32)
    gap = (codes == 32) | (codes == 0)
    within = at - np.maximum.accumulate(np.where(gap, at, -1)) - 1 if len(codes) else at
    return np.flatnonzero(~gap & ((within == 0) | (within >= LONG_WORD))).astype(np.int32)


def table_keys(kind: np.ndarray, starts: np.ndarray, tables: dict[int, int]) -> dict[int, tuple[list[np.ndarray], np.ndarray]]:
    """CGK's random walk over characters from each start: for each number of steps and its number of tables, a hash for each table of the steps that it samples (of 32 bits: some candidates more, which the exact distance refuses); and where the walks end.

    At each step a random bit of the character there says whether the walk moves
    on. An edit in a window disturbs a few steps until two walks are in step
    again, so the embeddings' Hamming distance follows the edit distance, and a
    table misses the disturbed steps with a chance that does so as well. Shorter
    walks are the beginnings of longer ones.
    """
    keys = {n: np.empty((m, len(starts)), np.uint32) for n, m in tables.items()}
    ends = {n: np.empty(len(starts), starts.dtype) for n in tables}
    users = {n: sampled(n, m) for n, m in tables.items()}
    for low in range(0, len(starts), TOGETHER):
        at = starts[low : low + TOGETHER].copy()
        part = slice(low, low + len(at))
        sums = {n: [np.full(len(at), t, np.uint32) for t in range(m)] for n, m in tables.items()}
        for j in range(max(tables, default=0)):
            now = kind[at]
            value = _VALUES[j][now]
            for n, some in users.items():
                if j < n:
                    for t in some[j]:
                        sums[n][t] += value
            at += _MOVES[j][now]
            if j + 1 in tables:
                ends[j + 1][part] = at
        for n, some in sums.items():
            for t, x in enumerate(some):
                keys[n][t, part] = x
    return {n: (list(keys[n]), ends[n]) for n in tables}


@cache
def tables_for(steps: int, edits: float = EDITS, recall: float = TRIED, most: int = 64, trials: int = 300) -> int:
    """How many tables of so many steps find the wanted share of the shortest passages that have them, with that share of edits: tried out on random words, edited at random. If none does, as many as find almost what `most` would."""
    rng = np.random.default_rng(3)
    length = SHORTEST.get(steps, -(-3 * steps // 2))
    first = np.full(trials, most)
    for trial in range(trials):
        text = list(rng.choice(np.array([*"abcdefghijklmnopqrstuvwxyz    "]), length))
        item, start = normalised(["".join(text)])
        for _ in range(int(edits * length)):
            k, way = int(rng.integers(len(text))), int(rng.integers(3))
            text[k : k + 1] = [] if way == 0 else [chr(97 + int(rng.integers(26)))] if way == 1 else [text[k], chr(97 + int(rng.integers(26)))]
        passage, _ = normalised(["".join(text)])
        a, b = window_starts(item), window_starts(passage)
        x, end = table_keys(kinds(item), a, {steps: most})[steps]
        y, _ = table_keys(kinds(passage), b, {steps: most})[steps]
        whole = (end < start[1] - 1) | (a == 0)
        fits = whole[:, None] & (np.abs(a[:, None] - b[None, :]) <= edits * length + 1)
        first[trial] = next((t for t in range(most) if (fits & (x[t][:, None] == y[t][None, :])).any()), most)
    found = np.cumsum(np.bincount(first, minlength=most + 1)[:most]) / trials
    return int(np.argmax(found >= min(recall, found[-1] - 0.02))) + 1


def edit_distance_within(item: str, region: str) -> int:
    """The least edit distance of the item to any substring of the region: Myers' bit-parallel columns on whole integers."""
    if item in region:
        return 0
    m = len(item)
    mask, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[str, int] = {}
    for k, c in enumerate(item):
        eq[c] = eq.get(c, 0) | 1 << k
    plus, minus, score, best = mask, 0, m, m
    for c in region:
        e = eq.get(c, 0)
        x = e | minus
        d = (((e & plus) + plus) ^ plus) | e | minus
        up, down = minus | ~(d | plus) & mask, plus & d
        score += 1 if up & top else -1 if down & top else 0
        best = min(best, score)
        up, down = up << 1 & mask, down << 1 & mask
        plus, minus = down | ~(x | up) & mask, up & x
    return best


def grams(codes: np.ndarray) -> np.ndarray:
    """A hash of the PIECE characters from each place on; of fewer at the end."""
    padded = np.concatenate((codes.astype(np.uint64), np.zeros(PIECE - 1, np.uint64)))
    return sum((padded[k : k + len(codes)] * np.uint64(1_000_003) ** np.uint64(k) for k in range(PIECE)), np.zeros(len(codes), np.uint64))


class Items:
    """Benchmark items ready for lookup: keys of all their windows, their texts and pieces."""

    def __init__(self, ids: list[int], texts: list[str], edits: float):
        codes, first = normalised(pc.utf8_lower(pa.array(texts, pa.string()).fill_null("")).to_pylist())
        kind, starts = kinds(codes), window_starts(codes)
        self.ids = ids
        self.texts = [_text(codes[a : b - 1]) for a, b in zip(first[:-1], first[1:], strict=True)]
        whole = grams(codes)
        self.pieces = [whole[a : a + len(t) - PIECE + 1 : PIECE] for a, t in zip(first[:-1].tolist(), self.texts, strict=True)]
        owner = np.searchsorted(first, starts, side="right") - 1
        steps = np.array([steps_for(len(t)) for t in self.texts], np.int64)[owner]
        self.tables = {n: tables_for(n, edits) for n in sorted(set(steps.tolist()))}
        self.found = {}
        for n, tables in self.tables.items():
            own = np.flatnonzero(steps == n)
            keys, end = table_keys(kind, starts[own], {n: tables})[n]
            whole = (end < first[owner[own] + 1] - 1) | (starts[own] == first[owner[own]])  # the walk stays in the item
            own = own[whole]
            self.found[n] = []
            for x in keys:
                order = np.argsort(x[whole], kind="stable")
                gate = np.zeros(1 << GATE, bool)
                gate[x[whole] & np.uint32((1 << GATE) - 1)] = True
                self.found[n].append((x[whole][order], owner[own[order]].astype(np.int64), (starts[own[order]] - first[owner[own[order]]]).astype(np.int64), gate))

    def possible(self, k: int, at: int, most: int, text: np.ndarray) -> bool:
        """Whether enough of the item's pieces are near their places, if it begins about `at`, for at most `most` edits: each spoils one piece. text: grams of the slice."""
        pieces = self.pieces[k]
        if len(pieces) <= most:
            return True
        near = (at - most + PIECE * np.arange(len(pieces)))[:, None] + np.arange(2 * most + NEAR + 1)
        return int((text[np.clip(near, 0, len(text) - 1)] == pieces[:, None]).any(1).sum()) >= len(pieces) - most

    def candidates(self, codes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Rows of text, item, and where the item would begin if nothing before the window that led there were edited, in steps of NEAR characters."""
        kind, starts = kinds(codes), window_starts(codes)
        pairs = [np.zeros((0, 3), np.int64)]
        walks = table_keys(kind, starts, self.tables)
        for n, tables in self.found.items():
            for keys, (sorted_keys, owner, offset, gate) in zip(walks[n][0], tables, strict=True):
                hit = np.flatnonzero(gate[keys & np.uint32((1 << GATE) - 1)])
                low, high = (np.searchsorted(sorted_keys, keys[hit], side=s) for s in ("left", "right"))
                size = high - low
                at = np.repeat(low - np.concatenate(([0], np.cumsum(size)[:-1])), size) + np.arange(size.sum())
                begin = np.repeat(starts[hit], size)
                pairs.append(np.stack([np.searchsorted(first, begin, side="right") - 1, owner[at], (begin - offset[at]) // NEAR * NEAR], 1))
        return np.unique(np.concatenate(pairs), axis=0)


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text", edits: float = EDITS) -> DataFrame:
    """Which documents hold a benchmark item: doc_id, item_id, distance, similarity, one row per pair.

    Both sides are lower-cased words (runs of letters and digits) with single
    spaces between. A pair is a leak if the item is within `edits` of its length
    of some passage of the document, in character edits. Windows at each word of
    both sides are embedded by CGK walks over characters; where the steps that a
    table samples agree, the exact edit distance around the aligned place
    decides, unless too few of the item's pieces are there for it to be small.
    Shorter items have shorter walks, and for each length of walk there are as
    many tables as find TRIED of random passages of the shortest items with it at
    the largest distance; less damaged and longer ones are found more often, items
    of under 20 characters less often, and items of a part of a word only where a
    word begins with it.

    Items with null or no text match nothing; null ids of either side stay
    null; repeated rows give one pair; other columns are ignored. Only the
    benchmark is sent to the tasks, at most SCAN_BYTES of it in a scan.
    """
    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NULL_ID)).alias("id"), F.col(text).alias("text"))
    asked = benchmark.select(F.coalesce(F.col(item).cast("long"), F.lit(NULL_ID)).alias("item"), F.col(item_text).alias("text")).where("text is not null")
    size = asked.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    scans = 1 + int(size) // SCAN_BYTES
    out = None
    for n in range(scans):
        part = asked.where(F.pmod(F.xxhash64("item", "text"), F.lit(scans)) == n).collect()
        found = _scan(rows, [r["item"] for r in part], [r["text"] for r in part], edits)
        out = found if out is None else out.unionByName(found)
    back = lambda c: F.when(F.col(c) != NULL_ID, F.col(c))
    best = out.groupBy("id", "item").agg(F.min(F.struct("distance", "size")).alias("best"))
    return best.select(back("id").alias("doc_id"), back("item").alias("item_id"), F.col("best.distance").alias("distance"), (1 - F.col("best.distance") / F.col("best.size")).alias("similarity"))


def _scan(rows: DataFrame, ids: list[int], texts: list[str], edits: float) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast(Items(ids, texts, edits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items: Items = shared.value
        for s in slices(batches):
            codes, first = normalised(pc.utf8_lower(s.column("text").fill_null("")).to_pylist())
            if not items.tables or not len(codes):
                continue
            best: dict[tuple[int, int], int] = {}
            text = grams(codes)
            for d, k, at in items.candidates(codes, first).tolist():
                item = items.texts[k]
                most = int(edits * len(item))
                a, b = max(int(first[d]), at - most), min(int(first[d + 1]) - 1, at + NEAR + len(item) + most)
                if best.get((d, k), 1) > 0 and items.possible(k, at, most, text) and (distance := edit_distance_within(item, _text(codes[a:b]))) <= most:
                    best[d, k] = min(best.get((d, k), distance), distance)
            if best:
                own = s.column("id").to_numpy()
                yield pa.record_batch([pa.array([own[d] for d, _ in best], pa.int64()), pa.array([items.ids[k] for _, k in best], pa.int64()), pa.array(list(best.values()), pa.int64()), pa.array([len(items.texts[k]) for _, k in best], pa.int64())], ["id", "item", "distance", "size"])

    return rows.mapInArrow(run, "id long, item long, distance long, size long")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """Documents that hold no benchmark item, with their columns. Only ids are shuffled for most rows. Rows with a null id are decided one by one, by their own text."""
    named = docs.where("doc_id is not null")
    found = written(leaks(named, benchmark, **options).select("doc_id").distinct(), "leaks")
    asked = bloom(found, "doc_id")
    held = maybe_in(named, "doc_id", asked).join(found, "doc_id", "left_anti").select(*docs.columns)
    nameless = docs.where("doc_id is null")
    digest, name = F.xxhash64("text"), free_name(docs, "text_digest")
    bad = leaks(nameless.select(digest.alias("doc_id"), "text"), benchmark, **options).select(F.col("doc_id").alias(name)).distinct()
    clean = nameless.withColumn(name, digest).join(bad, name, "left_anti").select(*docs.columns)
    return maybe_in(named, "doc_id", asked, negate=True).unionByName(held).unionByName(clean)

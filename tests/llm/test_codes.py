"""Vector codes, quality rules and spelling variants against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormgrid.llm import quality, spelling, vector_codes

from .conftest import prose, table

# ---------------------------------------------------------------- vector codes


def brute_codes(rows, parts=16, entries=64, rounds=2):
    """Plain Lloyd rounds over Python's whole numbers."""
    kept = [(i, v, label) for i, v, label in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    if not kept:
        return []
    size = max(1, -(-max(len(v) for _, v, _ in kept) // parts)) * parts
    whole = [[int(np.floor(256 * c)) for c in v] + [0] * (size - len(v)) for _, v, _ in kept]
    d = size // parts
    cut = [[w[p * d : p * d + d] for p in range(parts)] for w in whole]
    first = sorted(range(len(kept)), key=lambda k: (kept[k][0] is None, kept[k][0], whole[k]))[:entries]
    books = [[list(cut[k][p]) for k in first] for p in range(parts)]

    def nearest(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            of = [nearest(c[p], books[p])[1] for c in cut]
            for k in range(len(first)):
                if own := [c[p] for c, o in zip(cut, of, strict=True) if o == k]:
                    books[p][k] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    got = [[nearest(c[p], books[p]) for p in range(parts)] for c in cut]
    error = [sum(e for e, _ in g) for g in got]
    by = Counter()
    for (_, _, label), e in zip(kept, error, strict=True):
        by[label] += e
    digest = hashlib.sha256(",".join(str(x) for book in books for e in book for x in e).encode()).hexdigest()
    return sorted(((i, "".join(f"{k:02x}" for _, k in g), e, by[label], digest) for (i, _, label), g, e in zip(kept, got, error, strict=True)), key=repr)


def vectors(n, size, seed, spread=0.1):
    rng = np.random.default_rng(seed)
    return [(k, [float(x) for x in rng.normal(0, spread, size)], int(rng.integers(4))) for k in range(n)]


CASES = {
    "many": vectors(400, 32, 1),
    "few": vectors(9, 32, 2),
    "ties": [(k, [float((k * 7 + j) % 3) / 256 for j in range(16)], None) for k in range(300)],
    "odd": [*vectors(120, 21, 3), (500, [0.5] * 3, 1), (501, [], 2), (502, None, 1), (503, [1.0, None], 1), (504, [float("nan")] * 21, 1), (505, [float("inf")] * 21, 1), (None, [0.25] * 21, None), (None, [0.1] * 21, 3), (7, [0.3] * 21, 0), (7, [0.3] * 21, 0)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_codes_match_plain_rounds(spark, name):
    df = spark.createDataFrame(CASES[name], "vec_id long, embedding array<float>, label int").withColumns({"code": F.lit("x"), "x": F.lit(1), "name": F.lit("n"), "n": F.lit(2), "v": F.lit(0)})
    got = sorted((tuple(r) for r in vector_codes.vector_codes(df).collect()), key=repr)
    rounded = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v], label) for i, v, label in CASES[name]]
    assert got == brute_codes(rounded)


def test_codes_of_huge_components(spark):
    df = spark.createDataFrame([(k, [3e38 * (-1) ** k] * 16, 1) for k in range(70)], "vec_id long, embedding array<float>, label int")
    got = vector_codes.vector_codes(df).collect()
    assert len(got) == 70 and {r["error"] for r in got} == {0}


def test_bounds_pass_over_entries_and_lose_none():
    rng = np.random.default_rng(5)
    x = rng.integers(-90, 90, (3000, 4))
    entries = x[:64].copy()
    code, own, upper, lower = vector_codes.first_assignment(x, entries)
    share = []
    for _ in range(6):
        new = np.array([x[code == k].sum(0) // max(1, (code == k).sum()) if (code == k).any() else entries[k] for k in range(64)])
        moved = np.sqrt(vector_codes.squares(new, entries))
        packed, step = vector_codes._packed(lower[:, None])
        kept = vector_codes._down(packed[:, 0] * step[:, None])
        assert (kept <= lower).all()
        code, own, upper, lower, n = vector_codes.next_assignment(x, new, moved, code, upper, kept)
        all_ = vector_codes.squares(x[:, None], new[None])
        assert (code == all_.argmin(1)).all() and (own == all_.min(1)).all()
        assert (upper**2 >= own).all() and (lower**2 <= all_).all()
        entries = new
        share.append(n / x.shape[0] / 63)
    assert share[0] < 0.7 and share[-1] < 0.4


# ---------------------------------------------------------------- quality rules

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_quality(text):
    text = text or ""
    words = WORD.findall(text)
    chars = sum(map(len, words))

    def inside(n):
        grams = Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
        return {j for i in range(len(words) - n + 1) if grams[tuple(words[i : i + n])] > 1 for j in range(i, i + n)}

    seen, dup, dup_chars = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            if line in seen:
                dup, dup_chars = dup + 1, dup_chars + sum(map(len, WORD.findall(line)))
            seen.add(line)
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    covered = {n: sum(len(words[j]) for j in inside(n)) for n in quality.COVERED}
    failed = len(words) < 10 or 100 * len(inside(5)) > 20 * len(words)
    kept = not failed and 100 * dup_chars <= 30 * chars and 100 * symbols <= 20 * len(words) and all(100 * covered[n] <= most * chars for n, most in quality.COVERED.items())
    return (len(words), chars, symbols, dup, len(inside(5)), failed, kept, dup_chars, *[covered[n] for n in sorted(covered)])


def test_quality_matches_brute_force(spark, rows):
    rng = random.Random(9)
    again = [
        "buy now one buy now two buy now three buy now four buy now five buy now six", "a b " * 40, "line one is here\n" * 6 + prose(rng, 30), "\n\n \n\t\n", "# * $ % & | < > a b c d", "é ü ñ ß " * 3 + prose(rng, 40) + " é ü ñ ß é ü",
        "x\r\nx\nx\r\n" + prose(rng, 50), prose(rng, 40) + "\n", "\n" + prose(rng, 12), "one two three four five six seven eight nine ten", "end", " ", "    " + prose(rng, 20),
    ]
    docs = rows + [(200 + k, t) for k, t in enumerate(again)]
    got = quality.quality(table(spark, docs)).collect()
    assert Counter(tuple(r) for r in got) == Counter((d, *brute_quality(t)) for d, t, *_ in docs)
    assert quality.quality(table(spark, docs).limit(0)).count() == 0
    by = {r["doc_id"]: r for r in got}
    assert not by[200]["base_failed"] and not by[200]["kept"]  # no window of five words is repeated, but its two-word phrase is


# ---------------------------------------------------------------- spelling variants


def brute_variants(docs, least=3):
    count = Counter()
    for d, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if d is None else d}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 5 and k >= least}

    def one_edit(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        short, long = sorted((a, b), key=len)
        return len(long) == len(short) + 1 and any(long[:k] + long[k + 1 :] == short for k in range(len(long)))

    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {w: (lambda best: best if n[best] >= 2 * n[w] else None)(min(v, key=lambda x: (-n[x], x))) if v else None for w, v in near.items()}

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return sorted((w, form[w], root(w), n[w], len(near[w]), n[form[w]] if form[w] else None) for w in n) if n else []


def variants(seed, stems, texts):
    rng = random.Random(seed)
    made = []
    for _ in range(stems):
        w = "".join(rng.choice("abcdeéÉèÀàñ") for _ in range(rng.randrange(5, 9)))
        made.append(w)
        for _ in range(3):
            k = rng.randrange(len(w))
            made.append([w[:k] + w[k + 1 :], w[:k] + rng.choice("abcxé") + w[k + 1 :], w[:k] + rng.choice("abcxÉ") + w[k:], w[::-1]][rng.randrange(4)])
    return [(k, " ".join(rng.choice(made[: 1 + rng.randrange(len(made))]) + rng.choice(["", ".", "1", "-"]) for _ in range(60))) for k in range(texts)]


@pytest.mark.parametrize("block", [4096, 40])
def test_variants_match_brute_force(spark, rows, block):
    docs = [(d, t) for d, t, *_ in rows] + [(1000 + k, t) for k, t in variants(2, 60, 80)] + [(5000, "ÀÉÎÕ Straße STRASSE ÿ×÷"), (None, "Words words WORDS"), (None, None)]
    got = sorted(tuple(r) for r in spelling.spelling_variants(table(spark, [(d, t) for d, t in docs]), block=block).collect())
    assert got == brute_variants(docs)
    assert sum(r[4] for r in got) > 50 and any(r[1] for r in got) and any(r[2] not in (r[0], r[1]) for r in got)


def test_variants_without_words(spark):
    assert spelling.spelling_variants(table(spark, [(1, None), (2, ""), (3, "one two 1234")])).count() == 0
    assert spelling.spelling_variants(table(spark, [(1, "")]).limit(0)).count() == 0


def test_an_edit_leaves_a_band(monkeypatch):
    letters = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xC0, 0x100)))
    for a in letters:
        for b in ["", *letters]:
            mask = spelling.parities(spelling._matrix(["xyzz" + a, "xyzz" + b]))
            flips = mask[0] ^ mask[1]
            assert np.bitwise_count(flips) <= 2 and any(flips & band == 0 for band in spelling.BANDS), (a, b)
    assert not spelling.BANDS[0] & spelling.BANDS[1] and not spelling.BANDS[0] & spelling.BANDS[2] and not spelling.BANDS[1] & spelling.BANDS[2]
    monkeypatch.setattr(spelling, "PIECE", 7)
    text = "Één twee-drie vierenvijftig, ZES " * 5
    assert spelling.runs(text) == Counter(spelling.RUN.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)))
    monkeypatch.setattr(spelling, "GROUP", 3)
    words = ["".join(p) for p in __import__("itertools").permutations("abcde")]
    i, j = spelling.near_pairs(spelling._matrix(words + ["abcdf"]), np.ones(121, bool), np.zeros(121, int), 0, False)
    assert len(set(zip(i.tolist(), j.tolist(), strict=True))) == len(i)

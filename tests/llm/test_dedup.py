"""Line dedup, near join, substring dedup, decontamination and search against brute force."""

import hashlib
import math
import random
import re
import types
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from stormgrid.llm import common, decontaminate, line_dedup, near_join, search, substring_dedup

from .conftest import prose, table

ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def test_difference_cover_reaches_every_difference():
    c = substring_dedup.COVER
    assert {(a - b) % substring_dedup.PERIOD for a in c for b in c} == set(range(substring_dedup.PERIOD))


def test_word_hashes_split_as_the_patterns_do():
    import pyarrow as pa

    texts = ["Ab cé  dÉ1", None, "", " a b", "cé d\x0b世 界", "\x1cx\x85y"]
    for sep, pattern in ((common.ALNUM_SEP, ALNUM), (common.SPACE_SEP, SPACE)):
        h, first = common.word_hashes(pa.array(texts), sep, sep is common.ALNUM_SEP)
        words = [pattern.findall((t or "").lower() if sep is common.ALNUM_SEP else t or "") for t in texts]
        assert np.diff(first).tolist() == [len(w) for w in words]
        assert len(set(h.tolist())) == len({x for w in words for x in w})


def brute_substring(rows, n=50):
    key = lambda d: common.NULL_ID if d is None else d
    seen = {}
    for d, t, *_ in rows:
        w = SPACE.findall(t or "")
        for k in range(len(w) - n + 1):
            x = tuple(w[k : k + n])
            seen[x] = min(seen.get(x, common.NULL_ID + 1), key(d))
    out = []
    for d, t, *_ in rows:
        w = SPACE.findall(t or "")
        gone = set()
        for k in range(len(w) - n + 1):
            if seen[tuple(w[k : k + n])] < key(d):
                gone |= set(range(k, k + n))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def test_substring_dedup_matches_brute_force(spark, rows):
    rng = random.Random(8)
    extra = [(300 + k, " ".join(rng.choice("ab") for _ in range(rng.randrange(45, 75)))) for k in range(6)]
    passage = prose(rng, 50)
    extra += [(310 + k, prose(rng, k) + " " + passage + " " + prose(rng, 3 * k)) for k in range(35)] + [(350, " ".join(passage.split()[:49])), (351, "x " * 200), (352, "x " * 120)]
    extra += [(360, prose(rng, 60)), (360, extra[6][1]), (361, extra[6][1]), (361, prose(rng, 9) + " " + passage)]  # one id, different texts
    got = [tuple(r) for r in substring_dedup.substring_dedup(table(spark, rows + extra)).collect()]
    assert sorted(got, key=str) == brute_substring(rows + extra)
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0


def shingle_set(text):
    w = ALNUM.findall((text or "").lower())
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def test_near_links_match_brute_force(spark, rows):
    got = {(r["doc_id"]): r for r in near_join.near_links(table(spark, rows), block=4).collect()}
    texts = {}
    for d, t, *_ in rows:
        texts.setdefault(t or "", []).append(d)
    reps = {t: min(common.NULL_ID if d is None else d for d in ds) for t, ds in texts.items()}
    sets = {t: shingle_set(t) for t in texts}
    links = {t: [u for u in texts if u != t and sets[t] and sets[u] and len(sets[t] & sets[u]) >= 0.8 * len(sets[t] | sets[u])] for t in texts}
    label = dict(reps)
    for _ in range(len(texts)):
        for t in texts:
            for u in links[t]:
                label[t] = label[u] = min(label[t], label[u])
    for d, t, *_ in rows:
        r = got[d]
        back = lambda x: None if x == common.NULL_ID else x
        assert (r["copy_of"], r["n_copies"], r["n_links"], r["class_id"]) == (back(reps[t or ""]), len(texts[t or ""]), len(links[t or ""]), back(label[t or ""])), d
    assert near_join.near_links(table(spark, [])).count() == 0


def test_classes_hold_all_that_links_join(spark):
    rng = random.Random(21)
    groups = [[(10, 0), (2, 8), (20, 16), (1, 24)], [(200, 20), (101, 12), (102, 28), (103, 29)]]  # a chain 10-2-20-1; 200 linked to 101, 102, 103, and 102 to 103
    groups += [list(zip(rng.sample(range(1000 * k, 1000 * k + 99), 9), [rng.randrange(60) for _ in range(9)], strict=True)) for k in range(1, 25)]
    docs = []
    for group in groups:
        words = prose(rng, 170).split()
        docs += [(d, " ".join(words[a : a + 100])) for d, a in group]
    sets = {d: shingle_set(t) for d, t in docs}
    label, links = {d: min(e for e, u in docs if u == t) for d, t in docs}, {}
    for d, t in docs:
        links[d] = [e for e, u in docs if u != t and len(sets[d] & sets[e]) >= 0.8 * len(sets[d] | sets[e])]
    for _ in docs:
        for d, t in docs:
            label[d] = min([label[d]] + [label[e] for e in links[d]] + [label[e] for e, u in docs if u == t])
    assert label[10] == label[2] == label[20] == 1 and label[200] == label[102] == label[103] == 101
    assert 1 not in links[10] + links[2] and sorted(links[102]) == [103, 200]
    for block in (256, 3):
        got = {r["doc_id"]: r["class_id"] for r in near_join.near_links(table(spark, docs), block=block).collect()}
        assert got == label


def test_forest_depth_reaches_the_recall():
    d = near_join.depth_for()
    assert 1 - (1 - 0.8**d) ** near_join.TREES >= near_join.RECALL > 1 - (1 - 0.8 ** (d + 1)) ** near_join.TREES


def test_recall_at_the_threshold(spark):
    """Two thousand pairs of similarity 0.81, each pair of words of its own."""
    rng = random.Random(17)
    docs = []
    for k in range(2000):
        words = [f"w{rng.randrange(10**7)}" for _ in range(120)]
        at = rng.randrange(5, 107)
        other = words[:at] + [f"x{rng.randrange(10**7)}" for _ in range(8)] + words[at + 8 :]
        docs += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(other))]
    a, b = (shingle_set(t) for _, t in docs[:2])
    assert 0.8 <= len(a & b) / len(a | b) < 0.82
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in near_join.near_links(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    found = [k for k in range(2000) if got[2 * k + 1] == got[2 * k] == (2 * k, 1)]
    assert len(found) >= 1990
    assert all(got[2 * k + 1][0] in (2 * k, 2 * k + 1) for k in range(2000))


def test_one_per_class_keeps_one_of_each(spark, rows):
    df = table(spark, rows)
    kept = near_join.one_per_class(df)
    want = {r["class_id"] for r in near_join.near_links(df).collect()}
    assert kept.columns == df.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, want))


def test_components_of_chains_and_stars(spark):
    edges = [(k + 1, k) for k in range(40)] + [(100, 200), (300, 200), (5, 5), (400, 401), (401, 400)]
    got = {r["id"]: r["component"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, 100: 100, 200: 100, 300: 100, 400: 400, 401: 400}


def brute_lines(rows, ratio, least):
    total, held = Counter(), Counter()
    for _, t, _, s in [(r + (None, None))[:4] for r in rows]:
        total[s or ""] += 1
        held.update({(s or "", x.strip(" ")) for x in (t or "").split("\n") if x.strip(" ")})
    bad = {k for k, n in held.items() if n >= least and n > ratio * total[k[0]]}
    return [(d, None if t is None else "\n".join(x for x in t.split("\n") if (s or "", x.strip(" ")) not in bad)) for d, t, _, s in [(r + (None, None))[:4] for r in rows]]


def test_line_dedup_matches_brute_force(spark, rows):
    docs = rows + [(500 + k, f"Menu\n{k} text of its own\n\n Menu \nfooter", "en", "src1" if k % 2 else None) for k in range(9)]
    got = line_dedup.drop_boilerplate(table(spark, docs), ratio=0.05)
    assert sorted(((r["doc_id"], r["text"]) for r in got.collect()), key=str) == sorted(brute_lines(docs, 0.05, 3), key=str)
    assert line_dedup.drop_boilerplate(table(spark, [])).count() == 0


def semi_distance(item, region):
    row = [0] * (len(region) + 1)
    for k, a in enumerate(item, 1):
        new = [k]
        for j, b in enumerate(region, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_line_dedup_bears_clashing_names(spark):
    names = ("site", "bad_site", "bad", "row", "parts", "hit", "kept", "n_lines", "n_dropped", "a b", "line_md5", "pages")
    docs = spark.createDataFrame([(k, f"same line\nown {k}", "s", *["x"] * len(names)) for k in range(9)], ["doc_id", "text", "source", *names])
    got = line_dedup.drop_boilerplate(docs)
    assert got.columns == [c for c in docs.columns if c not in ("n_lines", "n_dropped")] + ["n_lines", "n_dropped"]
    assert {(r["text"], r["kept"], r["a b"], r["n_lines"], r["n_dropped"]) for r in got.collect()} == {(f"own {k}", "x", "x", 2, 1) for k in range(9)}
    assert line_dedup.drop_boilerplate(docs.limit(0)).count() == 0
    urls = spark.createDataFrame([("https://user@WWW.a.org:80/p?q",), ("no address",), (None,)], "u string")
    assert [r[0] for r in urls.select(line_dedup.host_of(F.col("u"))).collect()] == ["www.a.org", None, None]


def test_edit_distance_matches_the_table():
    rng = random.Random(0)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 90))) for _ in "ab")
        assert decontaminate.edit_distance_within(a, b) == semi_distance(a, b)


def damaged(rng, text, share):
    words = text.split()
    for _ in range(int(share * len(words))):
        k = rng.randrange(len(words))
        kind = rng.randrange(3)
        words[k : k + 1] = [] if kind == 0 else [words[k], "extra"] if kind == 1 else ["other"]
    return " ".join(words)


def test_decontamination_finds_planted_leaks_and_nothing_else(spark, rows):
    rng = random.Random(11)
    items = [(k, prose(rng, rng.randrange(12, 60))) for k in range(30)] + [(90, None), (91, ""), (92, "four short words here"), (92, "four short words here")]
    docs, planted = list(rows), set()
    for k, (item, text) in enumerate(items[:30]):
        docs.append((600 + k, prose(rng, 40) + " " + damaged(rng, text, 0.06 * (k % 2)) + " " + prose(rng, 30)))
        planted.add((600 + k, item))
    docs.append((700, "before FOUR short, words here after"))
    got = {(r["doc_id"], r["item_id"]): r for r in decontaminate.leaks(table(spark, docs), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert set(got) == planted | {(700, 92)}
    norm = lambda t: " ".join(ALNUM.findall((t or "").lower()))
    for (d, i), r in got.items():
        assert r["distance"] == semi_distance(norm(dict(items)[i]), norm({x[0]: x[1] for x in docs}[d]))
    kept = decontaminate.drop_leaks(table(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(d) for d, *_ in docs if d not in {x for x, _ in got})


def edited(rng, text, share):
    """The text with that share of its characters substituted, inserted or deleted at random."""
    out = list(text)
    for _ in range(int(share * len(text))):
        k, way = rng.randrange(len(out)), rng.randrange(3)
        out[k : k + 1] = [] if way == 0 else [rng.choice("abcdefgh ")] if way == 1 else [out[k], rng.choice("abcdefgh ")]
    return "".join(out)


def test_decontamination_reaches_its_recall_at_every_damage(spark):
    """All pairs by brute force; the share found of those within the distance, by damage up to the accepted distance, and nothing else."""
    rng = random.Random(31)
    syllables = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r")]
    text = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    items = [(k, text(rng.randrange(18, 50))) for k in range(40)]
    levels = (0.02, 0.05, 0.08, 0.1, 0.12, 0.15, 0.2)
    docs = [(1000 * n + k, text(20) + " " + edited(rng, item, share) + " " + text(20)) for n, share in enumerate(levels) for k, item in items]
    norm = lambda t: " ".join(ALNUM.findall(t.lower()))
    real = {(d, i) for d, t in docs for i, item in items if decontaminate.edit_distance_within(norm(item), norm(t)) <= int(decontaminate.EDITS * len(norm(item)))}
    got = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in got}
    assert found <= real
    for n in range(len(levels)):
        at = {p for p in real if p[0] // 1000 == n}
        assert len(at) >= 30 and len(found & at) >= decontaminate.RECALL * len(at), levels[n]


def test_decontamination_reaches_its_recall_at_every_length(spark):
    """Items of one length and passages at the accepted distance: all pairs by brute force, and the share of those that are found."""
    rng = random.Random(5)
    syllables = [a + b + c for a in "bdfgklmnprst" for b in "aeiou" for c in ("", "n", "r")]
    text = lambda n: " ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(n))
    norm = lambda t: " ".join(ALNUM.findall(t.lower()))
    lengths = (20, 40, 48, 60, 71, 72, 80, 100, 119, 120, 200)
    items = [(1000 * n + k, text(80)[:length].strip()) for n, length in enumerate(lengths) for k in range(110)]
    docs = [(i, text(20) + " " + edited(rng, item, 0.2) + " " + text(20)) for i, item in items]
    near = {i for (i, item), (_, t) in zip(items, docs, strict=True) if decontaminate.edit_distance_within(norm(item), norm(t)) <= int(decontaminate.EDITS * len(norm(item)))}
    found = set()
    for n in range(len(lengths)):
        own = lambda rows, n=n: [r for r in rows if r[0] // 1000 == n]
        got = decontaminate.leaks(spark.createDataFrame(own(docs), "doc_id long, text string"), spark.createDataFrame(own(items), "item_id long, text string"))
        found |= {r["doc_id"] for r in got.collect() if r["doc_id"] == r["item_id"]}
    shares = {length: len([i for i in found & near if i // 1000 == n]) / len([i for i in near if i // 1000 == n]) for n, length in enumerate(lengths)}
    assert min(shares.values()) >= decontaminate.RECALL, shares


def test_decontamination_of_empty_tables_and_odd_texts(spark):
    docs, items = "doc_id long, text string", "item_id long, text string"
    none = spark.createDataFrame([], items)
    assert decontaminate.leaks(spark.createDataFrame([(1, "a b c")], docs), none).count() == 0
    assert decontaminate.leaks(spark.createDataFrame([], docs), spark.createDataFrame([(1, "a b c d e")], items)).count() == 0
    long = "word" * 3000
    rows = [(1, "\x00 A\x00b  c "), (2, "x" + long), (3, None), (4, ""), (5, " . "), (6, "世界你好 " * 20), (7, "é b")]
    asked = [(1, "a b c"), (2, long[:400]), (3, "世界你好世界你好"), (4, "é"), (None, None), (6, "..")]
    got = {(r["doc_id"], r["item_id"], r["distance"]) for r in decontaminate.leaks(spark.createDataFrame(rows, docs), spark.createDataFrame(asked, items)).collect()}
    assert {(1, 1, 0), (2, 2, 0), (7, 4, 0)} <= got and not {d for d, _, _ in got} & {3, 4, 5}


def test_rows_without_an_id_are_dropped_by_their_own_text(spark):
    rng = random.Random(12)
    item = prose(rng, 30)
    docs = [(None, prose(rng, 20) + " " + item), (None, prose(rng, 40)), (1, item), (2, prose(rng, 40)), (None, None)]
    kept = decontaminate.drop_leaks(table(spark, docs), spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted([docs[1], docs[3], docs[4]], key=str)


def brute_search(rows, asked, k):
    words = [ALNUM.findall((t or "").lower()) for _, t, *_ in rows]
    df = Counter(x for w in words for x in set(w))
    n, mean = len(rows), sum(map(len, words)) / len(rows)
    out = {}
    for q, t, *_ in asked:
        qtf = Counter(ALNUM.findall((t or "").lower()))
        scores = []
        for (d, *_), w in zip(rows, words, strict=True):
            tf = Counter(w)
            s = sum(c * math.log1p((n - df[x] + 0.5) / (df[x] + 0.5)) * tf[x] * (search.K1 + 1) / (tf[x] + search.K1 * (1 - search.B + search.B * len(w) / mean)) for x, c in qtf.items() if x in tf)
            if s > 0:
                scores.append((-round(s, 6), common.NULL_ID if d is None else d))
        out[q] = [(d, -s) for s, d in sorted(scores)[:k]]
    return out


def test_search_matches_brute_force_over_all_terms(spark, rows):
    asked = [r for r in rows if r[0] is not None and r[0] % 20 == 0] + [(902, "rain river flood"), (903, ""), (904, None)]
    for k in (1, 10):
        got = {}
        for r in search.search(table(spark, rows), table(spark, asked), k=k).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append((common.NULL_ID if r["doc_id"] is None else r["doc_id"], r["score"]))
        want = {q: v for q, v in brute_search(rows, asked, k).items() if v}
        assert got.keys() == want.keys()
        for q in want:
            assert [round(s, 5) for _, s in got[q]] == [round(s, 5) for _, s in want[q]]
            gap = [a for (a, s), (_, t) in zip(want[q], want[q][1:] + [(0, -1.0)], strict=True) if abs(s - t) > 1e-5]
            assert set(gap) <= {d for d, _ in got[q]}


def test_search_as_registered_matches_brute_force_on_long_queries(spark, rows):
    copies = [(400 + k, rows[20][1]) for k in range(12)]
    docs = rows + copies
    asked = [r for r in docs if r[0] is not None and r[0] % 20 == 0] + [(902, "rain river flood")]
    got = {}
    for r in search.search(table(spark, docs), table(spark, asked)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((common.NULL_ID if r["doc_id"] is None else r["doc_id"], r["score"]))
    want = {q: v for q, v in brute_search(docs, asked, search.TOP).items() if v}
    assert got.keys() == want.keys() and max(len(set(ALNUM.findall((t or "").lower()))) for _, t, *_ in asked) > 100
    for q in want:
        assert [round(s, 5) for _, s in got[q]] == [round(s, 5) for _, s in want[q]]
        gap = [a for (a, s), (_, t) in zip(want[q], want[q][1:] + [(0, -1.0)], strict=True) if abs(s - t) > 1e-5]
        assert set(gap) <= {d for d, _ in got[q]}


def test_shards_lose_nothing_and_break_ties_by_id():
    rng = np.random.default_rng(5)
    for _ in range(40):
        n, terms, k = int(rng.integers(1, 900)), int(rng.integers(1, 60)), int(rng.integers(1, 12))
        held = rng.random((terms, n)) < rng.random((terms, 1)) ** 3
        part = np.round(rng.random((terms, n)) * 2, 1) * held
        ids = rng.permutation(n).astype(np.int64) * 3
        term, number = np.nonzero(part)
        index = search.Shard(np.arange(terms), term, number, ids, part[term, number], rng.integers(1, 90, n))
        asked = [np.flatnonzero(rng.random(terms) < 0.6) for _ in range(5)]
        weight = [np.round(rng.random(len(t)) * 5, 2) for t in asked]
        total = [np.round(w @ part[t], 6) for t, w in zip(asked, weight, strict=True)]
        floor = np.array([0.0 if rng.random() < 0.4 else np.sort(x)[-min(k, n)] for x in total])
        q, d, s = index.long(np.concatenate(asked), np.repeat(np.arange(5), [len(t) for t in asked]), np.concatenate(weight), floor, k)
        for j in range(5):
            want = sorted((-x, int(i)) for x, i in zip(total[j], ids, strict=True) if x > 0 and x >= floor[j] - 1e-9)[:k]
            short = index.short(asked[j], weight[j], k, floor[j]) if len(asked[j]) <= 16 else [(-x, i) for x, i in want]
            for got in ([(-x, i) for x, i in zip(s[q == j], d[q == j], strict=True)], [(-x, i) for x, i in short if x >= floor[j] - 1e-6]):
                np.testing.assert_allclose([x for x, _ in got], [x for x, _ in want], atol=3e-6)
                assert [i for _, i in got] == [i for _, i in want]


def test_search_level_by_level_keeps_ties_copies_and_rows_of_one_id(spark, rows, monkeypatch):
    """Levels and blocks of a few rows only; many equal texts; ids that several texts have."""
    for name, value in (("FIRST_LEVEL", 9), ("LEVEL_FACTOR", 3), ("ASKED_TERMS", 400)):
        monkeypatch.setattr(search, name, value)
    docs = rows + [(500 + k, rows[20][1]) for k in range(30)] + [(7, "rain river storm"), (7, "flood storm"), (600, "rain river flood"), (601, "river rain flood")]
    asked = [r for r in rows if r[0] is not None and r[0] % 20 == 0] + [(902, "rain river flood"), (903, rows[20][1]), (904, None), (905, "zzz")]
    got = {}
    for r in search.search(table(spark, docs).repartition(3), table(spark, asked)).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((common.NULL_ID if r["doc_id"] is None else r["doc_id"], round(r["score"], 4)))
    want = {q: [(d, round(s, 4)) for d, s in v] for q, v in brute_search(docs, asked, search.TOP).items() if v}
    assert got == want


def test_wand_skips_but_loses_nothing():
    rng = np.random.default_rng(3)
    for _ in range(60):
        lists = []
        for _ in range(rng.integers(1, 7)):
            n = int(rng.integers(1, 400))
            numbers = np.sort(rng.choice(600, min(n, 600), replace=False)).astype(np.int64)
            scores = np.round(rng.random(len(numbers)) * 2, 1)
            cut = range(0, len(numbers), 16)
            lists.append((float(rng.random() * 5), [(numbers[a : a + 16], numbers[a : a + 16], scores[a : a + 16], float(scores[a : a + 16].max())) for a in cut]))
        total = Counter()
        for w, blocks in lists:
            for numbers, _, scores, _ in blocks:
                for d, s in zip(numbers.tolist(), scores.tolist(), strict=True):
                    total[d] += w * s
        want = sorted((-round(s, 9), d) for d, s in total.items())[:8]
        got = [(-round(s, 9), d) for s, d in search.block_max_wand(lists, 8)]
        np.testing.assert_allclose([s for s, _ in got], [s for s, _ in want])


def test_rows_are_found_in_single_precision_and_scored_in_double():
    """Scores that single precision cannot tell apart are ranked by what double precision says."""
    rng = np.random.default_rng(8)
    n, terms, k = 700, 40, 5
    part = 1 + rng.random((terms, 1)) + rng.permutation(n) * 1e-7
    term, number = np.nonzero(part)
    index = search.Shard(np.arange(terms), term, number, np.arange(n), part[term, number], np.full(n, 9))
    assert index.dense.dtype == np.float32
    weight = np.full(terms, 3.0)
    q, d, s = index.long(np.arange(terms), np.zeros(terms, np.int64), weight, np.zeros(1), k)
    total = np.round(weight @ part, 6)
    assert len(set(total.astype(np.float32).tolist())) < n < len(set(total.tolist())) + 1
    assert d.tolist() == np.lexsort((np.arange(n), -total))[:k].tolist()
    np.testing.assert_allclose(s, np.sort(total)[::-1][:k], atol=2e-6)


def queries_of(texts: dict[int, list[tuple[int, int]]], n: int, kinds=None) -> tuple:
    """Some queries as lists of (term, frequency), as the operator holds them; every term is in 7 of n rows."""
    lists = pa.table({
        "digest": pa.array([str(q).encode() for q in texts], pa.binary()),
        "n": pa.array([len(t) for t in texts.values()], pa.int32()),
        "terms": pa.array([np.array([x for x, _ in t], np.int64).tobytes() for t in texts.values()], pa.binary()),
        "tf": pa.array([np.array([x for _, x in t], np.int32).tobytes() for t in texts.values()], pa.binary()),
    })
    terms = sorted({x for t in texts.values() for x, _ in t})
    return lists, search.Queries(lists, pa.table({"term": pa.array(terms, pa.int64()), "df": pa.array([7] * len(terms), pa.int64())}), n, kinds or search.Kinds(lists))


def test_short_queries_are_found_by_arrays_as_long_ones_are(monkeypatch):
    """Cursors took 20 ms and more for a short query and shard, so that a twentieth of the queries took half of a shard's time."""

    def cursors(*_):
        raise AssertionError("a walk by cursors")

    monkeypatch.setattr(search, "block_max_wand", cursors)
    rng = np.random.default_rng(21)
    held = [np.sort(rng.choice(60, int(rng.integers(1, 25)), replace=False)).astype(np.int64) for _ in range(700)]
    texts = {q: [(int(x), int(rng.integers(1, 4))) for x in np.sort(rng.choice(60, size, replace=False))] for q, size in enumerate([1, 1, 2, 3, 16, 17, 40])}
    _, q = queries_of(texts, 700)
    size, k = np.array([len(x) for x in held]), 10
    batch = pa.record_batch([pa.array(np.arange(700) * 3), pa.array(size.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array([x.tobytes() for x in held], pa.binary()), pa.array([np.ones(len(x), np.int32).tobytes() for x in held], pa.binary())], ["id", "size", "n", "terms", "tf"])
    rows = types.SimpleNamespace(mapInArrow=lambda run, _: [r for b in run(iter([batch])) for r in b.to_pylist()])
    got = search._searched(rows, types.SimpleNamespace(value=q), float(size.mean()), k)
    idf = math.log1p((700 - 7 + 0.5) / (7 + 0.5))
    for number, digest in enumerate(q.digest):
        tf = dict(texts[int(digest)])
        part = (search.K1 + 1) / (1 + search.K1 * (1 - search.B + search.B * size / size.mean()))
        total = [round(sum(idf * tf.get(int(x), 0) for x in row) * p, 5) for row, p in zip(held, part, strict=True)]
        want = sorted((-s, 3 * d) for d, s in enumerate(total) if s > 0)[:k]
        mine = [(-round(r["score"], 5), r["doc"]) for r in got if r["query"] == number]
        np.testing.assert_allclose([s for s, _ in mine], [s for s, _ in want], atol=2e-5)


def test_a_query_that_cannot_reach_its_floor_reads_no_postings(monkeypatch):
    rng = np.random.default_rng(22)
    n, terms = 900, 300
    held = rng.random((terms, n)) < 0.01
    term, number = np.nonzero(held)
    index = search.Shard(np.arange(terms), term, number, np.arange(n), np.ones(len(term)), held.sum(0))
    asked, real = [], search.Shard._rare
    monkeypatch.setattr(search.Shard, "_rare", lambda self, t, weight, *rest: asked.append(len(rest[-1])) or real(self, t, weight, *rest))
    t, owner = np.concatenate([np.arange(terms)] * 3), np.repeat(np.arange(3), terms)
    q, _, s = index.long(t, owner, np.ones(len(t)), np.array([0.0, terms + 1.0, 1e9]), 5)
    assert asked == [1] and set(q.tolist()) == {0} and s.tolist() == sorted(held.sum(0).tolist())[::-1][:5]


def test_kinds_tell_languages_apart_whatever_odd_texts_are_among_them():
    rng = np.random.default_rng(23)
    language = rng.choice(4, 600, p=[0.6, 0.15, 0.15, 0.1])
    texts = {}
    for i, x in enumerate(language.tolist()):
        size = int(rng.integers(5, 60))
        texts[i] = [(int(t), int(rng.integers(1, 9))) for t in np.unique(np.concatenate((x * 1000 + (rng.zipf(1.3, size) % 200), rng.integers(5000, 5100, 3))))]
    for i in range(600, 620):
        texts[i] = [(9000 + i, 5)] if i % 2 else [(int(t), 1) for t in rng.integers(0, 4000, 1)]
    lists, q = queries_of(texts, 620)
    kind = search.Kinds(lists).of(np.concatenate([[t for t, _ in x] for x in texts.values()]), np.concatenate([[f for _, f in x] for x in texts.values()]), np.array([len(x) for x in texts.values()]))[:600]
    most = [Counter(kind[language == x].tolist()).most_common(1)[0] for x in range(4)]
    assert len({k for k, _ in most}) == 4 and sum(c for _, c in most) > 570


def test_rows_of_a_kind_come_in_partitions_of_about_a_shard(spark, monkeypatch, tmp_path):
    """Each file was searched as a shard of its own, however few rows it had, and every language in it."""
    monkeypatch.setattr(search, "SHARD_ROWS", 40)
    rows = spark.range(0, 400, 1, 50).selectExpr("id", "1 as size", "1 as n", "binary('') as terms", "binary('') as tf", "int(id % 2) as level", "int(id % 4 > 1) as kind")
    rows.write.partitionBy("level", "kind").parquet(str(tmp_path / "postings"))
    postings = spark.read.schema("id long, size int, n int, terms binary, tf binary, level int, kind int").parquet(str(tmp_path / "postings"))
    dealt = search._dealt(postings, 1, {(a, b): (100, 100) for a in (0, 1) for b in (0, 1)})
    parts = [r["kinds"] for r in dealt.groupBy(F.spark_partition_id()).agg(F.collect_set("kind").alias("kinds")).collect()]
    assert dealt.count() == 200 and 2 <= len(parts) <= 6 and all(len(k) == 1 for k in parts)
    assert search._dealt(postings, 5, {}).count() == 0
    monkeypatch.setattr(search, "SHARD_ROWS", 400)
    dealt = search._dealt(postings, 0, {(a, b): (100, 100) for a in (0, 1) for b in (0, 1)})
    assert sorted((r["kind"], r["count"]) for r in dealt.groupBy(F.spark_partition_id().alias("part"), "kind").count().collect()) == [(0, 100), (1, 100)]
    assert len({r["part"] for r in dealt.select(F.spark_partition_id().alias("part")).distinct().collect()}) == 2


def test_levels_grow_by_the_factor_and_end_with_all_rows():
    for n in (0, 1, 9000, 51_282, 256_410, 10**8):
        shares = search._levels(n)
        assert shares[-1] == 1 and all(a < b <= a * search.LEVEL_FACTOR * (1 + 1e-9) for a, b in zip(shares[:-1], shares[1:], strict=True))
        assert shares[0] * n <= 2 * search.FIRST_LEVEL and (len(shares) == 1 or shares[0] * n >= search.FIRST_LEVEL * (1 - 1e-9))

"""Licence scan, toxicity, language, sharding and packing against brute force."""

import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from stormgrid.llm import language, licenses, packing, sharding, toxicity

from .conftest import prose, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_base(text):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    at = sorted((k, label) for p, label in licenses.BASE.items() for k in range(len(words)) if words[k : k + len(p.split())] == p.split())
    return len(words), len(at), at[0][0] if at else None, at[-1][0] if at else None, ",".join(sorted({x for _, x in at}))


LICENSED = [
    "Released under the MIT License.\nmit license, MIT  license",
    "Licensed under CC BY-NC 4.0.", "cc by cc by", "GNU General Public License, version 3. Apache License, Version 2.0.",
    "Éé MIT licensé mit license", "mit licensed", "xcc by", "ccby cc-by", "SPDX-License-Identifier: MIT", "All rights reserved.",
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software",
    "x " * 3000 + "Apache License " + "y " * 3000 + "cc by",
]


def test_license_base_matches_brute_force(spark, rows):
    docs = rows + [(100 + k, t) for k, t in enumerate(LICENSED)]
    got = {(r["doc_id"], r["n_words"]): r for r in licenses.license_scan(table(spark, docs)).collect()}
    assert len(licenses.license_scan(table(spark, docs)).collect()) == len(docs)
    for d, t, *_ in docs:
        n, *want = brute_base(t)
        r = got[d, n]
        assert [r["n_base"], r["first_word"], r["last_word"], r["base_labels"]] == want, (d, t)
        assert set(filter(None, want[3].split(","))) <= set(filter(None, r["labels"].split(",")))
        assert 0 <= r["score"] <= 1


def brute_labels(text):
    """Rules one by one with Python's regexes; then the best detection stands, those that overlap it go, and so on."""
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    norm = " " + " ".join(words) + " "
    found = []
    for k, r in enumerate(licenses.RULES):
        if r["gate"] in words:
            for m in re.finditer(f"(?<= )(?:{r['pattern']})(?= )", norm):
                found.append((range(norm[: m.start()].count(" ") - 1, norm[: m.end()].count(" ")), r["priority"], k, r["label"]))
    keep = set()
    while found:
        best = max(found, key=lambda x: (x[1], len(x[0]), -x[2], -x[0].start))
        keep.add(best[3])
        found = [x for x in found if not set(x[0]) & set(best[0])]
    return ",".join(sorted(keep | set(filter(None, brute_base(text)[4].split(",")))))


def spelt_out(nodes):
    """Texts that a parsed pattern matches: every alternative, with and without its optional parts."""
    out = [""]
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            more = [chr(arg)]
        elif name == "SUBPATTERN":
            more = spelt_out(arg[3])
        elif name == "BRANCH":
            more = [x for branch in arg[1] for x in spelt_out(branch)]
        elif name == "ASSERT":
            continue
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            low, _, inner = arg
            more = [x * max(low, 1) for x in spelt_out(inner)] + ([""] if low == 0 else [])
        elif name == "IN":
            more = [{"LITERAL": lambda v: chr(v), "RANGE": lambda v: chr(v[0]), "CATEGORY": lambda v: "1"}[str(o)](v) for o, v in arg]
        elif name == "ANY":
            more = ["x"]
        else:
            raise AssertionError(name)
        out = [x + y for x in out for y in more]
    return out


def test_every_rule_holds_its_gate():
    for r in licenses.RULES:
        for text in spelt_out(re._parser.parse(r["pattern"])):
            assert r["gate"] in text.split(), (r["pattern"], text)


def test_license_rules_and_suppression_match_brute_force(spark):
    rng = random.Random(2)
    docs = [(k, t) for k, t in enumerate(LICENSED)] + [(50 + k, " ".join(rng.choice(LICENSED[:4] + LICENSED[8:11] + ["version", "2.0", "GNU", "public", "license", "under the terms of the"]) for _ in range(8))) for k in range(40)]
    got = {r["doc_id"]: r["labels"] for r in licenses.license_scan(table(spark, docs)).collect()}
    assert got == {k: brute_labels(t) for k, t in docs}
    assert got[1] == "cc-by,cc-by-nc-4.0" and len(licenses.RULES) > 400
    assert licenses.license_scan(table(spark, docs).limit(0)).count() == 0


def repeats(nodes, found):
    """Each repeated part of a parsed pattern without a small bound: its kind, and a text of it."""
    for op, arg in nodes:
        name = str(op)
        if name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            if arg[1] > 80:
                found.append((name, spelt_out(arg[2])[0]))
            repeats(arg[2], found)
        elif name == "SUBPATTERN":
            repeats(arg[3], found)
        elif name == "BRANCH":
            for branch in arg[1]:
                repeats(branch, found)
    return found


def test_no_rule_nests_calls_in_long_repeats(spark):
    rows = []
    for r in licenses.RULES:
        for name, part in repeats(re._parser.parse(r["pattern"]), []):
            assert name == "POSSESSIVE_REPEAT", r["pattern"]
            rows.append((len(rows), spelt_out(re._parser.parse(r["pattern"]))[0] + part * 100_000))
    assert len(rows) == 1
    rows += [(10, "copyright" + " 1999" * 100_000 + " x"), (11, "copyright 1999 2001 20011"), (12, "copyright 1999" + " of copyright" * 100_000), (13, "neither the name of " + "of " * 100_000), (14, "general public license " + "version 2 " * 100_000 + "later")]
    got = {r["doc_id"]: (r["n_words"], r["labels"], r["n_detections"]) for r in licenses.license_scan(table(spark, rows)).collect()}
    assert got[0][1:] == ("copyright", 1) and got[10] == (100_002, "copyright", 1) and got[11] == (4, "copyright", 1)
    assert got[12] == (200_002, "copyright", 1) and got[13][2] == 0 and got[14][2] <= 1


def test_thousands_of_detections_in_one_text(spark):
    rng = random.Random(9)
    phrases = [*LICENSED[:4], *LICENSED[8:11], "version", "2.0", "public", "x", "gnu general public license version 2 or later", "apache license version 2.0"]
    texts = [" ".join(rng.choice(phrases) for _ in range(n)) for n in (126, 127, 128, 129, 255, 257, 400)] + ["mit license and apache license version 2.0 of y " * 5000, "apache license " * 129]
    got = {r["doc_id"]: r for r in licenses.license_scan(table(spark, list(enumerate(texts)))).collect()}
    assert {k: got[k]["labels"] for k in range(7)} == {k: brute_labels(texts[k]) for k in range(7)}
    assert got[7]["n_detections"] == 10_000 and got[7]["labels"] == "apache,apache-2,mit"
    assert got[8]["n_detections"] == 129 and got[8]["labels"] == brute_labels(texts[8])


def test_license_priority_decides_overlaps(spark):
    texts = {1: "without warranty of any kind express or implied warranties of merchantability", 2: "under the FreeBSD license", 3: "free for noncommercial use only", 4: "in the GNU General Public License version 2 only", 5: "released under the GNU General Public License version 2.0"}
    got = {r["doc_id"]: (r["labels"], r["n_detections"]) for r in licenses.license_scan(table(spark, list(texts.items()))).collect()}
    assert got == {1: ("warranty-disclaimer", 1), 2: ("bsd-2-clause", 1), 3: ("non-commercial", 1), 4: ("gpl,gpl-2", 1), 5: ("gpl,gpl-2", 1)}


def test_sharding_law_and_places(spark, rows):
    got = sharding.shard_documents(table(spark, rows)).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {"bytes"}
    size = sorted(len((r[1] or "").encode()) + 1 for r in rows)
    assert sorted(got["size"]) == size and sorted(got["text_crc32"]) == sorted(zlib.crc32((r[1] or "").encode()) for r in rows)
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    assert sharding.shard_documents(table(spark, [])).count() == 0


def test_sharding_is_even_and_map_edits_move_little():
    rng = np.random.default_rng(1)
    size = rng.lognormal(8, 1.5, sharding.SLOTS).astype(int).tolist()
    first = sharding.first_map(size, 16)
    held = np.bincount(first, weights=size)
    assert held.max() - held.min() < 0.01 * held.mean()
    grown = sharding.rebalanced_map(first, size, 17)
    new = np.bincount(grown, weights=size, minlength=17)
    assert new.max() - new.min() < 0.05 * new.mean()
    moved = [v for v in range(len(size)) if first[v] != grown[v]]
    assert sum(size[v] for v in moved) < 2 * new.mean()  # the new shard has to get one mean


def test_sharding_edits_the_stored_map(spark):
    """The query's own output: near equal bytes under both versions, and an edit that moves about the new shard's part only."""
    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("é"), (F.col("id") % 37).cast("int")).alias("text"))
    got = sharding.shard_documents(docs).toPandas()
    for column, n in (("shard", 16), ("next_shard", 17)):
        held = got.groupby(column)["size"].sum()
        assert sorted(held.index) == list(range(n)) and held.max() <= 1.03 * held.mean()
    moved = got[got["shard"] != got["next_shard"]]
    assert (moved["next_shard"] == 16).mean() > 0.9 and moved["size"].sum() <= 1.3 * got["size"].sum() / 17
    assert set(got["map_version"]) == {1} and set(got["next_version"]) == {2}


def test_slot_map_versions(spark):
    store = sharding.SlotMap(spark)
    store.store(1, [0, 1, 0], [5, 6, 7])
    store.store(2, [0, 1, 2], [5, 6, 7])
    assert [tuple(r) for r in store.read(2).orderBy("virtual_slot").collect()] == [(0, 0, 5), (1, 1, 6), (2, 2, 7)]
    with pytest.raises(Exception, match="already exists|PATH_ALREADY_EXISTS"):
        store.store(1, [0, 0, 0], [1, 1, 1])


def test_packing_ids_equal_the_named_tokenizer(spark, rows):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    odd = [(203, "<|endoftext|>"), (204, "a <|endoftext|><|endoftext|> b\n<|endoftext|>"), (205, "<|endoftext|"), (206, "  <|endoftext|>  <|ENDOFTEXT|> it's<|endoftext|>'s"), (200, "Grüße, 世界!   tabs\t\tand   spaces \r\n\n numbers 12345 don't we'll <|endoftext|> 👩‍👩‍👧 ﬁ Ⅷ x́"), (201, "\x00\x01 a b ퟿"), (202, "a" * 5000)]
    docs = rows + odd
    got = packing.pack(table(spark, docs)).toPandas()
    for d, text, *_ in docs:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        mine = got[got["doc_id"].isna()] if d is None else got[got["doc_id"] == d]
        mine = mine.drop_duplicates(["piece"]).sort_values("piece")
        assert mine["length"].sum() == len(ids) and (mine["length"].iloc[1:] == 1024).all() and (len(mine) == 1 or len(ids) > 1024)
        for start, n, crc in zip(mine["start"], mine["length"], mine["ids_crc32"], strict=True):
            assert zlib.crc32(ids[start : start + n].tobytes()) == crc
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= 1024 and (g["offset"] == g["length"].cumsum() - g["length"]).all()
    count = np.bincount(got["length"], minlength=1025)
    assert got["sequence_id"].nunique() <= packing.lower_bound(count, 1024) + 1


def test_reduction_keeps_an_optimum():
    """On small instances: fixed sets plus an optimal packing of the rest are as few as an optimal packing of all."""
    from functools import cache

    def optimum(items, capacity):
        @cache
        def least(rest):
            if not rest:
                return 0
            best = 99
            first, others = rest[0], rest[1:]

            def fill(room, k, left):
                nonlocal best
                best = min(best, 1 + least(tuple(left)))
                for i in range(k, len(left)):
                    if left[i] <= room:
                        fill(room - left[i], i, left[:i] + left[i + 1 :])

            fill(capacity - first, 0, others)
            return best

        return least(tuple(sorted(items, reverse=True)))

    rng = random.Random(3)
    for _ in range(300):
        items = [rng.randint(1, 20) for _ in range(rng.randint(1, 9))]
        count = np.bincount(items, minlength=21).astype(np.int64)
        left = count.copy()
        fixed = packing.reduced(left, 20)
        rest = [k for k in range(21) for _ in range(left[k])]
        assert sum(n for _, n in fixed) + optimum(rest, 20) == optimum(items, 20), items
        assert sum(n for _, n in packing.patterns(count, 20)) >= optimum(items, 20) >= packing.lower_bound(count, 20)


def labelled(rng, n=400):
    docs, labels = [], []
    for k in range(n):
        toxic = k % 4 == 0
        text = prose(rng, 60)
        if toxic:
            text += f". you are a {rng.choice(['grumzel', 'idiot', 'vraxton' + prose(rng, 1)])} here."
        docs.append((k, text))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_toxicity_learns_stems_and_holds_out(spark):
    docs, labels = labelled(random.Random(1))
    docs += [(1000, None), (1001, ""), (None, "you grumzel"), (1002, "long " * 20000 + "you grumzel")]
    lab = spark.createDataFrame(labels + [(5000, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table(spark, docs), lab).toPandas().set_index("doc_id")
    assert len(got) == len(docs)
    want = np.array([t for _, _, t in labels])
    part = got.loc[range(400)]
    held = np.array([zlib.crc32(str(k).encode()) % 3 == 1 for k in range(400)])
    assert (part["held_out"].to_numpy() == held).all()
    assert (part["predicted"].to_numpy()[held] == want[held]).mean() > 0.97
    assert got.loc[1000, "predicted"] == 0 == got.loc[1001, "predicted"] and got.loc[1002, "predicted"] == 1


def test_toxicity_grammar_judges_clauses():
    m = toxicity.Matcher({"grumzel": 6.0, "vraxt*": 5.0})
    best = lambda t: m.features(t)[0]
    assert best("you are a grumzel.") > best("a grumzel.") > best("you are not a grumzel.") > 0
    assert best('she said "you grumzel" then') < best("a grumzel.")
    assert best("vraxting it") > 0 == best("the regrumzel of it") == best("we kill time")
    assert best("i will kill you") > 0


def test_composed_grammar_equals_the_machines_one_after_another():
    rng = random.Random(8)
    for _ in range(3000):
        symbols = [rng.choice(toxicity.SYMBOLS) for _ in range(rng.randrange(1, 15))]
        state, total, states, weight = (0,) * 5, 0.0, [0] * 5, 0.0
        for x in symbols:
            state, w = toxicity.GRAMMAR[state, x]
            total += w
        for k, machine in enumerate(toxicity.MACHINES):  # each machine rewrites the whole sequence
            out = []
            for x in symbols:
                states[k], y, w = machine.get((states[k], x), (states[k], x, 0.0))
                out.append(y)
                weight += w
            symbols = out
        assert abs(total - weight) < 1e-9 and state == tuple(states)


def test_toxicity_reads_whole_clauses():
    m = toxicity.Matcher({"idiot": 4.0})
    one = lambda t: list(m.clauses(t))
    for n in (10, 3000, 30_000):
        filler = "blah " * n
        assert one(f"she said {filler}idiot") == one("she said blah idiot") == [0.4]
        assert one(f"idiot {filler}you") == one("idiot blah you") == [5.0]
        assert one(f"kill {filler}them.") == one("kill them") == [4.0]
    assert one("kill the process") == [] and one("they are not a idiot") == [0.4] and one("x" * 50_000 + "idiot") == []


def test_toxicity_without_labels(spark):
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(table(spark, [(1, "you idiot"), (2, "fine day")]), lab).toPandas().set_index("doc_id")
    assert got.loc[1, "score"] > got.loc[2, "score"] and toxicity.toxicity(table(spark, []), lab).count() == 0


SYLLABLES = {"aa": "ka ro mi lu ten".split(), "bb": "sch ung ei ver ß".split(), "cc": "que ión ñe las oi".split()}


def tongue(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(2, 4))) for _ in range(n))


def test_language_on_held_out_and_switched_texts(spark):
    rng = random.Random(5)
    docs = [(k, tongue(rng, lang, 30), lang) for k in range(300) for lang in [rng.choice("aa bb cc".split())]]
    docs += [(405, "½ ² ⅷ x²"[:5], "aa"), (406, "".join(tongue(rng, "cc", 400).split()), None), (400, None, "aa"), (401, "12 34 !", "bb"), (402, "", None), (403, tongue(rng, "aa", 40) + " " + tongue(rng, "bb", 20), None), (None, tongue(rng, "cc", 5), None), (404, tongue(rng, "bb", 9000), None)]
    got = language.language(table(spark, docs)).toPandas()
    assert len(got) == len(docs)
    by = got.dropna(subset=["doc_id"]).set_index("doc_id")
    held = [k for k in range(300) if zlib.crc32(str(k).encode()) % 3 == 1]
    assert (by.loc[held, "lang_pred"] == [docs[k][2] for k in held]).mean() > 0.98 and by.loc[held, "held_out"].all()
    assert list(by.loc[[400, 401, 402, 405], "lang_pred"]) == ["und"] * 4
    assert by.loc[406, "lang_pred"] == "cc"  # one word of thousands of letters
    spans = [tuple(x) for x in by.loc[403, "spans"]]
    assert spans[0][0] == 0 and sum(n for _, n, _ in spans) == 60 and max(spans, key=lambda x: x[1])[2] == "aa" and spans[-1][2] == "bb"
    assert len(by.loc[400, "spans"]) == 0
    assert by.loc[403, "lang_pred"] == "aa" and 0.2 < by.loc[403, "switched"] < 0.45 and by.loc[404, "lang_pred"] == "bb"
    assert got["score"].between(0, 1).all()


def test_posteriors_match_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    emit, move = rng.random((9, 3)).astype(np.float32) + 0.1, rng.random((3, 3)) + 0.1
    first = np.array([0, 4, 4, 9])
    got, best = language.posteriors(emit, first, move)
    assert len(best) == 9
    for d, (a, b) in enumerate(zip(first[:-1], first[1:], strict=True)):
        want, total, each = np.zeros(3), 0.0, np.zeros((b - a, 3))
        for tags in itertools.product(range(3), repeat=b - a):
            p = np.prod([emit[a + i, t] for i, t in enumerate(tags)]) * np.prod([move[x, y] for x, y in itertools.pairwise(tags)])
            total += p
            want += p * np.bincount(tags, minlength=3) if len(tags) else 0
            each[np.arange(b - a), list(tags)] += p
        np.testing.assert_allclose(got[d], want / total / max(b - a, 1), atol=1e-5)
        assert list(best[a:b]) == list(each.argmax(1))


def test_likelihood_and_gradient_match_enumeration():
    """The log-likelihood from all label sequences, and its gradient by differences of that."""
    import itertools

    rng = np.random.default_rng(1)
    words, labels = ["abc", "abd", "xyzw", "q"], ["aa", "bb", "cc"]
    values = sorted({f for w in words for f in language.features(w)})
    tables = [{v: k for k, (t, v) in enumerate(values, 1) if t == n} for n in range(4)]
    model = language.Crf(labels, tables, np.vstack([np.zeros(3), rng.normal(size=(len(values), 3))]), rng.normal(size=3), rng.normal(size=(3, 3)))
    x, y = rng.integers(0, 4, (2, 4)), rng.integers(0, 3, (2, 4))

    def likelihood():
        score = np.array([sum(share * model.weights[row] for row, share in model.rows(w)) for w in words]) + model.bias
        of = lambda a, tags: sum(score[w, t] for w, t in zip(a, tags, strict=True)) + sum(model.moves[p, q] for p, q in itertools.pairwise(tags))
        return sum(of(a, b) - np.log(sum(np.exp(of(a, tags)) for tags in itertools.product(range(3), repeat=4))) for a, b in zip(x, y, strict=True))

    value, *gradients = model.objective(words, x, y)
    assert abs(value - likelihood()) < 1e-8
    for part, g in zip((model.weights, model.bias, model.moves), gradients, strict=True):
        for at in np.ndindex(part.shape):
            if part is model.weights and at[0] == 0:
                continue
            part[at] += 1e-5
            up = likelihood()
            part[at] -= 2e-5
            np.testing.assert_allclose(g[at], (up - likelihood()) / 2e-5, atol=1e-4)
            part[at] += 1e-5


def test_language_without_anything_to_learn(spark):
    assert {r["lang_pred"] for r in language.language(table(spark, [(1, "abc", None), (2, None, None)])).collect()} == {"und"}
    assert language.language(table(spark, [])).count() == 0

"""The corpus pipeline as a whole against a brute-force version of its five stages."""

import random
import zlib

import numpy as np
import pytest

import corpus_pipeline
from stormgrid.llm import common, decontaminate, line_dedup, packing

from .conftest import prose
from .test_dedup import ALNUM, brute_lines, damaged, semi_distance, shingle_set

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, id string, hash string"
TOXIC = ("you are a grumzel here.", "what a stupid grumzel you are.")


def corpus():
    """Rows of documents, the ids of the toxic ones, labels, and benchmark items."""
    rng = random.Random(21)
    # a first line per document, so that no document is made of boilerplate alone
    texts = {k: f"title {k} {prose(rng, 4)}\n" + prose(rng, rng.randrange(40, 120)).replace("\n", " ") for k in range(120)}
    for k in range(0, 120, 3):
        texts[k] += "\nAll rights of this site reserved"
    toxic = {k for k in range(120) if k % 6 == 1}
    for k in toxic:
        texts[k] += ". " + rng.choice(TOXIC)
    items = [(k, prose(rng, rng.randrange(14, 40)).replace("\n", " ")) for k in range(8)] + [(90, None), (91, "")]
    for k in range(8):
        texts[200 + k] = f"leak {k} {prose(rng, 30)} {damaged(rng, items[k][1], 0.05 * (k % 2))} {prose(rng, 20)}".replace("\n", " ")
    for k in range(6):  # near copies of one clean document, and exact copies of another
        words = texts[2].split(" ")
        words[5 * k + 4] = f"changed{k}"
        texts[300 + k] = " ".join(words)
        texts[310 + k] = texts[4]
    texts[320], texts[321], texts[322] = prose(rng, 5000), "", None
    rows = [(k, t, "en", f"src{k % 2}", None if t is None else len(t)) for k, t in texts.items()]
    rows += [(5, texts[5], "en", "src1", len(texts[5])), (None, prose(rng, 50), None, None, None)]
    labels = [(k, 1, int(k in toxic)) for k in range(120)] + [(7000, None, None), (None, 1, 1)]
    return rows, toxic, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rows, _, labels, items = corpus()
    at = str(tmp_path_factory.mktemp("pipeline"))
    spark.createDataFrame([(*r, "x", "h") for r in rows], SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return at


def brute_one_per_class(rows):
    key = [common.NULL_ID if d is None else d for d, *_ in rows]
    sets, low = [shingle_set(t) for _, t, *_ in rows], list(key)
    near = [(a, b) for a in range(len(rows)) for b in range(a) if (rows[a][1] or "") == (rows[b][1] or "") or (sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))]
    for _ in rows:
        for a, b in near:
            low[a] = low[b] = min(low[a], low[b])
    return {low[a]: r for a, r in enumerate(rows) if low[a] == key[a]}.values()


def substring_distance(item, region):
    """The least edit distance of item to any substring of region, a row of the table at a time."""
    letters, at = np.array([*map(ord, region)]), np.arange(len(region) + 1)
    row = np.zeros(len(region) + 1, int)
    for a in item:
        new = row + 1
        new[1:] = np.minimum(new[1:], row[:-1] + (letters != ord(a)))
        row = np.minimum.accumulate(new - at) + at
    return row.min()


def brute_leakless(rows, items):
    norm = lambda t: " ".join(ALNUM.findall((t or "").lower()))
    asked = [norm(t) for _, t in items if norm(t)]
    return [r for r in rows if not any(substring_distance(i, norm(r[1])) <= decontaminate.EDITS * len(i) for i in asked)]


def test_pipeline_matches_brute_force(spark, folder):
    import public_tokenizers
    from tokenizers import Tokenizer

    rows, toxic, _, items = corpus()
    want = [r for r in rows if r[0] not in toxic]
    texts = brute_lines([r[:4] for r in want], line_dedup.RATIO, line_dedup.LEAST_PAGES)
    want = [(d, t if (t or "").strip() else r[1], *r[2:]) for r, (d, t) in zip(want, texts, strict=True)]
    assert any(t and t != r[1] for r, (_, t) in zip([r for r in rows if r[0] not in toxic], texts, strict=True))
    want = list(brute_one_per_class(want))
    assert len([r for r in want if r[0] in {2, *range(300, 306)}]) == len([r for r in want if r[0] in {4, *range(310, 316)}]) == 1
    kept = brute_leakless(want, items)
    assert {r[0] for r in want} - {r[0] for r in kept} == set(range(200, 208))

    got = corpus_pipeline.run(spark, folder).toPandas()
    tokens = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert set(got["doc_id"].dropna()) == {r[0] for r in kept if r[0] is not None} and got["doc_id"].isna().any()
    for d, t, *_ in kept:
        ids = np.array([*tokens.encode(t or "", add_special_tokens=False).ids, packing.END_ID], "<u4")
        mine = (got[got["doc_id"].isna()] if d is None else got[got["doc_id"] == d]).sort_values("piece")
        assert mine["length"].sum() == len(ids) and (mine["start"] == mine["length"].cumsum() - mine["length"]).all(), d
        assert [zlib.crc32(ids[a : a + n].tobytes()) for a, n in zip(mine["start"], mine["length"], strict=True)] == mine["ids_crc32"].tolist(), d
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert g["length"].sum() <= packing.CAPACITY and (g["offset"] == g["length"].cumsum() - g["length"]).all()


def test_substring_distance_matches_the_table():
    rng = random.Random(5)
    for _ in range(100):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(1, 40))) for _ in "ab")
        assert substring_distance(a, b) == semi_distance(a, b)


def test_line_stage_spares_whole_copies(spark, folder):
    rows, *_ = corpus()
    got = {r["doc_id"]: r for r in corpus_pipeline.line_dedup_stage(spark, common.documents(spark, folder), folder).collect()}
    assert all(got[k]["text"] == dict((r[0], r[1]) for r in rows)[4] for k in range(310, 316))
    assert not any("All rights of this site" in (r["text"] or "") for r in got.values())
    assert all(r["n_chars"] == len(r["text"]) for k, r in got.items() if r["text"] is not None and k is not None)


def test_stages_keep_the_columns(spark, folder):
    docs = common.documents(spark, folder)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, folder).columns == docs.columns


def test_pipeline_of_empty_tables(spark, tmp_path):
    for name, schema in (("documents", SCHEMA), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_bear_columns_with_their_own_names(spark, folder):
    from pyspark.sql import functions as F

    own = {c: F.lit(7) for c in ("best", "several", "_best", "stage_lines", "stage_dropped", "TEXT_DIGEST", "parts", "kept", "row", "item", "class_id", "n_copies")}
    docs = common.documents(spark, folder).withColumns(own)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, folder)
        assert got.columns == docs.columns, name
        plain = stage(spark, common.documents(spark, folder), folder)
        assert got.where(" or ".join(f"`{c}` is distinct from 7" for c in own)).isEmpty(), name
        assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect())), name

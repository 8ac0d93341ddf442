"""Small documents with the awkward cases that every operator has to bear."""

import random

import pytest

WORDS = "the of and rain river flood storm cell peak hour year grid soil water depth area level north south east".split()


def prose(rng: random.Random, n: int) -> str:
    out = [rng.choice(WORDS) + rng.choice(["", "", "s", "ed", "ing"]) + str(rng.randrange(60)) for _ in range(n)]
    return " ".join(w + ("." if rng.random() < 0.1 else "") + ("\n" if rng.random() < 0.05 else "") for w in out)


def table(spark, rows, extra=True):
    """rows of (doc_id, text[, lang[, source]]), with columns whose names clash with the operators' own."""
    full = [(r + (None, None))[:4] for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({"id": F.lit("x"), "n": F.lit(1), "hash": F.lit("h"), "node": F.lit(2.0), "part": F.lit("p"), "slot": F.lit(True), "places": F.lit(None).cast("string"), "best": F.lit("b")})
    return df


@pytest.fixture
def rows():
    """Prose, copies, near copies, shared passages, nulls, empty texts, repeated rows and one long text."""
    rng = random.Random(4)
    out = [(k, prose(rng, rng.randrange(20, 160)), "en", f"src{k % 3}") for k in range(60)]
    passage = prose(rng, 70)
    for k in range(60, 70):
        words = out[5][1].split(" ")
        words[k - 60] = f"changed{k}"
        out.append((k, " ".join(words), "en", "src0"))
    out += [(70, out[3][1], "en", "src1"), (71, out[3][1], "en", "src1"), (72, prose(rng, 30) + " " + passage + " " + prose(rng, 20), "en", "src2"), (73, passage + " " + prose(rng, 9), "en", "src2")]
    out += [(74, prose(rng, 6000), "en", "src0"), (75, None, None, None), (76, "", "en", None), (77, "   \n ", "en", "src1"), (78, "one two three", "en", "src1"), (79, "one two three", "en", "src1"), (79, "one two three", "en", "src1"), (None, prose(rng, 60), "en", "src2")]
    return out

"""Toxicity by a weighted finite-state grammar over clauses, with an insult lexicon learned from labels."""

from __future__ import annotations

import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ALNUM_SEP, NULL_ID, free_name, slices, window_hashes, word_hashes

#: Most labelled rows that the model is fitted on, chosen by hash; scoring covers every row.
FIT_ROWS = 40_000
#: Lengths of learned stems, least weight (a log ratio of document rates), and most lexicon entries kept.
STEMS, LEAST_WEIGHT, MOST_ENTRIES = (4, 5, 6), 2.5, 4000

#: Word classes of the grammar written by hand, in English, German, French and Spanish.
INSULT = "idiot moron loser scum trash stupid pathetic worthless imbecile dumbass bastard asshole idioten dummkopf arschloch abschaum versager trottel crétin connard salaud imbécile ordure abruti gilipollas estúpido basura escoria cabrón".split()
THREAT = (
    "kill kills killed killing hurt hurts hurting destroy destroys destroying beat beats beating shoot shoots shooting stab stabs stabbing strangle strangling "
    "töten töte tötet umbringen bringe schlagen schlage schlägt vernichten vernichte erschießen ersteche "
    "tuer tue tuerai tuerons frapper frappe frapperai détruire détruis détruirai buter buterai "
    "matar mato mata mataré mataremos golpear golpeo golpearé destruir destruyo destruiré disparar disparo dispararé"
).split()
TARGET = "you your yourself u du dich dir ihr euch dein tu te toi vous ton usted ustedes ti tus they them he she him her".split()
NEGATION = "not no never neither nor without isn aren wasn don nicht kein keine nie niemals ohne pas jamais sans aucun ningún nunca jamás sin tampoco".split()
REPORTED = "said says called wrote quoted claimed alleged reportedly sagte sagt nannte schrieb zitierte dit disait appelé écrit cité dijo dice llamó escribió citó".split()

CLAUSE_END = re.compile(r"[.!?;\n\r]")
TOKEN = re.compile(r"[^\W\d_]+|[\"“”«»„]")

# ------------------------------------------------ transducers: (state, symbol) -> (next state, output symbol, weight)

Arcs = dict[tuple[int, str], tuple[int, str, float]]

#: Reported speech: after a reporting verb or inside quotation marks, an insult or threat comes out as a reported one.
REPORT_FST: Arcs = {
    (0, "REPORT"): (1, "o", 0.0), (0, "QUOTE"): (2, "o", 0.0),
    (1, "INSULT"): (1, "INSULT_R", 0.0), (1, "THREAT"): (1, "THREAT_R", 0.0), (1, "QUOTE"): (2, "o", 0.0), (1, "REPORT"): (1, "o", 0.0),
    (2, "INSULT"): (2, "INSULT_R", 0.0), (2, "THREAT"): (2, "THREAT_R", 0.0), (2, "QUOTE"): (0, "o", 0.0), (2, "REPORT"): (2, "o", 0.0),
}
#: Negation holds for three words: what it covers comes out as negated.
NEGATION_FST: Arcs = {
    **{(s, "NEG"): (3, "o", 0.0) for s in range(4)},
    **{(s, x): (s - 1, f"{x}_N", 0.0) for s in (1, 2, 3) for x in ("INSULT", "THREAT")},
    **{(s, x): (s - 1, x, 0.0) for s in (1, 2, 3) for x in ("o", "TARGET", "INSULT_R", "THREAT_R", "QUOTE", "REPORT")},
}
#: Targets: an insult beside a target comes out as aimed (or the target does, if it comes later); a threat comes out only with its target, before or after it. States: nothing, target, insult, threat, both waiting for a target.
TARGET_FST: Arcs = {
    (0, "TARGET"): (1, "o", 0.0), (1, "TARGET"): (1, "o", 0.0), (2, "TARGET"): (1, "AIM", 0.0), (3, "TARGET"): (1, "THREAT_T", 0.0), (4, "TARGET"): (1, "AIM_THREAT", 0.0),
    (0, "INSULT"): (2, "INSULT", 0.0), (1, "INSULT"): (1, "INSULT_T", 0.0), (2, "INSULT"): (2, "INSULT", 0.0), (3, "INSULT"): (4, "INSULT", 0.0), (4, "INSULT"): (4, "INSULT", 0.0),
    (0, "THREAT"): (3, "o", 0.0), (1, "THREAT"): (1, "THREAT_T", 0.0), (2, "THREAT"): (4, "o", 0.0), (3, "THREAT"): (3, "o", 0.0), (4, "THREAT"): (4, "o", 0.0),
}
#: Insults: the first in a clause counts in full, further ones half, the first beside a target a quarter more; negated and reported ones little.
INSULT_FST: Arcs = {
    (0, "INSULT"): (1, "o", 1.0), (0, "INSULT_T"): (1, "o", 1.25), (1, "INSULT"): (1, "o", 0.5), (1, "INSULT_T"): (1, "o", 0.5), (1, "AIM"): (1, "o", 0.25), (1, "AIM_THREAT"): (1, "THREAT_T", 0.25),
    **{(s, f"INSULT_{k}"): (s, "o", 0.1) for s in (0, 1) for k in "NR"},
}
#: Threats: the first in a clause counts in full, further ones half; negated and reported ones not at all.
THREAT_FST: Arcs = {(0, "THREAT_T"): (1, "o", 1.0), (1, "THREAT_T"): (1, "o", 0.5)}


def compose(parts: list[Arcs], symbols: list[str]) -> dict[tuple[tuple, str], tuple[tuple, float]]:
    """One deterministic machine over tuples of states; a missing arc keeps the state and passes the symbol on."""
    start = (0,) * len(parts)
    out, todo = {}, [start]
    while todo:
        states = todo.pop()
        for symbol in symbols:
            x, weight, after = symbol, 0.0, []
            for arcs, s in zip(parts, states, strict=True):
                s, x, w = arcs.get((s, x), (s, x, 0.0))
                weight += w
                after.append(s)
            if (states, symbol) not in out:
                out[states, symbol] = (tuple(after), weight)
                todo.append(tuple(after))
    return out


MACHINES, SYMBOLS = [REPORT_FST, NEGATION_FST, TARGET_FST, INSULT_FST, THREAT_FST], ["o", "INSULT", "THREAT", "TARGET", "NEG", "REPORT", "QUOTE"]
GRAMMAR = compose(MACHINES, SYMBOLS)
_START = (0,) * len(MACHINES)
_CLASS = {**dict.fromkeys(TARGET, "TARGET"), **dict.fromkeys(NEGATION, "NEG"), **dict.fromkeys(REPORTED, "REPORT"), **dict.fromkeys(THREAT, "THREAT"), **dict.fromkeys('"“”«»„', "QUOTE")}


class Matcher:
    """Clauses of a text that hold an insult or threat, scored by the grammar."""

    def __init__(self, lexicon: dict[str, float]):
        """lexicon: weight by word, or by stem where the entry ends in an asterisk."""
        self.words = {k: v for k, v in lexicon.items() if not k.endswith("*")}
        self.stems = {k[:-1]: v for k, v in lexicon.items() if k.endswith("*")}
        self.keys = ahocorasick.Automaton()
        for k in {*self.words, *self.stems, *THREAT}:
            self.keys.add_word(k, len(k))
        self.keys.make_automaton()

    def weight(self, word: str) -> float:
        return max([self.words.get(word, 0.0), *(self.stems.get(word[:n], 0.0) for n in STEMS)])

    def clauses(self, text: str) -> Iterator[float]:
        """The score of each clause that the grammar matches: the machine runs over the whole clause, however long."""
        low, upto, ends = text.lower(), 0, None
        for end, size in self.keys.iter(low):
            at = end - size + 1
            if at < upto or (at and low[at - 1].isalpha()):
                continue
            if ends is None:
                ends = [-1, *(m.start() for m in CLAUSE_END.finditer(low)), len(low)]
            k = bisect_left(ends, at)
            upto = ends[k]
            if (score := self.clause(low[ends[k - 1] + 1 : upto])) > 0:
                yield score

    def clause(self, clause: str) -> float:
        state, total, most = _START, 0.0, 0.0
        for word in TOKEN.findall(clause):
            symbol = _CLASS.get(word, "o")
            if symbol in ("o", "THREAT") and (w := self.weight(word)) > 0:
                symbol, most = "INSULT", max(most, w)
            state, weight = GRAMMAR[state, symbol]
            total += weight
        return total * (most or 4.0)

    def features(self, text: str) -> tuple[float, float]:
        """The best clause's score, and the logarithm of how many match."""
        found = list(self.clauses(text))
        return (max(found), float(np.log1p(len(found)))) if found else (0.0, 0.0)


def learns(key: str = "doc_id"):
    """Rows that labels may be learned from: crc32 of the id as text, modulo 3, is not 1."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % 3 != 1


def bounded_sample(df: DataFrame, key: str, most: int) -> DataFrame:
    """About `most` rows by hash of the id, or all if there are fewer: a row-wise filter, after a count."""
    n = df.count()
    return df if n <= most else df.where(F.pmod(F.xxhash64(F.lit("fit"), F.col(key)), F.lit(1_000_000)) < int(1_000_000 * most / n))


def _keys_of(text: str) -> set[str]:
    words = set(re.findall(r"[^\W\d_]{3,}", text.lower()))
    return words | {w[:n] + "*" for w in words for n in STEMS if len(w) > n}


def _counted(rows: DataFrame, only: dict[str, int] | None = None) -> DataFrame:
    """In how many of the rows' texts (distinct by min-hash) each word and stem is."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(iter(batches)):
            got: Counter = Counter()
            for t in s.column("text").to_pylist():
                got.update(_keys_of(t or "") if only is None else [k for k in _keys_of(t or "") if k in only])
            yield pa.record_batch([pa.array(list(got), pa.string()), pa.array(list(got.values()), pa.int64())], ["key", "n"])

    return rows.select("text").mapInArrow(count, "key string, n long").groupBy("key").agg(F.sum("n").alias("n"))


def _one_per_copy(rows: DataFrame) -> DataFrame:
    """Of rows with the same smallest shingle hash and label, the one with the smallest id: copies are not counted as support."""

    def least(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(iter(batches)):
            h, first = word_hashes(s.column("text"), ALNUM_SEP, True)
            w = window_hashes(h, 5)
            low = [int(w[a : b - 4].min().view(np.int64)) if b - a >= 5 else int(np.bitwise_xor.reduce(h[a:b]).view(np.int64)) if b > a else -1 for a, b in zip(first[:-1], first[1:], strict=True)]
            yield pa.record_batch([s.column("doc_id"), s.column("toxic"), pa.array(low, pa.int64())], ["doc_id", "toxic", "low"])

    ids = rows.mapInArrow(least, "doc_id long, toxic int, low long").groupBy("low", "toxic").agg(F.min("doc_id").alias("doc_id")).select("doc_id")
    return rows.join(ids, "doc_id", "left_semi")


def fit(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> dict:
    """The model: a lexicon {entry: weight} and three coefficients. From at most `most` labelled rows, held-out rows left out."""
    marked = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic")).where(learns())
    marked = bounded_sample(marked, "doc_id", most)
    # a bounded number of ids: the join reads the texts where they are
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(marked), "doc_id")
    rows = _one_per_copy(rows)
    n = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    lexicon = dict.fromkeys(INSULT, 4.0)
    if n1 and n0:
        least = max(4, n1 // 100)
        some = {r["key"]: r["n"] for r in _counted(rows.where("toxic = 1")).where(F.col("n") >= least).orderBy(F.desc("n"), "key").limit(20 * MOST_ENTRIES).collect()}
        clean = {r["key"]: r["n"] for r in _counted(rows.where("toxic = 0"), some).collect()}
        weight = {k: float(min(8.0, np.log((v + 0.5) / (n1 + 1)) - np.log((clean.get(k, 0) + 0.5) / (n0 + 1)))) for k, v in some.items()}
        # a stem has to be in clearly more texts than any one word that it begins: else that word is what was learned
        longest: Counter = Counter()
        for k, v in some.items():
            for n_ in STEMS:
                if not k.endswith("*") and len(k) > n_:
                    longest[k[:n_] + "*"] = max(longest[k[:n_] + "*"], v)
        best = sorted((k for k, w in weight.items() if w >= LEAST_WEIGHT and clean.get(k, 0) <= some[k] and 2 * some[k] >= 3 * longest[k]), key=lambda k: (-weight[k] * np.log1p(some[k]), k))[:MOST_ENTRIES]
        lexicon |= {k: weight[k] for k in best}
    matcher = Matcher(lexicon)
    seen = [(1.0, *f, r["toxic"]) for r in _featured(rows, lexicon).select("best", "several", "toxic").collect() for f in [(r["best"], r["several"])]] if n1 and n0 else [(1.0, 0.0, 0.0, 0), (1.0, matcher.weight("idiot"), 0.69, 1)]
    x, y = np.array([r[:3] for r in seen]), np.array([r[3] for r in seen], float)
    beta = np.zeros(3)
    for _ in range(25):  # Newton steps of a logistic regression with a small ridge
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        beta += np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(3), x.T @ (y - p) - 0.05 * beta)
    return {"lexicon": lexicon, "beta": [float(b) for b in beta]}


def _featured(rows: DataFrame, lexicon: dict[str, float]) -> DataFrame:
    """rows and the grammar's two features of `text`."""
    model = json.dumps(lexicon)
    names = [c for c in rows.columns if c != "text"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(json.loads(model))
        for s in slices(iter(batches)):
            got = np.array([matcher.features(t or "") for t in s.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.record_batch([*(s.column(c) for c in names), pa.array(got[:, 0]), pa.array(got[:, 1])], [*names, "best", "several"])

    fields = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes if c != "text")
    return rows.mapInArrow(run, f"{fields}, best double, several double")


def score(docs: DataFrame, model: dict) -> DataFrame:
    """Every row's id and score, 0 to 1. The score depends on the text alone."""
    b0, b1, b2 = model["beta"]
    z = F.lit(b0) + F.lit(b1) * F.col("best") + F.lit(b2) * F.col("several")
    return _featured(docs.select("doc_id", "text"), model["lexicon"]).select("doc_id", (F.lit(1.0) / (F.lit(1.0) + F.exp(-z))).alias("score"))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    The grammar composes insult, threat, target, negation and reported-speech
    transducers and scores clauses, not words. Its insult lexicon (words and
    stems) is learned from labelled rows that are not held out; copies of a text
    count once. Null and empty texts match nothing and get the lowest score; rows
    with null ids are scored as well; repeated rows are scored one by one; without
    usable labels the hand-written lexicon stands alone.
    """
    got = score(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), fit(docs, labels))
    return got.select("doc_id", (~learns()).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """Rows whose text scores below the threshold, with their columns. Scored where they stand, without a shuffle."""
    model = fit(docs, labels)
    b0, b1, b2 = model["beta"]
    best, several = free_name(docs, "best"), free_name(docs, "several")
    z = F.lit(b0) + F.lit(b1) * F.col(best) + F.lit(b2) * F.col(several)
    lexicon, names = json.dumps(model["lexicon"]), docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(json.loads(lexicon))
        for s in slices(iter(batches)):
            got = np.array([matcher.features(t or "") for t in s.column("text").to_pylist()]).reshape(-1, 2)
            yield pa.record_batch([*s.columns, pa.array(got[:, 0]), pa.array(got[:, 1])], [*names, best, several])

    fields = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes)
    return docs.mapInArrow(run, f"{fields}, {best} double, {several} double").where(F.lit(1.0) / (F.lit(1.0) + F.exp(-z)) < threshold).select(*names)


__all__ = ["fit", "score", "toxicity", "drop_toxic", "learns", "bounded_sample", "Matcher", "compose", "GRAMMAR", "FIT_ROWS", "NULL_ID"]

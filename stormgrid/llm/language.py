"""Language of texts by a linear-chain conditional random field over words."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, written
from .toxicity import bounded_sample, learns

#: Labelled rows that the feature tables are counted on, rows whose words make the training sequences, features kept of each template.
FIT_ROWS, SEQUENCE_ROWS, MOST_FEATURES = 20_000, 300, 40_000
#: Feature templates: lexicon, prefix, suffix, n-grams.
TEMPLATES = ("lexicon", "prefix", "suffix", "ngram")
#: Words whose emissions a worker remembers.
REMEMBERED = 200_000

#: Letters of words that a worker remembers.
REMEMBERED_LETTERS = 8_000_000

_RUN = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters, lower-cased. Fractions, superscripts and letter-like numerals are not letters."""
    found = _RUN.findall(text.lower())
    if all(map(str.isalpha, found)):
        return found
    return [x for w in found for x in ([w] if w.isalpha() else "".join(c if c.isalpha() else " " for c in w).split())]


def features(word: str) -> list[tuple[int, str]]:
    """(template, value) of a lower-case word, of any length."""
    edged = f"^{word}$"
    return [(0, word), (1, word[:3]), (2, word[-3:]), *((3, edged[k : k + 3]) for k in range(len(edged) - 2))]


def _forward_backward(z: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Of sequences of one length (scores z: b, t, k): posteriors of labels, of label pairs, and the log of the partition functions, summed."""
    top = z.max(2, keepdims=True)
    emit, move = np.exp(z - top), np.exp(moves)
    ahead, back, log = np.empty_like(emit), np.ones_like(emit), float(top.sum())
    for i in range(z.shape[1]):
        a = emit[:, i] * (ahead[:, i - 1] @ move if i else 1.0)
        size = a.sum(1, keepdims=True)
        ahead[:, i], log = a / size, log + float(np.log(size).sum())
    for i in range(z.shape[1] - 2, -1, -1):
        a = (emit[:, i + 1] * back[:, i + 1]) @ move.T
        back[:, i] = a / a.sum(1, keepdims=True)
    post = ahead * back
    pair = ahead[:, :-1, :, None] * move * (emit[:, 1:] * back[:, 1:])[:, :, None, :]
    return post / post.sum(2, keepdims=True), pair / pair.sum((2, 3), keepdims=True), log


class Crf:
    """A weight for each feature and label, a bias per label, and transitions."""

    def __init__(self, labels: list[str], tables: list[dict[str, int]], weights: np.ndarray, bias=None, moves=None):
        """tables: for each template the row in `weights` of each feature value. Row 0 is the unknown feature's: zeros."""
        k = len(labels)
        self.labels, self.tables, self.weights = labels, tables, weights
        self.bias = np.zeros(k) if bias is None else bias
        self.moves = np.eye(k) if moves is None else moves

    def rows(self, word: str) -> list[tuple[int, float]]:
        """(row of weights, share) of a word's features: n-grams share one, as there are more of them in longer words."""
        found = [(self.tables[t].get(value, 0), t) for t, value in features(word)]
        n = sum(t == 3 for _, t in found)
        return [(row, 1.0 if t < 3 else 1.0 / n) for row, t in found]

    def objective(self, words: list[str], x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Log-likelihood of the labels y of sequences x (numbers of `words`), and its gradients by weights, bias and moves: observed minus expected, by forward-backward."""
        row, share, word = (np.array(c) for c in zip(*((r, c, k) for k, w in enumerate(words) for r, c in self.rows(w)), strict=True))
        k = len(self.labels)
        score = np.stack([np.bincount(word, share * self.weights[row, j], len(words)) for j in range(k)], 1) + self.bias
        z = score[x]
        post, pair, log = _forward_backward(z, self.moves)
        hot = np.eye(k)[y]
        both = np.einsum("btj,btl->jl", hot[:, :-1], hot[:, 1:])
        off = hot - post
        by_word = np.stack([np.bincount(x.ravel(), off[:, :, j].ravel(), len(words)) for j in range(k)], 1)
        by_row = np.stack([np.bincount(row, share * by_word[word, j], len(self.weights)) for j in range(k)], 1)
        by_row[0] = 0
        return float((z * hot).sum() + (both * self.moves).sum()) - log, by_row, off.sum((0, 1)), both - pair.sum((0, 1))

    def fit(self, sequences: list[tuple[list[str], list[int]]], steps: int = 60, rate: float = 0.1, ridge: float = 1e-2) -> None:
        """Gradient ascent (AdaGrad) on the conditional likelihood of labelled sequences of one length; a ridge holds the weights near where they began."""
        words = sorted({w for text, _ in sequences for w in text})
        number = {w: k for k, w in enumerate(words)}
        x, y = np.array([[number[w] for w in text] for text, _ in sequences]), np.array([tags for _, tags in sequences])
        values = (self.weights, self.bias, self.moves)
        begin, total = [v.copy() for v in values], [np.zeros_like(v) for v in values]
        for _ in range(steps):
            _, *gradients = self.objective(words, x, y)
            for value, first, seen, g in zip(values, begin, total, gradients, strict=True):
                g = g / len(sequences) - ridge * (value - first)
                seen += g**2
                value += rate * g / np.sqrt(seen + 1e-9)

    def emissions(self):
        """A function words -> emissions (words x labels): the weights of each word's features are looked up and summed for all words at once."""
        value = self.weights.astype(np.float32)
        lexicon, prefix, suffix, ngram = (x.get for x in self.tables)

        def run(words: list[str]) -> np.ndarray:
            single, grams, begin = [], [], []
            for w in words:
                single += (lexicon(w, 0), prefix(w[:3], 0), suffix(w[-3:], 0))
                begin.append(len(grams))
                e = f"^{w}$"
                grams += [ngram(e[k : k + 3], 0) for k in range(len(e) - 2)]
            n = np.diff(np.append(begin, len(grams)))[:, None]
            z = value[single].reshape(len(words), 3, -1).sum(1) + np.add.reduceat(value[grams], begin) / n + self.bias
            return np.exp(z - z.max(1, keepdims=True)).astype(np.float32)

        return run


def posteriors(emit: np.ndarray, first: np.ndarray, move: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean posterior of the labels over each sequence's words, and each word's likeliest label, by forward-backward over all sequences at once.

    emit: words x labels of all sequences behind one another; first: where each begins (one more entry at the end).
    Words are laid out by place, longest sequence first, so each step is one slice.
    """
    size = np.diff(first)
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(size), np.int64)
    rank[order] = np.arange(len(size))
    place = np.arange(first[-1]) - np.repeat(first[:-1], size)
    at = np.lexsort((np.repeat(rank, size), place))
    e = emit[at]
    longest = int(size.max(initial=0))
    cut = np.searchsorted(place[at], np.arange(longest + 1))
    move = move.astype(np.float32)
    ahead, back = e.copy(), np.ones_like(e)
    for i in range(longest):
        a = ahead[cut[i] : cut[i + 1]]
        if i:
            a *= ahead[cut[i - 1] : cut[i - 1] + len(a)] @ move
        a /= a.sum(1, keepdims=True)
    for i in range(longest - 2, -1, -1):
        n = cut[i + 2] - cut[i + 1]
        a = (e[cut[i + 1] : cut[i + 2]] * back[cut[i + 1] : cut[i + 2]]) @ move.T
        back[cut[i] : cut[i] + n] = a / a.sum(1, keepdims=True)
    ahead *= back
    ahead /= ahead.sum(1, keepdims=True)
    out = np.zeros((len(size), emit.shape[1]))
    by = np.repeat(np.arange(len(size)), size)[at]
    for k in range(emit.shape[1]):
        out[:, k] = np.bincount(by, ahead[:, k], len(size))
    tags = np.empty(len(at), np.int64)
    tags[at] = ahead.argmax(1)
    return out / np.maximum(size, 1)[:, None], tags


def fit(docs: DataFrame, key: str = "doc_id", most: int = FIT_ROWS) -> Crf | None:
    """A model from rows with a language that are not held out: features and their first weights counted by Spark over at most `most` rows, then all weights and transitions fitted on code-switched sequences from some of them. None without any such row."""
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), "text", "lang").where("lang is not null and text is not null").where(learns())
    rows = bounded_sample(rows, "doc_id", most)

    def words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in slices(iter(batches)):
            got: Counter = Counter()
            for lang, text in zip(s.column("lang").to_pylist(), s.column("text").to_pylist(), strict=True):
                got.update((lang, w) for w in words_of(text))
            yield pa.record_batch([pa.array([k[0] for k in got], pa.string()), pa.array([k[1] for k in got], pa.string()), pa.array(list(got.values()), pa.int64())], ["lang", "word", "n"])

    def parts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in batches:
            got: Counter = Counter()
            for lang, word, n in zip(*(c.to_pylist() for c in s.columns), strict=True):
                for f in features(word):
                    got[lang, f] += n
            yield pa.record_batch([pa.array([k[0] for k in got], pa.string()), pa.array([k[1][0] for k in got], pa.int32()), pa.array([k[1][1] for k in got], pa.string()), pa.array(list(got.values()), pa.int64())], ["lang", "template", "value", "n"])

    counted = rows.select("lang", "text").mapInArrow(words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    by = counted.mapInArrow(parts, "lang string, template int, value string, n long").groupBy("template", "value", "lang").agg(F.sum("n").alias("n"))
    by = written(by.groupBy("template", "value").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("lang", "n"))).alias("by")).where("n >= 2"), "features")  # a group holds one row per language
    found = [r for t in range(len(TEMPLATES)) for r in by.where(F.col("template") == t).orderBy(F.desc("n"), "value").limit(MOST_FEATURES).collect()] if most else []
    labels = sorted({k for r in found for k in r["by"]})
    if not labels:
        return None
    total = np.ones((len(TEMPLATES), len(labels)))
    for r in found:
        total[r["template"]] += [r["by"].get(k, 0) for k in labels]
    tables: list[dict[str, int]] = [{} for _ in TEMPLATES]
    weights = np.zeros((len(found) + 1, len(labels)))
    for k, r in enumerate(found, 1):  # weights begin as log shares
        share = np.log((np.array([r["by"].get(x, 0) for x in labels]) + 0.1) / total[r["template"]])
        weights[k] = np.clip(share - share.mean(), -6, 6)
        tables[r["template"]][r["value"]] = k
    model = Crf(labels, tables, weights)
    some = bounded_sample(rows, "doc_id", SEQUENCE_ROWS).select("lang", "text").limit(2 * SEQUENCE_ROWS).collect()  # a bounded number of rows
    if len(labels) > 1:
        model.fit(_switched({k: [w for r in some if r["lang"] == k for w in words_of(r["text"])] for k in labels}, labels))
    return model


def _switched(words: dict[str, list[str]], labels: list[str], n: int = 240, length: int = 60) -> list[tuple[list[str], list[int]]]:
    """Code-switched sequences: spans of 8 to 30 words of changing languages, one behind the other."""
    rng, out = np.random.default_rng(9), []
    full = [k for k, name in enumerate(labels) if words[name]]
    for _ in range(n if full else 0):
        text: list[str] = []
        tags: list[int] = []
        while len(text) < length:
            k = int(rng.choice(full))
            at, size = int(rng.integers(len(words[labels[k]]))), int(rng.integers(8, 31))
            span = words[labels[k]][at : at + size]
            text += span
            tags += [k] * len(span)
        out.append((text[:length], tags[:length]))
    return out


def language(docs: DataFrame, key: str = "doc_id", model: Crf | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, switched, spans of every row.

    All words of a text get posteriors by forward-backward; the language is the
    one with the highest mean posterior, which is the score (ties: the first
    label). `switched` is the share of the second language; `spans` labels the
    words of code-switched texts: (start, words, lang) for each run of words with
    one likeliest label, words counted from 0. Null texts and texts
    without a letter are `und` with score 0, as all are where no row has a
    language to learn from. Repeated rows are judged one by one.
    """
    model = model or fit(docs, key)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of bounded size: MOST_FEATURES per template

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        crf = shared.value
        move = np.exp(crf.moves) if crf else None
        emit = crf.emissions() if crf else None
        number: dict[str, int] = {}
        letters = 0
        table = np.zeros((0, len(crf.labels) if crf else 1), np.float32)
        for s in slices(batches, most=2 << 20):
            found = [words_of(t) if t and crf else [] for t in s.column("text").to_pylist()]
            first = np.cumsum([0, *map(len, found)])
            if len(number) > REMEMBERED or letters > REMEMBERED_LETTERS:
                number, table, letters = {}, table[:0], 0
            new = list(dict.fromkeys(w for words in found for w in words if w not in number))
            if new:
                number.update(zip(new, range(len(number), len(number) + len(new)), strict=True))
                table = np.concatenate((table, emit(new)))
                letters += sum(map(len, new))
            ids = [number[w] for words in found for w in words]
            size = np.diff(first)
            mean, tags = posteriors(table[ids], first, move) if ids else (np.zeros((len(size), table.shape[1])), np.zeros(0, np.int64))
            best = mean.argmax(1)
            names = [crf.labels[k] if n else "und" for k, n in zip(best, size, strict=True)] if crf else ["und"] * len(size)
            score = np.where(size > 0, np.clip(mean[np.arange(len(size)), best], 0, 1), 0.0)
            second = np.sort(mean, 1)[:, -2] if mean.shape[1] > 1 else np.zeros(len(size))
            turn = np.ones(len(tags), bool)
            turn[1:] = tags[1:] != tags[:-1]
            turn[first[:-1][size > 0]] = True
            begin = np.flatnonzero(turn)
            held = np.searchsorted(begin, first).astype(np.int32)
            of = np.searchsorted(first, begin, side="right") - 1
            lang = pa.DictionaryArray.from_arrays(pa.array(tags[begin].astype(np.int32)), pa.array(crf.labels if crf else [""])).cast(pa.string())
            span = pa.StructArray.from_arrays([pa.array((begin - first[of]).astype(np.int32)), pa.array(np.diff(np.append(begin, len(tags))).astype(np.int32)), lang], ["start", "words", "lang"])
            yield pa.record_batch([s.column("doc_id"), pa.array(names, pa.string()), pa.array(score), pa.array(np.clip(second, 0, 1)), pa.ListArray.from_arrays(pa.array(held), span)], ["doc_id", "lang_pred", "score", "switched", "spans"])

    got = docs.select(F.col(key).cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double, switched double, spans array<struct<start:int,words:int,lang:string>>")
    return got.select("doc_id", (~learns()).alias("held_out"), "lang_pred", "score", "switched", "spans")

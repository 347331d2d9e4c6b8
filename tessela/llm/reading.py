"""The reading level of documents, by regularised ordinal regression.

The unit is a sentence. Its features are lexical diversity, word rarity,
connectives, a proxy of clause depth (words that open a clause within another),
and lengths. A proportional-odds model with a ridge penalty is fitted to the
sentences of the graded reference texts. A document's place on the scale is the
median of its sentences', weighted by words, so that a foreign insertion of less
than half of the prose doesn't move it.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessela.llm.batches import pieces, spread
from tessela.llm.prose import FUNCTION_WORDS, prose
from tessela.storage import materialise

LEAST_WORDS = 60  # words of English prose that a document must have
WORDS = 200_000  # words whose share in the corpus is sent to the workers, the most frequent ones; others are as rare as the rarest of these
SAMPLE = 20_000  # graded texts used for fitting, at most: those of the least hashes of their ids
RIDGE = 0.02  # weight of the penalty on the squared coefficients, per unit

#: Words that tie clauses and sentences together, and those that open a clause within another.
CONNECTIVES = frozenset(
    b"""although because consequently despite furthermore hence however insofar moreover nevertheless notwithstanding
    otherwise since so then therefore thereby though thus unless until whereas whereby while yet and but or""".split()
)
SUBORDINATORS = frozenset(
    b"""after although as because before if insofar once since that though unless until when where whereas whereby wherein
    whether which while who whom whose""".split()
)
FEATURES = ("log_sentence", "word_length", "long_words", "syllables", "function_words", "connectives", "clause_depth", "rarity", "diversity")


def _syllables(word: bytes) -> int:
    n, inside = 0, False
    for c in word:
        vowel = c in b"aeiouy"
        n += vowel and not inside
        inside = vowel
    return max(1, n)


class _Rows(dict):
    """From a word to its row in a table of word features that grows as words come up."""

    def __init__(self, counts: dict[bytes, int], total: int) -> None:
        self.counts, self.total = counts, total + len(counts) + 1
        self.least = min(counts.values(), default=0) if len(counts) >= WORDS else 0
        self.table = np.zeros((1024, 7))

    def __missing__(self, w: bytes) -> int:
        row = len(self)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        rarity = -math.log((self.counts.get(w, self.least) + 1) / self.total)
        self.table[row] = len(w), len(w) >= 9, _syllables(w), w in FUNCTION_WORDS, w in CONNECTIVES, w in SUBORDINATORS, rarity
        self[w] = row
        return row


class Features:
    """Unit features; ``rarity`` is minus the log of a word's share of ``total`` words, of which ``counts`` knows the frequent ones."""

    def __init__(self, counts: dict[bytes, int], total: int | None = None) -> None:
        self.counts, self.total = counts, sum(counts.values()) if total is None else total
        self.rows = _Rows(self.counts, self.total)

    def __getstate__(self) -> dict:
        return {"counts": self.counts, "total": self.total}

    def __setstate__(self, state: dict) -> None:
        self.__init__(**state)

    def units(self, sentences: Sequence[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Features and number of words of each sentence; none may be empty."""
        if len(self.rows) > 500_000:
            self.rows = _Rows(self.counts, self.total)
        rows = self.rows
        at = [rows[w] for s in sentences for w in s]
        n = np.array([len(s) for s in sentences], float)
        sums = np.add.reduceat(rows.table[at], np.r_[0, np.cumsum(n)[:-1].astype(int)], axis=0)
        distinct = np.array([len(set(s)) for s in sentences])
        length, long, syllables, function, connective, sub, rare = sums.T
        return np.stack([np.log(n), length / n, long / n, syllables / n, function / n, connective, sub, rare / n, distinct / np.sqrt(n)], axis=1), n


def fit_ordinal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = RIDGE, rounds: int = 1500) -> tuple[np.ndarray, np.ndarray]:
    """Coefficients and increasing cut points of P(y <= k) = logistic(cut_k - x w); y from 0 without gaps.

    Minimises the weighted mean of the negative log likelihood plus the ridge by
    gradient steps of adaptive size, from the same start: the result is
    reproducible.
    """
    k = int(y.max())
    theta = np.r_[np.zeros(x.shape[1]), -1.0, np.zeros(k - 1)] if k else np.zeros(x.shape[1])
    if not k:
        return theta, np.zeros(0)
    weight = weight / weight.sum()
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    nx = x.shape[1]

    def cuts(t: np.ndarray) -> np.ndarray:
        return np.cumsum(np.r_[t[nx], np.exp(t[nx + 1 :])])

    rows = np.arange(len(y))
    for step in range(1, rounds + 1):
        c = cuts(theta)
        edge = np.c_[np.full(len(y), -np.inf), c[None, :] - (x @ theta[:nx])[:, None], np.full(len(y), np.inf)]
        with np.errstate(over="ignore"):
            p = 1 / (1 + np.exp(-edge))
        slope = p * (1 - p)
        like = np.maximum(p[rows, y + 1] - p[rows, y], 1e-12)
        up, low = slope[rows, y + 1] / like * weight, slope[rows, y] / like * weight
        by_cut = np.zeros(k + 2)
        np.add.at(by_cut, y + 1, -up)
        np.add.at(by_cut, y, low)
        by_cut = by_cut[1 : k + 1]
        tail = np.cumsum(by_cut[::-1])[::-1]
        grad = np.r_[x.T @ (up - low) + 2 * ridge * theta[:nx] / 10, tail[0], tail[1:] * np.exp(theta[nx + 1 :])]
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad**2
        theta = theta - 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    return theta[:nx], cuts(theta)


def weighted_median(score: np.ndarray, weight: np.ndarray) -> float:
    """The least score that at least half of the weight doesn't exceed."""
    order = np.argsort(score, kind="stable")
    upto = np.cumsum(weight[order])
    return float(score[order][np.searchsorted(upto, upto[-1] / 2)])


class Model:
    """The fitted scale: text to score and level.

    ``words``: the counts of a corpus' words and their total; those of the
    graded texts by default.
    """

    def __init__(self, texts: Sequence[tuple[str, int]], words: tuple[dict[bytes, int], int] | None = None) -> None:
        split = [(prose(t), g) for t, g in texts if t and g is not None]
        split = [(s, g) for s, g in split if s]
        if not split:
            raise ValueError("no graded text holds English prose")
        self.features = Features(*(words or (Counter(w for s, _ in split for x in s for w in x),)))
        self.levels = sorted({g for _, g in split})
        parts = [self.features.units(s) for s, _ in split]
        grade = np.array([self.levels.index(g) for _, g in split])
        x, n = (np.concatenate(p) for p in zip(*parts))
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-9)
        self.w, _ = fit_ordinal((x - self.mean) / self.scale, np.repeat(grade, [len(p) for _, p in parts]), n)
        self.cuts = np.zeros(0)
        if len(self.levels) > 1:  # the cut points are calibrated on whole texts, as they are applied
            whole = np.array([[weighted_median(self.scores(a), b)] for a, b in parts])
            spread = max(float(whole.std()), 1e-9)
            slope, cuts = fit_ordinal(whole / spread, grade, np.ones(len(parts)), ridge=1e-4)
            self.cuts = cuts * spread / max(float(slope[0]), 1e-9)

    def scores(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.w

    def grades(self, texts: Sequence[str | None]) -> list[tuple[int, float, int] | None]:
        """Words of English prose, score and level of each text; None below ``LEAST_WORDS``."""
        split = [prose(t) if t else [] for t in texts]
        words = [sum(map(len, s)) for s in split]
        enough = [i for i, n in enumerate(words) if n >= LEAST_WORDS]
        out: list[tuple[int, float, int] | None] = [None] * len(texts)
        if enough:
            x, n = self.features.units([s for i in enough for s in split[i]])
            score, at = self.scores(x), 0
            for i in enough:
                end = at + len(split[i])
                mid = weighted_median(score[at:end], n[at:end])
                out[i] = words[i], mid, self.levels[int(np.searchsorted(self.cuts, mid))]
                at = end
        return out


def word_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, n``: how often each word occurs in the English prose of all documents; counted in the tasks before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["word", "n"])

        seen: Counter[bytes] = Counter()
        for part in pieces(batches, 0):
            for text in part.column(0).to_pylist():
                for sentence in prose(text):
                    seen.update(sentence)
            if len(seen) > WORDS:
                yield rows()
                seen.clear()
        yield rows()

    return spread(docs.select(text_col).where(F.length(text_col) > 0)).mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def corpus_words(docs: DataFrame, text_col: str = "text") -> tuple[dict[bytes, int], int]:
    """The counts of the ``WORDS`` most frequent words, and the number of all words, of the documents' prose."""
    counts = materialise(word_counts(docs, text_col), "words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    best = counts.orderBy(F.desc("n"), "word").limit(WORDS)
    return {r.word.encode(): r.n for r in best.toLocalIterator()}, total


def fit(graded: DataFrame, sample: int = SAMPLE, words: tuple[dict[bytes, int], int] | None = None) -> Model:
    """The model of the graded texts ``text, grade_level`` (``ref_id`` picks the sample) and a corpus' words; nulls don't count."""
    rows = graded.select("ref_id", "text", "grade_level").where("text IS NOT NULL AND grade_level IS NOT NULL")
    rows = rows.orderBy(F.xxhash64("ref_id"), "ref_id", "text").limit(sample)
    return Model([(r.text, r.grade_level) for r in rows.toLocalIterator()], words)


def reading_levels(docs: DataFrame, graded: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, score, grade_level`` of every document with enough English prose.

    Whole texts are read; null, empty and other texts give no row, repeated rows
    one row each. The texts are read twice: for the counts of their words, which
    say how rare a word is, and for their levels. Documents are not shuffled; the
    model is sent out, with the counts of ``WORDS`` words at most.
    """
    model = fit(graded, words=corpus_words(docs, text_col))
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for part in pieces(batches):
            found = [(i, g) for i, g in enumerate(m.grades(part.column(1).to_pylist())) if g]
            keys = part.column(0).take(pa.array([i for i, _ in found], pa.int64()))
            cols = [pa.array([g[j] for _, g in found], t) for j, t in ((0, pa.int32()), (1, pa.float64()), (2, pa.int32()))]
            yield pa.RecordBatch.from_arrays([keys, *cols], names=["doc_id", "n_words", "score", "grade_level"])

    return spread(docs.select(id_col, text_col).where(F.length(text_col) > 0)).mapInArrow(run, f"doc_id {kind}, n_words int, score double, grade_level int")

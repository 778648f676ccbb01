"""Toxicity: bags of subword embeddings, averaged, into a linear softmax, trained together in numpy.

A word's vector is the mean of the vectors of its hashed character n-grams (with its ends marked), so a
misspelling shares most of its vector with the word.  A text is read as segments of a few words; a segment's
vector is the mean over its words, and the text is as toxic as its most toxic segment, however long it is.
Labels are known for texts only: after a first round in which every segment bears its text's label, each
toxic text stands for its most toxic segments alone.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fold, per_batch, release, small_batches, text_or_empty
from riskloom.llm.labelled import labelled_texts
from riskloom.llm.quality import calibrate

BUCKETS = 1 << 15
_RUNS = re.compile(r"[^\W_]+(?:[@$!*'’][^\W_]+)*").findall
#: A longer run of letters (a script without blanks, joined text) is read as overlapping words of this length.
LONGEST_WORD = 32
#: Words whose part of the score a task remembers, of late and of before.
KEEP_WORDS = 80_000


def words_of(text: str) -> list[str]:
    """The words of a text in lower case; every 16 neighbouring characters of a long run are whole in one of its words."""
    runs = _RUNS(text.lower())
    if not runs or max(map(len, runs)) <= LONGEST_WORD:
        return runs
    half = LONGEST_WORD // 2
    return [r[i : i + LONGEST_WORD] for r in runs for i in range(0, max(1, len(r) - half), half)]


def subwords(word: str, shortest: int = 3, longest: int = 5) -> list[int]:
    """Hashed character n-grams of a word between its end marks."""
    b = f"<{word}>"
    crc = zlib.crc32
    grams = [b[i : i + n] for n in range(shortest, longest + 1) for i in range(max(1, len(b) - n + 1))] if not b.isascii() else []
    if grams:
        return [crc(g.encode()) % BUCKETS for g in grams]
    said = b.encode()  # a byte a character
    return [crc(said[i : i + n]) % BUCKETS for n in range(shortest, longest + 1) for i in range(max(1, len(said) - n + 1))]


def windows(values: np.ndarray, size: int) -> np.ndarray:
    """Means over every ``size`` neighbouring words; fewer words count as filled up with neutral ones."""
    if len(values) <= size:
        return values.sum(keepdims=True) / size
    ends = np.concatenate([[0.0], np.cumsum(values)])
    return (ends[size:] - ends[:-size]) / size


@dataclass
class ToxicModel:
    """``vectors``: one for each bucket; ``softmax``: two columns; ``slope``, ``shift``: the text's curve."""

    vectors: np.ndarray
    softmax: np.ndarray
    bias: float
    slope: float = 1.0
    shift: float = 0.0
    window: int = 6

    def scorer(self) -> Scorer:
        """What scores texts, with a memory of its own: to be dropped with the task."""
        return Scorer(self)

    def score(self, text: str) -> float:
        return Scorer(self)(text)


class Scorer:
    """Scores texts; the softmax is linear, so each word's part of the log-odds is worked out once and remembered."""

    def __init__(self, model: ToxicModel):
        self.model, self.said, self.earlier = model, {}, {}
        self.line = (model.vectors @ (model.softmax[:, 1] - model.softmax[:, 0])).tolist()

    def word(self, word: str) -> float:
        """What a word adds to the log-odds."""
        value = self.earlier.get(word)
        if value is None:
            grams = subwords(word)
            value = sum(map(self.line.__getitem__, grams)) / len(grams)
        if len(self.said) >= KEEP_WORDS:
            self.earlier, self.said = self.said, {}
        self.said[word] = value
        return value

    def margin(self, text: str) -> float:
        """Log-odds of the most toxic segment of the whole text."""
        words = words_of(text)
        if not words:
            return -20.0
        said, new = self.said.get, self.word
        values = np.array([v if (v := said(w)) is not None else new(w) for w in words])
        return float(windows(values, self.model.window).max()) + self.model.bias

    def __call__(self, text: str) -> float:
        m = self.model
        return float(1 / (1 + np.exp(-np.clip(m.slope * self.margin(text) + m.shift, -30, 30))))


class _Trainer:
    """AdaGrad on segments, given as rows of word numbers (-1: none)."""

    def __init__(self, words: list[str], size: int, window: int, seed: int = 11):
        rng = np.random.default_rng(seed)
        ids = [subwords(w) for w in words]
        self.counts = np.array([len(x) for x in ids])
        self.starts = np.concatenate([[0], np.cumsum(self.counts)])
        self.ids = np.fromiter((i for x in ids for i in x), np.int32, int(self.counts.sum()))
        self.vectors = rng.uniform(-1 / size, 1 / size, (BUCKETS, size)).astype(np.float32)
        self.softmax = np.stack([-np.ones(size), np.ones(size)], 1).astype(np.float32) * 0.1
        self.bias, self.window = 0.0, window
        self.seen_v, self.seen_s = np.full(BUCKETS, 1e-4, np.float32), np.full(size, 1e-4, np.float32)

    def line(self) -> np.ndarray:
        """Each word's addition to the log-odds."""
        each = (self.vectors @ (self.softmax[:, 1] - self.softmax[:, 0]))[self.ids]
        return np.add.reduceat(each, self.starts[:-1]) / self.counts if len(self.counts) else each

    def step(self, segments: np.ndarray, y: np.ndarray, weight: np.ndarray, rate: float) -> None:
        words, place = np.unique(segments[segments >= 0], return_inverse=True)
        rows = np.repeat(np.arange(len(segments)), (segments >= 0).sum(1))
        n = self.counts[words]
        flat = np.concatenate([self.ids[self.starts[w] : self.starts[w + 1]] for w in words])
        owner = np.repeat(np.arange(len(words)), n)
        vec = np.add.reduceat(self.vectors[flat], np.concatenate([[0], np.cumsum(n)[:-1]])) / n[:, None]
        bag = np.zeros((len(segments), vec.shape[1]), np.float32)
        np.add.at(bag, rows, vec[place])
        bag /= self.window
        u = self.softmax[:, 1] - self.softmax[:, 0]
        miss = (1 / (1 + np.exp(-np.clip(bag @ u + self.bias, -30, 30))) - y) * weight
        to_u = bag.T @ miss
        to_word = np.bincount(place, miss[rows], len(words)) / self.window / n
        buckets, at = np.unique(flat, return_inverse=True)
        pull = np.bincount(at, to_word[owner], len(buckets))
        grad = pull[:, None].astype(np.float32) * u[None, :]
        self.seen_v[buckets] += (grad**2).mean(1)
        self.vectors[buckets] -= rate * grad / np.sqrt(self.seen_v[buckets])[:, None]
        self.seen_s += to_u**2
        move = (rate * 0.5 * to_u / np.sqrt(self.seen_s)).astype(np.float32)
        self.softmax[:, 1] -= move
        self.softmax[:, 0] += move
        self.bias -= rate * float(miss.mean())


def fit(texts: list[str], labels: list[int], share_toxic: float | None = None, size: int = 12, window: int = 6, rounds: int = 6, rate: float = 0.1, clean_segments: int = 24) -> ToxicModel:
    """Trains in rounds on segments of ``window`` neighbouring words of a bounded sample of texts.

    A toxic text gives all its segments at first, then those that look most toxic, wherever they begin.  Any other text
    gives ``clean_segments`` drawn ones (its share of the bounded sample), and from the second round on also the
    segment of its whole text that looks most toxic.
    """
    y = np.array(labels, int)
    if len(set(y.tolist())) < 2:
        sure = 0.5 if not len(y) else (0.99 if y[0] else 0.01)
        return ToxicModel(np.zeros((BUCKETS, 1), np.float32), np.zeros((1, 2), np.float32), 0.0, 0.0, float(np.log(sure / (1 - sure))), window)
    numbers: dict[str, int] = {}
    rng = np.random.default_rng(5)
    kept = []
    for text in texts:
        words = [numbers.setdefault(w, len(numbers)) for w in words_of(text)]
        kept.append(np.array(words + [-1] * (window - len(words)), np.int32))
    sizes = np.array([len(k) for k in kept])
    firsts, flat = np.concatenate([[0], np.cumsum(sizes)[:-1]]), np.concatenate(kept)
    begins = np.concatenate([np.arange(f, f + n - window + 1) for f, n in zip(firsts, sizes, strict=True)])
    of = np.repeat(np.arange(len(texts)), sizes - window + 1)
    trainer, toxic = _Trainer(list(numbers), size, window), y > 0
    ends = np.cumsum(sizes - window + 1)
    aligned = toxic[of] & ((begins - firsts[of]) % window == 0)
    aligned[ends - 1] |= toxic  # the last words, too
    drawn = np.zeros(len(of), bool)
    for t in np.flatnonzero(~toxic):
        n = sizes[t] - window + 1
        drawn[ends[t] - n + rng.choice(n, min(n, clean_segments), replace=False)] = True
    for round_ in range(rounds):
        use = aligned | drawn
        if round_:
            run = np.concatenate([[0.0], np.cumsum(np.append(trainer.line(), 0.0)[flat])])
            logit = (run[begins + window] - run[begins]) / window + trainer.bias
            best = np.maximum.reduceat(logit, np.concatenate([[0], ends[:-1]]))[of]
            use = drawn | (logit >= best) | toxic[of] & (logit > 2)
        pick = np.flatnonzero(use)
        target = toxic[of[pick]].astype(float)
        up = target.sum()
        weight = np.where(target > 0, min((len(pick) - up) / max(up, 1), 20.0), 1.0)
        order = np.concatenate([rng.permutation(len(pick)) for _ in range(1 + 4096 // len(pick))])  # small samples several times
        for part in np.array_split(order, max(1, len(order) // 256)):
            trainer.step(flat[begins[pick[part]][:, None] + np.arange(window)], target[part], weight[part], rate)
    model = ToxicModel(trainer.vectors, trainer.softmax, float(trainer.bias), 1.0, 0.0, window)
    margin = model.scorer().margin
    model.slope, model.shift = calibrate(np.array([margin(t) for t in texts]), np.where(y > 0, 1, -1))
    if share_toxic is not None and 0 < share_toxic < 1:
        drawn = y.mean()
        model.shift += float(np.log(share_toxic / (1 - share_toxic)) - np.log(drawn / (1 - drawn)))
    return model


def score_documents(docs: DataFrame, model: ToxicModel, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores every whole text: doc_id, held_out, score (0 to 1, higher: likelier toxic), predicted (score >= threshold).

    A row for each row of ``docs``; a null or empty text, or one without words, is clean; a null id is in the
    held-out fold.  Other columns are not read.  No shuffle; the model (2 MB) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def worker():
        score = shared.value.scorer()

        def work(columns: dict[str, list]) -> dict[str, list]:
            scores = [score(t) for t in columns["text"]]
            return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    picked = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id) == 0).alias("held_out"), text_or_empty(text).alias("text"))
    return per_batch(picked, worker, f"doc_id {kind}, held_out boolean, score double, predicted int")


def learn(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 3000, doc_id: str = "doc_id", text: str = "text") -> ToxicModel:
    """Fits on at most ``most`` labelled documents outside the held-out fold."""
    return fit(*labelled_texts(docs, labels, label, most, doc_id, text))


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = 3000, threshold: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from at most ``most`` labelled documents outside the held-out fold, then scores all of ``docs`` (see ``score_documents``).

    Labels that are null or neither 0 nor 1, and labelled ids that ``docs`` lacks, are left out; with one class or none, scores are constant.
    """
    return score_documents(docs, learn(docs, labels, label, most, doc_id, text), threshold, doc_id, text)


def drop_toxic(docs: DataFrame, model: ToxicModel, threshold: float = 0.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose whole text scores below ``threshold``, with all their columns as they were.

    Null and empty texts, and ones without words, stay; repeated rows share their fate; an empty table stays empty.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    small_batches(docs.sparkSession)

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = shared.value.scorer()
        for texts in batches:
            yield texts.map(one).astype(float)
        del one
        release()

    return docs.where(score(text_or_empty(text)) < threshold)

"""Quality classifier: naive-Bayes support vectors over n-grams of bytes.

The indicator of each n-gram is scaled by the log ratio of its smoothed shares in the two classes; a linear
model with hinge loss is then fitted to the scaled indicators by dual coordinate descent.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskloom.llm.common import fold, per_batch, text_or_empty
from riskloom.llm.labelled import labelled_texts

HASH_BITS = 17
OWN = 256 + 65536 + (1 << HASH_BITS)
WIDTH = OWN + 1024
_place = np.zeros(WIDTH, np.int32)


def indicators(text: str) -> np.ndarray:
    """Distinct features of a whole text: its n-grams of 1 to 3 bytes (3 hashed), and how far its words and lines repeat.

    The share of distinct words (in eighths, by the power of two of their number) is one indicator, the most
    frequent line's count (up to 16) one for each time.
    """
    b = np.frombuffer(text.encode(), np.uint8).astype(np.int32)
    if not len(b):
        return np.zeros(0, np.int32)
    codes = [b, 256 + b[:-1] * 256 + b[1:]]
    if len(b) > 2:
        three = (b[:-2] * 65536 + b[1:-1] * 256 + b[2:]).astype(np.uint32) * np.uint32(2654435769)
        codes.append((three >> np.uint32(32 - HASH_BITS)).astype(np.int32) + 65792)
    words, lines = text.split(), text.split("\n")
    if words:
        codes.append(np.array([OWN + 16 * min(len(words).bit_length(), 20) + 8 * len(set(words)) // len(words)], np.int32))
    if len(set(lines)) < len(lines):
        times: dict[str, int] = {}
        for line in lines:
            times[line] = times.get(line, 0) + 1
        codes.append(np.arange(min(max(times.values()), 16), dtype=np.int32) + OWN + 512)
    all_codes = np.concatenate(codes)
    order = np.arange(len(all_codes), dtype=np.int32)
    _place[all_codes] = order  # the last writer of each place stands for it
    return all_codes[_place[all_codes] == order]


@dataclass
class QualityModel:
    """``weight`` holds model weight times ratio, ``square`` the squared ratio, both per feature."""

    weight: np.ndarray
    square: np.ndarray
    bias: float
    slope: float
    shift: float

    def margin(self, text: str) -> float:
        at = indicators(text)
        norm = float(np.sqrt(self.square[at].sum())) if len(at) else 0.0
        return float(self.weight[at].sum()) / norm + self.bias if norm else self.bias

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(text) + self.shift, -30, 30))))


def _descend(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, width: int, cost: np.ndarray, epochs: int) -> tuple[np.ndarray, float]:
    """Hinge loss by dual coordinate descent; the bias is one more feature of value 1."""
    w, bias, alpha, rng = np.zeros(width), 0.0, np.zeros(len(y)), np.random.default_rng(7)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, x = rows[i], values[i]
            grad = y[i] * (float(w[at] @ x) + bias) - 1
            new = min(max(alpha[i] - grad / (float(x @ x) + 1), 0.0), cost[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[at] += step * x
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w, bias


def calibrate(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins, by Newton steps with a small ridge."""
    x, p = np.stack([margins, np.ones_like(margins)], 1), np.array([1.0, 0.0])
    t = np.where(y > 0, 1 - 1 / (2 + (y > 0).sum()), 1 / (2 + (y <= 0).sum()))
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ p, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (q * (1 - q) + 1e-6)[:, None]) + 1e-3 * np.eye(2), x.T @ (q - t) + 1e-3 * np.array([p[0], 0.0]))
        p -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return max(float(p[0]), 0.1), float(p[1])


def fit(texts: list[str], labels: list[int], share_good: float | None = None, smooth: float = 1.0, cost: float = 4.0, epochs: int = 30) -> QualityModel:
    """Fits on three quarters of the texts and sets the score's curve on the rest. With one class only, scores are constant.

    ``share_good`` is the share of label 1 among all labels, where the texts hold the classes in other shares.
    """
    y = np.where(np.array(labels, int) > 0, 1, -1)
    if len(set(y.tolist())) < 2:
        sure = 0.5 if not len(y) else (0.99 if y[0] > 0 else 0.01)
        return QualityModel(np.zeros(WIDTH, np.float32), np.zeros(WIDTH, np.float32), 0.0, 1.0, float(np.log(sure / (1 - sure))))
    rows = [indicators(t) for t in texts]
    rest = np.arange(len(y)) % 4 == 3
    if len(set(y[rest].tolist())) < 2 or len(set(y[~rest].tolist())) < 2:
        rest[:] = False
    use = np.flatnonzero(~rest)
    up, down = np.full(WIDTH, smooth), np.full(WIDTH, smooth)
    for i in use:
        (up if y[i] > 0 else down)[rows[i]] += 1
    ratio = np.log(up / up.sum()) - np.log(down / down.sum())
    values = [ratio[r] / max(float(np.sqrt((ratio[r] ** 2).sum())), 1e-9) for r in rows]
    share = (y[use] > 0).mean()
    w, bias = _descend([rows[i] for i in use], [values[i] for i in use], y[use], WIDTH, np.where(y[use] > 0, cost * 0.5 / share, cost * 0.5 / (1 - share)), epochs)
    model = QualityModel((w * ratio).astype(np.float32), (ratio**2).astype(np.float32), bias, 1.0, 0.0)
    held = np.flatnonzero(rest) if rest.any() else use
    model.slope, model.shift = calibrate(np.array([model.margin(texts[i]) for i in held]), y[held])
    if share_good is not None and 0 < share_good < 1:
        drawn = (y > 0).mean()
        model.shift += float(np.log(share_good / (1 - share_good)) - np.log(drawn / (1 - drawn)))
    return model


def score_documents(docs: DataFrame, model: QualityModel, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Scores every whole text: doc_id, held_out, score (0 to 1, higher: likelier good), predicted (score >= threshold).

    A row for each row of ``docs``; a null text counts as empty and gets the score of the bias; a null id is
    in the held-out fold.  Other columns are not read.  No shuffle; the model (2 MB) is broadcast.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def worker():
        score = shared.value.score

        def work(columns: dict[str, list]) -> dict[str, list]:
            scores = [score(t) for t in columns["text"]]
            return {"doc_id": columns["doc_id"], "held_out": columns["held_out"], "score": scores, "predicted": [int(s >= threshold) for s in scores]}

        return work

    kind = docs.schema[doc_id].dataType.simpleString()
    picked = docs.select(F.col(doc_id).alias("doc_id"), (fold(doc_id) == 0).alias("held_out"), text_or_empty(text).alias("text"))
    return per_batch(picked, worker, f"doc_id {kind}, held_out boolean, score double, predicted int")


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = 4000, threshold: float = 0.3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Learns from at most ``most`` labelled documents outside the held-out fold, then scores all of ``docs``."""
    return score_documents(docs, fit(*labelled_texts(docs, labels, label, most, doc_id, text)), threshold, doc_id, text)

"""Toxicity by a subsequence-kernel support vector machine with landmarks.

Words are compared with landmark strings by a gap-weighted subsequence kernel,
which tolerates gaps, inserted characters and endings. A sentence takes, per
landmark, the best value of its words; the Nystroem map of those values feeds a
linear support vector machine. Labels are of documents: the sentence of a toxic
document with the largest margin is its witness, and every sentence of another
document is negative, of which each round of training adds the one that is then
worst. A document scores by its worst sentence through a logistic curve.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandmill.llm.common import Shelf, tidy
from strandmill.llm.labelled import sampled_labels, scored
from strandmill.llm.strings import FIELD, ORDER, UNIT, LandmarkKernel

#: Bounds of the fit: labelled documents, landmarks, and rounds of training.
SAMPLE_ROWS, LANDMARKS, ROUNDS = 10_000, 32, 4
#: Share of the toxic documents that a gram must be in to start or extend a landmark,
#: the larger share where there are few of them, as rare grams then say little, and how
#: much more frequent than in other documents it must be.
LEAST_COVER, LEAST_SMALL, CONTRAST = 0.03, 0.06, 8
#: Length of the grams (with ^ and $ at a word's ends) that landmarks grow from.
GRAM = 5
#: Units that a worker remembers, with their values or as without any.
REMEMBERED = 250_000
_SPELLED = re.compile(r"(?<!\S)(?:\S[ \t]){3,}\S(?!\S)")
_SENTENCE = re.compile(r"[.!?\n]+(?=\s|$)|\n")
_EDGES = " \t\r\n.,;:!?\"'()[]{}<>|*#$%&"


def decoded(texts: list[bytes]) -> list[str]:
    """Texts of UTF-8 bytes; bytes that are none count as U+FFFD."""
    return [text.decode("utf-8", "replace") for text in texts]


def units(text: str) -> list[str]:
    """Lower-case words, and spelled-out words with their letters joined."""
    text = text.lower()
    found = text.split()
    return found + ["".join(m[0].split()) for m in _SPELLED.finditer(text)] if _SPELLED.search(text) else found


def _bare(unit: str) -> str:
    return unit.strip(_EDGES)


def _windows(unit: str) -> list[str]:
    """A long unit in overlapping pieces."""
    return [unit[i : i + UNIT] for i in range(0, max(len(unit) - UNIT // 2, 1), UNIT // 2)]


def _grams(text: str) -> set[str]:
    out = set()
    for unit in set(units(text)):
        word = f"^{_bare(unit)}$"
        out.update(word[i : i + GRAM] for i in range(max(len(word) - GRAM + 1, 1)))
    return {g for g in out if len(g) == GRAM}


def _overlap(a: str, b: str, low: dict[str, float], left: bool) -> str:
    """Extend string ``a`` by grams that overlap it by all but one letter."""
    while len(a) < 14:
        options = [g for g in low if (g[1:] == a[: GRAM - 1] if left else g[:-1] == a[-(GRAM - 1) :])]
        best = max(options, key=low.get, default=None)
        if best is None or low[best] < 0.6 * low[b]:
            return a
        low.pop(best) if best != b else None
        a = best[0] + a if left else a + best[-1]
    return a


def least_documents(toxic: int) -> float:
    """Toxic documents that a gram must be in, of so many."""
    return max(3, LEAST_COVER * toxic, LEAST_SMALL * min(toxic, 100))


def choose_landmarks(counts: list[tuple[str, int, int]], toxic: int, clean: int, most: int = LANDMARKS) -> list[str]:
    """Strings grown from grams that toxic documents have far more often than others."""
    share = {g: t / max(toxic, 1) for g, t, c in counts if t >= least_documents(toxic) and t / max(toxic, 1) > CONTRAST * c / max(clean, 1)}
    out: list[str] = []
    while share and len(out) < most:
        gram = max(sorted(share), key=share.get)
        grown = _overlap(_overlap(gram, gram, share, left=False), gram, share, left=True)
        share.pop(gram, None)
        landmark = grown.strip("^$").strip(_EDGES)
        pieces = {landmark[i : i + 4] for i in range(max(len(landmark) - 3, 1))}
        if ORDER <= len(landmark) < FIELD and not any(piece in other for other in out for piece in pieces):
            out.append(landmark)
        for other in [g for g in share if g.strip("^$") in landmark]:
            share.pop(other)
    return out


class Sentences:
    """Best kernel values of a text's sentences; remembers units without values."""

    def __init__(self, kernel: LandmarkKernel):
        self.kernel = kernel
        self.blank: set[str] = set()
        self.valued: dict[str, np.ndarray] = {}

    def unknown(self, seen: set[str]) -> list[str]:
        return [unit for unit in seen - self.blank if unit not in self.valued]

    def make_room(self, seen: set[str]) -> None:
        """Forget units if those of a call would be too many; what it needs again is then unknown."""
        if len(self.blank) + len(self.valued) + len(self.unknown(seen)) > REMEMBERED:
            self.blank = {u for u in self.blank if len(u) <= 7}
        if len(self.blank) + len(self.valued) + len(self.unknown(seen)) > REMEMBERED:
            self.blank, self.valued = set(), {}

    def learn(self, fresh: list[str]) -> None:
        for at in range(0, len(fresh), 20_000):
            some = fresh[at : at + 20_000]
            pieces = [(i, piece) for i, unit in enumerate(some) for piece in _windows(_bare(unit))]
            hit, values = self.kernel.values([piece for _, piece in pieces])
            found: dict[str, np.ndarray] = {}
            for row, value in zip(hit, values.astype(np.float32), strict=True):
                unit = some[pieces[row][0]]
                found[unit] = np.maximum(found[unit], value) if unit in found else value
            self.valued |= found
            self.blank.update(unit for unit in some if unit not in found)

    def values(self, texts: list[str]) -> list[np.ndarray]:
        """For each text, the values of its sentences that have any."""
        split = [set(units(text)) for text in texts]
        seen = set().union(*split)
        self.make_room(seen)
        fresh = self.unknown(seen)
        self.learn(fresh)
        out = []
        for text, own in zip(texts, split, strict=True):
            rows = []
            if not self.valued.keys().isdisjoint(own):
                for sentence in _SENTENCE.split(text):
                    found = [self.valued[u] for u in units(sentence) if u in self.valued]
                    if found:
                        rows.append(np.max(found, axis=0))
            out.append(np.array(rows))
        for unit in fresh:
            if len(unit) > 40:
                self.blank.discard(unit)
                self.valued.pop(unit, None)
        return out


@dataclass
class Machine:
    """Landmarks, weights in Nystroem space, and the logistic curve over margins."""

    kernel: LandmarkKernel
    weights: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, values: np.ndarray) -> np.ndarray:
        return values @ self.kernel.root @ self.weights + self.bias

    def probabilities(self, sentences: list[np.ndarray]) -> list[float]:
        worst = np.array([self.margins(rows).max() if len(rows) else self.bias for rows in sentences])
        return (1.0 / (1.0 + np.exp(-np.clip(self.slope * worst + self.shift, -30, 30)))).tolist()


def train_svm(x: np.ndarray, y: np.ndarray, cost: float = 60.0, steps: int = 1500) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss and classes of equal weight, by accelerated descent."""
    sign = np.where(y > 0, 1.0, -1.0)
    weight = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y <= 0).sum(), 1)) * cost * 20
    full = np.hstack([x, np.ones((len(x), 1))])
    rate = 1.0 / (1.0 + 2 * np.linalg.norm(full * np.sqrt(weight)[:, None], 2) ** 2)
    w = look = np.zeros(full.shape[1])
    pace = 1.0
    for _ in range(steps):
        slack = np.maximum(0.0, 1.0 - sign * (full @ look))
        gradient = np.append(look[:-1], 0.0) - 2 * full.T @ (weight * sign * slack)
        new = look - rate * gradient
        next_pace = (1 + np.sqrt(1 + 4 * pace * pace)) / 2
        look = new + (pace - 1) / next_pace * (new - w)
        w, pace = new, next_pace
    return w[:-1], float(w[-1])


def _logistic(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic curve through margins, by Newton steps with smoothed targets."""
    positive, negative = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    at = np.array([1.0, 0.0])
    full = np.stack([margins, np.ones_like(margins)], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(full @ at, -30, 30)))
        hessian = (full * (p * (1 - p))[:, None]).T @ full + 1e-3 * np.eye(2)
        at = at - np.linalg.solve(hessian, full.T @ (p - target) + 1e-3 * (at - [1.0, 0.0]))
    return float(max(at[0], 0.1)), float(at[1])


def _texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string").cast("binary"), F.lit(b"")).alias("text"))
    return rows.join(F.broadcast(sample), "doc_id").select("doc_id", "label", "text")


def _values(texts: DataFrame, kernel: LandmarkKernel) -> DataFrame:
    """(doc_id, label, found): the different value vectors of a document's sentences, end to end."""
    width = len(kernel.landmarks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sentences = Sentences(kernel)
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                part = batch.slice(at, 100)
                found = [np.unique(np.vstack([rows, np.zeros((1, width))]).astype(np.float32), axis=0).reshape(-1) if len(rows) else np.zeros(width, np.float32) for rows in sentences.values(decoded(part.column(2).to_pylist()))]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.float32()))], ["doc_id", "label", "found"])

    return texts.mapInArrow(tidy(run), "doc_id long, label int, found array<float>")


def _worst(values: DataFrame, direction: np.ndarray) -> list:
    """Per document the label and the sentence that is largest in a direction; one row per
    sampled id, so bounded by the sample."""
    width = len(direction)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, rows = [], []
            for found in batch.column(2):
                x = found.values.to_numpy().reshape(-1, width)
                margins = x @ direction
                best.append(float(margins.max()))
                rows.append(x[margins.argmax()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(best, pa.float64()), pa.array(rows, pa.list_(pa.float32()))], ["doc_id", "label", "margin", "found"])

    each = values.mapInArrow(tidy(run), "doc_id long, label int, margin double, found array<float>")
    rows = each.groupBy("doc_id").agg(F.min("label").alias("label"), F.max(F.struct("margin", "found")).alias("best")).select("doc_id", "label", "best.found").collect()
    return sorted(rows, key=lambda r: r.doc_id)


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, modulus: int = 4, held_out: int = 2) -> Machine | None:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold.

    None if a class is missing or no landmark stands out.
    """
    sample = sampled_labels(labels, "toxic", modulus, held_out, sample_rows)

    def grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for label, text in zip(batch.column(1).to_pylist(), decoded(batch.column(2).to_pylist()), strict=True):
                found = sorted(_grams(text))
                yield pa.RecordBatch.from_arrays([pa.array([label] * len(found), pa.int32()), pa.array(found, pa.string())], ["label", "gram"])

    sizes = dict(sample.groupBy("label").count().collect())
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not clean:
        return None
    shelf = Shelf()
    texts = shelf.put(_texts(docs, sample), "labelled")
    counted = texts.dropDuplicates(["text"]).mapInArrow(tidy(grams), "label int, gram string").groupBy("gram").agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean"))
    # A gram passes only if a share of the toxic documents has it, so few do.
    frequent = counted.where((F.col("toxic") >= least_documents(toxic)) & (F.col("toxic") * clean > CONTRAST * toxic * F.col("clean")))
    landmarks = choose_landmarks(sorted(map(tuple, frequent.select("gram", "toxic", "clean").collect())), toxic, clean)
    if not landmarks:
        shelf.clear()
        return None
    kernel = LandmarkKernel(landmarks)
    values = shelf.put(_values(texts, kernel), "sentences")
    direction = np.ones(len(landmarks))
    weights, bias = np.zeros(len(landmarks)), 0.0
    negatives: list[np.ndarray] = []
    for turn in range(ROUNDS + 1):
        rows = _worst(values, direction)
        label = np.array([r.label for r in rows])
        found = np.array([r.found for r in rows]) @ kernel.root
        if turn == ROUNDS or len(set(label.tolist())) < 2:
            break
        negatives.append(found[label == 0])
        x = np.vstack([found[label == 1], np.unique(np.vstack(negatives).round(6), axis=0)])
        y = np.concatenate([np.ones((label == 1).sum()), np.zeros(len(x) - (label == 1).sum())])
        weights, bias = train_svm(x, y)
        direction = kernel.root @ weights
    shelf.clear()
    slope, shift = _logistic(found @ weights + bias, label)
    return Machine(kernel, weights, bias, slope, shift)


def score_toxicity(docs: DataFrame, machine: Machine | None, modulus: int = 4, held_out: int = 2, threshold: float = 0.3, carry: list[str] | None = None) -> DataFrame:
    """One row per document: doc_id (or the columns to carry), held_out, score, predicted.

    Only the text enters a score. Null and empty texts have no sentence and score
    by the bias. Bytes that are no UTF-8 count as U+FFFD. Without a machine every score is 0. Null ids are never held out;
    repeated rows are scored alike; other columns are ignored; an empty table
    gives no rows. One narrow pass, no shuffle.
    """

    def scorer():
        if machine is None:
            return lambda texts: [0.0] * len(texts)
        sentences = Sentences(machine.kernel)
        return lambda texts: machine.probabilities(sentences.values(decoded(texts)))

    return scored(docs, scorer, modulus, held_out, threshold, per_call=250, carry=carry)

"""Quality by regularised quadratic discriminant analysis.

Statistics of a whole text are transformed and standardised. Each class gets a
mean and a covariance that is shrunk towards the pooled one and then towards a
multiple of the identity; its Cholesky factor is computed once and reused for
every document. The score is the logistic of the difference of the Mahalanobis
log densities plus the log odds of the classes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame

from strandmill.llm import features
from strandmill.llm.labelled import labelled_statistics, sampled_labels, scored

#: Bound of the labelled sample that the model is fitted on.
SAMPLE_ROWS = 20_000
#: Standardised statistics beyond this many deviations are drawn in.
FAR = 6.0


@dataclass
class Discriminant:
    """Standardisation and, per class, log prior, mean and inverse Cholesky factor."""

    centre: np.ndarray
    spread: np.ndarray
    priors: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    log_scales: np.ndarray

    def probability(self, raw: np.ndarray) -> np.ndarray:
        """Probability of label 1 by row of raw statistics."""
        z = np.clip((features.transformed(raw) - self.centre) / self.spread, -FAR, FAR)
        logs = [p - 0.5 * np.square((z - m) @ f.T).sum(axis=1) - s for p, m, f, s in zip(self.priors, self.means, self.factors, self.log_scales, strict=True)]
        return 1.0 / (1.0 + np.exp(-np.clip(logs[1] - logs[0], -30.0, 30.0)))


def fit_discriminant(raw: np.ndarray, labels: np.ndarray, to_pooled: float = 0.05, to_identity: float = 0.02) -> Discriminant | None:
    """None unless both classes have at least two rows."""
    if min((labels == 0).sum(), (labels == 1).sum()) < 2:
        return None
    x = features.transformed(raw)
    centre, spread = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.clip((x - centre) / spread, -FAR, FAR)
    pooled = np.cov(z.T)
    priors, means, factors, scales = [], [], [], []
    for label in (0, 1):
        own = z[labels == label]
        shrunk = (1 - to_pooled) * np.cov(own.T) + to_pooled * pooled
        shrunk = (1 - to_identity) * shrunk + to_identity * np.trace(shrunk) / len(shrunk) * np.eye(len(shrunk))
        factor = np.linalg.cholesky(shrunk)
        priors.append(np.log(len(own) / len(z)))
        means.append(own.mean(axis=0))
        factors.append(np.linalg.inv(factor))
        scales.append(np.log(np.diag(factor)).sum())
    return Discriminant(centre, spread, np.array(priors), np.array(means), np.array(factors), np.array(scales))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, modulus: int = 5, held_out: int = 0) -> Discriminant | None:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold."""
    rows = labelled_statistics(docs, sampled_labels(labels, "quality", modulus, held_out, sample_rows), features.statistics)
    if not rows:
        return None
    return fit_discriminant(np.array([found for _, found in rows]), np.array([label for label, _ in rows]))


def score_quality(docs: DataFrame, model: Discriminant | None, modulus: int = 5, held_out: int = 0, threshold: float = 0.3) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted.

    Only the text enters a score. Null and empty texts are scored from the
    statistics of an empty text. Without a model every score is 0.5. Null ids
    are never held out; repeated rows are scored alike; other columns are
    ignored; an empty table gives no rows. One narrow pass, no shuffle.
    """

    def score(texts: list[bytes]) -> list[float]:
        if model is None:
            return [0.5] * len(texts)
        return model.probability(np.array([features.statistics(text) for text in texts])).tolist() if texts else []

    return scored(docs, lambda: score, modulus, held_out, threshold)

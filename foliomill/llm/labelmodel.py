"""An expectation-maximisation label model over vote patterns of noisy labelling functions.

Votes are +1 (defect), -1 (no defect) or 0 (no opinion).  A function's chance to be right given the hidden class is
learned, functions being independent given the class.  The input is the count of each vote pattern (at most 3^k rows for k
functions), so a fit costs the same for any corpus.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class LabelModel:
    """The share of the defect, and of each class and function the chances of the votes -1 and +1."""

    share: float
    chances: np.ndarray

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """Posterior of the defect for each row of ``votes``, also of patterns that no training row had."""
        said = _said(votes)
        log1 = np.log(self.share) + (said * np.log(self.chances[1])).sum((1, 2))
        log0 = np.log(1 - self.share) + (said * np.log(self.chances[0])).sum((1, 2))
        return 1 / (1 + np.exp(np.clip(log0 - log1, -500, 500)))


def _said(votes: np.ndarray) -> np.ndarray:
    # Only what a function says counts; its silence is no evidence for either class.
    return np.stack([votes == -1, votes == 1], axis=2).astype(float)  # pattern, function, vote


def fit(votes: np.ndarray, counts: np.ndarray, rounds: int = 60, prior: float = 0.05) -> LabelModel:
    """The model of patterns (rows of ``votes``) and how often each occurs."""
    k = votes.shape[1]
    chances = np.empty((2, k, 2))
    chances[1], chances[0] = [0.2, 0.8], [0.8, 0.2]  # every function right four times in five, to begin with
    model = LabelModel(prior, chances)
    w, said = counts.astype(float), _said(votes)
    for _ in range(rounds if len(counts) else 0):
        post = model.posterior(votes)
        chances = np.empty((2, k, 2))
        for y, part in ((1, post), (0, 1 - post)):
            n = np.einsum("p,pfv->fv", w * part, said)
            # Pseudo-votes keep each function better than chance, hence the classes from changing places.
            guess = np.array([1.0, 4.0]) if y else np.array([4.0, 1.0])
            chances[y] = (n + guess) / (n + guess).sum(1, keepdims=True)
        model = LabelModel(float(np.clip((w * post).sum() / w.sum(), 1e-6, 0.5)), chances)
    return model


def validated_cutoff(posterior: np.ndarray, label: np.ndarray, share: float) -> float:
    """The cutoff, 0.5 at least, of greatest F1 on labelled rows, of which the positive ones are weighted to be ``share`` of all; of equal ones the
    middle between the least and the next posterior below."""
    positive = label.sum()
    if not positive or positive == len(label):
        return 0.5
    weight = np.where(label, share / positive, (1 - share) / (len(label) - positive))
    values = np.unique(posterior[posterior >= 0.5])
    best = (0.0, 0.5)
    for k, at in enumerate(values):
        hit = posterior >= at
        f1 = 2 * (weight * label)[hit].sum() / (weight[hit].sum() + share)
        if f1 > best[0] + 1e-12:
            best = (f1, float(at + (values[k - 1] if k else 0.5)) / 2)
    return best[1]

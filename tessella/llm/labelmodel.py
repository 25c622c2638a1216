"""A generative model of overlapping voters, and a linear scorer fitted to its posteriors.

Both work on bounded summaries: the label model on counts per vote pattern, the scorer on sparse rows of a
bounded sample.
"""

from __future__ import annotations

import numpy as np


class LabelModel:
    """Voters with values 0..k-1 given a hidden label, fitted by expectation maximisation.

    The last label is the one asked for; there may be several others, such as the kinds of what it is not, since voters
    that see one kind only are far from independent given "any kind". Voters are first taken as independent given the
    label. Then the correlations that the posterior leaves between voters are estimated, and voters that repeat each
    other share their weight. A value may stand for no vote (`abstain`): it tells nothing of the label, and
    accuracies are those of the votes given.
    """

    def __init__(self, values: int = 3, rounds: int = 60, outer: int = 3, abstain: int | None = None):
        self.values, self.rounds, self.outer, self.abstain = values, rounds, outer, abstain

    def fit(self, votes: np.ndarray, counts: np.ndarray, start: np.ndarray) -> LabelModel:
        """votes (patterns, voters), counts (patterns), start: a first guess of P(last label) per pattern, or of all
        labels (patterns, labels), which says which label is which."""
        self.weight = np.ones(votes.shape[1])
        self.correlation = np.eye(votes.shape[1])
        hot = (votes[:, :, None] == np.arange(self.values)).astype(float)
        post = np.clip(start if start.ndim == 2 else np.stack([1 - start, start], axis=1), 0.001, 0.999)
        self._learn(counts, hot, post / post.sum(axis=1, keepdims=True))
        for _ in range(self.outer):
            # shared weights come first: else voters that repeat each other could become the label themselves
            self._share(votes, counts, post)
            for _ in range(self.rounds):
                self._learn(counts, hot, post)
                new = self.labels(votes)
                moved = float(np.abs(new - post).max(initial=0))
                post = new
                if moved < 1e-6:
                    break
        return self

    def _learn(self, counts: np.ndarray, hot: np.ndarray, post: np.ndarray) -> None:
        mass = (counts[:, None] * post).T
        self.priors = (mass.sum(axis=1) + 1) / (mass.sum() + len(mass))
        table = np.einsum("yn,nmv->ymv", mass, hot) + 0.5
        if self.abstain is not None:
            table[:, :, self.abstain] = 0
        self.chance = table / table.sum(axis=2, keepdims=True)
        self.log = np.log(self.chance, where=self.chance > 0, out=np.zeros_like(self.chance))  # 0 for no vote
        self.others = np.einsum("y,ymv->mv", self.priors[:-1] / self.priors[:-1].sum(), self.chance[:-1])
        self.odds = self.log[-1] - np.log(self.others, where=self.others > 0, out=np.zeros_like(self.others))

    def _share(self, votes: np.ndarray, counts: np.ndarray, post: np.ndarray) -> None:
        told = np.take_along_axis(self.odds[None], votes[:, :, None], axis=2)[:, :, 0]  # log-odds each vote stands for
        rest = told - post @ (self.chance * self.odds[None]).sum(axis=2)
        if self.abstain is not None:
            rest[votes == self.abstain] = 0
        cov = (rest * counts[:, None]).T @ rest / max(1.0, counts.sum())
        scale = np.sqrt(np.maximum(np.diag(cov), 1e-12))
        self.correlation = cov / scale[:, None] / scale[None]
        extra = np.where(self.correlation > 0.1, self.correlation, 0.0).sum(axis=1) - 1
        self.weight = 1 / (1 + np.maximum(extra, 0))

    @property
    def prior(self) -> float:
        """P(last label)."""
        return float(self.priors[-1])

    def labels(self, votes: np.ndarray) -> np.ndarray:
        """P(label) per pattern, for all labels."""
        z = np.log(self.priors) + np.stack([(np.take_along_axis(x[None], votes[:, :, None], axis=2)[:, :, 0] * self.weight).sum(axis=1) for x in self.log], axis=1)
        e = np.exp(z - z.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        """P(last label) per pattern."""
        return self.labels(votes)[:, -1]

    def accuracies(self) -> np.ndarray:
        """Per voter, how often its vote points to the label that is there or away from it (no pointer counts as half)."""
        p, q, odds = self.chance[-1], self.others, self.odds
        right1, right0 = (p * (odds > 0)).sum(axis=1) + 0.5 * (p * (odds == 0)).sum(axis=1), (q * (odds < 0)).sum(axis=1) + 0.5 * (q * (odds == 0)).sum(axis=1)
        return self.prior * right1 + (1 - self.prior) * right0


def fit_linear(rows: list[np.ndarray], values: list[np.ndarray], target: np.ndarray, size: int, steps: int = 150, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic regression on sparse rows (feature numbers and values) with soft targets: (weights, bias).
    Full-batch adaptive gradient steps, so the result depends on the rows alone, not on their order in time."""
    w, b = np.zeros(size), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3))) if len(target) else 0.0
    if not len(target):
        return w, b
    lengths = np.array([len(r) for r in rows])
    cols = np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    vals = np.concatenate([*values, np.zeros(0)])
    of = np.repeat(np.arange(len(rows)), lengths)
    seen_w, seen_b = np.full(size, 1e-8), 1e-8
    for _ in range(steps):
        z = np.bincount(of, vals * w[cols], len(rows)) + b
        g = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) / len(rows)
        gw, gb = np.bincount(cols, vals * g[of], size) + decay * w / 10, g.sum()
        seen_w, seen_b = seen_w + gw**2, seen_b + gb**2
        w, b = w - rate * gw / np.sqrt(seen_w), b - rate * gb / np.sqrt(seen_b)
    return w, float(b)

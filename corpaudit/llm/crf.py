"""A linear-chain conditional random field over sets of binary features, in numpy."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np


@dataclass
class Chain:
    """Weights of a trained chain. Features that training didn't see weigh nothing."""

    labels: tuple[str, ...]
    features: dict[str, int]
    emission: np.ndarray  # (features, labels)
    transition: np.ndarray  # (labels, labels), from row to column
    first: np.ndarray  # (labels,)
    cache: dict = field(default_factory=dict, compare=False)

    def scores(self, items: Sequence[Sequence[str]]) -> np.ndarray:
        """(item, label) scores of items given by their features."""
        known = [[self.features[f] for f in item if f in self.features] for item in items]
        sizes = np.array([len(k) for k in known], np.int64)
        ids = np.array([i for k in known for i in k], np.int64)
        running = np.zeros((len(ids) + 1, len(self.labels)))
        np.cumsum(self.emission[ids], axis=0, out=running[1:])
        ends = np.cumsum(sizes)
        return running[ends] - running[ends - sizes]

    def decode(self, scores: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Best label of every item; sequences of `lengths` stand one after the other.

        Viterbi over all sequences at once, the longest first, so that a step handles only those
        that are still running. Ties take the first label.
        """
        lengths = np.asarray(lengths, np.int64)
        starts = np.cumsum(lengths) - lengths
        order = np.argsort(-lengths, kind="stable")
        lengths, starts = lengths[order], starts[order]
        out = np.zeros(len(scores), np.int64)
        if not len(lengths) or not lengths[0]:
            return out
        running = len(lengths) - np.searchsorted(lengths[::-1], np.arange(int(lengths[0])), "right")
        # the best value of a path up to an item that ends in a label; the way back asks for one label an item only
        best = np.empty(scores.shape)
        here = starts[:running[0]]
        best[here] = now = self.first + scores[here]
        for count in running[1:].tolist():
            here = here[:count] + 1
            now = (now[:count, :, None] + self.transition).max(axis=1)
            now += scores[here]
            best[here] = now
        ended = starts[:running[0]] + lengths[:running[0]] - 1
        label = best[ended].argmax(axis=1)
        out[ended] = label
        into = np.ascontiguousarray(self.transition.T)
        for step in range(int(lengths[0]) - 1, 0, -1):
            before = starts[:running[step]] + (step - 1)
            label[:len(before)] = found = (best[before] + into[label[:len(before)]]).argmax(axis=1)
            out[before] = found
        return out


def _log_sum(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


def fit(
    sequences: Sequence[Sequence[Sequence[str]]], labels: Sequence[Sequence[str]], names: Sequence[str],
    steps: int = 120, rate: float = 0.15, ridge: float = 0.02,
) -> Chain:
    """A chain trained on labelled sequences by full-batch gradient steps (Adam), ridge-regularized.

    The gradient is observed less expected counts, by forward-backward over all sequences at once.
    """
    place = {name: i for i, name in enumerate(names)}
    features: dict[str, int] = {}
    for sequence in sequences:
        for item in sequence:
            for f in item:
                features.setdefault(f, len(features))
    n, width, size = len(sequences), max((len(s) for s in sequences), default=0), len(names)
    rows, ids = [], []
    truth = np.zeros((n, width), np.int64)
    valid = np.zeros((n, width), bool)
    for i, (sequence, tags) in enumerate(zip(sequences, labels)):
        for j, (item, tag) in enumerate(zip(sequence, tags)):
            truth[i, j], valid[i, j] = place[tag], True
            rows += [i * width + j] * len(item)
            ids += [features[f] for f in item]
    rows_, ids_ = np.array(rows, np.int64), np.array(ids, np.int64)
    order = np.argsort(ids_, kind="stable")
    rows_, ids_ = rows_[order], ids_[order]
    weights = [np.zeros((len(features), size)), np.zeros((size, size)), np.zeros(size)]
    gold = np.zeros((n, width, size))
    gold[np.nonzero(valid)[0], np.nonzero(valid)[1], truth[valid]] = 1
    pairs = np.zeros((size, size))
    both = valid[:, 1:] & valid[:, :-1]
    np.add.at(pairs, (truth[:, :-1][both], truth[:, 1:][both]), 1)
    ends = valid.sum(axis=1) - 1
    moment = [np.zeros_like(w) for w in weights]
    spread = [np.zeros_like(w) for w in weights]
    for step in range(1, steps + 1):
        emission, transition, first = weights
        flat = np.zeros((n * width, size))
        np.add.at(flat, rows_, emission[ids_])
        scores = flat.reshape(n, width, size)
        ahead = np.zeros((n, width, size))
        behind = np.zeros((n, width, size))
        ahead[:, 0] = first + scores[:, 0]
        for t in range(1, width):
            ahead[:, t] = _log_sum(ahead[:, t - 1][:, :, None] + transition, 1) + scores[:, t]
        for t in range(width - 2, -1, -1):
            step_back = _log_sum(transition + (scores[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where((t < ends)[:, None], step_back, 0)
        total = _log_sum(ahead[np.arange(n), ends], 1)
        marginal = np.exp(ahead + behind - total[:, None, None]) * valid[:, :, None]
        expected = np.zeros((size, size))
        for t in range(width - 1):
            live = both[:, t]
            if live.any():
                joint = ahead[live, t][:, :, None] + transition + (scores[live, t + 1] + behind[live, t + 1])[:, None, :]
                expected += np.exp(joint - total[live][:, None, None]).sum(axis=0)
        off = (gold - marginal).reshape(n * width, size)
        slope = np.zeros_like(emission)
        np.add.at(slope, ids_, off[rows_])
        slopes = [slope, pairs - expected, (gold[:, 0] - marginal[:, 0]).sum(axis=0)]
        for k, w in enumerate(weights):
            g = slopes[k] - ridge * w
            moment[k] = 0.9 * moment[k] + 0.1 * g
            spread[k] = 0.999 * spread[k] + 0.001 * g * g
            w += rate * (moment[k] / (1 - 0.9 ** step)) / (np.sqrt(spread[k] / (1 - 0.999 ** step)) + 1e-8)
    return Chain(tuple(names), features, *weights)

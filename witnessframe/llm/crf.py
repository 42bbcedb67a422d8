"""A linear-chain conditional random field in numpy: training on a small table, Viterbi in batches."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Chain:
    """Scores of labels per feature, of label pairs, and of a label that begins or ends a sequence."""

    weights: np.ndarray  # features x labels
    moves: np.ndarray  # from x to
    start: np.ndarray
    stop: np.ndarray


def _logsum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(features: list[np.ndarray], labels: list[np.ndarray], n_labels: int, *, rounds: int = 200, rate: float = 0.1, ridge: float = 0.01) -> Chain:
    """Maximise the log-likelihood of labelled sequences with Adam and a ridge penalty.

    ``features[s]`` is a (places, features) matrix, ``labels[s]`` the label of each place.
    Forward and backward sums run over all sequences at once, padded to the longest.
    """
    n, longest, width = len(features), max(map(len, features)), features[0].shape[1]
    x, y, real = np.zeros((n, longest, width)), np.zeros((n, longest), np.int64), np.zeros((n, longest), bool)
    for s, (f, l) in enumerate(zip(features, labels)):
        x[s, : len(f)], y[s, : len(f)], real[s, : len(f)] = f, l, True
    last = real.sum(axis=1) - 1
    rows = np.arange(n)
    one = np.eye(n_labels)[y] * real[..., None]
    seen = {
        "weights": np.einsum("stf,stl->fl", x, one), "moves": np.einsum("sti,stj->ij", one[:, :-1], one[:, 1:]),
        "start": one[:, 0].sum(axis=0), "stop": one[rows, last].sum(axis=0),
    }
    state = {k: np.zeros_like(v, dtype=float) for k, v in seen.items()}
    first, second = {k: np.zeros_like(v) for k, v in state.items()}, {k: np.zeros_like(v) for k, v in state.items()}
    for step in range(1, rounds + 1):
        emit = x @ state["weights"]
        forward = np.empty((longest, n, n_labels))
        forward[0] = state["start"] + emit[:, 0]
        for t in range(1, longest):
            new = _logsum(forward[t - 1][:, :, None] + state["moves"], 1) + emit[:, t]
            forward[t] = np.where(real[:, t, None], new, forward[t - 1])
        whole = _logsum(forward[-1] + state["stop"], 1)
        backward = np.empty((longest, n, n_labels))
        backward[-1] = state["stop"]
        for t in range(longest - 2, -1, -1):
            new = _logsum(state["moves"] + (emit[:, t + 1] + backward[t + 1])[:, None, :], 2)
            backward[t] = np.where(real[:, t + 1, None], new, state["stop"])
        at = np.exp(forward + backward - whole[:, None]).transpose(1, 0, 2) * real[..., None]
        pairs = np.zeros((n_labels, n_labels))
        for t in range(1, longest):
            both = np.exp(forward[t - 1][:, :, None] + state["moves"] + (emit[:, t] + backward[t])[:, None, :] - whole[:, None, None])
            pairs += (both * real[:, t, None, None]).sum(axis=0)
        expected = {"weights": np.einsum("stf,stl->fl", x, at), "moves": pairs, "start": at[:, 0].sum(axis=0), "stop": at[rows, last].sum(axis=0)}
        for k in state:
            slope = (seen[k] - expected[k]) / n - ridge * state[k]
            first[k] = 0.9 * first[k] + 0.1 * slope
            second[k] = 0.99 * second[k] + 0.01 * slope**2
            state[k] = state[k] + rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return Chain(**state)


def viterbi(emit: np.ndarray, offsets: np.ndarray, chain: Chain) -> np.ndarray:
    """The best label of every place; ``emit[offsets[s]:offsets[s + 1]]`` are the scores of sequence s.

    All sequences advance together, the longest first, so step t works on just those that
    have a place t. Ties go to the lower label.
    """
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    best = np.zeros(len(emit), np.uint8)
    if not len(order):
        return best
    begin, length = offsets[:-1][order], lengths[order]
    back = np.zeros(emit.shape, np.uint8)
    score = chain.start + emit[begin]
    alive = len(order) - np.searchsorted(length[::-1], np.arange(length[0]), "right")
    for t in range(1, length[0]):
        k = alive[t]
        through = score[:k, :, None] + chain.moves
        back[begin[:k] + t] = through.argmax(axis=1)
        score[:k] = through.max(axis=1) + emit[begin[:k] + t]
    label = (score + chain.stop).argmax(axis=1)
    for t in range(length[0] - 1, -1, -1):
        k = alive[t]
        best[begin[:k] + t] = label[:k]
        label[:k] = back[begin[:k] + t, label[:k]]
    return best

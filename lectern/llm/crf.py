"""A linear-chain conditional random field over rows with dense and sparse features, trained by gradient ascent.

Sequences are trained together, place by place, so a round costs a few matrix operations whatever their number."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Chain:
    labels: tuple[str, ...]
    emit: np.ndarray  # dense features by labels
    words: np.ndarray  # sparse features by labels
    step: np.ndarray  # label before by label after
    start: np.ndarray


@dataclass(frozen=True)
class Rows:
    """Rows of all sequences after each other: dense features, and for each row the numbers of its sparse ones."""

    dense: np.ndarray
    sparse: list[list[int]]

    def flat(self) -> tuple[np.ndarray, np.ndarray]:
        """Sparse numbers of all rows, and the row of each."""
        sizes = np.array([len(x) for x in self.sparse], dtype=np.int64)
        return np.array([i for x in self.sparse for i in x], dtype=np.int64), np.repeat(np.arange(len(sizes)), sizes)


def scores(chain: Chain, rows: Rows) -> np.ndarray:
    out = rows.dense @ chain.emit
    number, row = rows.flat()
    for k in range(out.shape[1]):
        out[:, k] += np.bincount(row, weights=chain.words[number, k], minlength=len(out))
    return out


def _marginals(emissions: np.ndarray, grid: np.ndarray, held: np.ndarray, step: np.ndarray, start: np.ndarray):
    """Probability of each label for each row, and expected numbers of each pair of neighbours and of each first label.

    Forward and backward passes in probabilities, scaled to sum 1 at each place."""
    n, t, k = *grid.shape, emissions.shape[1]
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True))[grid]
    go, first = np.exp(step - step.max()), np.exp(start - start.max())
    fwd, scale = np.zeros((t, n, k)), np.ones((t, n))
    fwd[0] = first * e[:, 0]
    for i in range(t):
        if i:
            fwd[i] = np.where(held[:, i, None], (fwd[i - 1] @ go) * e[:, i], fwd[i - 1])
        scale[i] = fwd[i].sum(axis=1)
        fwd[i] /= scale[i][:, None]
    node, pairs = np.zeros_like(emissions), np.zeros((k, k))
    bwd = np.ones((n, k))
    for i in range(t - 1, -1, -1):
        at = np.flatnonzero(held[:, i])
        node[grid[at, i]] = fwd[i, at] * bwd[at]
        if i:
            ahead = e[at, i] * bwd[at] / scale[i, at][:, None]
            pairs += (fwd[i - 1, at].T @ ahead) * go
            bwd[at] = ahead @ go.T
    return node, pairs, node[grid[:, 0]].sum(axis=0)


def fit(rows: Rows, lengths: list[int], tags: list[int], labels: tuple[str, ...], vocabulary: int, rounds: int = 80, rate: float = 0.15, decay: float = 0.02,
        sparse_decay: float = 0.2, begin: Chain | None = None, quiet: tuple[int, ...] = (),
        together: tuple[int, ...] = (), shared: np.ndarray | None = None) -> Chain:
    """Weights that make the tags of the sequences likely, held small by the decays; the same for the same input.  ``begin`` gives the
    weights to start from; ``quiet`` labels take no part in the sparse features, and those ``together`` have
    one weight for each of the ``shared`` ones."""
    k, n = len(labels), len(lengths)
    y = np.eye(k)[tags]
    ends = np.cumsum(lengths)
    starts = ends - lengths
    t = max(lengths)
    held = np.arange(t)[None, :] < np.array(lengths)[:, None]
    grid = np.where(held, starts[:, None] + np.arange(t)[None, :], 0)
    number, row = rows.flat()
    follows = np.zeros((k, k))
    after = np.flatnonzero(held[:, 1:].reshape(-1)) if t > 1 else np.array([], dtype=np.int64)
    if len(after):
        b = grid[:, 1:].reshape(-1)[after]
        np.add.at(follows, (np.array(tags)[b - 1], np.array(tags)[b]), 1)
    first = y[starts].sum(axis=0)
    weights = [np.zeros((rows.dense.shape[1], k)), np.zeros((vocabulary, k)), np.zeros((k, k)), np.zeros(k)]
    if begin is not None:
        weights = [begin.emit.copy(), begin.words.copy(), begin.step.copy(), begin.start.copy()]
    m1, m2 = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    for r in range(1, rounds + 1):
        emissions = rows.dense @ weights[0]
        for j in range(k):
            emissions[:, j] += np.bincount(row, weights=weights[1][number, j], minlength=len(emissions))
        node, pairs, begins = _marginals(emissions, grid, held, weights[2], weights[3])
        gap = y - node
        words = np.stack([np.bincount(number, weights=gap[row, j], minlength=vocabulary) for j in range(k)], axis=1)
        words[:, list(quiet)] = 0
        if together:
            words[np.ix_(shared, together)] = words[np.ix_(shared, together)].sum(axis=1, keepdims=True) / len(together)
        grads = [rows.dense.T @ gap - decay * n * weights[0] / 10, words - sparse_decay * weights[1], follows - pairs - decay * n * weights[2] / 10, first - begins - decay * n * weights[3] / 10]
        for w, g, a, b in zip(weights, grads, m1, m2):
            g = g / n
            a += 0.1 * (g - a)
            b += 0.01 * (g * g - b)
            w += rate * (a / (1 - 0.9**r)) / (np.sqrt(b / (1 - 0.99**r)) + 1e-8)
    return Chain(labels, *weights)


def decode(emissions: np.ndarray, lengths: list[int], chain: Chain, cells: int = 500_000) -> np.ndarray:
    """The best tags of every row of the sequences, by Viterbi; sequences of like length go together."""
    lengths = np.asarray(lengths, dtype=np.int64)
    tags = np.zeros(len(emissions), dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    order = np.argsort(-lengths, kind="stable")
    order = order[lengths[order] > 0]
    at = 0
    while at < len(order):
        t = int(lengths[order[at]])
        some = order[at : at + max(1, cells // t)]
        at += len(some)
        held = np.arange(t)[None, :] < lengths[some][:, None]
        grid = np.where(held, starts[some][:, None] + np.arange(t)[None, :], 0)
        best = chain.start + emissions[grid[:, 0]]
        same = np.arange(best.shape[1])[None, :]
        links = np.zeros((t, *best.shape), dtype=np.int8)
        for i in range(1, t):
            ways = best[:, :, None] + chain.step[None]
            links[i] = np.where(held[:, i, None], ways.argmax(axis=1), same)
            best = np.where(held[:, i, None], ways.max(axis=1) + emissions[grid[:, i]], best)
        tag = best.argmax(axis=1)
        for i in range(t - 1, -1, -1):
            tags[grid[held[:, i], i]] = tag[held[:, i]]
            tag = links[i][np.arange(len(some)), tag]
    return tags

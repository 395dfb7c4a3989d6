"""Linear-chain conditional random fields in numpy: many sequences at once, time along the first axis.

``emit`` is (T, N, L): the score of each label at each step of each sequence. ``trans`` is (L, L),
from label to label. ``length`` (N,) says how many steps of a sequence count.
"""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def forward_backward(emit: np.ndarray, trans: np.ndarray, length: np.ndarray):
    """Log partition (N,), label marginals (T, N, L) and expected transition counts (L, L)."""
    steps, n, labels = emit.shape
    alpha, beta = np.empty_like(emit), np.zeros_like(emit)
    alpha[0] = emit[0]
    for t in range(1, steps):
        step = _lse(alpha[t - 1][:, :, None] + trans[None], 1) + emit[t]
        alpha[t] = np.where((t < length)[:, None], step, alpha[t - 1])
    log_z = _lse(alpha[-1], 1)
    for t in range(steps - 2, -1, -1):
        step = _lse(trans[None] + (emit[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where((t + 1 < length)[:, None], step, 0.0)
    live = (np.arange(steps)[:, None] < length[None])[:, :, None]
    post = np.exp(alpha + beta - log_z[None, :, None]) * live
    pairs = np.zeros((labels, labels))
    for t in range(1, steps):
        on = t < length
        if on.any():
            pairs += np.exp(alpha[t - 1][on][:, :, None] + trans[None] + (emit[t] + beta[t])[on][:, None, :] - log_z[on][:, None, None]).sum(0)
    return log_z, post, pairs


def whole_marginals(emit: np.ndarray, text: np.ndarray, trans: np.ndarray, block: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """Label marginals (words, L) and expected transition counts (L, L) of whole sequences, exactly, by scaled forward-backward.

    ``emit`` (words, L) has the words of all sequences one after the other, ``text`` (words,) the number of each word's sequence. Sequences are
    dealt out in blocks. All blocks are walked at once: first for the product of their transfer matrices, which carry the messages from block to
    block, then for the messages inside. So a sequence isn't cut anywhere, and the steps are those of one block and the number of blocks of the longest.
    """
    n, k = emit.shape
    if not n:
        return np.zeros((0, k)), np.zeros((k, k))
    new = np.ones(n, dtype=bool)
    new[1:] = text[1:] != text[:-1]
    begin = np.nonzero(new)[0]
    inside = np.arange(n) - np.repeat(begin, np.diff(np.append(begin, n)))
    step, number = inside % block, np.cumsum(inside % block == 0) - 1
    length = np.bincount(number)
    steps, count = int(length.max()), len(length)
    first = inside[step == 0] == 0  # of each block: whether it starts a sequence
    move, tiny = np.exp(trans - trans.max()), 1e-300
    one, ones = np.ones(k), np.ones(k * k)  # sums over short axes as products, which numpy does much faster

    def scaled(x):
        return x / np.maximum(x @ one, tiny)[:, None]

    e = np.ones((steps, count, k))
    e[step, number] = np.exp(emit - emit.max(axis=1, keepdims=True))

    last = np.append(first[1:], True)
    many = np.nonzero(~(first & last))[0]  # blocks of sequences that have more than one
    incoming, outgoing = np.ones((count, k)), np.ones((count, k))
    if len(many):
        p = np.where(first[many][:, None, None], np.eye(k), move) * e[0, many][:, None, :]
        for t in range(1, steps):
            q = (p.reshape(-1, k) @ move).reshape(-1, k, k) * e[t, many][:, None, :]
            q /= np.maximum(q.reshape(-1, k * k) @ ones, tiny)[:, None, None]
            short = t >= length[many]
            q[short] = p[short]
            p = q
        place = np.full(count, -1)
        place[many] = np.arange(len(many))
        heads = np.nonzero(first)[0]
        blocks = np.diff(np.append(heads, count))
        for j in range(1, int(blocks.max())):
            at = heads[blocks > j] + j
            x = np.einsum("ni,nij->nj", incoming[at - 1], p[place[at - 1]])
            incoming[at] = scaled(x)
        for j in range(int(blocks.max()) - 1, 0, -1):
            at = heads[blocks > j] + j
            x = np.einsum("nij,nj->ni", p[place[at]], outgoing[at])
            outgoing[at - 1] = scaled(x)

    a, b = np.empty_like(e), np.empty_like(e)
    before = np.where(first[:, None], 1.0, incoming @ move)  # what each block's first word is told
    for t in range(steps):
        a[t] = scaled((a[t - 1] @ move if t else before) * e[t])
    b[steps - 1] = outgoing
    for t in range(steps - 2, -1, -1):
        b[t] = scaled((e[t + 1] * b[t + 1]) @ move.T)
        short = t + 1 >= length
        b[t, short] = outgoing[short]
    alpha, beta, e = a[step, number], b[step, number], e[step, number]
    post = scaled(alpha * beta)
    on = np.nonzero(~new)[0]
    left, right = alpha[on - 1], e[on] * beta[on]
    pairs = move * ((left / np.maximum(((left @ move) * right) @ one, tiny)[:, None]).T @ right)
    return post, pairs


def viterbi(emit: np.ndarray, trans: np.ndarray, length: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Best labels (T, N). ``first`` and ``last`` (N, L) score the labels at both ends; ties go to the smaller label."""
    steps, n, labels = emit.shape
    back = np.zeros((steps, n, labels), dtype=np.int8)
    score = emit[0] + first
    for t in range(1, steps):
        options = score[:, :, None] + trans[None]
        back[t] = options.argmax(1)
        score = np.where((t < length)[:, None], options.max(1) + emit[t], score)
    best = np.zeros((steps, n), dtype=np.int64)
    now = (score + last).argmax(1)
    every = np.arange(n)
    for t in range(steps - 1, -1, -1):
        best[t] = now
        now = np.where((t < length) & (t > 0), back[t][every, now], now)
    return best


def ascend(gradient, size: int, rounds: int, rate: float = 0.5) -> np.ndarray:
    """Maximise with Adagrad steps; ``gradient`` maps the parameters to the gradient of what is maximised."""
    x, seen = np.zeros(size), np.full(size, 1e-8)
    for _ in range(rounds):
        g = gradient(x)
        seen += g * g
        x += rate * g / np.sqrt(seen)
    return x

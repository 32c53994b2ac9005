"""A linear-chain conditional random field in array operations.

Features are sparse and binary; a position's emission is the sum of its features'
weights. Sequences are batched as padded arrays (sequence, position, label).
"""

from __future__ import annotations

import numpy as np


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def forward_backward(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray, begin: np.ndarray, pairs: bool = False):
    """Marginals (n, length, k), log partition (n), and with ``pairs`` the expected transitions summed up (k, k).

    Padding is at the end of a sequence; its marginals are 0.
    """
    n, length, k = emit.shape
    alpha = np.empty_like(emit)
    alpha[:, 0] = emit[:, 0] + begin
    for i in range(1, length):
        step = _lse(alpha[:, i - 1, :, None] + trans, 1) + emit[:, i]
        alpha[:, i] = np.where(mask[:, i, None], step, alpha[:, i - 1])
    log_z = _lse(alpha[:, -1], 1)
    beta = np.zeros_like(emit)
    expected = np.zeros((k, k))
    for i in range(length - 2, -1, -1):
        ahead = emit[:, i + 1] + beta[:, i + 1]
        on = mask[:, i + 1]
        if pairs and on.any():
            both = alpha[on, i, :, None] + trans + ahead[on, None, :] - log_z[on, None, None]
            expected += np.exp(both).sum(axis=0)
        beta[:, i] = np.where(on[:, None], _lse(trans + ahead[:, None, :], 2), beta[:, i + 1])
    marginals = np.exp(alpha + beta - log_z[:, None, None]) * mask[:, :, None]
    return marginals, log_z, expected


def viterbi(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The best labels (n, length); padding repeats the last one."""
    n, length, k = emit.shape
    best = emit[:, 0] + begin
    back = np.zeros((n, length, k), np.int64)
    for i in range(1, length):
        step = best[:, :, None] + trans
        on = mask[:, i, None]
        back[:, i] = np.where(on, step.argmax(axis=1), np.arange(k))
        best = np.where(on, step.max(axis=1) + emit[:, i], best)
    out = np.empty((n, length), np.int64)
    out[:, -1] = best.argmax(axis=1)
    for i in range(length - 1, 0, -1):
        out[:, i - 1] = back[np.arange(n), i, out[:, i]]
    return out


def two_state_pairs(emit: np.ndarray, mask: np.ndarray, trans: np.ndarray, begin: np.ndarray):
    """forward_backward() with pairs for two labels, scaled at each position in place of logarithms."""
    n, length, _ = emit.shape
    gap = np.clip(emit[:, :, 1] - emit[:, :, 0], -50, 50).T
    odds = np.exp(np.ascontiguousarray(gap))
    t = np.exp(np.clip(trans - trans.max(), -50, 0))
    on = np.ascontiguousarray(mask.T)
    p = np.empty((length, n))  # probability of label 1 given what came before
    x = odds[0] * np.exp(np.clip(begin[1] - begin[0], -50, 50))
    p[0] = x / (1 + x)
    for i in range(1, length):
        zero, one = t[0, 0] + p[i - 1] * (t[1, 0] - t[0, 0]), odds[i] * (t[0, 1] + p[i - 1] * (t[1, 1] - t[0, 1]))
        p[i] = np.where(on[i], one / (zero + one), p[i - 1])
    out = np.empty((n, length, 2))
    expected = np.zeros((2, 2))
    q = np.full(n, 0.5)  # backward message of label 1, scaled to a sum of one
    for i in range(length - 1, -1, -1):
        one, zero = p[i] * q, (1 - p[i]) * (1 - q)
        out[:, i, 1] = one / (one + zero)
        if i:
            a, b = (1 - q), odds[i] * q
            w = np.stack([(1 - p[i - 1]) * t[0, 0] * a, (1 - p[i - 1]) * t[0, 1] * b, p[i - 1] * t[1, 0] * a, p[i - 1] * t[1, 1] * b])
            expected += (w / w.sum(axis=0))[:, on[i]].sum(axis=1).reshape(2, 2)
            zero, one = t[0, 0] * a + t[0, 1] * b, t[1, 0] * a + t[1, 1] * b
            q = np.where(on[i], one / (zero + one), q)
    out[:, :, 0] = 1 - out[:, :, 1]
    return out * mask[:, :, None], None, expected


def chain_marginals(gap: np.ndarray, first: np.ndarray, trans: np.ndarray, begin: np.ndarray, block: int = 32) -> np.ndarray:
    """P(label 1) by position over whole chains of two labels laid end to end.

    ``gap`` are emission differences, chain k is gap[first[k]:first[k+1]]. Chains are cut
    into blocks whose 2 x 2 transfer matrices are multiplied up for all blocks at once;
    messages then pass from block to block along each chain, for all chains at once, and
    into the blocks again. So this is the forward-backward of the whole chain, exactly.
    """
    sizes = np.diff(first)
    many = -(-sizes // block)
    at_block = np.cumsum(many) - many
    n = int(many.sum())
    if not n:
        return np.zeros(0)
    chain = np.repeat(np.arange(len(sizes)), many)
    number = np.arange(n) - at_block[chain]
    start = first[chain] + number * block
    size = np.minimum(block, first[chain + 1] - start)
    odds = np.ones((block, n))
    on = np.arange(block)[:, None] < size
    flat = start + np.arange(block)[:, None]
    odds[on] = np.exp(np.clip(gap, -50, 50))[flat[on]]
    t = np.exp(np.clip(trans - trans.max(), -50, 0))
    # transfer matrices of whole blocks: (a0, a1) before a block to after it, up to scale
    m = np.zeros((2, 2, n))
    m[0, 0] = m[1, 1] = 1
    for i in range(block):
        zero, one = t[0, 0] * m[0] + t[1, 0] * m[1], odds[i] * (t[0, 1] * m[0] + t[1, 1] * m[1])
        scale = 1 / (zero + one).sum(axis=0)
        m[0], m[1] = zero * scale, one * scale
    # forward: probability of label 1 just before each block, chain by chain in step
    p = np.empty((block, n))
    opening = np.full(n, -1.0)
    order = np.argsort(-many, kind="stable")  # chains with more blocks first
    upto = np.searchsorted(-many[order], -np.arange(1, int(many.max()) + 1), side="right")  # chains with so many blocks

    def enter(b: np.ndarray, lead: bool) -> np.ndarray:
        """p at the first position of blocks ``b``."""
        if lead:
            x = odds[0, b] * np.exp(np.clip(begin[1] - begin[0], -50, 50))
            return x / (1 + x)
        zero, one = t[0, 0] + opening[b] * (t[1, 0] - t[0, 0]), odds[0, b] * (t[0, 1] + opening[b] * (t[1, 1] - t[0, 1]))
        return one / (zero + one)

    def onward(b: np.ndarray) -> None:
        for i in range(1, block):
            zero, one = t[0, 0] + p[i - 1, b] * (t[1, 0] - t[0, 0]), odds[i, b] * (t[0, 1] + p[i - 1, b] * (t[1, 1] - t[0, 1]))
            p[i, b] = one / (zero + one)

    lead = at_block[many > 0]
    p[0, lead] = enter(lead, True)
    onward(lead)
    closing = p[block - 1].copy()
    for k in range(1, len(upto)):
        b = at_block[order[: upto[k]]] + k
        opening[b] = closing[b - 1]
        zero = m[0, 0, b] * (1 - opening[b]) + m[0, 1, b] * opening[b]
        one = m[1, 0, b] * (1 - opening[b]) + m[1, 1, b] * opening[b]
        closing[b] = one / (zero + one)
    rest = np.flatnonzero(number > 0)
    if len(rest):
        p[0, rest] = enter(rest, False)
        onward(rest)
    # backward: message of label 1 just after each block, scaled to a sum of one
    q = np.full(n, 0.5)
    for k in range(len(upto) - 1, 0, -1):
        b = at_block[order[: upto[k]]] + k
        last = many[order[: upto[k]]] - 1 == k
        b_full = b[~last]
        zero = m[0, 0, b_full] * (1 - q[b_full]) + m[1, 0, b_full] * q[b_full]
        one = m[0, 1, b_full] * (1 - q[b_full]) + m[1, 1, b_full] * q[b_full]
        q[b_full - 1] = one / (zero + one)
        b_last = b[last]
        if len(b_last):
            v = np.full(len(b_last), 0.5)
            for i in range(block - 1, -1, -1):
                a, c = 1 - v, odds[i, b_last] * v
                zero, one = t[0, 0] * a + t[0, 1] * c, t[1, 0] * a + t[1, 1] * c
                v = np.where(on[i, b_last], one / (zero + one), v)
            q[b_last - 1] = v
    out = np.empty((block, n))
    for i in range(block - 1, -1, -1):
        one, zero = p[i] * q, (1 - p[i]) * (1 - q)
        out[i] = one / (one + zero)
        a, c = 1 - q, odds[i] * q
        zero, one = t[0, 0] * a + t[0, 1] * c, t[1, 0] * a + t[1, 1] * c
        q = np.where(on[i], one / (zero + one), q)
    result = np.empty(len(gap))
    result[flat[on]] = out[on]
    return result


def train(rows: np.ndarray, cols: np.ndarray, labels: np.ndarray, mask: np.ndarray, n_features: int, k: int, rounds: int = 80, rate: float = 0.3, l2: float = 1e-4):
    """Weights (features, k), transitions (k, k) and begin (k) by gradient ascent with Adam's step sizes.

    ``rows`` are flat positions (sequence * length + position) and ``cols`` the features
    active there; ``labels`` (n, length) are the right labels, ``mask`` tells padding.
    The result depends on nothing but the arguments.
    """
    n, length = labels.shape
    size = n_features * k
    w = np.zeros(size + k * k + k)
    m, v = np.zeros_like(w), np.zeros_like(w)
    flat = labels.ravel()
    on = mask.ravel()
    gold = np.zeros((n * length, k))
    gold[np.flatnonzero(on), flat[on]] = 1
    gold_pairs = np.zeros((k, k))
    both = mask[:, 1:] & mask[:, :-1]
    np.add.at(gold_pairs, (labels[:, :-1][both], labels[:, 1:][both]), 1)
    gold_begin = np.bincount(labels[:, 0][mask[:, 0]], minlength=k)
    total = max(1, int(on.sum()))
    for step in range(1, rounds + 1):
        weights, trans, begin = w[:size].reshape(n_features, k), w[size : size + k * k].reshape(k, k), w[size + k * k :]
        emit = np.stack([np.bincount(rows, weights[cols, j], n * length) for j in range(k)], axis=1).reshape(n, length, k)
        marginals, _, expected = two_state_pairs(emit, mask, trans, begin) if k == 2 else forward_backward(emit, mask, trans, begin, pairs=True)
        diff = gold - marginals.reshape(-1, k)
        grad = np.concatenate([
            np.stack([np.bincount(cols, diff[rows, j], n_features) for j in range(k)], axis=1).ravel(),
            (gold_pairs - expected).ravel(),
            gold_begin - (marginals[:, 0] * mask[:, :1]).sum(axis=0),
        ]) / total - l2 * w
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad * grad
        w = w + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:size].reshape(n_features, k), w[size : size + k * k].reshape(k, k), w[size + k * k :]

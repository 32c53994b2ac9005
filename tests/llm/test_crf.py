"""The field's inference against enumeration of all label sequences."""

from itertools import product

import numpy as np
import pytest

from quire.llm import crf


def enumerate_all(emit, trans, begin):
    """(marginals, log partition, expected transitions, best sequence) of one sequence."""
    n, k = emit.shape
    scores, sequences = [], list(product(range(k), repeat=n))
    for s in sequences:
        scores.append(begin[s[0]] + sum(emit[i, s[i]] for i in range(n)) + sum(trans[a, b] for a, b in zip(s, s[1:], strict=False)))
    scores = np.array(scores)
    log_z = np.logaddexp.reduce(scores)
    p = np.exp(scores - log_z)
    marginals, pairs = np.zeros((n, k)), np.zeros((k, k))
    for s, w in zip(sequences, p, strict=True):
        for i, y in enumerate(s):
            marginals[i, y] += w
        for a, b in zip(s, s[1:], strict=False):
            pairs[a, b] += w
    return marginals, log_z, pairs, sequences[int(np.argmax(scores))]


@pytest.fixture
def batch():
    rng = np.random.default_rng(2)
    sizes = [1, 2, 5, 7, 7, 3]
    mask = np.arange(7) < np.array(sizes)[:, None]
    return rng, sizes, mask


@pytest.mark.parametrize("k", [2, 3])
def test_forward_backward_and_viterbi(batch, k):
    rng, sizes, mask = batch
    emit, trans, begin = rng.normal(size=(6, 7, k)) * mask[:, :, None], rng.normal(size=(k, k)), rng.normal(size=k)
    marginals, log_z, expected = crf.forward_backward(emit, mask, trans, begin, pairs=True)
    best = crf.viterbi(emit, mask, trans, begin)
    total = np.zeros((k, k))
    for r, n in enumerate(sizes):
        m, z, pairs, sequence = enumerate_all(emit[r, :n], trans, begin)
        total += pairs
        assert np.allclose(marginals[r, :n], m) and np.isclose(log_z[r], z) and tuple(best[r, :n]) == sequence
    assert np.allclose(expected, total)
    if k == 2:
        fast, _, pairs = crf.two_state_pairs(emit, mask, trans, begin)
        assert np.allclose(fast, marginals) and np.allclose(pairs, total)


@pytest.mark.parametrize("block", [1, 2, 3, 32])
def test_marginals_of_whole_chains(block):
    rng = np.random.default_rng(5)
    sizes = [0, 1, 2, 9, 4, 0, 11, 3, 6]
    first = np.append(0, np.cumsum(sizes))
    emit, trans, begin = rng.normal(size=(first[-1], 2)) * 2, rng.normal(size=(2, 2)) * 2, rng.normal(size=2)
    got = crf.chain_marginals(emit[:, 1] - emit[:, 0], first, trans, begin, block)
    for k, n in enumerate(sizes):
        if n:
            want = enumerate_all(emit[first[k] : first[k + 1]], trans, begin)[0]
            assert np.allclose(got[first[k] : first[k + 1]], want[:, 1])


def test_long_chain_does_not_underflow():
    gap = np.tile([40.0, -40.0, 5.0], 100_000)
    p = crf.chain_marginals(gap, np.array([0, len(gap)]), np.array([[3.0, -3.0], [-3.0, 3.0]]), np.zeros(2))
    assert np.isfinite(p).all() and (p >= 0).all() and (p <= 1).all()


def test_training_lowers_the_loss():
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, (40, 6))
    rows, cols = np.arange(240), (y.ravel() ^ (rng.random(240) < 0.1)).astype(np.int64)
    weights, trans, begin = crf.train(rows, cols, y, np.ones((40, 6), bool), 2, 2)
    best = crf.viterbi(weights[cols].reshape(40, 6, 2), np.ones((40, 6), bool), trans, begin)
    assert (best == y).mean() > 0.8

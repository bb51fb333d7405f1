import numpy as np
import pytest

from gridloom.llm.fm_index import Bits, FMIndex, Wavelet, suffix_order


def brute(symbols, phrase):
    return [i for i in range(len(symbols) - len(phrase) + 1) if list(symbols[i : i + len(phrase)]) == list(phrase)]


def test_bits_rank():
    bits = np.random.default_rng(1).integers(0, 2, 1000).astype(bool)
    b = Bits(bits)
    at = np.arange(1001)
    assert (b.rank(at) == np.concatenate([[0], np.cumsum(bits)])).all()


def test_wavelet_rank_and_access():
    s = np.random.default_rng(2).integers(0, 11, 500)
    w = Wavelet(s, 10)
    for c in range(11):
        assert (w.rank(np.full(501, c), np.arange(501)) == np.concatenate([[0], np.cumsum(s == c)])).all()
    symbol, rank = w.access_rank(np.arange(500))
    assert (symbol == s).all() and all(rank[i] == (s[:i] == s[i]).sum() for i in range(500))


@pytest.mark.parametrize("top,n,seed", [(1, 300, 0), (2, 400, 1), (5, 2000, 2), (3000, 2000, 3), (1, 1, 4)])
def test_search_and_locate_match_brute_force(top, n, seed):
    rng = np.random.default_rng(seed)
    symbols = rng.integers(0, top + 1, n).astype(np.int32)
    if n > 500:
        symbols[200:300] = symbols[0:100]
        symbols[350:450] = symbols[0:100]
    symbols[-1] = 0
    index = FMIndex(symbols, top, sample=7)
    phrases, lengths = [], []
    for _ in range(200):
        m, i = int(rng.integers(1, 11)), int(rng.integers(0, n))
        p = symbols[i : i + m] if rng.random() < 0.7 else rng.integers(1, top + 1, m)
        if len(p) and (np.asarray(p) > 0).all():
            phrases.append([*p, *[0] * (10 - len(p))])
            lengths.append(len(p))
    if not phrases:
        return
    low, high = index.search(np.array(phrases), np.array(lengths))
    for p, m, a, b in zip(phrases, lengths, low, high):
        assert sorted(index.locate(np.arange(a, b))) == brute(symbols, p[:m])


def test_long_repeats_are_ordered():
    one = np.tile(np.array([1, 2, 1, 1], np.int32), 200)
    symbols = np.concatenate([one, [0], one, [0], one[3:], [0]]).astype(np.int32)
    order = suffix_order(symbols, 2)
    assert sorted(order) == list(range(len(symbols)))
    end = lambda i: next(j for j in range(i, len(symbols)) if symbols[j] == 0)
    keys = [(*symbols[i : end(i)], 0) for i in order]
    assert keys == sorted(keys)


@pytest.mark.parametrize("n", range(1, 12))
def test_tiny_shards(n):
    symbols = np.array([1] * (n - 1) + [0], np.int32)
    low, high = FMIndex(symbols, 1).search(np.array([[1, 1, 0]]), np.array([2]))
    assert high[0] - low[0] == max(0, n - 2)

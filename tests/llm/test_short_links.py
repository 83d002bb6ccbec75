"""Links of short texts share a key, wherever their shingles fall."""

import numpy as np

from tracewell.llm import near_dedup as nd


def test_no_short_link_is_missed():
    g = np.random.default_rng(11)
    for t, small, more in ((0.80, 4, 1), (0.80, 8, 2), (0.80, 11, 2), (0.85, 6, 1), (0.85, 11, 1)):
        for _ in range(4_000):
            a = np.unique(g.integers(0, 1 << 63, small + more).astype(np.uint64) * np.uint64(2))
            b = np.sort(g.permutation(a)[:small])
            assert np.intersect1d(nd.band_keys(a, t), nd.band_keys(b, t)).size, (t, small)


def test_shared_shingles_in_the_band_of_the_differing_one():
    """4 of 5 shingles in the same bucket of every size class: no band tells that the sets are alike."""
    t = 0.80
    a = np.array([5 << 40, 6 << 40, 7 << 40, 8 << 40, 1 << 40], np.uint64)
    a = np.sort(a)
    b = a[1:]
    bands = [np.setdiff1d(nd.band_keys(x, t), nd.single_keys(x, t)) for x in (a, b)]
    assert not np.intersect1d(*bands).size
    assert np.intersect1d(nd.band_keys(a, t), nd.band_keys(b, t)).size

import tracemalloc

import numpy as np

from flightline.functions import metrics


def test_weights_are_those_of_the_plain_form_and_take_little_more_than_themselves():
    hashes = np.random.default_rng(3).integers(0, 2**64, 2000, dtype=np.uint64)
    tracemalloc.start()
    found = metrics.poisson_weights(hashes, 500)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 1.5 * found.nbytes
    x = hashes[:, None] + np.arange(1, 501, dtype=np.uint64)[None, :] * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    edges = np.exp(-1.0) * np.cumsum(1 / np.cumprod(np.append(1.0, np.arange(1.0, 13.0))))
    assert np.array_equal(found, np.searchsorted(edges, u.ravel(), "right").reshape(u.shape))

import random

import numpy as np

from quillon.llm import toxicity


def rows(rng, clean, toxic):
    """A weak marker that a tenth of clean and half of toxic rows have."""
    has = lambda share: {0: 1.0} if rng.random() < share else {}
    return [(has(0.1), 0) for _ in range(clean)] + [(has(0.5), 1 + i % 3) for i in range(toxic)]


def test_results_do_not_depend_on_the_sampling_rates():
    rng = random.Random(3)
    fit = lambda got, **more: toxicity.train(toxicity.Model(["weak"], np.zeros(0), np.zeros(0)), got, **more)
    whole = fit(rows(rng, 9000, 1000)).above("weak")
    sampled = rows(rng, 1000, 1000)
    assert np.abs(fit(sampled, weights=(9.0, 1.0)).above("weak") - whole).max() < 0.08
    assert whole[0] < 0.5 < fit(sampled).above("weak")[0]

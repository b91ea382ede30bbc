"""How much the language model trains in its single pass."""

import numpy as np

from tempora.llm import lm_score


class Counting:
    def __init__(self):
        self.rng, self.drawn = np.random.default_rng(0), []

    def choice(self, n, size, p):
        self.drawn.append(size)
        return self.rng.choice(n, size, p=p)


def test_steps_and_noise_samples_of_a_pass():
    n = 20_480
    net = lm_score.LogBilinear(np.full(lm_score.SYMBOLS, 1 / lm_score.SYMBOLS))
    sym = np.random.default_rng(1).integers(0, lm_score.SYMBOLS, n)
    rng = Counting()
    net.train(sym, *lm_score.contexts(sym, np.array([0, n])), rng, net.new_grads())
    assert len(rng.drawn) >= n // 1024 and min(rng.drawn) >= 64

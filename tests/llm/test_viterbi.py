"""The decoder against every path of short lattices."""

import itertools
import random

import numpy as np
import pytest

from colophon.llm import toxicity


def path_score(path, model):
    x = y = 0
    total = 0.0
    for piece, cost in [*path, (" ", 0.0)]:
        total += cost
        for c in piece:
            z = toxicity._code(c)
            if z or y:
                total += float(model[x, y, z])
                x, y = y, z
    return total


@pytest.mark.parametrize("spaced", [False, True])
@pytest.mark.parametrize("seed", range(4))
def test_best_of_all_paths(seed, spaced):
    rng = random.Random(seed)
    model = np.log(np.random.default_rng(seed).dirichlet(np.full(64, 0.2), (64, 64)) + 1e-9).astype(np.float32)
    signs = [*toxicity.LEET, "a", "b", "e", "l", "oo", "sss", "tttt", "é", *([" ", ".", " - "] if spaced else [])]
    for _ in range(60):
        token = "".join(rng.choices(signs, k=rng.randrange(1, 7)))
        steps = toxicity.lattice(token, spaced)
        best: dict[str, float] = {}
        for path in itertools.product(*steps):
            text = "".join(p for p, _ in path)
            best[text] = max(best.get(text, -np.inf), path_score(path, model))
        found = toxicity.viterbi(token, model, spaced)
        assert found in best and best[found] == pytest.approx(max(best.values()), abs=1e-6), token


def test_long_lattices_are_linear():
    model = np.full((64, 64, 64), -4.0, np.float32)
    assert len(toxicity.viterbi("a1" * 20_000, model)) > 0

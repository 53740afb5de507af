"""The language model's size is bounded before it is built and broadcast."""

import numpy as np
import pytest

from rivulet.llm.language import Model


def test_a_model_too_large_is_refused():
    rnd = np.random.default_rng(1)
    letters = rnd.integers(97, 122, (300, 4)).astype(np.uint64)
    grams = np.unique((letters << np.array([0, 8, 16, 24], np.uint64)).sum(1, dtype=np.uint64))
    counts = {f"l{k}": (grams, np.full(len(grams), k + 1)) for k in range(6)}
    model = Model(counts, 3)
    assert len(model.langs) == 6
    with pytest.raises(ValueError, match="6 languages"):
        Model(counts, 3, model.cost.nbytes)
    assert Model({}, 3).langs == []

import random

import pytest


@pytest.fixture()
def words():
    """A source of invented words, the same in every run."""
    rng = random.Random(7)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(400)]
    return lambda n: [rng.choice(vocabulary) for _ in range(n)]

from __future__ import annotations

import random

import pytest

SF = "/root/testdata/sf0.001"
WORDS = [a + b for a in "ba ke li mo nu pa ri so tu ve".split() for b in "n r s t l x d g m p".split()]


@pytest.fixture
def rng():
    return random.Random(7)


def sentence(rng, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture
def text(rng):
    return lambda n: sentence(rng, n)

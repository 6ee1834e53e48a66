import random

import pytest


@pytest.fixture(scope="session")
def prose():
    """Texts of invented words, the same in every run."""
    random.seed(11)
    syllables = "ba ke lo mi nu pra ste tri van zel or ant esh ing".split()
    words = ["".join(random.choices(syllables, k=random.randint(1, 3))) for _ in range(900)]

    def make(n: int) -> str:
        return " ".join(random.choices(words, k=n))

    return make

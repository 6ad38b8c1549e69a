import os
import random

import pytest

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(SF):
        pytest.skip("no test tables")
    return SF


@pytest.fixture(scope="session")
def tokenizer_path():
    return pytest.importorskip("public_tokenizers").path


@pytest.fixture
def words():
    r = random.Random(7)
    return lambda n: " ".join("".join(r.choice("abcdefgéß") for _ in range(r.randint(1, 7))) for _ in range(n))

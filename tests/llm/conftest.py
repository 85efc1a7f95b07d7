import os
import random

import pytest

WORDS = ["".join(random.Random(k).choice("abdegiklmnoprstuv") for _ in range(3 + k % 6)) for k in range(600)]


@pytest.fixture
def prose():
    """Text of n invented words, the same for the same seed."""

    def make(n: int, seed: int) -> str:
        rng = random.Random(seed)
        return " ".join(rng.choice(WORDS) for _ in range(n))

    return make


@pytest.fixture
def table(spark):
    """Documents with an extra column whose names clash with columns the operators use inside."""

    def make(rows, schema="doc_id bigint, text string"):
        extra = ", doc string, body string, kept boolean, spans string, seed int, size int, n int"
        rows = [(*r, "x", "y", True, "z", 1, 2, 3) for r in rows]
        return spark.createDataFrame(rows, schema + extra)

    return make


@pytest.fixture(scope="session")
def tiny():
    return "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def tokenizer_path():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    return os.path.abspath(public_tokenizers.path("byte_bpe_50k.json"))

import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(__file__))


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").cache()


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, ties, and extra columns whose names clash."""
    rnd = random.Random(8)
    prose = [" ".join(rnd.choice(["alpha", "Beta", "gamma.", "delta", "ünï", "<|endoftext|>", "don't"]) for _ in range(n)) for n in (40, 60, 90)]
    rows = [(0, prose[0]), (1, prose[0]), (1, prose[0]), (2, None), (3, ""), (4, " \t\n "), (None, prose[1]), (None, None), (5, prose[1]), (6, "x" * 30000), (7, " ".join(prose * 60)), (8, prose[2].replace(" ", "\x0b\n")), (9, "\x00\x1c' 's 'S a'll")]
    return spark.createDataFrame([(i, t, 0.5, 1, "r", 2, [1], None) for i, t in rows], "doc_id long, text string, score double, g int, `row` string, id int, n_words array<int>, `lang` string")

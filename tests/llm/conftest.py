import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

WORDS = "lorem ipsum dolor sit amet consetetur sadipscing elitr sed diam nonumy eirmod tempor invidunt ut labore et magna".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randint(0, 60)) for _ in range(n))


@pytest.fixture(scope="session")
def texts():
    """(doc_id, text) with copies, near copies, shared lines and passages, nulls, empty, long, periodic, odd characters."""
    rng = random.Random(4)
    passage, line, base = prose(rng, 70), prose(rng, 8), prose(rng, 160)
    rows = [(i, prose(rng, rng.randint(1, 220))) for i in range(40)]
    rows += [(100 + i, f"{prose(rng, 30)} {passage} {prose(rng, 20)}") for i in range(12)]
    rows += [(200 + i, f"{prose(rng, 9)}\n  {line.upper()}\t\n{prose(rng, 9)}\n{line}") for i in range(12)]
    words = base.split()
    for i in range(25):
        near = list(words)
        for _ in range(rng.randint(0, 4)):
            near[rng.randrange(len(near))] = f"other{rng.randint(0, 9)}"
        rows.append((300 + i, " ".join(near)))
    rows += [(400, None), (401, ""), (402, "\n\n \t"), (403, "one"), (404, "two words"), (405, "A  a\x0bA\x0ca"), (406, "na " * 400), (407, "ab" * 700)]
    rows += [(408, "größe straße 日本語 \U0001f600 " * 12), (409, "größe straße 日本語 \U0001f600 " * 12), (410, prose(rng, 9000)), (None, base), (None, None), (300, rows[77][1]), (300, rows[77][1])]
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def docs(spark, texts):
    """The rows with columns whose names clash with those the operators use."""
    return spark.createDataFrame([(d, t, "en", "s", 1, 2) for d, t in texts], "doc_id long, text string, lang string, source string, n int, anchor int").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], "doc_id long, text string, lang string, source string")

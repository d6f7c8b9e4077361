from __future__ import annotations

import pytest

WORDS = "alder birch cedar fir hazel larch maple oak pine rowan spruce willow yew ash elm beech".split()


def text_of(seed: int, n: int) -> str:
    import random

    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture
def docs(spark):
    """Documents from (doc_id, text) pairs, with other columns and one of a clashing name."""

    def make(rows, extra=False):
        full = [(i, t, "en", "s", len(t or "")) + ((7,) if extra else ()) for i, t in rows]
        return spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long" + (", score int" if extra else ""))

    return make

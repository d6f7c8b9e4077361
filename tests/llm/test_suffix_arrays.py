from __future__ import annotations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from ravelin.llm.suffix_arrays import common_prefixes, suffix_array


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), max_size=80), st.integers(1, 4))
def test_order_and_prefixes(values, times):
    s = np.array([*values * times, 0])
    b = s.tolist()
    want = sorted(range(len(b)), key=lambda i: b[i:])
    got = suffix_array(s, 4)
    assert got.tolist() == want
    shared = common_prefixes(s, got, len(s), np.array([0]))
    for i in range(1, len(b)):
        x, y = b[want[i - 1] :], b[want[i] :]
        k = 0
        while k < min(len(x), len(y)) and x[k] == y[k]:
            k += 1
        assert shared[i] == k


def test_recursion_on_names():
    rng = np.random.default_rng(3)
    part = rng.integers(1, 200, 400)
    s = np.append(np.concatenate([part[i : i + 90] for i in rng.integers(0, 310, 60)]), 0)
    b = s.tolist()
    assert suffix_array(s, 200).tolist() == sorted(range(len(b)), key=lambda i: b[i:])


def test_many_symbols():
    """Alphabets of thousands of names, at random, in runs and in order."""
    rng = np.random.default_rng(5)
    part = rng.integers(1, 5000, 3000)
    for s in (part, np.concatenate([part[:900], part[:900], part[300:700]]), np.sort(part), np.sort(part)[::-1], np.repeat(part[:300], 4), np.tile([7, 3000, 12], 200)):
        s = np.append(s, 0)
        b = s.tolist()
        assert suffix_array(s, 5000).tolist() == sorted(range(len(b)), key=lambda i: b[i:])

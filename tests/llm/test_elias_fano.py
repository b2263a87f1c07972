import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mrkit.llm.elias_fano import EliasFano


@given(st.lists(st.integers(0, 2**64 - 1), max_size=80), st.sampled_from([2**64, 1000, 17]), st.lists(st.integers(0, 2**64 - 1), max_size=20))
@settings(max_examples=80, deadline=None)
def test_access_and_successor(values, universe, wanted):
    v = np.sort(np.array([x % universe for x in values], dtype=np.uint64))
    q = np.concatenate([v, np.array([x % universe for x in wanted], dtype=np.uint64)])
    sequence = EliasFano(v)
    assert (sequence.find(q) >= 0).tolist() == np.isin(q, v).tolist()
    if len(v):
        assert sequence[np.arange(len(v))].tolist() == v.tolist()
        assert sequence.successor(q).tolist() == np.searchsorted(v, q).tolist()
        begin = np.arange(len(q)) % len(v)
        end = np.minimum(begin + 3, len(v))
        inside = [b + np.searchsorted(v[b:e], x) for b, e, x in zip(begin, end, q)]
        assert sequence.successor(q, begin, end).tolist() == inside


@pytest.mark.parametrize("n", [1, 63, 64, 65, 1000])
def test_equal_values(n):
    sequence = EliasFano(np.full(n, 5))
    assert sequence.successor(np.array([4, 5, 6])).tolist() == [0, 0, n]

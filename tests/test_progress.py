import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.progress import NOTHING, Place, advance, reached, settled

JOINED = [Place(), Place(), Place((0, 1)), Place((2,), back=1)]


def test_advance():
    assert advance(NOTHING) == 0 and advance(4) == 5


@given(st.integers(-1, 9), st.integers(-1, 9))
def test_a_relation_is_as_far_as_its_slowest_source(a, b):
    assert reached(JOINED, {0: a, 1: b}) == [a, b, min(a, b), min(a, b)]


@given(st.integers(0, 9), st.integers(0, 9))
def test_what_a_reader_needs_is_not_settled(a, b):
    slow = min(a, b)
    found = settled(JOINED, [a, b, slow, slow], {3: slow})
    assert found[0] <= slow and found[1] <= slow  # the join computes epoch slow + 1 next, from the sums up to slow
    assert found[2] == slow - 1  # the delay reads one epoch back
    assert found[3] == slow - 1  # the cursor's own epoch stays


def test_graphs_are_ordered():
    with pytest.raises(ValueError):
        reached([Place((0,))], {})
    assert settled([Place()], [NOTHING], {}) == [NOTHING]

import random

import pytest

from fbrank.functions.positions import check_slice, sample_positions, slice_width

# Golden position lists (width 10 = total 100 / split 10; width 100 = total 1000 / split 10).
GOLDEN = {
    42: ([0, 1, 4], [3, 14, 81]),
    51: ([2, 3, 8], [31, 64, 70]),
    10: ([0, 6, 9], [4, 54, 73]),
    23: ([0, 1, 4], [10, 37, 99]),
    34: ([0, 5, 8], [45, 67, 74]),
    65: ([4, 6, 8], [36, 53, 65]),
    78: ([1, 3, 4], [12, 24, 38]),
    86: ([0, 5, 8], [3, 71, 99]),
    97: ([3, 5, 6], [24, 47, 54]),
    9: ([4, 5, 7], [47, 59, 78]),
}


@pytest.mark.parametrize("seed", sorted(GOLDEN))
def test_golden_positions(seed):
    w10, w100 = GOLDEN[seed]
    assert sample_positions(seed, 3, 100, 10, 0) == w10
    assert sample_positions(seed, 3, 1000, 10, 0) == w100
    # slice offset: nsplit * width
    assert sample_positions(seed, 3, 100, 10, 7) == [p + 70 for p in w10]


def test_reseeded_every_call():
    random.seed(1)
    a = sample_positions(42, 3, 100, 10, 0)
    random.random()
    assert sample_positions(42, 3, 100, 10, 0) == a


def test_slice_width_truncates():
    assert slice_width(105, 10) == 10
    assert slice_width(20, 2) == 10


@pytest.mark.parametrize("depth,total,split,nsplit", [(3, 100, 10, 10), (3, 100, 10, -1), (11, 100, 10, 0)])
def test_invalid_slices_rejected(depth, total, split, nsplit):
    with pytest.raises(ValueError):
        check_slice(depth, total, split, nsplit)


def test_depth_zero_is_empty():
    assert sample_positions(42, 0, 100, 10, 0) == []

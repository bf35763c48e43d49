"""Pivots whose scores agree to nine decimals: the smallest cell, as the SQL's ORDER BY has it."""

import numpy as np

from fieldspark.operators import placement

SMALLEST, SECOND = 5, 7


def near_ties():
    """Cells, out of order, whose lengths differ by 1e-11: the larger the cell the longer its tube."""
    cells = np.array([9, 7, SMALLEST, 8])
    a = np.eye(4)[[1, 1, 0, 2]] * (1 + 1e-11 * cells)[:, None]
    return cells, a


def test_passes(spark):
    cells, a = near_ties()
    rows = spark.createDataFrame([(int(c), t.tolist()) for c, t in zip(cells, a)], "cell long, tube array<double>").repartition(3)
    assert placement.place(rows, 3, small=0).cells == [SMALLEST, SECOND, 8]


def test_array():
    cells, a = near_ties()
    found = placement.place_array(a, 3, cells)
    assert found.cells == [SMALLEST, SECOND, 8] and np.isclose(found.scores[0], 1)


def test_uniform_passes(spark):
    """Also where the first axis is too long for a count of each of its entries."""
    cells, a = near_ties()
    far = 10**12
    rows = spark.createDataFrame([(int(c) + far, t.tolist()) for c, t in zip(cells, a)], "cell long, tube array<double>").repartition(3)
    opt = placement.Options(uniform=True, shape=[far // 16 + 1, 4, 4])
    for small in (0, placement.SMALL):
        assert placement.place(rows, 3, opt=opt, small=small).cells[0] == SMALLEST + far
        assert len(placement.place(rows, 3, opt=opt, small=small).cells) == 3

"""The cluster query over the whole grid."""

import numpy as np

from fieldspark.plans import queries

SMALL = "/root/testdata/sf0.001"


def test_every_cell(spark):
    got = queries.QUERIES["cluster_nearest"](spark, SMALL).collect()
    assert len({(r["row"], r["col"]) for r in got}) == len(got) == 100 * 100
    centres = np.array([[20, 20], [70, 30], [50, 80]])
    for r in got[::97]:
        assert r["cluster"] == np.linalg.norm(centres - [r["row"], r["col"]], axis=1).argmin()
    assert {(r["row"], r["col"]) for r in got if r["sensor"]} == {(r["row"], r["col"]) for r in queries._sensors(spark, SMALL).collect()}

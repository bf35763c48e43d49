"""The array source: slices against numpy, and the bytes they read."""

import numpy as np
import pytest
from pyspark.sql import datasource as D

from fieldspark.sources import arrays


def rows(x, where):
    at = np.argwhere(where)
    return sorted((*map(int, i), float(x[tuple(i)])) for i in at)


@pytest.mark.parametrize("order", ["C", "F"])
@pytest.mark.parametrize("kind", ["<f8", ">f4", "<i2"])
def test_whole_and_slices(spark, tmp_path, order, kind):
    x = np.asarray(np.random.default_rng(1).integers(-99, 99, (7, 4, 9)), dtype=kind, order=order)
    path = str(tmp_path / "x.npy")
    np.save(path, x)
    i, j, t = np.indices(x.shape)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        frame = arrays.read(spark, path, chunk=200)
        assert frame.columns == ["i0", "i1", "t", "v"]
        assert sorted(map(tuple, frame.collect())) == rows(x, x == x)
        for text, where in (("i0 >= 2 and i0 < 5 and t = 3", (i >= 2) & (i < 5) & (t == 3)), ("i1 in (0, 3) and t > 6 and v > 0", ((j == 0) | (j == 3)) & (t > 6) & (x > 0)), ("i0 = 99", i == 99), ("i0 + 1 = t", i + 1 == t)):
            assert sorted(map(tuple, frame.filter(text).collect())) == rows(x, where), text
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")


class Counting:
    def __init__(self, f, seen):
        self.f, self.seen = f, seen

    def __enter__(self):
        return self

    def __exit__(self, *a):
        self.f.close()

    def read(self, n=-1):
        got = self.f.read(n)
        self.seen.append((self.f.tell() - len(got), len(got)))
        return got

    def seek(self, n):
        return self.f.seek(n)

    def tell(self):
        return self.f.tell()


def test_a_slice_reads_only_its_bytes(tmp_path, monkeypatch):
    x = np.arange(50 * 20 * 30, dtype=np.float64).reshape(50, 20, 30)
    path = str(tmp_path / "x.npy")
    np.save(path, x)
    seen: list = []
    plain = arrays.open_file
    monkeypatch.setattr(arrays, "open_file", lambda p: Counting(plain(p), seen))
    assert arrays.header(path).shape == x.shape and sum(n for _, n in seen) <= 256  # metadata from the header
    reader = arrays.ArrayReader(path, 4096)
    left = list(reader.pushFilters([D.EqualTo(("i0",), 7), D.GreaterThanOrEqual(("i1",), 18), D.LessThan(("v",), 3.0), D.IsNotNull(("t",))]))
    assert [type(f) for f in left] == [D.LessThan]
    seen.clear()
    got = [b for p in reader.partitions() for b in reader.read(p)]
    assert sum(b.num_rows for b in got) == 60 and sum(n for _, n in seen) == 60 * 8 and len(seen) == 1
    assert np.array_equal(np.concatenate([b.column(3).to_numpy() for b in got]), x[7, 18:].ravel())
    inner = arrays.ArrayReader(path, 1 << 20)
    assert not list(inner.pushFilters([D.EqualTo(("t",), 4)]))
    seen.clear()
    got = [b for p in inner.partitions() for b in inner.read(p)]
    assert sum(n for _, n in seen) == 1000 * 8 and np.array_equal(np.concatenate([b.column(3).to_numpy() for b in got]), x[:, :, 4].ravel())


def test_other_content_is_refused(tmp_path):
    path = str(tmp_path / "x.npy")
    np.save(path, np.array(["a"]))
    with pytest.raises(ValueError):
        arrays.header(path)

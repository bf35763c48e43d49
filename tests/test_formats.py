"""Torch files, workbooks and MATLAB files: each against what was written, by a parser or writer of the test's own."""

import collections
import io
import pickle
import struct
import sys
import types
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldspark.sources import arrays, matfile, readers, sheets, torchfile


class _Kept:
    def __init__(self, name, member, n):
        self.name, self.member, self.n = name, member, n


def save_torch(path, tensors, bare=False, big=False):
    """A torch file as torch writes it: {key: (storage's name, numbers, offset, shape, strides)}."""
    torch, utils = types.ModuleType("torch"), types.ModuleType("torch._utils")
    for name in torchfile.STORAGES:
        setattr(torch, name, type(name, (), {"__module__": "torch", "__qualname__": name}))

    def rebuild(*a):
        raise AssertionError

    rebuild.__module__, rebuild.__qualname__, rebuild.__name__ = "torch._utils", "_rebuild_tensor_v2", "_rebuild_tensor_v2"
    utils._rebuild_tensor_v2 = rebuild

    class Tensor:
        def __init__(self, *a):
            self.a = a

        def __reduce__(self):
            return rebuild, (*self.a, False, collections.OrderedDict())

    class Pickler(pickle.Pickler):
        def persistent_id(self, x):
            return ("storage", getattr(torch, x.name), x.member, "cpu", x.n) if isinstance(x, _Kept) else None

    sys.modules |= {"torch": torch, "torch._utils": utils}
    try:
        made = collections.OrderedDict()
        for i, (key, (name, numbers, offset, shape, strides)) in enumerate(tensors.items()):
            made[key] = Tensor(_Kept(name, str(i), len(numbers)), offset, shape, strides)
        out = io.BytesIO()
        Pickler(out, protocol=2).dump(next(iter(made.values())) if bare else made)
    finally:
        del sys.modules["torch"], sys.modules["torch._utils"]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("model/data.pkl", out.getvalue())
        if big:
            z.writestr("model/byteorder", "big")
        for i, (_, numbers, *_) in enumerate(tensors.values()):
            z.writestr(f"model/data/{i}", numbers.tobytes())


def table(frame):
    return sorted(map(tuple, frame.collect()))


def cells(x):
    return sorted((*map(int, i), float(v)) for i, v in np.ndenumerate(x))


@pytest.mark.parametrize("name,kind", torchfile.STORAGES.items())
@pytest.mark.parametrize("big", [False, True])
def test_torch_numbers(tmp_path, name, kind, big):
    x = np.random.default_rng(2).integers(-9, 9, (3, 4, 5)).astype("?" if kind == "?" else kind if kind[0] != "u" else "f4" if name[0] == "B" and name != "ByteStorage" else "u1")
    stored = x
    if name == "BFloat16Storage":  # small whole numbers are exact in its 8 bits
        stored = (x.view(np.uint32) >> 16).astype("u2")
    stored = stored.astype(stored.dtype.newbyteorder(">")) if big else stored
    path = str(tmp_path / "x.pt")
    save_torch(path, {"": (name, stored.ravel(), 0, x.shape, (20, 5, 1))}, bare=True, big=big)
    reader = arrays.ArrayReader(path, 100)
    got = [tuple(r) for p in reader.partitions() for b in reader.read(p) for r in zip(*[c.to_pylist() for c in b.columns])]
    assert sorted(got) == cells(x)


def test_torch_slices_keys_and_orders(spark, tmp_path):
    x = np.arange(7 * 4 * 5, dtype="f4")
    path = str(tmp_path / "run_step_3.pt")
    save_torch(path, {
        "whole": ("FloatStorage", x, 0, (7, 4, 5), (20, 5, 1)), "part": ("FloatStorage", x, 40, (3, 4, 5), (20, 5, 1)),
        "turned": ("FloatStorage", x, 0, (5, 7, 4), (1, 20, 5)), "thin": ("FloatStorage", x, 0, (7, 1, 20), (20, 20, 1)), "gaps": ("FloatStorage", x, 0, (7, 2, 5), (20, 10, 1)),
    })
    cube = x.reshape(7, 4, 5)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        for key, want in (("whole", cube), ("part", cube[2:5]), ("turned", cube.transpose(2, 0, 1)), ("thin", x.reshape(7, 1, 20))):
            frame = arrays.read(spark, path, chunk=100, key=key)
            assert table(frame) == cells(want), key
            assert table(frame.filter("i0 = 2 and t > 1")) == [c for c in cells(want) if c[0] == 2 and c[2] > 1], key
        assert readers.load_tensor(spark, path).agg(F.sum("v"), F.min("subject")).first()[:] == (x.sum(), "run_step_3")
        row = readers.metadata(spark, path).first()
        assert row["keys"] == ["whole", "part", "turned", "thin", "gaps"] and row["shape"] == [7, 4, 5] and row["dtype"] == "float32"
    finally:
        spark.conf.unset("spark.sql.python.filterPushdown.enabled")
    with pytest.raises(ValueError, match="view"):
        arrays.header(path, "gaps")
    with pytest.raises(KeyError):
        arrays.header(path, "none")
    assert torchfile.keys(path)[0] == "whole"


class Evil:
    def __reduce__(self):
        return print, ("run",)


@pytest.mark.parametrize("content", [pickle.dumps(Evil(), 2), pickle.dumps(np.float64(1), 2), b"\x80\x02", b"(i", pickle.dumps({"epoch": 3}, 2)])
def test_torch_refuses_the_rest(tmp_path, content, capsys):
    path = str(tmp_path / "x.pt")
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("m/data.pkl", content)
    with pytest.raises((ValueError, KeyError)):
        arrays.header(path)
    assert "run" not in capsys.readouterr().out


def test_archives_of_arrays(spark, tmp_path):
    a, b = np.arange(12.0).reshape(3, 4), np.asfortranarray(np.arange(24, dtype="i2").reshape(2, 3, 4))
    np.savez(tmp_path / "x.npz", a=a, b=b)
    np.savez_compressed(tmp_path / "y.npz", a=a)
    assert table(arrays.read(spark, str(tmp_path / "x.npz"))) == cells(a)
    assert table(arrays.read(spark, str(tmp_path / "x.npz"), key="b", chunk=10)) == cells(b)
    with pytest.raises(ValueError, match="compressed"):
        arrays.header(str(tmp_path / "y.npz"))
    assert [(r["keys"], r["shape"]) for r in readers.metadata(spark, str(tmp_path / "*.npz")).orderBy("path").collect()] == [(["a", "b"], [3, 4]), (["a"], [3, 4])]


# --- workbooks -------------------------------------------------------------------------------------


def save_sheet(path, lines, shared=True, name="Data"):
    """A workbook of one sheet after an empty one."""
    strings, out = [], []
    for r, line in enumerate(lines, 1):
        if line is None:
            continue
        row = []
        for c, x in enumerate(line):
            at = f"{chr(65 + c) if c < 26 else 'A' + chr(39 + c)}{r}"
            if x is None:
                continue
            if isinstance(x, str) and shared:
                strings.append(x)
                row.append(f'<c r="{at}" t="s"><v>{len(strings) - 1}</v></c>')
            elif isinstance(x, str):
                row.append(f'<c r="{at}" t="inlineStr"><is><t>{x}</t></is></c>')
            else:
                row.append(f'<c r="{at}"><v>{x!r}</v></c>')
        out.append(f'<row r="{r}">{"".join(row)}</row>')
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("xl/workbook.xml", f'<workbook {ns}><sheets><sheet name="{name}" sheetId="1" r:id="rId7"/><sheet name="Other" sheetId="2" r:id="rId1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="rId1" Target="worksheets/sheet1.xml"/><Relationship Id="rId7" Target="/xl/worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/worksheets/sheet1.xml", f"<worksheet {ns}><sheetData/></worksheet>")
        z.writestr("xl/worksheets/sheet2.xml", f"<worksheet {ns}><sheetData>{''.join(out)}</sheetData></worksheet>")
        if shared:
            z.writestr("xl/sharedStrings.xml", f"<sst {ns}>" + "".join(f"<si><r><t>{s[:1]}</t></r><r><t>{s[1:]}</t></r><rPh><t>no</t></rPh></si>" for s in strings) + "</sst>")


@pytest.mark.parametrize("shared", [True, False])
def test_a_workbook_equals_its_csv(spark, tmp_path, shared):
    g = np.random.default_rng(5)
    head = [f"c{k}" for k in range(30)]
    lines = [head, *[["id", "x", None, 7, *[None if g.random() < 0.2 else float(g.normal()) for _ in range(26)]] for _ in range(9000)]]
    save_sheet(tmp_path / "well_step_12.xlsx", [*lines[:40], None, *lines[40:]], shared)  # a row that isn't there
    (tmp_path / "csv").mkdir()
    (tmp_path / "csv" / "well_step_12.csv").write_text("\n".join(",".join("" if x is None else str(x) for x in line) for line in lines))
    one = readers.read_static(spark, str(tmp_path / "well_step_12.xlsx"))
    two = readers.read_static(spark, str(tmp_path / "csv" / "well_step_12.csv"))
    assert one.count() == 9000 * 26 and one.exceptAll(two).count() == 0 and two.exceptAll(one).count() == 0


def test_cells_of_a_workbook(tmp_path):
    save_sheet(tmp_path / "x.xlsx", [["a", "b"], None, [1.5, None, "text"]])
    content = (tmp_path / "x.xlsx").read_bytes()
    assert list(sheets.rows(content)) == [["a", "b"], [], [1.5, None, "text"]]
    assert list(sheets.rows(content, "Other")) == []
    with pytest.raises(KeyError):
        list(sheets.rows(content, "None"))


def test_bad_workbooks_are_skipped_and_listed(spark, tmp_path):
    save_sheet(tmp_path / "a.xlsx", [["a", "b", "c", "d", "e"], [0, 0, 0, 0, 2]])
    save_sheet(tmp_path / "b.xlsx", [["a", "b", "c", "d", "e"], [0, 0, 0, 0, "word"]])
    (tmp_path / "c.xlsx").write_bytes(b"no archive")
    assert table(readers.read_static(spark, str(tmp_path)).select("subject", "row", "col", "v")) == [("a", 0, 0, 2.0)]
    assert sorted(r["path"][-6:] for r in readers.bad_files(spark, str(tmp_path)).collect()) == ["b.xlsx", "c.xlsx"]


# --- MATLAB files ----------------------------------------------------------------------------------


def load_mat(content):
    """The arrays of doubles of a level 5 file."""
    assert len(content) >= 128 and content[124:128] == b"\x00\x01IM"
    found, at = {}, 128
    while at < len(content):
        kind, size = struct.unpack_from("<II", content, at)
        assert kind == 14
        parts, k, end = [], at + 8, at + 8 + size
        while k < end:
            t, n = struct.unpack_from("<II", content, k)
            parts.append((t, content[k + 8 : k + 8 + n]))
            k += 8 + -(-n // 8) * 8
        assert k == end and [t for t, _ in parts] == [6, 5, 1, 9] and parts[0][1][0] == 6
        shape = np.frombuffer(parts[1][1], "<i4")
        found[parts[2][1].decode()] = np.frombuffer(parts[3][1], "<f8").reshape(shape, order="F")
        at = end
    return found


def test_mat_files_read_back_bit_by_bit(spark, tmp_path):
    g = np.random.default_rng(3)
    x = g.normal(size=(3, 4, 5, 6))
    x[0, 1, 2, 3], x[1, 1, 1, 1] = -0.0, np.nan
    rows = [(f"s{i[0]}", *map(int, i[1:]), float(v)) for i, v in np.ndenumerate(x) if not v == 7]
    coo = spark.createDataFrame(rows, "subject string, i0 int, i1 int, t int, v double").repartition(5)
    path = str(tmp_path / "out")
    matfile.save(coo, path, {"i0": 4, "i1": 5, "t": 6})
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["s0.mat", "s1.mat", "s2.mat"]
    for k in range(3):
        got = load_mat((tmp_path / "out" / f"s{k}.mat").read_bytes())
        assert got["u"].tobytes() == x[k].tobytes() and got["a"].tobytes() == x[k, :, :, 0].tobytes() and got["t"].ravel().tolist() == list(range(6))
    with pytest.raises(Exception, match="there already"):
        matfile.save(coo, path, {"i0": 4, "i1": 5, "t": 6})
    matfile.save(coo.filter("subject = 's1'"), path, {"i0": 4, "i1": 5, "t": 6}, mode="overwrite")
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["s1.mat"]


def test_a_failed_mat_job_leaves_nothing(spark, tmp_path):
    rows = spark.createDataFrame([("a", "u", [2], [1.0, 2.0]), ("b", "not a name", [1], [1.0])], matfile.COLUMNS)
    with pytest.raises(Exception, match="name a variable"):
        matfile.write(rows, str(tmp_path / "out"))
    assert not (tmp_path / "out").exists() or not list((tmp_path / "out").iterdir())
    with pytest.raises(Exception, match="name a file"):
        matfile.write(rows.select(F.lit("../x").alias("file"), F.lit("u").alias("name"), "shape", "data"), str(tmp_path / "out"))

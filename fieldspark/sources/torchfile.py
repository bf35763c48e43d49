"""Tensors of torch's zip files (.pt, .pth), read without torch.

Such a file is an uncompressed archive: a pickle that describes the tensors, and a member of raw numbers for each storage. The
unpickler here only rebuilds descriptions of tensors and plain containers, so nothing in a file can run. A tensor whose numbers
stand together in its storage, in any order of its axes, is read by ranges of bytes as other arrays are; a view that
skips or repeats numbers is refused, and so is the older format that is no archive.
"""

from __future__ import annotations

import math
import pickle
import zipfile
from collections import OrderedDict
from dataclasses import dataclass

import numpy as np

#: The format's names of storages and their numbers.
STORAGES = {
    "DoubleStorage": "f8", "FloatStorage": "f4", "HalfStorage": "f2", "BFloat16Storage": "u2", "LongStorage": "i8", "IntStorage": "i4",
    "ShortStorage": "i2", "CharStorage": "i1", "ByteStorage": "u1", "BoolStorage": "?",
}


@dataclass(frozen=True)
class Storage:
    kind: str
    member: str


@dataclass(frozen=True)
class Tensor:
    storage: Storage
    offset: int
    shape: tuple[int, ...]
    strides: tuple[int, ...]


def _tensor(storage, offset, shape, strides, *_):
    return Tensor(storage, offset, tuple(shape), tuple(strides))


def _parameter(tensor, *_):
    return tensor


class _Unpickler(pickle.Unpickler):
    def find_class(self, module, name):
        if module == "torch" and name in STORAGES:
            return Storage(name, "")
        known = {("torch._utils", "_rebuild_tensor_v2"): _tensor, ("torch._utils", "_rebuild_parameter"): _parameter, ("collections", "OrderedDict"): OrderedDict}
        if (module, name) not in known:
            raise ValueError(f"{module}.{name} is no tensor")
        return known[module, name]

    def persistent_load(self, pid):
        if not (isinstance(pid, tuple) and len(pid) >= 3 and pid[0] == "storage" and isinstance(pid[1], Storage)):
            raise ValueError(f"{pid} is no storage")
        return Storage(pid[1].kind, str(pid[2]))


def index_of(z: zipfile.ZipFile) -> str | None:
    """The member that describes the tensors, where the archive is torch's."""
    return next((n for n in z.namelist() if n.endswith("/data.pkl") or n == "data.pkl"), None)


def tensors(z: zipfile.ZipFile) -> dict[str, Tensor]:
    """The tensors of a file by their keys, those of nested dictionaries and lists joined by dots; a bare one has the key ''."""
    with z.open(index_of(z)) as f:
        try:
            root = _Unpickler(f).load()
        except (pickle.UnpicklingError, TypeError, AttributeError, IndexError, EOFError) as e:
            raise ValueError(f"no tensors: {e}") from e
    found: dict[str, Tensor] = {}
    todo = [("", root)]
    while todo:
        key, x = todo.pop(0)
        if isinstance(x, Tensor):
            found[key] = x
        elif isinstance(x, (dict, list, tuple)):
            todo += [(f"{key}.{k}" if key else str(k), v) for k, v in (x.items() if isinstance(x, dict) else enumerate(x))]
    return found


def header(f, z: zipfile.ZipFile, path: str, key: str | None):
    from fieldspark.sources import arrays

    found = tensors(z)
    if key is None and found:
        key = next(iter(found))
    if key not in found:
        raise KeyError(key if key is not None else path)
    t = found[key]
    order = tuple(sorted(range(len(t.shape)), key=lambda a: (-t.strides[a], -t.shape[a], a)))
    dense, width = True, 1
    for a in reversed(order):
        dense &= t.shape[a] == 1 or t.strides[a] == width
        width *= t.shape[a]
    if not t.shape or not dense and math.prod(t.shape):
        raise ValueError(f"{path}: {key or 'the tensor'} of shape {t.shape} is a number or a view of parts of its storage; save a copy of it")
    folder = index_of(z).removesuffix("data.pkl")
    ends = z.read(f"{folder}byteorder").strip() if f"{folder}byteorder" in z.namelist() else b"little"
    dtype = np.dtype(STORAGES[t.storage.kind]).newbyteorder("<" if ends == b"little" else ">")
    start = arrays.place(f, z.getinfo(f"{folder}data/{t.storage.member}"))
    return arrays.Header(t.shape, dtype, order, start + t.offset * dtype.itemsize, t.storage.kind == "BFloat16Storage")


def keys(path: str) -> list[str]:
    from fieldspark.sources import arrays

    with arrays.open_file(path) as f, zipfile.ZipFile(f) as z:
        return list(tensors(z))

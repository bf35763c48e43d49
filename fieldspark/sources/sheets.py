"""Tables of Excel workbooks (.xlsx), read without a library for them.

A workbook is an archive of XML: strings that cells share, and a sheet of rows. Both are parsed as streams, an element at a
time, so a task holds the shared strings and a batch of rows, whatever the sheet's length.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np

ROWS = 4096
_RELATION = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _elements(f, wanted: set[str]) -> Iterator[ElementTree.Element]:
    """Whole elements of the wanted names, each forgotten once it has been used, with what stood before it."""
    root = None
    for event, e in ElementTree.iterparse(f, events=("start", "end")):
        root = e if root is None else root
        if event == "end" and _local(e.tag) in wanted:
            yield e
            e.clear()
            for child in list(root):
                if _local(child.tag) == "sheetData":
                    child.clear()
            if _local(root.tag) == "sst":
                root.clear()


def _text(e: ElementTree.Element) -> str:
    """The text of a string, its runs joined, without readings beside it."""
    return "".join(t.text or "" for part in ([e] if _local(e.tag) == "t" else e) if _local(part.tag) != "rPh" for t in part.iter() if _local(t.tag) == "t")


def _column(reference: str) -> int:
    n = 0
    for c in reference:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


def _sheet(z: zipfile.ZipFile, sheet: str | None) -> str:
    """The member that holds the sheet of a name, or the workbook's first."""
    with z.open("xl/workbook.xml") as f:
        sheets = [(e.get("name"), e.get(_RELATION)) for _, e in ElementTree.iterparse(f) if _local(e.tag) == "sheet"]
    with z.open("xl/_rels/workbook.xml.rels") as f:
        targets = {e.get("Id"): e.get("Target") for _, e in ElementTree.iterparse(f) if _local(e.tag) == "Relationship"}
    found = [r for n, r in sheets if sheet is None or n == sheet]
    if not found:
        raise KeyError(sheet if sheet is not None else "no sheet")
    target = targets[found[0]]
    return target[1:] if target.startswith("/") else f"xl/{target}"


def _value(cell: ElementTree.Element, shared: list[str]):
    kind = cell.get("t", "n")
    if kind == "inlineStr":
        return "".join(_text(e) for e in cell if _local(e.tag) == "is")
    text = next((e.text for e in cell if _local(e.tag) == "v"), None)
    if text is None or kind == "e":  # empty cells and errors
        return None
    if kind == "s":
        return shared[int(text)]
    return float(text) if kind in ("n", "b") else text


def rows(content: bytes, sheet: str | None = None) -> Iterator[list]:
    """The rows of a sheet from its first to its last, cells that aren't there as None; rows that aren't there are empty lists."""
    try:
        z = zipfile.ZipFile(io.BytesIO(content))
        member = _sheet(z, sheet)
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            with z.open("xl/sharedStrings.xml") as f:
                shared = [_text(e) for e in _elements(f, {"si"})]
        at = 0
        with z.open(member) as f:
            for e in _elements(f, {"row"}):
                here = int(e.get("r", at + 1))
                for _ in range(at + 1, here):
                    yield []
                at, row = here, []
                for cell in (c for c in e if _local(c.tag) == "c"):
                    k = _column(cell.get("r")) if cell.get("r") else len(row)
                    row += [None] * (k + 1 - len(row))
                    row[k] = _value(cell, shared)
                yield row
    except (zipfile.BadZipFile, ElementTree.ParseError) as e:
        raise ValueError(f"no workbook: {e}") from e


def payloads(content: bytes, skip: int, sheet: str | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """(number of its first row, numbers) of runs of rows below the heading, without the first ``skip`` columns; what is missing is 0.
    Rows without any cell are passed over, as in the text form."""
    lines = (r for r in rows(content, sheet) if any(x is not None for x in r))
    width = len(next(lines, [])) - skip
    at, some = 0, []
    for line in lines:
        if len(line) - skip > width:
            raise ValueError(f"a row of {len(line)} cells below {width + skip} headings")
        some.append([0.0 if x is None else float(x) for x in line[skip:]] + [0.0] * (width - max(0, len(line) - skip)))
        if len(some) == ROWS:
            yield at, np.array(some)
            at, some = at + len(some), []
    if some:
        yield at, np.array(some)

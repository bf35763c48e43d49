"""Removal of byte strings that occur earlier, by a sparse suffix array over all documents.

A byte goes if a string of LENGTH bytes that covers it also starts earlier: in a smaller doc_id,
or in the same document further left. Strings are judged on the input, not on what is left.

1. Every string of LENGTH bytes owns one suffix: the one in it whose first LEAD bytes hash least (the
   leftmost of equals). So equal strings own suffixes with equal beginnings, at the same place of
   the string, and only about one suffix in 24 bytes is needed. The strings that own the same suffix
   of a text are a run; the bytes they cover are its context.
2. Sampled splitters range-partition the suffixes by the fingerprint of their first LEAD bytes, then of their
   context, so that a common beginning is split too. Contexts met before are repeated as a whole: within
   a batch before the shuffle, then within a bucket. A bucket's first and last beginnings may go on in its
   neighbours: their contexts are compared across boundaries by an aggregation. What is left for step 3 are the first
   occurrences of different contexts with the same beginning: mostly the ends of repeated passages.
3. These suffixes get their texts and are range-partitioned by their leading bytes. A bucket sorts its strings by multikey
   quicksort, whose characters are eight bytes: a string that no other equals so far is dropped at each
   step. Strings that begin like a bucket's first or last suffix are again compared across boundaries, by fingerprints of 128 bits.

Contexts count as equal if two fingerprints of 64 bits are, of the beginning and of the whole; all else compares texts.
The sample (SAMPLE documents) only places the splitters and changes no result. Texts travel compressed.

A null text is empty; texts shorter than LENGTH stay whole. Texts of any length are read in pieces with an overlap of LENGTH - 1 bytes. A
null doc_id counts as the least long, smaller than any other in use. Rows of one doc_id are no earlier than each other but by their place, so
equal rows stay or go alike. Empty tables give empty results; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import store
from fieldspark.llm.shingles import _powers_to, scramble

LENGTH, LEAD = 100, 52
#: Documents for the splitters, suffixes of each; rows a task holds before it compares them; bytes and windows worked on at once.
SAMPLE, OF_EACH, HELD, PIECE, CONTEXTS = 2000, 64, 300_000, 1 << 20, 20_000
_U = np.uint64
_seed = np.random.default_rng(20250303)
BYTES = _seed.integers(0, 1 << 64, (2, 256), dtype=np.uint64)
LEFT, RIGHT = (_U(int(x) | 1) for x in _seed.integers(0, 1 << 63, 2))
LEAST = -(1 << 63)
ROW = "kind int, k long, h long, doc long, tag long, at long"
MARK, FIRST, OPEN = 0, 1, 2


def _least_of(v: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` entries in a row, from running minima of blocks in both directions."""
    n = len(v) - width + 1
    blocks = np.concatenate([v, np.full(-len(v) % width, np.iinfo(np.uint64).max, np.uint64)]).reshape(-1, width)
    before = np.minimum.accumulate(blocks, axis=1).ravel()
    after = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(after[:n], before[width - 1 : width - 1 + n])


def owned(data: np.ndarray, bounds: np.ndarray, length: int, lead: int) -> tuple[np.ndarray, ...]:
    """For pieces of text one after another: k, h, piece, place of the suffix, first and last string of its run."""
    empty = tuple(np.zeros(0, np.int64) for _ in range(6))
    if len(data) < length:
        return empty
    power, inverse = _powers_to(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(BYTES[0][data] * power[: len(data)])))
    k = scramble((sums[lead:] - sums[:-lead]) * inverse[: len(data) - lead + 1])
    low = _U((1 << 24) - 1)
    own = (_least_of(k & ~low | np.arange(len(k), dtype=np.uint64), length - lead + 1) & low).astype(np.int64)
    start = np.arange(len(own))
    piece = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[: len(own)]
    inside = start + length <= bounds[1:][piece]
    start, own, piece = start[inside], own[inside], piece[inside]
    if not len(start):
        return empty
    new = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (piece[1:] != piece[:-1]))))
    p, lo, hi, piece = own[new], start[new], np.append(start[new[1:] - 1], start[-1]), piece[new]
    h = scramble((sums[hi + length] - sums[lo]) * inverse[lo] + (p - lo).astype(np.uint64) * LEFT + (hi - lo).astype(np.uint64) * RIGHT)
    return k[p].view(np.int64), h.view(np.int64), piece, p, lo, hi


def _pieces(texts, length: int, most: int = PIECE) -> Iterator[tuple[list[int], list[int], list[bytes]]]:
    """Runs of pieces of about ``most`` bytes: row, offset and bytes of each."""
    rows, offsets, parts, size = [], [], [], 0
    for i, t in enumerate(texts):
        t = t or b""
        for at in range(0, max(1, len(t) - length + 1), most):
            if size and size + min(len(t) - at, most) > most:
                yield rows, offsets, parts
                rows, offsets, parts, size = [], [], [], 0
            part = t[at : at + most + length - 1]
            if len(part) >= length:
                rows.append(i), offsets.append(at), parts.append(part)
                size += len(part)
    if rows:
        yield rows, offsets, parts


def _joined_marks(doc: np.ndarray, tag: np.ndarray, lo: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, ...]:
    """Marked spans of documents, those that overlap or touch as one."""
    if not len(doc):
        return doc, tag, lo, end
    order = np.lexsort((lo, tag, doc))
    doc, tag, lo, end = doc[order], tag[order], lo[order], end[order]
    other = np.concatenate(([True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])))
    group = np.cumsum(other) - 1
    # Running ends within a document: documents are lifted apart by more than any text is long.
    reach = np.maximum.accumulate(end + group * (1 << 33)) - group * (1 << 33)
    new = np.flatnonzero(other | np.concatenate(([True], lo[1:] > reach[:-1])))
    return doc[new], tag[new], lo[new], reach[np.append(new[1:] - 1, len(lo) - 1)]


def _spans(at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Bytes a packed run covers: from its first string to the end of its last."""
    p = at >> 16
    return p - (at >> 8 & 255), p - (at & 255) + length


def _later(new: np.ndarray, doc: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Of rows sorted by group, doc and at: those later than the first of their group."""
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    return (doc > doc[first]) | (at >> 16 > at[first] >> 16)


def _batch(columns, names) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


def _suffix_rows(batches, length: int, lead: int, splitters: np.ndarray, n: int):
    """bucket, k, h, doc, tag, at of the suffixes that no earlier row of the same batches makes superfluous; marks
    of those that are, as spans k to h in buckets from n on."""
    held, size = [], 0

    def out():
        k, h, doc, tag, at = (np.concatenate(x) for x in zip(*held))
        order = np.lexsort((tag, at, doc, h, k))
        k, h, doc, tag, at = (x[order] for x in (k, h, doc, tag, at))
        new = np.concatenate(([True], (k[1:] != k[:-1]) | (h[1:] != h[:-1])))
        late = _later(new, doc, at)
        twice = np.concatenate(([False], ~new[1:] & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (at[1:] == at[:-1])))
        md, mt, lo, end = _joined_marks(doc[late], tag[late], *_spans(at[late], length))
        keep = ~late & ~twice
        k, h, doc, tag, at = (x[keep] for x in (k, h, doc, tag, at))
        bucket = np.searchsorted(splitters[:, 0], k, "left")
        for i in np.flatnonzero(bucket < np.searchsorted(splitters[:, 0], k, "right")):  # a beginning that is a splitter: by context
            same = splitters[splitters[:, 0] == k[i], 1]
            bucket[i] += np.searchsorted(same, h[i], "left")
        marks = n + (md ^ tag_hash(mt)) % n
        yield _batch((np.append(bucket, marks).astype(np.int32), np.append(k, lo), np.append(h, end), np.append(doc, md), np.append(tag, mt), np.append(at, np.zeros(len(lo), np.int64))), ["bucket", "k", "h", "doc", "tag", "at"])

    def tag_hash(x):
        return (scramble(x.view(np.uint64)) >> _U(33)).astype(np.int64)

    for b in batches:
        doc, tag = b.column(0).to_numpy(), b.column(1).to_numpy()
        for s, e in store.slices(b.column(2)):
            for rows, offsets, parts in _pieces(b.column(2).slice(s, e - s).cast(pa.binary()).to_pylist(), length):
                bounds = np.cumsum([0, *map(len, parts)])
                k, h, piece, p, lo, hi = owned(np.frombuffer(b"".join(parts), np.uint8), bounds, length, lead)
                row = s + np.array(rows)[piece]
                at = (p - bounds[piece] + np.array(offsets)[piece]) << 16 | (p - lo) << 8 | (p - hi)
                held.append((k, h, doc[row], tag[row], at))
                size += len(k)
                if size >= HELD:
                    yield from out()
                    held, size = [], 0
    if size:
        yield from out()


def _runs(batches, same, most: int):
    """Rows of sorted batches in tables of whole classes (``same`` tells class borders: an array of class keys, then
    one of partition keys, per table), with flags a row: whether its class may go on elsewhere."""
    held: list = []
    count, continued, before = 0, False, None

    def cut(t: pa.Table, final: bool):
        nonlocal continued, before
        new, part = same(t)
        part_new = np.concatenate(([before is None or part[0] != before], part[1:] != part[:-1]))
        new = new | part_new
        new[0] = True
        starts = np.flatnonzero(new)
        if final or len(starts) == 1:
            end, rest = t.num_rows, None
        else:
            end, rest = starts[-1], t.slice(starts[-1])
        if not end:
            return None, rest
        starts = starts[starts < end]
        cls = np.cumsum(new[:end]) - 1
        opens = part_new[starts].copy()  # a partition's first class
        following = np.append(starts[1:], end)
        last = np.ones(len(starts), bool)
        inner = following < len(part)
        last[inner] = part[following[inner]] != part[starts[inner]]
        if following[-1] == len(part):
            last[-1] = True  # what follows is not known
        opens |= last
        if continued:
            opens[0] = True
        continued = following[-1] == len(part) and not final  # the class may go on in the next table
        before = part[end - 1]
        return (t.slice(0, end), cls, opens[cls]), rest

    for b in batches:
        if b.num_rows:
            held.append(b)
            count += b.num_rows
            if count >= most:
                got, rest = cut(pa.Table.from_batches(held).combine_chunks(), False)
                held = rest.to_batches() if rest is not None else []
                count = rest.num_rows if rest is not None else 0
                if got:
                    yield got
    if count:
        got, _ = cut(pa.Table.from_batches(held).combine_chunks(), True)
        if got:
            yield got


def _rows_out(kind, k, h, doc, tag, at) -> pa.RecordBatch:
    return _batch((np.asarray(kind, np.int32), k, h, doc, tag, at), ["kind", "k", "h", "doc", "tag", "at"])


def _contexts(batches, length: int, n: int):
    """Within a bucket: marks of repeated contexts, first contexts of beginnings with several, and those that may go on elsewhere."""

    def same(t):
        k, bucket = t["k"].to_numpy(), t["bucket"].to_numpy()
        return np.concatenate(([True], (k[1:] != k[:-1]) | (bucket[1:] >= n))), bucket

    for t, cls, opens in _runs(batches, same, HELD):
        bucket, k, h, doc, tag, at = (t[c].to_numpy() for c in ("bucket", "k", "h", "doc", "tag", "at"))
        mark = bucket >= n
        new = np.concatenate(([True], (cls[1:] != cls[:-1]) | (h[1:] != h[:-1])))
        late = _later(new, doc, at) & ~mark
        many = np.bincount(cls, weights=new)[cls] > 1
        twice = np.concatenate(([False], ~new[1:] & (doc[1:] == doc[:-1]) & (tag[1:] == tag[:-1]) & (at[1:] == at[:-1])))
        lo, end = _spans(at, length)
        joined = _joined_marks(np.append(doc[late], doc[mark]), np.append(tag[late], tag[mark]), np.append(lo[late], k[mark]), np.append(end[late], h[mark]))
        keep = ~late & ~mark & ~twice & (opens | many)
        md, mt, mlo, mend = joined
        kind = np.append(np.full(len(md), MARK), np.where(opens[keep], OPEN, FIRST))
        yield _rows_out(kind, np.append(mlo, k[keep]), np.append(mend, h[keep]), np.append(md, doc[keep]), np.append(mt, tag[keep]), np.append(np.zeros(len(md), np.int64), at[keep]))


def _with_texts(batches, length: int, lead: int):
    """suffix, left, doc, tag, lo: the context of each run asked for, from its text."""
    for b in batches:
        for i in range(b.num_rows):
            text = _unpacked(b.column(2)[i].as_py(), b.column(3)[i].as_py())
            at = pc.unique(b.column(4)[i].values).to_numpy()
            p, (lo, end) = at >> 16, _spans(at, length)
            for s in range(0, len(at), CONTEXTS):
                ps, los, ends = (x[s : s + CONTEXTS].tolist() for x in (p, lo, end))
                m = len(ps)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([text[x:y] for x, y in zip(ps, ends)], pa.binary()), pa.array([text[x:y] for x, y in zip(los, ps)], pa.binary()), pa.array([b.column(0)[i].as_py()] * m, pa.int64()), pa.array([b.column(1)[i].as_py()] * m, pa.int64()), pa.array(los, pa.int64())],
                    names=["suffix", "left", "doc", "tag", "lo"],
                )


def equal_strings(data: np.ndarray, at: np.ndarray, group: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``at`` of strings that others of their group equal, and classes of equals. Multikey quicksort, eight bytes
    a character: strings alone with their characters so far are left out."""
    live = np.arange(len(at))
    for d in [*range(0, length - 8, 8), length - 8]:
        word = np.ascontiguousarray(data[at[live][:, None] + np.arange(d, d + 8)]).view(">u8").ravel().astype(np.uint64)
        order = np.lexsort((word, group))
        word, group, live = word[order], group[order], live[order]
        new = np.concatenate(([True], (group[1:] != group[:-1]) | (word[1:] != word[:-1]))) if len(live) else np.zeros(0, bool)
        group = np.cumsum(new) - 1
        several = np.bincount(group)[group] > 1 if len(live) else new
        live, group = live[several], group[several]
        if not len(live):
            break
    return live, group


def _common(data: np.ndarray, begin: np.ndarray, size: np.ndarray, rows: np.ndarray, other: int, most: int) -> np.ndarray:
    """For each row, how many first bytes of its suffix the row ``other`` shares, ``most`` at most; 0 for those not in ``rows``."""
    out = np.zeros(len(begin), np.int64)
    m = min(most, int(size[other]))
    for s in range(0, len(rows), 4096):
        x = rows[s : s + 4096]
        where = np.minimum(begin[x][:, None] + np.arange(m), len(data) - 1)
        differs = data[where] != data[begin[other] : begin[other] + m]
        out[x] = np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), m), size[x])
    return out


def _strings(batches, length: int, lead: int):
    """Within a bucket of suffixes with their texts: marks of repeated strings, and strings that may be met elsewhere, by fingerprints."""
    power = _powers_to(length)[0][:length]

    def same(t):
        head = pc.binary_slice(t["suffix"].combine_chunks(), 0, lead)
        differs = pc.not_equal(head[1:], head[:-1]).to_numpy(zero_copy_only=False) if len(head) > 1 else np.zeros(0, bool)
        return np.concatenate(([True], differs)), np.zeros(t.num_rows, np.int64)

    for t, cls, opens in _runs(batches, same, CONTEXTS):
        doc, tag, lo = (t[c].to_numpy() for c in ("doc", "tag", "lo"))
        left, suffix = t["left"].to_pylist(), t["suffix"].to_pylist()
        nl = np.array([len(x) for x in left])
        size = nl + np.array([len(x) for x in suffix])
        data = np.frombuffer(b"".join(y for x in zip(left, suffix) for y in x), np.uint8)
        begin = np.cumsum(size) - size
        count = size - length + 1
        row = np.repeat(np.arange(len(doc)), count)
        j = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = begin[row] + j
        live, group = equal_strings(data, at, cls[row] * 256 + nl[row] - j, length)
        r, place = row[live], lo[row[live]] + j[live]
        order = np.lexsort((place, doc[r], group))
        live, group, r, place = live[order], group[order], r[order], place[order]
        new = np.concatenate(([True], group[1:] != group[:-1])) if len(live) else np.zeros(0, bool)
        late = _later(new, doc[r], place << 16) if len(live) else new
        md, mt, mlo, mend = _joined_marks(doc[r[late]], tag[r[late]], place[late], place[late] + length)
        yield _rows_out(np.full(len(md), MARK), mlo, mend, md, mt, np.zeros(len(md), np.int64))
        known = np.zeros(len(row), bool)
        known[live[late]] = True
        # Strings met elsewhere lie, in the order of suffixes, beyond this table's first or last row, whose suffix so begins as they do.
        right = length - (nl[row] - j)
        beyond = np.zeros(len(row), bool)
        for end in (0, len(doc) - 1):
            at_end = np.flatnonzero((cls == cls[end]) & opens)
            beyond |= right <= _common(data, begin + nl, size - nl, at_end, end, length)[row]
        ask = np.flatnonzero(beyond & ~known)
        for s in range(0, len(ask), 1 << 16):
            x = ask[s : s + (1 << 16)]
            where = at[x][:, None] + np.arange(length)
            h = [scramble((table[data[where]] * power).sum(axis=1, dtype=np.uint64) + (nl[row[x]] - j[x]).astype(np.uint64) * LEFT).view(np.int64) for table in BYTES]
            yield _rows_out(np.full(len(x), OPEN), h[0], h[1], doc[row[x]], tag[row[x]], (lo[row[x]] + j[x]) << 16)


def _packed(text: bytes | None) -> bytes:
    return pa.compress(text or b"", codec="zstd", asbytes=True)


def _unpacked(packed: bytes, size: int) -> bytes:
    return pa.decompress(packed, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def _keyed(docs: DataFrame) -> DataFrame:
    """doc, tag, text. Where every doc_id is on one row, the tag, which tells rows of one doc_id apart by their texts, is 0."""
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST))
    docs = docs.select(doc.alias("doc"), F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    repeats = docs.groupBy("doc").count().filter("count > 1").limit(1).count()
    tag = F.xxhash64("text", F.col("doc_id").isNull().cast("int")) if repeats else F.lit(0).cast("long")
    return docs.select("doc", tag.alias("tag"), "text", "doc_id")


def _splitters(keyed: DataFrame, length: int, lead: int, n: int) -> np.ndarray:
    """n - 1 suffixes (k, h) of a sample of SAMPLE documents, OF_EACH of each at most, that part it evenly."""
    total = keyed.count()
    few = keyed.select("text").sample(min(1.0, SAMPLE / max(1, total)), 5)

    def run(batches):
        for b in batches:
            for rows, offsets, parts in _pieces(b.column(0).cast(pa.binary()).to_pylist(), length):
                bounds = np.cumsum([0, *map(len, parts)])
                k, h, piece, *_ = owned(np.frombuffer(b"".join(parts), np.uint8), bounds, length, lead)
                order = np.lexsort((h, piece))
                rank = np.arange(len(order)) - np.searchsorted(piece[order], piece[order])
                keep = order[rank < OF_EACH]
                yield _batch((k[keep], h[keep]), ["k", "h"])

    found = store.in_arrow(few, run, "k long, h long").toPandas().to_numpy(np.int64).reshape(-1, 2)
    found = found[np.lexsort((found[:, 1], found[:, 0]))]
    return found[np.linspace(0, len(found), n + 1)[1:-1].astype(np.int64)] if len(found) >= n else found[:0]


def _across(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows that buckets left open: (marks of repeated ones, the first ones). A (k, h) is here at most once a bucket, but for
    rows of one doc_id."""
    rows = table.filter(F.col("kind") == OPEN).withColumn("p", F.col("at").bitwiseAND(F.lit(~0xFFFF)))
    first = rows.groupBy("k", "h").agg(F.min(F.struct("doc", "p")).alias("first"))
    rows = rows.join(first, ["k", "h"]).withColumn("late", F.struct("doc", "p") > F.col("first"))
    return rows.filter("late"), rows.filter("not late")


def marks(keyed: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """doc, tag, lo, end: spans of repeated bytes, which may overlap, of rows (doc, tag, text)."""
    spark = keyed.sparkSession
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    splitters = _splitters(keyed, length, lead, n)
    shared = spark.sparkContext.broadcast(splitters)  # n - 1 rows
    suffixes = store.in_arrow(keyed.select("doc", "tag", "text"), lambda it: _suffix_rows(it, length, lead, shared.value, n), "bucket int, k long, h long, doc long, tag long, at long")
    dealt = suffixes.repartitionById(n, F.col("bucket") % n).sortWithinPartitions("bucket", "k", "h", "doc", "at", "tag")
    met = store.table(store.in_arrow(dealt, lambda it: _contexts(it, length, n), ROW), "suffixes")
    late, first = _across(met)
    # One row a beginning that a bucket left open: two a bucket at most.
    several = met.filter(F.col("kind") == OPEN).groupBy("k").agg((F.min("h") < F.max("h")).alias("several")).filter("several").select("k")
    first = first.join(F.broadcast(several), "k", "left_semi")
    p, back, on = (F.shiftright("at", 16), F.shiftright("at", 8).bitwiseAND(F.lit(255)), F.col("at").bitwiseAND(F.lit(255)))
    out = [met.filter(F.col("kind") == MARK).select("doc", "tag", F.col("k").alias("lo"), F.col("h").alias("end")), late.select("doc", "tag", (p - back).alias("lo"), (p - on + length).alias("end"))]

    asked = met.filter(F.col("kind") == FIRST).select("doc", "tag", "at").unionByName(first.select("doc", "tag", "at"))
    asked = asked.groupBy("doc", "tag").agg(F.collect_set("at").alias("at"))
    texts = _with_packed(keyed).join(asked, ["doc", "tag"]).select("doc", "tag", "packed", "n_bytes", "at")
    contexts = store.in_arrow(texts, lambda it: _with_texts(it, length, lead), "suffix binary, left binary, doc long, tag long, lo long")
    contexts = contexts.repartitionByRange(n, "suffix", "doc", "lo").sortWithinPartitions("suffix", "doc", "lo")
    strings = store.table(store.in_arrow(contexts, lambda it: _strings(it, length, lead), ROW), "strings")
    late, _ = _across(strings)
    out += [strings.filter(F.col("kind") == MARK).select("doc", "tag", F.col("k").alias("lo"), F.col("h").alias("end")), late.select("doc", "tag", p.alias("lo"), (p + length).alias("end"))]
    return out[0].unionByName(out[1]).unionByName(out[2]).unionByName(out[3])


def _with_packed(keyed: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            for s, e in store.slices(b.column(2)):
                t = b.column(2).slice(s, e - s).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([b.column(0).slice(s, e - s), b.column(1).slice(s, e - s), b.column(3).slice(s, e - s), pc.cast(pc.binary_length(t), pa.int64()), pa.array([_packed(x.as_py()) for x in t], pa.binary())], names=["doc", "tag", "doc_id", "n_bytes", "packed"])

    return store.in_arrow(keyed.select("doc", "tag", "text", "doc_id"), run, "doc long, tag long, doc_id long, n_bytes long, packed binary")


def _cut(batches, make, names):
    """doc_id and what ``make`` gives for the text and its merged spans."""
    for b in batches:
        rows = []
        for i in range(b.num_rows):
            text, m = _unpacked(b.column(2)[i].as_py(), b.column(1)[i].as_py()), b.column(3)[i]
            lo = end = np.zeros(0, np.int64)
            if m.is_valid:
                lo, end = (np.asarray(pc.struct_field(m.values, f)).astype(np.int64) for f in (0, 1))
                z = np.zeros(len(lo), np.int64)
                _, _, lo, end = _joined_marks(z, z, lo, end)
            rows.append(make(text, list(zip(lo.tolist(), end.tolist()))))
        yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c) for c in zip(*rows)]] if rows else [], names=names) if rows else None


def _kept(text: bytes, spans: list[tuple[int, int]]) -> bytes:
    ends = [0, *[e for _, e in spans]]
    starts = [*[s for s, _ in spans], len(text)]
    return b"".join(text[a:b] for a, b in zip(ends, starts))


def _results(docs: DataFrame, make, columns: str, length: int, lead: int) -> DataFrame:
    if not 16 <= lead <= length - 8 or length - lead > 255:
        raise ValueError("lead must be 16 at least, and 8 to 255 less than length")
    keyed = _keyed(docs)
    found = marks(keyed, length, lead).groupBy("doc", "tag").agg(F.collect_set(F.struct("lo", "end")).alias("spans"))
    rows = _with_packed(keyed).join(found, ["doc", "tag"], "left").select("doc_id", "n_bytes", "packed", "spans")
    names = ["doc_id", *[c.split(" ")[0] for c in columns.split(", ")]]
    return store.in_arrow(rows, lambda it: (x for x in _cut(it, make, names) if x is not None), f"doc_id long, {columns}")


def remove(docs: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """Per document: doc_id, kept (the bytes left, which may part a character), starts and ends of the removed runs."""
    return _results(docs, lambda text, spans: (_kept(text, spans), [s for s, _ in spans], [e for _, e in spans]), "kept binary, starts array<bigint>, ends array<bigint>", length, lead)


def digest(docs: DataFrame, length: int = LENGTH, lead: int = LEAD) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256."""

    def make(text, spans):
        kept = _kept(text, spans)
        return len(text), len(text) - len(kept), len(spans), hashlib.sha256(kept).hexdigest()

    return _results(docs, make, "n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string", length, lead)

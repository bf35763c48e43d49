"""Removal of earlier strings, against every string of every text."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from fieldspark.llm import suffixes

SCHEMA = "doc_id long, text string, lo long, doc long"


def brute(rows, length):
    """For each row (doc_id, text): n_bytes, n_removed, n_spans, kept_sha256."""
    least = {}
    key = lambda i, s: (i is not None, i or 0, s)
    texts = [(i, (t or "").encode()) for i, t in rows]
    for i, t in texts:
        for s in range(len(t) - length + 1):
            w = t[s : s + length]
            least[w] = min(least.get(w, key(i, s)), key(i, s))
    out = []
    for i, t in texts:
        gone = bytearray(len(t))
        for s in range(len(t) - length + 1):
            if least[t[s : s + length]] < key(i, s):
                gone[s : s + length] = b"\1" * length
        kept = bytes(c for c, g in zip(t, gone) if not g)
        spans = sum(1 for j, g in enumerate(gone) if g and not (j and gone[j - 1]))
        out.append((i, len(t), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


def found(frame):
    return sorted((tuple(r) for r in frame.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(i, t, 0, 0) for i, t in rows], SCHEMA).repartition(parts)


def prose(r, n):
    return " ".join("".join(r.choice("abcdeé") for _ in range(r.randint(1, 9))) for _ in range(n))


def cases():
    r = random.Random(3)
    passages = [prose(r, k) for k in (30, 40, 60)]
    rows = []
    for i in range(60):
        parts = [prose(r, r.randint(1, 40))]
        for _ in range(r.randint(0, 3)):
            parts += [r.choice(passages)[r.randint(0, 20) :], prose(r, r.randint(0, 12))]
        rows.append((i * 3, "".join(parts)))
    rows += [(500, rows[4][1]), (501, rows[4][1]), (502, rows[7][1][50:300])]
    rows += [(600, "a" * 700), (601, "ab" * 300), (602, "a" * 350 + "b" + "a" * 200), (603, "xyz" + passages[0] * 3)]
    return rows


@pytest.mark.parametrize("length,lead", [(100, 52), (100, 32), (40, 16)])
def test_against_every_string(spark, length, lead):
    rows = cases()
    assert found(suffixes.digest(frame(spark, rows), length, lead)) == brute(rows, length)


def test_repeated_ids_nulls_and_short_texts(spark):
    r = random.Random(4)
    p = prose(r, 60)
    rows = [(None, p), (None, "q" + p), (None, p), (1, None), (2, ""), (3, "short"), (7, p), (7, p), (7, "other " + p), (8, p + p), (-5, p), (9, "é" * 99 + p)]
    assert found(suffixes.digest(frame(spark, rows))) == brute(rows, 100)
    assert suffixes.digest(frame(spark, rows).limit(0)).count() == 0


def test_small_buffers_and_pieces(spark, monkeypatch):
    """Tables cut within a class, pieces of texts, and one very common passage with other words around it."""
    r = random.Random(5)
    common = prose(r, 50)
    rows = [(i, prose(r, 4) + common + prose(r, 5) + (common[:150] if i % 3 else "")) for i in range(120)] + [(400, common[:120] * 40)]
    for name, value in (("PIECE", 300), ("HELD", 50), ("CONTEXTS", 7)):
        monkeypatch.setattr(suffixes, name, value)
    held = suffixes._runs, suffixes._pieces.__defaults__
    monkeypatch.setattr(suffixes._pieces, "__defaults__", (300,))
    keyed = suffixes._keyed(frame(spark, rows))
    spans = {}
    names = dict(length=100, lead=32)
    batches = lambda t, n: t.to_batches(max_chunksize=n)
    # In one process, so that the small buffers hold: the steps that Spark runs, with a partition as a table.
    import numpy as np
    import pyarrow as pa

    t = pa.Table.from_pandas(keyed.select("doc", "tag", "text").toPandas(), preserve_index=False)
    first = pa.Table.from_batches(suffixes._suffix_rows(batches(t, 20), splitters=np.zeros((0, 2), np.int64), n=1, **names))
    first = first.sort_by([(c, "ascending") for c in ("bucket", "k", "h", "doc", "at", "tag")])
    met = pa.Table.from_batches(suffixes._contexts(batches(first, 30), 100, 1))
    out = spark.createDataFrame(met.to_pandas(), suffixes.ROW)
    late, rest = suffixes._across(out)
    asked = [tuple(x) for x in rest.select("doc", "tag", "at").collect()] + [(d, g, a) for k, d, g, a in zip(*(met[c].to_pylist() for c in ("kind", "doc", "tag", "at"))) if k == suffixes.FIRST]
    by = {}
    for d, g, a in asked:
        by.setdefault((d, g), set()).add(a)
    texts = {i: x.encode() for i, x in rows}
    joined = pa.table({"doc": [d for d, _ in by], "tag": [g for _, g in by], "packed": [suffixes._packed(texts[d]) for d, _ in by], "n": [len(texts[d]) for d, _ in by], "at": [sorted(a) for a in by.values()]})
    contexts = pa.Table.from_batches(suffixes._with_texts(batches(joined, 9), **names)).sort_by([(c, "ascending") for c in ("suffix", "doc", "lo")])
    strings = pa.Table.from_batches(suffixes._strings(batches(contexts, 5), **names))
    late2, _ = suffixes._across(spark.createDataFrame(strings.to_pandas(), suffixes.ROW))
    for table in (met, strings):
        for k, d, lo, end in zip(*(table[c].to_pylist() for c in ("kind", "doc", "k", "h"))):
            if k == suffixes.MARK:
                spans.setdefault(d, []).append((lo, end))
    for d, a in [(x["doc"], x["at"]) for x in late.collect()]:
        p = a >> 16
        spans.setdefault(d, []).append((p - (a >> 8 & 255), p - (a & 255) + 100))
    for d, a in [(x["doc"], x["at"]) for x in late2.collect()]:
        spans.setdefault(d, []).append((a >> 16, (a >> 16) + 100))
    for i, n, removed, _, _ in brute(rows, 100):
        gone = set()
        for lo, end in spans.get(i, []):
            gone |= set(range(lo, end))
        assert len(gone) == removed, i
    assert held


def test_removed_texts(spark):
    rows = cases()
    out = {r["doc_id"]: r for r in suffixes.remove(frame(spark, rows)).collect()}
    by = {i: (t or "").encode() for i, t in rows}
    for i, r in out.items():
        t, cut = by[i], list(zip(r["starts"], r["ends"]))
        assert bytes(r["kept"]) == b"".join(t[a:b] for a, b in zip([0, *[e for _, e in cut]], [*[s for s, _ in cut], len(t)]))


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert found(suffixes.digest(docs.withColumn("lo", F.lit(1)))) == brute(rows, 100)

"""Hard negatives against all pairs of rows, in Python's integers."""

import math
import random

import numpy as np
from pyspark.sql import functions as F

from fieldspark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, v string, q long"
COLUMNS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def brute(rows, relabel=True):
    kept = []
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        if relabel and i % 7 == 0:
            label = (label + 1) % 10
        kept.append((i, label, [math.floor(256 * float(np.float32(x))) for x in v]))
    out = []
    for i, label, v in kept:
        if i % 50:
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w)), j, m) for j, m, w in kept if j != i)
        for p, j, _ in [x for x in scored if x[2] == label][:5]:
            fits = [x for x in scored if x[2] != label and 50 * -p <= 100 * -x[0] <= 95 * -p][:3]
            out += [(i, j, r, x[1], -p, -x[0]) for r, x in enumerate(fits, 1)]
    return sorted(out)


def found(frame):
    return sorted(tuple(r) for r in frame.select(*COLUMNS).collect())


def mined(spark, rows, **options):
    frame = spark.createDataFrame([(*r, "own", 1) for r in rows], SCHEMA).repartition(4)
    return found(negatives.mine(negatives.relabelled(negatives.usable(frame)), **options))


def vectors(n, width, seed, spread=1.0):
    r = random.Random(seed)
    centres = [[r.gauss(0, 1) for _ in range(width)] for _ in range(10)]
    return [(i, [c + spread * r.gauss(0, 1) for c in centres[k]], k) for i in range(n) for k in [r.randrange(10)]]


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(negatives, "ROWS", 150)
    rows = vectors(900, 8, 1)
    rows += [(1000 + i, rows[i % 3][1], i % 10) for i in range(60)]  # ties: the same vectors under several labels
    assert mined(spark, rows) == brute(rows)


def test_rows_that_take_no_part(spark):
    r = vectors(120, 4, 2)
    rows = r + [(None, [1.0] * 4, 1), (200, None, 1), (250, [1.0] * 4, None), (300, [1.0, None, 0.0, 0.0], 2), (350, [float("nan")] * 4, 3), (400, [float("inf"), 0.0, 0.0, 0.0], 3), (450, [0.0] * 4, 4), (500, [], 5), (550, [2.0, 1.0], r[0][2]), (0, r[3][1], r[3][2]), (-50, r[5][1], r[5][2])]
    assert mined(spark, rows) == brute(rows)
    assert mined(spark, []) == [] and mined(spark, [(1, None, 2)]) == []


def test_large_components_are_exact(spark):
    r = random.Random(3)
    rows = [(i, [r.choice([1, -1]) * 2.0 ** r.randrange(14, 20) + r.random() for _ in range(3)], i % 3) for i in range(110)]
    assert mined(spark, rows) == brute(rows)


def test_prunes(spark):
    """Far balls are not read: rows in well apart groups, queries that need one of them."""
    r = np.random.default_rng(4)
    x = np.round(256 * np.concatenate([20 * c + r.standard_normal((300, 6)) for c in np.eye(6)])).astype(np.int64)
    labels, ids = np.repeat(np.arange(2), 900), np.arange(1800)
    order, root = negatives.build(x, labels)
    seen = []
    plain = negatives.products
    negatives.products = lambda q, rows: (seen.append(len(rows)), plain(q, rows))[1]
    try:
        s = negatives.Search(x[:1], np.zeros(1, np.int64), ids[:1].copy(), labels[:1], np.array([negatives.LEAST]), np.array([negatives.MOST]), np.array([negatives.LEAST]), 5, True)
        s.visit(root, x[order], ids[order], labels[order], np.arange(1))
    finally:
        negatives.products = plain
    best = sorted(((-int(x[0] @ x[j]), j) for j in range(1, 900)))[:5]
    assert [(-a, b) for a, b in best] == list(zip(s.score.tolist(), s.found.tolist())) and sum(seen) < 600


def test_given_embeddings(spark):
    frame = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").withColumn("v", F.lit("own"))
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in frame.collect()]
    assert found(negatives.mine(negatives.relabelled(negatives.usable(frame)))) == brute(rows)

"""Quality by compression: zstandard dictionaries of good and bad labelled text.

A text is cut into chunks, each compressed once with the dictionary trained on good text
and once with the one trained on bad text. The normalised difference of the two sizes,
beside the sizes a byte, becomes a probability by logistic calibration on labelled rows
that neither dictionary has seen.

Dictionaries and calibration are fitted on a bounded sample of labelled rows: at most
``2 * per_class`` of each label, first in the order of a hash, half of them for either. Fitting
and scoring read whole texts.
Repeated rows get equal scores; of the labels of a doc_id the least counts, of its texts the first in
code point order; extra columns are ignored.
Null and empty texts have sizes of 0 and get the calibration's value there. Where a label is
missing altogether, the score is the share of good labels, or 0.5 without any.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import zstandard as zstd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import store
from fieldspark.llm.langid import held_out

CHUNK, LEVEL, DICTIONARY = 4096, 1, 64 << 10
PER_CLASS = 2000
PREDICTED = 0.7


def sizes(text: bytes, good, bad) -> tuple[int, int, int]:
    g = b = 0
    for i in range(0, len(text), CHUNK):
        part = text[i : i + CHUNK]
        g += len(good.compress(part))
        b += len(bad.compress(part))
    return len(text), g, b


def features(n, g, b) -> np.ndarray:
    """Normalised difference and the sizes a byte, of arrays of sizes."""
    n, g, b = (np.asarray(x, float) for x in (n, g, b))
    d = (g - b) / np.maximum(1, g + b)
    r, q = g / np.maximum(1, n), b / np.maximum(1, n)
    return np.stack([np.ones_like(d), d, d * d, r, q, r * r, d * r, np.log1p(n) / 10], axis=-1)


@dataclass
class Model:
    good: bytes
    bad: bytes
    weights: np.ndarray | None
    constant: float
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def compressors(self):
        make = lambda d: zstd.ZstdCompressor(level=LEVEL, dict_data=_prepared(d), write_content_size=False)
        return make(self.good), make(self.bad)

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.weights is None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))


def _prepared(raw: bytes):
    d = zstd.ZstdCompressionDict(raw)
    d.precompute_compress(level=LEVEL)
    return d


def _compressors(model: Model):
    return store.held(model.key, model.compressors)


def measure(docs: DataFrame, shared, keep: list[str]) -> DataFrame:
    """``keep`` and the sizes n, g, b of every whole text."""
    fields = [f for f in docs.select(*keep).schema.fields]

    def run(batches):
        good, bad = _compressors(shared.value)
        for b in batches:
            got = [sizes(t or b"", good, bad) for t in b.column(b.num_columns - 1).to_pylist()]
            n, x, y = zip(*got) if got else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64()), pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=[*keep, "n", "g", "b"])

    ddl = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in fields], "n long, g long, b long"])
    return store.in_arrow(docs.select(*keep, F.col("text").cast("binary").alias("_text")), run, ddl)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    def loss(w):
        z = np.clip(x @ w, -30, 30)
        return weight @ (np.logaddexp(0, z) - y * z) + ridge * w @ w / 2

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (weight * (p - y)) + ridge * w
        hess = (x * (weight * p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        now = loss(w)
        while loss(w - step) > now and np.abs(step).max() >= 1e-8:  # full steps may diverge
            step /= 2
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """Learn from the labelled rows that aren't held out."""
    spark = docs.sparkSession
    order = F.xxhash64(F.lit("quality"), F.col("doc_id"))
    marks = labels.filter(~held_out() & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min(F.col("quality").cast("int")).alias("quality"))
    few = marks.filter("quality = 0").orderBy(order, "doc_id").limit(2 * per_class).unionByName(marks.filter("quality = 1").orderBy(order, "doc_id").limit(2 * per_class))
    few = few.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), F.col("doc_id")), F.lit(2)))
    rows = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(few), "doc_id")  # 4 * per_class ids at most
    rows = rows.groupBy("doc_id", "quality", "half").agg(F.min("text").alias("text"))
    texts = rows.filter("half = 0").select("quality", "text").toPandas()
    kinds = {q: sorted(texts.loc[texts["quality"] == q, "text"]) for q in (0, 1)}
    counts = {q: len(kinds[q]) for q in (0, 1)}
    total = sum(counts.values())
    if min(counts.values()) < 8:
        return Model(b"", b"", None, counts[1] / total if total else 0.5)
    raw = {q: _train([t.encode() for t in kinds[q] if t]) for q in (0, 1)}
    model = Model(raw[1], raw[0], None, 0.5)
    shared = spark.sparkContext.broadcast(model)
    half = measure(rows.filter("half = 1").select("quality", "text"), shared, ["quality"]).toPandas().sort_values(["quality", "n", "g", "b"])
    y = half["quality"].to_numpy(float)
    if not 0 < y.sum() < len(y):
        return Model(b"", b"", None, counts[1] / total)
    share = marks.agg(F.avg("quality")).first()[0]  # of all labels, for a calibrated level
    weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
    return Model(raw[1], raw[0], _logistic(features(half["n"], half["g"], half["b"]), y, weight), 0.5)


def _train(samples: list[bytes]) -> bytes:
    parts = [s[i : i + CHUNK] for s in samples for i in range(0, len(s), CHUNK)]  # as they are scored
    try:
        return zstd.train_dictionary(DICTIONARY, parts, k=512, d=8, level=LEVEL).as_bytes()
    except zstd.ZstdError:  # too little text to train on: the text itself
        return b"".join(parts)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted of every row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "text")
    if model.weights is None:
        return rows.select("doc_id", "held_out", F.lit(float(model.constant)).alias("score"), F.lit(int(model.constant >= PREDICTED)).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # two dictionaries of fixed size
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("score", pa.float64()), ("predicted", pa.int32())])

    def run(batches):
        m = shared.value
        good, bad = _compressors(m)
        for b in batches:
            got = np.array([sizes(t or b"", good, bad) for t in b.column(2).to_pylist()], float).reshape(-1, 3)
            p = m.score(features(got[:, 0], got[:, 1], got[:, 2]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(p, pa.float64()), pa.array((p >= PREDICTED).astype(np.int32))], schema=schema)

    return store.in_arrow(rows.withColumn("text", F.col("text").cast("binary")), run, "doc_id long, held_out boolean, score double, predicted int")

"""Language identification by word-first backoff.

A word seen in training scores each language with the log of its frequency there. An unseen
word falls back to its character 5-grams, then 4-grams and so on: the longest length of
which any gram is known gives the mean log frequency of its known grams. A document's
score is the softmax over languages of the sum of its words; all languages have the same prior.

The model is fitted on a bounded, stratified sample of labelled rows: at most
``per_language`` documents for each language, first in the order of a hash. Prediction
reads every whole text. Texts that are null or have no letter get ``und`` and score 0, as
do all texts where nothing could be learned. A word is a run of Unicode letters with their
combining marks. Very long texts are read to their end. Ties go to the first language in code point
order. Repeated rows get equal results; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import re
import uuid
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm import store
from fieldspark.llm.store import remainder

UNKNOWN = "und"
LONGEST = 5
PER_LANGUAGE, SALTS = 1536, 64
#: A sample of so many rows or fewer is broadcast to pick its texts, so the texts aren't dealt out.
BROADCAST_ROWS = 100_000
#: In lower-cased text up to U+024F the letters are these; elsewhere Unicode's categories say.
_LATIN = re.compile("[a-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+")
_BEYOND = re.compile("[^\x00-\u024f]")
_ANY = regex.compile(r"\p{L}[\p{L}\p{M}]*")


def words_of(text: str) -> list[str]:
    text = text.lower()
    return (_ANY if _BEYOND.search(text) else _LATIN).findall(text)


def held_out(doc_id: str = "doc_id") -> Column:
    return remainder(doc_id, 4) == 2


def grams(word: str, k: int) -> list[str]:
    s = f"^{word}$"
    return [s[i : i + k] for i in range(len(s) - k + 1)] or ([s] if k == LONGEST else [])


@dataclass
class Model:
    """Log frequencies by language: a row of ``word_scores`` for each word, of ``gram_scores`` for each gram."""

    languages: list[str]
    words: dict[str, int]
    word_scores: np.ndarray
    grams: dict[str, int]
    gram_scores: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)

    def unseen(self, word: str) -> np.ndarray:
        for k in range(min(LONGEST, len(word) + 2), 0, -1):
            found = [i for g in grams(word, k) if (i := self.grams.get(g)) is not None]
            if found:
                return self.gram_scores[found].mean(axis=0)
        return np.zeros(len(self.languages))


class Scorer(dict):
    """Words to rows of a score table; unseen words are scored once and remembered up to a bound."""

    def __init__(self, model: Model, remember: int = 150_000):
        super().__init__(model.words)
        self.model, self.room = model, len(model.words) + remember
        self.table = np.zeros((self.room + 1, len(model.languages)))
        self.table[: len(model.words)] = model.word_scores

    def __missing__(self, word: str) -> int:
        i = len(self)
        if i >= self.room:  # forget the remembered words, in the next text
            i = self.room
            self.table[i] += self.model.unseen(word)
            self.full = True
            return i
        self.table[i] = self.model.unseen(word)
        self[word] = i
        return i

    full = False

    def forget(self) -> None:
        self.clear()
        self.update(self.model.words)
        self.full = False

    def predict(self, text: str | None) -> tuple[str, float]:
        words = words_of(text) if text else []
        if not words or not self.model.languages:
            return UNKNOWN, 0.0
        if self.full:
            self.forget()
        self.table[self.room] = 0.0
        rows = list(map(self.__getitem__, words))
        spilled = rows.count(self.room)  # their scores stand summed in the last row
        total = self.table[rows].sum(axis=0)
        if spilled > 1:
            total = total - (spilled - 1) * self.table[self.room]
        p = np.exp(total - total.max())
        p /= p.sum()
        best = int(np.argmax(p))
        return self.model.languages[best], float(p[best])


def sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """doc_id, lang, text of at most ``per_language`` labelled rows a language. Ranks are taken within
    (language, salt), so that a language with most of the rows isn't sorted in one task."""
    ids = docs.filter(~held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    h = F.xxhash64(F.lit("langid"), F.col("doc_id"))
    ids = ids.select("doc_id", "lang", "text", F.pmod(h, F.lit(SALTS)).alias("salt"), h.alias("h"))
    rank = F.row_number().over(Window.partitionBy("lang", "salt").orderBy("h", "doc_id"))
    few = ids.select("doc_id", "lang", "salt", "h").withColumn("r", rank).filter(F.col("r") <= -(-per_language // SALTS))
    few = store.table(few.select(F.col("doc_id").alias("_id"), F.col("lang").alias("_lang")).distinct(), "sample")
    if few.count() <= BROADCAST_ROWS:
        few = F.broadcast(few)
    return ids.join(few, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("lang") == F.col("_lang"))).select("lang", "text")


def _count(batches, hold: int = 400_000):
    """Partial counts of words and grams of a task's texts, by language."""
    found: dict[str, Counter] = {}

    def flush():
        rows = []
        for lang, words in found.items():
            counts = Counter({"w" + w: n for w, n in words.items()})
            for w, n in words.items():
                for k in range(1, LONGEST + 1):
                    for g in grams(w, k):
                        counts[f"{k}{g}"] += n
            rows += [(lang, g, n) for g, n in counts.items()]
        found.clear()
        lang, gram, n = zip(*rows) if rows else ((), (), ())
        return pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(gram, pa.string()), pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    for b in batches:
        for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            found.setdefault(lang, Counter()).update(words_of(text))
        if sum(map(len, found.values())) > hold:
            yield flush()
    yield flush()


def fit(docs: DataFrame, per_language: int = PER_LANGUAGE, least: int = 2) -> Model:
    """Learn from ``text`` and ``lang`` of the rows that aren't held out. What comes to the driver are
    counts of words and grams of the bounded sample seen ``least`` times."""
    counts = store.in_arrow(sample(docs, per_language), _count, "lang string, gram string, n long")
    rows = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).toArrow()
    languages = sorted(set(rows["lang"].to_pylist()))
    at = np.array([languages.index(x) for x in rows["lang"].to_pylist()], np.int64)
    gram = rows["gram"].combine_chunks().dictionary_encode()
    n = np.zeros((len(gram.dictionary), len(languages)))
    n[gram.indices.to_numpy(), at] = rows["n"].to_numpy()
    names = gram.dictionary.to_pylist()
    kinds: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        kinds.setdefault(name[0], []).append(i)
    logs = np.zeros_like(n)
    for some in kinds.values():
        logs[some] = np.log((n[some] + 0.1) / (n[some].sum(axis=0) + 0.1 * len(some)))
        logs[some] -= logs[some].max(axis=1, keepdims=True)
    words = kinds.pop("w", [])
    grams_ = [i for some in kinds.values() for i in some]
    return Model(languages, {names[i][1:]: k for k, i in enumerate(words)}, logs[words], {names[i][1:]: k for k, i in enumerate(grams_)}, logs[grams_])


def _scorer(shared) -> Scorer:
    key, data = shared
    return store.held(key, lambda: Scorer(pickle.loads(data.value)))


def _apply(docs: DataFrame, model: Model, columns: list[Column], ddl: str, kinds: list[tuple[str, pa.DataType]]) -> DataFrame:
    """``columns``, the last being the text, which gives way to the prediction."""
    shared = model.key, docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))  # bounded by the sample
    schema = pa.schema([*kinds, ("lang_pred", pa.string()), ("score", pa.float64())])

    def run(batches):
        s = _scorer(shared)
        for b in batches:
            got = [s.predict(t) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array([x for x, _ in got], pa.string()), pa.array([x for _, x in got], pa.float64())], schema=schema)

    return store.in_arrow(docs.select(*columns), run, ddl)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text")]
    return _apply(docs, model, columns, "doc_id long, held_out boolean, lang_pred string, score double", [("doc_id", pa.int64()), ("held_out", pa.bool_())])


def accepted(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs`` whose language is recognised with a score of ``least`` or more, unchanged."""
    names = docs.columns
    at = names.index("text")
    shared = model.key, docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        s = _scorer(shared)
        for b in batches:
            got = [s.predict(t) for t in b.column(at).to_pylist()]
            keep = pa.array([x != UNKNOWN and p >= least for x, p in got], pa.bool_())
            yield pa.RecordBatch.from_arrays(b.columns, names=names).filter(keep)

    return store.in_arrow(docs, run, docs.schema)

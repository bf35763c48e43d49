"""Divergence of sources, in Python's integers."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldspark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, p long, m long"
TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(rows):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        words = [w.translate(LOWER) for w in TERM.findall(text or "")]
        groups.add((lang, source))
        counts[lang, source].update(words)
        docs[lang].update(set(words))
    out = []

    def ranked(lang, source, part, values, most):
        order = sorted(values, key=lambda x: (-x[1], x[0].encode()))[:most]
        out.extend((lang, source, part, item, value, r) for r, (item, value) in enumerate(order, 1))

    for lang, source in groups:
        kept = [t for t, n in docs[lang].items() if n >= 10]

        def shares(c):
            n = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 2) // (n + 2 * len(kept)) for t in kept}

        def f(p, q):
            return (p - q) ** 2 // (p + q)

        p = shares(counts[lang, source])
        others = [(b, shares(counts[lang, b])) for a, b in groups if a == lang and b != source]
        ranked(lang, source, "pair", [(b, sum(f(p[t], q[t]) for t in kept)) for b, q in others], None)
        whole = Counter()
        for a, b in groups:
            if a == lang:
                whole.update(counts[a, b])
        q = shares(whole)
        ranked(lang, source, "term", [(t, f(p[t], q[t])) for t in kept if counts[lang, source][t] and p[t] > q[t]], 10)
    return sorted(out)


def cases():
    r = random.Random(1)
    words = ["Zoo", "été", "漢字", "a", "B", "bee", "it's", "x1y", "ÉTÉ", "zoo"] + [f"w{chr(97 + i)}" for i in range(14)]
    rows = []
    for i in range(160):
        lang, source = r.choice(["en", "fr", None]), r.choice(["s", "t", "u", None, "éa"])
        rows.append((i, " ".join(r.choices(words, [1 / (k + 1) for k in range(len(words))], k=r.randint(0, 30))), lang, source))
    # Terms with the same counts everywhere, more than a source reports, and groups without terms.
    rows += [(i, " ".join(f"same{chr(97 + k)}" for k in range(25)), "de", "s") for i in range(12)]
    rows += [(400, None, "de", "empty"), (401, "", "it", "s"), (402, "rare words", "it", "t"), (None, "1 2 3", None, None), (3, "zoo", "en", "s"), (3, "zoo", "en", "s"), (5, "zoo " * 5000, "en", "t")]
    return rows


def test_against_integers(spark):
    rows = cases()
    frame = spark.createDataFrame([(*x, 1, 2) for x in rows], SCHEMA).repartition(5)
    found = sorted(tuple(x) for x in divergence.audit(frame).select("lang", "source", "part", "item", "value", "rank").collect())
    assert found == brute(rows)
    assert divergence.audit(frame.limit(0)).count() == 0


@pytest.mark.parametrize("n,total,kept", [(0, 0, 1), (5, 17, 3), (9 * 10**15, 9 * 10**15 + 3, 10**9), (10**18, 3 * 10**18, 7), (999_999_999, 10**9 - 3, 0)])
def test_shares_are_exact(spark, n, total, kept):
    row = spark.range(1).select(divergence.share(*(F.lit(x).cast("long") for x in (n, total, kept))).alias("p")).first()
    assert row["p"] == 1 + 10**9 * (n + 2) // (total + 2 * kept)


def test_small_tables_of_counts(monkeypatch):
    """Handing on counts early changes only the number of rows."""
    import pyarrow as pa

    rows = cases()
    b = pa.RecordBatch.from_arrays([pa.array([x[2] or "" for x in rows]), pa.array([x[3] or "" for x in rows]), pa.array([x[1] or "" for x in rows])], names=["lang", "source", "text"])

    def summed():
        out = Counter()
        for x in divergence._counts([b]):
            for lang, source, term, n, docs in zip(*(c.to_pylist() for c in x.columns)):
                out[lang, source, term, "n"] += n
                out[lang, source, term, "docs"] += docs
        return {k: v for k, v in out.items() if v or not k[2]}

    whole = summed()
    monkeypatch.setattr(divergence, "HELD", 3)
    monkeypatch.setattr(divergence.store, "slices", lambda c: ((i, i + 1) for i in range(len(c))))
    assert summed() == whole

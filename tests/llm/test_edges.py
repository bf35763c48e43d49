"""Nulls, empty and long texts, repeated rows, empty tables and clashing columns, for every operator."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from fieldspark.llm import ann, bpe, langid, licenses, lmscore, media, mixing, neardup, pii, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_tokens long, held_out boolean, _text string, size long"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu".split()


def text(k, n=12):
    return " ".join(WORDS[(k * 7 + i * (k % 5 + 1)) % 12] + (str(k) if i % 3 == 0 else "") for i in range(n))


def rows():
    out = [(k, text(k), ("en", "fr")[k % 2], f"s{k % 3}") for k in range(40)]
    out += [(40, None, "en", "s0"), (41, "", None, None), (42, " \t\n ", "en", None), (None, "null id here with some words", "fr", "s1"), (5, text(5), "fr", "s2"), (44, "word " * 30000, "en", "s0"), (45, "x" * 200000, None, "s1"), (46, text(3), "en", "s1"), (47, "é漢字 ß 😀", None, "s0")]
    return [(a, b, c, d, 1, 0.0, 1, True, "own", 9) for a, b, c, d in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(k, k % 2) for k in range(40)] + [(None, 1), (3, None)], "doc_id long, quality int")


def equal_texts_equal_rows(frame, docs, columns):
    t = {}
    by = {(r["doc_id"], r["text"]) for r in docs.collect()}
    texts = {}
    for i, x in by:
        texts.setdefault(i, x)
    for r in frame.collect():
        if r["doc_id"] in (3, 46):
            t.setdefault(texts[3], set()).add(tuple(r[c] for c in columns))
    assert all(len(v) == 1 for v in t.values())


def test_licenses(docs, none):
    out = licenses.scan(docs)
    assert out.count() == docs.count() and out.filter("n_hits > 0").count() == 0
    assert licenses.scan(none).count() == 0


def test_license_notices_anywhere(spark, docs, none):
    """Wrapped and embedded notices against every window of every text."""
    import random
    import re

    rng, pool = random.Random(5), list(licenses.TEMPLATES.values())
    noise = "the of license software under terms with public and version general use copy".split()
    texts = [None, "", "License", "Redistribution and use in source and\nbinary forms, with or without modification, are\npermitted provided that the following conditions are met:"]
    for i in range(60):
        inside = pool[i % len(pool)].split()
        for _ in range(rng.randrange(4)):
            inside[rng.randrange(len(inside))] = rng.choice(noise)
        inside = inside * (2 if i % 7 == 0 else 1)
        whole = rng.choices(noise, k=rng.randrange(40)) + inside + rng.choices(noise, k=rng.randrange(40))
        texts.append("".join(w + rng.choice(" \n") for w in whole))
    d = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, license string")
    got = {(r["doc_id"], r["license"]): (r["first_word"], r["last_word"], r["dice"]) for r in licenses.notices(d).collect()}
    want = {}
    for i, t in enumerate(texts):
        words = re.sub(r"[\W_]+", " ", (t or "").lower()).split()
        grams = [f"{a} {b}" for a, b in zip(words, words[1:])]
        for name, template in licenses.TEMPLATES.items():
            b = set(licenses._bigrams(template))
            best = (0.0, 0, 0)
            for s in range(len(grams)):
                seen = set()
                for e in range(s, len(grams)):
                    if grams[e] in b:
                        seen.add(grams[e])
                    v = 2.0 * len(seen) / (e - s + 1 + len(b))
                    if v > best[0]:
                        best = v, s + 1, e + 2
            if best[0] >= licenses.THRESHOLD:
                want[i, name] = best[1], best[2], round(best[0], 6)
    assert (3, "BSD-3-Clause") in want and len(want) > 40
    assert got == want
    assert licenses.notices(none).count() == 0 and licenses.notices(docs).count() >= 0


def test_license_matches(spark):
    d = spark.createDataFrame([(1, "some other line\nReleased under the MIT license\nand one more line"), (2, "Licensed under the Apache License, Version 2.0."), (3, "licensed under the moon"), (4, "released under the mit  LICENSE!")], "doc_id long, text string")
    got = {r["doc_id"]: (r["n_hits"], r["license"]) for r in licenses.scan(d).collect()}
    assert got == {1: (1, "MIT"), 2: (1, "Apache-2.0"), 3: (0, None), 4: (1, "MIT")}
    assert licenses.bounds(10, 0.8) == (7, 15)


def test_pii(docs, none):
    f = pii.fit(docs)
    out = pii.find(docs, f)
    assert out.count() == docs.count() and out.filter("spans is null").count() == 0
    assert pii.find(none, pii.fit(none)).count() == 0
    red = pii.redact(docs, f)
    assert red.columns == docs.columns and red.count() == docs.count() and red.filter("text is null").count() == 1


def test_language(docs, none):
    m = langid.fit(docs, 64)
    out = langid.predict(docs, m)
    assert out.count() == docs.count()
    und = {r["doc_id"] for r in out.filter("lang_pred = 'und'").collect()}
    assert {40, 41, 42} <= und
    kept = langid.accepted(docs, m, 0.0)
    assert kept.columns == docs.columns and kept.filter("doc_id in (40, 41, 42)").count() == 0
    e = langid.fit(none)
    assert langid.predict(none, e).count() == 0 and langid.predict(docs, e).filter("lang_pred <> 'und'").count() == 0


def test_bpe(docs, none):
    out = bpe.digest(docs)
    assert out.count() == docs.count() and out.filter("n_tokens = 0").count() == 3
    equal_texts_equal_rows(out, docs, ["n_tokens", "ids_sha256"])
    assert bpe.digest(none).count() == 0
    back = bpe.decode(bpe.encode(docs.filter("doc_id = 1"))).first()["text"]
    assert back.replace("</w>", "").replace(" ", "") == text(1).replace(" ", "")


def test_lm(docs, none):
    out = lmscore.score(docs).collect()
    assert len(out) == docs.count() and all(r["score"] < 0 and r["base_score"] < 0 for r in out)
    assert {r["n_tokens"] for r in out if r["doc_id"] in (40, 41, 42)} == {1}
    assert lmscore.score(none).count() == 0


def test_mixing(docs, none):
    out = mixing.plan(docs)
    assert out.count() == docs.count() and mixing.plan(none).count() == 0
    assert out.filter("taken > 2 * size or target > 2 * source_size").count() == 0
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.plan(docs.repartition(7)).collect()))
    m = mixing.mix(docs)
    assert m.columns == docs.columns
    many = mixing.BROADCAST_SOURCES
    mixing.BROADCAST_SOURCES = 0
    try:
        assert sorted(map(str, mixing.plan(docs).collect())) == sorted(map(str, out.collect()))
    finally:
        mixing.BROADCAST_SOURCES = many


def test_quality(docs, none, labels):
    for m in (quality.fit(docs, labels), quality.fit(none, labels), quality.fit(docs, labels.limit(0))):
        out = quality.score(docs, m)
        assert out.count() == docs.count() and out.filter("score < 0 or score > 1 or score is null").count() == 0
        assert quality.score(none, m).count() == 0


def test_media(docs, none):
    out = media.describe(docs)
    assert out.count() == docs.count() and out.filter("payload_bytes % 64 <> 0 or payload_bytes = 0").count() == 0
    equal_texts_equal_rows(out, docs, ["payload_sha256", "media_sha256", "feature"])
    assert media.describe(none).count() == 0
    clips = media.clips(media.stored(docs))
    assert clips.groupBy("doc_id").agg(F.min("start_s").alias("s")).filter("s <> 0").count() == 0


def test_neardup(docs, none):
    out = neardup.deduplicate(docs)
    got = {r["doc_id"]: (r["component_id"], r["kept"]) for r in out.collect()}
    assert out.count() == docs.count() and neardup.deduplicate(none).count() == 0
    assert got[46] == (3, False) and got[40] == (40, True) and got[42] == (42, True) and got[45] == (45, True)


def test_neighbours(spark):
    v = [(i, [float((i * k) % 7) - 3 for k in range(1, 9)], 1) for i in range(1, 60)]
    v += [(60, None, 1), (80, [0.0] * 8, 1), (100, [float("nan")] * 8, 1), (120, [1.0, None] * 4, 1), (140, [float("inf")] * 8, 1), (160, [1.0] * 4, 1), (20, [1.0] * 8, 1), (None, [1.0] * 8, 1)]
    e = spark.createDataFrame(v, "vec_id long, embedding array<float>, score int")
    out = ann.neighbours(e).collect()
    assert {r["query_id"] for r in out} == {20, 40}
    q40 = sorted((r["rank"], r["vec_id"], r["score"]) for r in out if r["query_id"] == 40)
    assert [r for r, _, _ in q40] == list(range(1, 21)) and all(a[2] > b[2] or a[2] == b[2] and a[1] <= b[1] for a, b in zip(q40, q40[1:]))
    assert ann.neighbours(e.limit(0)).count() == 0


def test_pipeline(spark, docs, none):
    now = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, "")
        assert out.columns == now.columns, name
        now = spark.createDataFrame(out.collect(), now.schema)
    ids = corpus_pipeline.tokens(spark, now, "")
    assert ids.count() == now.count() and ids.filter("n_tokens <> size(ids)").count() == 0
    empty = none.select(*now.columns)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0

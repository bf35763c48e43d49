"""How a language's sources differ in their words, in exact integers.

Words are counted by language and source within tasks, then summed. A language keeps the terms that are in
LEAST of its documents. A kept term's counts by source are a sparse vector; terms with the same vector have the same
values, so each distinct vector is kept once with the number of its terms and the first TOP of them (no more can be
among the TOP of a source). Shares are parts of 10**9: p = 1 + floor(10**9 (count + 2) / (N + 2 V)); the divergence of two shares is
f = floor((p - q)**2 / (p + q)).

Pairs of sources: a term that neither has adds the same f to a pair, so with z the share of a count of 0
    sum of f(p_a, p_b) = V f(z_a, z_b) + D(a, b) + D(b, a) + B(a, b)
where D sums f(p_a, z_b) - f(z_a, z_b) over a's counts (one row a distinct count) and B, over the distinct vectors that have
both, f(p_a, p_b) - f(p_a, z_b) - f(z_a, p_b) + f(z_a, z_b), all times the number of terms. Work grows with what
is not zero; the result itself has a row for each two sources of a language.

Null text, lang and source count as ''. Groups without terms have rows too: of value 0 where the language keeps no term. Very long texts
are counted whole; repeated rows count as often as they are there. Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fieldspark.llm import store

LEAST, TOP, PARTS = 10, 10, 1_000_000_000
#: Different (lang, source, term) a task holds before it hands them on.
HELD = 300_000
#: Bytes of a term: letters in lower case, and all beyond ASCII; others part terms.
_CUT = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def _counts(batches):
    """lang, source, term, n and in how many documents; a row of the empty term for each group."""
    held: dict = defaultdict(lambda: (Counter(), Counter()))
    size = 0

    def out():
        rows = [(k[0], k[1], t, c, docs[t]) for k, (n, docs) in held.items() for t, c in n.items()]
        rows += [(*k, b"", 0, 0) for k in held]
        for s in range(0, len(rows), 1 << 16):
            lang, source, term, n, docs = zip(*rows[s : s + (1 << 16)])
            yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(source, pa.string()), pa.array(term, pa.binary()).cast(pa.string()), pa.array(n, pa.int64()), pa.array(docs, pa.int64())], names=["lang", "source", "term", "n", "docs"])

    for b in batches:
        for s, e in store.slices(b.column(2)):
            lang, source = (b.column(c).slice(s, e - s).to_pylist() for c in (0, 1))
            for a, o, t in zip(lang, source, b.column(2).slice(s, e - s).cast(pa.binary()).to_pylist()):
                n, docs = held[a, o]
                words = t.translate(_CUT).split()
                before = len(n)
                n.update(words)
                docs.update(set(words))
                size += len(n) - before
            if size >= HELD:
                yield from out()
                held.clear()
                size = 0
    if held:
        yield from out()


def share(n: Column, total: Column, kept: Column) -> Column:
    """1 + floor(10**9 (n + 2) / (total + 2 kept)), in decimals, so that no product overflows."""
    return F.call_function("div", (n + 2).cast("decimal(19,0)") * F.lit(PARTS).cast("decimal(10,0)"), (total + 2 * kept).cast("decimal(19,0)")) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)**2 / (p + q)) of two shares."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def vectors(docs: DataFrame, least: int = LEAST, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """(lang, vec of (source, n), m terms, first terms) of the distinct vectors, and the groups (lang, source) there are."""
    empty = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    counted = store.in_arrow(docs.select(*empty), _counts, "lang string, source string, term string, n long, docs long")
    per = counted.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    terms = per.groupBy("lang", "term").agg(F.sum("docs").alias("docs"), F.array_sort(F.collect_list(F.struct("source", "n"))).alias("vec"))
    terms = store.table(terms.filter((F.col("docs") >= least) | (F.col("term") == "")).select("lang", "term", "vec"), "terms")
    groups = terms.filter("term = ''").select("lang", F.explode("vec.source").alias("source"))
    terms = terms.filter("term <> ''")
    rank = F.row_number().over(Window.partitionBy("lang", "vec").orderBy("term"))
    first = terms.withColumn("place", rank).filter(F.col("place") <= top).groupBy("lang", "vec").agg(F.array_sort(F.collect_list("term")).alias("first"))
    found = terms.groupBy("lang", "vec").agg(F.count("*").alias("m")).join(first, ["lang", "vec"])
    return store.table(found.withColumn("id", F.monotonically_increasing_id()), "vectors"), groups


def _ranked(rows: DataFrame, part: str, most: int | None) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    rows = rows.withColumn("rank", rank)
    if most is not None:
        rows = rows.filter(F.col("rank") <= most)
    return rows.select("lang", "source", F.lit(part).alias("part"), "item", "value", F.col("rank").cast("int").alias("rank"))


def audit(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank: for each source of a language all others by their divergence from it (``pair``) and
    the terms it has more often than the language by theirs (``term``, ranks to ``top``)."""
    found, groups = vectors(docs, least, top)
    entries = found.select("id", "lang", "m", F.explode("vec").alias("e")).select("id", "lang", "m", "e.*")
    sums = entries.groupBy("lang", "source").agg(F.sum(F.col("m") * F.col("n")).alias("total"))
    of_lang = found.groupBy("lang").agg(F.sum("m").alias("kept"))
    groups = groups.join(sums, ["lang", "source"], "left").join(of_lang, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "kept")])
    zero = F.lit(0).cast("long")
    groups = store.table(groups.withColumn("z", F.when(F.col("kept") > 0, share(zero, F.col("total"), F.col("kept")))), "groups")
    # Each vector's entries with their shares, once.
    entries = entries.join(groups, ["lang", "source"]).withColumn("p", share(F.col("n"), F.col("total"), F.col("kept")))
    entries = store.table(entries.select("id", "lang", "source", "m", "n", "p", "z"), "shares")

    pairs = _pairs(entries, groups)
    whole = groups.groupBy("lang").agg(F.sum("total").alias("total"), F.max("kept").alias("kept"))
    of_all = found.select("id", "lang", "first", F.aggregate("vec", F.lit(0).cast("long"), lambda a, e: a + e["n"]).alias("n")).join(whole, "lang")
    of_all = of_all.select("id", "first", share(F.col("n"), F.col("total"), F.col("kept")).alias("q"))
    more = entries.join(of_all, "id").filter("p > q and n > 0").withColumn("value", apart(F.col("p"), F.col("q")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.col("first")[0]))
    more = more.withColumn("place", rank).filter(F.col("place") <= top)
    terms = more.select("lang", "source", F.explode("first").alias("item"), "value")
    return _ranked(pairs, "pair", None).unionByName(_ranked(terms, "term", top))


def _pairs(entries: DataFrame, groups: DataFrame) -> DataFrame:
    """lang, source, item (another source), value."""
    other = groups.select("lang", F.col("source").alias("b"), F.col("z").alias("zb"))
    counts = entries.groupBy("lang", F.col("source").alias("a"), "p", F.col("z").alias("za")).agg(F.sum("m").alias("m"))
    far = apart(F.col("p"), F.col("zb")) - apart(F.col("za"), F.col("zb"))
    one = counts.join(other, "lang").filter("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("m") * far).alias("d"))
    both = one.unionByName(one.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "d"))

    packed = entries.groupBy("id", "lang", "m").agg(F.collect_list(F.struct("source", "p", "z")).alias("vec")).filter(F.size("vec") > 1)
    left = packed.select("lang", "m", "vec", F.explode("vec").alias("x"))
    met = left.select("lang", "m", "x", F.explode("vec").alias("y")).filter("x.source < y.source")
    px, zx, py, zy = F.col("x.p"), F.col("x.z"), F.col("y.p"), F.col("y.z")
    extra = F.sum(F.col("m") * (apart(px, py) - apart(px, zy) - apart(zx, py) + apart(zx, zy))).alias("d")
    met = met.groupBy("lang", F.col("x.source").alias("a"), F.col("y.source").alias("b")).agg(extra)
    both = both.unionByName(met).unionByName(met.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "d"))
    both = both.groupBy("lang", "a", "b").agg(F.sum("d").alias("d"))

    all_ = groups.select("lang", F.col("source").alias("a"), "z", "kept").join(other, "lang").filter("a <> b").join(both, ["lang", "a", "b"], "left")
    value = F.coalesce(F.col("kept") * apart(F.col("z"), F.col("zb")) + F.coalesce("d", F.lit(0).cast("long")), F.lit(0).cast("long"))
    return all_.select("lang", F.col("a").alias("source"), F.col("b").alias("item"), value.alias("value"))


SQL = r"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
t AS (SELECT id, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT id) >= 10),
size AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
every AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept ON g.lang = kept.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM every JOIN size USING (lang)),
a AS (SELECT lang, term, sum(n) AS n FROM c GROUP BY lang, term),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM a JOIN size USING (lang)),
pairs AS (SELECT x.lang, x.source, y.source AS item, sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)) AS value FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY 1, 2, 3),
pair AS (SELECT x.lang, x.source, y.source AS item, coalesce(value, 0)::BIGINT AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN pairs s ON s.lang = x.lang AND s.source = x.source AND s.item = y.source),
term AS (SELECT lang, source, term AS item, (((p - q) * (p - q)) // (p + q))::BIGINT AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
ranked AS (SELECT lang, source, 'pair' AS part, item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS r FROM pair
  UNION ALL SELECT lang, source, 'term', item, value, row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) FROM term)
SELECT lang, source, part, item, value, r::INT AS rank FROM ranked WHERE part = 'pair' OR r <= 10
"""

"""Mixing sources to target weights.

Words are counted per source, the sources get targets (shares by weight, no more than a
multiple of their own size, the excess shared again by weight), and a document is emitted
floor(rate) times plus once more if a hash-seeded draw falls below the rate's fraction,
where rate = target / size of its source. The draw depends on seed and doc_id alone, so
reruns agree, and repeated rows of one doc_id share it.

A null source is a source of its own, the last; null or empty texts have size 0; a null
doc_id draws as the empty text. Empty tables give empty results. Extra columns are kept by
``mix``, whatever their names, and ignored by ``plan``. Targets are found in one task over the
table of sources, a row each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import store

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE, MOST, SEED = 1.5, 2, "mix-1"
#: Up to so many sources their targets are broadcast; beyond, they are joined with salted keys.
BROADCAST_SOURCES = 10_000
SALTS = 32


def size_of(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def draw(doc_id: str = "doc_id", seed: str = SEED) -> Column:
    """A number in [0, 1) from seed and id: 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col(doc_id).cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size, target, rate, from rows (source, size). The level at which uncapped
    sources stand is found in one pass over the sources in the order of cap / weight."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.expr("row_number() over (order by source nulls last) - 1") % len(weights) + 1).cast("int"))
    per = per.select("source", "source_size", w.alias("w"), (F.lit(most) * F.col("source_size")).alias("cap"))
    order = "over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding)"
    per = per.selectExpr(
        "source", "source_size", "w", "cap",
        f"cast({share} as double) * sum(source_size) over () as budget", "sum(w) over () as all_w",
        f"coalesce(sum(cap) {order}, 0) as cap_before", f"coalesce(sum(w) {order}, cast(0 as double)) as w_before",
    )
    per = per.withColumn("level", F.expr("(budget - cap_before) / (all_w - w_before)"))
    per = per.withColumn("level", F.expr("min_by(if(level <= cap / w, level, null), if(level <= cap / w, cap / w, null)) over ()"))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double")))
    per = per.withColumn("target", target)
    return per.select("source", "source_size", "target", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0)).alias("rate"))


def with_targets(rows: DataFrame, per_source: DataFrame) -> DataFrame:
    """``rows`` joined with the target of their source. One source may hold a third of the rows,
    so they are not dealt out by source: few sources are broadcast, many get salted keys."""
    per_source = store.table(per_source, "targets")
    right = per_source.withColumnRenamed("source", "_source")
    match = F.col("source").eqNullSafe(F.col("_source"))
    if per_source.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(right), match).drop("_source")
    right = right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    rows = rows.withColumn("_slot", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    return rows.join(right, match & (F.col("_slot") == F.col("_salt"))).drop("_source", "_slot", "_salt")


def copies(rate: Column, seed: str = SEED) -> Column:
    return (F.floor(rate) + (draw(seed=seed) < rate - F.floor(rate)).cast("long")).cast("long")


def plan(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """Per document: doc_id, size, source_size, target, copies, taken."""
    sizes = store.table(docs.select("doc_id", "source", size_of().alias("size")), "sizes")
    out = with_targets(sizes, targets(sizes, weights, share, most)).withColumn("copies", copies(F.col("rate"), seed))
    return out.select("doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = SEED) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it, with the columns of ``docs``."""
    sizes = docs.select("source", size_of().alias("size"))
    per = targets(sizes, weights, share, most).select("source", "rate")
    rows = docs.select("source", "doc_id", F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))
    out = with_targets(rows, per).withColumn("copies", copies(F.col("rate"), seed))
    return out.filter("copies > 0").withColumn("copy", F.explode(F.expr("sequence(cast(1 as bigint), copies)"))).select("row.*")


SQL = rf"""
WITH sized AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size FROM documents),
per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS w, 2 * source_size AS cap FROM per),
cum AS (SELECT *, 1.5::DOUBLE * sum(source_size) OVER () AS budget, sum(w) OVER () AS all_w,
  coalesce(sum(cap) OVER o, 0)::BIGINT AS cap_before, coalesce(sum(w) OVER o, 0)::DOUBLE AS w_before FROM ranked
  WINDOW o AS (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lev AS (SELECT min_by((budget - cap_before) / (all_w - w_before), cap / w) AS level FROM cum WHERE (budget - cap_before) / (all_w - w_before) <= cap / w),
tar AS (SELECT source, source_size, least(cap::DOUBLE, coalesce(level * w, cap::DOUBLE)) AS target FROM cum, lev),
rated AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0::DOUBLE END AS rate,
  CAST('0x' || substr(md5('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT)::DOUBLE / 4503599627370496.0::DOUBLE AS u
  FROM sized JOIN tar ON sized.source IS NOT DISTINCT FROM tar.source)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken FROM rated
"""

"""MinHash near-duplicates with odd sketches.

1. Every text becomes its set of five-word shingles. Texts with equal sets are one node, so
   copies cost nothing further.
2. A node's MinHash samples are cut into bands; nodes that share a band are candidates. The
   samples are also folded into a parity bitmap (an odd sketch): XOR of two bitmaps counts
   the samples in which the two differ, which estimates high similarities precisely, and
   drops most candidates without looking at their sets.
3. First each node is tried against the least node of each of its bands, and links that hold
   on the full sets are joined to components. In large groups of near copies this takes one
   comparison a node and band.
4. Only bands whose nodes lie in different components then remain. All pairs across
   components are compared there, in blocks of bounded size, by a finer odd sketch: of the
   whole set, or of its hashes below a power of two that leaves about a thousand. Its XOR
   count never exceeds the symmetric difference, so for whole sets no link fails it; for
   sampled ones six deviations are allowed. Pairs that pass are confirmed on full sets: first
   the likeliest few of each two components, then, in what is still apart, all the others.
   So no link is lost to a representative, and a pair inside a component, which cannot
   change the result, is never built.

A pair at the threshold shares no band with a probability of (1 - 0.85**5)**24, under 1e-6.

Texts that are null or have no words have an empty set and stand alone. Repeated doc_ids
keep a row each; the row's own text decides. A row with a null doc_id has links like any other,
its doc_id stays null and never names a component, whose id is null if all its members' are.
Very long texts are read to their end; an empty table gives an empty one. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import graph, shingles, store

BANDS, ROWS, BITS = 24, 5, 512
THRESHOLD = 85
BLOCK = 1024
FINE_BITS, FINE_SIZE = 2048, 1024
LIKELIEST = 2
_seed = np.random.default_rng(20250202)
SAMPLES = BANDS * ROWS
MULTIPLY = _seed.integers(0, 1 << 32, SAMPLES, dtype=np.uint32) | np.uint32(1)
ADD = _seed.integers(0, 1 << 32, SAMPLES, dtype=np.uint32)
PLACE = _seed.integers(0, 1 << 64, SAMPLES, dtype=np.uint64)


def samples(hashes: np.ndarray) -> np.ndarray:
    """The MinHash samples of a non-empty set."""
    x = (hashes >> np.uint64(32)).astype(np.uint32)[:, None]
    least = np.full(SAMPLES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        y = x[i : i + 2048] * MULTIPLY
        y += ADD
        np.minimum(least, (y ^ (y >> np.uint32(15))).min(axis=0), out=least)
    return least


def band_keys(least: np.ndarray) -> np.ndarray:
    """One 64-bit key a band, for a matrix of samples."""
    x = shingles.scramble(least.astype(np.uint64) ^ PLACE).reshape(len(least), BANDS, ROWS)
    return shingles.scramble(x.sum(axis=2, dtype=np.uint64))


def odd_sketches(least: np.ndarray) -> np.ndarray:
    """Parity bitmaps of BITS bits: each sample flips the bit that (its number, its value) hashes to."""
    at = (shingles.scramble(least.astype(np.uint64) + PLACE) >> np.uint64(40)).astype(np.int64) % BITS
    n = len(least)
    odd = np.bincount((at + BITS * np.arange(n)[:, None]).ravel(), minlength=n * BITS).reshape(n, BITS) & 1
    return np.packbits(odd.astype(np.uint8), axis=1).view(np.int64)


def level_of(n):
    """How often a set of n hashes is halved until at most FINE_SIZE of them can be expected."""
    return np.maximum(0, np.ceil(np.log2(np.maximum(1, n) / FINE_SIZE))).astype(np.int64)


def fine_sketch(h: np.ndarray, level: int) -> bytes:
    """Parity bitmap of the hashes below 2 ** (64 - level)."""
    h = h[h < np.uint64(1 << (64 - level))] if level else h
    at = (shingles.scramble(h ^ np.uint64(0x5DEECE66D)) >> np.uint64(40)).astype(np.int64) % FINE_BITS
    return np.packbits((np.bincount(at, minlength=FINE_BITS) & 1).astype(np.uint8)).tobytes()


def most_apart(sizes: np.ndarray, level: np.ndarray, percent: int) -> np.ndarray:
    """The greatest XOR count of fine sketches of two sets, by the sum of their sizes, at which they may be linked."""
    apart = np.floor(sizes * (100 - percent) / (100 + percent))
    share = 0.5**level
    return np.where(level == 0, apart, apart * share + 6 * np.sqrt(apart * share) + 6)


def similarity(flipped) -> float:
    """The similarity that an XOR population count stands for."""
    left = 1 - 2 * flipped / BITS
    return 1 - math.log(left) / math.log(1 - 2 / BITS) / (2 * SAMPLES) if left > 0 else 0.0


def most_flipped(percent: int = THRESHOLD, deviations: float = 5.5) -> int:
    """The greatest XOR count at which a pair of the threshold may stand, by so many deviations of
    the samples and of the bitmap."""
    j = percent / 100
    j -= deviations * math.sqrt(j * (1 - j) / SAMPLES)
    mean = BITS / 2 * (1 - (1 - 2 / BITS) ** (2 * SAMPLES * (1 - j)))
    return math.ceil(mean + deviations * math.sqrt(BITS) / 8)


SIGNED = "doc_id long, n_shingles long, node long, bands array<long>, sketch array<long>, row long"


def _node(h: np.ndarray) -> int:
    """A set's identity: 64 bits from all its hashes."""
    return int(shingles.scramble(np.array([np.sum(shingles.scramble(h)), len(h)], np.uint64)).sum().astype(np.int64)) if len(h) else 0


def sign(docs: DataFrame) -> DataFrame:
    """Per document: size and identity of its set, band keys and odd sketch, and a hash of its text, which with doc_id names the row."""

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, 2000):
                part = b.slice(at, 2000)
                n, nodes, least = [], [], []
                for h in shingles.sets(part.column(1).to_pylist()):
                    n.append(len(h))
                    nodes.append(_node(h))
                    if len(h):
                        least.append(samples(h))
                some = np.array(n) > 0
                m = np.array(least, np.uint32).reshape(-1, SAMPLES)
                lists = []
                for values, width in ((band_keys(m).view(np.int64), BANDS), (odd_sketches(m), BITS // 64)):
                    ends = np.concatenate(([0], np.cumsum(some * width))).astype(np.int32)
                    lists.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(values.ravel(), pa.int64())))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(nodes, pa.int64()), *lists, part.column(2)], names=["doc_id", "n_shingles", "node", "bands", "sketch", "row"])

    return store.in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text"), F.xxhash64("text").alias("row")), run, SIGNED)


SETS = "node long, set binary, level int, fine binary"


def _described(nodes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    levels = [int(level_of(len(h))) for h in sets]
    fine = [fine_sketch(h, k) + fine_sketch(h, k + 1) for h, k in zip(sets, levels)]
    return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([h.tobytes() for h in sets], pa.binary()), pa.array(levels, pa.int32()), pa.array(fine, pa.binary())], names=["node", "set", "level", "fine"])


def _sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, set (sorted hashes as bytes), its level, and its fine sketches at that level and the next,
    for ``wanted`` (doc_id, node), from the documents' texts."""

    def run(named: bool):
        def out(batches):
            for b in batches:
                for start, end in store.slices(b.column(0)):
                    part = b.slice(start, end - start)
                    sets = list(shingles.sets(part.column(0).to_pylist()))
                    nodes = [_node(h) for h in sets]
                    keep = [i for i, n in enumerate(part.column(1).to_pylist()) if nodes[i] == n] if named else range(len(sets))
                    yield _described([nodes[i] for i in keep], [sets[i] for i in keep])

        return out

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    # Texts have to meet the wanted ids; a node all of whose ids are null meets its own set, made anew.
    found = store.in_arrow(texts.join(wanted.filter("doc_id is not null"), "doc_id").select("text", "node"), run(True), SETS)
    bare = store.in_arrow(texts.filter("doc_id is null").select("text", "doc_id"), run(False), SETS).join(wanted.filter("doc_id is null").select("node"), "node", "left_semi")
    return found.unionByName(bare).dropDuplicates(["node"])


def _linked(batches, percent: int):
    for b in batches:
        keep = []
        for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.concatenate((x, y))
            both.sort(kind="stable")
            shared = int(np.count_nonzero(both[1:] == both[:-1]))
            keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    left, right = (sets.select(F.col("node").alias(c), F.col("set").alias(f"set_{c}"), F.expr("length(set)").alias(f"n_{c}")) for c in "ab")
    sized = pairs.join(left, "a").join(right, "b").filter(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)")
    return store.in_arrow(sized.select("a", "b", "set_a", "set_b"), lambda it: _linked(it, percent), "a long, b long")


def _flips(x: str, y: str) -> str:
    return " + ".join(f"bit_count({x}[{i}] ^ {y}[{i}])" for i in range(BITS // 64))


def _across(batches, percent: int, limit: int | None):
    """Pairs of different components within each (key, cell) of sorted rows, by fine sketch: the ``limit``
    likeliest of each two components, or all."""
    held = None

    def pairs(t: pa.Table):
        node, comp, side, level, size = (t[c].to_numpy() for c in ("node", "comp", "side", "level", "n"))
        fine = np.frombuffer(b"".join(t["fine"].to_pylist()), np.uint64).reshape(len(node), 2, -1)
        one, two = np.flatnonzero(side != 1), np.flatnonzero(side != 0)  # side 2: a block against itself
        found = [np.zeros((5, 0), np.int64)]
        for i in range(0, len(one), 64):
            r = one[i : i + 64]
            la, lb = level[r][:, None], level[two][None]
            near = (comp[r][:, None] != comp[two][None]) & (np.abs(la - lb) <= 1)
            near &= 100 * np.minimum(size[r][:, None], size[two][None]) >= percent * np.maximum(size[r][:, None], size[two][None])
            p, q = np.nonzero(near)
            for j in range(0, len(p), 1 << 14):
                x, y = r[p[j : j + (1 << 14)]], two[q[j : j + (1 << 14)]]
                top = np.maximum(level[x], level[y])
                flips = np.bitwise_count(fine[x, top - level[x]] ^ fine[y, top - level[y]]).sum(axis=1)
                most = most_apart((size[x] + size[y]).astype(float), top, percent)
                keep = flips <= most
                x, y, spare = x[keep], y[keep], (flips - most)[keep]
                found.append(np.stack((np.minimum(node[x], node[y]), np.maximum(node[x], node[y]), np.minimum(comp[x], comp[y]), np.maximum(comp[x], comp[y]), np.rint(spare).astype(np.int64))))
        a, b, ca, cb, spare = np.concatenate(found, axis=1)
        if limit is not None:
            order = np.lexsort((b, a, spare, cb, ca))
            a, b, ca, cb = a[order], b[order], ca[order], cb[order]
            first = np.flatnonzero(np.concatenate(([True], (ca[1:] != ca[:-1]) | (cb[1:] != cb[:-1])))) if len(a) else np.zeros(0, np.int64)
            rank = np.arange(len(a)) - np.repeat(first, np.diff(np.append(first, len(a))))
            a, b = a[rank < 2 * limit], b[rank < 2 * limit]  # in a block against itself each pair comes twice
        both = np.unique(np.stack((a, b)), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(both[0], pa.int64()), pa.array(both[1], pa.int64())], names=["a", "b"])

    def groups(t: pa.Table, last: bool):
        key, cell = t["key"].to_numpy(), t["cell"].to_numpy()
        cut = np.flatnonzero((key[1:] != key[:-1]) | (cell[1:] != cell[:-1])) + 1
        bounds = [0, *cut.tolist(), len(key)]
        out = [pairs(t.slice(s, e - s)) for s, e in zip(bounds[: None if last else -2], bounds[1 : None if last else -1])]
        return out, t.slice(bounds[-2])

    for b in batches:
        t = pa.Table.from_batches([b])
        t = pa.concat_tables([held, t]).combine_chunks() if held is not None else t
        if t.num_rows:
            out, held = groups(t, False)
            yield from out
    if held is not None and held.num_rows:
        yield from groups(held, True)[0]


def _rest(members: DataFrame, labels: DataFrame, sets: DataFrame, percent: int, limit: int | None) -> DataFrame:
    """Candidate pairs across components in the bands that hold more than one."""
    placed = members.join(labels.withColumnRenamed("component", "comp"), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).filter("lo <> hi").select("key")
    rest = placed.join(mixed, "key").withColumn("blocks", F.ceil(F.col("m") / F.lit(BLOCK)).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    # Each row goes to the cell of its block with every other block of its key; nearly all keys have one block.
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.select("key", (F.least("own", "other") * F.col("blocks") + F.greatest("own", "other")).alias("cell"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).alias("side"), "node", "comp")
    fine = sets.select("node", "level", "fine", F.expr("length(set) div 8").alias("n"))
    rest = rest.join(fine, "node").repartition("key", "cell").sortWithinPartitions("key", "cell")
    return store.in_arrow(rest, lambda it: _across(it, percent, limit), "a long, b long").distinct()


def _merged(labels: DataFrame, more: DataFrame) -> DataFrame:
    """Labels after further links (a, b) between nodes."""
    for c in "ab":
        more = more.join(labels.select(F.col("node").alias(c), F.col("component").alias(f"comp_{c}")), c, "left")
    top = store.table(graph.components(more.select(F.coalesce("comp_a", "a").alias("a"), F.coalesce("comp_b", "b").alias("b"))), "merged")
    everyone = labels.unionByName(top.select("node", F.col("node").alias("component"))).groupBy("node").agg(F.min("component").alias("component"))
    out = everyone.join(top.select(F.col("node").alias("component"), F.col("component").alias("top")), "component", "left")
    return store.table(out.select("node", F.coalesce("top", "component").alias("component")), "labels")


def links(docs: DataFrame, percent: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """The signed documents, and node -> component for the nodes that link with another."""
    signed = store.table(sign(docs), "signed")
    nodes = store.table(signed.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    keys = nodes.select("node", F.explode("bands").alias("key"))
    shared = keys.groupBy("key").agg(F.min("node").alias("leader"), F.count("*").alias("m")).filter("m > 1")
    members = store.table(keys.join(shared, "key"), "members")
    wanted = members.select("node").distinct().join(nodes.select("node", "doc_id"), "node")
    sets = store.table(_sets_of(docs, wanted), "sets")
    most = most_flipped(percent)
    sketches = nodes.select("node", "sketch")

    first = members.filter("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    for c in "ab":
        first = first.join(sketches.select(F.col("node").alias(c), F.col("sketch").alias(f"sketch_{c}")), c)
    first = store.table(first.filter(f"{_flips('sketch_a', 'sketch_b')} <= {most}").select("a", "b"), "pairs")
    labels = store.table(graph.components(confirm(first, sets, percent)), "labels")

    tried = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    for limit in (LIKELIEST, None):
        pairs = store.table(_rest(members, labels, sets, percent, limit).join(tried, ["a", "b"], "left_anti"), "pairs")
        found = store.table(confirm(pairs, sets, percent), "links")
        if found.limit(1).count():
            labels = _merged(labels, found)
        tried = tried.unionByName(pairs)
    return signed, labels


def deduplicate(docs: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept."""
    signed, comps = links(docs, percent)
    own = signed.filter("n_shingles > 0").groupBy("node").agg(F.min("doc_id").alias("least"))
    named = own.join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    by_node = store.table(named.join(least, "component").select("node", "component_id"), "named")
    out = signed.select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("node")).alias("node")).join(by_node, "node", "left")
    out = out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def keepers(docs: DataFrame, percent: int = THRESHOLD) -> DataFrame:
    """doc_id, row (xxhash64 of the text), repeated (whether several rows are equal in both): one row of each group, of the least doc_id,
    then hash, nulls last; and every row without words, which is in no group."""
    signed, comps = links(docs, percent)
    some = signed.filter("n_shingles > 0")
    name = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")
    own = some.groupBy("node").agg(F.min(name).alias("best"))
    best = own.join(comps, "node", "left").groupBy(F.coalesce("component", "node")).agg(F.min("best").alias("best")).select("best.doc_id", "best.row")
    twice = some.groupBy("doc_id", "row").count().filter("count > 1").select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"))
    best = best.join(twice, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    none = signed.filter("n_shingles = 0").select("doc_id", "row").distinct()
    return store.table(best.select("doc_id", "row", F.col("_row").isNotNull().alias("repeated")).unionByName(none.withColumn("repeated", F.lit(False))), "kept")

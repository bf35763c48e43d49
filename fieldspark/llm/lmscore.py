"""Language-model scoring by online logistic context mixing.

A text is coded as bytes: its lower-cased words, a space between two, a line feed at the end,
which is the end token. A byte is a path of binary decisions through a Huffman tree of its
own for each byte before it, so frequent bytes take few decisions. Each decision is predicted
in five contexts of the text so far: the last one, three and four bytes, the word so far, and
the word so far with the word before it. A context is hashed with the node of the tree to a slot
that holds how often either way was taken in all training texts. The slots' logits are
mixed with weights, of which a set is chosen (gated) by how sure the words' contexts are, and the
mixture is averaged with an adaptive map from mixed logits to what was found there. Weights and map
learn online: every ``STEP`` decisions of a text they move by what these were, so they are the
text's own. They begin anew every ``WINDOW`` decisions, so that
many windows are mixed side by side, from weights and a map learned of training texts: a ``FOLD``-th of these, all of it,
is predicted from the counts of the others, and Newton steps on the summed loss, in integers, give the weights.
A text's score is the sum over its decisions, and
10 ** score a probability: those of all texts sum to 1 at most.

Counting: integer sums over all whole training texts, so neither the split of the input nor the
number of cores changes a score. Tables have as many slots as the training bytes ask for, up
to ``MOST_BITS``, where contexts begin to share slots; words and their counts, which the
base score needs, are a distributed table that grows with the corpus, by a 64-bit hash of the word.

Frequent words (``FREQUENT`` at most) are broadcast with their counts, so no word is a hot
join key; all others are joined. Null texts count as empty: they hold the end alone. Repeated rows
get a row each; extra columns are ignored; an empty table gives an empty one; very long texts
are coded in pieces of about ``PIECE`` bytes, cut between words, with their contexts unbroken. With too few training texts for
a fold, weights stay at their neutral start; with none, counts are 0, base probabilities uniform over the one end token, and all decisions even.
"""

from __future__ import annotations

import heapq
import math
import pickle
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import shingles, store

END, GAP = 10, 32
CONTEXTS = 5
LEAST_BITS, MOST_BITS, BLOCK_BITS = 12, 21, 16
NODES = 256 * 256
PIECE = 1 << 19
SLICE = 3 << 19
FREQUENT = 1 << 18
STEP, WINDOW = 64, 1 << 16
#: Bytes whose windows are mixed together, whose contexts are taken at once and whose decisions are, and windows side by side: they change no result.
POOL, AT_ONCE, NEAR, ABREAST = 1 << 22, 1 << 17, 1 << 13, 256
#: Logits are stored in steps of 1 / SCALE.
SCALE, PRIOR = 12.0, 0.1
GATES, BUCKETS = 4, 29
RATE, MAP_WEIGHT = 0.015, 24.0
_U = np.uint64
_ODD = [_U(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]
NODE_HASH = np.random.default_rng(20250303).integers(0, 1 << 32, NODES, dtype=np.uint32)


#: What learning begins with, a row for each gate: whether the word so far is sure of the decision (its logit above 1
#: or below -1), plus 2 if the pair of words is. Columns: one byte, three bytes, four bytes, word, pair of words.
#: At 0.29 no sum of stored logits is on the border of two buckets of the map, where rounding would decide.
FIRST_WEIGHTS = np.full((GATES, CONTEXTS), 0.29, np.float32)
#: One training text in FOLD is kept out of the counts that the weights are learned on; each round is a pass over these texts.
FOLD, ROUNDS = 16, 5
#: Distinct decisions of which a task weighs so many at once, which bounds its memory.
RUN = 1 << 16
#: Learning is in whole numbers: weights, mixed logits and probabilities in these steps a unit.
WEIGHT_STEPS, LOGIT_STEPS, CHANCE_STEPS = 1 << 16, 64, 1 << 12
SUMS = GATES * (1 + CONTEXTS + CONTEXTS**2) + 2 * BUCKETS


def held_out():
    return store.remainder("doc_id", 5) == 1


def stream(text: bytes | None) -> bytes:
    """What is coded of a text."""
    return b" ".join((text or b"").lower().split()) + b"\n"


def pieces(s: bytes, most: int = PIECE) -> list[tuple[bytes, int]]:
    """Runs of a stream to be coded, cut between words; each comes after the word before it and four bytes at least,
    and with the number of bytes that are context alone."""
    if len(s) <= most:
        return [(s, 0)]
    out, at = [], 0
    while at < len(s):
        end = len(s)
        if end - at > most:
            cut = s.rfind(b" ", at, at + most)
            cut = cut if cut > at else s.find(b" ", at + most)
            end = cut + 1 if cut >= 0 else end
        back = at
        while back and at - back < 5 or back and s.count(b" ", back, at) < 2:
            back = s.rfind(b" ", 0, back - 1) + 1
        out.append((s[back:end], at - back))
        at = end
    return out


# --- the tree of decisions ---------------------------------------------------------------------


class Code:
    """A Huffman tree for each byte before. Byte b after a takes the decisions first[a, b] : first[a, b] + length[a, b]
    of ``node`` and ``bit``."""

    def __init__(self, pairs: np.ndarray):
        single = np.minimum(pairs.sum(axis=0), 255)
        self.first, self.length = np.zeros(NODES, np.int32), np.zeros(NODES, np.int32)
        node, bit = [], []
        for a in range(256):
            heap = [(int(w), b) for b, w in enumerate(256 * pairs[a] + single + 1)]
            heapq.heapify(heap)
            up = np.zeros(511, np.int32).tolist()  # of each entry: its node, and whether it is the right side
            side = [0] * 511
            for k in range(255):
                (w, x), (v, y) = heapq.heappop(heap), heapq.heappop(heap)
                up[x] = up[y] = 256 + k
                side[y] = 1
                heapq.heappush(heap, (w + v, 256 + k))
            for b in range(256):
                x, path = b, []
                while x != 510:
                    path.append((up[x], side[x]))
                    x = up[x]
                self.first[a * 256 + b], self.length[a * 256 + b] = len(node), len(path)
                for x, s in reversed(path):
                    node.append(a * 256 + x - 256)
                    bit.append(s)
        self.node, self.bit = np.array(node, np.int32), np.array(bit, np.uint8)


# --- contexts ----------------------------------------------------------------------------------


def _keys(parts: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For each coded byte of the pieces, in order: it, the number of its piece, the four bytes before it, and a number each for the
    word so far and for that with the word before."""
    joined = b"".join([p for p, _ in parts])
    data = np.frombuffer(joined, np.uint8)
    sizes = np.array([len(p) for p, _ in parts])
    starts = np.cumsum(sizes) - sizes
    n = len(data)
    # The four bytes before each, the last one lowest; those before its piece are ENDs.
    four = np.ndarray((n,), ">u4", b"\n\n\n\n" + joined, strides=(1,)).astype(np.uint32)
    for i in range(4):
        at, own = starts[sizes > i] + i, np.uint32((1 << 8 * i) - 1)
        four[at] = four[at] & own | np.uint32(END * 0x01010101) & ~own
    begins, first = np.zeros(n, bool), np.zeros(n, bool)
    np.equal(data[:-1], GAP, out=begins[1:])
    first[starts] = True
    begins |= first
    power, inverse = shingles._powers_to(n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(shingles.BYTES[data] * power[:n], out=sums[1:])
    own = np.flatnonzero(begins)  # where words begin
    long = np.diff(np.append(own, n))
    so_far = sums[:-1] - np.repeat(sums[own], long)
    so_far *= np.repeat(inverse[own], long)
    before = np.zeros(len(own), np.uint64)
    later = np.flatnonzero(~first[own])
    last = own[later - 1]
    before[later] = ((sums[own[later] - 1] - sums[last]) * inverse[last]) | _U(1)
    piece = np.repeat(np.arange(len(parts)), sizes)
    out = data, piece, four, so_far, so_far + np.repeat(before * _ODD[1], long)
    if any(k for _, k in parts):
        coded = np.arange(n) - np.repeat(starts, sizes) >= np.repeat(np.array([k for _, k in parts]), sizes)
        out = tuple(x[coded] for x in out)
    return out


def _hash(k: int, key: np.ndarray) -> np.ndarray:
    """The hash of context k, which is not the first, by its bytes or the number of its words."""
    key = (key & np.uint32(0xFFFFFF) if k == 1 else key).astype(np.uint64)
    if k < 4:
        key += _U(1 << 33 + k)
    key ^= key >> _U(31)
    key *= _ODD[k - 1]
    key >>= _U(32)
    return key.astype(np.uint32)


def _pair(four: np.ndarray, byte: np.ndarray) -> np.ndarray:
    pair = (four & np.uint32(0xFF)).astype(np.int32) << 8
    pair += byte
    return pair


def contexts(parts: list[tuple[bytes, int]]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """For each coded byte of the pieces, in order: the byte before it times 256 plus it, the number of its piece, and the
    hashes of the contexts but the first."""
    byte, piece, four, word, both = _keys(parts)
    return _pair(four, byte), piece, [_hash(k, key) for k, key in enumerate((four, four, word, both), 1)]


def decisions(code: Code, pair: np.ndarray, n: np.ndarray, hashes: list[np.ndarray], bits: int) -> tuple[np.ndarray, Iterator[np.ndarray]]:
    """Of bytes that take n decisions each: which way each goes; and, context by context, its slots."""
    ends = np.cumsum(n, dtype=np.intp)
    long = int(ends[-1]) if len(ends) else 0
    # The byte of each decision: how many bytes have ended before it.
    of = np.cumsum(np.bincount(ends, minlength=long)[:long])
    path = np.take(code.first[pair] + n - ends, of, mode="wrap")
    path += np.arange(long)
    node = np.take(code.node, path, mode="wrap")

    def slots():
        yield node
        mask = np.uint32((1 << bits) - 1)
        mark = np.take(NODE_HASH, node, mode="wrap")
        mark &= mask
        for h in hashes:
            x = np.take(h & mask, of, mode="wrap")
            x ^= mark
            yield x

    return np.take(code.bit, path, mode="wrap"), slots()


def _batches(texts: list[bytes], most: int = SLICE) -> Iterator[tuple[list[int], list[tuple[bytes, int]]]]:
    """Pieces of many texts, about ``most`` bytes at once, with the number of their text."""
    who, parts, size = [], [], 0
    for i, t in enumerate(texts):
        for p in pieces(stream(t)):
            if size and size + len(p[0]) > most:
                yield who, parts
                who, parts, size = [], [], 0
            who.append(i)
            parts.append(p)
            size += len(p[0])
    if parts:
        yield who, parts


def _runs(parts: list[tuple[bytes, int]]) -> Iterator[list[tuple[bytes, int]]]:
    """Pieces in order, about ``AT_ONCE`` bytes at once."""
    run, size = [], 0
    for p in parts:
        if size and size + len(p[0]) > AT_ONCE:
            yield run
            run, size = [], 0
        run.append(p)
        size += len(p[0])
    if run:
        yield run


# --- mixing ------------------------------------------------------------------------------------


def quantised(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(SCALE * np.log((ones + PRIOR) / (zeros + PRIOR))), -127, 127).astype(np.int8)


class Model:
    """Tables of logits, one for each context, the code, and the weights and the map that texts begin with."""

    def __init__(self, code: Code, bits: int, tables: list[np.ndarray], weights: np.ndarray = FIRST_WEIGHTS, chances: np.ndarray | None = None):
        self.code, self.bits, self.tables, self.key = code, bits, tables, uuid.uuid4().hex
        self.weights, self.chances = weights, _first_map() if chances is None else chances

    def found(self, pair: np.ndarray, n: np.ndarray, hashes: list[np.ndarray]) -> np.ndarray:
        """Of bytes that take n decisions each, a row each: the logits of the contexts, ``STEP`` times the gate, the way gone, and that times ``BUCKETS``. Bytes are
        taken ``NEAR`` at once, so that a pass over their decisions finds them in the processor's cache."""
        out, at = np.empty((CONTEXTS + 3, int(n.sum())), np.uint8), 0
        for start in range(0, len(n), NEAR):
            some = slice(start, start + NEAR)
            bit, slots = decisions(self.code, pair[some], n[some], [h[some] for h in hashes], self.bits)
            here = out[:, at : at + len(bit)]
            for table, s, to in zip(self.tables, slots, here):
                np.take(table.view(np.uint8), s, out=to, mode="wrap")
            sure = (np.abs(here[3:5].view(np.int8)) > np.int8(SCALE)).view(np.uint8)
            np.multiply(sure[1] * np.uint8(2) + sure[0], np.uint8(STEP), out=here[CONTEXTS])
            here[CONTEXTS + 1] = bit
            np.multiply(bit, np.uint8(BUCKETS), out=here[CONTEXTS + 2])
            at += len(bit)
        return out

    def score(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """log10 probability of each text, and the bytes coded."""
        out, size = np.zeros(len(texts)), np.zeros(len(texts), np.int64)
        for who, parts in _batches(texts, POOL):
            steps, sizes, at = [], [], 0
            x = np.empty((sum(len(p) for p, _ in parts) // (STEP // 4) + len(parts), CONTEXTS + 3, STEP), np.uint8)  # more, if bytes take over four decisions
            for some in _runs(parts):
                pair, piece, hashes = contexts(some)
                sizes.append(np.bincount(piece, minlength=len(some)))
                n = self.code.length[pair]
                count = np.bincount(piece, weights=n, minlength=len(some)).astype(np.int64)
                # Each piece is padded to whole steps; its windows follow one another.
                steps.append(-(-count // STEP))
                ends = at + np.cumsum(steps[-1])
                found = self.found(pair, n, hashes)
                if ends[-1] > len(x):
                    x = np.concatenate((x[:at], np.empty((int(ends[-1]), *x.shape[1:]), np.uint8)))
                x[ends - 1, :-2], x[ends - 1, -2], x[ends - 1, -1] = 0, 2, 2 * BUCKETS
                for done, to, long in zip((np.cumsum(count) - count).tolist(), (ends - steps[-1]).tolist(), count.tolist()):
                    whole, rest = divmod(long, STEP)
                    x[to : to + whole] = found[:, done : done + whole * STEP].reshape(len(found), whole, STEP).transpose(1, 0, 2)
                    if rest:
                        x[to + whole, :, :rest] = found[:, done + long - rest : done + long]
                at = int(ends[-1])
            steps, size_of = np.concatenate(steps), np.concatenate(sizes)
            begin, per = np.cumsum(steps) - steps, WINDOW // STEP
            windows = -(-steps // per)
            owner = np.repeat(np.arange(len(parts)), windows)
            nth = np.arange(len(owner)) - np.repeat(np.cumsum(windows) - windows, windows)
            first, last = begin[owner] + nth * per, np.minimum((begin + steps)[owner], begin[owner] + (nth + 1) * per)
            sums = mixed(x, first, last - first, self.weights, self.chances)
            np.add.at(out, who, np.bincount(owner, weights=sums, minlength=len(parts)))
            np.add.at(size, who, size_of)
        return out / math.log(10), size


def _first_map() -> np.ndarray:
    return MAP_WEIGHT / (1 + np.exp(-(np.arange(BUCKETS) - BUCKETS // 2).astype(np.float64)))


def mixed(x: np.ndarray, first: np.ndarray, steps: np.ndarray, start: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """Log probability of each window of decisions (``Model.found``, by step), windows side by side, a step of each at a time."""
    out, order = np.zeros(len(first)), np.argsort(-steps, kind="stable")
    for at in range(0, len(order), ABREAST):
        some = order[at : at + ABREAST]
        out[some] = _abreast(x, first[some], steps[some], start, chances)
    return out


def _abreast(x: np.ndarray, first: np.ndarray, steps: np.ndarray, start: np.ndarray, chances: np.ndarray) -> np.ndarray:
    """``mixed`` of windows of which none is longer than the one before."""
    n, wide = len(first), 3 * BUCKETS
    weights = np.repeat(start[None], n, axis=0)
    # A window's row: what is found of each bucket, for decisions that went down, up, or are padding.
    rows = (np.arange(n, dtype=np.float32) * wide + BUCKETS // 2)[:, None]
    ups, downs = (np.zeros((n, BUCKETS), np.int64) for _ in range(2))
    share, ones, every = np.zeros((n, wide), np.float32), np.empty((n, BUCKETS)), np.empty((n, BUCKETS))
    total = np.zeros(n)
    places = (np.arange(n) * (GATES * STEP))[:, None] + np.arange(STEP)  # where the first gate's mixture of a decision stands
    logits, mixtures, spreads = (np.empty((n, k, STEP), np.float32) for k in (CONTEXTS, GATES, GATES))
    ps, qs, ys = (np.empty((n, STEP), np.float32) for _ in range(3))
    gates, nears = (np.empty((n, STEP), np.intp) for _ in range(2))
    zeros = np.empty((n, STEP), bool)
    alive = np.searchsorted(-steps, -np.arange(int(steps[0]) + 1), side="left").tolist()
    for s in range(int(steps[0])):
        m = alive[s]
        block = x.take(first[:m] + s, axis=0)
        bit, logit, spread = block[:, CONTEXTS + 1], logits[:m], spreads[:m]  # window, context or gate, decision
        p, q, y, gate, near, zero = ps[:m], qs[:m], ys[:m], gates[:m], nears[:m], zeros[:m]
        np.multiply(block[:, :CONTEXTS].view(np.int8), np.float32(1 / SCALE), out=logit)
        np.add(places[:m], block[:, CONTEXTS], out=gate)
        np.matmul(weights[:m], logit, out=mixtures[:m])
        np.take(mixtures.reshape(-1), gate, out=y, mode="wrap")
        np.clip(y, np.float32(-14), np.float32(14), out=y)
        np.negative(y, out=p)
        np.exp(p, out=p)
        p += np.float32(1)
        np.reciprocal(p, out=p)
        np.rint(y, out=y)
        y += rows[:m]
        np.copyto(near, y, casting="unsafe")
        np.add(ups[:m], chances, out=ones[:m])
        np.add(ups[:m], downs[:m], out=every[:m])
        every[:m] += MAP_WEIGHT
        np.divide(ones[:m], every[:m], out=share[:m, :BUCKETS], casting="same_kind")
        np.take(share.reshape(-1), near, out=q, mode="wrap")
        q += p
        q *= np.float32(0.5)
        np.copyto(y, bit)
        np.subtract(y, p, out=p)  # the miss
        np.equal(bit, 0, out=zero)
        q -= zero  # its magnitude is now the probability of the way taken
        np.abs(q, out=q)
        if alive[s + 1] < m:  # windows whose last step this is may end early
            early = bit[alive[s + 1] :] == 2
            q[alive[s + 1] :][early] = 1
            p[alive[s + 1] :][early] = 0
        total[:m] += np.log(q, out=q).sum(axis=1, dtype=np.float64)
        spread.fill(0)  # a miss counts for its gate alone
        spread.reshape(-1)[gate] = p
        weights[:m] += np.float32(RATE) * np.matmul(spread, logit.transpose(0, 2, 1))
        near += block[:, CONTEXTS + 2]
        found = np.bincount(near.reshape(-1), minlength=m * wide).reshape(m, 3, BUCKETS)
        downs[:m] += found[:, 0]
        ups[:m] += found[:, 1]
    return total


# --- counting ----------------------------------------------------------------------------------


def _pairs(batches):
    """How often each byte follows each in training texts, and how many bytes there are."""
    found = np.zeros(NODES, np.int64)
    for b in batches:
        for start, end in store.slices(b.column(0), SLICE):
            data = np.frombuffer(b"\n" + b"".join([stream(t) for t in b.column(0).slice(start, end - start).to_pylist()]), np.uint8)
            found += np.bincount(data[:-1].astype(np.int32) * 256 + data[1:], minlength=NODES)
    yield pa.RecordBatch.from_arrays([pa.array([found.tobytes()], pa.binary())], names=["found"])


def _sum_pairs(rows):
    return pa.table({"found": pa.array([sum(np.frombuffer(x, np.int64) for x in rows.column("found").to_pylist()).tobytes()], pa.binary())})


def _distinct(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct numbers, ascending, and how often each is there."""
    x = np.concatenate(parts)
    x.sort()
    cut = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1]))) if len(x) else np.zeros(0, np.int64)
    return x[cut], np.diff(np.append(cut, len(x)))


def tally(code: Code, bits: int, counts: list[np.ndarray], texts: list[bytes]) -> None:
    """Adds the decisions of texts to the counts of both ways of each slot. A byte recurs in most of its contexts: its decisions are
    found once for all of its places with the same four bytes before, and once for those with the same word so far."""

    def add(to, pair, hashes, times):
        for start in range(0, len(pair), NEAR):
            some = slice(start, start + NEAR)
            n = code.length[pair[some]]
            bit, slots = decisions(code, pair[some], n, [h[some] for h in hashes], bits)
            often = np.int32(1) if times is None else np.repeat(times[some].astype(np.int32), n)
            for c, s in zip(to, slots):
                if c is not None:
                    s = s.astype(np.intp)
                    s <<= 1
                    s |= bit
                    np.add.at(c, s, often)

    mask = np.uint64((1 << bits) - 1)
    for _, parts in _batches(texts):
        after_four, in_word = [], []
        for some in _runs(parts):
            byte, _, four, word, both = _keys(some)
            pair = _pair(four, byte)
            after_four.append(four.astype(np.uint64) << _U(8) | byte)
            in_word.append((_hash(3, word) & mask) << _U(16) | pair.astype(np.uint64))
            add([None, counts[4]], pair, [_hash(4, both)], None)
        key, times = _distinct(after_four)
        four = (key >> _U(8)).astype(np.uint32)
        add(counts[:3], _pair(four, (key & _U(0xFF)).astype(np.uint8)), [_hash(k, four) for k in (1, 2)], times)
        key, times = _distinct(in_word)
        add([None, counts[3]], (key & _U(0xFFFF)).astype(np.int32), [(key >> _U(16)).astype(np.uint32)], times)


def _count(batches, shared):
    """Blocks of a task's table of counts, compressed: (context, block, both counts of each slot)."""
    code, bits = store.held(shared[0], lambda: pickle.loads(shared[1].value))
    counts = [np.zeros(2 * (NODES if k == 0 else 1 << bits), np.int32) for k in range(CONTEXTS)]
    for b in batches:
        for start, end in store.slices(b.column(0), SLICE):
            tally(code, bits, counts, b.column(0).slice(start, end - start).to_pylist())
    for k, c in enumerate(counts):
        for at in range(0, len(c), 2 << BLOCK_BITS):
            part = c[at : at + (2 << BLOCK_BITS)]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([at >> 1], pa.int64()), pa.array([_packed(part)], pa.binary())], names=["k", "at", "part"])


def _unpacked(part: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(part[1:]), np.uint8).reshape(part[0], -1).T.copy().view(f"u{part[0]}")[:, 0].astype(np.int64)


def _added(parts) -> np.ndarray:
    total = 0
    for part in parts:
        total = total + _unpacked(part)
    return total


def _packed(counts: np.ndarray) -> bytes:
    """Counts as bytes of equal weight together, as many as the largest takes, compressed; their number goes before them."""
    kind = np.min_scalar_type(int(counts.max()))
    return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(counts.astype(kind).view(np.uint8).reshape(-1, kind.itemsize).T.tobytes())


def _add_block(key, rows):
    return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([key[1].as_py()], pa.int64()), "part": pa.array([_packed(_added(rows.column("part").to_pylist()))], pa.binary())})


def _sum_block(key, rows):
    total = _added(rows.column("part").to_pylist())
    part = quantised(total[::2].astype(float), total[1::2].astype(float))
    return pa.table({"k": pa.array([key[0].as_py()], pa.int32()), "at": pa.array([key[1].as_py()], pa.int64()), "part": pa.array([part.tobytes()], pa.binary())})


def _tables(sums: DataFrame, bits: int) -> list[np.ndarray]:
    """The logits of summed counts: a byte a slot reaches the driver."""
    tables = [np.zeros(NODES if k == 0 else 1 << bits, np.int8) for k in range(CONTEXTS)]
    for r in sums.groupBy("k", "at").applyInArrow(_sum_block, "k int, at long, part binary").collect():
        tables[r["k"]][r["at"] : r["at"] + len(r["part"])] = np.frombuffer(r["part"], np.int8)
    return tables


def fit(docs: DataFrame) -> Model:
    """The model of all training texts. What reaches the driver has a fixed number of slots at most."""
    spark = docs.sparkSession
    fold = F.pmod(F.xxhash64(F.lit("fold"), F.col("doc_id")), F.lit(FOLD)) == 0
    train = docs.filter(~held_out()).select(F.col("text").cast("binary").alias("text"), fold.alias("fold"))
    found = store.in_arrow(train.select("text"), _pairs, "found binary").groupBy(F.pmod(F.spark_partition_id(), F.lit(16)).alias("g")).applyInArrow(lambda t: _sum_pairs(t), "found binary")
    pairs = sum((np.frombuffer(r["found"], np.int64) for r in found.collect()), np.zeros(NODES, np.int64))  # 16 rows
    size = int(pairs.sum())
    bits = min(MOST_BITS, max(LEAST_BITS, (size >> 3).bit_length()))
    code = Code(pairs.reshape(256, 256))
    shared = uuid.uuid4().hex, spark.sparkContext.broadcast(pickle.dumps((code, bits)))

    def counted(rows):
        # A block of at most 64 tasks is added up first, then those sums: no group holds a row of every task.
        parts = store.in_arrow(rows.select("text"), lambda it: _count(it, shared), "k int, at long, part binary")
        sums = parts.withColumn("g", F.expr("spark_partition_id() div 64")).groupBy("k", "at", "g").applyInArrow(_add_block, "k int, at long, part binary")
        return store.table(sums, "counts")

    most, rest = counted(train.filter("not fold")), counted(train.filter("fold"))
    weights, chances = learned(train.filter("fold").select("text"), Model(code, bits, _tables(most, bits)))
    return Model(code, bits, _tables(most.unionByName(rest), bits), weights, chances)


# --- learning where texts begin ----------------------------------------------------------------


def _chance_tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By mixed logit, from -14 in steps: the chance of a one, its variance, both times CHANCE_STEPS, and the loss of a zero in as many steps a nat."""
    y = np.arange(-14 * LOGIT_STEPS, 14 * LOGIT_STEPS + 1) / LOGIT_STEPS
    p = 1 / (1 + np.exp(-y))
    return tuple(np.rint(CHANCE_STEPS * x).astype(np.int64) for x in (p, p * (1 - p), np.logaddexp(0, y)))


def distinct(model: Model, texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """What the model finds for the decisions of texts, about SLICE bytes of them at once: each distinct gate with its logits and the way
    gone, as a byte each of a number (gate highest, way lowest), and how many decisions find just that. No weights are in it."""
    for _, parts in _batches(texts):
        keys = []
        for some in _runs(parts):
            pair, _, hashes = contexts(some)
            found = model.found(pair, model.code.length[pair], hashes)
            key = np.zeros((found.shape[1], 8), np.uint8)
            for to, row in enumerate((CONTEXTS + 1, *range(CONTEXTS + 1))):
                key[:, to] = found[row]
            keys.append(key.view("<i8")[:, 0])
        yield _distinct(keys)


def gathered(model: Model, weights: np.ndarray, texts: list[bytes]) -> np.ndarray:
    """What texts say about integer weights, all in whole numbers, so that it adds up in any order: for each gate the
    loss, the slope (a number a context) and the curvature (context by context); then for each bucket of the map the decisions and the ones."""
    return sum((weighed(weights, *found) for found in distinct(model, texts)), np.zeros(SUMS, np.int64))


def weighed(weights: np.ndarray, keys: np.ndarray, times: np.ndarray) -> np.ndarray:
    """The sums of ``gathered`` of what ``distinct`` has found."""
    chance, spread, loss = _chance_tables()
    out = np.zeros(SUMS, np.int64)
    per, high = out[: -2 * BUCKETS].reshape(GATES, -1), 14 * LOGIT_STEPS
    spread, miss = spread.astype(np.float64), np.stack((-chance, CHANCE_STEPS - chance), axis=1).ravel().astype(np.float64)
    near = (np.arange(-high, high + 1) + LOGIT_STEPS // 2) // LOGIT_STEPS + BUCKETS // 2  # the bucket of each mixed logit
    cut = np.searchsorted(keys, (np.arange(GATES + 1) * STEP) << 8 * (CONTEXTS + 1))
    for g in range(GATES):
        for at in range(cut[g], cut[g + 1], RUN):
            some = slice(at, min(at + RUN, cut[g + 1]))
            parts = keys[some].astype("<i8").view(np.int8).reshape(-1, 8)
            f, up, often = parts[:, 1 : 1 + CONTEXTS].T.astype(np.float64), parts[:, 0], times[some].astype(np.float64)  # whole numbers far below 2 ** 53: exact
            # A unit of the sum is a weight's step times a logit's.
            y = weights[g].astype(np.float64) @ f
            y *= LOGIT_STEPS
            y /= WEIGHT_STEPS * int(SCALE)
            np.floor(y, out=y)
            np.clip(y, -high, high, out=y)
            y += high
            at_y = y.astype(np.intp)
            curve = f * (spread[at_y] * often)
            at_y *= 2
            at_y += up
            # By mixed logit: how many went either way.
            zeros, ones = np.bincount(at_y, weights=often, minlength=2 * len(chance)).astype(np.int64).reshape(-1, 2).T
            per[g, 0] += zeros @ loss + ones @ loss[::-1]
            per[g, 1 : 1 + CONTEXTS] += (f @ (miss[at_y] * often)).astype(np.int64)
            per[g, 1 + CONTEXTS :] += (curve @ f.T).astype(np.int64).ravel()
            np.add.at(out[-2 * BUCKETS : -BUCKETS], near, zeros + ones)
            np.add.at(out[-BUCKETS:], near, ones)
    return out


def learned(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Weights and map to begin with, from all texts of ``rows`` (none of which the model has counted). What the model finds for them
    doesn't depend on weights: it is looked up and written once. A round sends a few hundred numbers of a task; a step that raises the loss is halved."""
    spark = rows.sparkSession
    cast = model.key, spark.sparkContext.broadcast(pickle.dumps(model))
    best = now = np.rint(FIRST_WEIGHTS * WEIGHT_STEPS).astype(np.int64)
    least, chances = None, _first_map()

    def find(batches):
        m = store.held(cast[0], lambda: pickle.loads(cast[1].value))
        for b in batches:
            for start, end in store.slices(b.column(0), SLICE):
                for found in distinct(m, b.column(0).slice(start, end - start).to_pylist()):
                    yield pa.RecordBatch.from_arrays([pa.array([_packed(x)], pa.binary()) for x in found], names=["keys", "times"])

    kept = store.table(store.in_arrow(rows, find, "keys binary, times binary"), "fold")
    for _ in range(ROUNDS):

        def run(batches, weights=now):
            total = 0
            for b in batches:
                for keys, times in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                    total = total + weighed(weights, _unpacked(keys), _unpacked(times))
            if not np.isscalar(total):
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array(total)], names=["i", "n"])

        sums = store.in_arrow(kept, run, "i long, n long").groupBy("i").agg(F.sum(F.col("n").cast("decimal(20,0)")).alias("n")).orderBy("i").collect()  # some 200 rows
        if not sums:
            return FIRST_WEIGHTS, _first_map()
        total = np.array([float(r["n"]) for r in sums])
        per = total[: -2 * BUCKETS].reshape(GATES, -1)
        loss = per[:, 0].sum()
        if least is None or loss < least:
            least, best = loss, now
            every, ones = total[-2 * BUCKETS : -BUCKETS], total[-BUCKETS:]
            chances = MAP_WEIGHT * (ones + _first_map()) / (every + MAP_WEIGHT)
            slope, curve = per[:, 1 : 1 + CONTEXTS] / SCALE, per[:, 1 + CONTEXTS :].reshape(GATES, CONTEXTS, CONTEXTS) / SCALE**2
            near = CHANCE_STEPS * np.eye(CONTEXTS)  # about a decision's worth: a gate without any stays where it is
            now = best + np.rint(WEIGHT_STEPS * np.stack([np.linalg.solve(c + near, s) for c, s in zip(curve, slope)])).astype(np.int64)
        else:
            now = (now + best) // 2
        if (now == best).all():
            break
    return (best / WEIGHT_STEPS).astype(np.float32), chances


# --- words -------------------------------------------------------------------------------------

#: The end token, beside the words' hashes.
END_WORD = -1


def _hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    found, begins = [np.zeros(0, np.int64)], [np.zeros(1, np.int64)]
    for some in _runs([(t, 0) for t in texts]):
        h, at = shingles.words([t for t, _ in some])
        found.append(h.view(np.int64))
        begins.append(begins[-1][-1] + at[1:])
    h = np.concatenate(found)
    return np.where(h == END_WORD, 0, h), np.concatenate(begins)


def _merged(parts: list[np.ndarray]) -> np.ndarray:
    """Rows (word, train, rest) with equal words summed."""
    rows = np.concatenate(parts, axis=1)
    rows = rows[:, np.argsort(rows[0])]
    cut = np.flatnonzero(np.concatenate(([True], rows[0, 1:] != rows[0, :-1]))) if rows.shape[1] else np.zeros(0, np.int64)
    return np.stack((rows[0, cut], *(np.add.reduceat(r, cut) if len(cut) else r[:0] for r in rows[1:])))


def vocabulary(docs: DataFrame, hold: int = 1 << 20) -> DataFrame:
    """word (its hash), c (its count in training texts) and rest (elsewhere) of all distinct words."""

    def run(batches):
        kept, size = [], 0
        for b in batches:
            for start, end in store.slices(b.column(1), SLICE):
                part = b.slice(start, end - start)
                texts = [t or b"" for t in part.column(1).to_pylist()]
                h, begins = _hashes(texts)
                held = np.repeat(np.array(part.column(0).to_pylist(), bool), np.diff(begins))
                n = int(np.count_nonzero(part.column(0).to_pylist()))
                now = [np.array([[END_WORD], [len(texts) - n], [n]])]
                for side, zero in ((h[~held], 2), (h[held], 1)):
                    w, c = np.unique(side, return_counts=True)
                    now.append(np.insert(np.stack((w, c)), zero, 0, axis=0))
                kept.append(_merged(now))
                size += kept[-1].shape[1]
                if size > hold:
                    kept = [_merged(kept)]
                    size = kept[0].shape[1]
                    if size > hold // 2:
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in kept[0]], names=["word", "train", "rest"])
                        kept, size = [], 0
        if kept:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in _merged(kept)], names=["word", "train", "rest"])

    parts = store.in_arrow(docs.select(held_out().alias("held"), F.col("text").cast("binary").alias("text")), run, "word long, train long, rest long")
    return parts.groupBy("word").agg(F.sum("train").alias("c"), F.sum("rest").alias("rest"))


ROWS = "word long, row long, doc_id long, held_out boolean, m long, n long, k long, b double, s double, bytes long"


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row."""
    spark = docs.sparkSession
    words = store.table(vocabulary(docs), "words")
    total, distinct = words.filter("c > 0").agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = fit(docs)
    bottom = math.log10(total + 0.5 * (distinct + 1))
    top = words.filter(F.col("word") != END_WORD).select("word", "c", (F.col("c") + F.col("rest")).alias("n")).orderBy(F.desc("n"), "word").limit(FREQUENT)
    few = top.select("word", "c").unionByName(words.filter(F.col("word") == END_WORD).select("word", "c")).toPandas().sort_values("word")
    known = few["word"].to_numpy(np.int64), few["c"].to_numpy(np.int64)
    cast = model.key, spark.sparkContext.broadcast(pickle.dumps((model, known)))  # FREQUENT words and the tables' slots at most

    def run(batches):
        model, (word, count) = store.held(cast[0], lambda: pickle.loads(cast[1].value))
        base = np.log10(count + 0.5) - bottom
        end = int(np.searchsorted(word, END_WORD))
        for b in batches:
            for start, stop in store.slices(b.column(3), POOL):
                part = b.slice(start, stop - start)
                texts = [t or b"" for t in part.column(3).to_pylist()]
                rows = part.num_rows
                h, begins = _hashes(texts)
                lengths = np.diff(begins)
                # One entry for each text and distinct word of it.
                doc = np.repeat(np.arange(rows), lengths)
                every, which = np.unique(h, return_inverse=True)
                place = np.minimum(np.searchsorted(word, every), len(word) - 1)
                pair, m = np.unique(doc * max(1, len(every)) + which, return_counts=True)
                doc, which = np.divmod(pair, max(1, len(every)))
                h, at = every[which], place[which]
                hit = word[at] == h
                k = np.bincount(doc[hit], weights=(m * (count[at] > 0))[hit], minlength=rows) + float(count[end] > 0)
                sums = np.bincount(doc[hit], weights=(m * base[at])[hit], minlength=rows) + base[end]
                logs, size = model.score(texts)
                rest, ids = ~hit, part.column(0).to_numpy()
                none = lambda x, kind: pa.concat_arrays([pa.nulls(int(rest.sum()), kind), x])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.array(h[rest]), pa.nulls(rows, pa.int64())]), pa.array(np.concatenate((ids[doc[rest]], ids))), none(part.column(1), pa.int64()), none(part.column(2), pa.bool_()),
                        pa.concat_arrays([pa.array(m[rest]), pa.nulls(rows, pa.int64())]), none(pa.array(lengths + 1), pa.int64()), none(pa.array(k.astype(np.int64)), pa.int64()),
                        none(pa.array(sums), pa.float64()), none(pa.array(logs), pa.float64()), none(pa.array(size), pa.int64()),
                    ],
                    names=[x.split()[0] for x in ROWS.split(", ")],
                )

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("binary").alias("text"))
    parts = store.table(store.in_arrow(rows, run, ROWS), "parts")
    # The words that weren't broadcast meet their counts; the rows of documents need no shuffle for that.
    rare = parts.filter("word is not null").select("word", "row", "m").join(words.select("word", "c"), "word")
    rare = rare.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("more"), F.sum(F.col("m") * (F.log10(F.col("c") + 0.5) - F.lit(bottom))).alias("add"))
    own = parts.filter("word is null").drop("word", "m")
    out = own.join(rare, "row", "left")
    return out.select(
        "doc_id", "held_out", F.col("n").alias("n_tokens"), (F.col("k") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(int(total)).cast("long").alias("train_tokens"),
        (F.col("b") + F.coalesce("add", F.lit(0.0))).alias("base_score"), F.col("s").alias("score"), (-F.col("s") * math.log2(10) / F.col("bytes")).alias("bits_per_byte"),
    )

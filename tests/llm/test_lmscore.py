"""Steps of the language-model scoring against their plain forms."""

import numpy as np

from fieldspark.llm import lmscore as L


def test_counts_are_packed_in_as_few_bytes_as_they_take():
    """Counts were sent as eight bytes each, whatever they were."""
    r = np.random.default_rng(3)
    parts = [r.integers(0, most, 64).astype(np.int64) for most in (200, 60_000, 1 << 31, 1 << 40)]
    packed = [L._packed(x) for x in parts]
    assert [x[0] for x in packed] == [1, 2, 4, 8]
    assert (L._added(packed) == sum(parts)).all()


def test_contexts_byte_by_byte():
    """Bytes of the same contexts, and only these, have the same hashes; context before a piece counts, other pieces don't."""
    texts = [L.stream(t) for t in (b"A bb ccc bb ccc", b"", b"x", b"bb ccc bb", b"A bb ccc bb ccc")]
    parts = [p for t in texts for p in L.pieces(t, 6)]
    pair, piece, hashes = L.contexts(parts)
    want = []
    for text in texts:
        for i, b in enumerate(text):
            before = b"\n\n\n\n" + text[:i]
            words = text[:i].split(b" ")
            last = words[-2] if len(words) > 1 else None
            want.append((before[-1] * 256 + b, before[-3:], before[-4:], words[-1], (last, words[-1])))
    assert pair.tolist() == [w[0] for w in want] and (np.diff(piece) >= 0).all() and piece[-1] == len(parts) - 1
    for k, h in enumerate(hashes, 1):
        assert len({(w[k], int(x)) for w, x in zip(want, h)}) == len({w[k] for w in want}) == len(set(h.tolist()))


def test_gathered_decision_by_decision():
    r = np.random.default_rng(5)
    texts = [b"some words and some more words", b"and other words", b""]
    data = np.frombuffer(b"\n" + b"".join(map(L.stream, texts)), np.uint8)
    code = L.Code(np.bincount(data[:-1].astype(np.int32) * 256 + data[1:], minlength=L.NODES).reshape(256, 256))
    tables = [r.integers(-127, 128, L.NODES if k == 0 else 1 << 12).astype(np.int8) for k in range(L.CONTEXTS)]
    weights = r.integers(-20_000, 40_000, (L.GATES, L.CONTEXTS))
    pair, _, hashes = L.contexts([(L.stream(t), 0) for t in texts])
    bit, slots = L.decisions(code, pair, code.length[pair], hashes, 12)
    chance, spread, loss = (x.tolist() for x in L._chance_tables())
    per, near = np.zeros((L.GATES, 1 + L.CONTEXTS + L.CONTEXTS**2), np.int64), np.zeros((2, L.BUCKETS), np.int64)
    for x, up in zip(zip(*[t[s].tolist() for t, s in zip(tables, slots)]), bit.tolist()):
        g = (abs(x[3]) > L.SCALE) + 2 * (abs(x[4]) > L.SCALE)
        y = sum(int(w) * v for w, v in zip(weights[g], x)) * L.LOGIT_STEPS // (L.WEIGHT_STEPS * int(L.SCALE))
        y = max(-14 * L.LOGIT_STEPS, min(14 * L.LOGIT_STEPS, y))
        at = y + 14 * L.LOGIT_STEPS
        per[g] += [loss[14 * L.LOGIT_STEPS + (-y if up else y)], *[v * (up * L.CHANCE_STEPS - chance[at]) for v in x], *[u * v * spread[at] for u in x for v in x]]
        near[:, (y + L.LOGIT_STEPS // 2) // L.LOGIT_STEPS + L.BUCKETS // 2] += [1, up]
    assert (L.gathered(L.Model(code, 12, tables), weights, texts) == np.concatenate((per.ravel(), near.ravel()))).all()


def plain(texts, bits=14):
    """Code of texts, and both counts of each slot from every decision of every byte."""
    data = np.frombuffer(b"\n" + b"".join(map(L.stream, texts)), np.uint8)
    code = L.Code(np.bincount(data[:-1].astype(np.int32) * 256 + data[1:], minlength=L.NODES).reshape(256, 256))
    counts = [np.zeros(2 * (L.NODES if k == 0 else 1 << bits), np.int32) for k in range(L.CONTEXTS)]
    for t in texts:
        pair, _, hashes = L.contexts([(L.stream(t), 0)])
        bit, slots = L.decisions(code, pair, code.length[pair], hashes, bits)
        for c, s in zip(counts, slots):
            np.add.at(c, s.astype(int) * 2 + bit, 1)
    return code, counts


TEXTS = [b"some words and some more words", b"Other words \xc3\xa9\xff", b"", None, *[b"the same sentence again and again, to the end"] * 50]


def test_repeated_contexts_are_counted_once(monkeypatch):
    """Every byte's decisions were looked up in all contexts, however often it came after the same bytes or in the same word."""
    code, want = plain(TEXTS)
    counts, done, real = [np.zeros_like(c) for c in want], [], L.decisions
    monkeypatch.setattr(L, "NEAR", 50)
    monkeypatch.setattr(L, "AT_ONCE", 100)
    monkeypatch.setattr(L, "decisions", lambda code, pair, n, hashes, bits: done.append(len(pair) * len(hashes)) or real(code, pair, n, hashes, bits))
    L.tally(code, 14, counts, TEXTS)
    assert all((a == b).all() for a, b in zip(counts, want))
    size = sum(len(L.stream(t)) for t in TEXTS)
    assert sum(done) < 1.5 * size  # of four contexts, only the pair of words is looked up byte by byte


def test_learning_looks_decisions_up_once():
    """Equal decisions are one number with a count, which holds all that a round of learning needs."""
    code, counts = plain(TEXTS)
    m = L.Model(code, 14, [L.quantised(c[::2].astype(float), c[1::2].astype(float)) for c in counts])
    keys, times = (np.concatenate(x) for x in zip(*L.distinct(m, TEXTS)))
    pairs = [L.contexts([(L.stream(t), 0)]) for t in TEXTS]
    rows = []
    for pair, _, hashes in pairs:
        bit, slots = L.decisions(code, pair, code.length[pair], hashes, 14)
        x = [t[s].tolist() for t, s in zip(m.tables, slots)]
        rows += zip(((np.abs(x[3]) > L.SCALE) + 2 * (np.abs(x[4]) > L.SCALE)).tolist(), *x, bit.tolist())
    found = {}
    for row in rows:
        found[row] = found.get(row, 0) + 1
    parts = keys.astype("<i8").view(np.int8).reshape(-1, 8).astype(int)
    got = {(int(p[6]) % 256 // L.STEP, *p[1:6].tolist(), int(p[0])): int(n) for p, n in zip(parts, times)}
    assert got == found and len(keys) * 10 < times.sum() and (np.diff(keys) > 0).all()
    weights = np.random.default_rng(4).integers(-20_000, 40_000, (L.GATES, L.CONTEXTS))
    packed = L._unpacked(L._packed(keys)), L._unpacked(L._packed(times))
    assert (L.weighed(weights, *packed) == sum(L.gathered(m, weights, [t]) for t in TEXTS)).all()


def test_scores_do_not_depend_on_what_is_mixed_together(monkeypatch):
    code, counts = plain(TEXTS)
    m = L.Model(code, 14, [L.quantised(c[::2].astype(float), c[1::2].astype(float)) for c in counts])
    texts = [*[t or b"" for t in TEXTS], bytes(range(256)) * 9, b"some words and " * 400]
    monkeypatch.setattr(L, "WINDOW", 256)
    whole = m.score(texts)
    for name, value in (("POOL", 3000), ("AT_ONCE", 40), ("NEAR", 7), ("ABREAST", 3)):
        monkeypatch.setattr(L, name, value)
        got = m.score(texts)
        assert (got[0] == whole[0]).all() and (got[1] == whole[1]).all()

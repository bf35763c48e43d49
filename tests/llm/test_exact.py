"""Operators against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from pyspark.sql import functions as F

import __spark_entry__ as entry
from fieldspark.llm import ann, bpe, graph, jpeg, langid, lmscore, media, neardup, pii, quality, shingles

SF = "/root/testdata/sf0.001"
DOCS = pd.read_parquet(f"{SF}/documents.parquet")
TEXTS = dict(zip(DOCS["doc_id"], DOCS["text"]))
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(t):
    return re.sub("[A-Z]", lambda m: m.group().lower(), t or "")


def run(spark, name):
    return entry.queries()[name](spark, SF).toPandas()


def test_bpe_is_the_library(spark):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.default_path())
    e = bpe.Encoder(open(bpe.default_path()).read())
    g = random.Random(1)
    odd = "abc eEΣσς İıßéñ'strevmld0١Ⅷ½ \x1c\x85 <|>endoftext!!??漢字😀 \n\t\xa0"
    texts = [*list(TEXTS.values())[:60], "a<|endoftext|>B <|startoftext|>", "ΟΔΟΣ", *["".join(g.choice(odd) for _ in range(g.randint(0, 50))) for _ in range(1500)], *["".join(g.choice("aeinorst!") for _ in range(g.randint(0, 40))) for _ in range(1500)]]
    for t, want in zip(texts, lib.encode_batch(texts, add_special_tokens=False)):
        assert list(e.encode(t)) == want.ids, t
        assert e.decode(e.encode(t).tolist()) == lib.decode(want.ids, skip_special_tokens=False)
    out = run(spark, "op4_bpe").set_index("doc_id")
    for i, t in TEXTS.items():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert out.loc[i, "n_tokens"] == len(ids) and out.loc[i, "decoded_sha256"] == hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest()
        assert out.loc[i, "ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def base(t):
    digits = lambda s: re.sub("[^0-9]", "", s)
    out = [(m.start(), 0, m.end()) for m in EMAIL.finditer(t)]
    out += [(m.start(), 1, m.end()) for m in IP.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))]
    out += [(m.start(), 2, m.end()) for m in CARD.finditer(t) if 14 <= len(digits(m.group())) <= 19 and pii.luhn(digits(m.group()))]
    return sorted(out + [(m.start(), 3, m.end()) for m in PHONE.finditer(t) if 10 <= len(digits(m.group())) <= 15])


def test_pii_base(spark):
    g = random.Random(3)
    for _ in range(5000):
        t = "".join(g.choice(g.choice(["0123456789", "ab@.@.-", "0123.. ", "+() -1234567890", "4111 1111-", " é\n"])) for _ in range(g.randint(0, 60)))
        assert pii.base_spans(t) == base(t), t
    out = run(spark, "op2_pii").set_index("doc_id")
    for i, t in TEXTS.items():
        assert out.loc[i, "base_sha256"] == hashlib.sha256(pii.written(base(t)).encode()).hexdigest()
        assert set(pii.written(base(t)).split(",")) <= set(out.loc[i, "spans"].split(",")) | {""}
    for t in ("1" * 50000, "a" * 50000 + "@", "1." * 25000, "+1" * 25000, "a@" * 25000):
        pii.all_spans(pii.learn([]), [t])


def test_pii_repeats_follow():
    """A number that is known from one mention is found in another that no pattern matches."""
    train = [f"please call +1 (555) 01{k}-77{k}3 or write to ann{k}@mail.org about item {k} of 2024 and {k}.5 more" for k in range(10, 60)]
    f = pii.learn(train)
    t = "her phone is +15550177993 she said. " + "nothing here. " * 20 + "again 15550177993 is hers"
    got = pii.all_spans(f, [t, "chapter 12 of 300 pages"])
    assert ("phone", "15550177993") in {(pii.KINDS[k], t[s:e]) for s, k, e in got[0][1]} and not got[1][1]


def test_pii_fit_reads_whole_texts(spark, monkeypatch):
    read = []
    monkeypatch.setattr(pii, "learn", read.extend)
    pii.fit(spark.createDataFrame([(1, " ".join(f"item {k}" for k in range(1000, 1600)) + " call +15550177993")], "doc_id long, text string"))
    assert "1599 call +15550177993" in read[0]


def test_neardup_brute_force(spark):
    out = run(spark, "op10_neardup").set_index("doc_id")
    sets = {}
    for i, t in TEXTS.items():
        w = WORD.findall(lowered(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[a + 1 :]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both) and find(i) != find(j):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    for i in ids:
        assert (out.loc[i, "n_shingles"], out.loc[i, "component_id"], out.loc[i, "kept"]) == (len(sets[i]), find(i), find(i) == i)


def test_neardup_second_round(spark):
    """Copies that drift: the ends aren't alike, and links run through the middle."""
    words = [f"w{k}" for k in range(400)]
    texts, now = [], list(words)
    for k in range(12):
        texts.append(" ".join(now))
        for m in range(3):
            now[(37 * (3 * k + m)) % 400] = f"x{k}_{m}"
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["component_id"] for r in neardup.deduplicate(d).collect()} == {0}


def test_odd_sketch_estimates():
    g = np.random.default_rng(5)
    a = shingles.scramble(g.integers(0, 1 << 62, 2000).astype(np.uint64))
    for share in (0.95, 0.85, 0.5):
        n = int(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:n], shingles.scramble(g.integers(0, 1 << 62, 2000 - n).astype(np.uint64))])
        s = neardup.odd_sketches(np.stack([neardup.samples(a), neardup.samples(b)])).view(np.uint64)
        got = neardup.similarity(int(np.bitwise_count(s[0] ^ s[1]).sum()))
        assert abs(got - share) < 0.2
    assert neardup.most_flipped() < 256


@pytest.mark.parametrize("small", [0, graph.SMALL])
def test_components(spark, monkeypatch, small):
    monkeypatch.setattr(graph, "SMALL", small)
    g = random.Random(2)
    edges = [(g.randrange(200), g.randrange(200)) for _ in range(150)] + [(k, k + 1) for k in range(300, 340)]
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    near = defaultdict(set)
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    for n in near:
        seen, todo = {n}, [n]
        while todo:
            for m in near[todo.pop()] - seen:
                seen.add(m)
                todo.append(m)
        assert got[n] == min(seen)


def test_lm_base(spark):
    out = run(spark, "op5_lm_score").set_index("doc_id")
    t = {i: (x or "").encode().lower().split() for i, x in TEXTS.items()}
    c = Counter()
    for i, w in t.items():
        if zlib.crc32(str(i).encode()) % 5 != 1:
            c.update(w)
            c[None] += 1
    n, v = sum(c.values()), len(c)
    for i, w in t.items():
        w = [*w, None]
        want = sum(math.log10((c[x] + 0.5) / (n + 0.5 * (v + 1))) for x in w)
        r = out.loc[i]
        assert r["base_score"] == pytest.approx(want, rel=1e-9) and (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(c[x] > 0 for x in w), n)
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 1)


def model_of(texts, bits=20):
    s = b"\n" + b"".join(map(lmscore.stream, texts))
    data = np.frombuffer(s, np.uint8).astype(int)
    code = lmscore.Code(np.bincount(data[:-1] * 256 + data[1:], minlength=1 << 16).reshape(256, 256))
    counts = [np.zeros(2 * (lmscore.NODES if k == 0 else 1 << bits), np.int64) for k in range(lmscore.CONTEXTS)]
    for _, parts in lmscore._batches(texts):
        pair, _, hashes = lmscore.contexts(parts)
        bit, slots = lmscore.decisions(code, pair, code.length[pair], hashes, bits)
        for c, x in zip(counts, slots):
            np.add.at(c, x.astype(int) * 2 + bit, 1)
    return lmscore.Model(code, bits, [lmscore.quantised(c[::2].astype(float), c[1::2].astype(float)) for c in counts])


def slow_steps(code, text):
    """(contexts, node, bit) of each decision of a text, from its bytes one by one."""
    s, out = lmscore.stream(text), []
    for i, b in enumerate(s):
        before = b"\n" * 4 + s[:i]
        words = s[:i].split(b" ")
        now = before[-1] * 256 + b
        keys = ("one", before[-1:]), ("three", before[-3:]), ("four", before[-4:]), ("word", words[-1]), ("pair", words[-1], words[-2] if len(words) > 1 else None)
        for j in range(code.first[now], code.first[now] + code.length[now]):
            out.append((keys, int(code.node[j]), int(code.bit[j])))
    return out


def test_lm_is_slow_mixing():
    """Whole scores against one decision after another: exact contexts (but for the few that share a slot), scalar mixing."""
    texts = [t.encode() for t in list(TEXTS.values())[:40] if t and len(t) < 1500]
    m, counts = model_of(texts, 22), defaultdict(lambda: [0, 0])
    for t in texts:
        for keys, node, bit in slow_steps(m.code, t):
            for k in keys:
                counts[k, node][bit] += 1
    some = [*texts, b"", b"Words that never were \xc3\xa9 \xff", b" ".join(texts[:9])]
    got, size = m.score(some)
    shared = every_one = 0
    for t, mine, n in zip(some, got, size):
        assert n == len(lmscore.stream(t))
        pair, _, hashes = lmscore.contexts([(lmscore.stream(t), 0)])
        _, slots = lmscore.decisions(m.code, pair, m.code.length[pair], hashes, m.bits)
        found = np.stack([table[x] for table, x in zip(m.tables, slots)], axis=1)
        total, steps = 0.0, slow_steps(m.code, t)
        assert len(steps) == len(found)
        for at, (keys, node, bit) in enumerate(steps):
            if at % lmscore.WINDOW == 0:
                w, ones, every = lmscore.FIRST_WEIGHTS.astype(float).copy(), lmscore._first_map(), np.full(lmscore.BUCKETS, lmscore.MAP_WEIGHT)
                later = []
            if at % lmscore.STEP == 0:  # what the last step was moves weights and map
                for g, x, miss, near, up in later:
                    w[g] += lmscore.RATE * miss * x
                    every[near] += 1
                    ones[near] += up
                later = []
            want = [np.clip(np.rint(lmscore.SCALE * math.log((b + lmscore.PRIOR) / (a + lmscore.PRIOR))), -127, 127) for a, b in (counts.get((k, node), (0, 0)) for k in keys)]
            shared += np.count_nonzero(found[at] != want)
            every_one += len(keys)
            x = found[at] / lmscore.SCALE
            g = (abs(x[3]) > 1) + 2 * (abs(x[4]) > 1)
            y = float(np.clip(w[g] @ x, -14, 14))
            p, near = 1 / (1 + math.exp(-y)), int(np.rint(y)) + lmscore.BUCKETS // 2
            both = (p + ones[near] / every[near]) / 2
            total += math.log10(both if bit else 1 - both)
            later.append((g, x, bit - p, near, bit))
        assert mine == pytest.approx(total, rel=1e-4)
    assert shared < 0.02 * every_one


def test_lm_is_a_distribution():
    """The probabilities of all texts of a few short words sum to less than 1."""
    m = model_of([b"a ab b ba"] * 20 + [b"", b"b"])
    short = [bytes([x]) for x in range(256) if x not in (9, 10, 11, 12, 13, 32) and not 65 <= x < 91]
    every = [b"", *short, *[bytes([x, y]) for x in range(97, 123) for y in range(97, 123)], *[x + b" " + y for x in short for y in short]]
    total = (10 ** m.score(every)[0]).sum()
    assert 0.02 < total < 1 + 1e-6


def test_lm_long_texts_keep_their_contexts(monkeypatch):
    g = random.Random(4)
    s = lmscore.stream(" ".join(g.choice(["a", "bcd", "efghij", "k" * 70]) for _ in range(3000)).encode())
    whole = lmscore.contexts([(s, 0)])
    parts = lmscore.pieces(s, 500)
    assert len(parts) > 20 and b"".join(p[k:] for p, k in parts) == s
    cut = lmscore.contexts(parts)
    assert (whole[0] == cut[0]).all() and all((a == b).all() for a, b in zip(whole[2], cut[2]))
    assert lmscore.pieces(b"x" * 2000 + b"\n", 500) == [(b"x" * 2000 + b"\n", 0)]


def test_lm_whatever_the_split(spark):
    """Neither partitions nor the order of rows change a score; it beats a smoothed unigram that spells unseen words."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    one = lmscore.score(docs).toPandas().sort_values("doc_id").reset_index(drop=True)
    two = lmscore.score(docs.repartition(7, "source").sortWithinPartitions("n_chars")).toPandas().sort_values("doc_id").reset_index(drop=True)
    assert (one["score"] == two["score"]).all() and (one["n_known"] == two["n_known"]).all() and np.allclose(one["base_score"], two["base_score"], rtol=1e-12)
    t = pd.read_parquet("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"])
    words = {i: (x or "").encode().lower().split() for i, x in zip(t["doc_id"], t["text"])}
    held = {i for i in words if zlib.crc32(str(i).encode()) % 5 == 1}
    c, letters = Counter(), Counter()
    for i in words.keys() - held:
        c.update(words[i])
        c[None] += 1
        for w in words[i]:
            letters.update(w + b" ")
    once, n, b = sum(v == 1 for v in c.values()), sum(c.values()), sum(letters.values())
    spell = lambda w: sum(math.log10((letters[x] + 1) / (b + 256)) for x in w + b" ")
    want = sum(math.log10(c[w] / n * (1 - once / n)) if c[w] else math.log10(once / n) + spell(w) for i in held for w in [*words[i], None])
    assert one.loc[one["held_out"], "score"].sum() > want and one["bits_per_byte"].between(0, 9).all()


def test_language_held_out(spark):
    out = run(spark, "op3_language").merge(DOCS, on="doc_id")
    h = out[out["held_out"] & out["lang"].notna()]
    assert len(h) > 10 and (h["lang_pred"] == h["lang"]).mean() > 0.95


def test_language_backs_off():
    m = langid.Model(["a", "b"], {"known": 0}, np.array([[0.0, -2.0]]), {"^xy": 0}, np.array([[-3.0, 0.0]]))
    s = langid.Scorer(m, remember=3)
    assert s.predict("known")[0] == "a" and s.predict("xyz")[0] == "b" and s.predict("123") == ("und", 0.0)
    for k in range(20):  # beyond what it may remember
        assert s.predict(" ".join("xy" + "abcdefghij"[(k + i) % 10] for i in range(8)))[0] == "b"


def test_quality_held_out(spark):
    labels = pd.read_parquet("/root/testdata/sf0.01/labels.parquet")
    out = entry.queries()["op8_quality"](spark, "/root/testdata/sf0.01").toPandas().merge(labels, on="doc_id")
    h = out[out["held_out"]]
    rank, good = h["score"].rank(), h["quality"] == 1
    auc = (rank[good].sum() - good.sum() * (good.sum() + 1) / 2) / good.sum() / (~good).sum()
    assert auc > 0.9 and h["predicted"][good].mean() > 0.97


def test_quality_learns_late_text(spark):
    """What only the end of long documents has is in the dictionary of their label."""
    g = random.Random(7)
    late = "".join(g.choice("klmnopqrstuvwxyz ") for _ in range(1500))
    texts = ["".join(g.choice("abcdefghij ") for _ in range(5000)) + (late if k % 2 == 0 else "") for k in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    m = quality.fit(docs, spark.createDataFrame([(k, k % 2) for k in range(120)], "doc_id long, quality int"))
    assert late[700:800].encode() in m.bad and late[700:800].encode() not in m.good


def test_neighbours_recall(spark):
    e = pd.read_parquet("/root/testdata/sf0.01/embeddings.parquet")
    out = entry.queries()["op7_neighbours"](spark, "/root/testdata/sf0.01").toPandas()
    v, ids = np.stack(e["embedding"]).astype(float), e["vec_id"].to_numpy()
    hit = 0
    for q, found in out.groupby("query_id"):
        s = v @ v[ids == q][0]
        s[ids == q] = -9
        hit += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(found["vec_id"]))
        assert np.allclose(found["score"], s[found["vec_id"].map({i: k for k, i in enumerate(ids)})])
    assert hit >= 0.9 * len(out)


def test_balanced_parts():
    x = ann._unit(np.random.default_rng(1).standard_normal((500, 16)))
    parts = np.bincount(ann.bisect(ann.neighbour_graph(x), x, 8))
    assert len(parts) == 8 and parts.max() - parts.min() <= 4


def test_media_round_trip():
    g = np.random.default_rng(2)
    for t in (None, b"", b"a", b"x" * 64, g.bytes(5000), bytes(range(256)) * 9):
        payload = media.pad(t)
        frames, length, rate = media.parse(media.encode(payload))
        assert media.decode_samples(frames).tobytes()[:length] == payload and rate == 25
    assert np.array_equal(jpeg.block_means(frames), media.decode_samples(frames))
    assert (jpeg.decode(frames[0])[0][:8, :8] == payload[0]).all()


def test_shots():
    s = np.zeros((30, 512), np.uint8)
    s[10:20] = 120
    s[20:] = 240
    assert media.shots(s) == [0, 10, 20] and media.shots(s[:1]) == [0] and media.shots(s[:0]) == []


def test_mixing_oracle(spark):
    import duckdb

    got = run(spark, "op6_mixing").sort_values("doc_id").reset_index(drop=True)
    c = duckdb.connect()
    c.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    want = c.sql(entry.oracle_sql()["op6_mixing"]).df().sort_values("doc_id").reset_index(drop=True)
    pd.testing.assert_frame_equal(got[want.columns], want, check_dtype=False)


def test_media_values(spark):
    out = run(spark, "op9_media").set_index("doc_id")
    for i, t in TEXTS.items():
        raw = (t or "").encode()
        payload = raw + bytes(-len(raw) % 64 or (0 if raw else 64))
        m, r = media.encode(payload), out.loc[i]
        frames, length, _ = media.parse(m)
        assert (r["n_bytes"], r["payload_bytes"], r["tail_crc32"]) == (len(raw), len(payload), zlib.crc32(payload[-64:])) and media.decode_samples(frames).tobytes()[:length] == payload
        assert (r["payload_sha256"], r["media_bytes"], r["media_sha256"]) == (hashlib.sha256(payload).hexdigest(), len(m), hashlib.sha256(m).hexdigest())
        count = np.bincount(np.frombuffer(payload, np.uint8) >> 4, minlength=16)
        assert r["feature"].endswith("hist=" + "-".join(map(str, count))) and f";mean={sum(payload) * 100 // len(payload)};" in r["feature"]


def test_links_of_rows_without_an_id(spark):
    words = [f"w{k}" for k in range(400)]
    texts = []
    for _ in range(3):
        texts.append(" ".join(words))
        words = [f"x{len(texts)}_{k}" if k % 80 == 7 * len(texts) else w for k, w in enumerate(words)]
    d = spark.createDataFrame([(1, texts[0]), (None, texts[1]), (3, texts[2])], "doc_id long, text string")
    assert {(r["doc_id"], r["component_id"]) for r in neardup.deduplicate(d).collect()} == {(1, 1), (None, 1), (3, 1)}


def test_neighbours_overflow_and_cancel():
    g = np.random.default_rng(3)
    c = g.standard_normal((300, 8)) * 1e3
    q = np.zeros((1, 8))
    q[0, :2] = 1e160
    c[5, :2] = 1e160
    i, j, s = ann.nearest(np.array([-1]), q, np.arange(300), c, 20)
    assert j[0] == 5 and np.isinf(s[0]) and len(j) == 20
    want = ann.exact(np.repeat(q, 300, axis=0), c)
    assert list(j) == list(np.lexsort((np.arange(300), -want))[:20])


def test_language_of_no_letters(spark):
    m = langid.Model(["a"], {"x": 0}, np.zeros((1, 1)), {}, np.zeros((0, 1)))
    s = langid.Scorer(m)
    assert s.predict("½ ² Ⅷ 12 ४") == ("und", 0.0) and s.predict("x")[0] == "a" and langid.words_of("नमस्ते") == ["नमस्ते"]


def test_marginals_near_enumeration():
    """Message passing on a small loop against the sum over all labellings; exact without the loop."""
    import itertools

    texts = ["4111111111111111 and 15550177993 then 4111111111111112 or 15550177993 or 4111111111111111"]
    f = pii.learn([f"call +1 (555) 01{k}-77{k}3 or card 4396177793418310 of item {k}" for k in range(10, 40)])
    f.skip = f.skip * 0.2
    graph_ = pii.Graph()
    graph_.add(0, texts[0], [])
    x, allow, fixed, chain, skip, alike = graph_.arrays()
    score = np.where(allow, x @ f.unary, -50.0)
    total, n = np.zeros(score.shape), len(score)
    for labels in itertools.product(*[np.flatnonzero(a) for a in allow]):
        e = sum(score[k, y] for k, y in enumerate(labels)) + sum(f.chain[labels[a], labels[b]] for a, b in chain)
        e += sum(f.skip[labels[a], labels[b]] for a, b in skip) + pii.ALIKE * sum(f.skip[labels[a], labels[b]] for a, b in alike)
        for k, y in enumerate(labels):
            total[k, y] += np.exp(e - 30)
    want = total / total.sum(axis=1, keepdims=True)
    assert n >= 4 and len(skip) + len(alike) >= 3 and np.abs(f.marginals(graph_, 60) - want).max() < 0.1


def test_secrets_are_found():
    train = [f'token = "{hashlib.sha1(b"%d" % k).hexdigest()}" of {k} and AKIA{"ABCDEFGH2345WXYZ"[k % 5:] + "QQQQQ"[: k % 5]} x' for k in range(60)]
    f = pii.learn(train + [f"chapter {k} of version {k}.5 in 20{k}" for k in range(10, 60)])
    t = 'here password=e3b3ed3cc8548923d6 is; version 2.0 of 1999'
    got = {(pii.SPANS[k], t[s:e]) for s, k, e in pii.all_spans(f, [t])[0][1]}
    assert got == {("secret", "e3b3ed3cc8548923d6")}


def test_pipeline_against_brute_force(spark):
    """Every stage's result on a small table from plain functions of its input."""
    import corpus_pipeline
    from tokenizers import Tokenizer

    now = spark.read.parquet(f"{SF}/documents.parquet")
    before, out = DOCS, {}
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, now, SF).cache()
        after = got.toPandas()
        ids = Counter(after["doc_id"])
        texts = dict(zip(before["doc_id"], before["text"]))
        if name == "language":
            s = langid.Scorer(langid.fit(now))
            assert ids == Counter(i for i, t in texts.items() if (p := s.predict(t))[0] != "und" and p[1] >= 0.5)
        elif name == "near_duplicates":
            whole = {i: lowered(t).split() for i, t in texts.items()}
            sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()) for i, w in whole.items()}
            near = defaultdict(list)
            for a in sets:
                for b in sets:
                    both = len(sets[a] & sets[b])
                    if a < b and both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                        near[a].append(b)
                        near[b].append(a)
            gone, seen = set(), set()
            for i in sorted(sets):
                todo = [i] if i not in seen else []
                while todo:
                    x = todo.pop()
                    if x not in seen:
                        seen.add(x)
                        gone |= {x} if x != i else set()
                        todo += near[x]
            assert ids == Counter(sets.keys() - gone)
        elif name == "personal_data":
            f = pii.fit(now)
            assert ids == Counter(texts.keys())
            for i, t in zip(after["doc_id"], after["text"]):
                want = texts[i]
                for s, k, e in reversed(pii.all_spans(f, [want])[0][1]):
                    want = want[:s] + f"[{pii.SPANS[k].upper()}]" + want[e:]
                assert t == want and not base(t)
        elif name == "mixing":
            taken = {r["doc_id"]: r["copies"] for r in corpus_pipeline.mixing.plan(now).collect()}
            assert ids == Counter(taken)
        else:
            lib = Tokenizer.from_file(bpe.default_path())
            assert sorted((i, list(x)) for i, x in zip(after["doc_id"], after["ids"])) == sorted((i, lib.encode(t, add_special_tokens=False).ids) for i, t in zip(before["doc_id"], before["text"]))
        now, before = got, after


def test_lm_learns_where_texts_begin():
    """What a fold says about weights: against a scalar sum over its decisions, whatever the batches; and steps that lower the loss."""
    texts = [t.encode() for t in list(TEXTS.values())[:60] if t and len(t) < 1500]
    m, fold = model_of(texts[:40], 16), texts[40:]
    w = np.rint(lmscore.FIRST_WEIGHTS * lmscore.WEIGHT_STEPS).astype(np.int64)
    got = lmscore.gathered(m, w, fold)
    assert (got == sum(lmscore.gathered(m, w, [t]) for t in fold[::-1])).all()
    loss, slope, ones = np.zeros(lmscore.GATES), np.zeros((lmscore.GATES, lmscore.CONTEXTS)), 0
    for t in fold:
        pair, _, hashes = lmscore.contexts([(lmscore.stream(t), 0)])
        bit, slots = lmscore.decisions(m.code, pair, m.code.length[pair], hashes, m.bits)
        found = np.stack([table[x] for table, x in zip(m.tables, slots)], axis=1) / lmscore.SCALE
        for x, up in zip(found, bit):
            g = int((abs(x[3]) > 1) + 2 * (abs(x[4]) > 1))
            p = 1 / (1 + math.exp(-np.clip(lmscore.FIRST_WEIGHTS[g] @ x, -14, 14)))
            loss[g] -= math.log(p if up else 1 - p)
            slope[g] += (up - p) * x
            ones += int(up)
    per = got[: -2 * lmscore.BUCKETS].reshape(lmscore.GATES, -1).astype(float)
    assert np.allclose(per[:, 0] / lmscore.CHANCE_STEPS, loss, rtol=0.02)
    assert np.allclose(per[:, 1:6] / lmscore.CHANCE_STEPS / lmscore.SCALE, slope, atol=0.01 * np.abs(slope).max() + 2)
    assert got[-lmscore.BUCKETS :].sum() == ones and got[-2 * lmscore.BUCKETS : -lmscore.BUCKETS].sum() >= ones


def test_lm_weights_come_from_the_training_rows(spark):
    """Other training texts, other weights, with a lower loss than the neutral start has on the held-out; held-out texts change nothing; few rows leave the start."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = lmscore.fit(docs)
    other = lmscore.fit(docs.withColumn("text", F.when(lmscore.held_out(), F.lit("x y z")).otherwise(F.col("text"))))
    assert (m.weights == other.weights).all() and (m.chances == other.chances).all() and not (m.weights == lmscore.FIRST_WEIGHTS).any()
    held = [bytes(r["text"] or b"") for r in docs.filter(lmscore.held_out()).select(F.col("text").cast("binary").alias("text")).collect()]
    plain = lmscore.Model(m.code, m.bits, m.tables)
    assert m.score(held)[0].sum() > plain.score(held)[0].sum()
    few = lmscore.fit(docs.filter("doc_id < 0"))
    assert (few.weights == lmscore.FIRST_WEIGHTS).all()

"""Personal data by base patterns and a skip-chain conditional random field.

Base: email, ip, card and phone patterns, leftmost and without overlap per kind, each found in
time linear in the text. Then every chunk with a digit or an @ is a node of a field over
the labels none, email, ip, card, phone, secret (keys, tokens, passwords). Neighbouring chunks
share chain potentials; distant chunks of the same normalised form or the same digits share
skip potentials, each with the one before it, and similar chunks (one digit apart, a masked
number, an address of the same name) a share of them, so a value that is recognised once
pulls its other mentions to the same label. Loopy message passing over whole batches gives marginals; chunks inside
base spans are fixed, all other text is none. Runs of chunks whose label is sure enough
become added spans; base spans always stay.

Weights are learned by pseudo-likelihood on a bounded sample of documents (``SAMPLE`` rows,
first in the order of a hash) labelled by the base patterns, and by seeds for secrets (a named
long mixed value, a key's identifier), with the features that these rest on left out at
random, so that shape and surroundings count too.

Null texts count as empty and have no spans. Rows are independent; equal texts give equal
spans. Extra columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldspark.llm import store

KINDS = ("email", "ip", "card", "phone")
SPANS = (*KINDS, "secret")
SAMPLE, ROUNDS, SURE = 3000, 8, 0.9
LABELS = 1 + len(SPANS)
#: The potentials of similar chunks, as a share of those of equal ones.
ALIKE = 0.5

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_MARK = re.compile(r"[0-9@]")
_SPACE = re.compile(r"\s")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n - 9 if n > 4 else 2 * n)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = at + 1
        at = text.find("@", done)
    if _MARK.search(text):
        for m in _DOTTED.finditer(text):
            if text.count(".", m.start(), m.end()) >= 3:
                parts, begin = m.group().split("."), m.start()
                for i in range(0, len(parts) - 3, 4):
                    four = parts[i : i + 4]
                    end = begin + sum(map(len, four)) + 3
                    if all(len(p.lstrip("0")) <= 3 and int(p[-4:]) <= 255 for p in four):
                        out.append((begin, 1, end))
                    begin = end + 1
        for m in _DIGITS.finditer(text):
            if m.end() - m.start() >= 14:
                digits = m.group().replace(" ", "").replace("-", "")
                if 14 <= len(digits) <= 19 and luhn(digits):
                    out.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                    out.append((m.start(), 3, m.end()))
    out.sort()
    return out


def written(spans) -> str:
    return ",".join([f"{SPANS[k]}:{s}:{e}" for s, k, e in spans])


# --- the field ---------------------------------------------------------------------------------

#: Words that announce a kind.
CUES = (
    ("mail", "email", "e-mail", "correo", "contact"), ("ip", "host", "server", "addr"), ("card", "visa", "credit", "karte", "carte", "tarjeta"),
    ("phone", "tel", "call", "fax", "mobile", "cell"), ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "auth", "credential", "passwort", "clave"),
)
FEATURES = 34
#: Features that the seed patterns rest on, left out at random in training.
STRONG = (2, 3, 12, 16, 17, 24, 29)


def chunks(text: str) -> list[tuple[int, int]]:
    """Bounds of the white-space chunks with a digit or an @, outer punctuation left out."""
    out, done = [], 0
    m = _MARK.search(text)
    while m:
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        gap = _SPACE.search(text, m.end())
        end = done = gap.start() if gap else len(text)
        while start < end and not (text[start].isalnum() or text[start] in "+("):
            start += 1
        while end > start and not (text[end - 1].isalnum() or text[end - 1] == ")"):
            end -= 1
        if end > start:
            out.append((start, end))
        m = _MARK.search(text, done)
    return out


_DIGIT, _LETTER = re.compile("[0-9]"), re.compile(r"[^\W\d_]")
_KEYED = re.compile(r"""(?:.*[=:])?["']?([A-Za-z0-9+/_-]{12,})["']?$""", re.S)
#: Fixed value: the form of a cloud access key's identifier.
_KEY_ID = re.compile(r"(?:AKIA|ASIA)[A-Z2-7]{16}$")
_TURNS = re.compile(r"[A-Za-z](?=[0-9])|[0-9](?=[A-Za-z])")


def value_of(token: str) -> tuple[int, int]:
    """Where in a chunk its value lies: what follows the last = or : where that is long, or all of it."""
    m = _KEYED.match(token)
    return m.span(1) if m else (0, len(token))


def cue_before(text: str, start: int) -> str:
    """The last word before a chunk, signs left out."""
    for w in reversed(text[max(0, start - 40) : start].lower().split()):
        w = w.strip(".,:;()=\"'")
        if w:
            return w
    return ""


def features(text: str, start: int, end: int) -> list[int]:
    token = text[start:end]
    digits, letters = len(_DIGIT.findall(token)), len(_LETTER.findall(token))
    out = [0]
    if "@" in token:
        out.append(2 if "." in token[token.index("@") :] else 3)
    out.append(4 + (0 if digits == 0 else 1 if digits == 1 else 2 if digits < 4 else 3 if digits < 7 else 4 if digits < 10 else 5 if digits < 13 else 6 if digits < 20 else 7))
    if token[0] == "+":
        out.append(12)
    if letters == 0:
        out.append(13)
    elif digits:
        out.append(14)
    if "(" in token:
        out.append(15)
    if token.count(".") == 3 and letters == 0:
        out.append(16)
    if 13 <= digits <= 19 and digits == len(token) and luhn(token):
        out.append(17)
    if "-" in token and letters == 0:
        out.append(18)
    if "=" in token or '"' in token or "'" in token:
        out.append(19)
    cue = cue_before(text, start)
    s, e = value_of(token)
    name = token[:s].lower().strip("=:\"'")
    for i, words in enumerate(CUES):
        if cue in words or name in words:
            out.append(20 + i)
    if start == 0 or text[start - 1] == "\n":
        out.append(25)
    if "." in token and letters == 0 and digits < 4:
        out.append(26)
    if "/" in token or ":" in token:
        out.append(27)
    if e - s >= 12 and digits and letters:
        turns = len(_TURNS.findall(token, s, e))
        out.append(28 if turns < 3 else 30 if turns < 6 else 31)
        if _KEY_ID.match(token, s, e):
            out.append(29)
        if token[s:e].isupper():
            out.append(32)
        if e - s >= 18:
            out.append(33)
    return out


def seed_secret(text: str, start: int, end: int) -> bool:
    """Whether a chunk is a secret for certain: a key's identifier, or a long mixed value after its name."""
    token = text[start:end]
    s, e = value_of(token)
    if _KEY_ID.match(token, s, e):
        return True
    if not (e - s >= 12 and _DIGIT.search(token, s, e) and _LETTER.search(token, s, e)):
        return False
    return token[:s].lower().strip("=:\"'") in CUES[4] or cue_before(text, start) in CUES[4]


def allowed(text: str, start: int, end: int) -> np.ndarray:
    """Labels that the form of a chunk permits."""
    token = text[start:end]
    digits, letters = _DIGIT.search(token) is not None, _LETTER.search(token) is not None
    s, e = value_of(token)
    secret = digits and e - s >= 12 and _LETTER.search(token, s, e) is not None and _DIGIT.search(token, s, e) is not None
    return np.array([True, "@" in token or letters and digits and "." in token, digits and not letters and "." in token, digits and not letters, digits and not letters, secret])


_MASKED = re.compile(r"[xX*#\u2022]{2,}[\x20-]?([0-9]{4})$")


def key(token: str) -> tuple[list[str], list[str]]:
    """Forms under which a chunk counts as repeated, and those under which it counts as similar: digits with one left
    out (so that one differs), an address's name, the last four digits of a number that is masked elsewhere."""
    digits = re.sub(r"[^0-9]", "", token)
    same = [f"t{token[slice(*value_of(token))].lower()}"] + ([f"d{digits}"] if len(digits) >= 6 else [])
    alike = []
    if 9 <= len(digits) <= 19:
        alike += {f"o{digits[:i]}{digits[i + 1:]}" for i in range(len(digits))}
        alike.append(f"m{digits[-4:]}")
    m = _MASKED.search(token)
    if m:
        alike.append(f"m{m.group(1)}")
    at = token.find("@")
    if at >= 5:
        alike.append(f"n{token[:at].lower()}")
    return same, alike


class Graph:
    """Nodes and edges of many texts."""

    def __init__(self):
        self.feats, self.allow, self.fixed, self.chain, self.skip, self.alike, self.where = [], [], [], [], [], [], []

    def add(self, doc: int, text: str, base) -> None:
        found = chunks(text)
        if not found:
            return
        last: dict[str, int] = {}
        j, before = 0, None
        for start, end in found:
            n = len(self.where)
            while j < len(base) and base[j][2] <= start:
                j += 1
            self.fixed.append(base[j][1] + 1 if j < len(base) and base[j][0] < end else 0)
            self.feats.append(features(text, start, end))
            self.allow.append(allowed(text, start, end))
            if before is not None and text[before:start].strip() == "" and start - before <= 3:
                self.chain.append((n - 1, n))
            before = end
            same, alike = key(text[start:end])
            linked = set()
            for keys, edges in ((same, self.skip), (alike, self.alike)):
                for k in keys:
                    if k in last and last[k] not in linked:
                        linked.add(last[k])
                        edges.append((last[k], n))
                    last[k] = n
            self.where.append((doc, start, end))

    def arrays(self):
        n = len(self.where)
        x = np.zeros((n, FEATURES))
        for i, f in enumerate(self.feats):
            x[i, f] = 1
        edges = lambda e: np.array(e, np.int64).reshape(-1, 2)
        return x, np.array(self.allow).reshape(n, LABELS), np.array(self.fixed, np.int64), edges(self.chain), edges(self.skip), edges(self.alike)


class Field:
    def __init__(self, unary: np.ndarray, chain: np.ndarray, skip: np.ndarray):
        self.unary, self.chain, self.skip, self.key = unary, chain, skip, uuid.uuid4().hex

    def marginals(self, g: Graph, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy message passing, all edges of all texts at once."""
        x, allow, fixed, chain, skip, alike = g.arrays()
        score = np.where(allow, x @ self.unary, -50.0)
        known = fixed > 0
        score[known] = -50.0
        score[known, fixed[known]] = 0.0
        both = np.concatenate((chain, skip, alike))
        source, target = both.T.ravel(), both[:, ::-1].T.ravel()
        n = len(both)
        back = np.concatenate((np.arange(n) + n, np.arange(n)))
        of = np.repeat([0, 1, 2], [len(chain), len(skip), len(alike)])
        kinds = np.stack((self.chain, self.skip, ALIKE * self.skip))
        pair = np.concatenate((kinds[of], kinds.transpose(0, 2, 1)[of]))
        m = np.zeros((len(source), LABELS))
        for _ in range(rounds if len(source) else 0):
            total = score.copy()
            np.add.at(total, target, m)
            out = (total[source] - m[back])[:, :, None] + pair
            top = out.max(axis=1)
            new = top + np.log(np.exp(out - top[:, None]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            m = 0.5 * m + 0.5 * new
        np.add.at(score, target, m)
        score -= score.max(axis=1, keepdims=True)
        p = np.exp(score)
        return p / p.sum(axis=1, keepdims=True)


def learn(texts: list[str], rounds: int = 300, rate: float = 0.5, ridge: float = 1e-4) -> Field:
    """Pseudo-likelihood: each node given its neighbours' labels."""
    g = Graph()
    for i, t in enumerate(texts):
        g.add(i, t, base_spans(t))
    unary, chain, skip = np.zeros((FEATURES, LABELS)), np.zeros((LABELS, LABELS)), np.zeros((LABELS, LABELS))
    unary[0, 0] = 2.0
    chain += 0.5 * np.eye(LABELS)
    prior = np.diag([1.0] + [6.0] * len(SPANS))  # few documents repeat a value, so what is learned starts from agreement
    skip += prior
    if not g.where:
        return Field(unary, chain, skip)
    x, allow, y, pairs, repeats, alike = g.arrays()
    for n, (i, start, end) in enumerate(g.where):
        if y[n] == 0 and seed_secret(texts[i], start, end):
            y[n] = LABELS - 1
    allow[np.arange(len(y)), y] = True
    drop = np.array([[zlib.crc32(b"%d:%d" % (i, f)) % 10 < 3 for f in STRONG] for i in range(len(x))])
    x[:, list(STRONG)] *= ~drop
    one = np.eye(LABELS)[y]
    left, right, same = np.zeros_like(one), np.zeros_like(one), np.zeros_like(one)
    np.add.at(right, pairs[:, 0], one[pairs[:, 1]])
    np.add.at(left, pairs[:, 1], one[pairs[:, 0]])
    for edges, much in ((repeats, 1.0), (alike, ALIKE)):
        np.add.at(same, edges[:, 0], much * one[edges[:, 1]])
        np.add.at(same, edges[:, 1], much * one[edges[:, 0]])
    n = len(x)
    for _ in range(rounds):
        z = np.where(allow, x @ unary + left @ chain + right @ chain.T + same @ skip, -50.0)
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        d = (one - p) / n
        unary += rate * (x.T @ d * 4 - ridge * unary)
        chain += rate * (left.T @ d + d.T @ right - ridge * chain)
        step = same.T @ d
        skip += rate * ((step + step.T) / 2 - ridge * (skip - prior))
    return Field(unary, chain, skip)


def all_spans(field: Field, texts: list[str]) -> list[tuple[list, list]]:
    """For each text its base spans, and all spans."""
    g, bases = Graph(), []
    for i, t in enumerate(texts):
        b = base_spans(t)
        bases.append(b)
        g.add(i, t, b)
    added: dict[int, list] = {}
    if g.where:
        p = field.marginals(g)
        label = p.argmax(axis=1)
        sure = (p.max(axis=1) >= SURE) & (label > 0) & (np.array(g.fixed) == 0)
        joined = {b for a, b in g.chain if sure[a] and sure[b] and label[a] == label[b]}
        for n in np.flatnonzero(sure).tolist():
            doc, start, end = g.where[n]
            spans = added.setdefault(doc, [])
            if label[n] == LABELS - 1:
                first, last = value_of(texts[doc][start:end])
                spans.append((start + first, LABELS - 2, start + last))
            elif n in joined and spans:
                spans[-1] = (spans[-1][0], int(label[n]) - 1, end)
            else:
                spans.append((start, int(label[n]) - 1, end))
    out = []
    for i, b in enumerate(bases):
        more = added.get(i)
        if more:
            keep, j = [], 0
            for s, k, e in more:  # both lists are in order
                while j < len(b) and b[j][2] <= s:
                    j += 1
                if (j == len(b) or b[j][0] >= e) and _whole(texts[i][s:e], k):
                    keep.append((s, k, e))
            out.append((b, sorted(b + keep)))
        else:
            out.append((b, b))
    return out


def _whole(text: str, kind: int) -> bool:
    """Whether an added span holds as much as a value of its kind must."""
    digits = sum(c.isdigit() for c in text)
    return (digits > 0 or "@" in text, text.count(".") == 3, 12 <= digits <= 19, 7 <= digits <= 15, len(text) >= 12)[kind]


def _field(shared) -> Field:
    return store.held(shared[0], lambda: shared[1].value)


def fit(docs: DataFrame, rows: int = SAMPLE) -> Field:
    """Learn the field on a bounded sample of documents, each read to its end. Rows of a doc_id that is repeated are
    documents of their own, in the order of a hash of their text."""
    spark = docs.sparkSession
    h = F.xxhash64(F.lit("pii"), F.col("doc_id"))
    few = docs.filter("text is not null and doc_id is not null").select("doc_id").orderBy(h, "doc_id").limit(rows)
    texts = docs.select("doc_id", "text").join(F.broadcast(few.distinct()), "doc_id").select(h.alias("h"), F.col("text").cast("string").alias("text"))  # ``rows`` ids at most

    def near(batches):
        """Only what lies around chunks goes to the driver."""
        for b in batches:
            hashes, out = [], []
            for n, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                pieces, done = [], 0
                for s, e in chunks(t or ""):
                    lo, hi = max(done, s - 60), min(len(t), e + 20)
                    if hi > lo:
                        pieces.append(t[lo:hi])
                        done = hi
                if pieces:
                    hashes.append(n)
                    out.append("".join(pieces))
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.int64()), pa.array(out, pa.string())], names=["h", "text"])

    got = store.in_arrow(texts, near, "h long, text string").orderBy("h", F.xxhash64("text"), "text").limit(rows).toPandas()
    return learn(sorted(got["text"]))


FOUND = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_secret long, n_spans long"


def find(docs: DataFrame, field: Field) -> DataFrame:
    """Per document: base counts and digest, and all spans."""
    shared = field.key, docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        f = _field(shared)
        for b in batches:
            for start, end in store.slices(b.column(1)):
                part = b.slice(start, end - start)
                rows = []
                for base, spans in all_spans(f, [t or "" for t in part.column(1).to_pylist()]):
                    kinds = [k for _, k, _ in base]
                    rows.append((*[kinds.count(k) for k in range(4)], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), sum(k == 4 for _, k, _ in spans), len(spans)))
                kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()] * 2
                yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows), kinds))], names=names)

    names = [x.split()[0] for x in FOUND.split(", ")]
    return store.in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), run, FOUND)


def redacted(text: str, spans) -> str:
    out, done = [], 0
    for s, k, e in spans:
        if s >= done:
            out += [text[done:s], f"[{SPANS[k].upper()}]"]
        done = max(done, e)  # of overlapping spans the first gives the name
    return "".join([*out, text[done:]])


def redact(docs: DataFrame, field: Field) -> DataFrame:
    """``docs`` with every span of ``text`` replaced by its kind in brackets, and ``n_chars``, where
    there is one, counted again. Rows, columns and null texts stay."""
    names = docs.columns
    at = names.index("text")
    shared = field.key, docs.sparkSession.sparkContext.broadcast(field)

    def run(batches):
        f = _field(shared)
        for b in (whole.slice(start, end - start) for whole in batches for start, end in store.slices(whole.column(at))):
            texts = b.column(at).to_pylist()
            new = [t if t is None else redacted(t, spans) for t, (_, spans) in zip(texts, all_spans(f, [t or "" for t in texts]))]
            cols = list(b.columns)
            cols[at] = pa.array(new, b.column(at).type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    out = store.in_arrow(docs, run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("text").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out

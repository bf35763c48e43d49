"""BPE encoding and decoding by per-prefix dynamic programming.

For a proper BPE the encoding of every prefix of a word ends in one token only: the token t
that spans (j, i] such that j is 0 or the last token of prefix j is compatible with t, that
is, no merge can cross the border between the two while both are built. So one table entry
per prefix suffices. The tokens ending at each place come from an automaton over the
vocabulary's suffixes; back-pointers from the last prefix give the exact ids.

White space separates words before anything else, so the ids of an encoded chunk are
remembered, in a table of bounded size. Texts are encoded in slices of a few MB, whole texts
each. Null texts count as empty and have no ids. The file's special strings are recognised
in the text, as the library does by default. Rows are independent: repeated rows get equal
results, empty tables give empty tables, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from array import array
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldspark.llm import store

#: The pre-tokeniser's pattern and Unicode white space, as the vocabulary file states.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"
WORD_END = "</w>"
NEVER = (1 << 31) - 1
NONE = b""


def byte_letters() -> list[str]:
    """The printable character for each byte: printable Latin-1 stands for itself, others start at 256."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, free = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else free))
        free += b not in plain
    return out


class Encoder:
    """Exact BPE with word ends, from the JSON of a ``tokenizers`` file."""

    def __init__(self, source: str, remember: int = 80_000, pairs: int = 250_000):
        spec = json.loads(source)
        library = Tokenizer.from_str(source)
        self.normal, self.cut = library.normalizer, library.pre_tokenizer
        model = spec["model"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        top = max([*model["vocab"].values(), *self.special.values()])
        self.text: list[str | None] = [None] * (top + 1)
        for t, i in [*model["vocab"].items(), *self.special.items()]:
            self.text[i] = t
        self.number = list(map(str, range(top + 1)))
        self.remember, self.most_pairs = remember, pairs
        self.chunks, self.older_chunks, self.words, self.older_words, self.pairs = {}, {}, {}, {}, {}
        self.pieces = regex.compile(PIECES.replace(r"\s", SPACE))
        self.spaces = regex.compile(f"[{SPACE}]+")
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.inner = byte_letters()
        self._tokens(model, top + 1)

    def _symbols(self, token: str) -> str:
        """A token as one character per byte, the word's last byte being marked."""
        if not token.endswith(WORD_END) or token == WORD_END:
            return token
        token = token.removesuffix(WORD_END)
        return token[:-1] + chr(0x4000 + ord(token[-1]))

    def _tokens(self, model: dict, size: int) -> None:
        vocab = model["vocab"]
        self.rank: dict[int, int] = {}
        parts: dict[int, tuple[int, int, int]] = {}
        for r, pair in enumerate(model["merges"]):
            a, b = pair if not isinstance(pair, str) else pair.split(" ")
            self.rank[vocab[a] << 32 | vocab[b]] = r
            parts.setdefault(vocab[a + b], (vocab[a], vocab[b], r))
        # Spines: what stands at a token's left and right border while it is built, with the rank of the merge that takes
        # it away; a token's lie one after the other, from ``first`` on.
        self.left, self.right = ((array("i"), array("i"), array("i", [0]) * size) for _ in "lr")
        for t in vocab.values():
            for (at, gone, first), side in ((self.left, 0), (self.right, 1)):
                spine, x, until = [], t, NEVER
                while True:
                    spine.append((x, until))
                    if x not in parts:
                        break
                    until, x = parts[x][2], parts[x][side]
                first[t] = len(at)
                for x, until in reversed(spine):
                    at.append(x)
                    gone.append(until)
        self.suffixes = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        self.length = array("i", [0]) * size
        for token, t in vocab.items():
            s = self._symbols(token)
            if t not in parts or self.compatible(*parts[t][:2], made=t):
                self.suffixes.add_word(s, t)
                self.length[t] = len(s)
        self.suffixes.make_automaton()

    def compatible(self, a: int, b: int, made: int | None = None) -> bool:
        """Whether no merge crosses the border of a and b. With ``made``: whether the first that does is theirs."""
        (x, gone_x, i), (y, gone_y, j), rank = self.right, self.left, self.rank
        i, j = i[a], j[b]
        while True:
            s, t, gone_s, gone_t = x[i], y[j], gone_x[i], gone_y[j]
            r = rank.get(s << 32 | t, NEVER)
            if r < gone_s and r <= gone_t and r < NEVER:  # equal ranks: the pair on the left is merged first
                return made is not None and s == a and t == b
            if gone_s == gone_t == NEVER:
                return made is None
            if gone_s <= gone_t:
                i += 1
            else:
                j += 1

    def piece(self, letters: str) -> list[int]:
        """Ids of one pre-token, given as one character per byte."""
        whole = letters[:-1] + chr(0x4000 + ord(letters[-1]))
        if whole in self.suffixes:
            return [self.suffixes.get(whole)]
        n, done = len(letters), -1
        last, back = [-1] * n, [0] * n
        pairs, length = self.pairs, self.length
        for end, t in self.suffixes.iter(whole):
            if end == done:  # a prefix has one last token only
                continue
            j = end - length[t]  # the end of the prefix before it
            if j >= 0:
                before = last[j]
                if before < 0:
                    continue
                key = before << 32 | t
                fits = pairs.get(key)
                if fits is None:
                    if len(pairs) >= self.most_pairs:
                        pairs.clear()
                    fits = pairs[key] = self.compatible(before, t)
                if not fits:
                    continue
            last[end], back[end] = t, j
            done = end
        out, at = [], n - 1
        while at >= 0:
            if last[at] < 0:
                raise ValueError("a byte is not in the vocabulary")
            out.append(last[at])
            at = back[at]
        return out[::-1]

    def _word(self, letters: str) -> bytes:
        got = self.older_words.get(letters)
        if got is None:
            got = array("i", self.piece(letters)).tobytes()
        if len(self.words) >= self.remember:
            self.words, self.older_words = {}, self.words
        if len(letters) <= 50:
            self.words[letters] = got
        return got

    def _pieces(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk without white space, one character per byte. Latin text is cut here,
        other text by the library, whose tables of letters may be of another Unicode version."""
        if chunk.isascii() and chunk.isprintable():
            return self.pieces.findall(chunk.lower())
        chunk = self.normal.normalize_str(chunk)
        if max(chunk) < "\u0250":
            to = self.inner
            return ["".join([to[b] for b in p.encode()]) for p in self.pieces.findall(chunk)]
        return [p for p, _ in self.cut.pre_tokenize_str(chunk)]

    def _chunk(self, chunk: str) -> bytes:
        got = self.older_chunks.get(chunk)
        if got is None:
            words = self.words
            got = NONE.join([words.get(p) or self._word(p) for p in self._pieces(chunk)])
        if len(self.chunks) >= self.remember:
            self.chunks, self.older_chunks = {}, self.chunks
        if len(chunk) <= 50:
            self.chunks[chunk] = got
        return got

    def _plain(self, text: str) -> bytes:
        odd = any(c in text for c in "\x1c\x1d\x1e\x1f")
        known, out = self.chunks, []
        for chunk in self.spaces.split(text) if odd else text.split():
            got = known.get(chunk)
            if got is None:
                got = self._chunk(chunk)
                known = self.chunks
            out.append(got)
        return NONE.join(out)

    def ids(self, text: str | None) -> bytes:
        """The ids of a text, four bytes each."""
        if not text:
            return NONE
        if self.specials is None or not any(t in text for t in self.special):
            return self._plain(text)
        return NONE.join([self._plain(part) if part not in self.special else array("i", [self.special[part]]).tobytes() for part in self.specials.split(text)])

    def encode(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.ids(text), np.int32)

    def decode(self, ids) -> str:
        known, n = self.text, len(self.text)
        return " ".join([known[i] for i in ids if 0 <= i < n and known[i] is not None])


def encoder(source: str) -> Encoder:
    """One encoder per worker and vocabulary."""
    return store.held(hashlib.sha256(source.encode()).hexdigest(), lambda: Encoder(source))


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _mapped(docs: DataFrame, path: str | None, ddl: str, make):
    """``make(encoder, texts)`` gives the columns after doc_id, by slices of each batch."""
    source = docs.sparkSession.sparkContext.broadcast(Path(path or default_path()).read_text())  # the size of one vocabulary file
    names = [x.split()[0] for x in ddl.split(", ")]

    def run(batches):
        e = encoder(source.value)
        for b in batches:
            for start, end in store.slices(b.column(1)):
                part = b.slice(start, end - start)
                yield pa.RecordBatch.from_arrays([part.column(0), *make(e, part.column(1).to_pylist())], names=names)

    return store.in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), run, ddl)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and ids (array<int>) of every text."""

    def make(e: Encoder, texts):
        got = [e.ids(t) for t in texts]
        ends = np.concatenate(([0], np.cumsum([len(x) // 4 for x in got]))).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(NONE.join(got), np.int32)))]

    return _mapped(docs, path, "doc_id long, ids array<int>", make)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id and text of rows (doc_id, ids); ids outside the vocabulary are left out, null ids give a null text."""
    source = encoded.sparkSession.sparkContext.broadcast(Path(path or default_path()).read_text())

    def run(batches):
        e = encoder(source.value)
        for b in batches:
            for at in range(0, b.num_rows, 1000):
                part = b.slice(at, 1000)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([None if x is None else e.decode(x) for x in part.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    return store.in_arrow(encoded.select("doc_id", "ids"), run, "doc_id long, text string")


def digest(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids and of the decoded text."""
    hashed = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def make(e: Encoder, texts):
        n, ids, back = [], [], []
        for t in texts:
            x = e.encode(t).tolist()
            n.append(len(x))
            ids.append(hashed(" ".join([e.number[i] for i in x])))
            back.append(hashed(e.decode(x)))
        return [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]

    return _mapped(docs, path, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string", make)

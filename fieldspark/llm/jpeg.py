"""A baseline JPEG decoder for motion-JPEG frames that ``media`` didn't write itself."""

from __future__ import annotations

import numpy as np

#: The order of coefficients in a block, and the default Huffman tables that motion-JPEG frames may leave out.
ZIGZAG = [0, 1, 8, 16, 9, 2, 3, 10, 17, 24, 32, 25, 18, 11, 4, 5, 12, 19, 26, 33, 40, 48, 41, 34, 27, 20, 13, 6, 7, 14, 21, 28, 35, 42, 49, 56, 57, 50, 43, 36, 29, 22, 15, 23, 30, 37, 44, 51, 58, 59, 52, 45, 38, 31, 39, 46, 53, 60, 61, 54, 47, 55, 62, 63]
DC_LUMA = ([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12)))
DC_CHROMA = ([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0], list(range(12)))
AC_LUMA = ([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125], bytes.fromhex(
    "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"
))
AC_CHROMA = ([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119], bytes.fromhex(
    "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"
))
_k = np.arange(8)
COSINE = np.where(_k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)


def _table(lengths, symbols) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol, codes given in order of length."""
    out, code, at = {}, 0, 0
    for n, count in enumerate(lengths, 1):
        for _ in range(count):
            out[n, code] = symbols[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def bit(self) -> int:
        if not self.n:
            self.held = self.data[self.at] if self.at < len(self.data) else 0
            self.at, self.n = self.at + 1, 8
        self.n -= 1
        return self.held >> self.n & 1

    def bits(self, count: int) -> int:
        v = 0
        for _ in range(count):
            v = v << 1 | self.bit()
        return v

    def symbol(self, table) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bit()
            got = table.get((n, code))
            if got is not None:
                return got
        raise ValueError("bad Huffman code")

    def signed(self, size: int) -> int:
        v = self.bits(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def decode(frame: bytes) -> list[np.ndarray]:
    """The planes of a baseline sequential JPEG, each at its own resolution."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    quant, huff = {}, {(0, 0): _table(*DC_LUMA), (0, 1): _table(*DC_CHROMA), (1, 0): _table(*AC_LUMA), (1, 1): _table(*AC_CHROMA)}
    at, parts, restart = 2, [], 0
    while True:
        marker, size = frame[at + 1], int.from_bytes(frame[at + 2 : at + 4], "big")
        body = frame[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xDB:
            while body:
                wide, k = body[0] >> 4, body[0] & 15
                n = 64 * (1 + wide)
                quant[k] = np.frombuffer(body[1 : 1 + n], ">u2" if wide else np.uint8).astype(float)
                body = body[1 + n :]
        elif marker == 0xC4:
            while body:
                lengths = list(body[1:17])
                huff[body[0] >> 4, body[0] & 15] = _table(lengths, body[17 : 17 + sum(lengths)])
                body = body[17 + sum(lengths) :]
        elif marker == 0xC0:
            height, width = int.from_bytes(body[1:3], "big"), int.from_bytes(body[3:5], "big")
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
        elif marker in (0xC1, 0xC2, 0xC3) or 0xC5 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames")
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker == 0xDA:
            for i in range(body[0]):
                for p in parts:
                    if p["id"] == body[1 + 2 * i]:
                        p["dc"], p["ac"] = body[2 + 2 * i] >> 4, body[2 + 2 * i] & 15
            break
    # Entropy-coded data: cut at restart markers, stuffed zeros left out.
    runs, begin, k = [], at, at
    while True:
        k = frame.find(b"\xff", k)
        if k < 0 or k + 1 >= len(frame):
            runs.append(frame[begin:])
            break
        if frame[k + 1] == 0:
            k += 2
        elif 0xD0 <= frame[k + 1] <= 0xD7:
            runs.append(frame[begin:k])
            begin = k = k + 2
        else:
            runs.append(frame[begin:k])
            break
    hm, vm = max(p["h"] for p in parts), max(p["v"] for p in parts)
    if len(parts) == 1:
        parts[0]["h"] = parts[0]["v"] = hm = vm = 1
    across, down = -(-width // (8 * hm)), -(-height // (8 * vm))
    for p in parts:
        p["blocks"] = np.zeros((down * p["v"], across * p["h"], 64))
    n, todo = 0, iter(runs)
    bits = None
    for n in range(across * down):
        if bits is None or restart and n % restart == 0:
            bits = _Bits(next(todo).replace(b"\xff\x00", b"\xff"))
            for p in parts:
                p["last"] = 0
        my, mx = divmod(n, across)
        for p in parts:
            for y in range(p["v"]):
                for x in range(p["h"]):
                    block = p["blocks"][my * p["v"] + y, mx * p["h"] + x]
                    p["last"] += bits.signed(bits.symbol(huff[0, p["dc"]]))
                    block[0] = p["last"]
                    i = 1
                    while i < 64:
                        s = bits.symbol(huff[1, p["ac"]])
                        if s == 0:
                            break
                        i += s >> 4
                        if s & 15 and i < 64:
                            block[ZIGZAG[i]] = bits.signed(s & 15)
                        i += 1
    out = []
    for p in parts:
        q = np.zeros(64)
        q[ZIGZAG] = quant[p["q"]]
        c = (p["blocks"] * q).reshape(*p["blocks"].shape[:2], 8, 8)
        pixels = COSINE.T @ c @ COSINE + 128
        plane = pixels.transpose(0, 2, 1, 3).reshape(c.shape[0] * 8, c.shape[1] * 8)
        h, w = -(-height * p["v"] // vm), -(-width * p["h"] // hm)
        out.append(np.clip(np.rint(plane), 0, 255).astype(np.uint8)[:h, :w])
    return out


def block_means(frames: list[bytes]) -> np.ndarray:
    """Means of the 8x8 blocks of the first plane, a row a frame; frames have one size."""
    rows = []
    for f in frames:
        y = decode(f)[0]
        y = np.pad(y, [(0, -y.shape[0] % 8), (0, -y.shape[1] % 8)], mode="edge").astype(float)
        rows.append(np.rint(y.reshape(y.shape[0] // 8, 8, -1, 8).mean(axis=(1, 3))).astype(np.uint8).ravel())
    return np.stack(rows) if rows else np.zeros((0, 0), np.uint8)

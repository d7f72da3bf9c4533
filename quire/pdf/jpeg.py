"""Baseline JPEG images: Huffman-coded, eight bits, one scan."""

from __future__ import annotations

import numpy as np

from .objects import PdfError


def zigzag() -> np.ndarray:
    """Row and column of each coefficient in the order in which they are coded: along rising and falling diagonals by turns."""
    order = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda p: (p[0] + p[1], p[0] if (p[0] + p[1]) % 2 else p[1]))
    return np.array([r * 8 + c for r, c in order])


ZIGZAG = zigzag()
COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(0.125) if u == 0 else 0.5) for u in range(8)] for x in range(8)])


def _codes(counts: bytes, values: bytes) -> dict[tuple[int, int], int]:
    out, code, k = {}, 0, 0
    for n, many in enumerate(counts, 1):
        for _ in range(many):
            out[n, code] = values[k]
            code, k = code + 1, k + 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def bit(self) -> int:
        if not self.n:
            if self.at >= len(self.data):
                raise PdfError("bad-jpeg", "too little data")
            c = self.data[self.at]
            self.at += 1
            if c == 0xFF:
                if self.data[self.at : self.at + 1] != b"\0":
                    raise PdfError("bad-jpeg", "marker in data")
                self.at += 1
            self.held, self.n = c, 8
        self.n -= 1
        return self.held >> self.n & 1

    def number(self, n: int) -> int:
        v = 0
        for _ in range(n):
            v = v << 1 | self.bit()
        return v - (1 << n) + 1 if n and v < 1 << (n - 1) else v

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.bit()
            if (n, code) in codes:
                return codes[n, code]
        raise PdfError("bad-jpeg", "code")

    def restart(self) -> None:
        self.n = 0
        if self.data[self.at : self.at + 1] == b"\xff" and 0xD0 <= self.data[self.at + 1] <= 0xD7:
            self.at += 2


def decode_jpeg(data: bytes) -> dict:
    """width, height and samples (height, width, components), as they are coded, without colour conversion."""
    if data[:2] != b"\xff\xd8":
        raise PdfError("bad-jpeg", "signature")
    at, quant, huff, frame, every = 2, {}, {}, None, 0
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise PdfError("bad-jpeg", "no scan")
        kind, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        part = data[at + 4 : at + 2 + n]
        at += 2 + n
        if kind == 0xDB:
            while part:
                wide, k = part[0] >> 4, part[0] & 15
                size = 128 if wide else 64
                quant[k] = np.frombuffer(part[1 : 1 + size], ">u2" if wide else np.uint8).astype(float)
                part = part[1 + size :]
        elif kind == 0xC4:
            while part:
                many = sum(part[1:17])
                huff[part[0]] = _codes(part[1:17], part[17 : 17 + many])
                part = part[17 + many :]
        elif kind in (0xC0, 0xC1):
            if part[0] != 8:
                raise PdfError("unsupported-feature", "jpeg depth")
            h, w = int.from_bytes(part[1:3], "big"), int.from_bytes(part[3:5], "big")
            frame = [(part[6 + 3 * k], part[7 + 3 * k] >> 4, part[7 + 3 * k] & 15, part[8 + 3 * k]) for k in range(part[5])]
        elif 0xC2 <= kind <= 0xCF and kind != 0xC8 and kind != 0xCC:
            raise PdfError("unsupported-feature", "jpeg coding")
        elif kind == 0xDD:
            every = int.from_bytes(part[:2], "big")
        elif kind == 0xDA:
            break
    if not frame or part[0] != len(frame):
        raise PdfError("unsupported-feature", "jpeg scans")
    use = {part[1 + 2 * k]: (part[2 + 2 * k] >> 4, part[2 + 2 * k] & 15) for k in range(part[0])}
    hm, vm = max(f[1] for f in frame), max(f[2] for f in frame)
    if len(frame) == 1:
        frame = [(frame[0][0], 1, 1, frame[0][3])]
        hm = vm = 1
    across, down = -(-w // (8 * hm)), -(-h // (8 * vm))
    planes = [np.zeros((down * f[2] * 8, across * f[1] * 8)) for f in frame]
    bits, before = _Bits(data[at:]), [0] * len(frame)
    for mcu in range(across * down):
        if every and mcu and mcu % every == 0:
            bits.restart()
            before = [0] * len(frame)
        y0, x0 = divmod(mcu, across)
        for c, (name, fh, fv, q) in enumerate(frame):
            dc, ac = use[name]
            for v in range(fv):
                for u in range(fh):
                    block = np.zeros(64)
                    before[c] += bits.number(bits.symbol(huff[dc]))
                    block[0] = before[c]
                    k = 1
                    while k < 64:
                        s = bits.symbol(huff[16 | ac])
                        if s == 0:
                            break
                        k += s >> 4
                        if k > 63:
                            raise PdfError("bad-jpeg", "coefficients")
                        if s & 15:
                            block[k] = bits.number(s & 15)
                        k += 1
                    grid = np.zeros(64)
                    grid[ZIGZAG] = block * quant[q]
                    y, x = (y0 * fv + v) * 8, (x0 * fh + u) * 8
                    planes[c][y : y + 8, x : x + 8] = COSINES @ grid.reshape(8, 8) @ COSINES.T
    out = [np.repeat(np.repeat(p, vm // f[2], 0), hm // f[1], 1)[:h, :w] for p, f in zip(planes, frame, strict=True)]
    return {"width": w, "height": h, "pixels": np.clip(np.floor(np.dstack(out) + 128.5), 0, 255).astype(np.uint8)}

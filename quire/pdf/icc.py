"""Colour profiles at work: matrix and table profiles evaluated for many colours at a time."""

from __future__ import annotations

import struct
from itertools import product

import numpy as np

from .images import icc_curve, icc_header, icc_parametric, icc_xyz
from .objects import PdfError

#: The connection space's white.
D50 = np.array([0.9642, 1.0, 0.8249])
INTENTS = {"perceptual": 0, "relative": 1, "saturation": 2, "absolute": 1}


def lab(xyz: np.ndarray) -> np.ndarray:
    t = xyz / D50
    f = np.where(t > 216 / 24389, np.cbrt(t), (t * 24389 / 27 + 16) / 116)
    return np.stack([116 * f[:, 1] - 16, 500 * (f[:, 0] - f[:, 1]), 200 * (f[:, 1] - f[:, 2])], 1)


def xyz(lab_: np.ndarray) -> np.ndarray:
    fy = (lab_[:, 0] + 16) / 116
    f = np.stack([fy + lab_[:, 1] / 500, fy, fy - lab_[:, 2] / 200], 1)
    return np.where(f**3 > 216 / 24389, f**3, (116 * f - 16) * 27 / 24389) * D50


def multilinear(grid: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Values between the points of a table (n, ..., n, outputs) at x in 0 to 1; the last input varies fastest."""
    n = grid.shape[:-1]
    place = np.clip(x, 0, 1) * (np.array(n) - 1)
    low = np.minimum(place.astype(int), np.maximum(np.array(n) - 2, 0))
    part = place - low
    out = np.zeros((len(x), grid.shape[-1]))
    for corner in product((0, 1), repeat=len(n)):
        at = tuple(np.minimum(low[:, k] + c, n[k] - 1) for k, c in enumerate(corner))
        weight = np.prod([part[:, k] if c else 1 - part[:, k] for k, c in enumerate(corner)], 0)
        out += weight[:, None] * grid[at]
    return out


def tetrahedral(grid: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The same for three inputs, by the tetrahedron that holds the point."""
    n = np.array(grid.shape[:3])
    place = np.clip(x, 0, 1) * (n - 1)
    low = np.minimum(place.astype(int), np.maximum(n - 2, 0))
    part = place - low
    order = np.argsort(-part, 1, kind="stable")
    ranked = np.take_along_axis(part, order, 1)
    at = low.copy()
    value = grid[tuple(at.T)]
    out = value * (1 - ranked[:, :1])
    for k in range(3):
        at[np.arange(len(x)), order[:, k]] = np.minimum(at[np.arange(len(x)), order[:, k]] + 1, n[order[:, k]] - 1)
        after = ranked[:, k + 1] if k < 2 else 0
        out += grid[tuple(at.T)] * np.reshape(ranked[:, k] - after, (-1, 1))
    return out


class Table:
    """A table tag of 8 or 16 bits: input curves, grid, output curves."""

    def __init__(self, tag: bytes):
        kind = tag[:4]
        if kind not in (b"mft1", b"mft2"):
            raise PdfError("invalid-profile", f"table {kind!r}")
        self.inputs, self.outputs, n = tag[8], tag[9], tag[10]
        self.wide = kind == b"mft2"
        at, steps_in, steps_out = 48, 256, 256
        if self.wide:
            steps_in, steps_out = struct.unpack(">HH", tag[48:52])
            at = 52
        kind_ = np.dtype(">u2") if self.wide else np.dtype(np.uint8)
        top = 65535.0 if self.wide else 255.0

        def take(count: int) -> np.ndarray:
            nonlocal at
            if at + count * kind_.itemsize > len(tag):
                raise PdfError("invalid-profile", "short table")
            out = np.frombuffer(tag, kind_, count, at) / top
            at += count * kind_.itemsize
            return out

        self.curves_in = take(self.inputs * steps_in).reshape(self.inputs, steps_in)
        self.grid = take(n**self.inputs * self.outputs).reshape(*[n] * self.inputs, self.outputs)
        self.curves_out = take(self.outputs * steps_out).reshape(self.outputs, steps_out)

    def run(self, x: np.ndarray, by_tetrahedra: bool) -> np.ndarray:
        curve = lambda c, v: np.interp(np.clip(v, 0, 1), np.linspace(0, 1, len(c)), c)
        x = np.stack([curve(self.curves_in[k], x[:, k]) for k in range(self.inputs)], 1)
        y = tetrahedral(self.grid, x) if by_tetrahedra and self.inputs == 3 else multilinear(self.grid, x)
        return np.stack([curve(self.curves_out[k], y[:, k]) for k in range(self.outputs)], 1)


class MultiTable:
    """A table tag of several dimensions: curves, a grid, curves, a matrix and curves again, each of which may be missing."""

    wide = False

    def __init__(self, tag: bytes):
        self.forward = tag[:4] == b"mAB "
        self.inputs, self.outputs = tag[8], tag[9]
        b, matrix, m, grid, a = struct.unpack(">5I", tag[12:32])
        side = self.outputs if self.forward else self.inputs  # of the connection space
        device = self.inputs if self.forward else self.outputs
        self.b, self.m, self.a = (self._curves(tag, at, n) if at else None for at, n in ((b, side), (m, side), (a, device)))
        self.matrix = None
        if matrix:
            v = np.array(struct.unpack(">12i", tag[matrix : matrix + 48])) / 65536
            self.matrix = v[:9].reshape(3, 3), v[9:]
        self.grid = None
        if grid:
            n = list(tag[grid : grid + self.inputs])
            kind = np.dtype(np.uint8) if tag[grid + 16] == 1 else np.dtype(">u2")
            count = int(np.prod(n)) * self.outputs
            if not all(n) or grid + 20 + count * kind.itemsize > len(tag):
                raise PdfError("invalid-profile", "short table")
            self.grid = (np.frombuffer(tag, kind, count, grid + 20) / (255.0 if kind.itemsize == 1 else 65535.0)).reshape(*n, self.outputs)

    @staticmethod
    def _curves(tag: bytes, at: int, n: int) -> list[bytes]:
        out = []
        for _ in range(n):
            if tag[at : at + 4] == b"curv":
                size = 12 + 2 * int.from_bytes(tag[at + 8 : at + 12], "big")
            elif tag[at : at + 4] == b"para":
                size = 12 + 4 * (1, 3, 4, 5, 7)[min(4, int.from_bytes(tag[at + 8 : at + 10], "big"))]
            else:
                raise PdfError("invalid-profile", "curve")
            out.append(tag[at : at + size])
            at += -(-size // 4) * 4
        return out

    def run(self, x: np.ndarray, by_tetrahedra: bool) -> np.ndarray:
        curves = lambda c, v: v if c is None else np.stack([_curve(t, np.clip(v[:, k], 0, 1)) for k, t in enumerate(c)], 1)
        look = lambda v: v if self.grid is None else tetrahedral(self.grid, v) if by_tetrahedra and self.inputs == 3 else multilinear(self.grid, v)
        turn = lambda v: v if self.matrix is None else np.clip(v @ self.matrix[0].T + self.matrix[1], 0, 1)
        if self.forward:
            return curves(self.b, turn(curves(self.m, look(curves(self.a, x)))))
        return curves(self.a, look(curves(self.m, turn(curves(self.b, x)))))


def written(space: bytes, pcs: bytes, tags: list[tuple[bytes, bytes]], kind: bytes = b"prtr", version: int = 4) -> bytes:
    """A profile of the given tags."""
    head = bytearray(128)
    head[8], head[36:40], head[12:16], head[16:20], head[20:24] = version, b"acsp", kind, space, pcs
    at, index, body = 132 + 12 * len(tags), struct.pack(">I", len(tags)), b""
    for name, data in tags:
        data += bytes(-len(data) % 4)
        index += struct.pack(">4sII", name, at + len(body), len(data))
        body += data
    return bytes(head) + index + body


def srgb() -> bytes:
    """The profile of colours on a screen, by the standard's primaries, adapted to the connection space, and its curve."""
    tag = lambda *v: b"XYZ \0\0\0\0" + struct.pack(">3i", *[round(x * 65536) for x in v])
    curve = b"para\0\0\0\0" + struct.pack(">HH5i", 3, 0, *[round(x * 65536) for x in (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045)])
    columns = ((0.4360747, 0.2225045, 0.0139322), (0.3850649, 0.7168786, 0.0971045), (0.1430804, 0.0606169, 0.7141733))
    tags = [(c + b"XYZ", tag(*v)) for c, v in zip((b"r", b"g", b"b"), columns, strict=True)]
    return written(b"RGB ", b"XYZ ", [*tags, *[(c + b"TRC", curve) for c in (b"r", b"g", b"b")], (b"wtpt", tag(*D50))], b"mntr")


class Profile:
    """Device colours (0 to 1) to Lab and, with tables for it, back."""

    def __init__(self, data: bytes):
        self.head = icc_header(data)
        self.tags = self.head["tags"]

    def _table(self, name: str, intent: str) -> Table | MultiTable | None:
        tag = self.tags.get(f"{name}{INTENTS[intent]}") or self.tags.get(f"{name}0")
        return (MultiTable if tag[:4] in (b"mAB ", b"mBA ") else Table)(tag) if tag else None

    def white(self) -> np.ndarray:
        """What the medium's white is to the connection space's."""
        return np.array(icc_xyz(self.tags["wtpt"])) / D50 if "wtpt" in self.tags else np.ones(3)

    def to_lab(self, x: np.ndarray, intent: str = "relative") -> np.ndarray:
        """Absolute colours are those relative to the medium's white, scaled to it."""
        v = self._to_lab(x, intent)
        return lab(xyz(v) * self.white()) if intent == "absolute" else v

    def _to_lab(self, x: np.ndarray, intent: str) -> np.ndarray:
        if t := self._table("A2B", intent):
            y = t.run(x, True)
            if self.head["pcs"] == "XYZ":
                return lab(y * (1 + 32767 / 32768))
            scale = 65280 / 65535 if t.wide else 1
            return np.stack([y[:, 0] / scale * 100, y[:, 1] / scale * 255 - 128, y[:, 2] / scale * 255 - 128], 1)
        if self.head["space"] == "RGB" and "rXYZ" in self.tags:
            m = np.array([icc_xyz(self.tags[f"{c}XYZ"]) for c in "rgb"])
            linear = np.stack([_curve(self.tags[f"{c}TRC"], x[:, k]) for k, c in enumerate("rgb")], 1)
            return lab(linear @ m)
        if self.head["space"] == "GRAY" and "kTRC" in self.tags:
            return lab(_curve(self.tags["kTRC"], x[:, 0])[:, None] * D50)
        raise PdfError("invalid-profile", "no way to the connection space")

    def from_lab(self, v: np.ndarray, intent: str = "relative") -> np.ndarray:
        t = self._table("B2A", intent)
        if t is None:
            raise PdfError("invalid-profile", "no way from the connection space")
        if intent == "absolute":
            v = lab(xyz(v) / self.white())
        if self.head["pcs"] == "XYZ":
            return np.clip(t.run(xyz(v) / (1 + 32767 / 32768), False), 0, 1)
        scale = 65280 / 65535 if t.wide else 1
        x = np.stack([v[:, 0] / 100, (v[:, 1] + 128) / 255, (v[:, 2] + 128) / 255], 1) * scale
        return np.clip(t.run(x, False), 0, 1)


def _curve(tag: bytes, x: np.ndarray) -> np.ndarray:
    if tag[:4] == b"para":
        return parametric(*icc_parametric(tag), x)
    table, gamma = icc_curve(tag)
    return np.interp(x, np.linspace(0, 1, len(table)), table) if table else np.power(x, gamma) if gamma else x


def parametric(kind: int, p: list[float], x: np.ndarray) -> np.ndarray:
    """The five parametric forms: a power above a break, a line or a constant below it."""
    g, a, b, c, d, e, f = [*p, *([1.0, 0.0, 0.0, 0.0, 0.0, 0.0][len(p) - 1 :])]
    power = np.power(np.maximum(a * x + b, 0), g)
    if kind == 0:
        return np.power(x, g)
    if kind in (1, 2):
        low = c if kind == 2 else 0.0
        return np.where(x >= (-b / a if a else 0), power + low, low)
    return np.where(x >= d, power + (e if kind == 4 else 0), c * x + (f if kind == 4 else 0))


def inverse(table: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Where a sampled curve has the values: it is taken as rising (a falling one is turned), and of a plateau the middle counts, at its ends the inner end."""
    t = np.asarray(table, float)
    turned = t[0] > t[-1]
    t = np.maximum.accumulate(t[::-1] if turned else t)
    place = np.linspace(0, 1, len(t))
    y = np.clip(y, t[0], t[-1])
    first, last = np.searchsorted(t, y, "left"), np.searchsorted(t, y, "right") - 1
    lo = np.clip(first - 1, 0, len(t) - 1)
    hi = np.clip(first, 0, len(t) - 1)
    gap = np.where(t[hi] > t[lo], t[hi] - t[lo], 1.0)
    x = place[lo] + (place[hi] - place[lo]) * np.clip((y - t[lo]) / gap, 0, 1)
    flat = last > first
    x = np.where(flat, np.where(first == 0, place[np.maximum(last, 0)], np.where(last == len(t) - 1, place[hi], (place[hi] + place[np.maximum(last, 0)]) / 2)), x)
    return 1 - x if turned else x


def black_point(p: Profile, intent: str) -> float:
    """The luminance of the darkest neutral that a profile reproduces."""
    if p.head["space"] == "RGB":
        dark = p.to_lab(np.zeros((1, 3)), intent)
    elif p._table("B2A", intent) and p._table("A2B", intent):
        dark = p.to_lab(p.from_lab(np.zeros((1, 3)), intent), intent)  # what black comes to in ink and back
    else:
        return 0.0
    return float(xyz(np.array([[np.clip(dark[0, 0], 0, 50), 0.0, 0.0]]))[0, 1])


def transform(source: Profile, target: Profile, intent: str = "relative", compensate: bool = False):
    """A function of device colours (rows, 0 to 1). Paper white stays free of ink but for the absolute intent.

    compensate: the source's black is brought to the target's by a straight line in XYZ that leaves white in place.
    """
    low, high = (black_point(source, intent), black_point(target, intent)) if compensate and intent != "absolute" else (0.0, 0.0)
    scale = (1 - high) / (1 - low)

    def run(x: np.ndarray) -> np.ndarray:
        v = source.to_lab(x, intent)
        if low != high:
            v = lab(xyz(v) * scale + (1 - scale) * D50)
        out = target.from_lab(v, intent)
        if intent != "absolute" and source.head["space"] == "RGB" and target.head["space"] == "CMYK":
            out[(x == 1).all(1)] = 0
        return out

    return run


def convert_rows(pixels: np.ndarray, f) -> np.ndarray:
    """Samples (rows, width, channels) of 8 or 16 bits through a transform. Each distinct colour is converted once."""
    top = 65535 if pixels.dtype == np.uint16 else 255
    flat = pixels.reshape(-1, pixels.shape[-1])
    colours, place = np.unique(flat, axis=0, return_inverse=True)
    out = np.floor(np.clip(f(colours / top), 0, 1) * top + 0.5).astype(pixels.dtype)
    return out[place.ravel()].reshape(*pixels.shape[:-1], out.shape[-1])

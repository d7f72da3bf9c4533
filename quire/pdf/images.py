"""Raster images and colour profiles: PNG pixels, JPEG and ICC headers."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np

from .filters import unpredict
from .objects import PdfError

CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def decode_png(data: bytes) -> dict:
    """width, height, depth, color and pixels: an array (height, width, channels) of samples, interlaced or not."""
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise PdfError("bad-png", "signature")
    at, body, out = 8, bytearray(), {}
    while at + 12 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + chunk) != int.from_bytes(data[at + 8 + n : at + 12 + n], "big"):
            raise PdfError("bad-png", f"checksum of {kind.decode('latin-1')}")
        at += 12 + n
        if kind == b"IHDR":
            w, h, depth, color, _, _, lace = struct.unpack(">IIBBBBB", chunk)
            out = {"width": w, "height": h, "depth": depth, "color": color, "interlaced": bool(lace)}
        elif kind == b"PLTE":
            out["palette"] = np.frombuffer(chunk, np.uint8).reshape(-1, 3)
        elif kind == b"tRNS":
            out["transparent"] = chunk
        elif kind == b"IDAT":
            body += chunk
        elif kind == b"IEND":
            break
    if "width" not in out or out["color"] not in CHANNELS:
        raise PdfError("bad-png", "header")
    raw, c = zlib.decompress(bytes(body)), CHANNELS[out["color"]]
    grids = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if out["interlaced"] else [(0, 0, 1, 1)]
    pixels = np.zeros((h, w, c), np.uint16 if depth == 16 else np.uint8)
    k = 0
    for x, y, dx, dy in grids:
        gw, gh = -(-(w - x) // dx), -(-(h - y) // dy)
        if gw <= 0 or gh <= 0:
            continue
        row = (gw * c * depth + 7) // 8
        part = unpredict(raw[k : k + gh * (row + 1)], {b"Predictor": 15, b"Colors": c, b"BitsPerComponent": depth, b"Columns": gw})
        k += gh * (row + 1)
        if len(part) < gh * row:
            raise PdfError("bad-png", "too few rows")
        rows = np.frombuffer(part, np.uint8).reshape(gh, row)
        if depth == 16:
            rows = rows.view(">u2")
        elif depth < 8:
            bits = np.unpackbits(rows, axis=1)[:, : gw * c * depth].reshape(gh, gw * c, depth)
            rows = (bits * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
        pixels[y::dy, x::dx] = rows[:, : gw * c].reshape(gh, gw, c)
    return out | {"pixels": pixels}


def to_rgba(png: dict) -> np.ndarray:
    """Eight bits a sample, red, green, blue and opacity."""
    p, color, depth = png["pixels"], png["color"], png["depth"]
    t = png.get("transparent")
    if color == 3:
        rgb = png["palette"][np.minimum(p[:, :, 0], len(png["palette"]) - 1)]
        a = np.full(256, 255, np.uint8)
        if t:
            a[: len(t)] = np.frombuffer(t, np.uint8)
        return np.dstack([rgb, a[p[:, :, 0]]])
    top = (1 << depth) - 1
    eight = lambda x: np.floor(x.astype(np.float64) * 255 / top + 0.5).astype(np.uint8)
    alpha = eight(p[:, :, -1]) if color in (4, 6) else np.full(p.shape[:2], 255, np.uint8)
    if t and color in (0, 2):
        key = np.frombuffer(t, ">u2")
        alpha = np.where((p == key).all(2), 0, 255).astype(np.uint8)
    rgb = eight(p[:, :, :3] if color in (2, 6) else np.repeat(p[:, :, :1], 3, 2))
    return np.dstack([rgb, alpha])


def jpeg_header(data: bytes) -> dict:
    """width, height, components, depth, coding, the colour profile's bytes and the orientation."""
    if data[:2] != b"\xff\xd8":
        raise PdfError("bad-jpeg", "signature")
    at, out, profile = 2, {"orientation": 1}, {}
    while at + 4 <= len(data) and data[at] == 0xFF:
        kind = data[at + 1]
        if kind in (0xD8, 0x01, 0xFF) or 0xD0 <= kind <= 0xD7:
            at += 1 if kind == 0xFF else 2
            continue
        n = int.from_bytes(data[at + 2 : at + 4], "big")
        part = data[at + 4 : at + 2 + n]
        if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
            out |= {"depth": part[0], "height": int.from_bytes(part[1:3], "big"), "width": int.from_bytes(part[3:5], "big"), "components": part[5], "coding": {0: "baseline", 1: "extended", 2: "progressive"}.get(kind & 15, "other")}
        elif kind == 0xE2 and part[:12] == b"ICC_PROFILE\0":
            profile[part[12]] = part[14:]
        elif kind == 0xE1 and part[:6] == b"Exif\0\0":
            t = part[6:]
            order = "little" if t[:2] == b"II" else "big"
            first = int.from_bytes(t[4:8], order)
            for k in range(int.from_bytes(t[first : first + 2], order)):
                e = t[first + 2 + 12 * k : first + 14 + 12 * k]
                if int.from_bytes(e[:2], order) == 0x112:
                    out["orientation"] = int.from_bytes(e[8:10], order)
        elif kind == 0xDA:
            break
        at += 2 + n
    if "width" not in out:
        raise PdfError("bad-jpeg", "no frame")
    return out | {"profile": b"".join(profile[k] for k in sorted(profile)) or None}


def icc_header(data: bytes) -> dict:
    """Version, class, spaces and tags of a colour profile."""
    if len(data) < 132 or data[36:40] != b"acsp":
        raise PdfError("invalid-profile", "signature")
    word = lambda k: data[k : k + 4].decode("latin-1").strip()
    tags = {}
    for k in range(min(int.from_bytes(data[128:132], "big"), 200)):
        name, offset, size = struct.unpack(">4sII", data[132 + 12 * k : 144 + 12 * k])
        if offset + size > len(data):
            raise PdfError("invalid-profile", "tag outside of the file")
        tags[name.decode("latin-1")] = data[offset : offset + size]
    return {"version": f"{data[8]}.{data[9] >> 4}", "class": word(12), "space": word(16), "pcs": word(20), "intent": int.from_bytes(data[64:68], "big"), "tags": tags}


def icc_curve(tag: bytes) -> tuple[list[float] | None, float | None]:
    """(table, gamma) of a curve tag; neither for the identity."""
    n = int.from_bytes(tag[8:12], "big")
    if tag[:4] != b"curv":
        raise PdfError("invalid-profile", "curve")
    if n == 0:
        return None, None
    v = struct.unpack(f">{n}H", tag[12 : 12 + 2 * n])
    return (None, v[0] / 256) if n == 1 else ([x / 65535 for x in v], None)


def icc_parametric(tag: bytes) -> tuple[int, list[float]]:
    """Kind and parameters g, a, b, c, d, e, f of a parametric curve tag."""
    kind = int.from_bytes(tag[8:10], "big")
    if tag[:4] != b"para" or kind > 4:
        raise PdfError("invalid-profile", "parametric curve")
    n = (1, 3, 4, 5, 7)[kind]
    return kind, [x / 65536 for x in struct.unpack(f">{n}i", tag[12 : 12 + 4 * n])]


def icc_identity(data: bytes) -> str:
    """A digest by which copies of a profile are one: its flags, intent and stored identifier don't count."""
    head = bytearray(data[:128])
    for a, b in ((44, 48), (64, 68), (84, 100)):
        head[a:b] = bytes(b - a)
    return hashlib.md5(bytes(head) + data[128:]).hexdigest()


def jpx_colour(data: bytes) -> dict:
    """What a JPEG 2000 file says of its colour: components, and an enumerated space or the bytes of a profile."""
    out: dict = {"components": None, "space": None, "profile": None}
    if data[:4] == b"\xff\x4f\xff\x51":  # a bare code stream
        return out | {"components": int.from_bytes(data[40:42], "big")}
    if data[4:8] != b"jP  ":
        raise PdfError("bad-jpx", "signature")

    def boxes(at: int, end: int, depth: int) -> None:
        while at + 8 <= end:
            size, kind, skip = int.from_bytes(data[at : at + 4], "big"), data[at + 4 : at + 8], 8
            if size == 1:
                size, skip = int.from_bytes(data[at + 8 : at + 16], "big"), 16
            size = size or end - at
            if size < skip or at + size > end:
                raise PdfError("bad-jpx", "box")
            body = at + skip
            if kind == b"jp2h" and depth < 2:
                boxes(body, at + size, depth + 1)
            elif kind == b"ihdr":
                out["components"] = int.from_bytes(data[body + 8 : body + 10], "big")
            elif kind == b"colr" and out["space"] is None and out["profile"] is None:
                if data[body] == 1:
                    number = int.from_bytes(data[body + 3 : body + 7], "big")
                    out["space"] = {12: "CMYK", 14: "Lab", 16: "sRGB", 17: "grey", 18: "sYCC"}.get(number, str(number))
                elif data[body] == 2:
                    out["profile"] = data[body + 3 : at + size]
            at += size

    boxes(0, len(data), 0)
    return out


def icc_xyz(tag: bytes) -> tuple[float, float, float]:
    return tuple(x / 65536 for x in struct.unpack(">3i", tag[8:20]))

"""TrueType programs: table directory, characters to glyphs, and glyph boxes."""

from __future__ import annotations

import struct

from .objects import PdfError


def tables(data: bytes) -> dict[str, bytes]:
    if len(data) < 12 or data[:4] not in (b"\0\1\0\0", b"true", b"OTTO"):
        raise PdfError("bad-font", "directory")
    out = {}
    for k in range(struct.unpack(">H", data[4:6])[0]):
        tag, _, offset, size = struct.unpack(">4sIII", data[12 + 16 * k : 28 + 16 * k])
        if offset + size <= len(data):
            out[tag.decode("latin-1")] = data[offset : offset + size]
    return out


def character_map(cmap: bytes) -> tuple[dict[int, int], dict[tuple[int, int], int | None]]:
    """Characters to glyphs, from the widest Unicode subtable; and (character, selector) to glyphs, None for the default one."""
    best, plain, variants = -1, {}, {}
    rank = {(3, 10): 3, (0, 4): 2, (0, 6): 2, (3, 1): 1, (0, 3): 1, (3, 0): 0, (1, 0): 0}
    for k in range(struct.unpack(">H", cmap[2:4])[0]):
        platform, encoding, at = struct.unpack(">HHI", cmap[4 + 8 * k : 12 + 8 * k])
        form = struct.unpack(">H", cmap[at : at + 2])[0]
        if form == 14:
            variants = _variants(cmap, at)
        elif rank.get((platform, encoding), -1) > best and form in (0, 4, 6, 12):
            best, plain = rank[platform, encoding], _subtable(cmap, at, form)
    return plain, variants


def _subtable(d: bytes, at: int, form: int) -> dict[int, int]:
    out: dict[int, int] = {}
    if form == 0:
        out = {c: g for c, g in enumerate(d[at + 6 : at + 262]) if g}
    elif form == 6:
        first, n = struct.unpack(">HH", d[at + 6 : at + 10])
        out = {first + k: g for k, g in enumerate(struct.unpack(f">{n}H", d[at + 10 : at + 10 + 2 * n])) if g}
    elif form == 12:
        for k in range(struct.unpack(">I", d[at + 12 : at + 16])[0]):
            lo, hi, g = struct.unpack(">III", d[at + 16 + 12 * k : at + 28 + 12 * k])
            if hi - lo > 0x10FFFF:
                raise PdfError("bad-font", "cmap")
            out |= {c: g + c - lo for c in range(lo, hi + 1)}
    else:
        n = struct.unpack(">H", d[at + 6 : at + 8])[0] // 2
        part = lambda k, f: struct.unpack(f">{n}{f}", d[at + 14 + k : at + 14 + k + 2 * n])
        ends, starts, deltas, offsets = part(0, "H"), part(2 * n + 2, "H"), part(4 * n + 2, "h"), part(6 * n + 2, "H")
        base = at + 14 + 6 * n + 2
        for k, (lo, hi, delta, offset) in enumerate(zip(starts, ends, deltas, offsets, strict=True)):
            for c in range(lo, min(hi, 0xFFFE) + 1):
                g = c
                if offset:
                    where = base + 2 * k + offset + 2 * (c - lo)
                    g = int.from_bytes(d[where : where + 2], "big")
                    if not g:
                        continue
                if g := (g + delta) & 0xFFFF:
                    out[c] = g
    return out


def _variants(d: bytes, at: int) -> dict[tuple[int, int], int | None]:
    out: dict[tuple[int, int], int | None] = {}
    for k in range(struct.unpack(">I", d[at + 6 : at + 10])[0]):
        row = at + 10 + 11 * k
        selector = int.from_bytes(d[row : row + 3], "big")
        default, own = struct.unpack(">II", d[row + 3 : row + 11])
        if default:
            for j in range(struct.unpack(">I", d[at + default : at + default + 4])[0]):
                r = at + default + 4 + 4 * j
                first = int.from_bytes(d[r : r + 3], "big")
                out |= {(c, selector): None for c in range(first, first + d[r + 3] + 1)}
        if own:
            for j in range(struct.unpack(">I", d[at + own : at + own + 4])[0]):
                r = at + own + 4 + 5 * j
                out[int.from_bytes(d[r : r + 3], "big"), selector] = int.from_bytes(d[r + 3 : r + 5], "big")
    return out


def glyph_box(t: dict[str, bytes], glyph: int) -> tuple[int, int, int, int] | None:
    """A glyph's box in font units; None for one without outlines."""
    wide = struct.unpack(">h", t["head"][50:52])[0]
    size = 4 if wide else 2
    loca = t["loca"][glyph * size : glyph * size + 2 * size]
    if len(loca) < 2 * size:
        return None
    a, b = struct.unpack(">II" if wide else ">HH", loca)
    if not wide:
        a, b = 2 * a, 2 * b
    return struct.unpack(">4h", t["glyf"][a + 2 : a + 10]) if b > a else None


def evidence(text: str, glyph: int, plain: dict[int, int], variants: dict) -> str:
    """confirmed, disagrees or silent: whether the program's own map leads from the text to the glyph."""
    codes = [ord(c) for c in text]
    if len(codes) == 2 and (codes[0], codes[1]) in variants:
        want = variants[codes[0], codes[1]]
        return "confirmed" if (plain.get(codes[0]) if want is None else want) == glyph else "disagrees"
    if len(codes) != 1 or codes[0] not in plain:
        return "silent"
    return "confirmed" if plain[codes[0]] == glyph else "disagrees"

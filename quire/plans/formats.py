"""Queries that write filters, images, profiles and functions from the driver's tables and read them back."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import colour
from ..pdf import calculator, filters, icc, images, jpeg
from ..pdf.objects import Name
from ..session import table
from .files import ORACLES, QUERIES, query

__all__ = ["ORACLES", "QUERIES"]


def each(df: DataFrame, make: Callable[[pd.Series], tuple], schema: str) -> DataFrame:
    """A row for each row, made in Python from batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame([make(r) for r in batch.itertuples()], columns=names)

    return df.mapInPandas(run, schema)


# ---------------------------------------------------------------------------- filters


def lzw_encoded(data: bytes) -> bytes:
    """Codes of 9 to 12 bits, each length left one code early."""
    known = {bytes([k]): k for k in range(256)}
    codes, width, word = [(256, 9)], 9, b""
    for k in data:
        now = word + bytes([k])
        if now in known:
            word = now
            continue
        codes.append((known[word], width))
        known[now] = len(known) + 2
        if len(known) + 2 > 4094:
            codes.append((256, width))
            known, width = {bytes([k]): k for k in range(256)}, 9
        else:
            width = max(9, (len(known) + 2).bit_length())
        word = bytes([k])
    if word:
        codes.append((known[word], width))
        width = max(width, (len(known) + 3).bit_length())
    codes.append((257, min(12, width)))
    bits = "".join(format(c, f"0{w}b") for c, w in codes)
    return int(bits.ljust(-(-len(bits) // 8) * 8, "0"), 2).to_bytes(-(-len(bits) // 8), "big")


def run_lengths(data: bytes) -> bytes:
    out, k = bytearray(), 0
    while k < len(data):
        n = 1
        while n < 128 and k + n < len(data) and data[k + n] == data[k]:
            n += 1
        if n > 1:
            out += bytes([257 - n, data[k]])
            k += n
        else:
            part = data[k : k + 1]
            out += bytes([0]) + part
            k += 1
    return bytes(out) + b"\x80"


def predicted(data: bytes, row: int, step: int, kinds: Callable[[int], int]) -> bytes:
    """Rows with a tag, each the difference to what its kind foretells."""
    out, before = bytearray(), bytes(row)
    for at in range(0, len(data), row):
        line, kind = data[at : at + row], kinds(at // row)
        out.append(kind)
        for i, v in enumerate(line):
            a, b, c = line[i - step] if i >= step else 0, before[i], before[i - step] if i >= step else 0
            p = a + b - c
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            out.append((v - (0, a, b, (a + b) // 2, paeth)[kind]) & 255)
        before = line.ljust(row, b"\0")
    return bytes(out)


CHAINS = {
    0: (["FlateDecode"], lambda b: zlib.compress(b), None), 1: (["LZWDecode"], lzw_encoded, None), 2: (["ASCIIHexDecode"], lambda b: b.hex().encode() + b">", None),
    3: (["ASCII85Decode", "FlateDecode"], lambda b: _base85(zlib.compress(b)), None), 4: (["RunLengthDecode"], run_lengths, None),
    5: (["FlateDecode"], lambda b: zlib.compress(predicted(b, 12, 3, lambda k: k % 5)), {b"Predictor": 15, b"Colors": 3, b"Columns": 4}), 6: (["Fl"], lambda b: filters.deflate(b, len(b) % 10), None),
}


def _base85(data: bytes) -> bytes:
    import base64

    return base64.a85encode(data) + b"~>"


@query("SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, md5(coalesce(text, '')) AS digest FROM documents")
def filter_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text through one of seven chains of filters and back."""

    def make(r) -> tuple:
        import hashlib

        names, encode, parms = CHAINS[r.doc_id % 7]
        raw = filters.decode(encode((r.text or "").encode()), [Name(n.encode()) for n in names], [parms])[0]
        return r.doc_id, len(raw), hashlib.md5(raw).hexdigest()

    return each(table(spark, sf_dir, "documents").select("doc_id", "text"), make, "doc_id long, bytes long, digest string")


@query("""WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents), l AS (SELECT doc_id, list_transform(range(0, len(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT) AS x FROM b)
SELECT doc_id, (1 + coalesce(list_sum(x), 0))::BIGINT % 65521 + 65536 * ((len(x) + coalesce(list_sum(list_transform(x, lambda v, i: v * (len(x) - i + 1))), 0))::BIGINT % 65521) AS adler FROM l""")
def adler_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return each(table(spark, sf_dir, "documents").select("doc_id", "text"), lambda r: (r.doc_id, zlib.adler32((r.text or "").encode())), "doc_id long, adler long")


# ---------------------------------------------------------------------------- images


def png(pixels: np.ndarray, color: int, depth: int = 8, lace: bool = False, palette: bytes = b"", clear: bytes = b"") -> bytes:
    """A file of samples (height, width, channels) with a filter of its own for each row."""
    h, w, c = pixels.shape
    grids = [(0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2)] if lace else [(0, 0, 1, 1)]
    raw = b""
    for x, y, dx, dy in grids:
        part = pixels[y::dy, x::dx]
        if not part.size:
            continue
        line = part.reshape(len(part), -1)
        if depth == 16:
            rows = line.astype(">u2").tobytes()
        elif depth < 8:
            bits = (line[:, :, None] >> np.arange(depth - 1, -1, -1)) & 1
            rows = np.packbits(bits.reshape(len(part), -1).astype(np.uint8), axis=1).tobytes()
        else:
            rows = line.astype(np.uint8).tobytes()
        raw += predicted(rows, len(rows) // len(part), max(1, c * depth // 8), lambda k: k % 5)
    chunk = lambda kind, body: struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))
    head = struct.pack(">IIBBBBB", w, h, depth, color, 0, 0, lace)
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", head) + (chunk(b"PLTE", palette) if palette else b"") + (chunk(b"tRNS", clear) if clear else b"") + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


SAMPLE = "((vec_id * 31 + {0} * 7) % 256)"
PNG = f"""WITH i AS (SELECT vec_id, vec_id % 6 AS kind, unnest(range(0, 63)) AS k FROM embeddings),
p AS (SELECT vec_id, kind, CASE kind WHEN 0 THEN {SAMPLE.format('k')} WHEN 1 THEN {SAMPLE.format('3 * k')} WHEN 2 THEN {SAMPLE.format('2 * k')} WHEN 3 THEN {SAMPLE.format('4 * k')} WHEN 4 THEN ((vec_id + k) % 16) * 16 ELSE {SAMPLE.format('k')} END AS r,
CASE kind WHEN 0 THEN {SAMPLE.format('k')} WHEN 1 THEN {SAMPLE.format('(3 * k + 2)')} WHEN 2 THEN {SAMPLE.format('2 * k')} WHEN 3 THEN {SAMPLE.format('(4 * k + 2)')} WHEN 4 THEN (vec_id + k) % 16 ELSE {SAMPLE.format('k')} END AS b,
CASE kind WHEN 2 THEN {SAMPLE.format('(2 * k + 1)')} WHEN 3 THEN {SAMPLE.format('(4 * k + 3)')} WHEN 4 THEN CASE WHEN (vec_id + k) % 16 = 0 THEN 7 ELSE 255 END ELSE 255 END AS a FROM i)
SELECT vec_id, sum(r)::BIGINT AS red, sum(b)::BIGINT AS blue, sum(a)::BIGINT AS opacity FROM p GROUP BY 1"""


@query(PNG)
def png_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of 9 by 7 of every colour type, at 4, 8 and 16 bits, interlaced or not, as eight-bit red, green, blue and opacity."""

    def make(r) -> tuple:
        kind = r.vec_id % 6
        channels = (1, 3, 2, 4, 1, 1)[kind]
        at = np.arange(63 * channels)
        samples = ((r.vec_id + at) % 16 if kind == 4 else (r.vec_id * 31 + at * 7) % 256 * (257 if kind == 5 else 1)).reshape(7, 9, channels)
        palette = b"".join(bytes([16 * k, 255 - k, k]) for k in range(16)) if kind == 4 else b""
        data = png(samples, (0, 2, 4, 6, 3, 0)[kind], (8, 8, 8, 8, 4, 16)[kind], r.vec_id % 4 < 2, palette, b"\x07" if kind == 4 else b"")
        rgba = images.to_rgba(images.decode_png(data)).astype(int)
        return r.vec_id, int(rgba[..., 0].sum()), int(rgba[..., 2].sum()), int(rgba[..., 3].sum())

    return each(table(spark, sf_dir, "embeddings").select("vec_id"), make, "vec_id long, red long, blue long, opacity long")


def flat_jpeg(values: list[int], orientation: int = 1, profile: bytes = b"") -> bytes:
    """Grey squares of 8 by 8 in a row, each of one value: codes of four bits for the sizes of differences, of one bit for no further ones."""
    segment = lambda kind, body: b"\xff" + bytes([kind]) + struct.pack(">H", len(body) + 2) + body
    bits, last = "", 0
    for v in values:
        d = v - 128 - last
        last, n = v - 128, abs(v - 128 - last).bit_length()
        bits += format(n, "04b") + (format(d if d > 0 else d + (1 << n) - 1, f"0{n}b") if n else "") + "0"
    bits = bits.ljust(-(-len(bits) // 8) * 8, "1")
    scan = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0")
    exif = b"Exif\0\0MM\0*\0\0\0\x08" + struct.pack(">HHHIHHI", 1, 0x112, 3, 1, orientation, 0, 0)
    out = b"\xff\xd8" + segment(0xE1, exif) + (segment(0xE2, b"ICC_PROFILE\0\1\1" + profile) if profile else b"")
    out += segment(0xDB, b"\0" + b"\x08" * 64) + segment(0xC0, struct.pack(">BHHBBBB", 8, 8, 8 * len(values), 1, 1, 0x11, 0))
    out += segment(0xC4, b"\0" + bytes([0, 0, 0, 12]) + bytes(12) + bytes(range(12))) + segment(0xC4, b"\x10" + bytes([1]) + bytes(15) + b"\0")
    return out + segment(0xDA, b"\x01\x01\0\0\x3f\0") + scan + b"\xff\xd9"


@query("SELECT p_partkey, 24::BIGINT AS width, (p_partkey % 8 + 1)::BIGINT AS orientation, (p_size)::BIGINT AS profile, (64 * ((p_partkey * 37) % 256 + (p_partkey * 11) % 256 + p_size))::BIGINT AS total FROM part")
def jpeg_pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three grey squares, with an orientation and a profile beside them."""

    def make(r) -> tuple:
        data = flat_jpeg([r.p_partkey * 37 % 256, r.p_partkey * 11 % 256, r.p_size], r.p_partkey % 8 + 1, bytes(r.p_size))
        head = images.jpeg_header(data)
        pixels = jpeg.decode_jpeg(data)["pixels"]
        return r.p_partkey, head["width"], head["orientation"], len(head["profile"] or b""), int(np.asarray(pixels, np.int64).sum())

    return each(table(spark, sf_dir, "part").select("p_partkey", "p_size"), make, "p_partkey long, width long, orientation long, profile long, total long")


# ---------------------------------------------------------------------------- profiles and functions


def profile(space: bytes, pcs: bytes, tags: list[tuple[bytes, bytes]]) -> bytes:
    return icc.written(space, pcs, tags, version=2)


def xyz_tag(*v: float) -> bytes:
    return b"XYZ \0\0\0\0" + struct.pack(">3i", *[round(x * 65536) for x in v])


def gamma_tag(gamma: float) -> bytes:
    return b"curv\0\0\0\0" + struct.pack(">IH", 1, round(gamma * 256))


def para_tag(kind: int, *v: float) -> bytes:
    return b"para\0\0\0\0" + struct.pack(">HH", kind, 0) + struct.pack(f">{len(v)}i", *[round(x * 65536) for x in v])


@query("""WITH v AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS x FROM part), y AS (SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN pow(x, 2.0) WHEN 1 THEN CASE WHEN x >= 0.25 THEN pow(0.5 * x + 0.5, 2.0) ELSE 0.5 * x END ELSE pow(x, 1.5) END AS y FROM v)
SELECT p_partkey, round(CASE WHEN y > 216.0 / 24389 THEN 116 * cbrt(y) - 16 ELSE y * 24389.0 / 27 END, 4) AS lightness FROM y""")
def grey_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lightness of greys under profiles with a gamma or a parametric curve."""
    p = {k: profile(b"GRAY", b"XYZ ", [(b"kTRC", t)]) for k, t in enumerate((gamma_tag(2.0), para_tag(3, 2.0, 0.5, 0.5, 0.5, 0.25), para_tag(0, 1.5)))}

    def make(r) -> tuple:
        return r.p_partkey, round(float(icc.Profile(p[r.p_partkey % 3]).to_lab(np.array([[r.p_size / 50]]))[0, 0]), 4)

    return each(table(spark, sf_dir, "part").select("p_partkey", "p_size"), make, "p_partkey long, lightness double")


RGB = [(0.4361, 0.2225, 0.0139), (0.3851, 0.7169, 0.0971), (0.1431, 0.0606, 0.7141)]
FIXED = [[round(x * 65536) / 65536 for x in v] for v in RGB]


@query(f"""WITH v AS (SELECT vec_id, least(abs(embedding[1]::DOUBLE), 1) AS r, least(abs(embedding[2]::DOUBLE), 1) AS g, least(abs(embedding[3]::DOUBLE), 1) AS b FROM embeddings),
x AS (SELECT vec_id, (r*r*{FIXED[0][0]!r} + g*g*{FIXED[1][0]!r} + b*b*{FIXED[2][0]!r}) / 0.9642 AS x, r*r*{FIXED[0][1]!r} + g*g*{FIXED[1][1]!r} + b*b*{FIXED[2][1]!r} AS y FROM v),
f AS (SELECT vec_id, CASE WHEN x > 216.0 / 24389 THEN cbrt(x) ELSE (x * 24389.0 / 27 + 16) / 116 END AS fx, CASE WHEN y > 216.0 / 24389 THEN cbrt(y) ELSE (y * 24389.0 / 27 + 16) / 116 END AS fy FROM x)
SELECT vec_id, round(116 * fy - 16, 3) AS l, round(500 * (fx - fy), 3) AS a FROM f""")
def matrix_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab of colours under a matrix profile with gamma 2."""
    source = profile(b"RGB ", b"XYZ ", [*[(c + b"XYZ", xyz_tag(*v)) for c, v in zip((b"r", b"g", b"b"), RGB, strict=True)], *[(c + b"TRC", gamma_tag(2.0)) for c in (b"r", b"g", b"b")]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        p = icc.Profile(source)
        for batch in batches:
            if len(batch):
                v = p.to_lab(np.minimum(np.abs(np.stack(batch["rgb"].to_numpy()).astype(float)), 1))
                yield pd.DataFrame({"vec_id": batch["vec_id"], "l": np.round(v[:, 0], 3), "a": np.round(v[:, 1], 3)})

    d = table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("rgb"))
    return d.mapInPandas(run, "vec_id long, l double, a double")


@query("""WITH v AS (SELECT p_partkey, p_size / 50.0::DOUBLE AS x, p_partkey % 3 AS k FROM part)
SELECT p_partkey, round(CASE k WHEN 0 THEN 100 * x * x WHEN 1 THEN 100 * (0.5 * x + 0.25) ELSE 100 * x END, 1) AS lightness, round(CASE k WHEN 0 THEN -128 + 255 * x ELSE -128 + 255 * 0.5 END, 1) AS a FROM v""")
def table_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lab of red, green and blue under tables of several dimensions: with curves and a grid, with a matrix, and with neither."""
    square, line = para_tag(0, 2.0), b"curv\0\0\0\0\0\0\0\0"
    grid = np.stack(np.meshgrid(*[np.linspace(0, 1, 3)] * 3, indexing="ij"), -1)

    def tag(a: bytes | None, clut: bool, matrix: list[float] | None, b: bytes) -> bytes:
        body, at = b"", {}
        for name, part in (("b", b * 3), ("matrix", struct.pack(">12i", *[round(x * 65536) for x in matrix]) if matrix else b""), ("m", line * 3 if matrix else b""), ("grid", bytes([3, 3, 3]) + bytes(13) + b"\2\0\0\0" + (grid * 65535).round().astype(">u2").tobytes() if clut else b""), ("a", a * 3 if a else b"")):
            at[name] = 32 + len(body) if part else 0
            body += part + bytes(-len(part) % 4)
        return b"mAB \0\0\0\0\3\3\0\0" + struct.pack(">5I", at["b"], at["matrix"], at["m"], at["grid"], at["a"]) + body

    tags = [tag(line, True, None, square), tag(None, False, [0.5, 0, 0, 0, 1, 0, 0, 0, 1, 0.25, 0, 0], line), tag(None, False, None, line)]
    p = [icc.written(b"RGB ", b"Lab ", [(b"A2B0", t)]) for t in tags]

    def make(r) -> tuple:
        x = r.p_size / 50
        second = np.sqrt(x) if r.p_partkey % 3 == 0 else 0.5
        v = icc.Profile(p[r.p_partkey % 3]).to_lab(np.array([[x, second, 0.5]]))
        return r.p_partkey, round(float(v[0, 0]), 1), round(float(v[0, 1]), 1)

    return each(table(spark, sf_dir, "part").select("p_partkey", "p_size"), make, "p_partkey long, lightness double, a double")


@query("""WITH v AS (SELECT p_partkey, (p_partkey * 37) % 256 / 255.0::DOUBLE AS c FROM part), y AS (SELECT p_partkey, CASE WHEN c >= 0.04045 THEN pow((c + 0.055) / 1.055, 2.4) ELSE c / 12.92 END AS y FROM v)
SELECT p_partkey, round(CASE WHEN y > 216.0 / 24389 THEN 116 * cbrt(y) - 16 ELSE y * 24389.0 / 27 END, 1) AS lightness FROM y""")
def screen_greys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lightness of a screen's greys, by the profile that is made for them."""

    def make(r) -> tuple:
        return r.p_partkey, round(float(icc.Profile(icc.srgb()).to_lab(np.full((1, 3), r.p_partkey * 37 % 256 / 255))[0, 0]), 1)

    return each(table(spark, sf_dir, "part").select("p_partkey"), make, "p_partkey long, lightness double")


@query("SELECT vec_id, round(abs(embedding[1]::DOUBLE) % 1 + 2 * (abs(embedding[2]::DOUBLE) % 1) + 3 * (abs(embedding[3]::DOUBLE) % 1), 5) AS trilinear, round(abs(embedding[1]::DOUBLE) % 1 + 2 * (abs(embedding[2]::DOUBLE) % 1) + 3 * (abs(embedding[3]::DOUBLE) % 1), 5) AS tetrahedral FROM embeddings")
def table_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A plane sampled at 5 by 4 by 3 points is met exactly, by corners and by tetrahedra."""
    grid = (np.linspace(0, 1, 5)[:, None, None] + 2 * np.linspace(0, 1, 4)[:, None] + 3 * np.linspace(0, 1, 3))[..., None]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                x = np.abs(np.stack(batch["x"].to_numpy()).astype(float)) % 1
                yield pd.DataFrame({"vec_id": batch["vec_id"], "trilinear": np.round(icc.multilinear(grid, x)[:, 0], 5), "tetrahedral": np.round(icc.tetrahedral(grid, x)[:, 0], 5)})

    return table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", 1, 3).alias("x")).mapInPandas(run, "vec_id long, trilinear double, tetrahedral double")


@query("SELECT p_partkey, list_transform(range(0, 6), lambda i: 255 - (p_partkey * 13 + i * 29) % 256)::BIGINT[] AS eight, list_transform(range(0, 6), lambda i: 65535 - (p_partkey * 1301 + i * 2903) % 65536)::BIGINT[] AS sixteen FROM part")
def image_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of samples of 8 and 16 bits, each colour converted once."""

    def make(r) -> tuple:
        at = np.arange(6)
        eight = ((r.p_partkey * 13 + at * 29) % 256).astype(np.uint8).reshape(1, 2, 3)
        sixteen = ((r.p_partkey * 1301 + at * 2903) % 65536).astype(np.uint16).reshape(1, 2, 3)
        return r.p_partkey, *[icc.convert_rows(x, lambda v: 1 - v).ravel().astype(int).tolist() for x in (eight, sixteen)]

    return each(table(spark, sf_dir, "part").select("p_partkey"), make, "p_partkey long, eight array<bigint>, sixteen array<bigint>")


@query("SELECT l_orderkey, l_linenumber, round(0.4 * pow(l_discount, 1.5) + 0.3 * pow(l_tax, 2.0) + 0.2 * (l_quantity / 50), 6) AS x, round(0.95 * pow(l_discount, 1.8), 6) AS grey FROM lineitem")
def calibrated_colours(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "lineitem")
    x, _, _ = colour.calibrated_rgb(F.col("l_discount"), F.col("l_tax"), F.col("l_quantity") / 50, (1.5, 2.0, 1.0), (0.4, 0.2, 0.1, 0.3, 0.6, 0.1, 0.2, 0.1, 0.7))
    g, _, _ = colour.calibrated_grey(F.col("l_discount"), (0.95, 1.0, 1.1), 1.8)
    return d.select("l_orderkey", "l_linenumber", F.round(x, 6).alias("x"), F.round(g, 6).alias("grey"))


PROGRAM = b"{ 2 copy gt { exch } if dup 0.04 lt { 2 mul add } { sub abs neg 3 mul } ifelse dup 0 lt { 1 add 10 mul round 10 div } { sqrt } ifelse }"


@query("""WITH v AS (SELECT l_orderkey, l_linenumber, least(l_discount, l_tax)::DOUBLE AS a, greatest(l_discount, l_tax)::DOUBLE AS b FROM lineitem), s AS (SELECT *, CASE WHEN b < 0.04 THEN a + b * 2 ELSE -abs(a - b) * 3 END AS s FROM v)
SELECT l_orderkey, l_linenumber, round(CASE WHEN s < 0 THEN floor((s + 1) * 10 + 0.5 + 1e-9) / 10 ELSE sqrt(s) END, 6) AS value FROM s""")
def calculator_fn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A calculator program with copies, exchanges, conditions, roots and rounding, once for each pair of inputs."""
    pairs = table(spark, sf_dir, "lineitem").select(F.col("l_discount").cast("double").alias("x"), F.col("l_tax").cast("double").alias("y")).distinct()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        program = calculator.compile_program(PROGRAM)
        for batch in batches:
            yield batch.assign(value=[round(calculator.run_program(program, [x, y])[0], 6) for x, y in zip(batch["x"], batch["y"], strict=True)])

    known = pairs.mapInPandas(run, "x double, y double, value double")
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_discount").cast("double").alias("x"), F.col("l_tax").cast("double").alias("y"))
    return d.join(known, ["x", "y"]).select("l_orderkey", "l_linenumber", "value")

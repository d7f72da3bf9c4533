"""Document functions as a file holds them: sampled, exponential, stitching and calculator functions."""

from __future__ import annotations

from itertools import product

import numpy as np

from .calculator import compile_program, run_program
from .objects import PdfError, Stream

DEPTH, NODES = 16, 65_536


class Function:
    """Reads a function, or an array of them, and evaluates it. Shared parts are read once; cycles and deep nesting are refused."""

    def __init__(self, doc, value):
        self.doc, self.count = doc, 0
        self.parts = [self._read(v, 0) for v in value] if isinstance(value := doc.get(value), list) else [self._read(value, 0)]

    def __call__(self, x: list[float]) -> list[float]:
        return [y for f in self.parts for y in f(list(map(float, x)))]

    def _numbers(self, d: dict, key: bytes, default=None):
        v = self.doc.get(d.get(key, default))
        return None if v is None else [float(self.doc.get(x)) for x in v]

    def _read(self, value, depth: int):
        self.count += 1
        if depth > DEPTH or self.count > NODES:
            raise PdfError("nesting-limit", "function")
        value = self.doc.get(value)
        d = value.dict if isinstance(value, Stream) else value
        if not isinstance(d, dict):
            raise PdfError("bad-function")
        kind, domain, out_range = self.doc.get(d.get(b"FunctionType")), self._numbers(d, b"Domain"), self._numbers(d, b"Range")
        if domain is None:
            raise PdfError("bad-function", "Domain")
        clip = lambda x, r: [min(max(v, r[2 * k]), r[2 * k + 1]) for k, v in enumerate(x[: len(r) // 2])] if r else x
        if kind == 2:
            c0, c1, n = self._numbers(d, b"C0", [0]), self._numbers(d, b"C1", [1]), float(self.doc.get(d.get(b"N", 1)))
            body = lambda x: [a + x[0] ** n * (b - a) for a, b in zip(c0, c1, strict=True)]
        elif kind == 3:
            parts = [self._read(f, depth + 1) for f in self.doc.get(d[b"Functions"])]
            bounds, encode = self._numbers(d, b"Bounds"), self._numbers(d, b"Encode")
            edges = [domain[0], *bounds, domain[1]]

            def body(x):
                k = next((k for k, b in enumerate(bounds) if x[0] < b), len(parts) - 1)
                lo, hi, e0, e1 = edges[k], edges[k + 1], encode[2 * k], encode[2 * k + 1]
                return parts[k]([e0 if hi == lo else e0 + (x[0] - lo) * (e1 - e0) / (hi - lo)])
        elif kind == 4:
            program = compile_program(self.doc.decoded(value)[0])
            body = lambda x: run_program(program, x)
        elif kind == 0:
            body = self._sampled(value, d, domain, out_range)
        else:
            raise PdfError("bad-function", "type")
        return lambda x: clip(body(clip(x, domain)), out_range)

    def _sampled(self, value: Stream, d: dict, domain: list[float], out_range: list[float]):
        sizes, bits = [int(self.doc.get(v)) for v in self.doc.get(d[b"Size"])], int(self.doc.get(d[b"BitsPerSample"]))
        m, n = len(sizes), len(out_range) // 2
        if m > 8:
            raise PdfError("unsupported-feature", "more than eight inputs")
        raw = np.frombuffer(self.doc.decoded(value)[0], np.uint8)
        count = int(np.prod(sizes)) * n
        flat = np.unpackbits(raw)[: count * bits].reshape(count, bits)
        samples = (flat * 2.0 ** np.arange(bits - 1, -1, -1)).sum(1).reshape(*reversed(sizes), n)  # the first input varies fastest
        encode = self._numbers(d, b"Encode") or [v for s in sizes for v in (0, s - 1)]
        decode = self._numbers(d, b"Decode") or out_range
        top = 2.0**bits - 1

        def body(x):
            place = [min(max(encode[2 * k] + (v - domain[2 * k]) * (encode[2 * k + 1] - encode[2 * k]) / ((domain[2 * k + 1] - domain[2 * k]) or 1), 0), sizes[k] - 1) for k, v in enumerate(x)]
            low = [min(int(p), max(s - 2, 0)) for p, s in zip(place, sizes, strict=True)]
            out = np.zeros(n)
            for corner in product((0, 1), repeat=m):
                weight = np.prod([p - q if c else 1 - (p - q) for p, q, c in zip(place, low, corner, strict=True)])
                if weight:
                    out += weight * samples[tuple(min(q + c, s - 1) for q, c, s in reversed(list(zip(low, corner, sizes, strict=True))))]
            return [decode[2 * k] + v * (decode[2 * k + 1] - decode[2 * k]) / top for k, v in enumerate(out.tolist())]

        return body

"""PDF objects, and a tolerant reader of them."""

from __future__ import annotations

from dataclasses import dataclass, field


class PdfError(Exception):
    """What stops the reading of a file; code is a short fixed word."""

    def __init__(self, code: str, detail: str = ""):
        super().__init__(f"{code}: {detail}")
        self.code, self.detail = code, detail


class Name(bytes):
    """A name's bytes, without the slash."""


@dataclass(frozen=True)
class Str:
    data: bytes
    hex: bool = False


@dataclass(frozen=True)
class Ref:
    num: int
    gen: int


@dataclass(frozen=True)
class Invalid:
    data: bytes
    reason: str


class Keyword(bytes):
    """An operator or a word such as obj."""


@dataclass
class Stream:
    dict: dict
    data: bytes
    warnings: list = field(default_factory=list)


WHITE = b"\0\t\n\f\r "
DELIMITER = b"()<>[]{}/%"
ENDS = frozenset(WHITE + DELIMITER)
EOF = Keyword(b"")
DEPTH = 256


class Reader:
    """Reads tokens and objects from bytes at a place that moves on."""

    def __init__(self, data: bytes, at: int = 0, refs: bool = True):
        self.data, self.at, self.refs = data, at, refs
        self.warnings: list[tuple[str, int]] = []

    def space(self) -> None:
        d, n = self.data, len(self.data)
        while self.at < n:
            c = d[self.at]
            if c in WHITE:
                self.at += 1
            elif c == 0x25:
                while self.at < n and d[self.at] not in b"\r\n":
                    self.at += 1
            else:
                return

    def token(self):
        """The next token: a keyword, number, name, string, or one of [ ] << >> { }."""
        self.space()
        d, n, at = self.data, len(self.data), self.at
        if at >= n:
            return EOF
        c = d[at]
        if c == 0x2F:
            return self._name()
        if c == 0x28:
            return self._literal()
        if c == 0x3C:
            if d[at + 1 : at + 2] == b"<":
                self.at += 2
                return Keyword(b"<<")
            return self._hex()
        if c == 0x3E and d[at + 1 : at + 2] == b">":
            self.at += 2
            return Keyword(b">>")
        if c in DELIMITER:
            self.at += 1
            return Keyword(d[at : at + 1])
        end = at
        while end < n and d[end] not in ENDS:
            end += 1
        self.at = end
        word = d[at:end]
        if c in b"+-.0123456789":
            return self._number(word, at)
        return Keyword(word)

    def _number(self, word: bytes, at: int):
        try:
            if word.isdigit() or (word[:1] in b"+-" and word[1:].isdigit()):
                return int(word)
            body = word.lstrip(b"+-")
            if body and body.count(b".") <= 1 and body.replace(b".", b"").isdigit():
                value = float(body)
                if len(word) - len(body) > 1:
                    self.warnings.append(("malformed-number", at))
                return -value if word[:1] == b"-" else value
        except ValueError:
            pass
        self.warnings.append(("malformed-number", at))
        return Invalid(word, "number") if word[:1] in b"+-.0123456789" and word.strip(b"+-.0123456789") == b"" else Keyword(word)

    def _name(self) -> Name:
        d, n = self.data, len(self.data)
        at = end = self.at + 1
        while end < n and d[end] not in ENDS:
            end += 1
        self.at = end
        raw = d[at:end]
        if b"#" in raw:
            out, k = bytearray(), 0
            while k < len(raw):
                pair = raw[k + 1 : k + 3]
                if raw[k] == 0x23 and len(pair) == 2 and all(x in b"0123456789abcdefABCDEF" for x in pair):
                    out.append(int(pair, 16))
                    k += 3
                else:
                    out.append(raw[k])
                    k += 1
            raw = bytes(out)
        return Name(raw)

    def _literal(self) -> Str | Invalid:
        d, n, depth = self.data, len(self.data), 1
        out, k = bytearray(), self.at + 1
        simple = {0x6E: 10, 0x72: 13, 0x74: 9, 0x62: 8, 0x66: 12}
        while k < n:
            c = d[k]
            if c == 0x5C:
                k += 1
                e = d[k] if k < n else 0
                if e in simple:
                    out.append(simple[e])
                elif 0x30 <= e <= 0x37:
                    m = k
                    while m < n and m < k + 3 and 0x30 <= d[m] <= 0x37:
                        m += 1
                    out.append(int(d[k:m], 8) & 255)
                    k = m - 1
                elif e == 13:
                    k += d[k + 1 : k + 2] == b"\n"
                elif e != 10:
                    out.append(e)
            elif c == 0x28:
                depth += 1
                out.append(c)
            elif c == 0x29:
                depth -= 1
                if not depth:
                    self.at = k + 1
                    return Str(bytes(out))
                out.append(c)
            elif c == 13:
                out.append(10)
                k += d[k + 1 : k + 2] == b"\n"
            else:
                out.append(c)
            k += 1
        self.warnings.append(("unterminated-string", self.at))
        self.at = n
        return Invalid(bytes(out), "string")

    def _hex(self) -> Str | Invalid:
        end = self.data.find(b">", self.at)
        if end < 0:
            self.warnings.append(("unterminated-string", self.at))
            raw, self.at = self.data[self.at :], len(self.data)
            return Invalid(raw, "string")
        raw = bytes(c for c in self.data[self.at + 1 : end] if c not in WHITE)
        self.at = end + 1
        good = bytes(c for c in raw if c in b"0123456789abcdefABCDEF")
        if len(good) != len(raw):
            self.warnings.append(("malformed-hex-string", end))
        return Str(bytes.fromhex((good + b"0" * (len(good) % 2)).decode()), True)

    def object(self, depth: int = 0):
        """The next object, or a keyword that isn't part of one."""
        if depth > DEPTH:
            raise PdfError("nesting-limit", f"at {self.at}")
        start = self.at
        t = self.token()
        if type(t) is int and self.refs and t >= 0:
            after = self.at
            g = self.token()
            if type(g) is int and 0 <= g:
                if self.token() == b"R" and self.data[self.at - 1 : self.at] == b"R":
                    return Ref(t, g)
            self.at = after
            return t
        if not isinstance(t, Keyword):
            return t
        if t == b"[":
            out = []
            while True:
                x = self.object(depth + 1)
                if isinstance(x, Keyword):
                    if x == b"]":
                        return out
                    if x == b"" or x in (b">>", b"endobj", b"endstream"):
                        self.warnings.append(("unterminated-array", start))
                        return out
                    x = Invalid(bytes(x), "keyword")
                out.append(x)
        if t == b"<<":
            out = {}
            while True:
                k = self.object(depth + 1)
                if isinstance(k, Keyword):
                    if k == b">>":
                        return out
                    if k == b"" or k in (b"endobj", b"stream"):
                        self.warnings.append(("unterminated-dictionary", start))
                        return out
                    self.warnings.append(("invalid-dictionary-key", self.at))
                    continue
                if not isinstance(k, Name):
                    self.warnings.append(("invalid-dictionary-key", self.at))
                    continue
                v = self.object(depth + 1)
                if isinstance(v, Keyword):
                    if v == b">>":
                        self.warnings.append(("missing-dictionary-value", self.at))
                        return out
                    v = Invalid(bytes(v), "keyword")
                if k in out:
                    self.warnings.append(("duplicate-key", self.at))
                    del out[k]
                out[k] = v
        if t == b"true":
            return True
        if t == b"false":
            return False
        if t == b"null":
            return None
        return t


def number_text(v: float) -> bytes:
    """A real without exponent, to six places, half to even."""
    t = f"{v:.6f}".rstrip("0").rstrip(".")
    return b"0" if t in ("-0", "") else t.encode()


def serialize(v) -> bytes:
    """An object's bytes."""
    if v is None:
        return b"null"
    if v is True or v is False:
        return b"true" if v else b"false"
    if isinstance(v, int):
        return str(v).encode()
    if isinstance(v, float):
        return number_text(v)
    if isinstance(v, Name):
        return b"/" + b"".join(bytes([c]) if 0x21 <= c <= 0x7E and c not in DELIMITER and c != 0x23 else b"#%02X" % c for c in v)
    if isinstance(v, Str):
        if v.hex:
            return b"<" + v.data.hex().upper().encode() + b">"
        return b"(" + v.data.replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)").replace(b"\r", b"\\r").replace(b"\n", b"\\n") + b")"
    if isinstance(v, Ref):
        return b"%d %d R" % (v.num, v.gen)
    if isinstance(v, Invalid):
        return v.data
    if isinstance(v, list):
        return b"[" + b" ".join(map(serialize, v)) + b"]"
    if isinstance(v, dict):
        return b"<<" + b"".join(serialize(Name(k)) + b" " + serialize(x) for k, x in v.items()) + b">>"
    if isinstance(v, Stream):
        return serialize(v.dict | {b"Length": len(v.data)}) + b"\nstream\n" + v.data + b"\nendstream"
    raise TypeError(type(v))

"""Document functions that carry a program: a stack machine for the calculator's operators."""

from __future__ import annotations

import math

from .objects import EOF, Keyword, PdfError, Reader

MATH = {
    b"abs": abs, b"ceiling": math.ceil, b"cvi": math.trunc, b"cvr": float, b"floor": math.floor, b"ln": math.log, b"log": math.log10, b"neg": lambda x: -x,
    b"round": lambda x: math.floor(x + 0.5), b"sin": lambda x: math.sin(math.radians(x)), b"cos": lambda x: math.cos(math.radians(x)), b"sqrt": math.sqrt, b"truncate": math.trunc,
    b"not": lambda x: not x if isinstance(x, bool) else ~int(x),
}
PAIRS = {
    b"add": lambda a, b: a + b, b"sub": lambda a, b: a - b, b"mul": lambda a, b: a * b, b"div": lambda a, b: a / b, b"idiv": lambda a, b: math.trunc(a / b), b"mod": lambda a, b: int(math.fmod(a, b)),
    b"exp": lambda a, b: float(a) ** b, b"atan": lambda a, b: math.degrees(math.atan2(a, b)) % 360, b"eq": lambda a, b: a == b, b"ne": lambda a, b: a != b, b"lt": lambda a, b: a < b, b"le": lambda a, b: a <= b,
    b"gt": lambda a, b: a > b, b"ge": lambda a, b: a >= b, b"and": lambda a, b: a and b if isinstance(a, bool) else a & b, b"or": lambda a, b: a or b if isinstance(a, bool) else a | b, b"xor": lambda a, b: a ^ b,
    b"bitshift": lambda a, b: a << b if b >= 0 else a >> -b,
}


def compile_program(source: bytes) -> list:
    """The program as nested lists."""
    r = Reader(source, 0, refs=False)
    if r.token() != b"{":
        raise PdfError("bad-function")

    def block(depth: int) -> list:
        if depth > 64:
            raise PdfError("nesting-limit")
        out = []
        while (t := r.token()) != b"}":
            if t is EOF or t == b"":
                raise PdfError("bad-function")
            out.append(block(depth + 1) if t == b"{" else t)
        return out

    return block(0)


def run_program(program: list, inputs: list[float]) -> list[float]:
    stack: list = list(inputs)

    def run(block: list) -> None:
        for k, t in enumerate(block):
            if len(stack) > 100:
                raise PdfError("size-limit", "stack")
            if isinstance(t, list) or not isinstance(t, Keyword):
                if not isinstance(t, list):
                    stack.append(t)
                continue
            try:
                if t in MATH:
                    stack.append(MATH[t](stack.pop()))
                elif t in PAIRS:
                    b, a = stack.pop(), stack.pop()
                    stack.append(PAIRS[t](a, b))
                elif t in (b"true", b"false"):
                    stack.append(t == b"true")
                elif t == b"pop":
                    stack.pop()
                elif t == b"dup":
                    stack.append(stack[-1])
                elif t == b"exch":
                    stack[-1], stack[-2] = stack[-2], stack[-1]
                elif t == b"copy":
                    n = int(stack.pop())
                    stack.extend(stack[len(stack) - n :] if n else [])
                elif t == b"index":
                    stack.append(stack[-1 - int(stack.pop())])
                elif t == b"roll":
                    j, n = int(stack.pop()), int(stack.pop())
                    if n:
                        part = stack[-n:]
                        stack[-n:] = part[-j % n :] + part[: -j % n]
                elif t == b"if":
                    if stack.pop():
                        run(block[k - 1])
                elif t == b"ifelse":
                    run(block[k - 2] if stack.pop() else block[k - 1])
                else:
                    raise PdfError("bad-function", t.decode("latin-1"))
            except (IndexError, ValueError, ZeroDivisionError, OverflowError, TypeError) as e:
                raise PdfError("bad-function", t.decode("latin-1")) from e

    run(program)
    return [float(x) for x in stack]

"""Small tables with awkward rows, and brute-force versions of what the operators compute."""

import random
import re

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, `_path` string, owner string, h long"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))


def awkward(seed=1, n=40):
    """Rows with nulls in every column, empty, blank and very long texts, ties, copies, near copies and names that clash with the operators' own."""
    rng = random.Random(seed)
    out = []
    for k in range(n):
        text = "\n".join(words(rng, rng.randint(3, 30)) for _ in range(rng.randint(1, 6)))
        out.append([k, text, rng.choice(["en", "de", "fr"]), f"src{rng.randint(0, 3)}"])
    for k in range(8):  # copies and near copies of the first rows
        out.append([n + k, out[k][1], "en", "src0"])
        w = (out[k][1] + " " + words(rng, 120)).split(" ")
        out.append([n + 20 + k, " ".join(w), "en", "src1"])
        w[3] = "changed"
        out.append([n + 40 + k, " ".join(w), "en", "src1"])
    out += [[500, None, "en", "src0"], [501, "", "en", "src1"], [502, "  \n\t ", None, None], [503, "12 34 !!", "de", "src1"], [None, "no id here but words", "fr", "src2"], [504, words(rng, 20_000), "en", "src2"], [505, "x" * 30_000, "en", "src2"], [506, "a b", "en", "src1"], [507, "A B", "en", "src1"], [508, "naïve 😀 <|endoftext|> don't  stop now \n\n x", "fr", "src3"], [509, "1 " * 5000, "en", "src3"]]
    out += [out[0][:], out[0][:]]  # repeated rows
    return [(*r, len(r[1] or ""), 7, "p", "o", 3) for r in out]


def shingle_set(text, size):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def smallest_linked(keys, linked):
    """For each key the smallest that links reach."""
    top = {k: k for k in keys}

    def find(k):
        while top[k] != k:
            k = top[k]
        return k

    for a, b in linked:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}

"""BPE encoding and decoding with a minimal acyclic transducer lexicon.

The corpus's frequent words are compiled, with their ids, into a shared-suffix automaton that every worker maps into
memory. Words that it lacks are merged exactly, all words of a length at a time.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import json
import os
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F

from ..session import shared_dir
from . import automaton
from .common import RUN, columns, give_back, most_frequent, scratch

#: Fixed value: the split of byte-level BPE into words, in the notation of the tokenizers' documentation. splitter() writes it for re.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Fixed value: Unicode's White_Space, without the plain space and the line feed.
RARE_SPACE = "\t\x0b\x0c\r\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
NEVER = np.int32(2**31 - 1)
#: Longer words are merged one by one with a heap.
WIDE = 48
#: Entries of a task's memo and of its counts; beyond that they are emptied (counts: sent on). Some 70 MB: a task of 16 MB of
#: Parquet has fewer different chunks, so each is merged once.
MEMO = 400_000


def splitter() -> re.Pattern:
    """SPLIT with its classes spelt out, which re matches faster than regex does. Letters go first: no contraction starts with one."""
    kinds = np.frombuffer("".join(unicodedata.category(chr(c))[0] for c in range(0x110000)).encode(), np.uint8)

    def spelt(kind: str) -> str:
        edge = np.flatnonzero(np.diff(np.concatenate([[0], kinds == ord(kind), [0]]).astype(np.int8)))
        return "".join(f"\\U{a:08x}-\\U{b - 1:08x}" for a, b in edge.reshape(-1, 2).tolist())

    letters, numbers, spaces = spelt("L"), spelt("N"), f" \n{RARE_SPACE}"
    return re.compile(f" ?[{letters}]+| ?[{numbers}]+|'s|'t|'re|'ve|'m|'ll|'d| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+")


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}


class Vocabulary:
    """A byte-level BPE vocabulary file of the tokenizers library."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        letters = byte_letters()
        model, self.path = spec["model"], path
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = added
        vocab = model["vocab"]
        self.bytes_of: dict[int, bytes] = {i: bytes(letters[c] for c in t) for t, i in vocab.items() if t not in added}
        self.bytes_of |= {i: t.encode() for t, i in added.items()}
        single = {bytes([letters[c]]): vocab[c] for c in letters if c in vocab}
        self.byte_id = np.array([single[bytes([b])] for b in range(256)], np.int32)
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        for r, m in enumerate(model["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.rank.setdefault((vocab[a], vocab[b]), (r, vocab[a + b]))
        self.bits = 19
        self._table()
        self.split = splitter()
        self.rare = re.compile(f"[{RARE_SPACE}]")
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
        self.texts = [str(i) for i in range(max(self.bytes_of) + 1)]

    def _table(self) -> None:
        """An open-addressed table of all pairs that merge, for lookups by the million."""
        n = 1 << self.bits
        self.pair, self.pair_rank, self.pair_new = np.full(n, -1, np.int64), np.full(n, NEVER, np.int32), np.zeros(n, np.int32)
        self.tries = 1
        for (a, b), (r, new) in self.rank.items():
            key, at = a << 20 | b, self._slot(a << 20 | b)
            tries = 1
            while self.pair[at] != -1:
                at, tries = (at + 1) % n, tries + 1
            self.pair[at], self.pair_rank[at], self.pair_new[at] = key, r, new
            self.tries = max(self.tries, tries)

    def _slot(self, key):
        return (key * 0x9E3779B1 >> 13) & ((1 << self.bits) - 1)

    def find(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 for pairs that don't merge."""
        key = a.astype(np.int64) << 20 | b
        at = self._slot(key)
        found = np.where(self.pair[at] == key, at, -1)
        open_ = (found < 0) & (self.pair[at] != -1)
        for k in range(1, self.tries):
            if not open_.any():
                break
            where = np.nonzero(open_)
            next_ = (at[where] + k) & ((1 << self.bits) - 1)
            same = self.pair[next_] == key[where]
            found[where] = np.where(same, next_, found[where])
            open_[where] = ~same & (self.pair[next_] != -1)
        return found

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        at = self.find(a, b)
        return np.where(at >= 0, self.pair_rank[at], NEVER)

    def merge_alike(self, cur: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(rows, their ids) for a matrix of byte ids, a word a row. Each round merges, in every word, the leftmost pair of the lowest rank."""
        row = np.arange(len(cur))
        rank = self.ranks(cur[:, :-1], cur[:, 1:])
        while len(row):
            if not rank.shape[1]:
                yield row, cur
                return
            k = np.arange(len(row))
            best = rank.argmin(1)
            go = rank[k, best] != NEVER
            if not go.all():
                yield row[~go], cur[~go]
                row, cur, rank, best = row[go], cur[go], rank[go], best[go]
                k = np.arange(len(row))
            cur[k, best] = self.pair_new[self.find(cur[k, best], cur[k, best + 1])]
            keep = np.ones(cur.shape, bool)
            keep[k, best + 1] = False
            cur = cur[keep].reshape(len(row), keep.shape[1] - 1)
            rank = rank[keep[:, 1:]].reshape(len(row), keep.shape[1] - 2)
            if rank.shape[1]:
                left, right = best > 0, best < rank.shape[1]
                i, p = k[left], best[left]
                rank[i, p - 1] = self.ranks(cur[i, p - 1], cur[i, p])
                i, p = k[right], best[right]
                rank[i, p] = self.ranks(cur[i, p], cur[i, p + 1])

    def merge_long(self, word: bytes) -> list[int]:
        """Ids of one long word, by a heap of pairs over a linked list."""
        ids = self.byte_id[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        left, right = [*range(-1, n - 1)], [*range(1, n), -1]
        heap = [(r[0], i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := self.rank.get((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = right[i] if ids[i] == a else -1
            if j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = self.rank[a, b][1], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            right[j] = -1
            for p in (left[i], i):
                q = right[p] if p >= 0 else -1
                if q >= 0 and (r := self.rank.get((ids[p], ids[q]))):
                    heapq.heappush(heap, (r[0], p, ids[p], ids[q]))
        return [i for i in ids if i >= 0]

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words on end, where each word's start and the last end) of non-empty words, by merging alone."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        flat, start = self.byte_id[np.frombuffer(b"".join(words), np.uint8)], np.cumsum(size) - size
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(size[size <= WIDE]).tolist():
            which = np.flatnonzero(size == n)
            found += [(which[row], ids) for row, ids in self.merge_alike(flat[start[which, None] + np.arange(n)])]
        found += [(np.array([k]), np.array([self.merge_long(words[k])])) for k in np.flatnonzero(size > WIDE).tolist()]
        count = np.zeros(len(words) + 1, np.int64)
        for which, ids in found:
            count[which + 1] = ids.shape[1]
        at = np.cumsum(count)
        out = np.empty(at[-1], np.int32)
        for which, ids in found:
            out[at[which, None] + np.arange(ids.shape[1])] = ids
        return out, at

    def words(self, text: str) -> list[str]:
        """The words of a text; special tokens stand for themselves."""
        if self.cut is None or not any(s in text for s in self.special):
            return self.split.findall(text)
        return [w for part in self.cut.split(text) for w in ([part] if part in self.special else self.split.findall(part))]

    def chunks(self, text: str) -> list[str]:
        """Pieces that split into the words of the text each by itself.

        A plain space between two characters that aren't white space always starts a word, so a text without other
        runs of white space is cut there, which is far cheaper than the split into words.
        """
        if "  " in text or " \n" in text or "\n " in text or text[:1] == " " or text[-1:] == " " or self.rare.search(text) or any(s in text for s in self.special):
            return self.words(text)
        out = text.replace(" ", "\0 ").split("\0") if "\0" not in text else self.words(text)
        return out if out != [""] else []


class Coder:
    """Encodes and decodes with a lexicon and a bounded memo of what the lexicon and the merges gave."""

    def __init__(self, vocabulary: Vocabulary, lexicon: automaton.Lexicon | None):
        self.vocabulary, self.lexicon = vocabulary, lexicon
        self.ids: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}

    def encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words on end, where each word's start and the last end): the lexicon's, else merged ones."""
        v, raw = self.vocabulary, [w.encode("utf-8", "surrogatepass") for w in words]
        rank = self.lexicon.ranks(raw) if self.lexicon is not None else np.full(len(raw), -1)
        own = [(k, v.special[w]) for k, w in enumerate(words) if w[:1] == "<" and w in v.special]
        rank[[k for k, _ in own]] = -2
        todo, known = np.flatnonzero(rank == -1), np.flatnonzero(rank >= 0)
        merged, start = v.merge([raw[k] for k in todo.tolist()])
        count = np.ones(len(words) + 1, np.int64)
        count[0] = 0
        count[todo + 1] = np.diff(start)
        if len(known):
            first = self.lexicon.offset[rank[known]].astype(np.int64)
            count[known + 1] = self.lexicon.offset[rank[known] + 1] - first
        at = np.cumsum(count)
        out = np.empty(at[-1], np.int32)
        out[at[[k for k, _ in own]]] = [i for _, i in own]
        out[spread(at[todo], count[todo + 1])] = merged
        if len(known):
            out[spread(at[known], count[known + 1])] = self.lexicon.ids[spread(first, count[known + 1])]
        return out, at

    def learn(self, new: list[str]) -> None:
        """Adds chunks to the memo, all at once: their ids, and what these decode to where that isn't the chunk itself."""
        v = self.vocabulary
        words, last = [], []
        for c in new:
            if plain(c) or c in v.special:
                words.append(c)
            else:
                words += v.split.findall(c)
            last.append(len(words))
        ids, at = self.encode(words)
        texts = list(map(v.texts.__getitem__, ids.tolist()))
        every = ",".join(texts)
        ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)[at[last] - 1].tolist()  # after each chunk's last comma
        begin = 0
        held = self.ids
        for c, end in zip(new, ends, strict=True):
            held[c] = every[begin : end - 1]
            begin = end
        raw = list(map(v.bytes_of.__getitem__, ids.tolist()))
        if b"".join(raw).decode("utf-8", "replace") != "".join(new):
            for c, i, j in zip(new, [0, *last], last, strict=False):
                if (decoded := b"".join(raw[at[i] : at[j]])) != c.encode("utf-8", "surrogatepass"):
                    self.raw[c] = decoded

    def run(self, texts: list[str]) -> Iterator[tuple[str, str]]:
        """For each text its ids, joined by commas, and the text that they decode to."""
        each = [self.vocabulary.chunks(t) for t in texts]
        if len(self.ids) > MEMO:
            self.ids.clear()
            self.raw.clear()
        new: set[str] = set()
        for chunks in each:
            new.update(chunks)
        if new := list(new.difference(self.ids)):
            self.learn(new)
        for text, chunks in zip(texts, each, strict=True):
            ids = ",".join(map(self.ids.__getitem__, chunks))
            yield ids, b"".join([self.raw.get(c) or c.encode() for c in chunks]).decode("utf-8", "replace") if self.raw else text


def plain(chunk: str) -> bool:
    """Whether a chunk is one word of letters, with or without the space before it."""
    return chunk.isalpha() or (chunk[0] == " " and chunk[1:].isalpha())


def spread(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for count places, of each pair on end."""
    end = np.cumsum(count)
    return np.arange(end[-1] if len(end) else 0) + np.repeat(start - end + count, count)


def groups(texts: Iterator[str | None], most: int = 500_000) -> Iterator[list[str]]:
    """Texts in lists of about that many characters; null counts as empty."""
    out, n = [], 0
    for t in texts:
        out.append(t or "")
        n += len(out[-1])
        if n >= most:
            yield out
            out, n = [], 0
    if out:
        yield out


_open: dict[tuple, object] = {}


def _once(key: tuple, make):
    """One object a worker: workers live on from task to task."""
    if key not in _open:
        for old in [k for k in _open if k[0] == key[0]]:
            del _open[old]
        _open[key] = make()
    return _open[key]


def _counts(vocab_path: str, most: int = MEMO):
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = _once(("vocabulary", vocab_path), lambda: Vocabulary(vocab_path))
        held: Counter[str] = Counter()

        def send() -> pa.RecordBatch:
            words: Counter[str] = Counter()
            for chunk, n in held.items():
                for w in (chunk,) if plain(chunk) else v.words(chunk):
                    words[w] += n
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.keys(), pa.string()), pa.array(words.values(), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text"):
                held.update(v.chunks(text.as_py() or ""))
                if len(held) > most:
                    yield send()
        yield send()
        give_back()

    return counts


def frequent_words(docs: DataFrame, vocab_path: str, text_col: str = "text", size: int = 50_000) -> list[str]:
    """The most frequent words of all texts, size of them at most."""
    counted = columns(docs, text=text_col).mapInArrow(_counts(vocab_path), "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    with scratch(docs.sparkSession):
        return most_frequent(counted.filter("n > 1"), size, "words").select("word").toArrow().column("word").to_pylist()


def compile_lexicon(docs: DataFrame, vocab_path: str, text_col: str = "text", size: int = 50_000) -> str:
    """Compiles the frequent words into a lexicon and gives it to all executors; its name there."""
    v = Vocabulary(vocab_path)
    words = sorted({w.encode() for w in frequent_words(docs, vocab_path, text_col, size)} - {s.encode() for s in v.special})
    context, jvm = docs.sparkSession.sparkContext, docs.sparkSession._jvm
    with tempfile.TemporaryDirectory() as own:  # the driver's; executors fetch the copy in the shared folder
        automaton.save(path := os.path.join(own, "lexicon"), words, *v.merge(words))
        with open(path, "rb") as f:
            name = f"lexicon-{base64.b32encode(hashlib.sha256(f.read()).digest()[:10]).decode().lower()}"
        if name not in {f.rsplit("/", 1)[-1] for f in context.listFiles}:  # the name tells the content
            shared = f"{shared_dir(docs.sparkSession)}/{RUN}/{name}"
            target = jvm.org.apache.hadoop.fs.Path(shared)
            store = target.getFileSystem(context._jsc.hadoopConfiguration())
            store.copyFromLocalFile(False, True, jvm.org.apache.hadoop.fs.Path(f"file://{path}"), target)
            context.addFile(store.makeQualified(target).toString())
    return name


def _coded(vocab_path: str, name: str, digests: bool):
    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Coder(_once(("vocabulary", vocab_path), lambda: Vocabulary(vocab_path)), automaton.Lexicon(SparkFiles.get(name)))
        for batch in batches:
            keep = [i for i, f in enumerate(batch.schema.names) if f != "text"]
            at = 0
            for group in groups(t.as_py() for t in batch.column("text")):  # ids take more room than their texts, so each group is sent on by itself
                n, ids, text = [], [], []
                for found, decoded in c.run(group):
                    n.append(found.count(",") + 1 if found else 0)
                    ids.append(hashlib.sha256(found.encode()).hexdigest() if digests else found)
                    text.append(hashlib.sha256(decoded.encode()).hexdigest() if digests else decoded)
                yield pa.RecordBatch.from_arrays([*[batch.column(i).slice(at, len(group)) for i in keep], pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(text, pa.string())], [*[batch.schema.names[i] for i in keep], "n_tokens", "ids", "decoded"])
                at += len(group)
        del c
        give_back()

    return coded


def encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", size: int = 50_000, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (decimal, joined by commas) and the text that they decode to; with digests, the SHA-256 of both.

    The lexicon holds at most size words, counted over all texts; it decides speed alone, never the result. Null text
    counts as empty and has no ids; repeated rows and null ids each give a row; an empty table gives an empty result.
    A special token's string in a text becomes its id. Only the two named columns are read.
    """
    name = compile_lexicon(docs, vocab_path, text_col, size)
    kind = docs.schema[id_col].dataType.simpleString()
    src = columns(docs, doc_id=id_col, text=text_col)
    return src.mapInArrow(_coded(vocab_path, name, digests), f"doc_id {kind}, n_tokens long, ids string, decoded string")

"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A forward algorithm sums over all ways to cut
a word into pieces; a text's score is the sum over its words. The probabilities are fitted by expectation-maximisation.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .bpe import groups
from .common import columns, give_back, scratch, written

#: Letters up to which the sums over a word's cuts need no scale: 1e-7 a letter at least stays within a double.
SHORT = 32
#: Letters of all words that are summed at a time, and different stretches without white space whose scores are kept.
BLOCK, MEMO = 50_000, 100_000
#: Fixed-point steps of the expected counts, so that their sums don't depend on the order of tasks.
STEPS = 1 << 24
FLOOR = 1e-7
BASE = np.uint64(0x9E3779B97F4A7C15)
LETTERS = re.compile(r"[^\W\d_]+")


def pieces(path: str) -> list[str]:
    """The vocabulary's pieces of lower-case letters, with or without the mark of a word's start. No other can be part of a word."""
    from sentencepiece import SentencePieceProcessor

    p = SentencePieceProcessor(model_file=path)
    found = {p.id_to_piece(i) for i in range(p.get_piece_size())}
    return sorted(x for x in found if x == x.lower() and (x == "▁" or x.removeprefix("▁").isalpha()))


def words_of(text: str) -> list[str]:
    """Runs of letters, in lower case."""
    return LETTERS.findall(text.lower())


def _hashes(m: np.ndarray, n: int) -> np.ndarray:
    """Of every run of n columns of each row."""
    h = np.zeros((m.shape[0], m.shape[1] - n + 1), np.uint64)
    for k in range(n):
        h = (h + m[:, k : m.shape[1] - n + 1 + k].astype(np.uint64) + np.uint64(1)) * BASE
        h ^= h >> np.uint64(29)
    return h


@dataclass
class Model:
    """langs, sorted; per length of piece, sorted hashes and the pieces' places; p[piece, lang], its last two rows 0 and the floor."""

    langs: list[str]
    table: dict[int, tuple[np.ndarray, np.ndarray]]
    p: np.ndarray

    @classmethod
    def blank(cls, vocabulary: list[str], langs: list[str]) -> Model:
        """Every piece as likely as any other."""
        table = {}
        for n in sorted({*map(len, vocabulary)}):
            own = [(x, k) for k, x in enumerate(vocabulary) if len(x) == n]
            h = _hashes(np.array([[ord(c) for c in x] for x, _ in own], np.uint32), n)[:, 0]
            order = np.argsort(h)
            table[n] = h[order], np.array([k for _, k in own], np.int32)[order]
        p = np.full((len(vocabulary) + 2, len(langs)), 1 / max(1, len(vocabulary)))
        p[-2], p[-1] = 0, FLOOR
        return cls(langs, table, p)

    def places(self, m: np.ndarray) -> dict[int, np.ndarray]:
        """For each length n, the piece at every start in each row of letters; the row of zeros where there is none, of the floor for a lone letter."""
        none = len(self.p) - 2
        out = {}
        for n, (h, k) in self.table.items():
            if n <= m.shape[1]:
                x = _hashes(m, n)
                at = np.minimum(np.searchsorted(h, x), len(h) - 1)
                out[n] = np.where(h[at] == x, k[at], none + (n == 1))
        if 1 not in out and m.shape[1]:
            out[1] = np.full(m.shape, none + 1)
        return out

    def forward(self, at: dict[int, np.ndarray], rows: int, size: int) -> np.ndarray:
        """alpha[position, word, lang]: the sum over all cuts of the letters before the position."""
        a = np.zeros((size + 1, rows, len(self.langs)))
        a[0] = 1
        for i in range(1, size + 1):
            for n, piece in at.items():
                if n <= i:
                    a[i] += a[i - n] * self.p[piece[:, i - n]]
        return a

    def long_forward(self, letters: np.ndarray, keep: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """log of the sum over all cuts of one word of any length, letter by letter on a scale of its own, with the last
        sums alone in memory; keep: the scaled sums of every position and the log of their scales too."""
        size, widest, langs = len(letters), max([1, *self.table]), len(self.langs)
        last = np.zeros((widest, langs))  # the sums at the positions before, the latest first
        last[0] = 1
        log = np.zeros(langs)
        every, scale = (np.zeros((size + 1, langs)), np.zeros((size + 1, langs))) if keep else (last, log)
        if keep:
            every[0] = 1
        reach = np.arange(1, widest + 1)
        for at in range(0, size, 4096):
            begin = max(0, at - widest + 1)
            found = self.places(letters[None, begin : at + 4096])
            ends = np.full((widest, min(4096, size - at)), len(self.p) - 2)  # the piece of each length that ends at each letter
            for n, piece in found.items():
                first = at - n + 1 - begin  # where it starts
                from_ = max(0, -first)
                own = piece[0, max(0, first) : max(0, first + ends.shape[1])]
                ends[n - 1, from_ : from_ + len(own)] = own
            for k in range(ends.shape[1]):
                now = (last * self.p[ends[reach - 1, k]]).sum(0)
                now = np.maximum(now, 1e-290)
                last = np.concatenate([now[None], last[:-1]]) / now
                log = log + np.log(now)
                if keep:
                    every[at + k + 1], scale[at + k + 1] = 1, log
        return log, every, scale

    def expect(self, m: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """How often each piece is used, over all cuts of words that occur weight[word, lang] times."""
        rows, size = m.shape
        at = self.places(m)
        if size > SHORT:
            return sum((self._long_expect(m[r], weight[r]) for r in range(rows)), np.zeros_like(self.p))
        a = self.forward(at, rows, size)
        b = np.zeros_like(a)
        b[size] = weight / np.maximum(a[size], 1e-290)
        for i in range(size - 1, -1, -1):
            for n, piece in at.items():
                if i + n <= size:
                    b[i] += self.p[piece[:, i]] * b[i + n]
        out = np.zeros_like(self.p)
        for n, piece in at.items():
            for i in range(size - n + 1):
                used = a[i] * self.p[piece[:, i]] * b[i + n]
                for lang in range(len(self.langs)):
                    out[:, lang] += np.bincount(piece[:, i], used[:, lang], len(out))
        return out

    def _long_expect(self, letters: np.ndarray, weight: np.ndarray) -> np.ndarray:
        """The same of one long word: sums after a position are kept relative to the sums before it, so that their product is the share of cuts there."""
        size = len(letters)
        _, _, scale = self.long_forward(letters, keep=True)
        at = self.places(letters[None])
        out = np.zeros_like(self.p)
        share = np.zeros((size + 1, len(self.langs)))  # the weight of all cuts that part the word at each position
        share[size] = weight
        for j in range(size, 0, -1):
            for n, piece in at.items():
                if n <= j:
                    k = piece[0, j - n]
                    used = share[j] * self.p[k] * np.exp(scale[j - n] - scale[j])
                    share[j - n] += used
                    out[k] += used
        return out

    def score(self, words: list[str]) -> np.ndarray:
        """log p[word, lang], summed over all cuts."""
        out = np.empty((len(words), len(self.langs)))
        for which, m in _alike(words):
            if m.shape[1] > SHORT:
                out[which] = [self.long_forward(r)[0] for r in m]
            else:
                out[which] = np.log(np.maximum(self.forward(self.places(m), *m.shape)[-1], 1e-290))
        return out


def _alike(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Words of a length together: their places and their letters after the mark of a start."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    letters = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    start = np.cumsum(size) - size
    for n in np.unique(size).tolist():
        which = np.flatnonzero(size == n)
        for part in np.array_split(which, -(-len(which) * (n + 1) // BLOCK)):
            if len(part):
                m = np.full((len(part), n + 1), ord("▁"), np.uint32)
                m[:, 1:] = letters[start[part, None] + np.arange(n)]
                yield part, m


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter[tuple[str, str]] = Counter()

    def rows() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([a for a, _ in held], pa.string()), pa.array([b for _, b in held], pa.string()), pa.array(held.values(), pa.int64())], ["lang", "word", "n"])
        held.clear()
        return out

    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            held.update((lang, w) for w in words_of(text.as_py() or ""))
            if len(held) > 500_000:
                yield rows()
    yield rows()


def _expected(model: Model):
    """Of counted words, the expected uses of every piece in each language, in fixed-point steps."""

    def expected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        used = np.zeros_like(model.p)
        place = {x: k for k, x in enumerate(model.langs)}
        for batch in batches:
            found, at = np.unique(np.array(batch.column("word").to_pylist(), object), return_inverse=True)
            weight = np.zeros((len(found), len(model.langs)))
            np.add.at(weight, (at, [place[x] for x in batch.column("lang").to_pylist()]), batch.column("n").to_numpy())
            for which, m in _alike(found.tolist()):
                used += model.expect(m, weight[which])
        piece, lang = np.nonzero(used)
        steps = np.rint(used[piece, lang] * STEPS).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(steps)], ["piece", "lang", "used"])

    return expected


def held_out(doc_id: Column) -> Column:
    """Rows that nothing is learned from; a null id is not one of them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = 500, rounds: int = 4) -> Model:
    """Fits the model on a bounded sample: of each language the given number of rows with the lowest hashes of their id,
    with all words of their whole texts. Rows that are held out, and those without a language, teach nothing; repeated
    rows teach once. The driver holds the model alone: a row for each piece and language."""
    src = columns(docs, lang=F.col(lang_col).cast("string"), text=text_col, held=held_out(F.col(id_col)), hash=F.xxhash64(F.col(id_col).cast("string"))).filter("not held and lang is not null and text is not null").drop("held")
    size = src.groupBy("lang").agg(F.count(F.lit(1)).alias("rows"))
    # Rows of low hashes, about twice as many as are wanted, are ranked; every row of a small language is.
    share = F.pmod(F.xxhash64(F.lit(11), "hash"), F.lit(1 << 30)) / (1 << 30)
    some = src.join(F.broadcast(size), "lang").filter(share * F.col("rows") < 2 * texts + 100)  # a row for each language
    keys = some.select("lang", "hash", F.xxhash64("text").alias("same")).distinct()
    first = keys.withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64(F.lit(11), "hash"), "same"))).filter(F.col("r") <= texts).drop("r")
    sample = some.withColumn("same", F.xxhash64("text")).join(F.broadcast(first), ["lang", "hash", "same"]).groupBy("lang", "hash", "same").agg(F.first("text").alias("text"))
    model = Model.blank(pieces(vocab_path), sorted(r.lang for r in size.collect()))
    with scratch(docs.sparkSession):
        counted = written(sample.select("lang", "text").mapInArrow(_count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
        for _ in range(rounds if model.langs else 0):
            found = counted.mapInArrow(_expected(model), "piece int, lang int, used long").groupBy("piece", "lang").agg(F.sum("used").alias("used")).toArrow()
            used = np.full_like(model.p, 0.02)
            used[found.column("piece").to_numpy(), found.column("lang").to_numpy()] += found.column("used").to_numpy() / STEPS
            model.p[:-2] = used[:-2] / used[:-2].sum(0)
            model.p[-2], model.p[-1] = 0, FLOOR
    return model


class Scorer:
    """Scores texts; what is between white space is scored once and kept in a bounded memo."""

    def __init__(self, model: Model):
        self.model, self.at, self.rows = model, {}, np.zeros((0, len(model.langs)))

    def learn(self, new: list[str]) -> None:
        each = [words_of(c) for c in new]
        words = list({w for x in each for w in x})
        place = {w: k for k, w in enumerate(words)}
        score = np.vstack([self.model.score(words), np.zeros((1, len(self.model.langs)))])
        flat = np.array([place[w] for x in each for w in (x or [""]) if x] or [], np.int64)
        count = np.array([len(x) for x in each])
        add = np.zeros((len(new), len(self.model.langs)))
        some = np.flatnonzero(count)
        if len(some):
            add[some] = np.add.reduceat(score[flat], (np.cumsum(count) - count)[some])
        self.at.update(zip(new, range(len(self.rows), len(self.rows) + len(new)), strict=True))
        self.rows = np.vstack([self.rows, add])

    def run(self, texts: list[str]) -> Iterator[tuple[str, float]]:
        """The language and its posterior under equal priors; und without letters."""
        each = [t.split() for t in texts]
        if len(self.at) > MEMO:
            self.at, self.rows = {}, self.rows[:0]
        new: set[str] = set()
        for chunks in each:
            new.update(chunks)
        if new := list(new.difference(self.at)):
            self.learn(new)
        for text, chunks in zip(texts, each, strict=True):
            if not self.model.langs or not any(map(str.isalpha, text)):
                yield "und", 0.0
                continue
            total = self.rows[np.fromiter(map(self.at.__getitem__, chunks), np.int64, len(chunks))].sum(0)
            best = int(total.argmax())
            yield self.model.langs[best], float(1 / np.exp(total - total[best]).sum())


def _told(model: Model) -> Column:
    """A function of a column of texts: lang_pred and score. Texts are sent once and stay on Spark's side; only these two come back."""

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def told(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(model)
        for batch in batches:
            found = [x for g in groups(t.as_py() for t in batch) for x in scorer.run(g)]
            yield pa.StructArray.from_arrays([pa.array([a for a, _ in found], pa.string()), pa.array([b for _, b in found], pa.float64())], ["lang_pred", "score"])
        del scorer
        give_back()

    return told


def identify(docs: DataFrame, vocab_path: str, model: Model | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred and score, one row per row of docs, predicted from the whole text alone.

    A text's words are its runs of letters, of any length, and their pieces all of the vocabulary that consist of letters.
    Null texts and those without a letter are und with score 0, as are all texts if no language could be learned. Ties
    go to the language that sorts first. Null ids are not held out. Repeated rows each give a row; only the named
    columns are read. The model's size depends on the vocabulary and the number of languages.
    """
    model = model or fit(docs, vocab_path, id_col, text_col, lang_col)
    src = columns(docs, doc_id=id_col, held_out=held_out(F.col(f"`{id_col}`")), text=text_col)
    return src.select("doc_id", "held_out", _told(model)("text").alias("told")).select("doc_id", "held_out", "told.lang_pred", "told.score")


def accepted(docs: DataFrame, vocab_path: str, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs, with all their columns, whose language is told with the least score; the others are rejected.

    Null texts, texts without a letter and, if no language could be learned, all texts are rejected. A score of exactly
    `least` stays. Repeated rows each stay or go alike. An empty table gives an empty one.
    """
    told = _told(fit(docs, vocab_path, id_col, text_col, lang_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{text_col}`").alias("text")).select("row", told("text").alias("told"))
    return rows.filter((F.col("told.lang_pred") != "und") & (F.col("told.score") >= least)).select("row.*")

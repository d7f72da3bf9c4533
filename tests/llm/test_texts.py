import hashlib
import os
import random
import re
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from quire.llm import automaton, boosting, bpe, langid, linededup, mixing, ngramjoin, pii, secrets, sharding
from quire.llm.catalog import BYTE_BPE, PIECES, WEIGHTS, levels

from .helpers import SCHEMA, awkward, shingle_set, smallest_linked, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(awkward(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# ------------------------------------------------------------------ mixing


def test_budget_goes_to_siblings_before_ancestors():
    leaves = {("a", "x"): 10, ("a", "y"): 1000, ("b", "x"): 1000}
    got = mixing.leaf_budgets(leaves, {}, 400, 1)
    assert got == {("a", "x"): 10, ("a", "y"): 190, ("b", "x"): 200}
    assert mixing.leaf_budgets({("a", "x"): 10, ("b", "x"): 1000}, {}, 400, 2) == {("a", "x"): 20, ("b", "x"): 380}
    assert mixing.leaf_budgets({}, {}, 400, 1) == {}


def test_mixing_against_brute_force(spark, docs, none):
    got = mixing.mix(docs, levels(), WEIGHTS, share=0.5, epochs=2)
    assert got.select("row.*").columns == docs.columns
    rows = got.collect()
    total = Counter()
    for r in docs.select("lang", "source", mixing.domain_of(docs.source).alias("d"), mixing.tokens_of(docs.text).alias("t")).collect():
        total[r.d, r.lang or "", r.source or ""] += r.t
    plan = mixing.leaf_budgets(total, WEIGHTS, sum(total.values()) // 2, 2)
    used, given = Counter(), {}
    for r in rows:
        used[tuple(r.path)] += r.tokens * r.copies
        given[tuple(r.path)] = r.given
        assert 1 <= r.copies <= 2 and r.budget == plan[tuple(r.path)]
    every = docs.select(docs.doc_id, docs.text, mixing.domain_of(docs.source).alias("d"), docs.lang, docs.source, mixing.tokens_of(docs.text).alias("t"), *[F_hash(docs, e) for e in range(2)]).collect()
    for path, b in plan.items():
        epoch = b // total[path] if total[path] else 0
        own = sorted((r for r in every if (r.d, r.lang or "", r.source or "") == path), key=lambda r: (r[f"h{min(epoch, 1)}"] % 2**64, r.doc_id is None, r.doc_id or 0))
        rest, want = b % total[path] if total[path] else 0, (b // total[path] if total[path] else 0) * total[path]
        sofar = 0
        for r in own:
            sofar += r.t
            if sofar > rest:
                break
            want += r.t
        assert used[path] == want and given.get(path, want) == want
    assert mixing.mix(none, levels(), WEIGHTS).count() == 0


def F_hash(docs, epoch):
    from pyspark.sql import functions as F

    return F.xxhash64(F.lit(17), F.lit(epoch).cast("long"), docs.doc_id.cast("string")).alias(f"h{epoch}")


def test_epochs_have_orders_of_their_own(spark):
    """Of two leaves with the same ids, one gives a half of its first epoch and one all of it and half of a second."""
    docs = spark.createDataFrame([(k, "a b", lang) for k in range(200) for lang in ("x", "y")], "doc_id long, text string, lang string")
    got = mixing.mix(docs, {"lang": docs.lang}, {("x",): 1, ("y",): 3}, share=1.0, epochs=2, seed=3).collect()
    first = {r.row.doc_id for r in got if r.path == ["x"]}
    second = {r.row.doc_id for r in got if r.path == ["y"] and r.copies == 2}
    assert len(first) == len(second) == 100 and len(first & second) < 80
    assert {r.row.doc_id for r in got if r.path == ["y"]} == {*range(200)} and {r.given for r in got} == {200, 600}


def test_equal_rows_are_taken_together(spark):
    docs = spark.createDataFrame([(1, "a b c", "x")] * 5 + [(2, "d", "x"), (3, "", "x"), (4, None, "x")], "doc_id long, text string, lang string")
    for share in (0.1, 0.5, 0.9, 1.0):
        got = mixing.mix(docs, {"lang": docs.lang}, {}, share=share, epochs=1).collect()
        assert sum(r.row.doc_id == 1 for r in got) in (0, 5) and sum(r.tokens for r in got) <= 16 * share
        assert all(r.given == sum(x.tokens for x in got) for r in got)


# ------------------------------------------------------------------ personal data


def luhn(s):
    d = [int(c) for c in reversed(s)]
    return sum(x if k % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for k, x in enumerate(d)) % 10 == 0


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
]


def personal(text):
    return [(k, m.start(), m.end()) for k, p, ok in PII for m in re.finditer(p, text) if ok(m.group())]


def noisy(rng):
    bits = ["a.b@c.de", "x@y", "@", "a@b.c_d@e.f-g.hh", "1.2.3.4.5.6.7.8", "256.1.1.1", "010.000.0.255", "4111 1111-1111 1111", "4111  1111 1111 1111", "4111111111111111", "41111111111111111111111", "+1 (202) 555-0100", "+12", "+1....2", "+123456789", "é😀", "٣٤", "\n", " ", "-", ".", "0", "7"]
    return "".join(rng.choice(bits) + rng.choice(["", " ", "-", "x"]) for _ in range(rng.randint(1, 40)))


def test_personal_data_against_brute_force(spark, docs, none):
    rng = random.Random(5)
    rows = [(k, noisy(rng)) for k in range(300)] + [(900, None), (901, ""), (902, "1 " * 20_000), (903, "9" * 50_000), (904, "a" * 50_000 + "@b.c"), (905, "1." * 10_000), (None, "a@b.cd")]
    got = pii.digest(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for k, text in rows:
        want = personal(text or "")
        assert by[k].base_sha256 == hashlib.sha256(",".join("%s:%d:%d" % x for x in want).encode()).hexdigest(), text
        assert [by[k][f"n_{n}"] for n, _, _ in PII] == [sum(x[0] == n for x in want) for n, _, _ in PII]
        assert {"%s:%d:%d" % x for x in want} <= set(by[k].spans.split(","))
    assert pii.digest(pii.find_personal_data(none)).count() == 0
    assert pii.find_personal_data(docs).count() == docs.count()


def test_written_out_addresses_are_added(spark):
    rows = [(k, f"write to name{k} (at) host{k} (dot) example for more") for k in range(20)] + [(k, f"mail user{k}@host.example now") for k in range(20, 60)] + [(k, "we met at noon. then nothing happened") for k in range(60, 90)]
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert all(got[k].n_added == 1 for k in range(20)) and all(got[k].n_added == 0 for k in range(20, 90))


def test_boosting_learns_a_pattern():
    counts = {b: (10, 10 if b & 1 and not b & 4 else 0) for b in range(8)}
    trees = boosting.train(counts, 3)
    least = boosting.threshold(counts, trees, 0.9)
    assert all((round(boosting.value(trees, b), 9) >= least) == bool(b & 1 and not b & 4) for b in range(8))
    assert boosting.threshold({0: (5, 0)}, [], 0.9) == float("inf")


# ------------------------------------------------------------------ BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(BYTE_BPE)


def test_automaton_is_minimal_and_exact(tmp_path):
    w = sorted({b"", b"stop", b"top", b"tops", b"stops", b"x" * 300, "é".encode()})
    ids = [list(range(k, 2 * k)) for k in range(len(w))]
    automaton.save(str(tmp_path / "a"), w, np.concatenate(ids).astype(np.int32), np.cumsum([0, *map(len, ids)]))
    a = automaton.Lexicon(str(tmp_path / "a"))
    rank = a.ranks([*w, b"sto", b"topsy", b"\xff"]).tolist()
    assert rank == [*range(len(w)), -1, -1, -1]
    assert [a.ids[a.offset[r] : a.offset[r + 1]].tolist() for r in rank[: len(w)]] == ids
    right = lambda word: frozenset(x[len(word) :] for x in w if x.startswith(word))
    assert len(a.end) == len({right(x[:k]) for x in w for k in range(len(x) + 1)})
    automaton.save(str(tmp_path / "none"), [], np.empty(0, np.int32), np.zeros(1))
    assert automaton.Lexicon(str(tmp_path / "none")).ranks([b"a", b""]).tolist() == [-1, -1]


def test_merges_agree_with_the_library(vocabulary):
    library = Tokenizer.from_file(BYTE_BPE)
    rng = random.Random(2)
    texts = [r[1] or "" for r in awkward()] + ["".join(rng.choice(["a", "the", " ", "  ", "\n", "'s", "é", "😀", "1", "!", "\t", "　", "²", "ß", "\0", "<|endoftext|>", "ing", "\x1c"]) for _ in range(rng.randint(0, 60))) for _ in range(2000)]
    coder = bpe.Coder(vocabulary, None)
    for text, (ids, decoded) in zip(texts, coder.run(texts), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want)), text
        assert decoded == library.decode(want, skip_special_tokens=False)


def test_encoding_of_a_table(docs, none):
    library = Tokenizer.from_file(BYTE_BPE)
    got = {r.doc_id: r for r in bpe.encode(docs, BYTE_BPE, size=300).collect()}
    for r in docs.collect():
        want = library.encode(r.text or "", add_special_tokens=False).ids
        assert (got[r.doc_id].n_tokens, got[r.doc_id].ids, got[r.doc_id].decoded) == (len(want), ",".join(map(str, want)), library.decode(want, skip_special_tokens=False))
    assert bpe.encode(none, BYTE_BPE).count() == 0


# ------------------------------------------------------------------ line dedup


def test_patience_finds_common_lines():
    rng = random.Random(4)
    assert linededup.patience([1, 2, 3], [1, 2, 3]) == [(0, 0), (1, 1), (2, 2)]
    assert linededup.patience([9, 1, 2], [1, 2, 8]) == [(1, 0), (2, 1)]
    assert linededup.patience([5, 5, 5], [7, 5, 5]) == [(1, 1), (2, 2)]
    for _ in range(300):
        a, b = ([rng.randint(0, 9) for _ in range(rng.randint(0, 15))] for _ in range(2))
        found = linededup.patience(a, b)
        assert all(a[i] == b[j] for i, j in found)
        assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(found, found[1:], strict=False))
        assert found or not set(a) & set(b)


def test_blocks_are_deleted_from_the_later_document(spark, docs, none):
    passage = "\n".join(f"line {k} of a passage that many share" for k in range(3))
    rows = [(3, f"own start of three\n{passage}\nend of three"), (1, f"first has other words\n{passage}"), (2, passage), (4, "short\nown words of the fourth"), (5, "short\nquite different"), (6, None), (7, "")] + [(100 + k, f"start {k} is like no other\n{passage}\nend {k} too") for k in range(12)]
    got = {r.doc_id: r for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).select("row.*").collect()}
    assert got[1].text == rows[1][1] and got[2].text == "" and got[3].text == "own start of three\nend of three"
    assert got[4].text == rows[3][1] and got[5].text == rows[4][1] and got[6].text is None and got[7].text == ""
    assert all(got[100 + k].text == f"start {k} is like no other\nend {k} too" for k in range(12))
    found = linededup.dedup_lines(docs)
    assert found.select("row.*").columns == docs.columns and found.count() == docs.count()
    assert {r.doc_id: r.text for r in found.select("row.*").collect()}[41] == ""  # a copy of document 1
    assert linededup.dedup_lines(none).count() == 0


# ------------------------------------------------------------------ sharding


def test_shards_are_minimax(spark, docs, none):
    rows = sharding.shard(docs, 4).collect()
    assert len(rows) == docs.count()
    texts = [(r.text, len((r.text or "").encode()) + 1) for r in docs.collect()]
    size = Counter()
    for t, n in texts:
        size["" if t is None else hashlib.sha256(t.encode()).hexdigest()] += n
    ordered = [size[d] for d in sorted(size)]

    def fits(c):
        n, left = 1, c
        for s in ordered:
            if s > c:
                return False
            if s > left:
                n, left = n + 1, c
            left -= s
        return n <= 4

    best = next(c for c in range(max(ordered), sum(ordered) + 1) if fits(c))
    by = Counter()
    for r in rows:
        by[r.shard] += r["size"]
    assert max(by.values()) == best and set(by) <= {0, 1, 2, 3}
    for s in by:
        assert sorted(r.slot for r in rows if r.shard == s) == [*range(sum(r.shard == s for r in rows))]
    where = {}
    for r in rows:
        where.setdefault((r["size"], r.text_crc32), set()).add(r.shard)
    assert all(len(x) == 1 for k, x in where.items() if k[0] > 1)
    assert sharding.shard(none).count() == 0


# ------------------------------------------------------------------ languages


def test_forward_sums_all_segmentations():
    m = langid.Model.blank(["▁", "a", "b", "ab", "▁a", "▁ab", "ba"], ["x"])
    m.p[:-2, 0] = [0.1, 0.2, 0.3, 0.05, 0.07, 0.02, 0.01]
    m.p[-1] = 1e-7
    p = dict(zip(["▁", "a", "b", "ab", "▁a", "▁ab", "ba"], m.p[:-2, 0], strict=True))

    def total(s):
        return 1.0 if not s else sum(p.get(s[:k], 1e-7 if k == 1 else 0) * total(s[k:]) for k in range(1, len(s) + 1))

    for w in ("a", "ab", "abba", "bab", "aé"):
        assert m.score([w])[0, 0] == pytest.approx(np.log(total("▁" + w)))


def test_words_of_any_length_are_summed_whole():
    vocabulary = ["▁", "a", "b", "ab", "▁a", "ba", "bbab" * 5]
    m = langid.Model.blank(vocabulary, ["x", "y"])
    m.p[:-2] = np.random.default_rng(1).random((7, 2)) / 4
    for word in ("abba", "bbab" * 7, "é" * 40, "ab" * 3000):
        letters = "▁" + word
        sums, scale = [np.ones(2)], 0.0
        for i in range(1, len(letters) + 1):
            now = sum((sums[i - n] * (m.p[vocabulary.index(x)] if (x := letters[i - n : i]) in vocabulary else 1e-7 if n == 1 else 0) for n in range(1, min(i, 20) + 1)), np.zeros(2))
            sums.append(now)
            if now.min() < 1e-100:
                sums[-21:] = [x / now for x in sums[-21:]]
                scale = scale + np.log(now)
        assert m.score([word])[0] == pytest.approx(np.log(sums[-1]) + scale, rel=1e-9)
    word, weight = np.array([[ord(c) for c in "▁abbabbabab"]], np.uint32), np.array([[2.0, 3.0]])
    assert np.allclose(m.expect(word, weight), m._long_expect(word[0], weight[0]))


def by_enumeration(vocabulary, langs, rows, rounds):
    """The model's piece probabilities, with every cut of every word listed."""
    known = {*vocabulary}

    def cuts(w):
        if not w:
            yield ()
        for k in range(1, len(w) + 1):
            if w[:k] in known or k == 1:
                yield from ((w[:k], *rest) for rest in cuts(w[k:]))

    p = {lang: dict.fromkeys(vocabulary, 1 / len(vocabulary)) for lang in langs}
    of = lambda lang, c: np.prod([p[lang].get(x, 1e-7) for x in c])
    for _ in range(rounds):
        for lang in langs:
            used = dict.fromkeys(vocabulary, 0.02)
            for w in (w for own, text in rows if own == lang for w in re.findall(r"[^\W\d_]+", text.lower())):
                each = [(c, of(lang, c)) for c in cuts("▁" + w)]
                for c, x in each:
                    for piece in c:
                        if piece in known:
                            used[piece] += x / sum(y for _, y in each)
            p[lang] = {x: n / sum(used.values()) for x, n in used.items()}
    return lambda text: {lang: sum(np.log(sum(of(lang, c) for c in cuts("▁" + w))) for w in re.findall(r"[^\W\d_]+", text.lower())) for lang in langs}


def test_identify_against_enumeration(spark, monkeypatch):
    vocabulary = ["▁", "a", "b", "c", "ab", "▁a", "ba", "▁ca", "bc"]
    monkeypatch.setattr(langid, "pieces", lambda path: vocabulary)
    rng = random.Random(3)
    word = {"xx": "aab", "yy": "bbc"}
    rows = [(k, " ".join("".join(rng.choice(word[lang] + "abc") for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 6))), lang) for k in range(60) for lang in [rng.choice(["xx", "yy"])]]
    rows += [(60, "ABBA d1é, cab", None), (61, None, "xx"), (62, "1 2", "yy"), (None, "ab", "yy"), (0, rows[0][1], rows[0][2])]
    found = langid.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3), "none").collect()
    assert len(found) == len(rows)
    out = {str(r.doc_id): r.held_out for r in found}
    fitted = {(i, lang, t) for i, t, lang in rows if lang and t and not out[str(i)]}
    score = by_enumeration(vocabulary, ["xx", "yy"], [(lang, t) for _, lang, t in fitted], 4)
    by = {str(r.doc_id): r for r in found}
    for i, text, _ in rows:
        if not any(map(str.isalpha, text or "")):
            assert (by[str(i)].lang_pred, by[str(i)].score) == ("und", 0.0)
            continue
        s = score(text)
        best = max(s, key=s.get)
        assert by[str(i)].lang_pred == best and by[str(i)].score == pytest.approx(1 / sum(np.exp(x - s[best]) for x in s.values()), abs=1e-4)


def test_languages_on_held_out_rows(spark, none):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs, PIECES).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert len(got) > 200 and sum(r.lang == r.lang_pred for r in got) / len(got) > 0.97
    assert all(0 <= r.score <= 1 for r in got)
    assert langid.identify(none, PIECES).count() == 0


def test_languages_of_awkward_rows(docs):
    got = {r.doc_id: r for r in langid.identify(docs, PIECES).collect()}
    assert [got[k].lang_pred for k in (500, 501, 502, 503)] == ["und"] * 4
    assert got[504].lang_pred in ("en", "de", "fr") and got[None].held_out is False
    kept = langid.accepted(docs, PIECES)
    assert langid.accepted(docs.limit(0), PIECES).count() == 0 and kept.filter("doc_id = 0").count() == 3  # repeated rows go alike
    assert kept.columns == docs.columns and not {500, 501, 502, 503} & {r.doc_id for r in kept.collect()}


# ------------------------------------------------------------------ n-gram join


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80)])
def test_jaccard_groups_against_brute_force(spark, docs, size, percent):
    rng = random.Random(8)
    rows = [(r.doc_id, r.text) for r in docs.collect() if r.doc_id is not None]
    base = words(rng, 90).split(" ")
    for k in range(40):  # a chain: each differs from the next by a little, so that the ends don't link
        base = base[:]
        base[rng.randrange(90)] = f"new{k}"
        rows.append((1000 + k, " ".join(base)))
    common = words(rng, 60)
    rows += [(2000 + k, f"{words(rng, rng.randint(20, 60))} {common}") for k in range(30)]  # unrelated but for a passage
    base = words(rng, 60).split(" ")  # near copies of one text that mostly miss the threshold among themselves
    for k in range(120):
        own = base[:]
        for at in rng.sample(range(60), 2):
            own[at] = f"odd{k}"
        rows.append((3000 + k, " ".join(own)))
    sets = [(k, shingle_set(t, size)) for k, t in rows]
    linked = [(a, b) for i, (a, x) in enumerate(sets) for b, y in sets[:i] if x and y and 100 * len(x & y) >= percent * len(x | y)]
    want = smallest_linked({k for k, _ in sets}, linked)
    got = ngramjoin.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), size, percent).collect()
    assert len(got) == len(rows)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == {k: (len(s), want[k]) for k, s in sets}


def test_one_of_each_group_stays(docs, none):
    kept = ngramjoin.one_of_each(docs)
    assert kept.columns == docs.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert len(ids) == len(set(ids)) and {0, 1, 500, 501, 506} <= set(ids) and 507 not in ids and not {40, 41, 42} & set(ids)
    assert kept.filter("doc_id is null").count() == 1
    assert ngramjoin.jaccard_groups(none).count() == 0


# ------------------------------------------------------------------ secrets


def test_secrets_against_brute_force(spark, docs, none):
    rng = random.Random(6)
    bits = ["password=hunter22x", "TOKEN : 'abc.def/ghi'", "api_key=", "apikey=short", "AKIA" + "Q7" * 8, "AKIA12", "deadbeef" * 4, "secret", "=", "é😀", "9f" * 11, " ", "\n", 'token="', "passwd=passwd=xyzzy1", "tokenſ=abcdefg"]
    rows = [(k, "".join(rng.choice(bits) + rng.choice(["", " "]) for _ in range(rng.randint(0, 15))), f"s{k % 5}") for k in range(200)]
    rows += [(900, None, None), (901, "z" * 50_000, "s1"), (None, "password=abcdefgh", "s0")]
    plain = [(re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m.group(2)) >= 6), (re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m.group()) >= 20), (re.compile("[0-9a-f]+"), lambda m: len(m.group()) >= 24)]
    got = secrets.digest(secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string"))).collect()
    by = {r.doc_id: r for r in got}
    assert len(got) == len(rows)
    for k, text, _ in rows:
        want = sorted((m.start(), n, m.end()) for n, (p, ok) in enumerate(plain) for m in p.finditer(text or "") if ok(m))
        assert by[k].base_sha256 == hashlib.sha256(",".join(f"{secrets.KINDS[n]}:{a}:{b}" for a, n, b in want).encode()).hexdigest()
        assert [by[k][f"n_{x}"] for x in secrets.KINDS[:3]] == [sum(w[1] == n for w in want) for n in range(3)]
    assert secrets.digest(secrets.scan_secrets(docs)).count() == docs.count()
    assert secrets.scan_secrets(none).count() == 0


def test_ownership_tells_examples_from_live_credentials(spark):
    shared, own = "k3yZq81mNb5vCx2LwEr7TyU9", "Xy7pQ92rTzKm4NsD8fGhJ3LaB"
    rows = [(k, f"use {shared} here", f"s{k}") for k in range(5)] + [(10, f"ours is {own} now", "s1"), (11, f"and {own} again", "s1")]
    got = {r.doc_id: r.spans for r in secrets.scan_secrets(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert all(not got[k] for k in range(5))
    assert [(s.owners, s.repos, s.live) for s in got[10]] == [(1, 2, True)]


def test_lexicon_needs_no_file_of_ours():
    assert not [f for _, _, names in os.walk(os.path.dirname(bpe.__file__)) for f in names if f.endswith((".json", ".model", ".tiktoken"))]


def test_numbers_that_run_into_one_another_are_added(spark):
    """No rule keeps them, but they look like those that rules confirm elsewhere; numbers that no rule confirms stay out."""
    rng = random.Random(11)

    def card():
        d = [rng.randint(0, 9) for _ in range(15)]
        return next("".join(map(str, d)) + str(c) for c in range(10) if luhn("".join(map(str, d)) + str(c)))

    phone = lambda: f"+1 ({rng.randint(200, 999)}) 555-{rng.randint(1000, 9999)}"
    rows = [(k, f"one {card()} here") for k in range(1000, 1200)] + [(k, f"one {int(card()) - 1:016d} here") for k in range(1200, 1300)] + [(k, f"ring {phone()} now") for k in range(1300, 1500)]
    both = {200 + k: (card(), card()) for k in range(5)} | {300 + k: (phone(), f"{rng.randint(1, 255)}.20.30.{rng.randint(100, 255)}") for k in range(5)}
    rows += [(k, f"of {a} {b} both") for k, (a, b) in both.items()]
    got = {r.doc_id: r for r in pii.digest(pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    for k, (a, b) in both.items():
        assert f"{'card' if k < 300 else 'phone'}:3:{3 + len(a)}" in got[k].spans.split(",") and got[k].n_added >= 1
        if k < 300:
            assert f"card:{4 + len(a)}:{4 + len(a) + len(b)}" in got[k].spans.split(",")
    assert all(got[k].n_added == 0 for k in range(1000, 1500))


def test_rows_of_equal_ids_are_ordered_by_their_texts(spark):
    line = "a line of more than five words"
    rows = [(1, f"own {k} start\n{line}\nown {k} end", k) for k in range(6)] + [(1, f"{line}\ntwice here too", 9)] * 2
    schema = "doc_id long, text string, k int"
    seen = set()
    for parts in (1, 3, 5):
        docs = spark.createDataFrame(rows[::-1] if parts == 3 else rows, schema).repartition(parts)
        found = linededup.dedup_lines(docs).select("row.*").collect()
        seen.add(tuple(sorted((r.k, r.text) for r in found)))
        assert sum(line in r.text.split("\n") for r in found) == 1
    assert len(seen) == 1


def test_opaque_tokens_outside_of_many_spans():
    text = " ".join("deadbeef" * 4 + f" k3yZq81mNb5vCx2LwEr7Ty{k}U9" for k in range(3000))
    base = secrets.base_spans(text)
    found = secrets.opaque_spans(text, base, 3.5)
    assert len(base) == len(found) == 3000 and all(text[a:b] == s for _, a, b, s in found)
    inside = "password=k3yZq81mNb5vCx2LwEr7TyU9"
    assert secrets.opaque_spans(inside, secrets.base_spans(inside), 3.5) == []

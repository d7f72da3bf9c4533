"""Secret scans with corpus-wide ownership frequency.

Every candidate string is hashed and counted by the distinct repositories and the distinct owners that hold it. A string
that several owners share is an example that was copied about; one that a single owner holds looks like a live credential.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import columns, written

#: The kinds of candidates, in order, and their patterns. Only ASCII letters match in either case.
KINDS = ("assign", "access", "hex", "opaque")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a maximal run, as [0-9a-f]+ finds it, of 24 at least
OPAQUE = re.compile(r"[A-Za-z0-9_+/-]{20,}")
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIXED = re.compile(r"[0-9]")


def entropy(s: str) -> float:
    """Bits a character."""
    n = len(s)
    return -sum(k / n * math.log2(k / n) for k in Counter(s).values())


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(kind, start, end, candidate) of the three base kinds, ordered by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(0, m.start(), m.end(), m.group(2)) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    if "AKIA" in text:
        found += [(1, m.start(), m.end(), m.group()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(2, m.start(), m.end(), m.group()) for m in HEX.finditer(text)]
    found.sort(key=lambda x: (x[1], x[0]))
    return found


def opaque_spans(text: str, taken: list[tuple[int, int, int, str]], least_bits: float) -> list[tuple[int, int, int, str]]:
    """Further candidates: long tokens of letters and digits with high entropy, outside the base spans."""
    starts = [a for _, a, _, _ in taken]  # rising
    ends = [*accumulate((b for _, _, b, _ in taken), max)]
    found = []
    for m in OPAQUE.finditer(text):
        s = m.group()
        before = bisect_left(starts, m.end())
        if MIXED.search(s) and not s.isdigit() and entropy(s) >= least_bits and not (before and ends[before - 1] > m.start()):
            found.append((3, m.start(), m.end(), s))
    return found


def _scan(least_bits: float):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                out.append([{"kind": k, "start": a, "end": b, "hash": hashlib.sha256(s.encode()).digest()[:16]} for k, a, b, s in base + opaque_spans(text, base, least_bits)])
            kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.binary())]))
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id"), batch.column("repo"), batch.column("owner"), pa.array(out, kind)], ["rid", "doc_id", "repo", "owner", "found"])

    return scan


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repo_col: str = "doc_id", owner_col: str = "source", wide_owners: int = 3, least_bits: float = 3.5) -> DataFrame:
    """One row per row of docs: its id and spans, an array of (kind, start, end, repos, owners, live) ordered by start, then kind.

    Offsets are code points, end exclusive. live: fewer than wide_owners distinct owners hold the string. Base kinds are
    always listed; an opaque token is listed only if it is live, since a widely shared one is no credential.
    Null text counts as empty; a null id, owner or repository is a value of its own; repeated rows each give a row; an
    empty table gives an empty result. Only the four named columns are read, so others may clash with anything.
    """
    src = columns(docs, doc_id=id_col, repo=F.col(repo_col).cast("string"), owner=F.col(owner_col).cast("string"), text=text_col)
    src = src.withColumn("rid", F.monotonically_increasing_id())
    kind = docs.schema[id_col].dataType.simpleString()
    hits = written(src.mapInArrow(_scan(least_bits), f"rid long, doc_id {kind}, repo string, owner string, found array<struct<kind:int,start:int,end:int,hash:binary>>"), "secrets")
    each = hits.filter(F.size("found") > 0).select("rid", "repo", "owner", F.explode("found").alias("x")).select("rid", "repo", "owner", "x.*")
    # Counted level by level, each with partial sums before its shuffle: a string in a third of all rows is no burden to one task.
    by_repo = each.groupBy("hash", "owner", "repo").agg(F.lit(1).alias("one"))
    by_owner = by_repo.groupBy("hash", "owner").agg(F.count("one").alias("repos"))
    spread = by_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))
    rated = each.join(spread, "hash").withColumn("live", F.col("owners") < wide_owners).filter((F.col("kind") < 3) | F.col("live"))
    span = F.struct("start", "kind", "end", "repos", "owners", "live")
    per_row = rated.groupBy("rid").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    none = F.array().cast("array<struct<start:int,kind:int,end:int,repos:bigint,owners:bigint,live:boolean>>")
    return hits.select("rid", "doc_id").join(per_row, "rid", "left").select("doc_id", F.coalesce("spans", none).alias("spans"))


def _of_kind(kind: int):
    return lambda x: x["kind"] == kind  # of one argument: a second one would be the place


def digest(spans: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, the digest of the base spans, all spans, counts of live and copied ones, and the
    most repositories that hold one of them."""
    names = F.array(*map(F.lit, KINDS))
    listed = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", F.get(names, x["kind"]), x["start"], x["end"])), ",")
    count = lambda f: F.size(F.filter("spans", f)).cast("long")
    return spans.select(
        "doc_id",
        *[count(_of_kind(k)).alias(f"n_{name}") for k, name in enumerate(KINDS[:3])],
        F.sha2(listed(F.filter("spans", lambda x: x["kind"] < 3)), 256).alias("base_sha256"),
        listed(F.col("spans")).alias("spans"),
        count(lambda x: x["live"]).alias("n_live"),
        count(lambda x: ~x["live"]).alias("n_copied"),
        F.coalesce(F.array_max(F.transform("spans", lambda x: x["repos"])), F.lit(0)).cast("long").alias("most_repos"),
    )

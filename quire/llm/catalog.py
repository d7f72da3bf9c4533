"""The registered queries of the text operators, with their production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import bpe, langid, linededup, mixing, ngramjoin, pii, secrets, sharding, vectors
from .common import modest_batches, table

#: Vocabulary files of public tokenizers; operators take the path as a parameter.
BYTE_BPE = "/opt/tokenizers/byte_bpe_50k.json"
PIECES = "/opt/tokenizers/piece_bpe_32k.model"


#: Target weights by path of domain, language and source; what isn't named weighs 1.
WEIGHTS = {(f"domain{d}", lang): w for d in range(4) for lang, w in (("en", 4), ("de", 2), ("fr", 2), ("es", 2))}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents."""
    modest_batches(spark)
    return table(spark, sf_dir, "documents")


def levels() -> dict:
    """The tree of op1 and of the pipeline, from the root on."""
    return {"domain": mixing.domain_of(F.col("source")), "lang": F.col("lang"), "source": F.col("source")}


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Half of all tokens, dealt to domains, languages and sources by weight, in at most two epochs."""
    found = mixing.mix(documents(spark, sf_dir), levels(), WEIGHTS)
    return found.select("row.doc_id", F.array_join("path", "/").alias("leaf"), F.col("tokens").alias("n_tokens"), F.col("copies").alias("n_copies"), F.col("budget").alias("leaf_budget"), F.col("given").alias("leaf_given"))


def op2_pii_boosting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every whole text."""
    return pii.digest(pii.find_personal_data(documents(spark, sf_dir)))


def op3_flat_graph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all embeddings under links of cosine 0.9."""
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text, encoded and decoded again."""
    return bpe.encode(documents(spark, sf_dir), BYTE_BPE, digests=True).withColumnsRenamed({"ids": "ids_sha256", "decoded": "decoded_sha256"})


def op5_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text without the blocks of lines that an earlier document has."""
    found = linededup.dedup_lines(documents(spark, sf_dir))
    return found.select("row.doc_id", "row.text", F.col("lines").alias("n_lines"), F.col("deleted").alias("n_deleted"))


def op6_minimax_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near-equal bytes."""
    return sharding.shard(documents(spark, sf_dir), 8)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text."""
    return langid.identify(documents(spark, sf_dir), PIECES)


def op8_ngram_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents that share 85 % of their four-word shingles."""
    return ngramjoin.jaccard_groups(documents(spark, sf_dir))


def op9_secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every whole text, with the spread of each over sources."""
    return secrets.digest(secrets.scan_secrets(documents(spark, sf_dir)))


def op10_pruned_graph_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest of every twentieth embedding."""
    return vectors.nearest(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_source_mixing, op2_pii_boosting, op3_flat_graph_dedup, op4_bpe_transducer, op5_line_alignment, op6_minimax_shards, op7_language_id, op8_ngram_product, op9_secret_ownership, op10_pruned_graph_search)}
#: Links of the n-gram join and of the near-duplicates, and the smallest id that they reach, in plain SQL. The others train
#: models, encode, align, hash or report offsets; SQL has no such functions, and tests hold them against brute force.
REACH = """l AS (SELECT u, v FROM links UNION SELECT v, u FROM links),
walk AS (SELECT u AS node, u AS seen FROM l UNION SELECT walk.node, l.v FROM walk JOIN l ON l.u = walk.seen),
comp AS (SELECT node, least(node, min(seen)) AS c FROM walk GROUP BY node)"""

ORACLES: dict[str, str] = {
    "op3_flat_graph_dedup": f"""WITH RECURSIVE e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS x FROM embeddings),
n AS (SELECT vec_id, x, sqrt(list_dot_product(x, x)) AS size FROM e WHERE x IS NOT NULL),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM n a JOIN n b ON a.vec_id < b.vec_id AND list_dot_product(a.x, b.x) >= 0.9 * a.size * b.size), {REACH}
SELECT e.vec_id, (SELECT count(*) FROM l WHERE l.u = e.vec_id) AS n_links, coalesce(comp.c, e.vec_id) AS component_id, coalesce(comp.c, e.vec_id) = e.vec_id AS kept FROM e LEFT JOIN comp ON comp.node = e.vec_id""",
    "op8_ngram_product": f"""WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x09-\\x0d\\x20]+'), lambda w: w <> '') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS g FROM d),
x AS (SELECT doc_id, len(g) AS n, unnest(g) AS t FROM s),
links AS (SELECT a.doc_id AS u, b.doc_id AS v FROM x a JOIN x b ON a.t = b.t AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))), {REACH}
SELECT s.doc_id, len(g)::BIGINT AS n_shingles, coalesce(comp.c, s.doc_id) AS component_id FROM s LEFT JOIN comp ON comp.node = s.doc_id""",
}

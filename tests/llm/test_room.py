import random

from pyspark.sql import functions as F

import corpus_pipeline
from quire.llm.common import made, written
from quire.llm.components import components
from quire.llm.linededup import dedup_lines
from quire.llm.ngramjoin import jaccard_groups

from .helpers import words


def shuffle_files(spark):
    return sum("shuffle_" in str(f) for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(",").split(","))


def documents(spark):
    rng = random.Random(5)
    texts = ["\n".join(words(rng, 9) for _ in range(4)) for _ in range(12)]
    texts += [t + " more" for t in texts[:6]] + texts[6:9]
    return spark.createDataFrame([(k, t, "en", "src0", len(t)) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")


def test_shuffle_files_go_with_the_table_that_they_led_to(spark):
    before, set_before = shuffle_files(spark), spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None)
    out = written(spark.range(2000).repartition(7, "id").groupBy((F.col("id") % 50).alias("k")).agg(F.sum("id").alias("s")), "sums")
    assert shuffle_files(spark) <= before and out.agg(F.sum("s")).first()[0] == 1999 * 1000
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled", None) == set_before


def test_operators_leave_what_their_results_are_read_from(spark):
    docs = documents(spark)
    for of, most in ((lambda: jaccard_groups(docs), 1), (lambda: dedup_lines(docs), 2), (lambda: components(spark.createDataFrame([(1, 2), (2, 3), (9, 8)], "u long, v long")), 1)):
        before = set(made())
        out = of()
        assert len(set(made()) - before) == most
        assert out.count() in (21, 5)


def test_later_stages_drop_what_earlier_ones_left(spark, tmp_path):
    docs = documents(spark)
    corpus_pipeline.line_dedup(spark, docs, "").write.parquet(str(tmp_path / "a"))
    left = set(corpus_pipeline._behind[1])
    assert left and left <= set(made())
    got = corpus_pipeline.ngram_join(spark, spark.read.parquet(str(tmp_path / "a")), "")
    assert not left & set(made())
    chained = corpus_pipeline.source_mixing(spark, got, "")  # not stored: what it is read from stays
    assert chained.count() > 0

"""Registered queries read whole tables."""

from quire.plans import files


def test_box_rule_reads_every_part(spark, tmp_path):
    rows = [(k, k % 50) for k in range(390, 460)]
    spark.createDataFrame(rows, "p_partkey long, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r.p_partkey: r.status for r in files.pdf_box_rule(spark, str(tmp_path)).collect()}
    assert got == {k: "violation" if s % 3 == 0 or s > 30 else "passed" for k, s in rows}

"""The pipeline against its stages run apart."""

import pytest
from pyspark.sql import functions as F

pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_take_effect(spark, tmp_path):
    base = " ".join(f"w{i * 7 % 101}x{i}" for i in range(60))
    rows = [(i, f"{base} tail{i} " + " ".join(f"v{i}q{k}" for k in range(40 + i % 9)), "en", f"s{i % 3}", 1) for i in range(120)]
    rows += [(500, rows[0][1], "en", "s0", 1), (501, "too short", "en", "s1", 1), (502, None, None, None, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = pipeline.run(spark, str(tmp_path))
    ids = {r.doc_id for r in out.select("doc_id").collect()}
    assert not ids & {500, 501, 502}
    assert ids <= set(range(120))
    copies = out.groupBy("doc_id").count().agg(F.max("count")).first()[0]
    assert copies <= 3
    assert [n for n, _ in pipeline.STAGES][0] == "quality rules" and len(pipeline.STAGES) == 5

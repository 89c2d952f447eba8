"""Queries of texts on odd rows, against their SQL."""

from __future__ import annotations

import duckdb
from pyspark.sql import functions as F


def test_is_text_of_nothing(spark, tmp_path):
    from quern.plans import ORACLE_SQL, QUERIES

    rows = [(1, "plain"), (2, ""), (3, None), (4, "é" * 9 + "x" * 991), (5, "é" * 50)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    db.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    ours = {r.doc_id: r.is_text for r in QUERIES["S3_is_text"](spark, str(tmp_path)).collect()}
    assert ours == dict(db.sql(ORACLE_SQL["S3_is_text"]).fetchall())


def test_dictionary_numbers_once(spark, tmp_path):
    """Ranges are drawn from a sample; rank and offsets have to come from one drawing of them."""
    from quern.operators.corpus import dictionary

    toks = spark.range(0, 60000, 1, 8).select(F.col("id").alias("doc_id"), F.lit(0).alias("pos"), F.concat(F.lit("w"), F.xxhash64("id").cast("string")).alias("word"))
    out = dictionary(toks)
    text = out._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("simple"))
    assert "rangepartitioning" not in text
    assert out.agg(F.count_distinct("wi"), F.min("wi"), F.max("wi")).first()[:] == (60000, 0, 59999)

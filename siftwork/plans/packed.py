"""Problem 6: the values of every object cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.operators.packed import delimiter_scores, split_packed
from siftwork.session import table


def object_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "structured_records").select(F.col("record_id").alias("row_key"), F.lit("structured_records").alias("source"), F.col("object").alias("cell"))
    c = table(spark, sf_dir, "extraction_candidates").select(F.col("candidate_id").alias("row_key"), F.col("source_model").alias("source"), F.col("object").alias("cell"))
    return s.unionByName(c)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split_packed(object_cells(spark, sf_dir), "row_key", "source", "cell")


def p6_delimiters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return delimiter_scores(object_cells(spark, sf_dir), "source", "cell").withColumns({c: F.round(c, 4) for c in ("score", "free_share")})


QUERIES = {"p6_found": p6_found, "p6_delimiters": p6_delimiters}

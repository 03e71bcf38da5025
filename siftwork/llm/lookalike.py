"""Problem 1: texts that look the same and differ in their characters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.llm.form import form_column
from siftwork.operators.groups import pairs_within
from siftwork.session import checkpointed, table


def field_texts(spark: SparkSession, sf_dir: str, fields: dict[str, tuple[str, str]]) -> DataFrame:
    """``field_name, key, text`` of each field given as ``name: (table, key column)``; distinct rows."""
    parts = [table(spark, sf_dir, t).select(F.lit(name).alias("field_name"), F.col(key).alias("key"), F.col(name).alias("text")) for name, (t, key) in fields.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.filter(F.col("key").isNotNull()).distinct()


FIELDS = {"raw_text": ("raw_records", "record_id"), "scene": ("structured_records", "record_id")}


def forms(texts: DataFrame, fold_case: bool = False) -> DataFrame:
    """``field_name, key, text, form`` with every text in one form.

    Null texts keep a null form and blank ones an empty form. Letters of unlike case look
    different, so case folding is off unless asked for.
    """
    return texts.withColumn("form", form_column("text", fold_case))


def lookalike_pairs(texts: DataFrame) -> DataFrame:
    """Pairs of keys of one field whose texts are unlike strings with the same form.

    Null and blank texts are no case; rows that stand twice count once; a key with itself is no
    pair. Groups are joined on a digest of the form, in blocks.
    """
    formed = forms(texts.filter(F.col("text").isNotNull())).filter(F.col("form") != "")
    small = checkpointed(formed.select("field_name", "key", F.unhex(F.md5("form")).alias("g"), F.unhex(F.md5("text")).alias("v")))
    return pairs_within(small, ["field_name", "g"], "key", "v").select("field_name", "key_a", "key_b").distinct()


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(field_texts(spark, sf_dir, FIELDS))


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text of the two fields in one form, with the number of rows that share it."""
    f = forms(field_texts(spark, sf_dir, FIELDS).filter("text IS NOT NULL"))
    return f.groupBy("field_name", "form").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("text").alias("n_spellings"), F.min("key").alias("first_key"))


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms}

"""Checks of keys and references, as tables of what is wrong, and one-to-one joins that rely on them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as T


def require_columns(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """``df`` itself, or an error that names the missing columns."""
    if missing := [c for c in columns if c not in df.columns]:
        raise ValueError(f"{label}: no column {', '.join(missing)}")
    return df


def key_problems(df: DataFrame, key: str) -> DataFrame:
    """``key, n, reason``: keys that are blank or stand more than once."""
    n = df.groupBy(F.coalesce(F.col(key).cast("string"), F.lit("")).alias("key")).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("reason", F.when(T.normalize_text("key") == "", "blank").when(F.col("n") > 1, "repeated")).filter("reason IS NOT NULL")


def orphans(df: DataFrame, key: str, target: DataFrame, target_key: str) -> DataFrame:
    """Rows whose key the target table does not hold; null keys refer to nothing and are orphans."""
    return df.join(target.select(F.col(target_key).alias(key)).distinct(), key, "left_anti")


def path_frame(units: DataFrame, parents: DataFrame, targets: DataFrame, key: str, parent: str, text: str) -> DataFrame:
    """Units with their parent label and target text, one row per unit that all three tables hold.

    The keys must be unique in each table (see :func:`key_problems`); ``target_valid`` tells blank
    target texts.
    """
    out = units.join(parents.select(key, parent), key).join(targets.select(key, F.col(text).alias("target_text")), key)
    return out.withColumn("target_valid", T.normalize_text("target_text") != "")


def unit_key_problems(df: DataFrame, record: str, unit: str) -> DataFrame:
    """``record, unit, n, reason``: unit keys with a blank part, or that stand more than once within their record."""
    r, u = (F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in (record, unit))
    n = df.groupBy(r, u).agg(F.count(F.lit(1)).alias("n"))
    blank = (T.normalize_text(record) == "") | (T.normalize_text(unit) == "")
    return n.withColumn("reason", F.when(blank, "blank").when(F.col("n") > 1, "repeated")).filter("reason IS NOT NULL")

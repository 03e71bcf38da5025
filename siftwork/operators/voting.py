"""Votes over the answers of several models, and provenance of extracted spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from siftwork.functions import text as T


def candidate_groups(candidates: DataFrame, item: str, model: str, label: str, order: list[str]) -> DataFrame:
    """``candidates`` with ``group_index``, counted from 1 within an item.

    An item with no more candidates than distinct models is one group; else candidates with the
    same label form a group, in first-seen order.
    """
    c = candidates.withColumn("_l", T.normalize_text(label)).withColumn("_o", F.struct(*order))
    size = c.groupBy(item).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct(model).alias("_m"))
    first = c.groupBy(item, "_l").agg(F.min("_o").alias("_f"))
    rank = first.withColumn("_r", F.row_number().over(W.partitionBy(item).orderBy("_f"))).drop("_f")
    return c.join(size, item).join(rank, [item, "_l"]).withColumn("group_index", F.when(F.col("_n") <= F.col("_m"), 1).otherwise(F.col("_r"))).drop("_l", "_o", "_n", "_m", "_r")


def vote(candidates: DataFrame, item: list[str], model: str, key: list[str], order: list[str], keep: list[str], least: int = 2) -> DataFrame:
    """The candidate whose key most distinct models gave, per item.

    Ties go to the key seen first by ``order``. With fewer than ``least`` supporters the item needs
    arbitration: ``accepted_by`` says so and the first candidate stands in. ``keep`` are the columns
    of the chosen candidate.
    """
    c = candidates.withColumn("_o", F.struct(*order))
    support = c.groupBy(*item, *key).agg(F.countDistinct(model).alias("support"), F.min("_o").alias("_first"), F.min_by(F.struct(*keep), "_o").alias("_row"))
    best = F.struct(F.when(F.col("support") >= least, -F.col("support")).otherwise(0).alias("s"), F.col("_first").alias("f"))
    won = support.groupBy(*item).agg(F.min_by(F.struct("support", "_row"), best).alias("w"), F.sum("support").alias("n_votes"), F.count(F.lit(1)).alias("n_keys"))
    by = F.when(F.col("w.support") >= least, "majority_vote").otherwise("arbitration")
    return won.select(*item, *[F.col(f"w._row.{k}").alias(k) for k in keep], F.col("w.support").alias("support"), "n_votes", "n_keys", by.alias("accepted_by"))


def provenance(rows: DataFrame, stage: str, field: str, value: Column, source: Column, scope: str, fallback: Column | None = None) -> DataFrame:
    """Whether a value is a stretch of its source text; the empty value is told apart first."""
    v, s = T.normalize_text(value), F.coalesce(source, F.lit(""))
    inside = s.contains(v)
    reason = F.when(v == "", "empty_value").when(inside, f"continuous_substring_of_{scope}")
    if fallback is not None:
        reason = reason.when(F.coalesce(fallback, F.lit("")).contains(v), f"not_in_{scope}_but_found_in_raw_text")
    return rows.select(F.lit(stage).alias("stage"), "record_id", "raw_record_id", F.lit(field).alias("field"), v.alias("value"), ((v != "") & inside).alias("is_valid"), reason.otherwise(f"not_continuous_substring_of_{scope}").alias("reason"))


def provenance_summary(issues: DataFrame, by: list[str]) -> DataFrame:
    n, bad = F.count(F.lit(1)), F.count_if(~F.col("is_valid"))
    return issues.groupBy(*by).agg(n.alias("checked_fields"), bad.alias("invalid_fields"), (n - bad).alias("valid_fields"), (bad / n).alias("invalid_ratio"))

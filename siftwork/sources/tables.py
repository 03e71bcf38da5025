"""Readers with fixed rules for ids, blanks and caches, and writers that export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators.ordinal import numbered_id, with_ordinal


def read_any(spark: SparkSession, path: str, breaks: bool = False) -> DataFrame:
    """CSV (all text, BOM), JSON lines or Parquet, by suffix. Empty cells stay null.

    A CSV file is split over tasks; only with ``breaks``, for cells with line breaks in quotes, is
    each file read by one task.
    """
    if path.endswith(".csv"):
        return spark.read.csv(path, header=True, multiLine=breaks, escape='"', encoding="UTF-8")
    return spark.read.json(path) if path.endswith((".json", ".jsonl")) else spark.read.parquet(path)


def pick_column(df: DataFrame, wanted: str | None, candidates: list[str]) -> str | None:
    """The wanted column if it exists, else the first candidate that does."""
    return next((c for c in [wanted, *candidates] if c in df.columns), None)


def raw_texts(df: DataFrame, position: str, text: str | None = None, key: str | None = None) -> DataFrame:
    """``record_id, raw_text, src_pos`` from any table with a text column.

    Null and blank texts are dropped, texts are stripped. Without an id column the id is ``R`` and
    the row's number among the rows with a text.
    """
    t = pick_column(df, text, ["raw_text", "text", "content", "description"])
    if t is None:
        raise ValueError(f"no text column among {df.columns}")
    k = pick_column(df, key, ["record_id", "raw_record_id", "id"])
    rows = df.filter(F.col(t).isNotNull())
    if k is None:
        rows = with_ordinal(rows, [position], "_n").withColumn("_id", numbered_id("_n", "R"))
    return rows.select(F.col(k or "_id").cast("string").alias("record_id"), T.strip(t).alias("raw_text"), F.col(position).alias("src_pos")).filter("raw_text <> ''")


def first_rows(df: DataFrame, position: str, n: int) -> DataFrame:
    """The first rows of a source, for a pilot run."""
    return df.orderBy(position).limit(n)


def cached_vectors(cache: DataFrame, key: str, vector: str, order: str, dim: int, needed: DataFrame | None = None) -> DataFrame:
    """``key, value`` of the newest usable entry per key, for the needed keys only.

    Usable are vectors of ``dim`` finite numbers that are not all zero.
    """
    v: Column = F.col(vector)
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & F.exists(v, lambda x: x != 0)
    rows = cache.filter(F.coalesce(fine, F.lit(False)))
    if needed is not None:
        rows = rows.join(needed.select(key).distinct(), key, "left_semi")
    return rows.groupBy(key).agg(F.max_by(vector, order).alias("value"))


def missing_keys(needed: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """Needed keys that the cache does not hold."""
    return needed.select(key).distinct().join(vectors, key, "left_anti")


def append_cache(new: DataFrame, path: str) -> None:
    """New entries behind the old ones; readers take the newest per key."""
    new.write.mode("append").parquet(path)


def write_partitions(df: DataFrame, path: str, by: str) -> None:
    """Replace only the partitions that ``df`` holds."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with nested cells as JSON text."""
    nested = {f.name for f in df.schema.fields if f.dataType.typeName() in ("array", "map", "struct")}
    df.select(*[F.to_json(c).alias(c) if c in nested else F.col(c) for c in df.columns]).write.mode("overwrite").csv(path, header=True, escape='"')


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A small table as a pipe table; more than ``most`` rows are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    lines = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(cell(x) for x in r) + " |" for r in lines) + "\n"


def cluster_assignments(df: DataFrame) -> DataFrame:
    """Assignments with fixed types: the final cluster defaults to the cluster, the level to that of its noise flag."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    number = lambda c: T.optional_int(have(c)).alias(c)
    noise = T.true_text(F.col("is_noise").cast("string"))
    level = F.when(T.clean(have("cluster_level")) != "", have("cluster_level")).when(noise, "primary_noise").otherwise("primary")
    return df.select(
        F.col("experiment_id").cast("string").alias("experiment_id"), F.col("record_id").cast("string").alias("record_id"), T.optional_int("cluster_id").alias("cluster_id"), noise.alias("is_noise"), T.optional_float(have("distance_to_centroid")).alias("distance_to_centroid"),
        number("representative_rank"), number("primary_cluster_id"), T.optional_bool(have("primary_is_noise")).alias("primary_is_noise"), number("noise_recluster_id"), F.coalesce(T.optional_int(have("final_cluster_id")), T.optional_int("cluster_id")).alias("final_cluster_id"), level.alias("cluster_level"),
    )


def cluster_names(df: DataFrame) -> DataFrame:
    """Names with fixed types; blank cells give empty texts and a count of 0."""
    have = lambda c: F.col(c) if c in df.columns else F.lit(None).cast("string")
    return df.select(F.col("experiment_id").cast("string").alias("experiment_id"), T.optional_int("cluster_id").alias("cluster_id"), T.clean(have("cluster_name")).alias("cluster_name"), T.clean(have("explanation")).alias("explanation"), F.coalesce(T.optional_int(have("sample_count")), F.lit(0)).alias("sample_count"))


def name_review(assignments: DataFrame, names: DataFrame, failed_prefix: str) -> DataFrame:
    """Assignments with the name of their cluster, its size and whether the naming failed; without a name it is empty."""
    size = assignments.groupBy("experiment_id", "cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    n = names.select("experiment_id", "cluster_id", "cluster_name", F.col("explanation").alias("cluster_explanation"), F.col("sample_count").alias("name_sample_count"))
    out = assignments.join(size, ["experiment_id", "cluster_id"]).join(n, ["experiment_id", "cluster_id"], "left")
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("cluster_name", "cluster_explanation")}).withColumn("name_failed", F.col("cluster_name").startswith(failed_prefix))


def write_name_review(review: DataFrame, path: str) -> None:
    """The review, a partition per experiment; other experiments stay."""
    write_partitions(review, path, "experiment_id")


def effective_units(units: DataFrame, provider: str, effective: Column, providers: list[str] | None = None) -> DataFrame:
    """Units of each provider that hold anything. A wanted provider without one is an error."""
    kept = units.filter(effective)
    if providers is not None:
        have = {r[0] for r in kept.filter(F.col(provider).isin(*providers)).select(provider).distinct().collect()}
        if missing := [x for x in providers if x not in have]:
            raise ValueError(f"no effective units of {', '.join(missing)}")
        kept = kept.filter(F.col(provider).isin(*providers))
    return kept


def gold_records(spark: SparkSession, path: str) -> DataFrame:
    """Reference or predicted records from a file, ``object_json`` under the name ``object``."""
    df = read_any(spark, path)
    return df.withColumnRenamed("object_json", "object") if "object" not in df.columns else df


def without_split(records: DataFrame) -> DataFrame:
    """Records at their own grain: without the parts of the scene."""
    return records.drop("loc_detail", "risk_scene")

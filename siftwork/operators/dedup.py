"""De-duplication and grain changes between records and units, with an audit row per input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators.ordinal import numbered_id, rank_in_group, with_ordinal

FIELDS = ("finding", "object", "scene", "loc_detail", "risk_scene")


def canonical_sources(raw: DataFrame) -> DataFrame:
    """The groups of :func:`canonical_groups` without their numbers: ``sha1, first_pos, duplicate_count`` and the first row."""
    norm = T.normalize_text("raw_text")
    rows = raw.select("record_id", "raw_text", "src_pos", norm.alias("norm")).filter("norm <> ''")
    groups = rows.groupBy(F.sha1("norm").alias("sha1")).agg(F.min_by(F.struct(F.col("record_id").alias("canonical_raw_record_id"), "raw_text", "norm"), "src_pos").alias("f"), F.min("src_pos").alias("first_pos"), F.count(F.lit(1)).alias("duplicate_count"))
    return groups.select("sha1", "first_pos", "duplicate_count", "f.*")


def canonical_groups(raw: DataFrame) -> DataFrame:
    """One row per normalised text of ``record_id, raw_text, src_pos``, numbered in source order.

    The first source row gives the canonical id and text. Blank texts are left out.
    """
    numbered = with_ordinal(canonical_sources(raw), ["first_pos"], "n")
    return numbered.select(numbered_id("n", "U").alias("analysis_record_id"), numbered_id("n", "RAW-D").alias("dedupe_group_id"), "canonical_raw_record_id", "raw_text", F.col("norm").alias("normalized_raw_text"), F.col("sha1").alias("normalized_raw_text_sha1"), "duplicate_count")


def canonical_audit(raw: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per source row with its group, its place in it and whether it is the canonical one."""
    rows = raw.select("record_id", "src_pos", F.sha1(T.normalize_text("raw_text")).alias("sha1"), T.normalize_text("raw_text").alias("norm")).filter("norm <> ''").drop("norm")
    placed = rank_in_group(rows, "sha1", ["src_pos"], "duplicate_index")
    g = groups.select(F.col("normalized_raw_text_sha1").alias("sha1"), "analysis_record_id", "dedupe_group_id", "canonical_raw_record_id", "duplicate_count")
    return placed.join(g, "sha1").select("dedupe_group_id", "analysis_record_id", "canonical_raw_record_id", F.col("record_id").alias("original_raw_record_id"), (F.col("record_id") == F.col("canonical_raw_record_id")).alias("is_canonical"), "duplicate_index", "duplicate_count", F.col("sha1").alias("normalized_raw_text_sha1"), "src_pos")


def is_effective(fields: tuple[str, ...] = FIELDS, array: str = "object") -> Column:
    """Any of the fields is not blank; of an array, that it has an item."""
    out = F.lit(False)
    for f in fields:
        out = out | (F.coalesce(F.size(f) > 0, F.lit(False)) if f == array else T.normalize_text(f) != "")
    return out


def unit_score() -> Column:
    """How much a unit holds, for choosing among duplicates; smaller is more."""
    has = {f: (T.normalize_text(f) != "").cast("int") for f in ("scene", "loc_detail", "risk_scene")}
    objects = F.coalesce(F.size("object"), F.lit(0))
    some = (objects > 0).cast("int")
    parts = [some + has["scene"] + has["loc_detail"] + has["risk_scene"], has["risk_scene"], has["scene"], some, has["loc_detail"], objects]
    return F.struct(*[(-p).alias(f"s{k}") for k, p in enumerate(parts)])


def unit_audit(units: DataFrame, canonical_ids: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One row per unit: ``record_id, raw_record_id, is_canonical_source, is_kept_unit, kept_record_id, exclusion_reason``.

    Units are told apart by ``by``, such as the provider, which come out too.

    Of the effective units of canonical records with one normalised raw text and finding, the one
    that holds most is kept, the first by ``record_id`` on a tie.
    """
    ids = canonical_ids.select(F.col("canonical_raw_record_id").alias("raw_record_id")).distinct().withColumn("_c", F.lit(True))
    u = units.join(ids, "raw_record_id", "left").withColumn("_e", is_effective()).withColumn("_k", F.sha1(F.concat_ws("\u001f", *by, T.normalize_text("raw_text"), T.normalize_text("finding"))))
    live = u.filter("_c AND _e")
    kept = live.groupBy("_k").agg(F.min(F.struct(unit_score().alias("s"), "record_id")).alias("_b")).select("_k", F.col("_b.record_id").alias("_kept"))
    out = u.join(kept, "_k", "left")
    dup = "duplicate_raw_text_finding_within_canonical"
    live_row = F.col("_c").isNotNull() & F.col("_e")
    reason = F.when(F.col("_c").isNull(), "duplicate_source_raw_text").when(~F.col("_e"), "empty_structured_placeholder").when(F.col("record_id") != F.col("_kept"), dup).otherwise("")
    return out.select(*by, "record_id", "raw_record_id", F.col("_c").isNotNull().alias("is_canonical_source"), (live_row & (F.col("record_id") == F.col("_kept"))).alias("is_kept_unit"), F.when(live_row, F.col("_kept")).otherwise("").alias("kept_record_id"), reason.alias("exclusion_reason"))


def ordered_values(units: DataFrame, key: list[str], fields: list[str], array: str, order: str) -> DataFrame:
    """``key`` and per field its distinct normalised non-blank values in first-seen order, joined by ``；``.

    One pass: all fields' values are made distinct by one aggregate, so what is joined per key is
    its distinct values, never its rows.
    """
    scalar = [F.struct(F.lit(f).alias("f"), T.normalize_text(f).alias("v"), F.lit(0).alias("p")) for f in fields]
    items = F.transform(F.coalesce(F.col(array), F.array().cast("array<string>")), lambda x, i: F.struct(F.lit(array).alias("f"), T.normalize_text(x).alias("v"), i.alias("p")))
    rows = units.select(*key, order, F.explode(F.concat(F.array(*scalar), items)).alias("x")).filter("x.v <> ''")
    first = rows.groupBy(*key, F.col("x.f").alias("f"), F.col("x.v").alias("v")).agg(F.min(F.struct(order, "x.p")).alias("o"))
    joined = lambda f: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("f") == f, F.struct("o", "v")))), lambda x: x["v"]), "；")
    return first.groupBy(*key).agg(*[joined(f).alias(f) for f in (*fields, array)])


def consolidate(groups: DataFrame, units: DataFrame) -> DataFrame:
    """One row per canonical record with its units' values; records without units stay, with empty values."""
    fields = ["finding", "scene", "loc_detail", "risk_scene"]
    values = ordered_values(units, ["raw_record_id"], fields, "object", "record_id").withColumnRenamed("object", "objects")
    flags = units.groupBy("raw_record_id").agg(F.count(F.lit(1)).alias("n_units"), F.bool_or(F.coalesce("arbitration_required", F.lit(False))).alias("arbitration_required"))
    out = groups.select("analysis_record_id", F.col("canonical_raw_record_id").alias("raw_record_id")).join(flags, "raw_record_id", "left").join(values, "raw_record_id", "left")
    return out.select("analysis_record_id", "raw_record_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("finding", "objects", "scene", "loc_detail", "risk_scene")], F.coalesce("n_units", F.lit(0)).alias("n_units"), F.coalesce("arbitration_required", F.lit(False)).alias("arbitration_required"))


def provider_levels(groups: DataFrame, units: DataFrame, provider: str) -> DataFrame:
    """Per provider and canonical record the values of the provider's kept units, at the grain of records.

    Units are de-duplicated within their provider; a provider has a row for every canonical record,
    with empty values where it has no unit.
    """
    kept = unit_audit(units, groups, (provider,)).filter("is_kept_unit").select(provider, "record_id")
    live = units.join(kept, [provider, "record_id"], "left_semi")
    fields = [f for f in ("finding", "scene", "loc_detail", "risk_scene") if f in units.columns]
    key = [provider, "raw_record_id"]
    values = ordered_values(live, key, fields, "object", "record_id").withColumnRenamed("object", "objects")
    sizes = live.groupBy(*key).agg(F.count(F.lit(1)).alias("n_units"))
    every = groups.select("analysis_record_id", F.col("canonical_raw_record_id").alias("raw_record_id")).withColumn(provider, F.explode(F.array(*map(F.lit, sorted(r[0] for r in units.select(provider).distinct().collect())))))
    out = every.join(sizes, key, "left").join(values, key, "left")
    return out.select(provider, "analysis_record_id", "raw_record_id", *[F.coalesce(c, F.lit("")).alias(c) for c in ("objects", *fields)], F.coalesce("n_units", F.lit(0)).alias("n_units"))


def remap_to_canonical(rows: DataFrame, id_column: str, audit: DataFrame) -> DataFrame:
    """Rows with the canonical id of their source id, keeping one source per canonical id.

    That source is the canonical id itself if it has rows, else the smallest source id. Columns
    added: ``canonical_id``, ``was_mapped``, ``is_kept``.
    """
    to = audit.select(F.col("original_raw_record_id").alias(id_column), F.col("canonical_raw_record_id").alias("_c")).distinct()
    m = rows.join(to, id_column, "left").withColumn("canonical_id", F.coalesce("_c", id_column)).withColumn("was_mapped", F.col("_c").isNotNull()).drop("_c")
    pick = m.groupBy("canonical_id").agg(F.min(F.struct((F.col(id_column) != F.col("canonical_id")).alias("o"), F.col(id_column).alias("i"))).alias("s"))
    return m.join(pick, "canonical_id").withColumn("is_kept", F.col(id_column) == F.col("s.i")).drop("s")


def common_universe(rows: DataFrame, id_column: str, system: str, present: Column, n_systems: int) -> DataFrame:
    """Every id of any system, with the number of systems that have it filled and whether all do."""
    return rows.groupBy(id_column).agg(F.countDistinct(F.when(present, F.col(system))).alias("n_systems")).withColumn("included", F.col("n_systems") == n_systems)


def universe_audit(rows: DataFrame, id_column: str, branch: str, branches: list[str], effective: Column) -> DataFrame:
    """Per id one ``<branch>_has_unit`` flag, the missing branches and whether none is missing."""
    p = rows.groupBy(id_column).agg(*[F.coalesce(F.bool_or(F.when(F.col(branch) == b, effective)), F.lit(False)).alias(f"{b}_has_unit") for b in branches])
    missing = F.array_join(F.array_compact(F.array(*[F.when(~F.col(f"`{b}_has_unit`"), F.lit(b)) for b in branches])), ";")
    return p.withColumn("missing_branches", missing).withColumn("included", F.col("missing_branches") == "")


def complete_subset(assignments: DataFrame, records: DataFrame, key: str, required: list[str]) -> DataFrame:
    """Assignments whose record has all required fields present (arrays: not empty)."""
    kinds = dict(records.dtypes)
    ok = F.lit(True)
    for f in required:
        ok = ok & (F.coalesce(F.size(f) > 0, F.lit(False)) if kinds[f].startswith("array") else T.is_present(f))
    return assignments.join(records.filter(ok).select(key), key, "left_semi")


def merge_by_id(parts: list[DataFrame], key: str) -> DataFrame:
    """Union of tables by id: equal rows collapse; ``n_versions`` above 1 marks a conflict."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    distinct = out.distinct()
    versions = distinct.groupBy(key).agg(F.count(F.lit(1)).alias("n_versions"))
    return distinct.join(versions, key)

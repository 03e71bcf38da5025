"""Records, units, votes and channels over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import channels as C
from siftwork.operators import dedup as D
from siftwork.operators import voting as V
from siftwork.operators.ordinal import batches
from siftwork.operators.packed import DELIMITERS, values_column
from siftwork.session import checkpointed, table

MODELS = ["lm-aster", "lm-birch", "lm-cedar", "lm-dahlia", "lm-elm", "lm-fern", "lm-gorse"]


def n_(x: str) -> str:
    return rf"trim(regexp_replace(coalesce({x}, ''), '[\t-\r\x{{1C}}-\x{{20}}\x{{85}}\p{{Z}}]+', ' ', 'g'))"


def s_(x: str) -> str:
    return rf"regexp_replace(coalesce({x}, ''), '^[\t-\r\x{{1C}}-\x{{20}}\x{{85}}\p{{Z}}]+|[\t-\r\x{{1C}}-\x{{20}}\x{{85}}\p{{Z}}]+$', '', 'g')"


def c_(x: str) -> str:
    return rf"lower(regexp_replace(coalesce({x}, ''), '[\t-\r\x{{1C}}-\x{{20}}\x{{85}}\p{{Z}}]+', '', 'g'))"


EDGES_SQL = r"[\[\](){}\"''“”‘’`（）【】]+"


def objects_(x: str) -> str:
    t = n_(x)
    parts = f"""CASE WHEN {t} = '[]' THEN []::VARCHAR[] WHEN {t} LIKE '["%]' AND json_valid({t}) THEN try_cast({t} AS JSON)::VARCHAR[]
      WHEN {t} LIKE '[''%]' OR {t} LIKE '["%]' THEN regexp_split_to_array(regexp_replace({t}, '^\\[[''"]|[''"]\\]$', '', 'g'), '[''"], [''"]')
      ELSE regexp_split_to_array({t}, '[;；,，、|/]+') END"""
    clean = f"regexp_replace({c_('p')}, '^{EDGES_SQL}|{EDGES_SQL}$', '', 'g')"
    return f"list_sort(list_distinct(list_filter(list_transform({parts}, lambda p: {clean}), lambda p: p <> '')))"


# Bindings


def raw(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "raw_records")


def scene_votes(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "scene_split_candidates").select("source_model", "structured_record_id", T.normalize_text("loc_detail").alias("loc_detail"), T.normalize_text("risk_scene").alias("risk_scene"))
    return V.vote(s, ["structured_record_id"], "source_model", ["loc_detail", "risk_scene"], ["source_model", "loc_detail", "risk_scene"], ["loc_detail", "risk_scene"])


def units(spark: SparkSession, d: str) -> DataFrame:
    """Structured records with parsed objects and the voted split of their scene."""
    s = table(spark, d, "structured_records").withColumn("object", T.parse_objects("object"))
    v = scene_votes(spark, d).select(F.col("structured_record_id").alias("record_id"), "loc_detail", "risk_scene")
    return s.join(v, "record_id", "left").withColumns({c: F.coalesce(c, F.lit("")) for c in ("loc_detail", "risk_scene")})


def candidates(spark: SparkSession, d: str) -> DataFrame:
    """Distinct candidates with normalised texts and parsed objects as one key."""
    c = table(spark, d, "extraction_candidates").distinct()
    return c.select("candidate_id", "source_model", "raw_record_id", "cand_pos", T.normalize_text("finding").alias("finding"), T.normalize_text("scene").alias("scene"), T.object_key(T.parse_objects("object")).alias("objects"), "confidence")


# Queries


def raw_dedup_groups(spark, d):
    return D.canonical_groups(raw(spark, d)).select("analysis_record_id", "dedupe_group_id", "canonical_raw_record_id", "normalized_raw_text", "normalized_raw_text_sha1", "duplicate_count")


def raw_dedup_audit(spark, d):
    r = raw(spark, d)
    return D.canonical_audit(r, D.canonical_groups(r))


def source_preprocessing_summary(spark, d):
    r = raw(spark, d)
    norm = T.normalize_text("raw_text")
    return r.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(norm == "").alias("n_blank"), F.countDistinct(F.when(norm != "", norm)).alias("n_groups"), F.countDistinct("record_id").alias("n_ids"))


def normalize_text_scalar(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.normalize_text("text")).alias("norm_md5"), F.md5(T.compact_text("text")).alias("compact_md5"), F.length(T.normalize_text("text")).alias("n"))


def cache_keys(spark, d):
    return table(spark, d, "documents").select("doc_id", T.embedding_key("p", "m", 64, "text").alias("embedding_key"), F.sha1(F.coalesce("text", F.lit(""))).alias("sha1"))


def parse_objects(spark, d):
    return table(spark, d, "structured_records").select("record_id", F.array_join(T.parse_objects("object"), "¦").alias("objects"))


def json_cells(spark, d):
    e = table(spark, d, "extraction_candidates").distinct()
    return e.select("candidate_id", F.get_json_object("metadata", "$.attempt").cast("int").alias("attempt"), F.get_json_object("metadata", "$.tokens").cast("int").alias("tokens"))


def metadata_flags(spark, d):
    """Presence, booleans and casts of cells."""
    s = table(spark, d, "structured_records")
    return s.select("record_id", T.is_present("scene").alias("has_scene"), T.is_present("object").alias("has_object"), F.coalesce("arbitration_required", F.lit(False)).alias("arbitration"), T.safe_int(F.get_json_object("metadata", "$.votes")).alias("votes"), T.first_text("scene", "finding").alias("label"), T.remove_suffix("accepted_by", "_vote").alias("accepted"))


def text_helpers(spark, d):
    """Safe names, pair keys, templates and n-gram counts of extracted texts."""
    s = table(spark, d, "structured_records")
    return s.select("record_id", T.safe_name("scene").alias("safe_scene"), T.pair_key("record_id", "raw_record_id").alias("pair_key"), T.fill_template(F.lit("{R}: {F}"), {"{R}": "record_id", "{F}": F.coalesce("finding", F.lit(""))}).alias("filled"), F.size(T.char_ngrams("finding")).alias("n_bigrams"), T.canonical_json(record_id="record_id", finding="finding").alias("json"))


def unit_dedupe_audit(spark, d):
    return D.unit_audit(units(spark, d), D.canonical_sources(raw(spark, d)))


def unit_dedupe(spark, d):
    return unit_dedupe_audit(spark, d).groupBy("exclusion_reason").agg(F.count(F.lit(1)).alias("n"), F.count_if("is_kept_unit").alias("n_kept"))


def consolidate_units(spark, d):
    u = checkpointed(units(spark, d))
    g = checkpointed(D.canonical_groups(raw(spark, d)))
    kept = D.unit_audit(u, g).filter("is_kept_unit").select("record_id")
    return D.consolidate(g, u.join(kept, "record_id", "left_semi"))


def gold_remap(spark, d):
    r = raw(spark, d)
    a = D.canonical_audit(r, D.canonical_groups(r))
    return D.remap_to_canonical(table(spark, d, "structured_records").select("record_id", "raw_record_id"), "raw_record_id", a)


def common_universe(spark, d):
    c = table(spark, d, "extraction_candidates")
    return D.common_universe(c, "raw_record_id", "source_model", T.is_present("finding"), len(MODELS))


def universe_audit(spark, d):
    c = table(spark, d, "extraction_candidates")
    e = T.is_present("finding") | T.is_present("scene")
    out = D.universe_audit(c, "raw_record_id", "source_model", MODELS, e)
    return out.toDF(*[x.replace("-", "_") for x in out.columns])


def complete_field_subset(spark, d):
    u = units(spark, d)
    return D.complete_subset(u.select("record_id", "raw_record_id"), u, "record_id", ["finding", "object", "scene"])


def batch_assignment(spark, d):
    return batches(raw(spark, d).select("record_id", "src_pos"), ["src_pos"], 5)


def candidate_groups(spark, d):
    c = V.candidate_groups(checkpointed(candidates(spark, d)), "raw_record_id", "source_model", "finding", ["cand_pos", "candidate_id"])
    return c.select("candidate_id", "raw_record_id", "group_index")


def vote_extraction(spark, d):
    c = V.candidate_groups(checkpointed(candidates(spark, d)), "raw_record_id", "source_model", "finding", ["cand_pos", "candidate_id"])
    return V.vote(c, ["raw_record_id", "group_index"], "source_model", ["finding", "objects", "scene"], ["cand_pos", "candidate_id"], ["candidate_id", "finding", "scene"])


def vote_scene_split(spark, d):
    return scene_votes(spark, d)


def _issues(spark, d):
    s = table(spark, d, "structured_records")
    return V.provenance(s, "structured", "finding", F.col("finding"), F.col("raw_text"), "raw_text").unionByName(V.provenance(s, "structured", "scene", F.col("scene"), F.col("raw_text"), "raw_text")).unionByName(V.provenance(units(spark, d).filter("risk_scene <> ''"), "scene_split", "risk_scene", F.col("risk_scene"), F.col("scene"), "scene", F.col("raw_text")))


def provenance_validation(spark, d):
    return _issues(spark, d).select("stage", "record_id", "field", "is_valid", "reason")


def validation_summary(spark, d):
    return V.provenance_summary(_issues(spark, d), ["stage", "field"]).withColumn("invalid_ratio", F.round("invalid_ratio", 6))


def _all_issues(spark, d):
    """The issues above, one for every object against its finding, and those of loc_detail."""
    o = table(spark, d, "structured_records").withColumn("value", F.explode(values_column("object", F.lit(DELIMITERS))))
    loc = units(spark, d).filter("loc_detail <> ''")
    objects = V.provenance(o, "structured", "object", F.col("value"), F.col("finding"), "finding", F.col("raw_text"))
    return _issues(spark, d).unionByName(objects).unionByName(V.provenance(loc, "scene_split", "loc_detail", F.col("loc_detail"), F.col("scene"), "scene", F.col("raw_text")))


def provenance_all_fields(spark, d):
    return _all_issues(spark, d).select("stage", "record_id", "field", "value", "is_valid", "reason")


def validation_all_fields(spark, d):
    return V.provenance_summary(_all_issues(spark, d), ["stage", "field"]).withColumn("invalid_ratio", F.round("invalid_ratio", 6))


def channel_inputs_union(spark, d):
    return C.channel_inputs(units(spark, d)).unionByName(C.baseline_inputs(raw(spark, d).select("record_id", "raw_text").distinct(), "record_id", "raw_text"))


def provider_channels(spark, d):
    c = candidates(spark, d).withColumn("object", F.split("objects", "\u001f"))
    return C.provider_inputs(c, {"A1-F": ["finding"], "A1-R": ["scene", "finding"]}, "source_model", "candidate_id")


def selected_experiments(spark, d):
    return C.select_experiments(channel_inputs_union(spark, d), ["T8", "B1"]).groupBy("experiment_id", "place").agg(F.count(F.lit(1)).alias("n"), F.count_if(T.strip("input_text") == "").alias("n_blank"))


def field_composition(spark, d):
    return C.composition(units(spark, d), ["risk_scene", "object", "finding"])


def merged_versions(spark, d):
    """Raw records by id: how many distinct texts an id has."""
    m = D.merge_by_id([raw(spark, d).select("record_id", "raw_text")], "record_id")
    return m.groupBy("n_versions").agg(F.count(F.lit(1)).alias("n"))


def merged_sources(spark, d):
    """Raw records, canonical ones and those behind the structured records by id: how many distinct texts an id has."""
    c = table(spark, d, "canonical_raw_records").select(F.col("canonical_raw_record_id").alias("record_id"), "raw_text")
    s = table(spark, d, "structured_records").select(F.col("raw_record_id").alias("record_id"), "raw_text")
    m = D.merge_by_id([raw(spark, d).select("record_id", "raw_text"), c, s], "record_id")
    return m.groupBy("n_versions").agg(F.count(F.lit(1)).alias("n"))


def clause_findings(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(T.clause_with("text", ["缺失", "裸露", "断裂"])).alias("clause_md5"))


QUERIES = {f.__name__: f for f in (raw_dedup_groups, raw_dedup_audit, source_preprocessing_summary, normalize_text_scalar, cache_keys, parse_objects, json_cells, metadata_flags, text_helpers, unit_dedupe_audit, unit_dedupe, consolidate_units, gold_remap, common_universe, universe_audit, complete_field_subset, batch_assignment, candidate_groups, vote_extraction, vote_scene_split, provenance_validation, validation_summary, provenance_all_fields, validation_all_fields, channel_inputs_union, provider_channels, selected_experiments, field_composition, merged_versions, merged_sources, clause_findings)}

# DuckDB

GROUPS = f"""rows AS (SELECT record_id, raw_text, src_pos, {n_('raw_text')} AS norm FROM raw_records),
g0 AS (SELECT norm, min(src_pos) AS first_pos, count(*) AS duplicate_count, arg_min(record_id, src_pos) AS canon, arg_min(raw_text, src_pos) AS canon_text FROM rows WHERE norm <> '' GROUP BY norm),
g AS (SELECT *, row_number() OVER (ORDER BY first_pos) AS n FROM g0)"""
SCENE = f"""s0 AS (SELECT source_model, structured_record_id, {n_('loc_detail')} AS loc_detail, {n_('risk_scene')} AS risk_scene FROM scene_split_candidates),
s1 AS (SELECT structured_record_id, loc_detail, risk_scene, count(DISTINCT source_model) AS support, min(source_model) AS m FROM s0 GROUP BY ALL),
sv AS (SELECT structured_record_id, loc_detail, risk_scene, support, sum(support) OVER w AS n_votes, count(*) OVER w AS n_keys,
  CASE WHEN support >= 2 THEN 'majority_vote' ELSE 'arbitration' END AS accepted_by FROM s1 WINDOW w AS (PARTITION BY structured_record_id)
  QUALIFY row_number() OVER (PARTITION BY structured_record_id ORDER BY CASE WHEN support >= 2 THEN -support ELSE 0 END, m, loc_detail, risk_scene) = 1)"""
UNITS = f"""{SCENE}, u AS (SELECT r.record_id, r.raw_record_id, r.raw_text, r.finding, r.scene, r.arbitration_required, {objects_('r.object')} AS object,
  coalesce(v.loc_detail, '') AS loc_detail, coalesce(v.risk_scene, '') AS risk_scene FROM structured_records r LEFT JOIN sv v ON v.structured_record_id = r.record_id)"""
CANDS = f"""c0 AS (SELECT DISTINCT * FROM extraction_candidates),
c AS (SELECT candidate_id, source_model, raw_record_id, cand_pos, {n_('finding')} AS finding, {n_('scene')} AS scene, array_to_string({objects_('object')}, chr(31)) AS objects FROM c0),
c1 AS (SELECT *, count(*) OVER (PARTITION BY raw_record_id) AS n FROM c),
cm AS (SELECT raw_record_id, count(DISTINCT source_model) AS m FROM c GROUP BY 1),
cf AS (SELECT raw_record_id, finding, row_number() OVER (PARTITION BY raw_record_id ORDER BY min(row(cand_pos, candidate_id))) AS r FROM c GROUP BY 1, 2),
cg AS (SELECT c1.*, CASE WHEN n <= m THEN 1 ELSE r END AS group_index FROM c1 JOIN cm USING (raw_record_id) JOIN cf USING (raw_record_id, finding))"""
has = lambda x: f"(lower({n_(x)}) NOT IN ('', 'nan', 'none', 'null', '[]', '{{}}'))"
eff = f"({n_('finding')} <> '' OR len(object) > 0 OR {n_('scene')} <> '' OR {n_('loc_detail')} <> '' OR {n_('risk_scene')} <> '')"
AUDIT = f"""{GROUPS}, {UNITS}, ua AS (SELECT u.*, c.canon IS NOT NULL AS is_canon, {eff} AS is_eff, md5({n_('raw_text')} || chr(31) || {n_('finding')}) AS k,
  (len(object) > 0)::INT AS o, ({n_('scene')} <> '')::INT AS s, ({n_('loc_detail')} <> '')::INT AS l, ({n_('risk_scene')} <> '')::INT AS x FROM u LEFT JOIN (SELECT DISTINCT canon FROM g) c ON c.canon = u.raw_record_id),
kept AS (SELECT k, record_id AS kept_id FROM ua WHERE is_canon AND is_eff QUALIFY row_number() OVER (PARTITION BY k ORDER BY o+s+l+x DESC, x DESC, s DESC, o DESC, l DESC, len(object) DESC, record_id) = 1),
audit AS (SELECT record_id, raw_record_id, is_canon AS is_canonical_source, is_canon AND is_eff AND record_id = kept_id AS is_kept_unit, CASE WHEN is_canon AND is_eff THEN kept_id ELSE '' END AS kept_record_id,
  CASE WHEN NOT is_canon THEN 'duplicate_source_raw_text' WHEN NOT is_eff THEN 'empty_structured_placeholder' WHEN record_id <> kept_id THEN 'duplicate_raw_text_finding_within_canonical' ELSE '' END AS exclusion_reason
  FROM ua LEFT JOIN kept USING (k))"""
ISSUES = f"""i AS (
 SELECT 'structured' AS stage, record_id, 'finding' AS field, {n_('finding')} AS v, coalesce(raw_text, '') AS s, 'raw_text' AS scope, NULL AS f FROM structured_records
 UNION ALL SELECT 'structured', record_id, 'scene', {n_('scene')}, coalesce(raw_text, ''), 'raw_text', NULL FROM structured_records
 UNION ALL SELECT 'scene_split', record_id, 'risk_scene', {n_('risk_scene')}, coalesce(scene, ''), 'scene', coalesce(raw_text, '') FROM u WHERE risk_scene <> ''),
issues AS (SELECT stage, record_id, field, v <> '' AND contains(s, v) AS is_valid, CASE WHEN v = '' THEN 'empty_value' WHEN contains(s, v) THEN 'continuous_substring_of_' || scope
 WHEN f IS NOT NULL AND contains(f, v) THEN 'not_in_' || scope || '_but_found_in_raw_text' ELSE 'not_continuous_substring_of_' || scope END AS reason FROM i)"""


def piece(f: str) -> str:
    v = "array_to_string(object, '; ')" if f == "object" else s_(f)
    return f"CASE WHEN {v} <> '' THEN '{f}: ' || {v} END"


CHANNELS_SQL = " UNION ALL ".join(f"SELECT '{e}' AS experiment_id, record_id, concat_ws(' | ', {', '.join(piece(f) for f in fields)}) AS input_text FROM u" for e, fields in C.CHANNELS.items())
INPUTS = f"{UNITS}, ch AS ({CHANNELS_SQL} UNION ALL SELECT 'B1', record_id, coalesce(raw_text, '') FROM (SELECT DISTINCT record_id, raw_text FROM raw_records))"

SQL = {
    "raw_dedup_groups": f"WITH {GROUPS} SELECT 'U' || lpad(n::VARCHAR, greatest(5, len(n::VARCHAR))::INT, '0') AS analysis_record_id, 'RAW-D' || lpad(n::VARCHAR, greatest(5, len(n::VARCHAR))::INT, '0') AS dedupe_group_id, canon AS canonical_raw_record_id, norm AS normalized_raw_text, sha1(norm) AS normalized_raw_text_sha1, duplicate_count FROM g",
    "raw_dedup_audit": f"WITH {GROUPS} SELECT 'RAW-D' || lpad(n::VARCHAR, greatest(5, len(n::VARCHAR))::INT, '0') AS dedupe_group_id, 'U' || lpad(n::VARCHAR, greatest(5, len(n::VARCHAR))::INT, '0') AS analysis_record_id, canon AS canonical_raw_record_id, record_id AS original_raw_record_id, record_id = canon AS is_canonical, row_number() OVER (PARTITION BY norm ORDER BY src_pos)::INT AS duplicate_index, duplicate_count, sha1(norm) AS normalized_raw_text_sha1, src_pos FROM rows JOIN g USING (norm)",
    "source_preprocessing_summary": f"WITH {GROUPS} SELECT count(*) AS n_rows, count(*) FILTER (norm = '') AS n_blank, count(DISTINCT CASE WHEN norm <> '' THEN norm END) AS n_groups, count(DISTINCT record_id) AS n_ids FROM rows",
    "normalize_text_scalar": f"SELECT doc_id, md5({n_('text')}) AS norm_md5, md5({c_('text')}) AS compact_md5, length({n_('text')})::INT AS n FROM documents",
    "cache_keys": "SELECT doc_id, sha256('p' || chr(10) || 'm' || chr(10) || 'embedding' || chr(10) || '64' || chr(10) || coalesce(text, '')) AS embedding_key, sha1(coalesce(text, '')) AS sha1 FROM documents",
    "parse_objects": f"SELECT record_id, array_to_string({objects_('object')}, '¦') AS objects FROM structured_records",
    "json_cells": "SELECT candidate_id, (metadata->>'$.attempt')::INT AS attempt, (metadata->>'$.tokens')::INT AS tokens FROM (SELECT DISTINCT * FROM extraction_candidates)",
    "metadata_flags": f"SELECT record_id, {has('scene')} AS has_scene, {has('object')} AS has_object, coalesce(arbitration_required, false) AS arbitration, coalesce(try_cast(metadata->>'$.votes' AS INT), 0) AS votes, CASE WHEN lower({n_('scene')}) NOT IN ('', 'nan') THEN {n_('scene')} WHEN lower({n_('finding')}) NOT IN ('', 'nan') THEN {n_('finding')} ELSE '' END AS label, regexp_replace(accepted_by, '_vote$', '') AS accepted FROM structured_records",
    "text_helpers": rf"SELECT record_id, coalesce(nullif(regexp_replace(regexp_replace({n_('scene')}, '[^0-9A-Za-z._\x{{4e00}}-\x{{9fff}}-]+', '_', 'g'), '^_+|_+$', '', 'g'), ''), 'unnamed') AS safe_scene, CASE WHEN record_id <> raw_record_id THEN least(record_id, raw_record_id) || '|' || greatest(record_id, raw_record_id) END AS pair_key, record_id || ': ' || coalesce(finding, '') AS filled, CASE WHEN length({n_('finding')}) <= 2 THEN 1 ELSE length({n_('finding')}) - 1 END::INT AS n_bigrams, json_object('finding', finding, 'record_id', record_id)::VARCHAR AS json FROM structured_records",
    "unit_dedupe_audit": f"WITH {AUDIT} SELECT * FROM audit",
    "unit_dedupe": f"WITH {AUDIT} SELECT exclusion_reason, count(*) AS n, count(*) FILTER (is_kept_unit) AS n_kept FROM audit GROUP BY 1",
    "gold_remap": f"WITH {GROUPS}, m AS (SELECT DISTINCT rows.record_id AS raw_record_id, canon FROM rows JOIN g USING (norm)), j AS (SELECT s.record_id, s.raw_record_id, coalesce(canon, s.raw_record_id) AS canonical_id, canon IS NOT NULL AS was_mapped FROM structured_records s LEFT JOIN m USING (raw_record_id)) SELECT record_id, raw_record_id, canonical_id, was_mapped, raw_record_id = first_value(raw_record_id) OVER (PARTITION BY canonical_id ORDER BY raw_record_id <> canonical_id, raw_record_id) AS is_kept FROM j",
    "common_universe": f"SELECT raw_record_id, count(DISTINCT CASE WHEN {has('finding')} THEN source_model END) AS n_systems, count(DISTINCT CASE WHEN {has('finding')} THEN source_model END) = 7 AS included FROM extraction_candidates GROUP BY 1",
    "universe_audit": "WITH f AS (SELECT raw_record_id, source_model, " + f"{has('finding')} OR {has('scene')} AS e FROM extraction_candidates), p AS (SELECT raw_record_id, " + ", ".join(f"coalesce(bool_or(e) FILTER (source_model = '{m}'), false) AS {m.replace('-', '_')}_has_unit" for m in MODELS) + " FROM f GROUP BY 1), q AS (SELECT *, concat_ws(';', " + ", ".join(f"CASE WHEN NOT {m.replace('-', '_')}_has_unit THEN '{m}' END" for m in MODELS) + ") AS missing_branches FROM p) SELECT *, missing_branches = '' AS included FROM q",
    "complete_field_subset": f"WITH {UNITS} SELECT record_id, raw_record_id FROM u WHERE {has('finding')} AND len(object) > 0 AND {has('scene')}",
    "batch_assignment": "SELECT record_id, src_pos, ((row_number() OVER (ORDER BY src_pos) - 1) // 5)::INT AS batch FROM raw_records",
    "candidate_groups": f"WITH {CANDS} SELECT candidate_id, raw_record_id, group_index::INT AS group_index FROM cg",
    "vote_extraction": f"""WITH {CANDS}, k AS (SELECT raw_record_id, group_index, finding, objects, scene, count(DISTINCT source_model) AS support, min(row(cand_pos, candidate_id)) AS o, arg_min(candidate_id, row(cand_pos, candidate_id)) AS candidate_id FROM cg GROUP BY ALL)
 SELECT raw_record_id, group_index::INT AS group_index, candidate_id, finding, scene, support, sum(support) OVER w::BIGINT AS n_votes, count(*) OVER w AS n_keys, CASE WHEN support >= 2 THEN 'majority_vote' ELSE 'arbitration' END AS accepted_by FROM k WINDOW w AS (PARTITION BY raw_record_id, group_index)
 QUALIFY row_number() OVER (PARTITION BY raw_record_id, group_index ORDER BY CASE WHEN support >= 2 THEN -support ELSE 0 END, o) = 1""",
    "vote_scene_split": f"WITH {SCENE} SELECT structured_record_id, loc_detail, risk_scene, support, n_votes::BIGINT AS n_votes, n_keys, accepted_by FROM sv",
    "provenance_validation": f"WITH {UNITS}, {ISSUES} SELECT * FROM issues",
    "validation_summary": f"WITH {UNITS}, {ISSUES} SELECT stage, field, count(*) AS checked_fields, count(*) FILTER (NOT is_valid) AS invalid_fields, count(*) FILTER (is_valid) AS valid_fields, round(count(*) FILTER (NOT is_valid) / count(*), 6) AS invalid_ratio FROM issues GROUP BY 1, 2",
    "channel_inputs_union": f"WITH {INPUTS} SELECT * FROM ch",
    "provider_channels": f"WITH {CANDS} SELECT 'A1-F-' || source_model AS experiment_id, candidate_id AS record_id, CASE WHEN trim(finding) <> '' THEN 'finding: ' || finding ELSE '' END AS input_text FROM c UNION ALL SELECT 'A1-R-' || source_model, candidate_id, concat_ws(' | ', CASE WHEN scene <> '' THEN 'scene: ' || scene END, CASE WHEN finding <> '' THEN 'finding: ' || finding END) FROM c",
    "selected_experiments": f"WITH {INPUTS} SELECT experiment_id, CASE experiment_id WHEN 'T8' THEN 1 ELSE 2 END::BIGINT AS place, count(*) AS n, count(*) FILTER ({s_('input_text')} = '') AS n_blank FROM ch WHERE experiment_id IN ('T8', 'B1') GROUP BY 1, 2",
    "field_composition": f"WITH {UNITS}, p AS (SELECT concat_ws('+', CASE WHEN trim(risk_scene) <> '' THEN 'risk_scene' END, CASE WHEN len(object) > 0 THEN 'object' END, CASE WHEN trim(coalesce(finding, '')) <> '' THEN 'finding' END) AS pattern FROM u) SELECT pattern, count(*) AS n, pattern = 'risk_scene+object+finding' AS is_complete FROM p WHERE pattern <> '' GROUP BY 1",
    "clause_findings": f"WITH t AS (SELECT doc_id, list_filter(regexp_split_to_array({n_('text')}, '[，,；;。]'), lambda x: trim(x, ' ') <> '') AS p FROM documents), m AS (SELECT *, list_position(list_transform(p, lambda x: regexp_matches(x, '缺失|裸露|断裂')), true) AS i FROM t) SELECT doc_id, md5(CASE WHEN len(p) = 0 THEN '' ELSE array_to_string(CASE WHEN coalesce(i, 0) > 0 THEN p[i:] ELSE p[len(p):] END, '，') END) AS clause_md5 FROM m",
    "merged_sources": "WITH x AS (SELECT record_id, raw_text FROM raw_records UNION SELECT canonical_raw_record_id, raw_text FROM canonical_raw_records UNION SELECT raw_record_id, raw_text FROM structured_records), v AS (SELECT record_id, count(*) AS n_versions FROM x GROUP BY 1) SELECT n_versions, sum(n_versions)::BIGINT AS n FROM v GROUP BY 1",
    "merged_versions": "WITH x AS (SELECT DISTINCT record_id, raw_text FROM raw_records), v AS (SELECT record_id, count(*) AS n_versions FROM x GROUP BY 1) SELECT n_versions, sum(n_versions)::BIGINT AS n FROM v GROUP BY 1",
    "consolidate_units": f"""WITH {AUDIT}, ku AS (SELECT u.* FROM u JOIN audit USING (record_id) WHERE is_kept_unit),
 vals AS (SELECT raw_record_id, 'finding' AS f, {n_('finding')} AS v, record_id AS o, 0 AS p FROM ku UNION ALL SELECT raw_record_id, 'scene', {n_('scene')}, record_id, 0 FROM ku UNION ALL SELECT raw_record_id, 'loc_detail', {n_('loc_detail')}, record_id, 0 FROM ku
  UNION ALL SELECT raw_record_id, 'risk_scene', {n_('risk_scene')}, record_id, 0 FROM ku UNION ALL SELECT raw_record_id, 'objects', object[i], record_id, i FROM (SELECT ku.*, unnest(range(1, len(object) + 1)) AS i FROM ku)),
 d AS (SELECT raw_record_id, f, v, min(row(o, p)) AS o FROM vals WHERE v <> '' GROUP BY 1, 2, 3), j AS (SELECT raw_record_id, f, string_agg(v, '；' ORDER BY o) AS s FROM d GROUP BY 1, 2), k AS (SELECT raw_record_id, count(*) AS n_units, bool_or(coalesce(arbitration_required, false)) AS a FROM ku GROUP BY 1)
 SELECT 'U' || lpad(g.n::VARCHAR, greatest(5, len(g.n::VARCHAR))::INT, '0') AS analysis_record_id, canon AS raw_record_id, """ + ", ".join(f"coalesce((SELECT s FROM j WHERE j.raw_record_id = canon AND f = '{f}'), '') AS {f}" for f in ("finding", "objects", "scene", "loc_detail", "risk_scene")) + ", coalesce(k.n_units, 0) AS n_units, coalesce(k.a, false) AS arbitration_required FROM g LEFT JOIN k ON k.raw_record_id = canon",
}

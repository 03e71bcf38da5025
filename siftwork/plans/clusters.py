"""Cluster structure, separation, correspondence, paths and topics over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import channels as C
from siftwork.operators import correspondence as R
from siftwork.operators import topics as K
from siftwork.operators import vectors as X
from siftwork.operators.checks import key_problems as key_problems_of
from siftwork.operators.checks import orphans
from siftwork.operators.checks import path_frame as make_path
from siftwork.operators.ordinal import batches
from siftwork.plans.records import MODELS, UNITS, channel_inputs_union, n_, s_, units
from siftwork.session import checkpointed, table
from siftwork.sources.tables import cached_vectors

DIM = 64


def vectors(spark, d) -> DataFrame:
    """Newest usable vectors with two labels from their components: -2 missing, -1 noise, 0 to 9 topics; and a topic of 64."""
    v = cached_vectors(table(spark, d, "embedding_cache"), "cache_key", "value", "line_no", DIM)
    sizes = F.transform("value", F.abs)
    top = F.array_position(sizes, F.array_max(sizes)).cast("int") - 1
    high = F.array_position("value", F.array_max("value")).cast("int") - 1
    return v.select("cache_key", "value", (top % 12 - 2).alias("label"), (high % 12 - 2).alias("other"), top.alias("topic"))


def round_all(df: DataFrame, n: int = 6) -> DataFrame:
    return df.select(*[F.round(c, n).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def embedding_lookup(spark, d):
    return round_all(vectors(spark, d).select("cache_key", F.size("value").alias("dim"), F.sqrt(X.dot("value", "value")).alias("norm")), 4)


def fallback_cluster(spark, d):
    return vectors(spark, d).groupBy(T.fallback_label("value").alias("label")).agg(F.count(F.lit(1)).alias("n"))


def hash_embedding(spark, d):
    """Signed bigram features of findings in 32 buckets, scaled to length one, in long form."""
    s = table(spark, d, "structured_records").select("record_id", F.explode(T.char_ngrams("finding")).alias("g"))
    b = s.groupBy("record_id", T.hash_bucket(F.col("g"), 32).alias("bucket")).agg(F.sum(T.hash_sign(F.col("g"))).alias("x"))
    n = b.groupBy("record_id").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    return b.join(n, "record_id").select("record_id", "bucket", F.round(F.col("x") / F.when(F.col("norm") > 0, F.col("norm")).otherwise(1.0), 6).alias("value"))


def centroid_rank(spark, d):
    return round_all(X.centroid_ranks(vectors(spark, d), "cache_key", "label", "value", DIM).drop("distance"))


def centroid_distance(spark, d):
    r = X.centroid_ranks(vectors(spark, d), "cache_key", "label", "value", DIM, with_noise=False)
    return round_all(r.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("distance").alias("mean_distance"), F.max("distance").alias("max_distance"), F.count("rank").alias("n_ranked")), 5)


def cluster_structure(spark, d):
    return round_all(X.structure(vectors(spark, d), "label"))


def silhouette_cosine(spark, d):
    s = X.silhouette(vectors(spark, d), "cache_key", "label", "value", DIM)
    return round_all(s.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("silhouette")), 5)


def topic_similarity(spark, d):
    return round_all(X.topic_similarity(vectors(spark, d), "label", "value", DIM), 5)


def noise_recluster(spark, d):
    r = X.recluster_noise(vectors(spark, d), "label", F.when(F.col("other") < 0, -1).otherwise(F.col("other") % 2), 10, 0.01)
    return r.groupBy("level", "final_label").agg(F.count(F.lit(1)).alias("n"))


def missing_channel_labels(spark, d):
    """Labels by a digest of the channel text; blank texts are missing; coverage of parents per channel."""
    parent = units(spark, d).select("record_id", "raw_record_id")
    inputs = channel_inputs_union(spark, d).filter("experiment_id <> 'B1'").join(parent, "record_id")
    label = C.label_or_missing("input_text", T.hash_bucket(T.strip("input_text"), 6) - 1)
    return round_all(C.coverage(inputs.withColumn("label", label), "experiment_id", "label", "raw_record_id"))


def _cells(spark, d):
    v = checkpointed(vectors(spark, d).select("cache_key", "label", "other"))
    return R.contingency(R.joined_labels(v, v, "cache_key", "label", "other"))


def contingency(spark, d):
    return round_all(_cells(spark, d))


def tie_aware_summary(spark, d):
    return R.dominance_summary(_cells(spark, d))


def cluster_profiles(spark, d):
    return round_all(R.profiles(_cells(spark, d)))


def clustering_agreement(spark, d):
    return round_all(R.agreement(checkpointed(_cells(spark, d))))


def adjusted_mutual_information(spark, d):
    return round_all(R.agreement(checkpointed(_cells(spark, d)), True).select("n_records", "ami"))


def _labelled(spark, d):
    """Structured records with a label of their scene and of their parent record."""
    s = table(spark, d, "structured_records")
    return s.select("record_id", "raw_record_id", "finding", T.normalize_text("scene").alias("scene"), (T.hash_bucket(T.normalize_text("scene"), 8) - 1).alias("cluster_id"), (T.hash_bucket(F.col("raw_record_id"), 6) - 1).alias("parent"))


def parent_inherited_join(spark, d):
    s = _labelled(spark, d)
    parents = s.groupBy("raw_record_id").agg(F.min("parent").alias("parent"))
    return R.inherited(parents, s, "raw_record_id", "parent", "cluster_id").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


def assignment_review(spark, d):
    s = _labelled(spark, d)
    size = s.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("cluster_size"))
    order = F.when(F.col("cluster_id") >= 0, 0).otherwise(3)
    return s.join(size, "cluster_id").select("record_id", "cluster_id", "cluster_size", "scene", order.alias("sort_group"))


def cluster_top5(spark, d):
    return K.top_samples(_labelled(spark, d), ["cluster_id"], [F.col("record_id")], "record_id", 5)


def _path(spark, d):
    """Candidates with their site as the parent (null is noise) and whether they have a scene."""
    c = table(spark, d, "extraction_candidates").distinct()
    site = F.coalesce(F.substring("site_code", 3, 4).try_cast("int"), F.lit(-1))
    return c.select("candidate_id", site.alias("parent"), T.is_present("scene").alias("valid"), T.normalize_text("scene").alias("scene"), "confidence")


def key_problems(spark, d):
    """Repeated and blank keys of three tables, counted."""
    out = None
    for name, key in (("raw_records", "record_id"), ("structured_records", "record_id"), ("embedding_cache", "cache_key")):
        p = key_problems_of(table(spark, d, name), key).groupBy("reason").agg(F.count(F.lit(1)).alias("n_keys"), F.sum("n").alias("n_rows")).withColumn("table_name", F.lit(name))
        out = p if out is None else out.unionByName(p)
    return out


def orphan_candidates(spark, d):
    """Candidates without a canonical record that stands for their record itself."""
    c = table(spark, d, "extraction_candidates").select("raw_record_id", "candidate_id").distinct()
    return orphans(c, "raw_record_id", table(spark, d, "canonical_raw_records"), "canonical_raw_record_id")


def path_frame(spark, d):
    u = units(spark, d).select("record_id", "raw_record_id", "object")
    parents = _labelled(spark, d).select("record_id", "parent")
    targets = u.select("record_id", T.channel_text({"object": "object"}).alias("input_text"))
    return make_path(u.select("record_id", "raw_record_id"), parents, targets, "record_id", "parent", "input_text")


def parent_profiles(spark, d):
    return round_all(R.parent_profiles(_path(spark, d), "parent", "valid"))


def threshold_grid(spark, d):
    return round_all(R.threshold_grid(R.parent_profiles(_path(spark, d), "parent", "valid"), [5, 10, 30], [5, 20]))


def _local(spark, d):
    p = _path(spark, d).filter("parent >= 0")
    return p.groupBy("parent").agg(F.count(F.lit(1)).alias("n_units"), F.countDistinct(F.when(F.col("valid"), F.col("scene"))).alias("n_children"), F.avg("confidence").alias("quality"))


def local_summary(spark, d):
    return round_all(R.local_summary(_local(spark, d), "n_children", "n_units", "quality"))


def representative_parent(spark, d):
    return _local(spark, d).filter("n_children >= 2").orderBy(F.desc("n_units"), "parent").limit(1).select("parent", "n_units", "n_children")


def _topics(spark, d):
    c = checkpointed(X.centroids(vectors(spark, d), ["topic"], "value", DIM))
    return c.select(F.format_string("K%04d", "topic").alias("topic_id"), (F.col("topic") % 3).alias("parent"), "centroid")


def candidate_pairs(spark, d):
    return K.candidate_pairs(_topics(spark, d)).withColumn("similarity", F.round("similarity", 5))


def rule_comparison(spark, d):
    return round_all(K.rule_comparison(K.candidate_pairs(_topics(spark, d))), 5)


def provisional_groups(spark, d):
    p = checkpointed(K.candidate_pairs(_topics(spark, d)))
    return round_all(K.group_summary(K.maximal_cliques(p.filter("mutual OR high"), "key_a", "key_b"), p), 5)


def relation_flatten(spark, d):
    """Candidates nested per record in order, and flattened again."""
    c = table(spark, d, "extraction_candidates").distinct()
    nested = c.groupBy("raw_record_id").agg(F.array_sort(F.collect_list(F.struct("cand_pos", "candidate_id", "source_model"))).alias("judgements"))
    return K.flatten(nested, "raw_record_id", "judgements")


def diverse_sample(spark, d):
    c = table(spark, d, "extraction_candidates").distinct().select("candidate_id", "source_model", T.normalize_text("scene").alias("scene"))
    return K.diverse_sample(c, "source_model", "scene", "candidate_id", 12)


def knowledge_cards(spark, d):
    c = table(spark, d, "extraction_candidates").distinct().withColumn("scene", T.normalize_text("scene"))
    return round_all(K.evidence_cards(c, "source_model", "scene", F.coalesce(F.col("confidence") >= 0.85, F.lit(False)), "raw_record_id"))


def relation_requests(spark, d):
    """Structured records in batches of 6 as nested requests, with a digest of each payload."""
    s = batches(table(spark, d, "structured_records").select("record_id", "raw_record_id", "finding"), ["record_id"], 6)
    return K.batched_requests(s, "batch", "record_id", ["raw_record_id", "finding"]).select("batch", "n_items", "payload_sha256")


def controls_from_synthesis(spark, d):
    """Models that gave one scene of a record, as nested groups, flattened to numbered controls."""
    c = table(spark, d, "extraction_candidates").select("raw_record_id", T.normalize_text("scene").alias("name"), "source_model").filter("name <> ''").distinct()
    g = c.groupBy("raw_record_id", "name").agg(F.collect_set("source_model").alias("members"))
    nested = checkpointed(g.groupBy("raw_record_id").agg(F.array_sort(F.collect_list(F.struct("name", F.array_sort("members").alias("members")))).alias("groups")))
    control, member = K.controls(nested, "raw_record_id", "groups")
    return control.join(member.groupBy("control_id").agg(F.min("member").alias("first_member")), "control_id")


def _answer_errors(spark, d, models):
    c = table(spark, d, "extraction_candidates").distinct()
    asked = c.select("raw_record_id").distinct().withColumn("source_model", F.explode(F.array(*map(F.lit, models))))
    return K.partition_errors(asked, c.filter(F.col("source_model").isin(*models)), "source_model", "raw_record_id").groupBy("source_model", "reason").agg(F.count(F.lit(1)).alias("n"))


def answer_partition(spark, d):
    """Records asked of two models against the records they answered once."""
    return _answer_errors(spark, d, ["lm-aster", "lm-gorse"])


def answer_partition_all(spark, d):
    """Records asked of each model against the records it answered once."""
    return _answer_errors(spark, d, MODELS)


QUERIES = {f.__name__: f for f in (embedding_lookup, fallback_cluster, hash_embedding, centroid_rank, centroid_distance, cluster_structure, silhouette_cosine, topic_similarity, noise_recluster, missing_channel_labels, contingency, tie_aware_summary, cluster_profiles, clustering_agreement, adjusted_mutual_information, parent_inherited_join, assignment_review, cluster_top5, key_problems, orphan_candidates, path_frame, parent_profiles, threshold_grid, local_summary, representative_parent, candidate_pairs, rule_comparison, provisional_groups, relation_flatten, relation_requests, controls_from_synthesis, answer_partition, answer_partition_all, diverse_sample, knowledge_cards)}

# DuckDB

VEC = """ok AS (SELECT cache_key, line_no, value FROM embedding_cache WHERE len(value) = 64 AND len(list_filter(value, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(value, lambda x: x <> 0)) > 0),
v0 AS (SELECT cache_key, list_transform(value, lambda x: x::DOUBLE) AS value FROM ok QUALIFY row_number() OVER (PARTITION BY cache_key ORDER BY line_no DESC) = 1),
v1 AS (SELECT *, (list_position(list_transform(value, lambda x: abs(x)), list_max(list_transform(value, lambda x: abs(x)))) - 1)::INT AS topic, (list_position(value, list_max(value)) - 1)::INT AS high FROM v0),
v AS (SELECT cache_key, value, topic, topic % 12 - 2 AS label, high % 12 - 2 AS other FROM v1)"""


def cent(by: str, source: str, vec: str) -> str:
    return f"(SELECT {by}, list(m ORDER BY i) AS c, any_value(n) AS n FROM (SELECT {by}, i, avg({vec}[i]) AS m, count(*) AS n FROM {source}, range(1, 65) t(i) GROUP BY {by}, i) GROUP BY {by})"


CELLS = """p AS (SELECT label AS a, other AS b FROM v WHERE label >= 0 AND other >= 0), n AS (SELECT a, b, count(*) AS n FROM p GROUP BY 1, 2),
w AS (SELECT *, sum(n) OVER (PARTITION BY a)::BIGINT AS n_a, sum(n) OVER (PARTITION BY b)::BIGINT AS n_b, max(n) OVER (PARTITION BY a) AS max_a, max(n) OVER (PARTITION BY b) AS max_b FROM n),
cells AS (SELECT a, b, n, n_a, n_b, n / n_a AS share_a, n / n_b AS share_b, n = max_a AS dominant_a, n = max_b AS dominant_b, n = max_a AND n = max_b AS mutual,
 count(*) FILTER (n = max_a) OVER (PARTITION BY a) AS ties_a, count(*) FILTER (n = max_b) OVER (PARTITION BY b) AS ties_b FROM w)"""
h_ = lambda g, m: f"((('0x' || substr(md5({g}), 7, 2) || substr(md5({g}), 5, 2) || substr(md5({g}), 3, 2) || substr(md5({g}), 1, 2))::BIGINT) % {m})::INT"
LAB = f"s AS (SELECT record_id, raw_record_id, {n_('scene')} AS scene, {h_(n_('scene'), 8)} - 1 AS cluster_id, {h_('raw_record_id', 6)} - 1 AS parent FROM structured_records)"
PATH = f"p AS (SELECT candidate_id, coalesce(try_cast(substr(site_code, 3, 4) AS INT), -1) AS parent, lower({n_('scene')}) NOT IN ('', 'nan', 'none', 'null', '[]', '{{}}') AS valid, {n_('scene')} AS scene, confidence FROM (SELECT DISTINCT * FROM extraction_candidates))"
LOCAL = f"{PATH}, l AS (SELECT parent, count(*) AS n_units, count(DISTINCT CASE WHEN valid THEN scene END) AS n_children, avg(confidence) AS quality FROM p WHERE parent >= 0 GROUP BY 1)"
PAIRS = f"""{VEC}, t AS (SELECT printf('K%04d', topic) AS topic_id, topic % 3 AS parent, c FROM {cent('topic', 'v', 'value')}),
pr AS (SELECT a.topic_id AS key_a, b.topic_id AS key_b, a.parent <> b.parent AS cross_parent, round(list_cosine_similarity(a.c, b.c), 9) AS similarity FROM t a JOIN t b ON a.topic_id < b.topic_id),
th AS (SELECT round(quantile_cont(similarity, 0.95), 9) AS threshold FROM pr WHERE cross_parent),
dir AS (SELECT key_a AS src, key_b AS dst, similarity FROM pr UNION ALL SELECT key_b, key_a, similarity FROM pr),
near AS (SELECT * FROM dir QUALIFY row_number() OVER (PARTITION BY src ORDER BY similarity DESC, dst) <= 5),
vt AS (SELECT least(src, dst) AS key_a, greatest(src, dst) AS key_b, count(*) AS v FROM near GROUP BY 1, 2),
cp AS (SELECT key_a, key_b, cross_parent, similarity, coalesce(v, 0) = 2 AS mutual, coalesce(v, 0) >= 1 AS either, similarity >= threshold AS high FROM pr LEFT JOIN vt USING (key_a, key_b), th WHERE coalesce(v, 0) >= 1 OR similarity >= threshold)"""

SQL = {
    "embedding_lookup": f"WITH {VEC} SELECT cache_key, 64 AS dim, round(sqrt(list_sum(list_transform(value, lambda x: x * x))), 4) AS norm FROM v",
    "fallback_cluster": f"WITH {VEC} SELECT topic % 3 AS label, count(*) AS n FROM v GROUP BY 1",
    "hash_embedding": f"""WITH t AS (SELECT record_id, {n_('finding')} AS f FROM structured_records), g AS (SELECT record_id, CASE WHEN f = '' THEN '<empty>' WHEN length(f) <= 2 THEN f ELSE substr(f, i, 2) END AS g FROM t, LATERAL (SELECT unnest(range(1, greatest(length(f) - 1, 1) + 1)) AS i)),
 b AS (SELECT record_id, {h_('g', 32)} AS bucket, sum(CASE WHEN ('0x' || substr(md5(g), 9, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END)::DOUBLE AS x FROM g GROUP BY 1, 2)
 SELECT record_id, bucket, round(x / coalesce(nullif(sqrt(sum(x * x) OVER (PARTITION BY record_id)), 0), 1), 6) AS value FROM b""",
    "centroid_rank": f"WITH {VEC}, c AS {cent('label', 'v', 'value')}, d AS (SELECT cache_key, label, list_distance(value, c) AS distance FROM v JOIN c USING (label)) SELECT cache_key, label, row_number() OVER (PARTITION BY label ORDER BY round(distance, 9), cache_key)::INT AS rank FROM d",
    "centroid_distance": f"WITH {VEC}, c AS {cent('label', 'v', 'value')}, d AS (SELECT cache_key, label, CASE WHEN label >= 0 THEN list_distance(value, c) END AS distance FROM v JOIN c USING (label)) SELECT label, count(*) AS n, round(avg(distance), 5) AS mean_distance, round(max(distance), 5) AS max_distance, count(distance) AS n_ranked FROM d GROUP BY 1",
    "cluster_structure": f"WITH {VEC}, p AS (SELECT label, count(*) AS n FROM v GROUP BY 1) SELECT sum(n)::BIGINT AS record_count, sum(n) FILTER (label <> -2)::BIGINT AS clustered_record_count, coalesce(sum(n) FILTER (label = -2), 0)::BIGINT AS missing_count, round(coalesce(sum(n) FILTER (label = -2), 0) / sum(n), 6) AS missing_ratio, count(*) FILTER (label >= 0) AS cluster_count, coalesce(sum(n) FILTER (label = -1), 0)::BIGINT AS noise_count, round(coalesce(sum(n) FILTER (label = -1), 0) / sum(n), 6) AS noise_ratio, quantile_cont(n, 0.5) FILTER (label >= 0)::DOUBLE AS median_topic_size, max(n) FILTER (label >= 0) AS largest_topic_size, round(max(n) FILTER (label >= 0) / sum(n) FILTER (label <> -2), 6) AS largest_topic_ratio FROM p",
    "silhouette_cosine": f"""WITH {VEC}, u AS (SELECT cache_key, label, list_transform(value, lambda x: x / sqrt(list_sum(list_transform(value, lambda y: y * y)))) AS u FROM v WHERE label >= 0), m AS {cent('label', 'u', 'u')},
 d AS (SELECT cache_key, u.label, m.label AS l, n, 1 - list_dot_product(u, c) AS d FROM u, m), g AS (SELECT cache_key, label, max(CASE WHEN l = label THEN d * n / nullif(n - 1, 0) END) AS a, max(CASE WHEN l = label THEN n END) AS n, min(CASE WHEN l <> label THEN d END) AS b FROM d GROUP BY 1, 2)
 SELECT label, count(*) AS n, round(avg(CASE WHEN n = 1 THEN 0 ELSE (b - a) / greatest(a, b) END), 5) AS silhouette FROM g GROUP BY 1""",
    "topic_similarity": f"WITH {VEC}, u AS (SELECT label, list_transform(value, lambda x: x / sqrt(list_sum(list_transform(value, lambda y: y * y)))) AS u FROM v WHERE label >= 0), m AS {cent('label', 'u', 'u')}, s AS (SELECT list_cosine_similarity(a.c, b.c) AS s FROM m a JOIN m b ON a.label < b.label) SELECT count(*) AS n_pairs, round(avg(s), 5) AS mean_similarity, round(max(s), 5) AS max_similarity FROM s",
    "noise_recluster": f"WITH {VEC}, x AS (SELECT count(*) FILTER (label = -1) AS z, count(*) AS n, greatest(max(label), -1) AS top FROM v WHERE label <> -2), y AS (SELECT *, CASE WHEN other < 0 THEN -1 ELSE other % 2 END AS sec, label = -1 AND z >= 10 AND z >= 0.01 * n AS again FROM v, x) SELECT CASE WHEN label = -2 THEN 'missing_channel' WHEN label >= 0 THEN 'primary' WHEN NOT again THEN 'primary_noise' WHEN sec >= 0 THEN 'noise_recluster' ELSE 'residual_noise' END AS level, CASE WHEN again AND sec >= 0 THEN top + 1 + sec ELSE label END AS final_label, count(*) AS n FROM y GROUP BY 1, 2",
    "missing_channel_labels": f"WITH {UNITS}, ch AS (" + " UNION ALL ".join(f"SELECT '{e}' AS experiment_id, record_id, raw_record_id, concat_ws(' | ', {', '.join((lambda v, f: f'''CASE WHEN {v} <> '' THEN '{f}: ' || {v} END''')('''array_to_string(object, '; ')''' if f == 'object' else s_(f), f) for f in fields)}) AS t FROM u" for e, fields in C.CHANNELS.items()) + f"), l AS (SELECT experiment_id, raw_record_id AS p, CASE WHEN {n_('t')} = '' THEN -2 ELSE {h_(s_('t'), 6)} - 1 END AS label FROM ch) SELECT experiment_id, count(*) AS n_rows, count(*) FILTER (label <> -2) AS n_clusterable, count(*) FILTER (label = -2) AS n_missing, round(count(*) FILTER (label = -2) / count(*), 6) AS missing_ratio, round(count(*) FILTER (label = -1) / count(*), 6) AS noise_ratio, count(DISTINCT label) FILTER (label >= 0) AS n_clusters, count(DISTINCT p) AS n_parents, count(DISTINCT p) FILTER (label <> -2) AS n_covered_parents, round(count(DISTINCT p) FILTER (label <> -2) / count(DISTINCT p), 6) AS parent_coverage FROM l GROUP BY 1",
    "contingency": f"WITH {VEC}, {CELLS} SELECT a, b, n, n_a, n_b, round(share_a, 6) AS share_a, round(share_b, 6) AS share_b, dominant_a, dominant_b, mutual, ties_a, ties_b FROM cells",
    "tie_aware_summary": f"WITH {VEC}, {CELLS}, z AS (SELECT *, dominant_a AND b = min(b) FILTER (dominant_a) OVER (PARTITION BY a) AS single_a FROM cells) SELECT sum(n)::BIGINT AS n_records, count(DISTINCT a) AS n_a_clusters, count(DISTINCT b) AS n_b_clusters, sum(n) FILTER (single_a)::BIGINT AS dominant_records, count(*) FILTER (mutual) AS mutual_pairs, coalesce(sum(n) FILTER (mutual), 0)::BIGINT AS mutual_records, count(DISTINCT a) FILTER (ties_a > 1) AS tied_a, count(DISTINCT b) FILTER (ties_b > 1) AS tied_b FROM z",
    "cluster_profiles": f"WITH {VEC}, {CELLS} SELECT a, sum(n)::BIGINT AS n, count(*) AS n_partners, arg_min(b, row(-n, b)) AS dominant, round(max(share_a), 6) AS dominant_share, round(CASE WHEN count(*) > 1 THEN -sum(share_a * ln(share_a)) / ln(count(*)) ELSE 0 END, 6) AS normalized_entropy FROM cells GROUP BY 1",
    "clustering_agreement": f"""WITH {VEC}, {CELLS}, t AS (SELECT sum(n)::DOUBLE AS tot FROM cells), ma AS (SELECT DISTINCT a, n_a FROM cells), mb AS (SELECT DISTINCT b, n_b FROM cells),
 x AS (SELECT -sum(n_a / tot * ln(n_a / tot)) AS h_a, sum(n_a * (n_a - 1) / 2.0) AS pa FROM ma, t), y AS (SELECT -sum(n_b / tot * ln(n_b / tot)) AS h_b, sum(n_b * (n_b - 1) / 2.0) AS pb FROM mb, t), z AS (SELECT sum(n / tot * ln(n * tot / (n_a * n_b::DOUBLE))) AS mi, sum(n * (n - 1) / 2.0) AS pp FROM cells, t),
 r AS (SELECT *, mi / h_a AS hom, mi / h_b AS com, pa * pb / (tot * (tot - 1) / 2) AS e FROM x, y, z, t)
 SELECT tot::BIGINT AS n_records, round(h_a, 6) AS h_a, round(h_b, 6) AS h_b, round(mi, 6) AS mi, round(hom, 6) AS homogeneity, round(com, 6) AS completeness, round(2 * hom * com / (hom + com), 6) AS v_measure, round(mi / ((h_a + h_b) / 2), 6) AS nmi, round((pp - e) / ((pa + pb) / 2 - e), 6) AS ari FROM r""",
    "adjusted_mutual_information": f"""WITH {VEC}, {CELLS}, t AS (SELECT sum(n)::DOUBLE AS tot FROM cells), ma AS (SELECT DISTINCT a, n_a FROM cells), mb AS (SELECT DISTINCT b, n_b FROM cells),
 h AS (SELECT (SELECT -sum(n_a / tot * ln(n_a / tot)) FROM ma, t) AS h_a, (SELECT -sum(n_b / tot * ln(n_b / tot)) FROM mb, t) AS h_b, (SELECT sum(n / tot * ln(n * tot / (n_a * n_b::DOUBLE))) FROM cells, t) AS mi),
 g AS (SELECT n_a::DOUBLE AS x, n_b::DOUBLE AS y, tot, unnest(range(greatest(1, n_a + n_b - tot)::BIGINT, least(n_a, n_b)::BIGINT + 1))::DOUBLE AS k FROM ma, mb, t),
 e AS (SELECT sum(k / tot * ln(tot * k / (x * y)) * exp(lgamma(x + 1) + lgamma(y + 1) + lgamma(tot - x + 1) + lgamma(tot - y + 1) - lgamma(tot + 1) - lgamma(k + 1) - lgamma(x - k + 1) - lgamma(y - k + 1) - lgamma(tot - x - y + k + 1))) AS emi FROM g)
 SELECT tot::BIGINT AS n_records, round((mi - emi) / ((h_a + h_b) / 2 - emi), 6) AS ami FROM h, e, t""",
    "parent_inherited_join": f"WITH {LAB} SELECT parent AS a, cluster_id AS b, count(*) AS n FROM s GROUP BY 1, 2",
    "assignment_review": f"WITH {LAB} SELECT record_id, cluster_id, count(*) OVER (PARTITION BY cluster_id) AS cluster_size, scene, CASE WHEN cluster_id >= 0 THEN 0 ELSE 3 END AS sort_group FROM s",
    "cluster_top5": f"WITH {LAB}, r AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY record_id) <= 5) SELECT cluster_id, string_agg(record_id, ',' ORDER BY record_id) AS samples FROM r GROUP BY 1",
    "key_problems": " UNION ALL ".join(f"SELECT reason, count(*) AS n_keys, sum(n)::BIGINT AS n_rows, '{t}' AS table_name FROM (SELECT count(*) AS n, CASE WHEN {n_(k)} = '' THEN 'blank' WHEN count(*) > 1 THEN 'repeated' END AS reason FROM {t} GROUP BY {k}) WHERE reason IS NOT NULL GROUP BY 1" for t, k in (("raw_records", "record_id"), ("structured_records", "record_id"), ("embedding_cache", "cache_key"))),
    "orphan_candidates": "SELECT DISTINCT raw_record_id, candidate_id FROM extraction_candidates c WHERE NOT EXISTS (SELECT 1 FROM canonical_raw_records r WHERE r.canonical_raw_record_id = c.raw_record_id)",
    "path_frame": f"WITH {UNITS}, {LAB} SELECT u.record_id, u.raw_record_id, s.parent, CASE WHEN len(u.object) > 0 THEN 'object: ' || array_to_string(u.object, '; ') ELSE '' END AS target_text, len(u.object) > 0 AS target_valid FROM u JOIN s USING (record_id)",
    "parent_profiles": f"WITH {PATH} SELECT parent, count(*) AS n_units, count(*) FILTER (valid) AS n_targets, round(count(*) FILTER (valid) / count(*), 6) AS coverage FROM p WHERE parent >= 0 GROUP BY 1",
    "threshold_grid": f"WITH {PATH}, q AS (SELECT parent, count(*) AS u, count(*) FILTER (valid) AS t FROM p WHERE parent >= 0 GROUP BY 1) SELECT a::INT AS parent_min, b::INT AS target_min, count(*) FILTER (u >= a AND t >= b) AS n_eligible, coalesce(sum(u) FILTER (u >= a AND t >= b), 0)::BIGINT AS eligible_units, coalesce(sum(t) FILTER (u >= a AND t >= b), 0)::BIGINT AS eligible_targets, sum(u)::BIGINT AS all_units, round(coalesce(sum(u) FILTER (u >= a AND t >= b), 0) / sum(u), 6) AS unit_share FROM q, (VALUES (5), (10), (30)) x(a), (VALUES (5), (20)) y(b) GROUP BY 1, 2",
    "local_summary": f"WITH {LOCAL} SELECT count(*) AS n_parents, sum(n_children)::BIGINT AS n_children, round(count(*) FILTER (n_children >= 2) / count(*), 6) AS multi_child_share, quantile_cont(n_children, 0.25) AS q1, quantile_cont(n_children, 0.5) AS median, quantile_cont(n_children, 0.75) AS q3, round(sum(n_units * quality) / sum(n_units) FILTER (quality IS NOT NULL), 6) AS weighted_value FROM l",
    "representative_parent": f"WITH {LOCAL} SELECT parent, n_units, n_children FROM l WHERE n_children >= 2 ORDER BY n_units DESC, parent LIMIT 1",
    "candidate_pairs": f"WITH {PAIRS} SELECT key_a, key_b, cross_parent, round(similarity, 5) AS similarity, mutual, either, high FROM cp",
    "rule_comparison": f"WITH {PAIRS}, r AS (SELECT *, unnest(list_filter(['mutual', 'either', 'high', 'mutual_or_high'], lambda x: CASE x WHEN 'mutual' THEN mutual WHEN 'either' THEN either WHEN 'high' THEN high ELSE mutual OR high END)) AS rule FROM cp) SELECT rule, count(*) AS n_pairs, count(*) FILTER (cross_parent) AS n_cross_parent, round(avg(similarity), 5) AS mean_similarity FROM r GROUP BY 1",
    "relation_flatten": "SELECT raw_record_id, (row_number() OVER (PARTITION BY raw_record_id ORDER BY cand_pos, candidate_id, source_model) - 1)::INT AS place, cand_pos, candidate_id, source_model FROM (SELECT DISTINCT * FROM extraction_candidates)",
    "relation_requests": "WITH b AS (SELECT *, (row_number() OVER (ORDER BY record_id) - 1) // 6 AS batch FROM structured_records) SELECT batch::INT AS batch, count(*)::INT AS n_items, sha256('[' || string_agg(json_object('record_id', record_id, 'raw_record_id', raw_record_id, 'finding', finding)::VARCHAR, ',' ORDER BY record_id) || ']') AS payload_sha256 FROM b GROUP BY 1",
    "controls_from_synthesis": f"WITH c AS (SELECT DISTINCT raw_record_id, {n_('scene')} AS name, source_model FROM extraction_candidates WHERE {n_('scene')} <> ''), g AS (SELECT raw_record_id, name, list_sort(list(source_model)) AS m FROM c GROUP BY 1, 2), p AS (SELECT *, row_number() OVER (PARTITION BY raw_record_id ORDER BY name) AS place FROM g), n AS (SELECT *, row_number() OVER (ORDER BY raw_record_id, array_to_string(m, chr(31)), place) AS n FROM p WHERE len(m) >= 2) SELECT 'CTRL-' || lpad(n::VARCHAR, greatest(3, len(n::VARCHAR))::INT, '0') AS control_id, raw_record_id, name, len(m)::INT AS n_members, m[1] AS first_member FROM n",
    "answer_partition": "WITH c AS (SELECT DISTINCT * FROM extraction_candidates), a AS (SELECT DISTINCT raw_record_id, m AS source_model FROM c, (VALUES ('lm-aster'), ('lm-gorse')) t(m)), b AS (SELECT source_model, raw_record_id, count(*) AS n FROM c WHERE source_model IN ('lm-aster', 'lm-gorse') GROUP BY 1, 2), e AS (SELECT source_model, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END AS reason FROM a LEFT JOIN b USING (source_model, raw_record_id)) SELECT source_model, reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY 1, 2",
    "answer_partition_all": f"WITH c AS (SELECT DISTINCT * FROM extraction_candidates), a AS (SELECT DISTINCT raw_record_id, m AS source_model FROM c, (VALUES {', '.join(f"('{m}')" for m in MODELS)}) t(m)), b AS (SELECT source_model, raw_record_id, count(*) AS n FROM c GROUP BY 1, 2), e AS (SELECT source_model, CASE WHEN n IS NULL THEN 'missing' WHEN n > 1 THEN 'repeated' END AS reason FROM a LEFT JOIN b USING (source_model, raw_record_id)) SELECT source_model, reason, count(*) AS n FROM e WHERE reason IS NOT NULL GROUP BY 1, 2",
    "diverse_sample": f"WITH c AS (SELECT candidate_id, source_model, {n_('scene')} AS scene FROM (SELECT DISTINCT * FROM extraction_candidates)), t AS (SELECT *, row_number() OVER (PARTITION BY source_model, scene ORDER BY candidate_id) AS t FROM c) SELECT candidate_id, source_model, scene, row_number() OVER (PARTITION BY source_model ORDER BY t, scene, candidate_id)::INT AS place FROM t QUALIFY place <= 12",
    "knowledge_cards": f"WITH c AS (SELECT *, coalesce(confidence >= 0.85, false) AS sup, {n_('scene')} AS sc FROM (SELECT DISTINCT * FROM extraction_candidates)), m AS (SELECT source_model, sc, count(*) AS m FROM c WHERE sup GROUP BY 1, 2), l AS (SELECT source_model, string_agg(sc || ':' || m, ';' ORDER BY m DESC, sc) AS modes FROM m GROUP BY 1) SELECT c.source_model, count(*) AS n_units, count(*) FILTER (sup) AS n_support, count(DISTINCT raw_record_id) FILTER (sup) AS n_topics, any_value(modes) AS modes, round(count(*) FILTER (sup) / count(*), 6) AS support_ratio FROM c LEFT JOIN l USING (source_model) GROUP BY 1",
}

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from siftwork.functions import text as T
from siftwork.operators import correspondence as R
from siftwork.operators import evaluation as E
from siftwork.operators import ordinal, topics, vectors
from siftwork.operators.groups import connected_components, pairs_within
from siftwork.sources import tables as S


def test_pairs_within_blocks(spark):
    rng = random.Random(1)
    rows = [(rng.choice("abc"), f"k{i:03d}", rng.choice("xy")) for i in range(60)] + [(None, "n1", "x"), (None, "n2", "x"), ("a", None, "x")]
    df = spark.createDataFrame(rows, "g string, key string, v string")
    for block in (3, 1000):
        got = [tuple(r) for r in pairs_within(df, ["g"], "key", "v", block).collect()]
        want = [(a[0], *sorted((a[1], b[1]))) for a, b in itertools.combinations([r for r in rows if r[0] and r[1]], 2) if a[0] == b[0] and a[2] != b[2]]
        assert sorted(got) == sorted(set(want))


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(7, 7)]
    parent = {n: n for e in edges for n in e}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    assert got == {n: find(n) for n in parent}
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0


def test_ordinals_do_not_depend_on_partitions(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1009).alias("x"), F.lit("g").alias("g"))
    for d in (df, df.repartition(7)):
        got = {r["x"]: r["n"] for r in ordinal.with_ordinal(d, ["x"], "n").collect()}
        assert got == {x: i + 1 for i, x in enumerate(sorted(got))}
    ranks = [r["r"] for r in ordinal.rank_in_group(df, "g", ["x"], "r").collect()]
    assert sorted(ranks) == list(range(1, 1001))


def test_text_functions(spark):
    rows = [("　a \u001c b​ ", None), (None, "[]"), ("", "['甲', \"乙\"]"), ("x", '["b","a","a",null,""]'), ("y", "（阀）；阀，门")]
    df = spark.createDataFrame(rows, "t string, o string")
    got = df.select(T.normalize_text("t").alias("n"), T.parse_objects("o").alias("o"), T.is_present("o").alias("p"), T.json_list("o").alias("j")).collect()
    assert [r["n"] for r in got] == ["a b​", "", "", "x", "y"]
    assert [r["o"] for r in got] == [[], [], ["乙", "甲"], ["a", "b"], ["门", "阀"]]
    assert [r["p"] for r in got] == [False, False, True, True, True]
    assert got[3]["j"] == ["b", "a", "a"] and got[1]["j"] == []


def test_fenced_json_and_safe_int(spark):
    df = spark.createDataFrame([('```json\n{"a": 1}\n```', "3.7"), ("so: [1, 2] done", "x"), ("none", None)], "t string, i string")
    got = df.select(T.fenced_json("t").alias("t"), T.safe_int("i").alias("i")).collect()
    assert [r["t"] for r in got] == ['{"a": 1}', "[1, 2]", None] and [r["i"] for r in got] == [3, 0, 0]


def test_assignment_is_optimal():
    rng = np.random.default_rng(0)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        s = rng.random((n, m)).round(2)
        pairs = E.assignment(s)
        small, large = sorted((n, m))
        t = s if n <= m else s.T
        best = max(sum(t[i, p[i]] for i in range(small)) for p in itertools.permutations(range(large), int(small)))
        assert len(pairs) == small and abs(sum(s[i, j] for i, j in pairs) - best) < 1e-9


def test_silhouette_matches_pair_distances(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=(40, 4)), [*rng.integers(0, 3, 38), 5, -1]
    df = spark.createDataFrame([(i, int(l), v.tolist()) for i, (v, l) in enumerate(zip(x, y))], "id int, l int, v array<double>")
    got = {r["id"]: r["silhouette"] for r in vectors.silhouette(df, "id", "l", "v", 4).collect()}
    keep = [i for i in range(40) if y[i] >= 0]
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    d = 1 - u @ u.T
    for i in keep:
        own = [j for j in keep if y[j] == y[i] and j != i]
        a = d[i, own].mean() if own else 0
        b = min(d[i, [j for j in keep if y[j] == c]].mean() for c in set(y) - {y[i], -1})
        assert got[i] == pytest.approx((b - a) / max(a, b) if own else 0.0)


def test_topics_compared_in_lots(spark, monkeypatch):
    """Selected pairs and similarities of all topics, in one lot and in many, against all pairs written out."""
    rng = np.random.default_rng(6)
    c = rng.normal(size=(40, 5)).round(2)
    df = spark.createDataFrame([(f"t{i:02d}", i % 3, v.tolist()) for i, v in enumerate(c)], "topic_id string, parent int, centroid array<double>")
    u = c / np.linalg.norm(c, axis=1, keepdims=True)
    s = np.round(u @ u.T, 9)
    i, j = np.triu_indices(40, 1)
    least = round(float(np.quantile(s[i, j][i % 3 != j % 3], 0.95)), 9)
    near = {a: [b for b in sorted(range(40), key=lambda b: (-s[a, b], b)) if b != a][:5] for a in range(40)}
    want = {(f"t{a:02d}", f"t{b:02d}", a in near[b] and b in near[a], s[a, b] >= least) for a, b in zip(i.tolist(), j.tolist()) if a in near[b] or b in near[a] or s[a, b] >= least}
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(c)], "l int, v array<double>")
    for lot in (1 << 16, 7):
        monkeypatch.setattr(vectors.against_all, "__defaults__", (lot,))
        got = {(r["key_a"], r["key_b"], r["mutual"], r["high"]) for r in topics.candidate_pairs(df).collect()}
        assert got == want
        r = vectors.topic_similarity(rows, "l", "v", 5).first()
        assert r["n_pairs"] == 780 and r["mean_similarity"] == pytest.approx(s[i, j].mean()) and r["max_similarity"] == pytest.approx(s[i, j].max())
    assert topics.candidate_pairs(df.limit(1)).count() == 0 and topics.candidate_pairs(df.limit(0)).count() == 0


def test_silhouette_in_passes(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([(i, int(rng.integers(0, 9)), rng.normal(size=3).tolist()) for i in range(80)], "id int, l int, v array<double>")
    one, many = ({r["id"]: r["silhouette"] for r in vectors.silhouette(df, "id", "l", "v", 3, topics=t).collect()} for t in (100, 2))
    assert len(one) == 80 and one == pytest.approx(many)
    assert vectors.silhouette(df.filter("l = 1"), "id", "l", "v", 3).count() == 0


def test_log_gamma():
    import math

    x = np.array([1.0, 1.5, 2, 3, 10, 1e3, 1e7])
    assert np.allclose(R.log_gamma(x), [math.lgamma(v) for v in x], rtol=1e-12, atol=1e-12)


def test_agreement_of_equal_and_random_labels(spark):
    rng = random.Random(4)
    same = spark.createDataFrame([(i % 5, i % 5) for i in range(200)], "a int, b int")
    r = R.agreement(R.contingency(same), True).first()
    assert r["ami"] == pytest.approx(1) and r["ari"] == pytest.approx(1) and r["nmi"] == pytest.approx(1)
    loose = spark.createDataFrame([(rng.randrange(5), rng.randrange(5)) for _ in range(2000)], "a int, b int")
    r = R.agreement(R.contingency(loose), True).first()
    assert abs(r["ami"]) < 0.02 and abs(r["ari"]) < 0.02


def test_cliques(spark):
    edges = [(1, 2), (2, 3), (1, 3), (3, 4), (5, 6), (6, 7), (7, 5), (7, 8), (8, 5)]
    got = {r["clique"] for r in topics.maximal_cliques(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {"1|2|3", "3|4", "5|6|7", "5|7|8"}
    rng = random.Random(11)
    near = {n: set() for n in range(24)}
    edges = [(rng.randrange(24), rng.randrange(24)) for _ in range(150)] + [(None, 3)]
    for a, b in edges:
        if a is not None and a != b:
            near[a].add(b), near[b].add(a)
    cliques = {frozenset(c) for n in range(24) for k in range(1, 7) for c in itertools.combinations(sorted(near[n]), k) if all(y in near[x] for x, y in itertools.combinations(c, 2)) for c in [(n, *c)]}
    want = {c for c in cliques if not any(c <= near[n] for n in range(24))}
    got = topics.maximal_cliques(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()
    assert {frozenset(map(int, r["clique"].split("|"))) for r in got} == want and len(got) == sum(map(len, want))
    assert topics.maximal_cliques(spark.createDataFrame([(1, 1)], "a int, b int"), "a", "b").count() == 0
    # A component of more nodes than one search would hold: a ring with chords.
    ring = [(i, (i + j) % 1000) for i in range(1000) for j in (1, 2)]
    assert topics.maximal_cliques(spark.createDataFrame(ring, "a int, b int"), "a", "b").count() == 3000


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([("x", " a ", 2), ("y", None, 1), ("z", "　", 3), ("w", "b", 4)], "id string, text string, p int")
    assert [tuple(r) for r in S.raw_texts(df, "p").orderBy("src_pos").collect()] == [("x", "a", 2), ("w", "b", 4)]
    assert [r["record_id"] for r in S.raw_texts(df.drop("id"), "p").orderBy("src_pos").collect()] == ["R00001", "R00003"]
    S.write_csv(df.withColumn("l", F.array(F.lit("q"))), str(tmp_path / "c.csv"))
    back = S.read_any(spark, str(tmp_path / "c.csv"))
    assert back.filter("id = 'x'").first()["l"] == '["q"]'
    S.append_cache(spark.createDataFrame([("k", [1.0, 0.0], 1), ("k", [0.0, 2.0], 2), ("z", [0.0, 0.0], 3)], "key string, v array<double>, n int"), str(tmp_path / "cache"))
    got = S.cached_vectors(spark.read.parquet(str(tmp_path / "cache")), "key", "v", "n", 2)
    assert [tuple(r) for r in got.collect()] == [("k", [0.0, 2.0])]
    need = spark.createDataFrame([("k",), ("m",)], "key string")
    assert [r["key"] for r in S.missing_keys(need, got, "key").collect()] == ["m"]
    assert "| a\\|b |" in S.markdown(spark.createDataFrame([("a|b",)], "c string"))


def test_transport_is_the_assignment_of_copies():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n, m = rng.integers(1, 6, 2)
        s, a, b = rng.random((n, m)).round(2), rng.integers(1, 5, n), rng.integers(1, 5, m)
        moved = E.transport(s, a, b)
        copies = np.repeat(np.repeat(s, a, axis=0), b, axis=1)
        assert sum(q for _, _, q in moved) == min(a.sum(), b.sum())
        assert all(sum(q for i, _, q in moved if i == k) <= a[k] for k in range(n)) and all(sum(q for _, j, q in moved if j == k) <= b[k] for k in range(m))
        assert abs(sum(s[i, j] * q for i, j, q in moved) - sum(copies[i, j] for i, j in E.assignment(copies))) < 1e-9


def test_large_record_is_matched_whole(spark):
    """2,100 units on one side of a record: its other pairs are not left out, and are the best ones."""
    unit = "raw_record_id string, unit string, finding string, objects array<string>, scene string"
    side = lambda s, n, tail: [("r", f"{s}{i:05d}", f"裂缝{'甲乙丙'[i % 3]}{i % 40}{tail}", ["泵"], "") for i in range(n)] + [("q", f"{s}x", f"锈{tail}", ["阀"], "")]
    p, g = (spark.createDataFrame(rows, unit) for rows in (side("p", 2100, "深") + [("r", "pz", "同", [], "")], side("g", 2400, "") + [("r", "gz", "同", [], "")]))
    got = E.match_units(p, g, "raw_record_id", "unit").collect()
    assert len(got) == 2102 and len({r["unit_p"] for r in got}) == len({r["unit_g"] for r in got}) == 2102
    assert [(r["unit_p"], r["unit_g"]) for r in got if r["exact"]] == [("pz", "gz")]
    scored = E.scored_pairs(E.match_units(p, g, "raw_record_id", "unit"), p, g, "raw_record_id", "unit").filter("not exact")
    kind = lambda i: f"裂缝{'甲乙丙'[i % 3]}{i % 40}"
    f1 = sum(2 * len(kind(i)) / (2 * len(kind(i)) + 1) for i in range(2100)) + 2 / 3
    assert abs(scored.agg(F.sum("finding_f1")).first()[0] - f1) < 1e-6


def test_every_model_is_evaluated(spark, tmp_path):
    """Each model has its row, and the common scores take the units that all models matched."""
    from siftwork.plans import clusters, evaluation
    from siftwork.plans.records import MODELS

    s = spark.createDataFrame([("u1", "r1", "漏油", "泵", "仓库"), ("u2", "r2", "锈蚀", "阀", "车间")], "record_id string, raw_record_id string, finding string, object string, scene string")
    rows = [(f"{m}1", m, "r1", 0, "漏油" if k else "漏", "泵", "仓库") for k, m in enumerate(MODELS)] + [("x2", MODELS[1], "r2", 0, "锈蚀", "阀", "车间")]
    c = spark.createDataFrame(rows, "candidate_id string, source_model string, raw_record_id string, cand_pos int, finding string, object string, scene string")
    s.write.parquet(f"{tmp_path}/structured_records.parquet")
    c.write.parquet(f"{tmp_path}/extraction_candidates.parquet")
    got = {r["source_model"]: (r["n_pred"], r["n_gold"], r["n_hits"], r["n_pairs"]) for r in evaluation.extraction_eval(spark, str(tmp_path)).collect()}
    assert got == {m: (1, 2, 1, 1) for m in MODELS} | {MODELS[0]: (1, 2, 0, 1), MODELS[1]: (2, 2, 2, 2)}
    common = {r["source_model"]: (r["n_common"], round(r["mean_finding_f1"], 3)) for r in evaluation.common_matches(spark, str(tmp_path)).collect()}
    assert common == {m: (1, 1.0) for m in MODELS} | {MODELS[0]: (1, 0.667)}
    assert evaluation.exact_unit_match_all(spark, str(tmp_path)).count() == 7
    missing = {r["source_model"]: r["n"] for r in clusters.answer_partition_all(spark, str(tmp_path)).collect()}
    assert missing == {m: 1 for m in MODELS if m != MODELS[1]}

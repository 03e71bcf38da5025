import json
import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwork.operators import packed as P

ALL = P.DELIMITERS


def test_rules():
    cases = {
        "甲;乙 ； 丙,丁，戊、己|庚/辛": list("甲乙丙丁戊己庚辛"),
        "a; b ,c/d": ["a", "b", "c/d"],
        '["1/2\\"接头；堵头","x"]': ['1/2"接头；堵头', "x"],
        "['吊钩|钢丝绳', 'a']": ["吊钩|钢丝绳", "a"],
        '"2""软管"/“灭火器、消火栓”|\'标牌，警示灯\'': ['2"软管', "灭火器、消火栓", "标牌，警示灯"],
        "1.5/2.0t葫芦；2,500kVA变压器": ["1.5/2.0t葫芦", "2,500kVA变压器"],
        "I/O模块,AC/DC转换器": ["I/O模块", "AC/DC转换器"],
        "法兰[PN16;PN25]、软管（2寸，3寸）": ["法兰[PN16;PN25]", "软管（2寸，3寸）"],
        " 行车， ，箱 ;": ["行车", "箱"],
        "[]": [],
        "   ": [],
        '"没有结束；甲': ['"没有结束', "甲"],
        "甲（乙；丙": ["甲（乙", "丙"],
        "[PN16]法兰；[PN25]": ["[PN16]法兰", "[PN25]"],
    }
    for cell, want in cases.items():
        assert P.values_of(cell, ALL) == want, cell


def test_long_and_hostile_cells_end():
    assert len(P.values_of("阀；" * 50_000, ALL)) == 50_000
    for bad in ("(" * 50_000, '"' * 50_001, "[" * 20_000 + "]" * 20_000, "“；" * 30_000):
        P.values_of(bad, ALL)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("甲乙ab1;，/ ", min_size=1, max_size=6).map(str.strip).filter(bool), max_size=6))
def test_lists_round_trip(values):
    assert P.values_of(json.dumps(values, ensure_ascii=False), ALL) == values
    assert P.values_of(repr(values), ALL) == values


def test_table(spark):
    rows = [("a", "s1", "泵；阀", 1), ("a", "s1", "泵；阀", 1), ("b", None, "门/锁", 2), ("c", "s2", None, 3), ("d", "s2", "", 4), ("e", "s2", '["u","v"]', 5)]
    df = spark.createDataFrame(rows, "id string, src string, cell string, item int")
    got = sorted(tuple(r) for r in P.split_packed(df, "id", "src", "cell").collect())
    assert got == [("a", 0, "泵"), ("a", 1, "阀"), ("b", 0, "门"), ("b", 1, "锁"), ("e", 0, "u"), ("e", 1, "v")]
    assert P.split_packed(df.limit(0), "id", "src", "cell").count() == 0


def test_inference_refuses_irregular_delimiter(spark):
    rows = [("s", f"阀；门{i}；泵") for i in range(20)] + [("s", "1|2|3|4|5|6|7|8|9|10")] * 1
    rows = [("s", c) for _, c in rows] + [("t", "||||||||||")]
    got = {(r["source"], r["delimiter"]): r["accepted"] for r in P.delimiter_scores(spark.createDataFrame(rows, "src string, cell string"), "src", "cell").collect()}
    assert got["s", "；"] and got.get(("t", "|")) is False


def test_odd_cells_refuse_no_delimiter(spark):
    """One cell of 5,000 pieces among 200 short ones, numbers only, and long pieces: every value comes out."""
    rows = [(f"a{i}", "s", f"阀{i}；门；泵") for i in range(200)] + [("big", "s", "；".join(f"件{i}" for i in range(5000)))]
    rows += [("n", "t", "12； 15； 7"), ("l", "u", "；".join(["长" * 90, "短" * 70]))]
    df = spark.createDataFrame(rows, "id string, src string, cell string")
    got = {r["row_key"]: r["n"] for r in P.split_packed(df, "id", "src", "cell").groupBy("row_key").agg(F.count("*").alias("n")).collect()}
    assert got == {f"a{i}": 3 for i in range(200)} | {"big": 5000, "n": 3, "l": 2}
    score = {r["source"]: r["score"] for r in P.delimiter_scores(df, "src", "cell").collect()}
    assert abs(score["s"] - 200 / 201) < 1e-9 and score["t"] == 0


def test_inference_refuses_marks_that_belong_to_values(spark):
    """In source s ` / ` stands within values, in source t the same mark separates them; commas alike."""
    rng = random.Random(3)
    things = ["阀门", "泵", "软管", "配电箱", "护栏", "吊钩"]
    rows = []
    for i in range(60):
        a, b = rng.sample(things, 2)
        rows.append((f"s{i:02d}", "s", f"{a}；AC / DC 电源；{b}" if i % 2 else f"{b}；钢丝绳，双股"))
        rows.append((f"t{i:02d}", "t", f"{a} / {b}，{rng.choice(things)}"))
    df = spark.createDataFrame(rows, "id string, src string, cell string")
    got = {(r["source"], r["delimiter"]): r["accepted"] for r in P.delimiter_scores(df, "src", "cell").collect()}
    assert got == {("s", "；"): True, ("s", "/"): False, ("s", "，"): False, ("t", "/"): True, ("t", "，"): True}
    cut = {}
    for r in P.split_packed(df, "id", "src", "cell").orderBy("row_key", "pos").collect():
        cut.setdefault(r["row_key"], []).append(r["item"])
    assert "AC / DC 电源" in cut["s01"] and len(cut["s01"]) == 3 and cut["s00"][1] == "钢丝绳，双股" and all(len(cut[f"t{i:02d}"]) == 3 for i in range(60))

import pytest

from basketgraph.functions import clean

CASES = [
    ("2012", "HT7", [("HT7", "body", "keep")]), ("2012", "PC6(bilaterally)", [("PC6", "body", "map")]), ("2012", "(Ear) Shenmen", [("EAR_SHENMEN", "ear", "map")]),
    ("2012", "occiput and subcortex", [("EAR_OCCIPUT", "ear", "split"), ("EAR_SUBCORTEX", "ear", "split")]), ("2012", "hands(unspecified)", [("", "unknown", "drop")]),
    ("2016", "Ear points: heart", [("EAR_HEART", "ear", "map")]), ("2016", "LR3. Yintang", [("LR3", "body", "split"), ("YINTANG", "body", "split")]), ("2016", "moxa:KI1", [("KI1", "body", "map")]),
    ("2016", "Sishencong", [("SISHENCONG", "body", "map")]), ("2020", "Ear Shenmen(bilateral)", [("EAR_SHENMEN", "ear", "map")]), ("2020", "Heart(CO15)", [("EAR_HEART", "ear", "map")]),
    ("2020", "Sympathetic autonomic(AH6a)", [("EAR_SYMPATHETIC", "ear", "map")]), ("2020", "DU14", [("GV14", "body", "map")]), ("2020", "RN12", [("CV12", "body", "map")]), ("2020", "EX-HN1(note)", [("EX-HN1", "body", "map")]),
    ("2020", "nothing known", [("", "unknown", "review_needed")]),
]


def test_cascades(spark):
    for version in clean.RULESETS:
        own = [(i, c[1]) for i, c in enumerate(CASES) if c[0] == version]
        rows = clean.standardize(spark.createDataFrame(own, "i int, item string"), "item", version).collect()
        assert {r.i: [(x.standard, x.category, x.action) for x in r.results] for r in rows} == {i: CASES[i][2] for i, _ in own}


def test_split_and_regroup(spark):
    df = spark.createDataFrame([(1, "HT7; HT7,\nPC7 or KI1, Yintang"), (2, None)], "basket int, text string")
    rows = df.select("basket", clean.split_items(df.text).alias("items"))
    log = clean.mapping_log(rows, ["basket"], ruleset="2016")
    out = {r.basket: (r.standard_items, r.dropped_items) for r in clean.regroup(rows, log, ["basket"]).collect()}
    assert out == {1: (["HT7", "YINTANG"], ["PC7 or KI1"]), 2: ([], [])}


def test_parse_list_raises(spark):
    df = spark.createDataFrame([("{}",)], "t string")
    with pytest.raises(Exception, match="not a list"):
        df.select(clean.parse_list(df.t)).collect()


def test_review_gate_raises(spark):
    log = spark.createDataFrame([(1, "HT7", "keep"), (2, "?", "review_needed")], "basket int, original string, action string")
    with pytest.raises(ValueError, match="1 items need review"):
        clean.require_reviewed(log)
    assert clean.require_reviewed(log.filter("basket = 1")).count() == 1

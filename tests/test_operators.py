import pytest
from pyspark.sql import functions as F

from siftwright.operators import compose, corrections, edges, facts, guard, roles, vocabulary

FACT = "row_id long, key string, value string, uom string, method string, confidence double, seq int"


def merged(spark, *claims):
    rows = [(1, "k", v, "", m, c, i) for i, (v, m, c) in enumerate(claims)]
    return facts.merged(spark.createDataFrame(rows, FACT)).first()


def test_agreement_raises_confidence(spark):
    f = merged(spark, ("120", "rule", 0.9), ("120", "llm", 0.7))
    assert f["confidence"] == pytest.approx(0.955) and len(f["sources"]) == 2


def test_contradiction_lowers_it(spark):
    f = merged(spark, ("White", "rule", 0.9), ("Black", "llm", 0.5))
    assert (f["value"], f["conflicts"]) == ("White", ["Black"]) and f["confidence"] == pytest.approx(0.585)


def test_order_matters_and_the_stronger_takes_over(spark):
    f = merged(spark, ("White", "rule", 0.5), ("Black", "registry", 0.9), ("black", "llm", 0.1))
    assert f["value"] == "Black" and f["confidence"] == pytest.approx(0.585 + (1 - 0.585) * 0.55)


def test_facts_without_evidence_are_rejected(spark):
    df = spark.createDataFrame([("a", ["x"]), ("b", []), ("", ["x"]), ("c", None)], "value string, evidence array<string>")
    good, bad = facts.admitted(df)
    assert [r["value"] for r in good.collect()] == ["a"] and sorted(r["value"] for r in bad.collect()) == ["b", "c"]


def test_a_blank_quote_grounds_nothing(spark):
    df = spark.createDataFrame([("Red Box", "red"), ("Red Box", " "), ("Red Box", "blue"), ("Red Box", None)], "text string, quote string")
    assert facts.grounded(df).count() == 1


def test_guards(spark):
    rows = [(1, "arbor_size", "20", "in"), (1, "diameter", "12", "in"), (2, "arbor_size", "20", "mm"), (2, "diameter", "12", "in"), (3, "color_temperature", "49382", "K")]
    found = {(r["row_id"], r["rule"]) for r in guard.findings(spark.createDataFrame(rows, "row_id long, key string, value string, uom string")).collect()}
    assert (1, "GRD-REL-ARB") in found and (3, "GRD-DOM-K") in found and not any(r == 2 for r, _ in found)


def test_budget_line(spark):
    pieces = F.array(*[F.struct(F.lit(x).alias("key"), compose.forms(F.lit(x)).alias("forms")) for x in ("Dishwasher", "Stainless Steel", "x" * 50, "Built-in")])
    line = spark.range(1).select(compose.within_budget(pieces, 40).alias("l")).first()["l"]
    assert line["text"] == "DISHWASHER SST BLTLN" and line["dropped"] == ["x" * 50] and line["used"] <= 40


def test_slots_round_trip(spark):
    df = spark.createDataFrame([(1, "a", "x", 1), (1, "b", "y", 0), (2, "c", "z", 0)], "row_id long, key string, value string, priority int")
    back = compose.narrow(compose.wide(compose.slotted(df, 3), 3), "row_id", 3)
    assert {tuple(r) for r in back.collect()} == {(1, 1, "b", "y"), (1, 2, "a", "x"), (2, 1, "c", "z")}


def test_edges_are_distinct_and_never_loops(spark):
    e = spark.createDataFrame([(1, 2, "r", "A"), (1, 1, "r", "A")], "source long, target long, relation string, rule string")
    again = spark.createDataFrame([(1, 2, "r", "B")], e.schema)
    assert [tuple(r) for r in edges.distinct(e, again).collect()] == [(1, 2, "r", "A")]


def test_narrow_scope_wins_and_upserts_replace(spark):
    c = spark.createDataFrame([("part", "1", "k", "old", 1), ("classpath", "t", "k", "wide", 2)], "scope string, target string, key string, value string, seq int")
    c = corrections.upserted(c, spark.createDataFrame([("part", "1", "k", "new", 3)], c.schema))
    rows = spark.createDataFrame([(1, 1, "t"), (2, 2, "t")], "row_id long, part long, classpath string")
    f = spark.createDataFrame([(1, "k", "a", 0.5)], "row_id long, key string, value string, confidence double")
    got = {r["row_id"]: (r["value"], r["was"]) for r in corrections.applied(f, rows, c, {"part": "part", "classpath": "classpath"}).collect()}
    assert got == {1: ("new", "a"), 2: ("wide", None)}


def test_roles_by_name(spark):
    df = spark.createDataFrame([("Satco", "X1", "S4724", "S4724 4W Lamp", "Satco", "", "425")], ["Vendor Name", "internal_id", "MFR PART #", "Item Description", "Make", "notes", "qty_on_hand"])
    found = {r: c for r, (c, _) in roles.detect(df).items()}
    assert found["manufacturer"] == "Vendor Name" and found["sku"] == "internal_id" and found["mpn"] == "MFR PART #" and found["description"] == "Item Description" and found["brand"] == "Make"


def test_vocabulary(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(["red ring", "red ring", "blue ring", ""])], "id long, t string")
    got = {r["gram"]: r["n"] for r in vocabulary.mine(df, "t", seeds=["nut"]).collect()}
    assert got == {"ring": 3, "red ring": 2, "nut": 0}


def test_quotes_are_found_in_all_of_a_text_and_in_its_expansion(spark):
    text = "Kichler Wall Lt " + "x" * 5000 + " brushed in the middle " + "y" * 5000 + " sold in pairs"
    rows = [(1, text, "kichler"), (2, text, "In The Middle"), (3, text, "sold in pairs"), (4, text, "wall light"), (5, text, "absent"), (6, text, " "), (7, None, "a")]
    got = facts.grounded(spark.createDataFrame(rows, "id int, text string, quote string"))
    assert sorted(r["id"] for r in got.collect()) == [1, 2, 3, 4]


def test_further_roles(spark):
    df = spark.createDataFrame([("a", "b", "c", "d")], ["Our System Brand", "Brand", "Mfg Part Num", "Part Desc"])
    assert {r: c for r, (c, _) in roles.detect(df, {"brand_erp": [r"^our[_ ]?system[_ ]?brand"]}).items()} == {"brand_erp": "Our System Brand", "brand": "Brand", "mpn": "Mfg Part Num", "description": "Part Desc"}


def test_similar_names(spark):
    from siftwright.operators import registry

    df = spark.createDataFrame([("rings",), ("bolts",), ("zzz",), (None,), ("rings",)], "n string")
    got = sorted((r["n"] or "", r["nearest"], r["ratio"]) for r in registry.similar(df, "n", ["Ring", "Bolt", "ringer"], 0.8).collect())
    assert got == [("", None, None), ("bolts", "Bolt", pytest.approx(8 / 9)), ("rings", "Ring", pytest.approx(8 / 9)), ("rings", "Ring", pytest.approx(8 / 9)), ("zzz", None, None)]

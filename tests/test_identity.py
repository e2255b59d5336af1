import difflib

import pytest
from pyspark.sql import functions as F

from siftwright.operators import registry

ENTRIES = [
    ("Philips", "Signify Holding", "®", ["phillips", "philips lighting"], [], 0),
    ("Milwaukee", "Milwaukee Tool", "®", ["milw"], ["48-", "2"], 1),
    ("Freud", "Freud America, Inc.", "®", ["freud inc"], [], 2),
    ("Cooper Lighting", "Signify Holding", "®", [], [], 3),
    ("Rheem", "Rheem Manufacturing", "", [], ["48-1"], 4),
    ("Freudo", "Other", "", [], [], 5),
]


@pytest.fixture(scope="module")
def known(spark):
    return spark.createDataFrame(ENTRIES, registry.ENTRY)


def rows(spark, *given):
    return spark.createDataFrame([(i, *g) for i, g in enumerate(given)], "row_id long, text string, mpn string, manufacturer string, brand_dib string, brand_e1 string")


def test_cascade(spark, known):
    given = [
        ("x", "m", "Freud Inc (2435)", "PHILIPS LIGHTING", None),  # brand column, by alias
        ("x", "m", None, None, "Milwauke"),  # second brand column, by similarity
        ("x", "m", None, "Nobody Knows", None),  # as supplied
        ("Milw disc", "m", "Freud Inc", None, None),  # mention in the text before the supplier
        ("#2 Phillips drive bit", "m", "Freud Inc (2435)", None, None),  # an everyday word there, so the supplier
        ("lamp by Phillips", "m", None, None, None),
        ("x", "m", "Freude Incorp", None, None),  # supplier by similarity
        ("x", "48-1999", "Some Lumber Yard", None, None),  # reseller: longest prefix
        ("x", "48-1", "Building Materials Co-op", None, None),  # longer prefix is the whole code, so the shorter
        ("x", "m", "ABC Wholesale", None, None),  # abstains
        ("x", "m", "Rees Cast Stone Company (REECA)", None, None),  # as it is
        (None, None, None, None, None),
    ]
    got = [r["identity"] for r in registry.identified(rows(spark, *given), known).orderBy("row_id").collect()]
    r1, r6 = difflib.SequenceMatcher(None, "milwauke", "milwaukee").ratio(), difflib.SequenceMatcher(None, "freude incorp", "freud").ratio()
    assert r6 < 0.86
    want = [
        ("Philips®", "Signify Holding", "registry", 0.95, False), ("Milwaukee®", "Milwaukee Tool", "registry", 0.93 * r1, False), ("Nobody Knows", "Nobody Knows", "input", 0.70, True), ("Milwaukee®", "Milwaukee Tool", "registry", 0.88, False),
        ("Freud®", "Freud America, Inc.", "registry", 0.90, False), ("Philips®", "Signify Holding", "registry", 0.88, False), ("Freude Incorp", "Freude Incorp", "input", 0.58, True), ("Rheem", "Rheem Manufacturing", "rule", 0.80, False),
        ("Milwaukee®", "Milwaukee Tool", "rule", 0.80, False), (None, None, "abstain", 0.0, False), ("Rees Cast Stone Company", "Rees Cast Stone Company", "input", 0.58, True),
    ]
    assert got[11] is None
    for g, (brand, maker, method, confidence, unverified) in zip(got[:11], want, strict=True):
        assert (g["brand"], g["manufacturer"], g["method"], g["unverified"]) == (brand, maker, method, unverified) and g["confidence"] == pytest.approx(confidence)


def test_mismatch(spark, known):
    given = [("x", "m", "Rheem", "Freud", None), ("x", "m", "Cooper Lighting", "Philips", None), ("x", "m", "Freudo", "Freud", None), ("x", "m", "Unknown Firm", "Freud", None), ("x", "m", "Rheem Supply", "Freud", None)]
    got = registry.mismatches(registry.identified(rows(spark, *given), known)).collect()
    assert [(r["row_id"], r["supplied_brand"], r["resolved"]) for r in got] == [(0, "Rheem", "Freud America, Inc.")]


def test_taught_aliases_and_master_lists(spark, known):
    store = spark.createDataFrame([("brand", "ACME Supply Desk ", "brand_alias", "milw"), ("brand", "zzz", "brand_alias", "nobody"), ("part", "1", "size", "2")], "scope string, target string, key string, value string")
    more = registry.taught(known, store)
    assert {r["brand"] for r in more.filter(F.array_contains("aliases", "acme supply desk")).collect()} == {"Milwaukee"} and more.count() == 6
    listed = spark.createDataFrame([("Acme®", "Acme Inc"), ("", "Maker Only"), ("", ""), ("FREUD", "Freud America Inc")], "BRAND_NAME string, MANUFACTURER_NAME string")
    got = registry.loaded(listed, known).orderBy("seq").collect()
    assert [(r["brand"], r["symbol"]) for r in got][:3] == [("Acme", "®"), ("Maker Only", ""), ("FREUD", "")] and [r["brand"] for r in got][3:] == ["Philips", "Milwaukee", "Cooper Lighting", "Rheem", "Freudo"]
    assert registry.loaded(listed.filter("BRAND_NAME = 'none'")).count() == 0

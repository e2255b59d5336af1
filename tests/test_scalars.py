import pytest
from pyspark.sql import functions as F

from siftwright.functions import extract, scalars


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("v", ["-- Unbranded --", "-- No DIB Brand --", "N/A", "-", "", "   ", None])
def test_placeholders_are_void(spark, v):
    assert one(spark, scalars.clean(F.lit(v).cast("string"))) is None


def test_names_survive_cleaning(spark):
    assert one(spark, scalars.clean(F.lit(" Freud  Inc (2435)"))) == "Freud Inc (2435)"


@pytest.mark.parametrize(("v", "x"), [("0.5", "1/2"), ("50.25", "50-1/4"), ("0.037", None), ("3", "3"), (".875", "7/8"), ("-2.5", "-2-1/2"), ("x", None)])
def test_fraction(spark, v, x):
    assert one(spark, scalars.fraction(F.lit(v))) == x


@pytest.mark.parametrize(("v", "x"), [("4-1/2", 4.5), ("1/8", 0.125), ("12/20", 20.0), ("7 in", 7.0), ("20", 20.0), ("-3.5", -3.5), ("abc", None)])
def test_number(spark, v, x):
    assert one(spark, scalars.number(F.lit(v))) == x


def test_inches(spark):
    assert one(spark, scalars.inches(F.lit(20.0), F.lit("mm"))) == pytest.approx(0.7874, abs=1e-4)
    assert one(spark, scalars.inches(F.lit(20.0), F.lit("lb"))) is None


@pytest.mark.parametrize(("text", "code", "x"), [("AB-1 - foo", "AB-1", "foo"), ("x AB-1 foo", "ab-1", "x  foo"), ("foo", "", "foo"), ("foo", "bar", "foo")])
def test_echo(spark, text, code, x):
    assert one(spark, scalars.without_echo(F.lit(text), F.lit(code))).split() == x.split()


def test_small_rules(spark):
    assert one(spark, scalars.seconds(F.lit("6h51m50.4s"))) == pytest.approx(24710.4)
    assert one(spark, scalars.seconds(F.lit("577ms"))) == pytest.approx(0.577)
    assert one(spark, scalars.clip(F.lit("abc def ghijkl"), 10)) == "abc def"
    assert one(spark, scalars.distinct_words(F.lit("a Red red of of box Red"))) == "a Red of of box"
    assert one(spark, scalars.token_f1(F.lit("a b c"), F.lit("b c d"))) == pytest.approx(2 / 3)
    assert one(spark, scalars.title(F.lit("led wall LAMP"))) == "LED Wall Lamp"
    assert one(spark, scalars.json_object(F.lit('```json\n{"a":1}\n```'))) == '{"a":1}'
    assert one(spark, scalars.without_terms(F.lit("Big Red box"), ["red", "big red"])) == "box"
    assert one(spark, scalars.expand(F.lit("Sst dr wht, lt"))) == "Stainless Steel Door White, Light"


CASES = [
    ('Milw 14"x1/8"x1" Cut Off Disc', {"diameter": "14", "thickness": "1/8", "arbor_size": "1"}),
    ('Milw 12"x1/8"x20mm Metal Cut Off Disc', {"arbor_size": "20", "dimensions": "12 in x 1/8 in x 20 mm"}),
    ("4' Feit Shop Light 4500L 40k", {"lumens": "4500", "color_temperature": "4000", "size": "4"}),
    ("Widget 900lm Module", {"lumens": "900"}),
    ("60W Led BA11 50k 3pk", {"color_temperature": "5000", "wattage": "60", "pack_quantity": "3", "bulb_shape": "BA11"}),
    ("Dewalt 12V/20V Charger - 4 Amp", {"voltage": "12/20", "amperage": "4"}),
    ("7/8nx6-20' Sq Edge Decking", {"nominal_size": "7/8 in x 6 in", "length": "20", "edge_profile": "Square Edge"}),
    ("ONE+ 18V Drill (Tool Only)", {"platform": "ONE+", "includes_battery": "No", "configuration": "Bare Tool"}),
]


@pytest.mark.parametrize(("text", "want"), CASES)
def test_extraction(spark, text, want):
    found = {f["key"]: f for f in one(spark, extract.facts(F.lit(text)))}
    assert {k: found[k]["value"] for k in want} == want
    assert all(text[f["start"] : f["end"]] == f["raw"] for f in found.values())


@pytest.mark.parametrize("text", ["3M 775L Stikit Film P150", "6068L Gliding Patio Dr 4500 United"])
def test_bare_l_is_no_light_without_a_light(spark, text):
    assert "lumens" not in {f["key"] for f in one(spark, extract.facts(F.lit(text)))}


def test_residual_keeps_the_boundary(spark):
    text = F.lit("PBUC013 15A Wall Tap w/USB")
    assert one(spark, extract.residual(text, extract.facts(text))) == "PBUC013 Wall Tap - USB"

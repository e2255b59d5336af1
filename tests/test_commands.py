import pytest

from siftwright import commands
from siftwright.operators import registry
from siftwright.plans.enrich import Config

TABLE = """Report of May;;;
Part_Manuf;Mfg_Part_Num;Part_Desc;DIB_Brand
Satco Prod Inc (5573);S4724;S4724 4W Led Cand 27K 4pk Light Bulb;Satco
Satco Prod Inc (5573);S4725;S4725 6W Led Cand 27K 4pk Light Bulb;Satco
Satco Prod Inc (5573);S4726;"S4726 8W ""Led"" 4pk Light Bulb";-- Unbranded --
"""
LABELLED = """Mfg_Part_Num,Part_Desc,Part_Manuf,DIB_Brand,Classpath,Product Name,ATTRIBUTE_LABEL 1,ATTRIBUTE_VALUE 1,ATTRIBUTE_UOM 1,MFR URL
S4724,S4724 4W Led Cand 27K 4pk Light Bulb,Satco Prod Inc,Satco,E>B,Light Bulb,Wattage,4,W,http
S4725,S4725 6W Led Cand 27K 4pk Light Bulb,Satco Prod Inc,Satco,E>B,Bulb,Wattage,6,W,
"""


def config(spark):
    return Config(brands=spark.createDataFrame([("Satco", "Satco Products, Inc.", "®", ["satco prod inc"], [], 1)], registry.ENTRY), rules=[("bulb", "E>B")], seeds=["light bulb"])


def test_a_run_is_written_and_read_again(spark, tmp_path):
    source, out, store = tmp_path / "in.csv", str(tmp_path / "out"), str(tmp_path / "store")
    source.write_text(TABLE, encoding="utf-8")
    commands.correct(spark, store, "part", "S4726", "finish", "Red")
    commands.correct(spark, store, "part", " s4726", "finish", "Blue", note="seen")
    commands.correct(spark, store, "family", "F-gone", "finish", "x")
    commands.correct(spark, store, "family", "f-gone", "finish", None)
    with pytest.raises(ValueError):
        commands.correct(spark, store, "planet", "x", "y", "z")
    commands.run(spark, str(source), out, commands.configured(spark, store=store, base=config(spark)))
    found = commands.reloaded(spark, out)
    sheet = {r["Mfg_Part_Num"]: r for r in found["delivery"].collect()}
    assert set(sheet) == {"S4724", "S4725", "S4726"} and len(found["delivery"].columns) == 252 and sheet["S4724"]["Classpath"] == "E>B"
    assert sheet["S4726"]["Part_Desc"] == 'S4726 8W "Led" 4pk Light Bulb'
    assert [(r["target"].strip().lower(), r["rows"], r["stale"]) for r in found["corrections"].collect()] == [("s4726", "1", "false")]
    assert found["inspect"].count() == 3 and found["report"].first()["rows"] == 3 and found["audit_provenance"].count() > 30
    assert commands.relations(spark, out, "variant_of").count() >= 1


def test_scores_and_packs(spark, tmp_path):
    truth, out = tmp_path / "truth.csv", str(tmp_path / "packs")
    truth.write_text(LABELLED, encoding="utf-8")
    learned = commands.learn_spec(spark, str(truth), out, config(spark)).collect()
    assert [(p["classpath"], p["rows"], p["source"]) for p in learned] == [("E>B", 2, "truth.csv")]
    assert [(s["label"], s["key"], s["uom"], s["value_support"]) for s in learned[0]["slots"]] == [("Wattage", "wattage", "W", 2)]
    found = commands.evaluate(spark, str(truth), out=str(tmp_path / "eval"), config=commands.configured(spark, pack_path=out, base=config(spark)))
    scores = {r["column"]: r for r in found["per_field"].collect()}
    assert scores["Classpath"]["exact"] == 2 and scores["ATTRIBUTE_VALUE 1"]["exact"] == 2 and scores["Product Name"]["exact"] == 1 and scores["MFR URL"]["missed"] == 1
    parts = {r["part"]: r for r in found["overall"].collect()}
    assert parts["retrieval_dependent"]["exact"] == 0.0 and parts["in_scope"]["exact"] > 0.8 and parts["overall"]["scored"] == parts["in_scope"]["scored"] + parts["retrieval_dependent"]["scored"]

import json

from siftwright.operators import registry
from siftwright.plans.enrich import Config, enrich
from siftwright.sources import tabular

ROWS = [
    (1, "Satco Prod Inc (5573)", "S4724", "S4724 4W Led Cand 27K 4pk Light Bulb", "Satco"),
    (2, "Satco Prod Inc (5573)", "S4725", "S4725 6W Led Cand 27K 4pk Light Bulb", "Satco"),
    (3, "Satco Prod Inc (5573)", "S4726", "S4726 8W Led 4pk Light Bulb", "Satco"),
    (4, "Milwaukee Accessory (4031)", "49-94-1940", '49-94-1940 Milw 14"x1/8"x1" Masonry Cut Off Disc', "-- Unbranded --"),
    (5, "", "", "", "N/A"),
    (6, "ABC Lumber Supply", "X1", "Zzz qq", ""),
    (7, "Satco Prod Inc (5573)", "S9", "S9 60W Med", ""),
]
BRANDS = [("Satco", "Satco Products, Inc.", "®", ["satco prod inc"], [], 1), ("Milwaukee", "Milwaukee Tool", "®", ["milw", "milwaukee accessory"], ["48-"], 2)]
COLUMNS = ["row_id", "Vendor Name", "MFR PART #", "Item Description", "DIB Brand"]


def config(spark, **more):
    rules = [("bulb", "Electrical>Bulbs"), ("disc|cut off", "Tools>Abrasives")]
    return Config(brands=spark.createDataFrame(BRANDS, registry.ENTRY), rules=rules, placed={"Electrical>Bulbs": ("Electrical", "Lighting", "Bulbs", "39101600")}, seeds=["light bulb", "cut off disc"], **more)


def test_rows_are_enriched(spark, tmp_path):
    df = spark.createDataFrame(ROWS, COLUMNS)
    stages = []
    out = enrich(df, config(spark, progress=stages.append))
    rows = {r["row_id"]: r for r in out.delivery.collect()}
    one, four = rows[1], rows[4]
    assert (one["Product Name"], one["BRAND_NAME"], one["MANUFACTURER_NAME"], one["Classpath"], one["Dept"], one["UNSPSC"]) == ("Light Bulb", "Satco®", "Satco Products, Inc.", "Electrical>Bulbs", "Electrical", "39101600")
    assert (one["Mfg_Part_Num"], one["Part_Desc"], one["Part_Manuf"], one["DIB_Brand"]) == ("S4724", ROWS[0][3], ROWS[0][1], "Satco")
    assert (four["Product Name"], four["Classpath"], four["BRAND_NAME"]) == ("Cut Off Disc", "Tools>Abrasives", "Milwaukee®") and rows[7]["Product Name"] == "Light Bulb"
    assert all(len(r["INVOICE_DESC"]) <= 40 and r["INVOICE_DESC"] == r["INVOICE_DESC"].upper() for r in rows.values()) and "14IN" in four["INVOICE_DESC"]
    assert len(out.delivery.columns) == 253 and stages == ["parsed", "identified and typed", "facts settled", "delivered"]
    checked = {r["row_id"]: r for r in out.checked.collect()}
    assert checked[5]["status"] == checked[6]["status"] == "blocked" and checked[1]["status"] == "ready"
    facts = {(r["row_id"], r["key"]): r["value"] for r in out.facts.collect()}
    assert facts[4, "arbor_size"] == "1" and facts[1, "wattage"] == "4" and facts[1, "lamp_type"] == "LED"
    kinds = {(r["row_id"], r["kind"]) for r in out.notes.collect()}
    assert {(6, "brand_unresolved"), (5, "item_type_unresolved"), (5, "classification_abstained")} <= kinds and not {k for i, k in kinds if i == 1}
    report = out.report.first()
    assert report["rows"] == 7 and report["invoice_compliance"] == 1.0 and report["blocked"] == 2 and report["ready"] + report["needs_review"] == 5
    queue = out.review.collect()
    assert [r["review_value"] for r in queue] == sorted((r["review_value"] for r in queue), reverse=True) and {r["row_id"] for r in queue} == {r for r, c in checked.items() if c["status"] != "ready"}
    cells = out.provenance.count()
    assert cells == sum(r["filled"] for r in checked.values()) and out.edges.filter("relation = 'variant_of'").count() >= 1 and out.specs.count() > 0 and out.consistency.columns == ["key", "families", "agreeing", "rate"]
    path = str(tmp_path / "delivery.csv")
    tabular.write_delimited(out.delivery, path, out.delivery.columns[1:])
    assert len((next(iter(sorted((tmp_path / "delivery.csv").glob("part*"))))).read_text(encoding="utf-8").split(",")) == 252


def test_people_and_models_have_their_say(spark):
    df = spark.createDataFrame(ROWS, COLUMNS)
    store = spark.createDataFrame(
        [("part", "S4724", "finish", "Frosted"), ("classpath", "Electrical>Bulbs", "warranty", "2 years"), ("brand", "ABC Lumber Supply", "brand_alias", "Milwaukee"), ("part", "nobody", "finish", "x")], "scope string, target string, key string, value string"
    )

    def llm(prompt):
        asked = json.loads(prompt)
        return json.dumps({"facts": [{"key": "item_type", "value": "Cut Off Disc", "evidence": "qq"}, {"key": "made_up", "value": "Gold", "evidence": "gold"}]}) if "Zzz" in asked["description"] else "no idea"

    out = enrich(df, config(spark, corrections=store, llm=llm, auditor=lambda p: json.dumps({"verdicts": [{"key": "wattage", "verdict": "unsupported", "reason": "no"}]})))
    facts = {(r["row_id"], r["key"]): r for r in out.facts.collect()}
    assert facts[1, "finish"]["value"] == "Frosted" and facts[1, "finish"]["confidence"] == 0.99 and facts[1, "finish"]["method"] == "correction"
    assert {r for r, k in facts if k == "warranty"} == {1, 2, 3, 7} and facts[6, "item_type"]["method"] == "llm" and facts[6, "classpath"]["value"] == "Tools>Abrasives" and (6, "made_up") not in facts
    assert facts[1, "wattage"]["confidence"] < 0.5
    kinds = {(r["row_id"], r["kind"]) for r in out.notes.collect()}
    assert (6, "llm_evidence_rejected") in kinds and (1, "audit_disagreement") in kinds
    assert {r["target"]: (r["rows"], r["stale"]) for r in out.corrections.collect() if r["scope"] != "brand"} == {"S4724": (1, False), "Electrical>Bulbs": (4, False), "nobody": (0, True)}
    assert out.answers.count() >= 1


def test_an_empty_table(spark):
    out = enrich(spark.createDataFrame([], "row_id long, Description string, MPN string"))
    assert out.delivery.count() == out.review.count() == out.edges.count() == 0 and out.report.first()["rows"] == 0

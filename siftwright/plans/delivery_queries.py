"""More catalogue operators on the standard tables, with SQL: identity, item types, series, packs, specs, guards, lines, the sheet, models, relations."""

from __future__ import annotations

import difflib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.operators import compose, corrections, delivery, edges, facts, families, fill, guard, item_types, packs, registry, review, series, specs
from siftwright.plans import enrich as plan
from siftwright.plans.queries import _COLUMNS, MEMBERS, PART_FACTS, _corrections, _part_nodes, _scoped, members, part_facts, q_edges_star, q_edges_xref, query, table

NOUN = "list_last(string_split(p_name, ' '))"
FIRST = "split_part(p_name, ' ', 1)"


def _noun() -> F.Column:
    return F.element_at(F.split("p_name", " "), -1)


def _first() -> F.Column:
    return F.split("p_name", " ")[0]


# ---- identity

BRANDS = [("Ring Co", "Ring Company Inc.", "®", ["ring"], ["BX-"], 1), ("Widget", "Acme Inc", "", ["widget", "acme"], [], 2), ("Bolt & Co", "Acme Inc", "™", ["bolt"], ["Q"], 3)]
_ROWS = f"""r AS (SELECT p_partkey AS row_id, p_name AS text, CASE WHEN p_partkey % 2 = 0 THEN 'BX-' || p_partkey ELSE 'Z' || p_partkey END AS mpn, ['Bolt Supply', 'Acme Inc (1234)', 'Solo Maker LLC (77ab)'][(p_partkey % 3 + 1)::INT] AS manufacturer,
  CASE p_partkey % 5 WHEN 0 THEN 'ACME' WHEN 1 THEN 'Unknown Brand' END AS brand_dib, {NOUN} AS noun FROM part),
i AS (SELECT *, CASE WHEN brand_dib = 'ACME' THEN ['Widget', 'Acme Inc', 'registry', '0.95', '2'] WHEN brand_dib IS NOT NULL THEN ['Unknown Brand', 'Unknown Brand', 'input', '0.7', NULL]
  WHEN noun = 'ring' THEN ['Ring Co®', 'Ring Company Inc.', 'registry', '0.88', '1'] WHEN noun = 'widget' THEN ['Widget', 'Acme Inc', 'registry', '0.88', '2'] WHEN noun = 'bolt' THEN ['Bolt & Co™', 'Acme Inc', 'registry', '0.88', '3']
  WHEN manufacturer LIKE 'Acme%' THEN ['Widget', 'Acme Inc', 'registry', '0.9', '2'] WHEN mpn LIKE 'BX-%' THEN ['Ring Co®', 'Ring Company Inc.', 'rule', '0.8', '1'] WHEN manufacturer LIKE '%Supply' THEN [NULL, NULL, 'abstain', '0', NULL]
  ELSE ['Solo Maker LLC', 'Solo Maker LLC', 'input', '0.58', NULL] END AS x FROM r)"""


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    makers = F.array(*map(F.lit, ("Bolt Supply", "Acme Inc (1234)", "Solo Maker LLC (77ab)")))
    rows = table(spark, sf_dir, "part").select(
        k.alias("row_id"), F.col("p_name").alias("text"), F.when(k % 2 == 0, F.concat(F.lit("BX-"), k.cast("string"))).otherwise(F.concat(F.lit("Z"), k.cast("string"))).alias("mpn"), F.element_at(makers, (k % 3 + 1).cast("int")).alias("manufacturer"),
        F.when(k % 5 == 0, "ACME").when(k % 5 == 1, "Unknown Brand").alias("brand_dib"), F.lit(None).cast("string").alias("brand_e1"),
    )
    return registry.identified(rows, spark.createDataFrame(BRANDS, registry.ENTRY))


@query("WITH " + _ROWS + " SELECT row_id, x[1] AS brand, x[2] AS manufacturer, x[3] AS method, x[4]::DOUBLE AS confidence, manufacturer LIKE '%Supply' AS reseller FROM i")
def q_identity_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _named(spark, sf_dir).select("row_id", "identity.brand", "identity.manufacturer", "identity.method", "identity.confidence", "identity.reseller")


_ALIKE = round(difflib.SequenceMatcher(None, "widget", "ring").ratio(), 2)


@query("WITH " + _ROWS + f" SELECT row_id, manufacturer AS supplied, 'Widget' AS supplied_brand, x[2] AS resolved, x[1] AS brand, {_ALIKE}::DOUBLE AS similarity FROM i WHERE x[5] = '1' AND manufacturer LIKE 'Acme%'")
def q_identity_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.mismatches(_named(spark, sf_dir))


@query("SELECT n_name AS brand, CASE WHEN n_nationkey % 2 = 0 THEN 'Maker of ' || n_name ELSE '' END AS manufacturer, CASE WHEN n_nationkey % 3 = 0 THEN '®' ELSE '' END AS symbol FROM nation")
def q_registry_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    listed = n.select(F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, "®").otherwise("")).alias("BRAND_NAME"), F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("Maker of "), "n_name")).alias("MANUFACTURER_NAME"))
    return registry.loaded(listed).select("brand", "manufacturer", "symbol")


@query("SELECT s_suppkey, CASE WHEN s_suppkey % 10 = 3 THEN 'Widget' END AS brand FROM supplier")
def q_brand_taught(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Aliases that reviewers taught resolve suppliers from then on."""
    s = table(spark, sf_dir, "supplier")
    store = s.filter("s_suppkey % 10 = 3").select(F.lit("brand").alias("scope"), F.col("s_name").alias("target"), F.lit("brand_alias").alias("key"), F.lit("acme").alias("value"))
    known = registry.taught(spark.createDataFrame(BRANDS, registry.ENTRY), store)
    return registry.by_name(s, "s_name", known).select("s_suppkey", F.col("entry.brand").alias("brand"))


# ---- item types and series

_SURE = "least(0.95, 0.72 + least(0.2, ln(1 + n) / 25) + 0.04 * (n_words - 1) + CASE WHEN seeded THEN 0.05 ELSE 0 END)"


@query(
    f"""
WITH p AS (SELECT p_partkey, p_name, {NOUN} AS noun FROM part), one AS (SELECT noun AS gram, count(*) AS n FROM p GROUP BY 1), two AS (SELECT p_name AS gram, count(*) AS n FROM p GROUP BY 1 HAVING count(*) >= 2),
g AS (SELECT p_partkey AS row_id, CASE WHEN noun IN ('ring', 'gizmo') THEN noun WHEN two.gram IS NOT NULL THEN p_name ELSE noun END AS matched, noun IN ('ring', 'gizmo') AS seeded, CASE WHEN noun IN ('ring', 'gizmo') OR two.gram IS NULL THEN one.n ELSE two.n END AS n, CASE WHEN noun IN ('ring', 'gizmo') OR two.gram IS NULL THEN 1 ELSE 2 END AS n_words
  FROM p JOIN one ON one.gram = noun LEFT JOIN two ON two.gram = p_name)
SELECT row_id, matched, n::BIGINT AS n, round({_SURE}, 6)::DOUBLE AS confidence FROM g"""
)
def q_item_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "row_id")
    return item_types.resolved(p, "p_name", item_types.mined(p, "p_name", ["ring", "gizmo"])).select("row_id", "matched", "n", F.round("confidence", 6).alias("confidence"))


@query("SELECT n_nationkey, n_name AS word, length(n_name) >= 3 AND regexp_matches(lower(n_name), '[aeiouy]') AS plausible FROM nation UNION ALL SELECT 100 + i, w, w IN ('grommet', 'Anvil') FROM (SELECT unnest(['grommet', 'Anvil', 'xl', 'mw', 'kit', 'LED', 'brtk', 'ab']) AS w, unnest(range(8)) AS i)")
def q_plausible_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n_nationkey"), F.col("n_name").alias("word"))
    own = spark.createDataFrame([(100 + i, w) for i, w in enumerate(("grommet", "Anvil", "xl", "mw", "kit", "LED", "brtk", "ab"))], "n_nationkey long, word string")
    return n.unionByName(own).select("n_nationkey", "word", item_types.plausible(F.col("word")).alias("plausible"))


@query(
    "SELECT p_partkey AS row_id, 'Light Bulb' AS item_type, 'ITM-INF-LAMP' AS rule_id FROM part WHERE (p_size % 2 = 0 AND (p_size % 3 = 0 OR p_size % 5 = 0)) OR (p_size % 3 = 0 AND p_size % 7 = 0)"
)
def q_inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = [F.when(F.col("p_size") % n == 0, k) for n, k in ((2, "wattage"), (3, "color_temperature"), (5, "base_type"), (7, "lumens"))]
    f = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.explode(F.array_compact(F.array(*keys))).alias("key"))
    return item_types.inferred(f).select("row_id", "item_type", "rule_id")


def _collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("row_id"), F.concat(F.initcap(_first()), F.lit(" Line "), _noun()).alias("rest"), F.col("p_brand").alias("brand"), _noun().alias("item_type"))


_LINE = f"upper({FIRST}[1]) || substr({FIRST}, 2) || ' Line'"


@query(f"SELECT p_partkey AS row_id, {_LINE} AS series FROM part WHERE {FIRST} <> 'new'")
def q_series_detect(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _collections(spark, sf_dir)
    return series.detected(rows, series.mined(rows, "rest"))


@query(f"SELECT lower({_LINE}) AS phrase, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 3")
def q_series_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.mined(_collections(spark, sf_dir), "rest")


@query(
    f"""
WITH v AS (SELECT lower(p_brand) AS brand, 'big ' || {FIRST} AS series, CASE WHEN p_size % 4 > 0 THEN 'Ring' ELSE {NOUN} END AS t FROM part), c AS (SELECT brand, series, t, count(*) AS n FROM v GROUP BY ALL),
b AS (SELECT brand, series, sum(n) AS total, max(n) AS n, arg_min(t, (-n, t)) AS item_type FROM c GROUP BY ALL HAVING max(n) >= 2 AND max(n) >= 0.7 * sum(n))
SELECT brand, series, item_type FROM b UNION ALL SELECT brand, substr(series, 5), item_type FROM b"""
)
def q_series_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return series.learned(p.select(F.col("p_brand").alias("brand"), F.concat(F.lit("Big "), _first()).alias("series"), F.when(F.col("p_size") % 4 > 0, "Ring").otherwise(_noun()).alias("item_type")))


# ---- packs and specs


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    cells = {"ATTRIBUTE_LABEL 1": _noun(), "ATTRIBUTE_VALUE 1": F.col("p_size").cast("string"), "ATTRIBUTE_UOM 1": F.when(F.col("p_size") % 3 == 0, "in").otherwise(""), "ATTRIBUTE_LABEL 2": F.lit("Color"), "ATTRIBUTE_VALUE 2": _first()}
    return p.select(F.col("p_partkey").alias("code"), F.col("p_type").alias("Classpath"), *[v.alias(k) for k, v in cells.items()])


_PACK = f"""s AS (SELECT p_partkey AS row_id, p_type AS classpath, unnest([1, 2]) AS position, unnest([{NOUN}, 'Color']) AS label, unnest([p_size::VARCHAR, {FIRST}]) AS value, unnest([CASE WHEN p_size % 3 = 0 THEN 'in' ELSE '' END, '']) AS uom, unnest(['size', CASE WHEN p_size > 25 THEN 'finish' END]) AS key FROM part),
l AS (SELECT classpath, position, arg_min(label, (-n, label)) AS label, max(n) AS support FROM (SELECT classpath, position, label, count(*) AS n FROM s GROUP BY ALL) GROUP BY ALL),
o AS (SELECT classpath, position, max(uom) AS uom, count(key) AS value_support, max(key) AS key, list_sort(list_distinct(list(value)))[:60] AS vals FROM s GROUP BY ALL)"""


@query("WITH " + _PACK + " SELECT classpath, position::INT AS position, label, uom, coalesce(key, '') AS key, support, value_support, array_to_string(vals, ',') AS vals FROM l JOIN o USING (classpath, position)")
def q_pack_learn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Slots with label, unit, aligned key and values: the sizes of large parts have a finish among their facts, others none."""
    said = part_facts(spark, sf_dir).filter("key = 'size'").select("row_id", "key", F.col("value").alias("display"))
    finish = table(spark, sf_dir, "part").filter("p_size > 25").select(F.col("p_partkey").alias("row_id"), F.lit("finish").alias("key"), _first().alias("display"))
    learned = packs.learned(packs.aligned(packs.read_slots(_labelled(spark, sf_dir), "code", "Classpath"), said.unionByName(finish)))
    return learned.select("classpath", F.inline("slots")).select("classpath", "position", "label", "uom", "key", "support", "value_support", F.array_join("values", ",").alias("vals"))


@query("WITH c AS (SELECT p_type, count(*) AS n FROM part GROUP BY 1) SELECT p_partkey, CASE WHEN p_partkey % 4 < 3 THEN n END AS rows FROM part JOIN c USING (p_type)")
def q_pack_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the category's name, by its folded name, and not at all."""
    learned = packs.learned(packs.read_slots(_labelled(spark, sf_dir), "code", "Classpath"))
    k = F.col("p_partkey")
    rows = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 4 < 2, F.col("p_type")).when(k % 4 == 2, F.concat(F.lit(" "), F.lower("p_type"))).otherwise("other").alias("classpath"))
    return packs.of_category(rows, learned).select("p_partkey", F.col("pack.rows").alias("rows"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'own' ELSE ['finish', 'dimensions', 'voltage', ''][(p_partkey % 4 + 1)::INT] END AS key FROM part")
def q_slot_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    label = F.element_at(F.array(*map(F.lit, ("Colour", "SIZE", "Voltage  Rating", "No such"))), (k % 4 + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", packs.slot_key(label, F.when(k % 2 == 0, "own").otherwise("")).alias("key"))


@query(
    "WITH "
    + PART_FACTS
    + """, o AS (SELECT p_type AS category, key, value FROM pf JOIN part ON p_partkey = row_id), n AS (SELECT p_type AS category, count(*) AS n_rows FROM part GROUP BY 1 HAVING count(*) >= 3),
c AS (SELECT category, key, value, count(*) AS n FROM o GROUP BY ALL), t AS (SELECT category, key, arg_min(value, (-n, value)) AS top, least(60, count(*)) AS kept, sum(n) AS support FROM c GROUP BY ALL)
SELECT category, key, row_number() OVER (PARTITION BY category ORDER BY CASE key WHEN 'item_type' THEN 3 WHEN 'size' THEN 20 WHEN 'finish' THEN 24 ELSE 500 END, key)::INT AS position, top, kept::INT AS kept, CASE WHEN key = 'size' THEN 'in' ELSE '' END AS uom FROM t JOIN n USING (category)"""
)
def q_spec_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = part_facts(spark, sf_dir).withColumn("uom", F.when(F.col("key") == "size", "in").otherwise("")).withColumn("label", F.initcap("key"))
    cats = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_type").alias("category"))
    return specs.slots(f, cats).select("category", "key", "position", F.col("values")[0]["value"].alias("top"), F.size("values").alias("kept"), "uom")


@query("SELECT p_type AS category, 'item_type,size,finish,brand' AS keys FROM part GROUP BY 1 HAVING count(*) >= 3")
def q_title_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = part_facts(spark, sf_dir).withColumn("uom", F.lit("")).withColumn("label", F.col("key"))
    cats = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_type").alias("category"))
    return specs.title_order(specs.slots(f, cats)).select("category", F.array_join("keys", ",").alias("keys"))


@query("SELECT category, n_rows, 4::BIGINT AS n_slots FROM (SELECT p_type AS category, count(*) AS n_rows FROM part GROUP BY 1 HAVING count(*) >= 3)")
def q_specs_by_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    cats = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_type").alias("category"))
    return specs.by_size(specs.induced(part_facts(spark, sf_dir), cats)).select("category", "n_rows", "n_slots")


@query(
    """
WITH p AS (SELECT p_type, p_brand AS l, min(p_partkey) AS x FROM part WHERE p_size <= 25 GROUP BY ALL), t AS (SELECT p_type, p_brand AS l, min(p_size) * 1000 + min(p_partkey) % 1000 AS x FROM part WHERE p_size > 20 GROUP BY ALL),
b AS (SELECT t.p_type, t.l, t.x AS a, p.x AS b FROM t JOIN p ON t.p_type = p.p_type AND t.l = p.l), q AS (SELECT u.p_type, count(*) AS n, count(*) FILTER (v.b > u.b) AS same FROM b u JOIN b v ON u.p_type = v.p_type AND (u.a < v.a OR (u.a = v.a AND u.b < v.b)) GROUP BY 1)
SELECT k.p_type, round(CASE WHEN coalesce(n, 0) > 0 THEN same::DOUBLE / n ELSE 1.0 END, 6)::DOUBLE AS order_agreement FROM (SELECT DISTINCT p_type FROM t) k LEFT JOIN q USING (p_type)"""
)
def q_order_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    predicted = p.filter("p_size <= 25").groupBy("p_type", "p_brand").agg(F.min("p_partkey").alias("x"))
    truth = p.filter("p_size > 20").groupBy("p_type", "p_brand").agg((F.min("p_size") * 1000 + F.min("p_partkey") % 1000).alias("x"))
    return specs.order_agreement(predicted, truth, "p_type", "p_brand", "x").withColumn("order_agreement", F.round("order_agreement", 6))


@query("WITH c AS (SELECT p_brand, p_name, count(*) AS n FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_name) AS k FROM c), g AS (SELECT p_brand, count(*) AS n_values, sum(n)::BIGINT AS mentions, string_agg(p_name, ',' ORDER BY k) FILTER (k <= 5) AS examples FROM r GROUP BY 1) SELECT * FROM g ORDER BY mentions DESC, p_brand LIMIT 15")
def q_label_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the top of the list."""
    return specs.label_report(table(spark, sf_dir, "part"), "p_brand", "p_name").withColumn("examples", F.array_join("examples", ","))


# ---- guards


@query(
    """
WITH f AS (SELECT p_partkey AS row_id, p_size FROM part)
SELECT row_id, 'GRD-UNIT-01' AS rule, 'voltage' AS key, 'error' AS severity FROM f WHERE p_size % 3 = 0 UNION ALL SELECT row_id, 'GRD-XAT-LED', 'wattage', 'warning' FROM f WHERE p_size % 2 = 0 AND p_size * 10 > 300
UNION ALL SELECT row_id, 'GRD-XAT-K', 'color_temperature', 'warning' FROM f WHERE p_size * 55 > 1000 AND p_size * 55 % 100 <> 0 UNION ALL SELECT row_id, 'GRD-DOM-K', 'color_temperature', 'error' FROM f WHERE p_size * 55 < 1500
UNION ALL SELECT row_id, 'GRD-REL-DUP', 'dimensions', 'warning' FROM f WHERE p_size % 7 = 0 UNION ALL SELECT row_id, 'GRD-REL-ARB', 'arbor_size', 'error' FROM f WHERE p_size % 7 = 0 UNION ALL SELECT row_id, 'GRD-REL-THK', 'thickness', 'error' FROM f WHERE p_size % 7 = 0
UNION ALL SELECT row_id, 'GRD-REL-AL', 'arbor_size', 'error' FROM f WHERE p_size % 7 = 0 AND p_size > 20 UNION ALL SELECT row_id, 'GRD-DOM-ARB', 'arbor_size', 'error' FROM f WHERE p_size % 7 = 0 AND p_size > 12 UNION ALL SELECT row_id, 'GRD-DOM-THK', 'thickness', 'error' FROM f WHERE p_size % 7 = 0 AND p_size > 24"""
)
def q_guard_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Units of another kind, LED watts, odd temperatures, chains of one value, and lengths in a unit nobody knows, which aren't judged."""
    size = F.col("p_size")
    text = lambda c: c.cast("string")
    fact = lambda k, v, u, when=None: F.when(F.lit(True) if when is None else when, F.struct(F.lit(k).alias("key"), v.alias("value"), F.lit(u).alias("uom")))
    seventh = size % 7 == 0
    items = [
        F.when(size % 3 == 0, F.struct(F.lit("voltage").alias("key"), F.lit("120").alias("value"), F.lit("K").alias("uom"))).otherwise(F.struct(F.lit("voltage").alias("key"), F.lit("120").alias("value"), F.lit("V").alias("uom"))),
        fact("wattage", text(size * 10), "W"), fact("lamp_type", F.lit("led"), "", size % 2 == 0), fact("color_temperature", text(size * 55), "K"), *[fact(k, text(size), "in", seventh) for k in ("diameter", "thickness", "arbor_size")], fact("length", F.lit("20"), "in", seventh),
        fact("diameter", F.lit("9000"), "furlong", ~seventh),
    ]
    return guard.findings(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.inline(F.array_compact(F.array(*items)))))


# ---- lines and the sheet


def _gathered(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = part_facts(spark, sf_dir).withColumn("uom", F.when(F.col("key") == "size", "in").otherwise("")).withColumn("label", F.initcap(F.translate("key", "_", " "))).withColumn("rule_id", F.lit("R"))
    return compose.gathered(f)


_LINES = f"x AS (SELECT p_partkey AS row_id, p_brand AS brand, {NOUN} AS noun, {FIRST} AS finish, p_size || ' in' AS size, CASE {FIRST} WHEN 'black' THEN 'BK' ELSE upper({FIRST}) END AS tight FROM part)"


@query("WITH " + _LINES + " SELECT row_id, brand || ', ' || noun || ', ' || finish || ', ' || size AS text, true AS exhausted, length(brand || ', ' || noun || ', ' || finish || ', ' || size)::INT AS length FROM x")
def q_mobile_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gathered(spark, sf_dir).select("row_id", compose.mobile().alias("l")).select("row_id", "l.text", "l.exhausted", "l.length")


@query("WITH " + _LINES + " SELECT row_id, brand || ' ' || noun || ', ' || finish || ', ' || size AS short, noun || ', ' || size || ', ' || finish AS retail, brand || ' ' || noun || ', ' || finish || ', ' || size AS long FROM x")
def q_descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.array().cast("array<string>")
    return _gathered(spark, sf_dir).select("row_id", compose.short(none).alias("short"), compose.retail(F.array(F.lit("size"))).alias("retail"), compose.long(none).alias("long"))


@query(
    "WITH "
    + _LINES
    + """, l AS (SELECT row_id, upper(noun) || ' ' || tight || ' ' || upper(replace(size, ' ', '')) AS line FROM x)
SELECT row_id, line AS text, 'item_type,finish,size' AS included FROM l"""
)
def q_invoice_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gathered(spark, sf_dir).select("row_id", compose.invoice().alias("i")).select("row_id", "i.text", F.array_join("i.included", ",").alias("included"))


def _sheet_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_name").alias("raw"), F.when(F.col("p_size") % 2 == 0, F.col("p_type")).alias("kind"))
    slot = F.struct(F.lit("Grit").alias("label"), F.lit("grit").alias("key"), F.lit("").alias("uom"), F.lit("spec").alias("method"), F.lit(0.9).alias("confidence"), F.lit("").alias("detail"))
    return delivery.rendered(_gathered(spark, sf_dir).join(given, "row_id"), delivery.passed_through({"description": "raw", "class": "kind"}), F.array(slot))


@query(
    "WITH "
    + _LINES
    + """ SELECT row_id, p_name AS "Part_Desc", CASE WHEN p_size % 2 = 0 THEN p_type ELSE '' END AS "Class", brand AS "BRAND_NAME", noun AS "Product Name", 'Grit' AS "ATTRIBUTE_LABEL 1", '' AS "ATTRIBUTE_VALUE 1", 'Finish' AS "ATTRIBUTE_LABEL 2", finish AS "ATTRIBUTE_VALUE 2", p_size::VARCHAR AS "ATTRIBUTE_VALUE 3", 'in' AS "ATTRIBUTE_UOM 3", '' AS "ATTRIBUTE_LABEL 4" FROM x JOIN part ON p_partkey = row_id"""
)
def q_delivery_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["Part_Desc", "Class", "BRAND_NAME", "Product Name", "ATTRIBUTE_LABEL 1", "ATTRIBUTE_VALUE 1", "ATTRIBUTE_LABEL 2", "ATTRIBUTE_VALUE 2", "ATTRIBUTE_VALUE 3", "ATTRIBUTE_UOM 3", "ATTRIBUTE_LABEL 4"]
    return delivery.sheet(_sheet_rows(spark, sf_dir), names)


@query(
    "WITH "
    + _LINES
    + """, c AS (SELECT row_id, unnest(['Part_Desc', 'Class', 'BRAND_NAME', 'Product Name', 'ATTRIBUTE_LABEL 1', 'ATTRIBUTE_VALUE 2']) AS "column", unnest([p_name, CASE WHEN p_size % 2 = 0 THEN p_type END, brand, noun, 'Grit', finish]) AS value, unnest(['input', 'input', 'rule', 'rule', 'spec', 'rule']) AS method, unnest([0.99, 0.99, 0.9, 0.9, 0.9, 0.9]::DOUBLE[]) AS confidence FROM x JOIN part ON p_partkey = row_id)
SELECT * FROM c WHERE value IS NOT NULL"""
)
def q_cell_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    some = ("Part_Desc", "Class", "BRAND_NAME", "Product Name", "ATTRIBUTE_LABEL 1", "ATTRIBUTE_VALUE 2")
    return delivery.provenance(_sheet_rows(spark, sf_dir)).filter(F.col("column").isin(*some)).select("row_id", "column", "value", "method", "confidence")


@query("SELECT p_partkey AS row_id, 'blocked' AS status, 'MOBILE_DESC:info,Classpath:error' AS found FROM part")
def q_sheet_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = delivery.checked(_sheet_rows(spark, sf_dir).withColumn("score", F.lit(0.9)))
    return judged.select("row_id", "status", F.array_join(F.transform("violations", lambda v: F.concat(v["column"], F.lit(":"), v["severity"])), ",").alias("found"))


@query(
    "WITH "
    + MEMBERS
    + """ SELECT count(*) AS rows, 0::BIGINT AS ready, count(*) AS blocked, count(DISTINCT family_id) AS families, 1.0::DOUBLE AS brand_rate, 0.0::DOUBLE AS classified_rate, 1.0::DOUBLE AS invoice_compliance, 0.0::DOUBLE AS mobile_compliance, 1.0::DOUBLE AS mobile_data_limited, 0.0::DOUBLE AS mobile_composition_short, round(avg(p_size / 50.0), 6) AS mean_score FROM m JOIN part ON p_partkey = row_id"""
)
def q_run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The report over delivered rows: none has a classpath here, and no mobile line reaches its window."""
    score = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_size") / 50.0).alias("score"))
    judged = delivery.checked(_sheet_rows(spark, sf_dir).join(score, "row_id")).join(members(spark, sf_dir), "row_id")
    return review.run_report(judged).select("rows", "ready", "blocked", "families", "brand_rate", "classified_rate", "invoice_compliance", "mobile_compliance", "mobile_data_limited", "mobile_composition_short", F.round("mean_score", 6).alias("mean_score"))


@query("SELECT unnest(['CG-TAX-01', 'CG-MOB-01']) AS rule, count(*) AS n FROM part")
def q_violation_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.counts(delivery.checked(_sheet_rows(spark, sf_dir).withColumn("score", F.lit(0.9))), "violations", "rule")


# ---- models


@query("SELECT p_partkey AS row_id FROM part WHERE p_size % 4 <> 0 OR p_size % 6 <> 0")
def q_model_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows without a classpath, or with too few facts, are worth a question."""
    size = F.col("p_size")
    keys = [F.lit("item_type"), F.lit("brand"), F.lit("finish"), F.lit("size"), F.when(size % 4 == 0, "classpath"), F.when(size % 6 == 0, "grit")]
    rows = table(spark, sf_dir, "part").withColumnRenamed("p_partkey", "row_id")
    f = rows.select("row_id", F.explode(F.array_compact(F.array(*keys))).alias("key"))
    return fill.wanting(rows, f).select("row_id")


@query(
    f"""
WITH v AS (SELECT p_partkey AS row_id, unnest([0, 1, 2, 3, 4]) AS seq, unnest([p_size::VARCHAR, p_size || '.0', upper({FIRST}), 'quite new', '9']) AS value, p_size FROM part)
SELECT row_id, seq::INT AS seq, CASE seq WHEN 0 THEN p_size >= 10 WHEN 3 THEN false WHEN 4 THEN false ELSE true END AS redundant FROM v"""
)
def q_redundant_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same number, the same word, something new; a single sign proves nothing."""
    size = F.col("p_size").cast("string")
    values = F.array(size, F.concat(size, F.lit(".0")), F.upper(_first()), F.lit("quite new"), F.lit("9"))
    proposed = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.posexplode(values).alias("seq", "value"))
    f = part_facts(spark, sf_dir).filter("key IN ('size', 'finish')").withColumn("uom", F.when(F.col("key") == "size", "in").otherwise(""))
    return fill.said_already(proposed, f).select("row_id", "seq", "redundant")


@query("WITH " + PART_FACTS + " SELECT row_id, key FROM pf WHERE key <> 'brand' AND NOT (key = 'size' AND row_id % 2 = 0)")
def q_auditable(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = part_facts(spark, sf_dir).withColumn("method", F.when((F.col("key") == "size") & (F.col("row_id") % 2 == 0), "input").otherwise("rule"))
    return facts.auditable(f.withColumn("key", F.when(F.col("key") == "brand", "mpn").otherwise(F.col("key")))).select("row_id", "key")


@query("WITH " + PART_FACTS + " SELECT row_id, key FROM pf WHERE 0.5 + priority * 0.1 >= 0.7")
def q_confident(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.confident(part_facts(spark, sf_dir).withColumn("confidence", F.round(0.5 + F.col("priority") * 0.1, 1)), 0.7).select("row_id", "key")


@query("SELECT p_partkey AS row_id, 'audit_disagreement' AS kind, 'size' AS key, 'review' AS severity FROM part WHERE p_partkey % 4 = 1")
def q_audit_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = part_facts(spark, sf_dir).filter("key = 'size'")
    v = f.select("row_id", "key", F.when(F.col("row_id") % 4 == 1, "unsupported").otherwise("unknown").alias("verdict"))
    return facts.disagreements(f, v).select("row_id", "kind", "key", "severity")


# ---- relations, families, corrections, scores

_XREF = "k AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_size, p_brand ORDER BY p_partkey) AS k, min(p_partkey) OVER (PARTITION BY p_type, p_size, p_brand) AS f FROM part), x AS (SELECT a.p_partkey AS source, b.p_partkey AS target, 'cross_reference' AS relation FROM k a JOIN k b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_brand <> b.p_brand AND a.f < b.f WHERE a.k <= 6 AND b.k <= 6)"
_STAR = "r AS (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_name) AS n, min(p_partkey) OVER (PARTITION BY p_name) AS head FROM part), e AS (SELECT head AS source, p_partkey AS target, 'variant_of' AS relation FROM r WHERE k BETWEEN 2 AND 25 AND n <= 60)"
_BOTH = f"WITH {_XREF}, {_STAR}, a AS (SELECT * FROM x UNION ALL SELECT * FROM e)"


@query(_BOTH + ", t AS (SELECT relation, source AS p FROM a UNION ALL SELECT relation, target FROM a) SELECT relation, (count(*) / 2)::BIGINT AS edges, count(DISTINCT p) AS products FROM t GROUP BY 1")
def q_edge_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.by_relation(edges.distinct(q_edges_xref(spark, sf_dir), q_edges_star(spark, sf_dir)))


@query(_BOTH + " SELECT source, target FROM a WHERE relation = 'variant_of'")
def q_edge_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.of_relation(edges.distinct(q_edges_xref(spark, sf_dir), q_edges_star(spark, sf_dir)), "variant_of").select("source", "target")


@query(
    """
WITH p AS (SELECT p_partkey, lower(p_type) AS t, regexp_replace(lower(p_brand), '[^a-z0-9]', '', 'g') AS b FROM part), r AS (SELECT *, row_number() OVER (PARTITION BY b, t ORDER BY p_partkey) AS k, min(p_partkey) OVER (PARTITION BY b, t) AS head FROM p)
SELECT head AS source, p_partkey AS target, 'same_series' AS relation, 'KG-SER-01' AS rule, 'series=' || t AS shared, 0.8::DOUBLE AS confidence FROM r WHERE k BETWEEN 2 AND 25"""
)
def q_edges_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _part_nodes(spark, sf_dir).select("row_id", F.col("row_id").cast("string").alias("pn"), "brand", F.col("kind").alias("series"))
    return edges.related(n).select("source", "target", "relation", "rule", "shared", "confidence")


@query("WITH " + MEMBERS + ", s AS (SELECT family_id, count(*) AS n FROM m GROUP BY 1) SELECT count(*) AS families, count(*) FILTER (n = 1) AS singletons FROM s")
def q_family_singletons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.singletons(members(spark, sf_dir))


@query(
    "WITH r AS (SELECT count(*) FILTER (p_name LIKE 'red %') AS a, count(*) FILTER (p_type = 'PROMO') AS b FROM part) SELECT 4::BIGINT AS corrections, (2 + a + b)::BIGINT AS rows_affected, round((2 + a + b) / 4.0, 2)::DOUBLE AS rows_per_correction, (CASE WHEN a = 0 THEN 1 ELSE 0 END + CASE WHEN b = 0 THEN 1 ELSE 0 END)::BIGINT AS stale FROM r"
)
def q_corrections_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.summary(corrections.leverage(_scoped(spark, sf_dir), _corrections(spark), _COLUMNS))


@query(
    """
WITH t AS (SELECT unnest(['p_brand', 'p_name']) AS c, unnest([CASE WHEN p_partkey % 5 = 0 THEN '' ELSE upper(p_brand) END, p_name]) AS p, unnest([p_brand, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END]) AS t FROM part),
s AS (SELECT c, count(*) AS n, count(*) FILTER (p = t) AS exact, count(*) FILTER (lower(p) = lower(t)) AS norm FROM t GROUP BY 1), u AS (SELECT 'overall' AS part, * FROM s UNION ALL SELECT CASE WHEN c = 'p_brand' THEN 'retrieval_dependent' ELSE 'in_scope' END, * FROM s)
SELECT part, sum(n)::BIGINT AS scored, round(sum(exact)::DOUBLE / sum(n), 6) AS exact, round(sum(norm)::DOUBLE / sum(n), 6) AS normalised, round(sum(norm)::DOUBLE / sum(n), 6) AS token_f1 FROM u GROUP BY 1"""
)
def q_eval_overall(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    predicted = p.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.upper("p_brand")).alias("p_brand"), "p_name")
    truth = p.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_name")).alias("p_name"))
    scores = review.overall(review.field_scores(predicted, truth, "p_partkey", ["p_brand", "p_name"]), ("p_brand",))
    return scores.select("part", "scored", *[F.round(c, 6).alias(c) for c in ("exact", "normalised", "token_f1")])


@query("SELECT p_name, p_brand FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 5 <> 0")
def q_truth_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled rows with any of the supplier's columns filled, those columns alone."""
    k = F.col("p_partkey")
    t = table(spark, sf_dir, "part").select(F.when((k % 3 != 0) | (k % 5 != 0), F.col("p_name")).alias("p_name"), F.when((k % 3 != 0) | (k % 5 != 0), F.col("p_brand")).otherwise(" ").alias("p_brand"), "p_type")
    return review.inputs_of(t, ["p_name", "p_brand", "absent"])


@query()
def q_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalogue plan over the parts as a messy table: status, score and lines of each row."""
    p = table(spark, sf_dir, "part")
    text = F.format_string('%s Milw %d"x1/8"x1" %dV %s 3pk', F.concat(F.lit("P"), F.col("p_partkey").cast("string")), F.col("p_size"), F.col("p_size") + 12, F.col("p_name"))
    messy = p.select(F.col("p_partkey").alias("row_id"), F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("Mfg Part Num"), text.alias("Part Desc"), F.concat("p_type", F.lit(" Supply (1234)")).alias("Vendor"), F.when(F.col("p_size") % 3 == 0, "ACME").otherwise("-- Unbranded --").alias("DIB Brand"))
    config = plan.Config(brands=spark.createDataFrame([*BRANDS, ("Milwaukee", "Milwaukee Tool", "®", ["milw"], ["48-"], 4)], registry.ENTRY), rules=[(r"\bring\b", "Hardware>Rings"), (r"\b(bolt|rod)\b", "Hardware>Fasteners")])
    done = plan.enrich(messy, config).checked
    return done.select("row_id", "status", F.round("score", 6).alias("score"), "filled", F.col("budget.text").alias("invoice"), F.col("line.text").alias("mobile"))

"""The catalogue operators applied to the standard tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions import extract, scalars
from siftwright.operators import classify, compose, corrections, edges, facts, families, guard, registry, review, roles, specs, vocabulary

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Attributes of parts: first word, last word, brand, size."""
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.split("p_name", " ")[0].alias("a"), F.element_at(F.split("p_name", " "), -1).alias("n"), "p_brand", F.col("p_size").alias("s"))
    return facts.unpivoted(p, "id", {"a": "finish", "n": "item_type", "p_brand": "brand", "s": "size"}, "rule", 0.9)


PART_FACTS = "pf AS (SELECT p_partkey AS row_id, unnest(['finish', 'item_type', 'brand', 'size']) AS key, unnest([split_part(p_name, ' ', 1), list_last(string_split(p_name, ' ')), p_brand, p_size::VARCHAR]) AS value, unnest([0, 1, 2, 3]) AS priority FROM part)"


def members(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("row_id"), scalars.family_signature(F.col("p_type"), F.lit(""), F.col("p_name")).alias("family_id"))


MEMBERS = "m AS (SELECT p_partkey AS row_id, 'F-' || substr(sha1(lower(p_type) || '||' || list_aggregate(list_sort(list_distinct(regexp_extract_all(regexp_replace(regexp_replace(lower(p_name), '[0-9]+', ' ', 'g'), '[#\"''xX-]', ' ', 'g'), '[a-z]{3,}'))), 'string_agg', ' ')), 1, 8) AS family_id FROM part)"

VOIDS = ["-- Unbranded --", "-- No DIB Brand --", "N/A", "-", "", "  ", "Freud Inc (2435)", " two  words ", "TBD"]


@query(
    r"""
WITH v AS (SELECT c_name AS v FROM customer UNION ALL SELECT unnest(['-- Unbranded --', '-- No DIB Brand --', 'N/A', '-', '', '  ', 'Freud Inc (2435)', ' two  words ', 'TBD']))
SELECT v AS raw, CASE WHEN trim(v) = '' OR regexp_matches(trim(v), '(?i)^\s*(--\s*)?(no\s+)?(unbranded|un-?branded|none|n/?a|null|nil|tbd|unknown|no\s+[\w& ]+\s+brand|commodity\s*-\s*unbranded|not\s+applicable|-{1,3}|\.)\s*(--)?\s*$') OR (trim(v) LIKE '--%' AND trim(v) LIKE '%--') THEN NULL
  ELSE trim(regexp_replace(v, '\s+', ' ', 'g')) END AS cleaned FROM v"""
)
def q_void_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "customer").select(F.col("c_name").alias("raw")).unionAll(spark.createDataFrame([(x,) for x in VOIDS], "raw string"))
    return v.select("raw", scalars.clean(F.col("raw")).alias("cleaned"))


@query(
    """
WITH h AS (SELECT * FROM part ORDER BY p_partkey LIMIT 200), l AS (SELECT unnest(['p_name', 'p_brand', 'p_type']) AS "column", unnest([p_name, p_brand, p_type]) AS v FROM h)
SELECT "column", count(DISTINCT v)::DOUBLE / count(v) AS unique_share, avg(length(v)) AS mean_length, avg(CASE WHEN contains(trim(v), ' ') THEN 1.0 ELSE 0.0 END) AS space_share, avg(0.0) AS void_share FROM l GROUP BY 1"""
)
def q_role_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    return roles.sniffed(table(spark, sf_dir, "part").orderBy("p_partkey"), ["p_name", "p_brand", "p_type"])


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100")
def q_limit_ordered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the limit: first rows in order."""
    return roles.page(table(spark, sf_dir, "part"), 0, 100, order="p_partkey").select("p_partkey", "p_name")


@query(
    r"""
WITH v AS (SELECT p_partkey, p_size, unnest([p_size || '', p_size || '.25', p_size || '-1/8', p_size || '/64', p_size || '/20', p_size || ' x 3', 'none', '1,' || lpad(p_size || '', 3, '0')]) AS value, unnest(range(8)) AS k FROM part)
SELECT p_partkey, value, CASE k WHEN 0 THEN p_size WHEN 1 THEN p_size + 0.25 WHEN 2 THEN p_size + 0.125 WHEN 3 THEN p_size / 64.0 WHEN 4 THEN CASE WHEN p_size >= 5 THEN greatest(p_size, 20) ELSE p_size / 20.0 END WHEN 5 THEN p_size WHEN 7 THEN 1000 + p_size END::DOUBLE AS number FROM v"""
)
def q_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trade numbers: decimals, fractions, pairs, leading numbers."""
    size = F.col("p_size").cast("string")
    forms = F.array(size, F.concat(size, F.lit(".25")), F.concat(size, F.lit("-1/8")), F.concat(size, F.lit("/64")), F.concat(size, F.lit("/20")), F.concat(size, F.lit(" x 3")), F.lit("none"), F.concat(F.lit("1,"), F.lpad(size, 3, "0")))
    v = table(spark, sf_dir, "part").select("p_partkey", F.explode(forms).alias("value"))
    return v.select("p_partkey", "value", scalars.number(F.col("value")).alias("number"))


@query(
    r"""
SELECT doc_id, regexp_extract(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}') AS raw,
  (strpos(text, regexp_extract(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) - 1)::INT AS start,
  (strpos(text, regexp_extract(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')) - 1 + length(regexp_extract(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')))::INT AS "end"
FROM documents WHERE regexp_matches(text, '[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}')"""
)
def q_extract_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = (extract._simple("dotted", r"([0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3})", "ip", "IP", "", 1, "IP"),)
    d = table(spark, sf_dir, "documents").select("doc_id", F.inline(extract.facts(F.col("text"), rule)))
    return d.select("doc_id", "raw", "start", "end")


@query(
    """
WITH t AS (SELECT p_partkey, p_name || ' ' AS a, p_size || '"x1/8"x1"' AS chain, (p_size + 12) || 'V' AS volts, p_type FROM part),
f AS (SELECT p_partkey, unnest(['dimensions', 'voltage', 'base_type', 'pack_quantity', 'platform']) AS key, unnest([replace(replace(chain, 'x', ' in x '), '"', '') || ' in', replace(volts, 'V', ''), CASE WHEN p_type = 'MEDIUM' THEN 'MEDIUM' END, '3', CASE WHEN volts = '18V' THEN '18V' END]) AS value, unnest(['', 'V', '', '', '']) AS uom,
  unnest(['Size', 'Voltage Rating', 'Base Type', 'Pack Quantity', 'Battery Platform']) AS label, unnest(['DIM-CHN-01', 'ELE-V-01', 'LMP-BAS-01', 'PKG-PK-01', 'TOL-PLT-01']) AS rule_id, unnest([20, 25, 31, 40, 26]) AS priority, unnest([chain, volts, 'MEDIUM', '3pk', volts]) AS raw,
  unnest([length(a), length(a || chain) + 1, length(a || chain || volts) + 2, length(a || chain || volts || p_type) + 3, length(a || chain) + 1]) AS start FROM t)
SELECT p_partkey, key, value, uom, label, rule_id, priority, raw, start::INT AS start, (start + length(raw))::INT AS "end" FROM f WHERE value IS NOT NULL"""
)
def q_extract_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All extraction rules over composed descriptions, whose facts are known from how they are composed."""
    d = table(spark, sf_dir, "part").select("p_partkey", F.format_string('%s %d"x1/8"x1" %dV %s 3pk', F.col("p_name"), F.col("p_size"), F.col("p_size") + 12, F.col("p_type")).alias("text"))
    return d.select("p_partkey", F.inline(extract.facts(F.col("text"))))


@query("SELECT p_partkey, p_name || ' -' || CASE WHEN p_type = 'MEDIUM' THEN '' ELSE ' ' || p_type END AS residual FROM part")
def q_span_residual(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "part").select("p_partkey", F.format_string('%s %d"x1/8"x1" %dV w/%s', F.col("p_name"), F.col("p_size"), F.col("p_size") + 12, F.col("p_type")).alias("text"))
    return d.select("p_partkey", extract.residual(F.col("text"), extract.facts(F.col("text"))).alias("residual"))


@query("SELECT c_custkey, trim(regexp_replace(c_name, '^\\s*Customer\\s*[-:#]?\\s*', '')) AS stripped FROM customer")
def q_strip_echo(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.trim(F.regexp_replace(scalars.without_echo(F.col("c_name"), F.lit("Customer")), r"^[#]\s*", "")).alias("stripped"))


@query(
    """
WITH w AS (SELECT string_split(lower(p_name), ' ') AS w FROM part), g AS (SELECT unnest(list_filter([CASE WHEN len(w) >= 1 THEN array_to_string(w[len(w):], ' ') END, CASE WHEN len(w) >= 2 THEN array_to_string(w[len(w) - 1:], ' ') END, CASE WHEN len(w) >= 3 THEN array_to_string(w[len(w) - 2:], ' ') END], lambda x: x IS NOT NULL)) AS gram FROM w),
c AS (SELECT gram, count(*) AS n FROM g GROUP BY gram), s AS (SELECT unnest(['ring', 'frobnicator']) AS seed)
SELECT coalesce(gram, seed) AS gram, coalesce(n, 0)::BIGINT AS n, seed IS NOT NULL AS seeded FROM c FULL JOIN s ON gram = seed WHERE seed IS NOT NULL OR n >= CASE WHEN contains(gram, ' ') THEN 2 ELSE 3 END"""
)
def q_ngram_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vocabulary.mine(table(spark, sf_dir, "part"), "p_name", seeds=["ring", "frobnicator"])


@query(
    """
WITH c AS (SELECT lower(p_name) AS gram, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 2), w AS (SELECT list_last(string_split(lower(p_name), ' ')) AS gram, count(*) AS n FROM part GROUP BY 1 HAVING count(*) >= 3),
v AS (SELECT * FROM c UNION SELECT * FROM w)
SELECT p_partkey AS row_id, coalesce(a.gram, b.gram) AS gram, coalesce(a.n, b.n) AS n, CASE WHEN a.gram IS NOT NULL THEN 2 ELSE 1 END::INT AS n_words FROM part LEFT JOIN v a ON a.gram = lower(p_name) LEFT JOIN v b ON b.gram = list_last(string_split(lower(p_name), ' ')) WHERE coalesce(a.gram, b.gram) IS NOT NULL"""
)
def q_longest_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return vocabulary.longest(p, "p_partkey", "p_name", vocabulary.mine(p, "p_name"))


@query(
    """
WITH p AS (SELECT p_brand, CASE WHEN p_size % 4 > 0 THEN 'ring' ELSE list_last(string_split(p_name, ' ')) END AS noun FROM part),
c AS (SELECT p_brand, noun, count(*) AS n FROM p GROUP BY 1, 2), r AS (SELECT *, sum(n) OVER (PARTITION BY p_brand) AS total, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, noun) AS k FROM c)
SELECT p_brand, total::BIGINT AS total, n, noun FROM r WHERE k = 1 AND n >= 2 AND n >= 0.7 * total"""
)
def q_series_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("noun", F.when(F.col("p_size") % 4 > 0, "ring").otherwise(F.element_at(F.split("p_name", " "), -1)))
    return vocabulary.votes(p, ["p_brand"], "noun")


@query("SELECT n_name AS name, n_name AS brand FROM nation UNION ALL SELECT r_name, NULL FROM region")
def q_alias_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    names = n.select(F.col("n_name").alias("name")).unionAll(table(spark, sf_dir, "region").select(F.col("r_name").alias("name")))
    return registry.by_alias(names, "name", n.select(F.lower("n_name").alias("alias"), F.col("n_name").alias("brand"), F.col("n_nationkey").alias("seq"))).select("name", "brand")


@query("SELECT p_partkey, CASE WHEN starts_with(p_brand, 'Brand#12') AND length(p_brand) > 8 THEN 'twelve' WHEN starts_with(p_brand, 'Brand#1') AND length(p_brand) > 7 THEN 'one' WHEN starts_with(p_brand, 'Brand#2') AND length(p_brand) > 7 THEN 'two' END AS brand FROM part")
def q_prefix_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", registry.by_prefix(p, F.col("p_brand"), [("Brand#1", "one"), ("Brand#12", "twelve"), ("Brand#2", "two")]).alias("brand"))


@query(
    r"""
SELECT doc_id, CASE WHEN regexp_matches(lower(text), '(^|[^\w])creative commons([^\w]|$)') THEN 'Creative Commons' WHEN regexp_matches(lower(text), '(^|[^\w])licensed([^\w]|$)') THEN 'Licensed' WHEN regexp_matches(lower(text), '(^|[^\w])license([^\w]|$)') THEN 'License' WHEN regexp_matches(lower(text), '(^|[^\w])gnu([^\w]|$)') THEN 'GNU' END AS name FROM documents"""
)
def q_text_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", registry.mentioned(F.col("text"), ["License", "GNU", "Creative Commons", "Licensed"]).alias("name"))


@query(
    """
WITH p AS (SELECT p_partkey, list_last(string_split(p_name, ' ')) AS n FROM part)
SELECT p_partkey, n || 's' AS noun, CASE WHEN n IN ('ring', 'widget', 'gadget', 'bolt', 'gear') THEN n END AS nearest, CASE WHEN n IN ('ring', 'widget', 'gadget', 'bolt', 'gear') THEN round(2 * length(n) / (2 * length(n) + 1)::DOUBLE, 6) END AS ratio FROM p"""
)
def q_fuzzy_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name with one letter more: the ratio of matching blocks is known, though SQL engines have none that is equal."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.element_at(F.split("p_name", " "), -1), F.lit("s")).alias("noun"))
    return registry.similar(p, "noun", ["ring", "widget", "gadget", "bolt", "gear"], 0.8).withColumn("ratio", F.round("ratio", 6))


RULES = [(r"^red", "Colour>Red"), (r"^(small|tiny)", "Size>Small"), (r"ring", "Kind>Ring"), (r"^promo", "Type>Promo")]


@query(
    """
SELECT p_partkey, CASE WHEN regexp_matches(p_name, '(?i)^red') THEN 'Colour>Red' WHEN regexp_matches(p_name, '(?i)^(small|tiny)') THEN 'Size>Small' WHEN regexp_matches(p_name, '(?i)ring') THEN 'Kind>Ring' WHEN regexp_matches(p_name, '(?i)^promo') THEN 'Type>Promo'
 WHEN regexp_matches(p_type, '(?i)^red') THEN 'Colour>Red' WHEN regexp_matches(p_type, '(?i)^(small|tiny)') THEN 'Size>Small' WHEN regexp_matches(p_type, '(?i)ring') THEN 'Kind>Ring' WHEN regexp_matches(p_type, '(?i)^promo') THEN 'Type>Promo' END AS path FROM part"""
)
def q_rule_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", classify.classify(RULES, F.col("p_name"), F.col("p_type"))["path"].alias("path"))


@query("WITH " + PART_FACTS + " SELECT row_id, key, value, priority, 'rule' AS method, 0.9::DOUBLE AS confidence FROM pf WHERE value <> ''")
def q_fact_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = facts.admitted(part_facts(spark, sf_dir).withColumn("evidence", F.array("value")))
    return good.drop("evidence")


@query(
    """
WITH c AS (SELECT p_partkey AS row_id, 'size' AS key, p_size::VARCHAR AS v1, CASE WHEN p_partkey % 3 = 0 THEN (p_size + 1)::VARCHAR ELSE p_size::VARCHAR END AS v2, CASE WHEN p_partkey % 2 = 0 THEN 0.95 ELSE 0.7 END AS c2 FROM part)
SELECT row_id, key, CASE WHEN v1 = v2 OR c2 <= 0.9 THEN v1 ELSE v2 END AS value, CASE WHEN v1 = v2 THEN least(0.995, 0.9 + (1 - 0.9) * 0.55) ELSE greatest(0.05, greatest(0.9, c2) * 0.65) END::DOUBLE AS confidence, CASE WHEN v1 = v2 THEN 0 ELSE 1 END::INT AS conflicts FROM c"""
)
def q_fact_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    one = p.select(F.col("p_partkey").alias("row_id"), F.lit("size").alias("key"), F.col("p_size").cast("string").alias("value"), F.lit("").alias("uom"), F.lit("rule").alias("method"), F.lit(0.9).alias("confidence"), F.lit(1).alias("seq"))
    other = F.when(F.col("p_partkey") % 3 == 0, F.col("p_size") + 1).otherwise(F.col("p_size")).cast("string")
    two = p.select(F.col("p_partkey").alias("row_id"), F.lit("size").alias("key"), other.alias("value"), F.lit("").alias("uom"), F.lit("llm").alias("method"), F.when(F.col("p_partkey") % 2 == 0, 0.95).otherwise(0.7).alias("confidence"), F.lit(2).alias("seq"))
    return facts.merged(one.unionAll(two)).select("row_id", "key", "value", "confidence", F.size("conflicts").alias("conflicts"))


@query("WITH " + MEMBERS + " SELECT row_id, family_id FROM m")
def q_family_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    return members(spark, sf_dir)


_FAMILY_VOTES = "WITH " + PART_FACTS + ", " + MEMBERS + ", v AS (SELECT family_id, key, trim(value) AS value, count(DISTINCT row_id) AS n FROM pf JOIN m USING (row_id) GROUP BY 1, 2, 3)"


@query(_FAMILY_VOTES + " SELECT family_id, key, min(value) AS value, sum(n)::BIGINT AS support, least(0.88, 0.6 + 0.05 * sum(n))::DOUBLE AS confidence FROM v GROUP BY 1, 2 HAVING count(*) = 1 AND sum(n) >= 2")
def q_family_consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.consensus(part_facts(spark, sf_dir), members(spark, sf_dir))


@query(
    """
WITH f AS (SELECT o_orderkey AS row_id, o_custkey AS family_id, o_orderstatus AS value FROM orders), v AS (SELECT family_id, value, count(*) AS n FROM f GROUP BY 1, 2),
t AS (SELECT family_id, sum(n)::BIGINT AS total, count(*) AS vals, max(n) AS most, arg_min(value, (-n, value)) AS usual FROM v GROUP BY 1 HAVING sum(n) >= 4 AND count(*) >= 2 AND max(n) >= 0.75 * sum(n))
SELECT row_id, family_id, 'status' AS key, value, usual, most, total FROM f JOIN t USING (family_id) WHERE value <> usual"""
)
def q_family_anomaly(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("row_id"), F.col("o_custkey").alias("family_id"), F.col("o_orderstatus").alias("value"))
    return families.anomalies(o.select("row_id", F.lit("status").alias("key"), "value"), o.select("row_id", "family_id"))


@query(_FAMILY_VOTES + ", f AS (SELECT family_id, key, sum(n) AS n, count(*) AS vals FROM v GROUP BY 1, 2 HAVING sum(n) >= 2) SELECT key, count(*) AS families, count(*) FILTER (vals = 1) AS agreeing, avg(CASE WHEN vals = 1 THEN 1.0 ELSE 0.0 END) AS rate FROM f GROUP BY key HAVING count(*) >= 3")
def q_family_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.consistency(part_facts(spark, sf_dir), members(spark, sf_dir))


@query("WITH " + MEMBERS + ", r AS (SELECT *, row_number() OVER (PARTITION BY family_id ORDER BY row_id) AS k, count(*) OVER (PARTITION BY family_id) AS size FROM m) SELECT family_id, size, array_to_string(list(row_id ORDER BY row_id), ',') AS members FROM r WHERE k <= 25 AND size >= 2 GROUP BY 1, 2")
def q_family_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return families.listing(members(spark, sf_dir)).withColumn("members", F.array_join(F.transform("members", lambda m: m.cast("string")), ","))


_SPEC = (
    "WITH "
    + PART_FACTS
    + """, o AS (SELECT p_type AS category, key, value, row_id FROM pf JOIN part ON p_partkey = row_id), s AS (SELECT p_type AS category, count(*) AS n_rows FROM part GROUP BY 1 HAVING count(*) >= 3),
v AS (SELECT category, key, value, count(DISTINCT row_id) AS n FROM o GROUP BY 1, 2, 3), k AS (SELECT category, key, sum(n)::BIGINT AS total, count(*) AS cardinality, sum(n * log2(n)) AS nlogn FROM v GROUP BY 1, 2)
SELECT category, key, n_rows, total AS support, total::DOUBLE / n_rows AS fill, cardinality, CASE WHEN cardinality > 1 THEN (log2(total) - nlogn / total) / log2(cardinality) ELSE 0 END AS entropy,
 cardinality > 1 AND cardinality <= 40 AND total::DOUBLE / n_rows >= 0.35 AND cardinality < greatest(2.0, 0.6 * n_rows) AS facet FROM k JOIN s USING (category) WHERE total::DOUBLE / n_rows >= 0.2"""
)


@query(_SPEC)
def q_category_spec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.induced(part_facts(spark, sf_dir), table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_type").alias("category")))


@query("WITH " + PART_FACTS + ", c AS (SELECT key, value, count(*) AS n FROM pf GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n DESC, value) AS nth FROM c) SELECT key, value, n, nth::INT AS nth FROM r WHERE nth <= 10")
def q_lov_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report."""
    return specs.top_values(part_facts(spark, sf_dir), ["key"], "value", 10)


@query("WITH c AS (SELECT o_orderstatus, o_totalprice, count(*) AS n FROM orders GROUP BY 1, 2) SELECT o_orderstatus, sum(n)::BIGINT AS mentions, count(*) AS n_values, count(*) FILTER (n = 1) AS singletons, coalesce(sum(n) FILTER (n > 1), 0)::DOUBLE / sum(n) AS closed_rate FROM c GROUP BY 1")
def q_lov_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return specs.coverage(table(spark, sf_dir, "orders"), ["o_orderstatus"], "o_totalprice")


@query(
    """
WITH l AS (SELECT p_type AS category, unnest([1, 2]) AS position, unnest([list_last(string_split(p_name, ' ')), p_brand]) AS label, unnest([p_size::VARCHAR, p_name]) AS value FROM part),
c AS (SELECT category, position, label, count(*) AS n, count(*) FILTER (trim(value) <> '') AS n_values FROM l GROUP BY 1, 2, 3), r AS (SELECT *, row_number() OVER (PARTITION BY category, position ORDER BY n DESC, label) AS k, sum(n) OVER (PARTITION BY category, position) AS support FROM c)
SELECT category, position::INT AS position, label, n, n_values, support::BIGINT AS support FROM r WHERE k = 1"""
)
def q_pack_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("noun", F.element_at(F.split("p_name", " "), -1))
    return specs.learned_slots(p, "p_type", {1: ("noun", "p_size", "p_type"), 2: ("p_brand", "p_name", "p_type")})


@query("SELECT l_orderkey * 10 + l_linenumber AS row_id, 'GRD-DOM-GA' AS rule, 'gauge' AS key, 'error' AS severity FROM lineitem WHERE l_quantity < 1 OR l_quantity > 40")
def q_guard_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("row_id"), F.lit("gauge").alias("key"), F.col("l_quantity").cast("string").alias("value"), F.lit("GA").alias("uom"))
    return guard.findings(li)


@query("SELECT p_partkey AS row_id, 'GRD-REL-ARB' AS rule, 'arbor_size' AS key, 'error' AS severity FROM part WHERE p_size / 25.4 >= 1.0")
def q_guard_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    arbor = p.select(F.col("p_partkey").alias("row_id"), F.lit("arbor_size").alias("key"), F.col("p_size").cast("string").alias("value"), F.lit("mm").alias("uom"))
    disc = p.select(F.col("p_partkey").alias("row_id"), F.lit("diameter").alias("key"), F.lit("1").alias("value"), F.lit("in").alias("uom"))
    return guard.findings(arbor.unionAll(disc)).filter("rule LIKE 'GRD-REL%'")


@query("SELECT p_partkey, (p_size + 0.125) * u.f AS inches, u.unit FROM part, (VALUES ('in', 1.0::DOUBLE), ('ft', 12.0::DOUBLE), ('mm', 1 / 25.4::DOUBLE), ('cm', 1 / 2.54::DOUBLE)) u(unit, f)")
def q_unit_convert(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat(F.col("p_size").cast("string"), F.lit("-1/8")).alias("v"), F.explode(F.array(*map(F.lit, ("in", "ft", "mm", "cm")))).alias("unit"))
    return p.select("p_partkey", scalars.inches(scalars.number(F.col("v")), F.col("unit")).alias("inches"), "unit")


@query("SELECT p_partkey, p_size / 64.0 AS decimal, CASE WHEN p_size % 64 = 0 THEN (p_size / 64)::BIGINT::VARCHAR ELSE CASE WHEN p_size > 64 THEN floor(p_size / 64)::BIGINT::VARCHAR || '-' ELSE '' END || ((p_size % 64) / gcd(p_size % 64, 64))::BIGINT::VARCHAR || '/' || (64 / gcd(p_size % 64, 64))::BIGINT::VARCHAR END AS fraction FROM part")
def q_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").withColumn("decimal", F.col("p_size") / 64.0)
    return p.select("p_partkey", "decimal", scalars.fraction(F.col("decimal").cast("string")).alias("fraction"))


@query(
    """
WITH v AS (SELECT p_partkey, p_name, (CASE WHEN length(p_name) > 12 THEN 1 ELSE 0 END + CASE WHEN upper(p_brand) <> p_brand THEN 1 ELSE 0 END)::INT AS n, length(p_name) > 12 AS bad, CASE WHEN p_size > 40 THEN 0.5 ELSE 0.9 END AS score FROM part)
SELECT p_partkey, n AS n_violations, CASE WHEN bad THEN 'blocked' WHEN score < 0.75 THEN 'needs_review' ELSE 'ready' END AS status FROM v"""
)
def q_validate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = [guard.FieldRule("p_name", "NAME", most=12), guard.FieldRule("p_brand", "BRAND", upper=True, severity="info")]
    p = table(spark, sf_dir, "part").withColumn("v", guard.violations(rules))
    return p.select("p_partkey", F.size("v").alias("n_violations"), guard.status(F.col("v"), F.when(F.col("p_size") > 40, 0.5).otherwise(0.9)).alias("status"))


@query(
    """
WITH p AS (SELECT p_partkey, [upper(p_name), upper(p_type), upper(p_brand), p_size::VARCHAR || 'IN', upper(p_name)] AS t FROM part)
SELECT p_partkey, list_reduce(t, lambda a, x: CASE WHEN length(a) + CASE WHEN a = '' THEN 0 ELSE 1 END + length(x) <= 40 THEN a || CASE WHEN a = '' THEN '' ELSE ' ' END || x
  WHEN contains(x, ' ') AND length(a) + 1 + length(array_to_string(list_transform(string_split(x, ' '), lambda w: w[:4]), '')) <= 40 THEN a || ' ' || array_to_string(list_transform(string_split(x, ' '), lambda w: w[:4]), '') ELSE a END, '') AS line FROM p"""
)
def q_invoice_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    pieces = F.array(*[F.struct(F.lit("k").alias("key"), compose.forms(c).alias("forms")) for c in (F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.concat(F.col("p_size").cast("string"), F.lit("in")), F.col("p_name"))])
    return p.select("p_partkey", compose.within_budget(pieces)["text"].alias("line"))


@query(
    "WITH "
    + PART_FACTS
    + """, r AS (SELECT *, row_number() OVER (PARTITION BY row_id ORDER BY priority, key) AS slot FROM pf)
SELECT row_id, max(key) FILTER (slot = 1) AS label_1, max(value) FILTER (slot = 1) AS value_1, max(key) FILTER (slot = 2) AS label_2, max(value) FILTER (slot = 2) AS value_2, max(key) FILTER (slot = 3) AS label_3, max(value) FILTER (slot = 3) AS value_3 FROM r GROUP BY row_id"""
)
def q_attr_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compose.wide(compose.slotted(part_facts(spark, sf_dir), 3), 3)


def _part_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_brand").alias("brand"), F.col("p_type").alias("kind"), F.col("p_size").alias("size"), "p_name")


@query(
    """
WITH l AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_size <= 10), r AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS k FROM part WHERE p_size > 40)
SELECT l.p_partkey AS source, r.p_partkey AS target, 'powers' AS relation, 'KG-PLT-01' AS rule FROM l JOIN r USING (p_brand) WHERE l.k <= 25 AND r.k <= 25"""
)
def q_edges_blocked(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _part_nodes(spark, sf_dir)
    return edges.blocked(n, ["brand"], F.col("size") <= 10, F.col("size") > 40, "row_id", 25, "powers", "KG-PLT-01")


_STAR = "r AS (SELECT p_name, p_partkey, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS k, count(*) OVER (PARTITION BY p_name) AS n, min(p_partkey) OVER (PARTITION BY p_name) AS head FROM part), e AS (SELECT head AS source, p_partkey AS target, 'variant_of' AS relation, 'KG-VAR-01' AS rule FROM r WHERE k BETWEEN 2 AND 25 AND n <= 60)"


@query("WITH " + _STAR + " SELECT * FROM e")
def q_edges_star(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.star(_part_nodes(spark, sf_dir), ["p_name"], "row_id", "variant_of", "KG-VAR-01", largest=60)


@query(
    """
WITH k AS (SELECT *, row_number() OVER (PARTITION BY p_type, p_size, p_brand ORDER BY p_partkey) AS k, min(p_partkey) OVER (PARTITION BY p_type, p_size, p_brand) AS f FROM part)
SELECT a.p_partkey AS source, b.p_partkey AS target, 'cross_reference' AS relation, 'KG-XRF-01' AS rule FROM k a JOIN k b ON a.p_type = b.p_type AND a.p_size = b.p_size AND a.p_brand <> b.p_brand AND a.f < b.f WHERE a.k <= 6 AND b.k <= 6"""
)
def q_edges_xref(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six rows of each brand in a block, however many another brand has there."""
    return edges.across(_part_nodes(spark, sf_dir), ["kind", "size"], "brand", "row_id", 6, "cross_reference", "KG-XRF-01")


@query("WITH " + _STAR + ", d AS (SELECT source AS row_id FROM e UNION ALL SELECT target FROM e) SELECT row_id, count(*) AS degree FROM d GROUP BY 1")
def q_edge_degree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edges.degrees(edges.distinct(q_edges_star(spark, sf_dir)))


@query(
    "WITH "
    + MEMBERS
    + """, s AS (SELECT row_id, family_id, count(*) OVER (PARTITION BY family_id) AS family_rows, p_size / 50.0 AS score, p_name, p_size FROM m JOIN part ON p_partkey = row_id),
i AS (SELECT *, unnest(list_filter([CASE WHEN length(p_name) > 8 THEN 'too long' END, CASE WHEN p_size < 10 THEN 'too small' END], lambda x: x IS NOT NULL)) AS issue FROM s)
SELECT row_id, family_id, family_rows, issue, round((1 - score) * family_rows, 3) AS review_value FROM i"""
)
def q_review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), (F.col("p_size") / 50.0).alias("score"), F.array_compact(F.array(F.when(F.length("p_name") > 8, "too long"), F.when(F.col("p_size") < 10, "too small"))).alias("issues"))
    return review.queue(p.join(members(spark, sf_dir), "row_id"), "family_id", "score", F.col("issues")).select("row_id", "family_id", "family_rows", "issue", "review_value")


@query("SELECT s_suppkey AS row_id, unnest(['s_name', 's_nationkey', 's_acctbal']) AS \"column\", unnest([s_name, s_nationkey::VARCHAR, s_acctbal::INT::VARCHAR]) AS value, 'input' AS method FROM supplier")
def q_provenance_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = table(spark, sf_dir, "supplier").withColumn("s_acctbal", F.bround("s_acctbal").cast("int"))
    return review.ledger(s, "s_suppkey", ["s_name", "s_nationkey", "s_acctbal"], "input")


_F1 = """tok AS (SELECT item_id, list_filter(regexp_extract_all(lower(a), '[a-z0-9]+(?:[./-][a-z0-9]+)*'), lambda x: true) AS x, regexp_extract_all(lower(b), '[a-z0-9]+(?:[./-][a-z0-9]+)*') AS y FROM pair),
f AS (SELECT item_id, CASE WHEN len(x) = 0 AND len(y) = 0 THEN 1.0 WHEN len(x) = 0 OR len(y) = 0 THEN 0.0 ELSE 2.0 * coalesce(list_sum(list_transform(list_distinct(x), lambda w: least(len(list_filter(x, lambda v: v = w)), len(list_filter(y, lambda v: v = w))))), 0) / (len(x) + len(y)) END::DOUBLE AS f1 FROM tok)"""


@query("WITH pair AS (SELECT x.item_id, x.text AS a, y.text AS b FROM benchmark x LEFT JOIN benchmark y ON y.item_id = x.item_id + 1), " + _F1.replace("lower(b)", "lower(coalesce(b, ''))") + " SELECT item_id, f1 FROM f")
def q_token_f1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark text with the next one's, both whole."""
    b = table(spark, sf_dir, "benchmark")
    after = b.select((F.col("item_id") - 1).alias("item_id"), F.col("text").alias("next"))
    return b.join(after, "item_id", "left").select("item_id", scalars.token_f1(F.col("text"), F.col("next")).alias("f1"))


@query(
    """
WITH t AS (SELECT unnest(['p_brand', 'p_name']) AS "column", unnest([CASE WHEN p_partkey % 5 = 0 THEN '' ELSE upper(p_brand) END, p_name]) AS p, unnest([p_brand, CASE WHEN p_partkey % 7 = 0 THEN '' ELSE p_name END]) AS t FROM part)
SELECT "column", count(*) AS scored, count(*) FILTER (p = t) AS exact, count(*) FILTER (lower(p) = lower(t)) AS normalised, avg(CASE WHEN lower(p) = lower(t) THEN 1.0 ELSE 0.0 END) AS token_f1, count(*) FILTER (p = '') AS missed, count(*) FILTER (t = '') AS overfilled FROM t WHERE p <> '' OR t <> '' GROUP BY 1"""
)
def q_eval_field_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    predicted = p.select("p_partkey", F.when(F.col("p_partkey") % 5 == 0, "").otherwise(F.upper("p_brand")).alias("p_brand"), "p_name")
    truth = p.select("p_partkey", "p_brand", F.when(F.col("p_partkey") % 7 == 0, "").otherwise(F.col("p_name")).alias("p_name"))
    return review.field_scores(predicted, truth, "p_partkey", ["p_brand", "p_name"])


@query("SELECT unnest(['p_name', 'p_type']) AS \"column\", count(*) AS filled, unnest([count(*) FILTER (length(p_name) <= 10), count(*) FILTER (length(p_type) <= 6)]) AS compliant, unnest([avg(length(p_name)), avg(length(p_type))]) AS mean_length FROM part")
def q_char_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return review.length_report(table(spark, sf_dir, "part"), {"p_name": 10, "p_type": 6})


CORRECTIONS = [("part", "7", "size", "99", 1), ("classpath", "PROMO", "size", "1", 2), ("family", " F-red", "size", "5", 3), ("part", "7", "note", "seen", 4)]


def _corrections(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CORRECTIONS, "scope string, target string, key string, value string, seq int")


def _scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("row_id"), F.col("p_partkey").alias("part"), F.col("p_type").alias("classpath"), F.concat(F.lit("F-"), F.split("p_name", " ")[0]).alias("family"))


_COLUMNS = {"part": "part", "family": "family", "classpath": "classpath"}


@query(
    """
SELECT p_partkey AS row_id, 'size' AS key, CASE WHEN p_partkey = 7 THEN '99' WHEN p_name LIKE 'red %' THEN '5' WHEN p_type = 'PROMO' THEN '1' ELSE p_size::VARCHAR END AS value, CASE WHEN p_partkey = 7 OR p_name LIKE 'red %' OR p_type = 'PROMO' THEN 0.99 ELSE 0.9 END::DOUBLE AS confidence,
 CASE WHEN p_partkey = 7 OR p_name LIKE 'red %' OR p_type = 'PROMO' THEN p_size::VARCHAR END AS was, CASE WHEN p_partkey = 7 THEN 'part' WHEN p_name LIKE 'red %' THEN 'family' WHEN p_type = 'PROMO' THEN 'classpath' END AS scope FROM part UNION ALL SELECT 7, 'note', 'seen', 0.99, NULL, 'part'"""
)
def q_corrections_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = part_facts(spark, sf_dir).filter("key = 'size'")
    return corrections.applied(f, _scoped(spark, sf_dir), _corrections(spark), _COLUMNS)


@query("SELECT * FROM (VALUES ('part', '7', 'size', 1::BIGINT, false), ('part', '7', 'note', 1, false)) v(scope, target, key, rows, stale) UNION ALL SELECT 'family', ' F-red', 'size', count(*), count(*) = 0 FROM part WHERE p_name LIKE 'red %' UNION ALL SELECT 'classpath', 'PROMO', 'size', count(*), count(*) = 0 FROM part WHERE p_type = 'PROMO'")
def q_corrections_stale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corrections.leverage(_scoped(spark, sf_dir), _corrections(spark), _COLUMNS)


@query("WITH d AS (SELECT o_custkey, arg_min(o_totalprice, o_orderkey) AS o FROM orders GROUP BY 1) SELECT c_custkey, c_acctbal AS truth, o AS predicted FROM customer JOIN d ON o_custkey = c_custkey")
def q_truth_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first prediction of each key, beside the truth."""
    predicted = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", F.col("o_totalprice").alias("amount"))
    truth = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("amount"))
    return review.joined(predicted, truth, "c_custkey", ["amount"], "o_orderkey").select("c_custkey", F.col("t.amount").alias("truth"), F.col("p.amount").alias("predicted"))


@query("SELECT p_partkey FROM part WHERE p_type = (SELECT min(p_type) FROM part) AND contains(lower(p_name || p_type), 'r') ORDER BY p_partkey LIMIT 50 OFFSET 5")
def q_page_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature is the page."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type")
    least = p.agg(F.min("p_type").alias("t")).first()["t"]
    return roles.page(p, 5, 50, {"p_type": least}, "R", "p_partkey").select("p_partkey")


@query("SELECT event_id, json_extract_string(props, '$.k')::INT AS k FROM events")
def q_json_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit("```json\n"), F.col("props"), F.lit("\n```")).alias("answer"))
    return e.select("event_id", F.get_json_object(scalars.json_object(F.col("answer")), "$.k").cast("int").alias("k"))


@query(
    """
WITH p AS (SELECT p_type, p_brand AS l FROM part WHERE p_size <= 25 GROUP BY 1, 2), t AS (SELECT p_type, p_brand AS l FROM part WHERE p_size > 20 GROUP BY 1, 2),
c AS (SELECT p_type, count(*) FILTER (p.l IS NOT NULL AND t.l IS NOT NULL)::INT AS hits, count(*) FILTER (p.l IS NULL)::INT AS missed, count(*) FILTER (t.l IS NULL)::INT AS extra FROM p FULL JOIN t USING (p_type, l) GROUP BY 1)
SELECT p_type, hits, missed, extra FROM (SELECT * FROM (SELECT coalesce(p.p_type, t.p_type) AS p_type, count(*) FILTER (p.l IS NOT NULL AND t.l IS NOT NULL)::INT AS hits, count(*) FILTER (p.l IS NULL)::INT AS missed, count(*) FILTER (t.l IS NULL)::INT AS extra FROM p FULL JOIN t ON p.p_type = t.p_type AND p.l = t.l GROUP BY 1))"""
)
def q_setops(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return specs.scored(p.filter("p_size <= 25"), p.filter("p_size > 20"), "p_type", "p_brand").select("p_type", "hits", "missed", "extra")


@query("SELECT p_partkey AS row_id, round((3 * 0.9 + 0.5 + (p_size % 5) / 10.0)::DOUBLE / 4, 6) AS score, 4::BIGINT AS n_facts FROM part")
def q_row_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    varied = F.when(F.col("key") == "size", 0.5 + F.col("value").try_cast("int") % 5 / 10.0).otherwise(F.col("confidence"))
    return facts.row_scores(part_facts(spark, sf_dir).withColumn("confidence", varied)).withColumn("score", F.round("score", 6))


@query(
    "WITH "
    + PART_FACTS
    + """ SELECT row_id, substr(sha1('[' || string_agg('["' || key || '", "' || regexp_replace(lower(value), '[^a-z0-9./-]', '', 'g') || '"]', ', ' ORDER BY key) || ']'), 1, 12) AS fingerprint FROM pf GROUP BY 1"""
)
def q_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.fingerprint(part_facts(spark, sf_dir))


@query("SELECT p_partkey AS row_id, 'size' AS key, p_size::VARCHAR AS value, CASE WHEN p_partkey % 4 = 0 THEN least(0.99, 0.9 + 0.1 * 0.5) WHEN p_partkey % 4 = 1 THEN greatest(0.05, 0.9 * 0.45) ELSE 0.9 END::DOUBLE AS confidence FROM part")
def q_audit_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = part_facts(spark, sf_dir).filter("key = 'size'")
    v = f.select("row_id", "key", F.when(F.col("row_id") % 4 == 0, "supported").when(F.col("row_id") % 4 == 1, "unsupported").otherwise("unsure").alias("verdict"))
    return facts.judged(f, v).select("row_id", "key", "value", "confidence")


@query(
    """
WITH q AS (SELECT doc_id, text, unnest([substr(text, 1, 12), substr(text, length(text) // 2, 25), right(text, 15), 'zzzzqq', ' ', text]) AS quote, unnest(range(6)) AS nth FROM documents)
SELECT doc_id, nth, length(quote)::INT AS n FROM q WHERE trim(quote) <> '' AND contains(lower(text), lower(trim(quote)))"""
)
def q_evidence_firewall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quotes from the start, the middle and the end of whole texts, of all of a text, and some that are not there."""
    n = F.length("text")
    quotes = F.array(F.substring("text", 1, 12), F.substring("text", (n / 2).cast("int"), F.lit(25)), F.right("text", F.lit(15)), F.lit("zzzzqq"), F.lit(" "), F.col("text"))
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.posexplode(quotes).alias("nth", "quote"))
    return facts.grounded(d).select("doc_id", F.col("nth").cast("long").alias("nth"), F.length("quote").alias("n"))

"""Names resolved against a registry: by alias, by name core, by longest code prefix, by mention in text, by similarity; and who contradicts it.

A registry is a dimension of one row for each brand: brand, manufacturer, symbol, aliases, prefixes (arrays) and seq, the order in
which entries claim a name that several have.
"""

from __future__ import annotations

import difflib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Words of company names that tell nothing.
CORPORATE = (
    "inc|llc|ltd|corp|corporation|company|co|mfg|manufacturing|products|prod|tools?|tool|usa|us|na|international|intl|group|holdings?|industries|industrial|lighting|electric|electrical|accessory|accessories|sales|brands|technologies"
)
# Marks of suppliers that sell what others make.
RESELLERS = (
    "cooperative", "co-op", "coop", "dealers", "distributor", "supply", "lumber", "building materials", "parksite", "wholesale", "industrial supply", "jam industrial", "palmer donavin", "westwood", "boise cascade", "u s lumber", "us lumber",
    "tech gear", "premier metals", "metalmark", "fenton bros", "v & v appliance",
)
# Names that are everyday words beside some others.
NOT_BESIDE = {
    "phillips": ("drive", "bit", "head", "screw", "driver", "tip", "point", "ph2"), "philips": ("drive", "bit", "head", "screw", "driver", "tip", "point"), "square": ("drive", "edge", "edg", "foot", "ft", "head", "bit"), "square d": ("drive", "edge"),
    "element": ("heating", "filter"), "keystone": ("jack", "insert", "plate"), "jet": ("black", "stream"), "sabre": ("saw",),
}
#: Registries are dimensions; a larger one is joined by shuffle, and can't be searched for similar names.
BROADCAST_ROWS = 100_000
ENTRY = "brand string, manufacturer string, symbol string, aliases array<string>, prefixes array<string>, seq int"


def norm(name: Column) -> Column:
    """Lower case, without a trailing code in brackets and signs other than & and +."""
    plain = F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"\s*\([A-Za-z0-9]{3,6}\)\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(plain, r"[^a-z0-9&+ ]+", " "), r"\s+", " "))


def core(name: Column) -> Column:
    """norm without words that tell nothing."""
    return F.trim(F.regexp_replace(F.regexp_replace(norm(name), rf"\b(?:{CORPORATE})\b\.?", " "), r"\s+", " "))


def is_reseller(name: Column) -> Column:
    plain = norm(name)
    out = F.lit(False)
    for mark in RESELLERS:
        out = out | F.contains(plain, F.lit(mark))
    return out


def small(df: DataFrame) -> DataFrame:
    """df with a broadcast hint, if it has at most BROADCAST_ROWS rows."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def loaded(rows: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """A registry from a master list with columns BRAND_NAME or brand, and MANUFACTURER_NAME or manufacturer; then the entries of known
    that it lacks. A registration sign in a name becomes its symbol."""
    by = {c.strip().lower(): F.trim(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))) for c in rows.columns}
    pick = lambda *names: F.coalesce(*[F.when(by[n] != "", by[n]) for n in names if n in by], F.lit(""))
    brand, manufacturer = pick("brand_name", "brand"), pick("manufacturer_name", "manufacturer")
    name = F.when(brand != "", brand).otherwise(manufacturer)
    listed = rows.select(name.alias("name"), manufacturer.alias("manufacturer"), F.monotonically_increasing_id().alias("at")).filter("name <> ''")
    none = F.array().cast("array<string>")
    out = listed.select(F.trim(F.regexp_replace("name", "[®™]", "")).alias("brand"), "manufacturer", F.regexp_extract("name", "([®™])", 1).alias("symbol"), none.alias("aliases"), none.alias("prefixes"), "at", F.lit(0).alias("part"))
    if known is not None:
        out = out.unionByName(known.select("brand", "manufacturer", "symbol", "aliases", "prefixes", F.col("seq").cast("long").alias("at"), F.lit(1).alias("part")))
    key = (norm(F.col("brand")), norm(F.col("manufacturer")))
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy(*key).orderBy("part", "at"))
    order = F.row_number().over(Window.orderBy("part", "at")).cast("int")  # a registry is a dimension
    return out.withColumn("_k", first).filter("_k = 1").withColumn("seq", order).select("brand", "manufacturer", "symbol", "aliases", "prefixes", "seq")


def taught(registry: DataFrame, corrections: DataFrame) -> DataFrame:
    """registry with the aliases that reviewers taught: corrections of scope brand, whose target is a supplier's name and value a brand."""
    said = corrections.filter("scope = 'brand'").select(F.lower(F.trim("target")).alias("supplier"), F.col("value").alias("name"))
    known = by_name(said, "name", registry).filter("entry IS NOT NULL").groupBy(F.col("entry.seq").alias("_seq")).agg(F.collect_set("supplier").alias("_more"))
    out = registry.join(known, registry["seq"] == known["_seq"], "left")
    return out.select("brand", "manufacturer", "symbol", F.array_union("aliases", F.coalesce("_more", F.array().cast("array<string>"))).alias("aliases"), "prefixes", "seq")


def _index(registry: DataFrame, fold, names: Column, name: str) -> DataFrame:  # noqa: ANN001
    entry = F.struct("brand", "manufacturer", "symbol", "seq")
    found = registry.select(F.explode(names).alias("_n"), entry.alias("e"))
    return found.select(fold(F.col("_n")).alias(f"_{name}"), "e").filter(F.length(f"_{name}") >= (2 if name == "core" else 1)).groupBy(f"_{name}").agg(F.min_by("e", "e.seq").alias(f"_{name}_entry"))


def by_name(rows: DataFrame, name: str, registry: DataFrame) -> DataFrame:
    """rows with entry: the one with that name, manufacturer or alias, else with that core; null if there is none."""
    a = _index(registry, norm, F.concat(F.array("brand", "manufacturer"), "aliases"), "norm")
    c = _index(registry, core, F.concat(F.array("brand"), "aliases"), "core")
    out = rows.join(small(a), norm(F.col(name)) == F.col("_norm"), "left").join(small(c), core(F.col(name)) == F.col("_core"), "left")
    return out.withColumn("entry", F.coalesce("_norm_entry", "_core_entry")).drop("_norm", "_norm_entry", "_core", "_core_entry")


def by_alias(rows: DataFrame, name: str, registry: DataFrame) -> DataFrame:
    """rows with brand. registry here: alias, brand, seq, a row for each alias."""
    none = F.array().cast("array<string>")
    entries = registry.select("brand", F.lit("").alias("manufacturer"), F.lit("").alias("symbol"), F.array("alias").alias("aliases"), none.alias("prefixes"), "seq")
    return by_name(rows, name, entries).withColumn("brand", F.col("entry.brand")).drop("entry")


def by_prefix(rows: DataFrame, code: str | Column, prefixes: list[tuple[str, str]]) -> Column:
    """The brand of the longest prefix of a code that is longer than the prefix. prefixes: a literal list, so this is one CASE."""
    out = F.lit(None).cast("string")
    for prefix, brand in sorted(prefixes, key=lambda p: (len(p[0]), p[0])):
        out = F.when(F.upper(code).startswith(prefix.upper()) & (F.length(code) > len(prefix)), F.lit(brand)).otherwise(out)
    return out


def mention(name: str) -> str:
    """Pattern of a name as a word of its own, not beside words that make it an everyday one."""
    plain = rf"(?<![A-Za-z0-9])\Q{name}\E(?![A-Za-z0-9])"
    beside = "|".join(NOT_BESIDE.get(name.lower(), ()))
    return rf"(?<!\b(?:{beside})\W{{0,8}}){plain}(?!\W{{0,8}}(?:{beside})\b)" if beside else plain


def mentioned(text: Column, names: list[str]) -> Column:
    """The longest of the names found as whole words in a text; of equally long ones, the first of the list."""
    if not names:
        return F.lit(None).cast("string")
    order = sorted(names, key=len, reverse=True)
    out = F.when(text.rlike("(?i)" + mention(order[0])), F.lit(order[0]))
    for name in order[1:]:
        out = out.when(text.rlike("(?i)" + mention(name)), F.lit(name))
    # most texts name none: one look at all names first
    return F.when(text.rlike("(?i)(?:" + "|".join(rf"\Q{n}\E" for n in order) + ")"), out)


def similar(rows: DataFrame, name: str, names: list[str], cutoff: float = 0.86) -> DataFrame:
    """rows with nearest and ratio: the name of the list with the largest matching-blocks ratio of at least cutoff.

    Only distinct values are compared; no built-in function has this ratio, so they go through Arrow batches."""

    @F.pandas_udf("nearest string, ratio double")
    def best(s: pd.Series) -> pd.DataFrame:
        import difflib as d

        out = []
        for x in s:
            low = (x or "").lower()
            near = d.get_close_matches(low, [n.lower() for n in names], n=1, cutoff=cutoff)
            at = [n.lower() for n in names].index(near[0]) if near else -1
            out.append((names[at], d.SequenceMatcher(None, low, near[0]).ratio()) if near else (None, None))
        return pd.DataFrame(out, columns=["nearest", "ratio"])

    distinct = rows.select(F.col(name).alias("_name")).distinct().select("_name", best("_name").alias("_best"))
    return rows.join(distinct, F.col(name).eqNullSafe(F.col("_name")), "left").select(*rows.columns, "_best.nearest", "_best.ratio")


def ratio(a: str, b: str) -> float:
    return difflib.SequenceMatcher(None, a, b).ratio()


def looked_up(names: DataFrame, registry: DataFrame, cutoff: float = 0.80) -> DataFrame:
    """name, entry and ratio for each of names: 1 by name or core, else that of the most similar core of three characters or more."""
    found = by_name(names.select("name"), "name", registry)
    cores = _index(registry, core, F.concat(F.array("brand"), "aliases"), "core")
    keys = [r["_core"] for r in cores.select("_core").limit(BROADCAST_ROWS + 1).collect()]
    if len(keys) > BROADCAST_ROWS:
        raise ValueError(f"a registry of more than {BROADCAST_ROWS} names can't be searched for similar ones")
    open_ones = found.filter("entry IS NULL").withColumn("_c", core(F.col("name"))).filter(F.length("_c") >= 3)
    near = similar(open_ones, "_c", sorted(keys), cutoff).filter("nearest IS NOT NULL").select(F.col("name").alias("_name"), "nearest", F.col("ratio").alias("_ratio"))
    near = near.join(small(cores), near["nearest"] == cores["_core"]).select("_name", F.col("_core_entry").alias("_near"), "_ratio")
    out = found.join(near, found["name"] == near["_name"], "left")
    return out.select("name", F.coalesce("entry", "_near").alias("entry"), F.when(F.col("entry").isNotNull(), 1.0).otherwise(F.col("_ratio")).alias("ratio"))


def supplier_name(name: Column) -> Column:
    """A supplier's name fit to print: without its code."""
    plain = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(name, F.lit("")), r"\s*\([A-Za-z0-9]{3,6}\)\s*$", "")), r"^[ ,-]+|[ ,-]+$", "")
    plain = F.regexp_replace(F.regexp_replace(plain, r"\s{2,}", " "), r"\bU\s+S\b", "U.S.")
    return F.when(F.length(plain) >= 2, plain)


def resolved(*steps: tuple[str, Column, float]) -> Column:
    """The first step that names a brand: struct of brand, method and confidence."""
    return F.coalesce(*[F.when(brand.isNotNull(), F.struct(brand.alias("brand"), F.lit(method).alias("method"), F.lit(confidence).alias("confidence"))) for method, brand, confidence in steps])


IDENTITY = "brand string, name string, manufacturer string, method string, confidence double, evidence string, source string, unverified boolean, reseller boolean, seq int"


def identified(rows: DataFrame, registry: DataFrame) -> DataFrame:
    """rows (row_id, text, mpn, manufacturer, brand_dib, brand_e1) with identity (IDENTITY), null if nothing names the maker.

    Brand columns come first, then a mention in the text, the supplier unless it is a reseller, the part number's prefix, at last the
    supplier's name as it is. Where a reseller is all there is, the method is abstain."""
    columns = ("brand_dib", "brand_e1", "manufacturer")
    names = rows.select(F.explode(F.array(*columns)).alias("name")).filter("name <> ''").distinct()
    found = small(looked_up(names, registry))
    out = rows
    for c in columns:
        one = found.select(F.col("name").alias(f"_n_{c}"), F.struct("entry", "ratio").alias(f"_f_{c}"))
        out = out.join(one, F.col(c) == F.col(f"_n_{c}"), "left").drop(f"_n_{c}")
    entries = registry.orderBy("seq").limit(BROADCAST_ROWS).collect()  # a dimension, as literals
    said = [(n, e) for e in entries for n in [e["brand"], *e["aliases"]] if n and len(n) >= 2]
    first: dict[str, dict] = {}
    for n, e in said:
        first.setdefault(n, e)
    text = mentioned(F.coalesce("text", F.lit("")), list(first))
    starts = [(p, str(e["seq"])) for e in reversed(entries) for p in e["prefixes"] if p]
    prefix = by_prefix(out, F.upper(F.trim(F.coalesce("mpn", F.lit("")))), starts)
    literal = {str(e["seq"]): e for e in entries}
    as_entry = lambda e: F.struct(F.lit(e["brand"]).alias("brand"), F.lit(e["manufacturer"]).alias("manufacturer"), F.lit(e["symbol"]).alias("symbol"), F.lit(e["seq"]).alias("seq"))
    by_text = F.element_at(F.create_map(*[x for n, e in first.items() for x in (F.lit(n), as_entry(e))]), text) if first else F.lit(None)
    by_start = F.element_at(F.create_map(*[x for k, e in literal.items() for x in (F.lit(k), as_entry(e))]), prefix) if starts else F.lit(None)
    reseller = is_reseller(F.col("manufacturer"))
    blank = lambda c: F.coalesce(F.col(c), F.lit("")) == ""

    def of(entry: Column, method: str, confidence: Column, evidence: Column, source: str) -> Column:
        name = entry["brand"]
        maker = F.when(F.coalesce(entry["manufacturer"], F.lit("")) != "", entry["manufacturer"]).otherwise(name)
        values = (F.concat(name, F.coalesce(entry["symbol"], F.lit(""))), name, maker, F.lit(method), F.least(F.lit(0.97), confidence), evidence, F.lit(source), F.lit(False), reseller, entry["seq"])
        return F.struct(*[v.alias(n.split()[0]) for v, n in zip(values, IDENTITY.split(", "), strict=True)])

    def as_is(name: Column, confidence: float, evidence: Column, source: str) -> Column:
        values = (name, name, name, F.lit("input"), F.lit(confidence), evidence, F.lit(source), F.lit(True), reseller, F.lit(None).cast("int"))
        return F.struct(*[v.alias(n.split()[0]) for v, n in zip(values, IDENTITY.split(", "), strict=True)])

    out = out.withColumn("_text", by_text).withColumn("_start", by_start).withColumn("_said", text)
    steps: list[tuple[Column, Column]] = []
    for c, confidence, source in (("brand_dib", 0.95, "input:DIB_Brand"), ("brand_e1", 0.93, "input:E1_Brand")):
        hit, sure = F.col(f"_f_{c}.entry"), F.col(f"_f_{c}.ratio")
        steps.append((hit.isNotNull() & ((sure == 1.0) | (sure >= 0.86)), of(hit, "registry", confidence * sure, F.col(c), source)))
        steps.append((~blank(c), as_is(F.col(c), 0.70, F.col(c), source)))
    hit, sure = F.col("_f_manufacturer.entry"), F.col("_f_manufacturer.ratio")
    supplied = ~blank("manufacturer") & ~reseller
    if first:
        steps.append((F.col("_text").isNotNull(), of(F.col("_text"), "registry", F.lit(0.88), F.col("_said"), "input:Part_Desc")))
    steps.append((supplied & (sure == 1.0), of(hit, "registry", F.lit(0.90), F.col("manufacturer"), "input:Part_Manuf")))
    steps.append((supplied & (sure >= 0.86), of(hit, "registry", 0.82 * sure, F.col("manufacturer"), "input:Part_Manuf")))
    if starts:
        steps.append((F.col("_start").isNotNull(), of(F.col("_start"), "rule", F.lit(0.80), F.col("mpn"), "input:Mfg_Part_Num")))
    none = F.lit(None).cast("string")
    abstained = F.struct(*[v.alias(n.split()[0]) for v, n in zip((none, none, none, F.lit("abstain"), F.lit(0.0), F.col("manufacturer"), F.lit("input:Part_Manuf"), F.lit(False), F.lit(True), F.lit(None).cast("int")), IDENTITY.split(", "), strict=True)])
    steps.append((~blank("manufacturer") & reseller, abstained))
    steps.append((supplier_name(F.col("manufacturer")).isNotNull(), as_is(supplier_name(F.col("manufacturer")), 0.58, F.col("manufacturer"), "input:Part_Manuf")))
    identity = None
    for condition, value in steps:
        identity = F.when(condition, value) if identity is None else identity.when(condition, value)
    kept = [*rows.columns, "_f_manufacturer"]
    out = out.withColumn("identity", identity).select(*kept, "identity")
    return out.withColumn("supplier_entry", F.col("_f_manufacturer.entry")).drop("_f_manufacturer")


def mismatches(rows: DataFrame, spark: SparkSession | None = None) -> DataFrame:
    """row_id, supplied, supplied_brand, resolved, brand, similarity: rows of identified() whose supplier is another maker in the registry
    than the brand's. Lines of one maker, and brands whose names are much alike, are no contradiction."""
    from_registry = rows.filter("identity.seq IS NOT NULL AND NOT identity.reseller AND supplier_entry IS NOT NULL AND manufacturer <> ''").select("row_id", F.col("manufacturer").alias("supplied"), "identity", "supplier_entry")
    maker = lambda e: F.when(F.coalesce(e["manufacturer"], F.lit("")) != "", e["manufacturer"]).otherwise(e["brand"])
    other = from_registry.filter((F.col("supplier_entry.seq") != F.col("identity.seq")) & (core(maker(F.col("supplier_entry"))) != core(F.col("identity.manufacturer"))))
    pairs = other.select(core(F.col("supplier_entry.brand")).alias("_a"), core(F.col("identity.name")).alias("_b")).distinct()

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        import difflib as d

        return pd.Series([d.SequenceMatcher(None, x, y).ratio() for x, y in zip(a, b, strict=True)], dtype=float)

    judged = pairs.select("_a", "_b", alike("_a", "_b").alias("similarity"))
    out = other.join(judged, (core(F.col("supplier_entry.brand")) == F.col("_a")) & (core(F.col("identity.name")) == F.col("_b"))).filter("similarity < 0.85")
    return out.select("row_id", F.trim("supplied").alias("supplied"), F.col("supplier_entry.brand").alias("supplied_brand"), F.col("identity.manufacturer").alias("resolved"), F.col("identity.brand").alias("brand"), F.round("similarity", 2).alias("similarity"))


def plain(name: str) -> str:
    """norm, on the driver."""
    s = re.sub(r"\s*\([A-Za-z0-9]{3,6}\)\s*$", "", (name or "").lower())
    return re.sub(r"\s+", " ", re.sub(r"[^a-z0-9&+ ]+", " ", s)).strip()

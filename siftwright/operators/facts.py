"""Facts: one claim about a row's attribute, with its evidence; and the algebra that merges claims.

A fact row has row_id, key, value, uom, method, confidence, priority, seq (order of arrival) and evidence (array of strings).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions import scalars
from siftwright.functions.scalars import literal_map

# Confidence that a method has by itself, which methods count as one independent source, and the constants of the merge.
PRIORS = {"input": 0.99, "registry": 0.94, "rule": 0.92, "document": 0.88, "family": 0.78, "llm": 0.70, "inferred": 0.62}
SOURCE_OF = {"input": "source", "registry": "master", "rule": "pattern", "document": "source", "family": "consensus", "llm": "model", "inferred": "pattern"}
GAIN, CEILING, LOSS, FLOOR = 0.55, 0.995, 0.65, 0.05
CONFIRMED, REJECTED = 0.5, 0.45
# Keys and methods that aren't worth a second opinion.
NOT_AUDITED, TRUSTED = ("mpn", "dept", "class", "fine", "classpath", "unspsc", "selling_uom", "display_only"), ("input", "correction")


def source(method: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(SOURCE_OF), method), method)


def prior(method: Column) -> Column:
    return F.coalesce(F.element_at(literal_map(PRIORS), method), F.lit(0.6))


def confident(facts: DataFrame, threshold: float) -> DataFrame:
    """Facts of at least that confidence."""
    return facts.filter(F.col("confidence") >= threshold)


def conflicted(facts: DataFrame) -> DataFrame:
    """Merged facts that another claim contradicts."""
    return facts.filter(F.size("conflicts") > 0)


def auditable(facts: DataFrame, rules: bool = True) -> DataFrame:
    """Facts worth a second opinion: not copied, not decided by a person, not structural; with rules False, none that a pattern found."""
    out = facts.filter(~F.col("key").isin(*NOT_AUDITED) & ~F.col("method").isin(*TRUSTED) & (F.trim(F.coalesce("value", F.lit(""))) != ""))
    return out if rules else out.filter("method <> 'rule'")


def keyed(facts: DataFrame) -> DataFrame:
    """row_id and fact, a map from key to struct(value, uom, display, method, confidence), for access by key."""
    entry = F.struct("key", F.struct("value", F.coalesce("uom", F.lit("")).alias("uom"), scalars.display(F.col("value"), F.coalesce("uom", F.lit(""))).alias("display"), "method", "confidence").alias("fact"))
    return facts.groupBy("row_id").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("fact"))


def unpivoted(df: DataFrame, row_id: str, columns: dict[str, str], method: str, confidence: float) -> DataFrame:
    """A fact for each named column of each row. columns: column to key."""
    items = [F.struct(F.lit(k).alias("key"), F.col(c).cast("string").alias("value"), F.lit(i).alias("priority")) for i, (c, k) in enumerate(columns.items())]
    out = df.select(F.col(row_id).alias("row_id"), F.inline(F.array(*items)))
    return out.withColumn("method", F.lit(method)).withColumn("confidence", F.lit(confidence))


def admitted(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Facts that have a value and evidence; and the rejected ones, which have a value but none."""
    valued = facts.filter(F.trim(F.coalesce("value", F.lit(""))) != "")
    backed = F.exists(F.coalesce(F.col("evidence"), F.array().cast("array<string>")), lambda e: F.trim(e) != "")
    return valued.filter(F.coalesce(backed, F.lit(False))), valued.filter(~F.coalesce(backed, F.lit(False)))


def merged(facts: DataFrame) -> DataFrame:
    """One fact for each row and key, folding claims in order of seq.

    A claim with the same value from a new source closes part of the gap to certainty; from a known source the higher confidence stays.
    A claim with another value takes over only if it is strictly more confident; whichever stays loses some confidence. Claims of one
    row and key are few; they are gathered in one array and folded there."""
    claim = F.struct("seq", F.col("value").alias("value"), scalars.value_key(F.col("value")).alias("folded"), F.coalesce("uom", F.lit("")).alias("uom"), "method", source(F.col("method")).alias("source"), F.col("confidence").cast("double").alias("confidence"))
    claims = facts.groupBy("row_id", "key").agg(F.array_sort(F.collect_list(claim)).alias("claims"))
    c0 = F.col("claims")[0]
    zero = F.struct(c0["value"].alias("value"), c0["folded"].alias("folded"), c0["uom"].alias("uom"), c0["method"].alias("method"), c0["confidence"].alias("confidence"), F.array(c0["source"]).alias("sources"), F.array().cast("array<string>").alias("conflicts"))

    def step(a: Column, x: Column) -> Column:
        agrees, new = a["folded"] == x["folded"], ~F.array_contains(a["sources"], x["source"])
        takes = ~agrees & (x["confidence"] > a["confidence"])
        risen = F.when(new, F.least(F.lit(CEILING), a["confidence"] + (1 - a["confidence"]) * GAIN)).otherwise(F.greatest(a["confidence"], x["confidence"]))
        pick = lambda f: F.when(takes, x[f]).otherwise(a[f])
        return F.struct(
            pick("value").alias("value"),
            pick("folded").alias("folded"),
            F.when(agrees & (a["uom"] == ""), x["uom"]).otherwise(pick("uom")).alias("uom"),
            F.when(agrees & (x["method"] == "input"), x["method"]).otherwise(pick("method")).alias("method"),
            F.when(agrees, risen).otherwise(F.greatest(F.lit(FLOOR), F.greatest(a["confidence"], x["confidence"]) * LOSS)).alias("confidence"),
            F.when(agrees, F.array_union(a["sources"], F.array(x["source"]))).when(takes, F.array(x["source"])).otherwise(a["sources"]).alias("sources"),
            F.when(agrees, a["conflicts"]).otherwise(F.array_append(a["conflicts"], F.when(takes, a["value"]).otherwise(x["value"]))).alias("conflicts"),
        )

    fold = F.aggregate(F.slice("claims", 2, 1 << 30), zero, step)
    return claims.select("row_id", "key", F.size("claims").alias("n_claims"), fold.alias("f")).select("row_id", "key", "f.value", "f.uom", "f.method", "f.confidence", "f.sources", "f.conflicts", "n_claims")


def judged(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """facts with confidence after an auditor's verdicts (row_id, key, verdict): support closes half the gap to certainty, .99 at most; doubt
    leaves 45 %. No verdict makes a fact."""
    v = verdicts.dropDuplicates(["row_id", "key"]).select("row_id", "key", "verdict")
    c = F.col("confidence")
    risen = F.least(F.lit(0.99), c + (1 - c) * CONFIRMED)
    changed = F.when(F.col("verdict") == "supported", risen).when(F.col("verdict") == "unsupported", F.greatest(F.lit(FLOOR), c * REJECTED)).otherwise(c)
    return facts.join(v, ["row_id", "key"], "left").withColumn("confidence", changed)


def disagreements(facts: DataFrame, verdicts: DataFrame) -> DataFrame:
    """row_id, kind, message, severity, key: notes for facts that an auditor found no support for."""
    v = verdicts.filter("verdict = 'unsupported'").dropDuplicates(["row_id", "key"])
    reason = F.coalesce(F.col("reason"), F.lit("")) if "reason" in verdicts.columns else F.lit("")
    hit = facts.join(v.select("row_id", "key", reason.alias("reason")), ["row_id", "key"])
    return hit.select("row_id", F.lit("audit_disagreement").alias("kind"), F.trim(F.concat("key", F.lit(" = "), "value", F.lit(" has no support in the text. "), "reason")).alias("message"), F.lit("review").alias("severity"), "key")


def noted(notes: DataFrame, more: DataFrame) -> DataFrame:
    """notes with more appended; a table of observations only ever grows."""
    return notes.unionByName(more, allowMissingColumns=True)


def grounded(proposals: DataFrame, text: str = "text", quote: str = "quote") -> DataFrame:
    """Proposals whose quote is found in the text or in the text with its abbreviations written out, whatever its case. A blank quote grounds nothing."""
    q = F.lower(F.trim(F.coalesce(quote, F.lit(""))))
    return proposals.filter((q != "") & (F.contains(F.lower(text), q) | F.contains(F.lower(scalars.expand(F.col(text))), q)))


def row_scores(facts: DataFrame) -> DataFrame:
    return facts.groupBy("row_id").agg(F.avg("confidence").alias("score"), F.count(F.lit(1)).alias("n_facts"))


def fingerprint(facts: DataFrame) -> DataFrame:
    """A short digest of each row's keys and folded values, whatever their order: of the JSON list of the pairs."""
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("key", scalars.value_key(F.col("value")).alias("v")))), lambda p: F.concat(F.lit('["'), p["key"], F.lit('", "'), p["v"], F.lit('"]')))
    return facts.groupBy("row_id").agg(F.substring(F.sha1(F.concat(F.lit("["), F.array_join(pairs, ", "), F.lit("]")).cast("binary")), 1, 12).alias("fingerprint"))

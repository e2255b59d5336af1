"""Mixing sources to target weights by capped water-filling.

Every source has a weight and a capacity, ``max_epochs`` times its size. Targets are ``min(capacity, level * weight)``, the level
such that they sum to the budget: this is where clamping sources at their capacity and handing the excess to the others by weight
ends. Sorted by capacity over weight, the full sources come first, so one running sum finds the level.

A source's epochs are target over size. Each document is taken as often as the whole part says. For the fractional part, documents
are ordered by a seeded hash, in ``BUCKETS`` steps: those before the step where the share is reached are taken once more, those
in that step are taken in part, later ones not at all.

Defined cases: null text has size 0; a null source is a source of its own and comes last; sources of size 0 have target 0, and
their documents take 0; repeated rows count as rows, and rows of one id are taken alike; an empty table gives an empty result.
Only doc_id, source and text are read; columns added on the way begin with _mix_. Words are runs of anything but U+0020 and U+0009 to U+000D.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm.common import WORD, WS, stored

BUCKETS = 1024
WEIGHTS = (5, 2, 1)
#: Up to this many rows the table of sources is broadcast (about 100 bytes a row).
BROADCAST_SOURCES = 20_000


def water_fill(sources: DataFrame, budget: Column, max_epochs: float, by: list[str]) -> DataFrame:
    """Adds target to (source_size, weight, ...), one row for each source. by: columns that break ties, for a stable order.

    The running sums see one row for each source, never documents."""
    t = sources.withColumn("_cap", F.col("source_size") * F.lit(float(max_epochs)))
    w = Window.orderBy(F.col("_cap") / F.col("weight"), *[F.col(c).asc_nulls_last() for c in by])
    over = w.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    t = t.withColumn("_before", F.coalesce(F.sum("_cap").over(over), F.lit(0.0))).withColumn("_left", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(over), F.lit(0)))
    t = t.withColumn("_budget", F.least(budget, F.sum("_cap").over(everything)))
    # level if all sources before this one are full and this and later ones are not
    t = t.withColumn("_level", (F.col("_budget") - F.col("_before")) / F.col("_left"))
    open_ = F.col("_level") * F.col("weight") < F.col("_cap")
    t = t.withColumn("_final", F.min(F.when(open_, F.struct(F.col("_cap") / F.col("weight"), "_level"))).over(everything)["_level"])
    target = F.when(F.col("_final").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_final") * F.col("weight")))
    return t.withColumn("target", target.cast("double")).drop("_cap", "_before", "_left", "_budget", "_level", "_final")


def bucket(seed: int) -> Column:
    """Step of a document, from md5 of seed and id; SQL engines agree on it."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % BUCKETS).cast("int")


def _sized(docs: DataFrame, seed: int) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.withColumn("_mix_size", size).withColumn("_mix_step", bucket(seed))


def _plan(rows: DataFrame, share: float, max_epochs: float, weights: tuple[int, ...]) -> DataFrame:
    """For each source: source_size, target, repeats, and the step and part of it at which its fractional share ends. rows: source, _size, _step."""
    steps = stored(rows.groupBy("source", "_mix_step").agg(F.sum("_mix_size").alias("step_size")))
    sources = steps.groupBy("source").agg(F.sum("step_size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (rank % len(weights) + 1).cast("int"))
    sources = sources.withColumn("weight", weight)
    budget = F.lit(share) * F.sum("source_size").over(Window.partitionBy(F.lit(1)))
    filled = water_fill(sources, budget, max_epochs, ["source"])
    filled = filled.withColumn("_epochs", F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(max_epochs)))).otherwise(0.0))
    filled = filled.withColumn("repeats", F.floor("_epochs").cast("long")).withColumn("_need", (F.col("_epochs") - F.floor("_epochs")) * F.col("source_size"))
    w = Window.partitionBy("source").orderBy("_mix_step").rowsBetween(Window.unboundedPreceding, -1)
    cut = steps.withColumn("_before", F.coalesce(F.sum("step_size").over(w), F.lit(0))).alias("s").join(filled.alias("f"), F.expr("s.source <=> f.source"))
    part = (F.col("_need") - F.col("_before")) / F.col("step_size")
    cut = cut.filter((F.col("step_size") > 0) & (part >= 0) & (part < 1)).select(F.col("f.source").alias("source"), F.col("_mix_step").alias("_mix_cut"), part.alias("_mix_part"))
    return stored(filled.alias("f").join(cut.alias("c"), F.expr("f.source <=> c.source"), "left").select(F.col("f.source").alias("_mix_source"), *(F.col(c).alias(f"_mix_{c}") for c in ("source_size", "target", "repeats")), "_mix_cut", "_mix_part"))


def _with_plan(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """rows with their source's plan and _extra, the words of one more, fractional repetition."""
    small = plan.count() <= BROADCAST_SOURCES
    extra = F.when(F.col("_mix_cut").isNull() | (F.col("_mix_step") > F.col("_mix_cut")), F.lit(0)).when(F.col("_mix_step") < F.col("_mix_cut"), F.col("_mix_size")).otherwise(F.floor(F.col("_mix_size") * F.col("_mix_part")))
    return rows.join(F.broadcast(plan) if small else plan, F.col("source").eqNullSafe(F.col("_mix_source")), "left").withColumn("_mix_extra", extra.cast("long"))


def mix(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """doc_id, source, size, source_size, target, repeats (whole), taken (words, repeats counted) for each row of docs."""
    rows = stored(_sized(docs.select("doc_id", "source", "text"), seed).drop("text"))
    joined = _with_plan(rows, _plan(rows, share, max_epochs, weights))
    return joined.select("doc_id", "source", F.col("_mix_size").alias("size"), *(F.col(f"_mix_{c}").alias(c) for c in ("source_size", "target", "repeats")), (F.col("_mix_repeats") * F.col("_mix_size") + F.col("_mix_extra")).alias("taken"))


def mixed(docs: DataFrame, share: float = 1.5, max_epochs: float = 2.0, weights: tuple[int, ...] = WEIGHTS, seed: int = 7) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each whole repetition, and one with the first words for a fractional one.

    Documents without words come once if their source is taken at all."""
    rows = _sized(docs, seed)
    joined = _with_plan(rows, _plan(rows.select("source", "_mix_size", "_mix_step"), share, max_epochs, weights))
    whole = (F.col("_mix_repeats") + F.when((F.col("_mix_extra") == F.col("_mix_size")) & ((F.col("_mix_size") > 0) | (F.col("_mix_repeats") == 0)), 1).otherwise(0)).cast("int")
    part = F.when((F.col("_mix_extra") > 0) & (F.col("_mix_extra") < F.col("_mix_size")), F.col("_mix_extra"))
    takes = F.concat(F.array_repeat(F.lit(None).cast("long"), whole), F.when(part.isNotNull(), F.array(part)).otherwise(F.array().cast("array<bigint>")))
    out = joined.withColumn("_mix_words", F.explode(takes))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(f"[{WS}]*{WORD}"), F.lit(0)), F.lit(1), F.col("_mix_words").cast("int")), "")
    out = out.withColumn("text", F.when(F.col("_mix_words").isNull(), F.col("text")).otherwise(first))
    return out.select(*docs.columns)

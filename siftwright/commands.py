"""Runs, scores, pack learning and corrections, as functions and as commands: python -m siftwright.commands run|eval|learn-spec|correct ..."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.functions import scalars
from siftwright.operators import corrections, delivery, edges, facts, packs, registry, review
from siftwright.plans.enrich import Config, Result, enrich
from siftwright.sources import tabular

#: Columns of labelled rows that the supplier gave.
GIVEN = ("Mfg_Part_Num", "Part_Desc", "E1_Brand", "ERP_Brand", "DIB_Brand", "Part_Manuf")
KEY = "Mfg_Part_Num"
REVIEW = ("row_id", "mpn", "status", "score", "family_id", "rule", "severity", "what", "family_rows", "review_value")
LEDGER = ("row_id", "column", "value", "method", "confidence", "rule_id", "detail")


def configured(spark: SparkSession, brands: str | None = None, pack_path: str | None = None, store: str | None = None, base: Config | None = None) -> Config:
    """A configuration with the registry of a master list, learned packs and stored corrections."""
    out = base or Config()
    if brands:
        out = replace(out, brands=registry.loaded(tabular.read_table(spark, brands), out.brands))
    if pack_path:
        out = replace(out, packs=packs.load(spark, pack_path))
    if store:
        out = replace(out, corrections=corrections.load(spark, store))
    return out


def bundle(result: Result) -> DataFrame:
    """Of each row what is needed to explain it, without its values: status, score, flags, violations, and method, confidence and rule of each cell."""
    cells = F.map_from_entries(F.transform("cells", lambda c: F.struct(c["column"], F.struct(c["method"].alias("m"), c["confidence"].alias("c"), F.nullif(c["rule_id"], F.lit("")).alias("r"), F.nullif(c["detail"], F.lit("")).alias("d")))))
    return result.checked.select("row_id", "status", "filled", F.round("score", 4).alias("score"), "family_id", "flags", "violations", F.col("budget").alias("invoice_budget"), cells.alias("prov"))


def run(spark: SparkSession, source: str, out: str, config: Config | None = None, limit: int | None = None, sheet: str | None = None) -> Result:
    """Enriches the table at source and writes all results under out: delivery, ledger, queue, relations, corrections as delimited text, report,
    facts and inspection bundle as JSON. limit: the feature is a trial on the first rows."""
    df = tabular.read_table(spark, source, sheet)
    if limit:
        df = df.orderBy("row_id").limit(limit)
    result = enrich(df, config)
    tabular.write_delimited(result.delivery.orderBy("row_id"), f"{out}/delivery.csv", result.delivery.columns[1:])
    tabular.write_delimited(result.provenance, f"{out}/audit_provenance.csv", list(LEDGER))
    tabular.write_delimited(result.review, f"{out}/review_queue.csv", list(REVIEW))
    tabular.write_delimited(result.edges, f"{out}/relationships.csv", list(edges.COLUMNS))
    if result.corrections is not None:
        tabular.write_delimited(result.corrections, f"{out}/corrections.csv", result.corrections.columns)
    for name, df in (("report", result.report), ("facts", result.facts), ("specs", result.specs), ("notes", result.notes), ("inspect", bundle(result))):
        tabular.write_json(df, f"{out}/{name}.json")
    return result


def reloaded(spark: SparkSession, out: str) -> dict[str, DataFrame]:
    """What run() wrote, by name; what is missing is left out."""
    from pyspark.errors import AnalysisException

    found = {}
    for name in ("delivery", "audit_provenance", "review_queue", "relationships", "corrections"):
        try:
            raw = spark.read.options(header=False, quote='"', escape='"', multiLine=True).csv(f"{out}/{name}.csv")
        except AnalysisException as missing:
            if missing.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        # the header is the first part alone
        part = F.col("_metadata.file_path")
        first = raw.agg(F.min(part)).first()[0]
        names = [str(v or "").lstrip("\ufeff") for v in raw.filter(part == first).first()]
        found[name] = raw.filter(part != first).toDF(*names).na.fill("")
    for name in ("report", "facts", "specs", "notes", "inspect"):
        try:
            found[name] = spark.read.json(f"{out}/{name}.json")
        except AnalysisException as missing:
            if missing.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
                raise
    return found


def evaluated(predicted: DataFrame, truth: DataFrame, columns: list[str] | None = None) -> dict[str, DataFrame]:
    """Scores of predicted delivery rows against labelled ones of the same part number: by field, over all, and lengths and vocabularies of what was predicted."""
    names = [c for c in columns or delivery.columns() if c in truth.columns and c in predicted.columns]
    trimmed = lambda df: df.withColumn(KEY, F.trim(F.col(KEY)))
    scores = review.field_scores(trimmed(predicted), trimmed(truth), KEY, names)
    limits = {r.column: r.most for r in delivery.rules() if r.most and r.column in predicted.columns}
    slots = packs.read_slots(predicted, KEY, "Classpath")
    return {"per_field": scores, "overall": review.overall(scores, delivery.RETRIEVED), "char_limits": review.length_report(predicted, limits), "labels": _labels(slots)}


def _labels(slots: DataFrame) -> DataFrame:
    from siftwright.operators import specs

    return specs.label_report(slots.filter("value <> ''"), "label", "value")


def evaluate(spark: SparkSession, truth: str, predicted: str | None = None, out: str | None = None, config: Config | None = None) -> dict[str, DataFrame]:
    """evaluated() for files; without predictions, the supplier's columns of the labelled rows are enriched first."""
    labelled = tabular.read_table(spark, truth)
    rows = tabular.read_table(spark, predicted) if predicted else enrich(_given(labelled), config).delivery
    found = evaluated(rows, labelled)
    if out:
        for name, df in found.items():
            tabular.write_json(df, f"{out}/{name}.json")
    return found


def _given(labelled: DataFrame) -> DataFrame:
    return review.inputs_of(labelled, ["row_id", *GIVEN])


def learn_spec(spark: SparkSession, truth: str, out: str, config: Config | None = None, source: str = "") -> DataFrame:
    """Packs from labelled rows, each slot aligned with the fact that says the same, saved at out."""
    labelled = tabular.read_table(spark, truth)
    said = enrich(_given(labelled), config).facts.select("row_id", "key", scalars.display(F.col("value"), F.coalesce("uom", F.lit(""))).alias("display"))
    found = packs.learned(packs.aligned(packs.read_slots(labelled, "row_id", "Classpath"), said), source or truth.rpartition("/")[2])
    packs.saved(found, out)
    return packs.load(spark, out)


def correct(spark: SparkSession, store: str, scope: str, target: str, key: str, value: str | None, uom: str = "", note: str = "", by: str = "reviewer") -> DataFrame:
    """Adds a correction to the store, or replaces the one of that scope, target and key; without a value it is removed."""
    if scope not in (*corrections.SCOPES, "brand"):
        raise ValueError(f"no scope {scope}")
    known = corrections.load(spark, store)
    one = spark.createDataFrame([(scope, target, key, value or "", uom, note, by)], "scope string, target string, key string, value string, uom string, note string, by string")
    one = one.withColumn("at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss")).withColumn("seq", F.lit((known.agg(F.max("seq")).first()[0] or 0) + 1).cast("long"))
    changed = corrections.deleted(known, one) if value is None else corrections.upserted(known, one)
    rows = changed.collect()  # a store is a dimension, and is read from where it is written to
    corrections.saved(spark.createDataFrame(rows, corrections.SCHEMA), store)
    return corrections.load(spark, store)


def relations(spark: SparkSession, out: str, relation: str | None = None) -> DataFrame:
    """The relations that run() wrote, all or of one kind."""
    return edges.of_relation(reloaded(spark, out)["relationships"], relation)


def confident(result: Result, threshold: float) -> DataFrame:
    return facts.confident(result.facts, threshold)


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="siftwright")
    sub = p.add_subparsers(dest="command", required=True)
    common = {"--brands": "master list of brands", "--packs": "learned packs", "--corrections": "store of corrections"}
    for name, named, flags in (("run", ("input",), ("--out",)), ("eval", ("truth",), ("--predicted", "--out")), ("learn-spec", ("truth",), ("--out",))):
        s = sub.add_parser(name)
        for n in named:
            s.add_argument(n)
        for f in flags:
            s.add_argument(f, required=f == "--out" and name != "eval")
        for f, what in common.items():
            s.add_argument(f, help=what)
        if name == "run":
            s.add_argument("--sheet")
            s.add_argument("--limit", type=int)
            s.add_argument("--images", action="store_true", help="add image names by convention")
    s = sub.add_parser("correct")
    for n in ("store", "scope", "target", "key"):
        s.add_argument(n)
    for f in ("--value", "--uom", "--note", "--by"):
        s.add_argument(f, default=None if f == "--value" else "reviewer" if f == "--by" else "")
    a = p.parse_args(argv)
    spark = SparkSession.builder.appName("siftwright").getOrCreate()
    if a.command == "correct":
        correct(spark, a.store, a.scope, a.target, a.key, a.value, a.uom, a.note, a.by).show(truncate=False)
        return 0
    config = configured(spark, a.brands, a.packs, a.corrections)
    if a.command == "run":
        run(spark, a.input, a.out, replace(config, images=a.images), a.limit, a.sheet).report.show(truncate=False, vertical=True)
    elif a.command == "eval":
        evaluate(spark, a.truth, a.predicted, a.out, config)["overall"].show()
    else:
        learn_spec(spark, a.truth, a.out, config).select("classpath", "rows", F.size("slots").alias("slots")).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())

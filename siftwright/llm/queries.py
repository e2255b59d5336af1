"""The registered queries of the training-data operators, opN_<name>, and their SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwright.llm import ann, bitplanes, langid, lm, mixing, neardup, packing, pii, quality, substrings
from siftwright.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op7_quality_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    policy = quality.POLICIES[2]
    base = sum(1 << quality.BITS[r] for r in quality.BASE_RULES)
    judged = quality.apply_policy(quality.ledger(table(spark, sf_dir, "documents")), policy)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (F.col("fail_bits").bitwiseAND(base) != 0).alias("base_failed"), "kept", "n_lines", "fail_bits")


ORACLES["op7_quality_ledger"] = r"""
WITH t AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT k, doc_id, t, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
p AS (SELECT k, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
v AS (SELECT k, i, x || ' ' || lead(x, 1) OVER o || ' ' || lead(x, 2) OVER o || ' ' || lead(x, 3) OVER o || ' ' || lead(x, 4) OVER o || ' ' || lead(x, 5) OVER o || ' ' || lead(x, 6) OVER o || ' ' || lead(x, 7) OVER o AS s FROM p WINDOW o AS (PARTITION BY k ORDER BY i)),
g AS (SELECT k, i, count(*) OVER (PARTITION BY k, s) AS n FROM v WHERE s IS NOT NULL),
r AS (SELECT k, count(DISTINCT j) AS n FROM (SELECT k, unnest(range(i, i + 8)) AS j FROM g WHERE n > 1) GROUP BY k),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(r.n, 0)::BIGINT AS n_repeat_words, len(l)::BIGINT AS n_lines FROM w LEFT JOIN r USING (k)),
b AS (SELECT *, (CASE WHEN n_words < 20 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 30 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > 3 * n_words THEN 4 ELSE 0 END
  + CASE WHEN 100 * n_dup_lines > 30 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars > 14 * n_words OR 2 * word_chars < 5 * n_words THEN 16 ELSE 0 END)::INT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, n_lines, fail_bits FROM b
"""


@query
def op10_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "repeats")


ORACLES["op10_mix_sources"] = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
  (('0x' || substr(md5('7:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT % 1024)::INT AS step FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2.0 * source_size AS cap, 1.5 * sum(source_size) OVER () AS budget FROM s),
l AS (SELECT *, (least(budget, sum(cap) OVER ()) - coalesce(sum(cap) OVER o, 0))::DOUBLE / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM w
  WINDOW o AS (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (SELECT arg_min(level, cap::DOUBLE / weight) FROM l WHERE level * weight < cap) AS final FROM l),
t AS (SELECT source, source_size, (CASE WHEN final IS NULL THEN cap ELSE least(cap, final * weight) END)::DOUBLE AS target FROM f),
e AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, 2.0) ELSE 0.0 END::DOUBLE AS epochs FROM t),
n AS (SELECT *, floor(epochs)::BIGINT AS repeats, (epochs - floor(epochs)) * source_size AS need FROM e),
b AS (SELECT source, step, sum(size) AS step_size, coalesce(sum(sum(size)) OVER (PARTITION BY source ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM d GROUP BY source, step),
c AS (SELECT b.source, step AS cut, (need - before) / step_size::DOUBLE AS part FROM b JOIN n ON b.source IS NOT DISTINCT FROM n.source WHERE step_size > 0 AND (need - before) / step_size::DOUBLE >= 0 AND (need - before) / step_size::DOUBLE < 1)
SELECT doc_id, size, source_size, target, (repeats * size + CASE WHEN cut IS NULL OR step > cut THEN 0 WHEN step < cut THEN size ELSE floor(size * part) END)::BIGINT AS taken, repeats
FROM d JOIN n ON d.source IS NOT DISTINCT FROM n.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source
"""


def _byte_bpe() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query
def op1_bit_plane_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.round_trip(table(spark, sf_dir, "documents"), _byte_bpe(), end_id=2)


@query
def op8_pack_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), _byte_bpe(), end_id=0, size=1024)


def fold(n: int) -> "F.Column":
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % n


@query
def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = langid.fit(docs.filter(fold(4) != 2))
    return langid.predict(docs, model, "doc_id", (fold(4) == 2).alias("held_out"))


@query
def op6_pii_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.detect(table(spark, sf_dir, "documents"))


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.join(table(spark, sf_dir, "documents"))


@query
def op2_adaptive_scan_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("id") % 50 == 0, k=5)


@query
def op3_log_bilinear_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(table(spark, sf_dir, "documents"), fold(5) == 1)


@query
def op5_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.removed(table(spark, sf_dir, "documents")).drop("kept")

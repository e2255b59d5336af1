"""Quality rules as a bitmask ledger.

Every rule is evaluated once for each document. The ledger holds its measurements and one integer of failure bits; policies are
versioned masks over those bits, so a new policy, or the effect of leaving a rule out, needs no second look at the texts.

Defined cases: a null text counts as an empty one; an empty text has no words, lines or windows, so every measurement is 0 and
``few_words`` fails. Rows are judged one by one, so repeated rows give repeated results and an empty table an empty ledger. Only
``id_col`` and ``text_col`` are read: further columns, whatever their names, do no harm. A null id is passed on.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm.common import WORD, WS, WS_CHARS

WINDOW = 8

#: Bit of each rule. Bits are never reused: a policy of an older version keeps its meaning.
BITS = {"few_words": 0, "repeated_words": 1, "symbols": 2, "repeated_lines": 3, "word_length": 4}
BASE_RULES = ("few_words", "repeated_words")


@dataclass(frozen=True)
class Policy:
    """A document is kept if it fails none of the rules."""

    version: int
    rules: tuple[str, ...]

    @property
    def mask(self) -> int:
        return sum(1 << BITS[r] for r in self.rules)


POLICIES = {
    1: Policy(1, BASE_RULES),
    2: Policy(2, ("few_words", "repeated_words", "symbols", "repeated_lines", "word_length")),
}


def _covered(hashes: Column) -> Column:
    """Words in windows whose hash is found twice or more. Sorting (hash, position) brings equal windows together, in n log n."""
    n = F.size(hashes)
    order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    same = lambda s, j, k: F.try_element_at(s, k + 1)["h"].eqNullSafe(F.try_element_at(s, j + 1)["h"])
    # let-binding: the sorted array is computed once and handed to the lambda
    at = F.flatten(F.transform(F.array(order), lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, j: F.struct(x["i"].alias("i"), ((j > 0) & same(s, j, F.greatest(j - 1, F.lit(0))) | (j < n - 1) & same(s, j, j + 1)).alias("twice"))), lambda x: x["twice"]), lambda x: x["i"]))))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("last"))
    return F.aggregate(at, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(WINDOW), i - a["last"])).cast("long").alias("n"), i.alias("last")), lambda a: a["n"])


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col with n_words, word_chars, n_symbols, n_lines, n_dup_lines and n_repeat_words of each row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    gone = lambda c, chars: F.length(F.translate(c, chars, ""))
    t = docs.select(F.col(id_col), text.alias("_t"))
    t = t.select(id_col, "_t", F.filter(F.split("_t", f"[{WS}]+"), lambda w: w != "").alias("_w"), F.filter(F.split("_t", "\n"), lambda x: x.rlike(WORD)).alias("_lines"))
    t = t.select(
        id_col,
        F.size("_w").cast("long").alias("n_words"),
        gone(F.col("_t"), WS_CHARS).cast("long").alias("word_chars"),
        (F.length("_t") - gone(F.col("_t"), "#*$%&|<>")).cast("long").alias("n_symbols"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.transform(F.col("_w"), lambda w: F.xxhash64(w)).alias("_h"),
    )
    windows = F.when(F.size("_h") >= WINDOW, F.transform(F.sequence(F.lit(1), F.size("_h") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("_h", i, WINDOW)))).otherwise(F.array().cast("array<bigint>"))
    t = t.withColumn("_h", windows)
    repeat = F.when(F.size(F.array_distinct("_h")) == F.size("_h"), F.lit(0).cast("long")).otherwise(_covered(F.col("_h")))
    return t.withColumn("n_repeat_words", repeat).drop("_h")


def ledger(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The measurements, with failure bits in fail_bits (see BITS)."""
    n = F.col("n_words")
    fails = {
        "few_words": n < 20,
        "repeated_words": 100 * F.col("n_repeat_words") > 30 * n,
        "symbols": 10 * F.col("n_symbols") > 3 * n,
        "repeated_lines": 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
        "word_length": (F.col("word_chars") > 14 * n) | (2 * F.col("word_chars") < 5 * n),
    }
    bits = sum((F.when(fails[r], F.lit(1 << b)).otherwise(F.lit(0)) for r, b in BITS.items()), F.lit(0))
    return measured(docs, id_col, text_col).withColumn("fail_bits", bits.cast("int"))


def apply_policy(entries: DataFrame, policy: Policy) -> DataFrame:
    """Adds kept and policy_version to a ledger."""
    return entries.withColumn("kept", F.col("fail_bits").bitwiseAND(policy.mask) == 0).withColumn("policy_version", F.lit(policy.version))


def ablations(entries: DataFrame, policy: Policy) -> DataFrame:
    """One row for each rule of the policy: documents that fail it, that fail it alone (kept without it), and kept if only it applied.

    Rows are first counted by bit pattern, of which there are 2 to the number of rules at most; what follows handles only patterns."""
    m = F.col("fail_bits").bitwiseAND(policy.mask)
    patterns = entries.groupBy(m.alias("bits")).agg(F.count(F.lit(1)).alias("n"))
    rules = F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << BITS[r]).alias("bit")) for r in policy.rules]))
    hit = F.col("bits").bitwiseAND(F.col("r.bit")) != 0
    return patterns.select("bits", "n", rules.alias("r")).groupBy(F.col("r.rule").alias("rule")).agg(
        F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("bits") == F.col("r.bit"), F.col("n"))), F.lit(0)).alias("failed_alone"),
        F.coalesce(F.sum(F.when(~hit, F.col("n"))), F.lit(0)).alias("kept_alone"),
        F.bit_or(F.when(hit, F.col("bits"))).alias("failed_with_bits"),
    )

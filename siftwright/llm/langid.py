"""Language identification with a bit-sliced Bloom filter of character n-grams.

The filter is one table of masks, in slices of eight languages: an n-gram sets its language's bit in ``HASHES`` rows, and the AND of
those rows is the mask of all languages that have the n-gram. A text's n-grams are looked up at once; a histogram of the masks gives
every language's popcount. A popcount of h among n grams contains false positives at the language's known rate f, the fill of its
bits to the power of HASHES, so (h - n f) / (1 - f) estimates the grams truly known; the language with the most of them wins.

The filter is fitted on at most ``per_language`` labelled documents of each language (those with the least hash of their id), of the
``most_languages`` languages with the most documents. An n-gram counts for a language if it makes up ``LEAST_SHARE`` of the sample's,
and is at least a third as frequent there as in any other language. Masks are put together by aggregation; the driver receives the
filter's rows, whose number does not depend on the corpus. Predictions see nothing but the text, and all of it.

Defined cases: null text and text without a letter give "und" with score 0; documents without a language don't teach; without any
labelled document all is "und"; ties go to the language that sorts first; repeated rows repeat; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm.common import ship, stored, text_or_empty

UNKNOWN = "und"
ORDERS = (2, 3, 4)
HASHES = 2
#: Least share of an n-gram among those of its language's sample.
LEAST_SHARE = 1e-6
SPACE = 0x20
AT_A_TIME = 500_000


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point whether it is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the lower-cased texts, each within spaces, all else than letters a space; and the lengths."""
    low = [f" {t.lower()} " for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(_letters()[codes], codes, SPACE), np.fromiter(map(len, low), np.int64, len(low))


def _grams(codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order, the places of its n-grams and their hashes. A space stands at an n-gram's ends only."""
    space = codes == SPACE
    mixed = codes * np.uint32(0x9E3779B1)
    for n in ORDERS:
        if len(codes) < n:
            continue
        m = len(codes) - n + 1
        bad = space[:m] & space[n - 1 :] if n == 2 else np.zeros(m, bool)
        for i in range(1, n - 1):
            bad = bad | space[i : i + m]
        at = np.flatnonzero(~bad)
        h = np.full(len(at), n * 0x85EBCA6B & 0xFFFFFFFF, np.uint32)
        for i in range(n):
            h = (h ^ mixed[at + i]) * np.uint32(0xC2B2AE35)
            h ^= h >> np.uint32(15)
        yield at, h


def _rows(hashes: np.ndarray, bits: int) -> list[np.ndarray]:
    low = np.uint32((1 << bits) - 1)
    return [hashes & low, (hashes * np.uint32(0x27D4EB2F) ^ hashes >> np.uint32(16)) & low]


@dataclass
class Model:
    languages: list[str]
    masks: np.ndarray  # slices x rows, uint8
    bits: int

    @property
    def false_rates(self) -> np.ndarray:
        rates = [((self.masks[i // 8] >> (i % 8) & 1).mean()) ** HASHES for i in range(len(self.languages))]
        return np.array(rates)

    def known(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For each text and language the estimated number of n-grams known, and each text's number of n-grams."""
        codes, sizes = _codes(texts)
        doc = np.repeat(np.arange(len(texts)), sizes)
        slices = len(self.masks)
        histogram = np.zeros((slices, len(texts), 256), np.int64)
        for at, h in _grams(codes):
            rows, key = _rows(h, self.bits), doc[at] << 8
            for s in range(slices):
                mask = self.masks[s][rows[0]] & self.masks[s][rows[1]]
                histogram[s] += np.bincount(key | mask, minlength=len(texts) * 256).reshape(len(texts), 256)
        n = histogram[0].sum(axis=1) if slices else np.zeros(len(texts), np.int64)
        each = (np.arange(256)[:, None] >> np.arange(8) & 1).astype(np.int64)
        hits = np.concatenate([histogram[s] @ each for s in range(slices)], axis=1)[:, : len(self.languages)] if slices else np.zeros((len(texts), 0))
        f = self.false_rates
        return np.maximum((hits - n[:, None] * f) / np.maximum(1 - f, 1e-9), 0.0), n

    def predict(self, texts: list[str]) -> tuple[list[str], list[float], list[float]]:
        """Language, score and lead of each text."""
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts), [0.0] * len(texts)
        known, n = self.known(texts)
        best = known.argmax(axis=1)
        share = np.minimum(known / np.maximum(n, 1)[:, None], 1.0)
        score = share.max(axis=1)
        next_one = np.partition(share, -2, axis=1)[:, -2] if share.shape[1] > 1 else np.zeros(len(texts))
        return [self.languages[b] if k else UNKNOWN for b, k in zip(best, n, strict=True)], score.tolist(), (score - next_one).tolist()


def _in_parts(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= AT_A_TIME:
            yield part
            part, size = [], 0
    if part:
        yield part


def _sample(labelled: DataFrame, per_language: int, most_languages: int) -> DataFrame:
    """lang, text of the documents to learn from.

    Hashes of ids are counted in steps first, so that of a language only documents about as many as wanted are ranked."""
    steps = 4096
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "lang", "text").withColumn("_hash", F.xxhash64("doc_id"))
    step = F.pmod(F.shiftrightunsigned("_hash", 40), F.lit(steps))
    counts = rows.groupBy("lang", step.alias("_step")).agg(F.count(F.lit(1)).alias("n"))
    languages = counts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages).select("lang")
    before = Window.partitionBy("lang").orderBy("_step").rowsBetween(Window.unboundedPreceding, -1)
    reached = counts.join(F.broadcast(languages), "lang", "left_semi").withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # a row for each of most_languages
    last = reached.filter(F.col("_before") < per_language).groupBy(F.col("lang").alias("_lang")).agg(F.max("_step").alias("_last"))
    near = rows.join(F.broadcast(last), F.col("lang") == F.col("_lang")).filter(step <= F.col("_last"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(step, "_hash", "doc_id", F.xxhash64("text")))
    return near.withColumn("_k", rank).filter(F.col("_k") <= per_language).select("lang", "text")


def fit(labelled: DataFrame, per_language: int = 1000, most_languages: int = 256, bits: int = 20) -> Model:
    """labelled: doc_id, text, lang. The driver receives a row for each language, and at most 2 ** bits for each eight of them."""
    ship(labelled.sparkSession)
    sample = _sample(labelled, per_language, most_languages)

    schema = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                for part in _in_parts(texts):
                    codes, _ = _codes(part)
                    found = [h for _, h in _grams(codes)]
                    gram, n = np.unique(np.concatenate(found) if found else np.zeros(0, np.uint32), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.astype(np.int64)), pa.array(n)], schema=schema)

    counts = stored(sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("_all"))
    languages = sorted(r["lang"] for r in totals.select("lang").collect())
    masks = np.zeros(((len(languages) + 7) // 8, 1 << bits), np.uint8)
    if not languages:
        return Model(languages, masks, bits)
    numbers = labelled.sparkSession.createDataFrame(list(enumerate(languages)), "number int, _lang string")
    shares = counts.join(F.broadcast(totals), "lang").withColumn("p", F.col("n") / F.col("_all")).filter(F.col("p") >= LEAST_SHARE)
    most = F.max("p").over(Window.partitionBy("gram"))
    own = shares.withColumn("_most", most).filter(F.col("p") * 3 >= F.col("_most")).join(F.broadcast(numbers), F.col("lang") == F.col("_lang"))
    of_gram = own.select((F.col("number") / 8).cast("int").alias("slice"), "gram", F.expr("shiftleft(1, number % 8)").alias("mask")).groupBy("slice", "gram").agg(F.bit_or("mask").alias("mask"))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in _rows(b.column(1).to_numpy().astype(np.uint32), bits):
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(r.astype(np.int64)), b.column(2)], names=["slice", "row", "mask"])

    found = of_gram.mapInArrow(rows, "slice int, row long, mask int").groupBy("slice", "row").agg(F.bit_or("mask").cast("short").alias("mask")).toArrow()
    masks[found.column(0).to_numpy(), found.column(1).to_numpy()] = found.column(2).to_numpy().astype(np.uint8)
    return Model(languages, masks, bits)


def predict(docs: DataFrame, model: Model, *keep: str | Column, names: tuple[str, str, str] = ("lang_pred", "score", "lead")) -> DataFrame:
    """The columns keep of docs (doc_id if none are named), with the language, the share of n-grams that it knows, and how much more than the next one's that is."""
    ship(docs.sparkSession)
    columns = docs.select(*(keep or ["doc_id"]), text_or_empty().alias("_text"))
    kept = columns.schema[:-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found: tuple[list, ...] = ([], [], [])
            for part in _in_parts(b.column(b.num_columns - 1).to_pylist()):
                for all_of, some in zip(found, model.predict(part), strict=True):
                    all_of += some
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(found[0], pa.string()), *(pa.array(x, pa.float64()) for x in found[1:])], names=[*b.schema.names[:-1], *names])

    from pyspark.sql import types as T

    out = T.StructType([*kept, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType()), T.StructField(names[2], T.DoubleType())])
    return columns.mapInArrow(run, out)

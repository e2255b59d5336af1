"""Joining documents whose word n-gram sets have a Jaccard similarity of at least a threshold, by MinHash banding.

Documents with the same n-gram set are one class from the start; the least id stands for it. Representatives are hashed to bands of
MinHash values; bands and rows are chosen such that a pair at the threshold shares a band with the target probability, and pairs above
it more surely. Within each bucket, sketches (a byte of each MinHash value) tell which pairs can be similar at all: pairs whose
agreement is six standard errors below the threshold are not candidates, so documents that merely share a band do not chain groups
together. Each bucket gives links to the least document of each of its parts, as many rows at most as it has documents; connected
through these, candidates form groups. Groups are cut into blocks of ``BLOCK`` documents, and buckets into blocks of
``SKETCH_BLOCK`` sketches; every pair of blocks is a task of its own. A task of a group counts shared n-grams of all its pairs at
once from the full sets. It returns, for each document, its number of links and the least document it is connected to in the task;
pairs are never written out. Within a group of documents that are truly alike, every pair is counted: that is what n_links says.

N-grams are of words as they stand (runs of anything but U+0020 and U+0009 to U+000D), held as 64-bit hashes. A text of fewer than n
words but one at least has itself as its only n-gram.

Defined cases: null and empty texts have no n-grams and no links; repeated rows of an id are copies of each other; rows with a null
id have neither class nor links; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm import graph, words
from siftwright.llm.common import ship, stored, text_or_empty

BLOCK, SKETCH_BLOCK = 128, 1024
#: Up to this many candidate documents are broadcast to find their texts.
BROADCAST_CANDIDATES = 500_000


def bands_and_rows(threshold: float, recall: float, most_hashes: int = 256) -> tuple[int, int]:
    """Bands, and rows of a band: as many rows as ``most_hashes`` allow, and as many bands as recall at the threshold then needs."""
    for rows in range(16, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= most_hashes:
            return bands, rows
    raise ValueError("no choice of bands reaches that recall")


def _sets(texts: pa.Array, n: int) -> list[np.ndarray]:
    """The sorted distinct n-gram hashes of each text."""
    h, counts = words.hashes(texts)
    grams, _ = words.windows(h, counts, n)
    m = np.maximum(counts - (n - 1), 0)
    ends, word_ends = np.cumsum(m), np.cumsum(counts)
    out = []
    for e, k, we, c in zip(ends.tolist(), m.tolist(), word_ends.tolist(), counts.tolist(), strict=True):
        if k:
            out.append(np.unique(grams[e - k : e]))
        else:
            out.append(words.of_ranges(h[we - c : we], np.array([0]), np.array([c])) if c else np.zeros(0, np.uint64))
    return out


def features(docs: DataFrame, n: int, bands: int, rows: int, seed: int = 1) -> DataFrame:
    """doc_id, print (digest of the n-gram set, null if it is empty), bands (hashes), sketch (the low byte of each MinHash value)."""
    schema = pa.schema([("doc_id", pa.int64()), ("print", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.binary())])
    factors = np.random.default_rng(seed).integers(0, 1 << 63, (bands * rows, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def permuted(grams: np.ndarray, f: np.ndarray) -> np.ndarray:
        h = grams * f[0]
        h ^= h >> np.uint64(32)
        h *= f[1]
        return h

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.in_parts(batch, 1):
                sets = _sets(b.column(1), n)
                full = [i for i, s in enumerate(sets) if len(s)]
                prints = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                keys: list[list[int]] = [[] for _ in sets]
                sketches: list[bytes | None] = [None] * len(sets)
                if full:
                    grams = np.concatenate([sets[i] for i in full])
                    sizes = np.array([len(sets[i]) for i in full])
                    starts = np.cumsum(sizes) - sizes
                    least = np.stack([np.minimum.reduceat(permuted(grams, f), starts) for f in factors], axis=1)
                    at = np.arange(len(full) * bands) * rows
                    hashed = words.of_ranges(words.mix(least.ravel()), at, at + rows).reshape(-1, bands)
                    hashed = words.mix(hashed + np.arange(bands, dtype=np.uint64)).view(np.int64)
                    low = words.mix(least).astype(np.uint8)
                    for i, k, x in zip(full, hashed.tolist(), low, strict=True):
                        keys[i], sketches[i] = k, x.tobytes()
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(sketches, pa.binary())], schema=schema)

    ship(docs.sparkSession)
    return docs.select("doc_id", text_or_empty().alias("text")).mapInArrow(run, "doc_id long, print binary, bands array<long>, sketch binary")


def _agreement(sketches: np.ndarray) -> np.ndarray:
    """In how many columns each two rows agree."""
    out = np.zeros((len(sketches), len(sketches)), np.uint16)
    for c in np.ascontiguousarray(sketches.T):
        out += c[:, None] == c[None, :]
    return out


def candidates(reps: DataFrame, threshold: float, hashes: int) -> DataFrame:
    """a, b: links of representatives (rep, bands, sketch) that share a band and whose sketches can be those of similar sets."""
    need = int(np.floor(hashes * threshold - 6 * np.sqrt(hashes * threshold * (1 - threshold))))
    keyed = reps.select("rep", F.explode("bands").alias("key"))
    sizes = keyed.groupBy(F.col("key").alias("k")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k", F.ceil(F.col("n") / SKETCH_BLOCK).cast("int").alias("blocks"))
    members = keyed.join(sizes, keyed["key"] == sizes["k"]).select("key", "rep", "blocks")
    own = reps.select(F.col("rep").alias("r"), "sketch")
    placed = members.join(own, members["rep"] == own["r"]).withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = placed.withColumn("_o", other).select("key", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "rep", "sketch")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def parts(ids: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(ids) == 2:
            yes = (sketches[0] == sketches[1]).sum() >= need
            return (ids.max(keepdims=True), ids.min(keepdims=True)) if yes else (ids[:0], ids[:0])
        roots = _roots(_agreement(sketches) >= need, ids)
        linked = roots != ids
        return ids[linked], roots[linked]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def links(t: pa.Table) -> pa.RecordBatch:
            key, i, j, ids = (t.column(c).to_numpy() for c in range(4))
            sketches = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint8).reshape(len(ids), -1)
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            found = [parts(ids[s:e], sketches[s:e]) for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)], strict=True) if e - s > 1]
            a, b = (np.concatenate([f[x] for f in found]) if found else ids[:0] for x in (0, 1))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], schema=schema)

        for b in batches:
            t = pa.Table.from_batches([b])
            t = pa.concat_tables([held, t]) if held is not None else t
            key, i, j = (t.column(c).to_numpy() for c in range(3))
            # the last bucket may go on in the next batch
            cuts = np.flatnonzero((key[1:] != key[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
            if len(cuts):
                yield links(t.slice(0, int(cuts[-1])))
                t = t.slice(int(cuts[-1])).combine_chunks()
            held = t
        if held is not None and held.num_rows:
            yield links(held)

    return tasks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j").mapInArrow(run, "a long, b long")


def _shared(sets: list[np.ndarray]) -> np.ndarray:
    """Number of n-grams that each two of the sets share, by products of incidence matrices, some thousand n-grams at a time."""
    sizes = np.array([len(s) for s in sets])
    grams, column = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    out = np.zeros((len(sets), len(sets)), np.int64)
    for lo in range(0, len(grams), 4096):
        a, z = np.searchsorted(column, [lo, lo + 4096])
        inside = np.zeros((len(sets), 4096), np.float32)
        inside[row[a:z], column[a:z] - lo] = 1
        out += (inside @ inside.T).astype(np.int64)
    return out


def _linked(sets: list[np.ndarray], side: np.ndarray, same: bool, threshold: tuple[int, int]) -> np.ndarray:
    """Which two are at least as similar as the threshold, a fraction. Of two blocks, only pairs across count: others have their own task."""
    sizes = np.array([len(s) for s in sets])
    both = _shared(sets)
    up, down = threshold
    yes = down * both >= up * (sizes[:, None] + sizes[None, :] - both)
    np.fill_diagonal(yes, False)
    return yes if same else yes & (side[:, None] != side[None, :])


def _roots(yes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Least id reachable from each."""
    label = ids.copy()
    while True:
        new = np.minimum(label, np.where(yes, label[None, :], np.iinfo(np.int64).max).min(axis=1))
        if (new == label).all():
            return label
        label = new


def verified(docs: DataFrame, groups: DataFrame, n: int, threshold: tuple[int, int]) -> DataFrame:
    """rep, root, links (documents), text_links (representatives), a row for each task in which rep has a link. groups: rep, label, copies."""
    sizes = groups.groupBy("label").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("blocks"))
    placed = groups.join(sizes, "label").withColumn("block", F.pmod(F.xxhash64("rep"), "blocks").cast("int"))
    texts = docs.select("doc_id", text_or_empty().alias("text"))
    # rows of one id are copies or of different texts; the text that was hashed is the one with the representative's print
    sets_schema = pa.schema([("rep", pa.int64()), ("print", pa.binary()), ("copies", pa.int64()), ("label", pa.int64()), ("blocks", pa.int32()), ("block", pa.int32()), ("grams", pa.binary())])

    def to_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in words.in_parts(batch, 0):
                sets = [s.tobytes() for s in _sets(b.column(0), n)]
                yield pa.RecordBatch.from_arrays([*b.columns[1:], pa.array(sets, pa.binary())], schema=sets_schema)

    # a candidate is some 100 bytes; beyond the bound, texts are shuffled to them
    placed = F.broadcast(placed) if groups.count() <= BROADCAST_CANDIDATES else placed
    found = texts.join(placed, texts["doc_id"] == placed["rep"]).select("text", "rep", "print", "copies", "label", "blocks", "block")
    sets = found.mapInArrow(to_sets, "rep long, print binary, copies long, label long, blocks int, block int, grams binary")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    tasks = sets.withColumn("_o", other).select("label", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "rep", "print", "copies", "grams")
    schema = pa.schema([("rep", pa.int64()), ("root", pa.int64()), ("links", pa.int64()), ("text_links", pa.int64())])

    def judge(rows: list[dict]) -> pa.RecordBatch:
        kept: dict[int, dict] = {}
        for r in rows:
            if hashlib.blake2b(r["grams"], digest_size=16).digest() == r["print"]:
                kept.setdefault(r["rep"], r)
        rows = list(kept.values())
        if len(rows) < 2:
            return pa.RecordBatch.from_pylist([], schema)
        ids, copies, side = (np.array([r[c] for r in rows], np.int64) for c in ("rep", "copies", "block"))
        yes = _linked([np.frombuffer(r["grams"], np.uint64) for r in rows], side, rows[0]["i"] == rows[0]["j"], threshold)
        some = yes.any(axis=1)
        columns = (ids, _roots(yes, ids), yes @ copies, yes.sum(axis=1))
        return pa.RecordBatch.from_arrays([pa.array(c[some]) for c in columns], schema=schema)

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for b in batches:
            for r in b.to_pylist():
                if (k := (r["label"], r["i"], r["j"])) != key:
                    if len(rows) > 1:
                        yield judge(rows)
                    key, rows = k, []
                rows.append(r)
        if len(rows) > 1:
            yield judge(rows)

    dealt = tasks.repartition("label", "i", "j").sortWithinPartitions("label", "i", "j")
    return dealt.mapInArrow(pairs, "rep long, root long, links long, text_links long")


def join(docs: DataFrame, n: int = 5, threshold: tuple[int, int] = (4, 5), recall: float = 0.9999) -> DataFrame:
    """For each row of docs: doc_id, class_id (least id of all it is linked to, directly or through others), n_links (other rows
    that are similar to it, copies included), n_text_links (other n-gram sets), copies (rows with its n-gram set, itself included)."""
    bands, rows = bands_and_rows(threshold[0] / threshold[1], recall)
    seen = stored(features(docs, n, bands, rows))
    reps = stored(seen.filter("print IS NOT NULL AND doc_id IS NOT NULL").groupBy("print").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.min_by(F.struct("bands", "sketch"), "doc_id").alias("f")).select("print", "rep", "copies", "f.bands", "f.sketch"))
    labels = graph.components(candidates(reps, threshold[0] / threshold[1], bands * rows))
    groups = stored(labels.join(reps.select("rep", "copies", "print"), labels["node"] == reps["rep"]).select("rep", "label", "copies", "print"))
    links = stored(verified(docs, groups, n, threshold))
    classes = graph.components(links.select(F.col("rep").alias("a"), F.col("root").alias("b"))).select(F.col("node").alias("c_rep"), F.col("label").alias("class"))
    sums = links.groupBy(F.col("rep").alias("s_rep")).agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    known = reps.select(F.col("print").alias("p"), "rep", "copies")
    known = known.join(classes, known["rep"] == classes["c_rep"], "left").join(sums, known["rep"] == sums["s_rep"], "left")
    known = stored(known.select("p", F.coalesce("class", "rep").alias("class_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("text_links", F.lit(0)).alias("text_links")))
    rows_ = seen.select("doc_id", "print").withColumn("print", F.when(F.col("doc_id").isNotNull(), F.col("print")))
    return rows_.join(known, rows_["print"] == known["p"], "left").select(
        "doc_id",
        F.coalesce("class_id", "doc_id").alias("class_id"),
        (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_links"),
        F.coalesce("text_links", F.lit(0)).cast("long").alias("n_text_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
    )


def one_of_each(docs: DataFrame, joined: DataFrame) -> DataFrame:
    """docs without those that a document of smaller id stands for; of repeated rows of an id, all stay. A null id stays."""
    gone = joined.filter("class_id <> doc_id").select(F.col("doc_id").alias("_neardup_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_neardup_gone"], "left_anti")

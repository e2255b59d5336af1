"""Approximate nearest neighbours by cosine: inverted lists and an adaptive scan over column blocks of rotated vectors.

Vectors are scaled to length 1 and rotated by a random orthogonal matrix, so that any first d of D coordinates of a difference are a
fair sample of the whole: with d coordinates seen, partial distance times D / d estimates the distance, with a relative error of
order 1 / sqrt(d). Centroids are fitted on a bounded sample; every vector is put in the list of its nearest centroid, and lists are cut
into pieces of bounded size, and pieces dealt to groups, each of which a task holds at once. A query probes its ``FIRST`` nearest lists;
then, with its k-th best score known, every list that may hold a better one at the chosen error rate; and all lists if it has found
fewer than k. It goes once to each group with a list that it probes. There, coordinates are read in blocks of columns; after each
block a test drops the candidates whose partial distance already shows, at the chosen error rate, that they lie beyond the query's
k-th nearest so far, that of the first probe included. Survivors are measured exactly, in double precision, on the original vectors.

The sample bounds the number of lists, to a quarter of its vectors; beyond that, lists grow and are cut into more pieces.

Defined cases: vectors that are null, zero, of another length than the most frequent (of two, the shorter), or hold a null or non-finite component take no part;
a query without candidates has no rows; ties go to the smaller id; of rows with one id, each is a candidate of its own but a query is
never its own candidate by id; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm.common import ship, stored

SAMPLE = 16_384
PIECE = 2_048
#: Vectors of a group, about; lists of the first probe.
GROUP, FIRST = 32_768, 4
#: Pieces of a list go to consecutive groups from this multiple of its number on.
SPREAD = 7_919
BLOCK = 16
#: Width of the test, in standard errors.
EPSILON = 2.1


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (double array): the vectors that take part."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    bad = F.exists(F.col("v"), lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).alias("id"), v.alias("v")).filter("id IS NOT NULL AND v IS NOT NULL")
    return rows.filter(~bad & F.exists(F.col("v"), lambda x: x != 0.0))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    big = np.abs(x).max(axis=1, keepdims=True)
    x = x / big  # squares neither overflow nor vanish
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def rotation(dim: int, seed: int = 5) -> np.ndarray:
    """A random orthogonal matrix, by Gram-Schmidt."""
    m = np.random.default_rng(seed).standard_normal((dim, dim))
    for i in range(dim):
        for _ in range(2):
            m[i] -= (m[:i] @ m[i]) @ m[:i]
        m[i] /= np.sqrt(m[i] @ m[i])
    return m


def centroids(sample: np.ndarray, lists: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """Spherical k-means; a centroid without vectors moves to a vector far from its own."""
    rng = np.random.default_rng(seed)
    distinct = np.unique(sample, axis=0)
    c = distinct[rng.permutation(len(distinct))[:lists]].copy()
    for _ in range(rounds):
        near = sample @ c.T
        of = near.argmax(axis=1)
        total = np.zeros_like(c)
        np.add.at(total, of, sample)
        norm = np.sqrt((total * total).sum(axis=1))
        empty = norm < 1e-12
        c = np.where(empty[:, None], c, total / np.maximum(norm, 1e-12)[:, None])
        if empty.any():
            worst = np.argsort(near.max(axis=1))[: int(empty.sum())]
            c[np.flatnonzero(empty)[: len(worst)]] = sample[worst]
    return c


def cosines(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of q and each row of x, in double precision; rows with equal components get equal values."""
    q, x = q / np.abs(q).max(), x / np.abs(x).max(axis=1, keepdims=True)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))


def scan(q: np.ndarray, x: np.ndarray, k: int, epsilon: float = EPSILON, block: int = BLOCK, rows: np.ndarray | None = None, bound: float = np.inf) -> np.ndarray:
    """Of rows of x (all if not given), those that may be among the k nearest to q, and no farther than bound, a squared distance. Both
    are rotated, of length 1; ties at the bound stay.

    After each block of columns, the k rows that look nearest are measured fully, which tightens the bound; then every row is put to
    the test whether its partial distance is consistent with a distance within the bound."""
    dim = x.shape[1]
    alive = np.arange(len(x)) if rows is None else rows
    part, seen = np.zeros(len(alive)), 0
    while seen < dim and len(alive) and (len(alive) > k or bound < np.inf):
        part = part + ((x[alive, seen : seen + block] - q[seen : seen + block]) ** 2).sum(axis=1)
        seen = min(dim, seen + block)
        if len(alive) > k:
            nearest = alive[np.argpartition(part, k - 1)[:k]]
            bound = min(bound, ((x[nearest] - q) ** 2).sum(axis=1).max())
        slack = (1 + epsilon / np.sqrt(seen)) ** 2 if seen < dim else 1.0
        keep = part * (dim / seen) <= bound * slack + 1e-9
        alive, part = alive[keep], part[keep]
    return alive


def reach(cos_q: np.ndarray, cos_members: np.ndarray, score: np.ndarray) -> np.ndarray:
    """How far, in units of what directions around its centroid can give, a list must reach to hold the score: cosines of query and of members to the centroid."""
    side = np.sqrt(np.maximum(1 - cos_q**2, 0)) * np.sqrt(np.maximum(1 - cos_members**2, 0))
    return (score - cos_q * cos_members) / np.maximum(side, 1e-9)


def enough_reach(sample: np.ndarray, centres: np.ndarray, k: int, target: float, queries: int = 200) -> float:
    """The reach that the lists of the target share of the sample queries' k nearest in the sample have at least."""
    k = min(k, len(sample) - 1)
    if k < 1:
        return np.inf
    near = sample[:queries] @ sample.T
    near[np.arange(len(near)), np.arange(len(near))] = -np.inf
    to = sample @ centres.T
    own = to.argmax(axis=1)
    mean = np.bincount(own, to.max(axis=1), len(centres)) / np.maximum(np.bincount(own, minlength=len(centres)), 1)
    best = np.argpartition(-near, k - 1, axis=1)[:, :k]
    last = np.take_along_axis(near, best, axis=1).min(axis=1)
    needed = reach(to[: len(near)][np.arange(len(near))[:, None], own[best]], mean[own[best]], last[:, None])
    return float(np.quantile(needed, target))


def search(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", lists: int | None = None, target: float = 0.97) -> DataFrame:
    """query_id, rank, vec_id, score: for each vector for which is_query holds, the k nearest others that are found.

    lists: half the square root of the number of vectors unless given. A query probes its nearest lists, and then the others that come
    near enough for the target share of true neighbours, as the sample shows it. is_query is of the column id."""
    spark = vectors.sparkSession
    ship(spark)
    rows = stored(usable(vectors, id_col, vector_col).withColumn("d", F.size("v")))
    result = "query_id long, rank int, vec_id long, score double"
    shape = rows.groupBy("d").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "d").first()
    if not shape:
        return spark.createDataFrame([], result)
    n, dim = shape["n"], shape["d"]
    rows = rows.filter(F.col("d") == dim).select("id", "v")
    lists = lists or min(SAMPLE // 4, max(1, round(n**0.5 / 2)))
    chosen = rows.orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow().column(0).combine_chunks()
    turn = rotation(dim)
    sample = _unit(_matrix(chosen.chunk(0) if isinstance(chosen, pa.ChunkedArray) else chosen)) @ turn.T
    centres = centroids(sample, lists)
    probes = min(FIRST, len(centres))
    most = enough_reach(sample, centres, k, target)

    listed = pa.schema([("id", pa.int64()), ("v", pa.list_(pa.float64())), ("query", pa.bool_()), ("lists", pa.list_(pa.int32())), ("near", pa.float64())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            near = (_unit(_matrix(b.column(1))) @ turn.T) @ centres.T
            query = b.column(2).to_numpy(zero_copy_only=False)
            home = near.argmax(axis=1)
            best = np.argpartition(-near, probes - 1, axis=1)[:, :probes]
            # a query's own list is always among those it probes
            out = [([h, *(p for p in ps if p != h)][:probes] if q else [h]) for h, ps, q in zip(home.tolist(), best.tolist(), query.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1).cast(pa.list_(pa.float64())), b.column(2), pa.array(out, pa.list_(pa.int32())), pa.array(near.max(axis=1))], schema=listed)

    placed = stored(rows.withColumn("query", F.coalesce(is_query, F.lit(False))).mapInArrow(assign, "id long, v array<double>, query boolean, lists array<int>, near double"))
    # as many rows as lists; lists are cut into pieces that a task holds at once
    sizes = stored(placed.groupBy(F.col("lists")[0].alias("list")).agg(F.ceil(F.count(F.lit(1)) / PIECE).cast("int").alias("pieces"), F.avg("near").alias("near")))
    used = sizes.toPandas()
    used_lists, mean = used["list"].to_numpy().astype(np.int64), used["near"].to_numpy()
    n_pieces = np.zeros(len(centres), np.int64)
    n_pieces[used_lists] = used["pieces"]
    pieces = F.broadcast(sizes.select("list", "pieces"))
    groups = max(-(-n // GROUP), min(len(used), 2 * spark.sparkContext.defaultParallelism))
    no_lists, no_score = F.lit(None).cast("array<int>"), F.lit(None).cast("double")
    members = placed.withColumn("list", F.col("lists")[0]).join(pieces, "list").withColumn("piece", F.pmod(F.xxhash64("id"), "pieces").cast("int"))
    members = members.select(F.pmod(F.col("list").cast("long") * SPREAD + F.col("piece"), F.lit(groups)).cast("int").alias("group"), F.lit(0).alias("query"), "list", "id", "v", no_lists.alias("lists"), no_score.alias("last"))
    # of rows of a query with one direction, one asks
    direction = F.expr("transform(v, x -> x / array_max(transform(v, y -> abs(y))) + 0.0D)")
    queries = stored(placed.filter("query").withColumn("direction", direction).dropDuplicates(["id", "direction"]).drop("direction"))
    found = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, ids, x, turned, where = None, [], None, None, None, {}

        def look(query_id: int, q: np.ndarray, wanted: list[int], last: float) -> tuple[np.ndarray, np.ndarray] | None:
            rows = [np.arange(*where[i]) for i in wanted if i in where]
            rows = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            rows = rows[ids[rows] != query_id]
            at = scan(_unit(q[None])[0] @ turn.T, turned, k, rows=rows, bound=2 - 2 * last + 1e-9 if np.isfinite(last) else np.inf)
            if not len(at):
                return None
            score = cosines(q, x[at])
            best = np.lexsort((ids[at], -score))[:k]
            return ids[at][best], score[best]

        for b in batches:
            if not b.num_rows:
                continue
            of, kinds, names, values = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(3).to_numpy(), _matrix(b.column(4))
            starts = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (kinds[1:] != kinds[:-1])]))
            for at, end in zip(starts.tolist(), [*starts[1:].tolist(), len(of)], strict=True):
                if of[at] != key:
                    key, held, ids = of[at], [], None
                if kinds[at] == 0:
                    held.append((b.column(2).slice(at, end - at).to_numpy(), names[at:end], values[at:end]))
                    continue
                if ids is None:  # members come before queries, by list
                    in_list, ids, x = (np.concatenate(c) for c in zip(*held, strict=True)) if held else (np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros((0, dim)))
                    turned, held = _unit(x) @ turn.T if len(x) else x, []
                    first = np.flatnonzero(np.concatenate([[True], in_list[1:] != in_list[:-1]])) if len(x) else np.zeros(0, np.int64)
                    where = dict(zip(in_list[first].tolist(), zip(first.tolist(), [*first[1:].tolist(), len(x)], strict=True), strict=True))
                lists_of, last_of = b.column(5).slice(at, end - at).to_pylist(), b.column(6).slice(at, end - at).to_pylist()
                out = [(q, r) for q, v, w, s in zip(names[at:end].tolist(), values[at:end], lists_of, last_of, strict=True) if (r := look(q, v, w, s)) is not None]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat([q for q, _ in out], [len(r[0]) for _, r in out])), pa.array(np.concatenate([r[0] for _, r in out])), pa.array(np.concatenate([r[1] for _, r in out]))], schema=found)

    asked_schema = pa.schema([("group", pa.int32()), ("query", pa.int32()), ("list", pa.int32()), ("id", pa.int64()), ("v", pa.list_(pa.float64())), ("lists", pa.list_(pa.int32())), ("last", pa.float64())])

    def dealt_out(b: pa.RecordBatch, wanted: list[np.ndarray], last: np.ndarray) -> pa.RecordBatch:
        """Each query (id, v, ...) of the batch once to every group with a piece of a wanted list."""
        row, of, lists = [], [], []
        for i, w in enumerate(wanted):
            which = np.repeat(np.arange(len(w)), n_pieces[w])
            nth = np.arange(len(which)) - np.repeat(np.cumsum(n_pieces[w]) - n_pieces[w], n_pieces[w])
            pairs = np.unique(np.stack([(w[which] * SPREAD + nth) % groups, w[which]], axis=1), axis=0)
            cuts = np.flatnonzero(np.diff(pairs[:, 0])) + 1
            for part in np.split(pairs, cuts) if len(pairs) else []:
                row.append(i)
                of.append(part[0, 0])
                lists.append(part[:, 1].astype(np.int32))
        at = pa.array(row, pa.int64())
        same = lambda x: pa.array(np.full(len(row), x, np.int32))
        return pa.RecordBatch.from_arrays([pa.array(of, pa.int32()), same(1), same(0), b.column(0).take(at), b.column(1).cast(pa.list_(pa.float64())).take(at), pa.array(lists, pa.list_(pa.int32())), pa.array(last[row] if row else [], pa.float64())], schema=asked_schema)

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield dealt_out(b, [np.array([p for p in ps if n_pieces[p]], np.int64) for ps in b.column(2).to_pylist()], np.full(b.num_rows, -np.inf))

    def widen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            to = ((_unit(_matrix(b.column(1))) @ turn.T) @ centres.T)[:, used_lists]
            last = b.column(3).to_numpy(zero_copy_only=False)
            wanted = (reach(to, mean[None], last[:, None]) <= most) | ~np.isfinite(last)[:, None]
            yield dealt_out(b, [np.setdiff1d(used_lists[w], had) for w, had in zip(wanted, b.column(2).to_pylist(), strict=True)], last)

    def looked(asked: DataFrame) -> DataFrame:
        dealt = members.union(asked).repartition(groups, "group").sortWithinPartitions("group", "query", "list", "id")
        return dealt.mapInArrow(probe, "query_id long, vec_id long, score double")

    def ranked(near: DataFrame) -> DataFrame:
        # each candidate row counts
        order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        return near.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)

    kind = "group int, query int, list int, id long, v array<double>, lists array<int>, last double"
    first = stored(ranked(looked(queries.select("id", "v", "lists").mapInArrow(begin, kind))).select("query_id", "vec_id", "score"))
    bounds = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("last"))
    open_ones = queries.join(bounds, F.col("id") == F.col("query_id"), "left").select("id", "v", "lists", F.coalesce("last", F.lit(float("-inf"))).alias("last"))
    more = looked(open_ones.mapInArrow(widen, kind))
    return ranked(first.union(more)).select("query_id", F.col("rank").cast("int"), "vec_id", "score")

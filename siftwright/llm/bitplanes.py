"""Token ids as bit-plane shuffled, zstandard-compressed chunks with a chunk index.

Documents are range-partitioned and sorted by id; every partition writes one shard. A shard is the ids of its documents, one after
the other, cut into chunks of ``CHUNK`` ids. A chunk's body is self-contained::

    4 bytes  b"BPS1"
    u32      number of ids
    u16      number of planes (one for each bit, or each byte, of an id)
    u16      bits of an id in a plane: 1 or 8
    u32[]    stored bytes of each plane; the top bit is set if the plane is raw because zstandard would not shrink it
    ...      the planes, least significant first

Bodies are rows of a Parquet table written by Spark, so that any store Spark can write will do and the committer sees to lost and
repeated tasks. The other columns are the chunk index: shard, chunk, position of the first id in the shard, number of ids, crc32
of the ids, and the parts of documents in the chunk (id, first id of the document in the shard, its length, part's offset and
length). Reading a range of ids touches only the chunks that the index names.

Defined cases: null text counts as empty and gives just the end id; rows of equal id are neighbours, in order of text; null ids
come first; an empty table gives no chunks; further columns are ignored. Documents longer than a chunk span several.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftwright.llm.common import shared_dir, ship, text_or_empty

CHUNK = 1 << 15
MAGIC = b"BPS1"
RAW = 1 << 31

CHUNK_SCHEMA = "shard int, chunk int, first long, n_ids int, crc long, parts array<struct<doc_id:long,doc_first:long,doc_ids:long,at:int,n:int>>, body binary"
PART = pa.struct([("doc_id", pa.int64()), ("doc_first", pa.int64()), ("doc_ids", pa.int64()), ("at", pa.int32()), ("n", pa.int32())])
CHUNK_ARROW = pa.schema([("shard", pa.int32()), ("chunk", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("crc", pa.int64()), ("parts", pa.list_(PART)), ("body", pa.binary())])


def pack(ids: np.ndarray, id_bytes: int = 2, mode: str = "bit", level: int = 3) -> bytes:
    """ids below 256 ** id_bytes as one chunk body."""
    import zstandard

    c = zstandard.ZstdCompressor(level=level)
    octets = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if octets[:, id_bytes:].any():
        raise ValueError(f"an id needs more than {id_bytes} bytes")
    planes = np.ascontiguousarray(octets[:, :id_bytes].T)
    if mode == "bit":
        planes = np.packbits((planes[:, None, :] >> np.arange(8, dtype=np.uint8)[:, None]) & 1, axis=2).reshape(8 * id_bytes, -1)
    sizes, bodies = [], []
    for p in planes:
        raw = p.tobytes()
        small = c.compress(raw)
        bodies.append(raw if len(small) >= len(raw) else small)
        sizes.append(len(bodies[-1]) | (RAW if len(small) >= len(raw) else 0))
    return b"".join([MAGIC, struct.pack("<IHH", len(ids), len(planes), 1 if mode == "bit" else 8), struct.pack(f"<{len(planes)}I", *sizes), *bodies])


def unpack(body: bytes | pa.Buffer) -> np.ndarray:
    import zstandard

    body = memoryview(body)
    if bytes(body[:4]) != MAGIC:
        raise ValueError("not a chunk")
    d = zstandard.ZstdDecompressor()
    n, count, bits = struct.unpack_from("<IHH", body, 4)
    at, sizes, planes = 12 + 4 * count, struct.unpack_from(f"<{count}I", body, 12), []
    width = (n + 7) // 8 if bits == 1 else n
    for s in sizes:
        stored = body[at : at + (s & (RAW - 1))]
        planes.append(np.frombuffer(stored if s & RAW else d.decompress(stored, max_output_size=width), np.uint8))
        at += s & (RAW - 1)
    grid = np.stack(planes) if planes else np.zeros((0, 0), np.uint8)
    if bits == 1:
        spread = np.unpackbits(grid, axis=1, count=n).reshape(count // 8, 8, n)
        grid = np.zeros((count // 8, n), np.uint8)
        for b in range(8):
            grid |= spread[:, b] << b
    out = np.zeros((n, 4), np.uint8)
    out[:, : len(grid)] = grid.T
    return out.view("<u4").ravel()


def _cut(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Documents of these places, cut at chunks: document and place of each part."""
    a = starts // CHUNK
    n = (starts + sizes - 1) // CHUNK - a + 1
    doc = np.repeat(np.arange(len(starts)), n)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, np.where(nth == 0, starts[doc], (a[doc] + nth) * CHUNK)


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int, id_bytes: int = 2, mode: str = "bit", level: int = 3) -> None:
    """Encodes docs (doc_id, text) and writes the shards under path."""

    def shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        from siftwright.llm.tokens import encoder

        e, number = encoder(tokenizer), TaskContext.get().partitionId()
        # ids that don't fill a chunk yet; place, document's first id, its ids and length of each part of them; ids in full chunks, and in all
        ids, held = np.zeros(0, np.uint32), [np.zeros(0, np.int64)] * 4
        before = seen = 0

        def rows(ids: np.ndarray, parts: list[np.ndarray], before: int, sizes: list[int]) -> pa.RecordBatch:
            """Of ids, the chunks of these sizes. A part's chunk is its place before ``before``, by the size of full chunks."""
            ends = np.cumsum(sizes)
            each = [ids[z - n : z] for n, z in zip(sizes, ends.tolist(), strict=True)]
            chunk = parts[0] // CHUNK
            offsets = np.searchsorted(chunk, before // CHUNK + np.arange(len(sizes) + 1))
            place = parts[0] - chunk * CHUNK
            # doc_id may be null: its column is Arrow, the others numpy
            body = pa.StructArray.from_arrays([parts[1], *(pa.array(p.astype(np.int64)) for p in parts[2:4]), pa.array(place.astype(np.int32)), pa.array(parts[4].astype(np.int32))], fields=list(PART))
            return pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(sizes), number, np.int32)),
                    pa.array((before // CHUNK + np.arange(len(sizes))).astype(np.int32)),
                    pa.array(before + ends - sizes),
                    pa.array(sizes, pa.int32()),
                    pa.array([zlib.crc32(x) for x in each], pa.int64()),
                    pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), body),
                    pa.array([pack(x, id_bytes, mode, level) for x in each], pa.binary()),
                ],
                schema=CHUNK_ARROW,
            )

        names: list[pa.Array] = []
        for batch in batches:
            lo = 0
            for more, sizes in e.with_ends(batch.column(1), end_id):
                starts = seen + np.cumsum(sizes) - sizes
                doc, first = _cut(starts, sizes)
                last = np.minimum(starts[doc] + sizes[doc], (first // CHUNK + 1) * CHUNK)
                names.append(batch.column(0).slice(lo, len(sizes)).take(pa.array(doc)))
                held = [np.concatenate(x) for x in zip(held, (first, starts[doc], sizes[doc], last - first), strict=True)]
                ids = np.concatenate([ids, more])
                lo, seen = lo + len(sizes), seen + len(more)
                if full := len(ids) // CHUNK:
                    all_names = pa.concat_arrays(names)
                    n = int(np.searchsorted(held[0], before + full * CHUNK))
                    yield rows(ids, [held[0][:n], all_names.slice(0, n), *(h[:n] for h in held[1:])], before, [CHUNK] * full)
                    before += full * CHUNK
                    ids, held, names = ids[full * CHUNK :].copy(), [h[n:] for h in held], [all_names.slice(n)]
        if len(ids):
            yield rows(ids, [held[0], pa.concat_arrays(names), *held[1:]], before, [len(ids)])

    ship(docs.sparkSession)
    ordered = docs.select("doc_id", text_or_empty().alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(shard, CHUNK_SCHEMA).write.option("compression", "uncompressed").parquet(path)


def chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CHUNK_SCHEMA).parquet(path)


_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials over GF(2), modulo that of crc32, in its reflected bit order."""
    out = 0
    for k in range(31, -1, -1):
        if a >> k & 1:
            out ^= b
        b = b >> 1 ^ (_POLY if b & 1 else 0)
    return out


def _shift(n_bytes: int) -> int:
    """x to the power 8 * n_bytes."""
    out, base, e = 1 << 31, 1 << 30, 8 * n_bytes
    while e:
        if e & 1:
            out = _times(base, out)
        base, e = _times(base, base), e >> 1
    return out


def crc_of_parts(parts: list[tuple[int, int]]) -> int:
    """crc32 of a whole from (bytes, crc32) of its parts in order."""
    out = 0
    for n, crc in parts:
        out = _times(_shift(n), out) ^ crc
    return out


def documents(spark: SparkSession, path: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32. Every chunk is decoded and held against its crc."""

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                shard, chunk, crc = (batch.column(i)[row].as_py() for i in (0, 1, 4))
                data = memoryview(unpack(batch.column(6)[row].as_buffer()).astype("<u4", copy=False)).cast("B")
                if zlib.crc32(data) != crc:
                    raise ValueError(f"shard {shard}, chunk {chunk} is damaged")
                doc_id, doc_first, doc_ids, at, n = batch.column(5)[row].values.flatten()
                begin = 4 * at.to_numpy()
                crcs = [zlib.crc32(data[i:j]) for i, j in zip(begin.tolist(), (begin + 4 * n.to_numpy()).tolist(), strict=True)]
                same = lambda x, t, n=len(crcs): pa.array(np.full(n, x), t)
                yield pa.RecordBatch.from_arrays([same(shard, pa.int32()), doc_first, doc_id, doc_ids, same(chunk, pa.int32()), n.cast(pa.int64()), pa.array(crcs, pa.int64())], schema=part_schema)

    part_schema = pa.schema([("shard", pa.int32()), ("doc_first", pa.int64()), ("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("chunk", pa.int32()), ("n", pa.int32()), ("crc", pa.int64())])

    @F.pandas_udf("long")
    def joined(s):  # noqa: ANN001, ANN202
        return s.map(lambda ps: ps[0]["crc"] if len(ps) == 1 else crc_of_parts([(4 * p["n"], p["crc"]) for p in ps]))

    ship(spark)
    found = chunks(spark, path).mapInArrow(parts, "shard int, doc_first long, doc_id long, n_tokens long, chunk int, n int, crc long")
    whole = found.groupBy("shard", "doc_first").agg(F.first("doc_id").alias("doc_id"), F.first("n_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("chunk", "n", "crc"))).alias("ps"))
    # as many rows as shards, that is, partitions
    before = chunks(spark, path).groupBy("shard").agg(F.sum("n_ids").alias("_n")).select("shard", F.coalesce(F.sum("_n").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    return whole.join(F.broadcast(before), "shard").select("doc_id", (F.col("_base") + F.col("doc_first")).alias("start"), "n_tokens", joined("ps").alias("ids_crc32"))


def round_trip(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Writes docs to a folder that all executors share and returns documents() of it."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/siftwright-ids-{uuid.uuid4().hex}"
    write(docs, path, tokenizer, end_id)
    return documents(spark, path)
